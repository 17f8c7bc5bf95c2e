"""Chunk reuse against the tokenizers library on whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediashelf.llm import chunked_bpe as cb


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(cb.TOKENIZER)


def check(docs, library, **options):
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, library.encode(r["text"] or "", add_special_tokens=False).ids)
                  for r in docs.select("doc_id", "text").collect())
    rows = cb.decode(cb.encode(docs, **options)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"])) for r in rows) == want
    for r in rows:
        assert r["text"] == library.decode(list(r["ids"]), skip_special_tokens=False)


def test_documents(documents, library):
    check(documents, library, block_bytes=100_000)


def test_odd_rows(odd_docs, library):
    check(odd_docs, library)
    check(odd_docs, library, size=(20, 16, 60), block_bytes=500)
    check(odd_docs.limit(0), library)


#: Characters at which a cut can do harm: marks, jamo, case and composition rules, control tokens, contractions.
PARTS = [*" \n\t  abcXYZ012.,!'", "é", "ñ", "日", "本", "語", "İ", "ſ", "̈", "̣", "ᄀ", "ᅡ", "ᆨ", "각", "ᆨ",
         "क", "़", "क़", "ẛ", "ﬁ", "<|endoftext|>", "<|startoftext|>", "'ll", "'re", "'s", "hello ", "word",
         "  ", "é", "<|end", "of", "text|>", "뀀ᆨ", "​", "\x00"]


def test_joins_anywhere(spark, library):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        own = rng.sample(PARTS, rng.choice([1, 2, 4, 8, len(PARTS)]))
        rows.append((i, "".join(rng.choice(own) for _ in range(rng.choice([0, 1, 5, 30, 100, 400])))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(docs, library, size=(16, 8, 40), block_bytes=4000)


def test_chunks_are_encoded_whole_without_units(spark, library, documents):
    check(documents.limit(40), library, word_units=False, block_bytes=50_000)


def test_runs_without_borders_are_encoded_in_growing_parts(library):
    encoder = cb.Encoder.get(open(cb.TOKENIZER, encoding="utf-8").read())
    seen = []

    class Counting:
        margin = encoder.margin

        def encode(self, texts):
            seen.extend(map(len, texts))
            return encoder.encode(texts)
    text = b"x" * 6000 + b" end of it, and more words follow here" * 3
    starts = [*range(0, len(text), 50), len(text)]
    parts = [text[a:b] for a, b in zip(starts, starts[1:])]
    chunks = [cb.Chunk.of(len(t), e, encoder.margin) for t, e in zip(parts, encoder.encode(parts))]
    windows = cb.join_windows(text, starts, chunks, encoder.margin)
    got = cb.join_chunks(text, starts, chunks, encoder.encode(windows), Counting())
    assert got.tolist() == library.encode(text.decode(), add_special_tokens=False).ids
    assert sum(seen) < 6 * len(text)


def test_simple_units_equal_the_whole_tokenizer(library):
    """Every composed Latin letter and printable character, alone, beside others and in contractions."""
    encoder = cb.Encoder(open(cb.TOKENIZER, encoding="utf-8").read())
    assert encoder.plain
    rng = random.Random(9)
    chars = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)]]
    units = [c for c in chars] + [a + c + b for c in chars for a, b in (("a", "b"), ("1", "!"), ("'", "s"))]
    units += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    units += ["it's", "I'LL", "WE'RE", "'s's", "don't.", "<|endoftext|>", "x<|startoftext|>y", "a" * 60, "'ll'"]
    simple = 0
    for u, e in zip(units, encoder.encode([u.encode() for u in units])):
        assert e.ids.tolist() == library.encode(u, add_special_tokens=False).ids, u
        simple += encoder.simple(u.encode()) is not None
    assert simple > 500


def test_units_with_the_same_hash_stay_apart(monkeypatch):
    raw = np.frombuffer(b"aa bb aa cc", np.uint8)
    start, end = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 11])
    place, kind = cb.distinct_units(raw, start, end)
    assert len(place) == 3 and kind[0] == kind[2] and len(set(kind.tolist())) == 3
    monkeypatch.setattr(cb, "mix64", lambda h: h * np.uint64(0))
    place, kind = cb.distinct_units(raw, start, end)
    assert place.tolist() == kind.tolist() == [0, 1, 2, 3]


def test_a_full_store_of_units_starts_anew(library, monkeypatch):
    monkeypatch.setattr(cb, "KEPT_UNITS", 30)
    monkeypatch.setattr(cb, "BATCH_BYTES", 200)
    encoder = cb.Encoder(open(cb.TOKENIZER, encoding="utf-8").read())
    rng = random.Random(3)
    texts = [" ".join(rng.choice(PARTS) + rng.choice(PARTS) for _ in range(rng.choice([0, 1, 9, 60]))) for _ in range(200)]
    for t, e in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert e.ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert e.at == sorted(set(e.at)) and all(a < len(t.encode()) for a in e.at)
    assert len(encoder.index) < 200


def test_chunks_cover_texts_and_repeat(spark):
    rng = np.random.default_rng(2)
    passage = bytes(rng.integers(97, 123, 30_000, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) + passage for n in (0, 777, 12_345)] + [b"", "é".encode() * 9000]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    lengths, counts = cb.cut_texts(raw, offsets)
    assert lengths.sum() == len(raw) and lengths.max() <= cb.CHUNK[2] and counts[3] == 0
    ends = np.cumsum(lengths)
    chunks = [raw[a:b].tobytes() for a, b in zip(ends - lengths, ends)]
    for c in chunks:
        c.decode()  # no character is cut
    first, second = (set(chunks[a:b]) for a, b in ((0, counts[0]), (counts[0], counts[:2].sum())))
    assert len(first & second) > counts[0] * 0.7


def test_shared_chunks_are_encoded_by_one_owner(spark, library):
    import pyarrow as pa
    text = " ".join(f"word{i} of a shared passage" for i in range(900))
    docs = spark.createDataFrame([(i, f"{i} {text}") for i in range(40)], "doc_id long, text string").repartition(8)
    check(docs, library, block_bytes=20_000)
    # a block without answers encodes all its chunks, with answers only the others
    encoder = cb.Encoder(open(cb.TOKENIZER, encoding="utf-8").read())
    batch = pa.RecordBatch.from_arrays([pa.array([3, 3]), pa.array([1, 2]), pa.array([text, text[:9000]])], names=["block", "doc_id", "text"])
    block = pa.Table.from_batches(cb.pack_blocks(cb.CHUNK)(iter([batch])))
    keys = cb.block_keys(block).column("k").to_pylist()
    none = pa.table({"k": pa.array([], pa.binary()), "chunk": pa.array([], pa.binary())})
    owned = cb.encode_owned(block, pa.table({"k": pa.array(keys[1:], pa.binary())}), encoder)
    assert sorted(owned.column("k").to_pylist()) == sorted(keys[1:])
    answers = pa.table({"k": owned.column("k"), "chunk": owned.column("chunk")})
    encoded = []
    one = cb._encode_chunks
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cb, "_encode_chunks", lambda found, e: encoded.extend(found) or one(found, e))
        assert cb.encode_block(block, answers, encoder).equals(cb.encode_block(block, none, encoder))
    assert encoded[0] == keys[0] and sorted(encoded[1:]) == sorted(keys)


def test_packed_chunk_round_trip():
    for chunk in (cb.Chunk(np.array([1, 2, 70000], np.uint32), [(0, 0), (5, 2)], (9, 2)), cb.Chunk(np.empty(0, np.uint32), [], None)):
        back = cb.Chunk.unpack(chunk.pack())
        assert back.ids.tolist() == chunk.ids.tolist() and back.heads == chunk.heads and back.tail == chunk.tail


def test_query_digests(spark, library):
    import hashlib
    rows = {r["doc_id"]: r for r in cb.op13_chunked_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    for r in docs.collect():
        ids = library.encode(r["t"], add_special_tokens=False).ids
        got = rows.pop(r["doc_id"])
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert not rows
