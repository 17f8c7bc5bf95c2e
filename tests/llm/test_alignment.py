"""Alignment of two tokenizers against the libraries and a plain statement of the rules."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediashelf.llm import token_alignment as ta


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(ta.FIRST)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=ta.SECOND)
    value = {}
    extra = 0
    for byte in range(256):  # the byte-level alphabet, stated anew
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            value[chr(byte)] = byte
        else:
            value[chr(256 + extra)] = byte
            extra += 1

    def a_tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(value[c] for c in a.id_to_token(i))) for i in ids]

    def b_tokens(text):
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                for i in b.encode(text)]
    return a_tokens, b_tokens


def brute(rows, libraries):
    """The report's rows by comparing all pairs of byte ranges."""
    docs = []
    for doc, text in rows:
        x, y = ([], []) if not text else (libraries[0](text), libraries[1](text))
        want = b" " + (text or "").encode()
        if b"".join(t for _, t in x) != want or b"".join(t for _, t in y) != want:
            x, y = [], []
        spans = []
        for tokens in (x, y):
            at, own = 0, []
            for i, t in tokens:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        text_of = []
        begin = 0
        for end in ends:
            text_of.append("|".join(",".join(str(i) for i, s, e in own if begin <= s and e <= end) for own in spans))
            begin = end
        docs.append((doc, len(x), len(y), len(ends), links,
                     hashlib.sha256(";".join(text_of).encode()).hexdigest() if x else ""))
    count = Counter(p for d in docs for p in set(d[4]))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(d[0], d[1], d[2], d[3], len(d[4]), sum(count[p] == most[p[0]] for p in d[4]), sum(count[p] for p in d[4]), d[5])
            for d in docs]


def key(r):
    return r[0] is None, r[0] or 0, r[1:]


def check(docs, libraries):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in ta.alignment_report(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, libraries), key=key)


def test_documents(documents, libraries):
    check(documents.where("length(text) < 3000"), libraries)  # brute force compares all pairs of ranges


def test_odd_rows(spark, odd_docs, libraries):
    check(odd_docs.where("coalesce(length(text), 0) < 50000"), libraries)
    check(odd_docs.limit(0), libraries)


def test_odd_texts(spark, libraries, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK_ROWS", 50)  # many blocks; workers of this test forget their units again and again
    monkeypatch.setattr(ta, "STEP", 300)
    monkeypatch.setattr(ta, "KEPT_UNITS", 40)
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "  ", " ", "\n", "\t", "\x00", "\r\n", "é", "é", "日本", "😀", "ﬁ",
             "don't", "word", "1234", "!!", "a", "b", "​", " ", "x"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 6, 25])))) for i in range(400)]
    rows += [(1, "same text")] * 40 + [(None, None), (None, " "), (None, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), libraries)


def test_units_are_encoded_as_in_their_text(libraries, documents, monkeypatch):
    """Ids of units, one after the other, are those of the whole text, whatever stands around the spaces."""
    import pyarrow as pa
    rng = random.Random(6)
    around = ["a", "Z", "9", ".", "'", "é", "ß", "я", "日", "\u00a0", "\u0085", "\u2003", "\u3000", "\u1680", "\t", "\n", " ", "'s", "'ll", "e\u0301",
              "<|endoftext|>", "</s>", "😀", "-", "_"]
    texts = [" ".join(rng.choice(around) for _ in range(rng.choice([1, 2, 5, 40]))) for _ in range(800)]
    texts += [r["text"] for r in documents.where("text IS NOT NULL").limit(60).collect()] + ["x" * 1000, " a  b " * 300, " ", ""]
    units = ta.Units(ta.Pair.get(ta.read_files(ta.FIRST, ta.SECOND)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    numbers, of = ta.text_units(units, batch)
    for i, t in enumerate(texts):
        a, b = libraries[0](t) if t else [], libraries[1](t) if t else []
        assert b"".join(x for _, x in a) == b"".join(x for _, x in b) == (b" " + t.encode() if t else b"")
        mine = numbers[of == i]
        assert units.gather("a", mine).tolist() == [k for k, _ in a] and units.gather("b", mine).tolist() == [k for k, _ in b]
    assert len(units.index) == len(units.written) == len(set(numbers.tolist())) < len(numbers)  # each unit once


def test_gallop_equals_bisection():
    rng = random.Random(1)
    for _ in range(300):
        long = sorted(rng.sample(range(500), rng.randint(0, 60)))
        keys = [rng.randint(-3, 510) for _ in range(rng.randint(1, 40))]
        lo = rng.randint(0, len(long))
        hi = rng.randint(lo, len(long))
        n = len(keys)
        guess = np.array([rng.randint(-5, 70) for _ in keys])
        got = ta.gallop(np.array(keys), np.array(long, np.int64), guess, np.full(n, lo), np.full(n, hi))
        assert got.tolist() == [bisect.bisect_left(long, k, lo, hi) for k in keys]


def test_a_pair_counts_once_per_document_and_ties_are_best(spark):
    docs = spark.createDataFrame([(1, "the the the"), (2, "the"), (2, "the"), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_links"], r["n_best"], r["count_sum"]) for r in ta.alignment_report(docs).collect()}
    assert got == {(1, 3, 3, 9), (2, 1, 1, 3), (3, 0, 0, 0)}


def test_groups_cover_all_tokens(spark, documents):
    rows = ta.align(documents).select(
        F.size("a_ids").alias("a"), F.size("b_ids").alias("b"),
        F.aggregate("a_group", F.lit(0), lambda s, x: s + x).alias("ga"), F.aggregate("b_group", F.lit(0), lambda s, x: s + x).alias("gb"))
    assert rows.where("a <> ga OR b <> gb").count() == 0 and rows.where("a > 0").count() > 100
