"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words at the meta space (no piece of a valid model crosses that cut), and each
distinct word of the corpus is segmented once:

1. documents are packed into blocks; each block sends its distinct words to their buckets;
2. the lattice: every distinct word's substrings up to the longest piece meet the piece table
   (broadcast: its size is the vocabulary's) in an equi-join, and the matching edges are grouped by word;
3. the fold over a word's edges;
4. words return to the blocks that hold them, and blocks look their words up.

For a unigram model, 2 and 3 are DataFrame operations: ``lattice`` explodes, joins and groups, and
``viterbi`` folds with Spark's ``aggregate``. For a BPE model the best path of summed scores is not the
model's segmentation, which is defined by merging the best adjacent pair again and again; that fold,
and its lattice, run on whole buckets of words as arrays (``bpe_bucket``), because the row form
exceeded the limits on disk and CPU time (figures in the README).

Blocks name words by 64-bit hashes. Characters without a piece become byte pieces, or the unknown piece where the model has none.
``decode`` reverses the encoding exactly, up to meta space characters written literally in a text,
which the model itself cannot tell from spaces.

The text is taken as it is (identity normalisation) with one meta space in front. Each block
and each word bucket is held by one task; their numbers grow with the text's size.

Defined cases: null and empty texts have no ids; repeated rows are encoded each; a null id stays null;
words of any length are segmented whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import read_table
from ._common import PASS_BYTES, mix64, powers, register
from .suffix_dedup import pack, unpack

META = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A word: meta spaces with what follows them, or a line break (which is in no piece).
WORD = re.compile(f"{META}*[^{META}\n]+|{META}+|\n")
#: Bytes of text in a block of documents, and in a bucket of distinct words at most.
BLOCK_BYTES = 12 << 20
#: Characters of a bucket's words that are segmented together.
STEP_CHARS = 1 << 16


class Pieces:
    """The vocabulary: pieces that texts can match, byte pieces, the unknown id."""

    def __init__(self, table: dict[str, tuple[int, float]], byte_ids: dict[int, int], unknown: int, names: list[str]):
        self.table, self.byte_ids, self.unknown, self.names = table, byte_ids, unknown, names
        if any(META in p.lstrip(META) for p in table) or any("\n" in p and p != "\n" for p in table):
            raise ValueError("pieces that cross words are not supported")
        self.longest = max(map(len, table), default=1)
        self._arrays: PieceArrays | None = None

    def arrays(self) -> "PieceArrays":
        """The table by length, built once in each worker."""
        if self._arrays is None:
            self._arrays = PieceArrays(self)
        return self._arrays

    @classmethod
    def read(cls, path: str = MODEL) -> "Pieces":
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        names = [m.id_to_piece(i) for i in range(n)]
        byte_ids = {int(names[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        table = {names[i]: (i, m.get_score(i)) for i in range(n)
                 if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        return cls(table, byte_ids, m.unk_id(), names)

    def fallback(self, text: str) -> list[int]:
        data = text.encode()
        if all(b in self.byte_ids for b in data):
            return [self.byte_ids[b] for b in data]
        return [self.unknown]


def split(text: str | None) -> list[str]:
    """Words of a text, with meta spaces for spaces."""
    return WORD.findall(META + text.replace(" ", META)) if text else []


# ---------------------------------------------------------------- blocks of documents

def pack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(block, ids, sizes, texts)``: a batch's documents of each block. A text that is not
    empty is preceded by the space that the model puts there; all texts are one compressed value."""
    zip_ = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        block = batch.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            rows = batch.take(pa.array(part))
            texts = [b" " + t.replace(META, " ").encode() if t else b"" for t in rows.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(block[part[0]])], pa.int32()), pa.array([rows.column(1).to_pylist()], pa.list_(pa.int64())),
                 pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                 pa.array([zip_.compress(b"".join(texts))], pa.binary())], names=["block", "ids", "sizes", "texts"])


def packed_texts(sizes: pa.Array, blob: pa.Scalar) -> Iterator[tuple[bytes, np.ndarray]]:
    """Texts of a packed row in pieces of about ``PASS_BYTES``: bytes and offsets."""
    data = zstandard.ZstdDecompressor().decompress(blob.as_py())
    offsets = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())]).astype(np.int64)
    at = 0
    while at < len(offsets) - 1:
        to = min(len(offsets) - 1, max(at + 1, int(np.searchsorted(offsets, offsets[at] + PASS_BYTES, "right")) - 1))
        yield data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit name, first and end byte of every word: a word begins with a text, at a line break,
    after one, and at a space that follows no space."""
    empty = np.empty(0, np.int64)
    if not len(raw):
        return np.empty(0, np.uint64), empty, empty
    first = raw == 0x20
    first[1:] &= ~first[:-1]
    line = raw == 0x0A
    first |= line
    first[1:] |= line[:-1]
    first[offsets[:-1][offsets[:-1] < len(raw)]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(raw))
    power, inverse = powers(len(raw))
    values = (raw.astype(np.uint64) + np.uint64(1)) * power
    return mix64(np.add.reduceat(values, start) * inverse[start]), start, end


def block_words(table: pa.Table, buckets: int) -> pa.Table:
    """The block's distinct words, packed per word bucket in the order of their names."""
    names, words = [np.empty(0, np.uint64)], []
    known = names[0]
    for sizes, blob in zip(table.column("sizes"), table.column("texts")):
        for data, offsets in packed_texts(sizes, blob):
            h, start, end = word_bounds(np.frombuffer(data, np.uint8), offsets)
            h, at = np.unique(h, return_index=True)
            new = ~np.isin(h, known, assume_unique=True)
            at = at[new]
            names.append(h[new])
            known = np.concatenate([known, h[new]])
            words += [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
    name = np.concatenate(names)
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((name, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(int(k), _packed([words[i] for i in order[cuts[k]:cuts[k + 1]].tolist()])) for k in np.flatnonzero(np.diff(cuts))]
    block = table.column("block")[0].as_py() if table.num_rows else 0
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
                     "words": pa.array([r[1] for r in rows], pa.binary())})


def _packed(words: list[bytes]) -> bytes:
    head = np.array([len(words), *map(len, words)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(words))


def _unpacked(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:4], "little")
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4)) + 4 * (n + 1)).tolist()
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends], ends)]


def bucket_words(table: pa.Table) -> tuple[list[str], list[tuple[int, np.ndarray]]]:
    """Distinct words of a bucket, and each block's words as positions in them."""
    index: dict[bytes, int] = {}
    held = [(block, np.array([index.setdefault(w, len(index)) for w in _unpacked(blob.as_py())], np.int64))
            for block, blob in zip(table.column("block").to_pylist(), table.column("words"))]
    return [w.decode(errors="replace").replace(" ", META) for w in index], held


def word_rows(table: pa.Table) -> pa.Table:
    """The bucket's words as rows, each with the ``(block, place)`` that hold it."""
    words, held = bucket_words(table)
    bucket = table.column("bucket")[0].as_py()
    blocks: list[list[dict]] = [[] for _ in words]
    for block, at in held:
        for place, i in enumerate(at.tolist()):
            blocks[i].append({"bucket": bucket, "block": block, "place": place})
    kind = pa.list_(pa.struct([("bucket", pa.int32()), ("block", pa.int32()), ("place", pa.int32())]))
    return pa.table({"word": pa.array(words, pa.string()), "blocks": pa.array(blocks, kind)})


# ---------------------------------------------------------------- lattice and folds

def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """``(word, blocks, edges)``: each word's edges ``(start, end, score, id)``, ends exclusive.

    ``words`` is dealt by the word's hash once; explode, broadcast join and grouping stay there."""
    keyed = words.withColumns({"k1": F.xxhash64("word"), "k2": F.xxhash64("word", F.lit(1))}).repartition("k1", "k2")
    starts = keyed.select("k1", "k2", "word", "blocks", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    starts = starts.select(
        "k1", "k2", "s", F.substring("word", F.col("s"), F.lit(longest)).alias("rest"),
        F.when(F.col("s") == 1, F.col("word")).alias("word"), F.when(F.col("s") == 1, F.col("blocks")).alias("blocks"))
    edges = starts.select("*", F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("l"))
    edges = edges.select("k1", "k2", "s", "l", F.substring("rest", F.lit(1), F.col("l")).alias("piece"),
                         F.when(F.col("l") == 1, F.col("word")).alias("word"),
                         F.when(F.col("l") == 1, F.col("blocks")).alias("blocks"))
    met = edges.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR word IS NOT NULL")
    edge = F.when(F.col("id").isNotNull(), F.struct(
        (F.col("s") - 1).alias("start"), (F.col("s") + F.col("l") - 1).alias("end"), "score", "id"))
    return met.groupBy("k1", "k2").agg(
        F.first("word", ignorenulls=True).alias("word"), F.first("blocks", ignorenulls=True).alias("blocks"),
        F.collect_list(edge).alias("edges")).select("word", "blocks", "edges")


def viterbi(word: Column, edges: Column, unknown: Column) -> Column:
    """Ends and ids ``array<struct<end, id>>`` of the best path by summed scores (unigram models).

    Folds the edges in order of their start over the best score of every position; a character
    without an edge of its own is an unknown edge scored below all others. Ties: the longer last edge."""
    n = F.length(word)
    solo = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        i.alias("start"), (i + 1).alias("end"), unknown.alias("score"), F.lit(-1).alias("id")))
    solo = F.filter(solo, lambda u: ~F.exists(edges, lambda e: (e["start"] == u["start"]) & (e["end"] == u["end"])))
    kind = "struct<start: int, end: int, score: double, id: int>"
    ordered = F.array_sort(F.concat(edges.cast(f"array<{kind}>"), solo.cast(f"array<{kind}>")))
    cell = "struct<score: double, start: int, id: int>"
    zero = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        F.when(i == 0, 0.0).alias("score"), F.lit(-1).alias("start"), F.lit(-1).alias("id")).cast(cell))

    def step(best: Column, e: Column) -> Column:
        score = best[e["start"]]["score"] + e["score"]
        return F.transform(best, lambda b, i: F.when(
            (i == e["end"]) & (b["score"].isNull() | (score > b["score"])),
            F.struct(score.alias("score"), e["start"].alias("start"), e["id"].alias("id")).cast(cell)).otherwise(b))
    best = F.aggregate(ordered, zero, step)
    none = F.array().cast("array<struct<end: int, id: int>>")

    def back(state: Column, _: Column) -> Column:
        at = state["at"]
        cell_ = state["best"][at]
        return F.when(at > 0, F.struct(
            cell_["start"].alias("at"), state["best"].alias("best"),
            F.concat(F.array(F.struct(at.alias("end"), cell_["id"].alias("id"))), state["path"]).alias("path"))).otherwise(state)
    return F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), best.alias("best"), none.alias("path")),
                       back, lambda s: s["path"])


class PieceArrays:
    """The piece table by length: sorted substring hashes with the pieces' ids and score ranks."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, pieces: Pieces):
        order = {x: r for r, x in enumerate(sorted({s for _, s in pieces.table.values()}, reverse=True))}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(p) for p in pieces.table}):
            own = [(p, i, order[s]) for p, (i, s) in pieces.table.items() if len(p) == n]
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = self.step(h, np.array([ord(p[k]) for p, _, _ in own], np.uint64))
            by = np.argsort(h)
            self.by_length[n] = (h[by], np.array([i for _, i, _ in own], np.int64)[by],
                                 np.array([r for _, _, r in own], np.int64)[by])

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return mix64(h + c + np.uint64(1))

    def edges(self, points: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and score rank of the piece that starts at each character and has each length
        (``(characters, longest + 1)``; -1 and ``NONE`` without one). ``end``: end of the character's word."""
        longest = max(self.by_length)
        ids = np.full((len(points), longest + 1), -1, np.int32)
        ranks = np.full((len(points), longest + 1), self.NONE, np.int32)
        at = np.arange(len(points))
        h = np.zeros(len(points), np.uint64)
        for n in range(1, longest + 1):  # substrings of n characters, inside their word
            inside = at + n <= end[at]
            at, h = at[inside], h[inside]
            h = self.step(h, points[at + n - 1].astype(np.uint64))
            if n in self.by_length:
                table, piece, rank = self.by_length[n]
                k = np.minimum(np.searchsorted(table, h), len(table) - 1)
                hit = np.flatnonzero(table[k] == h)
                ids[at[hit], n], ranks[at[hit], n] = piece[k[hit]], rank[k[hit]]
        return ids, ranks


def merge_words(ranks: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
    """BPE fold over many words at once: end of the symbol that starts at each character, 0 where
    none does. ``ranks`` as from ``PieceArrays.edges``, ``word`` numbers each character's word."""
    n, longest = len(word), ranks.shape[1] - 1
    to = np.arange(1, n + 1)
    start = np.arange(n)  # symbols of the words still at work, in order
    while len(start):
        follows = np.flatnonzero(to[start] < end[start])  # symbols with a neighbour in their word
        a = start[follows]
        c = to[to[a]]
        length = c - a
        rank = np.full(len(a), PieceArrays.NONE, np.int64)
        short = length <= longest
        rank[short] = ranks[a[short], length[short]]
        some = np.flatnonzero(rank < PieceArrays.NONE)
        if not len(some):
            break
        a, c, rank = a[some], c[some], rank[some]
        first = np.flatnonzero(np.concatenate([[True], word[a[1:]] != word[a[:-1]]]))
        best = np.minimum.reduceat((rank << 32) | a, first)  # best score, then leftmost
        a = (best & 0xFFFFFFFF).astype(np.int64)
        b = to[a]
        to[a] = to[b]
        to[b] = 0
        busy = np.zeros(word[-1] + 1, bool)
        busy[word[a]] = True
        start = start[busy[word[start]] & (to[start] > 0)]
    return to


def bpe_bucket(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one after the other, and the number of each word's ids. About ``STEP_CHARS`` characters
    (or one longer word) at a time have their edges in memory."""
    ends = np.cumsum([len(w) for w in words])
    ids, counts, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
    while at < len(words):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + STEP_CHARS, "right")))
        found, count = bpe_words(words[at:to], pieces)
        ids.append(found.astype(np.int32))
        counts.append(count)
        at = to
    return np.concatenate(ids), np.concatenate(counts)


def bpe_words(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    text = "".join(words)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    word = np.repeat(np.arange(len(words)), size)
    end = np.repeat(np.cumsum(size), size)
    ids, ranks = pieces.arrays().edges(points, end)
    to = merge_words(ranks, end, word)
    start = np.flatnonzero(to)
    found = ids[start, np.minimum(to[start] - start, ids.shape[1] - 1)].astype(np.int64)
    count = np.ones(len(start), np.int64)
    odd = np.flatnonzero(found < 0)  # characters without a piece
    spelled = {i: pieces.fallback(text[start[i]:to[start[i]]]) for i in odd.tolist()}
    count[odd] = [len(spelled[i]) for i in odd.tolist()]
    out = np.repeat(found, count)
    first = np.cumsum(count) - count
    for i, v in spelled.items():
        out[first[i]:first[i] + len(v)] = v
    return out, np.bincount(word[start], count, minlength=len(words)).astype(np.int64)


def path_ids(word: str, path: list[dict], pieces: Pieces) -> list[int]:
    out: list[int] = []
    start = 0
    for e in path:
        out += pieces.fallback(word[start:e["end"]]) if e["id"] < 0 else [e["id"]]
        start = e["end"]
    return out


def answer_rows(rows: list[tuple[int, int, np.ndarray, np.ndarray]], ids: np.ndarray, size: np.ndarray) -> pa.Table:
    """``(block, bucket, places, words)`` with the words' ids packed."""
    first = np.cumsum(size) - size
    return pa.table({
        "block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()),
        "ids": pa.array([pack(place, size[i], ids[spread(first[i], size[i])]) for _, _, place, i in rows], pa.binary())})


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs that start at ``first`` and have ``size`` elements, one after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def encode_block(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """Ids of a block's documents from its words' ids."""
    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for sizes, blob in zip(docs.column("sizes"), docs.column("texts")):
            for data, offsets in packed_texts(sizes, blob):
                yield (*word_bounds(np.frombuffer(data, np.uint8), offsets)[:2], offsets)
    # names are made twice rather than kept: a piece of text at a time is in memory
    name = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(h) for h, _, _ in pieces())]))
    # the words' order: by bucket, then by name; answers come in places within their bucket
    bucket = (name % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((name, bucket))
    begin = np.searchsorted(bucket[order], np.arange(buckets))
    size, first, parts, total = np.full(len(name), -1, np.int64), np.zeros(len(name), np.int64), [np.empty(0, np.int64)], 0
    for k, blob in zip(answers.column("bucket").to_pylist(), answers.column("ids")):
        place, n, ids = (x.astype(np.int64) for x in unpack(blob.as_py()))
        word = order[begin[k] + place]
        size[word], first[word] = n, total + np.cumsum(n) - n
        parts.append(ids)
        total += len(ids)
    if (size < 0).any():
        raise RuntimeError("a block's words came back incomplete")
    ids = np.concatenate(parts).astype(np.int32)
    out = []
    for h, start, offsets in pieces():
        w = np.searchsorted(name, h)
        n = size[w]
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, offsets, "left")].astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[spread(first[w], n)])))
    doc_ids = docs.column("ids").combine_chunks().flatten()
    return pa.table({"doc_id": doc_ids, "ids": pa.chunked_array(out, pa.list_(pa.int32()))})


def encode(docs: DataFrame, model: str = MODEL, fold: str = "bpe", id_col: str = "doc_id", text_col: str = "text",
           pieces: Pieces | None = None) -> DataFrame:
    """``(doc_id, ids)`` for every row. ``fold`` is ``bpe`` or ``unigram``, as the model was made."""
    spark = docs.sparkSession
    pieces = pieces or Pieces.read(model)
    shared = spark.sparkContext.broadcast(pieces)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = docs.select(
        F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        pack_docs, "block int, ids array<long>, sizes array<long>, texts binary")
    words = packed.groupBy("block").applyInArrow(
        lambda t: block_words(t, buckets), "bucket int, block int, words binary").groupBy("bucket")
    answer = "block int, bucket int, ids binary"
    if fold == "bpe":
        def bpe(table: pa.Table) -> pa.Table:
            names, held = bucket_words(table)
            bucket = table.column("bucket")[0].as_py()
            return answer_rows([(b, bucket, np.arange(len(at)), at) for b, at in held], *bpe_bucket(names, shared.value))
        answers = words.applyInArrow(bpe, answer)
    else:
        table = spark.createDataFrame([(p, i, float(s)) for p, (i, s) in pieces.table.items()],
                                      "piece string, id int, score double")
        low = min((s for _, s in pieces.table.values()), default=0.0) - 10.0
        grouped = lattice(words.applyInArrow(
            word_rows, "word string, blocks array<struct<bucket: int, block: int, place: int>>"), table, pieces.longest)
        paths = grouped.select("word", "blocks", viterbi(F.col("word"), F.col("edges"), F.lit(low)).alias("path"))

        def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(0).to_pylist()
                ids = [path_ids(w, p, shared.value) for w, p in zip(names, batch.column(2).to_pylist())]
                of: dict[tuple[int, int], list] = {}
                for i, held in enumerate(batch.column(1).to_pylist()):
                    for x in held:
                        of.setdefault((x["block"], x["bucket"]), []).append((x["place"], i))
                rows = [(*key, *np.array(at, np.int64).T) for key, at in of.items()]
                flat = np.array([v for x in ids for v in x], np.int64)
                yield from answer_rows(rows, flat, np.array([len(x) for x in ids], np.int64)).to_batches()
        answers = paths.mapInArrow(spelled, answer)
    return (packed.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(lambda d, a: encode_block(d, a, buckets), "doc_id long, ids array<int>"))


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", pieces: Pieces | None = None) -> DataFrame:
    """``encoded`` with the column ``text`` read back from the ids; unknown ids give U+FFFD."""
    pieces = pieces or Pieces.read(model)
    values = [n.replace(META, " ").encode() for n in pieces.names]
    for b, i in pieces.byte_ids.items():
        values[i] = bytes([b])
    for i, n in enumerate(pieces.names):
        if i not in pieces.byte_ids.values() and n not in pieces.table:
            values[i] = b"" if i != pieces.unknown else "\ufffd".encode()
    shared = encoded.sparkSession.sparkContext.broadcast(values)
    base = encoded.drop("text")
    at = base.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = shared.value
        data = np.frombuffer(b"".join(values), np.uint8)
        size = np.array([len(v) for v in values], np.int64)
        first = np.cumsum(size) - size
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                lists = batch.column(at)
                ids = lists.flatten().to_numpy()
                ends = np.cumsum([len(x) if x.is_valid else 0 for x in lists])
                n = size[ids]
                raw = data[spread(first[ids], n)].tobytes()
                cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends]).astype(np.int64)].tolist()
                texts = [raw[x + raw.startswith(b" ", x, y):y].decode(errors="replace") for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                                 names=[*batch.schema.names, "text"])
    return base.mapInArrow(run, StructType(base.schema.fields[:]).add("text", "string"))


@register("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and a digest of the text decoded from them."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
