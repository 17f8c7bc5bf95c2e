"""Edit-aware token counts.

A document's state is a segment tree over its pre-tokens, with the characters and the tokens of
every subtree. Slot ``i`` holds the ``i``-th pre-token (after edits: any number of neighbouring whole
pre-tokens). An edit finds its slots by descending the character sums, goes back ``CONTEXT`` slots
(a pre-token depends on its own text and a little look-ahead), and splits and encodes
anew from there only until a pre-token ends at an old slot's border behind the edit: from there
on the text and hence the pre-tokens are the old ones. The changed slots and the subtree sums above
them are updated; the count is the root's.

``build_states`` gives every document its tree, ``apply_edits`` joins edits to states,
``edited_counts`` does both for documents that carry their edits, without moving texts. Pre-tokens
are split by ``pattern`` and encoded with byte-level ranks read from ``ranks_path``; the ranks are
broadcast (their size is the vocabulary's).

Defined cases: null and empty texts have no pre-token and 0 tokens; edits apply in order, each
to the text that the one before left; a start beyond the text appends, a negative one counts as 0, a length beyond the
end is cut, null fields count as 0 or empty, null edits do nothing; repeated rows are counted
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from ._common import register

#: Fixed value: the byte-level vocabulary's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Slots with text that an edit steps back.
CONTEXT = 2
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 200_000

STATE = "doc_id long, text string, chars array<int>, tokens array<int>"
EDIT = "array<struct<start: long, length: long, insert: string>>"


class Tokenizer:
    """Pre-token counts, remembered per worker."""

    _of: dict[tuple[str, int], "Tokenizer"] = {}

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        import tiktoken
        self.split = regex.compile(pattern)
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    @classmethod
    def get(cls, pattern: str, ranks: dict[bytes, int]) -> "Tokenizer":
        key = (pattern, len(ranks))
        if key not in cls._of:
            cls._of[key] = cls(pattern, ranks)
        return cls._of[key]

    def counts(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = len(self.encode(p))
            return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SegmentTree:
    """Sums of characters and tokens over the slots; node 1 is the root, node ``i`` has the
    children ``2i`` and ``2i + 1`` and the slots are the last ``size`` nodes."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.size = len(chars) // 2

    @classmethod
    def over(cls, chars: np.ndarray, tokens: np.ndarray) -> "SegmentTree":
        size = 1 << max(0, int(len(chars) - 1).bit_length())
        trees = []
        for leaves in (chars, tokens):
            t = np.zeros(2 * size, np.int32)
            level = t[size:]
            level[:len(leaves)] = leaves
            while len(level) > 1:
                half = len(level) // 2
                t[half:2 * half] = level.reshape(-1, 2).sum(axis=1)
                level = t[half:2 * half]
            trees.append(t)
        return cls(*trees)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, at: int) -> tuple[int, int]:
        """Slot with character ``at`` and the character it starts with; the end if there is none."""
        if at >= self.chars[1]:
            return self.size, int(self.chars[1])
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def before(self, slot: int) -> int:
        """Nearest slot with text before ``slot``, or -1."""
        slot -= 1
        while slot >= 0 and not self.chars[self.size + slot]:
            slot -= 1
        return slot

    def replace(self, lo: int, hi: int, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Put pre-tokens into the slots ``[lo, hi)``: one each, the rest in the last slot."""
        n = hi - lo
        for tree, new in ((self.chars, chars), (self.tokens, tokens)):
            leaves = tree[self.size + lo:self.size + hi]
            leaves[:] = 0
            leaves[:min(n, len(new))] = new[:n]
            if len(new) > n:
                leaves[n - 1] += new[n:].sum()
        a, b = self.size + lo, self.size + hi - 1
        while a > 1:
            a, b = a // 2, b // 2
            for tree in (self.chars, self.tokens):
                tree[a:b + 1] = tree[2 * a:2 * b + 2:2] + tree[2 * a + 1:2 * b + 2:2]


def build(text: str, tokenizer: Tokenizer) -> SegmentTree:
    pieces = tokenizer.split.findall(text)
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return SegmentTree.over(chars, tokenizer.counts(pieces))


def edit(text: str, tree: SegmentTree, start: int, length: int, insert: str,
         tokenizer: Tokenizer) -> tuple[str, SegmentTree, int]:
    """Text and tree after one edit, and the number of pre-tokens encoded for it."""
    start = min(max(start, 0), len(text))
    end = min(start + max(length, 0), len(text))
    new = text[:start] + insert + text[end:]
    if new == text:
        return text, tree, 0
    if not text or not new:
        tree = build(new, tokenizer)
        return new, tree, len(tokenizer.split.findall(new))
    lo, begin = tree.find(max(0, start - 1))
    for _ in range(CONTEXT):
        back = tree.before(lo)
        if back < 0:
            break
        lo = back
        begin -= int(tree.chars[tree.size + lo])
    shift, safe = len(insert) - (end - start), start + len(insert)
    pieces, hi = [], tree.size
    for match in tokenizer.split.finditer(new, begin):
        pieces.append(match.group())
        if match.end() >= safe:
            slot, at = tree.find(match.end() - shift)
            if at == match.end() - shift and slot < tree.size and match.end() - shift >= end:
                hi = slot
                break
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    tokens = tokenizer.counts(pieces)
    if hi <= lo:  # text grew in front of the first slot
        hi = lo + 1
        chars = np.append(chars, tree.chars[tree.size + lo])
        tokens = np.append(tokens, tree.tokens[tree.size + lo])
    tree.replace(lo, hi, chars, tokens)
    return new, tree, len(pieces)


def _edits(value: list | None) -> Iterator[tuple[int, int, str]]:
    for e in value or []:
        if e is not None:
            yield e["start"] or 0, e["length"] or 0, e["insert"] or ""


def _tokenizer(docs: DataFrame, pattern: str, ranks_path: str):
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    return lambda: Tokenizer.get(pattern, ranks.value)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def build_states(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN,
                 ranks_path: str = RANKS) -> DataFrame:
    """``(doc_id, text, chars, tokens)``: each document with its two trees as node arrays."""
    get = _tokenizer(docs, pattern, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            trees = [build(t or "", get()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1),
                 pa.array([t.chars for t in trees], pa.list_(pa.int32())),
                 pa.array([t.tokens for t in trees], pa.list_(pa.int32()))],
                names=["doc_id", "text", "chars", "tokens"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STATE)


def apply_edits(states: DataFrame, edits: DataFrame, pattern: str = PATTERN, ranks_path: str = RANKS) -> DataFrame:
    """States after ``edits (doc_id, seq, start, length, insert)``, with ``n_tokens`` and the
    pre-tokens ``encoded`` for them. States without an edit are not returned: they stay."""
    get = _tokenizer(states, pattern, ranks_path)
    grouped = edits.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_list(
        F.struct("seq", "start", "length", "insert"))).alias("edits"))
    rows = states.join(grouped, "doc_id").select("doc_id", "text", "chars", "tokens", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            out = []
            for text, chars, tokens, own in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3),
                                                batch.column(4).to_pylist()):
                text = text or ""
                tree = SegmentTree(*(np.array(x.values.to_numpy(zero_copy_only=False)) for x in (chars, tokens)))
                encoded = 0
                for change in _edits(own):
                    text, tree, n = edit(text, tree, *change, get())
                    encoded += n
                out.append((text, tree.chars, tree.tokens, tree.total, encoded))
            text, chars, tokens, total, encoded = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(text, pa.string()), pa.array(chars, pa.list_(pa.int32())),
                 pa.array(tokens, pa.list_(pa.int32())), pa.array(total, pa.int64()), pa.array(encoded, pa.int64())],
                names=["doc_id", "text", "chars", "tokens", "n_tokens", "encoded"])
    return rows.mapInArrow(run, STATE + ", n_tokens long, encoded long")


def edited_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits",
                  pattern: str = PATTERN, ranks_path: str = RANKS) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens, n_tokens_edited, n_encoded)`` of documents that carry
    their edits (an array of ``start, length, insert``)."""
    get = _tokenizer(docs, pattern, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            out = []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text or ""
                tree = build(text, get())
                row = [int(np.count_nonzero(tree.chars[tree.size:])), tree.total]
                encoded = 0
                for change in _edits(own):
                    text, tree, n = edit(text, tree, *change, get())
                    encoded += n
                out.append((*row, tree.total, encoded))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*out))],
                names=["doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_encoded"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), edits_col).mapInArrow(
        run, "doc_id long, n_pretokens long, n_tokens long, n_tokens_edited long, n_encoded long")


def sample_edits(id_col: Column, text: Column) -> Column:
    """Three edits per document at places given by a hash: cut, copy and replace."""
    def place(seed: int) -> Column:
        return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.coalesce(F.length(text), F.lit(0)).cast("long") + 1)

    def one(start: Column, length: int, insert: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))
    return F.array(one(place(1), 9, F.lit("")), one(place(2), 0, F.substring(text, 1, 24)),
                   one(place(3), 5, F.lit(" edited text, 2nd version")))


@register("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits."""
    docs = read_table(spark, sf_dir, "documents")
    return edited_counts(docs.select("doc_id", "text", sample_edits(F.col("doc_id"), F.col("text")).alias("edits")))
