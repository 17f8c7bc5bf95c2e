"""Alignment of two tokenizers' tokens over the same texts.

Both tokenizers cut the bytes of a text into tokens; each gives an ascending list of token ends. The ends that both
have cut the tokens into groups, the smallest runs that cover the same bytes. They are found by
galloping: each end of the shorter list starts at a guess in the longer one, doubles its step until the end is
passed, and searches the last step by halves (``gallop``, many lists side by side). Inside a group, the
ranks of a token's first and last byte in the other list are the range of tokens that it overlaps.

Both tokenizers always begin a new token at a single space between two characters that are not white space, so
such a space is an end that both have, and what lies between two of them is a *unit* with its own tokens, groups
and links. A task encodes and aligns each different unit once and keeps it (``Units``, bounded); a text is a
list of units. A text without such a space is one unit.

A link is a pair of token occurrences whose bytes overlap. How many documents hold a pair of ids linked
is counted over the whole corpus, and every document is told how many of its links are the most
frequent ones of their first id.

1. scan tasks write blocks of documents, each one row: its documents' figures, their units as numbers, the units' links,
   and the pairs of the block with the number of its documents that hold them; the table is staged;
2. the counts are summed over the blocks (partial aggregates; a pair that every document holds is one row
   per block); the highest count of each first id is at most one number per id of the vocabulary, and only
   that is collected and broadcast;
3. counts go back to the blocks that hold the pair, once per block, and blocks add them up by unit and document.

Tokenizer files are read by the driver and broadcast (their size is the vocabulary's).

Defined cases: null and empty texts, and texts that one of the tokenizers does not give back byte
by byte (for example one that holds U+2581), have no tokens and take no part in the counts; repeated rows are
aligned each and count each; a null id stays null; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from ._common import passes, register, staged, utf8

FIRST = "/opt/tokenizers/byte_bpe_50k.json"
SECOND = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in one step of a task, and bytes of text and rows in a block of documents.
STEP, BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 16 << 20, 1 << 16
#: Units that are encoded in one call.
GROUP = 256
#: Units and bytes of units that a task keeps.
KEPT_UNITS, KEPT_BYTES = 1 << 18, 64 << 20


# ---------------------------------------------------------------- tokenizers

def byte_values() -> dict[str, int]:
    """Byte of each character by which byte-level vocabularies write it: printable bytes stand for
    themselves, the others for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers in a worker, with the bytes of all their tokens."""

    _made: dict[bytes, "Pair"] = {}

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(first.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # the strings of control tokens are plain text
        value = byte_values()
        vocab = json.loads(first)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.a_bytes[i] = bytes(value[c] for c in name)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            name = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # an id's decimal with what follows it: in its group, at the end of its side, at the end of the group
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.written = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)]
        self.written_size = np.array([len(x) for x in self.written], np.int64)

    @classmethod
    def get(cls, files: tuple[bytes, bytes]) -> "Pair":
        name = hashlib.sha256(files[0] + files[1]).digest()
        if name not in cls._made:
            cls._made[name] = cls(*files)
        return cls._made[name]

    def encode(self, units: list[bytes]) -> tuple["Tokens", "Tokens", np.ndarray]:
        """Tokens of a space and each unit under both tokenizers, and whether both give it back byte by byte;
        a unit that one of them does not give back has none."""
        a = self._ids(units, lambda x: [e.ids for e in self.a.encode_batch([" " + t for t in x], add_special_tokens=False)],
                      self.a_bytes, self.a_size)
        b = self._ids(units, lambda x: self.b.encode(x, num_threads=1) if x else [], self.b_bytes, self.b_size)
        good = np.ones(len(units), bool)
        for i in a[2] | b[2]:
            good[i] = False
        return *(Tokens(*_without(ids, count, good), size) for (ids, count, _), size in ((a, self.a_size), (b, self.b_size))), good

    @staticmethod
    def _ids(units: list[bytes], encode, names: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """Ids of all units and the number of each one's, and the units that are not given back. Units
        with plain characters at both ends are encoded ``GROUP`` at a time: a space between them is a cut."""
        edge = [i for i, u in enumerate(units) if not plain_edges(u)]
        odd = set(edge)
        plain = [i for i in range(len(units)) if i not in odd]
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # units, ids: in no order yet
        numbers, bad = [np.empty(0, np.int64)], set()
        groups = [plain[k:k + GROUP] for k in range(0, len(plain), GROUP)]
        found = encode([" ".join([units[i].decode() for i in g]) for g in groups])
        for g, ids in zip(groups, found):
            if b"".join(map(names.__getitem__, ids)) == b" " + b" ".join([units[i] for i in g]):
                ids = np.array(ids, np.int64)
                ends = np.cumsum([len(units[i]) + 1 for i in g])
                parts.append((np.array(g)[np.searchsorted(ends, np.cumsum(size[ids]))], ids))
            else:
                edge += g
        for i, ids in zip(edge, encode([units[i].decode() for i in edge])):
            if b"".join(map(names.__getitem__, ids)) != b" " + units[i]:
                bad.add(i)
            else:
                parts.append((np.full(len(ids), i), np.array(ids, np.int64)))
        of = np.concatenate([*numbers, *(p for p, _ in parts)])
        ids = np.concatenate([*numbers, *(p for _, p in parts)])
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(units)), bad


def _without(ids: np.ndarray, count: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(good, count)], np.where(good, count, 0)


# ---------------------------------------------------------------- units

#: Bytes that begin or end a character which is certainly no white space: printable ASCII, and Latin, Greek,
#: Cyrillic, Hebrew and Arabic letters by their first byte.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_FIRST = np.zeros(256, bool)
_FIRST[0xC3:0xE0] = True
_PLAIN_LIST, _FIRST_LIST = _PLAIN.tolist(), _FIRST.tolist()


def plain_edges(unit: bytes) -> bool:
    """A unit that begins and ends with characters that are certainly no white space."""
    first, last = unit[0], unit[-1]
    return (_PLAIN_LIST[first] or _FIRST_LIST[first]) and (
        _PLAIN_LIST[last] or (last >= 0x80 and len(unit) > 1 and _FIRST_LIST[unit[-2]]))


def unit_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of every unit, and its text. The space before a unit belongs to no unit."""
    n = len(raw)
    cut = np.empty(0, np.int64)
    if n > 2:
        space = np.flatnonzero(raw[1:-1] == 0x20) + 1
        before = _PLAIN[raw[space - 1]] | (_FIRST[raw[np.maximum(space - 2, 0)]] & (raw[space - 1] >= 0x80) & (space > 1))
        after = _PLAIN[raw[space + 1]] | _FIRST[raw[space + 1]]
        text = np.searchsorted(offsets, space, "right") - 1
        inside = (space > offsets[text]) & (space + 1 < offsets[text + 1])
        cut = space[before & after & inside]
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    start = np.sort(np.concatenate([offsets[:-1][some], cut + 1]))
    end = np.sort(np.concatenate([offsets[1:][some], cut]))
    return start, end, np.searchsorted(offsets, start, "right") - 1


class Units:
    """Units that a task has met, each encoded and aligned once. Unit ``i`` has the entries
    ``first[x][i] .. first[x][i + 1] - 1`` of ``flat[x]``: ``a`` and ``b`` its ids, ``na`` and ``nb`` the numbers of them in each
    group, ``links`` the numbers (in ``pairs``) of its links' id pairs ``a << 32 | b``."""

    PARTS = ("a", "b", "na", "nb", "links")

    def __init__(self, pair: "Pair"):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.written: list[str] = []
        self.pair_index: dict[int, int] = {}
        self.held = 0
        self.met = np.zeros(0, np.int64)
        self._flat: dict[str, list[np.ndarray]] = {x: [] for x in self.PARTS}
        self._size: dict[str, list[np.ndarray]] = {x: [] for x in self.PARTS}
        self._good: list[np.ndarray] = []
        self._arrays: dict | None = None

    def full(self) -> bool:
        return len(self.index) >= KEPT_UNITS or self.held >= KEPT_BYTES

    def renew(self) -> None:
        """Forget the units that were met once, and if they are many, those met less often than others."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > KEPT_UNITS // 4:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[:KEPT_UNITS // 4]])
        parts = {x: (self.gather(x, keep), self.arrays()["size"][x][keep]) for x in self.PARTS}
        used, numbers = np.unique(parts["links"][0], return_inverse=True)
        pairs = self.arrays()["pairs"][used].tolist()
        good, written, words = self.arrays()["good"][keep], self.written, list(self.index)
        self.clear()
        self.index = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.written = [written[k] for k in keep.tolist()]
        self.held = 4 * sum(map(len, self.index))
        if self.held >= KEPT_BYTES // 2:  # a few units of great length
            self.clear()
            return
        self.pair_index = {p: i for i, p in enumerate(pairs)}
        parts["links"] = numbers, parts["links"][1]
        for x, (flat, size) in parts.items():
            self._flat[x], self._size[x] = [flat], [size]
        self._good = [good]
        self.met = np.zeros(len(keep), np.int64)

    def numbers(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the units at these places; new ones are added."""
        words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        index = self.index
        new = [w for w in dict.fromkeys(words) if w not in index]
        if new:
            self._add(new)
        out = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        met = np.bincount(out, minlength=len(index))
        met[:len(self.met)] += self.met
        self.met = met
        return out

    def _add(self, new: list[bytes]) -> None:
        a, b, good = self.pair.encode(new)
        of, na, nb = group_sizes(a, b)
        i, j = links(a, b)
        ids, numbers = np.unique(a.ids[i] << 32 | b.ids[j], return_inverse=True)
        pairs = self.pair_index
        numbers = np.array([pairs.setdefault(p, len(pairs)) for p in ids.tolist()], np.int64)[numbers]
        groups = np.bincount(of, minlength=len(new))
        count = {"a": a.count, "b": b.count, "na": groups, "nb": groups, "links": np.bincount(a.doc[i], minlength=len(new))}
        for name, flat in (("a", a.ids), ("b", b.ids), ("na", na), ("nb", nb), ("links", numbers)):
            self._flat[name].append(flat)
            self._size[name].append(count[name])
        self._good.append(good)
        self.written += written_groups(self.pair, a, b, na, nb)
        for w in new:
            self.index[w] = len(self.index)
            self.held += 4 * len(w)
        self._arrays = None

    def arrays(self) -> dict:
        """``size``, ``first`` and ``flat`` of every part, ``good`` and ``pairs``."""
        if self._arrays is None:
            empty = [np.empty(0, np.int32)]
            for store in (*self._flat.values(), *self._size.values()):  # one piece each from now on
                store[:] = [np.concatenate([*empty, *(x.astype(np.int32) for x in store)])]
            self._good[:] = [np.concatenate([np.empty(0, bool), *self._good])]
            size = {x: v[0] for x, v in self._size.items()}
            self._arrays = {"size": size, "first": {x: np.cumsum(v, dtype=np.int64) - v for x, v in size.items()},
                            "flat": {x: v[0] for x, v in self._flat.items()}, "good": self._good[0],
                            "pairs": np.fromiter(self.pair_index, np.int64, len(self.pair_index))}
        return self._arrays

    def gather(self, part: str, units: np.ndarray) -> np.ndarray:
        """Entries of many units, one after the other."""
        all_ = self.arrays()
        n = all_["size"][part][units].astype(np.int64)
        return all_["flat"][part][np.repeat(all_["first"][part][units], n) + runs(n)].astype(np.int64)


def text_units(units: Units, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Unit numbers and text of every unit of a batch's texts; texts that are not given back have none."""
    raw, offsets = utf8(batch.column(1))
    start, end, text = unit_bounds(raw, offsets)
    numbers = units.numbers(raw.tobytes(), start, end)
    bad = np.unique(text[~units.arrays()["good"][numbers]])
    if len(bad):
        keep = ~np.isin(text, bad)
        numbers, text = numbers[keep], text[keep]
    return numbers, text


# ---------------------------------------------------------------- galloping intersection

def gallop(keys: np.ndarray, into: np.ndarray, guess: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each key the first position in the ascending ``into[low:high]`` whose value is not
    smaller: from ``guess``, steps of doubled width until the key is bracketed, then halving."""
    lo, hi = low.copy(), high.copy()  # the answer lies in lo .. hi
    at = np.clip(guess, low, np.maximum(high - 1, low))
    some = np.flatnonzero(low < high)
    below = np.zeros(len(keys), bool)
    below[some] = into[at[some]] < keys[some]
    lo[below] = at[below] + 1
    rest = np.zeros(len(keys), bool)
    rest[some] = ~below[some]
    hi[rest] = at[rest]
    width = 1
    up, down = np.flatnonzero(below), np.flatnonzero(rest)
    while len(up) or len(down):
        up = up[lo[up] + width - 1 < high[up]]  # others keep their list's end as upper bound
        probe = lo[up] + width - 1
        less = into[probe] < keys[up]
        hi[up[~less]] = probe[~less]
        lo[up[less]] = probe[less] + 1
        up = up[less]
        down = down[hi[down] - width >= low[down]]
        probe = hi[down] - width
        less = into[probe] < keys[down]
        lo[down[less]] = probe[less] + 1
        hi[down[~less]] = probe[~less]
        down = down[~less]
        width *= 2
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        less = into[mid] < keys[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def runs(n: np.ndarray) -> np.ndarray:
    """``0 .. n[i] - 1`` for every i, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Tokens:
    """Tokens of a batch of texts under one tokenizer: ids, byte ends counted through the batch, first token of each text."""

    def __init__(self, ids: np.ndarray, count: np.ndarray, size: np.ndarray):
        self.ids, self.count = ids, count
        self.first = np.cumsum(self.count) - self.count
        self.ends = np.cumsum(size[self.ids])
        self.doc = np.repeat(np.arange(len(count)), count)


def common_ends(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both lists of the ends that both hold, ascending. Text by text the shorter list searches the longer."""
    found = []
    for short, long, swap in ((a, b, False), (b, a, True)):
        mine = (short.count < long.count) if swap else (short.count <= long.count)
        i = np.flatnonzero(mine[short.doc])
        d = short.doc[i]
        local = i - short.first[d]
        guess = long.first[d] + local * long.count[d] // np.maximum(short.count[d], 1)
        j = gallop(short.ends[i], long.ends, guess, long.first[d], long.first[d] + long.count[d])
        inside = j < long.first[d] + long.count[d]
        hit = np.flatnonzero(inside)
        hit = hit[long.ends[j[hit]] == short.ends[i[hit]]]
        found.append((j[hit], i[hit]) if swap else (i[hit], j[hit]))
    i, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(i)
    return i[order], j[order]


def links(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of tokens whose bytes overlap: the ranks of an A token's first and last
    byte among the ends of B are the B tokens that it overlaps. Texts follow each other without a gap
    and are equally long under both, so one search over the batch's ends serves all."""
    if not len(a.ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin = np.concatenate([[0], a.ends[:-1]])
    guess = b.first[a.doc] + (np.arange(len(a.ids)) - a.first[a.doc]) * b.count[a.doc] // np.maximum(a.count[a.doc], 1)
    low, high = b.first[a.doc], b.first[a.doc] + b.count[a.doc]
    from_ = gallop(begin + 1, b.ends, guess, low, high)  # first B token that ends behind the first byte
    to = gallop(a.ends, b.ends, from_, low, high)  # first that ends at or behind the last
    n = to - from_ + 1
    return np.repeat(np.arange(len(a.ids)), n), np.repeat(from_, n) + runs(n)


def group_sizes(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text of each group, and its numbers of A and B tokens."""
    i, j = common_ends(a, b)
    doc = a.doc[i]
    before = np.concatenate([[-1], i[:-1]]) if len(i) else i
    before_b = np.concatenate([[-1], j[:-1]]) if len(j) else j
    return doc, i - before, j - before_b


# ---------------------------------------------------------------- rows

ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>"


def _list(values: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(values, pa.int32()))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices with about ``STEP`` bytes of text, at least one row each."""
    for batch in batches:
        for part, _, _ in passes(batch, size=STEP):
            yield part


def read_files(first: str, second: str) -> tuple[bytes, bytes]:
    with open(first, "rb") as a, open(second, "rb") as b:
        return a.read(), b.read()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def align(docs: DataFrame, first: str = FIRST, second: str = SECOND, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``ALIGNED`` rows: a text's ids under both tokenizers and how many of them each group has."""
    shared = docs.sparkSession.sparkContext.broadcast(read_files(first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(Pair.get(shared.value))
        for batch in _steps(batches):
            numbers, text = text_units(units, batch)
            size = units.arrays()["size"]
            columns = [_list(units.gather(x, numbers), np.bincount(text, size[x][numbers], batch.num_rows).astype(np.int64))
                       for x in ("a", "b", "na", "nb")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[c.split()[0] for c in ALIGNED.split(", ")])
            if units.full():
                units.renew()
    return _rows(docs, id_col, text_col).mapInArrow(run, ALIGNED)


def written_groups(pair: "Pair", a: Tokens, b: Tokens, na: np.ndarray, nb: np.ndarray) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3;``: decimal ids, every group ended by a semicolon."""
    place_a = np.repeat(np.cumsum(nb) - nb, na) + np.arange(len(a.ids))
    place_b = np.repeat(np.cumsum(na), nb) + np.arange(len(b.ids))
    end_a, end_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    end_a[np.cumsum(na) - 1] = 1
    end_b[np.cumsum(nb) - 1] = 1
    n, m = len(pair.a_bytes), len(pair.b_bytes)
    code = np.empty(len(a.ids) + len(b.ids), np.int64)
    code[place_a] = a.ids + n * end_a
    code[place_b] = 2 * n + b.ids + m * end_b
    whole = "".join(map(pair.written.__getitem__, code.tolist()))
    size = np.concatenate([[0], np.cumsum(pair.written_size[code])])
    ends = size[np.cumsum(a.count + b.count)].tolist()
    return [whole[x:y] for x, y in zip([0, *ends], ends)]


# ---------------------------------------------------------------- blocks and counts

_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
BLOCK = ("block long, ids array<long>, " + ", ".join(f"{x} array<int>" for x in _FIGURES)
         + ", digests array<string>, units binary, links binary, pairs array<long>, docs array<int>")
REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _pack(*arrays: np.ndarray) -> bytes:
    data = b"".join(np.concatenate([[len(a)], a]).astype("<u4").tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4"), [], 0
    while at < len(flat):
        out.append(flat[at + 1:at + 1 + flat[at]].astype(np.int64))
        at += 1 + int(flat[at])
    return out


class Block:
    """Documents of a block while a task gathers them."""

    def __init__(self, units: Units):
        self.units = units
        self.clear()

    def clear(self) -> None:
        self.ids: list = []
        self.digests: list[str] = []
        self.figures: list[list[np.ndarray]] = [[] for _ in _FIGURES]
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.docs = np.zeros(0, np.int64)
        self.bytes = 0

    def add(self, batch: pa.RecordBatch) -> None:
        units, n = self.units, batch.num_rows
        numbers, text = text_units(units, batch)
        all_ = units.arrays()
        for store, part in zip(self.figures, ("a", "b", "na", "links")):
            store.append(np.bincount(text, all_["size"][part][numbers], n).astype(np.int64))
        count = np.bincount(text, minlength=n)
        ends = np.cumsum(count).tolist()
        written, listed = units.written, numbers.tolist()
        self.digests += [hashlib.sha256("".join([written[k] for k in listed[a:b]])[:-1].encode()).hexdigest() if b > a else ""
                         for a, b in zip([0, *ends], ends)]
        self.ids += batch.column(0).to_pylist()
        self.numbers.append(numbers)
        self.counts.append(count)
        # documents by pair: different units of a document, their links, different pairs of the document
        once = np.unique(text << 32 | numbers)
        of, unit = once >> 32, once & 0xFFFFFFFF
        held = np.unique(np.repeat(of, all_["size"]["links"][unit]) << 32 | units.gather("links", unit))
        docs = np.bincount(held & 0xFFFFFFFF, minlength=len(all_["pairs"]))
        docs[:len(self.docs)] += self.docs
        self.docs = docs
        self.bytes += batch.column(1).nbytes

    def row(self, block: int) -> pa.RecordBatch:
        units, (distinct, numbers) = self.units, np.unique(np.concatenate(self.numbers), return_inverse=True)
        pairs = units.arrays()["pairs"][:len(self.docs)]
        held = np.flatnonzero(self.docs)
        held = held[np.argsort(pairs[held])]
        place = np.zeros(len(pairs) + 1, np.int64)
        place[held] = np.arange(len(held))
        links = _pack(units.arrays()["size"]["links"][distinct], place[units.gather("links", distinct)])
        made = {"block": pa.array([block]), "ids": pa.array([self.ids], pa.list_(pa.int64()))}
        made |= {x: pa.array([np.concatenate(f)], pa.list_(pa.int32())) for x, f in zip(_FIGURES, self.figures)}
        made |= {"digests": pa.array([self.digests], pa.list_(pa.string())),
                 "units": pa.array([_pack(np.concatenate(self.counts), numbers)]), "links": pa.array([links]),
                 "pairs": pa.array([pairs[held]], pa.list_(pa.int64())), "docs": pa.array([self.docs[held]], pa.list_(pa.int32()))}
        return pa.RecordBatch.from_pydict(made)


def packed_blocks(docs: DataFrame, first: str, second: str, id_col: str, text_col: str) -> DataFrame:
    """``BLOCK`` rows. ``block`` depends on how the input is split: stage the result before using it twice."""
    shared = docs.sparkSession.sparkContext.broadcast(read_files(first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(Pair.get(shared.value))
        block, number = Block(units), TaskContext.get().partitionId() << 32
        for batch in _steps(batches):
            block.add(batch)
            if block.bytes >= BLOCK_BYTES or len(block.ids) >= BLOCK_ROWS or units.full():
                yield block.row(number)
                block.clear()
                number += 1
                if units.full():
                    units.renew()
        if block.ids:
            yield block.row(number)
    return _rows(docs, id_col, text_col).mapInArrow(run, BLOCK)


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(block, pair, n)``, the documents of each block that hold a pair, and ``(pair, count)`` over all."""
    held = blocks.select(F.col("block").alias("block"), F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select(
        "block", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))
    return held, held.groupBy("pair").agg(F.sum("n").alias("count"))


def highest(counts: DataFrame, size: int) -> np.ndarray:
    """Highest count of each first id; at most one row per id of the vocabulary is collected."""
    out = np.zeros(size, np.int64)
    for r in counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("n")).collect():
        out[r["a"]] = r["n"]
    return out


def link_report(table: pa.Table, answers: pa.Table, most: np.ndarray) -> pa.Table:
    """The ``REPORT`` rows of a block's documents; ``answers`` holds the counts of all its pairs."""
    names, kinds = [c.split()[0] for c in REPORT.split(", ")], [pa.int64()] * 7 + [pa.string()]
    if not table.num_rows:
        return pa.table({n: pa.array([], k) for n, k in zip(names, kinds)})
    row = {c: table.column(c)[0].values for c in table.column_names if c not in ("block", "units", "links")}
    pairs, found = row["pairs"].to_numpy(), answers.column("pair").to_numpy()
    order = np.argsort(found)
    if len(found) != len(pairs) or (found[order] != pairs).any():
        raise RuntimeError("a block's pairs came back incomplete")
    count = answers.column("count").to_numpy()[order]
    best = count == most[pairs >> 32]
    counts, numbers = _unpack(table.column("units")[0].as_py())
    n_links, at = _unpack(table.column("links")[0].as_py())
    of = np.repeat(np.arange(len(n_links)), n_links)
    by_unit = [np.zeros(len(n_links), np.int64) for _ in range(2)]
    np.add.at(by_unit[0], of, best[at])
    np.add.at(by_unit[1], of, count[at])
    doc = np.repeat(np.arange(len(counts)), counts)
    sums = [np.zeros(len(counts), np.int64) for _ in range(2)]
    for out, values in zip(sums, by_unit):
        np.add.at(out, doc, values[numbers])
    columns = [row["ids"], *(row[x] for x in _FIGURES), *sums, row["digests"]]
    return pa.table({n: c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for n, c, k in zip(names, columns, kinds)})


def alignment_report(docs: DataFrame, first: str = FIRST, second: str = SECOND, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``REPORT`` rows: numbers of tokens, groups and links, the links whose pair is the most frequent of its first
    id, the sum of the links' document counts, and a digest of the groups."""
    spark = docs.sparkSession
    blocks = staged(packed_blocks(docs, first, second, id_col, text_col))
    held, counts = pair_counts(blocks)
    counts = staged(counts)
    most = spark.sparkContext.broadcast(highest(counts, len(Pair(*read_files(first, second)).a_bytes)))
    answers = held.select("block", "pair").join(counts, "pair").groupBy("block")
    return blocks.groupBy("block").cogroup(answers).applyInArrow(lambda t, c: link_report(t, c, most.value), REPORT)


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens under a byte-level and a piece vocabulary, aligned."""
    return alignment_report(read_table(spark, sf_dir, "documents"))
