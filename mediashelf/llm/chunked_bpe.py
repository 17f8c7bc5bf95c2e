"""BPE encoding and decoding with content-defined chunks that are encoded once.

Texts are cut where a rolling hash of the last bytes has its low bits zero, so equal passages
give equal chunks wherever they stand. Each distinct chunk of the corpus is encoded once, alone, and a document's
ids are put together from its chunks' ids. A cut may fall inside a word, a combining sequence, a run of spaces or a
control token, so every join is repaired: the text from a settled border before the cut to a border
behind it is encoded anew, and the following chunk's ids are taken from the first border on where
that encoding and the chunk's own agree. Where they agree nowhere, chunks are encoded together,
twice as many each time, until they do.

A border is the first byte of a pre-token. It is settled when the chunk goes on for ``margin`` bytes
behind it (no control token and no look-ahead of the pattern reaches further) and its
character cannot compose with what stands before it: from there on the text is encoded as if it began
there.

1. scan tasks cut texts and pack them into blocks by a hash, with their cuts and chunk keys (128 bits);
2. keys that more than one block holds get an owner, the smallest block (a grouped minimum with partial aggregates: a
   passage in a third of all documents is one row per task); owners encode them;
3. the ids of shared chunks go to the blocks that hold them, once per block;
4. each block encodes its other chunks and repairs the joins.

Texts are shuffled once, compressed; beside them only keys and the ids of shared chunks are. A task holds one
block, about ``BLOCK_BYTES`` of text or one longer document.

A task splits chunks at single spaces between plain characters into units, which tokenizers of this kind (words
apart, white space dropped) encode independently, and keeps the ids of a bounded number of units
(``word_units=False`` encodes chunks whole, for tokenizers whose tokens hold spaces).

The tokenizer is a JSON file of the ``tokenizers`` library, read by the driver and broadcast (its size is the
vocabulary's). Control tokens inside texts are encoded as that file says.

Defined cases: null and empty texts have no ids and decode to an empty text; repeated rows are
encoded each; a null id stays null; texts of any length are encoded whole; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import read_table
from ._common import PASS_BYTES, mix64, passes, powers, register
from .token_alignment import byte_values, runs, unit_bounds

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
#: Bytes of a chunk: smallest, mean beyond it, largest.
CHUNK = (256, 2048, 8192)
WINDOW = 16
#: Bytes of text in a block, and that a task packs at once.
BLOCK_BYTES, PACK_BYTES = 4 << 20, 12 << 20
#: Borders at a chunk's beginning that a join tries.
HEADS = 3
#: Characters behind a pre-token's end that its pattern may look at, at most.
LOOK_AHEAD = 4
#: Longest unit (bytes) that can be simple, and pre-tokens of simple units that a worker keeps.
SHORT, KEPT_WORDS = 48, 1 << 15
#: Units and bytes of units that a worker keeps, and bytes of texts that are encoded together.
KEPT_UNITS, KEPT_BYTES, BATCH_BYTES = 1 << 18, 32 << 20, 1 << 19
#: Vowel and final jamo and vowel signs that compose with the letter before them.
COMPOSING = ((0x1160, 0x11FF), (0xD7B0, 0xD7FF), (0x16D63, 0x16D6A))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The steps of a tokenizer whose simple units are split here: compose, white space to spaces, lower
#: case; contractions, runs of letters, single digits, runs of others; bytes as characters.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Latin letters that are composed, and have one lower-case letter each of their kind.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e"
SIMPLE = re.compile(f"[!-~{LATIN}]+")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z{LATIN}0-9]+")
#: The letters' bytes as the byte-level vocabulary writes them.
_NAMES = {b: c for c, b in byte_values().items()}
LATIN_BYTES = {i: "".join(_NAMES[b] for b in chr(i).encode()) for i in range(0xC0, 0x180)}


# ---------------------------------------------------------------- chunks

def candidates(raw: np.ndarray, mean: int) -> np.ndarray:
    """Positions at which the rolling hash allows a cut, always before a whole character."""
    out = []
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), PASS_BYTES):
            part = raw[max(0, at - WINDOW):at + PASS_BYTES].astype(np.uint64) + np.uint64(1)
            if len(part) <= WINDOW:
                continue
            h, power, width = part, _MULTIPLIER, 1
            while width < WINDOW:  # a window of twice the width from two neighbouring ones
                h = h[width:] + h[:-width] * power
                power, width = power * power, 2 * width
            # h[i] covers the bytes i .. i + WINDOW - 1 of the part
            cut = np.flatnonzero((mix64(h) & np.uint64(mean - 1)) == 0) + WINDOW + max(0, at - WINDOW)
            out.append(cut[cut < len(raw)])
    cut = np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)
    return cut[(raw[cut] & 0xC0) != 0x80]


def cut_texts(raw: np.ndarray, offsets: np.ndarray, size: tuple[int, int, int] = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all chunks and the number of chunks of each text."""
    least, mean, most = size
    allowed = candidates(raw, mean).tolist()
    lengths, counts = [], []
    for a, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = 0
        while a < end:
            to = end
            if end - a > least:
                i = bisect.bisect_left(allowed, a + least)
                if i < len(allowed) and allowed[i] < end:
                    to = allowed[i]
            if to - a > most:
                to = a + most
                while (raw[to] & 0xC0) == 0x80:
                    to -= 1
            lengths.append(to - a)
            a = to
            n += 1
        counts.append(n)
    return np.array(lengths, np.int64), np.array(counts, np.int64)


def chunk_key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


PACKED = "block long, ids array<long>, chunks array<int>, lengths array<int>, keys array<binary>, texts binary"


def pack_blocks(size: tuple[int, int, int]):
    """Task: ``(block, doc_id, text)`` to rows of ``PACKED``, one for each block in about ``PACK_BYTES`` of text."""
    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        of = np.concatenate([h[0].column(0).to_numpy() for h in held])
        ids = [i for h in held for i in h[0].column(1).to_pylist()]
        lengths, chunks = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        data = b"".join(h[3] for h in held)
        ends = np.cumsum(lengths).tolist()
        keys = [chunk_key(data[a:b]) for a, b in zip([0, *ends], ends)]
        last = np.cumsum(chunks)
        starts = [0, *ends]
        order = np.argsort(of, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            spans = [(int(last[i] - chunks[i]), int(last[i])) for i in part.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(of[part[0]])]), pa.array([[ids[i] for i in part.tolist()]], pa.list_(pa.int64())),
                 pa.array([chunks[part]], pa.list_(pa.int32())),
                 pa.array([np.concatenate([lengths[a:b] for a, b in spans])], pa.list_(pa.int32())),
                 pa.array([[k for a, b in spans for k in keys[a:b]]], pa.list_(pa.binary())),
                 pa.array([zip_.compress(b"".join(data[starts[a]:starts[b]] for a, b in spans))], pa.binary())],
                names=["block", "ids", "chunks", "lengths", "keys", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for part, raw, offsets in passes(batch):
                held.append((part, *cut_texts(raw, offsets, size), raw.tobytes()))
                total += len(raw)
                if total >= PACK_BYTES:
                    yield from packed(held)
                    held, total = [], 0
        if held:
            yield from packed(held)
    return run


# ---------------------------------------------------------------- encoding of chunks

def distinct_units(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A unit of each kind, and for every unit the number of its kind. Units are told apart by a hash, and the
    bytes of all of them compared with those of the one that stands for them."""
    all_ = np.arange(len(start))
    if not 0 < len(raw) <= PASS_BYTES or not len(start):
        return all_, all_
    power, inverse = powers(len(raw))
    values = (raw.astype(np.uint64) + np.uint64(1)) * power
    values[end[:-1][end[:-1] < start[1:]]] = 0  # the spaces between units
    h = mix64(np.add.reduceat(values, start) * inverse[start])
    _, place, kind = np.unique(h, return_index=True, return_inverse=True)
    size, other = end - start, place[kind]
    if (size != size[other]).any():
        return all_, all_
    step = runs(size)
    if (raw[np.repeat(start, size) + step] != raw[np.repeat(start[other], size) + step]).any():
        return all_, all_
    return place, kind


class Encoded:
    """A text's ids, and its borders as ascending byte positions with the token that begins there."""

    __slots__ = ("ids", "at", "token")

    def __init__(self, ids: np.ndarray, at: list[int], token: list[int]):
        self.ids, self.at, self.token = ids, at, token

    def token_at(self, at: int) -> int | None:
        """Token with which a pre-token begins at byte ``at``, a border's character."""
        i = bisect.bisect_left(self.at, at)
        return self.token[i] if i < len(self.at) and self.at[i] == at else None


class Grown:
    """An array that rows are appended to."""

    def __init__(self):
        self.a, self.n = np.empty(1024, np.int32), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            self.a = np.concatenate([self.a[:self.n], np.empty(max(len(x), self.n // 2), np.int32)])
        self.a[self.n:self.n + len(x)] = x
        self.n += len(x)

    def view(self) -> np.ndarray:
        return self.a[:self.n]


def safe(c: str) -> bool:
    """A character that cannot compose with the text before it and is one character after normalisation."""
    return c.isascii() or (unicodedata.category(c)[0] != "M" and not any(a <= ord(c) <= b for a, b in COMPOSING)
                           and len(unicodedata.normalize("NFC", c).lower()) == 1)


class Encoder:
    """The tokenizer in a worker, and the units that it has met, each encoded once."""

    _made: dict[tuple[bytes, bool], "Encoder"] = {}

    def __init__(self, text: str, word_units: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        tokens = self.tokenizer.get_added_tokens_decoder()
        added = [t.content for t in tokens.values()]
        self.added_texts = added
        self.margin = max([4 * LOOK_AHEAD, *(len(t.encode()) for t in added)]) + 1
        steps = json.loads(text)
        self.plain = (word_units and steps["normalizer"] == NORMALIZER and steps["pre_tokenizer"] == PRE_TOKENIZER
                      and not any(t.normalized or t.single_word for t in tokens.values()))
        self.word_units = word_units and not any(c.isspace() for t in added for c in t)
        self.clear()

    @classmethod
    def get(cls, text: str, word_units: bool = True) -> "Encoder":
        name = hashlib.sha256(text.encode()).digest(), word_units
        if name not in cls._made:
            cls._made[name] = cls(text, word_units)
        return cls._made[name]

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.words: dict[str, list[int]] = {}
        self.held = 0
        self.met = np.zeros(0, np.int64)
        self.ids, self.at, self.token, self.n_ids, self.n_borders, self.first, self.first_border = (Grown() for _ in range(7))

    def renew(self) -> None:
        """Forget the units that were met once, and if they are many, those met less often than others."""
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > KEPT_UNITS // 2:
            keep = np.sort(keep[np.argsort(-self.met[keep], kind="stable")[:KEPT_UNITS // 2]])
        n, m = (x.view()[keep].astype(np.int64) for x in (self.n_ids, self.n_borders))
        ids = self.ids.view()[np.repeat(self.first.view()[keep], n) + runs(n)]
        border = np.repeat(self.first_border.view()[keep], m) + runs(m)
        at, token, units = self.at.view()[border], self.token.view()[border], list(self.index)
        self.clear()
        kept = [units[k] for k in keep.tolist()]
        if sum(map(len, kept)) < KEPT_BYTES // 2:  # else a few units of great length
            self._store(kept, ids, n, at, token, m)

    def _store(self, units: list[bytes], ids: np.ndarray, n: np.ndarray, at: np.ndarray, token: np.ndarray, m: np.ndarray) -> None:
        for unit in units:
            self.index[unit] = len(self.index)
            self.held += len(unit)
        self.first.add(np.cumsum(n) - n + self.ids.n)
        self.first_border.add(np.cumsum(m) - m + self.at.n)
        for store, values in ((self.n_ids, n), (self.n_borders, m), (self.ids, ids), (self.at, at), (self.token, token)):
            store.add(values)
        met = np.zeros(len(self.index), np.int64)
        met[:len(self.met)] = self.met
        self.met = met

    def _add(self, units: list[bytes]) -> None:
        """Simple units go straight to the tokenizer's merges, with a border at their first character; others
        through the whole tokenizer, with all their borders."""
        n, m = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        ids: list[int] = []
        simple, alone = [], []
        for i, u in enumerate(units):
            pieces = self.simple(u)
            if pieces is None:
                alone.append(i)
                continue
            simple.append(i)
            before = len(ids)
            for p in pieces:
                known = self.words.get(p)
                if known is None:
                    known = [t.id for t in self.tokenizer.model.tokenize(p)]
                    if len(self.words) < KEPT_WORDS:
                        self.words[p] = known
                ids += known
            n[i] = len(ids) - before
        m[simple] = 1
        texts = [units[i].decode() for i in alone]
        inner: dict[int, list[tuple[int, int]]] = {}
        for i, t, e in zip(alone, texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids += e.ids
            n[i] = len(e.ids)
            inner[i] = self.borders(t, e)
            m[i] = len(inner[i])
        # from the order of encoding to that of the units
        order = np.array([*simple, *alone], np.int64)
        first = np.zeros(len(units), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        flat = np.array(ids, np.int64)[np.repeat(first, n) + runs(n)]
        first = np.cumsum(m) - m
        at, token = np.zeros(m.sum(), np.int64), np.zeros(m.sum(), np.int64)
        for i, borders in inner.items():
            for j, (x, t) in enumerate(borders, first[i]):
                at[j], token[j] = x, t
        self._store(units, flat, n, at, token, m)

    def simple(self, unit: bytes) -> list[str] | None:
        """Pre-tokens of a short unit of printable ASCII and composed Latin letters, as the model takes them;
        None for other units and other tokenizers. Such a unit is normal already but for its case."""
        if not self.plain or len(unit) > SHORT:
            return None
        text = unit.decode()
        if SIMPLE.fullmatch(text) is None or any(t in text for t in self.added_texts):
            return None
        pieces = PIECE.findall(text.lower())
        return pieces if text.isascii() else [p.translate(LATIN_BYTES) for p in pieces]

    @staticmethod
    def borders(text: str, e) -> list[tuple[int, int]]:
        """Byte and token of every pre-token whose first character is safe."""
        out, last, at, byte = [], None, 0, 0
        for i, (word, (begin, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if word == last:
                continue
            last = word
            if safe(text[begin]):
                byte += len(text[at:begin].encode())
                at = begin
                if not out or out[-1][0] != byte:
                    out.append((byte, i))
        return out

    def encode(self, texts: list[bytes]) -> list[Encoded]:
        out: list[Encoded] = []
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BATCH_BYTES or i + 1 == len(texts):
                out += self._batch(texts[at:i + 1])
                at, size = i + 1, 0
        return out

    def _batch(self, texts: list[bytes]) -> list[Encoded]:
        if len(self.index) >= KEPT_UNITS or self.held >= KEPT_BYTES:
            self.renew()
        data = b"".join(texts)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if self.word_units:
            start, end, text = unit_bounds(np.frombuffer(data, np.uint8), offsets)
        else:
            text = np.flatnonzero(np.diff(offsets))
            start, end = offsets[text], offsets[text + 1]
        place, inverse = distinct_units(np.frombuffer(data, np.uint8), start, end)
        units = [data[a:b] for a, b in zip(start[place].tolist(), end[place].tolist())]
        known = list(map(self.index.get, units))
        new = dict.fromkeys([u for u, k in zip(units, known) if k is None])
        if new:
            self._add(list(new))
            known = [self.index[u] if k is None else k for u, k in zip(units, known)]
        u = np.array(known, np.int64)[inverse]
        self.met += np.bincount(u, minlength=len(self.met))
        n, m = (x.view()[u].astype(np.int64) for x in (self.n_ids, self.n_borders))
        before = np.cumsum(n) - n  # tokens of the batch before each unit
        ids = self.ids.view()[np.repeat(self.first.view()[u], n) + runs(n)].astype(np.uint32)
        border = np.repeat(self.first_border.view()[u], m) + runs(m)
        ends = np.concatenate([[0], np.cumsum(np.bincount(text, n, len(texts)))]).astype(np.int64)
        last = np.concatenate([[0], np.cumsum(np.bincount(text, m, len(texts)))]).astype(np.int64).tolist()
        at = (self.at.view()[border] + np.repeat(start - offsets[text], m)).tolist()
        token = (self.token.view()[border] + np.repeat(before - ends[text], m)).tolist()
        ends = ends.tolist()
        return [Encoded(ids[a:b], at[c:d], token[c:d]) for a, b, c, d in zip(ends, ends[1:], last, last[1:])]


class Chunk:
    """A chunk's ids with its first borders and its last settled one."""

    def __init__(self, ids: np.ndarray, heads: list[tuple[int, int]], tail: tuple[int, int] | None):
        self.ids, self.heads, self.tail = ids, heads, tail

    @classmethod
    def of(cls, size: int, e: Encoded, margin: int) -> "Chunk":
        i = bisect.bisect_right(e.at, size - margin) - 1
        return cls(e.ids, list(zip(e.at[:HEADS], e.token[:HEADS])), (e.at[i], e.token[i]) if i >= 0 else None)

    def pack(self) -> bytes:
        flat = [x for h in self.heads for x in h] + list(self.tail or (0, 1 << 31))
        return np.array([len(self.heads), *flat], "<u4").tobytes() + self.ids.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> "Chunk":
        a = np.frombuffer(data, "<u4")
        n = int(a[0])
        flat = a[1:2 * n + 3].tolist()
        tail = None if flat[-1] == 1 << 31 else (flat[-2], flat[-1])
        return cls(a[2 * n + 3:], list(zip(flat[:2 * n:2], flat[1:2 * n:2])), tail)


# ---------------------------------------------------------------- joins

def _until(data: bytes, to: int) -> int:
    """The end of the character that byte ``to`` lies in, or of the data."""
    while to < len(data) and data[to] & 0xC0 == 0x80:
        to += 1
    return min(to, len(data))


def join_windows(text: bytes, starts: list[int], chunks: list[Chunk], margin: int) -> list[bytes]:
    """Text around each join: from the settled border before it to beyond the last tried one after
    it; empty where one of the sides has no border."""
    out = []
    for i in range(1, len(chunks)):
        tail, heads = chunks[i - 1].tail, chunks[i].heads
        out.append(text[starts[i - 1] + tail[0]:_until(text, starts[i] + heads[-1][0] + margin)] if tail and heads else b"")
    return out


def join_chunks(text: bytes, starts: list[int], chunks: list[Chunk], windows: list[Encoded], encoder: Encoder) -> np.ndarray:
    """A document's ids. ``starts``: each chunk's first byte, and the text's end; ``windows``: encodings
    of ``join_windows``."""
    if len(chunks) == 1:
        return chunks[0].ids
    out: list[np.ndarray] = []
    held, begin = chunks[0], starts[0]  # the chunk at work and its first byte
    at, token = 0, 0  # border from which its ids are right
    i, grow = 1, 1
    while i < len(chunks):
        behind = held.tail if held.tail is not None and held.tail[0] >= at else (at, token)
        window, found = None, None
        if grow == 1 and chunks[i].heads:
            if held is chunks[i - 1] and behind == held.tail:
                window = windows[i - 1]
            else:
                to = _until(text, starts[i] + chunks[i].heads[-1][0] + encoder.margin)
                window = encoder.encode([text[begin + behind[0]:to]])[0]
            shift = starts[i] - begin - behind[0]
            found = next(((h, t) for h in chunks[i].heads if (t := window.token_at(shift + h[0])) is not None), None)
        out.append(held.ids[token:behind[1]])
        if found:
            (at, token), t = found
            out.append(window.ids[:t])
            held, begin = chunks[i], starts[i]
            i += 1
            continue
        # no agreement: the next chunks are encoded together with what is open
        to = min(len(chunks), i + grow)
        begin += behind[0]
        whole = text[begin:starts[to]]
        held = Chunk.of(len(whole), encoder.encode([whole])[0], encoder.margin)
        at, token = 0, 0
        grow = 1 if held.tail is not None and held.tail[0] > 0 else 2 * grow
        i = to
    out.append(held.ids[token:])
    return np.concatenate(out)


def block_keys(block: pa.Table) -> pa.Table:
    """``(block, k)``: the distinct chunk keys of a block."""
    keys = list({k for row in block.column("keys").to_pylist() for k in row})
    number = block.column("block")[0].as_py() if block.num_rows else 0
    return pa.table({"block": pa.array([number] * len(keys), pa.int64()), "k": pa.array(keys, pa.binary())})


def _packed(block: pa.Table) -> Iterator[tuple[bytes, list[int], list[bytes], list[int]]]:
    """Texts, chunk ends, chunk keys and chunks per document of a block's packed rows."""
    unzip = zstandard.ZstdDecompressor()
    for texts, lengths, keys, chunks in zip(*(block.column(c) for c in ("texts", "lengths", "keys", "chunks"))):
        ends = np.cumsum(lengths.values.to_numpy()).tolist()
        yield (unzip.decompress(texts.as_py()), ends, keys.as_py(), chunks.values.to_pylist()) if ends else (
            b"", [], [], chunks.values.to_pylist())


def _encode_chunks(found: dict[bytes, bytes], encoder: Encoder) -> Iterator[tuple[bytes, Chunk]]:
    names = list(found)
    for at in range(0, len(names), 256):
        texts = [found[k] for k in names[at:at + 256]]
        for k, t, e in zip(names[at:at + 256], texts, encoder.encode(texts)):
            yield k, Chunk.of(len(t), e, encoder.margin)


def encode_owned(block: pa.Table, owned: pa.Table, encoder: Encoder) -> pa.Table:
    """``(k, chunk)``: the shared chunks that the block owns."""
    wanted, found = set(owned.column("k").to_pylist()), {}
    if wanted:
        for data, ends, keys, _ in _packed(block):
            found |= {k: data[a:b] for k, a, b in zip(keys, [0, *ends], ends) if k in wanted}
    made = {k: c.pack() for k, c in _encode_chunks(found, encoder)}
    return pa.table({"k": pa.array(list(made), pa.binary()), "chunk": pa.array(list(made.values()), pa.binary())})


def encode_block(block: pa.Table, answers: pa.Table, encoder: Encoder) -> pa.Table:
    """Ids of a block's documents; ``answers`` holds the ids of its shared chunks."""
    known = {k: Chunk.unpack(c) for k, c in zip(answers.column("k").to_pylist(), answers.column("chunk").to_pylist())}
    ids: list[np.ndarray] = [np.empty(0, np.uint32)]
    count = [0]
    for data, ends, keys, chunks in _packed(block):
        starts = [0, *ends]
        new = {k: data[a:b] for k, a, b in zip(keys, starts, ends) if k not in known}
        known.update(_encode_chunks(new, encoder))
        docs, first = [], 0
        for n in chunks:
            begin = starts[first]
            docs.append((data[begin:starts[first + n]], [s - begin for s in starts[first:first + n + 1]],
                         [known[k] for k in keys[first:first + n]]))
            first += n
        for at in range(0, len(docs), 64):
            some = docs[at:at + 64]
            windows = [join_windows(*d, encoder.margin) for d in some]
            encoded = iter(encoder.encode([w for x in windows for w in x]))
            for d, x in zip(some, windows):
                mine = [next(encoded) for _ in x]
                if d[2]:
                    ids.append(join_chunks(*d, mine, encoder))
                count.append(len(ids[-1]) if d[2] else 0)
    doc_ids = [i for row in block.column("ids").to_pylist() for i in row]
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(
        pa.array(np.cumsum(count), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))})


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text",
           size: tuple[int, int, int] = CHUNK, block_bytes: int = BLOCK_BYTES, word_units: bool = True) -> DataFrame:
    """``(doc_id, ids)`` for every row, as the library encodes its whole text without added tokens."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_read(tokenizer))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    # rows that are alike in all lie apart by their task
    where = F.pmod(F.xxhash64(id_col, text_col, F.spark_partition_id()), F.lit(max(1, -(-total // block_bytes))))
    blocks = docs.select(where.alias("block"), F.col(id_col).cast("long").alias("doc_id"),
                         F.col(text_col).cast("string").alias("text")).mapInArrow(pack_blocks(size), PACKED).groupBy("block")
    keys = blocks.applyInArrow(block_keys, "block long, k binary")
    owners = keys.groupBy("k").agg(F.min("block").alias("owner"), F.count("*").alias("n")).where("n > 1").select("k", "owner")
    chunks = blocks.cogroup(owners.groupBy("owner")).applyInArrow(
        lambda b, o: encode_owned(b, o, Encoder.get(shared.value, word_units)), "k binary, chunk binary")
    answers = keys.join(chunks, "k").select(F.col("block").alias("block"), "k", "chunk")
    return blocks.cogroup(answers.groupBy("block")).applyInArrow(
        lambda b, a: encode_block(b, a, Encoder.get(shared.value, word_units)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER, ids_col: str = "ids", finish=None, schema: str | None = None) -> DataFrame:
    """``encoded`` with the column ``text``: its ids decoded, control tokens included; null ids give an
    empty text. A tokenizer without a decoder gives its tokens' names, a space between them; then workers
    need the names only. ``finish`` (with the ``schema`` it gives) takes the batches on in the same worker."""
    from tokenizers import Tokenizer
    spec = _read(tokenizer)
    lib = Tokenizer.from_str(spec)
    names = [(lib.id_to_token(i) or "").encode() for i in range(lib.get_vocab_size(with_added_tokens=True))]
    if lib.decoder is not None or not all(names):
        names = None
    shared = encoded.sparkSession.sparkContext.broadcast((names, None if names else spec))
    base = encoded.drop("text")
    at = base.columns.index(ids_col)

    def texts_of(lists: list[list[int]]) -> list[bytes]:
        names, spec = shared.value
        if names is not None:
            return [b" ".join(map(names.__getitem__, x)) for x in lists]
        return [t.encode() for t in Encoder.get(spec).tokenizer.decode_batch(lists, skip_special_tokens=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            for a in range(0, held.num_rows, 64):
                batch = held.slice(a, 64)
                column = batch.column(at)
                ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy()).tolist()
                flat = column.flatten().to_numpy().tolist()
                texts = texts_of([flat[x:y] for x, y in zip([0, *ends], ends)])
                out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())],
                                                 names=[*batch.schema.names, "text"])
                yield finish(out) if finish else out
    return base.mapInArrow(run, schema or StructType(base.schema.fields[:]).add("text", "string"))


def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of ids and their decoded text."""
    ids = [x.values.to_numpy().astype("<u4") for x in batch.column("ids")]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
         pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
         pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column("text")], pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@register("op13_chunked_bpe")
def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by chunk reuse, and the text decoded from them, as digests."""
    return decode(encode(read_table(spark, sf_dir, "documents")), finish=digests,
                  schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
