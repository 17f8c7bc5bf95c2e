"""Exact substring deduplication over suffix buckets with a difference cover.

A byte of a document goes when it lies in a string of ``min_bytes`` bytes that also starts in a
document with a smaller id. Overlaps count, matches never cross documents and all strings are
judged on the input.

1. *Which suffixes can matter.* Every window of ``min_bytes`` bytes is named by the smallest
   hash among its ``GRAM``-byte substrings, so equal windows have equal names. Each task sends its
   distinct names (packed, by name bucket); names met in one document only cannot mark a
   repeat. This filter is lossless.
2. *Buckets.* Runs of windows with one shared name travel together as one piece of text to the
   bucket of that name; equal windows therefore meet in one bucket. A name with more than
   ``HOT_BYTES`` of text is split: its windows travel one by one to the buckets of the hashes of
   their whole ``min_bytes`` bytes, which equal windows share as well. Pieces and windows that are
   equal within a document bucket are sent once, for their smallest document.
3. *Blockwise sorting.* Each bucket is sorted on its own: its suffixes by their first ``v``
   bytes, and ties by the ranks of a difference cover: the bucket's positions ``q`` with ``q mod v``
   in the cover are ranked by their next ``min_bytes - v`` bytes, and for any two suffixes ``i`` and
   ``j`` there is a shift below ``v`` that puts both on ranked positions. Equal neighbours form
   classes, and windows with a document above the smallest of their class are repeats.
4. The removed runs return to their documents.

The number of buckets grows with the measured size, and what one key brings to its bucket is
bounded by ``HOT_BYTES`` for a name; for a whole window of a split name it is one piece per document
bucket (about ``BUCKET_BYTES`` of text) and not one per document.

Defined cases: null and empty texts keep zero bytes; a null id takes no part and its text stays
whole; rows that repeat an id count as the same document and never delete each other, and spans
return to the rows with the text they were found in only; texts under ``min_bytes`` stay; empty tables give empty results; other columns travel with their document
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from ._common import mix64, passes, powers, register, utf8

#: Bytes of the substrings whose hashes name the windows.
GRAM = 24
#: Names are compared by this many low bits; a clash only adds work.
NAME_BITS = 48
#: Text of a document bucket, and of a suffix bucket if all windows were candidates.
BUCKET_BYTES = 4 << 20
#: Text of one name above which its windows are dealt out by their whole bytes.
HOT_BYTES = 1 << 20
#: Pairs of a name and a document that a task holds before they leave, so that its memory does not follow the size of
#: its part of the table.
HELD_NAMES = 1 << 19
#: Columns of a span: the variant tells different texts of one id apart.
SPAN = ("doc_id", "variant", "start", "end")
#: A difference cover for each modulus (every residue is a difference of two members).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integer arrays as compressed byte planes."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, dtype="<u8")
        out.append(np.array([len(a)], "<u8").tobytes())
        out.append(a.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 8], "little")
        planes = np.frombuffer(data, np.uint8, 8 * n, at + 8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64))
        at += 8 + 8 * n
    return out


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of which two, times the inverse power of the first's position, hash a substring."""
    power, inverse = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    return sums, inverse


def window_names(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of neighbouring windows of one document with one name: ``(runs, names)``, a
    run being ``(document index, first window, number of windows)`` in positions of ``raw``."""
    lengths = np.diff(offsets)
    docs = np.flatnonzero(lengths >= width)
    if not len(docs):
        return np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    gram = min(GRAM, width)
    sums, inverse = _sums(raw)
    low = mix64((sums[gram:] - sums[:-gram]) * inverse[:len(raw) - gram + 1])
    span, reach = width - gram + 1, 1
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    # low[i] names the window that starts at i; windows over a document's end don't exist
    change = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    first, last = offsets[docs], offsets[docs + 1] - width  # first and last window of each document
    starts = np.union1d(change, first)
    of = np.searchsorted(first, starts, "right") - 1
    ok = (of >= 0) & (starts <= last[np.maximum(of, 0)])
    following = np.concatenate([starts[1:], [len(low)]])
    starts, of, following = starts[ok], of[ok], following[ok]
    runs = np.stack([docs[of], starts, np.minimum(following, last[of] + 1) - starts], 1)
    return runs, low[starts] & np.uint64((1 << NAME_BITS) - 1)


def task_names(batches: Iterator[pa.RecordBatch], width: int, n_docs: int, n_names: int) -> Iterator[pa.RecordBatch]:
    """The distinct (name, document bucket) pairs of a task's documents, packed per name bucket, with a mark on
    names that several of the documents have and the binary logarithm of the pair's text. About ``HELD_NAMES``
    leave at a time; documents are never cut between two times, so a name met at both is one of several."""
    names, docs, buckets, sizes = held = [], [], [], []
    for batch in batches:
        for rows, raw, offsets in passes(batch):
            runs, name = window_names(raw, offsets, width)
            ids = rows.column(0).to_numpy(zero_copy_only=False)[runs[:, 0]]
            db = rows.column(2).to_numpy(zero_copy_only=False)[runs[:, 0]]
            order = np.lexsort((ids, name))
            a, b = name[order], ids[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
            names.append(a[new])
            docs.append(b[new])
            buckets.append(db[order][new])
            size = (runs[:, 2] + (width - 1))[order]
            sizes.append((np.add.reduceat(size, np.flatnonzero(new)) if len(size) else size).astype(np.int32))
            if sum(map(len, names)) >= HELD_NAMES:
                yield from _packed_names(held, n_names)
    if sum(map(len, names)):
        yield from _packed_names(held, n_names)


def _packed_names(held: tuple[list[np.ndarray], ...], n_names: int) -> Iterator[pa.RecordBatch]:
    """The rows of some documents' names; empties the lists."""
    name, doc, db, size = (np.concatenate(x) for x in held)
    for x in held:
        x.clear()
    order = np.lexsort((doc, name))
    name, doc, db, size = name[order], doc[order], db[order].astype(np.int64), size[order]
    new = np.concatenate([[True], name[1:] != name[:-1]])
    group = np.cumsum(new) - 1
    several = np.zeros(group[-1] + 1, bool)
    several[group[1:][(~new[1:]) & (doc[1:] != doc[:-1])]] = True
    pair = np.lexsort((db, name))
    name, db, several = name[pair], db[pair], several[group[pair]]
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (db[1:] != db[:-1])])
    size = np.log2(np.add.reduceat(size[pair], np.flatnonzero(new), dtype=np.int64)).astype(np.uint8)
    name, db, several = name[new], db[new], several[new]
    to = (name % np.uint64(n_names)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    name, db, several, size, to = name[order], db[order], several[order], size[order], to[order]
    cuts = np.searchsorted(to, np.arange(n_names + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[k], cuts[k + 1])
        steps = np.diff(name[s], prepend=np.uint64(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(k)], pa.int32()),
             pa.array([pack(steps, db[s] * 2 + several[s], size[s])], pa.binary())], names=["bucket", "packed"])


def shared_names(table: pa.Table, hot_bytes: int = HOT_BYTES) -> pa.Table:
    """Of one name bucket: the names that at least two documents have, per document bucket, and
    whether they have more than about ``hot_bytes`` of text in all."""
    parts = [unpack(x.as_py()) for x in table.column("packed")]
    name = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    db = np.concatenate([p[1] for p in parts]).astype(np.int64)
    size = 1 << np.concatenate([p[2] for p in parts]).astype(np.int64)
    task = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(name, kind="stable")
    name, db, task, size = name[order], db[order], task[order], size[order]
    starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(name)]]))
    many = np.maximum.reduceat(db & 1, starts).astype(bool)
    many |= np.maximum.reduceat(task, starts) != np.minimum.reduceat(task, starts)
    keep = np.repeat(many, sizes)
    hot = np.repeat(np.add.reduceat(size, starts) > hot_bytes, sizes)[keep]
    name, db = name[keep], db[keep] >> 1
    order = np.lexsort((name, db))
    name, db, hot = name[order], db[order], hot[order]
    to, at = np.unique(db, return_index=True)
    ends = np.concatenate([at[1:], [len(db)]])
    return pa.table({"db": pa.array(to, pa.int32()), "names": pa.array(
        [pack(np.diff(name[a:b], prepend=np.uint64(0)), hot[a:b]) for a, b in zip(at, ends)], pa.binary())})


def variants(docs: pa.Table) -> np.ndarray:
    """Number of each row's text among the different texts of its id (0 but for repeated ids)."""
    out = np.zeros(docs.num_rows, np.int64)
    column = docs.column("doc_id")
    some = np.flatnonzero(column.is_valid().to_numpy())
    ids = column.fill_null(0).to_numpy()[some]
    _, of, count = np.unique(ids, return_inverse=True, return_counts=True)
    again = some[count[of] > 1]
    if len(again):
        texts = docs.column("text").take(pa.array(again))
        key = [(i, hashlib.sha256((t.as_py() or "").encode()).digest())
               for i, t in zip(ids[count[of] > 1].tolist(), texts)]
        number: dict[tuple[int, bytes], int] = {}
        before: dict[int, int] = {}
        for k in sorted(set(key)):
            number[k] = before[k[0]] = before.get(k[0], -1) + 1
        out[again] = [number[k] for k in key]
    return out


def single_windows(pieces: list, width: int, n_suffix: int) -> Iterator[tuple[bytes, int, int, int, int]]:
    """Pieces ``(bytes, document, start, variant)`` cut into runs of equal windows, each with the suffix bucket
    of its window's hash."""
    for first in range(0, len(pieces), 4096):
        group = pieces[first:first + 4096]
        data = b"".join(p[0] for p in group)
        length = np.array([len(p[0]) for p in group])
        n = length - width + 1
        begin = np.cumsum(length) - length
        of = np.repeat(np.arange(len(group)), n)
        at = np.arange(len(of)) - (np.cumsum(n) - n)[of] + begin[of]
        sums, inverse = _sums(np.frombuffer(data, np.uint8))
        h = mix64((sums[at + width] - sums[at]) * inverse[at])
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
        end = at[np.concatenate([new[1:], [len(at)]]) - 1] + width
        for i, a, b, o, k in zip(of[new].tolist(), at[new].tolist(), end.tolist(), (at - begin[of])[new].tolist(),
                                 (h[new] % np.uint64(n_suffix)).tolist()):
            yield data[a:b], group[i][1], group[i][2] + o, group[i][3], k


def candidate_pieces(docs: pa.Table, shared: pa.Table, width: int, n_suffix: int) -> pa.Table:
    """Pieces of one document bucket that hold windows with a shared name, packed per suffix bucket.

    A piece that a smaller document of the bucket has too is a repeat already and goes as a span."""
    out: dict[int, list] = {}
    done: list[tuple[int, int, int, int]] = []

    def smallest(found: Iterator[tuple[bytes, int, int, int, int]]) -> None:
        best: dict[bytes, tuple[int, int, int, int]] = {}
        for piece, doc, start, v, k in found:
            mine = (doc, start, v, k)
            other = best.get(piece)
            if other is None:
                best[piece] = mine
            elif other[0] < doc:
                done.append((doc, v, start, start + len(piece)))
            elif other[0] > doc:
                best[piece] = mine
                done.append((other[0], other[2], other[1], other[1] + len(piece)))
            else:  # again in the same document
                out.setdefault(k, []).append((piece, doc, start, v))
        for piece, (doc, start, v, k) in best.items():
            out.setdefault(k, []).append((piece, doc, start, v))

    def found(known: np.ndarray, hot: np.ndarray) -> Iterator[tuple[bytes, int, int, int, int]]:
        """Pieces with their suffix bucket, -1 for names to be split."""
        variant, row = variants(docs), 0
        for batch in docs.combine_chunks().to_batches():
            for rows, raw, offsets in passes(batch):
                runs, name = window_names(raw, offsets, width)
                column = rows.column(0)
                keep = np.isin(name, known) & column.is_valid().to_numpy(zero_copy_only=False)[runs[:, 0]]
                runs, name = runs[keep], name[keep]
                ids = column.fill_null(0).to_numpy(zero_copy_only=False)[runs[:, 0]].astype(np.int64)
                data, at = raw.tobytes(), offsets[runs[:, 0]]
                to = (name % np.uint64(n_suffix)).astype(np.int64)
                to[np.isin(name, hot)] = -1
                for doc, start, n, v, k, o in zip(ids.tolist(), runs[:, 1].tolist(), runs[:, 2].tolist(),
                                                  variant[row + runs[:, 0]].tolist(), to.tolist(), at.tolist()):
                    yield data[start:start + n + width - 1], doc, start - o, v, k
                row += rows.num_rows
    if shared.num_rows and docs.num_rows:
        parts = [unpack(x.as_py()) for x in shared.column("names")]
        name = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        smallest(found(np.unique(name), np.unique(name[np.concatenate([p[1] for p in parts]) > 0])))
        smallest(single_windows(out.pop(-1, []), width, n_suffix))
    rows = []
    zip_ = zstandard.ZstdCompressor(level=1)
    for k, pieces in out.items():
        rows.append((k, zip_.compress(b"".join(p[0] for p in pieces)),
                     pack(np.array([len(p[0]) for p in pieces]), _from_signed([p[1] for p in pieces]),
                          np.array([p[2] for p in pieces]), np.array([p[3] for p in pieces])), None))
    for at in range(0, len(done), 1 << 16):
        spans = np.array(done[at:at + (1 << 16)], np.int64)
        rows.append((at % n_suffix, None, None, pack(_from_signed(spans[:, 0]), *spans[:, 1:].T)))
    cols = list(zip(*rows)) or [[], [], [], []]
    return pa.table({"sb": pa.array(cols[0], pa.int32()), "bytes": pa.array(cols[1], pa.binary()),
                     "pieces": pa.array(cols[2], pa.binary()), "spans": pa.array(cols[3], pa.binary())})


def _from_signed(x) -> np.ndarray:
    """Signed 64-bit values as unsigned ones with small magnitudes staying small."""
    x = np.asarray(x, np.int64)
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _to_signed(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(1)) ^ (np.uint64(0) - (x & np.uint64(1)))).view(np.int64)


def _words(text: np.ndarray) -> np.ndarray:
    """Big-endian 64-bit word at every position (zero bytes after the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(text)]
    return out


def _reach(words: np.ndarray, at: np.ndarray, start: int, end: int) -> list[np.ndarray]:
    """Sort keys, first one first, of the bytes ``[start, end)`` from each position (end - start >= 8)."""
    steps = [*range(start, end - 8, 8), end - 8]
    return [words[at + s] for s in steps]


def _runs_of(keys: list[np.ndarray]) -> np.ndarray:
    """Number of the run of equal rows that each row of the sorted keys is in."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def window_classes(text: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """Class number of each window (start positions in ``text``), equal exactly for windows of
    ``width`` equal bytes and rising in suffix order. ``width`` must be at least 16."""
    v = max(m for m in COVERS if m == 7 or (m >= 8 and width - m >= m))
    if width - v < 8 or v < 8:
        keys = _reach(_words(text), windows, 0, width)
        order = np.lexsort(keys[::-1])
        out = np.empty(len(windows), np.int64)
        out[order] = _runs_of([k[order] for k in keys])
        return out
    cover, length = np.array(COVERS[v]), width - v
    words = _words(text)
    # ranks of the cover's positions by their next `length` bytes
    sample = np.flatnonzero(np.isin(np.arange(len(text)) % v, cover))
    sample = sample[sample + length <= len(text)]
    keys = _reach(words, sample, 0, length)
    order = np.lexsort(keys[::-1])
    rank = np.zeros(len(text), np.int64)
    rank[sample[order]] = _runs_of([k[order] for k in keys])
    # shift[r, s]: smallest d with r + d and s + d both in the cover
    member = np.isin(np.arange(2 * v) % v, cover)
    shift = np.array([[next(d for d in range(v) if member[r + d] and member[s + d]) for s in range(v)]
                      for r in range(v)])
    # first by the leading v bytes
    keys = _reach(words, windows, 0, v)
    order = np.lexsort(keys[::-1])
    group = _runs_of([k[order] for k in keys])
    at = windows[order]
    tail = _reach(words, at, length, width)
    border = np.concatenate([[True], group[1:] != group[:-1]])
    open_ = np.flatnonzero(np.bincount(group)[group] > 1)  # places in groups of several, in order
    sub = group[open_]
    while len(open_):
        # three-way split of each open group round its middle element
        starts = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(open_)]]))
        pivot = np.repeat(open_[starts + sizes // 2], sizes)
        d = shift[at[open_] % v, at[pivot] % v]
        side = np.sign(rank[at[open_] + d] - rank[at[pivot] + d])
        for t in tail:
            tie = np.flatnonzero(side == 0)
            x, y = t[open_[tie]], t[pivot[tie]]
            side[tie] = (x > y).astype(np.int64) - (x < y)
        mixed = np.repeat(np.maximum.reduceat(np.abs(side), starts), sizes) > 0
        places, side = open_[mixed], side[mixed]
        which = np.repeat(np.arange(len(starts)), sizes)[mixed]
        key = which * 3 + side + 1
        by = np.argsort(key, kind="stable")
        key, moved = key[by], places[by]
        for array in (at, order, *tail):
            array[places] = array[moved]
        new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
        border[places[new]] = True
        more = (key % 3 != 1) & (np.bincount(key)[key] > 1) if len(key) else np.empty(0, bool)
        open_, sub = places[more], key[more]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(border)
    return out


def bucket_spans(table: pa.Table, width: int) -> pa.Table:
    """Repeated spans ``(doc_id, variant, start, end)`` of one suffix bucket, and those decided before."""
    found = [np.empty((0, 4), np.int64)]
    for x in table.column("spans").drop_null():
        doc, *others = unpack(x.as_py())
        found.append(np.stack([_to_signed(doc), *(y.astype(np.int64) for y in others)], 1))
    rows = [(zstandard.ZstdDecompressor().decompress(b.as_py()), *unpack(p.as_py()))
            for b, p in zip(table.column("bytes"), table.column("pieces")) if b.is_valid]
    if rows:
        size = np.concatenate([r[1] for r in rows]).astype(np.int64)
        doc = _to_signed(np.concatenate([r[2] for r in rows]))
        start = np.concatenate([r[3] for r in rows]).astype(np.int64)
        variant = np.concatenate([r[4] for r in rows]).astype(np.int64)
        data = b"".join(r[0] for r in rows)
        ends = np.cumsum(size)
        # equal pieces once, for their smallest document
        kind: dict[bytes, int] = {}
        of = np.array([kind.setdefault(data[e - n:e], len(kind)) for e, n in zip(ends.tolist(), size.tolist())])
        low = np.full(len(kind), np.iinfo(np.int64).max)
        np.minimum.at(low, of, doc)
        over = doc > low[of]
        found.append(np.stack([doc[over], variant[over], start[over], start[over] + size[over]], 1))
        text = np.frombuffer(b"".join(kind), np.uint8)
        length = np.array([len(k) for k in kind])
        begin = np.cumsum(length) - length
        n_win = length - width + 1
        owner = np.repeat(np.arange(len(kind)), n_win)
        windows = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win) + begin[owner]
        cls = window_classes(text, windows, width)
        least = np.full(cls.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, low[owner])
        repeat = low[owner] > least[cls]
        # runs of repeated windows of one piece
        new = repeat.copy()
        new[1:] &= ~repeat[:-1] | (owner[1:] != owner[:-1])
        last = repeat.copy()
        last[:-1] &= ~repeat[1:] | (owner[1:] != owner[:-1])
        piece, a = owner[new], windows[new] - begin[owner[new]]
        b = windows[last] - begin[owner[last]] + width
        # every holder of the piece in its smallest document has these spans
        holder = np.flatnonzero(~over)
        by = np.argsort(of[holder], kind="stable")
        holder = holder[by]
        lo, hi = np.searchsorted(of[holder], piece, "left"), np.searchsorted(of[holder], piece, "right")
        reps = hi - lo
        who = holder[np.repeat(lo, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)]
        found.append(np.stack([doc[who], variant[who], start[who] + np.repeat(a, reps),
                               start[who] + np.repeat(b, reps)], 1))
    spans = merge_spans(np.concatenate(found))
    return pa.table({c: spans[:, i] for i, c in enumerate(SPAN)})


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of ``(document, variant, start, end)`` spans, sorted; touching spans become one."""
    if not len(spans):
        return spans.reshape(0, 4)
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    other = np.concatenate([[True], (spans[1:, :2] != spans[:-1, :2]).any(axis=1)])
    group = np.cumsum(other) - 1
    top = int(spans[:, 3].max()) + 1
    reach = np.maximum.accumulate(spans[:, 3] + group * top)
    new = np.concatenate([[True], spans[1:, 2] + group[1:] * top > reach[:-1]]) | other
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(spans)]]) - 1
    return np.column_stack([spans[starts, :3], reach[ends] - group[ends] * top])


def _whole_characters(text: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """``keep`` widened to all bytes of each UTF-8 character of which some byte stays."""
    start = (text & 0xC0) != 0x80
    start[:1] = True
    at = np.flatnonzero(start)
    return np.logical_or.reduceat(keep, at)[np.cumsum(start) - 1] if len(at) else keep


def cut_out(docs: pa.Table, spans: pa.Table, whole_chars: bool) -> pa.Table:
    """Documents of one bucket with their removed spans and the remaining bytes."""
    found = merge_spans(np.stack([spans.column(c).to_numpy().astype(np.int64) for c in SPAN], 1)
                        if spans.num_rows else np.empty((0, 4), np.int64))
    variant = variants(docs)
    raw, offsets = utf8(docs.column("text"))
    kept, removed, count, lists = [], [], [], []
    for i, doc in enumerate(docs.column("doc_id").to_pylist()):
        text = raw[offsets[i]:offsets[i + 1]]
        a, b = (np.searchsorted(found[:, 0], doc, side) for side in ("left", "right")) if doc is not None else (0, 0)
        own = found[a:b]
        own = own[own[:, 1] == variant[i], 2:]
        mask = np.zeros(len(text) + 1, np.int8)
        mask[own[:, 0]] += 1
        mask[own[:, 1]] -= 1
        keep = np.cumsum(mask[:-1]) == 0
        removed.append(len(text) - int(keep.sum()))
        if whole_chars and len(own):
            keep = _whole_characters(text, keep)
        kept.append(text[keep].tobytes())
        count.append(len(own))
        lists.append([{"start": int(x), "end": int(y)} for x, y in own])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": docs.column("doc_id"), "rest": docs.column("rest"),
                     "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()),
                     "spans": pa.array(lists, span)})


def suffix_dedup(docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text",
                 whole_chars: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """``(doc_id, rest, kept, n_bytes, n_removed, n_spans, spans)``: ``kept`` holds the remaining
    bytes, ``spans`` the maximal removed runs and ``rest`` the other columns of the row.

    With ``whole_chars`` a character goes from ``kept`` only with all its bytes, so it stays text."""
    if min_bytes < 16:
        raise ValueError("min_bytes must be at least 16")
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-total // BUCKET_BYTES))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(max(n, parts))).cast("int").alias("db"),
        (F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("int").alias("none"))).alias("rest"))
    some = base.where("doc_id IS NOT NULL").select("doc_id", "text", "db")
    names = some.mapInArrow(lambda it: task_names(it, min_bytes, max(n, parts), parts), "bucket int, packed binary")
    shared = names.groupBy("bucket").applyInArrow(lambda t: shared_names(t, hot_bytes), "db int, names binary")
    # both cogroups deal out the same rows, so Spark moves the texts once
    pieces = (base.groupBy("db").cogroup(shared.groupBy("db"))
              .applyInArrow(lambda a, b: candidate_pieces(a, b, min_bytes, max(n, parts)),
                            "sb int, bytes binary, pieces binary, spans binary"))
    spans = pieces.groupBy("sb").applyInArrow(
        lambda t: bucket_spans(t, min_bytes), "doc_id long, variant long, start long, end long")
    back = spans.withColumn("db", F.pmod(F.xxhash64("doc_id"), F.lit(max(n, parts))).cast("int"))
    rest = base.schema["rest"].dataType.simpleString()
    return (base.groupBy("db").cogroup(back.groupBy("db"))
            .applyInArrow(lambda a, b: cut_out(a, b, whole_chars), f"doc_id long, rest {rest}, kept binary, n_bytes long, n_removed long, "
                                   "n_spans long, spans array<struct<start: long, end: long>>"))


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 50 bytes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, 50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
