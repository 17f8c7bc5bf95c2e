"""N-gram Jaccard join by parity sketches.

Every document becomes the set of its distinct word shingles (64-bit hashes). Two sets with
Jaccard similarity at least ``num / den`` differ in at most ``T`` shingles, ``T`` following from the
larger size. The shingle space is cut into ``T + 1 + z`` parts; each shingle flips bits of its
part's parity sketch (XOR of shingle hashes, a linear hash of the part's parity vector), so
a differing shingle changes at most one part and the number of unequal parts lower-bounds the
symmetric difference. By the pigeonhole principle a pair within the threshold agrees in at
least ``z + 1`` parts. Sizes are banded, because ``T`` depends on the size; a document enters its own band and
every band that a partner above it can lie in, and joins on (band, part, sketch). A part with few
shingles says little, one with none nothing, so a document leaves out its parts of fewer than ``k``
shingles, ``k`` being the largest number for which these are at most ``z`` (``z`` is chosen to make ``k`` large). No link is
lost: of two linked documents take the one with the larger ``k``; at most ``z`` of the parts in which they agree have
fewer shingles than that, so one remains, which both use. Candidates are verified on the whole sets.
Nothing is capped.

Links are not expanded into all pairs: identical sets are one class, and buckets with the same members
(told by 128 bits of hash) one bucket; in each bucket members meet its smallest member; only in buckets that then still hold several components,
members of different ones are compared by fine parity sketches, in blocks within a task. Pairs that the
Hamming distance (a lower bound of the difference) does not rule out are verified, the closest of each member first; buckets
with more of them offer growing numbers for each member until none is left between two of their components. So a group that is
not yet linked does not offer all its pairs at once.

Defined cases: null, empty or blank text has an empty set and links with nothing; repeated
rows of one id count as one document; a null id gets its size and a null component; empty tables
give empty results; only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from ._common import StagedTables, connected_components, mix64, passes, register, shingle_hashes, word_hashes

#: Key rows that leave a task together, and bits of a key.
PACK, KEY_BITS = 1 << 16, 48
#: Keys that a task holds before they leave, so that its memory does not follow the size of its part of the table.
HELD_KEYS = 1 << 19
#: Buckets up to this size are compared together.
SMALL = 64
#: Pairs that a member of an open bucket offers at first.
CLOSEST = 8
#: Members of a bucket that one task compares with as many others.
BUCKET_ROWS = 4096
#: Members of small buckets that one call compares, about.
GROUP_ROWS = 512
#: Largest table of ids that is broadcast (bytes, from its exact count and the bytes of a row in a hash table).
BROADCAST_BYTES, ROW_BYTES = 8 << 20, 64
#: Shingles per partition of keys.
TASK_SHINGLES = 8 << 20


@lru_cache(maxsize=None)
def band_start(j: int, num: int, den: int) -> int:
    """Smallest set size of band ``j``: bands grow by the ratio of linked sizes."""
    if j == 0:
        return 1
    before = band_start(j - 1, num, den)
    return max(before + 1, before * den // num + 1)


@lru_cache(maxsize=None)
def band_parts(j: int, num: int, den: int) -> tuple[int, int]:
    """Parts of band ``j`` and the number ``z`` of poor ones that a document may leave out.

    Of ``z`` up to a quarter of the parts the one is taken with which the most shingles are expected in
    every part that is used: the shingles of a part are about Poisson distributed."""
    t = 2 * (band_start(j + 1, num, den) - 1) * (den - num) // (den + num)
    if t == 0:
        return 1, 0
    best = (-1, 0)
    for z in sorted({0, 1, 2, *(ceil((t + 1) * f / 40) for f in range(1, 11))}):
        parts, least = t + 1 + z, -1
        mean = band_start(j, num, den) / parts
        chance = total = exp(-mean)  # of a part with at most ``least + 1`` shingles
        while parts * total + 3 * sqrt(parts * total) <= z:
            least += 1
            chance *= mean / (least + 1)
            total += chance
        best = max(best, (least, -z))
    z = -best[1]
    return t + 1 + z, z


def bands_of(n: int, num: int, den: int) -> range:
    """Bands that a set of ``n`` shingles enters: its own to that of its largest partner."""
    j = 0
    while band_start(j + 1, num, den) <= n:
        j += 1
    k = j
    while band_start(k + 1, num, den) * num <= n * den:
        k += 1
    return range(j, k + 1)


def part_keys(hashes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Join keys of one distinct shingle set over all its bands and parts."""
    keys = []
    high, flips = hashes >> np.uint64(32), mix64(hashes)
    for j in bands_of(len(hashes), num, den):
        parts, z = band_parts(j, num, den)
        part = ((high * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        full = np.flatnonzero(counts)
        sketch = np.zeros(parts, np.uint64)
        sketch[full] = np.bitwise_xor.reduceat(flips[order], (np.cumsum(counts) - counts)[full])
        use = np.flatnonzero(counts >= np.partition(counts, z)[z])  # at most ``z`` parts have fewer shingles
        keys.append(mix64(mix64(sketch[use]) + np.uint64(j << 40) + use.astype(np.uint64)))
    return np.concatenate(keys)


def doc_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a pass."""
    words, of = word_hashes(raw, offsets)
    hashes, docs = shingle_hashes(words, of, len(offsets) - 1, n)
    ends = np.searchsorted(docs, np.arange(len(offsets) - 1), "right")
    return [np.unique(hashes[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]


def doc_digests(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """``(doc_id, n, d1, d2)``: size and 128-bit digest of each document's shingle set."""
    for batch in batches:
        for rows, raw, offsets in passes(batch):
            out = [(len(s), *_digest(s)) for s in doc_sets(raw, offsets, n)]
            cols = [pa.array(np.array(c, dtype=np.uint64).astype(np.int64)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), *cols], names=["doc_id", "n", "d1", "d2"])


def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return (int(np.bitwise_xor.reduce(mix64(s + np.uint64(1)))),
            int(np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))))


def planes(x: np.ndarray) -> bytes:
    """64-bit values byte by byte: all lowest bytes, all second ones and so on; equal high bytes compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def pack_keys(keys: np.ndarray, nodes: np.ndarray) -> bytes:
    """Ascending keys as differences, and their nodes."""
    return zstandard.ZstdCompressor(level=1).compress(planes(np.diff(keys, prepend=np.uint64(0))) + planes(nodes))


def unpack_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.cumsum(from_planes(raw[:len(raw) // 2]), dtype=np.uint64), from_planes(raw[len(raw) // 2:]).astype(np.int64)


def task_keys(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Join keys of a task's documents as packed rows ``(part, known, keys)``: one for each of the ``parts`` ranges
    of keys, so that a key costs a few bytes and one row holds many.

    Within the task, sets already seen give no keys. Every ``HELD_KEYS`` keys leave together: a key that several
    documents among them have goes to its range once, for the smallest of them; all its members go beside it
    (``known``), spread over the parts, so that a key of very many documents loads no partition. Keys have
    ``KEY_BITS`` bits: a clash makes a candidate more."""
    seen: dict[tuple[int, int, int], int] = {}
    held, docs = [], []
    for batch in batches:
        for rows, raw, offsets in passes(batch):
            for doc, s in zip(rows.column(0).to_pylist(), doc_sets(raw, offsets, n)):
                if len(s) and doc is not None and seen.setdefault((len(s), *_digest(s)), doc) == doc:
                    held.append(np.unique(part_keys(s, num, den) >> np.uint64(64 - KEY_BITS)))
                    docs.append(doc)
            if sum(map(len, held)) >= HELD_KEYS:
                yield from _packed_keys(held, docs, parts)
    if held:
        yield from _packed_keys(held, docs, parts)


def _packed_keys(held: list[np.ndarray], of: list[int], parts: int) -> Iterator[pa.RecordBatch]:
    """The rows of some documents' keys; empties both lists."""
    keys, docs = np.concatenate(held), np.repeat(np.array(of, np.int64), [len(k) for k in held])
    held.clear()
    of.clear()
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    del order
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    many = _in_groups(keys, docs)
    own, node = keys[first], docs[first]
    width = (1 << KEY_BITS) // parts + 1
    cuts = np.searchsorted(own, (np.arange(parts + 1, dtype=np.uint64) * np.uint64(width)))
    some = np.flatnonzero(np.diff(cuts))
    for at in range(0, len(some), 64):
        rows = [(int(p), pack_keys(own[cuts[p]:cuts[p + 1]], node[cuts[p]:cuts[p + 1]])) for p in some[at:at + 64]]
        yield _key_rows(rows, False)
    known, node = keys[many], docs[many]
    lead = int(keys[0]) % parts
    for i, at in enumerate(range(0, len(known), PACK)):
        yield _key_rows([((lead + i) % parts, pack_keys(known[at:at + PACK], node[at:at + PACK]))], True)


def _key_rows(rows: list[tuple[int, bytes]], known: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([known] * len(rows)), pa.array([r[1] for r in rows], pa.binary())],
        names=["part", "known", "keys"])


def _in_groups(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows (sorted by key, document) whose key has at least two different documents."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.concatenate([starts[1:], [len(keys)]])
    return np.repeat(docs[starts] != docs[ends - 1], ends - starts)


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, node)`` of a partition: keys of several documents, and rows known to be such."""
    parts, nodes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]

    def rows(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(key), PACK):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[at:at + PACK].astype(np.int64)), pa.array(node[at:at + PACK])], names=["key", "node"])
    for batch in batches:
        for known, packed in zip(batch.column(1).to_pylist(), batch.column(2)):
            key, node = unpack_keys(packed.as_py())
            if known:
                yield from rows(key, node)
            else:
                parts.append(key)
                nodes.append(node)
    keys, docs = np.concatenate(parts), np.concatenate(nodes)
    parts.clear()
    nodes.clear()
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    if len(keys):
        many = _in_groups(keys, docs)
        yield from rows(keys[many], docs[many])


def sketch_words(n: int, num: int, den: int) -> int:
    """64-bit words of the fine sketch of a set: a power of two with several bits per difference."""
    t = 2 * n * (den - num) // (den + num) + 1
    return max(4, 1 << int(8 * t / 64).bit_length())


def fine_sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch of ``64 * words`` bits: each shingle flips one. Halves XORed give the sketch of half the size."""
    bit = mix64(hashes ^ np.uint64(0x5555555555555555)) % np.uint64(64 * words)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8")


def shingle_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """``(node, hashes)``: the whole shingle set of each document as sorted 64-bit values."""
    for batch in batches:
        for rows, raw, offsets in passes(batch):
            sets = [s.tobytes() for s in doc_sets(raw, offsets, n)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], names=["node", "hashes"])


def fine_sketches(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """``(node, n, sketch)``: size and fine parity sketch of each document's shingle set."""
    for batch in batches:
        for rows, raw, offsets in passes(batch):
            sets = doc_sets(raw, offsets, n)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([fine_sketch(s, sketch_words(len(s), num, den)).tobytes() for s in sets], pa.binary())],
                names=["node", "n", "sketch"])


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def possible(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sizes and sketches, those that the Hamming distance does not rule out."""
    for batch in batches:
        n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        keep = np.minimum(n, m) * den >= np.maximum(n, m) * num
        most = (n + m) * (den - num) // (den + num)
        for i in np.flatnonzero(keep).tolist():
            x, y = (np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in (4, 5))
            words = min(len(x), len(y))
            keep[i] = np.bitwise_count(folded(x, words) ^ folded(y, words)).sum() <= most[i]
        keep = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def near_in_buckets(table: pa.Table, num: int, den: int, closest: int) -> pa.Table:
    """``near_in_bucket`` for all buckets of a group. The many small ones are compared together,
    neighbour by neighbour; the others one at a time."""
    table = table.sort_by([("key", "ascending"), ("node", "ascending")])
    key, node, comp, n = (table.column(c).to_numpy() for c in ("key", "node", "c", "n"))
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    found, unfinished = [np.empty((0, 2), np.int64)], []
    for a, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        pairs, more = _near_in_bucket(table.slice(a, m), num, den, closest)
        found.append(pairs)
        if more:
            unfinished.append(int(key[a]))
    rows = np.flatnonzero(np.repeat(size <= SMALL, size))
    key, node, comp, n = key[rows], node[rows], comp[rows], n[rows]
    raw = [np.frombuffer(x.as_py(), "<u8") for x in table.column("sketch").combine_chunks().take(pa.array(rows))]
    words = np.array([len(r) for r in raw], np.int64)
    # per sketch length: its rows and longer ones as far as linked sets can be apart, folded to it
    span = 2
    while span * num < den:
        span *= 2
    sketch, place = {}, {}
    for w in np.unique(words).tolist():
        own = np.flatnonzero((words >= w) & (words <= w * span))
        sketch[w] = np.stack([folded(raw[i], w) for i in own.tolist()])
        place[w] = np.zeros(len(words), np.int64)
        place[w][own] = np.arange(len(own))
    del raw
    near = [np.empty((0, 3), np.int64)]  # rows of two members and their distance
    for t in range(1, SMALL):  # every member with the t-th after it in its bucket
        i = np.flatnonzero(key[t:] == key[:-t]) if t < len(key) else np.empty(0, np.int64)
        if not len(i):
            break
        j = i + t
        ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
        i, j = i[ok], j[ok]
        most, least = (n[i] + n[j]) * (den - num) // (den + num), np.minimum(words[i], words[j])
        for w, x in sketch.items():
            for at in np.array_split(np.flatnonzero(least == w), 1 + len(i) * w // (1 << 21)):
                d = np.bitwise_count(x[place[w][i[at]]] ^ x[place[w][j[at]]]).sum(axis=1, dtype=np.int64)
                k = d <= most[at]
                near.append(np.stack([i[at[k]], j[at[k]], d[k]], 1))
    i, j, d = np.concatenate(near).T
    either = _offered(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([comp[j], comp[i]]),
                      np.concatenate([d, d]), closest)
    take = either[:len(i)] | either[len(i):]
    found.append(np.stack([node[i[take]], node[j[take]]], 1))
    return _pairs(found, unfinished + np.unique(key[i[~take]]).tolist())


def _offered(who: np.ndarray, whom: np.ndarray, comp: np.ndarray, d: np.ndarray, closest: int) -> np.ndarray:
    """Which candidates ``whom`` (of component ``comp``, at distance ``d``) are offered: the ``closest`` for each
    ``who``, where the first of every component comes before the second of any."""
    def places(*names: np.ndarray) -> np.ndarray:
        new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in names], axis=0)])[:len(names[0])]
        start = np.flatnonzero(new)
        return np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))
    order = np.lexsort((whom, d, comp, who))
    turn = places(who[order], comp[order])
    order = order[np.lexsort((whom[order], d[order], turn, who[order]))]
    offered = np.zeros(len(who), bool)
    offered[order] = places(who[order]) < closest
    return offered


def _pairs(found: list[np.ndarray], unfinished: list[int]) -> pa.Table:
    """Distinct candidate pairs, after a row without a pair for each bucket that has others (``more``, and its key)."""
    pairs, rest = np.unique(np.concatenate(found), axis=0), pa.nulls(len(unfinished), pa.int64())
    return pa.table({"a": pa.concat_arrays([rest, pa.array(pairs[:, 0])]), "b": pa.concat_arrays([rest, pa.array(pairs[:, 1])]),
                     "more": np.arange(len(rest) + len(pairs)) < len(rest),
                     "key": pa.array(unfinished + [None] * len(pairs), pa.int64())})


def near_in_bucket(table: pa.Table, num: int, den: int, closest: int) -> pa.Table:
    """Pairs of a bucket's members in different components whose fine sketches differ in no more
    bits than linked sets of their sizes can: for each member outside the largest component the ``closest`` ones, of as
    many components as can be, so that a bucket of many components offers no more pairs for that. A row with ``more``
    and the bucket's key says that there are others."""
    pairs, more = _near_in_bucket(table, num, den, closest)
    return _pairs([pairs], [table.column("key")[0].as_py()] if more else [])


def _near_in_bucket(table: pa.Table, num: int, den: int, closest: int) -> tuple[np.ndarray, bool]:
    node, comp = table.column("node").to_numpy(), table.column("c").to_numpy()
    side, n = table.column("side").to_numpy(), table.column("n").to_numpy()
    raw = [np.frombuffer(x.as_py(), "<u8") for x in table.column("sketch")]
    words = min(map(len, raw), default=1)
    x = np.stack([folded(r, words) for r in raw]) if raw else np.empty((0, 1), np.uint64)
    names, at, sizes = np.unique(comp, return_inverse=True, return_counts=True)
    few = np.flatnonzero(at != sizes.argmax()) if len(names) else np.empty(0, np.int64)
    pairs, more = [np.empty((0, 2), np.int64)], False
    step = max(1, (1 << 22) // max(1, x.size))
    for k in range(0, len(few), step):
        i = few[k:k + step]
        ok = (comp[i][:, None] != comp) & ((side[i][:, None] != side) | (side[i][:, None] == 2))
        ok &= (np.minimum(n[i][:, None], n) * den >= np.maximum(n[i][:, None], n) * num)
        r, c = np.nonzero(ok)
        d = np.bitwise_count(x[i[r]] ^ x[c]).sum(axis=1)
        near = d <= (n[i[r]] + n[c]) * (den - num) // (den + num)
        r, c, d = r[near], c[near], d[near]
        take = _offered(r, node[c], at[c], d, closest)
        more |= not take.all()
        a, b = node[i[r[take]]], node[c[take]]
        pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    return np.concatenate(pairs), more


def verified(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets reach the similarity exactly: ``den * |A and B| >= num * |A or B|``."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
                continue
            both = int(np.isin(x, y, assume_unique=True, kind="sort").sum())
            keep[i] = den * both >= num * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def open_pairs(members: DataFrame, labels: DataFrame, sketches: DataFrame, num: int, den: int, closest: int,
               tables: StagedTables) -> DataFrame:
    """Candidate pairs ``(a, b, more, key)`` of buckets whose members are in several components; rows with ``more`` have
    no pair and name a bucket with other candidates, which more of the closest would show. In a bucket of more
    than ``BUCKET_ROWS`` the members outside its largest component seek among all members: seekers and
    members are each cut into blocks of about that size, and every two meet in one task. So a large group whose
    members are linked already is dealt out once for each block of the few that are not."""
    named = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    open_keys = named.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.sum("n").alias("m"), F.max(F.struct("n", "c")).alias("big")).where("big.n < m").select(
        "key", F.col("big.c").alias("big"), F.ceil(F.col("m") / BUCKET_ROWS).cast("int").alias("blocks"),
        F.ceil((F.col("m") - F.col("big.n")) / BUCKET_ROWS).cast("int").alias("seeking"))
    # staged: the buckets of one block and the larger ones are both read from it
    found, kind = tables.write(named.join(open_keys, "key")), "a long, b long, more boolean, key long"
    # buckets of one block share groups, so that many small ones cost one call; there all meet all (side 2)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = min(32 * parts, max(parts, found.count() // GROUP_ROWS))
    whole = (found.where("blocks = 1").select("key", "node", "c", F.lit(2).alias("side")).join(sketches, "node")
             .withColumn("g", F.pmod("key", F.lit(groups))).groupBy("g")
             .applyInArrow(lambda t: near_in_buckets(t, num, den, closest), kind))

    def dealt(rows: DataFrame, side: int, own: str, of: str, other: str, others: str) -> DataFrame:
        return rows.select("key", "node", "c", F.lit(side).alias("side"),
                           F.pmod(F.xxhash64("node"), F.col(of)).cast("int").alias(own),
                           F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))
    large = found.where("blocks > 1")
    if large.isEmpty():
        return whole
    met = dealt(large, 1, "j", "blocks", "i", "seeking").unionByName(
        dealt(large.where("c <> big"), 0, "i", "seeking", "j", "blocks"))
    cut = (met.join(sketches, "node").groupBy("key", "i", "j")
           .applyInArrow(lambda t: near_in_bucket(t, num, den, closest), kind))
    return whole.unionByName(cut)


def joined_labels(labels: DataFrame, links: DataFrame, tables: StagedTables) -> DataFrame:
    """Component labels after more links: the components themselves are linked."""
    ends = [labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b")]
    between = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = tables.write(connected_components(between, tables=tables))
    top = above.withColumnRenamed("component", "top").withColumnRenamed("node", "c")
    old = labels.join(top, labels["component"] == top["c"], "left").select(
        labels["node"], F.coalesce("top", "component").alias("component"))
    return old.unionByName(above.join(labels.select("node"), "node", "left_anti").select("node", "component"))


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: documents linked when the Jaccard similarity of
    their ``n``-word shingle sets is at least ``num / den``; ``component_id`` is the smallest id
    reachable by links.

    The work is done at once; of the tables staged on the way only the result is left."""
    tables = StagedTables(docs.sparkSession)
    staged = tables.write
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes = staged(docs.mapInArrow(lambda it: doc_digests(it, n), "doc_id long, n long, d1 long, d2 long"))
    # a document has about as many keys as parts; tasks hold a bounded number of them
    spark = docs.sparkSession
    shingles = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // TASK_SHINGLES)
    classes = (sizes.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2")
               .agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("_last")).where("rep < _last"))
    copies = staged(sizes.join(classes, ["n", "d1", "d2"]).select("doc_id", "rep").distinct())
    # the texts are hashed again for the keys: less work than to write and read all keys
    met = (docs.mapInArrow(lambda it: task_keys(it, n, num, den, parts), "part int, known boolean, keys binary")
           .repartition(parts, "part").mapInArrow(shared_keys, "key long, node long"))
    members = staged(met.join(copies.withColumnRenamed("doc_id", "node"), "node", "left").select(
        "key", F.coalesce("rep", "node").alias("node")).distinct())
    # two sets that share some parts meet in as many buckets: of buckets with the same members one is enough
    sets = members.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                      F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("node").alias("hub"))
    one = sets.where("m > 1").groupBy("m", "x", "y").agg(F.min("key").alias("key"), F.min("hub").alias("hub"))
    met, members = members, staged(members.join(one.select("key", "hub"), "key"))
    tables.drop(met)

    def texts_of(nodes: DataFrame) -> DataFrame:
        nodes = staged(nodes.distinct())
        few = nodes.count() * ROW_BYTES <= BROADCAST_BYTES
        return docs.join(F.broadcast(nodes) if few else nodes, docs["doc_id"] == nodes["node"], "left_semi")
    sketches = staged(texts_of(members.select("node")).mapInArrow(
        lambda it: fine_sketches(it, n, num, den), "node long, n long, sketch binary"))

    def links_of(pairs: DataFrame) -> DataFrame:
        """The pairs that link, verified on the whole sets of just their documents."""
        sets = staged(texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))).mapInArrow(
            lambda it: shingle_sets(it, n), "node long, hashes binary"))
        left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
        return staged(both.mapInArrow(lambda it: verified(it, num, den), "a long, b long"))

    # every member against the smallest member of its buckets
    star = members.where("hub < node").groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a"))
    own, other = (sketches.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
                  for k in ("a", "b"))
    star = staged(star.join(own, "a").join(other, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(
        lambda it: possible(it, num, den), "a long, b long"))
    labels = staged(connected_components(links_of(star), tables=tables))
    # buckets that still hold several components: pairs across components, the closest first. A bucket that has
    # no others than those offered is done, since whatever is in it has been verified
    tried, closest, left = star, CLOSEST, members
    while True:
        close = staged(open_pairs(left, labels, sketches, num, den, closest, tables))
        # staged before the join, which Spark would else put below: a pair is offered by every bucket that holds it
        offers = staged(close.where("NOT more").select("a", "b").distinct())
        fresh = staged(offers.join(tried, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            links = links_of(fresh)
            if not links.isEmpty():
                labels = staged(joined_labels(labels, links, tables))
            tried = tried.unionByName(fresh)
        again = staged(close.where("more").select("key").distinct())
        if again.isEmpty():
            break
        left, closest = staged(left.join(again, "key", "left_semi")), closest * 16
    found = staged(sizes.select("doc_id", F.col("n").alias("n_shingles"))
                   .join(copies, "doc_id", "left")
                   .join(labels, F.coalesce("rep", "doc_id") == labels["node"], "left")
                   .select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")))
    tables.drop_all(found)
    return found


@register("op8_ngram_jaccard_join")
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles at a similarity of 0.9."""
    return jaccard_components(read_table(spark, sf_dir, "documents"), n=3, num=90)
