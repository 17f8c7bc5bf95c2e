"""Shared helpers of the operators: registration, staging, fold split, components, text arrays."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query builder and, where SQL can express it, its DuckDB text."""
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage durably (an executor loss re-reads the files) and, unlike an RDD
    checkpoint, keeps the table columnar and compressed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class StagedTables:
    """Tables staged as Parquet below the shared checkpoint folder that are deleted again, each as soon
    as what was made of it stands in a table of its own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark)}/llm-{uuid.uuid4().hex}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = table, path
        return table

    def drop_all(self, *kept: DataFrame) -> None:
        """Delete all tables but some, and let Spark's cleaner find the shuffle files of the finished jobs."""
        self.drop(*[t for t, _ in list(self._paths.values()) if not any(t is k for k in kept)])
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete the tables' files; nothing that is still to be computed may read them."""
        for table in tables:
            _, path = self._paths.pop(id(table))
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def fold_of(column: str, folds: int) -> Column:
    """``crc32(column as text) mod folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a task: links reduced to one from every node to the smallest of its group."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(at[:len(a)], at[len(a):], len(nodes))
        far = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[far]]), pa.array(nodes[far])], names=["u", "v"])


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes under the links ``a - b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    return label


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tables: StagedTables | None = None) -> DataFrame:
    """Components of an undirected graph given by ``edges`` (two long columns).

    Returns one row ``(node, component)`` per node that has an edge, ``component`` being
    the smallest node of its component. Links are first reduced within each task; then large-star and
    small-star rounds alternate. A round is a grouped minimum (partial aggregates) and a join on the
    node, which splits a node with very many links, and its result is staged (in ``tables``, where given, which then
    drops each round's table when the next stands). The number of rounds is logarithmic; only a count and a sum reach
    the driver."""
    write = tables.write if tables else staged
    def star(rows: DataFrame) -> DataFrame:
        """``(u, v)`` rows to ``(m, v)`` with ``m`` the smallest of ``u`` and its ``v``."""
        low = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return rows.join(low, "u").select("m", "u", "v")

    e = write(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v")
               .mapInArrow(_forest, "u long, v long").distinct())
    before = None
    while True:
        large = star(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u AND m < v")
        large = write(large.select(F.col("v").alias("u"), F.col("m").alias("v")))  # from a node to a smaller one
        small = star(large)
        small = small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u < v").distinct()
        seen = Observation()
        old, e = e, write(small.observe(seen, F.count("*").alias("n"), F.sum(
            F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        if tables:
            tables.drop(old, large)
        now = (seen.get["n"], seen.get["h"])
        if now == before or now[0] == 0:
            break
        before = now
    leaves = e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return leaves.unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


# ---------------------------------------------------------------- text as numpy arrays

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that one numpy pass holds; larger batches are cut between documents.
PASS_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of the hash multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, PASS_BYTES)
        for i, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its ``len + 1`` offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def passes(batch: pa.RecordBatch, column: str = "text",
           size: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch between documents into slices of about ``size`` bytes of text (at least
    one document each) and give each slice with its text bytes and offsets."""
    raw, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, batch.num_rows)
        yield batch.slice(at, to - at), raw[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run of non-space bytes, A-Z lower-cased) and its document's index."""
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = ~SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    power, inverse = powers(len(raw))
    values = (LOWER[raw].astype(np.uint64) + np.uint64(1)) * power
    values[~word] = 0
    sums = np.add.reduceat(values, starts) * inverse[starts]
    return mix64(sums), np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(words: np.ndarray, docs: np.ndarray, n_docs: int,
                   n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles and each one's document; a document with fewer than
    ``n`` words (but at least one) gives its whole sequence as one."""
    out_h, out_d = [], []
    if len(words) >= n:
        ok = docs[n - 1:] == docs[:len(docs) - n + 1]
        h = np.zeros(len(ok), np.uint64)
        for i in range(n):
            h = mix64(h + words[i:len(words) - n + 1 + i] + np.uint64(i + 1))
        out_h.append(h[ok])
        out_d.append(docs[:len(ok)][ok])
    counts = np.bincount(docs, minlength=n_docs) if len(docs) else np.zeros(n_docs, np.int64)
    ends = np.cumsum(counts)
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        h = np.zeros(1, np.uint64)
        for w in words[ends[d] - counts[d]:ends[d]]:
            h = mix64(h + w + np.uint64(counts[d]) * np.uint64(1 << 40))
        out_h.append(h)
        out_d.append(np.array([d]))
    if not out_h:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    if len(out_h) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d
