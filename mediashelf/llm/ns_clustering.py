"""Centroid clustering (Lloyd rounds) with ns-bounds, exact in integers.

Vectors are turned into integers, so distances, sums and centroids are exact and the result does not
depend on the order of rows or tasks. A vector keeps an upper bound on the distance to its own
centroid and a lower bound for every other one, each with the round in which it was evaluated. The
driver keeps the centroids of all rounds. In a later round a bound is loosened by the norm of its
centroid's *total* displacement since that round, which is at most the sum of the drifts of the rounds
between and often much less (a centroid that swings back costs nothing). A vector whose
loosened bounds still part its own centroid from all others is not looked at; for the rest, the
distances to the own centroid and to those whose bound fails are evaluated exactly.

Each round is one pass over a staged table that holds the vectors with their bounds: tasks write the
new bounds and, as further rows, the sums of their vectors by cluster, so ``k * dims`` numbers a task
are summed and no vector is shuffled, however large a cluster is. Tasks are sent the current
centroids and one table of displacements (``rounds * k`` numbers); a round's table is deleted
when the next one stands.

Defined cases: vectors that are null, of another length than ``dims`` or with a null or non-finite
component are left out; the zero vector takes part; a null id takes part but starts no centroid; rows that repeat an
id are clustered each (starts: equal ids in the order of their vectors); with fewer vectors than
``k`` there are fewer centroids; an empty table gives an empty result; an integer component of
``LIMIT`` or more raises, since distances would no longer fit a long; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from ._common import StagedTables, register

#: Integer components are below this in size.
LIMIT = 1 << 27
#: Numbers that one numpy step holds.
STEP = 1 << 20
_STATE = ("vec_id long, x array<int>, cluster int, upper double, seen int, lower array<float>, at array<smallint>, "
          "sums array<long>, members long, evaluated long")
#: Bounds are compared with this much slack for their rounding.
_SLACK = 1e-6


class Clustering(NamedTuple):
    rows: DataFrame  #: ``(vec_id, cluster, distance)``
    centroids: np.ndarray
    evaluated: list[int]  #: distances evaluated in each assignment
    n: int


class Bounds(NamedTuple):
    """Of a batch: own centroid, its upper bound and that bound's round, lower bounds and their rounds."""

    cluster: np.ndarray
    upper: np.ndarray
    seen: np.ndarray
    lower: np.ndarray
    at: np.ndarray


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, x)`` of the vectors that take part, ``x`` as ``floor(scale * component)``."""
    x = F.col(vec_col).cast("array<double>")
    fine = (F.size(vec_col) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v * scale) < LIMIT - 1, F.floor(v * scale)).otherwise(
        F.raise_error(F.lit("a component is too large for exact distances"))).cast("int"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all of ``c``."""
    size = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * int(size) ** 2 < 1 << 53:  # every sum is an integer that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def paired(x: np.ndarray, i: np.ndarray, c: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of the pairs ``x[i], c[j]``."""
    step = max(1, STEP // max(1, x.shape[1]))
    parts = [((x[i[a:a + step]] - c[j[a:a + step]]) ** 2).sum(1) for a in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """Distance of each centroid's present place from its place in every round, ``(rounds, k)``."""
    return np.sqrt(np.array([((history[-1] - c) ** 2).sum(1) for c in history], dtype=np.float64))


def _down(root: np.ndarray) -> np.ndarray:
    """Lower bounds are kept in single precision, rounded down."""
    return np.maximum(np.nextafter(root.astype(np.float32), np.float32(-1)), np.float32(0))


def first_bounds(x: np.ndarray, c: np.ndarray) -> tuple[Bounds, int]:
    """All distances, in round 0."""
    d2 = squared(x, c)
    cluster = d2.argmin(1)
    root = np.sqrt(d2.astype(np.float64))
    zero = np.zeros(len(x), np.int32)
    return Bounds(cluster, root[np.arange(len(x)), cluster], zero, _down(root), np.zeros(d2.shape, np.int16)), d2.size


def next_bounds(x: np.ndarray, c: np.ndarray, moved: np.ndarray, old: Bounds) -> tuple[Bounds, int]:
    """Bounds in the round that ``moved`` (``displacements``) leads to, and the distances evaluated."""
    now = len(moved) - 1
    n, k = old.lower.shape
    cluster, upper, seen, lower, at = (np.array(v) for v in old)
    loose = lower.astype(np.float64) - moved[at, np.arange(k)[None]]
    loose[np.arange(n), cluster] = np.inf
    bound = upper + moved[seen, cluster]
    slack = _SLACK * (1 + bound)
    f = np.flatnonzero(loose.min(1) <= bound + slack)
    own = paired(x, f, c, cluster[f])
    upper[f], seen[f] = np.sqrt(own.astype(np.float64)), now
    i, j = np.nonzero(loose[f] <= (upper[f] + slack[f])[:, None])
    d2 = paired(x, f[i], c, j)
    lower[f[i], j], at[f[i], j] = _down(np.sqrt(d2.astype(np.float64))), now
    best = np.full((len(f), k), np.iinfo(np.int64).max)
    best[i, j] = d2
    best[np.arange(len(f)), cluster[f]] = own
    to = best.argmin(1)  # ties: the smaller number
    left = np.flatnonzero(to != cluster[f])
    lower[f[left], cluster[f[left]]], at[f[left], cluster[f[left]]] = _down(np.sqrt(own[left].astype(np.float64))), now
    upper[f] = np.sqrt(best[np.arange(len(f)), to].astype(np.float64))
    cluster[f] = to
    return Bounds(cluster, upper, seen, lower, at), len(f) + len(i)


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(m.reshape(-1), kind))


def _bounds_of(batch: pa.RecordBatch, k: int) -> Bounds:
    return Bounds(batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), batch.column("seen").to_numpy(),
                  _matrix(batch.column("lower"), k, np.float32), _matrix(batch.column("at"), k, np.int16))


def _assign(batches: Iterator[pa.RecordBatch], c: np.ndarray, moved: np.ndarray,
            dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Bounds, int]]:
    """Each slice of rows with its vectors, new bounds and the distances evaluated."""
    step = max(1, STEP // (len(c) + dims))
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            x = _matrix(batch.column("x"), dims, np.int64)
            made = first_bounds(x, c) if "cluster" not in batch.schema.names else next_bounds(
                x, c, moved, _bounds_of(batch, len(c)))
            yield batch, x, *made


def _round(c: np.ndarray, moved: np.ndarray, dims: int):
    """Task of a round: rows with new bounds, then the task's sums by cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()),
            ("seen", pa.int32()), ("lower", pa.list_(pa.float32())), ("at", pa.list_(pa.int16())),
            ("sums", pa.list_(pa.int64())), ("members", pa.int64()), ("evaluated", pa.int64())])
        sums, members, evaluated = np.zeros((len(c), dims), np.int64), np.zeros(len(c), np.int64), 0
        for batch, x, b, seen in _assign(batches, c, moved, dims):
            order = np.argsort(b.cluster, kind="stable")
            some, first = np.unique(b.cluster[order], return_index=True)
            sums[some] += np.add.reduceat(x[order], first, axis=0)
            members += np.bincount(b.cluster, minlength=len(c))
            evaluated += seen
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(b.cluster, pa.int32()), pa.array(b.upper),
                 pa.array(b.seen, pa.int32()), _lists(b.lower, pa.float32()), _lists(b.at, pa.int16()),
                 *(pa.nulls(n, schema.field(i).type) for i in (7, 8, 9))], schema=schema)
        some = np.flatnonzero(members)
        if len(some):
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, schema.field(i).type) for i in (0, 1)), pa.array(some, pa.int32()),
                 *(pa.nulls(n, schema.field(i).type) for i in (3, 4, 5, 6)), _lists(sums[some], pa.int64()),
                 pa.array(members[some]), pa.array([evaluated] + [0] * (n - 1), pa.int64())], schema=schema)
    return run


def _last(c: np.ndarray, moved: np.ndarray, dims: int):
    """Task of the last assignment: cluster and exact squared distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, b, seen in _assign(batches, c, moved, dims):
            d2 = paired(x, np.arange(len(x)), c, b.cluster)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(b.cluster, pa.int32()), pa.array(d2),
                 pa.array(np.full(len(x), 0) + (np.arange(len(x)) == 0) * seen, pa.int64())],
                names=["vec_id", "cluster", "distance", "evaluated"])
    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1",
            id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering:
    """Lloyd's rounds from the ``k`` vectors whose ``sha256("<seed>:<id>")`` is smallest; ties of
    distance go to the smaller centroid, an empty cluster keeps its centroid."""
    tables = StagedTables(vectors.sparkSession)
    rows = tables.write(integer_vectors(vectors, dims, scale, id_col, vec_col))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    starts = rows.where("vec_id IS NOT NULL").select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    if not starts:
        none = rows.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(none, np.empty((0, dims), np.int64), [], 0)
    history = [np.array([r["x"] for r in starts], np.int64)]
    state, evaluated = rows, []
    for t in range(rounds):
        task = _round(history[-1], displacements(history), dims)
        columns = ["vec_id", "x"] if t == 0 else ["vec_id", "x", "cluster", "upper", "seen", "lower", "at"]
        old = state
        state = tables.write(old.where("x IS NOT NULL").select(*columns).mapInArrow(task, _STATE))
        tables.drop(old)
        totals = state.where("sums IS NOT NULL").select("cluster", "members", "evaluated", F.posexplode("sums").alias("i", "s"))
        found = totals.groupBy("cluster", "i").agg(
            F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("members").alias("n"), F.sum("evaluated").alias("e")).collect()
        evaluated.append(sum(r["e"] for r in found if r["i"] == 0))
        c = history[-1].copy()
        for r in found:
            c[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
        history.append(c)
    columns = ["vec_id", "x"] if not rounds else ["vec_id", "x", "cluster", "upper", "seen", "lower", "at"]
    done = tables.write(state.where("x IS NOT NULL").select(*columns).mapInArrow(
        _last(history[-1], displacements(history), dims), "vec_id long, cluster int, distance long, evaluated long"))
    tables.drop(state)
    n, last = done.agg(F.count("*"), F.sum("evaluated")).first()
    return Clustering(done.select("vec_id", "cluster", "distance"), history[-1], [*evaluated, last or 0], n)


def report(found: Clustering) -> DataFrame:
    """Rows with their cluster's and the whole inertia and a digest of the final centroid."""
    spark = found.rows.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    table = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
             for i, c in enumerate(found.centroids)]
    by = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(by), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int) -> str:
    def assigned(t: int) -> str:
        return f"""a{t} AS MATERIALIZED (SELECT v.r, min(CAST(list_dot_product(v.f, v.f) + list_dot_product(c.f, c.f) - 2 * list_dot_product(v.f, c.f) AS BIGINT) * {k} + c.c) AS m
  FROM v CROSS JOIN c{t} c GROUP BY v.r)"""

    def moved(t: int) -> str:
        return f"""s{t} AS (SELECT m % {k} AS c, i, sum(x) AS s, count(*) AS n FROM a{t} JOIN
  (SELECT r, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v) USING (r) GROUP BY ALL),
n{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS f FROM s{t} GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.f, o.f) AS f FROM c{t} o LEFT JOIN n{t} n ON n.c = o.c)"""
    steps = ",\n".join(f"{assigned(t)},\n{moved(t)}" for t in range(rounds))
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
w AS (SELECT r, vec_id, list_transform(x, lambda a: CAST(floor(64 * a) AS BIGINT)) AS x FROM e
      WHERE len(x) = 64 AND list_bool_and(list_transform(x, lambda a: a IS NOT NULL AND isfinite(a)))),
v AS MATERIALIZED (SELECT r, vec_id, x, x::DOUBLE[] AS f FROM w),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, f FROM v WHERE vec_id IS NOT NULL
  ORDER BY sha256('1:' || vec_id), x LIMIT {k}),
{steps},
{assigned(rounds)}
SELECT v.vec_id, CAST(m % {k} AS INTEGER) AS cluster, m // {k} AS distance,
       CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia, CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.f::BIGINT[], ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = m % {k}
"""


@register("op11_centroid_clustering", _sql(16, 3))
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after 3 rounds."""
    return report(cluster(read_table(spark, sf_dir, "embeddings")))
