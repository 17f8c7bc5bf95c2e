"""Embedding near-duplicates by an exact metric range join.

Vectors are normalised, where a cosine of at least ``c`` is a Euclidean distance of at most
``eps = sqrt(2 - 2c)``. Equal vectors are one class. A bounded set of pivots cuts the space into
Voronoi cells: a vector is at home in the cell of its nearest pivot and visits every other
cell in which a partner can live. By the triangle inequality that is a cell whose bisector
lies within ``eps`` and whose radius (largest distance of a member from its pivot) plus
``eps`` reaches the vector. Each vector then finds all its partners among the home members of the
cells it is in, every pair from either side exactly once, and cells are joined independently. Large
cells are cut into blocks of bounded size, home members against all present, so a dense cell spreads over
many tasks. Blocks send counts and spanning links, never all pairs.

Cosines are taken in single precision first; whatever lies near the threshold is decided in double
precision.

Defined cases: null ids, null or zero vectors and vectors with null or non-finite components
link with nothing; vectors of different lengths do not link with each other; equal vectors link with each
other; rows that repeat an id count as separate vectors; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from ._common import connected_components, register, roots, staged
from ._vectors import lists, matrix, sample, usable

#: Home members of a cell that one block holds, and vectors it is compared with.
BLOCK_ROWS = 8192
#: Vectors per pivot aimed at, and the most pivots (they are broadcast).
CELL_ROWS, MAX_PIVOTS = 8192, 4096
_SUB = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def present_cells(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray | None, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector and the matrix of cells it is present in."""
    dist = _distances(x, pivots)
    home = dist.argmin(axis=1)
    if radius is None:
        return home, dist
    near = dist[np.arange(len(x)), home]
    between = np.maximum(_distances(pivots, pivots)[home], 1e-12)
    here = (dist ** 2 - near[:, None] ** 2) / (2 * between) <= eps
    here &= dist <= radius + eps
    here[np.arange(len(x)), home] = True
    return home, here


def join_block(table: pa.Table, cosine: float, d: int) -> pa.Table:
    """One block: weighted partner counts of the vectors and links that span their components.

    Output rows: ``(vec_id, other, count)`` with a count (other null) or a link (count null)."""
    home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
    ids, weight = table.column("vec_id").to_numpy(), table.column("size").to_numpy().astype(np.float64)
    x = _unit(matrix(table.column("x"), d))
    ya, xa = np.flatnonzero(home), np.flatnonzero(~home)
    yi, xi, wy, yd, xd = ids[ya], ids[xa], weight[ya], x[ya], x[xa]
    y32 = yd.astype(np.float32)
    slack = max(1e-5, d * 2.4e-7)
    count = np.zeros(len(xa))
    names = np.unique(np.concatenate([yi, xi]))
    yn, xn = np.searchsorted(names, yi), np.searchsorted(names, xi)
    la, lb = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(xa), _SUB):
        sims = xd[at:at + _SUB].astype(np.float32) @ y32.T
        i, j = np.nonzero(sims >= cosine - slack)
        i += at
        unsure = np.flatnonzero(sims[i - at, j] < cosine + slack)
        if len(unsure):
            u, v = xd[i[unsure]], yd[j[unsure]]
            exact = np.einsum("ij,ij->i", u, v)
            keep = np.ones(len(i), bool)
            keep[unsure] = exact >= cosine
            i, j = i[keep], j[keep]
        other = xi[i] != yi[j]
        i, j = i[other], j[other]
        count += np.bincount(i, wy[j], minlength=len(xa))
        if len(i):  # links of this strip, reduced to spanning ones
            a, b = xn[i], yn[j]
            used, k = np.unique(np.concatenate([a, b]), return_inverse=True)
            r = roots(k[:len(a)], k[len(a):], len(used))
            far = r != np.arange(len(used))
            la.append(used[far])
            lb.append(used[r[far]])
    a, b = np.concatenate(la), np.concatenate(lb)
    if len(a):
        r = roots(a, b, len(names))
        a = np.flatnonzero(r != np.arange(len(names)))
        b = r[a]
    some = count > 0
    return pa.table({
        "vec_id": np.concatenate([xi[some], names[a]]),
        "other": pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(names[b])]),
        "count": pa.concat_arrays([pa.array(count[some].astype(np.int64)), pa.nulls(len(a), pa.int64())])})


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``."""
    rows, lengths = usable(vectors, id_col, vec_col)
    parts = [_of_length(rows.where(F.size("x") == d), d, cosine) for d in lengths or [1]]
    x = F.col(vec_col).cast("array<double>")
    left = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(x).alias("h1"), F.xxhash64(x, F.lit(1)).alias("h2")))
    out = left.join(reduce(DataFrame.unionByName, parts), ["vec_id", "h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def _of_length(rows: DataFrame, d: int, cosine: float) -> DataFrame:
    """``(vec_id, h1, h2, n_links, component_id)`` of the vectors of one length."""
    spark = rows.sparkSession
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    rows = rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64("x", F.lit(1))})
    classes = staged(rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
                     .withColumn("node", F.monotonically_increasing_id()))
    # from here on to the labels a class goes by its node: two classes may have the same smallest id
    reps = staged(rows.join(classes, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["node"])
                  .select(F.col("node").alias("vec_id"), "size", "x"))
    total = reps.count()
    pivots = sample(reps, total, min(MAX_PIVOTS, -(-total // CELL_ROWS)) * 2, 5, d)
    pivots = np.unique(_unit(pivots), axis=0) if len(pivots) else pivots
    if not len(pivots) and total:
        pivots = _unit(matrix(reps.limit(1).toArrow().column("x"), d))
    pivots = pivots[:max(1, min(MAX_PIVOTS, -(-total // CELL_ROWS)))]
    shared = spark.sparkContext.broadcast(pivots)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, dist = present_cells(_unit(matrix(batch.column(0), d)), shared.value, None, eps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home, pa.int64()), pa.array(dist[np.arange(len(home)), home])], names=["cell", "dist"])
    cells = (reps.select("x").mapInArrow(homes, "cell long, dist double").groupBy("cell")
             .agg(F.max("dist").alias("r"), F.count("*").alias("n")).collect()) if total else []
    radius, members = np.full(len(pivots), -10.0), np.zeros(len(pivots), np.int64)
    for c in cells:
        radius[c["cell"]], members[c["cell"]] = c["r"] + 1e-9, c["n"]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(pivots), np.int64)
        for batch in batches:
            seen += present_cells(_unit(matrix(batch.column(0), d)), shared.value, radius, eps)[1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["cell", "n"])
    present = np.zeros(len(pivots), np.int64)
    if total:
        for c in reps.select("x").mapInArrow(visits, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            present[c["cell"]] = c["n"]
    y_blocks, x_blocks = (np.maximum(1, -(-n // BLOCK_ROWS)) for n in (members, present))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _SUB):
                batch = whole.slice(start, _SUB)
                ids, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                raw = matrix(batch.column(2), d)
                home, here = present_cells(_unit(raw), shared.value, radius, eps)
                spread = (ids * 2654435761) >> 7
                out = []  # row, cell, block of home members, block of the present, role
                for c in np.flatnonzero(here.any(axis=0)):
                    i = np.flatnonzero(here[:, c])
                    for k in range(y_blocks[c]):
                        out.append(np.stack([i, np.full(len(i), c), np.full(len(i), k), spread[i] % x_blocks[c], np.zeros(len(i), np.int64)]))
                    i = i[home[i] == c]
                    for k in range(x_blocks[c]):
                        out.append(np.stack([i, np.full(len(i), c), spread[i] % y_blocks[c], np.full(len(i), k), np.ones(len(i), np.int64)]))
                r, c, y, x, role = np.concatenate(out, 1)
                for a in range(0, len(r), 1 << 14):
                    s = slice(a, a + (1 << 14))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[s]), pa.array(y[s]), pa.array(x[s]), pa.array(role[s] == 1), pa.array(ids[r[s]]),
                         pa.array(size[r[s]]), lists(raw[r[s]])],
                        names=["cell", "y", "xb", "home", "vec_id", "size", "x"])
    found = staged(
        reps.mapInArrow(dealt, "cell long, y long, xb long, home boolean, vec_id long, size long, x array<double>")
        .groupBy("cell", "y", "xb").applyInArrow(
            lambda t: join_block(t, cosine, d), "vec_id long, other long, count long"))
    links = found.where("count IS NOT NULL").groupBy("vec_id").agg(F.sum("count").alias("count"))
    labels = connected_components(found.where("other IS NOT NULL").select(
        F.col("vec_id").alias("a"), F.col("other").alias("b")))
    least = (labels.join(classes.select("node", "rep"), "node").groupBy("component")
             .agg(F.min("rep").alias("component_id")))
    labels = labels.join(least, "component").select("node", "component_id")
    by_class = (classes.join(links.withColumnRenamed("vec_id", "node"), "node", "left").join(labels, "node", "left")
                .select("h1", "h2", (F.coalesce("count", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                        F.coalesce("component_id", "rep").alias("component_id")))
    return rows.select("vec_id", "h1", "h2").distinct().join(by_class, ["h1", "h2"])


SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l
           FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT * FROM v WHERE l > 0 AND isfinite(l)),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
      WHERE list_dot_product(a.x, b.x) / (a.l * b.l) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings),
w AS (WITH RECURSIVE t(a, c) AS (SELECT a, c FROM r UNION SELECT p.a, t.c FROM t JOIN p ON p.b = t.a) SELECT a, min(c) AS c FROM t GROUP BY a)
SELECT e.vec_id, CAST((SELECT count(*) FROM p WHERE p.a = e.vec_id) AS BIGINT) AS n_links,
       w.c AS component_id, e.vec_id = w.c AS kept
FROM embeddings e JOIN w ON w.a = e.vec_id
"""


@register("op10_embedding_near_dedup", SQL)
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings at a cosine of 0.9."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.9)
