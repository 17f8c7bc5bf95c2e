"""Approximate nearest neighbours by balanced posting lists.

Vectors gain one coordinate, ``sqrt(M**2 - |x|**2)`` with ``M`` the largest norm, so that the
largest inner product with a query is the smallest distance. Centroids (k-means over a bounded
sample; their number grows with the table) head posting lists. A vector goes to its nearest
list and, as a boundary vector, to further lists whose centroid is within ``1 + CLOSURE`` times that
distance. Lists above a bounded length are cut into pieces, each a task of its own. A
query finds its nearest centroids by best-first search in an in-memory neighbour graph and probes
those within a ratio of the nearest distance, and always a least number of lists and enough rows to fill its
answer. Pieces answer with their best rows; scores are inner products of the original vectors in
double precision, the same for a pair in every list.

The index is fitted on ``FIT_ROWS`` vectors; every vector is indexed. How far a query looks is measured, not
assumed: the pass that counts the lists also finds the true neighbours of ``TRIED`` queries by brute force, and
``Index.fit_reach`` takes the cheapest ratio, least number of lists and number of boundary lists with which
these queries find ``RECALL`` of them. On rows without structure that is every list, each vector in one of them.
Where queries probe many lists, lists stand together on shelves and a query meets all rows of its lists' shelves.

Defined cases: null ids, null or zero vectors, vectors with null or non-finite components and
vectors of different lengths are never each other's candidates; ties go to the
smaller id; rows that repeat an id are one candidate per distinct score; with fewer candidates
than asked for all are returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from ._common import register, staged
from ._vectors import lists, matrix, sample, usable

#: Vectors that the centroids are fitted on; vectors per list aimed at; most centroids.
FIT_ROWS, LIST_ROWS, MAX_CENTROIDS = 20_000, 256, 8192
#: Lists that a vector may join, and how much farther than its nearest one they may be.
REPLICAS, CLOSURE = 8, 0.10
#: Queries answered by brute force to fit the reach, the share of their neighbours that must be found.
TRIED, RECALL = 200, 0.98
#: How much farther than the nearest centroid a probed list may be: ratios tried, lists a vector may join: numbers tried.
PRUNES, JOINED = (0.0, 0.02, 0.05, 0.09, 0.15, 0.25, 0.5, 1.0), (1, 2, 4, REPLICAS)
#: Scored rows that cost as much as moving one, and as one piece's answer to a query.
MOVE, ANSWER = 64, 4000
#: Lists that one task may hold together: numbers tried.
SHELVES = (1, 4, 16)
#: Rows of a piece of a list, and queries that meet it in one task.
PIECE_ROWS, QUERY_ROWS = 4096, 2048
#: Neighbours of a centroid in the graph.
DEGREE = 24


def _sq_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x ** 2).sum(1)[:, None] + (c ** 2).sum(1) - 2 * x @ c.T, 0)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means; empty clusters keep their centre."""
    x = x.astype(np.float32)
    c = x[np.random.default_rng(0).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([_sq_distances(x[a:a + 2048], c).argmin(1) for a in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(c))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return np.unique(c, axis=0).astype(np.float64)


class Index:
    """Centroids, their neighbour graph and the lists' lengths."""

    def __init__(self, centroids: np.ndarray, top_norm: float):
        self.centroids, self.top_norm = centroids, top_norm
        k = min(DEGREE, len(centroids) - 1)
        self.near = np.zeros((len(centroids), max(k, 0)), np.int64)
        for a in range(0, len(centroids), 1024):
            d = _sq_distances(centroids[a:a + 1024], centroids)
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            if k > 0:
                self.near[a:a + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
        # a ring keeps the graph connected
        ring = (np.arange(len(centroids)) + 1) % len(centroids)
        self.near = np.concatenate([self.near, ring[:, None]], 1)
        self.sizes = np.zeros(len(centroids), np.int64)
        # the reach: ratio of distances, least number of lists, lists that a vector is in
        self.prune, self.least, self.joined = 0.09, 1, REPLICAS
        # lists along one direction; neighbours there share a shelf
        off = centroids - centroids.mean(axis=0)
        along = off @ off[(off ** 2).sum(axis=1).argmax()]
        self.line = np.argsort(np.argsort(along, kind="stable"), kind="stable")
        self.shelf = self.line.copy()

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top_norm ** 2 - (x ** 2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Lists of each row in a column each: the nearest and close ones, nearest first, then -1."""
        dist = np.sqrt(_sq_distances(self.augmented(x), self.centroids))
        r = min(REPLICAS, dist.shape[1])
        part = np.argpartition(dist, r - 1, axis=1)[:, :r]
        close = np.take_along_axis(dist, part, 1)
        order = np.argsort(close, axis=1, kind="stable")
        part, close = np.take_along_axis(part, order, 1), np.take_along_axis(close, order, 1)
        return np.where(close <= close[:, :1] * (1 + CLOSURE), part, -1)

    def fit_reach(self, counts: np.ndarray, queries: np.ndarray, of: np.ndarray, lists: np.ndarray, asked: int, k: int) -> None:
        """Set the sizes and the cheapest reach that finds ``RECALL`` of known neighbours.

        ``counts``: postings by list and column of ``homes``; row ``i`` of ``lists`` are the homes of a neighbour of
        query ``of[i]``; ``asked`` queries will look for ``k`` rows."""
        found = counts.cumsum(axis=1)
        self.sizes = found[:, self.joined - 1]
        if not len(of):
            return
        dist = np.stack([self._distance(self._target(q), slice(None)) for q in queries])
        order = np.argsort(dist, axis=1, kind="stable")
        at = np.empty_like(order)
        np.put_along_axis(at, order, np.arange(order.shape[1])[None, :], 1)
        near = np.sort(dist, axis=1)
        far, best = order.shape[1], None
        for joined in JOINED:
            known = lists[:, :joined]
            place = np.where(known >= 0, at[of[:, None], known], far).min(axis=1)
            sizes = found[:, joined - 1]
            filled = (np.cumsum(sizes[order], axis=1) < 4 * joined * k).sum(axis=1) + 1
            for prune in PRUNES:
                inside = np.maximum((near <= near[:, :1] * (1 + prune)).sum(axis=1), filled)
                missed = np.sort(np.where(place < inside[of], 0, place + 1))
                least = max(1, int(missed[int(np.ceil(RECALL * len(missed))) - 1]))
                probed = at < np.minimum(np.maximum(inside, least), far)[:, None]
                for width in SHELVES:
                    shelf = self.line // width
                    held = np.bincount(shelf, sizes)
                    met = np.zeros((len(probed), len(held)), bool)
                    i, c = np.nonzero(probed)
                    met[i, shelf[c]] = True
                    cost = asked * ((met @ held).mean() + ANSWER * (met @ np.ceil(held / PIECE_ROWS)).mean()) + MOVE * float(sizes.sum())
                    if best is None or cost < best[0]:
                        best = cost, prune, least, joined, shelf
        _, self.prune, self.least, self.joined, self.shelf = best
        self.sizes = found[:, self.joined - 1]
        # the graph search may miss lists that the full order has: widen until it finds as much
        while self.least < far:
            probed = np.zeros(at.shape, bool)
            for i, q in enumerate(queries):
                probed[i, self.probes(q, k)] = True
            known = lists[:, :self.joined]
            if ((known >= 0) & probed[of[:, None], known]).any(axis=1).mean() >= RECALL:
                break
            self.least = min(far, self.least * 2)

    def _target(self, query: np.ndarray) -> np.ndarray:
        # the scale of a query changes no order
        return np.concatenate([query * (self.top_norm / np.linalg.norm(query)), [0.0]])

    def _distance(self, q: np.ndarray, nodes: np.ndarray | slice) -> np.ndarray:
        return np.sqrt(((self.centroids[nodes] - q) ** 2).sum(1))

    def probes(self, query: np.ndarray, wanted: int) -> list[int]:
        """Lists of one query by best-first search over the graph."""
        q, floor = self._target(query), wanted * 4 * self.joined

        def distance(nodes: np.ndarray | slice) -> np.ndarray:
            return self._distance(q, nodes)

        def enough(d: float, best: float, lists: int, rows: int) -> bool:
            return d > best * (1 + self.prune) and lists >= self.least and rows >= floor
        if self.least * 4 >= len(self.centroids):  # most lists: all distances at once
            dist = distance(slice(None))
            order = np.argsort(dist, kind="stable")
            before = np.concatenate([[0], np.cumsum(self.sizes[order])[:-1]])
            ends = (dist[order] > dist.min() * (1 + self.prune)) & (np.arange(len(order)) >= self.least) & (before >= floor)
            return order[:int(ends.argmax()) if ends.any() else len(order)].tolist()
        start = np.linspace(0, len(self.centroids) - 1, min(8, len(self.centroids))).astype(np.int64)
        seen = np.zeros(len(self.centroids), bool)
        seen[start] = True
        heap = [(d, int(c)) for d, c in zip(distance(start), start)]
        heapq.heapify(heap)
        taken: list[tuple[float, int]] = []
        best, rows, beyond = np.inf, 0, 0
        while heap:
            d, c = heapq.heappop(heap)
            best = min(best, d)
            if enough(d, best, len(taken), rows):
                beyond += 1
                if beyond > DEGREE:  # the frontier stays outside
                    break
            taken.append((d, c))
            rows += int(self.sizes[c])
            new = self.near[c][~seen[self.near[c]]]
            new = np.unique(new)
            seen[new] = True
            for dd, cc in zip(distance(new), new):
                heapq.heappush(heap, (dd, int(cc)))
        taken.sort()
        out, rows = [], 0
        for d, c in taken:
            if enough(d, best, len(out), rows):
                break
            out.append(c)
            rows += int(self.sizes[c])
        return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def different(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One position of each pair of score and id, best first, ties by id."""
    order = np.lexsort((ids, -scores))
    s, i = scores[order], ids[order]
    return order[np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])])] if len(order) else order


def best_rows(ids: np.ndarray, x: np.ndarray, qid: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and scores of each query's ``k`` best rows, which are different pairs of id and score."""
    places = np.arange(len(ids))
    _, first, times = np.unique(ids, return_index=True, return_counts=True)
    if len(first) < len(ids):  # a row that comes twice is one
        places = np.array(sorted({(int(i), r.tobytes()): at for at, (i, r) in enumerate(zip(ids, x))}.values()))
        ids, x = ids[places], x[places]
        times = np.unique(ids, return_counts=True)[1]
    most = k * int(times.max(initial=1))  # rows among which are k different ids
    for a in range(0, len(q), 256):
        rough = q[a:a + 256] @ x.T
        for i in range(len(rough)):
            other = np.flatnonzero(ids != qid[a + i])
            r = rough[i, other]
            if len(r) > most:  # all that may be among the best, whatever the rounding of the product
                cut = np.partition(r, len(r) - most)[len(r) - most]
                other = other[r >= cut - 1e-9 * max(1.0, abs(cut))]
            s = (x[other] * q[a + i]).sum(axis=1)
            if most > k:
                once = different(s, ids[other])
                other, s = other[once], s[once]
            top = best_of(s, ids[other], k)
            yield places[other[top]], s[top]


def answer_piece(postings: pa.Table, queries: pa.Table, k: int, d: int) -> pa.Table:
    """Best rows of one piece for each query that probes it."""
    out_q, out_i, out_s = [], [], []
    if postings.num_rows and queries.num_rows:
        ids, x = postings.column("vec_id").to_numpy(), matrix(postings.column("x"), d)
        qid, q = queries.column("query_id").to_numpy(), matrix(queries.column("q"), d)
        for name, (at, s) in zip(qid, best_rows(ids, x, qid, q, k)):
            out_q.append(name)
            out_i.append(ids[at])
            out_s.append(s)
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "ids": pa.array(out_i, pa.list_(pa.int64())),
                     "scores": pa.array(out_s, pa.list_(pa.float64()))})


def build_index(rows: DataFrame, total: int, d: int) -> Index:
    """Fit the centroids on a bounded sample and set up their graph."""
    top = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0]
    x = sample(rows, total, FIT_ROWS, 3, d)
    if not len(x):
        x = matrix(rows.limit(1).toArrow().column("x"), d)
    index = Index(np.zeros((1, d + 1)), float(np.sqrt(top)) * (1 + 1e-12))
    k = max(1, min(MAX_CENTROIDS, -(-total // LIST_ROWS), len(x)))
    return Index(fit_centroids(index.augmented(x), k), index.top_norm)


def _some(queries: DataFrame, total: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about ``TRIED`` queries, picked by a hash of their ids."""
    draw = (F.xxhash64("vec_id", F.lit(7)).cast("double") + 2.0 ** 63) / 2.0 ** 64
    table = queries.where(draw < min(1.0, TRIED / max(1, total))).limit(2 * TRIED).toArrow()
    if not table.num_rows and total:
        table = queries.limit(1).toArrow()
    return table.column("vec_id").to_numpy(), matrix(table.column("x"), d) if table.num_rows else np.empty((0, d))


def fit_reach(index: Index, shared: Broadcast, rows: DataFrame, tried: tuple[np.ndarray, np.ndarray], asked: int, k: int,
              d: int) -> None:
    """One pass over all rows counts the lists and finds the tried queries' true neighbours; ``index`` gets its reach."""
    qid, q = tried
    given = rows.sparkSession.sparkContext.broadcast(tried)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (qid, q) = shared.value, given.value
        counts = np.zeros((len(index.centroids), REPLICAS), np.int64)
        none = np.empty(0, np.int64), np.empty(0), np.empty((0, REPLICAS), np.int64)
        best = [none] * len(qid)
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), d)
                homes = index.homes(x)
                homes = np.pad(homes, ((0, 0), (0, REPLICAS - homes.shape[1])), constant_values=-1)
                i, col = np.nonzero(homes >= 0)
                np.add.at(counts, (homes[i, col], col), 1)
                for n, (at, s) in enumerate(best_rows(ids, x, qid, q, k)):
                    if len(best[n][1]) == k and (not len(s) or s[0] < best[n][1][-1]):
                        continue
                    i, s, h = (np.concatenate(p) for p in zip(best[n], (ids[at], s, homes[at])))
                    once = different(s, i)[:k]
                    best[n] = i[once], s[once], h[once]
        c, col = np.nonzero(counts)
        yield pa.RecordBatch.from_pylist(
            [{"list": a, "col": b, "n": n} for a, b, n in zip(c.tolist(), col.tolist(), counts[c, col].tolist())]
            + [{"query": n, "score": s, "vec_id": i, "homes": h} for n, b in enumerate(best)
               for i, s, h in zip(*(v.tolist() for v in b))], pa.schema([
                   (c, pa.int64()) for c in ("list", "col", "n", "query", "vec_id")] + [
                   ("score", pa.float64()), ("homes", pa.list_(pa.int64()))]))
    seen = staged(rows.mapInArrow(survey, "list long, col long, n long, query long, vec_id long, score double, homes array<long>"))
    counts = np.zeros((len(index.centroids), REPLICAS), np.int64)
    for r in seen.where("list IS NOT NULL").groupBy("list", "col").agg(F.sum("n").alias("n")).collect():
        counts[r["list"], r["col"]] = r["n"]
    entry = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i"), "homes")
    near = (seen.where("query IS NOT NULL").groupBy("query", "score", "vec_id").agg(F.min("homes").alias("homes"))
            .groupBy("query").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("near")).collect())
    of = np.array([r["query"] for r in near for _ in r["near"]], np.int64)
    known = np.array([e["homes"] for r in near for e in r["near"]], np.int64).reshape(-1, REPLICAS)
    index.fit_reach(counts, q, of, known, asked, k + 1)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors`` that satisfies ``is_query`` (a
    condition on ``vec_id``) its ``k`` best other rows of its length found."""
    rows, lengths = usable(vectors, id_col, vec_col)
    parts = [_of_length(rows.where(F.size("x") == d), d, is_query, k) for d in lengths]
    none = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts) if parts else none


def _of_length(rows: DataFrame, d: int, is_query: Column, k: int) -> DataFrame:
    """``search`` among the vectors of one length."""
    spark = rows.sparkSession
    total = rows.count()
    index = build_index(rows, total, d)
    first = spark.sparkContext.broadcast(index)
    queries = rows.where(is_query).distinct()
    asked_rows = queries.count()
    tried = _some(queries, asked_rows, d)
    fit_reach(index, first, rows, tried, asked_rows, k, d)
    pieces = np.maximum(1, -(-np.bincount(index.shelf, index.sizes).astype(np.int64) // PIECE_ROWS))
    searched = spark.sparkContext.broadcast((index, pieces))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = searched.value[0]
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                x = matrix(batch.column(1), d)
                homes = index.homes(x)[:, :index.joined]
                i, col = np.nonzero(homes >= 0)
                i, c = np.unique(np.stack([i, index.shelf[homes[i, col]]]), axis=1)
                for b in range(0, len(i), 1 << 14):
                    s = slice(b, b + (1 << 14))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[s]), pa.array(batch.column(0).to_numpy()[i[s]]), lists(x[i[s]])],
                        names=["shelf", "vec_id", "x"])
    postings = rows.mapInArrow(post, "shelf long, vec_id long, x array<double>")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, pieces = searched.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                q = matrix(batch.column(1), d)
                at = [(i, c, p) for i in range(len(q)) for c in np.unique(index.shelf[index.probes(q[i], k + 1)]) for p in range(pieces[c])]
                i, c, p = np.array(at, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c), pa.array(p), pa.array(batch.column(0).to_numpy()[i]), lists(q[i])],
                    names=["shelf", "piece", "query_id", "q"])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = staged(queries.repartition(tasks).mapInArrow(probe, "shelf long, piece long, query_id long, q array<double>"))
    # queries of a piece in blocks; the piece's rows go to every block of its shelf
    blocks = {r["shelf"]: -(-r["n"] // QUERY_ROWS) for r in asked.where("piece = 0").groupBy("shelf").agg(F.count("*").alias("n")).collect()}
    per_shelf = spark.createDataFrame([(int(c), int(pieces[c]), int(n)) for c, n in blocks.items()],
                                     "shelf long, pieces long, blocks long")
    per_shelf = F.broadcast(per_shelf)  # at most MAX_CENTROIDS rows
    left = (postings.join(per_shelf, "shelf")
            .select("shelf", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).alias("piece"),
                    F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "x"))
    right = (asked.join(per_shelf, "shelf")
             .select("shelf", "piece", F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), "query_id", "q"))
    found = (left.groupBy("shelf", "piece", "block").cogroup(right.groupBy("shelf", "piece", "block"))
             .applyInArrow(lambda p, q: answer_piece(p, q, k, d), "query_id long, ids array<long>, scores array<double>"))
    pair = F.arrays_zip((F.transform("scores", lambda s: -s)).alias("s"), F.col("ids").alias("i"))
    best = (found.groupBy("query_id")
            .agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pair)))), 1, k).alias("best")))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.i").alias("vec_id"),
        (-F.col("b.s")).alias("score"))


@register("op1_nearest_neighbours")
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding by inner product."""
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
