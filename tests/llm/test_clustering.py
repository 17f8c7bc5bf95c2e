"""Centroid clustering against plain Lloyd rounds in Python integers, and what the bounds save."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediashelf.llm import ns_clustering as ns


def brute(rows, k, rounds, dims, scale=64, seed="1"):
    """``(id, cluster, distance)`` of every usable row, and the centroids."""
    kept = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows
            if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    c = [x for _, x in starts]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    return [(i, *reversed(nearest(x))) for i, x in kept] if c else [], c


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "n") for i, x in rows], "vec_id long, embedding array<double>, cluster string")


def got(found):
    return sorted(tuple(r) for r in found.rows.select("vec_id", "cluster", "distance").collect())


def mixture(n, dims, centres, seed):
    rng = random.Random(seed)
    mid = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [rng.gauss(m, 0.2) for m in mid[rng.randrange(centres)]]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_rounds(spark, seed):
    rows = mixture(600, 5, 7, seed)
    found = ns.cluster(frame(spark, rows).repartition(5), k=7, rounds=6, dims=5)
    want, c = brute(rows, 7, 6, 5)
    assert got(found) == sorted(want) and found.centroids.tolist() == c and found.n == len(want)


def test_bounds_spare_distances_and_never_miss(spark):
    rows = mixture(3000, 8, 10, 3)
    found = ns.cluster(frame(spark, rows).repartition(3), k=10, rounds=10, dims=8)
    want, _ = brute(rows, 10, 10, 8)
    assert got(found) == sorted(want)
    assert found.evaluated[0] == 3000 * 10 and max(found.evaluated[1:]) < 3000 * 10
    assert found.evaluated[-1] < 3000 * 10 / 5


def test_total_displacement_is_tighter_than_summed_drifts():
    """A centroid that swings out and back loosens nothing."""
    there, back = np.array([[0, 0], [100, 0]]), np.array([[40, 0], [100, 0]])
    moved = ns.displacements([there, back, there])
    assert moved[0].tolist() == [0, 0] and moved[1].tolist() == [40, 0]
    x = np.array([[30, 0]])
    bounds, _ = ns.first_bounds(x, there)
    _, evaluated = ns.next_bounds(x, there, moved, bounds)
    assert evaluated == 0  # summed drifts (80) would have opened the lower bound


def test_large_components_stay_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-(1 << 26), 1 << 26, (50, 6))
    c = rng.integers(-(1 << 26), 1 << 26, (4, 6))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert ns.squared(x, c).tolist() == want and ns.squared(x // 4096, c // 4096).tolist() == [
        [sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c // 4096] for p in x // 4096]
    bounds, _ = ns.first_bounds(x, c)
    d = c + rng.integers(-(1 << 24), 1 << 24, c.shape)
    after, _ = ns.next_bounds(x, d, ns.displacements([c, d]), bounds)
    assert after.cluster.tolist() == ns.squared(x, d).argmin(1).tolist()


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []),
            (7, [1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (9, [-2.0, 1.0]), (None, [5.0, 5.0]),
            (None, [5.0, 5.0]), (10, [0.25, 0.25])]  # ties between equal starts too
    for k in (1, 3, 16):
        found = ns.cluster(frame(spark, rows), k=k, rounds=3, dims=2)
        want, c = brute(rows, k, 3, 2)
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted((tuple(r) for r in found.rows.collect()), key=key) == sorted(want, key=key)
        assert found.centroids.tolist() == c
    with pytest.raises(Exception, match="too large"):
        ns.cluster(frame(spark, [(1, [1e300, 0.0])]), dims=2).rows.collect()


def test_empty_table(spark):
    found = ns.cluster(frame(spark, []), dims=2)
    assert ns.report(found).collect() == [] and found.evaluated == []
    assert ns.report(found).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_one_cluster_holds_most_rows(spark):
    rows = [(i, [0.1, 0.1]) for i in range(400)] + [(400 + i, [float(i), -3.0]) for i in range(20)]
    found = ns.cluster(frame(spark, rows).repartition(6), k=4, rounds=4, dims=2)
    assert got(found) == sorted(brute(rows, 4, 4, 2)[0])
    total = ns.report(found).agg(F.sum("distance"), F.max("inertia")).first()
    assert total[0] == total[1]


def test_tables_of_rounds_are_deleted(spark):
    import glob
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/llm-*"))
    ns.cluster(frame(spark, mixture(50, 2, 3, 1)), k=3, rounds=4, dims=2).rows.collect()
    assert len(set(glob.glob(f"{folder}/llm-*")) - before) == 1  # the result
