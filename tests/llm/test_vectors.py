"""Nearest neighbours and near-duplicates against brute force, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediashelf.llm import metric_join, posting_lists

SCHEMA = "vec_id long, embedding array<float>, label int, list int, x string"


def _rows(seed, n, d=16, copies=60):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 2, size=(n, 1))
    x[:copies] = x[0]
    x[copies:copies + 80] = x[copies] + 0.25 * rng.normal(size=(80, d))
    x = x.astype(np.float32)
    ids = rng.permutation(n) * 3
    rows = [(int(i), [float(v) for v in r], 1, 2, "clash") for i, r in zip(ids, x)]
    rows += [(9001, None, 1, 1, "n"), (9003, [0.0] * d, 1, 1, "z"), (9006, [float("nan")] * d, 1, 1, "q"),
             (9009, [1.0, None] + [1.0] * (d - 2), 1, 1, "p"), (9012, [1.0, 2.0], 1, 1, "short"), (9015, [], 1, 1, "e"),
             (None, [float(v) for v in x[0]], 1, 1, "i"), (9018, [float("inf")] * d, 1, 1, "f")]
    return rows, ids, x.astype(np.float64)


def test_search_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 40)
    monkeypatch.setattr(posting_lists, "PIECE_ROWS", 50)
    rows, ids, x = _rows(1, 1500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in posting_lists.search(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    at = {int(i): k for k, i in enumerate(ids)}
    assert set(got) == {i for i in at if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        assert [f[1:] for f in found] == [f[1:] for f in sorted(found, key=lambda f: (-f[2], f[1]))]
        s = (x * x[at[q]]).sum(axis=1)
        assert all(abs(s[at[v]] - score) < 1e-12 for _, v, score in found)
        s[at[q]] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)


def test_search_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.1]), (20, None)], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in posting_lists.search(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert posting_lists.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("seed,block", [(1, 8192), (2, 100)])
def test_near_duplicates(spark, monkeypatch, seed, block):
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(metric_join, "CELL_ROWS", 60)
    rows, ids, x = _rows(seed, 600)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = ids.copy()
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric_join.near_duplicates(df).collect()}
    assert got == {int(i): (int(link[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)} | {
        i: (0, i, i is not None or True) for i in (9001, 9003, 9006, 9009, 9012, 9015, 9018, None)}


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric_join.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in metric_join.near_duplicates(one).collect()] == [(3, 0, 3, True)]


def test_near_duplicates_of_one_id_with_two_vectors(spark):
    """Both vectors of id 1 are the smallest of their classes; each has its own partners."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.1]), (4, [0.0, 1.0, 0.05]),
            (5, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in metric_join.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True)]


def test_each_length_is_searched_and_joined_for_itself(spark):
    """No vector is left out because another length is more frequent."""
    rng = np.random.default_rng(4)
    rows = []
    for d, n in ((3, 40), (5, 40), (2, 4)):
        base = rng.normal(size=(n // 2, d))
        rows += [(len(rows) + i, x.tolist()) for i, x in enumerate(np.concatenate([base, base + 0.001 * rng.normal(size=base.shape)]))]
    rows += [(900, None), (901, [0.0, 0.0]), (902, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    good = {i: np.array(x) for i, x in rows if i < 900}
    links = {(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and
             good[a] @ good[b] >= 0.9 * np.linalg.norm(good[a]) * np.linalg.norm(good[b])}
    got = {r["vec_id"]: r for r in metric_join.near_duplicates(df, 0.9).collect()}
    assert set(got) == {i for i, _ in rows}
    assert all(got[i]["n_links"] == sum(a == i for a, _ in links) for i in got)
    assert all(len(good[i]) == len(good[got[i]["component_id"]]) for i in good)
    found = posting_lists.search(df, F.col("vec_id") % 5 == 0, 3).collect()
    want = {}
    for q in (i for i in good if i % 5 == 0):
        near = sorted((-float(good[q] @ good[c]), c) for c in good if c != q and len(good[c]) == len(good[q]))[:3]
        want |= {(q, k + 1): c for k, (_, c) in enumerate(near)}
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in found} == want


def _recall(got, ids, x, k=20):
    """Share of the distinct rows' true neighbours found, for queries ``{query: [vec_id]}``."""
    at = {int(i): n for n, i in enumerate(ids)}
    hits = 0
    for q, found in got.items():
        s = (x * x[at[q]]).sum(axis=1)
        s[at[q]] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -s))[:k]]) & set(found))
    return hits / k / len(got)


def _found(df, k=20):
    got = {}
    for r in posting_lists.search(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_search_of_rows_that_repeat(spark):
    """Rows that come four times fill no query's answer: each counts once."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 4
    got = _found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert len(got) == 45 and all(len(f) == len(set(f)) == 20 for f in got.values())
    assert _recall(got, np.arange(900), x) >= 0.95


@pytest.mark.parametrize("kind", ["few_long", "heavy"])
def test_search_recall_of_other_rows(spark, monkeypatch, kind):
    """The reach is fitted to the rows: unit vectors with a few long ones among them, norms of many sizes."""
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 100)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 24))
    if kind == "heavy":
        x *= np.exp(1.5 * rng.normal(size=(4000, 1)))
    else:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x[:20] *= 30
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = _found(df.repartition(4))
    assert len(got) == 200
    assert _recall(got, np.arange(4000), x) >= 0.95
