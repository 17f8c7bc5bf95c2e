"""Jaccard join and suffix deduplication against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mediashelf.llm import parity_join, suffix_dedup
from mediashelf.llm._common import connected_components, utf8


def _components(links, nodes):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


def _jaccard_model(rows, n, num):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = _components(links, [i for i in sets])
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def _near_copies(seed, n_groups, copies, words=(3, 120)):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, k = [], 0
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(*words))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(w))
                w[at:at + rng.randint(0, 1)] = [rng.choice(vocab)]
            rows.append((k, " ".join(w).replace("w1", "W1", rng.randint(0, 1))))
            k += 1
    return rows


@pytest.mark.parametrize("seed,n,num", [(1, 3, 90), (2, 5, 80), (3, 3, 60)])
def test_jaccard_components(spark, seed, n, num):
    rows = _near_copies(seed, 25, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in parity_join.jaccard_components(df, n=n, num=num).collect()}
    assert got == _jaccard_model(rows, n, num)


def test_jaccard_links_through_members_that_miss_the_hub(spark):
    """A drifting chain: each text is near the next one only, all in common buckets."""
    words = [f"v{i}" for i in range(100)]
    rows = []
    for k in range(12):
        rows.append((50 - k if k % 2 else k, " ".join(words)))
        words[7 * k % 100] = f"new{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in parity_join.jaccard_components(df, n=3, num=94).collect()}
    assert got == _jaccard_model(rows, 3, 94)


def test_jaccard_in_buckets_of_many_blocks(spark, monkeypatch):
    """Blocks of two members: seekers and members of every large bucket are dealt out over many tasks."""
    monkeypatch.setattr(parity_join, "BUCKET_ROWS", 2)
    words = [f"v{i}" for i in range(100)]
    rows = []
    for k in range(24):
        rows.append((50 - k if k % 2 else k, " ".join(words)))
        words[7 * k % 100] = f"new{k}"
    rows += [(100 + i, t) for i, (_, t) in enumerate(_near_copies(4, 6, 12))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in parity_join.jaccard_components(df, n=3, num=94).collect()}
    assert got == _jaccard_model(rows, 3, 94)


def test_jaccard_compares_finished_buckets_once(spark, monkeypatch):
    """Only buckets that have more candidates than they offered are dealt out again."""
    rng = random.Random(11)
    rows, words = [], [f"w{i}" for i in range(5000)]
    for k in range(60):  # small groups: texts with few words of a common one
        base = rng.choices(words, k=120)
        rows += [" ".join(base[:100 + rng.randint(0, 20)] + rng.choices(words, k=rng.randint(0, 30))) for _ in range(6)]
    base = rng.choices(words, k=200)
    for _ in range(90):  # one large group, whose members miss each other by little
        text = list(base)
        for i in rng.sample(range(len(text)), rng.choice([1, 2, 2, 3])):
            text[i] = rng.choice(words)
        rows.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    dealt, whole = [], parity_join.open_pairs

    def counted(members, *rest, **more):
        dealt.append(members.count())
        return whole(members, *rest, **more)
    monkeypatch.setattr(parity_join, "open_pairs", counted)
    monkeypatch.setattr(parity_join, "CLOSEST", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(docs, 3, 90).collect()}
    assert len(dealt) > 1 and max(dealt[1:]) < dealt[0]
    assert got == _jaccard_model(list(enumerate(rows)), 3, 90)


def test_task_keys_leave_before_the_task_has_read_all(monkeypatch):
    """The memory of a task does not follow the size of its part; keys met at two times are found."""
    monkeypatch.setattr(parity_join, "HELD_KEYS", 100, raising=False)
    text = " ".join(f"w{i}" for i in range(60))
    read = []

    def batches():
        for doc in range(8):
            read.append(doc)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "text": [text + f" x{doc} y{doc}"]})
    rows = parity_join.task_keys(batches(), 3, 90, 100, 1)
    first = next(rows)
    assert len(read) < 8
    out = pa.Table.from_batches(list(parity_join.shared_keys(iter([first, *rows]))))
    # as from one task for each document
    apart = [r for b in batches() for r in parity_join.task_keys(iter([b]), 3, 90, 100, 1)]
    one = pa.Table.from_batches(list(parity_join.shared_keys(iter(apart))))
    assert one.num_rows and set(zip(*out.to_pydict().values())) == set(zip(*one.to_pydict().values()))


def test_task_names_leave_before_the_task_has_read_all(monkeypatch):
    """The memory of a task does not follow the size of its part; names met at two times are shared."""
    monkeypatch.setattr(suffix_dedup, "HELD_NAMES", 20, raising=False)
    rng, read = random.Random(3), []
    line = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = [line + "".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(8)]

    def batches():
        for doc, text in enumerate(texts):
            read.append(doc)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "text": [text], "db": pa.array([doc], pa.int32())})
    rows = suffix_dedup.task_names(batches(), 50, 8, 1)
    first = next(rows)
    assert len(read) < 8
    shared = suffix_dedup.shared_names(pa.Table.from_batches([first, *rows]))
    runs = [set(suffix_dedup.window_names(*utf8(pa.array([t])), 50)[1].tolist()) for t in texts]
    for db, packed in zip(shared["db"].to_pylist(), shared["names"].to_pylist()):
        names = set(np.cumsum(suffix_dedup.unpack(packed)[0], dtype=np.uint64).tolist())
        assert names == {x for x in runs[db] if sum(x in r for r in runs) > 1}


def test_parts_hold_the_pigeonhole_bound():
    rng = np.random.default_rng(0)
    for num in (60, 80, 90):
        for n in (1, 2, 5, 9, 10, 11, 30, 200, 1000):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for _ in range(20):
                union, out_a, out_b = len(a), 0, 0
                out = rng.integers(0, n + 1)
                b = a
                for _ in range(int(out)):  # drop or add as long as the pair still links
                    c = np.delete(b, 0) if rng.random() < 0.5 and len(b) > 1 else np.append(b, rng.integers(0, 1 << 63, dtype=np.uint64))
                    both = len(np.intersect1d(a, c))
                    if 100 * both < num * (len(a) + len(c) - both):
                        break
                    b = np.unique(c)
                assert len(np.intersect1d(parity_join.part_keys(a, num, 100), parity_join.part_keys(b, num, 100)))


def test_jaccard_odd_rows(odd_docs):
    got = [tuple(r) for r in parity_join.jaccard_components(odd_docs).collect()]
    by = defaultdict(set)
    for i, n, c in got:
        by[i].add((n, c))
    assert len(got) == 10
    assert by[1] == {(2, 1)} and by[2] == {(0, 2)} and by[3] == {(0, 3)} and by[4] == {(0, 4)}
    assert by[5] == by[6] == {(5, 5)} and by[8] == {(1, 8)} and by[None] == {(2, None)}
    assert parity_join.jaccard_components(odd_docs.limit(0)).count() == 0


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    got = {r["node"]: r["component"] for r in
           connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _components(edges, {x for e in edges for x in e if e[0] != e[1]} | {x for e in edges for x in e})
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def _suffix_model(rows, width):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first.setdefault(b[p:p + width], i) < i:
                gone[p:p + width] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("seed,width", [(1, 50), (2, 50), (3, 20), (4, 16), (5, 70)])
def test_suffix_dedup(spark, seed, width):
    rng = random.Random(seed)
    chars = "ab" if seed == 3 else "abcdeéß😀 "
    passages = ["".join(rng.choice(chars) for _ in range(rng.randint(5, 150))) for _ in range(12)]
    rows = []
    for k in range(60):
        text = "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(
            rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 8)))
        rows.append((rng.choice([k, 1000 - k, -k]) if k else 0, text))
    rows = list(dict(rows).items())
    rows += [(5000 + k, rows[3][1]) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in suffix_dedup.suffix_dedup(df, width).collect()}
    assert got == _suffix_model(rows, width)


@pytest.mark.parametrize("seed,width", [(1, 50), (3, 20)])
def test_suffix_dedup_of_split_names(spark, seed, width):
    rng = random.Random(seed)
    line = "this very line stands in a third of all the documents --"
    rows = []
    for k in range(90):
        noise = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 90))) for _ in range(3)]
        rows.append((rng.choice([k, 1000 - k]), noise[0] + line + noise[1] + "-" * rng.choice([0, 20, 60, 90]) + noise[2] + "ab" * rng.choice([0, 40])))
    rows = list(dict(rows).items()) + [(5000 + k, rows[3][1]) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in suffix_dedup.suffix_dedup(df, width, hot_bytes=500).collect()}
    assert got == _suffix_model(rows, width)


def test_suffix_buckets_share_a_hot_name():
    """A line in all documents, with other bytes round it in each: no bucket gets most of the text."""
    rng = random.Random(5)
    line = "this very line stands in a third of all the documents --"
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) + line + "".join(rng.choice("abcdefgh ") for _ in range(60))
             for _ in range(30_000)]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts,
                     "db": pa.array([0] * len(texts), pa.int32())})
    names = pa.Table.from_batches(list(suffix_dedup.task_names(iter(docs.to_batches()), 50, 1, 1)))
    out = suffix_dedup.candidate_pieces(docs, suffix_dedup.shared_names(names), 50, 64)
    share = defaultdict(int)
    for k, p in zip(out["sb"].to_pylist(), out["pieces"].to_pylist()):
        if p is not None:
            share[k] += int(suffix_dedup.unpack(p)[0].sum())
    assert len(share) > 32 and max(share.values()) < 0.1 * sum(share.values())


@pytest.mark.parametrize("hot", [1 << 20, 100])
def test_suffix_spans_return_to_their_own_text(spark, hot):
    """Two texts with one id, of which one repeats an earlier document: the other stays whole."""
    rng = random.Random(7)
    first, other = ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(2))
    rows = [(1, first), (2, first[:120] + "xy"), (2, other), (2, other), (2, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(df, 50, hot_bytes=hot).collect())
    assert got == sorted([(1, 0, first.encode()), (2, 120, b"xy"), (2, 0, other.encode()), (2, 0, other.encode()),
                          (2, 0, b""), (2, 0, b"")])


def test_window_classes_follow_suffix_order():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 3, 200).astype(np.uint8)
    text = np.concatenate([np.append(base[a:a + rng.integers(20, 120)], rng.integers(0, 3, rng.integers(0, 30)))
                           for a in rng.integers(0, 100, 30)]).astype(np.uint8)
    for width in (16, 17, 29, 50, 64):
        at = np.arange(len(text) - width + 1)
        keys = [text[i:i + width].tobytes() for i in at]
        order = {k: i for i, k in enumerate(sorted(set(keys)))}
        cls = suffix_dedup.window_classes(text, at, width)
        assert (np.unique(cls, return_inverse=True)[1] == [order[k] for k in keys]).all()


def test_covers_are_difference_covers():
    for v, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_suffix_odd_rows(odd_docs):
    got = {}
    for r in suffix_dedup.suffix_dedup(odd_docs, 50).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[1]) == 2 and all(r["n_removed"] == 0 for r in got[1])
    assert got[2][0]["n_bytes"] == 0 and got[3][0]["kept"] == b"" and got[4][0]["n_removed"] == 0
    assert got[5][0]["n_removed"] == 0 and got[6][0]["n_removed"] == got[6][0]["n_bytes"] and got[6][0]["n_spans"] == 1
    assert got[None][0]["n_removed"] == 0 and got[7][0]["rest"]["size"] == "z"
    assert suffix_dedup.suffix_dedup(odd_docs.limit(0), 50).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(odd_docs, 8)


def test_whole_characters_stay_text(spark):
    a = "é" * 40 + "tail one"
    b = "xyé" + "é" * 33 + "ü tail"
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    for r in suffix_dedup.suffix_dedup(df, 51, whole_chars=True).collect():
        text = bytes(r["kept"]).decode()  # valid UTF-8
        if r["doc_id"] == 2:
            assert text.startswith("xy") and text.endswith("ü tail") and r["n_removed"] >= 51


@pytest.mark.parametrize("num", [60, 80, 90])
def test_open_buckets_lose_no_link(num):
    """Candidates of small and large buckets hold every link between components."""
    rng = np.random.default_rng(num)
    rows = []
    for key in range(12):
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(3, 300))).astype(np.uint64))
        for _ in range(int(rng.choice([2, 10, 63, 64, 65, 90]))):
            s = base[rng.random(len(base)) > 0.05 * rng.integers(0, 4)]
            s = np.unique(np.append(s, rng.integers(0, 1 << 63, int(rng.integers(1, 6))).astype(np.uint64)))
            rows.append((key, len(rows), int(rng.integers(0, 5)) + 1000 * key, s))
    table = pa.table({
        "key": [r[0] for r in rows], "node": [r[1] for r in rows], "c": [r[2] for r in rows], "side": [2] * len(rows),
        "n": [len(r[3]) for r in rows], "sketch": pa.array([parity_join.fine_sketch(
            r[3], parity_join.sketch_words(len(r[3]), num, 100)).tobytes() for r in rows], pa.binary())})
    out = parity_join.near_in_buckets(table, num, 100, 1000)
    got = set(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    links = {(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1:] if a[0] == b[0] and a[2] != b[2]
             and 100 * len(np.intersect1d(a[3], b[3])) >= num * len(np.union1d(a[3], b[3]))}
    assert links and not links - got
    # with one offer per member and component, the rest is announced
    few = parity_join.near_in_buckets(table, num, 100, 1)
    assert few.num_rows <= out.num_rows and few["more"][0].as_py()


def test_unlinked_buckets_offer_in_proportion_to_their_members():
    """A bucket of many components, all near each other, does not offer all its pairs at once, and says so."""
    rng = np.random.default_rng(4)
    rows = []
    for key, members in enumerate([60, 300]):
        base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        for _ in range(members):
            s = np.unique(np.append(base, rng.integers(0, 1 << 63, 4).astype(np.uint64)))
            rows.append((key, len(rows), len(s), parity_join.fine_sketch(s, parity_join.sketch_words(len(s), 80, 100)).tobytes()))
    table = pa.table({"key": [r[0] for r in rows], "node": [r[1] for r in rows], "c": [r[1] for r in rows],
                      "side": [2] * len(rows), "n": [r[2] for r in rows], "sketch": pa.array([r[3] for r in rows], pa.binary())})
    some = parity_join.near_in_buckets(table, 80, 100, 4)
    pairs = some.filter(some["a"].is_valid())
    assert 0 < pairs.num_rows <= 4 * len(rows)
    assert set(pairs["a"].to_pylist()) | set(pairs["b"].to_pylist()) == set(range(len(rows)))
    assert set(some.filter(some["more"])["key"].to_pylist()) == {0, 1}
    whole = parity_join.near_in_buckets(table, 80, 100, 300)
    assert whole.num_rows == 60 * 59 // 2 + 300 * 299 // 2 and not any(whole["more"].to_pylist())
