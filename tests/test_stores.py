"""Id sequences, copy-on-write buckets, the frontier walk, prefix joins of many lengths, counters of running jobs and
the detector hook."""

import datetime as dt
import os
import random
import re
import threading

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediashelf.operators import analysis as A
from mediashelf.operators import migrate as M
from mediashelf.operators import prefix_join as PJ
from mediashelf.operators import registry as R
from mediashelf.operators import scan as SC
from mediashelf.operators import sync as S
from mediashelf.operators import upsert as U
from mediashelf.schemas import SCHEMAS
from mediashelf.sources import catalogue as cat
from mediashelf.sources import folders
from mediashelf.sources import listing as L
from mediashelf.sources.bucket_table import BucketTable
from mediashelf.sources.sequences import Sequence

from .conftest import SF_SMALL

AS_OF = "2024-01-01 00:00:00"
FILE_KEYS = ["device_uuid", "path"]


# ---------------------------------------------------------------- sequences

def test_sequence_ranges_never_overlap(spark, tmpdir_path):
    taken, lock = [], threading.Lock()

    def writer(k):
        ids = Sequence(spark, f"{tmpdir_path}/seq")  # each writer its own object, as in another process
        for n in (1, 5, k + 1):
            start = ids.take(n)
            with lock:
                taken.append((start + 1, start + n))
    threads = [threading.Thread(target=writer, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    taken.sort()
    assert all(a[1] < b[0] for a, b in zip(taken, taken[1:])) and taken[0][0] == 1
    ids = Sequence(spark, f"{tmpdir_path}/seq")
    assert ids.last() == taken[-1][1]
    assert ids.take(0, 5) == ids.last() and ids.take(2, 1000) == 1000 and ids.last() == 1002


def test_sequence_of_a_lost_writer(spark, tmpdir_path):
    ids = Sequence(spark, f"{tmpdir_path}/seq", patience=0.2)
    ids.take(3)
    assert folders.claim(spark, f"{tmpdir_path}/seq/after-3")
    with pytest.raises(RuntimeError, match="after-3"):
        ids.take(1)


def test_ids_are_not_read_from_the_table_once_a_sequence_runs(spark, tmpdir_path, monkeypatch):
    files = cat.files(spark, SF_SMALL)
    ids = Sequence(spark, f"{tmpdir_path}/seq")
    new = spark.createDataFrame([("d", "a", "s"), ("d", "b", "s")], "device_uuid string, path string, system_id string")
    keys = ["device_uuid", "path", "system_id"]
    first = U.upsert(files, new, keys, as_of=AS_OF, sequence=ids)
    mark = U.max_id(files)
    assert sorted(r["id"] for r in first.table.where("device_uuid = 'd'").collect()) == [mark + 1, mark + 2]
    assert first.high_water == mark + 2 == ids.last()
    # the rows go, the next ones get new ids although the table no longer shows the old
    again = U.upsert(files, new.withColumn("path", F.concat("path", F.lit("x"))), keys, as_of=AS_OF, sequence=ids).table
    assert sorted(r["id"] for r in again.where("device_uuid = 'd'").collect()) == [mark + 3, mark + 4]


def test_deleted_ids_stay_away_with_floors_and_sequences(spark, tmpdir_path):
    """The row with the largest id is deleted before each insert."""
    progress = spark.createDataFrame([], SCHEMAS["scan_progress"])
    files = spark.createDataFrame([], SCHEMAS["files"])
    analyses = spark.createDataFrame([], SCHEMAS["image_analysis"])
    counts = spark.createDataFrame([("d", "s", 1, 1)], "device_uuid string, system_id string, total_files long, new_files long")
    pictures = spark.createDataFrame([(1, False)], "file_id long, has_faces boolean")
    legacy = spark.createDataFrame([("d", "p", "h", 1, None, None)], "device_uuid string, path string, hash string, size long, "
                                   "modified_time timestamp_ntz, scanned_time timestamp_ntz")
    totals = counts.drop("system_id").withColumn("last_updated", U.ts_lit(AS_OF))
    rows = spark.createDataFrame(
        [(1,)], "file_id long").select("file_id", *[F.lit(None).cast(t).alias(c) for c, t in analyses.dtypes if c not in ("id", "file_id")])
    changes = {
        "K5": lambda **i: R.store_progress(progress, counts, AS_OF, **i),
        "K6": lambda **i: R.store_progress(progress, counts, AS_OF, "device", **i),
        "K7": lambda **i: A.store_image_analyses(analyses, pictures, AS_OF, **i),
        "K10": lambda **i: M.migrate_files(files, legacy, AS_OF, **i),
        "K11": lambda **i: M.migrate_scan_progress(progress, totals, AS_OF, **i),
        "K12": lambda **i: M.append_image_analysis(analyses, rows, AS_OF, **i)}
    for name, change in changes.items():
        res = change(id_floor=7)
        assert [r["id"] for r in res.table.collect()] == [8] and res.high_water == 8, name
        ids = Sequence(spark, f"{tmpdir_path}/{name}")
        for want in (1, 2):  # the table is empty each time: all its rows were deleted
            assert [r["id"] for r in change(sequence=ids).table.collect()] == [want], name


def test_last_report_counts_for_a_device(spark):
    progress = spark.createDataFrame([(1, "d", 9, 9, None, "x", None)], SCHEMAS["scan_progress"])
    seen = spark.createDataFrame([("d", "b", 1, 1, 1), ("d", "a", 2, 2, 2), ("e", "b", 3, 3, 2), ("e", "a", 4, 4, 1)],
                                 "device_uuid string, system_id string, total_files long, new_files long, seq int")
    got = {(r["device_uuid"], r["system_id"]): r["total_files"] for r in
           R.upsert_progress(progress, seen, AS_OF, "device", "seq").collect()}
    assert got == {("d", "x"): 2, ("e", "b"): 3}


# ---------------------------------------------------------------- buckets

def files_frame(spark, rows):
    return spark.createDataFrame([(i, d, p, h, i, None, None, None, "s", None) for i, d, p, h in rows], SCHEMAS["files"])


def contents(table):
    return sorted((r["id"], r["device_uuid"], r["path"], r["hash"]) for r in table.read().collect())


def data_files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/data")
            for f in fs if f.endswith(".parquet")}


def batch_of(spark, rows):
    return spark.createDataFrame([(*r, "s") for r in rows], "device_uuid string, path string, hash string, system_id string")


KEY = ["device_uuid", "path", "system_id"]


def test_untouched_buckets_are_neither_read_nor_written(spark, tmpdir_path):
    rows = [(i, "hot" if i % 3 == 0 else f"d{i % 7}", f"p{i}", "h") for i in range(1, 400)]
    table = BucketTable.create(files_frame(spark, rows), f"{tmpdir_path}/t", FILE_KEYS, 32)
    hot = {r[0] for r in table.read().where("device_uuid = 'hot'").select(table.bucket()).distinct().collect()}
    assert len(hot) > 25  # one device lies in nearly all buckets
    before = data_files(table.path)
    batch = batch_of(spark, [("hot", "p3", "new"), ("d1", "p1", "new"), ("d9", "q", "new")])
    touched = table.touched(batch)
    read = table.read(only=touched).inputFiles()
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in read} <= set(touched)
    ids = Sequence(spark, f"{tmpdir_path}/ids")
    ids.take(0, 399)
    res = table.upsert(batch, KEY, ["hash"], as_of=AS_OF, sequence=ids)
    after = data_files(table.path)
    assert {f: t for f, t in after.items() if f in before} == before  # written once, never again
    fresh = {int(re.search(r"bucket=(\d+)", f)[1]) for f in after if f not in before}
    assert fresh == set(touched) and len(touched) <= 3
    want = sorted([(i, d, p, "new" if p in ("p1", "p3") else h) for i, d, p, h in rows] + [(400, "d9", "q", "new")])
    assert contents(table) == want and res.high_water == 400
    assert sorted((r["path"], r["action"]) for r in res.changes.collect()) == [("p1", "update"), ("p3", "update"), ("q", "insert")]
    # the version before is still whole for its readers, until vacuum
    assert table.read(0).count() == 399
    table.vacuum()
    assert contents(table) == want and table.layout() == BucketTable(spark, table.path, table.schema, FILE_KEYS, 32).layout()
    assert len(data_files(table.path)) == len(table.layout())


def test_deleted_rows_and_empty_buckets_stay_deleted(spark, tmpdir_path):
    table = BucketTable.create(files_frame(spark, [(1, "d", "a", "h"), (2, "d", "b", "h")]), f"{tmpdir_path}/t", FILE_KEYS, 64)
    table.delete(spark.createDataFrame([("d", "a"), ("d", "nothing")], "device_uuid string, path string"))
    assert contents(table) == [(2, "d", "b", "h")]
    table.vacuum()
    assert contents(table) == [(2, "d", "b", "h")] and len(data_files(table.path)) == 1
    table.delete(table.read().select("device_uuid", "path"))
    table.vacuum()
    assert contents(table) == [] and table.read(only=[5]).count() == 0
    empty = spark.createDataFrame([], "device_uuid string, path string, hash string, system_id string")
    version = table.version()
    assert table.upsert(empty, KEY, ["hash"], as_of=AS_OF, id_floor=2).changes.count() == 0 and table.version() == version
    with pytest.raises(ValueError, match="sequence"):
        table.upsert(batch_of(spark, [("d", "a", "h")]), KEY, ["hash"], as_of=AS_OF)
    with pytest.raises(ValueError, match="key"):
        table.upsert(batch_of(spark, [("d", "a", "h")]), ["device_uuid"], ["hash"], as_of=AS_OF, id_floor=2)


def test_a_failed_write_is_not_seen_and_is_repeated(spark, tmpdir_path, monkeypatch):
    table = BucketTable.create(files_frame(spark, [(1, "d", "a", "old")]), f"{tmpdir_path}/t", FILE_KEYS, 4)
    batch = batch_of(spark, [("d", "a", "new"), ("d", "b", "new")])

    def fail(*a):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "commit", fail)
        with pytest.raises(OSError):
            table.upsert(batch, KEY, ["hash"], as_of=AS_OF, id_floor=1)
    assert contents(table) == [(1, "d", "a", "old")] and table.version() == 0
    table.upsert(batch, KEY, ["hash"], as_of=AS_OF, id_floor=1)
    assert contents(table) == [(1, "d", "a", "new"), (2, "d", "b", "new")]


def test_groups_of_buckets_leave_nothing_but_the_table(spark, tmpdir_path, monkeypatch):
    """Buckets are rewritten group by group, ids run over all groups, and no copy of the change set stays behind."""
    from mediashelf.session import ensure_checkpoint_dir
    from mediashelf.sources import bucket_table
    monkeypatch.setattr(bucket_table, "TASK_ROWS", 1)
    tasks = spark.sparkContext.defaultParallelism
    table = BucketTable.create(files_frame(spark, [(i, "d", f"p{i:03}", "h") for i in range(1, 301)]), f"{tmpdir_path}/t",
                               FILE_KEYS, 4 * tasks)
    staged = set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))
    batch = batch_of(spark, [(None if i % 50 == 0 else "d", f"p{i:03}", f"new{i}") for i in range(201, 501)])
    writes = []
    write = BucketTable.write
    monkeypatch.setattr(BucketTable, "write", lambda self, rows, v, b, more=False: (writes.append((v, list(b))), write(self, rows, v, b, more)))
    res = table.upsert(batch, KEY, ["hash"], as_of=AS_OF, id_floor=300)
    assert len(writes) > 2 and sorted(b for _, g in writes for b in g) == list(range(4 * tasks))
    got = {(r["device_uuid"], r["path"]): (r["id"], r["hash"]) for r in table.read().collect()}
    fresh = [(None if i % 50 == 0 else "d", f"p{i:03}") for i in range(201, 501) if i > 300 or i % 50 == 0]
    fresh.sort(key=lambda k: (k[0] or "", k[1]))
    want = {("d", f"p{i:03}"): (i, f"new{i}" if 200 < i and i % 50 else "h") for i in range(1, 301)}
    want |= {k: (301 + n, f"new{int(k[1][1:])}") for n, k in enumerate(fresh)}
    assert got == want and res.high_water == 300 + len(fresh) and table.read().count() == len(want)
    assert res.changes.where("action = 'insert'").count() == len(fresh)
    writes.clear()
    table.delete(spark.createDataFrame([("d", f"p{i:03}") for i in range(2, 500, 2)], "device_uuid string, path string"))
    assert len(writes) > 2
    table.vacuum()
    left = {k for k in want if k[0] is None or int(k[1][1:]) % 2 or int(k[1][1:]) >= 500}
    assert {(r["device_uuid"], r["path"]) for r in table.read().collect()} == left
    assert set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:"))) == staged
    assert folders.names(spark, f"{table.path}/changes") == []


def test_buckets_follow_the_types_of_the_table(spark, tmpdir_path):
    """A key that arrives as another number type belongs into the same bucket."""
    table = BucketTable.create(spark.range(40).select("id", F.lit("a").alias("v")), f"{tmpdir_path}/t", ["id"], 8)
    table.upsert(spark.createDataFrame([(3, "b"), (50, "c")], "id int, v string"), ["id"], ["v"], id_col=None)
    table.delete(spark.createDataFrame([(7,)], "id int"))
    got = {r["id"]: r["v"] for r in table.read().collect()}
    assert got == {i: "b" if i == 3 else "a" for i in range(40) if i != 7} | {50: "c"}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("xyz"), st.booleans()), max_size=6), max_size=4))
def test_buckets_equal_a_plain_table(spark, batches):
    import tempfile
    folder = tempfile.mkdtemp(prefix="mediashelf-test-")
    table = BucketTable.create(spark.createDataFrame([], SCHEMAS["files"]), f"{folder}/t", FILE_KEYS, 5)
    ids, model = Sequence(spark, f"{folder}/ids"), {}
    ids.take(0, 10)
    for n, batch in enumerate(batches):
        keep = {k: (h, gone) for *k, gone in [(p, h, g) for p, h, g in batch] for k, h in [((k[0],), k[1])]}
        ups = sorted((k[0], h) for k, (h, gone) in keep.items() if not gone)
        dels = [(k[0],) for k, (h, gone) in keep.items() if gone]
        if ups:
            table.upsert(batch_of(spark, [("d", p, h) for p, h in ups]), KEY, ["hash"], as_of=AS_OF, sequence=ids)
        if dels:
            table.delete(spark.createDataFrame([("d", p) for p, in dels], "device_uuid string, path string"))
        model |= dict(ups)
        for p, in dels:
            model.pop(p, None)
        if n % 2:
            table.vacuum()
        got = table.read().select("path", "hash", "id").collect()
        assert {r["path"]: r["hash"] for r in got} == model and len({r["id"] for r in got}) == len(got)


# ---------------------------------------------------------------- listing

def deep_tree(root):
    """A lopsided tree: a long chain of folders beside a wide one."""
    path = root
    for i in range(30):
        path = os.path.join(path, f"n{i}")
        os.makedirs(path)
        open(os.path.join(path, "f.jpg"), "w").close()
    for i in range(40):
        os.makedirs(os.path.join(root, f"wide{i}", "leaf"))
        open(os.path.join(root, f"wide{i}", "leaf", "g.txt"), "w").close()
    return 1 + 30 + 80


@pytest.mark.parametrize("budget", [1, 3, 256])
def test_each_directory_is_opened_once(spark, tmpdir_path, budget):
    directories = deep_tree(tmpdir_path)
    found = L.walk(L.seeds_of(spark, [tmpdir_path]), extensions=[".jpg"], budget=budget)
    opened, passed = found.agg(F.sum("opened"), F.sum("passed")).first()
    assert opened == directories and passed == 40
    files = L.listed_files(found)
    assert sorted(r["path"] for r in files.collect()) == sorted(
        os.path.join(d, f) for d, _, fs in os.walk(tmpdir_path) for f in fs if f.endswith(".jpg"))
    # only stat runs when the result is used: the passes over directories are staged
    assert files._jdf.queryExecution().sparkPlan().toString().count("MapInPandas") == 1


def test_a_frontier_is_dealt_out_again(tmpdir_path):
    """What a task may not open comes back as the next frontier, nothing of it opened."""
    import pandas as pd
    directories = deep_tree(tmpdir_path)
    calls = []
    scandir = os.scandir

    def counting(path):
        calls.append(path)
        return scandir(path)
    run = L._lister((), None, True, 4)
    frontier, passes = [tmpdir_path], 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(os, "scandir", counting)
        while frontier:
            passes += 1
            out = pd.concat(list(run(iter([pd.DataFrame({"root": tmpdir_path, "path": frontier})]))))
            frontier = out[out["is_dir"]]["path"].tolist()
    assert len(calls) == len(set(calls)) == directories and 5 < passes < 15


def test_scan_counts_names_it_passes_over(spark, tmpdir_path):
    deep_tree(tmpdir_path)
    devices = spark.createDataFrame([(tmpdir_path, "dev")], "root string, device_uuid string")
    progress = spark.createDataFrame([], SCHEMAS["scan_progress"])
    files = spark.createDataFrame([], SCHEMAS["files"])
    done = SC.scan_devices(files, progress, devices, "me", AS_OF, extensions=[".jpg"], skip_dirs=[])
    got = done.stats.first()
    assert (got["total_files"], got["processed_files"], got["skipped_files"], got["error_files"]) == (30, 30, 40, 0)
    assert got["percent"] == 100.0 and got["files_per_sec"] > 0
    table = L.listing_of(L.walk_files(L.seeds_of(spark, [tmpdir_path])).drop("root"), tmpdir_path)
    listed = SC.scan_devices(files, progress, devices, "me", AS_OF, extensions=[".jpg"], skip_dirs=[], listing=table)
    again = listed.stats.first()
    assert all(again[c] == got[c] for c in SC.COUNTERS)
    assert listed.files.count() == done.files.count() == 30


def test_binary_files_are_those_of_spark_and_not_listed_by_the_driver(spark, tmpdir_path):
    root = f"{tmpdir_path}/tree"
    for name in ("a.txt", "b/c.TXT", "b/.hidden", "b/_under", "_skip/d", "_k=1/e", ".dot/f", "x y/é%20.md", "g._COPYING_",
                 "_metadata", "b/empty", "deep/1/2/3/h"):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(b"" if name.endswith("empty") else name.encode() * 3)
    for i in range(200):
        with open(f"{root}/b/n{i}", "wb") as f:
            f.write(b"x" * i)
    os.makedirs(f"{tmpdir_path}/far")
    open(f"{tmpdir_path}/far/z", "w").close()
    os.symlink(f"{tmpdir_path}/far", f"{root}/link")
    os.symlink(f"{tmpdir_path}/nothing", f"{root}/broken")
    os.symlink(f"{root}/a.txt", f"{root}/again")

    def rows(df):
        return sorted((r["path"], r["size"], r["modified_time"], bytes(r["content"])) for r in df.collect())
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    for at in (root, f"{tmpdir_path}/tr*", f"file:{root}/b", f"{root}/a.txt", f"{root}/*"):
        want = source.load(at).select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("size"),
                                      L._utc("modificationTime").alias("modified_time"), "content")
        got = L.binary_files(spark, at, with_content=True)
        assert rows(got) == rows(want) and got.dtypes == want.dtypes, at
        assert L.binary_files(spark, at).collect() and L.binary_files(spark, at).columns == ["path", "size", "modified_time"]
    assert len(L.binary_files(spark, root, with_content=True).inputFiles()) < 100  # tables of paths, not the files
    os.makedirs(f"{tmpdir_path}/none")
    assert L.binary_files(spark, f"{tmpdir_path}/none", with_content=True).collect() == []


def test_contents_leave_a_task_in_bounded_batches(tmpdir_path, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(L, "CHUNK_BYTES", 10)
    paths = []
    for i, n in enumerate([4, 4, 4, 30, 1, 0, 9]):
        paths.append(f"{tmpdir_path}/f{i}")
        with open(paths[-1], "wb") as f:
            f.write(b"x" * n)
    given = pa.RecordBatch.from_arrays([pa.array(paths)], names=["path"])
    out = list(L._content_reader(True)(iter([given])))
    assert [[len(c) for c in b.column(3).to_pylist()] for b in out] == [[4, 4], [4], [30], [1, 9]]
    assert [b.num_rows for b in L._content_reader(False)(iter([given]))] == [6]


# ---------------------------------------------------------------- prefix join

def norm(p):
    p = re.sub("/+", "/", p)
    return p if p == "/" else p.rstrip("/")


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_mounts_of_many_lengths(spark, threshold):
    rng = random.Random(7)
    mounts = sorted({"/" + "".join(rng.choice("ab/é") for _ in range(rng.randint(0, 14))) for _ in range(120)})
    paths = ["/" + "".join(rng.choice("ab/é") for _ in range(rng.randint(0, 16))) for _ in range(600)] + ["/ab/a"] * 300
    assert len({len(m) for m in mounts}) > PJ.MAX_LENGTHS
    mdf = spark.createDataFrame([(m, f"u{i}") for i, m in enumerate(mounts)] + [("", "never")], "mount_path string, uuid string")
    pdf = spark.createDataFrame([*enumerate(paths), (-1, None)], "id long, path string").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = PJ.longest_prefix_mount(pdf, mdf)
        got = {r["id"]: (r["mount_path"], r["device_uuid"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.columns == ["id", "path", "mount_path", "device_uuid", "device_label"] and len(got) == len(paths) + 1
    assert got[-1] == (None, None)
    for i, p in enumerate(paths):
        best = max((m for m in mounts if norm(p).startswith(m)), key=len, default=None)
        assert got[i] == (best, f"u{mounts.index(best)}" if best else None), p


def test_plan_does_not_grow_with_the_lengths(spark):
    paths = spark.range(100).select("id", F.concat(F.lit("/" + "m" * 300 + "/"), F.col("id").cast("string")).alias("path"))
    sizes = []
    for n in (20, 250):
        mounts = spark.createDataFrame([("/" + "m" * i, f"u{i}") for i in range(n)], "mount_path string, uuid string")
        out = PJ.longest_prefix_mount(paths, mounts)
        sizes.append(out._jdf.queryExecution().sparkPlan().toString().count("\n"))
        assert out.where(F.length("mount_path") == n).count() == 100
    assert sizes[0] == sizes[1]


def test_chains_are_never_broadcast(spark):
    """Only the row per partition goes through the driver, however small the chains' files are."""
    paths = spark.range(50).select("id", F.concat(F.lit("/" + "m" * 30 + "/"), F.col("id").cast("string")).alias("path"))
    mounts = spark.createDataFrame([("/" + "m" * i, f"u{i}") for i in range(20)], "mount_path string, uuid string")
    out = PJ.longest_prefix_mount(paths, mounts)
    assert {r["mount_path"] for r in out.collect()} == {"/" + "m" * 19}
    assert out._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 1
    chains = PJ.mount_chains(mounts.withColumnsRenamed({"mount_path": "_mount", "uuid": "_uuid"}))
    assert "BroadcastHashJoin" not in chains._jdf.queryExecution().sparkPlan().toString()


# ---------------------------------------------------------------- sync in one pass

def test_a_round_reads_each_table_once(spark):
    tables = [cat.devices(spark, SF_SMALL), cat.files(spark, SF_SMALL), cat.scan_progress(spark, SF_SMALL),
              cat.image_analysis_full(spark, SF_SMALL)]

    def scans(df):
        return len(re.findall(r"FileScan", df._jdf.queryExecution().sparkPlan().toString()))
    rnd = S.sync_all(*tables, "sys-1", "1996-01-01 00:00:00")
    assert scans(rnd.changes) == 4 and scans(rnd.files) == 1  # staged marks
    marked = S.mark_files(tables[1], "sys-1", "1996-01-01 00:00:00")
    assert scans(marked) == scans(tables[1])
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_null_keys_are_nobodys(spark):
    t0 = dt.datetime(2020, 1, 1)
    files = spark.createDataFrame(
        [(i, d, p, "h", 1, None, None, None, s, t0) for i, d, p, s in
         [(1, None, "a", "x"), (2, None, "a", "me"), (3, "d", None, "x"), (4, "d", "a", "x"), (5, "d", "a", "me")]], SCHEMAS["files"])
    present = spark.createDataFrame([("d", None), (None, "a"), ("q", "q")], "device_uuid string, path string")
    got = {r["id"]: (r["_op"], r["system_id"]) for r in S.mark_files(files, "me", AS_OF, present).collect()}
    assert got == {1: (None, "x"), 2: (None, "me"), 3: (None, "x"), 4: ("delete", "x"), 5: ("delete", "me")}
    got = {r["id"]: (r["_op"], r["system_id"]) for r in S.mark_files(files, "me", AS_OF).collect()}
    assert got[4] == ("delete", "me") and got[5] == ("update", "me") and got[1] == (None, "x")


# ---------------------------------------------------------------- counters, detector

def test_counters_come_from_the_job_that_writes(spark, tmpdir_path):
    batch = cat.file_batch(spark, SF_SMALL)
    wanted = SC.should_scan_file("path", [".jpg", ".png"])
    rows, seen = SC.observe_scan(batch, wanted, "one-job")
    rows.write.parquet(f"{tmpdir_path}/rows")
    got, want = SC.observed_stats(spark, seen, 2.0).first(), SC.scan_stats(batch, wanted, 2.0).first()
    assert got.asDict() == want.asDict()


def test_detector_batches_and_errors(spark):
    sizes = []

    def model(files):
        import pandas as pd
        n = files["content"].map(len)
        if (n == 7).any():
            raise KeyError("seven")
        return pd.DataFrame({"file_id": files["file_id"], "label": f"batch of {len(files)}", "confidence": n / 10.0})
    rows = [(i, bytearray(b"x" * n)) for i, n in enumerate([4, 4, 4, 7, 30, 2, 2, 0])] + [(100, None), (None, bytearray(b"y"))]
    files = spark.createDataFrame(rows, "file_id long, content binary").coalesce(1)
    got = {r["file_id"]: (r["label"], r["error"]) for r in A.detect_files(files, model, batch_bytes=12).collect()}
    assert got[0] == got[1] == got[2] == ("batch of 3", None)
    assert got[3] == (None, "KeyError: 'seven'") and got[4] == ("batch of 1", None)
    assert got[100] == (None, "no content") and got[7][1] is None and got[None][1] is None
    assert A.detect(files, model).count() == 8 and sizes == []
    none = A.detect_files(files.limit(0), model)
    assert none.collect() == [] and none.columns == ["file_id", "label", "confidence", "error"]


def test_a_failed_batch_is_tried_in_pieces(spark, tmpdir_path):
    """One file that cannot be read costs its piece's files a call each, not the whole batch's."""
    calls = f"{tmpdir_path}/calls"

    def model(files):
        import pandas as pd
        with open(calls, "a") as f:
            f.write(f"{len(files)}\n")
        if (files["file_id"] == 70).any():
            raise KeyError("seventy")
        return pd.DataFrame({"file_id": files["file_id"], "label": "x", "confidence": 1.0})
    files = spark.createDataFrame([(i, bytearray(b"x")) for i in range(100)], "file_id long, content binary").coalesce(1)
    got = {r["file_id"]: (r["label"], r["error"]) for r in A.detect_files(files, model).collect()}
    assert got == {i: ("x", None) if i != 70 else (None, "KeyError: 'seventy'") for i in range(100)}
    with open(calls) as f:
        assert sorted(int(n) for n in f) == [1] * 8 + [4] + [8] * 12 + [100]
