"""Scan of a real file tree (S1-S3, F2-F4, X18/X19, J6, U2) against a brute-force walk,
and streaming = batch for T7/T8."""

import datetime as dt
import hashlib
import os
import posixpath

import pytest
from pyspark.sql import functions as F

from mediashelf.functions import hashing as H
from mediashelf.operators import scan as SC
from mediashelf.sources import catalogue as cat
from mediashelf.sources import listing as L
from mediashelf.sources.catalogue import scan_events_from
from mediashelf.streaming import file_events as FE


def make_tree(root):
    files = {}
    for i in range(3):
        d = os.path.join(root, f"subdir_{i}")
        os.makedirs(d, exist_ok=True)
        p = os.path.join(d, f"test_file_{i}.jpg")
        files[p] = f"This is test file {i}".encode()
    extra = {os.path.join(root, ".hidden", "x.jpg"): b"h", os.path.join(root, "subdir_0", ".y.jpg"): b"y",
             os.path.join(root, "_under", "z.jpg"): b"zz", os.path.join(root, "doc.txt"): b"text",
             os.path.join(root, "big.mp4"): os.urandom(300_000)}
    files.update(extra)
    for p, data in files.items():
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)
    return files


def brute(root, exts):
    out = {}
    for dirpath, dirnames, filenames in os.walk(root):
        if posixpath.basename(dirpath).startswith("."):
            dirnames[:] = []
            continue
        for n in filenames:
            p = os.path.join(dirpath, n)
            if n.startswith(".") or posixpath.splitext(p.lower())[1] not in exts:
                continue
            with open(p, "rb") as fh:
                out[p] = (os.path.getsize(p), hashlib.sha256(fh.read()).hexdigest())
    return out


def test_walk_matches_brute_force(spark, tmpdir_path):
    make_tree(tmpdir_path)
    exts = [".jpg", ".mp4"]
    want = brute(tmpdir_path, exts)
    for depth in (1, 2, 256):
        walked = L.walk_files(L.seeds_of(spark, [tmpdir_path]), do_hash=True, budget=depth)
        filtered = walked.where(SC.should_scan_file("path", exts) & SC.dir_walked("path", "root"))
        early = L.walk_files(L.seeds_of(spark, [tmpdir_path]), do_hash=True, budget=depth, extensions=exts, hidden=False)
        for rows in (filtered, early):  # filtered afterwards, or by name before anything is opened
            got = {r["path"]: (r["size"], r["hash"]) for r in rows.collect()}
            assert got == want, depth
        assert os.path.join(tmpdir_path, "_under", "z.jpg") in got  # underscore names are kept


def test_walker_links_errors_and_pruned_root(spark, tmpdir_path):
    make_tree(tmpdir_path)
    os.symlink(os.path.join(tmpdir_path, "subdir_0"), os.path.join(tmpdir_path, "linkdir.jpg"))
    os.symlink(os.path.join(tmpdir_path, "doc.txt"), os.path.join(tmpdir_path, "link.txt"))
    os.symlink(os.path.join(tmpdir_path, "nothing"), os.path.join(tmpdir_path, "dangling.txt"))
    want = {os.path.join(d, f) for d, _, fs in os.walk(tmpdir_path) for f in fs}
    for depth in (1, 2, 256):
        rows = L.walk_files(L.seeds_of(spark, [tmpdir_path]), budget=depth).collect()
        assert {r["path"] for r in rows} == want
        assert [r["path"] for r in rows if r["error"]] == [os.path.join(tmpdir_path, "dangling.txt")]
        assert L.walk_files(L.seeds_of(spark, [tmpdir_path]), [tmpdir_path], budget=depth).count() == 0


def test_scan_devices_from_a_listing_table(spark, tmpdir_path):
    from mediashelf.schemas import SCHEMAS
    make_tree(tmpdir_path)
    devices = spark.createDataFrame([(tmpdir_path, "dev")], "root string, device_uuid string")
    empty = [spark.createDataFrame([], SCHEMAS[t]) for t in ("files", "scan_progress")]
    progress = spark.createDataFrame([], "device_uuid string, system_id string, id long, total_files long, "
                                         "new_files long, last_updated timestamp_ntz, last_sync timestamp_ntz")
    walked = SC.scan_devices(empty[0], progress, devices, "me", "2024-01-01 00:00:00")
    table = L.listing_of(L.walk_files(L.seeds_of(spark, [tmpdir_path]), do_hash=True).drop("root"), tmpdir_path)
    listed = SC.scan_devices(empty[0], progress, devices, "me", "2024-01-01 00:00:00", listing=table)
    cols = ["id", "device_uuid", "path", "size", "hash", "system_id"]
    a, b = (sorted(map(tuple, r.files.select(cols).collect())) for r in (walked, listed))
    assert a == b and len(a) == 5
    os.remove(os.path.join(tmpdir_path, "subdir_1", "test_file_1.jpg"))
    again = SC.scan_devices(walked.files, walked.progress, devices, "me", "2024-01-02 00:00:00")
    assert again.files.count() == 4
    assert [tuple(r) for r in again.counts.select("total_files", "new_files").collect()] == [(4, 0)]


def test_binaryfile_hash_and_hidden_names(spark, tmpdir_path):
    files = make_tree(tmpdir_path)
    df = L.binary_files(spark, tmpdir_path, with_content=True)
    got = {r["path"]: (r["size"], r["h"]) for r in df.select("path", "size", H.full_sha256("content").alias("h")).collect()}
    for p, (size, h) in got.items():
        assert size == len(files[p]) and h == hashlib.sha256(files[p][:10 * 1024 * 1024]).hexdigest()
    # Spark's listing drops names starting with '.' or '_' (why the walker exists)
    assert os.path.join(tmpdir_path, "_under", "z.jpg") not in got
    small = {r["path"]: r["h"] for r in df.select("path", H.prefix_sha256("content", 10).alias("h")).collect()}
    p0 = os.path.join(tmpdir_path, "subdir_0", "test_file_0.jpg")
    assert small[p0] == hashlib.sha256(files[p0][:10]).hexdigest()


def test_scan_diff_and_delete(spark):
    stored = spark.createDataFrame([(1, "d", "a"), (2, "d", "b"), (3, "e", "c")], "id long, device_uuid string, path string")
    scanned = spark.createDataFrame([("d", "a"), ("d", "n")], "device_uuid string, path string")
    diff = sorted((r["path"], r["change"]) for r in SC.scan_diff(stored, scanned).collect())
    assert diff == [("a", "updated"), ("b", "deleted"), ("n", "new")]
    kept = sorted(r["id"] for r in SC.delete_vanished(stored, scanned).collect())
    assert kept == [1, 3]
    nothing = spark.createDataFrame([("d", None)], "device_uuid string, path string")
    assert sorted(r["id"] for r in SC.delete_vanished(stored, nothing).collect()) == [3]


def test_skip_prefixes(spark):
    df = spark.createDataFrame([("/devices/x",), ("/home/x",), ("/usr2/y",)], "d string")
    got = [r["s"] for r in df.select(SC.should_skip_dir("d").alias("s")).collect()]
    assert got == [True, False, True]


def test_stream_equals_batch(spark, tmpdir_path):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = os.path.join(tmpdir_path, "src")
    from pyspark.sql import Window
    chunked = ev.withColumn("_c", F.ntile(4).over(Window.orderBy("ts", "event_id")))
    for i in range(4):  # events arrive in time order, one file per micro-batch
        part = chunked.where(F.col("_c") == i + 1).drop("_c")
        part.coalesce(1).write.parquet(os.path.join(src, f"chunk={i}"))
    files = spark.createDataFrame([(1, "dev-1", "e/1.jpg", None, 5, None, None, None, "sys-0", None)],
                                  "id long, device_uuid string, path string, hash string, size long, "
                                  "modified_time timestamp_ntz, scanned_time timestamp_ntz, "
                                  "last_accessed timestamp_ntz, system_id string, last_sync timestamp_ntz")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    log_dir = os.path.join(tmpdir_path, "log")
    q = FE.start_file_event_stream(scan_events_from(stream), log_dir, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination()
    assert len([d for d in os.listdir(log_dir) if d.startswith("batch_id=")]) == 4
    got = FE.snapshot(files, FE.read_log(spark, log_dir))
    want = FE.batch_equivalent(files, scan_events_from(ev))
    cols = ["device_uuid", "path", "size", "system_id", "scanned_time"]
    got_rows = sorted(map(tuple, got.select(cols).collect()))
    assert got_rows == sorted(map(tuple, want.select(cols).collect()))
    # incremental compaction: fold batches 0-1, then 2-3 onto that version
    from mediashelf.session import cut_lineage
    first = cut_lineage(FE.snapshot(files, FE.read_log(spark, log_dir, upto_batch=1)))
    second = FE.snapshot(first, FE.read_log(spark, log_dir, after_batch=1))
    assert sorted(map(tuple, second.select(cols).collect())) == got_rows
    # replaying the log (the sink is idempotent) changes nothing
    FE.log_writer(log_dir)(scan_events_from(spark.read.parquet(os.path.join(src, "chunk=0"))), 0)
    again = FE.snapshot(files, FE.read_log(spark, log_dir))
    assert sorted(map(tuple, again.select(cols).collect())) == got_rows


def test_observed_counters_match_stats(spark):
    from mediashelf.sources import catalogue as cat
    b = cat.file_batch(spark, "/root/testdata/sf0.001")
    elig = SC.should_scan_file("path", [".jpg", ".png"])
    df, obs = SC.observe_scan(b, elig)
    df.write.format("noop").mode("overwrite").save()
    got = obs.get
    want = SC.scan_stats(b, elig, 1.0).first()
    for k in ("total_files", "processed_files", "skipped_files", "error_files", "total_size"):
        assert got[k] == want[k], k


def test_detector_hook(spark):
    from mediashelf.operators import analysis as A

    def model(pdf):
        import pandas as pd
        rows = [(fid, "face" if len(c) % 2 else "dog", len(c) / 100.0) for fid, c in zip(pdf.file_id, pdf.content)]
        return pd.DataFrame(rows, columns=["file_id", "label", "confidence"])

    imgs = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"abcdefghij"))], "file_id long, content binary")
    det = A.detect(imgs, model)
    got = {r["file_id"]: (r["objects"], r["has_faces"]) for r in A.labels_per_file(det).collect()}
    assert got == {1: (["face"], False), 2: (["dog"], False)}


def test_progress_stream_survives_restart(spark, tmpdir_path):
    from pyspark.sql import Window
    from mediashelf.operators.registry import upsert_progress
    from mediashelf.streaming import progress as PR
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    chunked = ev.withColumn("_c", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    src = os.path.join(tmpdir_path, "src")
    initial = spark.createDataFrame([("dev-1", "sys-1", 1, 5, 2, None, None)], PR.PROGRESS_SCHEMA)
    base, ckpt = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt")
    as_of = "2024-01-01 00:00:00"
    stored = spark.createDataFrame([("dev-1", "e/1.jpg"), ("dev-2", "e/2.jpg")], "device_uuid string, path string")
    for i in range(3):  # a new file arrives, the query is (re)started from its checkpoint
        chunked.where(F.col("_c") == i + 1).drop("_c").coalesce(1).write.parquet(os.path.join(src, f"chunk={i}"))
        stream = scan_events_from(spark.readStream.schema(ev.schema).parquet(src))
        q = PR.start_progress_stream(stream, spark, base, ckpt, stored)
        q.awaitTermination()
        if i == 1:
            PR.compact(spark, base, 0)
    assert len([n for n in os.listdir(os.path.join(base, "new")) if n != "batch_id=-1"]) == 3
    PR.compact(spark, base, 1)  # folding old batches changes no count
    assert len([n for n in os.listdir(os.path.join(base, "new")) if n != "batch_id=-1"]) == 2
    got = PR.progress(spark, base, initial, as_of)
    ups = scan_events_from(ev).where("op = 'upsert'")
    nth = F.row_number().over(Window.partitionBy("device_uuid", "path").orderBy("ts", "event_id"))
    known = stored.select("device_uuid", "path", F.lit(True).alias("_known"))
    counts = ups.withColumn("nth", nth).join(known, ["device_uuid", "path"], "left").groupBy(
        "device_uuid", "system_id").agg(
        F.count("*").alias("total_files"),
        F.count_if((F.col("nth") == 1) & F.col("_known").isNull()).alias("new_files"))
    want = upsert_progress(initial, counts, as_of)
    cols = ["device_uuid", "system_id", "total_files", "new_files", "last_updated"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_progress_state_replaces_reading(spark, tmpdir_path):
    """No batch reads what earlier ones wrote or the catalogue: both may vanish. A batch that failed after its state
    was made counts the same when it is run again."""
    import shutil
    from mediashelf.streaming import progress as PR
    schema = "event_id long, device_uuid string, system_id string, path string, op string, size long, ts timestamp_ntz"
    src, base, ckpt = (os.path.join(tmpdir_path, x) for x in ("src", "out", "ckpt"))
    t = dt.datetime(2024, 1, 1)
    batches = [[(1, "d", "a", "p1", "upsert", 1, t), (2, "d", "b", "p1", "upsert", 1, t), (3, "d", "a", "known", "upsert", 1, t)],
               [(4, "d", "b", "p1", "upsert", 1, t - dt.timedelta(1)), (5, "d", "b", "p2", "upsert", 1, t), (6, "d", "a", "p9", "delete", 1, t)],
               [(7, "d", "a", "p2", "upsert", 1, t), (8, "e", "a", "p1", "upsert", 1, t), (9, "e", None, "p3", "upsert", 1, t)]]
    stored = spark.createDataFrame([("d", "known"), ("d", "gone")], PR.KNOWN)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"c={i}"))
        stream = spark.readStream.schema(schema).parquet(src)
        PR.start_progress_stream(stream, spark, base, ckpt, stored).awaitTermination()
        got = {(r["device_uuid"], r["system_id"]): (r["total_files"], r["new_files"]) for r in PR.counts(spark, base).collect()}
        if i == 1:
            kept = {n: os.path.join(base, n) + ".kept" for n in ("new", "totals")}
            for n, to in kept.items():
                shutil.move(os.path.join(base, n), to)
            os.mkdir(os.path.join(base, "new"))
    assert got == {("d", "a"): (3, 0), ("e", "a"): (1, 1), ("e", None): (1, 1)}  # the last batch alone, totals in full
    for n, to in kept.items():
        for part in os.listdir(to):
            if not os.path.exists(os.path.join(base, n, part)):
                shutil.move(os.path.join(to, part), os.path.join(base, n, part))
    want = {("d", "a"): (3, 1), ("d", "b"): (3, 1), ("e", "a"): (1, 1), ("e", None): (1, 1)}
    got = {(r["device_uuid"], r["system_id"]): (r["total_files"], r["new_files"]) for r in PR.counts(spark, base).collect()}
    assert got == want
    # the last batch again: its commit is lost, its output is there
    for name in ("totals", "new"):
        for suffix in ("2", ".2.crc"):
            os.remove(os.path.join(ckpt, name, "commits", suffix))
    PR.start_progress_stream(spark.readStream.schema(schema).parquet(src), spark, base, ckpt, stored).awaitTermination()
    again = {(r["device_uuid"], r["system_id"]): (r["total_files"], r["new_files"]) for r in PR.counts(spark, base).collect()}
    assert again == want


def _sync_source(spark, folder, sf, chunks):
    from pyspark.sql import Window
    ev = spark.read.parquet(f"{sf}/events.parquet")
    chunked = ev.withColumn("_c", F.ntile(chunks).over(Window.orderBy("ts", "event_id")))
    for i in range(chunks):
        chunked.where(F.col("_c") == i + 1).drop("_c").coalesce(1).write.parquet(os.path.join(folder, f"chunk={i}"))
    times = [r[0] for r in chunked.groupBy("_c").agg(F.max("ts").alias("t")).orderBy("_c").select("t").collect()]
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(folder).select("ts"), times


def _catalogue(spark, sf):
    from mediashelf.sources import catalogue as cat
    return {"devices": cat.devices(spark, sf), "files": cat.files(spark, sf),
            "scan_progress": cat.scan_progress(spark, sf), "image_analysis": cat.image_analysis_full(spark, sf)}


def test_sync_stream_equals_sequential_rounds(spark, tmpdir_path):
    from mediashelf.operators.sync import sync_all
    from mediashelf.session import cut_lineage
    from mediashelf.streaming import sync_loop as SLP
    sf = "/root/testdata/sf0.001"
    stream, times = _sync_source(spark, os.path.join(tmpdir_path, "src"), sf, 3)
    initial = _catalogue(spark, sf)
    base = os.path.join(tmpdir_path, "out")
    q = SLP.start_sync_stream(stream, spark, base, os.path.join(tmpdir_path, "ckpt"), initial, "sys-1",
                              trigger={"availableNow": True})
    q.awaitTermination()
    cur, logs, counts = dict(initial), [], []
    for as_of in times:
        rnd = sync_all(cur["devices"], cur["files"], cur["scan_progress"], cur["image_analysis"], "sys-1", as_of)
        logs.append(sorted(map(tuple, rnd.changes.collect())))
        counts.append(sorted(map(tuple, rnd.log.collect())))
        cur = {t: cut_lineage(getattr(rnd, t)) for t in SLP.TABLES}  # one materialised version per round
    for i in range(3):
        log, rounds = (x.where(f"batch_id = {i}").drop("batch_id") for x in (SLP.sync_log(spark, base), SLP.round_counts(spark, base)))
        assert sorted(map(tuple, log.collect())) == logs[i]
        assert sorted(map(tuple, rounds.collect())) == counts[i]
    # an empty batch writes nothing
    store = SLP.SyncStore(spark, base, initial)
    SLP.sync_writer(store, "sys-1")(spark.createDataFrame([], "ts timestamp_ntz"), 3)
    assert not os.path.exists(os.path.join(base, "rounds", "batch_id=3"))
    for t, got in SLP.current_tables(spark, base, initial).items():
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cur[t].select(got.columns).collect())), t


def _size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_sync_rounds_cost_what_changed(spark, tmpdir_path):
    """Rounds without foreign rows read summaries of constant size and write no table; a published row
    costs its bucket, and the next round takes it over."""
    from mediashelf.operators.sync import cutoff_of, dirty
    from mediashelf.streaming import sync_loop as SLP
    sf = "/root/testdata/sf0.001"
    initial = _catalogue(spark, sf)
    base = os.path.join(tmpdir_path, "out")
    store = SLP.SyncStore(spark, base, initial)
    begin = dt.datetime(2030, 1, 1)
    SLP.run_round(store, "sys-1", begin, 0)
    versions = store.versions()
    sizes, counts = set(), []
    for n in range(1, 21):
        SLP.run_round(store, "sys-1", begin + dt.timedelta(minutes=n), n)
        sizes.add(tuple(_size(os.path.join(base, x)) for x in ("tables", "summary")))
        counts.append({r["table_name"]: r["rows"] for r in SLP.round_counts(spark, base).where(f"batch_id = {n}").collect()})
    assert store.versions() == versions and len(sizes) == 1
    for n, got in ((1, counts[0]), (20, counts[-1])):  # as if the whole tables had been read
        cut = cutoff_of(begin + dt.timedelta(minutes=n))
        assert got == {t: store.read(t).where(dirty(store.read(t), "sys-1", cut)).count() for t in SLP.TABLES}
    # old versions are gone: one folder per bucket
    for t in SLP.TABLES:
        held = [p for d, ds, _ in os.walk(os.path.join(base, "tables", t, "data")) for p in ds if p.startswith("bucket=")]
        assert len(held) == len(set(held)) <= SLP.BUCKETS
    other = store.read("files").limit(1).withColumn("system_id", F.lit("sys-9"))
    key = other.first()
    store.publish("files", other)
    assert store.read("files").where("system_id = 'sys-9'").count() == 1
    before = store.tables["files"].layout()
    SLP.run_round(store, "sys-1", begin + dt.timedelta(minutes=30), 21)
    after = store.tables["files"].layout()
    assert sum(before[b] != after[b] for b in after) == 1
    log = SLP.sync_log(spark, base).where("batch_id = 21").collect()
    assert [(r["table_name"], r["record_id"], r["operation"]) for r in log] == [("files", str(key["id"]), "update")]
    assert store.read("files").where("system_id = 'sys-9'").count() == 0


def test_sync_round_is_replayed_from_its_first_versions(spark, tmpdir_path, monkeypatch):
    from mediashelf.streaming import sync_loop as SLP
    sf = "/root/testdata/sf0.001"
    initial = _catalogue(spark, sf)
    as_of = dt.datetime(2030, 1, 1)
    stores = [SLP.SyncStore(spark, os.path.join(tmpdir_path, x), initial) for x in ("whole", "failed")]
    SLP.run_round(stores[0], "sys-1", as_of, 0)
    put, done = SLP.SyncStore.put, []

    def failing(self, name, *args):
        put(self, name, *args)
        done.append(name)
        if name == "files":
            raise OSError("lost")
    monkeypatch.setattr(SLP.SyncStore, "put", failing)
    with pytest.raises(OSError):
        SLP.run_round(stores[1], "sys-1", as_of, 0)
    monkeypatch.setattr(SLP.SyncStore, "put", put)
    assert "files" in done and SLP.unfinished(spark, stores[1].base_dir) == 0
    with pytest.raises(RuntimeError, match="unfinished"):
        stores[1].publish("files", initial["files"].limit(1))
    SLP.run_round(stores[1], "sys-1", as_of, 0)
    for read in (SLP.sync_log, SLP.round_counts):
        a, b = (sorted(map(tuple, read(spark, s.base_dir).collect())) for s in stores)
        assert a == b
    for t in SLP.TABLES:
        assert sorted(map(str, stores[0].read(t).collect())) == sorted(map(str, stores[1].read(t).collect()))


def test_scan_upsert_restore_end_to_end(spark, tmpdir_path):
    """Scan a device, store it, restore every path and read the file back; the same device
    scanned by a second system under another mount keeps its own rows (3-column key)."""
    from mediashelf.functions import paths as P
    from mediashelf.operators import upsert as U
    from mediashelf.operators.registry import restore_paths
    from mediashelf.schemas import SCHEMAS
    root = os.path.join(tmpdir_path, "dev")
    for i in range(3):
        os.makedirs(os.path.join(root, f"subdir_{i}"))
        with open(os.path.join(root, f"subdir_{i}", f"test_file_{i}.jpg"), "w") as fh:
            fh.write(f"This is test file {i}")
    other_mount = root + "-on-sys2-different"
    os.symlink(root, other_mount)
    files = spark.createDataFrame([], SCHEMAS["files"])
    for system, mount in (("sys1", root), ("sys2", other_mount)):
        walked = L.walk_files(L.seeds_of(spark, [mount]), do_hash=True)
        dev = spark.createDataFrame([(mount, "test_dev")], "root string, device_uuid string")
        rows = SC.listing_rows(walked.where(SC.should_scan_file("path", [".jpg"])), dev, system)
        batch = rows.select("device_uuid", F.col("rel_path").alias("path"), "system_id", "size", "hash",
                            "modified_time")
        files = U.upsert(files, batch, ["device_uuid", "path", "system_id"], ["size", "hash", "modified_time"],
                         as_of="2024-01-01 00:00:00").table
    assert files.count() == 6
    assert files.where("system_id = 'sys1'").count() == 3
    devices = spark.createDataFrame([(1, "test_dev", root, "sys1"), (2, "test_dev", other_mount, "sys2")],
                                    "id long, uuid string, mount_path string, system_id string")
    mps = spark.createDataFrame([], SCHEMAS["device_mount_points"])
    for system, mount in (("sys1", root), ("sys2", other_mount)):
        ids = files.where(F.col("system_id") == system).select(F.col("id").alias("file_id"))
        got = restore_paths(ids, files.where(F.col("system_id") == system), devices, mps, system).collect()
        assert len(got) == 3
        for r in got:
            assert r["full_path"].startswith(mount + "/")
            with open(r["full_path"]) as fh:
                assert fh.read().startswith("This is test file")
    # X3 gives the same full path from the stored relative path
    one = files.where("system_id = 'sys2'").select(P.platform_path("path", F.lit(other_mount)).alias("p")).first()["p"]
    assert os.path.exists(one)


@pytest.mark.parametrize("name", ["T6_stream_sync_rounds", "T7_stream_progress", "T8_stream_file_events"])
def test_streams_spread_over_more_tasks_as_tables_grow(spark, monkeypatch, name):
    """Buckets and shuffle partitions of the streams follow the number of rows, not a constant."""
    from mediashelf import session
    from mediashelf.plans import q_streaming as Q

    from .conftest import SF_SMALL
    seen = []

    class Stop(Exception):
        pass

    def start(*args, **kw):
        seen.append(kw.get("buckets") or int(spark.conf.get("spark.sql.shuffle.partitions")))
        raise Stop
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    for module, at in ((Q.SL, "start_sync_stream"), (Q.PR, "start_progress_stream"), (Q.FE, "start_file_event_stream")):
        monkeypatch.setattr(module, at, start)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    run = {"T6": Q.t6_stream_sync, "T7": Q.t7_stream_progress, "T8": Q.t8_stream_file_events}[name[:2]]
    with pytest.raises(Stop):
        run(spark, SF_SMALL)
    rows = cat.files(spark, SF_SMALL).count()
    if name[:2] != "T6":
        rows += spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert seen == [-(-rows // 10)] and rows > 200
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
