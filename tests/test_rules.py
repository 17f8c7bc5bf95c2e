"""Rules that a fixture of well-formed rows cannot show: ids are never given out again, the last report
wins, times never move back, nothing computed is dropped, deep pages; and plan shapes of the one-pass operators."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from mediashelf.operators import analysis as A
from mediashelf.operators import migrate as M
from mediashelf.operators import registry as R
from mediashelf.operators import scan as SC
from mediashelf.operators import search
from mediashelf.operators import sync as S
from mediashelf.operators import upsert as U
from mediashelf.operators.prefix_join import longest_prefix_mount
from mediashelf.plans import q_upsert
from mediashelf.schemas import SCHEMAS
from mediashelf.sources import catalogue as cat
from mediashelf.streaming import file_events as FE

from .conftest import SF_SMALL

T0 = dt.datetime(2020, 1, 1)


def files_of(spark, rows):
    """``(id, device, path, hash, size, owner, last_sync)`` rows as a files table."""
    full = [(i, d, p, h, s, None, None, None, o, t) for i, d, p, h, s, o, t in rows]
    return spark.createDataFrame(full, "id long, device_uuid string, path string, hash string, size long, "
                                       "modified_time timestamp_ntz, scanned_time timestamp_ntz, "
                                       "last_accessed timestamp_ntz, system_id string, last_sync timestamp_ntz")


def scans(df):
    return len(re.findall(r"FileScan|Scan parquet|BatchScan", df._jdf.queryExecution().sparkPlan().toString()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def event(i, path, op, size=10, ts=T0):
    return (i, "d", "sys-1", path, op, size, ts, 0)


def test_folded_events_never_reuse_ids_and_stamp_updates(spark):
    files = files_of(spark, [(1, "d", "a", "h1", 1, "sys-0", T0), (2, "d", "b", "h2", 2, "sys-0", T0)])
    later = dt.datetime(2021, 1, 1)
    log = spark.createDataFrame([event(1, "b", "delete"), event(2, "a", "upsert", 9, later), event(3, "new", "upsert")],
                                FE.LOG_SCHEMA)
    res = FE.fold(files, log)
    got = {r["path"]: r for r in res.table.collect()}
    assert set(got) == {"a", "new"}
    assert got["new"]["id"] == 3  # 2 belonged to the deleted row
    assert got["a"]["id"] == 1 and got["a"]["last_sync"] == later and got["a"]["hash"] is None and got["a"]["size"] == 9
    assert res.high_water == 3
    # the row with the highest id goes, too: the mark keeps it from coming back
    gone = FE.fold(res.table, spark.createDataFrame([event(4, "new", "delete")], FE.LOG_SCHEMA))
    back = FE.fold(gone.table, spark.createDataFrame([event(5, "again", "upsert")], FE.LOG_SCHEMA), id_floor=gone.high_water)
    assert back.table.where("path = 'again'").first()["id"] == 4


def test_counts_start_no_id_job(spark, monkeypatch):
    def no(*a, **k):
        raise AssertionError("ids were given out for a count")
    monkeypatch.setattr(U, "assign_serial_ids", no)
    got = {r["action"]: r["rows"] for r in q_upsert.k1_result(spark, SF_SMALL).counts().collect()}
    assert got["insert"] > 0 and got["update"] > 0
    with pytest.raises(AssertionError):
        q_upsert.k1_result(spark, SF_SMALL).table


def test_last_report_of_a_device_wins(spark):
    devices = spark.createDataFrame([], SCHEMAS["devices"])
    seen = spark.createDataFrame([("u", "/b", "first", 1), ("u", "/a", "second", 2)],
                                 "uuid string, mount_path string, label string, seq int")
    row = R.register_devices(devices, seen, "me", "2024-01-01 00:00:00", order_col="seq").table.first()
    assert (row["mount_path"], row["label"]) == ("/a", "second")
    assert R.register_devices(devices, seen.drop("seq"), "me", "2024-01-01 00:00:00").table.count() == 1


def test_old_accesses_move_no_time_back(spark):
    files = files_of(spark, [(1, "d", "a", None, 1, "s", dt.datetime(2024, 6, 1)), (2, "d", "b", None, 1, "s", None)])
    files = files.withColumn("last_accessed", F.when(F.col("id") == 1, U.ts_lit("2024-06-01 00:00:00")))
    old = spark.createDataFrame([(1, T0), (2, T0)], "file_id long, ts timestamp_ntz")
    got = {r["id"]: (r["last_accessed"], r["last_sync"]) for r in U.touch_access(files, old).collect()}
    assert got == {1: (dt.datetime(2024, 6, 1), dt.datetime(2024, 6, 1)), 2: (T0, T0)}


def test_analysis_columns_are_never_dropped(spark):
    current = cat.image_analysis_full(spark, SF_SMALL).drop("width")
    an = spark.createDataFrame([(1, 10, 20)], "file_id long, width int, height int")
    with pytest.raises(ValueError, match="width"):
        A.store_image_analyses(current, an, "2024-01-01 00:00:00")


def test_pages_by_key_equal_pages_by_offset(spark):
    files, devices = cat.files(spark, SF_SMALL), cat.devices(spark, SF_SMALL)
    with pytest.raises(ValueError):
        search.search_files(files, devices, limit=None, offset=5)
    by_id = {r["uuid"]: r["id"] for r in devices.collect()}
    shown, after = [], None
    one = devices.groupBy("uuid").agg(F.min("id").alias("id"))
    devices = devices.join(one, ["uuid", "id"]).select(*devices.columns)  # one row per device
    by_id = {r["uuid"]: r["id"] for r in devices.collect()}
    for _ in range(4):
        page = search.search_files(files, devices, limit=37, after=after).collect()
        shown += [r["id"] for r in page]
        last = page[-1]
        after = (last["modified_time"], last["id"], by_id[last["device_uuid"]])
    whole = [r["id"] for r in search.search_files(files, devices, limit=148).collect()]
    assert shown == whole


def test_mounts_are_joined_in_place(spark):
    """No explode, no grouping, no shuffle of the paths; equal keys with different paths stay apart."""
    mounts = spark.createDataFrame([("/a", "u1"), ("/a/b", "u2"), ("/" + "x" * 5000, "u3")], "mount_path string, uuid string")
    paths = spark.createDataFrame([(1, "/a/b/c"), (1, "/a/z"), (2, "/" + "x" * 5000 + "/f")], "id long, path string")
    out = longest_prefix_mount(paths, mounts)
    assert sorted(r["device_uuid"] for r in out.collect()) == ["u1", "u2", "u3"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and shuffles(out) == 0


def test_one_pass_plans(spark):
    files, devices = cat.files(spark, SF_SMALL), cat.devices(spark, SF_SMALL)
    batch = cat.file_batch(spark, SF_SMALL)
    scanned = batch.select("device_uuid", "path")
    # The files once; the scan's input (files and lines) for the devices and for the seen paths
    assert scans(SC.delete_vanished(files, scanned)) == 1 + 2 * scans(scanned)
    # Files and devices once each, no join of the files with themselves
    assert scans(M.apply_rewrite(cat.legacy_files(spark, SF_SMALL), devices, "sys-0", "2024-01-01 00:00:00")) \
        == scans(cat.legacy_files(spark, SF_SMALL)) + 1
    # Requests, files, and the device tables; the files are read once
    req = files.select(F.col("id").alias("file_id"))
    got = R.restore_paths(req, files, devices, cat.device_mount_points(spark, SF_SMALL), "sys-0")
    assert scans(got) <= 7
    # T5: one table's log reads the table for the acted keys, for their rows and for the marks
    marked = S.mark_files(files, "sys-1", "1996-01-01 00:00:00")
    assert scans(S.change_log("files", marked, "sys-1", "1996-01-01 00:00:00")) <= 4


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from mediashelf import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
