"""Queries: streaming ingest and sync (T6-T8), each compared with SQL for the equivalent batch."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import parts_for, shuffle_partitions_for
from ..sources import catalogue as cat
from ..sources.catalogue import read_table, stored_events_from
from ..streaming import file_events as FE
from ..streaming import progress as PR
from ..streaming import sync_loop as SL
from .q_upsert import AS_OF
from .registry import register


def _event_stream(spark, sf_dir):
    schema = read_table(spark, sf_dir, "events").schema
    # the file source needs a directory or a glob; a one-file glob names the events table
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .parquet(os.path.join(sf_dir, "events.parque[t]")))


def _rows(spark, sf_dir) -> int:
    """Rows of the events and of the files that they are joined with (from the files' footers)."""
    return read_table(spark, sf_dir, "events").count() + cat.files(spark, sf_dir).count()


@register("T8_stream_file_events", views=("files", "stored_events"), sql="""
WITH last AS (SELECT * FROM stored_events
              QUALIFY row_number() OVER (PARTITION BY device_uuid, path ORDER BY ts DESC, event_id DESC) = 1),
ups AS (SELECT * FROM last WHERE op = 'upsert'),
base AS (SELECT f.* FROM files f WHERE NOT EXISTS (
          SELECT 1 FROM last d WHERE d.op = 'delete' AND d.device_uuid = f.device_uuid AND d.path = f.path)),
j AS (SELECT b.*, u.device_uuid AS u_dev, u.path AS u_path, u.system_id AS u_sys, u.size AS u_size, u.ts AS u_ts
      FROM base b FULL OUTER JOIN ups u ON b.device_uuid = u.device_uuid AND b.path = u.path)
SELECT CASE WHEN id IS NOT NULL THEN id
            ELSE (SELECT MAX(id) FROM files) + row_number() OVER (PARTITION BY id IS NULL ORDER BY u_dev, u_path) END AS id,
  COALESCE(device_uuid, u_dev) AS device_uuid, COALESCE(path, u_path) AS path,
  CASE WHEN u_dev IS NULL THEN hash END AS hash,
  CASE WHEN u_dev IS NOT NULL THEN u_size ELSE size END AS size, modified_time,
  CASE WHEN u_dev IS NOT NULL THEN u_ts ELSE scanned_time END AS scanned_time, last_accessed,
  CASE WHEN u_dev IS NOT NULL THEN u_sys ELSE system_id END AS system_id,
  CASE WHEN id IS NOT NULL AND u_dev IS NOT NULL THEN u_ts ELSE last_sync END AS last_sync
FROM j""")
def t8_stream_file_events(spark, sf_dir):
    log_dir = FE.work_dir(spark, "file-event-log")
    files = cat.files(spark, sf_dir)
    # a stream-static join names stored files in a third of the events
    events = stored_events_from(_event_stream(spark, sf_dir), files)
    with shuffle_partitions_for(spark, _rows(spark, sf_dir)):
        q = FE.start_file_event_stream(events, log_dir, FE.work_dir(spark, "t8-ckpt"))
    q.awaitTermination()
    return FE.snapshot(files, FE.read_log(spark, log_dir))


@register("T7_stream_progress", views=("scan_progress", "stored_events"), sql=f"""
WITH ups AS (SELECT *, row_number() OVER (PARTITION BY device_uuid, path ORDER BY ts, event_id) AS nth
             FROM stored_events WHERE op = 'upsert'),
b AS (SELECT device_uuid, system_id, COUNT(*) AS total_files,
             COUNT(*) FILTER (WHERE nth = 1 AND NOT EXISTS (
               SELECT 1 FROM files f WHERE f.device_uuid = ups.device_uuid AND f.path = ups.path)) AS new_files
      FROM ups GROUP BY device_uuid, system_id),
j AS (SELECT p.*, b.device_uuid AS b_dev, b.system_id AS b_sys, b.total_files AS b_total, b.new_files AS b_new
      FROM scan_progress p FULL OUTER JOIN b ON p.device_uuid = b.device_uuid AND p.system_id = b.system_id)
SELECT
  CASE WHEN id IS NOT NULL THEN id
       ELSE (SELECT MAX(id) FROM scan_progress)
            + row_number() OVER (PARTITION BY id IS NULL ORDER BY b_dev, b_sys) END AS id,
  COALESCE(device_uuid, b_dev) AS device_uuid, COALESCE(system_id, b_sys) AS system_id,
  CASE WHEN b_dev IS NOT NULL THEN b_total ELSE total_files END AS total_files,
  CASE WHEN b_dev IS NOT NULL THEN b_new ELSE new_files END AS new_files,
  CASE WHEN b_dev IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE last_updated END AS last_updated,
  CASE WHEN id IS NOT NULL AND b_dev IS NOT NULL THEN TIMESTAMP '{AS_OF}' ELSE last_sync END AS last_sync
FROM j""")
def t7_stream_progress(spark, sf_dir):
    base, files = FE.work_dir(spark, "progress"), cat.files(spark, sf_dir)
    events = stored_events_from(_event_stream(spark, sf_dir), files)
    with shuffle_partitions_for(spark, _rows(spark, sf_dir)):
        q = PR.start_progress_stream(events, spark, base, FE.work_dir(spark, "t7-ckpt"), files)
    q.awaitTermination()
    return PR.progress(spark, base, cat.scan_progress(spark, sf_dir), AS_OF)


# the columns of each table that show what a round did, as one text
_SHOWN = {"devices": ["uuid", "is_active", "last_seen"], "files": ["device_uuid", "path", "hash", "size", "scanned_time"],
          "scan_progress": ["device_uuid", "total_files", "new_files"],
          "image_analysis": ["file_id", "camera_model", "objects", "analyzed_time"]}


def _t6_sql() -> str:
    from .q_sync import _round_sql, CUT, NOW
    max_ts = "(SELECT MAX(ts) FROM events)"
    ctes = _round_sql().replace(CUT, f"({max_ts} - INTERVAL 5 MINUTE)").replace(NOW, max_ts)
    ctes = ctes.replace("p2 AS (SELECT DISTINCT device_uuid, path FROM file_batch WHERE error IS NULL)",
                        "p2 AS (SELECT DISTINCT device_uuid, path FROM files)")
    after = {"devices": "devices2", "files": "files2", "scan_progress": "progress2", "image_analysis": "analysis2"}
    parts = [f"SELECT '{t}' AS table_name, id, system_id, last_sync, concat_ws('|', "
             + ", ".join(f"CAST({c} AS VARCHAR)" for c in _SHOWN[t]) + f") AS shown FROM {after[t]}" for t in SL.TABLES]
    return f"WITH {ctes}\n" + " UNION ALL ".join(parts)


@register("T6_stream_sync_rounds", views=("devices", "files", "scan_progress", "file_batch", "image_analysis_full"),
          sql=_t6_sql())
def t6_stream_sync(spark, sf_dir):
    base = FE.work_dir(spark, "sync")
    initial = {"devices": cat.devices(spark, sf_dir), "files": cat.files(spark, sf_dir),
               "scan_progress": cat.scan_progress(spark, sf_dir),
               "image_analysis": cat.image_analysis_full(spark, sf_dir)}
    events = _event_stream(spark, sf_dir).select("ts")
    buckets = parts_for(initial["files"].count(), SL.BUCKETS)  # of the largest table
    q = SL.start_sync_stream(events, spark, base, FE.work_dir(spark, "t6-ckpt"), initial, "sys-1",
                             trigger={"availableNow": True}, buckets=buckets)
    q.awaitTermination()
    after = SL.current_tables(spark, base, initial, buckets)
    return reduce(DataFrame.unionByName, [after[t].select(
        F.lit(t).alias("table_name"), "id", "system_id", "last_sync",
        F.concat_ws("|", *[F.col(c).cast("string") for c in _SHOWN[t]]).alias("shown")) for t in SL.TABLES])
