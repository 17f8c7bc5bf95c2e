"""Queries: upserts and their change sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert as U
from ..sources import catalogue as cat
from .registry import register

# write order inside a batch: line number (+ part, supplier), then price in cents
def ORDER():
    return F.struct("ord", "ord2")

AS_OF = "2024-01-01 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

_BATCH_SQL = """
b AS (
  SELECT device_uuid, path, system_id, size, hash, modified_time FROM file_batch WHERE error IS NULL
  QUALIFY row_number() OVER (PARTITION BY device_uuid, path, system_id ORDER BY ord DESC, ord2 DESC) = 1)"""


def _clean_batch(spark, sf_dir):
    # rows carrying an error are not written
    return cat.file_batch(spark, sf_dir).where(F.col("error").isNull()).drop("error")


def k1_result(spark, sf_dir):
    return U.upsert(cat.files(spark, sf_dir), _clean_batch(spark, sf_dir),
                    ["device_uuid", "path", "system_id"], ["hash", "size", "modified_time"],
                    as_of=AS_OF, order_col=ORDER(),
                    insert_values={"scanned_time": U.ts_lit(AS_OF)})


@register("K1_W3_W4_K15_upsert_files", views=("files", "file_batch"), sql=f"""
WITH {_BATCH_SQL},
j AS (
  SELECT f.*, b.device_uuid AS b_dev, b.path AS b_path, b.system_id AS b_sys, b.size AS b_size,
         b.hash AS b_hash, b.modified_time AS b_mt
  FROM files f FULL OUTER JOIN b
    ON f.device_uuid = b.device_uuid AND f.path = b.path AND f.system_id = b.system_id)
SELECT
  CASE WHEN id IS NOT NULL THEN id
       ELSE (SELECT MAX(id) FROM files)
            + row_number() OVER (PARTITION BY id IS NULL ORDER BY b_dev, b_path, b_sys) END AS id,
  COALESCE(device_uuid, b_dev) AS device_uuid, COALESCE(path, b_path) AS path,
  CASE WHEN b_dev IS NOT NULL THEN b_hash ELSE hash END AS hash,
  CASE WHEN b_dev IS NOT NULL THEN b_size ELSE size END AS size,
  CASE WHEN b_dev IS NOT NULL THEN b_mt ELSE modified_time END AS modified_time,
  CASE WHEN id IS NULL THEN {AS_OF_SQL} ELSE scanned_time END AS scanned_time,
  last_accessed,
  COALESCE(system_id, b_sys) AS system_id,
  CASE WHEN id IS NOT NULL AND b_dev IS NOT NULL THEN {AS_OF_SQL} ELSE last_sync END AS last_sync
FROM j""")
def k1_upsert_files(spark, sf_dir):
    return k1_result(spark, sf_dir).table


@register("A7_upsert_change_counts", views=("files", "file_batch"), sql=f"""
WITH {_BATCH_SQL}
SELECT CASE WHEN f.id IS NULL THEN 'insert' ELSE 'update' END AS action, COUNT(*) AS rows
FROM b LEFT JOIN files f
  ON f.device_uuid = b.device_uuid AND f.path = b.path AND f.system_id = b.system_id
GROUP BY 1""")
def a7_change_counts(spark, sf_dir):
    return k1_result(spark, sf_dir).counts()


@register("K2_replace_files", views=("files", "file_batch"), sql=f"""
WITH {_BATCH_SQL},
kept AS (
  SELECT f.* FROM files f WHERE NOT EXISTS (
    SELECT 1 FROM b WHERE b.device_uuid = f.device_uuid AND b.path = f.path AND b.system_id = f.system_id)),
ins AS (
  SELECT (SELECT MAX(id) FROM files) + row_number() OVER (ORDER BY device_uuid, path, system_id) AS id,
    device_uuid, path, hash, size, modified_time, {AS_OF_SQL} AS scanned_time,
    CAST(NULL AS TIMESTAMP) AS last_accessed, system_id, CAST(NULL AS TIMESTAMP) AS last_sync
  FROM b)
SELECT * FROM kept UNION ALL SELECT * FROM ins""")
def k2_replace_files(spark, sf_dir):
    return U.upsert(cat.files(spark, sf_dir), _clean_batch(spark, sf_dir),
                    ["device_uuid", "path", "system_id"], ["hash", "size", "modified_time"],
                    mode="replace", as_of=AS_OF, order_col=ORDER(),
                    insert_values={"scanned_time": U.ts_lit(AS_OF)}).table


def k3_result(spark, sf_dir):
    return U.upsert(cat.files(spark, sf_dir), _clean_batch(spark, sf_dir), ["device_uuid", "path"],
                    ["system_id", "hash", "size", "modified_time"], as_of=AS_OF, order_col=ORDER(),
                    insert_values={"scanned_time": U.ts_lit(AS_OF)},
                    update_values={"scanned_time": U.ts_lit(AS_OF)})


_BATCH2_SQL = """
b AS (
  SELECT device_uuid, path, system_id, size, hash, modified_time FROM file_batch WHERE error IS NULL
  QUALIFY row_number() OVER (PARTITION BY device_uuid, path ORDER BY ord DESC, ord2 DESC) = 1)"""


@register("K3_upsert_files_path_key", views=("files", "file_batch"), sql=f"""
WITH {_BATCH2_SQL},
j AS (
  SELECT f.*, b.device_uuid AS b_dev, b.path AS b_path, b.system_id AS b_sys, b.size AS b_size,
         b.hash AS b_hash, b.modified_time AS b_mt
  FROM files f FULL OUTER JOIN b ON f.device_uuid = b.device_uuid AND f.path = b.path)
SELECT
  CASE WHEN id IS NOT NULL THEN id
       ELSE (SELECT MAX(id) FROM files)
            + row_number() OVER (PARTITION BY id IS NULL ORDER BY b_dev, b_path) END AS id,
  COALESCE(device_uuid, b_dev) AS device_uuid, COALESCE(path, b_path) AS path,
  CASE WHEN b_dev IS NOT NULL THEN b_hash ELSE hash END AS hash,
  CASE WHEN b_dev IS NOT NULL THEN b_size ELSE size END AS size,
  CASE WHEN b_dev IS NOT NULL THEN b_mt ELSE modified_time END AS modified_time,
  CASE WHEN b_dev IS NOT NULL THEN {AS_OF_SQL} ELSE scanned_time END AS scanned_time,
  last_accessed,
  CASE WHEN b_dev IS NOT NULL THEN b_sys ELSE system_id END AS system_id,
  CASE WHEN id IS NOT NULL AND b_dev IS NOT NULL THEN {AS_OF_SQL} ELSE last_sync END AS last_sync
FROM j""")
def k3_upsert_files_path_key(spark, sf_dir):
    return k3_result(spark, sf_dir).table


@register("A6_scan_result_counts", views=("files", "file_batch"), sql=f"""
WITH {_BATCH2_SQL}
SELECT b.device_uuid, b.system_id, COUNT(*) AS total_files,
  COUNT(*) FILTER (WHERE f.id IS NULL) AS new_files
FROM b LEFT JOIN files f ON f.device_uuid = b.device_uuid AND f.path = b.path
GROUP BY b.device_uuid, b.system_id""")
def a6_scan_result_counts(spark, sf_dir):
    # per (device, system) of the batch: rows written and rows that were new (K3's is_new)
    from ..operators.scan import scan_result_counts
    return scan_result_counts(cat.files(spark, sf_dir), _clean_batch(spark, sf_dir), order_col=ORDER())


@register("K14_touch_access", views=("files", "file_accesses"), sql="""
WITH a AS (SELECT file_id, MAX(ts) AS ts FROM file_accesses GROUP BY file_id)
SELECT f.id, f.device_uuid, f.path, f.hash, f.size, f.modified_time, f.scanned_time,
  CASE WHEN a.ts IS NOT NULL AND (f.last_accessed IS NULL OR a.ts > f.last_accessed) THEN a.ts
       ELSE f.last_accessed END AS last_accessed,
  f.system_id,
  CASE WHEN a.ts IS NOT NULL AND (f.last_sync IS NULL OR a.ts > f.last_sync) THEN a.ts ELSE f.last_sync END AS last_sync
FROM (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN TIMESTAMP '1996-06-01 00:00:00' END AS last_accessed) FROM files) f
LEFT JOIN a ON f.id = a.file_id""")
def k14_touch_access(spark, sf_dir):
    # a third of the files was accessed before, some of them later than any access of the batch
    f = cat.files(spark, sf_dir).withColumn(
        "last_accessed", F.when(F.col("id") % 3 == 0, U.ts_lit("1996-06-01 00:00:00")))
    return U.touch_access(f, cat.file_accesses(spark, sf_dir))


@register("W4_ids_never_reused", views=("files", "file_batch"), sql=f"""
WITH {_BATCH_SQL},
f AS (SELECT * FROM files WHERE id <= (SELECT MAX(id) FROM files) - 100),
n AS (SELECT device_uuid, path, system_id FROM b WHERE NOT EXISTS (
        SELECT 1 FROM f WHERE f.device_uuid = b.device_uuid AND f.path = b.path AND f.system_id = b.system_id))
SELECT (SELECT MAX(id) FROM files) + row_number() OVER (ORDER BY device_uuid, path, system_id) AS id,
  device_uuid, path, system_id FROM n""")
def w4_ids_never_reused(spark, sf_dir):
    # the rows with the largest ids were deleted; rows inserted now must not get those ids
    files = cat.files(spark, sf_dir)
    mark = U.max_id(files)
    rest = files.where(F.col("id") <= mark - 100)
    out = U.upsert(rest, _clean_batch(spark, sf_dir), ["device_uuid", "path", "system_id"],
                   as_of=AS_OF, order_col=ORDER(), id_floor=mark).table
    return out.where(F.col("id") > mark).select("id", "device_uuid", "path", "system_id")


@register("W3_latest_event_per_file", views=("scan_events",), sql="""
SELECT device_uuid, path, event_id, system_id, op, size, ts FROM scan_events
QUALIFY row_number() OVER (PARTITION BY device_uuid, path ORDER BY ts DESC, event_id DESC) = 1""")
def w3_latest_event(spark, sf_dir):
    e = cat.scan_events(spark, sf_dir)
    return U.latest_per_key(e, ["device_uuid", "path"], F.struct("ts", "event_id"))


@register("W4_serial_ids_for_new_keys", views=("files", "scan_events"), sql="""
SELECT (SELECT MAX(id) FROM files) + row_number() OVER (ORDER BY device_uuid, path, system_id) AS id,
  device_uuid, path, system_id
FROM (SELECT DISTINCT device_uuid, path, system_id FROM scan_events) k""")
def w4_serial_ids(spark, sf_dir):
    keys = cat.scan_events(spark, sf_dir).select("device_uuid", "path", "system_id").distinct()
    base = U.max_id(cat.files(spark, sf_dir))
    return U.assign_serial_ids(keys, ["device_uuid", "path", "system_id"], base)


@register("J8_existing_batch_keys", views=("files", "file_batch"), sql="""
SELECT b.* FROM file_batch b
WHERE EXISTS (SELECT 1 FROM files f WHERE f.device_uuid = b.device_uuid AND f.path = b.path
                                      AND f.system_id = b.system_id)""")
def j8_existing_batch_keys(spark, sf_dir):
    return U.existing_keys(cat.file_batch(spark, sf_dir), cat.files(spark, sf_dir),
                           ["device_uuid", "path", "system_id"])


@register("K14_unknown_file_accesses", views=("files",), sql="""
SELECT event_id * 7 AS file_id, COUNT(*) AS accesses FROM events
WHERE event_id * 7 NOT IN (SELECT id FROM files)
GROUP BY event_id * 7""")
def k14_unknown_accesses(spark, sf_dir):
    from ..sources.catalogue import read_table
    # accesses name file ids by a rule over the event ids: part of them lie beyond the catalogue
    acc = read_table(spark, sf_dir, "events").select((F.col("event_id") * 7).alias("file_id"), "ts")
    return U.unknown_accesses(acc, cat.files(spark, sf_dir))
