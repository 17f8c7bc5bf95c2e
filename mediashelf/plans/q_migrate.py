"""Queries: migration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import migrate as M
from ..operators.upsert import latest_per_key
from ..sources import catalogue as cat
from .q_upsert import AS_OF, AS_OF_SQL
from .registry import register

# write order inside a batch: line number (+ part, supplier), then price in cents
def ORDER():
    return F.struct("ord", "ord2")

ME = "sys-0"
DEVICE_MOUNT = "(SELECT uuid, mount_path, id AS device_id FROM devices WHERE system_id = 'sys-0')"
_PLAN_SQL = f"""
plan AS (
  SELECT f.id, f.device_uuid, d.device_id, f.path, d.mount_path,
    CASE WHEN starts_with(f.path, '/') THEN rel.rel ELSE f.path END AS rel_path,
    f.system_id AS old_system_id,
    CASE WHEN f.path IS NULL THEN 'error' WHEN NOT starts_with(f.path, '/') THEN 'already relative'
         WHEN d.mount_path IS NULL THEN 'error' ELSE 'convertible' END AS status
  FROM legacy_files f JOIN {DEVICE_MOUNT} d ON f.device_uuid = d.uuid
  CROSS JOIN LATERAL (
    SELECT CASE WHEN starts_with(f.path, rtrim(d.mount_path, '/') || '/')
                THEN substr(f.path, length(rtrim(d.mount_path, '/')) + 2) ELSE f.path END AS rel) rel
  WHERE COALESCE(f.system_id, '') IN ('', 'migration'))"""


@register("X13_J13_F13_apply_rewrite", views=("legacy_files",), sql=f"""
WITH {_PLAN_SQL}
SELECT f.id, f.device_uuid,
  CASE WHEN p.id IS NOT NULL THEN p.rel_path ELSE f.path END AS path,
  f.hash, f.size, f.modified_time, f.scanned_time, f.last_accessed,
  CASE WHEN p.id IS NOT NULL THEN '{ME}' ELSE f.system_id END AS system_id,
  CASE WHEN p.id IS NOT NULL THEN {AS_OF_SQL} ELSE f.last_sync END AS last_sync
FROM legacy_files f LEFT JOIN (SELECT * FROM plan WHERE status <> 'error') p ON f.id = p.id""")
def x13_apply_rewrite(spark, sf_dir):
    return M.apply_rewrite(cat.legacy_files(spark, sf_dir), cat.devices(spark, sf_dir), ME, AS_OF)


@register("W2_rewrite_preview", views=("legacy_files",), sql=f"""
WITH {_PLAN_SQL}
SELECT * FROM plan QUALIFY row_number() OVER (PARTITION BY device_uuid ORDER BY id) <= 10""")
def w2_preview(spark, sf_dir):
    plan = M.rewrite_plan(cat.legacy_files(spark, sf_dir), cat.devices(spark, sf_dir), ME)
    return M.preview(plan, 10)


@register("A10_rewrite_stats", views=("legacy_files",), sql=f"""
WITH {_PLAN_SQL}
SELECT device_uuid, COUNT(*) AS total,
  COUNT(*) FILTER (WHERE status <> 'error' AND device_uuid NOT IN ('dev-1', 'dev-2')) AS updated,
  COUNT(*) FILTER (WHERE device_uuid IN ('dev-1', 'dev-2')) AS skipped,
  COUNT(*) FILTER (WHERE status = 'error' AND device_uuid NOT IN ('dev-1', 'dev-2')) AS errors
FROM plan GROUP BY ROLLUP (device_uuid)""")
def a10_rewrite_stats(spark, sf_dir):
    plan = M.rewrite_plan(cat.legacy_files(spark, sf_dir), cat.devices(spark, sf_dir), ME)
    declined = spark.createDataFrame([("dev-1",), ("dev-2",)], "device_uuid string")
    return M.rewrite_stats(plan, declined)


@register("C6_F13_backfill_owner", views=("legacy_devices",), sql=f"""
SELECT id, uuid, mount_path, label, first_seen, last_seen,
  CASE WHEN COALESCE(system_id, '') IN ('', 'migration') THEN 'sys-9' ELSE system_id END AS system_id,
  CASE WHEN COALESCE(system_id, '') IN ('', 'migration') THEN {AS_OF_SQL} ELSE last_sync END AS last_sync,
  is_active
FROM legacy_devices""")
def c6_backfill_owner(spark, sf_dir):
    return M.backfill_owner(cat.legacy_devices(spark, sf_dir), "sys-9", AS_OF)


@register("C6_add_system_id_column", views=("devices",), sql="""
SELECT id, uuid, mount_path, label, first_seen, last_seen, last_sync, is_active, 'sys-9' AS system_id
FROM devices""")
def c6_add_column(spark, sf_dir):
    return M.backfill_owner(cat.devices(spark, sf_dir).drop("system_id"), "sys-9")


@register("A2_C7_duplicate_device_keys", views=("legacy_devices",), sql="""
WITH b AS (SELECT uuid, CASE WHEN COALESCE(system_id, '') IN ('', 'migration') THEN 'sys-1' ELSE system_id END
                  AS system_id FROM legacy_devices)
SELECT uuid, system_id, COUNT(*) AS count FROM b GROUP BY uuid, system_id HAVING COUNT(*) > 1""")
def a2_duplicate_device_keys(spark, sf_dir):
    b = M.backfill_owner(cat.legacy_devices(spark, sf_dir), "sys-1")
    return M.duplicate_keys(b, ["uuid", "system_id"])


@register("A3_duplicate_file_keys", views=("file_batch",), sql="""
SELECT device_uuid, path, system_id, COUNT(*) AS count FROM file_batch
GROUP BY device_uuid, path, system_id HAVING COUNT(*) > 1""")
def a3_duplicate_file_keys(spark, sf_dir):
    return M.duplicate_keys(cat.file_batch(spark, sf_dir), ["device_uuid", "path", "system_id"])


@register("K9_S9_migrate_devices", views=("devices",), sql=f"""
WITH t AS (SELECT * FROM devices QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY id) = 1),
s AS (SELECT CASE WHEN id % 5 = 0 THEN uuid || '-old' ELSE uuid END AS uuid, mount_path, label, first_seen, last_seen
      FROM devices
      QUALIFY row_number() OVER (PARTITION BY CASE WHEN id % 5 = 0 THEN uuid || '-old' ELSE uuid END
                                 ORDER BY last_seen DESC, id DESC) = 1),
j AS (SELECT t.*, s.uuid AS s_uuid, s.mount_path AS s_mount, s.label AS s_label, s.first_seen AS s_fs,
             s.last_seen AS s_ls FROM t FULL OUTER JOIN s ON t.uuid = s.uuid)
SELECT CASE WHEN id IS NOT NULL THEN id
            ELSE (SELECT MAX(id) FROM t) + row_number() OVER (PARTITION BY id IS NULL ORDER BY s_uuid) END AS id,
  COALESCE(uuid, s_uuid) AS uuid,
  CASE WHEN s_uuid IS NOT NULL THEN s_mount ELSE mount_path END AS mount_path,
  CASE WHEN s_uuid IS NOT NULL THEN s_label ELSE label END AS label,
  CASE WHEN id IS NULL THEN s_fs ELSE first_seen END AS first_seen,
  CASE WHEN s_uuid IS NOT NULL THEN s_ls ELSE last_seen END AS last_seen,
  CASE WHEN id IS NULL THEN 'migration' ELSE system_id END AS system_id,
  CASE WHEN s_uuid IS NOT NULL THEN {AS_OF_SQL} ELSE last_sync END AS last_sync,
  CASE WHEN id IS NULL THEN true ELSE is_active END AS is_active
FROM j""")
def k9_migrate_devices(spark, sf_dir):
    d = cat.devices(spark, sf_dir)
    # the legacy table is read by position (S9): id, uuid, mount_path, label, first_seen, last_seen;
    # both sides are whole tables, one row per uuid (target: the first, legacy: the newest)
    old = d.withColumn("uuid", F.when(F.col("id") % 5 == 0, F.concat("uuid", F.lit("-old"))).otherwise(F.col("uuid")))
    legacy = M.read_positional(old.drop("system_id"), ["id", "uuid", "mount_path", "label", "first_seen", "last_seen"])
    legacy = latest_per_key(legacy, ["uuid"], F.struct("last_seen", "id"))
    return M.migrate_devices(latest_per_key(d, ["uuid"], -F.col("id")).select(*d.columns), legacy, AS_OF).table


@register("K10_migrate_files", views=("files", "file_batch"), sql=f"""
WITH s AS (SELECT device_uuid, path, hash, size, modified_time, modified_time + INTERVAL 1 DAY AS scanned_time
           FROM file_batch WHERE error IS NULL
           QUALIFY row_number() OVER (PARTITION BY device_uuid, path ORDER BY ord DESC, ord2 DESC) = 1),
j AS (SELECT f.*, s.device_uuid AS s_dev, s.path AS s_path, s.hash AS s_hash, s.size AS s_size,
             s.modified_time AS s_mt, s.scanned_time AS s_st
      FROM files f FULL OUTER JOIN s ON f.device_uuid = s.device_uuid AND f.path = s.path)
SELECT CASE WHEN id IS NOT NULL THEN id
            ELSE (SELECT MAX(id) FROM files) + row_number() OVER (PARTITION BY id IS NULL ORDER BY s_dev, s_path) END AS id,
  COALESCE(device_uuid, s_dev) AS device_uuid, COALESCE(path, s_path) AS path,
  CASE WHEN s_dev IS NOT NULL THEN s_hash ELSE hash END AS hash,
  CASE WHEN s_dev IS NOT NULL THEN s_size ELSE size END AS size,
  CASE WHEN s_dev IS NOT NULL THEN s_mt ELSE modified_time END AS modified_time,
  CASE WHEN s_dev IS NOT NULL THEN s_st ELSE scanned_time END AS scanned_time,
  last_accessed,
  CASE WHEN id IS NULL THEN 'migration' ELSE system_id END AS system_id,
  CASE WHEN s_dev IS NOT NULL THEN {AS_OF_SQL} ELSE last_sync END AS last_sync
FROM j""")
def k10_migrate_files(spark, sf_dir):
    b = cat.file_batch(spark, sf_dir).where(F.col("error").isNull())
    b = latest_per_key(b, ["device_uuid", "path"], ORDER())
    b = b.withColumn("scanned_time", F.col("modified_time") + F.expr("INTERVAL 1 DAY"))
    return M.migrate_files(cat.files(spark, sf_dir), b, AS_OF).table


@register("K11_migrate_scan_progress", views=("scan_progress", "scan_events"), sql=f"""
WITH t AS (SELECT * FROM scan_progress QUALIFY row_number() OVER (PARTITION BY device_uuid ORDER BY id) = 1),
s AS (SELECT device_uuid, COUNT(*) AS total_files, COUNT(*) FILTER (WHERE op = 'upsert') AS new_files,
             MAX(ts) AS last_updated FROM scan_events GROUP BY device_uuid),
j AS (SELECT t.*, s.device_uuid AS s_dev, s.total_files AS s_total, s.new_files AS s_new, s.last_updated AS s_lu
      FROM t FULL OUTER JOIN s ON t.device_uuid = s.device_uuid)
SELECT CASE WHEN id IS NOT NULL THEN id
            ELSE (SELECT MAX(id) FROM t) + row_number() OVER (PARTITION BY id IS NULL ORDER BY s_dev) END AS id,
  COALESCE(device_uuid, s_dev) AS device_uuid,
  CASE WHEN id IS NULL THEN 'migration' ELSE system_id END AS system_id,
  CASE WHEN s_dev IS NOT NULL THEN s_total ELSE total_files END AS total_files,
  CASE WHEN s_dev IS NOT NULL THEN s_new ELSE new_files END AS new_files,
  CASE WHEN s_dev IS NOT NULL THEN s_lu ELSE last_updated END AS last_updated,
  CASE WHEN s_dev IS NOT NULL THEN {AS_OF_SQL} ELSE last_sync END AS last_sync
FROM j""")
def k11_migrate_scan_progress(spark, sf_dir):
    e = cat.scan_events(spark, sf_dir)
    s = e.groupBy("device_uuid").agg(F.count("*").alias("total_files"),
                                     F.count_if(F.col("op") == "upsert").alias("new_files"),
                                     F.max("ts").alias("last_updated"))
    p = cat.scan_progress(spark, sf_dir)
    t = latest_per_key(p, ["device_uuid"], -F.col("id")).select(*p.columns)  # one row per device: the first
    return M.migrate_scan_progress(t, s, AS_OF).table


@register("K12_X27_migrate_image_analysis", views=("image_analysis_full",), sql=f"""
SELECT * FROM image_analysis_full
UNION ALL
SELECT file_id, camera_model, taken_time, gps_lat, gps_lon, CAST(CAST(has_faces AS INT) AS BOOLEAN), objects,
  CAST(NULL AS INTEGER), CAST(NULL AS INTEGER),
  (SELECT MAX(id) FROM image_analysis_full)
    + row_number() OVER (ORDER BY file_id, taken_time + INTERVAL 1 DAY) AS id,
  taken_time + INTERVAL 1 DAY, 'migration', {AS_OF_SQL}
FROM image_analysis""")
def k12_migrate_image_analysis(spark, sf_dir):
    legacy = cat.image_analysis(spark, sf_dir).withColumns(  # an older table without sizes
        {c: F.lit(None).cast("int") for c in ("width", "height")})
    legacy = legacy.withColumn("has_faces", F.col("has_faces").cast("int")) \
                   .withColumn("analyzed_time", F.col("taken_time") + F.expr("INTERVAL 1 DAY"))
    return M.migrate_image_analysis(cat.image_analysis_full(spark, sf_dir), legacy, AS_OF)
