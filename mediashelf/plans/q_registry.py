"""Queries: device registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from ..sources import catalogue as cat
from .q_upsert import AS_OF, AS_OF_SQL
from .registry import register


def _k4_sql(seen: str) -> str:
    return f"""
WITH s AS (SELECT DISTINCT uuid, mount_path, label
           FROM {seen} WHERE COALESCE(uuid, '') <> ''),
j AS (SELECT d.*, s.uuid AS s_uuid, s.mount_path AS s_mount, s.label AS s_label
      FROM devices d FULL OUTER JOIN s ON d.uuid = s.uuid AND d.system_id = 'sys-1'),
u AS (
  SELECT
    CASE WHEN id IS NOT NULL THEN id
         ELSE (SELECT MAX(id) FROM devices) + row_number() OVER (PARTITION BY id IS NULL ORDER BY s_uuid) END AS id,
    COALESCE(uuid, s_uuid) AS uuid,
    CASE WHEN s_uuid IS NOT NULL THEN s_mount ELSE mount_path END AS mount_path,
    CASE WHEN s_uuid IS NOT NULL THEN s_label ELSE label END AS label,
    CASE WHEN id IS NULL THEN {AS_OF_SQL} ELSE first_seen END AS first_seen,
    CASE WHEN s_uuid IS NOT NULL THEN {AS_OF_SQL} ELSE last_seen END AS last_seen,
    COALESCE(system_id, 'sys-1') AS system_id,
    CASE WHEN id IS NOT NULL AND s_uuid IS NOT NULL THEN {AS_OF_SQL} ELSE last_sync END AS last_sync,
    CASE WHEN s_uuid IS NOT NULL THEN true ELSE is_active END AS is_active
  FROM j)
SELECT id, uuid, mount_path, label, first_seen, last_seen, system_id,
  CASE WHEN system_id = 'sys-1' AND is_active AND uuid NOT IN (SELECT uuid FROM {seen})
       THEN {AS_OF_SQL} ELSE last_sync END AS last_sync,
  CASE WHEN system_id = 'sys-1' AND is_active AND uuid NOT IN (SELECT uuid FROM {seen})
       THEN false ELSE is_active END AS is_active
FROM u"""


@register("K4_J7_register_devices", views=("devices", "seen_devices"), sql=_k4_sql("seen_devices"))
def k4_register_devices(spark, sf_dir):
    return R.register_devices(cat.devices(spark, sf_dir), cat.seen_devices(spark, sf_dir), "sys-1", AS_OF).table


@register("K4_J7_register_devices_null_uuid", views=("devices", "seen_devices"), sql=_k4_sql(
    "(SELECT * FROM seen_devices UNION ALL SELECT NULL, '/Volumes/none', 'none')"))
def k4_register_devices_null(spark, sf_dir):
    seen = cat.seen_devices(spark, sf_dir, with_null=True)
    return R.register_devices(cat.devices(spark, sf_dir), seen, "sys-1", AS_OF).table


@register("K4_register_changes", views=("devices", "seen_devices"), sql="""
SELECT CASE WHEN d.id IS NULL THEN 'insert' ELSE 'update' END AS action, COUNT(*) AS rows
FROM (SELECT DISTINCT uuid FROM seen_devices WHERE COALESCE(uuid, '') <> '') s
LEFT JOIN devices d ON d.uuid = s.uuid AND d.system_id = 'sys-1'
GROUP BY 1""")
def k4_register_changes(spark, sf_dir):
    return R.register_devices(cat.devices(spark, sf_dir), cat.seen_devices(spark, sf_dir), "sys-1", AS_OF).counts()


@register("J7_mark_inactive", views=("devices",), sql=f"""
SELECT id, uuid, mount_path, label, first_seen, last_seen, system_id,
  CASE WHEN system_id = 'sys-2' AND is_active AND uuid NOT IN (
         SELECT uuid FROM devices WHERE system_id = 'sys-2' AND label IS NOT NULL)
       THEN {AS_OF_SQL} ELSE last_sync END AS last_sync,
  CASE WHEN system_id = 'sys-2' AND is_active AND uuid NOT IN (
         SELECT uuid FROM devices WHERE system_id = 'sys-2' AND label IS NOT NULL)
       THEN false ELSE is_active END AS is_active
FROM devices""")
def j7_mark_inactive(spark, sf_dir):
    d = cat.devices(spark, sf_dir)
    active = d.where((F.col("system_id") == "sys-2") & F.col("label").isNotNull()).select("uuid")
    return R.mark_inactive(d, active, "sys-2", AS_OF)


@register("W1_newest_mount_point", views=("device_mount_points",), sql="""
SELECT device_uuid, system_id, id, mount_path, last_updated FROM device_mount_points
QUALIFY row_number() OVER (PARTITION BY device_uuid, system_id
                           ORDER BY last_updated DESC NULLS FIRST, id DESC) = 1""")
def w1_newest_mount_point(spark, sf_dir):
    return R.newest_per_key(cat.device_mount_points(spark, sf_dir), ["device_uuid", "system_id"], "last_updated")


@register("J10_device_mount_point", views=("files", "devices", "device_mount_points"), sql="""
WITH r AS (SELECT DISTINCT device_uuid, system_id FROM files),
mp AS (SELECT device_uuid, system_id, mount_path FROM device_mount_points
       QUALIFY row_number() OVER (PARTITION BY device_uuid, system_id
                                  ORDER BY last_updated DESC NULLS FIRST, id DESC) = 1),
d AS (SELECT uuid, system_id, arg_min(mount_path, id) AS d_mount FROM devices GROUP BY uuid, system_id)
SELECT r.device_uuid, r.system_id, COALESCE(mp.mount_path, d.d_mount) AS mount_path
FROM r LEFT JOIN mp ON r.device_uuid = mp.device_uuid AND r.system_id = mp.system_id
LEFT JOIN d ON r.device_uuid = d.uuid AND r.system_id = d.system_id""")
def j10_device_mount_point(spark, sf_dir):
    req = cat.files(spark, sf_dir).select("device_uuid", "system_id").distinct()
    return R.device_mount_point(req, cat.device_mount_points(spark, sf_dir), cat.devices(spark, sf_dir))


_PROGRESS_BATCH = """
b AS (SELECT device_uuid, system_id, COUNT(*) AS total_files,
             COUNT(*) FILTER (WHERE op = 'upsert') AS new_files
      FROM scan_events GROUP BY device_uuid, system_id)"""


def _progress_batch(spark, sf_dir):
    return cat.scan_events(spark, sf_dir).groupBy("device_uuid", "system_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("op") == "upsert").alias("new_files"))


@register("K5_progress_upsert", views=("scan_progress", "scan_events"), sql=f"""
WITH {_PROGRESS_BATCH},
j AS (SELECT p.*, b.device_uuid AS b_dev, b.system_id AS b_sys, b.total_files AS b_total, b.new_files AS b_new
      FROM scan_progress p FULL OUTER JOIN b ON p.device_uuid = b.device_uuid AND p.system_id = b.system_id)
SELECT
  CASE WHEN id IS NOT NULL THEN id
       ELSE (SELECT MAX(id) FROM scan_progress)
            + row_number() OVER (PARTITION BY id IS NULL ORDER BY b_dev, b_sys) END AS id,
  COALESCE(device_uuid, b_dev) AS device_uuid, COALESCE(system_id, b_sys) AS system_id,
  CASE WHEN b_dev IS NOT NULL THEN b_total ELSE total_files END AS total_files,
  CASE WHEN b_dev IS NOT NULL THEN b_new ELSE new_files END AS new_files,
  CASE WHEN b_dev IS NOT NULL THEN {AS_OF_SQL} ELSE last_updated END AS last_updated,
  CASE WHEN id IS NOT NULL AND b_dev IS NOT NULL THEN {AS_OF_SQL} ELSE last_sync END AS last_sync
FROM j""")
def k5_progress_upsert(spark, sf_dir):
    return R.upsert_progress(cat.scan_progress(spark, sf_dir), _progress_batch(spark, sf_dir), AS_OF)


@register("K6_progress_device_scope", views=("scan_progress", "scan_events"), sql=f"""
WITH e AS (SELECT device_uuid, system_id, COUNT(*) AS total_files,
                  COUNT(*) FILTER (WHERE op = 'upsert') AS new_files, MAX(ts) AS last_ts
           FROM scan_events GROUP BY device_uuid, system_id),
b AS (SELECT device_uuid, system_id, total_files, new_files FROM e
      QUALIFY row_number() OVER (PARTITION BY device_uuid ORDER BY last_ts DESC, system_id DESC) = 1),
upd AS (SELECT p.id, p.device_uuid, p.system_id,
          CASE WHEN b.device_uuid IS NOT NULL THEN b.total_files ELSE p.total_files END AS total_files,
          CASE WHEN b.device_uuid IS NOT NULL THEN b.new_files ELSE p.new_files END AS new_files,
          CASE WHEN b.device_uuid IS NOT NULL THEN {AS_OF_SQL} ELSE p.last_updated END AS last_updated,
          CASE WHEN b.device_uuid IS NOT NULL THEN {AS_OF_SQL} ELSE p.last_sync END AS last_sync
        FROM scan_progress p LEFT JOIN b ON p.device_uuid = b.device_uuid),
ins AS (SELECT (SELECT MAX(id) FROM scan_progress) + row_number() OVER (ORDER BY device_uuid, system_id) AS id,
          device_uuid, system_id, total_files, new_files, {AS_OF_SQL} AS last_updated,
          CAST(NULL AS TIMESTAMP) AS last_sync
        FROM b WHERE device_uuid NOT IN (SELECT device_uuid FROM scan_progress))
SELECT * FROM upd UNION ALL SELECT * FROM ins""")
def k6_progress_device_scope(spark, sf_dir):
    # all systems' reports; per device the one that was written last counts
    e = cat.scan_events(spark, sf_dir).groupBy("device_uuid", "system_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("op") == "upsert").alias("new_files"),
        F.struct(F.max("ts"), "system_id").alias("written"))
    return R.upsert_progress(cat.scan_progress(spark, sf_dir), e, AS_OF, scope="device", order_col="written")


_RESTORE_SQL = """
WITH f AS (SELECT id AS file_id, device_uuid, path AS rel_path FROM files
           WHERE device_uuid IN (SELECT uuid FROM devices)),
r AS (SELECT DISTINCT device_uuid FROM f),
mp AS (SELECT device_uuid, mount_path FROM device_mount_points WHERE system_id = 'sys-0'
       QUALIFY row_number() OVER (PARTITION BY device_uuid, system_id
                                  ORDER BY last_updated DESC NULLS FIRST, id DESC) = 1),
d AS (SELECT uuid, arg_min(mount_path, id) AS d_mount FROM devices WHERE system_id = 'sys-0' GROUP BY uuid),
m AS (SELECT r.device_uuid, COALESCE(mp.mount_path, d.d_mount) AS mount_path FROM r
      LEFT JOIN mp ON r.device_uuid = mp.device_uuid LEFT JOIN d ON r.device_uuid = d.uuid),
fp AS (SELECT f.file_id, CASE WHEN COALESCE(m.mount_path, '') = '' THEN NULL
                 WHEN starts_with(f.rel_path, '/') THEN f.rel_path
                 WHEN ends_with(m.mount_path, '/') THEN m.mount_path || f.rel_path
                 ELSE m.mount_path || '/' || f.rel_path END AS full_path
         FROM f LEFT JOIN m ON f.device_uuid = m.device_uuid),
live AS (SELECT DISTINCT fp.full_path AS path FROM fp JOIN files x ON fp.file_id = x.id
         WHERE fp.full_path IS NOT NULL AND EXISTS (
           SELECT 1 FROM file_batch b WHERE b.error IS NULL AND b.device_uuid = x.device_uuid AND b.path = x.path))
SELECT o.id AS file_id, CASE WHEN fp.full_path IN (SELECT path FROM live) THEN fp.full_path END AS full_path
FROM files o LEFT JOIN fp ON o.id = fp.file_id"""


@register("J3_J12_restore_paths", views=("files", "devices", "device_mount_points", "file_batch"), sql=_RESTORE_SQL)
def j3_restore_paths(spark, sf_dir):
    files = cat.files(spark, sf_dir)
    devices = cat.devices(spark, sf_dir)
    mps = cat.device_mount_points(spark, sf_dir)
    # the live listing: full paths of the files the rescan saw (error-free rows)
    seen = cat.file_batch(spark, sf_dir).where(F.col("error").isNull()).select("device_uuid", "path").distinct()
    seen_ids = files.join(seen, ["device_uuid", "path"], "left_semi").select(F.col("id").alias("file_id"))
    all_paths = R.restore_paths(files.select(F.col("id").alias("file_id")), files, devices, mps, "sys-0")
    listing = all_paths.join(seen_ids, "file_id", "left_semi").select(F.col("full_path").alias("path")) \
        .where(F.col("path").isNotNull())
    return R.restore_paths(files.select(F.col("id").alias("file_id")), files, devices, mps, "sys-0", listing)


@register("J7_mark_inactive_empty_list", views=("devices",), sql="""
SELECT id, uuid, mount_path, label, first_seen, last_seen, system_id, last_sync, is_active FROM devices""")
def j7_mark_inactive_empty(spark, sf_dir):
    d = cat.devices(spark, sf_dir)
    # an empty active list (a contradiction keeps no row): NOT IN () must change nothing
    active = d.where(F.col("label").isNull() & F.col("label").isNotNull()).select("uuid")
    return R.mark_inactive(d, active, "sys-2", AS_OF)
