"""Queries: ownership sync."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sync as S
from ..sources import catalogue as cat
from .registry import register

ME = "sys-1"
SYNC_AS_OF = "1996-01-01 00:00:00"
NOW = f"TIMESTAMP '{SYNC_AS_OF}'"
CUT = "TIMESTAMP '1995-12-31 23:55:00'"
DIRTY = f"COALESCE(last_sync < {CUT} OR system_id <> '{ME}', false)"
ACTED = f"{DIRTY} AND system_id IS DISTINCT FROM '{ME}'"
KEEP1 = "QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY last_sync DESC NULLS LAST, id DESC) = 1"


@register("F11_F12_dirty_files", views=("files",), sql=f"""
SELECT id, device_uuid, path, system_id, last_sync, system_id IS DISTINCT FROM '{ME}' AS acted
FROM files WHERE {DIRTY}""")
def f11_dirty_files(spark, sf_dir):
    f = cat.files(spark, sf_dir)
    return f.where(S.dirty(f, ME, S.cutoff_of(SYNC_AS_OF))).select(
        "id", "device_uuid", "path", "system_id", "last_sync",
        (~F.col("system_id").eqNullSafe(F.lit(ME))).alias("acted"))


def _t1_sql(present: str | None) -> str:
    if present is None:
        x = f"x AS (SELECT DISTINCT uuid, true AS present FROM devices WHERE {ACTED})"
    else:
        x = f"""a AS (SELECT DISTINCT uuid FROM devices WHERE {ACTED}),
x AS (SELECT a.uuid, p.uuid IS NOT NULL AS present FROM a LEFT JOIN ({present}) p ON a.uuid = p.uuid)"""
    return f"""
WITH {x},
u AS (SELECT d.id, d.uuid, d.mount_path, d.label, d.first_seen,
        CASE WHEN x.present THEN {NOW} ELSE d.last_seen END AS last_seen,
        CASE WHEN x.present THEN '{ME}' ELSE d.system_id END AS system_id,
        CASE WHEN x.uuid IS NOT NULL THEN {NOW} ELSE d.last_sync END AS last_sync,
        CASE WHEN x.present THEN true WHEN x.uuid IS NOT NULL THEN false ELSE d.is_active END AS is_active
      FROM devices d LEFT JOIN x ON d.uuid = x.uuid)
SELECT * FROM u {KEEP1.format(k='uuid, system_id')}"""


_T1_SQL = _t1_sql(None)


@register("T1_sync_devices", views=("devices",), sql=_T1_SQL)
def t1_sync_devices(spark, sf_dir):
    return S.sync_devices(cat.devices(spark, sf_dir), ME, SYNC_AS_OF)


_PRESENT_UUIDS = "SELECT DISTINCT device_uuid AS uuid FROM scan_events WHERE op = 'delete' AND size > 500"


def _present_uuids(spark, sf_dir):
    e = cat.scan_events(spark, sf_dir)
    return e.where((F.col("op") == "delete") & (F.col("size") > 500)).select(F.col("device_uuid").alias("uuid"))


@register("T1_J9_sync_devices_present", views=("devices", "scan_events"), sql=_t1_sql(_PRESENT_UUIDS))
def t1_sync_devices_present(spark, sf_dir):
    return S.sync_devices(cat.devices(spark, sf_dir), ME, SYNC_AS_OF, _present_uuids(spark, sf_dir))


_T2_CTES = f"""
a2 AS (SELECT * FROM files WHERE {ACTED}),
w2 AS (SELECT device_uuid, path, hash, size, modified_time, scanned_time FROM a2
       QUALIFY row_number() OVER (PARTITION BY device_uuid, path ORDER BY id DESC) = 1),
p2 AS (SELECT DISTINCT device_uuid, path FROM file_batch WHERE error IS NULL),
x2 AS (SELECT w2.*, p2.device_uuid IS NOT NULL AS present FROM w2
       LEFT JOIN p2 ON w2.device_uuid = p2.device_uuid AND w2.path = p2.path),
u2 AS (SELECT f.id, f.device_uuid, f.path,
         CASE WHEN x2.present THEN x2.hash ELSE f.hash END AS hash,
         CASE WHEN x2.present THEN x2.size ELSE f.size END AS size,
         CASE WHEN x2.present THEN x2.modified_time ELSE f.modified_time END AS modified_time,
         CASE WHEN x2.present THEN x2.scanned_time ELSE f.scanned_time END AS scanned_time,
         f.last_accessed,
         CASE WHEN x2.present THEN '{ME}' ELSE f.system_id END AS system_id,
         CASE WHEN x2.present THEN {NOW} ELSE f.last_sync END AS last_sync
       FROM files f LEFT JOIN x2 ON f.device_uuid = x2.device_uuid AND f.path = x2.path
       WHERE NOT COALESCE(x2.present = false, false)),
files2 AS (SELECT * FROM u2 {KEEP1.format(k='device_uuid, path, system_id')})"""


def _present_files(spark, sf_dir):
    return cat.file_batch(spark, sf_dir).where(F.col("error").isNull()).select("device_uuid", "path")


def _t2(spark, sf_dir):
    return S.sync_files(cat.files(spark, sf_dir), ME, SYNC_AS_OF, _present_files(spark, sf_dir))


@register("T2_J9_sync_files", views=("files", "file_batch"), sql=f"WITH {_T2_CTES}\nSELECT * FROM files2")
def t2_sync_files(spark, sf_dir):
    return _t2(spark, sf_dir)


_T3_SQL = f"""
WITH a AS (SELECT * FROM scan_progress WHERE {ACTED}),
w AS (SELECT device_uuid, total_files, new_files, last_updated FROM a
      QUALIFY row_number() OVER (PARTITION BY device_uuid ORDER BY id DESC) = 1),
u AS (SELECT p.id, p.device_uuid,
        CASE WHEN w.device_uuid IS NOT NULL THEN w.total_files ELSE p.total_files END AS total_files,
        CASE WHEN w.device_uuid IS NOT NULL THEN w.new_files ELSE p.new_files END AS new_files,
        CASE WHEN w.device_uuid IS NOT NULL THEN w.last_updated ELSE p.last_updated END AS last_updated,
        CASE WHEN w.device_uuid IS NOT NULL THEN '{ME}' ELSE p.system_id END AS system_id,
        CASE WHEN w.device_uuid IS NOT NULL THEN {NOW} ELSE p.last_sync END AS last_sync
      FROM scan_progress p LEFT JOIN w ON p.device_uuid = w.device_uuid)
SELECT * FROM u {KEEP1.format(k='device_uuid, system_id')}"""


@register("T3_sync_scan_progress", views=("scan_progress",), sql=_T3_SQL)
def t3_sync_scan_progress(spark, sf_dir):
    return S.sync_scan_progress(cat.scan_progress(spark, sf_dir), ME, SYNC_AS_OF)


_IA_VALS = ["camera_model", "taken_time", "gps_lat", "gps_lon", "has_faces", "objects", "width", "height", "analyzed_time"]


_T4_SQL = f"""
WITH a4 AS (SELECT * FROM image_analysis_full WHERE {ACTED}),
w4 AS (SELECT file_id, {', '.join(_IA_VALS)} FROM a4
       QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY id DESC) = 1),
x4 AS (SELECT w4.*, EXISTS (SELECT 1 FROM files2 f WHERE f.id = w4.file_id) AS present FROM w4)
SELECT i.id, i.file_id,
  {', '.join(f'CASE WHEN x4.present THEN x4.{c} ELSE i.{c} END AS {c}' for c in _IA_VALS)},
  CASE WHEN x4.present THEN '{ME}' ELSE i.system_id END AS system_id,
  CASE WHEN x4.present THEN {NOW} ELSE i.last_sync END AS last_sync
FROM image_analysis_full i LEFT JOIN x4 ON i.file_id = x4.file_id
WHERE NOT COALESCE(x4.present = false, false)"""


@register("T4_T5_sync_image_analysis", views=("files", "file_batch", "image_analysis_full"),
          sql=f"WITH {_T2_CTES}\n{_T4_SQL.replace('WITH a4', ', a4', 1)}")
def t4_sync_image_analysis(spark, sf_dir):
    rnd = S.sync_all(cat.devices(spark, sf_dir), cat.files(spark, sf_dir), cat.scan_progress(spark, sf_dir),
                     cat.image_analysis_full(spark, sf_dir), ME, SYNC_AS_OF,
                     present_files=_present_files(spark, sf_dir))
    return rnd.image_analysis


@register("A11_T5_sync_round_counts", views=("devices", "files", "scan_progress", "image_analysis_full"), sql=f"""
SELECT 'devices' AS table_name, 'processed' AS operation, COUNT(*) AS rows FROM devices WHERE {DIRTY}
UNION ALL SELECT 'files', 'processed', COUNT(*) FROM files WHERE {DIRTY}
UNION ALL SELECT 'scan_progress', 'processed', COUNT(*) FROM scan_progress WHERE {DIRTY}
UNION ALL SELECT 'image_analysis', 'processed', COUNT(*) FROM image_analysis_full WHERE {DIRTY}""")
def a11_sync_round_counts(spark, sf_dir):
    rnd = S.sync_all(cat.devices(spark, sf_dir), cat.files(spark, sf_dir), cat.scan_progress(spark, sf_dir),
                     cat.image_analysis_full(spark, sf_dir), ME, SYNC_AS_OF)
    return rnd.log


def _log_sql(name: str, before: str, after: str) -> str:
    """Log rows of one table by comparing its rows before and after the round."""
    return f"""
SELECT '{name}' AS table_name, CAST(b.id AS VARCHAR) AS record_id, 'delete' AS operation,
  '{ME}' AS system_id, {NOW} AS sync_time
FROM {before} b WHERE b.id NOT IN (SELECT id FROM {after})
UNION ALL
SELECT '{name}', CAST(n.id AS VARCHAR), 'update', '{ME}', {NOW}
FROM {after} n JOIN {before} o ON n.id = o.id
WHERE n.last_sync IS NOT DISTINCT FROM {NOW} AND o.last_sync IS DISTINCT FROM {NOW}"""


def _round_sql() -> str:
    """CTEs ``files2, devices2, progress2, analysis2``: the four tables after one round."""
    return f"""{_T2_CTES},
devices2 AS ({_T1_SQL}),
progress2 AS ({_T3_SQL}),
analysis2 AS ({_T4_SQL})"""


@register("T5_sync_change_log", views=("devices", "files", "scan_progress", "file_batch", "image_analysis_full"), sql=f"""
WITH {_round_sql()}
{_log_sql('devices', 'devices', 'devices2')} UNION ALL {_log_sql('files', 'files', 'files2')}
UNION ALL {_log_sql('scan_progress', 'scan_progress', 'progress2')}
UNION ALL {_log_sql('image_analysis', 'image_analysis_full', 'analysis2')}""")
def t5_sync_change_log(spark, sf_dir):
    rnd = S.sync_all(cat.devices(spark, sf_dir), cat.files(spark, sf_dir), cat.scan_progress(spark, sf_dir),
                     cat.image_analysis_full(spark, sf_dir), ME, SYNC_AS_OF,
                     present_files=_present_files(spark, sf_dir))
    return rnd.changes
