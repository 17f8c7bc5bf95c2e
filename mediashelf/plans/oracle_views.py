"""The derived catalogue views as plain SQL, for the DuckDB oracle.

Same rows as ``mediashelf.sources.catalogue``; each oracle query is prefixed with the
views it names as common table expressions.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "devices": """
SELECT s_suppkey + 1 AS id,
  'dev-' || CAST(CAST(FLOOR(s_suppkey / 3) AS INT) AS VARCHAR) AS uuid,
  CASE s_suppkey % 3 WHEN 0 THEN '/Volumes/Disk' || CAST(CAST(FLOOR(s_suppkey / 3) AS INT) AS VARCHAR)
    WHEN 1 THEN '/media/u/Disk' || CAST(CAST(FLOOR(s_suppkey / 3) AS INT) AS VARCHAR) ELSE 'D:' END AS mount_path,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS label,
  TIMESTAMP '1995-01-01 00:00:00' AS first_seen, TIMESTAMP '2001-01-01 00:00:00' AS last_seen,
  'sys-' || CAST(s_suppkey % 3 AS VARCHAR) AS system_id,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE TIMESTAMP '1999-06-01 00:00:00' END AS last_sync,
  s_acctbal > 0 AS is_active
FROM supplier""",
    "files": """
SELECT o_orderkey AS id, 'dev-' || CAST(o_custkey % 34 AS VARCHAR) AS device_uuid,
  'dir' || CAST(o_custkey % 7 AS VARCHAR) || '/' || lower(o_orderpriority) || '/f' || CAST(o_orderkey AS VARCHAR) ||
  CASE o_orderkey % 12 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.jpeg' WHEN 3 THEN '.png'
    WHEN 4 THEN '.gif' WHEN 5 THEN '.mp4' WHEN 6 THEN '.mov' WHEN 7 THEN '.avi' WHEN 8 THEN '.mkv'
    WHEN 9 THEN '.mp3' WHEN 10 THEN '.pdf' ELSE '' END AS path,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE md5(CAST(o_custkey AS VARCHAR)) END AS hash,
  CAST(FLOOR(o_totalprice * 1000) AS BIGINT) AS size,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderdate END AS modified_time,
  o_orderdate + INTERVAL '30' DAY AS scanned_time, CAST(NULL AS TIMESTAMP) AS last_accessed,
  CASE WHEN o_orderkey % 23 = 0 THEN 'migration' ELSE 'sys-' || CAST(o_orderkey % 3 AS VARCHAR) END AS system_id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL '60' DAY END AS last_sync
FROM orders""",
    "detections": """
SELECT l_orderkey AS file_id, CASE l_suppkey % 6 WHEN 0 THEN 'person' WHEN 1 THEN 'dog' WHEN 2 THEN 'car'
    WHEN 3 THEN 'cat' WHEN 4 THEN 'tree' ELSE 'face' END AS label,
  l_discount * 10 AS confidence
FROM lineitem""",
    "image_analysis": """
SELECT o_orderkey AS file_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'iPhone 12' WHEN 1 THEN 'Canon EOS R5' WHEN 2 THEN 'NIKON Z6' ELSE NULL END AS camera_model,
  o_orderdate AS taken_time,
  CAST(o_custkey % 180 AS DOUBLE) - 90 AS gps_lat, CAST(o_custkey % 360 AS DOUBLE) - 180 AS gps_lon,
  o_custkey % 2 = 0 AS has_faces,
  CASE o_custkey % 3 WHEN 0 THEN '["dog","person"]' WHEN 1 THEN '["car"]' ELSE NULL END AS objects
FROM orders WHERE o_orderkey % 12 < 5""",
    "image_analysis_full": """
SELECT i.*, CAST(o_custkey % 50 * 80 AS INTEGER) AS width, CAST(o_custkey % 40 * 60 AS INTEGER) AS height,
  o_orderkey * 10 AS id, o_orderdate + INTERVAL '90' DAY AS analyzed_time,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'sys-' || CAST(o_orderkey % 4 AS VARCHAR) END AS system_id,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate + INTERVAL '100' DAY END AS last_sync
FROM image_analysis i JOIN orders ON i.file_id = o_orderkey""",
    "scan_events": """
SELECT event_id, 'dev-' || CAST(user_id % 34 AS VARCHAR) AS device_uuid,
  'sys-' || CAST(user_id % 3 AS VARCHAR) AS system_id,
  'e/' || CAST(event_id % 500 AS VARCHAR) || '.jpg' AS path,
  CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
  CAST(FLOOR(value * 1000) AS BIGINT) AS size, ts
FROM events""",
    "stored_events": """
SELECT e.event_id, COALESCE(f.device_uuid, e.device_uuid) AS device_uuid, e.system_id,
  COALESCE(f.path, e.path) AS path, e.op, e.size, e.ts
FROM scan_events e LEFT JOIN files f ON e.event_id % 3 = 0 AND f.id = e.event_id""",
    "device_mount_points": """
SELECT o_orderkey AS id, 'dev-' || CAST(o_custkey % 40 + 20 AS VARCHAR) AS device_uuid,
  'sys-' || CAST(o_orderkey % 4 AS VARCHAR) AS system_id,
  '/mnt/m' || CAST(o_orderkey % 997 AS VARCHAR) AS mount_path,
  o_orderdate AS last_updated
FROM orders""",
    "scan_progress": """
SELECT device_uuid, system_id, MIN(id) AS id, COUNT(*) AS total_files,
  COUNT(*) FILTER (WHERE id % 2 = 0) AS new_files,
  MAX(scanned_time) AS last_updated, MAX(last_sync) AS last_sync
FROM files GROUP BY device_uuid, system_id""",
    "file_batch": """
SELECT f.device_uuid,
  CASE WHEN l_linenumber <= 2 THEN f.path ELSE f.path || '.v' || CAST(l_linenumber % 2 AS VARCHAR) END AS path,
  f.system_id, CAST(FLOOR(l_extendedprice * 1000) AS BIGINT) AS size,
  md5(CAST(l_partkey AS VARCHAR)) AS hash, l_shipdate AS modified_time,
  CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS ord,
  CAST(FLOOR(l_extendedprice * 100) AS BIGINT) AS ord2,
  CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 1 THEN 'stat failed' ELSE NULL END AS error
FROM files f JOIN lineitem ON f.id = l_orderkey""",
    "file_accesses": """
SELECT l_orderkey AS file_id, l_shipdate AS ts FROM lineitem""",
    "seen_devices": """
SELECT CASE WHEN n_regionkey = 0 THEN 'new-' || CAST(n_nationkey AS VARCHAR)
            ELSE 'dev-' || CAST(n_nationkey AS VARCHAR) END AS uuid,
  '/Volumes/' || n_name AS mount_path, n_name AS label
FROM nation""",
    "inventory_lines": r"""
WITH base AS (
  SELECT 'host-' || CAST(s_nationkey % 8 AS VARCHAR) AS host,
    CASE WHEN s_nationkey % 8 <= 2 THEN 'Linux' WHEN s_nationkey % 8 <= 4 THEN 'Darwin'
         WHEN s_nationkey % 8 <= 6 THEN 'Windows' ELSE 'Plan9' END AS os,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (s_suppkey // 64) HOUR AS captured_at, s_suppkey AS k,
    CASE s_suppkey % 5
      WHEN 0 THEN '/dev/sda' || CAST(s_suppkey AS VARCHAR) || ' U' || CAST(s_suppkey AS VARCHAR) || ' /media/u/Disk ' || CAST(s_suppkey AS VARCHAR)
      WHEN 1 THEN '/dev/sdb' || CAST(s_suppkey AS VARCHAR) || ' U' || CAST(s_suppkey AS VARCHAR) || ' /boot'
      WHEN 2 THEN '/dev/sdc' || CAST(s_suppkey AS VARCHAR) || ' U' || CAST(s_suppkey AS VARCHAR)
      WHEN 3 THEN '  /dev/sdd' || CAST(s_suppkey AS VARCHAR) || '   U' || CAST(s_suppkey AS VARCHAR) || '   /mnt/n' || CAST(s_nationkey AS VARCHAR) || '  '
      ELSE '/dev/sde' || CAST(s_suppkey AS VARCHAR) || ' U' || CAST(s_suppkey AS VARCHAR) || ' /' END AS linux,
    chr(CAST(65 + s_suppkey % 20 AS INTEGER)) || ': \\?\Volume{' || CAST(s_suppkey AS VARCHAR) || '}\' AS win,
    CASE WHEN s_suppkey % 9 = 0 THEN 'Device Identifier:' ELSE 'Device Identifier: disk' || CAST(s_suppkey AS VARCHAR) END AS mac0,
    CASE WHEN s_suppkey % 7 = 0 THEN '   Volume Name: X' ELSE '   Volume UUID: V' || CAST(s_suppkey % 50 AS VARCHAR) END AS mac1,
    '   Mount Point:   ' || CASE s_suppkey % 6 WHEN 0 THEN '/Volumes/Disk' || CAST(s_suppkey AS VARCHAR)
      WHEN 1 THEN '(not mounted)' WHEN 2 THEN '/Volumes/Recovery' || CAST(s_suppkey AS VARCHAR)
      WHEN 3 THEN '/Volumes/VM' WHEN 4 THEN '/' ELSE '/Volumes/Shared' || CAST(s_suppkey % 4 AS VARCHAR) END AS mac2,
    CASE WHEN s_suppkey % 4 = 0 THEN '   Mount Point: (not mounted)' ELSE '   Bus Protocol: USB' END AS mac3
  FROM supplier)
SELECT host, os, captured_at, k * 10 AS seq,
  CASE os WHEN 'Darwin' THEN mac0 WHEN 'Windows' THEN win ELSE linux END AS line FROM base
UNION ALL SELECT host, os, captured_at, k * 10 + 1, mac1 FROM base WHERE os = 'Darwin'
UNION ALL SELECT host, os, captured_at, k * 10 + 2, mac2 FROM base WHERE os = 'Darwin'
UNION ALL SELECT host, os, captured_at, k * 10 + 3, mac3 FROM base WHERE os = 'Darwin'""",
    "inventory_homes": """
SELECT DISTINCT 'host-' || CAST(n_nationkey % 8 AS VARCHAR) AS host,
  TIMESTAMP '2024-01-01 00:00:00' AS captured_at,
  'node.host-' || CAST(n_nationkey % 8 AS VARCHAR) || '.lan' AS node,
  CASE WHEN n_nationkey % 8 = 0 THEN '/mnt/n0' ELSE '/home/u' || CAST(n_nationkey % 8 AS VARCHAR) END AS home_dir
FROM nation""",
    "legacy_files": """
SELECT f.id, f.device_uuid,
  CASE WHEN f.id % 2 = 0 THEN COALESCE(d.mount_path, '/x') || '/' || f.path ELSE f.path END AS path,
  f.hash, f.size, f.modified_time, f.scanned_time, f.last_accessed,
  CASE f.id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE f.system_id END AS system_id,
  f.last_sync
FROM files f LEFT JOIN devices d ON d.uuid = f.device_uuid AND d.system_id = 'sys-0'""",
    "legacy_devices": """
SELECT id, uuid, mount_path, label, first_seen, last_seen,
  CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE system_id END AS system_id, last_sync, is_active
FROM devices""",
    "exif_tags": """
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 12 < 5)
SELECT o_orderkey AS file_id, 'Image Model' AS tag,
  CASE o_orderkey % 4 WHEN 0 THEN 'iPhone 12' WHEN 1 THEN 'Canon EOS R5' WHEN 2 THEN 'NIKON Z6' END AS value
FROM o WHERE o_orderkey % 4 <> 3
UNION ALL SELECT o_orderkey, 'EXIF DateTimeOriginal',
  CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END FROM o
UNION ALL SELECT o_orderkey, 'GPS GPSLatitude',
  CAST(o_custkey % 90 AS VARCHAR) || '/1, ' || CAST(o_custkey % 60 AS VARCHAR) || '/1, ' ||
  CAST(o_orderkey % 6000 AS VARCHAR) || CASE WHEN o_orderkey % 17 = 0 THEN '/0' ELSE '/100' END FROM o
UNION ALL SELECT o_orderkey, 'GPS GPSLatitudeRef', CASE WHEN o_custkey % 2 = 0 THEN 'N' ELSE 'S' END
FROM o WHERE o_orderkey % 19 <> 0
UNION ALL SELECT o_orderkey, 'GPS GPSLongitude',
  CAST(o_custkey % 180 AS VARCHAR) || '/1,' || CAST(o_orderkey % 60 AS VARCHAR) || '/1,0/1' FROM o
UNION ALL SELECT o_orderkey, 'GPS GPSLongitudeRef', CASE WHEN o_orderkey % 2 = 0 THEN 'E' ELSE 'W' END FROM o
UNION ALL SELECT o_orderkey, 'PIL width', CAST(640 + o_orderkey % 1000 AS VARCHAR) FROM o
UNION ALL SELECT o_orderkey, 'PIL height', CAST(480 + o_custkey % 500 AS VARCHAR) FROM o""",
    "video_probes": """
SELECT o_orderkey AS file_id, o_custkey * 10 AS frame_count,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 24 + o_orderkey % 7 END AS DOUBLE) AS fps,
  1920 - (o_orderkey % 3) * 640 AS width, 1080 AS height, o_orderdate AS created_time
FROM orders""",
}

# Views that other views are built from.
DEPENDS = {
    "legacy_files": ["files", "devices"],
    "legacy_devices": ["devices"],
    "file_batch": ["files"],
    "image_analysis_full": ["image_analysis"],
    "stored_events": ["scan_events", "files"],
    "scan_progress": ["files"],
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views (and what they depend on) as a WITH clause."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in ordered)
    body = sql.lstrip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
