"""Queries: device inventories from captured command output."""

from __future__ import annotations

from ..sources import catalogue as cat
from ..sources import inventory as inv
from .registry import register

_TOK = r"""CASE WHEN x = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(x, '\s+') END"""
_TRIM = r"""regexp_replace({c}, '^\s+|\s+$', '', 'g')"""

LINUX_SQL = f"""
lx AS (
  SELECT host, captured_at, seq, {_TOK} AS t
  FROM (SELECT *, {_TRIM.format(c='line')} AS x FROM inventory_lines WHERE os = 'Linux') s),
lp AS (SELECT host, captured_at, seq, t[2] AS uuid, array_to_string(t[3:], ' ') AS mount_path
       FROM lx WHERE len(t) >= 3),
linux AS (
  SELECT host, captured_at, mount_path, arg_max(uuid, seq) AS uuid, MIN(seq) AS seq FROM lp
  WHERE mount_path NOT IN ('/boot', '/') AND uuid <> '' AND mount_path <> ''
  GROUP BY host, captured_at, mount_path)"""

MAC_SQL = rf"""
m1 AS (SELECT host, captured_at, seq, {_TRIM.format(c='line')} AS l FROM inventory_lines WHERE os = 'Darwin'),
m2 AS (SELECT *, starts_with(l, 'Device Identifier:') AS is_vol FROM m1),
m3 AS (SELECT *, (NOT is_vol AND contains(l, 'Volume UUID:')) AS is_uuid FROM m2),
m4 AS (SELECT *, (NOT is_vol AND NOT is_uuid AND contains(l, 'Mount Point:')) AS is_mount,
         {_TRIM.format(c="regexp_extract(l, '^[^:]*:(.*)$', 1)")} AS value,
         {_TRIM.format(c="COALESCE(string_split(l, ':')[2], '')")} AS ident,
         CAST(SUM(CASE WHEN is_vol THEN 1 ELSE 0 END) OVER (
           PARTITION BY host, captured_at ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS vol
       FROM m3),
mv AS (SELECT host, captured_at, vol,
         arg_max(ident, seq) FILTER (WHERE is_vol) AS ident,
         arg_max(value, seq) FILTER (WHERE is_uuid) AS uuid,
         arg_max(value, seq) FILTER (WHERE is_mount AND value <> '' AND value <> '(not mounted)') AS mount_path
       FROM m4 WHERE vol > 0 GROUP BY host, captured_at, vol),
md AS (SELECT host, captured_at, mount_path, arg_max(uuid, vol) AS uuid, MIN(vol) AS seq FROM mv
       WHERE ident <> '' AND uuid IS NOT NULL AND mount_path IS NOT NULL
       GROUP BY host, captured_at, mount_path),
mac AS (SELECT * FROM md
        WHERE (starts_with(mount_path, '/Volumes/') AND NOT starts_with(mount_path, '/Volumes/Recovery')
               AND NOT starts_with(mount_path, '/Volumes/VM')) OR mount_path = '/')"""

WIN_SQL = f"""
w1 AS (SELECT *, MIN(seq) OVER (PARTITION BY host, captured_at) AS first_seq
       FROM inventory_lines WHERE os = 'Windows'),
wx AS (SELECT host, captured_at, seq, {_TOK} AS t
       FROM (SELECT *, {_TRIM.format(c='line')} AS x FROM w1 WHERE seq > first_seq) s),
wp AS (SELECT host, captured_at, seq, t[1] AS mount_path, t[2] AS uuid FROM wx WHERE len(t) >= 2),
win AS (SELECT host, captured_at, mount_path, arg_max(uuid, seq) AS uuid, MIN(seq) AS seq FROM wp
        WHERE mount_path <> 'C:' GROUP BY host, captured_at, mount_path)"""

ALL_SQL = f"""{LINUX_SQL},{MAC_SQL},{WIN_SQL},
found AS (SELECT * FROM linux UNION ALL SELECT * FROM mac UNION ALL SELECT * FROM win),
home AS (
  SELECT h.host, h.captured_at, h.home_dir AS mount_path,
    'HOME-' || replace(h.node, '.', '-') || '-' || regexp_extract(h.home_dir, '([^/]*)$', 1) AS uuid,
    CAST(1099511627776 AS BIGINT) AS seq
  FROM inventory_homes h
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.host = h.host AND f.captured_at = h.captured_at
                                          AND f.mount_path = h.home_dir)),
alldev AS (SELECT host, captured_at, mount_path, uuid, CAST(seq AS BIGINT) AS seq FROM found
           UNION ALL SELECT * FROM home)"""


@register("S4_F16_linux_devices", views=("inventory_lines",),
          sql=f"WITH {LINUX_SQL}\nSELECT * FROM linux")
def s4_linux(spark, sf_dir):
    lines = cat.inventory_lines(spark, sf_dir)
    return inv.linux_devices(lines.where(lines.os == "Linux"))


@register("S5_W5_macos_devices", views=("inventory_lines",), sql=f"WITH {MAC_SQL}\nSELECT * FROM mac")
def s5_macos(spark, sf_dir):
    lines = cat.inventory_lines(spark, sf_dir)
    return inv.macos_devices(lines.where(lines.os == "Darwin"))


@register("S6_windows_devices", views=("inventory_lines",), sql=f"WITH {WIN_SQL}\nSELECT * FROM win")
def s6_windows(spark, sf_dir):
    lines = cat.inventory_lines(spark, sf_dir)
    return inv.windows_devices(lines.where(lines.os == "Windows"))


@register("S7_S8_U1_all_devices", views=("inventory_lines", "inventory_homes"),
          sql=f"WITH {ALL_SQL}\nSELECT * FROM alldev")
def s8_all_devices(spark, sf_dir):
    return inv.all_devices(cat.inventory_lines(spark, sf_dir), cat.inventory_homes(spark, sf_dir))


@register("J11_first_mount_of_uuid", views=("inventory_lines", "inventory_homes"),
          sql=f"""WITH {ALL_SQL}
SELECT host, captured_at, uuid, arg_min(mount_path, seq) AS mount_path FROM alldev
GROUP BY host, captured_at, uuid""")
def j11_first_mount(spark, sf_dir):
    d = inv.all_devices(cat.inventory_lines(spark, sf_dir), cat.inventory_homes(spark, sf_dir))
    return inv.first_mount_of_uuid(d)


@register("X12_system_ids", views=("inventory_lines",), sql="""
SELECT DISTINCT host, os, lower(os) || '-' || host AS system_id, os || '-' || host AS sync_system_id
FROM inventory_lines""")
def x12_system_ids(spark, sf_dir):
    from ..functions.paths import system_id_of
    h = cat.inventory_lines(spark, sf_dir).select("host", "os").distinct()
    return h.select("host", "os", system_id_of("os", "host").alias("system_id"),
                    system_id_of("os", "host", lower=False).alias("sync_system_id"))
