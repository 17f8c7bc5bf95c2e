"""Queries: path and media-type scalars over catalogue paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import media_types as mt
from ..functions import paths as P
from ..sources import catalogue as cat
from .registry import register

# full paths of every file: files joined to the device row of the same owner; a file
# without such a row keeps a NULL mount and path
_FULL = """
SELECT f.id, f.path AS rel, d.mount_path AS mount, d.mount_path || '/' || f.path AS p
FROM files f LEFT JOIN devices d ON f.device_uuid = d.uuid AND f.system_id = d.system_id"""


def _full(spark, sf_dir):
    f = cat.files(spark, sf_dir)
    d = cat.devices(spark, sf_dir)
    return (f.join(d, (f.device_uuid == d.uuid) & (f.system_id == d.system_id), "left")
            .select(f.id, f.path.alias("rel"), d.mount_path.alias("mount"),
                    F.concat(d.mount_path, F.lit("/"), f.path).alias("p")))


@register("X1_normalize_path", views=("devices", "files"), sql=f"""
WITH b AS ({_FULL})
SELECT id, replace(p, '/', '\\') AS win_path, replace(replace(p, '/', '\\'), '\\', '/') AS norm_path FROM b""")
def x1_normalize(spark, sf_dir):
    b = _full(spark, sf_dir).select("id", F.replace("p", F.lit("/"), F.lit("\\")).alias("win_path"))
    return b.select("id", "win_path", P.normalize_path("win_path").alias("norm_path"))


@register("X2_relative_path", views=("devices", "files"), sql=f"""
WITH b AS ({_FULL}),
v AS (
  SELECT id, p,
    CASE id % 4 WHEN 0 THEN mount WHEN 1 THEN substr(mount, 1, length(mount) - 1)
      WHEN 2 THEN mount || '//' ELSE '/other' || mount END AS mount
  FROM b),
n AS (SELECT id, p, mount, rtrim(replace(mount, '\\', '/'), '/') AS m FROM v),
s AS (SELECT *, string_split(p, '/') AS pf, string_split(m, '/') AS pm FROM n)
SELECT id, p AS full_path, mount,
  CASE WHEN p IS NULL OR m IS NULL THEN NULL
       WHEN m = '' THEN p
       WHEN starts_with(p, m || '/') THEN substr(p, length(m) + 2)
       WHEN len(pm) >= 2 AND len(pf) >= len(pm)
            AND list_slice(pf, 1, len(pm) - 1) = list_slice(pm, 1, len(pm) - 1)
            AND ((pm[len(pm)] <> '' AND pf[len(pm)] <> '' AND contains(pf[len(pm)], pm[len(pm)]))
                 OR contains(pm[len(pm)], pf[len(pm)]))
         THEN array_to_string(list_slice(pf, len(pm) + 1, len(pf)), '/')
       ELSE p END AS rel_path
FROM s""")
def x2_relative_path(spark, sf_dir):
    b = _full(spark, sf_dir)
    k = F.col("id") % 4
    mount = (F.when(k == 0, F.col("mount"))
             .when(k == 1, F.expr("substring(mount, 1, length(mount) - 1)"))
             .when(k == 2, F.concat("mount", F.lit("//")))
             .otherwise(F.concat(F.lit("/other"), "mount")))
    v = b.select("id", F.col("p").alias("full_path"), mount.alias("mount"))
    return v.select("id", "full_path", "mount", P.relative_path("full_path", "mount").alias("rel_path"))


@register("X3_platform_path", views=("devices", "files"), sql=f"""
WITH b AS ({_FULL}),
v AS (
  SELECT id,
    CASE id % 3 WHEN 0 THEN rel WHEN 1 THEN '/' || rel ELSE '//' || rel END AS rel_path,
    CASE id % 4 WHEN 0 THEN mount WHEN 1 THEN mount || '/' WHEN 2 THEN '/' ELSE '' END AS mount_point
  FROM b),
n AS (SELECT id, rel_path, mount_point,
        regexp_replace(replace(rel_path, '\\', '/'), '^/', '') AS r,
        regexp_replace(replace(mount_point, '\\', '/'), '/$', '') AS m FROM v)
SELECT id, rel_path, mount_point,
  CASE WHEN starts_with(r, '/') THEN r WHEN m = '' THEN r
       WHEN ends_with(m, '/') THEN m || r ELSE m || '/' || r END AS full_path
FROM n""")
def x3_platform_path(spark, sf_dir):
    b = _full(spark, sf_dir)
    k3, k4 = F.col("id") % 3, F.col("id") % 4
    rel = (F.when(k3 == 0, F.col("rel")).when(k3 == 1, F.concat(F.lit("/"), "rel"))
           .otherwise(F.concat(F.lit("//"), "rel")))
    mount = (F.when(k4 == 0, F.col("mount")).when(k4 == 1, F.concat("mount", F.lit("/")))
             .when(k4 == 2, F.lit("/")).otherwise(F.lit("")))
    v = b.select("id", rel.alias("rel_path"), mount.alias("mount_point"))
    return v.select("id", "rel_path", "mount_point", P.platform_path("rel_path", "mount_point").alias("full_path"))


@register("X4_X5_extract_mount_point", views=("devices", "files"), sql=f"""
WITH b AS ({_FULL}),
v AS (
  SELECT id, p,
    CASE WHEN id % 5 = 0 THEN 'Plan9'
         WHEN starts_with(mount, '/Volumes') THEN 'Darwin'
         WHEN starts_with(mount, '/media') THEN 'Linux' ELSE 'Windows' END AS system,
    CASE WHEN id % 7 = 0 THEN replace(p, '/', '\\') ELSE p END AS path
  FROM b)
SELECT id, path, system,
  CASE system
    WHEN 'Darwin' THEN nullif(regexp_extract(replace(path, '\\', '/'), '^(/Volumes/[^/]+)', 1), '')
    WHEN 'Linux' THEN nullif(regexp_extract(replace(path, '\\', '/'), '^(/media/[^/]+/[^/]+)', 1), '')
    WHEN 'Windows' THEN nullif(regexp_extract(replace(path, '\\', '/'), '^([A-Z]:)', 1), '')
    ELSE NULL END AS mount_point,
  regexp_matches(replace(path, '\\', '/'), CASE system
    WHEN 'Darwin' THEN '^/Volumes/([^/]+)' WHEN 'Windows' THEN '^([A-Z]:)'
    ELSE '^/media/([^/]+)/([^/]+)' END) AS has_pattern
FROM v""")
def x5_extract_mount(spark, sf_dir):
    b = _full(spark, sf_dir)
    system = (F.when(F.col("id") % 5 == 0, F.lit("Plan9"))
              .when(F.startswith("mount", F.lit("/Volumes")), F.lit("Darwin"))
              .when(F.startswith("mount", F.lit("/media")), F.lit("Linux"))
              .otherwise(F.lit("Windows")))
    path = F.when(F.col("id") % 7 == 0, F.replace("p", F.lit("/"), F.lit("\\"))).otherwise(F.col("p"))
    v = b.select("id", path.alias("path"), system.alias("system"))
    # The pattern of the row's system, unknown systems by the default one
    pattern = reduce(lambda rest, name: F.when(F.col("system") == name, F.lit(P.mount_point_pattern(name))).otherwise(rest),
                     P.MOUNT_PATTERNS, F.lit(P.mount_point_pattern(None)))
    return v.select("id", "path", "system", P.extract_mount_point("path", F.col("system")).alias("mount_point"),
                    F.regexp_like(P.normalize_path("path"), pattern).alias("has_pattern"))


_EXT_SQL = r"lower(regexp_extract(regexp_extract({p}, '([^/]*)$', 1), '^\.*[^.].*(\.[^.]*)$', 1))"
_STRIP_ENC = r"regexp_replace({p}, '([^/.][^/]*)(\.gz|\.Z|\.bz2|\.xz|\.br)$', '\1')"


def _media_sql(p: str) -> str:
    ext = _EXT_SQL.format(p=p)
    mext = _EXT_SQL.format(p=_STRIP_ENC.format(p=p))
    def lst(xs):
        return "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    parts = []
    for t in mt.MEDIA_ORDER:
        parts.append(f"WHEN {ext} IN {lst(mt.MEDIA_EXTENSIONS[t])} OR {mext} IN {lst(mt.MIME_EXTENSIONS[t])} THEN '{t}'")
    return "CASE " + " ".join(parts) + " ELSE NULL END"


# file names with and without compression suffixes, plus hidden and dotted names
_NAMES = r"""
SELECT id, CASE id % 9 WHEN 0 THEN path || '.gz' WHEN 1 THEN path || '.Z' WHEN 2 THEN path || '.GZ'
    WHEN 3 THEN regexp_replace(path, '/f', '/.f') WHEN 4 THEN regexp_replace(path, '\.[^./]*$', '.tif')
    WHEN 5 THEN regexp_replace(path, '\.[^./]*$', '.QT') WHEN 6 THEN path || '.'
    WHEN 7 THEN regexp_replace(path, '/f[0-9]*', '/..') ELSE path END AS path
FROM files"""


def _names(spark, sf_dir):
    f = cat.files(spark, sf_dir)
    k, p = F.col("id") % 9, F.col("path")
    path = (F.when(k == 0, F.concat(p, F.lit(".gz"))).when(k == 1, F.concat(p, F.lit(".Z")))
            .when(k == 2, F.concat(p, F.lit(".GZ")))
            .when(k == 3, F.regexp_replace(p, "/f", "/.f"))
            .when(k == 4, F.regexp_replace(p, r"\.[^./]*$", ".tif"))
            .when(k == 5, F.regexp_replace(p, r"\.[^./]*$", ".QT"))
            .when(k == 6, F.concat(p, F.lit(".")))
            .when(k == 7, F.regexp_replace(p, "/f[0-9]*", "/.."))
            .otherwise(p))
    return f.select("id", path.alias("path"))


@register("X6_X8_X10_file_types", views=("files",), sql=f"""
WITH n AS ({_NAMES})
SELECT id, path, {_EXT_SQL.format(p='path')} AS extension,
  {_media_sql('path')} AS media_type,
  ({_media_sql('path')}) IS NOT NULL AS is_media
FROM n""")
def x6_x8_file_types(spark, sf_dir):
    n = _names(spark, sf_dir)
    return n.select("id", "path", P.extension("path").alias("extension"),
                    mt.media_type("path").alias("media_type"), mt.is_media("path").alias("is_media"))


@register("X7_basename_dirname_label", views=("devices", "files"), sql=f"""
WITH b AS ({_FULL}),
v AS (SELECT id, CASE id % 5 WHEN 0 THEN p || '/' WHEN 1 THEN '/' || rel ELSE p END AS path, mount FROM b)
SELECT id, path,
  regexp_extract(path, '([^/]*)$', 1) AS base_name,
  CASE WHEN regexp_matches(regexp_extract(path, '^(.*/)?[^/]*$', 1), '^/+$')
       THEN regexp_extract(path, '^(.*/)?[^/]*$', 1)
       ELSE regexp_replace(regexp_extract(path, '^(.*/)?[^/]*$', 1), '/+$', '') END AS dir_name,
  COALESCE(NULLIF(regexp_extract(mount, '([^/]*)$', 1), ''), 'Root') AS label
FROM v""")
def x7_basename(spark, sf_dir):
    b = _full(spark, sf_dir)
    k = F.col("id") % 5
    path = (F.when(k == 0, F.concat("p", F.lit("/"))).when(k == 1, F.concat(F.lit("/"), "rel"))
            .otherwise(F.col("p")))
    v = b.select("id", path.alias("path"), "mount")
    return v.select("id", "path", P.basename("path").alias("base_name"), P.dirname("path").alias("dir_name"),
                    P.device_label("mount").alias("label"))


@register("X9_extensions_by_type", views=("files",), sql=f"""
SELECT media_type, COUNT(*) AS n_files,
  CASE media_type WHEN 'image' THEN ['.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff', '.webp']
    WHEN 'video' THEN ['.mp4', '.avi', '.mov', '.mkv', '.wmv', '.flv', '.webm']
    WHEN 'audio' THEN ['.mp3', '.wav', '.aac', '.flac', '.ogg', '.m4a', '.wma']
    ELSE CAST([] AS VARCHAR[]) END AS extensions
FROM (SELECT {_media_sql('path')} AS media_type FROM files) t
GROUP BY media_type""")
def x9_extensions_by_type(spark, sf_dir):
    f = cat.files(spark, sf_dir)
    per_type = f.groupBy(mt.media_type("path").alias("media_type")).agg(F.count("*").alias("n_files"))
    return per_type.select("media_type", "n_files", mt.extensions_for("media_type").alias("extensions"))


@register("X11_is_absolute", views=("devices", "files"), sql=f"""
WITH b AS ({_FULL})
SELECT id, CASE WHEN id % 2 = 0 THEN p ELSE rel END AS path,
  starts_with(CASE WHEN id % 2 = 0 THEN p ELSE rel END, '/') AS is_absolute FROM b""")
def x11_is_absolute(spark, sf_dir):
    b = _full(spark, sf_dir)
    path = F.when(F.col("id") % 2 == 0, F.col("p")).otherwise(F.col("rel"))
    return b.select("id", path.alias("path")).select("id", "path", P.is_absolute("path").alias("is_absolute"))


# mounts: every device mount plus its first path component (nested, shorter mounts)
_MOUNTS_SQL = """
m AS (SELECT mount_path, arg_min(uuid, id) AS uuid FROM (
        SELECT mount_path, uuid, id FROM devices
        UNION ALL SELECT regexp_extract(mount_path, '^(/[^/]+)', 1), 'root-' || uuid, id FROM devices) u
      WHERE mount_path <> '' GROUP BY mount_path)"""


def _mounts(spark, sf_dir):
    d = cat.devices(spark, sf_dir)
    u = d.select("mount_path", "uuid", "id").unionByName(
        d.select(F.regexp_extract("mount_path", r"^(/[^/]+)", 1).alias("mount_path"),
                 F.concat(F.lit("root-"), "uuid").alias("uuid"), "id"))
    return u.where(F.col("mount_path") != "").groupBy("mount_path").agg(F.min_by("uuid", "id").alias("uuid"))


@register("J5_longest_prefix_mount", views=("devices", "files"), sql=f"""
WITH b AS ({_FULL}), {_MOUNTS_SQL},
p AS (SELECT id, CASE WHEN id % 3 = 0 THEN p ELSE replace(p, '/', '//') || '/' END AS path FROM b),
n AS (SELECT id, path, CASE WHEN regexp_replace(path, '/+', '/', 'g') = '/' THEN '/'
                ELSE regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') END AS np FROM p),
c AS (SELECT n.id, m.mount_path, m.uuid,
        row_number() OVER (PARTITION BY n.id ORDER BY length(m.mount_path) DESC) AS rn
      FROM n JOIN m ON starts_with(n.np, m.mount_path))
SELECT n.id, n.path, c.mount_path, c.uuid AS device_uuid,
  regexp_extract(c.mount_path, '([^/]*)$', 1) AS device_label
FROM n LEFT JOIN c ON n.id = c.id AND c.rn = 1""")
def j5_longest_prefix(spark, sf_dir):
    from ..operators.prefix_join import longest_prefix_mount
    b = _full(spark, sf_dir)
    path = F.when(F.col("id") % 3 == 0, F.col("p")).otherwise(
        F.concat(F.replace("p", F.lit("/"), F.lit("//")), F.lit("/")))
    return longest_prefix_mount(b.select("id", path.alias("path")), _mounts(spark, sf_dir))


@register("J5_mounts_of_many_lengths", views=("devices", "files"), sql=f"""
WITH b AS ({_FULL}),
m AS (SELECT left(p, CAST(4 + id % 23 AS INTEGER)) AS mount_path, 'm-' || CAST(MIN(id) AS VARCHAR) AS uuid FROM b GROUP BY 1),
n AS (SELECT id, CASE WHEN regexp_replace(p, '/+', '/', 'g') = '/' THEN '/'
                ELSE regexp_replace(regexp_replace(p, '/+', '/', 'g'), '/$', '') END AS np FROM b),
c AS (SELECT n.id, m.mount_path, m.uuid, row_number() OVER (PARTITION BY n.id ORDER BY length(m.mount_path) DESC) AS rn
      FROM n JOIN m ON starts_with(n.np, m.mount_path))
SELECT n.id, c.mount_path, c.uuid AS device_uuid FROM n LEFT JOIN c ON n.id = c.id AND c.rn = 1""")
def j5_mounts_of_many_lengths(spark, sf_dir):
    # beginnings of the paths themselves, cut at 23 lengths, as mounts
    from ..operators.prefix_join import longest_prefix_mount
    b = _full(spark, sf_dir).select("id", F.col("p").alias("path"))
    mounts = b.groupBy(F.expr("left(path, CAST(4 + id % 23 AS INT))").alias("mount_path")).agg(
        F.concat(F.lit("m-"), F.min("id").cast("string")).alias("uuid"))
    return longest_prefix_mount(b, mounts).select("id", "mount_path", "device_uuid")
