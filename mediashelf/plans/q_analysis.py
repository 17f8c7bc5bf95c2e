"""Queries: analysis over detection, tag and probe tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import media_meta as MM
from ..operators import analysis as A
from ..sources import catalogue as cat
from ..sources.catalogue import read_table
from .q_upsert import AS_OF, AS_OF_SQL
from .registry import register

_LABELS_SQL = """
SELECT file_id, list_sort(list_distinct(list(label))) AS objects,
  COUNT(*) FILTER (WHERE label = 'face' AND confidence >= 0.5) > 0 AS has_faces
FROM detections GROUP BY file_id"""


@register("A8_A9_labels_per_file", views=("detections",), sql=_LABELS_SQL)
def a8_a9_labels(spark, sf_dir):
    return A.labels_per_file(cat.detections(spark, sf_dir))


def _gps_sql(v: str, ref: str) -> str:
    parts = f"string_split(regexp_replace({v}, '\\s+', '', 'g'), ',')"
    num = "TRY_CAST(string_split(x, '/')[1] AS DOUBLE)"
    den = "COALESCE(TRY_CAST(string_split(x, '/')[2] AS DOUBLE), 1.0)"
    return f"""(SELECT CASE WHEN len(p) = 3 AND len([x FOR x IN p IF {num} IS NULL OR {den} = 0]) = 0
        THEN (CASE WHEN {ref} IN ('S', 'W') THEN -1 ELSE 1 END) * (
          {num.replace('x', 'p[1]')} / {den.replace('x', 'p[1]')}
          + {num.replace('x', 'p[2]')} / {den.replace('x', 'p[2]')} / 60.0
          + {num.replace('x', 'p[3]')} / {den.replace('x', 'p[3]')} / 3600.0) END
      FROM (SELECT {parts} AS p))"""


def _ok_sql(v: str) -> str:
    parts = f"string_split(regexp_replace({v}, '\\s+', '', 'g'), ',')"
    num = "TRY_CAST(string_split(x, '/')[1] AS DOUBLE)"
    den = "COALESCE(TRY_CAST(string_split(x, '/')[2] AS DOUBLE), 1.0)"
    return f"(SELECT len(p) = 3 AND len([x FOR x IN p IF {num} IS NULL OR {den} = 0]) = 0 FROM (SELECT {parts} AS p))"


_EXIF_SQL = f"""
WITH p AS (
  SELECT file_id,
    MAX(value) FILTER (WHERE tag = 'Image Model') AS model,
    MAX(value) FILTER (WHERE tag = 'EXIF DateTimeOriginal') AS taken,
    MAX(value) FILTER (WHERE tag = 'GPS GPSLatitude') AS lat,
    MAX(value) FILTER (WHERE tag = 'GPS GPSLatitudeRef') AS lat_ref,
    MAX(value) FILTER (WHERE tag = 'GPS GPSLongitude') AS lon,
    MAX(value) FILTER (WHERE tag = 'GPS GPSLongitudeRef') AS lon_ref,
    MAX(value) FILTER (WHERE tag = 'PIL width') AS w,
    MAX(value) FILTER (WHERE tag = 'PIL height') AS h
  FROM exif_tags GROUP BY file_id)
SELECT file_id, model AS camera_model, try_strptime(taken, '%Y:%m:%d %H:%M:%S') AS taken_time,
  CASE WHEN lat IS NOT NULL AND lat_ref IS NOT NULL THEN {_gps_sql('lat', 'lat_ref')} END AS gps_lat,
  CASE WHEN lon IS NOT NULL AND lon_ref IS NOT NULL
        AND NOT (lat IS NOT NULL AND lat_ref IS NOT NULL AND NOT {_ok_sql('lat')})
       THEN {_gps_sql('lon', 'lon_ref')} END AS gps_lon,
  CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height
FROM p"""


@register("X25_X23_X24_exif_fields", views=("exif_tags",), sql=_EXIF_SQL)
def x25_exif_fields(spark, sf_dir):
    return A.exif_fields(cat.exif_tags(spark, sf_dir))


@register("K7_F5_X28_store_image_analyses", views=("files", "detections", "exif_tags", "image_analysis_full"), sql=f"""
WITH imgs AS (SELECT id AS file_id FROM files WHERE path LIKE '%.jpg' OR path LIKE '%.jpeg' OR path LIKE '%.png'),
ex AS ({_EXIF_SQL}),
lab AS (SELECT file_id, '[' || string_agg('"' || label || '"', ',' ORDER BY label) || ']' AS objects
        FROM (SELECT DISTINCT file_id, label FROM detections) d GROUP BY file_id),
faces AS (SELECT file_id, COUNT(*) FILTER (WHERE label = 'face' AND confidence >= 0.5) > 0 AS has_faces
          FROM detections GROUP BY file_id),
lab2 AS (SELECT lab.file_id, lab.objects, faces.has_faces FROM lab JOIN faces ON lab.file_id = faces.file_id),
an AS (SELECT i.file_id, ex.camera_model, ex.taken_time, ex.gps_lat, ex.gps_lon, ex.width, ex.height,
         COALESCE(lab2.has_faces, false) AS has_faces, COALESCE(lab2.objects, '[]') AS objects
       FROM imgs i LEFT JOIN ex ON i.file_id = ex.file_id LEFT JOIN lab2 ON i.file_id = lab2.file_id)
SELECT * FROM image_analysis_full WHERE file_id NOT IN (SELECT file_id FROM an)
UNION ALL
SELECT file_id, camera_model, taken_time, gps_lat, gps_lon, has_faces, objects, width, height,
  (SELECT MAX(id) FROM image_analysis_full) + row_number() OVER (ORDER BY file_id) AS id,
  {AS_OF_SQL} AS analyzed_time, CAST(NULL AS VARCHAR) AS system_id, CAST(NULL AS TIMESTAMP) AS last_sync
FROM an""")
def k7_store_image_analyses(spark, sf_dir):
    images = A.select_images(cat.files(spark, sf_dir))
    an = A.image_analyses(images, cat.exif_tags(spark, sf_dir), cat.detections(spark, sf_dir))
    return A.store_image_analyses(cat.image_analysis_full(spark, sf_dir), an, AS_OF).table


@register("L3_F6_image_cap", views=("files",), sql="""
SELECT id AS file_id, path FROM files WHERE path LIKE '%.jpg' OR path LIKE '%.jpeg' OR path LIKE '%.png'
ORDER BY file_id LIMIT 100""")
def l3_image_cap(spark, sf_dir):
    return A.cap(A.select_images(cat.files(spark, sf_dir)), 100)


@register("X26_F7_video_analyses", views=("files", "video_probes"), sql="""
SELECT v.file_id, CASE WHEN p.fps > 0 THEN p.frame_count / p.fps END AS duration,
  CAST(p.width AS INTEGER) AS width, CAST(p.height AS INTEGER) AS height, p.fps, p.created_time
FROM (SELECT id AS file_id FROM files
      WHERE path LIKE '%.mp4' OR path LIKE '%.avi' OR path LIKE '%.mov' OR path LIKE '%.mkv') v
JOIN video_probes p ON v.file_id = p.file_id""")
def x26_video_analyses(spark, sf_dir):
    return A.video_analyses(A.select_videos(cat.files(spark, sf_dir)), cat.video_probes(spark, sf_dir))


@register("X21_X27_X28_scalar_conversions", views=("image_analysis",), sql="""
SELECT e.event_id, make_timestamp(CAST(round_even((e.event_id * 86400 + e.value / 7) * 1000000, 0) AS BIGINT)) AS from_epoch,
  CAST(e.event_id % 2 AS BOOLEAN) AS flag, CAST(CAST(e.event_id % 2 AS BOOLEAN) AS INTEGER) AS flag_int
FROM events e""")
def x21_scalars(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    flag = MM.to_flag(F.col("event_id") % 2)
    return e.select("event_id", MM.epoch_to_timestamp(F.col("event_id") * 86400 + F.col("value") / 7).alias("from_epoch"),
                    flag.alias("flag"), MM.flag_to_int(flag).alias("flag_int"))


@register("X28_objects_json", views=("image_analysis",), sql="""
SELECT file_id, CAST(objects AS VARCHAR[]) AS labels, CAST(len(CAST(objects AS VARCHAR[])) AS INTEGER) AS n_labels,
  CASE WHEN objects IS NULL THEN NULL ELSE '[' || array_to_string(
    [('"' || x || '"') FOR x IN CAST(objects AS VARCHAR[])], ',') || ']' END AS objects_json
FROM image_analysis""")
def x28_objects_json(spark, sf_dir):
    i = cat.image_analysis(spark, sf_dir)
    arr = MM.labels_from_json("objects")
    return i.select("file_id", arr.alias("labels"),
                    F.when(arr.isNull(), F.lit(None)).otherwise(F.size(arr)).alias("n_labels"),
                    MM.labels_to_json(arr).alias("objects_json"))


@register("K8_store_video_analyses", views=("files", "video_probes"), sql="""
WITH v AS (SELECT id AS file_id FROM files
           WHERE path LIKE '%.mp4' OR path LIKE '%.avi' OR path LIKE '%.mov' OR path LIKE '%.mkv'),
new AS (SELECT v.file_id, CASE WHEN p.fps > 0 THEN p.frame_count / p.fps END AS duration,
          CAST(p.width AS INTEGER) AS width, CAST(p.height AS INTEGER) AS height, p.fps, p.created_time
        FROM v JOIN video_probes p ON v.file_id = p.file_id WHERE p.created_time >= TIMESTAMP '1995-01-01 00:00:00'),
old AS (SELECT p.file_id, CASE WHEN p.fps > 0 THEN p.frame_count / (2 * p.fps) END AS duration,
          CAST(p.width AS INTEGER) AS width, CAST(p.height AS INTEGER) AS height, 2 * p.fps AS fps, p.created_time
        FROM v JOIN video_probes p ON v.file_id = p.file_id)
SELECT * FROM old WHERE file_id NOT IN (SELECT file_id FROM new)
UNION ALL SELECT * FROM new""")
def k8_store_video_analyses(spark, sf_dir):
    videos = A.select_videos(cat.files(spark, sf_dir))
    probes = cat.video_probes(spark, sf_dir)
    old = A.video_analyses(videos, probes.withColumn("fps", F.col("fps") * 2))
    new = A.video_analyses(videos, probes.where(F.col("created_time") >= F.lit("1995-01-01").cast("timestamp_ntz")))
    return A.store_video_analyses(old, new).table
