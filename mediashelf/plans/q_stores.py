"""Queries: stored catalogue structures: id sequences (W4), copy-on-write buckets (K1-K3, K10), counters of a
running job (A5) and the detector hook over file contents."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import migrate as M
from ..operators import registry as R
from ..operators import scan as SC
from ..operators import upsert as U
from ..operators.upsert import latest_per_key
from ..schemas import BUCKET_KEYS
from ..session import stage_table
from ..sources import catalogue as cat
from ..sources import listing as L
from ..sources.bucket_table import BucketTable
from ..sources.sequences import Sequence
from ..streaming.file_events import work_dir
from .q_registry import _PROGRESS_BATCH, _progress_batch
from .q_scan import _DOC_PATH_SQL, _ELIG, _document_tree
from .q_upsert import _BATCH2_SQL, _BATCH_SQL, AS_OF, AS_OF_SQL, ORDER, _clean_batch
from .registry import register


def _after_deletes(name: str, mark: str, rows: str, order: str, key: str) -> str:
    return (f"SELECT '{name}' AS operator, {key} AS key, ({mark}) + row_number() OVER (ORDER BY {order}) AS id FROM ({rows}) x")


@register("W4_ids_after_deletes", views=("files", "file_batch", "scan_progress", "scan_events", "image_analysis_full"), sql=f"""
WITH {_PROGRESS_BATCH},
{_BATCH2_SQL.replace('b AS', 'f10 AS')},
p11 AS (SELECT * FROM scan_progress QUALIFY row_number() OVER (PARTITION BY device_uuid ORDER BY id) = 1),
imgs AS (SELECT id AS file_id FROM files WHERE path LIKE '%.jpg' OR path LIKE '%.jpeg' OR path LIKE '%.png')
{_after_deletes('K5', 'SELECT MAX(id) FROM scan_progress', '''SELECT * FROM b WHERE NOT EXISTS (
   SELECT 1 FROM scan_progress p WHERE p.id <= (SELECT MAX(id) FROM scan_progress) - 5
   AND p.device_uuid = b.device_uuid AND p.system_id = b.system_id)''', 'device_uuid, system_id', "device_uuid || '|' || system_id")}
UNION ALL {_after_deletes('K7', 'SELECT MAX(id) FROM image_analysis_full', 'SELECT * FROM imgs', 'file_id', 'CAST(file_id AS VARCHAR)')}
UNION ALL {_after_deletes('K10', 'SELECT MAX(id) FROM files', '''SELECT * FROM f10 WHERE NOT EXISTS (
   SELECT 1 FROM files f WHERE f.id <= (SELECT MAX(id) FROM files) - 100
   AND f.device_uuid = f10.device_uuid AND f.path = f10.path)''', 'device_uuid, path', "device_uuid || '|' || path")}
UNION ALL {_after_deletes('K11', 'SELECT MAX(id) FROM p11', '''SELECT DISTINCT device_uuid FROM scan_events WHERE device_uuid NOT IN (
   SELECT device_uuid FROM p11 WHERE id <= (SELECT MAX(id) FROM p11) - 5)''', 'device_uuid', 'device_uuid')}
UNION ALL {_after_deletes('K12', 'SELECT MAX(id) FROM image_analysis_full', 'SELECT * FROM image_analysis', 'file_id, taken_time',
                          'CAST(file_id AS VARCHAR)')}""")
def w4_ids_after_deletes(spark, sf_dir):
    # per table: a sequence has given out all ids, the rows with the largest ones are deleted, then rows are inserted
    folder = work_dir(spark, "sequences")
    out: list[DataFrame] = []

    def run(name, table, gone, change, *key):
        mark = U.max_id(table)
        ids = Sequence(spark, f"{folder}/{name}")
        ids.take(0, mark)
        done = change(table.where(F.col("id") <= mark - gone), ids).table
        out.append(done.where(F.col("id") > mark).select(
            F.lit(name).alias("operator"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key"), "id"))
    files, progress = cat.files(spark, sf_dir), cat.scan_progress(spark, sf_dir)
    analyses, events = cat.image_analysis_full(spark, sf_dir), cat.scan_events(spark, sf_dir)
    run("K5", progress, 5, lambda t, ids: R.store_progress(t, _progress_batch(spark, sf_dir), AS_OF, sequence=ids),
        "device_uuid", "system_id")
    images = A.select_images(files).select("file_id", F.lit(False).alias("has_faces"))
    run("K7", analyses, 100, lambda t, ids: A.store_image_analyses(t, images, AS_OF, sequence=ids), "file_id")
    legacy = latest_per_key(_clean_batch(spark, sf_dir), ["device_uuid", "path"], ORDER())
    legacy = legacy.withColumn("scanned_time", F.col("modified_time"))
    run("K10", files, 100, lambda t, ids: M.migrate_files(t, legacy, AS_OF, sequence=ids), "device_uuid", "path")
    one = latest_per_key(progress, ["device_uuid"], -F.col("id")).select(*progress.columns)
    seen = events.groupBy("device_uuid").agg(F.count("*").alias("total_files"), F.count("*").alias("new_files"),
                                             F.max("ts").alias("last_updated"))
    run("K11", one, 5, lambda t, ids: M.migrate_scan_progress(t, seen, AS_OF, sequence=ids), "device_uuid")
    old = cat.image_analysis(spark, sf_dir).withColumns({c: F.lit(None).cast("int") for c in ("width", "height")})
    old = old.withColumn("analyzed_time", F.col("taken_time"))
    run("K12", analyses, 100, lambda t, ids: M.append_image_analysis(t, old, AS_OF, sequence=ids), "file_id")
    first, *rest = out
    for rows in rest:
        first = first.unionByName(rows)
    return first


_BUCKETS = 16


@register("K1_K15_bucket_copy_on_write", views=("files", "file_batch"), sql=f"""
WITH {_BATCH_SQL},
j AS (
  SELECT f.*, b.device_uuid AS b_dev, b.path AS b_path, b.system_id AS b_sys, b.size AS b_size,
         b.hash AS b_hash, b.modified_time AS b_mt
  FROM files f FULL OUTER JOIN b
    ON f.device_uuid = b.device_uuid AND f.path = b.path AND f.system_id = b.system_id),
u AS (SELECT
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
FROM j)
SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM file_batch e WHERE e.error IS NOT NULL
                                  AND e.device_uuid = u.device_uuid AND e.path = u.path)""")
def k1_bucket_copy_on_write(spark, sf_dir):
    # the catalogue in buckets; one batch of upserts with ids from a sequence, then the rows of failed paths go
    files, folder = cat.files(spark, sf_dir), work_dir(spark, "bucket-table")
    table = BucketTable.create(files, f"{folder}/files", BUCKET_KEYS["files"], _BUCKETS)
    ids = Sequence(spark, f"{folder}/ids")
    ids.take(0, U.max_id(files))
    table.upsert(_clean_batch(spark, sf_dir), ["device_uuid", "path", "system_id"], ["hash", "size", "modified_time"],
                 as_of=AS_OF, order_col=ORDER(), insert_values={"scanned_time": U.ts_lit(AS_OF)}, sequence=ids)
    table.vacuum()  # nobody reads the version before
    table.delete(cat.file_batch(spark, sf_dir).where("error IS NOT NULL").select("device_uuid", "path"))
    table.vacuum()
    return table.read()


@register("A5_observed_scan_counters", views=("files", "file_batch"), sql=f"""
WITH s AS (
  SELECT COUNT(*) FILTER (WHERE {_ELIG}) AS total_files,
    COUNT(*) FILTER (WHERE {_ELIG} AND error IS NULL) AS processed_files,
    COUNT(*) FILTER (WHERE NOT {_ELIG}) AS skipped_files,
    COUNT(*) FILTER (WHERE {_ELIG} AND error IS NOT NULL) AS error_files,
    COALESCE(CAST(SUM(CASE WHEN {_ELIG} AND error IS NULL THEN size END) AS BIGINT), 0) AS total_size
  FROM file_batch)
SELECT *, round(CASE WHEN total_files = 0 THEN 0.0 ELSE processed_files * 100.0 / total_files END, 6) AS percent,
  round(total_size / 1073741824.0, 9) AS gb, round(processed_files / 12.5, 6) AS files_per_sec
FROM s""")
def a5_observed_scan_counters(spark, sf_dir):
    # the counters of the one job that writes the scanned rows
    eligible = SC.should_scan_file("path", [".jpg", ".png", ".mp4", ".mov", ".v1"])
    rows, seen = SC.observe_scan(cat.file_batch(spark, sf_dir), eligible, f"scan-{uuid.uuid4().hex}")
    stage_table(rows)
    return SC.observed_stats(spark, seen, 12.5)


def _length_labels(files: pd.DataFrame) -> pd.DataFrame:
    """A stand-in detector whose labels follow from the content's length; some contents it cannot read."""
    n = files["content"].map(len)
    if (n % 23 == 0).any():
        raise ValueError("unreadable")
    faces = pd.DataFrame({"file_id": files["file_id"], "label": "face", "confidence": (n % 100) / 100.0})
    dogs = pd.DataFrame({"file_id": files["file_id"], "label": "dog", "confidence": 1.0})[n % 3 == 0]
    return pd.concat([faces, dogs])


@register("A8_A9_detect_file_contents", sql=f"""
WITH f AS (SELECT doc_id AS file_id, strlen(text) AS n FROM ({_DOC_PATH_SQL}) d
           WHERE doc_id % 20 <> 0 AND (doc_id % 17 = 0 OR doc_id % 21 <> 0))
SELECT file_id, '["' || CASE WHEN n % 3 = 0 THEN 'dog","' ELSE '' END || 'face"]' AS objects,
  n % 100 >= 50 AS has_faces, CAST(NULL AS VARCHAR) AS error FROM f WHERE n % 23 <> 0
UNION ALL SELECT file_id, '[]', false, 'ValueError: unreadable' FROM f WHERE n % 23 = 0""")
def a8_detect_file_contents(spark, sf_dir):
    # every listed file's bytes through a detector; labels per file, and the files it failed on
    files = L.binary_files(spark, _document_tree(spark, sf_dir), with_content=True).select(
        F.regexp_extract("path", r"d(\d+)\.[^/]*$", 1).cast("long").alias("file_id"), "content")
    found = stage_table(A.detect_files(files, _length_labels))
    labels = A.labels_per_file(found.where("error IS NULL"))
    failed = found.where("error IS NOT NULL").select("file_id", "error")
    j = labels.join(failed, "file_id", "full_outer")
    return j.select("file_id", A.labels_to_json(F.coalesce("objects", F.array().cast("array<string>"))).alias("objects"),
                    F.coalesce("has_faces", F.lit(False)).alias("has_faces"), "error")
