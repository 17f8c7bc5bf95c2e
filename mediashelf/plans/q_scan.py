"""Queries: scan filters, listings, scan diff, totals, statistics, hashes
(S1-S3, F1-F4, F17, U2, K13, J6, K18, A4, A5, A12, X18, X19)."""

from __future__ import annotations

import os
import uuid as _uuid

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import paths as P
from ..operators import scan as SC
from ..session import ensure_checkpoint_dir, ship_package
from ..sources import catalogue as cat
from ..sources import listing as L
from ..sources.catalogue import read_table
from .q_paths import _EXT_SQL
from .registry import register

# write order inside a batch: line number (+ part, supplier), then price in cents
def ORDER():
    return F.struct("ord", "ord2")

_PATHS_SQL = """
SELECT id, CASE id % 8 WHEN 0 THEN '/devices/' || path WHEN 1 THEN '/usr2/' || path
    WHEN 2 THEN '/home/u/' || path WHEN 3 THEN '/Volumes/Recovery/' || path
    WHEN 4 THEN '/data/.cache/' || path WHEN 5 THEN '/data/' || replace(path, '/f', '/.f')
    WHEN 6 THEN '/proc/' || path ELSE '/data/' || path END AS path
FROM files"""

_BASE = "regexp_extract({p}, '([^/]*)$', 1)"
_DIR = ("CASE WHEN regexp_matches(regexp_extract({p}, '^(.*/)?[^/]*$', 1), '^/+$') "
        "THEN regexp_extract({p}, '^(.*/)?[^/]*$', 1) "
        "ELSE regexp_replace(regexp_extract({p}, '^(.*/)?[^/]*$', 1), '/+$', '') END")
_SKIPS = "(" + ", ".join(f"'{s}'" for s in SC.SKIP_DIRS) + ")"


def _scan_paths(spark, sf_dir):
    f = cat.files(spark, sf_dir)
    k, p = F.col("id") % 8, F.col("path")
    path = (F.when(k == 0, F.concat(F.lit("/devices/"), p)).when(k == 1, F.concat(F.lit("/usr2/"), p))
            .when(k == 2, F.concat(F.lit("/home/u/"), p)).when(k == 3, F.concat(F.lit("/Volumes/Recovery/"), p))
            .when(k == 4, F.concat(F.lit("/data/.cache/"), p))
            .when(k == 5, F.concat(F.lit("/data/"), F.replace(p, F.lit("/f"), F.lit("/.f"))))
            .when(k == 6, F.concat(F.lit("/proc/"), p)).otherwise(F.concat(F.lit("/data/"), p)))
    return f.select("id", path.alias("path"))


@register("F1_F2_F3_F4_scan_filters", views=("files",), sql=f"""
WITH n AS ({_PATHS_SQL}),
d AS (SELECT id, path, {_DIR.format(p='path')} AS parent, regexp_extract(path, '^(/[^/]*)', 1) AS root FROM n),
e AS (SELECT *, substr(parent, length(root) + 2) AS below FROM d)
SELECT id, path,
  {_EXT_SQL.format(p='path')} IN ('.jpg', '.jpeg', '.png', '.gif', '.bmp', '.tiff', '.mp4', '.mov', '.avi', '.mkv') AS keep_f1,
  NOT starts_with({_BASE.format(p='path')}, '.') AND {_EXT_SQL.format(p='path')} IN ('.jpg', '.png', '.mp4') AS scan_f2,
  len([s FOR s IN {_SKIPS.replace('(', '[').replace(')', ']')} IF starts_with(parent, s)]) > 0 AS skip_f4,
  NOT contains('/' || {_BASE.format(p='root')} || CASE WHEN below = '' THEN '' ELSE '/' || below END, '/.')
    AND NOT len([s FOR s IN ['/home/u/dir1'] IF starts_with(parent, s)]) > 0 AS walked_f3
FROM e""")
def f1_f4_scan_filters(spark, sf_dir):
    n = _scan_paths(spark, sf_dir)
    root = F.regexp_extract("path", r"^(/[^/]*)", 1)
    n = n.withColumn("_dir", P.dirname("path"))  # computed once, tested against every prefix
    return n.select(
        "id", "path",
        SC.keep_extension("path").alias("keep_f1"),
        SC.should_scan_file("path", [".jpg", ".png", ".mp4"]).alias("scan_f2"),
        SC.should_skip_dir("_dir").alias("skip_f4"),
        SC.dir_walked("path", root, skip_dirs=["/home/u/dir1"]).alias("walked_f3"))


_SEEN_SQL = "(SELECT DISTINCT device_uuid, path FROM file_batch WHERE error IS NULL)"


@register("U2_K13_scan_diff", views=("files", "file_batch"), sql=f"""
WITH s AS {_SEEN_SQL},
t AS (SELECT DISTINCT device_uuid, path FROM files
      WHERE device_uuid IN (SELECT device_uuid FROM file_batch WHERE error IS NULL))
SELECT COALESCE(t.device_uuid, s.device_uuid) AS device_uuid, COALESCE(t.path, s.path) AS path,
  CASE WHEN t.path IS NOT NULL AND s.path IS NOT NULL THEN 'updated'
       WHEN s.path IS NOT NULL THEN 'new' ELSE 'deleted' END AS change
FROM t FULL OUTER JOIN s ON t.device_uuid = s.device_uuid AND t.path = s.path""")
def u2_scan_diff(spark, sf_dir):
    scanned = cat.file_batch(spark, sf_dir).where(F.col("error").isNull())
    return SC.scan_diff(cat.files(spark, sf_dir), scanned)


@register("J6_K18_F17_delete_vanished", views=("files", "file_batch"), sql=f"""
SELECT f.* FROM files f
WHERE f.device_uuid NOT IN (SELECT device_uuid FROM file_batch)
   OR EXISTS (SELECT 1 FROM {_SEEN_SQL} s WHERE s.device_uuid = f.device_uuid AND s.path = f.path)""")
def j6_delete_vanished(spark, sf_dir):
    b = cat.file_batch(spark, sf_dir)
    # a row whose stat failed counts as unseen; its device still counts as scanned
    scanned = b.select("device_uuid", F.when(F.col("error").isNull(), F.col("path")).alias("path"))
    return SC.delete_vanished(cat.files(spark, sf_dir), scanned)


_ELIG = f"(NOT starts_with({_BASE.format(p='path')}, '.') AND {_EXT_SQL.format(p='path')} IN ('.jpg', '.png', '.mp4', '.mov', '.v1'))"


@register("A4_pre_scan_totals", views=("files", "file_batch"), sql=f"""
SELECT device_uuid, COUNT(*) AS total_files, COALESCE(CAST(SUM(size) AS BIGINT), 0) AS total_size
FROM file_batch WHERE {_ELIG} GROUP BY device_uuid""")
def a4_pre_scan_totals(spark, sf_dir):
    b = cat.file_batch(spark, sf_dir)
    elig = SC.should_scan_file("path", [".jpg", ".png", ".mp4", ".mov", ".v1"])
    return SC.pre_scan_totals(b.where(elig), ["device_uuid"])


@register("A5_X29_scan_stats", views=("files", "file_batch"), sql=f"""
WITH s AS (
  SELECT device_uuid,
    COUNT(*) FILTER (WHERE {_ELIG}) AS total_files,
    COUNT(*) FILTER (WHERE {_ELIG} AND error IS NULL) AS processed_files,
    COUNT(*) FILTER (WHERE NOT {_ELIG}) AS skipped_files,
    COUNT(*) FILTER (WHERE {_ELIG} AND error IS NOT NULL) AS error_files,
    COALESCE(CAST(SUM(CASE WHEN {_ELIG} AND error IS NULL THEN size END) AS BIGINT), 0) AS total_size
  FROM file_batch GROUP BY device_uuid)
SELECT *, round(CASE WHEN total_files = 0 THEN 0.0 ELSE processed_files * 100.0 / total_files END, 6) AS percent,
  round(total_size / 1073741824.0, 9) AS gb, round(processed_files / 12.5, 6) AS files_per_sec
FROM s""")
def a5_scan_stats(spark, sf_dir):
    b = cat.file_batch(spark, sf_dir)
    elig = SC.should_scan_file("path", [".jpg", ".png", ".mp4", ".mov", ".v1"])
    return SC.scan_stats(b, elig, 12.5, ["device_uuid"])


@register("A12_dedupe_scanned_paths", views=("files", "file_batch"), sql="""
SELECT path, device_uuid, system_id, size, hash, modified_time, ord, ord2, error FROM file_batch
QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord DESC, ord2 DESC) = 1""")
def a12_dedupe_paths(spark, sf_dir):
    return SC.dedupe_paths(cat.file_batch(spark, sf_dir), ORDER())


@register("X18_X19_document_hashes", sql="""
SELECT doc_id, sha256(encode(text)[1:1000]) AS prefix_hash, sha256(text) AS full_hash
FROM documents""")
def x18_x19_hashes(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", H.prefix_sha256("text", 1000).alias("prefix_hash"),
                    H.full_sha256("text").alias("full_hash"))


def _document_tree(spark, sf_dir) -> str:
    """Write every document as a file of a known name into the shared checkpoint folder and return
    the tree's root: ``lang/d<id>.txt``, every 20th with a leading dot, every 21st under a hidden
    directory, every 11th as ``.TXT``, every 13th as ``.md``, and every 17th under ``skip/``."""
    ship_package(spark)
    base = ensure_checkpoint_dir(spark)
    root = os.path.join(base.replace("file:", ""), f"doc-tree-{_uuid.uuid4().hex}")

    def write(batches):
        for pdf in batches:
            for doc, lang, text in zip(pdf["doc_id"], pdf["lang"], pdf["text"]):
                path = os.path.join(root, _doc_path(int(doc), lang))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(text.encode())
            yield pdf[["doc_id"]]
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    docs.mapInPandas(write, "doc_id long").agg(F.count("*")).collect()
    return root


def _doc_path(doc: int, lang: str) -> str:
    name = f"d{doc}" + (".TXT" if doc % 11 == 0 else ".md" if doc % 13 == 0 else ".txt")
    folder = f"skip/{lang}" if doc % 17 == 0 else f".hid/{lang}" if doc % 21 == 0 else lang
    return f"{folder}/." + name if doc % 20 == 0 else f"{folder}/{name}"


_DOC_PATH_SQL = """
SELECT doc_id, text,
  CASE WHEN doc_id % 17 = 0 THEN 'skip/' || lang WHEN doc_id % 21 = 0 THEN '.hid/' || lang ELSE lang END || '/'
    || CASE WHEN doc_id % 20 = 0 THEN '.' ELSE '' END || 'd' || doc_id
    || CASE WHEN doc_id % 11 = 0 THEN '.TXT' WHEN doc_id % 13 = 0 THEN '.md' ELSE '.txt' END AS path
FROM documents"""


@register("S1_A4_binaryfile_tree", sql=f"""
SELECT path, strlen(text) AS size, sha256(text) AS hash FROM ({_DOC_PATH_SQL}) d
WHERE doc_id % 20 <> 0 AND (doc_id % 17 = 0 OR doc_id % 21 <> 0)""")
def s1_binaryfile_tree(spark, sf_dir):
    # Spark's own listing: names and folders with a leading dot are not in it
    root = _document_tree(spark, sf_dir)
    files = L.binary_files(spark, root, with_content=True)
    return files.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"), "size",
                        H.full_sha256("content").alias("hash"))


@register("S2_S3_walked_tree", sql=f"""
SELECT path, strlen(text) AS size, sha256(text) AS hash, true AS has_times, CAST(NULL AS VARCHAR) AS error
FROM ({_DOC_PATH_SQL}) d WHERE doc_id % 17 <> 0""")
def s2_walked_tree(spark, sf_dir):
    # every name, hidden ones too; the pruned folder is not entered
    root = _document_tree(spark, sf_dir)
    walked = L.walk_files(L.seeds_of(spark, [root]), prune_prefixes=[f"{root}/skip"], do_hash=True)
    now = F.current_timestamp().cast("timestamp_ntz")
    ok = F.col("modified_time").between(now - F.expr("INTERVAL 1 DAY"), now + F.expr("INTERVAL 1 DAY")) \
        & F.col("created_at").isNotNull()
    return walked.select(F.substring("path", len(root) + 2, 1 << 20).alias("path"), "size", "hash",
                         ok.alias("has_times"), "error")


_SCANNED_SQL = f"""
s AS (SELECT doc_id, text, path FROM ({_DOC_PATH_SQL}) d
      WHERE doc_id % 17 <> 0 AND doc_id % 20 <> 0 AND doc_id % 21 <> 0 AND doc_id % 13 <> 0 OR
            (doc_id % 13 = 0 AND doc_id % 11 = 0 AND doc_id % 17 <> 0 AND doc_id % 20 <> 0 AND doc_id % 21 <> 0)),
stored AS (SELECT doc_id AS id, path, 'old' AS hash, CAST(1 AS BIGINT) AS size, 'sys-0' AS system_id
           FROM ({_DOC_PATH_SQL}) d WHERE doc_id % 3 = 0)"""


@register("S1_K3_J6_A6_scan_devices", sql=f"""
WITH {_SCANNED_SQL}
SELECT s.path, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS hash, 'sys-1' AS system_id,
  COALESCE(t.id, (SELECT MAX(id) FROM stored) + row_number() OVER (PARTITION BY t.id IS NULL ORDER BY s.path)) AS id,
  (SELECT COUNT(*) FROM s) AS total_files,
  (SELECT COUNT(*) FROM s WHERE path NOT IN (SELECT path FROM stored)) AS new_files
FROM s LEFT JOIN stored t ON s.path = t.path""")
def s1_scan_devices(spark, sf_dir):
    # the stored catalogue knows a third of the documents under old sizes; files that are hidden, under
    # the skipped folder or of another type were never to be scanned, so their rows vanish
    root = _document_tree(spark, sf_dir)
    doc = F.col("doc_id")
    name = F.concat(F.lit("d"), doc.cast("string"), F.when(doc % 11 == 0, ".TXT").when(doc % 13 == 0, ".md").otherwise(".txt"))
    folder = F.when(doc % 17 == 0, F.concat(F.lit("skip/"), "lang")).when(
        doc % 21 == 0, F.concat(F.lit(".hid/"), "lang")).otherwise(F.col("lang"))
    path = F.concat(folder, F.lit("/"), F.when(doc % 20 == 0, ".").otherwise(""), name)
    empty = F.lit(None).cast("timestamp_ntz")
    stored = read_table(spark, sf_dir, "documents").where(doc % 3 == 0).select(
        doc.alias("id"), F.lit("dev-docs").alias("device_uuid"), path.alias("path"), F.lit("old").alias("hash"),
        F.lit(1).cast("long").alias("size"), empty.alias("modified_time"), empty.alias("scanned_time"),
        empty.alias("last_accessed"), F.lit("sys-0").alias("system_id"), empty.alias("last_sync"))
    devices = spark.createDataFrame([(root, "dev-docs")], "root string, device_uuid string")
    res = SC.scan_devices(stored, cat.scan_progress(spark, sf_dir), devices, "sys-1", "2024-01-01 00:00:00",
                          extensions=[".txt"], skip_dirs=[f"{root}/skip"])
    done = res.progress.where((F.col("device_uuid") == "dev-docs") & (F.col("system_id") == "sys-1")).select(
        "total_files", "new_files")
    return res.files.select("path", "size", "hash", "system_id", "id").join(F.broadcast(done))
