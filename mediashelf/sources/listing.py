"""File listings (S1-S3): Spark's binaryFile source, a partitioned directory walker, and listings
that arrive as a table.

``binary_files`` lists what Spark's ``binaryFile`` source would. That source keeps every file's status in the
driver and opens about 30 small files a task, so folders that every executor mounts are listed by the walker below and
read in tasks of many files; only single files and other stores go through the source itself. Spark's listing skips
names beginning with ``.`` or ``_``; the reference does not, so the walker lists directories with
``os.scandir`` inside Spark tasks, for paths that every executor mounts. On object stores a
listing table (an inventory report) takes its place: ``listing_of``.

The walker works in two steps. Directories become paths by a frontier: a pass deals the frontier's
directories out, each task walks on from its own until it has opened ``budget`` directories, and what it has not
opened is the next frontier. Each pass is staged, gives files, errors and the next frontier at once, and no
directory is opened twice. Passes go on until the frontier is empty, so a deep or lopsided
tree is dealt out anew again and again, and a small one is done in one pass. Names that the scan does
not want (extension, hidden, pruned prefixes) are dropped before anything is opened. Then the
paths are dealt out evenly and each is statted and, if asked, hashed whole by ranged reads, so
that a flat folder of any size is hashed by many tasks. Rows leave the tasks in chunks.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media_meta import epoch_to_timestamp
from ..session import ship_package, stage_table
from . import folders

WALK_SCHEMA = ("root string, path string, size long, mtime double, ctime double, "
               "hash string, error string")
FOUND = "root string, path string, is_dir boolean, error string, opened long, passed long"
LISTING_COLS = ["root", "path", "size", "modified_time", "created_at", "hash", "error"]
#: Rows that a task holds before it hands them on.
CHUNK = 1000
#: Directories that a task opens from one that it is dealt before it hands the rest back.
BUDGET = 256
CONTENT_SCHEMA = "path string, size long, mtime_ms long, content binary"
#: Files that one task reads, and the bytes of content that it holds before it hands them on.
FILES_A_TASK = 2000
CHUNK_BYTES = 8 << 20


def _utc(timestamp: str):
    """A file timestamp as UTC wall-clock time, whatever the session's zone."""
    return epoch_to_timestamp(F.unix_micros(timestamp) / F.lit(1_000_000.0))


def binary_files(spark: SparkSession, root: str, with_content: bool = False) -> DataFrame:
    """S1 via ``binaryFile``: ``path`` (local form), ``size``, ``modified_time`` (UTC) and, when
    asked, ``content``. Hidden / underscore names and empty files are not listed by Spark.

    Local folders are listed at once, by tasks; their files are read when the result is used. As with Spark's source, a
    folder that cannot be listed is an error, and so is a file that cannot be read."""
    roots = _local_folders(spark, root)
    if roots is None:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        path, size, modified = F.regexp_replace("path", "^file:", ""), F.col("length"), _utc("modificationTime")
    else:
        found = walk(seeds_of(spark, roots), hidden=False, as_spark=True)
        for failed in found.where("error IS NOT NULL").limit(1).collect():
            raise OSError(f"{failed['path']}: {failed['error']}")
        files = found.where("path IS NOT NULL").select("path")
        # paths are small: left to their bytes, a few tasks would read everything
        tasks = max(spark.sparkContext.defaultParallelism, -(-files.count() // FILES_A_TASK))
        df = files.repartition(tasks, "path").mapInArrow(_content_reader(with_content), CONTENT_SCHEMA)
        path, size, modified = F.col("path"), F.col("size"), epoch_to_timestamp(F.col("mtime_ms") / F.lit(1000.0))
    cols = [path.alias("path"), size.alias("size"), modified.alias("modified_time")]
    if with_content:
        cols.append(F.col("content"))
    return df.select(*cols)


def _local_folders(spark: SparkSession, root: str) -> list[str] | None:
    """The folders that ``root`` (a path or pattern) names on a file system that all executors mount; None where it
    names anything else."""
    found = folders.matches(spark, root)
    return [p for p, _ in found] if found and all(is_dir for _, is_dir in found) else None


def _content_reader(with_content: bool):
    """Paths to ``CONTENT_SCHEMA`` rows, in batches of bounded bytes; no rows for empty files. Times are whole
    milliseconds, as Spark has them."""
    kinds = [("path", pa.string()), ("size", pa.int64()), ("mtime_ms", pa.int64()), ("content", pa.binary())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for paths in batches:
            for path in paths.column(0).to_pylist():
                content = None
                if with_content:
                    with open(path, "rb") as f:
                        st = os.fstat(f.fileno())
                        if not st.st_size:
                            continue
                        if rows and held + st.st_size > CHUNK_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                        content = f.read()
                        held += len(content)
                else:
                    st = os.stat(path)
                    if not st.st_size:
                        continue
                rows.append((path, st.st_size, st.st_mtime_ns // 1_000_000, content))
                if len(rows) >= CHUNK:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)
    return run


def listing_of(table: DataFrame, root: str) -> DataFrame:
    """A listing that arrives as a table (``path`` and any of the other listing columns), in the
    walker's shape. Nothing is filtered by name."""
    kinds = {"size": "long", "modified_time": "timestamp_ntz", "created_at": "timestamp_ntz", "hash": "string",
             "error": "string"}
    return table.select(F.lit(root).alias("root"), "path", *[
        (F.col(c) if c in table.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def file_hash(path: str, limit: int | None = None) -> str:
    """SHA-256 of a file (or of its first ``limit`` bytes), read in pieces."""
    h = hashlib.sha256()
    left = limit if limit is not None else float("inf")
    with open(path, "rb") as fh:
        while left > 0:
            chunk = fh.read(int(min(1 << 20, left)))
            if not chunk:
                break
            h.update(chunk)
            left -= len(chunk)
    return h.hexdigest()


def _spark_lists(name: str, is_dir: bool) -> bool:
    """Whether Spark's listing of data has a name; folders with the names of Parquet's summaries are entered."""
    if is_dir and name.startswith(("_common_metadata", "_metadata")):
        return True
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _lister(prune: Sequence[str], extensions: Sequence[str] | None, hidden: bool, budget: int, as_spark: bool = False):
    """Directories to ``FOUND`` rows: wanted files, the directories that are not opened when ``budget`` of
    them were (counted per starting directory), failed directories, and per task one row with how many directories it
    opened and how many names it passed over. A link to a directory is neither listed nor entered, as
    ``os.walk`` has it. ``as_spark``: names, links to directories (entered) and links to nothing (not listed) are
    taken as Spark's listing takes them."""
    columns = [c.split()[0] for c in FOUND.split(", ")]
    def wanted(name: str) -> bool:
        if not hidden and name.startswith("."):
            return False
        return extensions is None or os.path.splitext(name.lower())[1] in extensions

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        total = passed = 0
        for pdf in batches:
            for root, start in zip(pdf["root"], pdf["path"]):
                queue, opened = deque([start]), 0
                while queue:
                    path = queue.popleft()  # breadth first: what is left lies as high as it can
                    if any(path.startswith(p) for p in prune):
                        continue
                    if opened == budget:
                        out.append((root, path, True, None, None, None))
                    else:
                        opened, total = opened + 1, total + 1
                        try:
                            with os.scandir(path) as entries:
                                for e in entries:
                                    if as_spark and (not _spark_lists(e.name, e.is_dir()) or e.is_symlink() and not os.path.exists(e.path)):
                                        passed += 1
                                    elif not e.is_dir():
                                        if wanted(e.name):
                                            out.append((root, e.path, False, None, None, None))
                                        else:
                                            passed += 1
                                    elif e.is_dir(follow_symlinks=as_spark) and (hidden or not e.name.startswith(".")):
                                        queue.append(e.path)
                                    if len(out) >= CHUNK:
                                        yield pd.DataFrame(out, columns=columns)
                                        out = []
                        except OSError as e:
                            out.append((root, path, False, str(e), None, None))
                    if len(out) >= CHUNK:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
        out.append((None, None, False, None, total, passed))
        yield pd.DataFrame(out, columns=columns).astype({"opened": "Int64", "passed": "Int64"})
    return run


def _reader(do_hash: bool, hash_bytes: int | None):
    """Paths to stat rows; a file that cannot be read becomes an ``error`` row, a failed hash NULL."""
    def one(root: str, path: str) -> tuple:
        try:
            st = os.stat(path)
        except OSError as e:
            return root, path, None, None, None, None, str(e)
        digest = None
        if do_hash:
            try:
                digest = file_hash(path, hash_bytes)
            except OSError:
                pass
        return root, path, st.st_size, st.st_mtime, st.st_ctime, digest, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in WALK_SCHEMA.split(", ")]
        for pdf in batches:
            for a in range(0, len(pdf), CHUNK):
                part = pdf.iloc[a:a + CHUNK]
                yield pd.DataFrame([one(r, p) for r, p in zip(part["root"], part["path"])], columns=names)
    return run


def walk_files(seeds: DataFrame, prune_prefixes: Sequence[str] = (), do_hash: bool = False,
               hash_bytes: int | None = None, extensions: Sequence[str] | None = None,
               hidden: bool = True, budget: int = BUDGET) -> DataFrame:
    """S1/S3 by directory walk: one output row per wanted file under each ``root`` of ``seeds``.

    ``extensions`` (lower-case, None: all) and ``hidden=False`` (no names with a leading dot, at any
    level) select files by name before they are opened (F1, F2, F3); ``prune_prefixes`` stops the walk
    at directories with such a raw prefix, the root included (F4). ``budget``: directories that a task opens from
    each that it is dealt. ``hash_bytes`` asks for the prefix form of the hash (X18); by default the
    whole file is hashed (X19). ``root`` stays the scan root.

    The passes over directories run at once; files are statted when the result is used."""
    return listed_files(walk(seeds, prune_prefixes, extensions, hidden, budget), do_hash, hash_bytes)


def walk(seeds: DataFrame, prune_prefixes: Sequence[str] = (), extensions: Sequence[str] | None = None,
         hidden: bool = True, budget: int = BUDGET, as_spark: bool = False) -> DataFrame:
    """The directory part of ``walk_files``: ``FOUND`` rows of files and failed directories below ``seeds``, and per
    task and pass a row without a path that has its numbers of opened directories and names passed over. Every
    pass is staged as Parquet; only whether it left a frontier reaches the driver."""
    ship_package(seeds.sparkSession)  # the walker runs in Python workers
    lister = _lister(tuple(prune_prefixes), set(extensions) if extensions is not None else None, hidden, budget, as_spark)
    dirs = seeds.select(F.col("root").cast("string").alias("root")).distinct().withColumn("path", F.col("root"))
    passes = []
    while True:
        step = stage_table(dirs.select("root", "path").repartition("path").mapInPandas(lister, FOUND))
        passes.append(step.where("NOT is_dir"))
        dirs = step.where("is_dir")
        if dirs.isEmpty():
            return reduce(DataFrame.unionByName, passes)


def listed_files(found: DataFrame, do_hash: bool = False, hash_bytes: int | None = None) -> DataFrame:
    """Stat (and hash) the files of a ``walk``, dealt out evenly; failed directories follow as error rows."""
    files = found.where("path IS NOT NULL AND error IS NULL")
    read = files.select("root", "path").repartition("path").mapInPandas(_reader(do_hash, hash_bytes), WALK_SCHEMA)
    return read.select(
        "root", "path", "size", epoch_to_timestamp(F.col("mtime")).alias("modified_time"),
        epoch_to_timestamp(F.col("ctime")).alias("created_at"), "hash", "error").unionByName(
        found.where("error IS NOT NULL").select("root", "path", "error"), allowMissingColumns=True)


def seeds_of(spark: SparkSession, roots: list[str]) -> DataFrame:
    return spark.createDataFrame([(r,) for r in roots], "root string")
