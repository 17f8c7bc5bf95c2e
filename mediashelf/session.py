"""Session helpers: build a session for tests / bench, find the checkpoint dir."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", app: str = "mediashelf",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session with the settings the library assumes (UTC, AQE, no UI)."""
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # joins on a superset of a table's bucket columns reuse its buckets
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        # remove checkpoint files once the checkpointed data is no longer referenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting points at shared storage and is used as is; without it a
    cluster session is an error. Only a ``local`` master (tests) gets a fresh local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        configured = tempfile.mkdtemp(prefix="mediashelf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back: durable
    across executor losses, and Spark knows the real size of what it reads."""
    import uuid
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of a stream's shuffle, or one bucket of a stored table, is to hold.
TASK_ROWS = 250_000


def parts_for(rows: int, least: int) -> int:
    """Partitions or buckets for a number of rows."""
    return max(least, -(-rows // TASK_ROWS))


@contextmanager
def shuffle_partitions_for(spark: SparkSession, rows: int) -> Iterator[None]:
    """Streams started inside shuffle into enough partitions for ``rows``; a stream takes the session's number when it
    starts and keeps it with its checkpoint."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts_for(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@contextmanager
def one_writer_a_task(spark: SparkSession) -> Iterator[None]:
    """Writes inside that deal whole folders to tasks do not sort by folder first, which would spill large ones: a
    task opens a file per folder as long as it has few of them, and sorts only beyond that."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of finished jobs, which otherwise stay until the driver's heap is full."""
    gc.collect()
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``mediashelf`` importable in Python workers (``addPyFile`` of a zip of the
    package, once per application), as ``--py-files`` would. Needed by the operators that
    run Python inside tasks (``mapInPandas``); a no-op when already shipped."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_dir)
    # driver-side staging of code only (no data): Spark serves the file to every executor,
    # exactly as spark-submit does with --py-files from the submitting machine
    archive = os.path.join(tempfile.mkdtemp(prefix="mediashelf-pyfiles-"), "mediashelf.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, dirs, files in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, parent))
    sc.addPyFile(archive)
    _SHIPPED.add(app)
