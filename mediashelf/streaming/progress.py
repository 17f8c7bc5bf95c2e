"""Running scan progress per (device_uuid, system_id) from a file-event stream.

Both counts are kept in Spark's state store, so no batch reads an earlier batch's output or the catalogue:

* ``totals``: a streaming count per device and system, in update mode;
* ``new``: the first scan of a path. A streaming aggregate per ``(device_uuid, path)`` holds the earliest
  scan (event time, id) and the batch that saw the key first; a key is new in the batch that made its
  state. The catalogue's keys are read once: they are a second input of the same stream, written as files
  when the query starts for the first time, and all of them arrive in its first batch and make state that counts nothing.

The sinks write ``batch_id=<n>``: for ``totals`` the new totals of the groups that changed, for ``new`` the batch's
first inserts per device and system. A replayed batch has the batch time of its first attempt and writes the same rows into its
own folder. ``progress`` reads the largest total and the sum of first inserts and stores them in the table (K5);
``compact`` folds old batches. A session with much state should set ``spark.sql.streaming.stateStore.providerClass`` to
the RocksDB provider: one state row per path ever scanned is kept, on the executors' disks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.registry import store_progress
from ..operators.upsert import UpsertResult
from ..session import cut_lineage
from ..sources import folders
from .versions import append_batch, fold_batches, read_batches

PROGRESS_SCHEMA = ("device_uuid string, system_id string, id long, total_files long, new_files long, "
                   "last_updated timestamp_ntz, last_sync timestamp_ntz")
KEYS = ["device_uuid", "path"]
GROUP = ["device_uuid", "system_id"]
TOTALS = "device_uuid string, system_id string, total_files long"
NEW = "device_uuid string, system_id string, new_files long"
KNOWN = "device_uuid string, path string"


class ProgressStreams:
    """The two queries of T7 as one."""

    def __init__(self, *queries: StreamingQuery):
        self.queries = queries

    def awaitTermination(self, timeout: int | None = None) -> bool:
        return all([q.awaitTermination(timeout) if timeout else q.awaitTermination() or True for q in self.queries])

    def processAllAvailable(self) -> None:
        for q in self.queries:
            q.processAllAvailable()

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    @property
    def isActive(self) -> bool:
        return any(q.isActive for q in self.queries)


def count_totals(events: DataFrame) -> DataFrame:
    """Streaming: scanned files (upsert events) per device and system so far."""
    return events.where("op = 'upsert'").groupBy(*GROUP).agg(F.count("*").alias("total_files"))


def first_scans(events: DataFrame, known: DataFrame) -> DataFrame:
    """Streaming: per key its earliest scan and the first and the latest batch that named it. The
    batch time is the same for all rows of a batch, also when it is replayed."""
    scan = events.where("op = 'upsert'").select(
        *KEYS, F.struct(F.lit(1).alias("scanned"), "ts", "event_id", "system_id").alias("scan"))
    stored = known.select(*KEYS, F.struct(
        F.lit(0).alias("scanned"), *[F.lit(None).cast(k).alias(c) for c, k in (
            ("ts", "timestamp_ntz"), ("event_id", "long"), ("system_id", "string"))]).alias("scan"))
    return scan.unionByName(stored).withColumn("batch", F.current_timestamp()).groupBy(*KEYS).agg(
        F.min("scan").alias("scan"), F.min("batch").alias("made"), F.max("batch").alias("latest"))


def write_totals(base_dir: str):
    """foreachBatch: the totals that changed. One action: the state of every partition moves on with it."""
    def run(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, f"{base_dir}/totals", batch_id)
    return run


def write_new(base_dir: str):
    """foreachBatch: first inserts of the keys whose state this batch made, in one action."""
    def run(batch: DataFrame, batch_id: int) -> None:
        new = batch.where("made = latest AND scan.scanned = 1").groupBy(
            "device_uuid", F.col("scan.system_id").alias("system_id")).agg(F.count("*").alias("new_files"))
        append_batch(new, f"{base_dir}/new", batch_id)
    return run


def start_progress_stream(events: DataFrame, spark: SparkSession, base_dir: str, checkpoint: str,
                          stored: DataFrame, trigger: dict | None = None) -> ProgressStreams:
    """Start T7 over file events; ``stored`` is the catalogue's files table, whose keys are read when
    ``base_dir`` is new."""
    if not folders.exists(spark, f"{base_dir}/known/_SUCCESS"):
        stored.select(*KEYS).distinct().write.mode("overwrite").parquet(f"{base_dir}/known")
    known = spark.readStream.schema(KNOWN).parquet(f"{base_dir}/known")
    trigger = trigger or {"availableNow": True}

    def start(rows: DataFrame, sink, name: str) -> StreamingQuery:
        return (rows.writeStream.outputMode("update").foreachBatch(sink)
                .option("checkpointLocation", f"{checkpoint}/{name}").trigger(**trigger).start())
    return ProgressStreams(start(count_totals(events), write_totals(base_dir), "totals"),
                           start(first_scans(events, known), write_new(base_dir), "new"))


def counts(spark: SparkSession, base_dir: str) -> DataFrame:
    """``(device_uuid, system_id, total_files, new_files)`` so far."""
    total = read_batches(spark, f"{base_dir}/totals", TOTALS).select(*GROUP, "total_files", F.lit(0).cast("long").alias("new_files"))
    new = read_batches(spark, f"{base_dir}/new", NEW).select(*GROUP, F.lit(0).cast("long").alias("total_files"), "new_files")
    # totals only grow, so the largest is the newest
    return total.unionByName(new).groupBy(*GROUP).agg(
        F.max("total_files").alias("total_files"), F.sum("new_files").alias("new_files"))


def compact(spark: SparkSession, base_dir: str, upto_batch: int) -> None:
    """Fold the batches up to one that has ended in both queries into it."""
    fold_batches(spark, f"{base_dir}/totals", TOTALS, upto_batch,
                 lambda rows: rows.groupBy(*GROUP).agg(F.max("total_files").alias("total_files")))
    fold_batches(spark, f"{base_dir}/new", NEW, upto_batch,
                 lambda rows: rows.groupBy(*GROUP).agg(F.sum("new_files").alias("new_files")))


def store_counts(spark: SparkSession, base_dir: str, initial: DataFrame, as_of, **ids) -> UpsertResult:
    """``initial`` with the counts so far (K5); ``ids`` as in ``upsert``."""
    return store_progress(initial, cut_lineage(counts(spark, base_dir)), as_of, **ids)


def progress(spark: SparkSession, base_dir: str, initial: DataFrame, as_of, **ids) -> DataFrame:
    """The progress table of ``store_counts``."""
    cols = [c.split()[0] for c in PROGRESS_SCHEMA.split(", ")]
    return store_counts(spark, base_dir, initial, as_of, **ids).table.select(*cols)
