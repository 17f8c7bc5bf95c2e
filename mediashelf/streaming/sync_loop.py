"""The sync loop as a stream. Each micro-batch of the driving event stream runs one
sync round (T5) with ``as_of`` = the batch's latest event time, so a replay repeats the
same result. In production the trigger is ``processingTime='300 seconds'``; tests use
``availableNow``.

The four tables live in a ``SyncStore``: bucketed versions (``sources.bucket_table``) and, per version, a
summary ``(bucket, system_id, last_sync, rows)``. A round reads the summaries first. They give the numbers of
processed rows, and the buckets in which some row is to be acted on: those that another system owns, and
ownerless ones whose ``last_sync`` has crossed the cutoff. Only these buckets are read, marked and
rewritten, so a round costs what changed since the one before it, and one in which nothing
changed reads four summaries, however many rounds came before. Every round is its own
compaction: it reads the newest version of a bucket and nothing older, and deletes versions that no replay needs.

Other systems hand their rows in with ``publish``, between rounds. A batch without events writes nothing.
A round notes the versions it starts from before it writes, so a replay starts from the same rows, and
its versions, log and counts replace those of the failed attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sync import (
    change_log, cutoff_of, dirty, kept_rows, mark_devices, mark_files, mark_image_analysis, mark_scan_progress,
)
from ..schemas import BUCKET_KEYS
from ..session import stage_table
from ..sources import folders
from ..sources.bucket_table import BucketTable
from .versions import append_batch, read_batches

TABLES = ("devices", "files", "scan_progress", "image_analysis")
LOG = "table_name string, record_id string, operation string, system_id string, sync_time timestamp_ntz"
ROUND = "table_name string, operation string, rows long"
SUMMARY = "bucket int, system_id string, last_sync timestamp_ntz, rows long"
BUCKETS = 8


class SyncStore:
    """The catalogue's four tables in ``base_dir``, laid out for rounds of one system."""

    def __init__(self, spark: SparkSession, base_dir: str, base: dict[str, DataFrame], buckets: int = BUCKETS):
        self.spark, self.base_dir = spark, base_dir
        self.tables: dict[str, BucketTable] = {}
        for t in TABLES:
            table = BucketTable(spark, f"{base_dir}/tables/{t}", base[t].schema, BUCKET_KEYS[t], buckets)
            if table.version() < 0:
                table.write(base[t], 0, range(buckets))
                self._summarise(table, t, 0, list(range(buckets)), None)
                table.commit(0, range(buckets))
            self.tables[t] = table

    def versions(self) -> dict[str, int]:
        return {t: table.version() for t, table in self.tables.items()}

    def read(self, table: str, upto: int | None = None) -> DataFrame:
        return self.tables[table].read(upto)

    def summary(self, table: str, version: int) -> DataFrame:
        return self.spark.read.schema(SUMMARY).parquet(f"{self.base_dir}/summary/{table}/version={version}")

    def _summarise(self, table: BucketTable, name: str, version: int, touched: list[int], before: int | None) -> None:
        """The summary of a version whose data is written: that of the one before with the touched buckets counted anew."""
        data = f"{table.path}/data/version={version}"
        rows = self.spark.read.schema(table.schema).option("recursiveFileLookup", "true").parquet(data) \
            .groupBy(table.bucket().alias("bucket"), "system_id", "last_sync").agg(F.count("*").alias("rows"))
        if before is not None:
            rows = rows.unionByName(self.summary(name, before).where(~F.col("bucket").isin(touched)))
        rows.coalesce(max(1, table.buckets // 64)).write.mode("overwrite").parquet(
            f"{self.base_dir}/summary/{name}/version={version}")

    def put(self, name: str, rows: DataFrame, touched: list[int], before: int) -> None:
        """Commit the touched buckets' new rows as the version after ``before``."""
        table = self.tables[name]
        table.write(rows, before + 1, touched)
        self._summarise(table, name, before + 1, touched, before)
        table.commit(before + 1, touched)

    def publish(self, name: str, rows: DataFrame) -> None:
        """Rows of other systems (all columns): they replace the rows with the same id or are added. Not
        while a round is unfinished, whose replay starts from the versions it noted."""
        if unfinished(self.spark, self.base_dir) is not None:
            raise RuntimeError("a sync round is unfinished; publish after its replay")
        table = self.tables[name]
        rows = stage_table(rows)
        # a replaced row may lie in another bucket than the new one
        old = self.read(name).join(rows.select("id"), "id", "left_semi")
        touched = table.touched(rows.select(*table.keys).unionByName(old.select(*table.keys)))
        if touched:
            before = table.version()
            kept = table.read(before, touched).join(rows.select("id"), "id", "left_anti")
            self.put(name, kept.unionByName(rows), touched, before)

    def vacuum(self, keep: dict[str, int]) -> None:
        """Delete what no reader from the versions ``keep`` on needs."""
        for t, version in keep.items():
            self.tables[t].vacuum(version)
            for n in folders.names(self.spark, f"{self.base_dir}/summary/{t}"):
                if int(n.removeprefix("version=")) < version:
                    folders.remove(self.spark, f"{self.base_dir}/summary/{t}/{n}")


def _round_file(base_dir: str, batch_id: int, state: str) -> str:
    return f"{base_dir}/round_marks/{batch_id}.{state}"


def unfinished(spark: SparkSession, base_dir: str) -> int | None:
    """The batch whose round has begun and not ended."""
    marks = folders.names(spark, f"{base_dir}/round_marks")
    open_ = [int(m.split(".")[0]) for m in marks if m.endswith(".begin") and m.replace(".begin", ".end") not in marks]
    return max(open_, default=None)


def run_round(store: SyncStore, me: str, as_of, batch_id: int) -> None:
    """One round from the versions that its first attempt started from."""
    spark, base_dir = store.spark, store.base_dir
    begin = _round_file(base_dir, batch_id, "begin")
    if folders.exists(spark, begin):
        start = folders.read_json(spark, begin)
    else:
        start = store.versions()
        folders.write_json(spark, begin, start)
    cut = cutoff_of(as_of)
    logs, counts = [], []
    for t in TABLES:
        table, before = store.tables[t], start[t]
        summary = store.summary(t, before)
        act = dirty(summary, me, cut) & ~F.col("system_id").eqNullSafe(F.lit(me))
        found = summary.where(dirty(summary, me, cut)).groupBy("bucket").agg(
            F.sum("rows").alias("rows"), F.max(act).alias("acted")).collect()  # at most one row a bucket
        counts.append((t, "processed", sum(r["rows"] for r in found)))
        touched = sorted(r["bucket"] for r in found if r["acted"])
        if not touched:
            continue
        rows = table.read(before, touched)
        if t == "devices":
            marked = mark_devices(rows, me, as_of)
        elif t == "files":
            marked = mark_files(rows, me, as_of)
        elif t == "scan_progress":
            marked = mark_scan_progress(rows, me, as_of)
        else:
            of_these = rows.select(F.col("file_id").alias("id")).distinct()
            marked = mark_image_analysis(rows, store.read("files").select("id").join(of_these, "id", "left_semi"), me, as_of)
        marked = stage_table(marked)
        store.put(t, kept_rows(marked), touched, before)
        logs.append(change_log(t, marked, me, as_of))
    for log in logs[1:]:
        logs[0] = logs[0].unionByName(log)
    append_batch(logs[0] if logs else spark.createDataFrame([], LOG), f"{base_dir}/sync_logs", batch_id)
    append_batch(spark.createDataFrame(counts, ROUND).coalesce(1), f"{base_dir}/rounds", batch_id)
    folders.write_json(spark, _round_file(base_dir, batch_id, "end"), as_of.isoformat())
    store.vacuum(start)  # a replay of this batch still finds the versions it started from


def sync_log(spark: SparkSession, base_dir: str) -> DataFrame:
    return read_batches(spark, f"{base_dir}/sync_logs", LOG)


def round_counts(spark: SparkSession, base_dir: str) -> DataFrame:
    return read_batches(spark, f"{base_dir}/rounds", ROUND)


def current_tables(spark: SparkSession, base_dir: str, base: dict[str, DataFrame], buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """The four tables as the newest round left them; ``base`` gives their schemas."""
    store = SyncStore(spark, base_dir, base, buckets)
    return {t: store.read(t) for t in TABLES}


def sync_writer(store: SyncStore, me: str):
    """foreachBatch: one round at the batch's latest event time."""
    def run(batch_df: DataFrame, batch_id: int) -> None:
        as_of = batch_df.agg(F.max("ts")).first()[0]
        if as_of is not None:
            run_round(store, me, as_of, batch_id)
    return run


def start_sync_stream(events: DataFrame, spark: SparkSession, base_dir: str, checkpoint: str,
                      base: dict[str, DataFrame], me: str, trigger: dict | None = None,
                      buckets: int = BUCKETS) -> StreamingQuery:
    """Start T6. ``base`` fills the store when ``base_dir`` is new; a restarted query goes on with the store. ``buckets``:
    choose for about 128-512 MB a bucket of the largest table."""
    run = sync_writer(SyncStore(spark, base_dir, base, buckets), me)
    return (events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "300 seconds"})).start())
