"""Streaming upsert of file events, merge-on-read.

Each micro-batch is reduced to its last event per ``(device_uuid, path)`` (W3, a
partial aggregate) and appended to an event log under ``batch_id=<n>``. Replaying a
batch after a failure overwrites the same directory, so the sink is idempotent and the
query is exactly-once with its checkpoint. The catalogue is never rewritten per batch:
``snapshot`` folds the whole log into a table version (last event per key across
batches decides upsert or delete) with one upsert join, which is also the compaction
job; it can run incrementally, folding only the batches after the last compacted one
into the previous compacted version. Streaming and batch give the same table because
both take the last event per key in (batch, event time, event id) order.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import UpsertResult, latest_per_key, max_id, upsert
from ..session import cut_lineage, ensure_checkpoint_dir

KEYS = ["device_uuid", "path"]
EVENT_COLS = ["event_id", "device_uuid", "system_id", "path", "op", "size", "ts"]
LOG_SCHEMA = ("event_id long, device_uuid string, system_id string, path string, op string, "
              "size long, ts timestamp_ntz, batch_id long")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    import uuid
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def reduce_batch(events: DataFrame, batch_id: int) -> DataFrame:
    """Last event per key inside one micro-batch, tagged with the batch id."""
    last = latest_per_key(events.select(*EVENT_COLS), KEYS, F.struct("ts", "event_id"))
    return last.withColumn("batch_id", F.lit(batch_id).cast("long"))


def log_writer(log_dir: str):
    """foreachBatch function appending the reduced batch to the event log (idempotent)."""
    def run(batch_df: DataFrame, batch_id: int) -> None:
        reduce_batch(batch_df, batch_id).drop("batch_id").write.mode("overwrite") \
            .parquet(f"{log_dir}/batch_id={batch_id}")
    return run


def start_file_event_stream(events: DataFrame, log_dir: str, checkpoint: str,
                            trigger: dict | None = None) -> StreamingQuery:
    """Start the T8 stream of file events (a streaming DataFrame with ``EVENT_COLS``)."""
    w = (events.writeStream.foreachBatch(log_writer(log_dir))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def read_log(spark: SparkSession, log_dir: str, after_batch: int | None = None,
             upto_batch: int | None = None) -> DataFrame:
    """The event log, optionally only batches in ``(after_batch, upto_batch]``: a filter on
    the ``batch_id`` partition column, so other batches' directories are never listed or
    read (incremental compaction)."""
    log = spark.read.schema(LOG_SCHEMA).parquet(log_dir)
    if after_batch is not None:
        log = log.where(F.col("batch_id") > after_batch)
    if upto_batch is not None:
        log = log.where(F.col("batch_id") <= upto_batch)
    return log


def snapshot(files: DataFrame, log: DataFrame, id_floor: int = 0, sequence=None) -> DataFrame:
    """Fold the event log into ``files`` (see ``fold``): the new table version."""
    return fold(files, log, id_floor, sequence).table


def fold(files: DataFrame, log: DataFrame, id_floor: int = 0, sequence=None) -> UpsertResult:
    """The last event per key (batch, time, id) deletes the row or upserts it (K3-style on
    ``(device_uuid, path)``: size, owner, scan time = event time).

    An updated row gets ``last_sync`` = event time (K15) and a NULL ``hash``, since its content has
    changed and it has not been hashed again. New rows get serial ids above the largest id of
    ``files`` before the deletions and above ``id_floor``, so an id never comes back. The folded log is
    materialised once."""
    last = cut_lineage(latest_per_key(log, KEYS, F.struct("batch_id", "ts", "event_id")))
    deletes = last.where(F.col("op") == "delete").select(*KEYS)
    upserts = last.where(F.col("op") == "upsert").select(
        *KEYS, "system_id", "size", F.col("ts").alias("scanned_time"))
    base = files.join(deletes, KEYS, "left_anti")
    return upsert(base, upserts, KEYS, ["system_id", "size", "scanned_time"], as_of=None,
                  update_values={"last_sync": F.col("_b_scanned_time"), "hash": F.lit(None)},
                  id_floor=id_floor if sequence is not None and sequence.last() > 0 else max(id_floor, max_id(files)),
                  sequence=sequence)


def batch_equivalent(files: DataFrame, events: DataFrame) -> DataFrame:
    """The same result computed in one batch job (all events as one batch)."""
    return snapshot(files, reduce_batch(events, 0))
