"""Append-only outputs of ``foreachBatch`` sinks: micro-batch ``n`` writes ``batch_id=<n>`` below a
table's folder and reads the batches before it. Nothing lives in driver memory, so a
restarted query continues from its checkpoint, and replaying batch ``n`` overwrites its own
folder with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stage_table
from ..sources import folders


def append_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def read_batches(spark: SparkSession, folder: str, schema: str | StructType, before: int | None = None) -> DataFrame:
    """Rows of all batches (or those before one) with their ``batch_id``; no rows when nothing
    was written yet. ``batch_id`` is a partition column, so other batches are not read."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    # an empty batch of its own makes the folder exist from the first read on
    spark.createDataFrame([], kind).write.mode("ignore").parquet(f"{folder}/batch_id=-1")
    rows = spark.read.schema(StructType(kind.fields[:]).add("batch_id", "long")).parquet(folder)
    return rows if before is None else rows.where(F.col("batch_id") < before)


def fold_batches(spark: SparkSession, folder: str, schema: str | StructType, upto: int,
                 fold: Callable[[DataFrame], DataFrame]) -> None:
    """Replace the batches up to ``upto`` by ``fold`` of their rows, as batch ``upto``. For sinks whose readers
    fold again, so that folded rows and the rows they came from never count twice: the folded rows are staged first, and
    the old batches go before the folded one takes its place."""
    rows = read_batches(spark, folder, schema).where(F.col("batch_id") <= upto).drop("batch_id")
    folded = stage_table(fold(rows))
    numbers = [int(n.removeprefix("batch_id=")) for n in folders.names(spark, folder) if n.startswith("batch_id=")]
    for n in numbers:
        if 0 <= n < upto:
            folders.remove(spark, f"{folder}/batch_id={n}")
    append_batch(folded, folder, upto)
