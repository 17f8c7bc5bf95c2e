"""Device summary (A1 on J4) with its display projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import human_size, label_or_default, last_scan_text, short_mount


def device_summary(devices: DataFrame, files: DataFrame, system_id: str | None = None) -> DataFrame:
    """Per device: number of files, byte total and newest scan, over files of the same
    ``(uuid, system_id)``; a device without files gives 0 / NULL / NULL.

    ``files`` is aggregated *before* the join: one partial (map-side) aggregate per
    ``(device_uuid, system_id)`` then a join against one row per group. Files are never
    shuffled row by row and a device holding a third of all files costs one
    partial-aggregate row per task, not a skewed join partition.
    """
    if system_id is not None:
        devices = devices.where(F.col("system_id") == system_id)
        files = files.where(F.col("system_id") == system_id)
    per_device = (
        files.where(F.col("device_uuid").isNotNull() & F.col("system_id").isNotNull())
        .groupBy(F.col("device_uuid").alias("uuid"), "system_id")
        .agg(F.count("id").alias("file_count"),
             F.sum("size").alias("total_size"),
             F.max("scanned_time").alias("last_scan"))
    )
    d = devices.select("id", "uuid", "label", "mount_path", "system_id")
    return (
        d.join(per_device, ["uuid", "system_id"], "left")
        .select("id", "uuid", "label", "mount_path",
                F.coalesce("file_count", F.lit(0)).alias("file_count"),
                "total_size", "last_scan", "system_id")
    )


def device_summary_report(summary: DataFrame) -> DataFrame:
    """Display form of ``device_summary``: short mount, human size, fallback texts, by id."""
    return summary.select(
        "id", "uuid",
        label_or_default("label").alias("label"),
        short_mount("mount_path").alias("mount_path"),
        "file_count",
        human_size("total_size").alias("total_size"),
        last_scan_text("last_scan").alias("last_scan"),
        "system_id",
    ).orderBy("id")
