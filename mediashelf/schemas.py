"""Catalogue schemas (1.1) and idempotent table initialisation."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

SCHEMAS: dict[str, str] = {
    "devices": ("id long, uuid string, mount_path string, label string, first_seen timestamp_ntz, "
                "last_seen timestamp_ntz, system_id string, last_sync timestamp_ntz, is_active boolean"),
    "device_mount_points": ("id long, device_uuid string, system_id string, mount_path string, "
                            "last_updated timestamp_ntz"),
    "files": ("id long, device_uuid string, path string, hash string, size long, modified_time timestamp_ntz, "
              "scanned_time timestamp_ntz, last_accessed timestamp_ntz, system_id string, last_sync timestamp_ntz"),
    "scan_progress": ("id long, device_uuid string, total_files long, new_files long, last_updated timestamp_ntz, "
                      "system_id string, last_sync timestamp_ntz"),
    "image_analysis": ("id long, file_id long, camera_model string, taken_time timestamp_ntz, gps_lat double, "
                       "gps_lon double, width int, height int, has_faces boolean, objects string, "
                       "analyzed_time timestamp_ntz, system_id string, last_sync timestamp_ntz"),
    "video_analysis": "file_id long, duration double, width int, height int, fps double, created_time timestamp_ntz",
    "sync_logs": ("id long, table_name string, record_id string, operation string, system_id string, "
                  "sync_time timestamp_ntz"),
}

# Keys per table (2.13): the canonical unique key of each table.
KEYS: dict[str, list[str]] = {
    "devices": ["uuid", "system_id"],
    "device_mount_points": ["device_uuid", "system_id"],
    "files": ["device_uuid", "path", "system_id"],
    "scan_progress": ["device_uuid", "system_id"],
    "image_analysis": ["file_id"],
    "video_analysis": ["file_id"],
    "sync_logs": ["id"],
}


# Bucket columns per table: the key prefix every join of that table shares. ``files`` is
# bucketed on (device_uuid, path): the upsert (3-column key), the sync (2-column key) and
# the scan diff then all scan it bucket by bucket, with
# ``spark.sql.requireAllClusterKeysForCoPartition=false`` so a join on a superset of the
# bucket columns reuses the buckets.
BUCKET_KEYS: dict[str, list[str]] = {
    "devices": ["uuid"],
    "device_mount_points": ["device_uuid"],
    "files": ["device_uuid", "path"],
    "scan_progress": ["device_uuid"],
    "image_analysis": ["file_id"],
    "video_analysis": ["file_id"],
}


def schema_of(spark: SparkSession, table: str) -> StructType:
    return spark.createDataFrame([], SCHEMAS[table]).schema


def init_catalogue(spark: SparkSession, root: str) -> dict[str, str]:
    """Create every table as empty parquet under ``root`` unless it already exists
    (idempotent). Returns table -> path."""
    out = {}
    for name, ddl in SCHEMAS.items():
        path = os.path.join(root, name)
        out[name] = path
        spark.createDataFrame([], ddl).write.mode("ignore").parquet(path)  # does nothing where the path exists
    return out
