"""Migration: legacy table reads (S9), bulk upserts K9-K12, owner back-fill (C6, F13),
key audits (A2, A3, C7), device-relative path rewrite (J13, X13, W2, A10). Where rows get ids, ``ids`` is
``id_floor`` or ``sequence``, as in ``upsert``."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import rewrite_status, rewrite_to_relative
from .upsert import UpsertResult, ts_lit, upsert

# Fixed value: owner given to migrated rows.
MIGRATION_OWNER = "migration"


def read_positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """A legacy ``SELECT *`` whose columns are taken by position."""
    return df.select(*df.columns[:len(names)]).toDF(*names)


def unowned(col: str = "system_id"):
    """owner NULL, empty or the migration marker."""
    return F.coalesce(F.col(col), F.lit("")).isin("", MIGRATION_OWNER)


def migrate_devices(target: DataFrame, legacy: DataFrame, as_of, **ids) -> UpsertResult:
    """K9: upsert on uuid; inserted rows are owned by ``migration``; a conflict updates
    mount_path, label, last_seen and last_sync (never first_seen or system_id)."""
    now = ts_lit(as_of)
    b = legacy.select("uuid", "mount_path", "label", "first_seen", "last_seen")
    return upsert(target, b, ["uuid"], ["mount_path", "label", "last_seen"], as_of=as_of,
                  insert_values={"system_id": F.lit(MIGRATION_OWNER), "last_sync": now, "is_active": F.lit(True)}, **ids)


def migrate_files(target: DataFrame, legacy: DataFrame, as_of, **ids) -> UpsertResult:
    """Upsert on (device_uuid, path); updates hash, size, times, last_sync."""
    now = ts_lit(as_of)
    b = legacy.select("device_uuid", "path", "hash", "size", "modified_time", "scanned_time")
    return upsert(target, b, ["device_uuid", "path"], ["hash", "size", "modified_time", "scanned_time"],
                  as_of=as_of, insert_values={"system_id": F.lit(MIGRATION_OWNER), "last_sync": now}, **ids)


def migrate_scan_progress(target: DataFrame, legacy: DataFrame, as_of, **ids) -> UpsertResult:
    """Upsert on device_uuid; updates totals, last_updated, last_sync."""
    now = ts_lit(as_of)
    b = legacy.select("device_uuid", "total_files", "new_files", "last_updated")
    return upsert(target, b, ["device_uuid"], ["total_files", "new_files", "last_updated"], as_of=as_of,
                  insert_values={"system_id": F.lit(MIGRATION_OWNER), "last_sync": now}, **ids)


def migrate_image_analysis(target: DataFrame, legacy: DataFrame, as_of, id_col: str = "id", **ids) -> DataFrame:
    """The table of ``append_image_analysis``."""
    return append_image_analysis(target, legacy, as_of, id_col, **ids).table


def append_image_analysis(target: DataFrame, legacy: DataFrame, as_of, id_col: str = "id", id_floor: int = 0,
                          sequence=None) -> UpsertResult:
    """The conflict target (id) is never supplied, so every row is appended with a
    new id; ``has_faces`` is cast to boolean, owner ``migration``. ``changes`` has the file ids."""
    from .upsert import INSERT, numbered_rows
    now = ts_lit(as_of)
    cols = [c for c in target.columns if c != id_col]
    rows = legacy.select(*[
        (F.col(c).cast("boolean") if c == "has_faces" else
         F.lit(MIGRATION_OWNER) if c == "system_id" else
         now if c == "last_sync" else F.col(c)).cast(dict(target.dtypes)[c]).alias(c)
        for c in cols])
    numbered = functools.cache(
        lambda: numbered_rows(target, rows, ["file_id", "analyzed_time"], id_col, id_floor, sequence))
    return UpsertResult(lambda: target.unionByName(numbered()[0].select(*target.columns)),
                        rows.select("file_id", F.lit(INSERT).alias("action")), lambda: numbered()[1])


def backfill_owner(df: DataFrame, system_id: str, as_of=None) -> DataFrame:
    """Add ``system_id`` when the column is missing (every row becomes ours), else set
    it on unowned rows (F13); updated rows get last_sync = as_of when that column exists."""
    if "system_id" not in df.columns:
        return df.withColumn("system_id", F.lit(system_id))
    hit = unowned()
    cols = []
    for c in df.columns:
        if c == "system_id":
            cols.append(F.when(hit, F.lit(system_id)).otherwise(F.col(c)).alias(c))
        elif c == "last_sync" and as_of is not None:
            cols.append(F.when(hit, ts_lit(as_of)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row (``HAVING COUNT(*) > 1``).
    An empty result means the key can be widened / declared unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where(F.col("count") > 1)


def files_to_rewrite(files: DataFrame, devices: DataFrame, system_id: str) -> DataFrame:
    """J13 + F13: unowned files of the devices this system knows, with the device mount."""
    d = devices.where(F.col("system_id") == system_id).select(
        F.col("id").alias("device_id"), F.col("uuid").alias("device_uuid"), F.col("mount_path"))
    return files.where(unowned()).join(d, "device_uuid", "inner")


def rewrite_plan(files: DataFrame, devices: DataFrame, system_id: str) -> DataFrame:
    """X13 per file: current path, mount, new path, owner change and status."""
    j = files_to_rewrite(files, devices, system_id)
    return j.select("id", "device_uuid", "device_id", F.col("path").alias("path"), "mount_path",
                    rewrite_to_relative("path", "mount_path").alias("rel_path"),
                    F.col("system_id").alias("old_system_id"),
                    rewrite_status("path", "mount_path").alias("status"))


def apply_rewrite(files: DataFrame, devices: DataFrame, system_id: str, as_of, dry_run: bool = False) -> DataFrame:
    """X13 applied: ``path = rel_path, system_id = me`` (and last_sync) on the rewritten
    rows; with ``dry_run`` the table is returned unchanged."""
    if dry_run:
        return files
    # one left join to this system's devices decides every row in place
    d = devices.where(F.col("system_id") == system_id).select(
        F.col("uuid").alias("_uuid"), F.col("mount_path").alias("_mount"))
    j = files.join(d, files["device_uuid"] == d["_uuid"], "left")
    owner = F.coalesce(files["system_id"], F.lit("")).isin("", MIGRATION_OWNER)
    hit = owner & F.col("_uuid").isNotNull() & (rewrite_status(files["path"], F.col("_mount")) != "error")
    out = []
    for c in files.columns:
        if c == "path":
            out.append(F.when(hit, rewrite_to_relative(files["path"], F.col("_mount"))).otherwise(files[c]).alias(c))
        elif c == "system_id":
            out.append(F.when(hit, F.lit(system_id)).otherwise(files[c]).alias(c))
        elif c == "last_sync":
            out.append(F.when(hit, ts_lit(as_of)).otherwise(files[c]).alias(c))
        else:
            out.append(files[c])
    return j.select(*out)


def preview(plan: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` files (by id) of each device; a salted two-stage top-n, so a
    device holding a third of all files is not ranked in one task."""
    from ._util import top_n_per_group
    return top_n_per_group(plan, ["device_uuid"], [F.col("id").asc()], n, salt_col="id")


def rewrite_stats(plan: DataFrame, skipped_devices: DataFrame | None = None) -> DataFrame:
    """A10: per device total / updated / skipped / errors, plus the overall row
    (``device_uuid`` NULL) from ``rollup``. Devices listed in ``skipped_devices`` (the
    interactive "no" answers) count as skipped."""
    p = plan
    if skipped_devices is not None:
        s = skipped_devices.select(F.col("device_uuid").alias("_s")).distinct().withColumn("_skip", F.lit(True))
        p = p.join(s, p["device_uuid"] == s["_s"], "left")
        skip = F.coalesce(F.col("_skip"), F.lit(False))
    else:
        skip = F.lit(False)
    err = F.col("status") == "error"
    return p.rollup("device_uuid").agg(
        F.count("*").alias("total"),
        F.count_if(~skip & ~err).alias("updated"),
        F.count_if(skip).alias("skipped"),
        F.count_if(~skip & err).alias("errors"))


def can_widen_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """The new unique key may be declared when no key value repeats; reads at most one
    violating group (``limit(1)``) rather than the whole audit."""
    return duplicate_keys(df, keys).limit(1).count() == 0
