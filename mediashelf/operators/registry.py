"""Device registry: K4 upsert, J7 mark-inactive, W1 newest row per key, J10 mount lookup
with fallback, J11 uuid -> first mount, K5 progress upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .upsert import UpsertResult, latest_per_key, ts_lit, upsert


def register_devices(devices: DataFrame, seen: DataFrame, system_id: str, as_of,
                     deactivate_missing: bool = True, order_col: str | None = None, **ids) -> UpsertResult:
    """K4 (+ F18, J7): upsert the devices one system sees, keyed by ``(uuid, system_id)``.

    ``seen`` has ``uuid`` and optionally ``mount_path``, ``label`` (a missing column means
    ``''`` for every row; a NULL value stays NULL).
    Rows without a uuid are skipped. Of several reports of one uuid the last by ``order_col``
    wins (without it: the largest mount path, then label). An existing row gets mount_path, label,
    last_seen = as_of, is_active = true (and last_sync = as_of); a new row gets
    first_seen = last_seen = as_of. Afterwards every other active device of this system
    is marked inactive (J7) unless the seen list is empty or holds a NULL uuid.
    ``ids``: ``id_floor`` or ``sequence``, as in ``upsert``.
    """
    now = ts_lit(as_of)
    cols = seen.columns
    # a missing field defaults to '' (dict.get default); a present NULL stays NULL
    batch = seen.select(
        F.col("uuid"),
        (F.col("mount_path") if "mount_path" in cols else F.lit("")).alias("mount_path"),
        (F.col("label") if "label" in cols else F.lit("")).alias("label"),
        (F.col(order_col) if order_col else F.struct(
            *[F.col(c) for c in ("mount_path", "label") if c in cols] or [F.lit(0)])).alias("_order"),
    ).where(F.coalesce(F.col("uuid"), F.lit("")) != "").withColumn("system_id", F.lit(system_id))
    batch = latest_per_key(batch, ["uuid", "system_id"], "_order").drop("_order")
    res = upsert(
        devices, batch, ["uuid", "system_id"], ["mount_path", "label"], as_of=as_of,
        insert_values={"first_seen": now, "last_seen": now, "is_active": F.lit(True),
                       "mount_path": F.col("_b_mount_path"), "label": F.col("_b_label")},
        update_values={"last_seen": now, "is_active": F.lit(True)}, **ids,
    )
    if not deactivate_missing:
        return res
    return UpsertResult(lambda: mark_inactive(res.table, seen.select("uuid"), system_id, as_of), res.changes,
                        lambda: res.high_water)


def mark_inactive(devices: DataFrame, active_uuids: DataFrame, system_id: str, as_of,
                  uuid_col: str = "uuid") -> DataFrame:
    """``UPDATE devices SET is_active = false WHERE system_id = me AND is_active AND
    uuid NOT IN (active)`` with SQL's NULL rules: an empty list changes nothing, and a
    NULL in the list makes ``NOT IN`` never true, so nothing changes either. Updated rows
    get last_sync = as_of (K15).

    The active list is reduced to distinct uuids plus two scalars (row count, NULL
    count); the device side is joined with a left join on uuid.
    """
    act = active_uuids.select(F.col(uuid_col).alias("_a_uuid"))
    # two scalars decide whether NOT IN can ever be true
    n, nulls = act.agg(F.count("*"), F.count_if(F.col("_a_uuid").isNull())).first()
    if n == 0 or nulls > 0:
        return devices
    distinct_act = act.distinct()
    d = devices.join(distinct_act, devices[uuid_col] == distinct_act["_a_uuid"], "left")
    hit = (F.col("system_id") == system_id) & (F.col("is_active") == F.lit(True)) \
        & F.col("_a_uuid").isNull() & F.col(uuid_col).isNotNull()
    out = []
    for c in devices.columns:
        if c == "is_active":
            out.append(F.when(hit, F.lit(False)).otherwise(F.col(c)).alias(c))
        elif c == "last_sync":
            out.append(F.when(hit, ts_lit(as_of)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return d.select(*out)


def newest_per_key(df: DataFrame, keys: Sequence[str], order_col: str,
                   tie_col: str | None = "id") -> DataFrame:
    """The newest row per key (``ORDER BY order_col DESC LIMIT 1``), ties broken by
    the largest ``tie_col``. As in PostgreSQL a NULL sorts first under DESC, so a row
    without ``order_col`` wins. ``max_by`` over a struct is a partial aggregate (no sort,
    no single-task group even when one key holds a third of the rows)."""
    rest = [c for c in df.columns if c not in keys]
    parts = [F.col(order_col).isNull(), F.col(order_col)] + ([F.col(tie_col)] if tie_col else [])
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*parts)).alias("_w"))
            .select(*keys, "_w.*"))


def device_mount_point(requests: DataFrame, mount_points: DataFrame, devices: DataFrame) -> DataFrame:
    """For each ``(device_uuid, system_id)`` request: the newest mount-point row of
    that device and system (ties: larger id), else the device row's mount_path, else NULL.

    Both lookup sides are first reduced to one row per key (partial aggregates), so the
    two left joins never multiply request rows.
    """
    newest = newest_per_key(mount_points.select("device_uuid", "system_id", "mount_path", "last_updated", "id"),
                            ["device_uuid", "system_id"], "last_updated")
    dev = (devices.groupBy(F.col("uuid").alias("device_uuid"), "system_id")
           .agg(F.min_by("mount_path", "id").alias("d_mount")))
    r = requests.select("device_uuid", "system_id")
    return (r.join(newest.select("device_uuid", "system_id", F.col("mount_path").alias("_m")),
                   ["device_uuid", "system_id"], "left")
            .join(dev, ["device_uuid", "system_id"], "left")
            .select("device_uuid", "system_id", F.coalesce("_m", "d_mount").alias("mount_path")))


def upsert_progress(progress: DataFrame, batch: DataFrame, as_of, scope: str = "system",
                    order_col: str | None = None, **ids) -> DataFrame:
    """The table of ``store_progress``."""
    return store_progress(progress, batch, as_of, scope, order_col, **ids).table


def store_progress(progress: DataFrame, batch: DataFrame, as_of, scope: str = "system",
                   order_col: str | None = None, **ids) -> UpsertResult:
    """K5 (and K6 with ``scope='device'``): progress upsert.

    ``scope='system'`` keys on ``(device_uuid, system_id)``. ``scope='device'`` reproduces
    the reference's final write keyed by device only: of several reports of one device the last by
    ``order_col`` counts (without it: that of the largest system); its counts overwrite every
    system's row of the device, and it is inserted where the device has no row.
    ``ids``: ``id_floor`` or ``sequence``, as in ``upsert``.
    """
    now = ts_lit(as_of)
    order = [order_col] if order_col else []
    b = batch.select("device_uuid", "system_id", "total_files", "new_files", *order)
    if scope == "system":
        return upsert(progress, b, ["device_uuid", "system_id"], ["total_files", "new_files"], as_of=as_of,
                      insert_values={"last_updated": now},
                      update_values={"last_updated": now}, order_col=order_col, **ids)
    b = latest_per_key(b, ["device_uuid"], order_col or "system_id")
    per_dev = b.select("device_uuid", F.struct("total_files", "new_files").alias("_v"))
    j = progress.join(per_dev, "device_uuid", "left")
    hit = F.col("_v").isNotNull()
    out = []
    for c in progress.columns:
        if c in ("total_files", "new_files"):
            out.append(F.when(hit, F.col("_v")[c]).otherwise(F.col(c)).alias(c))
        elif c in ("last_updated", "last_sync"):
            out.append(F.when(hit, now).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    updated = j.select(*out)
    missing = b.join(progress.select("device_uuid").distinct(), "device_uuid", "left_anti").drop(*order)
    return upsert(updated, missing, ["device_uuid", "system_id"], ["total_files", "new_files"], as_of=as_of,
                  insert_values={"last_updated": now}, **ids)


def restore_paths(requests: DataFrame, files: DataFrame, devices: DataFrame, mount_points: DataFrame,
                  system_id: str, listing: DataFrame | None = None) -> DataFrame:
    """J3 (+ J10, J12): for each requested ``file_id``, its full path on this system:
    the file must exist and its device be known (any system), the mount comes from J10,
    the path is ``os.path.join(mount, rel_path)``; with a live ``listing`` (column
    ``path``) a path not present there gives NULL, as a failed existence check does."""
    from ..functions.paths import join_path
    f = files.select(F.col("id").alias("file_id"), "device_uuid", F.col("path").alias("rel_path"))
    f = f.join(requests.select("file_id").distinct(), "file_id", "left_semi")
    # every known device with its mount on this system, from the device tables alone: one join
    # with the files answers both questions
    known = devices.select(F.col("uuid").alias("device_uuid")).distinct().withColumn("system_id", F.lit(system_id))
    mounts = device_mount_point(known, mount_points.where(F.col("system_id") == system_id),
                                devices.where(F.col("system_id") == system_id)).select("device_uuid", "mount_path")
    j = f.join(mounts, "device_uuid")
    full = F.when(F.coalesce(F.col("mount_path"), F.lit("")) == "", F.lit(None).cast("string")) \
        .otherwise(join_path("mount_path", "rel_path"))
    out = j.select("file_id", full.alias("full_path"))
    if listing is not None:
        live = listing.select(F.col("path").alias("_live")).distinct()
        out = out.join(live, out["full_path"] == live["_live"], "left") \
            .select("file_id", F.when(F.col("_live").isNotNull(), F.col("full_path")).alias("full_path"))
    return requests.select("file_id").distinct().join(out, "file_id", "left")
