"""Searches and table views: F8/J2/L1 (files), F9/J1 (images), F14, F15/L2 with X14/X15."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import short_hash, short_path
from ._util import all_of, like_escape


def _like(col: Column, pattern: str, case_sensitive: bool) -> Column:
    return col.like(pattern) if case_sensitive else col.ilike(pattern)


def file_predicates(keyword: str | None = None, device_uuid: str | None = None,
                    file_type: str | None = None, min_size: int | None = None,
                    max_size: int | None = None, case_sensitive: bool = True) -> list[Column]:
    """F8: the optional predicates of a file search. Empty strings are ignored; size bounds
    only when ``None`` (0 is a bound). ``%``/``_`` in user text stay wildcards."""
    preds: list[Column] = []
    if keyword:
        preds.append(_like(F.col("path"), f"%{like_escape(keyword)}%", case_sensitive))
    if device_uuid:
        preds.append(F.col("device_uuid") == device_uuid)
    if file_type:
        preds.append(_like(F.col("path"), f"%.{like_escape(file_type)}", case_sensitive))
    if min_size is not None:
        preds.append(F.col("size") >= min_size)
    if max_size is not None:
        preds.append(F.col("size") <= max_size)
    return preds


def _later_in_order(after: tuple, file_id: Column) -> Column:
    """Rows behind ``(modified_time, id, device id)`` in the search order (newest first, NULL
    times before all others)."""
    time, fid, did = after
    behind = (file_id > fid) | ((file_id == fid) & (F.col("_d_id") > did))
    if time is None:
        return F.col("modified_time").isNotNull() | behind
    t = _as_ts(time)
    return F.coalesce((F.col("modified_time") < t) | ((F.col("modified_time") == t) & behind), F.lit(False))


def search_files(files: DataFrame, devices: DataFrame, keyword: str | None = None,
                 device_uuid: str | None = None, file_type: str | None = None,
                 min_size: int | None = None, max_size: int | None = None,
                 limit: int | None = 100, offset: int = 0, match_system: bool = False,
                 case_sensitive: bool = True, after: tuple | None = None) -> DataFrame:
    """F8 + J2 + L1: filtered files joined to their device label, newest first, paged.

    The join is on uuid only, so a device known on several systems repeats its files
    (the reference's behaviour); ``match_system=True`` also matches ``system_id``.
    Order: ``modified_time DESC NULLS FIRST``, then file id, then device id, so pages are
    stable. Catalyst and AQE pick the join from real sizes; the page is a
    TakeOrderedAndProject (per-task top-k, no global sort). An ``offset`` needs a ``limit``:
    alone it would sort and move the whole result through one task. Deep pages are
    better asked for by ``after``, the ``(modified_time, id, device id)`` of the last row shown:
    a filter instead of skipped rows.
    """
    if offset and not limit:
        raise ValueError("an offset needs a limit")
    f = files.where(all_of(file_predicates(keyword, device_uuid, file_type, min_size,
                                           max_size, case_sensitive)))
    d = devices.select(F.col("uuid").alias("device_uuid"),
                       F.col("system_id").alias("_d_system_id"),
                       F.col("id").alias("_d_id"), F.col("label").alias("device_label"))
    cond = [f["device_uuid"] == d["device_uuid"]]
    if match_system:
        cond.append(f["system_id"] == d["_d_system_id"])
    joined = f.join(d, all_of(cond), "inner")
    if after is not None:
        joined = joined.where(_later_in_order(after, f["id"]))
    out = joined
    if limit:
        # a page: per-task top-k of (limit + offset) rows, no global sort
        out = joined.orderBy(F.col("modified_time").desc_nulls_first(), f["id"].asc(), F.col("_d_id").asc())
        out = out.offset(offset).limit(limit) if offset else out.limit(limit)
    # without a page the rows stay unsorted: a global sort of the whole result serves no one
    return out.select(f["id"], f["device_uuid"], "path", "hash", "size", "modified_time",
                      "scanned_time", "last_accessed", "device_label")


def _as_ts(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, _dt.datetime):
        return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(x, _dt.date):
        return F.lit(x.isoformat()).cast("timestamp_ntz")
    # bare dates mean midnight of that day, as in PostgreSQL
    return F.lit(str(x)).cast("timestamp_ntz")


def image_predicates(object_keywords: Sequence[str] | None = None, has_faces: bool | None = None,
                     camera_model_like: str | None = None, taken_time_range: tuple | None = None,
                     device_uuid: str | None = None, exact_objects: bool = False,
                     case_sensitive: bool = True, objects_is_array: bool = False) -> list[Column]:
    """optional predicates of an image search over ``image_analysis`` (+ files)."""
    preds: list[Column] = []
    objects = F.col("objects")
    for kw in object_keywords or []:
        if exact_objects:
            arr = objects if objects_is_array else F.from_json(objects, "array<string>")
            preds.append(F.array_contains(arr, kw))
        else:
            text = F.to_json(objects) if objects_is_array else objects
            preds.append(_like(text, f"%{like_escape(kw)}%", case_sensitive))
    if has_faces is not None:
        preds.append(F.col("has_faces") == F.lit(bool(has_faces)))
    if camera_model_like:
        preds.append(_like(F.col("camera_model"), f"%{like_escape(camera_model_like)}%", case_sensitive))
    if taken_time_range:
        start, end = taken_time_range
        preds.append(F.col("taken_time").between(_as_ts(start), _as_ts(end)))
    if device_uuid:
        preds.append(F.col("device_uuid") == device_uuid)
    return preds


def search_images(image_analysis: DataFrame, files: DataFrame,
                  object_keywords: Sequence[str] | None = None, has_faces: bool | None = None,
                  camera_model_like: str | None = None, taken_time_range: tuple | None = None,
                  device_uuid: str | None = None, exact_objects: bool = False,
                  case_sensitive: bool = True) -> DataFrame:
    """F9 + J1: image analyses joined to their file, filtered by a dynamic AND.

    Predicates are written against the joined columns; Catalyst pushes each one to the
    side that owns it (and into the parquet scans), so only surviving rows shuffle.
    """
    objects_is_array = dict(image_analysis.dtypes).get("objects", "string").startswith("array")
    i = image_analysis.select("file_id", "camera_model", "taken_time", "objects", "has_faces")
    f = files.select(F.col("id").alias("file_id"), "path", "device_uuid")
    preds = image_predicates(object_keywords, has_faces, camera_model_like, taken_time_range,
                             device_uuid, exact_objects, case_sensitive, objects_is_array)
    return (i.join(f, "file_id", "inner").where(all_of(preds))
            .select("path", "camera_model", "taken_time", "objects", "has_faces"))


def pick_device(devices: DataFrame, uuid_or_mount: str) -> DataFrame:
    """the first device (by id) whose uuid or mount path equals the argument."""
    return (devices.where((F.col("uuid") == uuid_or_mount) | (F.col("mount_path") == uuid_or_mount))
            .orderBy("id").limit(1))


def devices_table(devices: DataFrame, system_id: str | None = None, limit: int | None = None) -> DataFrame:
    """F15 + L2: the device table view, first ``limit`` rows by id (top-k); ``limit``
    None/0 means all rows, unsorted (a global sort of a whole table serves no one)."""
    d = devices if not system_id else devices.where(F.col("system_id") == system_id)
    d = d.select("id", "uuid", "mount_path", "label", "first_seen", "last_seen", "system_id", "is_active")
    return d.orderBy("id").limit(limit) if limit else d


def files_table(files: DataFrame, device_uuid: str | None = None, system_id: str | None = None,
                limit: int | None = 10, display: bool = True) -> DataFrame:
    """F15 + L2 (+ X14/X15): the file table view with shortened hash and path; the first
    ``limit`` rows by id, or all rows unsorted when ``limit`` is None/0."""
    f = files
    if device_uuid:
        f = f.where(F.col("device_uuid") == device_uuid)
    if system_id:
        f = f.where(F.col("system_id") == system_id)
    cols = [F.col("id"), F.col("device_uuid"),
            short_path("path").alias("path") if display else F.col("path"),
            short_hash("hash").alias("hash") if display else F.col("hash"),
            F.col("size"), F.col("modified_time"), F.col("scanned_time"), F.col("system_id")]
    if limit:
        f = f.orderBy("id").limit(limit)
    return f.select(*cols)
