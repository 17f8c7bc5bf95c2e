"""Scan pipeline: file filters (F1-F4, F17), scan diff against the catalogue (U2, J6,
K13, A6), totals and statistics (A4, A5, A12)."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.media_meta import gigabytes, percent, rate
from ..functions.paths import ColumnOrName, _c, basename, dirname, extension, relative_path
from ..session import cut_lineage, stage_table

# Default extension list of the device scanner (F1).
DEFAULT_SCAN_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".mp4", ".mov", ".avi", ".mkv"]
# System directory prefixes the scanner never enters (F4), raw prefixes.
SKIP_DIRS = ["/System", "/Volumes/Recovery", "/private", "/Library", "/bin", "/sbin", "/usr",
             "/proc", "/sys", "/dev", "/run", "/boot"]


def keep_extension(path: ColumnOrName, extensions: Sequence[str] = DEFAULT_SCAN_EXTENSIONS,
                   include_all: bool = False) -> Column:
    """lower-cased extension in the list, or everything when ``include_all``."""
    if include_all:
        return F.lit(True)
    return extension(path).isin(list(extensions))


def should_scan_file(path: ColumnOrName, include_extensions: Sequence[str] = (),
                     include_all: bool = False) -> Column:
    """not hidden, and (empty list, include-all, or extension listed)."""
    visible = ~F.startswith(basename(path), F.lit("."))
    if not include_extensions or include_all:
        return visible
    return visible & extension(path).isin(list(include_extensions))


def should_skip_dir(dir_path: ColumnOrName, skip_dirs: Sequence[str] = SKIP_DIRS) -> Column:
    """the directory has one of the raw prefixes (``/devices`` matches ``/dev``)."""
    d = _c(dir_path)
    return reduce(lambda a, b: a | b, [F.startswith(d, F.lit(p)) for p in skip_dirs], F.lit(False))


def dir_walked(path: ColumnOrName, scan_root: ColumnOrName, skip_dirs: Sequence[str] = ()) -> Column:
    """a file is reached when no directory from the scan root's own basename down to
    its parent is hidden, and its parent does not start with a skip prefix (an ancestor
    with the prefix implies the parent has it too)."""
    parent = dirname(path)
    root = F.regexp_replace(_c(scan_root), "/+$", "")
    below = F.substring(parent, F.length(root) + 2, 1 << 30)
    comps = F.concat(F.array(basename(_c(scan_root))),
                     F.when(below == "", F.array().cast("array<string>")).otherwise(F.split(below, "/")))
    visible = ~F.exists(comps, lambda x: F.startswith(x, F.lit(".")))
    if skip_dirs:
        return visible & ~should_skip_dir(parent, skip_dirs)
    return visible


def scan_diff(stored: DataFrame, scanned: DataFrame, keys: Sequence[str] = ("device_uuid", "path")) -> DataFrame:
    """Classify every path of the scanned devices as ``new`` (only scanned),
    ``updated`` (both) or ``deleted`` (only stored). One full outer join on the key; the
    stored side is restricted to the devices the scan covered (semi join on device)."""
    keys = list(keys)
    seen = scanned.select(*keys).distinct().withColumn("_s", F.lit(True))
    devs = scanned.select("device_uuid").distinct()
    st = stored.join(devs, "device_uuid", "left_semi").select(*keys).distinct() \
        .withColumn("_t", F.lit(True))
    j = st.join(seen, keys, "full_outer")
    cls = (F.when(F.col("_s").isNotNull() & F.col("_t").isNotNull(), F.lit("updated"))
           .when(F.col("_s").isNotNull(), F.lit("new")).otherwise(F.lit("deleted")))
    return j.select(*keys, cls.alias("change"))


def delete_vanished(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Drop the rows of each scanned device (whatever their owner) whose path
    was not seen. Rows whose stat or write failed count as unseen. A device scanned with
    nothing seen loses all its rows (``scanned`` then carries the device with a NULL path)."""
    # ``files`` is read once: a flag for scanned devices (one row each, so a small side that a
    # hot device does not grow), a flag for seen paths, and a filter
    devs = scanned.select(F.col("device_uuid").alias("_dev")).distinct()
    seen = scanned.where(F.col("path").isNotNull()).select(
        F.col("device_uuid").alias("_sdev"), F.col("path").alias("_spath")).distinct()
    flagged = (files.join(devs, files["device_uuid"] == F.col("_dev"), "left")
               .join(seen, (files["device_uuid"] == F.col("_sdev")) & (files["path"] == F.col("_spath")), "left"))
    return flagged.where(F.col("_dev").isNull() | F.col("_sdev").isNotNull()).select(
        *[files[c] for c in files.columns])


def listing_rows(listing: DataFrame, devices: DataFrame, system_id: str) -> DataFrame:
    """S1 shaping: device-relative path (X2) plus device and owner columns. ``devices`` has one
    row ``(root, device_uuid)`` per scanned mount."""
    return (listing.join(devices.select("root", "device_uuid"), "root")
            .withColumn("rel_path", relative_path(F.col("path"), F.col("root")))
            .withColumn("system_id", F.lit(system_id)))


@dataclass
class ScanResult:
    """One scan: new table versions, what was written per device, rows that failed, and the counters and rates
    of the scan (one row as from ``scan_stats``), which the job that stored the listing has counted."""
    files: DataFrame
    progress: DataFrame
    counts: DataFrame
    errors: DataFrame
    stats: DataFrame


def scan_devices(files: DataFrame, progress: DataFrame, devices: DataFrame, system_id: str, as_of, *,
                 extensions: Sequence[str] = DEFAULT_SCAN_EXTENSIONS, include_all: bool = False,
                 skip_dirs: Sequence[str] = SKIP_DIRS, do_hash: bool = True,
                 listing: DataFrame | None = None, id_floor: int = 0, sequence=None,
                 progress_sequence=None) -> ScanResult:
    """One call for a whole scan: list the devices (``devices``: ``root, device_uuid``), keep wanted
    names (F1-F4, before stat and hash), make paths device-relative (X2), upsert them by device and
    path (K3: owner, size, times and hash; scan time = ``as_of``), drop rows of the scanned devices whose
    path was not seen or failed (J6, F17), update the progress per device and system (K5) and count
    files and first inserts (A6).

    ``listing`` (see ``sources.listing.listing_of``) replaces the walk where executors cannot open the
    paths; it is filtered by the same rules. The listing is materialised once, and that job also counts the scan
    (A5): names that the walker passes over leave a number per task, so they are counted without being listed."""
    from ..sources.listing import listed_files, walk
    from .registry import upsert_progress
    from .upsert import ts_lit, upsert
    began = time.monotonic()
    passed = 0
    if listing is None:
        found = walk(devices.select("root"), skip_dirs, extensions=None if include_all else extensions, hidden=False)
        passed = found.agg(F.sum("passed")).first()[0] or 0
        listing, wanted = listed_files(found, do_hash), F.lit(True)
    else:
        listing = listing.withColumn("_dir", dirname("path")).where(
            dir_walked("path", F.col("root")) & ~should_skip_dir("_dir", skip_dirs)).drop("_dir")
        wanted = should_scan_file("path", extensions, include_all)
    observed, seen = observe_scan(listing.withColumn("_wanted", wanted), F.col("_wanted"), f"scan-{uuid.uuid4().hex}")
    rows = stage_table(listing_rows(observed.where("_wanted"), devices, system_id).select(
        "device_uuid", F.col("rel_path").alias("path"), "system_id", "size", "hash", "modified_time", "error"))
    stats = observed_stats(files.sparkSession, seen, time.monotonic() - began).withColumn(
        "skipped_files", F.col("skipped_files") + F.lit(passed))
    good = rows.where(F.col("error").isNull()).drop("error")
    counts = cut_lineage(scan_result_counts(files, good))
    res = upsert(files, good, ["device_uuid", "path"], ["system_id", "size", "hash", "modified_time"], as_of=as_of,
                 insert_values={"scanned_time": ts_lit(as_of)}, update_values={"scanned_time": ts_lit(as_of)},
                 id_floor=id_floor, sequence=sequence)
    there = good.select("device_uuid", "path").unionByName(
        devices.select("device_uuid", F.lit(None).cast("string").alias("path")))
    return ScanResult(delete_vanished(res.table, there),
                      upsert_progress(progress, counts, as_of, sequence=progress_sequence), counts,
                      rows.where(F.col("error").isNotNull()), stats)


def pre_scan_totals(listing: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """A4: number and byte sum of eligible files (only ``size`` is read)."""
    g = listing.groupBy(*group_cols) if group_cols else listing.groupBy()
    return g.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))


def scan_stats(files: DataFrame, eligible: Column, elapsed_seconds: float,
               group_cols: Sequence[str] = ()) -> DataFrame:
    """A5: processed / skipped / error counts, percent done (0 when nothing eligible),
    GB processed and files per second (0 when no time elapsed)."""
    err = F.col("error").isNotNull()
    g = files.groupBy(*group_cols) if group_cols else files.groupBy()
    return _rates(g.agg(*_counters(eligible, err)), elapsed_seconds, group_cols)


COUNTERS = ["total_files", "processed_files", "skipped_files", "error_files", "total_size"]


def _counters(eligible: Column, err: Column) -> list[Column]:
    return [F.count_if(eligible).alias("total_files"),
            F.count_if(eligible & ~err).alias("processed_files"),
            F.count_if(~eligible).alias("skipped_files"),
            F.count_if(eligible & err).alias("error_files"),
            F.coalesce(F.sum(F.when(eligible & ~err, F.col("size"))), F.lit(0)).cast("long").alias("total_size")]


def _rates(counted: DataFrame, elapsed_seconds: float, group_cols: Sequence[str] = ()) -> DataFrame:
    return counted.select(
        *group_cols, *COUNTERS,
        F.round(percent("processed_files", "total_files"), 6).alias("percent"),
        F.round(gigabytes("total_size"), 9).alias("gb"),
        F.round(rate("processed_files", F.lit(float(elapsed_seconds))), 6).alias("files_per_sec"))


def observed_stats(spark: SparkSession, observation: Observation, elapsed_seconds: float) -> DataFrame:
    """``scan_stats`` from the counters that a finished job left in ``observe_scan``'s observation."""
    got = observation.get
    row = spark.createDataFrame([tuple(got[c] for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
    return _rates(row, elapsed_seconds)


def dedupe_paths(listing: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per path (the last by ``order_col`` when given)."""
    if order_col is None:
        return listing.dropDuplicates(["path"])
    from .upsert import latest_per_key
    return latest_per_key(listing, ["path"], order_col)


def observe_scan(files: DataFrame, eligible: Column, name: str = "scan_counters"):
    """A5 runtime counters: the same counts as ``scan_stats`` gathered as a side effect of
    whatever action runs ``files`` (``df.observe``), so the scan is not read twice.
    Returns ``(observed_df, observation)``; ``observation.get`` is filled after the action."""
    obs = Observation(name)
    return files.observe(obs, *_counters(eligible, F.col("error").isNotNull())), obs


def scan_result_counts(stored: DataFrame, scanned: DataFrame, keys: Sequence[str] = ("device_uuid", "path"),
                       order_col=None) -> DataFrame:
    """Per (device, scanning system) the number of files written and how many were
    new (key not stored before). The scan is first reduced to one row per key (the last
    write when ``order_col`` is given); only the key columns of ``stored`` are read."""
    keys = list(keys)
    s = scanned
    if order_col is not None:
        from .upsert import latest_per_key
        s = latest_per_key(s, keys, order_col)
    known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
    j = s.select(*keys, "system_id").join(known, keys, "left")
    return j.groupBy("device_uuid", "system_id").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("_known").isNull()).alias("new_files"))
