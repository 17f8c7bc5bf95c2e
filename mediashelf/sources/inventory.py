"""Device inventories (S4-S8, U1, J11) from captured command output.

Input rows are ``(host, os, captured_at, seq, line)``: the text a fleet collector
captured from ``lsblk`` (Linux), ``diskutil info -all`` (macOS) or ``wmic volume``
(Windows), one row per line. Every host capture is parsed independently, so the work
partitions by ``(host, captured_at)``; one capture is one command's output (bounded), and
the only window (the macOS volume fold) runs inside one capture.

Output rows are ``(host, captured_at, mount_path, uuid, seq)`` where ``seq`` is the
position of the mount's first appearance (dictionary insertion order) and ``uuid`` is
the last value written for that mount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename

CAPTURE = ["host", "captured_at"]

# Fixed values of the inventory parsers.
LINUX_SKIP_MOUNTS = ["/boot", "/"]
MAC_VOLUME_MARKER = "Device Identifier:"
MAC_UUID_MARKER = "Volume UUID:"
MAC_MOUNT_MARKER = "Mount Point:"
MAC_NOT_MOUNTED = "(not mounted)"
MAC_KEEP_PREFIX = "/Volumes/"
MAC_DROP_PREFIXES = ["/Volumes/Recovery", "/Volumes/VM"]
WINDOWS_SKIP_DRIVE = "C:"


def _tokens(line):
    # str.split(): runs of whitespace, leading/trailing whitespace ignored
    t = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def _last_per_mount(df: DataFrame) -> DataFrame:
    """Dictionary semantics: the last write per mount wins, its position is the first."""
    return (df.groupBy(*CAPTURE, "mount_path")
            .agg(F.max_by("uuid", "seq").alias("uuid"), F.min("seq").alias("seq")))


def linux_devices(lines: DataFrame) -> DataFrame:
    """``NAME UUID MOUNTPOINT`` lines; >= 3 tokens; mount = tokens 3.. joined by one
    space (positional: a line lacking a UUID shifts); ``/boot`` and ``/`` dropped."""
    t = lines.select(*CAPTURE, "seq", _tokens(F.col("line")).alias("t"))
    t = t.where(F.size("t") >= 3).select(
        *CAPTURE, "seq", F.col("t")[1].alias("uuid"),
        F.array_join(F.slice("t", 3, F.size("t") - 2), " ").alias("mount_path"))
    t = t.where(~F.col("mount_path").isin(LINUX_SKIP_MOUNTS) & (F.col("uuid") != "") & (F.col("mount_path") != ""))
    return _last_per_mount(t)


def macos_devices(lines: DataFrame) -> DataFrame:
    """S5 (W5): fold of ``diskutil info -all``. A volume starts at a ``Device
    Identifier:`` line; it keeps the last ``Volume UUID:`` value and the last *valid*
    mount (a later ``(not mounted)`` does not erase an earlier mount). Volumes with a
    non-empty identifier, a UUID and a mount are kept; later volumes overwrite a mount.
    Then only ``/Volumes/*`` (except Recovery / VM prefixes) and ``/`` stay."""
    l = lines.select(*CAPTURE, "seq", F.regexp_replace("line", r"^\s+|\s+$", "").alias("l"))
    is_vol = F.startswith("l", F.lit(MAC_VOLUME_MARKER))
    is_uuid = ~is_vol & F.contains("l", F.lit(MAC_UUID_MARKER))
    is_mount = ~is_vol & ~is_uuid & F.contains("l", F.lit(MAC_MOUNT_MARKER))
    w = Window.partitionBy(*CAPTURE).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("vol", F.count_if(is_vol).over(w))
    value = F.regexp_replace(F.regexp_extract("l", r"^[^:]*:(.*)$", 1), r"^\s+|\s+$", "")
    ident = F.regexp_replace(F.try_element_at(F.split("l", ":"), F.lit(2)), r"^\s+|\s+$", "")
    mount_ok = is_mount & (value != "") & (value != MAC_NOT_MOUNTED)
    per_vol = (l.where(F.col("vol") > 0)
               .groupBy(*CAPTURE, "vol")
               .agg(F.max_by(F.when(is_vol, ident), F.when(is_vol, F.col("seq"))).alias("ident"),
                    F.max_by(F.when(is_uuid, value), F.when(is_uuid, F.col("seq"))).alias("uuid"),
                    F.max_by(F.when(mount_ok, value), F.when(mount_ok, F.col("seq"))).alias("mount_path")))
    vols = per_vol.where((F.col("ident") != "") & F.col("uuid").isNotNull() & F.col("mount_path").isNotNull())
    devs = _last_per_mount(vols.withColumnRenamed("vol", "seq"))
    keep = (F.startswith("mount_path", F.lit(MAC_KEEP_PREFIX))
            & ~F.exists(F.array(*[F.lit(p) for p in MAC_DROP_PREFIXES]),
                        lambda p: F.startswith(F.col("mount_path"), p))) | (F.col("mount_path") == "/")
    return devs.where(keep)


def windows_devices(lines: DataFrame) -> DataFrame:
    """First line is a header; >= 2 tokens; drive = token 1, id = token 2; ``C:`` dropped."""
    first = lines.groupBy(*CAPTURE).agg(F.min("seq").alias("_first"))
    t = lines.join(first, CAPTURE).where(F.col("seq") > F.col("_first"))
    t = t.select(*CAPTURE, "seq", _tokens(F.col("line")).alias("t")).where(F.size("t") >= 2)
    t = t.select(*CAPTURE, "seq", F.col("t")[0].alias("mount_path"), F.col("t")[1].alias("uuid"))
    return _last_per_mount(t.where(F.col("mount_path") != WINDOWS_SKIP_DRIVE))


def home_devices(homes: DataFrame, found: DataFrame) -> DataFrame:
    """``HOME-<node with . -> ->-<basename(home)>`` for a home not already a mount;
    it is inserted after every listed mount."""
    h = homes.select(*CAPTURE, F.col("home_dir").alias("mount_path"),
                     F.concat(F.lit("HOME-"), F.replace("node", F.lit("."), F.lit("-")), F.lit("-"),
                              basename("home_dir")).alias("uuid"),
                     F.lit(1 << 40).cast("bigint").alias("seq"))
    return h.join(found.select(*CAPTURE, "mount_path"), [*CAPTURE, "mount_path"], "left_anti")


def all_devices(lines: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """Per capture, the OS parser chosen by the ``os`` column, plus the home
    pseudo-device. An unsupported OS lists nothing (its home is still added)."""
    parts = [linux_devices(lines.where(F.col("os") == "Linux")),
             macos_devices(lines.where(F.col("os") == "Darwin")),
             windows_devices(lines.where(F.col("os") == "Windows"))]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if homes is not None:
        found = found.unionByName(home_devices(homes, found))
    return found.select(*CAPTURE, "mount_path", "uuid", F.col("seq").cast("bigint").alias("seq"))


def first_mount_of_uuid(devices: DataFrame) -> DataFrame:
    """Per capture and uuid, the first mount (insertion order) carrying it."""
    return devices.groupBy(*CAPTURE, "uuid").agg(F.min_by("mount_path", "seq").alias("mount_path"))
