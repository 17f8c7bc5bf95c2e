"""Catalogue tables derived from the driver's TPC-H-ish parquet tables.

The mapping is fixed (see FIXTURES.md part B) so that the same rows can be rebuilt in
SQL by the oracle. Every view is a projection of one base table (plus one aggregate for
``scan_progress``), so Catalyst prunes the parquet columns it does not need and pushes
filters written against the derived columns down where they are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# Fixed values of the derived views (FIXTURES.md part B).
EXTENSIONS_BY_KEY_MOD_12 = [".jpg", ".JPG", ".jpeg", ".png", ".gif", ".mp4", ".mov",
                            ".avi", ".mkv", ".mp3", ".pdf", ""]
DETECTION_LABELS_BY_SUPP_MOD_6 = ["person", "dog", "car", "cat", "tree", "face"]
CAMERAS_BY_KEY_MOD_4 = ["iPhone 12", "Canon EOS R5", "NIKON Z6", None]
OBJECTS_BY_CUST_MOD_3 = ['["dog","person"]', '["car"]', None]


def _pick(index: Column, values: list) -> Column:
    """``values[index]`` as a CASE expression (stays inside codegen)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(index == i, lit) if expr is None else expr.when(index == i, lit)
    return expr


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    grp = F.floor(k / 3).cast("int").cast("string")
    return s.select(
        (k + 1).alias("id"),
        F.concat(F.lit("dev-"), grp).alias("uuid"),
        F.when(k % 3 == 0, F.concat(F.lit("/Volumes/Disk"), grp))
        .when(k % 3 == 1, F.concat(F.lit("/media/u/Disk"), grp))
        .otherwise(F.lit("D:")).alias("mount_path"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("s_name")).alias("label"),
        _ts("1995-01-01 00:00:00").alias("first_seen"),
        _ts("2001-01-01 00:00:00").alias("last_seen"),
        F.concat(F.lit("sys-"), (k % 3).cast("string")).alias("system_id"),
        F.when(k % 4 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(_ts("1999-06-01 00:00:00")).alias("last_sync"),
        (F.col("s_acctbal") > 0).alias("is_active"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("dev-"), (c % 34).cast("string")).alias("device_uuid"),
        F.concat(F.lit("dir"), (c % 7).cast("string"), F.lit("/"), F.lower("o_orderpriority"),
                 F.lit("/f"), k.cast("string"), _pick(k % 12, EXTENSIONS_BY_KEY_MOD_12)).alias("path"),
        F.when(k % 50 == 0, F.lit(None).cast("string")).otherwise(F.md5(c.cast("string"))).alias("hash"),
        F.floor(F.col("o_totalprice") * 1000).cast("bigint").alias("size"),
        F.when(k % 41 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("o_orderdate")).alias("modified_time"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("scanned_time"),
        F.lit(None).cast("timestamp_ntz").alias("last_accessed"),
        F.when(k % 23 == 0, F.lit("migration"))
        .otherwise(F.concat(F.lit("sys-"), (k % 3).cast("string"))).alias("system_id"),
        F.when(k % 5 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("last_sync"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("file_id"),
        _pick(F.col("l_suppkey") % 6, DETECTION_LABELS_BY_SUPP_MOD_6).alias("label"),
        (F.col("l_discount") * 10).alias("confidence"),
    )


def _image_columns(k: Column, c: Column) -> list[Column]:
    return [
        k.alias("file_id"),
        _pick(k % 4, CAMERAS_BY_KEY_MOD_4).alias("camera_model"),
        F.col("o_orderdate").alias("taken_time"),
        ((c % 180).cast("double") - 90).alias("gps_lat"),
        ((c % 360).cast("double") - 180).alias("gps_lon"),
        (c % 2 == 0).alias("has_faces"),
        _pick(c % 3, OBJECTS_BY_CUST_MOD_3).alias("objects"),
    ]


def image_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.where(k % 12 < 5).select(*_image_columns(k, c))


def image_analysis_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_analysis`` with the size, time and ownership columns (one projection)."""
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.where(k % 12 < 5).select(
        *_image_columns(k, c),
        ((c % 50) * 80).cast("int").alias("width"),
        ((c % 40) * 60).cast("int").alias("height"),
        (k * 10).alias("id"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS")).alias("analyzed_time"),
        F.when(k % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("sys-"), (k % 4).cast("string"))).alias("system_id"),
        F.when(k % 6 == 0, F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate") + F.expr("INTERVAL 100 DAYS")).alias("last_sync"),
    )


def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return scan_events_from(e)


def scan_events_from(e: DataFrame) -> DataFrame:
    """Map raw ``events`` rows (batch or stream) to file events."""
    u = F.col("user_id")
    return e.select(
        F.col("event_id"),
        F.concat(F.lit("dev-"), (u % 34).cast("string")).alias("device_uuid"),
        F.concat(F.lit("sys-"), (u % 3).cast("string")).alias("system_id"),
        F.concat(F.lit("e/"), (F.col("event_id") % 500).cast("string"), F.lit(".jpg")).alias("path"),
        F.when(F.col("event_type") == "error", F.lit("delete")).otherwise(F.lit("upsert")).alias("op"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("size"),
        F.col("ts"),
    )


def stored_events_from(e: DataFrame, files: DataFrame) -> DataFrame:
    """As ``scan_events_from``, but every third event names the stored file with its id, when
    there is one: such events update and delete catalogue rows."""
    named = files.select(F.col("id").alias("_id"), F.col("device_uuid").alias("_dev"), F.col("path").alias("_path"))
    key = F.when(F.col("event_id") % 3 == 0, F.col("event_id"))
    j = scan_events_from(e).join(named, key == F.col("_id"), "left")
    return j.select("event_id", F.coalesce("_dev", "device_uuid").alias("device_uuid"), "system_id",
                    F.coalesce("_path", "path").alias("path"), "op", "size", "ts")


def device_mount_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("dev-"), (c % 40 + 20).cast("string")).alias("device_uuid"),
        F.concat(F.lit("sys-"), (k % 4).cast("string")).alias("system_id"),
        F.concat(F.lit("/mnt/m"), (k % 997).cast("string")).alias("mount_path"),
        F.col("o_orderdate").alias("last_updated"),
    )


def scan_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One progress row per (device_uuid, system_id) seen in ``files``."""
    f = files(spark, sf_dir)
    return f.groupBy("device_uuid", "system_id").agg(
        F.min("id").alias("id"),
        F.count("*").alias("total_files"),
        F.count_if(F.col("id") % 2 == 0).alias("new_files"),
        F.max("scanned_time").alias("last_updated"),
        F.max("last_sync").alias("last_sync"),
    )


def file_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rescan batch: one file-info row per lineitem of the file's order.

    Lines 1-2 rewrite the existing path, later lines two new paths (``.v1`` / ``.v0``),
    so keys repeat inside the batch (``ord`` = line number: the later write wins); a
    returned odd line carries an ``error`` (a failed stat) and must be skipped.
    """
    f = files(spark, sf_dir).select("id", "device_uuid", "path", "system_id")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    ln = F.col("l_linenumber")
    j = f.join(li, f.id == li.l_orderkey)
    return j.select(
        "device_uuid",
        F.when(ln <= 2, F.col("path"))
        .otherwise(F.concat(F.col("path"), F.lit(".v"), (ln % 2).cast("string"))).alias("path"),
        "system_id",
        F.floor(F.col("l_extendedprice") * 1000).cast("bigint").alias("size"),
        F.md5(F.col("l_partkey").cast("string")).alias("hash"),
        F.col("l_shipdate").alias("modified_time"),
        # write order: line number, ties (repeated line numbers) broken by part and supplier
        (ln.cast("bigint") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("ord"),
        F.floor(F.col("l_extendedprice") * 100).cast("bigint").alias("ord2"),
        F.when((F.col("l_returnflag") == "R") & (ln % 2 == 1), F.lit("stat failed"))
        .otherwise(F.lit(None).cast("string")).alias("error"),
    )


def file_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access events: one per lineitem, on the file of its order, at its ship date."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("file_id"), F.col("l_shipdate").alias("ts"))


def seen_devices(spark: SparkSession, sf_dir: str, with_null: bool = False) -> DataFrame:
    """Devices one system reports: one per nation (region 0 nations are new uuids)."""
    n = read_table(spark, sf_dir, "nation")
    uuid = F.when(F.col("n_regionkey") == 0, F.concat(F.lit("new-"), F.col("n_nationkey").cast("string"))) \
        .otherwise(F.concat(F.lit("dev-"), F.col("n_nationkey").cast("string")))
    out = n.select(uuid.alias("uuid"), F.concat(F.lit("/Volumes/"), F.col("n_name")).alias("mount_path"),
                   F.col("n_name").alias("label"))
    if with_null:
        out = out.unionByName(n.where(F.col("n_nationkey") == 0).select(
            F.lit(None).cast("string").alias("uuid"), F.lit("/Volumes/none").alias("mount_path"),
            F.lit("none").alias("label")))
    return out


_INV_AT = "2024-01-01 00:00:00"


def _host_num(col):
    return col % 8


def _host_os(h):
    return (F.when(h <= 2, F.lit("Linux")).when(h <= 4, F.lit("Darwin"))
            .when(h <= 6, F.lit("Windows")).otherwise(F.lit("Plan9")))


def inventory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured inventory text: per supplier up to four lines on host ``s_nationkey % 8``
    in the format of that host's OS (hosts 0-2 Linux, 3-4 macOS, 5-6 Windows, 7 other)."""
    s = read_table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    ks = k.cast("string")
    h = _host_num(n)
    linux = (F.when(k % 5 == 0, F.concat(F.lit("/dev/sda"), ks, F.lit(" U"), ks, F.lit(" /media/u/Disk "), ks))
             .when(k % 5 == 1, F.concat(F.lit("/dev/sdb"), ks, F.lit(" U"), ks, F.lit(" /boot")))
             .when(k % 5 == 2, F.concat(F.lit("/dev/sdc"), ks, F.lit(" U"), ks))
             .when(k % 5 == 3, F.concat(F.lit("  /dev/sdd"), ks, F.lit("   U"), ks, F.lit("   /mnt/n"),
                                        n.cast("string"), F.lit("  ")))
             .otherwise(F.concat(F.lit("/dev/sde"), ks, F.lit(" U"), ks, F.lit(" /"))))
    mac_mount = (F.when(k % 6 == 0, F.concat(F.lit("/Volumes/Disk"), ks))
                 .when(k % 6 == 1, F.lit("(not mounted)"))
                 .when(k % 6 == 2, F.concat(F.lit("/Volumes/Recovery"), ks))
                 .when(k % 6 == 3, F.lit("/Volumes/VM"))
                 .when(k % 6 == 4, F.lit("/"))
                 .otherwise(F.concat(F.lit("/Volumes/Shared"), (k % 4).cast("string"))))
    mac = [
        F.when(k % 9 == 0, F.lit("Device Identifier:")).otherwise(F.concat(F.lit("Device Identifier: disk"), ks)),
        F.when(k % 7 == 0, F.lit("   Volume Name: X")).otherwise(F.concat(F.lit("   Volume UUID: V"), (k % 50).cast("string"))),
        F.concat(F.lit("   Mount Point:   "), mac_mount),
        F.when(k % 4 == 0, F.lit("   Mount Point: (not mounted)")).otherwise(F.lit("   Bus Protocol: USB")),
    ]
    win = F.concat(F.chr(65 + k % 20), F.lit(": \\\\?\\Volume{"), ks, F.lit("}\\"))
    os_ = _host_os(h)
    base = s.select(F.concat(F.lit("host-"), h.cast("string")).alias("host"), os_.alias("os"),
                    # a capture is one command's output: one per block of suppliers and host
                    F.timestamp_add("HOUR", F.floor(k / 64).cast("int"), F.lit(_INV_AT).cast("timestamp_ntz"))
                    .alias("captured_at"), k.alias("k"),
                    linux.alias("linux"), win.alias("win"), *[m.alias(f"mac{i}") for i, m in enumerate(mac)])
    out = None
    for i in range(4):
        line = (F.when(F.col("os") == "Darwin", F.col(f"mac{i}"))
                .when(F.col("os") == "Windows", F.col("win")).otherwise(F.col("linux")))
        part = base.select("host", "os", "captured_at", (F.col("k") * 10 + i).alias("seq"), line.alias("line"))
        if i > 0:
            part = part.where(F.col("os") == "Darwin")
        out = part if out is None else out.unionByName(part)
    return out


def inventory_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One home directory per host (host 0's home is also one of its listed mounts)."""
    n = read_table(spark, sf_dir, "nation")
    h = _host_num(F.col("n_nationkey"))
    hs = h.cast("string")
    return n.select(F.concat(F.lit("host-"), hs).alias("host"),
                    F.lit(_INV_AT).cast("timestamp_ntz").alias("captured_at"),
                    F.concat(F.lit("node."), F.lit("host-"), hs, F.lit(".lan")).alias("node"),
                    F.when(h == 0, F.lit("/mnt/n0")).otherwise(F.concat(F.lit("/home/u"), hs)).alias("home_dir")
                    ).distinct()


def legacy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as an older catalogue held them: even ids carry absolute paths (under the
    ``sys-0`` mount of their device, or ``/x`` when there is none); owners NULL / ''."""
    f = files(spark, sf_dir)
    d = devices(spark, sf_dir).where(F.col("system_id") == "sys-0").select(
        F.col("uuid").alias("_u"), F.col("mount_path").alias("_m"))
    j = f.join(d, f.device_uuid == d._u, "left")
    k = F.col("id")
    return j.select(
        "id", "device_uuid",
        F.when(k % 2 == 0, F.concat(F.coalesce("_m", F.lit("/x")), F.lit("/"), F.col("path")))
        .otherwise(F.col("path")).alias("path"),
        "hash", "size", "modified_time", "scanned_time", "last_accessed",
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, F.lit(""))
        .otherwise(F.col("system_id")).alias("system_id"),
        "last_sync")


def legacy_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with owners partly missing (NULL / '')."""
    d = devices(spark, sf_dir)
    k = F.col("id")
    return d.withColumn("system_id", F.when(k % 4 == 0, F.lit(None).cast("string"))
                        .when(k % 4 == 1, F.lit("")).otherwise(F.col("system_id")))


def exif_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF tag rows ``(file_id, tag, value)`` of the image files (keys ``% 12 < 5``)."""
    o = read_table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 12 < 5)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    cam = _pick(k % 4, CAMERAS_BY_KEY_MOD_4)

    def part(tag, value, cond=None):
        d = o if cond is None else o.where(cond)
        return d.select(k.alias("file_id"), F.lit(tag).alias("tag"), value.alias("value"))

    parts = [
        part("Image Model", cam, cam.isNotNull()),
        part("EXIF DateTimeOriginal", F.when(k % 13 == 0, F.lit("unknown"))
             .otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))),
        part("GPS GPSLatitude", F.concat((c % 90).cast("string"), F.lit("/1, "), (c % 60).cast("string"),
                                         F.lit("/1, "), (k % 6000).cast("string"),
                                         F.when(k % 17 == 0, F.lit("/0")).otherwise(F.lit("/100")))),
        part("GPS GPSLatitudeRef", F.when(c % 2 == 0, F.lit("N")).otherwise(F.lit("S")), k % 19 != 0),
        part("GPS GPSLongitude", F.concat((c % 180).cast("string"), F.lit("/1,"), (k % 60).cast("string"),
                                          F.lit("/1,0/1"))),
        part("GPS GPSLongitudeRef", F.when(k % 2 == 0, F.lit("E")).otherwise(F.lit("W"))),
        part("PIL width", (640 + k % 1000).cast("string")),
        part("PIL height", (480 + c % 500).cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def video_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video probe rows: frames, fps (0 for keys ``% 5 = 0``), size, creation time."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("file_id"), (F.col("o_custkey") * 10).alias("frame_count"),
                    F.when(k % 5 == 0, F.lit(0)).otherwise(24 + k % 7).cast("double").alias("fps"),
                    (1920 - (k % 3) * 640).alias("width"), F.lit(1080).alias("height"),
                    F.col("o_orderdate").alias("created_time"))
