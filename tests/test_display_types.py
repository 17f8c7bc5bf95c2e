"""Display projections (X14-X17), media types (X8-X10), metadata scalars."""

import mimetypes
import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediashelf.functions import display as D
from mediashelf.functions import media_meta as MM
from mediashelf.functions import media_types as MT


def py_size(n):
    if not n:
        return "0 B"
    if n > 1024 ** 3:
        return f"{n / 1024 ** 3:.2f} GB"
    if n > 1024 ** 2:
        return f"{n / 1024 ** 2:.2f} MB"
    if n > 1024:
        return f"{n / 1024:.2f} KB"
    return f"{n} B"


def test_human_size_cases(spark):
    cases = [(0, "0 B"), (None, "0 B"), (1024, "1024 B"), (1025, "1.00 KB"), (1152, "1.12 KB"),
             (1048576, "1024.00 KB")]
    df = spark.createDataFrame([(v,) for v, _ in cases], "n long")
    got = [r["r"] for r in df.select(D.human_size("n").alias("r")).collect()]
    assert got == [w for _, w in cases]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5000), st.integers(0, 1 << 42)), min_size=1, max_size=60))
def test_human_size_property(spark, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = [r["r"] for r in df.select(D.human_size("n").alias("r")).collect()]
    assert got == [py_size(n) for n in ns]


def test_shorten(spark):
    df = spark.createDataFrame([("a" * 64, "p" * 41, "m" * 26)], "h string, p string, m string")
    r = df.select(D.short_hash("h").alias("h"), D.short_path("p").alias("p"), D.short_mount("m").alias("m")).first()
    assert r["h"] == "a" * 10 + "..." and r["p"] == "p" * 37 + "..." and r["m"] == "m" * 22 + "..."


MIME = mimetypes.MimeTypes()  # built-in table only, no system files
WANT = {"image": ["image/jpeg", "image/png", "image/gif", "image/bmp", "image/tiff", "image/webp"],
        "video": ["video/mp4", "video/x-msvideo", "video/quicktime", "video/x-matroska", "video/x-ms-wmv",
                  "video/x-flv", "video/webm"],
        "audio": ["audio/mpeg", "audio/wav", "audio/aac", "audio/flac", "audio/ogg", "audio/mp4", "audio/x-ms-wma"]}


def py_type(p):
    ext = posixpath.splitext(p)[1].lower()
    mime = MIME.guess_type(p)[0]
    for t in ("image", "video", "audio"):
        if ext in MT.MEDIA_EXTENSIONS[t] or (mime and mime in WANT[t]):
            return t
    return None


def test_media_type_cases(spark):
    cases = {"x.JPG": "image", "x.tif": "image", "x.mkv": "video", "x.pdf": None, "x.jpg.gz": "image",
             "x.mp3.Z": "audio", "x.jpg.GZ": None, "a/.jpg": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r["p"]: r["t"] for r in df.select("p", MT.media_type("p").alias("t")).collect()}
    assert got == cases


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "d/b", ".h", "x.y"]),
                          st.sampled_from([".jpg", ".JPEG", ".tif", ".qt", ".mp2", ".webm", ".wav", ".txt",
                                           ".mkv", ".m4a", ""]),
                          st.sampled_from(["", ".gz", ".Z", ".bz2", ".br", ".xz", ".GZ"])),
                min_size=1, max_size=40))
def test_media_type_property(spark, parts):
    names = [a + b + c for a, b, c in parts]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r["t"] for r in df.select(MT.media_type("p").alias("t")).collect()]
    assert got == [py_type(n) for n in names]


def test_gps_and_times(spark):
    df = spark.createDataFrame([([(40, 1), (30, 1), (0, 1)], "S"), ([(1, 0), (0, 1), (0, 1)], "N")],
                               "c array<struct<num:long,den:long>>, ref string")
    got = [r["g"] for r in df.select(MM.gps_decimal("c", "ref").alias("g")).collect()]
    assert got[0] == -40.5 and got[1] is None
    df = spark.createDataFrame([("2022:05:01 10:11:12",), ("junk",)], "t string")
    got = [r["t"] for r in df.select(MM.exif_time("t").alias("t")).collect()]
    assert str(got[0]) == "2022-05-01 10:11:12" and got[1] is None
    df = spark.createDataFrame([(100, 0.0), (100, 25.0)], "f long, fps double")
    assert [r["d"] for r in df.select(MM.video_duration("f", "fps").alias("d")).collect()] == [None, 4.0]
    df = spark.createDataFrame([(0, 0), (5, 10)], "d long, t long")
    assert [r["p"] for r in df.select(MM.percent("d", "t").alias("p")).collect()] == [0.0, 50.0]


def test_times_do_not_depend_on_session_zone(spark):
    import datetime as dt
    from mediashelf.operators.upsert import ts_lit
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.createDataFrame([("2024:03:10 02:30:00", 1710037800.5)], "t string, e double")
        r = df.select(MM.exif_time("t").alias("t"), MM.epoch_to_timestamp("e").alias("e"),
                      ts_lit(dt.datetime(2024, 3, 10, 2, 30)).alias("a")).first()
        assert r["t"] == dt.datetime(2024, 3, 10, 2, 30)
        assert r["e"] == dt.datetime(2024, 3, 10, 2, 30, 0, 500000)
        assert r["a"] == dt.datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
