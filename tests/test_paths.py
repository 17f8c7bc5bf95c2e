"""Path scalars: the reference's unit cases and property tests against a plain-Python
statement of each rule."""

import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediashelf.functions import paths as P


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("r")).first()["r"]


def test_normalize(spark):
    assert one(spark, P.normalize_path("p"), p="C:\\Users\\test\\Documents") == "C:/Users/test/Documents"
    assert one(spark, P.normalize_path("p"), p=None) is None


def test_relative_path_cases(spark):
    rp = P.relative_path("p", "m")
    assert one(spark, rp, p="/Volumes/External/Photos/image.jpg", m="/Volumes/External") == "Photos/image.jpg"
    assert one(spark, rp, p="/Volumes/External/Photos/image.jpg", m="/Volumes/Externa") == "Photos/image.jpg"
    assert one(spark, rp, p="/some/other/path/image.jpg", m="/Volumes/External") == "/some/other/path/image.jpg"
    assert one(spark, rp, p="/a/b.jpg", m="/") == "/a/b.jpg"
    assert one(spark, rp, p="/V/x/y", m="/V//") == "x/y"
    # an empty path component matches any last mount component
    assert one(spark, rp, p="/V//y", m="/V/Disk") == "y"
    assert one(spark, rp, p="C:\\d\\e.jpg", m="C:\\d") == "e.jpg"


def test_platform_path_cases(spark):
    pp = P.platform_path("r", "m")
    assert one(spark, pp, r="/Photos/image.jpg", m="/Volumes/External/") == "/Volumes/External/Photos/image.jpg"
    assert one(spark, pp, r="a/b", m="/") == "a/b"
    assert one(spark, pp, r="//a", m="/m") == "/a"
    assert one(spark, P.platform_path("r", "m", system="Windows"), r="a/b", m="D:") == "D:\\a\\b"


def test_mount_points(spark):
    assert one(spark, P.extract_mount_point("p", "Darwin"), p="/Volumes/External/a/b") == "/Volumes/External"
    assert one(spark, P.extract_mount_point("p", "Linux"), p="/media/user/External/a") == "/media/user/External"
    assert one(spark, P.extract_mount_point("p", "Windows"), p="C:/x/y") == "C:"
    assert one(spark, P.extract_mount_point("p", "Plan9"), p="/media/user/External/a") is None
    assert P.mount_point_pattern("Plan9") == P.mount_point_pattern("Linux")


def test_extension_cases(spark):
    cases = {"a.b.JPG": ".jpg", ".jpg": "", "..a.b": ".b", "a.": ".", "noext": "", "d.x/noext": ""}
    for p, want in cases.items():
        assert one(spark, P.extension("p"), p=p) == want, p


# --- plain-Python statements of the rules (written from SURVEY 2.13) -------------------

def py_relative(full, mount):
    full = full.replace("\\", "/")
    mount = mount.replace("\\", "/").rstrip("/")
    if mount == "":
        return full
    if full.startswith(mount + "/"):
        return full[len(mount) + 1:]
    pf, pm = full.split("/"), mount.split("/")
    if len(pm) >= 2 and len(pf) >= len(pm) and pf[:len(pm) - 1] == pm[:len(pm) - 1]:
        a, b = pm[-1], pf[len(pm) - 1]
        if (a != "" and b != "" and a in b) or (b in a):
            return "/".join(pf[len(pm):])
    return full


def py_platform(rel, mount):
    rel, mount = rel.replace("\\", "/"), mount.replace("\\", "/")
    if mount.endswith("/"):
        mount = mount[:-1]
    if rel.startswith("/"):
        rel = rel[1:]
    return posixpath.join(mount, rel)


def py_ext(p):
    return posixpath.splitext(p)[1].lower()


path_text = st.text(alphabet="/\\.abAB_ ", max_size=14)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(path_text, path_text), min_size=1, max_size=40))
def test_relative_path_property(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, m string")
    got = [r["r"] for r in df.select(P.relative_path("p", "m").alias("r")).collect()]
    assert got == [py_relative(p, m) for p, m in pairs]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(path_text, path_text), min_size=1, max_size=40))
def test_platform_path_property(spark, pairs):
    df = spark.createDataFrame(pairs, "r string, m string")
    got = [r["r"] for r in df.select(P.platform_path("r", "m").alias("r")).collect()]
    assert got == [py_platform(r, m) for r, m in pairs]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="/.aJPG", max_size=12), min_size=1, max_size=40))
def test_extension_property(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r["r"] for r in df.select(P.extension("p").alias("r")).collect()]
    assert got == [py_ext(n) for n in names]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="/ab.", max_size=10), min_size=1, max_size=30))
def test_basename_dirname_property(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [(r["b"], r["d"]) for r in df.select(P.basename("p").alias("b"), P.dirname("p").alias("d")).collect()]
    assert got == [(posixpath.basename(n), posixpath.dirname(n)) for n in names]
