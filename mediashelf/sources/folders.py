"""Small file-system steps of the driver, through Hadoop's API so that they work on every store that
Spark reads: list, test, delete, claim (create a file that must not exist), and tiny JSON records."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def matches(spark: SparkSession, pattern: str) -> list[tuple[str, bool]]:
    """Local paths that a path or pattern names, and whether each is a folder; none on other stores."""
    fs, p = _at(spark, pattern)
    found = fs.globStatus(p) if fs.getScheme() == "file" else None
    return [(s.getPath().toUri().getPath(), s.isDirectory()) for s in found] if found is not None else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False when somebody has already done so. Only one of several callers gets True
    where the store creates files atomically, as HDFS and local disks do."""
    fs, p = _at(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":  # Hadoop's local file system looks and creates in two steps
        return spark._jvm.java.io.File(p.toUri().getPath()).createNewFile()
    try:
        fs.create(p, False).close()
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise e
    return True


def write_json(spark: SparkSession, path: str, value) -> None:
    """Write a record under a name of its own first, so that no reader sees a part of it."""
    fs, p = _at(spark, path)
    _, made = _at(spark, f"{path}-{uuid.uuid4().hex}.part")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(made, p):
        raise RuntimeError(f"{path} could not be written")


def read_json(spark: SparkSession, path: str):
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()
