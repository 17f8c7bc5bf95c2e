"""Image / video analysis over detection, tag and probe tables (A8, A9, X25, X26, F5-F7,
K7, K8, L3).

Decoding images, reading EXIF headers and running models are per-file libraries and
stay outside; their outputs arrive as tables that Spark groups and joins:
``detections(file_id, label, confidence)``, ``tags(file_id, tag, value)`` and
``probes(file_id, frame_count, fps, width, height)``. A ``mapInPandas`` hook lets a user
plug a detector that turns ``(file_id, content)`` into detection rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media_meta import exif_time, gps_decimal, labels_to_json, video_duration
from .upsert import UpsertResult, ts_lit, upsert

# Image / video path patterns of the analysers (F5-F7), case-sensitive LIKE.
IMAGE_PATTERNS = ["%.jpg", "%.jpeg", "%.png"]
VIDEO_PATTERNS = ["%.mp4", "%.avi", "%.mov", "%.mkv"]
# Face detection threshold and label.
FACE_LABEL = "face"
FACE_MIN_CONFIDENCE = 0.5
# Tag names read from EXIF (X25) and the image-size pseudo tags.
TAG_MODEL = "Image Model"
TAG_TAKEN = "EXIF DateTimeOriginal"
TAG_LAT = "GPS GPSLatitude"
TAG_LAT_REF = "GPS GPSLatitudeRef"
TAG_LON = "GPS GPSLongitude"
TAG_LON_REF = "GPS GPSLongitudeRef"
TAG_WIDTH = "PIL width"
TAG_HEIGHT = "PIL height"
EXIF_TAGS = [TAG_MODEL, TAG_TAKEN, TAG_LAT, TAG_LAT_REF, TAG_LON, TAG_LON_REF, TAG_WIDTH, TAG_HEIGHT]


def _any_like(col: str, patterns: list[str], case_sensitive: bool = True):
    c = F.col(col)
    out = None
    for p in patterns:
        t = c.like(p) if case_sensitive else c.ilike(p)
        out = t if out is None else out | t
    return out


def select_images(files: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """Files whose path ends in .jpg / .jpeg / .png (LIKE: ``.JPG`` is missed)."""
    return files.where(_any_like("path", IMAGE_PATTERNS, case_sensitive)).select(F.col("id").alias("file_id"), "path")


def select_videos(files: DataFrame, case_sensitive: bool = True) -> DataFrame:
    """files ending in .mp4 / .avi / .mov / .mkv."""
    return files.where(_any_like("path", VIDEO_PATTERNS, case_sensitive)).select(F.col("id").alias("file_id"), "path")


def cap(df: DataFrame, limit: int | None, order_col: str = "file_id") -> DataFrame:
    """L3: the first ``limit`` rows by ``order_col`` (the analysers' ``--limit``)."""
    return df.orderBy(order_col).limit(limit) if limit else df


def labels_per_file(detections: DataFrame) -> DataFrame:
    """A8 + A9: sorted distinct labels per file, and has_faces = some face detection with
    confidence >= 0.5. ``collect_set`` de-duplicates map-side, so a hot file costs one
    set of distinct labels per task, never its raw detections."""
    return detections.groupBy("file_id").agg(
        F.array_sort(F.collect_set("label")).alias("objects"),
        (F.count_if((F.col("label") == FACE_LABEL) & (F.col("confidence") >= FACE_MIN_CONFIDENCE)) > 0)
        .alias("has_faces"))


def _rationals(text):
    parts = F.split(F.regexp_replace(text, r"\s+", ""), ",")
    return F.transform(parts, lambda x: F.struct(
        F.try_element_at(F.split(x, "/"), F.lit(1)).try_cast("double").alias("num"),
        F.coalesce(F.try_element_at(F.split(x, "/"), F.lit(2)).try_cast("double"), F.lit(1.0)).alias("den")))


def _coord_ok(coord):
    return (F.size(coord) == 3) & F.forall(coord, lambda r: r["num"].isNotNull() & (r["den"] != 0))


def exif_fields(tags: DataFrame) -> DataFrame:
    """X25 (+ X23, X24): one row per file from its tag rows. GPS values are
    ``num/den,num/den,num/den`` texts; a coordinate that cannot be converted leaves it
    NULL, and a failed latitude also leaves the longitude NULL (one try block)."""
    p = tags.groupBy("file_id").pivot("tag", EXIF_TAGS).agg(F.max("value"))
    lat_c, lon_c = _rationals(F.col(f"`{TAG_LAT}`")), _rationals(F.col(f"`{TAG_LON}`"))
    lat_tags = F.col(f"`{TAG_LAT}`").isNotNull() & F.col(f"`{TAG_LAT_REF}`").isNotNull()
    lon_tags = F.col(f"`{TAG_LON}`").isNotNull() & F.col(f"`{TAG_LON_REF}`").isNotNull()
    lat_fail = lat_tags & ~_coord_ok(lat_c)
    lat = F.when(lat_tags & _coord_ok(lat_c), gps_decimal(lat_c, F.col(f"`{TAG_LAT_REF}`")))
    lon = F.when(lon_tags & _coord_ok(lon_c) & ~lat_fail, gps_decimal(lon_c, F.col(f"`{TAG_LON_REF}`")))
    return p.select(
        "file_id",
        F.col(f"`{TAG_MODEL}`").alias("camera_model"),
        exif_time(F.col(f"`{TAG_TAKEN}`")).alias("taken_time"),
        lat.alias("gps_lat"), lon.alias("gps_lon"),
        F.col(f"`{TAG_WIDTH}`").cast("int").alias("width"),
        F.col(f"`{TAG_HEIGHT}`").cast("int").alias("height"))


def image_analyses(images: DataFrame, tags: DataFrame, detections: DataFrame) -> DataFrame:
    """Per selected image: EXIF fields, has_faces (false when nothing detected) and the
    label list as JSON text (D14: objects are stored)."""
    ex = exif_fields(tags)
    lab = labels_per_file(detections)
    j = images.select("file_id").join(ex, "file_id", "left").join(lab, "file_id", "left")
    return j.select("file_id", "camera_model", "taken_time", "gps_lat", "gps_lon", "width", "height",
                    F.coalesce("has_faces", F.lit(False)).alias("has_faces"),
                    labels_to_json(F.coalesce("objects", F.array().cast("array<string>"))).alias("objects"))


def store_image_analyses(current: DataFrame, analyses: DataFrame, as_of, **ids) -> UpsertResult:
    """K7: ``INSERT OR REPLACE`` keyed by file_id: a new id, the listed columns, the
    analysis time = as_of, every other column NULL. A column that ``current`` lacks is an
    error: nothing that was computed is dropped. ``ids``: ``id_floor`` or ``sequence``, as in ``upsert``."""
    missing = sorted(set(analyses.columns) - set(current.columns))
    if missing:
        raise ValueError(f"the analysis table lacks {', '.join(missing)}")
    return upsert(current, analyses, ["file_id"], mode="replace",
                  insert_values={"analyzed_time": ts_lit(as_of)}, **ids)


def video_analyses(videos: DataFrame, probes: DataFrame) -> DataFrame:
    """duration = frames / fps when fps > 0; width, height, fps, creation time."""
    j = videos.select("file_id").join(probes, "file_id", "inner")
    return j.select("file_id", video_duration("frame_count", "fps").alias("duration"),
                    F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
                    F.col("fps").cast("double").alias("fps"), "created_time")


def store_video_analyses(current: DataFrame, analyses: DataFrame) -> UpsertResult:
    """K8: ``INSERT OR REPLACE`` of video rows keyed by file_id (no serial id)."""
    return upsert(current, analyses, ["file_id"], mode="replace", id_col=None, stamp_col=None)


DETECTION_SCHEMA = "file_id long, label string, confidence double"
DETECTED = DETECTION_SCHEMA + ", error string"
#: Files that are tried together after their batch has failed: few fail, and a call costs much beside a file.
PIECE = 8


def detect(images: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The detections of ``detect_files``, without its error rows."""
    return detect_files(images, model).where("error IS NULL").drop("error")


def detect_files(images: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame],
                 batch_bytes: int = 64 << 20) -> DataFrame:
    """Hook: run a user detector over ``(file_id, content)`` rows, for example of ``binaryFile``. The model gets a
    pandas frame of both columns with at most ``batch_bytes`` of content (or one file) and returns
    ``file_id, label, confidence`` rows, any number per file. No model ships.

    A batch that fails is tried again in pieces of ``PIECE`` files, and a piece that fails file by file: a file that
    fails alone, or has no content, gives one row with ``error`` and no label, and costs the others nothing. Contents
    are never shuffled."""
    from ..session import ship_package
    ship_package(images.sparkSession)

    def rows_of(part: pa.RecordBatch) -> pa.RecordBatch:
        got = model(part.to_pandas())[["file_id", "label", "confidence"]]
        columns = [pa.array(got["file_id"], pa.int64()), pa.array(got["label"], pa.string()),
                   pa.array(got["confidence"], pa.float64())]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(got), pa.string())], names=names)

    def failed(file_id: int | None, error: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file_id], pa.int64()), pa.nulls(1, pa.string()),
                                           pa.nulls(1, pa.float64()), pa.array([error])], names=names)

    def retried(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        try:
            got = rows_of(part)
        except Exception as e:  # the model's own failures are rows, not the job's
            got = failed(part.column(0)[0].as_py(), f"{type(e).__name__}: {e}") if part.num_rows == 1 else None
        if got is not None:
            yield got
            return
        step = PIECE if part.num_rows > PIECE else 1
        for a in range(0, part.num_rows, step):
            yield from retried(part.slice(a, step))
    names = [c.split()[0] for c in DETECTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pc.is_valid(batch.column(1)))
            for file_id in batch.filter(pc.is_null(batch.column(1))).column(0).to_pylist():
                yield failed(file_id, "no content")
            ends = np.cumsum(pc.binary_length(some.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < some.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + batch_bytes, "right")))
                part = some.slice(at, to - at)
                at = to
                yield from retried(part)
    return images.select(F.col("file_id").cast("long").alias("file_id"), "content").mapInArrow(run, DETECTED)
