"""Media type detection (X8-X10) as Column expressions and a small reference table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import ColumnOrName, _c, extension

# The supported extensions per media type (X9), in declaration order.
MEDIA_EXTENSIONS = {
    "image": [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp"],
    "video": [".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm"],
    "audio": [".mp3", ".wav", ".aac", ".flac", ".ogg", ".m4a", ".wma"],
}
# Extensions whose standard-library MIME guess falls in the supported MIME
# types of each media type (Python 3.13 built-in table, no system files).
MIME_EXTENSIONS = {
    "image": [".bmp", ".gif", ".jpe", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"],
    "video": [".avi", ".mov", ".mp4", ".qt", ".webm"],
    "audio": [".aac", ".adts", ".ass", ".loas", ".mp2", ".mp3"],
}
# Compression suffixes the MIME guess looks through (case-sensitive).
ENCODING_SUFFIXES = [".gz", ".Z", ".bz2", ".xz", ".br"]
MEDIA_ORDER = ["image", "video", "audio"]


def _strip_encoding(path: Column) -> Column:
    alt = "|".join(s.replace(".", r"\.") for s in ENCODING_SUFFIXES)
    # only when the suffix is a real extension (something before it in the basename)
    return F.regexp_replace(path, rf"([^/.][^/]*)({alt})$", "$1")


def media_type(path: ColumnOrName) -> Column:
    """``image`` / ``video`` / ``audio`` / NULL, by extension or by MIME guess, image first."""
    p = _c(path)
    ext = extension(p)
    mime_ext = extension(_strip_encoding(p))
    out = None
    for t in MEDIA_ORDER:
        cond = ext.isin(MEDIA_EXTENSIONS[t]) | mime_ext.isin(MIME_EXTENSIONS[t])
        out = F.when(cond, F.lit(t)) if out is None else out.when(cond, F.lit(t))
    return out.otherwise(F.lit(None).cast("string"))


def is_media(path: ColumnOrName) -> Column:
    """X10."""
    return media_type(path).isNotNull()


def extensions_for(media: ColumnOrName) -> Column:
    """X9 as an expression: the extension list of a type column, empty when unknown."""
    m = _c(media)
    out = None
    for t in MEDIA_ORDER:
        arr = F.array(*[F.lit(e) for e in MEDIA_EXTENSIONS[t]])
        out = F.when(m == t, arr) if out is None else out.when(m == t, arr)
    return out.otherwise(F.array().cast("array<string>"))
