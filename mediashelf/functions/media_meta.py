"""Metadata scalars: times, GPS, video duration, flags, label lists, rates
(X21, X23, X24, X26-X29)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ColumnOrName, _c

# Fixed value: EXIF date-time text layout.
EXIF_TIME_FORMAT = "yyyy:MM:dd HH:mm:ss"


_EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_to_timestamp(seconds: ColumnOrName) -> Column:
    """Epoch seconds -> UTC wall-clock ``timestamp_ntz``, to the microsecond.

    Computed as epoch + microseconds, so the result does not depend on the session zone."""
    micros = F.rint(_c(seconds).cast("double") * 1_000_000).cast("bigint")  # half-even, as Python rounds
    return F.timestamp_add("MICROSECOND", micros, F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))


def exif_time(text: ColumnOrName) -> Column:
    """``YYYY:MM:DD HH:MM:SS`` text -> ``timestamp_ntz`` with the same wall clock;
    unparsable -> NULL. The text is parsed with an explicit ``+0000`` offset and moved to
    the epoch-based wall clock, so no session zone (or its DST gaps) can shift it."""
    instant = F.try_to_timestamp(F.concat(_c(text), F.lit(" +0000")), F.lit(EXIF_TIME_FORMAT + " Z"))
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))


def rational(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num/den as double, NULL when den = 0."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def gps_decimal(coord: ColumnOrName, ref: ColumnOrName) -> Column:
    """``array<struct<num,den>>`` degrees/minutes/seconds -> signed decimal degrees.

    ``S`` and ``W`` references are negative; a zero denominator gives NULL.
    """
    c = _c(coord)
    d = rational(c[0]["num"], c[0]["den"])
    m = rational(c[1]["num"], c[1]["den"])
    s = rational(c[2]["num"], c[2]["den"])
    dec = d + m / 60.0 + s / 3600.0
    return F.when(_c(ref).isin("S", "W"), -dec).otherwise(dec)


def video_duration(frame_count: ColumnOrName, fps: ColumnOrName) -> Column:
    """Frames / fps when fps > 0, else NULL."""
    return F.when(_c(fps) > 0, _c(frame_count).cast("double") / _c(fps)).otherwise(F.lit(None).cast("double"))


def flag_to_int(flag: ColumnOrName) -> Column:
    """Boolean -> 0/1."""
    return _c(flag).cast("int")


def to_flag(value: ColumnOrName) -> Column:
    """0/1 (or any) -> boolean."""
    return _c(value).cast("boolean")


def labels_from_json(text: ColumnOrName) -> Column:
    """JSON text list -> array<string>."""
    return F.from_json(_c(text), "array<string>")


def labels_to_json(arr: ColumnOrName) -> Column:
    """array<string> -> JSON text."""
    return F.to_json(_c(arr))


def percent(done: ColumnOrName, total: ColumnOrName) -> Column:
    """100 * done / total, 0 when total is 0."""
    return F.when(_c(total) == 0, F.lit(0.0)).otherwise(_c(done) * 100.0 / _c(total))


def rate(count: ColumnOrName, seconds: ColumnOrName) -> Column:
    """Count per second, 0 when elapsed is 0."""
    return F.when(_c(seconds) == 0, F.lit(0.0)).otherwise(_c(count) / _c(seconds))


def gigabytes(nbytes: ColumnOrName) -> Column:
    """Bytes / 1024^3."""
    return _c(nbytes) / float(1024 ** 3)
