"""Display projections (X14-X17) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ColumnOrName, _c

KIB = 1024
MIB = 1024 * 1024
GIB = 1024 * 1024 * 1024


def shorten(text: ColumnOrName, max_len: int, keep: int) -> Column:
    """Longer than ``max_len`` characters: first ``keep`` then ``...``."""
    t = _c(text)
    return F.when(F.length(t) > max_len, F.concat(F.substring(t, 1, keep), F.lit("..."))).otherwise(t)


def short_hash(h: ColumnOrName) -> Column:
    """Hashes over 10 characters show 10 then ``...``."""
    return shorten(h, 10, 10)


def short_path(p: ColumnOrName) -> Column:
    """Paths over 40 characters show 37 then ``...``."""
    return shorten(p, 40, 37)


def short_mount(m: ColumnOrName) -> Column:
    """Mounts over 25 characters show 22 then ``...``."""
    return shorten(m, 25, 22)


def _two_dec(x: Column, unit: str) -> Column:
    # bround = round half to even on the decimal value, as Python's format does for ties
    return F.format_string(f"%.2f {unit}", F.bround(x, 2))


def human_size(n: ColumnOrName) -> Column:
    """Strictly above 1 GiB / 1 MiB / 1 KiB two decimals, else ``n B``; NULL/0 -> ``0 B``."""
    x = _c(n)
    return (
        F.when(x.isNull() | (x == 0), F.lit("0 B"))
        .when(x > GIB, _two_dec(x / GIB, "GB"))
        .when(x > MIB, _two_dec(x / MIB, "MB"))
        .when(x > KIB, _two_dec(x / KIB, "KB"))
        .otherwise(F.concat(x.cast("string"), F.lit(" B")))
    )


# Fallback texts of the device summary.
NO_LABEL = "无标签"
NEVER_SCANNED = "未扫描"


def label_or_default(label: ColumnOrName) -> Column:
    """Empty or missing label -> fixed text."""
    return F.coalesce(F.nullif(_c(label), F.lit("")), F.lit(NO_LABEL))


def last_scan_text(ts: ColumnOrName) -> Column:
    """Last scan as text, or the never-scanned text."""
    return F.coalesce(F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss"), F.lit(NEVER_SCANNED))
