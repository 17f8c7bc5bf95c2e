"""Content hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ColumnOrName, _c

# Fixed value: the length of the scanner's prefix hash, 10 MiB (callers ask for it explicitly).
HASH_PREFIX_BYTES = 10 * 1024 * 1024


def prefix_sha256(content: ColumnOrName, max_bytes: int) -> Column:
    """SHA-256 hex of the first ``max_bytes`` bytes (string input is hashed as UTF-8)."""
    b = _c(content).cast("binary")
    return F.sha2(F.substring(b, 1, max_bytes), 256)


def full_sha256(content: ColumnOrName) -> Column:
    """SHA-256 hex of the whole content, whatever its size (the directory walker hashes
    files beyond the column limit by ranged reads)."""
    return F.sha2(_c(content).cast("binary"), 256)
