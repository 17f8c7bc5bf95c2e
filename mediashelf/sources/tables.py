"""Catalogue table sink: bucketed on the join-key prefix so later joins co-locate.

A ``files`` version written with ``save_bucketed(df, name, BUCKET_KEYS["files"])`` is read back
with its bucket spec: the upsert's left join, the insert anti join, the scan diff and the
sync joins on that key then shuffle only the (small) batch side into the table's
buckets; the table itself is scanned bucket by bucket without an exchange. Each version
is a new table (never overwrite what is being read).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# Buckets of a catalogue table: size for ~128-512 MB per bucket file at the target scale
# (e.g. 8,192 for tens of TB of file rows); tests use a handful.
DEFAULT_BUCKETS = 8192


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int = DEFAULT_BUCKETS,
                  partition_by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Write ``df`` as table ``table`` bucketed (and sorted) by ``keys``; return the table."""
    w = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return df.sparkSession.table(table)
