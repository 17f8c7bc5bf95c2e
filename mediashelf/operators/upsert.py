"""Set-based upserts (K1-K15 core), last-write-wins (W3), serial ids (W4), change counts.

Parquet tables have no row-level DML, so every operator here is a pure function
``(current, batch) -> new version``; the caller writes the result to a new location
(never over the path being read). One upsert is ``current LEFT JOIN batch`` (updated and
kept rows) plus ``batch LEFT ANTI current(keys)`` (inserted rows):

* both joins are on the *whole* key, so a device holding a third of all files still
  spreads over many partitions (the path is part of the key); a catalogue stored bucketed
  on the key prefix (``sources.tables``) is not shuffled at all;
* the batch is first reduced to one row per key with ``max_by`` (partial aggregation,
  map-side), so repeated events for one hot key never reach the join as duplicates, and
  checkpointed once because both joins read it;
* new serial ids are dense ranks in key order, computed from per-partition counts of a
  checkpointed, range-partitioned copy of the inserted rows only (no single-task window).
"""

from __future__ import annotations

import datetime as _dt
import functools
from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

if TYPE_CHECKING:
    from ..sources.sequences import Sequence as IdSequence

INSERT, UPDATE, KEEP, DELETE = "insert", "update", "keep", "delete"


def ts_lit(as_of) -> Column:
    """A fixed 'now' as a timestamp_ntz literal (operators never read the wall clock)."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        # through text: a datetime literal would pass through the session zone
        return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def latest_per_key(batch: DataFrame, keys: Sequence[str], order_col: str | Column) -> DataFrame:
    """One row per key, the one with the largest ``order_col`` (later write wins).

    ``max_by`` is a declarative aggregate: it is combined map-side, so a key repeated
    millions of times costs one partial row per task before the shuffle.
    """
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.dropDuplicates(list(keys))
    return (batch.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.col(order_col) if isinstance(order_col, str) else order_col)
                 .alias("_w"))
            .select(*keys, "_w.*"))


def assign_serial_ids(df: DataFrame, order_cols: Sequence[str], start_after: int | Callable[[int], int],
                      id_col: str = "id", partitions: int | None = None,
                      keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """``id = start_after + row_number() OVER (ORDER BY order_cols)`` without a
    single-partition window. ``start_after`` may be a function that is told the number of
    rows (a range of an id sequence).

    The rows are range-partitioned, sorted and numbered, and that layout is checkpointed once:
    range bounds come from sampling, which is not repeatable across executions, so it
    must be materialized before per-partition counts are taken. (Sampling reads the input
    a second time; the upsert's anti join is cheaper to repeat than its full rows are to write.)
    Every later read, also after an executor loss, sees the same ids. Each partition's row
    count (one small row per partition) gives its offset. ``keep`` materialises the layout durably (it may
    reorder rows, whose places are a column by then); the default is a checkpoint.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sortable = [c for c, t in df.dtypes
                if c not in order_cols and not t.startswith(("array", "map", "struct", "binary"))]
    cols = [F.col(c) for c in order_cols]
    ranked = keep(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols, *sortable)
                  .withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    pos = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["_pid"]: r["n"] for r in
              ranked.groupBy(pid.alias("_pid")).agg(F.count("*").alias("n")).collect()}
    offsets, acc = [], 0
    for p in range(max(counts) + 1 if counts else 0):
        offsets.append(acc)
        acc += counts.get(p, 0)
    if not offsets:
        return ranked.drop("_mid").withColumn(id_col, F.lit(None).cast("bigint"))
    off = F.array(*[F.lit(o).cast("bigint") for o in offsets])
    new_id = F.lit(start_after(acc) if callable(start_after) else start_after).cast("bigint") + F.element_at(off, (pid + 1).cast("int")) + pos + 1
    return ranked.withColumn(id_col, new_id).drop("_mid")


def max_id(df: DataFrame, id_col: str = "id") -> int:
    """Largest id of a table (0 when empty): one scalar, read from the id column only."""
    v = df.agg(F.max(id_col)).first()[0]
    return int(v) if v is not None else 0


class UpsertResult:
    """New table version plus the per-row action of the change set.

    ``table`` is built on first use: ids, which need jobs of their own, are not given out
    when only the changes or their counts are asked for. ``changes`` has the key columns and
    ``action``; ``high_water`` is the largest id ever given out (the next ``id_floor``)."""

    def __init__(self, table: Callable[[], DataFrame] | DataFrame, changes: DataFrame,
                 high_water: Callable[[], int] | None = None):
        self._table, self.changes, self._high_water = table, changes, high_water

    @property
    def table(self) -> DataFrame:
        if callable(self._table):
            self._table = self._table()
        return self._table

    @property
    def high_water(self) -> int | None:
        return self._high_water() if self._high_water else None

    def counts(self) -> DataFrame:
        """Affected rows per action (insert / update / delete)."""
        return self.changes.groupBy("action").agg(F.count("*").alias("rows"))


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str],
           update_cols: Sequence[str] | None = None, *, mode: str = "update",
           as_of=None, order_col: str | Column | None = None, id_col: str | None = "id",
           insert_values: dict[str, Column] | None = None,
           update_values: dict[str, Column] | None = None,
           stamp_col: str | None = "last_sync", id_floor: int = 0,
           sequence: IdSequence | None = None) -> UpsertResult:
    """K1 core: ``INSERT ... ON CONFLICT (keys) DO UPDATE SET update_cols``.

    * ``mode='update'``: a matched row takes ``update_cols`` from the batch (and
      ``update_values`` expressions), keeps every other column, and gets
      ``stamp_col = as_of`` (K15: the update trigger); an unmatched batch row is inserted.
    * ``mode='replace'`` (K2, SQLite ``INSERT OR REPLACE``): a matched row is deleted and
      the batch row inserted with a new id; columns the batch lacks become NULL.
    * ``insert_values``: expressions (over ``_b_<col>`` batch columns) for inserted rows.
    * ``order_col``: when set, the batch is first reduced to its last row per key (W3);
      without it the batch keys must be unique (as one bulk ``ON CONFLICT`` statement
      requires: it rejects a key twice).
    * ``id_col``: serial id column of ``current``; inserted rows get ids above the largest id in
      it and above ``id_floor``, the largest id ever given out (a SERIAL never gives an id
      again, also after its row was deleted). The result's ``high_water`` is the next floor. With a
      ``sequence`` (``sources.sequences``) the ids are a range taken from it, which keeps the mark itself.

    Plan: the reduced batch is checkpointed once; the new version is ``current LEFT JOIN
    batch`` (updated or kept rows) plus the inserted rows ``batch LEFT ANTI
    current(keys)``; the anti join reads only the key columns of the big table, and in
    replace mode inserts need no join at all.
    """
    if order_col is not None:
        batch = latest_per_key(batch, keys, order_col)
    keys = list(keys)
    # the batch (the incremental side) feeds both the insert and the update path:
    # materialise it once in the shared checkpoint folder
    b = cut_lineage(batch.select(*keys, *[c for c in batch.columns if c not in keys]))
    kept, inserted, changes = upsert_parts(current, b, keys, update_cols, mode=mode, as_of=as_of, insert_values=insert_values,
                                           update_values=update_values, stamp_col=stamp_col)
    cols = current.columns
    if needs_ids(cols, batch.columns, keys, id_col, insert_values):
        numbered = functools.cache(lambda: numbered_rows(current, inserted, keys, id_col, id_floor, sequence))
        return UpsertResult(lambda: kept.select(*cols).unionByName(numbered()[0].select(*cols)), changes,
                            lambda: numbered()[1])
    return UpsertResult(lambda: kept.select(*cols).unionByName(inserted.select(*cols)), changes)


def needs_ids(cols: Sequence[str], batch_cols: Sequence[str], keys: Sequence[str], id_col: str | None,
              insert_values: dict[str, Column] | None) -> bool:
    """Whether inserted rows get serial ids: nothing else gives them one."""
    return bool(id_col) and id_col in cols and id_col not in keys and id_col not in (insert_values or {}) \
        and id_col not in batch_cols


def upsert_parts(current: DataFrame, batch: DataFrame, keys: Sequence[str], update_cols: Sequence[str] | None = None, *,
                 mode: str = "update", as_of=None, insert_values: dict[str, Column] | None = None,
                 update_values: dict[str, Column] | None = None,
                 stamp_col: str | None = "last_sync") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The joins of ``upsert``: kept and updated rows, inserted rows (their ids still the batch's), changes. ``batch``
    has one row per key and is read several times: the caller has materialised it."""
    keys = list(keys)
    cols = current.columns
    ctypes = dict(current.dtypes)
    update_cols = [c for c in (update_cols if update_cols is not None else batch.columns) if c not in keys]
    insert_values = dict(insert_values or {})
    update_values = dict(update_values or {})
    stamp = ts_lit(as_of) if as_of is not None else None

    b_cols = [c for c in batch.columns if c not in keys]
    b = batch.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in b_cols])
    cur_keys = current.select(*keys)

    def bcol(c: str) -> Column:
        return F.col(f"_b_{c}") if c in b_cols else F.lit(None)

    # rows to insert, with every column of the table
    new_rows = b if mode == "replace" else b.join(cur_keys, keys, "left_anti")
    ins_cols = []
    for c in cols:
        if c in keys:
            ins_cols.append(F.col(c).cast(ctypes[c]).alias(c))
        else:
            v = insert_values[c] if c in insert_values else bcol(c)
            ins_cols.append(v.cast(ctypes[c]).alias(c))
    inserted = new_rows.select(*ins_cols)

    if mode == "update":
        j = current.join(b.withColumn("_b_hit", F.lit(True)), keys, "left")
        hit = F.col("_b_hit").isNotNull()
        out = []
        for c in cols:
            if c in keys:
                out.append(F.col(c))
                continue
            old = current[c]
            if c in update_values:
                upd = update_values[c]
            elif c in update_cols:
                upd = bcol(c)
            elif stamp is not None and c == stamp_col:
                upd = stamp
            else:
                upd = old
            out.append(F.when(hit, upd).otherwise(old).cast(ctypes[c]).alias(c))
        kept = j.select(*out)
        matched = b.join(cur_keys.distinct(), keys, "left_semi").select(*keys, F.lit(UPDATE).alias("action"))
        changes = matched.unionByName(new_rows.select(*keys, F.lit(INSERT).alias("action")))
    elif mode == "replace":
        kept = current.join(b.select(*keys), keys, "left_anti")
        deleted = current.join(b.select(*keys), keys, "left_semi").select(*keys, F.lit(DELETE).alias("action"))
        changes = b.select(*keys, F.lit(INSERT).alias("action")).unionByName(deleted)
    else:
        raise ValueError(f"unknown mode {mode}")
    return kept.select(*cols), inserted, changes


def numbered_rows(current: DataFrame, inserted: DataFrame, keys: list[str], id_col: str, id_floor: int,
              sequence: IdSequence | None,
              keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> tuple[DataFrame, int]:
    """Inserted rows with their serial ids, and the new high-water mark."""
    from ..sources.sequences import start_after
    mark = [None]

    def reserve(n: int) -> int:
        base = start_after(sequence, current, id_col, id_floor, n)
        mark[0] = base + n
        return base
    rows = assign_serial_ids(inserted.drop(id_col), keys, reserve, id_col, keep=keep)
    return rows, reserve(0) if mark[0] is None else mark[0]


def touch_access(files: DataFrame, accesses: DataFrame, id_col: str = "id",
                 ts_col: str = "ts", stamp: bool = True) -> DataFrame:
    """``last_accessed = ts`` of the newest access per file (and K15 stamp).

    Accesses are pre-aggregated to one row per file id (map-side ``max``) before the
    left join, so a file touched a million times adds one row to the join.
    """
    last = accesses.groupBy(F.col("file_id").alias("_a_id")).agg(F.max(ts_col).alias("_a_ts"))
    j = files.join(last, files[id_col] == last["_a_id"], "left")
    hit = F.col("_a_id").isNotNull()
    out = []
    for c in files.columns:
        if c == "last_accessed":
            # an older access batch never moves the times back
            out.append(F.when(hit, F.greatest("_a_ts", c)).otherwise(F.col(c)).cast("timestamp_ntz").alias(c))
        elif stamp and c == "last_sync":
            out.append(F.when(hit, F.greatest("_a_ts", c)).otherwise(F.col(c)).cast("timestamp_ntz").alias(c))
        else:
            out.append(files[c])
    return j.select(*out)


def existing_keys(batch: DataFrame, current: DataFrame, keys: Sequence[str], exists: bool = True) -> DataFrame:
    """Batch rows whose key is already in ``current`` (``left_semi``), or, with
    ``exists=False``, the new ones (``left_anti``). Only the key columns of ``current``
    are read and shuffled."""
    k = current.select(*keys)
    return batch.join(k, list(keys), "left_semi" if exists else "left_anti")


def unknown_accesses(accesses: DataFrame, files: DataFrame, id_col: str = "id") -> DataFrame:
    """K14's warning case: accessed file ids with no file row (the UPDATE touched 0 rows),
    with how often each was accessed. An anti join on the id column only."""
    per_id = accesses.groupBy("file_id").agg(F.count("*").alias("accesses"))
    return per_id.join(files.select(F.col(id_col).alias("file_id")), "file_id", "left_anti")
