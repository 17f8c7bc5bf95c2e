"""Ownership sync between systems.

One round is four pure functions over the catalogue tables; each selects the *dirty*
rows (``last_sync < cutoff OR system_id <> me``, SQL NULL rules), keeps those owned by
another system (Python ``!=``: a NULL owner counts as other), and then, keyed as the
reference keys each table, either takes ownership (``system_id = me``, ``last_sync =
as_of``) of every row sharing the key or deletes them when the thing is gone.

Everything is set-based and each table is read once: a window over the key decides what happens
to its rows. The takeover can make two rows share the full key (the reference keys drop
system_id); one row per full key is kept: the largest id (their ``last_sync`` is the same then).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .upsert import ts_lit

# Fixed value: the look-back of a sync round.
SYNC_LOOKBACK = _dt.timedelta(minutes=5)


def cutoff_of(as_of) -> _dt.datetime:
    t = as_of if isinstance(as_of, _dt.datetime) else _dt.datetime.fromisoformat(str(as_of))
    return t - SYNC_LOOKBACK


def dirty(df: DataFrame, me: str, cutoff) -> Column:
    """``last_sync < cutoff OR system_id <> me`` (NULL alone never selects)."""
    return F.coalesce((F.col("last_sync") < ts_lit(cutoff)) | (F.col("system_id") != F.lit(me)), F.lit(False))


def acted(df: DataFrame, me: str, cutoff) -> DataFrame:
    """F11 + F12: dirty rows owned by another system (a NULL owner is another system)."""
    return df.where(dirty(df, me, cutoff) & ~F.col("system_id").eqNullSafe(F.lit(me)))


def _marked(df: DataFrame, me: str, as_of, keys: Sequence[str], set_cols: dict[str, Column] | None = None,
            value_cols: Sequence[str] = (), absent_cols: dict[str, Column] | None = None,
            present: DataFrame | None = None, present_keys: Sequence[str] = (), one_per_key: bool = True) -> DataFrame:
    """``df`` with ``_op``: NULL for rows that the round leaves alone, ``update`` for rows of an
    acted key that is present (``set_cols`` and the winner's ``value_cols`` applied), ``delete`` for rows that go: those of
    an absent key (unless ``absent_cols`` updates them instead) and, with ``one_per_key``, all but the
    largest id of a key, whose full keys the takeover makes equal.

    The acted row with the largest id wins (a deterministic stand-in for the reference's fetch order). The table
    is read once: a window over the key sees whether it is acted on, the winner and the largest id, and the
    keys of ``present`` are rows of the same window, so one exchange on the key decides everything
    (none for a table bucketed on it). A NULL key equals no key: such rows are windows of their own."""
    types = dict(df.dtypes)
    act = dirty(df, me, cutoff_of(as_of)) & ~F.col("system_id").eqNullSafe(F.lit(me))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = df.withColumns({"_p": F.lit(None).cast("boolean"), "_acted": F.when(act & whole, F.col("id"))})
    if present is not None:
        there = present.select(*[F.col(a).alias(b) for a, b in zip(present_keys, keys)]).dropna().distinct()
        rows = rows.unionByName(there.select(*[F.col(k).cast(types[k]).alias(k) for k in keys], F.lit(True).alias("_p")),
                                allowMissingColumns=True)
    w = Window.partitionBy(*keys, F.when(~whole, F.col("id")))
    seen = {"_hit": F.max("_acted").over(w).isNotNull(), "_keep": F.max("id").over(w),
            "_there": F.max("_p").over(w).isNotNull() if present is not None else F.lit(True)}
    if value_cols:
        seen["_won"] = F.max_by(F.struct(*value_cols), F.col("_acted")).over(w)
    j = rows.select("*", *[v.alias(k) for k, v in seen.items()]).where(F.col("_p").isNull())
    hit, gone = F.col("_hit") & F.col("_there"), F.col("_hit") & ~F.col("_there")
    op = F.when(gone, F.lit("delete" if absent_cols is None else "update")).when(
        hit, F.when((F.col("id") < F.col("_keep")) & F.lit(one_per_key), F.lit("delete")).otherwise(F.lit("update")))
    sets = {c: F.col("_won")[c] for c in value_cols} | (set_cols or {})
    out = []
    for c in df.columns:
        v = F.col(c)
        if absent_cols and c in absent_cols:
            v = F.when(gone, absent_cols[c]).otherwise(v)
        if c in sets:
            v = F.when(hit, sets[c]).otherwise(v)
        out.append(v.cast(types[c]).alias(c))
    return j.select(*out, F.col("last_sync").alias("_old_sync"), op.alias("_op"))


def kept_rows(marked: DataFrame) -> DataFrame:
    """The table after a round: all rows but the deleted ones."""
    return marked.where(F.col("_op").isNull() | (F.col("_op") == "update")).drop("_op", "_old_sync")


def changed_rows(marked: DataFrame) -> DataFrame:
    """The rows that a round changes, with ``_op`` (``update`` rows hold their new values)."""
    return marked.where(F.col("_op").isNotNull()).drop("_old_sync")


def mark_devices(devices: DataFrame, me: str, as_of, present_uuids: DataFrame | None = None) -> DataFrame:
    """T1 as marked rows (see ``_marked``)."""
    now = ts_lit(as_of)
    return _marked(devices, me, as_of, ["uuid"],
                   {"last_seen": now, "system_id": F.lit(me), "last_sync": now, "is_active": F.lit(True)},
                   absent_cols={"last_sync": now, "is_active": F.lit(False)}, present=present_uuids, present_keys=["uuid"])


def mark_files(files: DataFrame, me: str, as_of, present_files: DataFrame | None = None) -> DataFrame:
    """T2 as marked rows."""
    return _takeover(files, ["device_uuid", "path"], ["hash", "size", "modified_time", "scanned_time"], me, as_of,
                     present_files, ["device_uuid", "path"])


def mark_scan_progress(progress: DataFrame, me: str, as_of, present_uuids: DataFrame | None = None) -> DataFrame:
    """T3 as marked rows."""
    return _takeover(progress, ["device_uuid"], ["total_files", "new_files", "last_updated"], me, as_of,
                     present_uuids, ["uuid"])


def mark_image_analysis(analyses: DataFrame, files: DataFrame, me: str, as_of) -> DataFrame:
    """T4 as marked rows; only ``files.id`` is read."""
    vals = [c for c in analyses.columns if c not in ("id", "file_id", "system_id", "last_sync")]
    return _takeover(analyses, ["file_id"], vals, me, as_of, files.select(F.col("id").alias("file_id")), ["file_id"],
                     one_per_key=False)


def _takeover(df: DataFrame, keys: Sequence[str], vals: Sequence[str], me: str, as_of, present: DataFrame | None,
              present_keys: Sequence[str], one_per_key: bool = True) -> DataFrame:
    return _marked(df, me, as_of, keys, {"system_id": F.lit(me), "last_sync": ts_lit(as_of)}, vals, None, present,
                   present_keys, one_per_key)


def sync_devices(devices: DataFrame, me: str, as_of, present_uuids: DataFrame | None = None) -> DataFrame:
    """Keyed by uuid. Present -> last_seen = now, system_id = me, last_sync = now,
    is_active = true on every row of that uuid; absent -> is_active = false, last_sync = now."""
    return kept_rows(mark_devices(devices, me, as_of, present_uuids))


def sync_files(files: DataFrame, me: str, as_of, present_files: DataFrame | None = None) -> DataFrame:
    """Keyed by (device_uuid, path). Present -> the acted row's hash/size/times,
    system_id = me, last_sync = now on every row of the key; absent -> rows deleted."""
    return kept_rows(mark_files(files, me, as_of, present_files))


def sync_scan_progress(progress: DataFrame, me: str, as_of, present_uuids: DataFrame | None = None) -> DataFrame:
    """Keyed by device_uuid. Present -> the acted row's counts, system_id = me,
    last_sync = now on every row of the device; absent -> rows deleted."""
    return kept_rows(mark_scan_progress(progress, me, as_of, present_uuids))


def sync_image_analysis(analyses: DataFrame, files: DataFrame, me: str, as_of) -> DataFrame:
    """T4: keyed by file_id. The file row still exists (by id) -> the acted row's values,
    system_id = me, last_sync = now; else the analysis rows are deleted (orphans)."""
    return kept_rows(mark_image_analysis(analyses, files, me, as_of))


def change_log(table_name: str, marked: DataFrame, me: str, as_of) -> DataFrame:
    """The ``sync_logs`` rows of one table from its marked rows: ``delete`` for rows that go,
    ``update`` for rows whose ``last_sync`` became ``as_of``. No second look at the table."""
    now = ts_lit(as_of)
    return (marked.where((F.col("_op") == "delete") | ((F.col("_op") == "update") & ~F.col("_old_sync").eqNullSafe(now)))
            .select(F.lit(table_name).alias("table_name"), F.col("id").cast("string").alias("record_id"),
                    F.col("_op").alias("operation"), F.lit(me).alias("system_id"), now.alias("sync_time")))


class SyncRound:
    """One round over the four tables. ``log`` has the counts of processed (dirty) rows per table (A11) and
    reads nothing else. The first use of anything further stages every table's marked rows, once: the tables
    after the round, ``changes`` (the ``sync_logs`` rows) and ``marked`` are all read from there."""

    def __init__(self, tables: dict[str, DataFrame], me: str, as_of, present_uuids: DataFrame | None,
                 present_files: DataFrame | None):
        self._tables, self._me, self._as_of = tables, me, as_of
        self._uuids, self._files = present_uuids, present_files
        self._marked: dict[str, DataFrame] = {}

    def marks(self, table: str) -> DataFrame:
        """A table's rows with what the round does to them, staged."""
        if table not in self._marked:
            df, me, as_of = self._tables[table], self._me, self._as_of
            if table == "devices":
                rows = mark_devices(df, me, as_of, self._uuids)
            elif table == "files":
                rows = mark_files(df, me, as_of, self._files)
            elif table == "scan_progress":
                rows = mark_scan_progress(df, me, as_of, self._uuids)
            else:  # the files that T4 still finds: all but T2's deletions
                rows = mark_image_analysis(df, kept_rows(self.marks("files")), me, as_of)
            self._marked[table] = stage_table(rows)
        return self._marked[table]

    @property
    def marked(self) -> dict[str, DataFrame]:
        return {t: self.marks(t) for t in self._tables}

    @property
    def devices(self) -> DataFrame:
        return kept_rows(self.marks("devices"))

    @property
    def files(self) -> DataFrame:
        return kept_rows(self.marks("files"))

    @property
    def scan_progress(self) -> DataFrame:
        return kept_rows(self.marks("scan_progress"))

    @property
    def image_analysis(self) -> DataFrame:
        return kept_rows(self.marks("image_analysis"))

    @property
    def log(self) -> DataFrame:
        """``(table_name, operation, rows)``: processed rows per table."""
        cut = cutoff_of(self._as_of)
        return reduce(DataFrame.unionByName, [
            df.where(dirty(df, self._me, cut)).agg(F.count("*").alias("rows"))
            .select(F.lit(t).alias("table_name"), F.lit("processed").alias("operation"), "rows")
            for t, df in self._tables.items()])

    @property
    def changes(self) -> DataFrame:
        """``(table_name, record_id, operation, system_id, sync_time)`` of updated and deleted rows."""
        return reduce(DataFrame.unionByName, [change_log(t, m, self._me, self._as_of) for t, m in self.marked.items()])


def sync_all(devices: DataFrame, files: DataFrame, progress: DataFrame, analyses: DataFrame,
             me: str, as_of, present_uuids: DataFrame | None = None,
             present_files: DataFrame | None = None) -> SyncRound:
    """T5: one round, T1 -> T2 -> T3 -> T4 (T4 sees T2's deletions), with the counts of
    processed (dirty) rows per table (A11) and the log of updated and deleted rows."""
    return SyncRound({"devices": devices, "files": files, "scan_progress": progress, "image_analysis": analyses},
                     me, as_of, present_uuids, present_files)
