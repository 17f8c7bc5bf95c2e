"""Catalogue tables whose updates rewrite only the buckets they touch (copy-on-write).

Rows lie in buckets by a hash of the key prefix. A change set finds the buckets of its keys, reads those
alone, and writes them anew as the next version; all other files are neither read nor written, so a small batch
against a table of many terabytes costs its buckets only. The hash covers the path as well as the device, so
a device that holds a third of all files spreads over all buckets.

``data/version=<v>/bucket=<b>`` holds a bucket as version ``v`` wrote it; ``commits/<v>`` names the
buckets that ``v`` replaced and is written last, so a reader sees all of a version or nothing of it, readers of
an older version are not disturbed, and a failed or repeated write of ``v`` starts over. ``vacuum`` deletes what no
reader needs any more. One writer at a time, as with every table version of this library; where
the session has a catalogue with row-level changes, ``MERGE INTO`` is the equivalent.

A change set is staged once, compressed and clustered by bucket, in ``changes/version=<v>``; the buckets are then
rewritten in groups, each of which reads its part of the change set and its buckets alone. The shuffle files of a
group are released before the next, so that disk holds the versions, the change set and one group's shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import UpsertResult, latest_per_key, needs_ids, numbered_rows, upsert_parts
from ..session import TASK_ROWS, one_writer_a_task, release_shuffles
from . import folders
from .tables import DEFAULT_BUCKETS

#: Versions and change sets are read back as Parquet whatever wrote them; this codec halves their disk.
CODEC = "zstd"
#: Bytes that a stored row takes at least, to tell a table's rows from its files' sizes.
ROW_BYTES = 20
#: Buckets that a write looks up one by one.
FEW_BUCKETS = 256


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = DEFAULT_BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path, schema, list(keys), buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: Sequence[str], buckets: int = DEFAULT_BUCKETS) -> "BucketTable":
        """Version 0 from ``df``; a table that is already there is left as it is."""
        table = cls(df.sparkSession, path, df.schema, keys, buckets)
        if table.version() < 0:
            table.write(df, 0, range(buckets))
            table.commit(0, range(buckets))
            release_shuffles(table.spark)
        return table

    def bucket(self) -> Column:
        """The bucket of a row, by its keys as the table has them."""
        keys = [F.col(k).cast(self.schema[k].dataType) for k in self.keys]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ versions

    def version(self) -> int:
        """The newest committed version; -1 without one."""
        return max((int(n) for n in folders.names(self.spark, f"{self.path}/commits") if n.isdigit()), default=-1)

    def layout(self, upto: int | None = None) -> dict[int, int]:
        """The version that holds each bucket which has rows (driver: at most one entry a bucket)."""
        upto = self.version() if upto is None else upto
        at: dict[int, int] = {}
        found = sorted(int(n) for n in folders.names(self.spark, f"{self.path}/commits") if n.isdigit())
        for v in (v for v in found if v <= upto):
            record = folders.read_json(self.spark, f"{self.path}/commits/{v}")
            for b in record["touched"]:
                at.pop(b, None)
            at.update({int(b): w for b, w in record["held"].items()})
        return at

    def commit(self, version: int, touched: Iterable[int]) -> None:
        held = {int(n[7:]): version for n in folders.names(self.spark, f"{self.path}/data/version={version}")
                if n.startswith("bucket=")}
        folders.write_json(self.spark, f"{self.path}/commits/{version}", {"touched": list(touched), "held": held})

    # ------------------------------------------------------------ rows

    def read(self, upto: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version (the newest), or of some buckets: only their files are listed and read."""
        at = self.layout(upto)
        wanted = at if only is None else [b for b in only if b in at]
        paths = [f"{self.path}/data/version={at[b]}/bucket={b}" for b in sorted(wanted)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys (at most all buckets reach the driver)."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def groups(self, sizes: dict[int, int], version: int) -> list[list[int]]:
        """Buckets with their numbers of rows to change, in groups that are rewritten one after the other: as many
        buckets as tasks can run, and more while the rows to read would fill no more tasks than that."""
        tasks = self.spark.sparkContext.defaultParallelism
        if sizes.keys() & self.layout(version).keys():  # the sizes of the files that a read lists
            stored = int(str(self.read(version, sizes)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        else:
            stored = 0
        each = stored // ROW_BYTES // max(1, len(sizes))
        out: list[list[int]] = [[]]
        rows = 0
        for b, n in sorted(sizes.items()):
            if len(out[-1]) >= tasks and rows + each + n > tasks * TASK_ROWS:
                out.append([])
                rows = 0
            out[-1].append(b)
            rows += each + n
        return out

    def write(self, rows: DataFrame, version: int, touched: Iterable[int], more: bool = False) -> None:
        """The touched buckets as ``version`` has them: ``rows`` holds all their rows. Each bucket is written by
        one task as one file. Nobody sees the version before ``commit``. ``more``: further buckets of a version
        that is being written; otherwise it starts anew."""
        names = [f.name for f in self.schema.fields]
        order = sorted(touched)
        parts = min(self.buckets, len(order)) or 1
        found = rows.select(*names, self.bucket().alias("bucket"))
        if len(order) <= FEW_BUCKETS:  # a task for each
            dealt = found.repartitionById(parts, (F.array_position(F.array(*[F.lit(b) for b in order]), F.col("bucket")) - 1).cast("int"))
        else:
            dealt = found.repartition(parts, "bucket")
        with one_writer_a_task(self.spark):
            dealt.write.mode("append" if more else "overwrite").option("compression", CODEC) \
                .partitionBy("bucket").parquet(f"{self.path}/data/version={version}")

    def replace(self, rows: DataFrame, touched: list[int]) -> int:
        """Commit the touched buckets' new rows; returns the version."""
        version = self.version() + 1
        self.write(rows, version, touched)
        self.commit(version, touched)
        return version

    # ------------------------------------------------------------ changes

    def _changes(self, version: int, name: str) -> str:
        return f"{self.path}/changes/version={version}/{name}"

    def _stage(self, rows: DataFrame, version: int, name: str, more: bool = False) -> DataFrame:
        """Rows of a change set with their ``_bucket``, by which each file is sorted: a group's rows are found by the
        statistics of the files' pages."""
        path = self._changes(version, name)
        marked = rows.select("*", self.bucket().alias("_bucket")).sortWithinPartitions("_bucket")
        marked.write.mode("append" if more else "overwrite").option("compression", CODEC).parquet(path)
        return self.spark.read.schema(marked.schema).parquet(path)

    def _sizes(self, staged: DataFrame) -> dict[int, int]:
        """Rows to change per bucket (at most all buckets reach the driver)."""
        return {r["_bucket"]: r["n"] for r in staged.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}

    def upsert(self, batch: DataFrame, keys: Sequence[str], update_cols: Sequence[str] | None = None, *,
               order_col: str | Column | None = None, id_col: str | None = "id", id_floor: int = 0, sequence=None,
               **options) -> UpsertResult:
        """``operators.upsert`` over the touched buckets. ``keys`` must hold the table's bucket keys. Ids need a
        ``sequence`` (or an ``id_floor``), since the largest id may lie in a bucket that is not read. The result's
        ``changes`` can be read until ``vacuum`` deletes the version before."""
        keys = list(keys)
        if not set(self.keys) <= set(keys):
            raise ValueError(f"the upsert key must hold {self.keys}")
        if "id" in self.schema.names and id_col == "id" and not (sequence or id_floor):
            raise ValueError("new ids need a sequence or an id_floor")
        if order_col is not None:
            batch = latest_per_key(batch, keys, order_col)
        before, version = self.version(), self.version() + 1
        batch = self._stage(batch, version, "batch")
        release_shuffles(self.spark)
        sizes = self._sizes(batch)
        touched = sorted(sizes)
        if not touched:
            return UpsertResult(self.read(), batch.select(*keys, F.lit("").alias("action")))
        groups = self.groups(sizes, before)

        def parts(group: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
            rows = batch if group is touched else batch.where(F.col("_bucket").isin(group))
            return upsert_parts(self.read(before, group), rows.drop("_bucket"), keys, update_cols, **options)
        new, mark = None, None
        if needs_ids(self.schema.names, batch.columns, keys, id_col, options.get("insert_values")):
            # ids follow the order of all keys: the inserted rows of all groups are numbered at once
            for i, group in enumerate(groups):
                new = self._stage(parts(group)[1].drop(id_col), version, "inserted", more=i > 0)
                release_shuffles(self.spark)
            new, mark = numbered_rows(self.read(before, touched), new.drop("_bucket"), keys, id_col, id_floor, sequence,
                                      keep=lambda rows: self._stage(rows, version, "numbered"))
            folders.remove(self.spark, self._changes(version, "inserted"))
            release_shuffles(self.spark)
        for i, group in enumerate(groups):
            kept, inserted, _ = parts(group)
            if new is not None:
                inserted = new.where(F.col("_bucket").isin(group))
            self.write(kept.unionByName(inserted.select(*self.schema.names)), version, group, more=i > 0)
            release_shuffles(self.spark)
        self.commit(version, touched)
        folders.remove(self.spark, self._changes(version, "numbered"))
        return UpsertResult(self.read(), parts(touched)[2], lambda: mark)

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows of some keys (columns: the bucket keys and any others); returns the version."""
        before, version, names = self.version(), self.version() + 1, keys.columns
        staged = self._stage(keys.distinct(), version, "keys")
        release_shuffles(self.spark)
        sizes = self._sizes(staged)
        for i, group in enumerate(self.groups(sizes, before) if sizes else []):
            gone = staged.where(F.col("_bucket").isin(group)).drop("_bucket")
            self.write(self.read(before, group).join(gone, names, "left_anti"), version, group, more=i > 0)
            release_shuffles(self.spark)
        if sizes:
            self.commit(version, sorted(sizes))
        folders.remove(self.spark, self._changes(version, "keys"))
        return self.version()

    def vacuum(self, keep: int | None = None) -> None:
        """Delete the files that no version from ``keep`` (the newest) on reads, the change sets up to ``keep``, and
        fold the older commits into that of ``keep``."""
        newest = self.version()
        keep = newest if keep is None else min(keep, newest)
        if keep < 1:
            return
        layout = self.layout(keep)
        folders.write_json(self.spark, f"{self.path}/commits/{keep}", {"touched": list(range(self.buckets)), "held": layout})
        for v in [int(n) for n in folders.names(self.spark, f"{self.path}/commits") if n.isdigit()]:
            if v < keep:
                folders.remove(self.spark, f"{self.path}/commits/{v}")
        for name in folders.names(self.spark, f"{self.path}/data"):
            v = int(name.removeprefix("version="))
            if v > keep:
                continue
            held = {b for b, w in layout.items() if w == v}
            if not held:
                folders.remove(self.spark, f"{self.path}/data/{name}")
                continue
            for part in folders.names(self.spark, f"{self.path}/data/{name}"):
                if part.startswith("bucket=") and int(part[7:]) not in held:
                    folders.remove(self.spark, f"{self.path}/data/{name}/{part}")
        for name in folders.names(self.spark, f"{self.path}/changes"):
            if int(name.removeprefix("version=")) <= keep:
                folders.remove(self.spark, f"{self.path}/changes/{name}")
