"""Longest raw-string-prefix join of paths to mount points.

The rule has no ``/`` boundary (``/V/Extra`` matches mount ``/V/Ext``), so it is not an
equi join on path components. While the mounts have few different lengths it is one left join per *length*: the
path's prefix of that length is looked up, and the longest hit wins (``coalesce``, longest
first). Rows of ``paths`` keep their place: nothing is exploded or regrouped, and while the mounts of a length
are small enough for Spark to broadcast them the paths are not shuffled at all.

With more than ``MAX_LENGTHS`` lengths each path is given one mount, its *predecessor*: the largest mount
that is not larger than the path. Every mount that is a prefix of the path is also one of the predecessor
(whatever sorts between a string and its extension extends the string, too), so the answer is on the
predecessor's chain, the mounts that are its prefixes. Paths and mounts are range-partitioned and sorted together,
a window carries the last mount on, and each partition's first paths take the last mount of the
partitions before (one row per partition). The plan does not depend on the number of mounts or
lengths, and a path that many rows share spreads over partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename
from ..session import stage_table

#: Different mount lengths up to which there is a join per length.
MAX_LENGTHS = 8


def abspath_like(path) -> "F.Column":
    """The part of ``os.path.abspath`` expressible per row: repeated ``/`` collapsed,
    trailing ``/`` dropped (root stays ``/``)."""
    p = F.regexp_replace(path, "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def longest_prefix_mount(paths: DataFrame, mounts: DataFrame, path_col: str = "path",
                         mount_col: str = "mount_path", uuid_col: str = "uuid") -> DataFrame:
    """Adds ``mount_path``, ``device_uuid`` and ``device_label`` (basename of the mount) of
    the longest mount that is a raw prefix of the (normalised) path; NULL when none.
    An empty mount never matches. ``mounts`` must hold one row per mount string.

    The mounts are staged as a table once, so that Spark joins by their real size; the
    driver sees only their distinct lengths, ``MAX_LENGTHS`` and one at most."""
    m = stage_table(mounts.select(F.col(mount_col).alias("_mount"), F.col(uuid_col).alias("_uuid"))
                    .where(F.length("_mount") > 0))
    lengths = sorted((r[0] for r in m.select(F.length("_mount")).distinct().limit(MAX_LENGTHS + 1).collect()), reverse=True)
    rows = paths.withColumn("_p", abspath_like(F.col(path_col)))
    found = _by_length(rows, m, lengths) if len(lengths) <= MAX_LENGTHS else _by_predecessor(rows, m)
    return found.select(*[F.col(c) for c in paths.columns], F.col("_best").alias("mount_path"),
                        F.col("_best_uuid").alias("device_uuid")) \
        .withColumn("device_label", basename(F.col("mount_path")))


def _by_length(rows: DataFrame, m: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` with ``_best`` and ``_best_uuid``: a left join per mount length, longest first."""
    none = F.lit(None).cast("string")
    out = rows.withColumns({"_best": none, "_best_uuid": none})
    for i, n in enumerate(lengths):
        of_n = m.where(F.length("_mount") == n).select(F.col("_mount").alias(f"_m{n}"), F.col("_uuid").alias(f"_u{n}"))
        # a path that has a longer mount is not looked up again
        missing = F.col("_best").isNull() if i else F.lit(True)
        prefix = F.when(missing & (F.length("_p") >= n), F.substring("_p", 1, n))
        out = out.join(of_n, prefix == F.col(f"_m{n}"), "left")
        best, uuid = F.col(f"_m{n}"), F.col(f"_u{n}")
        if i:
            uuid = F.when(F.col("_best").isNotNull(), F.col("_best_uuid")).otherwise(uuid)
            best = F.coalesce("_best", best)
        out = out.select(*[F.col(c) for c in rows.columns], best.alias("_best"), uuid.alias("_best_uuid"))
    return out


def mount_chains(m: DataFrame) -> DataFrame:
    """``(_mount, _chain)``: each mount with the mounts that are its prefixes, itself first, then ever
    shorter ones. Each mount's prefixes meet the mounts in an equi join."""
    prefixes = m.select("_mount", F.explode(F.sequence(F.lit(1), F.length("_mount"))).alias("n")).select(
        "_mount", F.expr("substring(_mount, 1, n)").alias("_prefix"))
    known = m.select(F.col("_mount").alias("_prefix"), F.struct(
        F.length("_mount").alias("n"), F.col("_mount").alias("mount"), F.col("_uuid").alias("uuid")).alias("_link"))
    # not broadcast: the mounts' files are many times smaller than their rows in memory
    return prefixes.join(known.hint("merge"), "_prefix").groupBy("_mount").agg(
        F.sort_array(F.collect_list("_link"), asc=False).alias("_chain"))


def _by_predecessor(rows: DataFrame, m: DataFrame) -> DataFrame:
    """``rows`` with ``_best`` and ``_best_uuid`` by a range-partitioned merge with the sorted mounts."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of_mounts = m.select(F.col("_mount").alias("_k"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_n"))
    of_paths = rows.select(F.col("_p").alias("_k"), F.lit(1).alias("_kind"), F.monotonically_increasing_id().alias("_n"),
                           F.struct(*rows.columns).alias("_row"))
    # range bounds come from a sample: partitions are numbered once, in a staged table
    both = stage_table(of_mounts.unionByName(of_paths, allowMissingColumns=True)
                       .repartitionByRange(n, "_k", "_kind", "_n").withColumn("_part", F.spark_partition_id()))
    last = {r["_part"]: r["m"] for r in both.where("_kind = 0").groupBy("_part").agg(F.max("_k").alias("m")).collect()}
    carried, before = [], None
    for part in range(n):  # one row per partition
        carried.append((part, before))
        before = last.get(part, before)
    carry = spark.createDataFrame(carried, "_part int, _carried string")
    w = Window.partitionBy("_part").orderBy("_k", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last(F.when(F.col("_kind") == 0, F.col("_k")), ignorenulls=True).over(w))
    placed = seen.where("_kind = 1").join(F.broadcast(carry), "_part").select(
        "_row.*", F.coalesce("_seen", "_carried").alias("_pred"))
    chains = stage_table(mount_chains(m))
    # chains repeat their mounts' beginnings, so the size of their files says little: never sent through the driver
    met = placed.join(chains.hint("merge"), placed["_pred"] == chains["_mount"], "left")
    link = F.try_element_at(F.filter("_chain", lambda e: F.startswith(F.col("_p"), e["mount"])), F.lit(1))
    return met.select(*rows.columns, link["mount"].alias("_best"), link["uuid"].alias("_best_uuid"))
