"""Mixing sources to target weights (native DataFrame operations only).

``mix_plan`` measures every document, sums the sizes per source, shares the wanted total over
the sources by weight (no source above ``max_repeat`` times its own size) and gives each
document its number of copies: ``floor(rate)`` plus one more with the probability of the
fraction, decided by a hash of the document's id and a seed. ``mix`` emits the copies.

Defined cases: null text has size 0; a null source is a source of its own, last in order;
a source without words gets target 0 and no copies; repeated ids share one draw; an empty table
gives an empty result; in ``mix_plan`` the added columns replace input columns of the same name, ``mix``
keeps all input columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import read_table
from ._common import register, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Largest table of sources that is broadcast (bytes, measured on the finished table).
BROADCAST_BYTES = 8 << 20


def word_count(text: Column) -> Column:
    """Number of words (runs of characters other than ASCII white space); null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from a 52-bit MD5 prefix of ``key:seed``."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float,
                   max_repeat: float) -> DataFrame:
    """``(source, source_size)`` to targets: ``min(cap, level * weight)`` with the one level at
    which all targets sum to ``share`` times all sizes. Sorted by cap / weight, a source is
    capped exactly if it lies under the level of the sources from it on. One row per source."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = (sizes
            .withColumn("weight", F.element_at(
                cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
            .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
            .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                        / F.sum("weight").over(after))
            .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight")))
    # the level of the first source that is not capped holds for all sources after it
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level")))
    return (rows.withColumn("final", level.over(everything)["level"])
            .select("source", "source_size",
                    F.when(F.col("capped") | F.col("final").isNull(), F.col("cap"))
                    .otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target")))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5,
             max_repeat: float = 2.0, seed: int = 7, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source", prefix: str = "") -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies`` (their names after ``prefix``).

    The sizes are summed per source with partial aggregates, so a hot source costs one row
    per task. Documents meet the targets by a broadcast of the finished source table when
    its measured size allows it, else by a shuffle join that AQE splits."""
    size, source_size, target, rate, copies = (prefix + c for c in ("size", "source_size", "target", "rate", "copies"))
    base = docs.drop(size, source_size, target, rate, copies).withColumn(size, word_count(F.col(text_col)))
    sums = base.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("source_size"))
    targets = staged(source_targets(sums, weights, share, max_repeat))
    n_bytes = targets.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 48)).first()[0] or 0
    right = targets.select(F.col("source").alias("_source"), F.col("source_size").alias(source_size),
                           F.col("target").alias(target),
                           F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                           .otherwise(0.0).alias(rate))
    if n_bytes <= BROADCAST_BYTES:
        right = F.broadcast(right)
    joined = base.join(right, base[source_col].eqNullSafe(right["_source"])).drop("_source")
    whole = F.floor(rate)
    return joined.withColumn(
        copies, (whole + (draw(F.col(id_col), seed) < F.col(rate) - whole).cast("long")).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: every document ``copies`` times, with the columns of ``docs``."""
    plan = mix_plan(docs, prefix="_mix_", **options).where("_mix_copies > 0")
    copy = F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))).alias("_mix_copy")
    return plan.select(*[plan[c] for c in docs.columns], copy).drop("_mix_copy")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap,
         (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * weight THEN cap
              ELSE least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap > level * weight))
         END AS target
  FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5(CAST(d.doc_id AS VARCHAR) || ':7'), 1, 13)) AS BIGINT)::DOUBLE
           / 4503599627370496::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


@register("op7_mix_sources", SQL)
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the default weights: words taken from each."""
    return (mix_plan(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).alias("taken")))
