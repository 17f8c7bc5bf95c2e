"""Small helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def all_of(preds: list[Column]) -> Column:
    """AND of a list of predicates; TRUE when empty."""
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def like_escape(text: str) -> str:
    """Escape a user keyword for LIKE: backslashes only; ``%`` and ``_`` stay wildcards,
    as in the reference (Spark rejects a stray backslash)."""
    return text.replace("\\", "\\\\")


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list, n: int,
                    salts: int = 32, salt_col: str | None = None) -> DataFrame:
    """Exact top ``n`` rows per group without putting a hot group in one task.

    Stage 1 ranks inside ``(group, salt)`` buckets (the salt is a hash of ``salt_col`` or
    of the whole row), so a group holding a third of all rows is spread over ``salts``
    tasks; stage 2 ranks the at most ``n * salts`` survivors per group. ``order_cols`` are
    Columns (with their direction) and must make the order total for a stable result.
    """
    from pyspark.sql import Window
    salt_src = F.col(salt_col) if salt_col else F.struct(*df.columns)
    salted = df.withColumn("_salt", F.pmod(F.hash(salt_src), F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    local = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n).drop("_r", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return local.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= n).drop("_r")
