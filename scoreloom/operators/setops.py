"""Set operations between call sets, label variants and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def membership_change(before: DataFrame, after: DataFrame, keys: Sequence[str], flag: str = "call") -> DataFrame:
    """gained / lost / kept per key between two boolean memberships."""
    b = before.select(*keys, F.col(flag).cast("boolean").alias("_b"))
    a = after.select(*keys, F.col(flag).cast("boolean").alias("_a"))
    j = b.join(a, list(keys), "full_outer").fillna(False, ["_b", "_a"])
    change = (
        F.when(F.col("_a") & ~F.col("_b"), "gained").when(~F.col("_a") & F.col("_b"), "lost")
        .when(F.col("_a") & F.col("_b"), "kept").otherwise("absent")
    )
    return j.select(*keys, change.alias("change"))


def patch(base: DataFrame, drop: DataFrame, add: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of base without the dropped keys, plus the added rows."""
    return base.join(drop.select(*keys), list(keys), "left_anti").unionByName(add)


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values present on one side only, tagged with the side; empty when the sets agree."""
    a = left.select(column).distinct().withColumn("_l", F.lit(1))
    b = right.select(column).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, column, "full_outer").filter(F.col("_l").isNull() | F.col("_r").isNull())
    return j.select(column, F.when(F.col("_l").isNull(), "right_only").otherwise("left_only").alias("side"))


def leave_one_out(df: DataFrame, block: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of each value over all blocks but one, for every block.

    Uses (total - own) / (n - 1): totals join back to the per-block rows, so blocks
    are never multiplied by blocks.
    """
    tot = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values])
    j = df.join(tot, list(keys))
    return j.select(
        *keys, F.col(block).alias("omitted"),
        *[F.try_divide(F.col(f"_s_{v}") - F.col(v), (F.col("_n") - 1).cast("double")).alias(f"mean_{v}") for v in values],
    )


def top_k_overlap(left: DataFrame, right: DataFrame, key: str, k: int, rank: str = "rank") -> DataFrame:
    """How many of the top k of two rankings coincide."""
    a = left.filter(F.col(rank) <= k).select(key)
    b = right.filter(F.col(rank) <= k).select(key)
    return a.join(b, key, "left_semi").agg(F.count("*").alias("overlap")).withColumn("k", F.lit(k))


def combination_counts(df: DataFrame, members: Column) -> DataFrame:
    """Exact combination frequencies of an array column."""
    return df.groupBy(F.concat_ws("+", F.sort_array(members)).alias("combination")).agg(F.count("*").alias("n"))


def co_occurrence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """% of entities with flag a that also carry flag b, all ordered pairs, in one
    aggregate over the entities."""
    pairs = [(a, b) for a in flags for b in flags]
    sums = [F.count_if(F.col(a) & F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    one = df.agg(*sums)
    cells = F.array(*[
        F.struct(F.lit(a).alias("line_a"), F.lit(b).alias("line_b"), F.col(f"_{i}").alias("n_both"),
                 F.col(f"_{pairs.index((a, a))}").alias("n_a"))
        for i, (a, b) in enumerate(pairs)
    ])
    return one.select(F.inline(cells)).withColumn(
        "pct", F.coalesce(F.try_divide(F.col("n_both") * 100.0, F.col("n_a").cast("double")), F.lit(0.0))
    )
