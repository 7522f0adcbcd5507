"""Reconciliation checks. Every check returns the violating rows; empty means it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scalars import is_finite


def tolerance_violations(got: DataFrame, want: DataFrame, keys: Sequence[str], values: Sequence[str], tol: float) -> DataFrame:
    """Rows whose value differs by more than ``tol`` or that exist on one side only."""
    a = got.select(*keys, F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("got")) for v in values]).alias("_g"))
    b = want.select(*keys, F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("want")) for v in values]).alias("_w"))
    ga, wb = a.select(*keys, F.inline("_g")), b.select(*keys, F.inline("_w"))
    j = ga.join(wb, [*keys, "metric"], "full_outer")
    bad = F.abs(F.col("got") - F.col("want")) > tol
    one_side = F.col("got").isNull() != F.col("want").isNull()
    return j.filter(F.coalesce(bad, F.lit(False)) | one_side)


def total_violations(counts: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Confusion counts must add up to the label totals (n_pos, n_neg)."""
    if keys:
        j = counts.join(totals, list(keys))
    else:
        j = counts.withColumn("n_pos", totals.select("n_pos").scalar()).withColumn("n_neg", totals.select("n_neg").scalar())
    return j.filter((F.col("tp") + F.col("fn") != F.col("n_pos")) | (F.col("fp") + F.col("tn") != F.col("n_neg")))


def missing_keys(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys absent from the table and keys that were not expected."""
    have = df.select(*keys).distinct()
    lost = expected.select(*keys).join(have, list(keys), "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.join(expected.select(*keys), list(keys), "left_anti").withColumn("problem", F.lit("unexpected"))
    return lost.unionByName(extra)


def incomplete_runs(runs: DataFrame, models: Sequence[str], *, block: str = "block", model: str = "model") -> DataFrame:
    """(block, model) pairs that did not finish: absent, non-zero exit or no artifact."""
    want = runs.select(block).distinct().select(block, F.explode(F.array(*[F.lit(m) for m in models])).alias(model))
    j = want.join(runs, [block, model], "left")
    problem = (
        F.when(F.col("exit_code").isNull(), "absent").when(F.col("exit_code") != 0, "failed").when(~F.col("has_artifact"), "no_artifact")
    )
    return j.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(block, model, "problem")


def baseline_changes(new: DataFrame, old: DataFrame, keys: Sequence[str], value: str, *, dp: int = 4, allowed: DataFrame | None = None) -> DataFrame:
    """Values that changed at ``dp`` decimals, minus an allow-list of keys."""
    j = new.select(*keys, F.round(value, dp).alias("new")).join(old.select(*keys, F.round(value, dp).alias("old")), list(keys))
    diff = j.filter(~F.col("new").eqNullSafe(F.col("old")))
    return diff if allowed is None else diff.join(allowed, list(keys), "left_anti")


def partition_violations(members: DataFrame, known: DataFrame, *, member: str = "member", parent: str = "parent") -> DataFrame:
    """Members with several parents and parents that are not known. Both sides of the check for unknown parents are reduced
    to distinct parents first: a parent that many rows name is one row there, not one task."""
    multi = (
        members.groupBy(member).agg(F.count_distinct(parent).alias("n_parents")).filter(F.col("n_parents") > 1)
        .select(F.col(member).cast("string").alias("id"), F.lit("several_parents").alias("problem"))
    )
    orphan = (
        members.select(parent).distinct().join(known.select(parent).distinct(), parent, "left_anti")
        .select(F.col(parent).cast("string").alias("id"), F.lit("unknown_parent").alias("problem"))
    )
    return multi.unionByName(orphan)


def range_violations(df: DataFrame, bounds: dict[str, tuple[float, float]], keys: Sequence[str]) -> DataFrame:
    """Metric values that are not finite or lie outside their range."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        for c, (lo, hi) in bounds.items()
    ])
    rows = df.select(*keys, F.inline(cells))
    return rows.filter(~is_finite("value") | ~F.col("value").between(F.col("lo"), F.col("hi")))


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Pass rows through, failing the job on the first that breaks the condition."""
    return df.filter(F.when(ok, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
