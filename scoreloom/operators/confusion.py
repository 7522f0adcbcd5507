"""Additive confusion counts and the metric tables built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.functions.scalars import ratio


def count_exprs(label: str = "label", call: str = "call", weight: str | None = None) -> list[Column]:
    """tp/fp/tn/fn as BIGINT sums (optionally weighted)."""
    y, p = F.col(label) == 1, F.col(call) == 1
    cells = {"tp": y & p, "fp": ~y & p, "tn": ~y & ~p, "fn": y & ~p}
    if weight is None:
        return [F.count_if(c).alias(n) for n, c in cells.items()]
    return [F.sum(F.when(c, F.col(weight)).otherwise(0)).cast("bigint").alias(n) for n, c in cells.items()]


def confusion(calls: DataFrame, keys: Sequence[str] = ("model",), **names) -> DataFrame:
    """Confusion counts per key. Partial aggregation leaves one row per key and map task."""
    return calls.groupBy(*keys).agg(*count_exprs(**names))


def with_metrics(counts: DataFrame, **options) -> DataFrame:
    return counts.select("*", *M.metric_columns(**options))


def metric_table(calls: DataFrame, keys: Sequence[str] = ("model",), **options) -> DataFrame:
    return with_metrics(confusion(calls, keys), **options)


def stratified_metrics(
    calls: DataFrame, stratum: str, *, model: str = "model", min_size: int = 0, two_class: bool = False, **options
) -> DataFrame:
    """Metrics per stratum, kept when large enough and (optionally) when both classes occur."""
    counts = confusion(calls, (model, stratum))
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    out = counts.filter(total >= min_size)
    if two_class:
        out = out.filter((F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0))
    return with_metrics(out, **options)


def category_vs_negatives(
    calls: DataFrame, category: str, *, model: str = "model", min_positives: int = 5, **options
) -> DataFrame:
    """Each positive category scored against the full set of negatives.

    The negatives are counted once per model and joined back to the category rows
    (a models-sized table) instead of being replicated per category.
    """
    pos = (
        calls.filter(F.col("label") == 1)
        .groupBy(model, category)
        .agg(F.count_if(F.col("call") == 1).alias("tp"), F.count_if(F.col("call") == 0).alias("fn"))
        .filter(F.col("tp") + F.col("fn") >= min_positives)
    )
    neg = (
        calls.filter(F.col("label") == 0)
        .groupBy(model)
        .agg(F.count_if(F.col("call") == 1).alias("fp"), F.count_if(F.col("call") == 0).alias("tn"))
    )
    joined = pos.join(neg, model).select(model, category, *M.COUNTS)
    return with_metrics(joined, **options)


def macro_summary(calls: DataFrame, source: str, *, model: str = "model", round_dp: int | None = None) -> DataFrame:
    """Per model: mean/min/max recall over positive sources, mean/max FPR over negative
    sources and the source with the worst FPR (first by name on ties)."""
    per = calls.groupBy(model, source, "label").agg(F.count("*").alias("n"), F.count_if(F.col("call") == 1).alias("k"))
    rate = F.col("k") / F.col("n")
    if round_dp is not None:
        rate = F.round(rate, round_dp)
    per = per.withColumn("rate", rate)
    pos, neg = F.col("label") == 1, F.col("label") == 0
    worst = F.min(F.when(neg, F.struct((-F.col("rate")).alias("r"), F.col(source).alias("s"))))
    return per.groupBy(model).agg(
        F.avg(F.when(pos, F.col("rate"))).alias("macro_recall"),
        F.min(F.when(pos, F.col("rate"))).alias("min_recall"),
        F.max(F.when(pos, F.col("rate"))).alias("max_recall"),
        F.avg(F.when(neg, F.col("rate"))).alias("macro_fpr"),
        F.max(F.when(neg, F.col("rate"))).alias("max_fpr"),
        worst["s"].alias("worst_negative_source"),
        F.count_if(pos).alias("n_positive_sources"),
        F.count_if(neg).alias("n_negative_sources"),
    )


def family_metrics(counts: DataFrame, *, family: str = "family", model: str = "model", **options) -> DataFrame:
    """Counts summed over the models of a family, then metrics; lists the members."""
    agg = counts.groupBy(family).agg(
        *[F.sum(c).alias(c) for c in M.COUNTS], F.concat_ws(",", F.sort_array(F.collect_set(model))).alias("members")
    )
    return with_metrics(agg, **options)


def coverage(calls: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """How many entities each model actually scored."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("n_entities"), F.count_if("emitted").alias("n_scored")
    ).withColumn("coverage", ratio(F.col("n_scored"), F.col("n_entities")))


def false_positive_strata(calls: DataFrame, stratum: str, *, model: str = "model") -> DataFrame:
    """False positives per stratum: count, share of the model's FPs, rate in the stratum."""
    per = (
        calls.filter(F.col("label") == 0)
        .groupBy(model, stratum)
        .agg(F.count("*").alias("n_neg"), F.count_if(F.col("call") == 1).alias("fp"))
    )
    share = ratio(F.col("fp"), F.sum("fp").over(Window.partitionBy(model)))
    return per.withColumn("share_of_fp", share).withColumn("fp_rate", ratio(F.col("fp"), F.col("n_neg")))


def concordance(calls: DataFrame, keys: Sequence[str], *, status: str = "status") -> DataFrame:
    """Model call against an independent signal; ambiguous entities are left out.

    a: call & signal, b: call only, d: signal only, e: neither. Recall/precision
    are NULL without a denominator; enrichment = recall / calling rate.
    """
    pos, call = F.col(status) == "positive", F.col("call") == 1
    counts = calls.filter(F.col(status) != "ambiguous").groupBy(*keys).agg(
        F.count_if(call & pos).alias("a"), F.count_if(call & ~pos).alias("b"),
        F.count_if(~call & pos).alias("d"), F.count_if(~call & ~pos).alias("e"),
    )
    return concordance_metrics(counts)


def concordance_metrics(counts: DataFrame) -> DataFrame:
    a, b, d, e = (F.col(c) for c in "abde")
    rec, rate = ratio(a, a + d, None), ratio(a + b, a + b + d + e, None)
    return counts.select(
        "*", rec.alias("recall"), ratio(a, a + b, None).alias("precision"), M.f1(a, b, d).alias("f1"),
        M.mcc(a, b, e, d).alias("mcc"), rate.alias("calling_rate"),
        F.try_divide(rec, F.nullif(rate, F.lit(0.0))).alias("enrichment"),
    )
