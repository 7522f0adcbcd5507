"""Tie-collapsed precision-recall curves, average precision and threshold search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.functions.scalars import at_least, is_finite, ratio
from scoreloom.operators.decide import gate_open
from scoreloom.operators.ordered import laid_out, running_totals


def score_histogram(scored: DataFrame, keys: Sequence[str] = ("model",), *, weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score (the only pass over entities)."""
    w = F.col(weight) if weight else F.lit(1)
    return scored.groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("label") == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col("label") == 0, w).otherwise(0)).cast("bigint").alias("neg"),
    )


def operating_points(hist: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """cum_pos / cum_neg at every distinct score, highest score first. ``hist`` is a
    table that ``laid_out`` wrote."""
    return running_totals(hist, keys, "score", ["pos", "neg"], descending=True)


def average_precision(
    scored: DataFrame, keys: Sequence[str] = ("model",), *, weight: str | None = None, ranges: int | None = None,
) -> DataFrame:
    """AUPRC with ties collapsed: sum over distinct scores of delta-recall x precision.

    0.0 without positives; NULL with at most one distinct score or any non-finite
    score. Delta recall at a score is pos/n_pos, so no lag is needed.
    """
    keys = list(keys)
    hist = score_histogram(scored, keys, weight=weight)
    if weight:
        hist = hist.filter(F.col("pos") + F.col("neg") > 0)
    hist = laid_out(hist, keys, "score", ranges=ranges)
    info = hist.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count("*").alias("n_scores"),
        F.bool_and(is_finite("score")).alias("_ok"),
    )
    pts = operating_points(hist.filter(is_finite("score")), keys)
    area = pts.groupBy(*keys).agg(
        F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("_area")
    )
    value = (
        F.when(~F.col("_ok") | (F.col("n_scores") <= 1), None)
        .when(F.col("n_pos") == 0, 0.0)
        .otherwise(F.col("_area") / F.col("n_pos"))
    )
    return info.join(area, keys, "left").select(*keys, "n_pos", "n_neg", "n_scores", value.alias("auprc"))


def pr_points(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """PR curve at distinct reported finite scores plus the (recall 0, precision 1) start."""
    keys = list(keys)
    y = F.col("label") == 1
    on = F.col("emitted") & is_finite("score")
    every = scored.groupBy(*keys, F.when(on, F.col("score")).alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    every = laid_out(every, keys, "score")
    totals = every.groupBy(*keys).agg(F.sum("pos").alias("n_pos"))
    pts = operating_points(every.filter(F.col("score").isNotNull()), keys).join(totals, keys)
    curve = pts.select(
        *keys, F.col("score").alias("threshold"), ratio(F.col("cum_pos"), F.col("n_pos")).alias("recall"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
    )
    start = totals.select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return start.unionByName(curve)


def threshold_metrics(grid: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Confusion counts and MCC at every candidate threshold: {0}, each distinct score, {1}.

    Rows failing the p gate can never be called, so they count only in the totals.
    One cumulative pass replaces a rescan per threshold.
    """
    keys = list(keys)
    gate = gate_open(grid)
    y = F.col("label") == 1
    hist = grid.groupBy(*keys, "score").agg(
        F.count_if(gate & y).alias("pos"), F.count_if(gate & ~y).alias("neg"), F.count_if(y).alias("_tp"), F.count_if(~y).alias("_tn")
    )
    # The ends ride on every score and fall together in one more aggregate of the histogram.
    zero = F.lit(0).cast("bigint")
    own = F.struct("score", "pos", "neg", "_tp", "_tn")
    ends = [F.struct(F.lit(e).alias("score"), zero.alias("pos"), zero.alias("neg"), zero.alias("_tp"), zero.alias("_tn")) for e in (0.0, 1.0)]
    hist = hist.select(*keys, F.inline(F.array(own, *ends))).groupBy(*keys, "score").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "_tp", "_tn")])
    hist = laid_out(hist, keys, "score")
    totals = hist.groupBy(*keys).agg(F.sum("_tp").alias("n_pos"), F.sum("_tn").alias("n_neg"))
    pts = operating_points(hist.filter(is_finite("score")), keys).join(totals, keys)
    return pts.select(
        *keys, F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        (F.col("n_neg") - F.col("cum_neg")).alias("tn"), (F.col("n_pos") - F.col("cum_pos")).alias("fn"),
    ).withColumn("mcc", M.mcc())


def best_threshold(grid: DataFrame, defaults: DataFrame, keys: Sequence[str] = ("model",), *, dp: int = 4) -> DataFrame:
    """Best-MCC threshold: the default is kept unless a candidate is strictly better at
    ``dp`` places; among equals the lowest threshold wins.

    ``defaults``: keys, default_threshold, default_mcc (unrounded).
    """
    keys = list(keys)
    pts = threshold_metrics(grid, keys).withColumn("mcc", F.round("mcc", dp))
    best = pts.groupBy(*keys).agg(
        F.min_by(F.struct("threshold", "mcc"), F.struct(-F.col("mcc"), F.col("threshold"))).alias("b"),
        F.count("*").alias("n_thresholds"),
    )
    d = F.round("default_mcc", dp)
    better = F.col("b.mcc") > d
    return best.join(defaults, keys).select(
        *keys, "n_thresholds", "default_threshold", d.alias("default_mcc"),
        F.when(better, F.col("b.threshold")).otherwise(F.col("default_threshold")).alias("best_threshold"),
        F.when(better, F.col("b.mcc")).otherwise(d).alias("best_mcc"),
    ).withColumn("delta_mcc", F.round(F.col("best_mcc") - F.col("default_mcc"), dp))


def threshold_sweep(grid: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ("model",)) -> DataFrame:
    """Metrics on a fixed grid of thresholds.

    Every score becomes the number of thresholds it reaches; a model is then at most
    thresholds + 1 counts, and each threshold sums the counts at or above it. One
    aggregation over entities, no join, no entity x threshold rows.
    """
    keys = list(keys)
    steps = sorted(float(t) for t in thresholds)
    slot = F.lit(0)
    for t in steps:
        slot = slot + at_least("score", t).cast("int")
    y = F.col("label") == 1
    per = grid.groupBy(*keys, slot.alias("slot")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    packed = per.groupBy(*keys).agg(
        F.collect_list(F.struct("slot", "pos", "neg")).alias("_c"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    ladder = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(t).alias("threshold")) for i, t in enumerate(steps)])).alias("g")
    above = lambda c: F.expr(f"aggregate(filter(_c, x -> x.slot >= g.at), 0L, (a, x) -> a + x.{c})")
    cells = packed.select("*", ladder).select(*keys, "g.threshold", "n_pos", "n_neg", above("pos").alias("tp"), above("neg").alias("fp"))
    return cells.select(
        *keys, "threshold", "tp", "fp", (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn")
    ).select("*", M.precision().alias("precision"), M.recall().alias("recall"), M.mcc().alias("mcc"))
