"""Two-arm contrasts on additive per-block counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.functions.scalars import ratio


def arm_totals(counts: DataFrame, keys=("model",), *, arm: str = "arm", low: str = "low", high: str = "high", n_blocks: bool = True) -> DataFrame:
    """One row per key with the summed counts of both arms (suffixes _l and _h)."""
    pick = lambda a, c: F.sum(F.when(F.col(arm) == a, F.col(c)).otherwise(0))
    cols = [pick(a, c).alias(f"{c}_{s}") for a, s in ((low, "l"), (high, "h")) for c in M.COUNTS]
    if n_blocks:
        cols += [F.count_if(F.col(arm) == a).alias(f"n_{s}") for a, s in ((low, "l"), (high, "h"))]
    return counts.groupBy(*keys).agg(*cols)


def _rates(s: str) -> dict[str, Column]:
    tp, fp, tn, fn, n = (F.col(f"{c}_{s}") for c in (*M.COUNTS, "n"))
    return {
        "per_sample": ratio(tp + fp + tn + fn, n, None), "positives": ratio(tp + fn, n, None), "called": ratio(tp + fp, n, None),
        "recall": ratio(tp, tp + fn, None), "fpr": ratio(fp, fp + tn, None), "precision": ratio(tp, tp + fp, None), "mcc": M.mcc(tp, fp, tn, fn),
    }


def arm_deltas(totals: DataFrame, keys=("model",)) -> DataFrame:
    """Rate differences and ratios, high arm against low arm."""
    lo, hi = _rates("l"), _rates("h")
    div = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0)))
    pos, call = div(hi["positives"], lo["positives"]), div(hi["called"], lo["called"])
    return totals.select(
        *keys, lo["per_sample"].alias("per_sample_low"), hi["per_sample"].alias("per_sample_high"),
        *[(hi[k] - lo[k]).alias(f"{k}_delta") for k in ("recall", "fpr", "precision", "mcc")],
        pos.alias("positive_ratio"), call.alias("call_ratio"), div(call, pos).alias("calls_vs_positives"),
    )


def arm_contrast(counts: DataFrame, *, model: str = "model") -> DataFrame:
    return arm_deltas(arm_totals(counts, (model,)), (model,))


def estimands(totals: DataFrame, per_block: DataFrame, cohort: Column, keys=("model",)) -> DataFrame:
    """Four high-minus-low MCC estimands: pooled, mean per block, standardised to the
    low arm's prevalence and to the cohort's.

    ``totals`` from arm_totals; ``per_block`` has keys, mean_l, mean_h; ``cohort``
    is the cohort prevalence column.
    """
    c = lambda s: tuple(F.col(f"{x}_{s}") for x in M.COUNTS)

    def at(s, pi):
        tp, fp, tn, fn = c(s)
        return M.mcc_at_prevalence(ratio(tp, tp + fn), ratio(fp, fp + tn), pi)

    tp, fp, tn, fn = c("l")
    pi_low = ratio(tp + fn, tp + fp + tn + fn)
    j = totals.join(per_block, list(keys))
    pooled_l, pooled_h = M.mcc(*c("l")), M.mcc(*c("h"))
    return j.select(
        *keys, (pooled_h - pooled_l).alias("pooled"), (F.col("mean_h") - F.col("mean_l")).alias("mean_per_sample"),
        (at("h", pi_low) - pooled_l).alias("prev_std_low"), (at("h", cohort) - at("l", cohort)).alias("prev_std_cohort"),
    )
