"""Metric expressions over the four confusion counts (additive BIGINT columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.scalars import col, ratio

COUNTS = ("tp", "fp", "tn", "fn")


def mcc(tp="tp", fp="fp", tn="tn", fn="fn") -> Column:
    """Matthews correlation; 0 when any margin is empty. Margins multiply in DOUBLE."""
    tp, fp, tn, fn = (col(c).cast("double") for c in (tp, fp, tn, fn))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return ratio(tp * tn - fp * fn, den)


def precision(tp="tp", fp="fp", empty: float | None = 0.0) -> Column:
    return ratio(col(tp), col(tp) + col(fp), empty)


def recall(tp="tp", fn="fn", empty: float | None = 0.0) -> Column:
    return ratio(col(tp), col(tp) + col(fn), empty)


def specificity(tn="tn", fp="fp", empty: float | None = None) -> Column:
    return ratio(col(tn), col(tn) + col(fp), empty)


def fpr(fp="fp", tn="tn", empty: float | None = None) -> Column:
    return ratio(col(fp), col(fp) + col(tn), empty)


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    """Harmonic mean of precision and recall, 0 when both are 0."""
    return ratio(2.0 * col(tp), 2.0 * col(tp) + col(fp) + col(fn))


def metric_columns(
    tp="tp", fp="fp", tn="tn", fn="fn", *, empty: float | None = 0.0, fdr_empty: float | None = 1.0,
    round_dp: int | None = None,
) -> list[Column]:
    """The standard metric set. ``empty`` is the zero-denominator value of
    precision/recall, ``fdr_empty`` that of FDR; specificity/FPR are NULL."""
    exprs = {
        "precision": precision(tp, fp, empty),
        "recall": recall(tp, fn, empty),
        "specificity": specificity(tn, fp),
        "fpr": fpr(fp, tn),
        "fdr": ratio(col(fp), col(tp) + col(fp), fdr_empty),
        "f1": f1(tp, fp, fn),
        "mcc": mcc(tp, fp, tn, fn),
    }
    out = [(e if round_dp is None else F.round(e, round_dp)).alias(n) for n, e in exprs.items()]
    out.append((col(tp) + col(fp)).alias("n_predicted"))
    out.append((col(tp) + col(fp) + col(tn) + col(fn)).alias("n_total"))
    return out


def mcc_at_prevalence(tpr: Column, fpr_: Column, pi: Column) -> Column:
    """MCC with the error rates held fixed and the positive share set to ``pi``."""
    tp, fn = pi * tpr, pi * (1.0 - tpr)
    fp, tn = (1.0 - pi) * fpr_, (1.0 - pi) * (1.0 - fpr_)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return ratio(tp * tn - fp * fn, den)
