"""Composite studies over replicate tables (replicates x models, never entities)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.operators import stats as T
from scoreloom.operators.resample import interval


def margin_verdict(diffs: DataFrame, keys: Sequence[str], *, margin: float) -> DataFrame:
    """Chance of a difference at or above zero / below the margin, and a verdict."""
    q = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975)))
    agg = diffs.groupBy(*keys).agg(
        F.avg((F.col("diff") >= 0).cast("int")).alias("p_at_least"), F.avg((F.col("diff") <= -margin).cast("int")).alias("p_below_margin"), q.alias("_q")
    )
    verdict = F.when(F.col("_q")[1] < -margin, "below").when(F.col("_q")[0] > margin, "above").otherwise("not separated")
    return agg.withColumn("verdict", verdict).drop("_q")


def model_pairs(rows: DataFrame, values: Sequence[str], *, keys: Sequence[str] = (), model: str = "model") -> DataFrame:
    """All model pairs a < b with both sides' values (suffixes _a, _b), per key.

    Pairs are built from the models-sized list of each key, so nothing is self-joined.
    """
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(model).alias("m"), *values))).alias("_r"))
    fields = ", ".join(f"'{v}_a', x.{v}, '{v}_b', y.{v}" for v in values)
    pairs = F.expr(
        "flatten(transform(_r, (x, i) -> transform(slice(_r, i + 2, greatest(size(_r) - i - 1, 0)),"
        f" y -> named_struct('model_a', x.m, 'model_b', y.m, {fields}))))"
    )
    return packed.select(*keys, F.inline(pairs))


def two_cohort_rho(first: DataFrame, second: DataFrame, first_point: DataFrame, second_point: DataFrame) -> DataFrame:
    """Rank correlation of model values between cohorts, resampling both, only the
    first or only the second; percentile interval per scope.

    Inputs hold model, b, v (replicates) and model, v (points): models-sized tables
    per replicate.
    """
    x = lambda df: df.withColumnRenamed("v", "x")
    y = lambda df: df.withColumnRenamed("v", "y")
    both = x(first).join(y(second), ["model", "b"]).withColumn("scope", F.lit("both"))
    one = x(first).join(y(second_point), "model").withColumn("scope", F.lit("early_only"))
    two = x(first_point).join(y(second), "model").withColumn("scope", F.lit("late_only"))
    cols = ["scope", "b", "model", "x", "y"]
    rows = both.select(cols).unionByName(one.select(cols)).unionByName(two.select(cols))
    rho = T.spearman(rows, "x", "y", ["scope", "b"])
    return interval(rho, "r", ["scope"])


def carried_rates(reps: DataFrame, first: str, second: str, *, cohort: str = "cohort", level: float = 0.95) -> DataFrame:
    """Per model: error rates and MCC of two cohorts, and the second cohort's MCC at the first one's positive share.

    ``reps``: model, cohort, b and confusion counts, b = -1 being the cohort itself; both cohorts share the replicate
    number, so each replicate's rates are carried to the share of the same replicate. One aggregate brings the two
    cohorts of a model together, another the replicates.
    """
    side = lambda name, c: F.max(F.when(F.col(cohort) == name, F.col(c)))
    share = (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    rates = reps.select("model", cohort, "b", M.recall(empty=None).alias("tpr"), M.fpr().alias("fpr"), share.alias("share"), M.mcc().alias("mcc"))
    met = rates.groupBy("model", "b").agg(*[side(n, c).alias(f"{c}_{n}") for n in (first, second) for c in ("tpr", "fpr", "share", "mcc")])
    carried = M.mcc_at_prevalence(F.col(f"tpr_{second}"), F.col(f"fpr_{second}"), F.col(f"share_{first}"))
    met = met.withColumn("mcc_carried", carried).withColumn("delta_carried", F.col("mcc_carried") - F.col(f"mcc_{first}"))
    tail = round((1.0 - level) / 2.0, 12)
    point = lambda c: F.max(F.when(F.col("b") < 0, F.col(c))).alias(c)
    ends = lambda c: F.percentile(F.when(F.col("b") >= 0, F.col(c)), F.array(F.lit(tail), F.lit(1.0 - tail))).alias(f"_{c}")
    spread = [f"{c}_{n}" for n in (first, second) for c in ("tpr", "fpr")] + ["mcc_carried", "delta_carried"]
    plain = [f"{c}_{n}" for n in (first, second) for c in ("share", "mcc")]
    out = met.groupBy("model").agg(*[point(c) for c in spread + plain], *[ends(c) for c in spread])
    excludes = (F.col("_delta_carried")[0] > 0) | (F.col("_delta_carried")[1] < 0)
    return out.select("model", *plain, *[x for c in spread for x in (F.col(c), F.col(f"_{c}")[0].alias(f"{c}_lo"), F.col(f"_{c}")[1].alias(f"{c}_hi"))], excludes.alias("excludes_0"))


def context_correlations(values: DataFrame, *, model: str = "model", context: str = "context", value: str = "v") -> DataFrame:
    """Spearman between every pair of contexts over the models they share."""
    packed = values.groupBy(model).agg(F.sort_array(F.collect_list(F.struct(F.col(context).alias("c"), F.col(value).alias("v")))).alias("_r"))
    pairs = F.expr(
        "flatten(transform(_r, (x, i) -> transform(slice(_r, i + 2, greatest(size(_r) - i - 1, 0)),"
        " y -> named_struct('context_a', x.c, 'context_b', y.c, 'x', x.v, 'y', y.v))))"
    )
    rows = packed.select(model, F.inline(pairs))
    return T.spearman(rows, "x", "y", ["context_a", "context_b"]).withColumnRenamed("r", "rho")


def value_at_posterior(params: Sequence[tuple[float, float, float]], target: float, *, lo: float = -3.0, hi: float = 4.0, steps: int = 80) -> float:
    """x where the posterior of the highest component reaches ``target`` (bisection on
    the k fitted triples)."""
    import math

    def top(x: float) -> float:
        logs = [math.log(w / s) - (x - m) ** 2 / (2.0 * s * s) for w, m, s in params]
        peak = max(logs)
        e = [math.exp(v - peak) for v in logs]
        return e[-1] / sum(e)

    for _ in range(steps):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if top(mid) < target else (lo, mid)
    return 0.5 * (lo + hi)


def with_cut(fit: DataFrame, target: float, *, lo: float, hi: float) -> DataFrame:
    """A fitted mixture (one row) with the value at which its highest component reaches a posterior."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(cut=[value_at_posterior(list(zip(r.weight, r.mean, r.sd, strict=True)), target, lo=lo, hi=hi) for r in pdf.itertuples()])

    return fit.select("weight", "mean", "sd", "log_likelihood", "bic", "n").mapInPandas(
        run, "weight array<double>, mean array<double>, sd array<double>, log_likelihood double, bic double, n long, cut double")
