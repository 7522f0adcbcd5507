"""Hypothesis tests, correlations and distribution summaries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.functions import pvalues as P
from scoreloom.functions.scalars import ratio
from scoreloom.operators.ordered import exact_quantiles, mid_ranks


def cochran_q(correct: DataFrame, *, entity: str = "entity_id", keys: Sequence[str] = (), value: str = "correct") -> DataFrame:
    """Cochran's Q over models from two aggregates: sums per model and sums per entity.

    Degenerate input (no variation) gives Q = 0, p = 1.
    """
    keys = list(keys)
    col_sums = correct.groupBy(*keys, "model").agg(F.sum(value).cast("bigint").alias("t"))
    row_sums = correct.groupBy(*keys, entity).agg(F.sum(value).cast("bigint").alias("l"))
    c = col_sums.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("t").cast("double").alias("st"),
        F.sum(F.col("t").cast("double") * F.col("t")).alias("st2"),
    )
    r = row_sums.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("l").cast("double") * F.col("l")).alias("sl2"))
    if keys:
        j = c.join(r, keys)
    else:
        j = c.withColumn("n", r.select("n").scalar()).withColumn("sl2", r.select("sl2").scalar())
    num = (F.col("k") - 1) * (F.col("k") * F.col("st2") - F.col("st") * F.col("st"))
    den = F.col("k") * F.col("st") - F.col("sl2")
    return j.select(
        *keys, "n", "k", (F.col("k") - 1).alias("df"), ratio(num, den).alias("q"),
        F.when(den == 0, "no_variation").otherwise("ok").alias("note"),
    )


def cochran_p(q: DataFrame) -> DataFrame:
    p = F.when(F.col("note") == "no_variation", 1.0).otherwise(P.chi2_tail(F.col("q"), F.col("df").cast("int")))
    return q.withColumn("p_value", p)


def discordant_pairs(patterns: DataFrame, models: Sequence[str], *, keys: Sequence[str] = (), weight: str = "n_entities") -> DataFrame:
    """b/c discordance counts of every model pair from outcome patterns.

    ``patterns`` has label, pattern (one call digit per model) and a count; the pair
    loop runs over pattern rows, at most 2**(models+1) of them, never over entities.
    """
    right = lambda i: F.substring("pattern", i + 1, 1).cast("int") == F.col("label")
    pair = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(models[i]).alias("model_a"), F.lit(models[j]).alias("model_b"),
                    (right(i) & ~right(j)).alias("only_a"), (~right(i) & right(j)).alias("only_b"),
                )
                for i, j in combinations(range(len(models)), 2)
            ]
        )
    )
    long = patterns.select(*keys, weight, pair.alias("p"))
    return long.groupBy(*keys, F.col("p.model_a").alias("model_a"), F.col("p.model_b").alias("model_b")).agg(
        F.sum(F.when(F.col("p.only_a"), F.col(weight)).otherwise(0)).alias("b"),
        F.sum(F.when(F.col("p.only_b"), F.col(weight)).otherwise(0)).alias("c"),
    )


def mcnemar(pairs: DataFrame, *, exact_below: int = 25, with_p: bool = True) -> DataFrame:
    """McNemar per pair: exact binomial for few discordant entities, else the
    continuity-corrected chi-square; none discordant -> p = 1."""
    n = F.col("b") + F.col("c")
    diff = F.abs(F.col("b") - F.col("c")).cast("double") - 1.0
    stat = F.when(n >= exact_below, ratio(diff * diff, n)).otherwise(None)
    test = F.when(n == 0, "no_discordant").when(n < exact_below, "exact_binomial").otherwise("chi2_corrected")
    out = pairs.withColumn("test", test).withColumn("statistic", stat)
    small = F.when((n > 0) & (n < exact_below), P.binomial_two_sided(F.when(n < exact_below, F.col("b")).otherwise(0), F.when(n < exact_below, F.col("c")).otherwise(0)))
    out = out.withColumn("p_exact", F.when(n == 0, 1.0).otherwise(small))
    if not with_p:
        return out
    chi = P.chi2_tail(F.coalesce("statistic", F.lit(0.0)), F.lit(1))
    return out.withColumn("p_value", F.coalesce("p_exact", chi)).drop("p_exact")


def group_mcnemar(
    calls: DataFrame, group: str, first: str, second: str, *, entity: str = "entity_id", min_positive: int = 5, exact_below: int = 25
) -> DataFrame:
    """McNemar between two groups of models, a group calling what any of its models calls.

    One aggregate per entity, one over all. Fewer than ``min_positive`` positives give no test; the statistic is the
    first discordant count where the exact test is used, as it is in binomial tests.
    """
    on = lambda g: F.max(F.when(F.col(group) == g, F.col("call")))
    per = calls.groupBy(entity, "label").agg(F.coalesce(on(first), F.lit(0)).alias("_a"), F.coalesce(on(second), F.lit(0)).alias("_b"))
    y, right_a, right_b = F.col("label") == 1, F.col("_a") == F.col("label"), F.col("_b") == F.col("label")
    agg = per.agg(
        F.count_if(y).alias("n_positive"), F.count_if(~y).alias("n_negative"), F.count_if(y & right_a).alias("_ra"), F.count_if(y & right_b).alias("_rb"),
        F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c"))
    agg = agg.select("n_positive", "n_negative", ratio(F.col("_ra"), F.col("n_positive")).alias("recall_first"), ratio(F.col("_rb"), F.col("n_positive")).alias("recall_second"), "b", "c")
    out = mcnemar(agg, exact_below=exact_below)
    few = F.col("n_positive") < min_positive
    stat = F.when(F.col("test") == "exact_binomial", F.col("b").cast("double")).when(F.col("test") == "no_discordant", 0.0).otherwise(F.col("statistic"))
    note = F.when(few, "too_few_positives").when(F.col("test") == "no_discordant", "no_discordant_pairs").otherwise("ok")
    return out.select("n_positive", "n_negative", "recall_first", "recall_second", "b", "c", F.when(~few, F.col("test")).alias("test"), F.when(~few, stat).alias("statistic"), F.when(~few, F.col("p_value")).alias("p_value"), note.alias("note"))


def rank_sum(df: DataFrame, value: str, group: str, first: str, second: str, *, keys: Sequence[str] = ("model",),
             min_n: int = 2) -> DataFrame:
    """Rank-sum U of ``first`` vs ``second`` per key with medians and the tie term.
    Values are per-block metrics, so a key holds as many rows as there are blocks."""
    two = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ranked = mid_ranks(two, value, group=keys, name="_r").withColumn(
        "_t", F.count("*").over(Window.partitionBy(*keys, value))
    )
    in_a, in_b = F.col(group) == first, F.col(group) == second
    agg = ranked.groupBy(*keys).agg(
        F.count_if(in_a).alias("n_a"), F.count_if(in_b).alias("n_b"),
        F.median(F.when(in_a, F.col(value))).alias("median_a"), F.median(F.when(in_b, F.col(value))).alias("median_b"),
        F.sum(F.when(in_a, F.col("_r"))).alias("_ra"),
        # sum of (t^3 - t) over tie groups, spread over their members as t^2 - 1
        F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("tie_term"),
    )
    u = F.col("_ra") - F.col("n_a") * (F.col("n_a") + 1) / 2.0
    enough = (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n)
    return agg.select(
        *keys, "n_a", "n_b", "median_a", "median_b", F.when(enough, u).alias("u"),
        (F.col("median_a") - F.col("median_b")).alias("delta"), "tie_term",
        F.when(enough, "ok").otherwise("insufficient_samples").alias("note"),
    )


def rank_sum_p(df: DataFrame, side: str = "two-sided") -> DataFrame:
    return df.withColumn("p_value", P.rank_sum_p("u", "n_a", "n_b", "tie_term", F.lit(side)))


def signed_rank(pairs: DataFrame, diff: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Signed-rank statistic W+ of paired differences (zeros dropped), one row per block."""
    base = pairs.withColumn("_a", F.round(F.abs(F.col(diff)), 12)) if keys else pairs.withColumn("_all", F.lit(1)).withColumn("_a", F.round(F.abs(F.col(diff)), 12))
    g = list(keys) or ["_all"]
    nz = base.filter(F.col("_a") > 0)
    ranked = mid_ranks(nz, "_a", group=g, name="_r").withColumn("_t", F.count("*").over(Window.partitionBy(*g, "_a")))
    stat = ranked.groupBy(*g).agg(
        F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.count("*").alias("n_nonzero"),
        F.sum(F.col("_t") * F.col("_t") - 1).cast("double").alias("tie_term"),
    )
    total = base.groupBy(*g).agg(F.count("*").alias("n"), F.avg(diff).alias("mean_diff"), F.count_if(F.col("_a") == 0).alias("n_zero"))
    if not keys:
        one = stat.select(F.struct("w_plus", "n_nonzero", "tie_term")).scalar()
        return total.drop("_all").withColumn("_s", one).select("n", "mean_diff", "n_zero", "_s.*")
    return total.join(stat, g, "left")


def fisher_table(counts: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Odds ratio of a 2x2 table in four columns."""
    return counts.withColumn(
        "odds_ratio", ratio(F.col(a).cast("double") * F.col(d), F.col(b).cast("double") * F.col(c), None)
    )


def pearson(pairs: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation per key; NULL when either side is constant."""
    flat = (F.var_pop(x) == 0) | (F.var_pop(y) == 0)
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(~flat, F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))).alias("r")
    )


def spearman(pairs: DataFrame, x: str, y: str, keys: Sequence[str] = (), *, ties: str = "average", tie: Sequence[str] = ()) -> DataFrame:
    """Spearman: Pearson on mid-ranks, or on ordinal ranks with ``ties='ordinal'``."""
    if ties == "average":
        ranked = mid_ranks(mid_ranks(pairs, x, group=keys, name="_rx"), y, group=keys, name="_ry")
    else:
        order = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(c).desc(), *tie))
        ranked = pairs.withColumn("_rx", order(x)).withColumn("_ry", order(y))
    return pearson(ranked, "_rx", "_ry", keys)


def lin_concordance(pairs: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    gap = F.avg(x) - F.avg(y)
    return pairs.groupBy(*keys).agg(
        F.try_divide(2.0 * F.covar_pop(x, y), F.var_pop(x) + F.var_pop(y) + gap * gap).alias("ccc")
    )


def exact_rank_permutation(groups: DataFrame, value: str, member: Column, *, keys: Sequence[str]) -> DataFrame:
    """Exact permutation null of the rank sum, ties kept. One row per unit (a model), so a key holds a handful."""
    ranked = mid_ranks(groups, value, group=keys, name="_r").withColumn("_in", member)
    packed = ranked.groupBy(*keys).agg(
        F.sort_array(F.collect_list("_r")).alias("_u"), F.count("*").cast("int").alias("n"),
        F.count_if("_in").cast("int").alias("k"), F.sum(F.when(F.col("_in"), F.col("_r")).otherwise(0.0)).alias("_obs"),
    )
    tails = packed.withColumn("_t", P.exact_rank_tails("_u", "k", "_obs")).select("*", "_t.*")
    return tails.select(
        *keys, F.col("k").alias("n_first"), (F.col("n") - F.col("k")).alias("n_second"),
        (F.col("_obs") - F.col("k") * (F.col("k") + 1) / 2.0).alias("u"),
        F.least(F.lit(1.0), 2.0 * F.least("p_less", "p_greater")).alias("p_two_sided"), "p_greater", "p_less",
    )


def prevalence_crossover(rates: DataFrame, grid: Sequence[float], *, keys: Sequence[str] = ()) -> DataFrame:
    """First grid prevalence where model a's MCC reaches model b's (NULL if never)."""
    pi = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    at = rates.withColumn("pi", pi)
    a = M.mcc_at_prevalence(F.col("tpr_a"), F.col("fpr_a"), F.col("pi"))
    b = M.mcc_at_prevalence(F.col("tpr_b"), F.col("fpr_b"), F.col("pi"))
    return at.groupBy(*keys).agg(F.min(F.when(a - b >= 0, F.col("pi"))).alias("crossover"))


def quantile_grid(df: DataFrame, value: str, *, step: float | None, anchor: float, probs=(0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Data-driven grid: quantiles rounded half-even to ``step`` (or to integers > 1),
    plus the anchor value, distinct."""
    q = exact_quantiles(df, value, probs).select(F.explode("quantiles").alias("_v"))
    if step:
        vals = q.select((F.bround(F.col("_v") / step, 0) * step).cast("int").alias("grid_value"))
    else:
        vals = q.select(F.greatest(F.lit(1), F.bround("_v", 0).cast("int")).alias("grid_value")).filter("grid_value > 1")
    extra = df.sparkSession.range(1).select(F.lit(int(anchor)).alias("grid_value"))
    return vals.unionByName(extra).distinct()
