"""Tests and resampling: known values, published results, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.functions import pvalues as P
from scoreloom.operators import mixture as X
from scoreloom.operators import replicates as R
from scoreloom.operators import resample as B
from scoreloom.operators import stats as T
from scoreloom.plans import studies as ST


def one(spark, cols, schema, expr):
    return spark.createDataFrame([cols], schema).select(expr).first()[0]


@pytest.mark.parametrize("x, df, want", [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (22.362032494826934, 13, 0.05), (0.0, 3, 1.0), (7.814727903251179, 3, 0.05)])
def test_chi2_tail(spark, x, df, want):
    assert one(spark, (x, df), "x double, k int", P.chi2_tail("x", "k")) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("r, n, want", [(0.506, 14, 0.064846), (0.607, 14, 0.021269), (0.733, 14, 0.002878)])
def test_correlation_p_published(spark, r, n, want):
    assert one(spark, (r, n), "r double, n int", P.correlation_p("r", "n")) == pytest.approx(want, rel=0.01)


@pytest.mark.parametrize("b, c", [(0, 5), (3, 9), (7, 7), (0, 1), (10, 14)])
def test_binomial_two_sided(spark, b, c):
    n, k = b + c, min(b, c)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert one(spark, (b, c), "b int, c int", P.binomial_two_sided("b", "c")) == pytest.approx(want)


def test_fisher_published(spark):
    df = spark.createDataFrame([(36, 126, 77, 85)], "a bigint, b bigint, c bigint, d bigint")
    r = T.fisher_table(df, "a", "b", "c", "d").withColumn("p", P.fisher_less("a", "b", "c", "d")).first()
    assert round(r["odds_ratio"], 4) == 0.3154 and r["p"] == pytest.approx(1.3054353348734495e-06, rel=1e-6)


@pytest.mark.parametrize("u, n1, n2, t, want", [(7.0, 5, 4, 0.0, 0.5555555555555556), (9.0, 5, 4, 0.0, 0.9047619047619049), (11.0, 5, 4, 0.0, 0.9047619047619049)])
def test_rank_sum_exact_published(spark, u, n1, n2, t, want):
    got = one(spark, (u, n1, n2, t), "u double, a int, b int, t double", P.rank_sum_p("u", "a", "b", "t", F.lit("two-sided")))
    assert got == pytest.approx(want)


def test_signed_rank_exact(spark):
    # n = 4, W+ = 10: only the all-positive assignment reaches it.
    assert one(spark, (10.0, 4, 0.0, 0), "w double, n int, t double, z int", P.signed_rank_p_greater("w", "n", "t", "z")) == pytest.approx(1 / 16)


# Published per-model recalls of marker and sequence models.
RECALL = {"marker": (0.9796, 0.9592, 0.9592, 0.7551), "sequence": (0.9184, 0.898, 0.8776, 0.8571, 0.8163, 0.6327, 0.3878)}
RATE = {"marker": (0.2004, 0.2921, 0.2765, 0.1028), "sequence": (0.6349, 0.5164, 0.3279, 0.2884, 0.2981, 0.3435, 0.1826)}


def test_exact_permutation_published(spark):
    rows = [(name, g, v) for name, t in (("recall", RECALL), ("rate", RATE)) for g, vs in t.items() for v in vs]
    df = spark.createDataFrame(rows, "metric string, g string, v double")
    got = {r["metric"]: r for r in T.exact_rank_permutation(df, "v", F.col("g") == "marker", keys=["metric"]).collect()}
    r = got["recall"]
    assert (r["u"], round(r["p_two_sided"], 4), round(r["p_greater"], 4), round(r["p_less"], 4)) == (23.0, 0.097, 0.0485, 0.9576)
    r = got["rate"]
    assert (r["u"], round(r["p_two_sided"], 4), round(r["p_greater"], 4), round(r["p_less"], 4)) == (4.0, 0.0727, 0.9788, 0.0364)


# Published model metrics in three contexts.
CONTEXT = {
    "x": (0.1517, 0.2165, 0.2825, 0.0906, 0.1485, 0.1716, -0.0232, 0.0486, 0.0, 0.6507, 0.0132, 0.0, 0.2795, 0.536),
    "y": (0.1389, 0.3304, 0.5006, 0.0967, 0.1839, 0.3541, -0.0442, 0.0418, 0.0, 0.6409, -0.0091, 0.237, 0.375, 0.6035),
    "z": (0.1696, 0.2654, 0.6378, 0.2206, 0.2945, 0.4013, -0.3305, 0.1106, 0.0, 0.7784, -0.1748, 0.4461, 0.1974, 0.659),
}


def test_context_correlations_published(spark):
    rows = [(f"m{i}", c, v) for c, vs in CONTEXT.items() for i, v in enumerate(vs)]
    out = ST.context_correlations(spark.createDataFrame(rows, "model string, context string, v double"))
    got = {(r["context_a"], r["context_b"]): round(r["rho"], 3) for r in out.collect()}
    assert got == {("x", "y"): 0.906, ("x", "z"): 0.733, ("y", "z"): 0.903}


def test_cochran_and_mcnemar_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = (rng.random((120, 4)) < np.array([0.3, 0.5, 0.5, 0.7])).astype(int)
    rows = [(i, f"m{j}", 1, int(x[i, j])) for i in range(120) for j in range(4)]
    df = spark.createDataFrame(rows, "entity_id int, model string, label int, call int")
    tj, li, k = x.sum(0).astype(float), x.sum(1).astype(float), 4
    want = (k - 1) * (k * (tj**2).sum() - tj.sum() ** 2) / (k * tj.sum() - (li**2).sum())
    r = T.cochran_q(df.withColumn("correct", F.col("call"))).first()
    assert r["q"] == pytest.approx(want) and (r["n"], r["df"]) == (120, 3)
    names = [f"m{j}" for j in range(4)]
    pairs = T.discordant_pairs(B.outcome_patterns(df, names), names)
    for p in T.mcnemar(pairs).collect():
        a, b = int(p["model_a"][1]), int(p["model_b"][1])
        assert (p["b"], p["c"]) == (((x[:, a] == 1) & (x[:, b] == 0)).sum(), ((x[:, a] == 0) & (x[:, b] == 1)).sum())
        assert 0 <= p["p_value"] <= 1


def test_cochran_without_variation(spark):
    df = spark.createDataFrame([(i, m, 1) for i in range(6) for m in ("a", "b")], "entity_id int, model string, correct int")
    r = T.cochran_p(T.cochran_q(df)).first()
    assert (r["q"], r["p_value"], r["note"]) == (0.0, 1.0, "no_variation")


def test_correlations(spark):
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 6, 40).astype(float), rng.integers(0, 6, 40).astype(float)
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y)] + [("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "k string, x double, y double")

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    got = {r["k"]: r["r"] for r in T.spearman(df, "x", "y", ["k"]).collect()}
    assert got["k"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1]) and got["flat"] is None
    ccc = {r["k"]: r["ccc"] for r in T.lin_concordance(df, "x", "y", ["k"]).collect()}
    assert ccc["k"] == pytest.approx(2 * np.cov(x, y, bias=True)[0, 1] / (x.var() + y.var() + (x.mean() - y.mean()) ** 2))


def test_unit_weights_sum_and_strata(spark):
    units = spark.createDataFrame([("a" if i < 30 else "b", f"u{i}") for i in range(40)], "arm string, unit string")
    w = B.unit_weights(units, ["unit"], 20, 1)
    assert {r["n"] for r in w.groupBy("b").agg(F.sum("w").alias("n")).collect()} == {40}
    s = B.unit_weights(units, ["arm", "unit"], 20, 1, strata=["arm"])
    assert {(r["arm"], r["n"]) for r in s.groupBy("arm", "b").agg(F.sum("w").alias("n")).collect()} == {("a", 30), ("b", 10)}
    # Same seed, same draws, whatever the partitioning.
    again = B.unit_weights(units.repartition(13), ["unit"], 20, 1)
    assert w.exceptAll(again).count() == 0 and again.exceptAll(w).count() == 0


def test_entity_bootstraps_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, m, int(i % 3 == 0), int(rng.random() < 0.4)) for i in range(600) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "entity_id int, model string, label int, call int")
    pat = B.outcome_patterns(df, ["a", "b"])
    hashed = R.cell_replicates(B.entity_patterns(df, ["a", "b"]), ["label", "pattern"], "entity_id", 300, 5)
    drawn = B.multinomial_pattern_weights(pat, 300, 5)
    assert {r["n"] for r in drawn.groupBy("b").agg(F.sum("w").alias("n")).collect()} == {600}
    assert np.mean([r["n"] for r in hashed.groupBy("b").agg(F.sum("w").alias("n")).collect()]) == pytest.approx(600, rel=0.02)
    se = []
    for w in (hashed, drawn):
        reps = B.pattern_counts(w, ["a", "b"], "w").withColumn("mcc", M.mcc())
        se.append({r["model"]: r["se"] for r in B.interval(reps, "mcc").collect()})
    for m in ("a", "b"):
        assert se[0][m] == pytest.approx(se[1][m], rel=0.2)


def test_interval_drops_non_finite(spark):
    df = spark.createDataFrame([("m", float(x)) for x in range(101)] + [("m", float("nan")), ("m", None)], "model string, v double")
    r = B.interval(df, "v").first()
    assert (r["lo"], r["hi"], r["n_valid"]) == (2.5, 97.5, 101)


def test_permutation_p_counts_the_observed(spark):
    obs = spark.createDataFrame([("m", 0.5)], "model string, r double")
    reps = spark.createDataFrame([("m", x) for x in (0.5, -0.6, 0.1, 0.2)], "model string, r double")
    assert B.permutation_p(obs, reps, "r", ["model"]).first()["p_perm"] == pytest.approx(3 / 5)


def test_subsample_by_pattern_keeps_positives(spark):
    pat = spark.createDataFrame([(1, "10", 30), (1, "00", 10), (0, "10", 500), (0, "01", 300)], "label int, pattern string, n_entities bigint")
    w = B.hypergeometric_pattern_weights(pat, (1, 4), 5, 3)
    for r in w.groupBy("ratio", "rep", "label").agg(F.sum("w").alias("n")).collect():
        assert r["n"] == (40 if r["label"] == 1 else 40 * r["ratio"])


def test_prevalence_standardisation(spark):
    df = spark.createDataFrame([(0.8, 0.1)], "t double, f double")
    got = df.select(M.mcc_at_prevalence(F.col("t"), F.col("f"), F.lit(0.5))).first()[0]
    tp, fn, fp, tn = 0.4, 0.1, 0.05, 0.45
    assert got == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def plain_em(x, means, k=3, max_iter=500, tol=1e-3):
    """EM on the values themselves."""
    w, m, v, old = np.full(k, 1 / k), np.array(means), np.full(k, (x.std() / k) ** 2), -np.inf
    for _ in range(max_iter):
        logs = np.log(w) - 0.5 * np.log(2 * np.pi * v) - (x[:, None] - m) ** 2 / (2 * v)
        lse = np.logaddexp.reduce(logs, axis=1)
        r = np.exp(logs - lse[:, None])
        n = r.sum(axis=0)
        w, m = n / len(x), (r * x[:, None]).sum(axis=0) / n
        v = (r * (x[:, None] - m) ** 2).sum(axis=0) / n + 1e-6
        if abs(lse.mean() - old) < tol:
            break
        old = lse.mean()
    return w, m, v**0.5


def test_mixture_recovers_components(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(-2, 0.3, 600), rng.normal(0, 0.3, 300), rng.normal(2, 0.4, 150)])
    fits = X.mixture_starts(X.histogram(spark.createDataFrame([(float(v),) for v in [*x, float("inf")]], "x double"), "x"), k=3, starts=4).collect()
    assert len(fits) == 4 and {f["n"] for f in fits} == {1050}
    best = max(fits, key=lambda f: f["log_likelihood"])
    assert best["mean"] == pytest.approx([-2, 0, 2], abs=0.15) and best["converged"]
    first = best["first"]
    for have, want in zip((best["weight"], best["mean"], best["sd"]), plain_em(x, first), strict=True):
        assert have == pytest.approx(np.array(want)[np.argsort(plain_em(x, first)[1])], abs=2e-3)
    fit = X.best_mixture(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert 0.5 < ST.value_at_posterior(list(zip(fit["weight"], fit["mean"], fit["sd"])), 0.95) < 2.0
    assert fit["bic"] == pytest.approx(-2 * fit["log_likelihood"] + 8 * np.log(1050))


def test_mixture_of_nothing_and_of_one_value(spark):
    assert X.best_mixture(spark.createDataFrame([], "x double"), "x").count() == 0
    one = X.best_mixture(spark.createDataFrame([(1.5,)] * 9, "x double"), "x").first()
    assert one["mean"] == pytest.approx([1.5] * 3) and sum(one["weight"]) == pytest.approx(1)


def test_posterior_cut_published():
    # Published mixture parameters and the ratio at posterior 0.95.
    params = [(0.6433109256708077, -1.9086893369323332, 0.45821077265412047), (0.3397291905293612, -0.22942237647973746, 0.48613248722018043), (0.016959883799831103, 2.1108486009922376, 1.1658027470981867)]
    cut = 10 ** ST.value_at_posterior(params, 0.95)
    assert cut == pytest.approx(37.94464989084466, rel=1e-3)


def test_pattern_draws_with_more_patterns_than_any_limit(spark):
    """Fourteen models: thousands of patterns; means of the drawn counts agree with the exact ones."""
    rng = np.random.default_rng(8)
    seen = sorted({(int(rng.integers(2)), "".join(rng.choice(["0", "1"], 14))) for _ in range(7000)})
    assert len(seen) > 4096
    df = spark.createDataFrame([(a, b, int(rng.integers(1, 9))) for a, b in seen], "label int, pattern string, n_entities long")
    total = df.agg(F.sum("n_entities")).first()[0]
    drawn = B.multinomial_pattern_weights(df, 40, 1).groupBy("b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("label")).alias("pos")).collect()
    share = df.agg(F.sum(F.col("n_entities") * F.col("label")) / F.sum("n_entities")).first()[0]
    assert {r.n for r in drawn} == {total}
    assert abs(np.mean([r.pos for r in drawn]) / total - share) < 5 * np.sqrt(share * (1 - share) / total / 40)
    sub = B.hypergeometric_pattern_weights(df.withColumn("n_entities", F.when(F.col("label") == 1, 1).otherwise(F.col("n_entities") * 10)), (1, 2), 5, 1)
    n_pos = sum(a for a, _ in seen)
    assert {(r.ratio, r.n) for r in sub.filter("label = 0").groupBy("ratio", "rep").agg(F.sum("w").alias("n")).collect()} == {(1, n_pos), (2, 2 * n_pos)}


def test_group_mcnemar_minimum_and_tests(spark):
    def run(rows):
        df = spark.createDataFrame([(i, y, f, c) for i, (y, a, b) in enumerate(rows) for f, c in (("m", a), ("s", b))], "entity_id int, label int, family string, call int")
        return T.group_mcnemar(df, "family", "m", "s").first()

    few = run([(1, 1, 0)] * 4 + [(0, 0, 1)] * 9)
    assert (few["note"], few["p_value"], few["test"]) == ("too_few_positives", None, None)
    exact = run([(1, 1, 0)] * 6 + [(0, 1, 0)] * 2)
    assert (exact["b"], exact["c"], exact["statistic"], exact["test"]) == (6, 2, 6.0, "exact_binomial") and exact["p_value"] == pytest.approx(0.2890625)
    assert (exact["recall_first"], exact["recall_second"]) == (1.0, 0.0)
    none = run([(1, 1, 1)] * 6)
    assert (none["statistic"], none["p_value"], none["note"]) == (0.0, 1.0, "no_discordant_pairs")
    many = run([(1, 1, 0)] * 30 + [(1, 0, 1)] * 10)
    assert many["test"] == "chi2_corrected" and many["statistic"] == pytest.approx(19**2 / 40)
