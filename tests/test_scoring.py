"""Decision rule, metrics and curve behaviours on tiny tables and random data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.functions.scalars import half_up_text
from scoreloom.operators import confusion as C
from scoreloom.operators import curves as V
from scoreloom.operators import decide as D

TRUTH = [
    ("v_accept", 1, "phage"), ("v_pvalue_boundary", 1, "phage"), ("v_missing", 1, "eukaryotic"), ("n_high_pvalue", 0, "phage"),
    ("n_below_score", 0, "phage"), ("n_false_positive", 0, "phage"), ("n_high_score_bad_pvalue", 0, "phage"), ("n_both_boundaries", 0, "phage"),
]
PRED = [
    ("v_accept", 0.5, 0.0499), ("v_pvalue_boundary", 0.9, 0.05), ("n_high_pvalue", 0.1, 0.9), ("n_below_score", 0.4999, 0.001),
    ("n_false_positive", 0.8, 0.001), ("n_high_score_bad_pvalue", 0.95, 0.051), ("n_both_boundaries", 0.5, 0.05), ("excluded", 1.0, 0.0),
]


def frames(spark, truth, pred):
    t = spark.createDataFrame(truth, "entity_id string, label int, category string")
    p = spark.createDataFrame([(e, "m", s, q) for e, s, q in pred], "entity_id string, model string, score double, pvalue double")
    return t, p


def counts(df):
    r = C.confusion(df).first()
    return r["tp"], r["fp"], r["tn"], r["fn"]


def test_joint_rule_and_boundaries(spark):
    t, p = frames(spark, TRUTH, PRED)
    calls = D.dense_calls(t, p, [D.Rule("m", 0.5, 0.05)])
    assert counts(calls) == (1, 1, 4, 2)
    r = C.metric_table(calls, round_dp=4).first()
    assert (r["precision"], r["recall"], r["mcc"], r["n_total"]) == (0.5, 0.3333, 0.1491, 8)
    assert V.average_precision(calls).first()["auprc"] == pytest.approx(0.425)
    recall = {x["category"]: x["k"] / x["n"] for x in calls.filter("label = 1").groupBy("category").agg(F.count("*").alias("n"), F.sum("call").alias("k")).collect()}
    assert recall == {"phage": 0.5, "eukaryotic": 0.0}


def test_missing_at_threshold_zero(spark):
    t, p = frames(spark, [("a", 1, "x"), ("b", 0, "x")], [("zz", 0.1, None)])
    assert counts(D.dense_calls(t, p, [D.Rule("m", 0.0)], require_present=True)) == (0, 0, 1, 1)
    assert counts(D.dense_calls(t, p, [D.Rule("m", 0.0)])) == (1, 1, 0, 0)


@pytest.mark.parametrize("bad, want", [(float("nan"), (1, 0, 1, 1)), (float("inf"), (1, 1, 0, 1)), (float("-inf"), (1, 0, 1, 1))])
def test_non_finite_scores(spark, bad, want):
    t, p = frames(spark, [("v_called", 1, "x"), ("v_missing", 1, "x"), ("neg", 0, "x")], [("v_called", 0.8, None), ("neg", bad, None)])
    calls = D.dense_calls(t, p, [D.Rule("m", 0.5)])
    assert counts(calls) == want
    assert V.average_precision(calls).first()["auprc"] is None


# Published counts and four-decimal metrics (tp, fp, tn, fn, precision, recall, f1, mcc).
PUBLISHED = [
    (476, 201, 11376, 977, 0.7031, 0.3276, 0.4469, 0.44), (317, 8, 11569, 1136, 0.9754, 0.2182, 0.3566, 0.439),
    (489, 385, 11192, 964, 0.5595, 0.3365, 0.4203, 0.3816), (512, 824, 10753, 941, 0.3832, 0.3524, 0.3672, 0.2918),
    (175, 97, 11480, 1278, 0.6434, 0.1204, 0.2029, 0.2467), (456, 892, 10685, 997, 0.3383, 0.3138, 0.3256, 0.2447),
    (543, 1392, 10185, 910, 0.2806, 0.3737, 0.3205, 0.2244), (767, 2938, 8639, 686, 0.207, 0.5279, 0.2974, 0.1913),
    (441, 1676, 9901, 1012, 0.2083, 0.3035, 0.2471, 0.1355), (280, 1304, 10273, 1173, 0.1768, 0.1927, 0.1844, 0.0771),
    (955, 6333, 5244, 498, 0.131, 0.6573, 0.2185, 0.0699), (1003, 7632, 3945, 450, 0.1162, 0.6903, 0.1989, 0.0207),
    (0, 0, 11577, 1453, 0.0, 0.0, 0.0, 0.0), (553, 5542, 6035, 900, 0.0907, 0.3806, 0.1465, -0.0619),
]


def test_published_metrics_from_counts(spark):
    df = spark.createDataFrame([r[:4] for r in PUBLISHED], "tp bigint, fp bigint, tn bigint, fn bigint")
    got = {tuple(r[c] for c in M.COUNTS): r for r in C.with_metrics(df, round_dp=4).collect()}
    for row in PUBLISHED:
        r = got[row[:4]]
        assert (r["precision"], r["recall"], r["f1"], r["mcc"]) == row[4:]


def test_zero_denominators(spark):
    r = C.with_metrics(spark.createDataFrame([(0, 0, 0, 3)], "tp bigint, fp bigint, tn bigint, fn bigint")).first()
    assert (r["precision"], r["f1"], r["mcc"]) == (0.0, 0.0, 0.0) and r["specificity"] is None and r["fpr"] is None


def test_margins_do_not_overflow(spark):
    n = 3_000_000_000
    r = C.with_metrics(spark.createDataFrame([(n, n, n, n)], "tp bigint, fp bigint, tn bigint, fn bigint")).first()
    assert r["mcc"] == 0.0


def test_half_up_once(spark):
    df = spark.createDataFrame([(0.0005,), (0.12345,), (-0.0005,)], "x double")
    assert [r[0] for r in df.select(half_up_text(F.col("x"), 3)).collect()] == ["0.001", "0.123", "-0.001"]


def brute_ap(y, s):
    total, n_pos = 0.0, y.sum()
    prev = 0.0
    for t in sorted(set(s), reverse=True):
        on = s >= t
        tp = y[on].sum()
        total += (tp / n_pos - prev) * tp / on.sum()
        prev = tp / n_pos
    return total


def test_gate_follows_the_best_row(spark):
    t, p = frames(spark, [("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], [("a", 0.9, 0.4), ("a", 0.6, 0.01), ("b", 0.9, 0.4), ("b", 0.9, 0.01), ("c", 0.9, None)])
    for with_p in (False, True):
        calls = D.dense_calls(t, p, [D.Rule("m", 0.5, 0.05)], with_pvalue=with_p)
        assert {r["entity_id"]: r["call"] for r in calls.collect()} == {"a": 0, "b": 1, "c": 0}


@pytest.mark.parametrize("ranges", [1, 7, 256])
def test_average_precision_random(spark, ranges):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for m, scale in (("a", 1.0), ("b", 1e6), ("hot", 1e-9)):
        y = (rng.random(300) < 0.3).astype(int)
        s = np.round(rng.random(300), 2) * scale if m != "hot" else np.where(rng.random(300) < 0.5, 0.0, rng.random(300) * scale)
        want[m] = brute_ap(y, s)
        rows += [(m, int(a), float(b)) for a, b in zip(y, s)]
    df = spark.createDataFrame(rows, "model string, label int, score double")
    got = {r["model"]: r["auprc"] for r in V.average_precision(df, ranges=ranges).collect()}
    for m in want:
        assert got[m] == pytest.approx(want[m], abs=1e-12)


def test_best_threshold_default_wins_ties(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(200) < 0.4).astype(int)
    s = np.round(np.clip(y * 0.2 + rng.random(200) * 0.8, 0, 1), 2)
    p = np.round(rng.random(200) * 0.1, 3)
    t, pr = frames(spark, [(str(i), int(v), "x") for i, v in enumerate(y)], [(str(i), float(a), float(b)) for i, (a, b) in enumerate(zip(s, p))])
    grid = D.dense_calls(t, pr, [D.Rule("m", 0.5, 0.05)])

    def mcc(thr):
        c = (s >= thr) & (p < 0.05)
        tp, fp, tn, fn = ((c & (y == 1)).sum(), (c & (y == 0)).sum(), (~c & (y == 0)).sum(), (~c & (y == 1)).sum())
        den = math.sqrt(float(tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        return round((tp * tn - fp * fn) / den, 4) if den else 0.0

    best_t, best = 0.5, mcc(0.5)
    for thr in sorted({0.0, 1.0, *s}):
        if mcc(thr) > best:
            best_t, best = thr, mcc(thr)
    base = C.confusion(grid, ("model", "threshold")).select("model", F.col("threshold").alias("default_threshold"), M.mcc().alias("default_mcc"))
    r = V.best_threshold(grid, base).first()
    assert (r["best_threshold"], r["best_mcc"]) == (best_t, best)
    # A model nothing can improve keeps its default.
    perfect = spark.createDataFrame([("m", 1, 0.9, None, 0.5, None, True), ("m", 0, 0.1, None, 0.5, None, True)],
                                    "model string, label int, score double, pvalue double, threshold double, pvalue_below double, emitted boolean")
    base = spark.createDataFrame([("m", 0.5, 1.0)], "model string, default_threshold double, default_mcc double")
    r = V.best_threshold(perfect, base).first()
    assert (r["best_threshold"], r["delta_mcc"]) == (0.5, 0.0)


def test_dense_grid_merges_duplicates_by_maximum(spark):
    t, p = frames(spark, [("a", 1, "x")], [("a", 0.2, 0.5), ("a", 0.9, 0.4), ("a", 0.9, 0.01)])
    r = D.dense_grid(t, p, [D.Rule("m")], with_pvalue=True).first()
    assert (r["score"], r["pvalue"], r["emitted"]) == (0.9, 0.01, True)


def test_concordance_leaves_out_ambiguous(spark):
    rows = [("m", 1, "positive"), ("m", 1, "absent"), ("m", 0, "positive"), ("m", 0, "absent"), ("m", 1, "ambiguous"), ("z", 0, "absent")]
    got = {r["model"]: r for r in C.concordance(spark.createDataFrame(rows, "model string, call int, status string"), ["model"]).collect()}
    assert tuple(got["m"][c] for c in "abde") == (1, 1, 1, 1)
    assert got["m"]["enrichment"] == 1.0 and got["z"]["recall"] is None and got["z"]["enrichment"] is None
