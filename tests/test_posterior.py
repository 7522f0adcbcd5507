"""Posteriors of a mixture: values against plain arithmetic, and each logarithm taken once."""

import math

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import labelling as L

PARAMS = [(0.6, -1.9, 0.45), (0.35, -0.2, 0.5), (0.05, 2.1, 1.2)]


def plain(x):
    logs = [math.log(w / s) - (x - m) * (x - m) / (s * s * 2.0) for w, m, s in PARAMS]
    exps = [math.exp(v - max(logs)) for v in logs]
    return [e / sum(exps) for e in exps]


def test_posterior_is_derived_step_by_step(spark):
    ratios = [0.0, 1e-3, 0.02, 0.5, 1.0, 3.0, 40.0, 1e4, math.inf, math.nan, -1.0, None]
    rows = [(i, r, "Low-quality", 0, 0, "No", False, "Bacteria") for i, r in enumerate(ratios)]
    df = spark.createDataFrame(rows, "id int, ratio double, quality string, viral_genes int, host_genes int, provirus string, classified boolean, domain string")
    fit = spark.createDataFrame([tuple(map(list, zip(*PARAMS)))], "weight array<double>, mean array<double>, sd array<double>")
    df = df.withColumn("_fit", fit.select(F.struct("weight", "mean", "sd")).scalar())
    params = [tuple(F.col(f"_fit.{c}")[i] for c in ("weight", "mean", "sd")) for i in range(3)]
    out = L.mixture_label(df, params, p_high=0.9, p_middle=0.6).drop("_fit")
    assert out.columns == [*df.drop("_fit").columns, "p_high", "p_middle", "mixture_label"]
    for r in out.collect():
        x = r["ratio"]
        if x is None or math.isnan(x) or x < 0:
            assert r["p_high"] is None and r["p_middle"] is None and r["mixture_label"] == "excluded"
            continue
        _, mid, high = (1.0, 0.0, 0.0) if x == 0 else (0.0, 0.0, 1.0) if x == math.inf else plain(math.log10(x))
        assert (r["p_high"], r["p_middle"]) == pytest.approx((high, mid), rel=1e-12)
        assert r["mixture_label"] == ("dark_matter" if high > 0.9 else "TN" if mid > 0.6 else "excluded")
    plan = out.select("id", "mixture_label")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("log10(") == 1 and plan.count("exp(") == 3, plan
