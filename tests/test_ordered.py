"""Distributed order operators against brute force, with one group holding most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import ordered as O
from scoreloom.operators import quality as QC
from scoreloom.operators import selection as SEL


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if rng.random() < 0.8 else f"g{int(rng.integers(5))}", float(np.round(rng.normal(), 2)), int(rng.integers(1, 5)), i) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "g string, v double, n bigint, i bigint")


@pytest.mark.parametrize("ranges", [1, 5, 64])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, skewed, ranges, descending):
    rows, df = skewed
    agg = df.groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = {(r["g"], r["v"]): r["cum_n"] for r in O.running_totals(agg, ["g"], "v", ["n"], descending=descending, ranges=ranges).collect()}
    for (g, v), c in got.items():
        want = sum(n for h, w, n, _ in rows if h == g and (w >= v if descending else w <= v))
        assert c == want


def test_dense_index_is_a_permutation(spark, skewed):
    _, df = skewed
    got = sorted(r["idx"] for r in O.dense_index(df.select("i"), ["i"]).collect())
    assert got == list(range(2000))
    counts = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    for r in O.dense_index(df.drop("n"), ["i"], group=["g"]).groupBy("g").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count_distinct("idx").alias("k"), F.max("n").alias("n")).collect():
        assert (r["lo"], r["hi"] + 1, r["k"], r["n"]) == (0, counts[r["g"]], counts[r["g"]], counts[r["g"]])


def test_best_per_key_keeps_first_line_on_ties(spark):
    df = spark.createDataFrame([("a", 5.0, 3, "x"), ("a", 5.0, 1, "y"), ("a", 4.0, 0, "z"), ("b", None, 1, "n")], "k string, m double, line_no int, p string")
    assert [tuple(r) for r in O.best_per_key(df, ["k"], "m", ["line_no"]).collect()] == [("a", 5.0, 1, "y")]


@pytest.mark.parametrize("fn", [O.mid_ranks, O.mid_ranks_large])
def test_mid_ranks(spark, fn):
    df = spark.createDataFrame([("g", x) for x in (3.0, 1.0, 3.0, 2.0, 3.0)], "g string, v double")
    got = sorted((r["v"], r["mid_rank"]) for r in fn(df, "v", group=["g"]).collect())
    assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


def test_bh_reverse_minimum_and_missing(spark):
    p = [0.01, 0.04, 0.03, 0.5, float("nan"), None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "t int, p_value double")
    got = {r["t"]: r["p_adj"] for r in O.adjust_bh(df, tie=["t"]).collect()}
    assert got[0] == pytest.approx(0.04) and got[1] == got[2] == pytest.approx(4 * 0.04 / 3) and got[3] == 0.5
    assert got[4] is None and got[5] is None


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_carry_forward_over_blocks(spark, block):
    marks = {2: "A", 9: "B", 10: "C"}
    df = spark.createDataFrame([("f", i, marks.get(i)) for i in range(20)], "file string, line_no bigint, m string")
    got = {r["line_no"]: r["enclosing"] for r in O.carry_forward(df, "line_no", F.col("m").isNotNull(), F.col("m"), block=block).collect()}
    want, cur = {}, None
    for i in range(20):
        cur = marks.get(i, cur)
        want[i] = cur
    assert got == want


def test_top_k_wide_puts_nan_last(spark):
    df = spark.createDataFrame([("s", "a", float("nan")), ("s", "b", 0.2), ("s", "c", 0.9)], "s string, m string, v double")
    r = O.top_k_wide(df, ["s"], "v", F.col("m"), 3, "m").first()
    assert (r["rank_1"], r["rank_2"], r["rank_3"]) == ("c", "b", "a")


def test_pareto_front(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5), ("b", 2.0, 0.5), ("c", 3.0, 0.9), ("d", 3.0, 0.4), ("e", 9.0, 0.8)], "m string, t double, q double")
    assert sorted(r["m"] for r in O.pareto_front(df, "t", "q").collect()) == ["a", "c"]


def test_n50(spark):
    df = spark.createDataFrame([("x", n) for n in (10, 10, 20, 60)] + [("y", 7)], "g string, len bigint")
    assert {r["g"]: r["n50"] for r in O.n50(df, "len", group=["g"]).collect()} == {"x": 60, "y": 7}
    assert O.n50(df.filter("g = 'x'"), "len").first()["n50"] == 60


def test_quota_selection_equals_greedy_scan(spark):
    rng = np.random.default_rng(7)
    rows = [(f"c{i}", f"s{int(rng.integers(8))}", "hf" if rng.random() < 0.4 else "hd", int(rng.integers(100))) for i in range(60)]
    order = sorted(rows, key=lambda r: (-r[3], r[0]))
    used, want = set(), []
    for klass, quota in (("hf", 3), ("hd", 3)):
        k = 0
        for r in order:
            if k < quota and r[2] == klass and r[1] not in used:
                used.add(r[1]); want.append(r[0]); k += 1
    df = spark.createDataFrame(rows, "id string, sample string, klass string, len int")
    got = SEL.quota_selection(df, sample="sample", klass="klass", quotas=[("hf", 3), ("hd", 3)], order=[-F.col("len"), F.col("id")], id_prefix="p_")
    assert [r["id"] for r in got.orderBy("panel_no").collect()] == want
    assert got.orderBy("panel_no").first()["panel_id"] == "p_001"


def test_require_fails_the_job(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert QC.require(df, F.col("x") > 0, "bad").count() == 2
    with pytest.raises(Exception, match="negative"):
        QC.require(df, F.col("x") > 1, "negative").collect()


def test_running_totals_over_many_decades(spark):
    """Scores from 1e-300 to 1: no range may hold more than a few times its share."""
    rng = np.random.default_rng(2)
    x = np.unique(10.0 ** -rng.uniform(0, 300, 4000))
    df = spark.createDataFrame([("g", float(v), 1) for v in x], "g string, v double, n bigint")
    got = {r["v"]: r["cum_n"] for r in O.running_totals(df, ["g"], "v", ["n"], ranges=32).collect()}
    assert got == {float(v): len(x) - i for i, v in enumerate(x)}
    plain = {r["v"]: r["cum_n"] for r in O.running_totals(df.drop("g"), [], "v", ["n"], ranges=32, descending=False).collect()}
    assert plain == {float(v): i + 1 for i, v in enumerate(x)}


def test_scratch_uses_the_configured_folder(spark, tmp_path):
    from types import SimpleNamespace

    from scoreloom.sources.scratch import scratch_dir

    def session(setting, master="local[2]"):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting if key == "spark.checkpoint.dir" else default), sparkContext=sc)

    base = f"{tmp_path}/ckpt"
    path = scratch_dir(session(base + "/"))
    assert path.startswith(f"{base}/scoreloom-") and path != scratch_dir(session(base))
    assert scratch_dir(session(None)).startswith("/tmp/spark-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            scratch_dir(session(None, master))
