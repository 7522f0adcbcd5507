"""Tiling and unions against a greedy loop, including one pair with most of the hits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import intervals as I
from scoreloom.operators import labelling as L

COLS = "qseqid string, sseqid string, pident double, qstart bigint, qend bigint, sstart bigint, send bigint, evalue double, bitscore double, qlen bigint, slen bigint, line_no bigint"


def test_self_test_cases(spark):
    rows = [
        ("Q", "S1", 100.0, 1, 100, 1, 100, 1e-9, 200.0, 200, 1000, 1), ("Q", "S1", 90.0, 51, 150, 51, 150, 1e-8, 150.0, 200, 1000, 2),
        ("Q", "S2", 70.0, 1, 80, 1, 80, 1e-3, 60.0, 200, 500, 3), ("Q2", "S", 100.0, 1, 200, 1, 200, 0.0, 400.0, 200, 250, 4),
        ("Q2", "S", 88.0, 40, 120, 40, 120, 0.1, 120.0, 200, 250, 5),
    ]
    t = I.tile_hits(spark.createDataFrame(rows, COLS), deep=1)
    got = {(r["qseqid"], r["sseqid"]): r for r in t.collect()}
    a = got["Q", "S1"]
    assert (a["covered_q"], a["q_af"], a["covered_s"]) == (150, 75.0, 150)
    assert a["weighted_identity"] == pytest.approx(14500 / 150) and a["identical_bases"] == pytest.approx(145)
    b = got["Q2", "S"]
    assert (b["covered_q"], b["q_af"], b["af_shorter"], b["n_accepted"], b["total_bitscore"]) == (200, 100.0, 100.0, 1, 400.0)
    assert {r["qseqid"]: r["sseqid"] for r in I.best_subject(t).collect()} == {"Q": "S1", "Q2": "S"}


def greedy(hits):
    owned, acc = {}, []
    for h in sorted(hits, key=lambda h: (-h[8], h[11])):
        new = [p for p in range(min(h[3], h[4]), max(h[3], h[4]) + 1) if p not in owned]
        if new:
            acc.append(h)
            owned.update({p: h[2] for p in new})
    subj = {p for h in acc for p in range(min(h[5], h[6]), max(h[5], h[6]) + 1)}
    return len(owned), len(subj), sum(owned.values()) / len(owned), sum(h[8] for h in acc), min(h[7] for h in acc), len(acc)


@pytest.mark.parametrize("deep", [2, 30, 10_000])
def test_tiling_equals_greedy_on_skewed_pairs(spark, deep):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        hot = rng.random() < 0.7
        a, n = int(rng.integers(1, 400)), int(rng.integers(1, 120))
        s = int(rng.integers(1, 300))
        qs, qe = (a, a + n) if rng.random() < 0.8 else (a + n, a)
        ss, se = (s, s + n) if rng.random() < 0.5 else (s + n, s)
        rows.append(("q" if hot else f"q{i % 7}", "s" if hot else f"s{i % 3}", float(rng.integers(70, 101)), qs, qe, ss, se, float(rng.random()), float(rng.integers(1, 60)), 1000, 900, i))
    got = {(r["qseqid"], r["sseqid"]): r for r in I.tile_hits(spark.createDataFrame(rows, COLS), deep=deep, width=50).collect()}
    pairs = {}
    for r in rows:
        pairs.setdefault(r[:2], []).append(r)
    assert set(got) == set(pairs)
    for k, hs in pairs.items():
        cq, cs, ident, bits, ev, n = greedy(hs)
        g = got[k]
        assert (g["covered_q"], g["covered_s"], g["n_accepted"], g["best_evalue"]) == (cq, cs, n, ev)
        assert g["weighted_identity"] == pytest.approx(ident) and g["total_bitscore"] == pytest.approx(bits)


def test_a_long_hit_over_many_short_ones(spark):
    rows = [("q", "s", 80.0, 1, 100_000, 1, 100_000, 0.1, 30.0, 100_000, 100_000, 0)]
    rows += [("q", "s", 90.0, 40 * i + 1, 40 * i + 20, 40 * i + 1, 40 * i + 20, 0.1, 50.0 if i % 2 else 10.0, 100_000, 100_000, i + 1) for i in range(2000)]
    r = I.tile_hits(spark.createDataFrame(rows, COLS)).first()
    assert (r["covered_q"], r["covered_s"], r["n_accepted"]) == (100_000, 100_000, 1001)
    assert r["weighted_identity"] == pytest.approx((20_000 * 90 + 80_000 * 80) / 100_000)


@pytest.mark.parametrize("width", [5, 50])
def test_union_length(spark, width):
    rng = np.random.default_rng(2)
    rows = [("hot" if rng.random() < 0.8 else "b", int(a), int(a + n)) for a, n in zip(rng.integers(1, 500, 300), rng.integers(0, 60, 300))]
    want = {}
    for k, a, b in rows:
        want.setdefault(k, set()).update(range(a, b + 1))
    got = {r["k"]: r["covered"] for r in I.union_length(spark.createDataFrame(rows, "k string, a bigint, b bigint"), ["k"], F.col("a"), F.col("b"), width=width).collect()}
    assert got == {k: len(v) for k, v in want.items()}


def test_summed_estimator_can_exceed_100(spark):
    rows = [("q", "s1", 90.0, 1, 100, 1, 100, 0.1, 1.0, 100, 100, 1), ("q", "s2", 100.0, 1, 100, 1, 100, 0.2, 1.0, 100, 100, 2)]
    df = spark.createDataFrame(rows, COLS).withColumn("length", F.lit(100))
    r = I.summed_identity(df).first()
    assert (r["ani"], r["aligned_frac"], r["last_subject"], r["evalue"]) == (95.0, 200.0, "s2", 0.1)


def test_spacer_evidence_rules(spark):
    rows = [("sp1", "A", "A", 100.0, 30, 30, 1), ("sp1", "A", "B", 96.0, 30, 30, 2), ("sp1", "A", "C", 94.0, 30, 30, 3),
            ("short", "A", "B", 100.0, 20, 20, 4), ("sp2", "D", "B", 96.0, 30, 30, 5)] + [("many", "Z", f"T{i}", 99.0, 30, 30, 10 + i) for i in range(4)]
    df = spark.createDataFrame(rows, "spacer_id string, source string, target string, pident double, length bigint, qlen bigint, line_no int")
    got = {r["target"]: r["spacer_id"] for r in L.spacer_evidence(df, max_hits=3).collect()}
    assert got == {"B": "sp1"}


@pytest.mark.parametrize("text, size, least", [("A" * 20, 8, 3), ("ACGTACGTAC", 4, 2), ("ACG", 4, 2), ("A", 4, 2), ("ACGTACGTACG", 4, 4)])
def test_windows_and_fragments_against_a_loop(spark, text, size, least):
    from scoreloom.operators import sequences as Q

    df = spark.createDataFrame([("s", text)], "id string, seq string")
    want = []
    if len(text) >= least:
        want = [(0, text)] if len(text) <= size else [(i, text[i:i + size]) for i in range(0, len(text) - least + 1, size // 2)]
    assert sorted((r["start"], r["fragment"]) for r in Q.windows(df, size, least).collect()) == want
    frags = sorted((r["fragment_length"], r["i"], r["fragment"]) for r in Q.fragments(df, (3, 4)).collect())
    assert frags == sorted((n, i + 1, text[i * n:(i + 1) * n]) for n in (3, 4) for i in range(len(text) // n))


def _rows_of_nodes(plan):
    """Rows that the operators of an executed plan gave out."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from _rows_of_nodes(plan.executedPlan())
        return
    if name.endswith("QueryStage"):
        yield from _rows_of_nodes(plan.plan())
        return
    n = plan.metrics().get("numOutputRows")
    if n.isDefined():
        yield n.get().value()
    for i in range(plan.children().size()):
        yield from _rows_of_nodes(plan.children().apply(i))


def test_overlaps_are_not_listed_one_by_one(spark):
    # 1,500 nested hits: every one overlaps all others.
    n = 1500
    rows = [("q", "s", i, n - i, n + i) for i in range(n)]
    df = spark.createDataFrame(rows, "qseqid string, sseqid string, k int, _lo long, _hi long")
    out = I.owned_segments(df, ["qseqid", "sseqid"], ["k"], deep=10_000)
    got = {r["k"]: r["bases"] for r in out.collect()}
    assert got == {0: 1} | {i: 2 for i in range(1, n)}
    assert max(_rows_of_nodes(out._jdf.queryExecution().executedPlan())) <= 20 * n


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_slots_spread_over_batches(spark, batch):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 4)), i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-300, 300, 400), rng.integers(0, 90, 400)))]
    want = {}
    for q in range(4):
        taken = set()
        for r in (x for x in rows if x[0] == q):
            new = set(range(r[2], r[3] + 1)) - taken
            taken |= new
            if new:
                want[q, r[1]] = len(new)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([*rows, (None, 900, 1, 5), (1, 901, None, 5)], "q int, k int, _lo long, _hi long")
        for deep in (8, 1024):
            assert {(r["q"], r["k"]): r["bases"] for r in I.owned_segments(df, ["q"], ["k"], deep=deep).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
