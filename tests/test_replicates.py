"""Replicate vectors against entity-by-entity computation."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from scoreloom.operators import replicates as R


def residues(seed, *parts):
    h = hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()
    return int(h[:8], 16) % R.PRIME, int(h[8:16], 16) % R.PRIME


def weight(seed, e, b, block=None):
    """Plain integers, one entity and replicate."""
    r = int(hashlib.md5(f"{seed}|b|{b}".encode()).hexdigest()[:8], 16) % R.PRIME

    def u(*parts):
        a, c = residues(seed, *parts)
        return pow(a + c * r, 5, R.PRIME)

    k = 1 if block is None else sum(u("block", block) >= t for t in R.poisson_steps(1.0))
    return sum(u(e) >= t for t in (R.poisson_steps(float(k)) if k else []))


def plain_auprc(rows):
    """rows: (score, label, weight)."""
    total = defaultdict(lambda: [0, 0])
    for s, y, w in rows:
        total[s][0 if y else 1] += w
    some = {s: v for s, v in total.items() if sum(v)}
    n_pos = sum(v[0] for v in some.values())
    if len(some) <= 1:
        return None
    if not n_pos:
        return 0.0
    p = n = area = 0
    for s in sorted(some, reverse=True):
        p, n = p + some[s][0], n + some[s][1]
        area += some[s][0] * p / (p + n)
    return area / n_pos


def scored_rows(seed, n=400):
    r = random.Random(seed)
    rows = []
    for e in range(n):
        y = int(r.random() < 0.3)
        block = "hot" if r.random() < 0.4 else f"b{r.randrange(5)}"
        rows += [(e, "tied", y, block, float(r.choice([0.0, 0.0, 0.0, 0.5, 1.0]))), (e, "fine", y, block, r.random() + 0.2 * y), (e, "same", y, block, 0.5), (e, "none", 0, block, r.random())]
    return rows


@pytest.mark.parametrize("chunk", [7, 150, 1 << 16])
def test_auprc_replicates(spark, chunk):
    rows = scored_rows(1)
    df = spark.createDataFrame(rows, "entity_id long, model string, label int, block string, score double").repartition(5)
    b_of = 13
    got = {(x["mode"], x["model"], x["b"]): x["auprc"] for x in R.auprc_replicates(df, "model", "entity_id", b_of, 5, modes=R.MODES, block="block", chunk=chunk).collect()}
    assert len(got) == 2 * 4 * b_of
    for mode in R.MODES:
        for b in range(b_of):
            w = {(e, blk): weight(5, e, b, blk if mode == "nested" else None) for e, _, _, blk, _ in rows}
            for model in ("tied", "fine", "same", "none"):
                want = plain_auprc([(s, y, w[e, blk]) for e, m, y, blk, s in rows if m == model])
                have = got[mode, model, b]
                assert have is None and want is None or have == pytest.approx(want, abs=1e-12), (mode, model, b)


def test_non_finite_scores_have_no_replicates(spark):
    df = spark.createDataFrame([(1, "x", 1, 0.5), (2, "x", 0, float("nan")), (1, "y", 1, 0.5), (2, "y", 0, 0.1)], "entity_id long, model string, label int, score double")
    assert {x["model"] for x in R.auprc_replicates(df, "model", "entity_id", 5, 1).collect()} == {"y"}


@pytest.mark.parametrize("mode", R.MODES)
def test_cell_replicates(spark, mode):
    rows = [(e, y, blk, "01"[e % 2] + "1") for e, m, y, blk, _ in scored_rows(2) if m == "fine"]
    df = spark.createDataFrame(rows, "entity_id long, label int, block string, pattern string").repartition(4)
    got = {(x["label"], x["pattern"], x["b"]): x["w"] for x in R.cell_replicates(df, ["label", "pattern"], "entity_id", 20, 9, mode=mode, block="block").collect()}
    want = defaultdict(int)
    for e, y, blk, pattern in rows:
        for b in range(20):
            want[y, pattern, b] += weight(9, e, b, blk if mode == "nested" else None)
    assert got == {k: v for k, v in want.items() if v}


def test_weights_are_poisson():
    rng = np.random.default_rng(0)
    a, c = rng.integers(0, R.PRIME, (2, 2000))
    w = R.plain_weights(R.uniforms(a, c, R.replicate_numbers(3, 500)))
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.003)
    per = np.corrcoef(w[:60])
    assert np.abs(per - np.eye(60)).max() < 0.25 and w.sum(axis=0).std() == pytest.approx(2000**0.5, rel=0.12)


@pytest.mark.parametrize("n_pos", [0, 20, 200])
def test_subsample_without_replacement(spark, n_pos):
    rows = [(i, int(i < n_pos), "01"[i % 2]) for i in range(500)]
    df = spark.createDataFrame(rows, "entity_id long, label int, pattern string").repartition(4)
    got = {(x["label"], x["pattern"], x["ratio"], x["rep"]): x["w"] for x in R.subsampled_cells(df, ["label", "pattern"], "entity_id", (1, 2, 4), 7, 3).collect()}
    want = defaultdict(int)
    for rep in range(7):
        r = int(hashlib.md5(f"3|b|{rep}".encode()).hexdigest()[:8], 16) % R.PRIME
        order = sorted((pow(a + c * r, 5, R.PRIME), a, c, p) for e, y, p in rows if not y for a, c in [residues(3, e)])
        for ratio in (1, 2, 4):
            for *_, p in order[: ratio * n_pos]:
                want[0, p, ratio, rep] += 1
            for e, y, p in rows:
                want[1, p, ratio, rep] += y
    assert got == {k: v for k, v in want.items() if v}


def test_lookups_at_every_step_and_residues_near_the_prime():
    at = np.array([t + d for s in R.STEPS for t in s for d in (-1, 0, 1) if 0 <= t + d < R.PRIME] + [0, R.PRIME - 1], np.int32)[None, :]
    for k, steps in enumerate(R.STEPS):
        assert (R.nested_weights(at, np.full(at.shape, k, np.uint8))[0] == [sum(u >= t for t in steps) for u in at[0].tolist()]).all()
    a, c = np.array([0, 0, 1, R.PRIME - 1, R.PRIME - 1]), np.array([0, 1, R.PRIME - 1, 0, R.PRIME - 1])
    r = np.array([0, 1, 2, R.PRIME - 1, R.PRIME - 2])
    assert R.uniforms(a, c, r).tolist() == [[pow(int(x) + int(y) * int(z), 5, R.PRIME) for z in r] for x, y in zip(a, c, strict=True)]


def test_weights_of_a_block_are_made_once(monkeypatch):
    made = []
    real = R.uniforms
    monkeypatch.setattr(R, "uniforms", lambda a, c, r: made.append(len(a)) or real(a, c, r))
    r, known = R.replicate_numbers(1, 50), {}
    u = real(np.arange(8), np.arange(8), r)
    first = R.weights("nested", u, np.array([5, 5, 6, 6, 5, 6, 5, 5]), np.array([1, 1, 2, 2, 1, 2, 1, 1]), r, known)
    again = R.weights("nested", u, np.array([5, 5, 6, 6, 5, 6, 5, 5]), np.array([1, 1, 2, 2, 1, 2, 1, 1]), r, known)
    assert made == [2] and (first == again).all()


def test_class_ratios_read_the_predictions_once(spark, monkeypatch):
    from scoreloom.catalog import resampling

    read = spark.sparkContext.accumulator(0)
    real = resampling.calls

    def counted(s, d):
        df = real(s, d)

        def count(batches):
            for b in batches:
                read.add(b.num_rows)
                yield b

        return df.mapInArrow(count, df.schema)

    monkeypatch.setattr(resampling, "calls", counted)
    d = "/root/testdata/sf0.001"
    resampling.class_ratio_subsampling(spark, d).collect()
    assert read.value == real(spark, d).count()
