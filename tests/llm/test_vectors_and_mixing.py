"""Embeddings, mixing, components and the pipeline against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoreloom.llm import mixing, vectors
from scoreloom.llm.graph import components

from .conftest import prose

SF = "/root/testdata/sf0.001"


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(150)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {(x.v, x.c) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(v, root(v)) for v in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------------


def brute_vectors(rows, limit):
    ok = [v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    up, n = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit:
                n[i], n[j] = n[i] + 1, n[j] + 1
                up[root(i)] = root(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return Counter((k, n[i], None if k is None else least[root(i)], k is None or least[root(i)] == k) for i, (k, _, _) in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)], int(i % 2)) for i in range(120)]
    for c in range(3):
        centre = rng.normal(size=16)
        rows += [(1000 + 100 * c + i, [float(np.float32(x)) for x in centre + rng.normal(size=16) * 0.15 * (1 + c)], 1) for i in range(50)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(40)] + [(2100, [2 * x for x in rows[0][1]], 0), (2101, rows[0][1], 1), (2102, rows[0][1], None)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, [None] * 16, 0), (3004, [], 0), (3005, rows[0][1][:8], 0), (3006, rows[0][1][:8], 0), (3, rows[3][1], 1), (3007, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, key string, vec string")
    got = Counter(tuple(r) for r in vectors.near_vectors(df, how=vectors.Descent(block=block, leaf=32)).collect())
    assert got == brute_vectors(rows, 0.93)


def test_no_link_below_the_threshold(spark):
    def turned(c):
        return [c, (1 - c * c) ** 0.5, 0.0]

    rows = [(1, [1.0, 0.0, 0.0], "a"), (2, turned(0.929999995), "a"), (3, [1.0, 0.0, 0.0], "b"), (4, turned(0.930000005), "b")]
    out = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert [(out[i].n_links, out[i].component_id, out[i].kept) for i in (1, 2, 3, 4)] == [(0, 1, True), (0, 2, True), (1, 3, True), (1, 3, False)]


def test_embeddings_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_descent_finds_neighbours_that_leaves_missed(spark):
    """With a single tree of small leaves most pairs are cut apart; rounds of descent join them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 12))
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(size=12) * 0.08], 0) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    how = vectors.Descent(trees=1, leaf=24, rounds=3, audit=600, recall=0.95)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(df, how=how).collect()}
    want = {k: n for (k, n, _, _) in brute_vectors(rows, 0.93)}
    assert sum(min(got[k], want[k]) for k in want) >= 0.95 * sum(want.values()) and all(got[k] <= want[k] for k in want)


def apart(rng, centre, away):
    """A unit vector whose cosine with ``centre`` is ``away``."""
    u = centre / np.linalg.norm(centre)
    w = rng.normal(size=len(u))
    w -= (w @ u) * u
    return away * u + np.sqrt(1 - away**2) * w / np.linalg.norm(w)


@pytest.mark.parametrize("block", [1024, 16])
def test_saturated_lists_lose_no_neighbouring_group(spark, block):
    """Two tight groups, each larger than a list, 0.95 apart: every list is full of its own group."""
    rng = np.random.default_rng(8)
    one = rng.normal(size=16)
    two = apart(rng, one, 0.95)
    rows = [(1000 * g + i, [float(x) for x in apart(rng, c, 0.9995)], 0) for g, c in enumerate((one, two)) for i in range(60)]
    rows += [(5000 + i, [float(x) for x in rng.normal(size=16)], i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(tuple(r) for r in vectors.near_vectors(df, how=vectors.Descent(block=block, recall=0.0)).collect())
    assert got == brute_vectors(rows, 0.93)


def test_one_group_does_not_hide_lost_pairs(spark):
    """The links of one tight group outnumber those of isolated pairs, which one tree of small leaves mostly misses."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in apart(rng, centre, 0.9995)], 0) for i in range(80)]
    for i in range(100):
        v = rng.normal(size=16)
        rows += [(1000 + 2 * i, [float(x) for x in v], 0), (1001 + 2 * i, [float(x) for x in apart(rng, v, 0.94)], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    how = vectors.Descent(trees=1, leaf=8, neighbours=2, rounds=1, still=1.0, tries=1)
    got = Counter(tuple(r) for r in vectors.near_vectors(df, how=how).collect())
    assert got == brute_vectors(rows, 0.93)


def test_recall_without_sampled_links_is_unknown(spark):
    sizes = spark.createDataFrame([(0, 2, 9), (1, 2, 9), (2, 2, 3)], "label int, dim int, n long")
    truth = spark.createDataFrame([(1, 0, 2, 80, True), (2, 0, 2, 1, True), (3, 0, 2, 1, True), (4, 1, 2, 5, False), (5, 2, 2, 0, False)], "key long, label int, dim int, true long, linked boolean")
    per = spark.createDataFrame([(1, 80, True), (2, 1, False), (3, 0, False), (4, 5, False), (5, 0, False)], "key long, links long, crowded boolean")
    got = {r.label: r.recall for r in vectors.verdicts(truth, sizes, per, 4).collect()}
    assert got == {0: 0.5, 1: None, 2: 1.0}


# --- mixing ------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while True:
        rest, weight = total - sum(out.values()), sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / weight > most * sizes[s] + 1e-9}
        if not over:
            return {**out, **{s: rest * w[s] / weight for s in open_}}
        out |= {s: most * sizes[s] for s in over}
        open_ -= over


def test_mixing(docs, odd_texts):
    r = random.Random(9)
    rows = [(i, prose(i, r.randint(0, 400)), "en", r.choice(["a", "a", "a", "B", "é", "tiny" if i < 3 else "z", None])) for i in range(300)]
    rows += [(900, prose(1, 20), "en", "rare"), (901, "", "en", "none"), *odd_texts[:8], (10, None, "en", "rare")]
    how = mixing.Mix(block=16, shard_slots=64, bucket_rows=32)
    got = mixing.mix_sizes(docs(rows), how=how).collect()
    assert Counter(tuple(x) for x in got) == Counter(tuple(x) for x in mixing.mix_sizes(docs(rows).repartition(5), how=how).collect())
    sizes = Counter()
    for x in rows:
        sizes[x[3] if len(x) > 3 else "s"] += len((x[1] or "").split())
    source = {}
    for x in rows:
        source.setdefault((x[0], len((x[1] or "").split())), x[3] if len(x) > 3 else "s")
    want = brute_targets(sizes)
    taken = Counter()
    for x in got:
        s = source[(x.doc_id, x["size"])]
        assert x.source_size == sizes[s] and x.target == pytest.approx(want[s]) and 0 <= x.taken <= 3 * x["size"]
        taken[s] += x.taken
    assert all(abs(taken[s] - want[s]) <= how.block for s in want)
    assert mixing.mix_sizes(docs([])).count() == 0


def test_mixed_texts_hold_the_taken_words(docs):
    r = random.Random(4)
    rows = [(i, prose(i, r.randint(1, 300)), "en", r.choice("abc")) for i in range(120)] + [(500, prose(500, 100), "en", "a")] * 3 + [(501, None, "en", "a"), (502, " \n", "en", None)]
    how = mixing.Mix(block=32, shard_slots=16, bucket_rows=16)
    out = mixing.mix(docs(rows), how=how)
    assert out.columns == docs([]).columns and out.filter("n_chars <> length(text)").count() == 0
    words = Counter()
    for x in out.collect():
        words[x.doc_id] += len(x.text.split())
    want = Counter()
    for x in mixing.mix_sizes(docs(rows), how=how).collect():
        want[x.doc_id] += x.taken
    assert +words == +want
    assert mixing.mix(docs([]), how=how).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    x = np.arange(n)
    seen = [mixing.permute(x, np.full(n, n), np.full(n, k, np.uint64)) for k in (1, 2)]
    assert all(sorted(p.tolist()) == x.tolist() for p in seen)
    assert n < 7 or (seen[0] != seen[1]).any()


def test_slots_take_each_block_once_a_pass(docs, spark):
    how = mixing.Mix(block=8, shard_slots=32)
    sizes = spark.createDataFrame([("a", 1000), ("b", 5000), ("c", 30)], "source string, size long")
    src = mixing.plan(mixing.targets(sizes, how), how)
    slots = mixing.slot_blocks(src, how).collect()
    for s in src.collect():
        own = [x for x in slots if x._s == s._s]
        assert sorted(x.slot for x in own) == list(range(s.slots))
        per = Counter((x.slot // s.blocks, x["index"]) for x in own)
        assert max(per.values()) == 1
    shards = Counter(x.shard for x in slots)
    assert len(shards) > 10 and max(shards.values()) <= 2 * how.shard_slots


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    from scoreloom.llm import lines, minhash, quality
    from scoreloom.sources.scratch import settle

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "source_mixing", "sentencepiece"]
    steps = dict(corpus_pipeline.STAGES)
    good = settle(steps["quality_rules"](spark, docs, SF))
    verdict = {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    assert good.columns == names and {r.doc_id for r in good.collect()} == verdict
    cut = settle(steps["line_dedup"](spark, good, SF))
    digest = {r.doc_id: r.kept_sha256 for r in lines.line_digest(good).collect()}
    assert {r.doc_id: r.h for r in cut.select("doc_id", F.sha2("text", 256).alias("h")).collect()} == digest
    one = settle(steps["minhash_near_dedup"](spark, cut, SF))
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in minhash.near_duplicates(cut).filter("kept").collect()}
    mixed = settle(steps["source_mixing"](spark, one, SF))
    assert mixed.columns == names
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.encode().split())
    want = {r.doc_id: r.taken for r in mixing.mix_sizes(one).filter("taken > 0").collect()}
    assert +words == want
    last = steps["sentencepiece"](spark, mixed, SF)
    assert last.count() == mixed.count() and last.filter("n_ids <= 0").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()


def test_pipeline_on_odd_rows(spark, docs, odd_texts):
    df = docs([*odd_texts, *[(100 + i, prose(i, 100)) for i in range(20)]])
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.count() > 0
    df = docs([])
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.count() == 0
