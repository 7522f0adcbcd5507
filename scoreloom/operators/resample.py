"""Bootstraps and permutations on additive counts.

Draw i of replicate b is ``hash(seed, b, i) mod n``: reproducible, independent of
partitioning, and stable when a lost task is rerun. Entities are aggregated to
counts per resampling unit before any replicate is made, so replicates multiply
units, never raw rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.functions.scalars import hashed_uniform, is_finite, ratio
from scoreloom.operators.ordered import dense_index
from scoreloom.sources.scratch import settle


def unit_weights(
    units: DataFrame, key: Sequence[str], replicates: int, seed: int, *, strata: Sequence[str] = (), name: str = "w"
) -> DataFrame:
    """Times each unit is drawn in each replicate (n draws with replacement).

    Columns: strata, key, b, w (drawn units only). Within ``strata`` every arm is
    drawn separately. Each unit contributes its own draw slot per replicate, so the
    draws are generated where the units already are.
    """
    idx = dense_index(units, key, group=strata)
    salt = [F.col(s) for s in strata]
    slots = idx.select(*strata, "n", "idx", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    draws = slots.select(*strata, "b", (hashed_uniform(seed, *salt, F.col("b"), F.col("idx")) % F.col("n")).alias("idx"))
    weights = draws.groupBy(*strata, "b", "idx").agg(F.count("*").alias(name))
    return weights.join(idx.select(*strata, "idx", *[k for k in key if k not in strata]), [*strata, "idx"]).drop("idx")


def block_replicates(
    counts: DataFrame, weights: DataFrame, block: Sequence[str], keys: Sequence[str] = ("model",)
) -> DataFrame:
    """Replicate confusion counts: sum of weight x count over blocks."""
    return (
        counts.join(weights, list(block))
        .groupBy(*keys, "b")
        .agg(*[F.sum(F.col("w") * F.col(c)).cast("bigint").alias(c) for c in M.COUNTS])
    )


def interval(
    reps: DataFrame, value: Column | str, keys: Sequence[str] = ("model",), *, level: float = 0.95, prefix: str = ""
) -> DataFrame:
    """Percentile interval and standard error over replicates, non-finite values dropped."""
    lo = round((1.0 - level) / 2.0, 12)
    v = F.col(value) if isinstance(value, str) else value
    vals = reps.withColumn("_v", v).filter(is_finite("_v"))
    q = F.percentile("_v", F.array(F.lit(lo), F.lit(1.0 - lo)))
    return vals.groupBy(*keys).agg(q.alias("_q"), F.stddev_samp("_v").alias(prefix + "se"), F.count("*").alias(prefix + "n_valid")).select(
        *keys, F.col("_q")[0].alias(prefix + "lo"), F.col("_q")[1].alias(prefix + "hi"), prefix + "se", prefix + "n_valid"
    )


def paired_difference(
    reps: DataFrame, metric: str = "mcc", *, model: str = "model", keys: Sequence[str] = ()
) -> DataFrame:
    """Metric difference for every model pair (a < b) inside the same replicate.

    Replicate rows of all models are gathered per replicate (a models-sized array)
    and expanded to pairs, which avoids shuffling both sides of a self-join.
    """
    rows = reps.groupBy(*keys, "b").agg(F.sort_array(F.collect_list(F.struct(F.col(model).alias("m"), F.col(metric).alias("v")))).alias("_r"))
    pairs = F.expr(
        "flatten(transform(_r, (x, i) -> transform(slice(_r, i + 2, greatest(size(_r) - i - 1, 0)),"
        " y -> named_struct('model_a', x.m, 'model_b', y.m, 'diff', x.v - y.v))))"
    )
    return rows.select(*keys, "b", F.inline(pairs))


def entity_patterns(calls: DataFrame, models: Sequence[str], *, entity: str = "entity_id", extra: Sequence[str] = ()) -> DataFrame:
    """One row per entity: label, ``extra`` and the calls of all models as a pattern."""
    bits = [F.max(F.when(F.col("model") == m, F.col("call"))).alias(f"_c{i}") for i, m in enumerate(models)]
    wide = calls.groupBy(entity, "label", *extra).agg(*bits)
    text = F.concat(*[F.coalesce(F.col(f"_c{i}"), F.lit(0)).cast("string") for i in range(len(models))])
    return wide.select(entity, "label", *extra, text.alias("pattern"))


def outcome_patterns(calls: DataFrame, models: Sequence[str], *, entity: str = "entity_id", extra: Sequence[str] = ()) -> DataFrame:
    """Entities collapsed to (label, calls of all models) patterns with their count.

    Count metrics depend on an entity only through its pattern, so resampling
    entities equals resampling patterns with these multiplicities.
    """
    return entity_patterns(calls, models, entity=entity, extra=extra).groupBy("label", *extra, "pattern").agg(F.count("*").alias("n_entities"))


def pattern_counts(patterns: DataFrame, models: Sequence[str], weight: str, keys: Sequence[str] = ("b",)) -> DataFrame:
    """Weighted confusion counts per model from pattern weights."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model"), F.substring("pattern", i + 1, 1).cast("int").alias("call")) for i, m in enumerate(models)])
    )
    long = patterns.select(*keys, "label", F.col(weight).alias("_w"), cells.alias("c")).select(*keys, "label", "_w", "c.model", "c.call")
    y, p = F.col("label") == 1, F.col("call") == 1
    pick = lambda cond: F.sum(F.when(cond, F.col("_w")).otherwise(0)).cast("bigint")
    return long.groupBy("model", *keys).agg(
        pick(y & p).alias("tp"), pick(~y & p).alias("fp"), pick(~y & ~p).alias("tn"), pick(y & ~p).alias("fn")
    )


def _cells(patterns: DataFrame) -> list[tuple[int, str, int]]:
    """The patterns as one list in fixed order: with m models there are at most 2**(m+1), however many entities."""
    return [(r.label, r.pattern, r.n_entities) for r in patterns.select("label", "pattern", "n_entities").orderBy("label", "pattern").toLocalIterator()]


def multinomial_pattern_weights(patterns: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Pattern weights of an entity bootstrap in O(patterns) per replicate.

    The counts of a bootstrap sample over patterns are multinomial; each replicate is one draw, generated from its
    own seeded stream inside a task. The cost does not depend on the number of entities.
    """
    cells = _cells(patterns)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        label, pattern, n = np.array([c[0] for c in cells], "int32"), np.array([c[1] for c in cells], object), np.array([c[2] for c in cells], "int64")
        for pdf in batches:
            for b in pdf["b"]:
                w = np.random.default_rng([seed, int(b)]).multinomial(int(n.sum()), n / n.sum()) if len(n) else n
                some = w > 0
                yield pd.DataFrame({"b": np.full(int(some.sum()), b, "int32"), "label": label[some], "pattern": pattern[some], "w": w[some]})

    reps = patterns.sparkSession.range(replicates).select(F.col("id").cast("int").alias("b"))
    return reps.mapInPandas(draw, "b int, label int, pattern string, w bigint")


def hypergeometric_pattern_weights(patterns: DataFrame, ratios: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """Class-ratio subsampling in O(patterns) per repeat.

    Drawing negatives without replacement leaves multivariate hypergeometric counts over their patterns; positives
    keep all their entities. Returns (ratio, rep, label, pattern, w).
    """
    cells = _cells(patterns)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        label, pattern, n = np.array([c[0] for c in cells], "int32"), np.array([c[1] for c in cells], object), np.array([c[2] for c in cells], "int64")
        for pdf in batches:
            for rep, ratio in zip(pdf["rep"], pdf["ratio"]):
                w = n.copy()
                want = min(int(n[label == 0].sum()), int(ratio) * int(n[label == 1].sum()))
                if want:
                    rng = np.random.default_rng([seed, int(rep), int(ratio)])
                    w[label == 0] = rng.multivariate_hypergeometric(n[label == 0], want, method="marginals")
                else:
                    w[label == 0] = 0
                some = w > 0
                k = int(some.sum())
                yield pd.DataFrame({"ratio": np.full(k, ratio, "int32"), "rep": np.full(k, rep, "int32"), "label": label[some], "pattern": pattern[some], "w": w[some]})

    reps = patterns.sparkSession.range(repeats).select(F.col("id").cast("int").alias("rep"), F.explode(F.array(*[F.lit(r) for r in ratios])).alias("ratio"))
    return reps.mapInPandas(draw, "ratio int, rep int, label int, pattern string, w bigint")


def hashed_orders(sizes: DataFrame, permutations: int, seed: int, *, chunk: int = 250) -> DataFrame:
    """(n, b, order): a permutation of 0 .. n-1 for each size and replicate, by the hash of (seed, b, place)."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(max(permutations - 1, 0) // chunk))).alias("_part")
    reps = sizes.select("n").distinct().select("n", parts).repartition("n", "_part")
    reps = reps.select("n", F.explode(F.sequence(F.col("_part") * chunk, F.least(F.col("_part") * chunk + chunk, F.lit(permutations)) - 1)).alias("b"))
    places = reps.select("n", "b", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).withColumn("h", hashed_uniform(seed, F.col("b"), F.col("i")))
    placed = places.groupBy("n", "b").agg(F.sort_array(F.collect_list(F.struct("h", "i"))).alias("_o"))
    return placed.select("n", "b", F.transform("_o.i", lambda i: i - 1).alias("order"))


def permuted_correlations(pairs: DataFrame, permutations: int, seed: int, *, keys: Sequence[str], unit: str, x: str, y: str) -> DataFrame:
    """(keys, b, r): Pearson correlation of x with y shuffled over the units of each key.

    Units are blocks (samples), so a key is one row with its values in arrays, and a replicate reads y in another
    order. Keys with as many units share their orders: keys x permutations rows are made and none is joined with itself.
    """
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    square = lambda c: total(F.transform(c, lambda v: v * v))
    rows = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(unit).alias("u"), F.col(x).alias("x"), F.col(y).alias("y")))).alias("_r"))
    rows = rows.select(*keys, F.size("_r").alias("n"), F.col("_r.x").cast("array<double>").alias("_x"), F.col("_r.y").cast("array<double>").alias("_y"))
    rows = rows.select("*", (total("_x") / F.col("n")).alias("_mx"), (total("_y") / F.col("n")).alias("_my"))
    rows = settle(rows.select(*keys, "n", F.transform("_x", lambda v: v - F.col("_mx")).alias("_x"), F.transform("_y", lambda v: v - F.col("_my")).alias("_y")))
    dot = F.aggregate(F.zip_with("_x", "order", lambda v, i: v * F.get("_y", i)), F.lit(0.0), lambda a, v: a + v)
    norm = F.sqrt(square("_x") * square("_y"))
    each = hashed_orders(rows, permutations, seed).join(rows.withColumn("_norm", norm), "n")
    return each.select(*keys, "b", ratio(dot, F.col("_norm"), None).alias("r"))


def permutation_p(observed: DataFrame, replicates: DataFrame, stat: str, keys: Sequence[str], *, slack: float = 1e-12) -> DataFrame:
    """(hits + 1) / (N + 1) with |stat| >= |observed| - slack."""
    joined = replicates.withColumnRenamed(stat, "_rep").join(observed, list(keys))
    return joined.groupBy(*keys, stat).agg(
        ((F.count_if(F.abs("_rep") >= F.abs(stat) - slack) + 1) / (F.count("*") + 1)).alias("p_perm")
    )
