"""Sensitivity sweeps. Entities are reduced to slots or counts before they meet a grid,
so a sweep never multiplies the entity table across a shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.operators.confusion import concordance_metrics
from scoreloom.operators.labelling import recruitment_status, tier_columns


def _slot(value: Column, edges: Sequence[float]) -> Column:
    """How many edges the value reaches."""
    total = F.lit(0)
    for e in edges:
        total = total + F.when(value >= e, 1).otherwise(0)
    return total


def minimum_sweep(df: DataFrame, value: str, edges: Sequence[float], keys: Sequence[str], sums: Mapping[str, Column], *, name: str) -> DataFrame:
    """Aggregates over rows with value >= edge, for every edge: one pass to slot totals,
    then suffix sums over the slots."""
    edges = sorted(edges)
    per = df.groupBy(*keys, _slot(F.col(value), edges).alias("_slot")).agg(*[c.alias(n) for n, c in sums.items()])
    ladder = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(e).alias(name)) for i, e in enumerate(edges)]))
    rungs = per.select("*", ladder.alias("_g")).filter(F.col("_slot") >= F.col("_g.at"))
    return rungs.groupBy(*keys, F.col(f"_g.{name}").alias(name)).agg(*[F.sum(n).alias(n) for n in sums])


def coverage_audit(calls: DataFrame, edges: Sequence[int], *, length: str = "length", least: float = 0.99) -> DataFrame:
    """Coverage per model and minimum length, and whether every model reaches ``least``."""
    cov = minimum_sweep(
        calls, length, edges, ("model",), {"n_entities": F.count("*"), "n_scored": F.count_if("emitted")}, name="min_length"
    ).withColumn("coverage", F.col("n_scored") / F.col("n_entities"))
    allok = cov.groupBy("min_length").agg(F.bool_and(F.col("coverage") >= least).alias("all_covered"))
    return cov.join(allok, "min_length")


def min_length_metrics(calls: DataFrame, edges: Sequence[int], *, length: str = "length") -> DataFrame:
    y, p = F.col("label") == 1, F.col("call") == 1
    sums = {"tp": F.count_if(y & p), "fp": F.count_if(~y & p), "tn": F.count_if(~y & ~p), "fn": F.count_if(y & ~p)}
    return minimum_sweep(calls, length, edges, ("model",), sums, name="min_length").select("*", *M.metric_columns())


def recruitment_grid(
    calls: DataFrame, breadths: Sequence[float], pairs: Sequence[int], *, breadth: str = "breadth_pct", n_pairs: str = "n_read_pairs",
) -> DataFrame:
    """Relabel by (breadth, read pair) thresholds and score every model per grid cell.

    Entities collapse to (breadth slot, pair slot, none) x call counts per model;
    the grid then meets at most a few dozen rows per model.
    """
    b, p = sorted(breadths), sorted(pairs)
    per = calls.groupBy(
        "model", _slot(F.col(breadth), b).alias("_sb"), _slot(F.col(n_pairs), p).alias("_sp"), (F.col(n_pairs) == 0).alias("_none"), "call"
    ).agg(F.count("*").alias("n"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("bi"), F.lit(float(x)).alias("min_breadth"), F.lit(j + 1).alias("pi"), F.lit(y).alias("min_pairs"))
        for i, x in enumerate(b) for j, y in enumerate(p)
    ]))
    g = per.select("*", cells.alias("g"))
    pos = ~F.col("_none") & (F.col("_sb") >= F.col("g.bi")) & (F.col("_sp") >= F.col("g.pi"))
    on = F.col("call") == 1
    pick = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    counts = g.groupBy("model", F.col("g.min_breadth").alias("min_breadth"), F.col("g.min_pairs").alias("min_pairs")).agg(
        pick(on & pos).alias("a"), pick(on & F.col("_none")).alias("b"), pick(~on & pos).alias("d"), pick(~on & F.col("_none")).alias("e")
    )
    return concordance_metrics(counts)


def label_vector(labels: Sequence[Column], *, positive: str = "TP", negative: str = "TN") -> Column:
    """The labels of an entity under all variants as one short text: 2 positive, 1 negative, 0 neither."""
    return F.concat(*[F.when(c == positive, "2").when(c == negative, "1").otherwise("0") for c in labels])


def relabel_grid(calls: DataFrame, names: Sequence[str], *, vector: str = "labels", keys=("model",)) -> DataFrame:
    """Confusion counts per model under several label definitions at once.

    Entities with the same ``label_vector`` differ in their calls only: they are counted per (model, call, vector)
    first, and the few vectors that occur are then read variant by variant. Variants with an empty class keep NULL
    metrics.
    """
    vectors = calls.groupBy(*keys, "call", vector).agg(F.count(F.lit(1)).alias("_n"))
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("variant"), F.substring(vector, i + 1, 1).alias("_l")) for i, n in enumerate(names)]))
    rows = vectors.select(*keys, "call", "_n", cells).filter(F.col("_l") != "0")
    y, on = F.col("_l") == "2", F.col("call") == 1
    pick = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    counts = rows.groupBy(*keys, "variant").agg(pick(y & on).alias("tp"), pick(~y & on).alias("fp"), pick(~y & ~on).alias("tn"), pick(y & ~on).alias("fn"))
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    return counts.select("*", *[F.when(both, c).alias(n) for n, c in (("precision", M.precision()), ("recall", M.recall()), ("f1", M.f1()), ("mcc", M.mcc()))])


def enrichment_variant(high: float, low: float, top: float, *, viral: Column, unknown: Column, negative: Column, ratio: str = "ratio") -> Column:
    """Label under one (enriched threshold, background band) setting."""
    r = F.col(ratio)
    return (
        F.when((r > high) & viral, "TP").when((r > high) & unknown, "dark_matter").when(r > high, "excluded")
        .when((r > low) & (r < top) & negative, "TN").otherwise("excluded")
    )


def tier_variants(flags: DataFrame, variants: Mapping[str, dict], *, keep: Sequence[str]) -> DataFrame:
    """Tier per entity under several evidence rules, one row per (entity, variant),
    computed on the flags row without a second scan."""
    return flags.select(*keep, F.inline(_tier_cells(variants)))


def tier_variant_counts(flags: DataFrame, variants: Mapping[str, dict]) -> DataFrame:
    """(variant, tier, category, n): entities are counted by their tiers under all variants together before these are
    listed one by one."""
    together = flags.groupBy(_tier_cells(variants).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    return together.select("_n", F.inline("_c")).groupBy("variant", "tier", "category").agg(F.sum("_n").alias("n"))


def _tier_cells(variants: Mapping[str, dict]) -> Column:
    cells = []
    for name, options in variants.items():
        c = tier_columns(**options)
        cells.append(F.struct(F.lit(name).alias("variant"), *[c[k].alias(k) for k in ("tier", "n_evidence", "category")]))
    return F.array(*cells)
