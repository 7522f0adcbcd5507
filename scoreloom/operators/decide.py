"""Decision rules, dense entity x model grids and id resolution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scalars import at_least


@dataclass(frozen=True)
class Rule:
    """How one model turns a score into a call."""

    model: str
    threshold: float = 0.5
    pvalue_below: float | None = None
    family: str = "other"
    min_length: int = 0


def with_thresholds(rules: Sequence[Rule], override: float | dict[str, float] | None) -> list[Rule]:
    """Copy of the rules with a global or per-model threshold override."""
    if override is None:
        return list(rules)
    pick = (lambda r: override.get(r.model, r.threshold)) if isinstance(override, dict) else (lambda r: override)
    return [Rule(r.model, float(pick(r)), r.pvalue_below, r.family, r.min_length) for r in rules]


def gate_open(df: DataFrame) -> Column:
    """Whether a row passes its model's p gate (rows of ungated models always do)."""
    if "gate_ok" in df.columns:
        return F.col("gate_ok")
    return F.coalesce(F.col("pvalue_below").isNull() | (F.col("pvalue") < F.col("pvalue_below")), F.lit(False))


def decide(df: DataFrame, *, require_present: bool = False, name: str = "call") -> DataFrame:
    """Add the 0/1 call: score >= threshold, and p below the gate where one is set.

    Expects score, emitted, threshold and either gate_ok or pvalue + pvalue_below. A
    missing score has already become 0 (and p 1), so at threshold 0 it is called
    unless ``require_present``.
    """
    ok = at_least("score", F.col("threshold")) & gate_open(df)
    if require_present:
        ok = ok & F.col("emitted")
    return df.withColumn(name, ok.cast("int"))


def best_per_model(
    predictions: DataFrame, rules: Sequence[Rule], entity: str = "entity_id", *, with_pvalue: bool = False
) -> DataFrame:
    """One row per entity with the best score of every model (lowest p on ties).

    A conditional aggregate: partial results combine before the shuffle and the state
    per entity is a few numbers per model, however many raw rows it has. Without the
    p-values themselves the state is plain doubles (hash aggregation in generated
    code): the best row passes the gate exactly when the best score among gated rows
    equals the best score.
    """
    aggs = []
    for i, r in enumerate(rules):
        mine = F.col("model") == r.model
        if with_pvalue:
            aggs.append(F.max(F.when(mine, F.struct(F.col("score"), (-F.col("pvalue")).alias("neg_p")))).alias(f"_m{i}"))
        else:
            aggs.append(F.max(F.when(mine, F.col("score"))).alias(f"_s{i}"))
            if r.pvalue_below is not None:
                aggs.append(F.max(F.when(mine & (F.col("pvalue") < r.pvalue_below), F.col("score"))).alias(f"_g{i}"))
    return predictions.groupBy(entity).agg(*aggs)


def dense_grid(
    truth: DataFrame, predictions: DataFrame, rules: Sequence[Rule], entity: str = "entity_id", *, with_pvalue: bool = False
) -> DataFrame:
    """Every truth entity x every model, missing predictions filled (score 0, p 1).

    Truth is joined once, on the entity, to the per-entity best scores and only then
    expanded to models inside the same task: the shuffle carries each truth row once
    instead of once per model.
    """
    joined = truth.join(best_per_model(predictions, rules, entity, with_pvalue=with_pvalue), entity, "left")
    cells = []
    for i, r in enumerate(rules):
        common = [F.lit(float(r.threshold)).alias("threshold"), F.lit(r.family).alias("family")]
        if with_pvalue:
            best = F.col(f"_m{i}")
            own = [
                F.coalesce(best["score"], F.lit(0.0)).alias("score"), F.coalesce(-best["neg_p"], F.lit(1.0)).alias("pvalue"),
                F.lit(r.pvalue_below).cast("double").alias("pvalue_below"), best.isNotNull().alias("emitted"),
            ]
        else:
            best = F.col(f"_s{i}")
            gate = F.lit(True) if r.pvalue_below is None else F.coalesce(F.col(f"_g{i}") == best, F.lit(False))
            own = [F.coalesce(best, F.lit(0.0)).alias("score"), gate.alias("gate_ok"), best.isNotNull().alias("emitted")]
        cells.append(F.struct(F.lit(r.model).alias("model"), *own, *common))
    return joined.select(*truth.columns, F.inline(F.array(*cells)))


def dense_calls(
    truth: DataFrame, predictions: DataFrame, rules: Sequence[Rule], *, entity: str = "entity_id",
    require_present: bool = False, with_pvalue: bool = False,
) -> DataFrame:
    """Dense grid plus the decision."""
    grid = dense_grid(truth, predictions, rules, entity, with_pvalue=with_pvalue)
    return decide(grid, require_present=require_present)


def fold_regions(
    predictions: DataFrame, known: DataFrame, pattern: str, *, entity: str = "entity_id", group: Sequence[str] = (),
) -> DataFrame:
    """Fold region ids into their parent: an id that is not known itself but whose
    suffix-stripped form is known becomes the parent; scores merge by maximum."""
    ids = known.select(F.col(entity).alias("_id")).distinct()
    exact = ids.withColumnRenamed("_id", entity).withColumn("_exact", F.lit(True))
    parent = ids.withColumnRenamed("_id", "_stripped").withColumn("_parent", F.lit(True))
    # One row per raw id before the lookups: repeated regions collapse map-side.
    raw = predictions.groupBy(*group, entity).agg(F.max("score").alias("score"))
    folded = (
        raw.withColumn("_stripped", F.regexp_replace(F.col(entity), pattern, ""))
        .join(exact, entity, "left")
        .join(parent, "_stripped", "left")
        .withColumn(
            "_target", F.when(F.col("_exact").isNull() & F.col("_parent").isNotNull(), F.col("_stripped")).otherwise(F.col(entity))
        )
    )
    return folded.groupBy(*group, F.col("_target").alias(entity)).agg(F.max("score").alias("score"))


def resolve_ids(
    raw: DataFrame, known: DataFrame, candidates: Column, mangle: Column, *, entity: str = "entity_id",
    strict: bool = True,
) -> DataFrame:
    """Resolve mangled ids: the first candidate equal to the mangled form of a known
    id wins; a candidate shared by several known ids is an error (or NULL)."""
    lookup = (
        known.select(F.col(entity).alias("_known"), mangle.alias("_cand"))
        .groupBy("_cand")
        .agg(F.min("_known").alias("_known"), F.count_distinct("_known").alias("_n"))
    )
    tagged = raw.withColumn("_row", F.monotonically_increasing_id()) if "_row" not in raw.columns else raw
    hits = (
        tagged.select("*", F.posexplode(candidates).alias("_pos", "_cand"))
        .join(lookup, "_cand", "left")
        .groupBy(*[c for c in tagged.columns])
        .agg(F.min(F.when(F.col("_known").isNotNull(), F.struct("_pos", "_n", "_known", "_cand"))).alias("_best"))
    )
    clash = F.concat(F.lit("ambiguous id after substitution: "), F.col("_best._cand"))
    target = F.when(F.col("_best._n") > 1, F.raise_error(clash) if strict else F.lit(None)).otherwise(F.col("_best._known"))
    return hits.withColumn("resolved", target.cast("string")).drop("_best", "_row")


def namespaced(sample: Column | str, entity: Column | str, sep: str = "__") -> Column:
    return F.concat_ws(sep, F.col(sample) if isinstance(sample, str) else sample, entity)


def split_namespace(c: Column | str, sep: str = "__") -> tuple[Column, Column]:
    x = F.col(c) if isinstance(c, str) else c
    pos = F.instr(x, sep)
    return (
        F.when(pos > 0, F.substring(x, F.lit(1), pos - 1)).otherwise(x),
        F.when(pos > 0, F.substring(x, pos + len(sep), F.length(x))).otherwise(x),
    )
