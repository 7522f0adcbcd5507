"""Panel selection with quotas, done in ranked passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_per_sample(df: DataFrame, sample: str, order: Sequence[Column]) -> DataFrame:
    """First row per sample in the given total order, as an aggregate."""
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c != sample]
    return df.groupBy(sample).agg(F.min_by(F.struct(*rest), rank).alias("_b")).select(sample, "_b.*")


def quota_selection(
    candidates: DataFrame, *, sample: str, klass: str, quotas: Sequence[tuple[str, int]], order: Sequence[Column], id_prefix: str
) -> DataFrame:
    """Greedy selection: one row per sample, classes filled in order up to their quota,
    later classes skipping samples already used. Rows are numbered in selection order.

    Candidates are read once. Each (sample, class) keeps its best row, an aggregate; a class can lose at most as many
    samples to earlier classes as these may take, so its best rows up to the sum of the quotas so far decide. These few
    rows, bounded by the quotas, are folded in order inside one row.
    """
    names = [n for n, _ in quotas]
    stage = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(klass)).cast("int") - 1
    upto = [sum(q for _, q in quotas[: i + 1]) for i in range(len(quotas))]
    at = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    rank = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)])
    whole = F.struct(*candidates.columns)
    best = candidates.filter(F.col(klass).isin(*names)).groupBy(sample, stage.alias("_stage")).agg(F.min_by(whole, rank).alias("_row"), F.min(rank).alias("_rank"))
    place = F.row_number().over(Window.partitionBy("_stage").orderBy("_rank", sample))
    few = best.withColumn("_place", place).filter(F.col("_place") <= at(upto, F.col("_stage")))
    line = few.agg(F.sort_array(F.collect_list(F.struct("_stage", "_place", F.col(sample).alias("_sample"), "_row"))).alias("_line"))
    kinds = {f.name: f.dataType for f in few.schema.fields}
    start = F.struct(
        F.array().cast(T.ArrayType(kinds[sample])).alias("used"), F.array(*[F.lit(0) for _ in names]).alias("n"),
        F.array().cast(T.ArrayType(T.StructType([T.StructField("_stage", T.IntegerType()), T.StructField("_row", kinds["_row"])]))).alias("out"))

    def admit(acc: Column, x: Column) -> Column:
        fits = ~F.array_contains(acc["used"], x["_sample"]) & (F.get(acc["n"], x["_stage"]) < at([q for _, q in quotas], x["_stage"]))
        more = F.struct(
            F.concat(acc["used"], F.array(x["_sample"])).alias("used"), F.transform(acc["n"], lambda v, i: v + (i == x["_stage"]).cast("int")).alias("n"),
            F.concat(acc["out"], F.array(F.struct(x["_stage"].alias("_stage"), x["_row"].alias("_row")))).alias("out"))
        return F.when(fits, more).otherwise(acc)

    chosen = line.select(F.posexplode(F.aggregate("_line", start, admit)["out"]).alias("_i", "_c"))
    number = (F.col("_i") + 1).alias("panel_no")
    label = F.concat(F.lit(id_prefix), F.lpad((F.col("_i") + 1).cast("string"), 3, "0")).alias("panel_id")
    return chosen.select(*[F.col(f"_c._row.{c}").alias(c) for c in candidates.columns], number, label)


def balanced_draw(
    pool: DataFrame, *, stratum: str, cohort: str, targets: dict[str, int], total: int, order: Sequence[Column]
) -> DataFrame:
    """Per stratum: up to the target of every cohort first, then leftovers (cohorts in
    listed order) until ``total`` rows."""
    names = list(targets)
    rank_in = Window.partitionBy(stratum, cohort).orderBy(*order)
    target = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col(cohort)]
    position = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(cohort))
    # No cohort can contribute more than ``total`` rows, so the window is a group limit.
    ranked = (
        pool.filter(F.col(cohort).isin(*names)).withColumn("_r", F.row_number().over(rank_in)).filter(F.col("_r") <= total)
        .withColumn("_extra", (F.col("_r") > target).cast("int")).withColumn("_c", position)
    )
    slot = F.row_number().over(Window.partitionBy(stratum).orderBy("_extra", "_c", "_r"))
    return ranked.withColumn("pick", slot).filter(F.col("pick") <= total).drop("_r", "_extra", "_c")
