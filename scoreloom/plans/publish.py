"""Publication tables: template-ordered joins, cross-context assembly, wide exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_template(template: DataFrame, numbers: DataFrame, keys: Sequence[str], values: Sequence[str], *, strict: bool = True) -> DataFrame:
    """Row order and fixed text from the template, numbers from the other table; a cell
    left without a number fails the job (or stays NULL)."""
    j = template.join(numbers.select(*keys, *values), list(keys), "left")
    if not strict:
        return j
    fill = lambda v: F.coalesce(F.col(v), F.raise_error(F.concat(F.lit(f"no {v} for "), F.concat_ws("/", *keys))).cast("double"))
    return j.select(*template.columns, *[fill(v).alias(v) for v in values])


def across_contexts(values: DataFrame, contexts: Sequence[str], *, model: str = "model", context: str = "context", value: str = "v") -> DataFrame:
    """One row per model with a column per context; models missing from any context are
    flagged instead of dropped."""
    wide = values.groupBy(model).agg(*[F.max(F.when(F.col(context) == c, F.col(value))).alias(f"c{i}") for i, c in enumerate(contexts)])
    full = F.lit(True)
    for i in range(len(contexts)):
        full = full & F.col(f"c{i}").isNotNull()
    return wide.withColumn("complete", full)


def attach_context(metrics: DataFrame, intervals: DataFrame, meta: DataFrame, keys: Sequence[str], value: str, point: str, tol: float) -> DataFrame:
    """Metrics x intervals x metadata, keeping a flag for rows whose two point estimates disagree."""
    j = metrics.join(intervals, list(keys)).join(meta, list(keys), "left")
    return j.withColumn("agrees", F.abs(F.col(value) - F.col(point)) <= tol)


def in_order(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """Sort by a custom category order, then by further columns (small result tables)."""
    pos = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    return df.orderBy(F.when(pos == 0, len(order) + 1).otherwise(pos), *then)
