"""End-to-end benchmark jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import metrics as M
from scoreloom.operators.confusion import concordance_metrics, confusion, metric_table
from scoreloom.operators.curves import average_precision
from scoreloom.operators.decide import Rule, dense_calls
from scoreloom.operators.labelling import evidence_tier
from scoreloom.operators.ordered import rank_by


def pooled_benchmark(
    flags: DataFrame, predictions: DataFrame, rules: Sequence[Rule], *, block: str = "block", min_tier: int = 2, min_length: int | None = None, **tiering
) -> DataFrame:
    """Evidence flags and predictions -> metrics per model, pooled (block NULL) and per block.

    The entity-level work is one tier projection, one join and one partial aggregate;
    pooled rows are added up from the block rows.
    """
    t = evidence_tier(flags, **tiering).filter(F.col("tier").between(0, min_tier))
    if min_length is not None:
        t = t.filter(F.col("length") >= min_length)
    ready = t.select("entity_id", block, (F.col("tier") > 0).cast("int").alias("label"))
    per = confusion(dense_calls(ready, predictions, rules), ("model", block))
    both = per.groupingSets([[F.col("model"), F.col(block)], [F.col("model")]], "model", block).agg(*[F.sum(c).alias(c) for c in M.COUNTS])
    return both.withColumn("mcc", M.mcc())


def full_metrics(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts, all metrics, AUPRC and the ranks by MCC and AUPRC of every model, within ``keys``."""
    by = ("model", *keys)
    both = metric_table(calls, by).join(average_precision(calls, by).select(*by, "auprc"), list(by))
    for m in ("mcc", "auprc"):
        both = rank_by(both.withColumn("_m", F.round(m, 9)), "_m", group=keys, method="min", name=f"rank_{m}").drop("_m")
    return both


def concordance_grains(calls: DataFrame, category: str, block: str, *, status: str = "status") -> DataFrame:
    """Concordance per model, per (model, category) and per (model, block).

    The finest counts are aggregated once and the coarser grains are sums of them.
    """
    pos, call = F.col(status) == "positive", F.col("call") == 1
    fine = calls.filter(F.col(status) != "ambiguous").groupBy("model", category, block).agg(
        F.count_if(call & pos).alias("a"), F.count_if(call & ~pos).alias("b"),
        F.count_if(~call & pos).alias("d"), F.count_if(~call & ~pos).alias("e"),
    )
    sets = [[F.col("model")], [F.col("model"), F.col(category)], [F.col("model"), F.col(block)]]
    counts = fine.groupingSets(sets, "model", category, block).agg(*[F.sum(c).alias(c) for c in "abde"])
    return concordance_metrics(counts)
