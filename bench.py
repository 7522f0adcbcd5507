"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

HEADLINE = [
    "rank_models_by_mcc", "metrics_by_stratum", "macro_summary", "average_precision", "pr_curve_points", "best_threshold",
    "threshold_sweep", "evidence_tiers", "evidence_variant_ranks", "composition_pooled_benchmark", "enrichment_labels", "enrichment_grid",
    "concordance_by_category", "recruitment_grid", "block_bootstrap_ci", "paired_mcc_difference", "four_estimand_contrast",
    "entity_bootstrap_ci", "two_cohort_rank_correlation", "cochran_q", "mcnemar_pairs", "permutation_test",
    "hit_tiling", "best_subject_per_query", "interval_union", "best_hit_per_key", "fragment_manifest", "community_diversity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from scoreloom.catalog.all import CATALOG

    names = [n for n in HEADLINE if n in CATALOG]
    CATALOG[names[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
