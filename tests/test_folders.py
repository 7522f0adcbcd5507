"""Many small files: each folder is written by one task, and finding the files takes no job per sample."""

import re

from pyspark.sql import functions as F

from scoreloom.catalog import inputs


def test_folders_of_documents_are_whole_and_listed_without_a_job_each(spark, tmp_path):
    k = F.col("id")
    sup = spark.range(40 * 50).select(k.alias("s_suppkey"), F.lit("n").alias("s_name"), (k % 3).cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal"))
    sup.write.parquet(str(tmp_path / "supplier.parquet"))
    sc = spark.sparkContext
    sc.setJobGroup("folders", "array files")
    try:
        docs = inputs.array_files(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in sc.statusTracker().getJobIdsForGroup("folders") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert max(sc.statusTracker().getStageInfo(s).numTasks for s in stages if sc.statusTracker().getStageInfo(s)) < 40, "a listing task per document"
    files = docs.inputFiles()
    assert len(files) == 40 * 3
    by = {}
    for f in files:
        folder, task = re.search(r"/arrays/([^/]+)/.*/part-(\d+)-", f).groups()
        by.setdefault(folder, set()).add(task)
    assert len(by) == 10 and all(len(tasks) == 1 for tasks in by.values()), by
    seen = docs.select("sample", "part", F.col("_corrupt").isNotNull().alias("bad"), F.size("Sequences").alias("n")).collect()
    assert {(int(r["sample"]), int(r["part"])): r["bad"] for r in seen} == {(a, p): (a + p) % 7 == 3 for a in range(3) for p in range(40)}
    assert sum(r["n"] for r in seen if not r["bad"]) == sum(1 for i in range(2000) if (i % 3 + i // 50) % 7 != 3)
