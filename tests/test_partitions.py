"""Reconciliation of members and parents where few parents hold all rows."""

from pyspark.sql import functions as F

from scoreloom.operators import quality as QC


def test_known_parents_are_distinct_before_the_join(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        members = spark.range(2000).select((F.col("id") % 50).alias("member"), F.when(F.col("id") == 7, "z").otherwise("x").alias("parent"))
        known = spark.range(20000).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("parent"))
        out = QC.partition_violations(members, known)
        assert sorted(map(tuple, out.collect())) == [("7", "several_parents"), ("z", "unknown_parent")]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan[plan.index("LeftAnti"):].count("Aggregate [") == 2, plan
