"""Doubles of a result are rounded as its SQL rounds them, also where a decimal tie is no exact double."""

import math

import duckdb

from scoreloom.catalog.base import rounded
from scoreloom.catalog.all import CATALOG


def test_ties_of_the_enrichment_ratio_follow_the_sql(spark, tmp_path):
    # Quantities 41 to 671 against 640 are ratios with a 5 in the seventh place.
    tops = (41, 323, 333, 641, 651, 661, 671)
    lines = [(k, "O", 40.0) for k in range(len(tops)) for _ in range(16)]
    lines += [(k, "F", float(min(50, n - x))) for k, n in enumerate(tops) for x in range(0, n, 50)]
    lines += [(100, "O", 1.0), (101, "F", 1.0)]
    rows = [(k, 1, 1, i, q, 1.0, 0.0, 0.0, "N", s) for i, (k, s, q) in enumerate(lines)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_ntz'1995-03-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    (tmp_path / "orders.parquet").mkdir()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute("CREATE TABLE orders (o_orderkey BIGINT, o_orderdate TIMESTAMP, o_orderpriority VARCHAR, o_orderstatus VARCHAR)")
    e = CATALOG["enrichment_ratios"]
    want = con.execute(e.sql).fetchall()
    assert sorted(tuple(r) for r in e.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_odd_doubles_keep_their_value(spark):
    values = [math.inf, -math.inf, 1.7e308, -1.7e308, 0.0000005, -0.0000005, -0.0000001, 2.5, 9007199254740993.0, None]
    got = [r[0] for r in rounded(spark.createDataFrame([(v,) for v in values], "v double")).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT round(?::DOUBLE, 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert math.isnan(rounded(spark.createDataFrame([(math.nan,)], "v double")).first()[0])
