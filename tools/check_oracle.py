"""Run registered queries in Spark and their SQL in DuckDB and compare the results.

usage: python tools/check_oracle.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAME = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT"}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return repr(v)


def compare(spark, con, entry, sf_dir):
    t0 = time.time()
    df = entry.run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in cols) for r in df.collect()])
    took = time.time() - t0
    if entry.sql is None:
        return "rows-only", len(got), took, ""
    t1 = time.time()
    rel = con.execute(entry.sql)
    names = [c[0] for c in rel.description]
    dtypes = {c[0]: str(c[1]) for c in rel.description}
    rows = rel.fetchall()
    duck_took = time.time() - t1
    if sorted(names) != cols:
        return "COLUMNS", len(got), took, f"{cols} vs {sorted(names)}"
    pos = [names.index(c) for c in cols]
    want = sorted([tuple(norm(r[i]) for i in pos) for r in rows])
    note = f"duck {duck_took:.2f}s"
    odd = [f"{n}:{t}/{dtypes[n]}" for n, t in df.dtypes if t in SAME and SAME[t] != dtypes[n]]
    if odd:
        note += " TYPES " + ",".join(odd)
    if got == want:
        return ("ok" if got else "ok-EMPTY"), len(got), took, note
    g, w = set(got), set(want)
    return "MISMATCH", len(got), took, f"{len(want)} wanted; cols {cols}\n   spark only {sorted(g - w)[:3]}\n   duck only  {sorted(w - g)[:3]}"


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0][0].isdigit() else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    from scoreloom.catalog.all import CATALOG

    picks = [n for n in CATALOG if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)] if args else list(CATALOG)
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in picks:
        try:
            status, n, took, note = compare(spark, con, CATALOG[name], sf_dir)
        except Exception as e:  # report and go on
            status, n, took, note = "ERROR", 0, 0.0, str(e).split("JVM stacktrace")[0][:900]
        flag = "" if status in ("ok", "rows-only") and "TYPES" not in note else "  <<<"
        bad += bool(flag)
        print(f"{name:42s} {status:10s} rows={n:<7d} {took:6.2f}s {note if flag or 'duck' in note else ''}{flag}", flush=True)
    print("checked", len(picks), "problems", bad)


if __name__ == "__main__":
    main()
