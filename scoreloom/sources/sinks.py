"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, columns: Sequence[str], *, sep: str = "\t", gzip: bool = False) -> None:
    """Fixed column order; columns not listed are dropped, listed ones not present are empty."""
    have = set(df.columns)
    out = df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])
    out.write.mode("overwrite").option("sep", sep).option("header", True).option(
        "compression", "gzip" if gzip else "none"
    ).csv(path)


def write_id_lists(df: DataFrame, path: str, label: str, entity: str) -> None:
    """One directory of plain id lines per label."""
    df.select(F.col(entity).cast("string").alias("value"), label).write.mode("overwrite").partitionBy(label).text(path)


def write_per_sample(df: DataFrame, path: str, sample: str = "sample") -> None:
    """Demultiplex: one directory per sample. Rows are clustered by sample only
    through partitionBy, so a large sample is still written by many tasks."""
    df.write.mode("overwrite").partitionBy(sample).parquet(path)


def fasta_lines(records: DataFrame, *, header: Column | None = None) -> DataFrame:
    h = header if header is not None else F.col("header")
    return records.select(F.concat(F.lit(">"), h, F.lit("\n"), F.col("seq")).alias("value"))


def fasta_subset(records: DataFrame, ids: DataFrame, *, preferred: DataFrame | None = None) -> DataFrame:
    """Records whose id is wanted; where a preferred (trimmed) version exists it wins."""
    want = ids.select("id").distinct()
    tagged = records.withColumn("_p", F.lit(1))
    if preferred is not None:
        tagged = preferred.select(*records.columns).withColumn("_p", F.lit(0)).unionByName(tagged)
    kept = tagged.join(want, "id", "left_semi")
    cols = [c for c in records.columns if c != "id"]
    return kept.groupBy("id").agg(F.min_by(F.struct(*cols), F.col("_p")).alias("_r")).select("id", "_r.*").select(*records.columns)


def prefixed(records: DataFrame, sample: Column, *, min_length: int = 0, sep: str = "__") -> DataFrame:
    """Length filter plus sample prefix on ids and headers."""
    return records.filter(F.col("length") >= min_length).select(
        F.concat_ws(sep, sample, "id").alias("id"), F.concat_ws(sep, sample, "header").alias("header"), "seq", "length"
    )


def whitelist(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the listed columns, in order; a missing one is an error."""
    return df.select(*columns)


def write_fasta(records: DataFrame, path: str) -> None:
    fasta_lines(records).write.mode("overwrite").text(path)
