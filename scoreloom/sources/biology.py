"""Readers for aligner, taxonomy, coverage and domain tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.scalars import leading_token, to_double, to_long
from scoreloom.operators.ordered import best_per_key, carry_forward
from scoreloom.sources.text import parse_headerless, read_lines, read_table, typed

# Column order of the headerless hit tables.
HIT_COLUMNS = (
    ("qseqid", "string"), ("sseqid", "string"), ("pident", "double"), ("length", "bigint"), ("mismatch", "bigint"),
    ("gapopen", "bigint"), ("qstart", "bigint"), ("qend", "bigint"), ("sstart", "bigint"), ("send", "bigint"),
    ("evalue", "double"), ("bitscore", "double"), ("qlen", "bigint"), ("slen", "bigint"),
)
# Columns that all protein layouts share; the title follows them directly (13 columns) or after both lengths (15).
PROTEIN_HIT_COLUMNS = HIT_COLUMNS[:12]
PAF_COLUMNS = (
    ("query", "string"), ("qlen", "bigint"), ("qstart", "bigint"), ("qend", "bigint"), ("strand", "string"),
    ("target", "string"), ("tlen", "bigint"), ("tstart", "bigint"), ("tend", "bigint"), ("matches", "bigint"),
    ("block", "bigint"), ("mapq", "bigint"),
)


def hits(lines: DataFrame) -> DataFrame:
    """Nucleotide hit lines (value, line_no) -> typed rows."""
    return parse_headerless(lines, HIT_COLUMNS)


def protein_hits(lines: DataFrame) -> DataFrame:
    """Protein hit lines of 12 columns or more; the title is column 13, or column 15 where lengths stand before it."""
    rows = parse_headerless(lines.withColumn("_v", F.col("value")), PROTEIN_HIT_COLUMNS)
    f = F.split("_v", r"\t", -1)
    long = F.size(f) >= 15
    title = F.when(long, F.get(f, F.lit(14))).otherwise(F.coalesce(F.get(f, F.lit(12)), F.lit("")))
    length = lambda i: F.when(long, to_long(F.get(f, F.lit(i))))
    return rows.withColumns({"qlen": length(12), "slen": length(13), "stitle": F.trim(title)}).drop("_v")


def best_protein_hit(rows: DataFrame, *, min_length: int = 50) -> DataFrame:
    """Hits of at least ``min_length`` residues, best score per query, first line on ties."""
    return best_per_key(rows.filter(F.col("length") >= min_length), ["qseqid"], "bitscore", ["line_no"])


def paf(lines: DataFrame, *, identity: str = "tag") -> DataFrame:
    """PAF lines -> typed rows; coordinates are 0-based half-open. Identity is 100*(1 - de) from the ``de:f:`` tag,
    wherever it stands, else matches over block length; with ``identity="matches"`` always the latter."""
    base = parse_headerless(lines.withColumn("_v", F.col("value")), PAF_COLUMNS)
    ident = F.try_divide(F.col("matches") * 100.0, F.col("block").cast("double"))
    if identity == "tag":
        tag = F.get(F.filter(F.split("_v", r"\t"), lambda t, i: (i >= len(PAF_COLUMNS)) & t.startswith("de:f:")), F.lit(0))
        ident = F.coalesce(100.0 * (1.0 - F.regexp_replace(tag, "^de:f:", "").try_cast("double")), ident)
    elif identity != "matches":
        raise ValueError("identity is tag or matches")
    cov = F.try_divide((F.col("qend") - F.col("qstart")) * 100.0, F.col("qlen").cast("double"))
    return base.withColumn("pident", ident).withColumn("coverage", cov).withColumn("aligned", F.col("tend") - F.col("tstart")).drop("_v")


def ani_best(table: DataFrame, *, order: str | None = None) -> DataFrame:
    """Best reference per query from an ANI table whose header names vary; of equal ones the first in the order of
    the number column ``order`` (the file's, where given), then by name."""
    place = {order: "bigint"} if order else {}
    rows = typed(
        table, place | {"query": "string", "ref": "string", "ani": "double", "af_ref": "double", "af_query": "double"},
        {"query": ("Query_name", "Query_file"), "ref": ("Ref_name", "Ref_file"), "ani": ("ANI",),
         "af_ref": ("Align_fraction_ref",), "af_query": ("Align_fraction_query",)},
    )
    rows = rows.withColumn("query", leading_token("query")).withColumn("ref", leading_token("ref"))
    rows = rows.withColumn("af_shorter", F.greatest("af_ref", "af_query"))
    return best_per_key(rows, ["query"], "ani", [*place, "ref"])


def quality_table(df: DataFrame) -> DataFrame:
    """Genome-quality table; completeness may be missing text."""
    return typed(
        df, {"contig_id": "string", "contig_length": "bigint", "checkv_quality": "string", "completeness": "double",
             "provirus": "string", "viral_genes": "bigint", "host_genes": "bigint"},
    ).withColumn("checkv_quality", F.coalesce("checkv_quality", F.lit("Not-determined"))).fillna(0, ["viral_genes", "host_genes"]).fillna("No", ["provirus"])


def taxon_assignments(lines: DataFrame) -> DataFrame:
    """C/U assignment lines -> status, contig, name, taxid, classified."""
    rows = parse_headerless(lines, (("status", "string"), ("contig_id", "string"), ("taxon", "string")))
    return rows.withColumn("taxid", F.nullif(F.regexp_extract("taxon", r"\(taxid (\d+)\)", 1), F.lit(""))).withColumn(
        "classified", F.col("status") == "C"
    )


def taxon_report(lines: DataFrame, ranks: Sequence[str] = ("D", "P", "C", "O", "F", "G", "S", "S1", "S2")) -> DataFrame:
    """Ordered taxonomy report -> (taxid, domain): the nearest domain line above."""
    rows = parse_headerless(
        lines, (("pct", "double"), ("n_clade", "bigint"), ("n_taxon", "bigint"), ("rank", "string"), ("taxid", "string"), ("name", "string"))
    )
    tagged = carry_forward(rows, "line_no", F.col("rank") == "D", F.col("name"), name="domain")
    return tagged.filter(F.col("rank").isin(*ranks) & F.col("domain").isNotNull()).select("taxid", "domain")


def prophage_regions(df: DataFrame) -> DataFrame:
    """Region table with header variants, one row per region."""
    return typed(
        df, {"contig_id": "string", "begin": "bigint", "end": "bigint", "n_genes": "string"},
        {"contig_id": ("scaffold", "contig"), "begin": ("start",), "end": ("stop",), "n_genes": ("taxonomy",)},
    )


def region_coords(regions: DataFrame) -> DataFrame:
    """begin-end list per contig, in coordinate order."""
    pair = F.struct("begin", "end")
    text = F.transform(F.array_sort(F.collect_set(pair)), lambda r: F.concat_ws("-", r["begin"].cast("string"), r["end"].cast("string")))
    return regions.groupBy("contig_id").agg(F.concat_ws(";", text).alias("coords"))


def flagstat_mapped(lines: DataFrame) -> DataFrame:
    """Mapped reads per file: the 'primary mapped' line, else the plain 'mapped (' line."""
    n = F.regexp_extract("value", r"^(\d+)", 1).try_cast("bigint")
    v = F.col("value")
    primary = F.max(F.when(v.contains("primary mapped"), n))
    plain = F.max(F.when(v.contains("mapped (") & ~v.contains("primary"), n))
    return lines.groupBy("file").agg(F.coalesce(F.nullif(primary, F.lit(0)), plain, F.lit(0)).alias("mapped_reads"))


def coverage_table(df: DataFrame) -> DataFrame:
    return typed(
        df, {"entity_id": "string", "length": "bigint", "numreads": "bigint", "coverage": "double", "depth": "double"},
        {"entity_id": ("#rname", "rname"), "length": ("endpos",), "depth": ("meandepth",)},
    )


def depth_lines(lines: DataFrame) -> DataFrame:
    return parse_headerless(lines, (("contig", "string"), ("pos", "bigint"), ("depth", "bigint")))


def domain_hits(lines: DataFrame) -> DataFrame:
    """Whitespace-delimited domain table -> gene, family, e-value of the sequence, score of the domain (field 14)."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("_f", f)
    return rows.filter(F.size("_f") >= 14).select(
        F.get("_f", F.lit(3)).alias("gene"), F.get("_f", F.lit(0)).alias("family"),
        to_double(F.get("_f", F.lit(6))).alias("evalue"), to_double(F.get("_f", F.lit(13))).alias("score"),
    )


def gene_families(rows: DataFrame) -> DataFrame:
    """Families of each gene, best score first and of equal scores the last name first.

    Duplicate (gene, family) rows collapse to their best score in a partial
    aggregate, so the per-gene list holds distinct families only.
    """
    best = rows.groupBy("gene", "family").agg(F.max("score").alias("score"))
    order = F.sort_array(F.collect_list(F.struct("score", "family")), asc=False)
    return best.groupBy("gene").agg(F.transform(order, lambda s: s["family"]).alias("families"))


def screen_rows(lines: DataFrame) -> DataFrame:
    """Containment screen rows (identity, X/N shared hashes, multiplicity, p-value, name)."""
    rows = parse_headerless(lines, (("identity", "double"), ("shared", "string"), ("multiplicity", "double"), ("pvalue", "double"), ("name", "string")))
    part = lambda i: to_long(F.get(F.split("shared", "/"), F.lit(i)))
    return rows.withColumn("shared_hashes", part(0)).withColumn("total_hashes", part(1)).drop("shared")


def read_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return hits(read_lines(spark, path))


def read_paf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return paf(read_lines(spark, path))


def read_quality(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return quality_table(spark.read.option("sep", "\t").option("header", True).csv(path))


def metadata_pick(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Named-column pick from a large (gzipped) metadata table."""
    return read_table(spark, path, columns)


def rule_counts(meta: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Many overlapping rules counted in one pass."""
    return meta.agg(F.count("*").alias("n_rows"), *[F.count_if(c).alias(n) for n, c in rules.items()])
