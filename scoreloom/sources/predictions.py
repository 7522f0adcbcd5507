"""Readers that turn each classifier's output layout into (entity_id, score, pvalue)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import rules as R
from scoreloom.functions.scalars import leading_token, softmax_share, to_double
from scoreloom.sources.text import typed

# Default decision rule of each classifier.
THRESHOLDS = {
    "DeepVirFinder": 0.5, "VirSorter": 0.5, "VirSorter2": 0.5, "VirFinder": 0.5, "PPR-Meta": 0.5, "VIBRANT": 0.5,
    "Seeker": 0.5, "MetaPhinder": 0.5, "Sourmash": 0.5, "geNomad": 0.7, "HVSeeker": 0.5, "Jaeger": 0.5,
    "TransGINmer": 0.5, "ViraLM": 0.5,
}
PVALUE_GATES = {"DeepVirFinder": 0.05, "VirFinder": 0.05}
# Region suffix each classifier appends to an input id.
REGION_SUFFIX = {
    "geNomad": r"\|provirus_\d+_\d+$",
    "VIBRANT": r"_fragment_\d+$",
    "VirSorter2": r"\|\|(?:(?:\d+_)?(?:full|partial)(?:_\d+_\d+)?|lt2gene)$",
}


def _out(df: DataFrame, entity: Column, score: Column, pvalue: Column | None = None) -> DataFrame:
    p = F.lit(None).cast("double") if pvalue is None else pvalue
    rows = df.select(entity.alias("entity_id"), score.alias("score"), p.alias("pvalue"))
    return rows.filter((F.col("entity_id") != "") & F.col("score").isNotNull())


def named_score(df: DataFrame, entity: Sequence[str], score: str, *, pvalue: str | None = None, first_token: bool = False) -> DataFrame:
    """Header table with an id and a score column (p-value defaults to 1 when present but empty)."""
    cols = {"e": "string", "s": "double"} | ({"p": "double"} if pvalue else {})
    t = typed(df, cols, {"e": tuple(entity), "s": (score,)} | ({"p": (pvalue,)} if pvalue else {}))
    e = leading_token("e") if first_token else F.col("e")
    return _out(t, e, F.col("s"), F.coalesce("p", F.lit(1.0)) if pvalue else None)


def deepvirfinder(df: DataFrame) -> DataFrame:
    return named_score(df, ("name",), "score", pvalue="pvalue", first_token=True)


def virfinder(lines: DataFrame) -> DataFrame:
    """Tab-separated table or space-separated data-frame print with an index column.

    The print is rewritten to the tabular layout (index dropped) and split once; the
    generated row keeps later filters from re-splitting the line.
    """
    v = F.col("value")
    printed = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(v, '"', "")), r"^\S+\s+", ""), r"\s+", "\t")
    f = F.split(F.when(v.contains("\t"), v).otherwise(printed), r"\t")
    cell = F.struct(F.get(f, F.lit(0)).alias("n"), F.get(f, F.lit(2)).alias("s"), F.get(f, F.lit(3)).alias("p"))
    rows = lines.select(F.inline(F.array(cell))).filter(F.col("p").isNotNull() & (F.col("n") != "name"))
    return _out(rows, leading_token("n"), to_double("s"), F.coalesce(to_double("p"), F.lit(1.0)))


def pprmeta(df: DataFrame) -> DataFrame:
    t = typed(df, {"h": "string", "s": "double"}, {"h": ("Header",), "s": ("phage_score",)})
    return _out(t, leading_token(F.regexp_replace("h", "^>+", "")), F.col("s"))


def seeker(df: DataFrame) -> DataFrame:
    return named_score(df, ("name",), "score")


def metaphinder(df: DataFrame) -> DataFrame:
    t = typed(df, {"e": "string", "c": "string"}, {"e": ("#contigID", "contigID"), "c": ("classification",)})
    return _out(t, F.col("e"), F.when(F.lower("c") == "phage", 1.0).otherwise(0.0))


def sourmash(lines: DataFrame) -> DataFrame:
    f = F.split("value", ",")
    rows = lines.filter((F.trim("value") != "") & (F.size(f) >= 2))
    return _out(rows, F.trim(F.get(f, F.lit(0))), to_double(F.get(f, F.lit(1))))


def merged_max(df: DataFrame) -> DataFrame:
    """One row per entity; a NaN among its scores stays NaN (NaN sorts above all numbers)."""
    return df.groupBy("entity_id").agg(F.max("score").alias("score"), F.min("pvalue").alias("pvalue"))


def genomad(df: DataFrame) -> DataFrame:
    return merged_max(named_score(df, ("seq_name",), "virus_score"))


def vibrant_calls(lines: DataFrame) -> DataFrame:
    """Accepted calls: one id per line, or FASTA headers; presence is score 1."""
    fasta = F.col("value").startswith(">")
    is_fasta = F.coalesce(F.col("is_fasta"), F.lit(False)) if "is_fasta" in lines.columns else F.lit(False)
    token = leading_token(F.regexp_replace("value", "^>", ""))
    rows = lines.filter(F.when(is_fasta, fasta).otherwise(F.trim("value") != ""))
    return merged_max(_out(rows, token, F.lit(1.0)))


def virsorter2(df: DataFrame) -> DataFrame:
    t = typed(df, {"e": "string", "raw": "string"}, {"e": ("seqname",), "raw": ("max_score",)})
    s = F.coalesce(F.nanvl(to_double("raw"), F.lit(0.0)), F.lit(0.0))
    return merged_max(_out(t, F.col("e"), s))


def virsorter_headers(lines: DataFrame) -> DataFrame:
    """FASTA headers with a category: raw body, category and ordered id candidates."""
    h = F.trim(F.substring(F.col("value"), F.lit(2), F.length("value")))
    pat = r"^(?:VIRSorter_)?(.+)-cat_([1-6])$"
    rows = lines.filter(F.col("value").startswith(">")).select(
        F.regexp_extract(h, pat, 1).alias("body"), F.regexp_extract(h, pat, 2).alias("cat")
    ).filter(F.col("body") != "")
    gene = F.regexp_replace("body", r"_gene_\d+_gene_\d+-\d+-\d+$", "")
    circ = F.regexp_replace(gene, r"-circular$", "")
    frag = F.nullif(F.regexp_extract(circ, r"^(.+_frag_\d+_L\d+)(?:_|$)", 1), F.lit(""))
    cands = F.array_distinct(F.array_compact(F.array(F.col("body"), gene, circ, frag)))
    return rows.select("body", R.category_score("cat").alias("score"), cands.alias("candidates"))


def hvseeker(df: DataFrame) -> DataFrame:
    return named_score(df, ("contig_id", "name"), "viral_score")


def jaeger(df: DataFrame) -> DataFrame:
    """Four class logits -> softmax probability of the second (phage)."""
    names = ("bacteria_score", "phage_score", "eukarya_score", "archaea_score")
    t = typed(df, {"contig_id": "string"} | {n: "double" for n in names})
    return _out(t, F.col("contig_id"), softmax_share([F.col(n) for n in names], 1))


def transginmer(df: DataFrame) -> DataFrame:
    return named_score(df, ("contig_id",), "viral_score")


def viralm(df: DataFrame) -> DataFrame:
    return named_score(df, ("contig_id",), "score")
