"""Registry and the shared input tables, each in a Spark and a SQL form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.scalars import is_finite
from scoreloom.operators.decide import Rule, dense_calls

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None
    covers: tuple[str, ...]


CATALOG: dict[str, Entry] = {}
PLACES = 6


def to_places(value: Column, places: int = PLACES) -> Column:
    """Rounded as the oracle does: a double is scaled, rounded to a whole number and scaled back. Spark's own ``round`` goes by
    the decimal digits of the unscaled double and takes some ties the other way (0.0640625: 0.064063, here 0.064062)."""
    scaled = value * 10.0**places
    return F.when(is_finite(scaled), F.round(scaled) / 10.0**places).otherwise(value)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so summation order cannot show in a comparison."""
    return df.select(
        *[
            to_places(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def register(name: str, covers: str, sql: str | None = None, doubles: str = ""):
    """Register a query. ``doubles`` lists the oracle's DOUBLE columns, rounded like Spark's."""

    def wrap(fn: Query) -> Query:
        assert name not in CATALOG, name
        text = None
        if sql is not None:
            cols = ", ".join(f"round({c}, {PLACES}) + 0.0 AS {c}" for c in doubles.split())
            text = f"SELECT * REPLACE ({cols}) FROM ({sql})" if cols else sql
        CATALOG[name] = Entry(name, lambda spark, d: rounded(fn(spark, d)), text, tuple(covers.split()))
        return fn

    return wrap


SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its declared schema (no inference job)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------- scoring tables
RULES = (
    Rule("disc", 0.9, 0.05, "composition"),
    Rule("qty", 0.9, None, "marker"),
    Rule("price", 0.6, None, "marker"),
    Rule("tax", 0.95, None, "composition"),
)
MODELS = tuple(r.model for r in RULES)


def truth(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    pr = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("entity_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.date_format("o_orderdate", "yyyy-MM").alias("block"),
        F.date_format("o_orderdate", "yyyy").alias("source"),
        pr.alias("stratum"),
        F.when(pr.isin("1-URGENT", "2-HIGH"), "high").otherwise("low").alias("arm"),
        F.floor("o_totalprice").cast("bigint").alias("length"),
        F.when(pr == "1-URGENT", "kraken2:Homo sapiens (taxid 9606)")
        .when(pr == "2-HIGH", "kraken2:Lactobacillus crispatus (taxid 47770)")
        .when(pr == "3-MEDIUM", "checkv:0_viral_genes").otherwise("").alias("notes"),
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Long prediction rows (several per order: one per line item), one scan of lineitem."""
    li = table(spark, d, "lineitem")
    none = F.lit(None).cast("double")
    cell = lambda m, s, p, ok: F.struct(F.lit(m).alias("model"), s.alias("score"), p.alias("pvalue"), ok.alias("ok"))
    cells = F.array(
        cell("disc", F.col("l_discount") * 10.0, F.col("l_tax"), F.lit(True)),
        cell("qty", F.col("l_quantity") / 50.0, none, F.lit(True)),
        cell("price", F.col("l_extendedprice") / 131072.0, none, F.col("l_extendedprice") >= 20000.0),
        cell("tax", F.col("l_tax") * 12.5, none, F.lit(True)),
    )
    rows = li.select(F.col("l_orderkey").alias("entity_id"), F.inline(cells))
    return rows.filter("ok").drop("ok")


def calls(spark: SparkSession, d: str) -> DataFrame:
    return dense_calls(truth(spark, d), predictions(spark, d), RULES)


_TRUTH = """
truth AS (
  SELECT o_orderkey AS entity_id, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
         strftime(o_orderdate, '%Y-%m') AS block, strftime(o_orderdate, '%Y') AS source,
         o_orderpriority AS stratum,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'low' END AS arm,
         CAST(floor(o_totalprice) AS BIGINT) AS length,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'kraken2:Homo sapiens (taxid 9606)'
              WHEN '2-HIGH' THEN 'kraken2:Lactobacillus crispatus (taxid 47770)'
              WHEN '3-MEDIUM' THEN 'checkv:0_viral_genes' ELSE '' END AS notes
  FROM orders)"""
_CALLS = """,
models(model, threshold, pvalue_below, family) AS (
  VALUES ('disc', 0.9::DOUBLE, 0.05::DOUBLE, 'composition'), ('qty', 0.9::DOUBLE, NULL::DOUBLE, 'marker'),
         ('price', 0.6::DOUBLE, NULL::DOUBLE, 'marker'), ('tax', 0.95::DOUBLE, NULL::DOUBLE, 'composition')),
raw AS (
  SELECT l_orderkey AS entity_id, 'disc' AS model, l_discount * 10.0::DOUBLE AS score, l_tax AS pvalue FROM lineitem
  UNION ALL SELECT l_orderkey, 'qty', l_quantity / 50.0::DOUBLE, NULL FROM lineitem
  UNION ALL SELECT l_orderkey, 'price', l_extendedprice / 131072.0::DOUBLE, NULL FROM lineitem WHERE l_extendedprice >= 20000
  UNION ALL SELECT l_orderkey, 'tax', l_tax * 12.5::DOUBLE, NULL FROM lineitem),
top AS (SELECT entity_id, model, max(score) AS score FROM raw GROUP BY ALL),
pred AS (SELECT t.entity_id, t.model, t.score, min(r.pvalue) AS pvalue
         FROM top t JOIN raw r ON t.entity_id = r.entity_id AND t.model = r.model AND t.score = r.score GROUP BY ALL),
grid AS (
  SELECT t.*, m.model, coalesce(p.score, 0.0::DOUBLE) AS score, coalesce(p.pvalue, 1.0::DOUBLE) AS pvalue,
         p.entity_id IS NOT NULL AS emitted, m.threshold, m.pvalue_below, m.family
  FROM truth t CROSS JOIN models m LEFT JOIN pred p ON p.entity_id = t.entity_id AND p.model = m.model),
calls AS (
  SELECT *, CAST(score >= threshold AND (pvalue_below IS NULL OR pvalue < pvalue_below) AS INTEGER) AS call FROM grid)
"""
W = "WITH " + _TRUTH + _CALLS
W_TRUTH = "WITH " + _TRUTH

COUNTS_SQL = """
 count(*) FILTER (WHERE label = 1 AND call = 1) AS tp, count(*) FILTER (WHERE label = 0 AND call = 1) AS fp,
 count(*) FILTER (WHERE label = 0 AND call = 0) AS tn, count(*) FILTER (WHERE label = 1 AND call = 0) AS fn"""
MCC_SQL = """coalesce((tp::DOUBLE * tn::DOUBLE - fp::DOUBLE * fn::DOUBLE)
 / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE), 0), 0)"""
METRICS_SQL = f"""
 coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
 tn / nullif(tn + fp, 0)::DOUBLE AS specificity, fp / nullif(fp + tn, 0)::DOUBLE AS fpr,
 coalesce(fp / nullif(tp + fp, 0)::DOUBLE, 1) AS fdr,
 coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, {MCC_SQL} AS mcc,
 tp + fp AS n_predicted, tp + fp + tn + fn AS n_total"""
M_DOUBLES = "precision recall specificity fpr fdr f1 mcc"


def metric_sql(keys: str, source: str = "calls", where: str = "TRUE") -> str:
    """Metric table over ``keys`` as SQL (without the WITH clause)."""
    return f"SELECT *, {METRICS_SQL} FROM (SELECT {keys}, {COUNTS_SQL} FROM {source} WHERE {where} GROUP BY ALL)"


def auprc_sql(keys: str, source: str) -> str:
    """Tie-collapsed AUPRC over ``keys`` of ``source`` (score, label)."""
    return f"""SELECT {keys}, CASE WHEN count(*) <= 1 THEN NULL WHEN sum(pos) = 0 THEN 0 ELSE sum(pos * cp / (cp + cn)::DOUBLE) / sum(pos) END AS auprc FROM (SELECT *, sum(pos) OVER w1 AS cp, sum(neg) OVER w1 AS cn
      FROM (SELECT {keys}, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {source} GROUP BY ALL) WINDOW w1 AS (PARTITION BY {keys} ORDER BY score DESC)) GROUP BY ALL"""


# ------------------------------------------------------------- evidence tables
def evidence_lines(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Six evidence line tables over orders and line items."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    key = F.col("l_orderkey").alias("entity_id")
    return {
        "e1a": li.filter(F.col("l_discount") >= 0.1).select(key),
        "e1b": li.filter(F.col("l_extendedprice") > 90000).select(key),
        "e2": o.filter(F.col("o_totalprice") > 400000).select(F.col("o_orderkey").alias("entity_id")),
        "e3": o.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).select(F.col("o_orderkey").alias("entity_id")),
        "e4": li.filter((F.col("l_tax") >= 0.08) & (F.col("l_returnflag") == "R")).select(key),
        "e5": li.filter(F.col("l_quantity") >= 48).select(key),
    }


def evidence_context(spark: SparkSession, d: str) -> DataFrame:
    """Context columns per entity: genes, taxon, family, region coordinates, spacer."""
    o = table(spark, d, "orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("entity_id"), F.floor("o_totalprice").cast("bigint").alias("length"),
        F.date_format("o_orderdate", "yyyy-MM").alias("block"),
        F.when(st == "O", 2).otherwise(0).alias("host_genes"),
        F.when((st == "O") & (pr == "5-LOW"), 1).otherwise(0).alias("viral_genes"),
        F.when(pr.isin("3-MEDIUM", "5-LOW"), "Lactobacillus crispatus (taxid 47770)").alias("taxon"),
        F.when(pr == "2-HIGH", "Papillomaviridae").when(pr == "3-MEDIUM", "phage").otherwise("unknown").alias("family"),
        F.concat_ws("-", F.lit("10"), F.lit("900")).alias("coords"),
        F.concat(F.lit("arr_"), st).alias("spacer_id"),
    )


EVIDENCE_SQL = """WITH lines AS (
  SELECT l_orderkey AS entity_id, 'e1a' AS line FROM lineitem WHERE l_discount >= 0.1
  UNION SELECT l_orderkey, 'e1b' FROM lineitem WHERE l_extendedprice > 90000
  UNION SELECT o_orderkey, 'e2' FROM orders WHERE o_totalprice > 400000
  UNION SELECT o_orderkey, 'e3' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
  UNION SELECT l_orderkey, 'e4' FROM lineitem WHERE l_tax >= 0.08 AND l_returnflag = 'R'
  UNION SELECT l_orderkey, 'e5' FROM lineitem WHERE l_quantity >= 48),
ctx AS (
  SELECT o_orderkey AS entity_id, CAST(floor(o_totalprice) AS BIGINT) AS length,
    strftime(o_orderdate, '%Y-%m') AS block,
    CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END AS host_genes,
    CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS viral_genes,
    CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 'Lactobacillus crispatus (taxid 47770)' END AS taxon,
    CASE o_orderpriority WHEN '2-HIGH' THEN 'Papillomaviridae' WHEN '3-MEDIUM' THEN 'phage' ELSE 'unknown' END AS family,
    '10-900' AS coords, 'arr_' || o_orderstatus AS spacer_id
  FROM orders),
ev AS (
  SELECT c.*, coalesce(bool_or(line = 'e1a'), false) AS e1a, coalesce(bool_or(line = 'e1b'), false) AS e1b,
    coalesce(bool_or(line = 'e2'), false) AS e2, coalesce(bool_or(line = 'e3'), false) AS e3,
    coalesce(bool_or(line = 'e4'), false) AS e4, coalesce(bool_or(line = 'e5'), false) AS e5
  FROM ctx c LEFT JOIN lines l ON l.entity_id = c.entity_id GROUP BY ALL)"""


def tier_sql(n: str, e1a: str = "e1a", e1b: str = "e1b", e4: str = "e4", e5: str = "e5") -> str:
    """Tier and category expressions for a count expression ``n``."""
    return f"""{n} AS n_evidence,
    CASE WHEN {n} >= 3 THEN 1 WHEN {n} = 2 THEN 2 WHEN {n} = 1 THEN 3
         WHEN host_genes > 0 AND viral_genes = 0 OR taxon IS NOT NULL THEN 0 ELSE -1 END AS tier,
    CASE WHEN {n} = 0 AND (host_genes > 0 AND viral_genes = 0 OR taxon IS NOT NULL) THEN 'bacterial'
         WHEN {n} = 0 THEN 'ambiguous' WHEN e3 THEN 'prophage'
         WHEN {e1a} AND family NOT IN ('phage', 'unknown') THEN 'eukaryotic_virus' ELSE 'free_phage' END AS category"""


N_STD = "((e1a OR e1b)::INT + e2::INT + e3::INT + e4::INT + e5::INT)"
TIERS_SQL = EVIDENCE_SQL + f", tiers AS (SELECT *, {tier_sql(N_STD)} FROM ev)"


# ------------------------------------------------------------ enrichment tables
def libraries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coverage of two libraries per order and their sizes (one row)."""
    li = table(spark, d, "lineitem")
    cov = lambda s: li.filter(F.col("l_linestatus") == s).groupBy(F.col("l_orderkey").alias("entity_id")).agg(
        (F.sum("l_quantity") / 10.0).alias("depth"), (F.count("*") * 1000).alias("length")
    )
    size = li.agg(F.count_if(F.col("l_linestatus") == "O").alias("n_a"), F.count_if(F.col("l_linestatus") == "F").alias("n_b"))
    return cov("O"), cov("F"), size


def quality_context(spark: SparkSession, d: str) -> DataFrame:
    """Quality and taxonomy of the orders that these tables list; open low-priority orders are in neither."""
    o = table(spark, d, "orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.filter((pr != "5-LOW") | (st == "F")).select(
        F.col("o_orderkey").alias("entity_id"), F.date_format("o_orderdate", "yyyy-MM").alias("block"),
        F.when(pr == "1-URGENT", "Complete").when(pr == "2-HIGH", "High-quality").when(pr == "3-MEDIUM", "Low-quality").otherwise("Not-determined").alias("quality"),
        F.when(st == "P", 1).otherwise(0).alias("viral_genes"), F.when(pr == "4-NOT SPECIFIED", 3).otherwise(0).alias("host_genes"),
        F.when((st == "F") & (pr == "5-LOW"), "Yes").otherwise("No").alias("provirus"), (st != "O").alias("classified"),
        F.when(st == "F", "Bacteria").when(st == "O", "unclassified").otherwise("Viruses").alias("domain"),
        F.when(st == "F", "Escherichia coli (taxid 562)").when(st == "O", "unclassified").otherwise("Papillomaviridae").alias("taxon"),
    )


LIBRARY_SQL = """WITH a AS (SELECT l_orderkey AS entity_id, sum(l_quantity) / 10.0::DOUBLE AS depth, count(*) * 1000 AS length
      FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
b AS (SELECT l_orderkey AS entity_id, sum(l_quantity) / 10.0::DOUBLE AS depth, count(*) * 1000 AS length
      FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
size AS (SELECT count(*) FILTER (WHERE l_linestatus = 'O') AS n_a, count(*) FILTER (WHERE l_linestatus = 'F') AS n_b FROM lineitem),
j AS (SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, greatest(coalesce(a.length, 0), coalesce(b.length, 0)) AS length,
        coalesce(a.depth, 0::DOUBLE) AS depth_a, coalesce(b.depth, 0::DOUBLE) AS depth_b
      FROM a FULL OUTER JOIN b ON a.entity_id = b.entity_id),
r AS (SELECT j.*, CASE WHEN depth_a > 0 THEN depth_b / depth_a WHEN depth_b > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS ratio_raw,
        CASE WHEN depth_a > 0 THEN (depth_b * n_a) / (depth_a * n_b) WHEN depth_b > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS ratio
      FROM j, size),
enriched AS (SELECT *, CASE WHEN ratio > 10 THEN 'enriched' WHEN ratio > 0.5 AND ratio < 2 THEN 'background'
        WHEN ratio <= 0.5 THEN 'depleted' ELSE 'moderate' END AS enrichment_class FROM r),
q AS (SELECT o_orderkey AS entity_id, strftime(o_orderdate, '%Y-%m') AS block,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Complete' WHEN '2-HIGH' THEN 'High-quality' WHEN '3-MEDIUM' THEN 'Low-quality' ELSE 'Not-determined' END AS quality,
    CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS viral_genes, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 3 ELSE 0 END AS host_genes,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'Yes' ELSE 'No' END AS provirus, o_orderstatus <> 'O' AS classified,
    CASE o_orderstatus WHEN 'F' THEN 'Bacteria' WHEN 'O' THEN 'unclassified' ELSE 'Viruses' END AS domain,
    CASE o_orderstatus WHEN 'F' THEN 'Escherichia coli (taxid 562)' WHEN 'O' THEN 'unclassified' ELSE 'Papillomaviridae' END AS taxon
    FROM orders WHERE o_orderpriority <> '5-LOW' OR o_orderstatus = 'F'),
lab AS (SELECT *, (quality IN ('Medium-quality', 'High-quality', 'Complete') OR viral_genes >= 1 OR provirus = 'Yes') AS is_viral
  FROM (SELECT e.entity_id, e.length, e.depth_a, e.depth_b, e.ratio, e.enrichment_class, block, coalesce(quality, 'Not-determined') AS quality, coalesce(viral_genes, 0) AS viral_genes,
      coalesce(host_genes, 0) AS host_genes, coalesce(provirus, 'No') AS provirus, coalesce(classified, false) AS classified, coalesce(domain, 'unknown') AS domain, coalesce(taxon, 'unclassified') AS taxon
    FROM enriched e LEFT JOIN q ON e.entity_id = q.entity_id))"""


# ------------------------------------------------------------------ alignments
def hit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line items read as alignment hits: supplier = query, return flag = subject, days = positions."""
    li = table(spark, d, "lineitem")
    start = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("bigint") + 1
    return li.select(
        F.col("l_suppkey").alias("qseqid"), F.col("l_returnflag").alias("sseqid"),
        (100.0 - 100.0 * F.col("l_discount")).alias("pident"), F.col("l_quantity").cast("bigint").alias("length"),
        start.alias("qstart"), (start + F.col("l_quantity").cast("bigint") - 1).alias("qend"),
        (F.col("l_partkey") % 1000 + 1).alias("sstart"), (F.col("l_partkey") % 1000 + F.col("l_quantity").cast("bigint")).alias("send"),
        F.col("l_tax").alias("evalue"), F.col("l_extendedprice").alias("bitscore"),
        F.lit(3000).cast("bigint").alias("qlen"), F.lit(2000).cast("bigint").alias("slen"),
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"),
                    F.lpad(F.col("l_partkey").cast("string"), 10, "0"), F.col("l_linestatus")).alias("line_no"),
    )


HITS_SQL = """WITH hits AS (
  SELECT l_suppkey AS qseqid, l_returnflag AS sseqid, 100.0::DOUBLE - 100.0::DOUBLE * l_discount AS pident, CAST(l_quantity AS BIGINT) AS length,
    date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 1 AS qstart,
    date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS qend,
    l_partkey % 1000 + 1 AS sstart, l_partkey % 1000 + CAST(l_quantity AS BIGINT) AS send,
    l_tax AS evalue, l_extendedprice AS bitscore, 3000::BIGINT AS qlen, 2000::BIGINT AS slen,
    concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber::VARCHAR, lpad(l_partkey::VARCHAR, 10, '0'), l_linestatus) AS line_no
  FROM lineitem)"""
