"""Readers, sinks, id handling and text rules. Text inputs are derived from the tables:
either as line DataFrames, or written out and read back through the file readers."""

from pyspark.sql import functions as F

from scoreloom.catalog.base import MCC_SQL, register, table
from scoreloom.functions import rules as R
from scoreloom.functions import scalars as X
from scoreloom.operators import decide as D
from scoreloom.operators import ordered as O
from scoreloom.sources import biology as BIO
from scoreloom.sources import files as FI
from scoreloom.sources import predictions as P
from scoreloom.sources import sinks as SK
from scoreloom.sources import text as TX
from scoreloom.sources.scratch import scratch_dir

s = lambda c: F.col(c).cast("string")
tabs = lambda *cols: F.concat_ws("\t", *cols)


def lines(df, *cols, order):
    """(value, line_no) lines of a table; ``order`` gives the file position."""
    return df.select(tabs(*cols).alias("value"), *[F.col(c) for c in order])


# --------------------------------------------------------------------- scans and sinks
@register("table_round_trip", "A1 A25", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", "c_acctbal")
def table_round_trip(spark, d):
    path = scratch_dir(spark) + "/t"
    SK.write_table(table(spark, d, "customer"), path, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    return TX.read_table(spark, path, {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double", "c_mktsegment": "string"})


@register(
    "gzip_table_selected_models", "A3 A19", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P')", "o_totalprice",
)
def gzip_table_selected_models(spark, d):
    path = scratch_dir(spark) + "/t"
    SK.write_table(table(spark, d, "orders"), path, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], gzip=True)
    got = TX.read_table(spark, path, {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double"})
    return got.filter(F.col("o_orderstatus").isin("F", "P")).drop("o_orderstatus")


@register(
    "commented_lines", "A2 A4",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'", "o_totalprice",
)
def commented_lines(spark, d):
    """'#' lines, blank lines and short rows are skipped."""
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    v = (
        F.when(st == "F", F.concat(F.lit("# "), s("o_orderkey"))).when(st == "P", "")
        .when(pr == "5-LOW", s("o_orderkey")).otherwise(tabs(s("o_orderkey"), s("o_totalprice")))
    )
    return TX.parse_headerless(table(spark, d, "orders").select(v.alias("value")), (("o_orderkey", "bigint"), ("o_totalprice", "double")))


@register(
    "multi_panel_lines", "A2 E8",
    """SELECT panel, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT o_orderkey AS k, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS mark,
      last_value(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'P' || o_orderkey END IGNORE NULLS) OVER (ORDER BY o_orderkey) AS panel FROM orders) WHERE NOT mark GROUP BY panel""",
)
def multi_panel_lines(spark, d):
    mark = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    v = F.when(mark, F.concat(F.lit("## Panel P"), s("o_orderkey"))).otherwise(s("o_orderkey"))
    src = table(spark, d, "orders").select(v.alias("value"), F.col("o_orderkey").alias("line_no"), F.lit("one").alias("file"))
    return TX.panels(src).groupBy("panel").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("bigint")).alias("total"))


_LI = ("l_orderkey", "l_linenumber", "l_partkey")


@register(
    "hit_table_scan", "A4",
    "SELECT l_suppkey::VARCHAR AS qseqid, l_returnflag AS sseqid, count(*) AS n, sum(l_discount) AS pident, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS length, sum(l_extendedprice) AS bitscore FROM lineitem GROUP BY ALL",
    "pident bitscore",
)
def hit_table_scan(spark, d):
    q = F.col("l_quantity").cast("bigint").cast("string")
    z = F.lit("1")
    li = table(spark, d, "lineitem")
    v = tabs(s("l_suppkey"), F.col("l_returnflag"), s("l_discount"), q, z, z, z, q, z, q, s("l_tax"), s("l_extendedprice"), z, z)
    h = BIO.hits(li.select(v.alias("value"), *_LI))
    return h.groupBy("qseqid", "sseqid").agg(F.count("*").alias("n"), F.sum("pident").alias("pident"), F.sum("length").alias("length"), F.sum("bitscore").alias("bitscore"))


@register(
    "protein_best_hits", "A5 B14 E5 B17",
    """SELECT qseqid, bitscore, length, CASE WHEN st = 'F' THEN 'Papillomaviridae' WHEN st = 'O' THEN 'phage' ELSE 'unknown' END AS family FROM (SELECT l_suppkey::VARCHAR AS qseqid, l_extendedprice AS bitscore, CAST(l_quantity AS BIGINT) AS length, l_linestatus AS st,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_partkey::VARCHAR, 10, '0') || l_linenumber) AS rn FROM lineitem WHERE CAST(l_quantity AS BIGINT) >= 30) WHERE rn = 1""",
    "bitscore",
)
def protein_best_hits(spark, d):
    q = F.col("l_quantity").cast("bigint").cast("string")
    z = F.lit("1")
    title = F.when(F.col("l_linestatus") == "F", "E6 protein [Human papillomavirus type 16]").otherwise("capsid [Lactobacillus phage LL-H]")
    li = table(spark, d, "lineitem")
    v = tabs(s("l_suppkey"), F.col("l_returnflag"), s("l_discount"), q, z, z, z, q, z, q, s("l_tax"), s("l_extendedprice"), title)
    pos = F.concat(F.lpad(s("l_orderkey"), 12, "0"), F.lpad(s("l_partkey"), 10, "0"), s("l_linenumber"))
    rows = BIO.protein_hits(li.select(v.alias("value"), pos.alias("line_no")))
    best = BIO.best_protein_hit(rows, min_length=30)
    return best.select("qseqid", "bitscore", "length", R.family_of_title("stitle").alias("family"))


@register(
    "paf_scan", "A6 D31",
    "SELECT l_suppkey::VARCHAR AS query, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS aligned, max(CASE WHEN l_returnflag = 'N' THEN 50.0::DOUBLE ELSE 100.0::DOUBLE * (1 - l_discount) END) AS best FROM lineitem GROUP BY ALL",
    "best",
)
def paf_scan(spark, d):
    q = F.col("l_quantity").cast("bigint")
    z = F.lit("0")
    tag = F.when(F.col("l_returnflag") == "N", "tp:A:P").otherwise(F.concat(F.lit("de:f:"), s("l_discount")))
    v = tabs(s("l_suppkey"), F.lit("100"), z, q.cast("string"), F.lit("+"), F.col("l_returnflag"), F.lit("500"), z, q.cast("string"), F.lit("50"), F.lit("100"), F.lit("60"), F.lit("NM:i:1"), tag)
    rows = BIO.paf(table(spark, d, "lineitem").select(v.alias("value")))
    return rows.groupBy("query").agg(F.sum("aligned").alias("aligned"), F.max("pident").alias("best"))


@register(
    "ani_table_best", "A7 E5",
    "SELECT query, ref, ani, af_shorter FROM (SELECT o_custkey::VARCHAR AS query, o_orderkey::VARCHAR AS ref, o_totalprice / 8192 AS ani, greatest(o_totalprice / 16384, 20.0) AS af_shorter, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 8192 DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "ani af_shorter",
)
def ani_table_best(spark, d):
    o = table(spark, d, "orders").select(
        F.concat(s("o_orderkey"), F.lit(" ref")).alias("Ref_name"), F.concat(s("o_custkey"), F.lit(" query")).alias("Query_name"),
        (F.col("o_totalprice") / 8192).cast("string").alias("ANI"), (F.col("o_totalprice") / 16384).cast("string").alias("Align_fraction_ref"), F.lit("20.0").alias("Align_fraction_query"), s("o_orderkey").alias("line_no"),
    )
    return BIO.ani_best(o, order="line_no").select("query", "ref", "ani", "af_shorter")


_LET = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def sequence_records(spark, d):
    docs = table(spark, d, "documents")
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    head = F.concat(F.lit("doc_"), s("doc_id"), F.lit(" label="), F.col("lang"), F.lit(" src="), F.col("source"))
    return docs.select(F.concat(F.lit("doc_"), s("doc_id")).alias("id"), head.alias("header"), seq.alias("seq"), F.length(seq).alias("length"))


@register(
    "fasta_round_trip", "A8 A9 A27",
    f"SELECT 'doc_' || doc_id AS id, lang AS label, CAST(length({_LET}) AS INTEGER) AS length, md5({_LET}) AS digest FROM documents",
)
def fasta_round_trip(spark, d):
    path = scratch_dir(spark) + "/seqs"
    SK.write_fasta(sequence_records(spark, d), path)
    return TX.read_fasta(spark, path).select("id", TX.header_tag("header", "label").alias("label"), "length", F.md5("seq").alias("digest"))


@register(
    "fasta_subset_trimmed", "A27 C12 A31",
    f"SELECT 'doc_' || d.doc_id AS id, CAST(length(CASE WHEN toxic = 1 THEN substr({_LET}, 1, 100) ELSE {_LET} END) AS INTEGER) AS length FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1",
)
def fasta_subset_trimmed(spark, d):
    """Wanted ids only; the trimmed version of a sequence wins over the full one."""
    seqs = sequence_records(spark, d)
    lab = table(spark, d, "labels").withColumn("id", F.concat(F.lit("doc_"), s("doc_id")))
    trimmed = seqs.join(lab.filter("toxic = 1").select("id"), "id", "left_semi").withColumn("seq", F.substring("seq", 1, 100)).withColumn("length", F.length("seq"))
    return SK.fasta_subset(seqs, lab.filter("quality = 1"), preferred=trimmed).select("id", "length")


@register(
    "prefixed_sequences", "A30 B13", f"SELECT source || '__doc_' || doc_id AS id, CAST(length({_LET}) AS INTEGER) AS length FROM documents WHERE length({_LET}) >= 500",
)
def prefixed_sequences(spark, d):
    seqs = sequence_records(spark, d).withColumn("sample", F.regexp_extract("header", r"src=(\S+)", 1))
    return SK.prefixed(seqs, F.col("sample"), min_length=500).select("id", "length")


@register(
    "quality_table_scan", "A10 B15",
    """SELECT contig_id, completeness, array_to_string(list_filter([CASE WHEN quality IN ('Medium-quality', 'High-quality', 'Complete') THEN 'quality:' || quality END, CASE WHEN st = 'P' THEN 'provirus:Yes' END, CASE WHEN genes >= 1 THEN 'viral_genes:' || genes END], lambda x: x IS NOT NULL), ';') AS reasons FROM (
      SELECT o_orderkey::VARCHAR AS contig_id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice / 8192 END AS completeness, o_orderstatus AS st, CASE o_orderpriority WHEN '1-URGENT' THEN 'Complete' WHEN '2-HIGH' THEN 'Medium-quality' ELSE 'Low-quality' END AS quality,
        CASE WHEN o_orderpriority = '5-LOW' THEN 2 ELSE 0 END AS genes FROM orders)""",
    "completeness",
)
def quality_table_scan(spark, d):
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    raw = table(spark, d, "orders").select(
        s("o_orderkey").alias("contig_id"), F.lit("100").alias("contig_length"),
        F.when(pr == "1-URGENT", "Complete").when(pr == "2-HIGH", "Medium-quality").otherwise("Low-quality").alias("checkv_quality"),
        F.when(st == "F", "NA").otherwise((F.col("o_totalprice") / 8192).cast("string")).alias("completeness"),
        F.when(st == "P", "Yes").otherwise("No").alias("provirus"), F.when(pr == "5-LOW", "2").otherwise("NA").alias("viral_genes"), F.lit("").alias("host_genes"),
    )
    q = BIO.quality_table(raw)
    return q.select("contig_id", "completeness", F.concat_ws(";", R.quality_reasons("checkv_quality", "viral_genes", "provirus")).alias("reasons"))


# Taxonomy: orders as assignment lines, customers as an ordered report.
_REP = """WITH rep AS (SELECT c_custkey::VARCHAR AS taxid, last_value(CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END IGNORE NULLS) OVER (ORDER BY c_custkey) AS domain,
   CASE c_mktsegment WHEN 'BUILDING' THEN 'D' WHEN 'MACHINERY' THEN 'R' ELSE 'G' END AS rank FROM customer), dom AS (SELECT taxid, domain FROM rep WHERE rank <> 'R' AND domain IS NOT NULL)"""


def report(spark, d):
    seg = F.col("c_mktsegment")
    rank = F.when(seg == "BUILDING", "D").when(seg == "MACHINERY", "R").otherwise("G")
    v = tabs(F.lit("0.1"), F.lit("1"), F.lit("1"), rank, s("c_custkey"), F.concat(F.lit("  "), F.col("c_name")))
    return BIO.taxon_report(table(spark, d, "customer").select(v.alias("value"), F.col("c_custkey").alias("line_no"), F.lit("report").alias("file")))


@register("taxon_report_domains", "A12 E8", _REP + " SELECT * FROM dom")
def taxon_report_domains(spark, d):
    return report(spark, d)


@register(
    "taxon_domain_assignment", "A11 J4 B16 E8",
    _REP + """ SELECT o_orderkey::VARCHAR AS contig_id, o_orderstatus <> 'F' AS classified, CASE WHEN o_orderstatus = 'F' THEN 'unclassified' WHEN domain IS NOT NULL THEN domain WHEN o_orderpriority = '1-URGENT' THEN 'Viruses' ELSE 'Bacteria' END AS domain,
      o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' AS negative_taxon FROM orders LEFT JOIN dom ON taxid = o_custkey::VARCHAR""",
)
def taxon_domain_assignment(spark, d):
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "Caudoviricetes sp. phage").otherwise("Lactobacillus crispatus")
    v = tabs(F.when(F.col("o_orderstatus") == "F", "U").otherwise("C"), s("o_orderkey"), F.concat(name, F.lit(" (taxid "), s("o_custkey"), F.lit(")")), F.lit("10"))
    a = BIO.taxon_assignments(table(spark, d, "orders").select(v.alias("value")))
    from scoreloom.operators.labelling import assign_domain

    out = assign_domain(a, report(spark, d))
    return out.select("contig_id", "classified", "domain", (F.col("classified") & ~R.is_viral_taxon("taxon")).alias("negative_taxon"))


def array_docs(spark, d):
    """One nested JSON document per line item: two arrays of two spacers each."""
    li = table(spark, d, "lineitem")
    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    region = lambda kind, seq: F.struct(F.lit(kind).alias("Type"), seq.alias("Sequence"))
    rep = lambda base, n: F.repeat(F.lit(base), n)

    def arr(level, one, two):
        regions = F.array(region("DR", F.lit("GTT")), region("Spacer", one), region("DR", F.lit("GTT")), region("Spacer", two))
        return F.struct(F.col("l_partkey").alias("Start"), (F.col("l_partkey") + q).alias("End"), level.cast("int").alias("Evidence_Level"), regions.alias("Regions"))

    arrays = F.array(arr(F.col("l_suppkey") % 5, rep("A", q), rep("C", k * 5)), arr(k, rep("G", k * 6), rep("T", q)))
    doc = F.to_json(F.struct(F.array(F.struct(_id().alias("Id"), arrays.alias("Crisprs"))).alias("Sequences")))
    return li.select(doc.alias("json")).select(F.from_json("json", TX.CRISPR_SCHEMA).alias("j")).select("j.*")


_ARR = """WITH i AS (SELECT concat_ws('_', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR) AS contig_id, l_partkey AS start, l_partkey + CAST(l_quantity AS INTEGER) AS "end",
   CAST(l_suppkey % 5 AS INTEGER) AS lv, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS k FROM lineitem),
 a AS (SELECT contig_id, contig_id || '_CRISPR_1' AS array_id, start, "end", lv AS evidence_level, q AS s1, k * 5 AS s2 FROM i
   UNION ALL SELECT contig_id, contig_id || '_CRISPR_2', start, "end", k, k * 6, q FROM i)"""


@register(
    "nested_array_scan", "A13 J10",
    _ARR + """ SELECT contig_id, array_id, start, "end", CAST((s1 >= 25)::INT + (s2 >= 25)::INT AS INTEGER) AS n_spacers, CAST((s1 < 25)::INT + (s2 < 25)::INT AS INTEGER) AS n_spacers_skipped, evidence_level FROM a WHERE evidence_level >= 2""",
)
def nested_array_scan(spark, d):
    return TX.crispr_arrays(array_docs(spark, d))[0]


@register(
    "nested_spacer_scan", "A13 J10",
    _ARR + """ SELECT array_id || '_spacer_' || n AS spacer_id, len FROM (SELECT array_id, 1 AS n, s1 AS len FROM a WHERE evidence_level >= 2 AND s1 >= 25
      UNION ALL SELECT array_id, CASE WHEN s1 >= 25 THEN 2 ELSE 1 END, s2 FROM a WHERE evidence_level >= 2 AND s2 >= 25)""",
)
def nested_spacer_scan(spark, d):
    return TX.crispr_arrays(array_docs(spark, d))[1].select("spacer_id", F.length("sequence").alias("len"))


@register(
    "event_props_json", "A13 M",
    "SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type",
)
def event_props_json(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k BIGINT").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@register(
    "region_table_coords", "A14",
    "SELECT l_suppkey::VARCHAR AS contig_id, string_agg(b || '-' || e, ';' ORDER BY b, e) AS coords FROM (SELECT DISTINCT l_suppkey, l_linenumber AS b, l_linenumber + CAST(l_quantity AS BIGINT) AS e FROM lineitem) GROUP BY l_suppkey",
)
def region_table_coords(spark, d):
    li = table(spark, d, "lineitem").select(
        s("l_suppkey").alias("scaffold"), s("l_linenumber").alias("begin"), (F.col("l_linenumber") + F.col("l_quantity").cast("bigint")).cast("string").alias("stop")
    )
    return BIO.region_coords(BIO.prophage_regions(li))


@register(
    "flagstat_mapped", "A15",
    "SELECT o_custkey AS file, coalesce(nullif(max(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 0), max(o_orderkey) FILTER (WHERE o_orderstatus = 'O'), 0) AS mapped_reads FROM orders GROUP BY o_custkey",
)
def flagstat_mapped(spark, d):
    k = s("o_orderkey")
    v = F.when(F.col("o_orderstatus") == "F", F.concat(k, F.lit(" + 0 primary mapped (98% : N/A)"))).when(
        F.col("o_orderstatus") == "O", F.concat(k, F.lit(" + 0 mapped (99% : N/A)"))).otherwise(F.concat(k, F.lit(" + 0 in total")))
    return BIO.flagstat_mapped(table(spark, d, "orders").select(F.col("o_custkey").alias("file"), v.alias("value")))


@register(
    "coverage_table_scan", "A15", "SELECT o_orderkey::VARCHAR AS entity_id, o_custkey AS length, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS depth FROM orders", "depth",
)
def coverage_table_scan(spark, d):
    raw = table(spark, d, "orders").select(
        s("o_orderkey").alias("#rname"), s("o_custkey").alias("endpos"), F.lit("1").alias("numreads"), F.lit("5.5").alias("coverage"),
        F.when(F.col("o_orderstatus") == "F", "NA").otherwise(s("o_totalprice")).alias("meandepth"),
    )
    return BIO.coverage_table(raw).select("entity_id", "length", "depth")


@register(
    "gene_family_map", "A16 J17 B20 E5",
    """WITH f AS (SELECT l_suppkey, 'fam_' || l_returnflag || l_linestatus AS fam, max(l_extendedprice) AS sc FROM lineitem GROUP BY ALL)
    SELECT 'g' || l_suppkey AS gene, string_agg(fam, ';' ORDER BY sc DESC, fam DESC) AS families, CASE WHEN bool_or(fam = 'fam_RO') THEN 'Plasmid replication / mobilisation' WHEN bool_or(fam LIKE 'fam_A%') THEN 'Phage-type domain' ELSE 'Other Pfam domain' END AS class FROM f GROUP BY l_suppkey""",
)
def gene_family_map(spark, d):
    """Domain lines -> families per gene, best score first, and the gene's class."""
    li = table(spark, d, "lineitem")
    fam = F.concat(F.lit("fam_"), F.col("l_returnflag"), F.col("l_linestatus"))
    z = F.lit("-")
    v = F.concat_ws("   ", fam, F.lit("PF1"), F.lit("100"), F.concat(F.lit("g"), s("l_suppkey")), z, F.lit("300"), s("l_tax"), F.lit("7.5"), z, F.lit("1"), F.lit("1"), z, z, s("l_extendedprice"), z, F.lit("1"), F.lit("90"))
    genes = BIO.gene_families(BIO.domain_hits(li.select(v.alias("value"))))
    cls = R.domain_class(F.col("families"), ("fam_RO",), (), "fam_A")
    return genes.select("gene", F.concat_ws(";", "families").alias("families"), cls.alias("class"))


@register(
    "screen_rows", "A17 B31",
    "SELECT p_partkey::VARCHAR AS name, p_retailprice AS identity, CAST(p_size AS BIGINT) AS shared_hashes FROM part WHERE p_size >= 25", "identity",
)
def screen_rows(spark, d):
    v = tabs(s("p_retailprice"), F.concat(s("p_size"), F.lit("/50")), F.lit("2"), F.lit("0"), s("p_partkey"), F.lit("comment"))
    r = BIO.screen_rows(table(spark, d, "part").select(v.alias("value")))
    return r.filter(F.col("shared_hashes") / F.col("total_hashes") >= 0.5).select("name", "identity", "shared_hashes")


@register(
    "metadata_rule_counts", "A19 D27 B22",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE p_brand = 'Brand#1') AS brand_one, count(*) FILTER (WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')) AS brand_set, count(*) FILTER (WHERE p_type = 'PROMO' AND p_size > 20) AS promo_large FROM part""",
)
def metadata_rule_counts(spark, d):
    """Overlapping rules over a parsed rank path, counted in one pass."""
    path = F.concat(F.lit("d__"), F.col("p_type"), F.lit(";g__"), F.col("p_brand"), F.lit(";s__"), F.col("p_name"))
    meta = table(spark, d, "part").select(path.alias("lineage"), "p_size")
    g, dom = R.host_rank("lineage", "g"), R.host_rank("lineage", "d")
    return BIO.rule_counts(meta, {
        "brand_one": g == "Brand#1", "brand_set": g.isin("Brand#1", "Brand#2", "Brand#3"), "promo_large": (dom == "PROMO") & (F.col("p_size") > 20),
    })


@register(
    "member_map", "A20", "SELECT member, count(*) AS n_parents, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (SELECT o_orderkey, o_orderpriority AS member FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') GROUP BY member",
)
def member_map(spark, d):
    """A comma-separated member column with blanks and empty entries -> (member, parent) rows."""
    listed = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" , "), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")))
    m = TX.members(table(spark, d, "orders").select("o_orderkey", listed.alias("members")), "o_orderkey", "members")
    return m.groupBy("member").agg(F.count("*").alias("n_parents"), F.sum("parent").alias("key_sum"))


@register(
    "cohort_run_list", "A21",
    "SELECT p_type AS cohort, p_partkey::VARCHAR AS run, 'r' || p_partkey || '_1.fq.gz' AS r1_file, 'r' || p_partkey || '_2.fq.gz' AS r2_file, CASE p_brand WHEN 'Brand#1' THEN 'reference' WHEN 'Brand#2' THEN 'background' ELSE p_brand END AS role FROM part WHERE p_type IN ('PROMO', 'SMALL')",
)
def cohort_run_list(spark, d):
    url = lambda n: F.concat(F.lit("https://example.org/a/b/r"), s("p_partkey"), F.lit(f"_{n}.fq.gz"))
    runs = table(spark, d, "part").select(F.col("p_type").alias("cohort"), s("p_partkey").alias("run"), url(1).alias("R1"), url(2).alias("R2"), F.col("p_brand").alias("role"))
    return TX.run_list(runs, ["PROMO", "SMALL"], {"Brand#1": "reference", "Brand#2": "background"})


# ------------------------------------------------------------------ classifier outputs
ID_SQL = "concat_ws('_', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR)"


def _id():
    return F.concat_ws("_", s("l_orderkey"), s("l_linenumber"), s("l_partkey"))


def _reader(name, covers, make, sql, doubles="score pvalue"):
    def run(spark, d):
        return make(table(spark, d, "lineitem"))

    register(name, covers, sql, doubles)(run)


_SEL = lambda score, p="NULL::DOUBLE", ident=ID_SQL: f"SELECT {ident} AS entity_id, {score} AS score, {p} AS pvalue FROM lineitem"
_reader(
    "reader_deepvirfinder", "A22.1",
    lambda li: P.deepvirfinder(li.select(F.concat(_id(), F.lit(" len=5")).alias("name"), s("l_discount").alias("score"), F.when(F.col("l_returnflag") == "N", "").otherwise(s("l_tax")).alias("pvalue"))),
    _SEL("l_discount", "CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE l_tax END"),
)
_reader(
    "reader_virfinder", "A22.2",
    lambda li: P.virfinder(li.select(F.when(F.col("l_linestatus") == "O", tabs(_id(), F.lit("100"), s("l_discount"), s("l_tax"))).otherwise(
        F.concat_ws(" ", F.concat(F.lit('"'), s("l_linenumber"), F.lit('"')), F.concat(F.lit('"'), _id(), F.lit('"')), F.lit("100"), s("l_discount"), s("l_tax"))).alias("value"))),
    _SEL("l_discount", "l_tax"),
)
_reader("reader_pprmeta", "A22.3", lambda li: P.pprmeta(li.select(F.concat(F.lit(">"), _id(), F.lit(" x")).alias("Header"), s("l_discount").alias("phage_score"))), _SEL("l_discount"))
_reader("reader_seeker", "A22.4", lambda li: P.seeker(li.select(_id().alias("name"), F.col("l_returnflag").alias("prediction"), s("l_tax").alias("score"))), _SEL("l_tax"))
_reader(
    "reader_metaphinder", "A22.5",
    lambda li: P.metaphinder(li.select(_id().alias("#contigID"), F.when(F.col("l_returnflag") == "R", "Phage").otherwise("negative").alias("classification"))),
    _SEL("CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE"),
)
_reader("reader_sourmash", "A22.6", lambda li: P.sourmash(li.select(F.concat_ws(",", _id(), s("l_discount")).alias("value"))), _SEL("l_discount"))
_reader(
    "reader_genomad", "A22.7", lambda li: P.genomad(li.select(s("l_orderkey").alias("seq_name"), s("l_discount").alias("virus_score"))),
    "SELECT l_orderkey::VARCHAR AS entity_id, max(l_discount) AS score, NULL::DOUBLE AS pvalue FROM lineitem GROUP BY 1",
)
_reader(
    "reader_vibrant", "A22.8",
    lambda li: P.vibrant_calls(li.select(F.when(F.col("l_linestatus") == "O", F.concat(F.lit(">"), s("l_orderkey"), F.lit(" phage"))).otherwise(s("l_orderkey")).alias("value"), (F.col("l_linestatus") == "O").alias("is_fasta"))),
    "SELECT DISTINCT l_orderkey::VARCHAR AS entity_id, 1.0::DOUBLE AS score, NULL::DOUBLE AS pvalue FROM lineitem",
)
_reader(
    "reader_virsorter2", "A22.9",
    lambda li: P.virsorter2(li.select(s("l_orderkey").alias("seqname"), F.when(F.col("l_returnflag") == "N", "nan").otherwise(s("l_discount")).alias("max_score"))),
    "SELECT l_orderkey::VARCHAR AS entity_id, max(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_discount END) AS score, NULL::DOUBLE AS pvalue FROM lineitem GROUP BY 1",
)
_reader(
    "reader_hvseeker", "A22.11", lambda li: P.hvseeker(li.select(_id().alias("contig_id"), F.lit("900").alias("length"), s("l_tax").alias("viral_score"), F.lit("x").alias("prediction"))), _SEL("l_tax"),
)
_JG = ("l_discount", "l_tax", "l_quantity / 50", "l_linenumber / 7.0::DOUBLE")
_reader(
    "reader_jaeger", "A22.12 M",
    lambda li: P.jaeger(li.select(_id().alias("contig_id"), s("l_discount").alias("bacteria_score"), s("l_tax").alias("phage_score"),
                                  (F.col("l_quantity") / 50).cast("string").alias("eukarya_score"), (F.col("l_linenumber") / F.lit(7.0)).cast("string").alias("archaea_score"))),
    _SEL(f"exp({_JG[1]}) / ({' + '.join(f'exp({x})' for x in _JG)})"),
)
_reader("reader_transginmer", "A22.13", lambda li: P.transginmer(li.select(_id().alias("contig_id"), F.lit("9").alias("length"), s("l_discount").alias("viral_score"))), _SEL("l_discount"))
_reader(
    "reader_viralm", "A22.14",
    lambda li: P.viralm(li.select(_id().alias("contig_id"), F.when(F.col("l_returnflag") == "N", "").otherwise(s("l_tax")).alias("score"))),
    _SEL("l_tax") + " WHERE l_returnflag <> 'N'",
)


def _vs_id(sep):
    return F.concat(F.lit("NODE_"), s("o_orderkey"), F.lit("_cov_"), s("o_custkey"), F.lit(sep), F.substring("o_orderpriority", 1, 1))


@register(
    "reader_virsorter", "A22.10 B10 B11",
    """SELECT 'NODE_' || o_orderkey || '_cov_' || o_custkey || '.' || substr(o_orderpriority, 1, 1) AS entity_id, 1.0::DOUBLE - (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 0.15::DOUBLE AS score FROM orders WHERE o_orderstatus <> 'P'""",
    "score",
)
def reader_virsorter(spark, d):
    """Category headers with dots replaced, region and circular suffixes; ids resolved back."""
    o = table(spark, d, "orders")
    suffix = F.when(F.col("o_orderstatus") == "F", "-circular").otherwise("_gene_1_gene_9-100-900")
    head = F.concat(F.lit(">VIRSorter_"), _vs_id("_"), suffix, F.lit("-cat_"), F.substring("o_orderpriority", 1, 1))
    raw = P.virsorter_headers(o.filter(F.col("o_orderstatus") != "P").select(head.alias("value")))
    known = o.select(_vs_id(".").alias("entity_id"))
    out = D.resolve_ids(raw, known, F.col("candidates"), F.replace(F.col("entity_id"), F.lit("."), F.lit("_")))
    return out.groupBy(F.coalesce("resolved", "body").alias("entity_id")).agg(F.max("score").alias("score"))


@register(
    "region_folding", "B9 A22.7",
    """WITH k AS (SELECT o_orderkey::VARCHAR AS id FROM orders), r AS (SELECT l_orderkey::VARCHAR || CASE WHEN l_linestatus = 'O' THEN '|provirus_' || l_linenumber || '_99' ELSE '' END AS raw, l_orderkey::VARCHAR AS base, l_discount AS sc FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
    SELECT base AS entity_id, max(sc) AS score FROM r GROUP BY base""",
    "score",
)
def region_folding(spark, d):
    li = table(spark, d, "lineitem")
    raw = li.select(
        F.concat(s("l_orderkey"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("|provirus_"), s("l_linenumber"), F.lit("_99"))).otherwise("")).alias("entity_id"),
        F.col("l_discount").alias("score"),
    )
    known = table(spark, d, "orders").select(s("o_orderkey").alias("entity_id"))
    return D.fold_regions(raw, known, P.REGION_SUFFIX["geNomad"])


@register(
    "fallback_sources", "A23",
    """SELECT o_custkey AS grp, count(*) AS n, any_value(src) AS src FROM (SELECT o_custkey, CASE o_orderstatus WHEN 'P' THEN 'first' WHEN 'F' THEN 'second' ELSE 'third' END AS src, min(CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END) OVER (PARTITION BY o_custkey) AS best,
      CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS i FROM orders) WHERE i = best GROUP BY o_custkey""",
)
def fallback_sources(spark, d):
    """Per group only the first source that has rows."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), "o_orderstatus")
    parts = [o.filter(F.col("o_orderstatus") == st).select("grp", F.lit(n).alias("src")) for st, n in (("P", "first"), ("F", "second"), ("O", "third"))]
    return TX.first_nonempty(parts, ["grp"]).groupBy("grp").agg(F.count("*").alias("n"), F.min("src").alias("src"))


@register(
    "run_selection", "A24",
    "SELECT source AS grp, CASE WHEN source = 'src7' THEN max(lpad(doc_id::VARCHAR, 10, '0')) ELSE min(lpad(doc_id::VARCHAR, 10, '0')) END AS path FROM documents GROUP BY source",
)
def run_selection(spark, d):
    """One run per group: a recorded choice whose digest matches, else identical runs."""
    files = table(spark, d, "documents").select(F.col("source").alias("grp"), F.lpad(s("doc_id"), 10, "0").alias("path"), F.encode("source", "UTF-8").alias("content"))
    pick = files.filter(F.col("grp") == "src7").groupBy("grp").agg(F.max("path").alias("path")).select("path", F.sha2(F.encode(F.lit("src7"), "UTF-8"), 256).alias("sha256"))
    return TX.select_run(files, pick)


FOLDER_PARTS = 4


def array_files(spark, d):
    """One JSON document per 50 suppliers of a nation, written over many lines below the sample's folder; every seventh
    is cut off, as by a run that stopped."""
    sup = table(spark, d, "supplier")
    sample, part = F.col("s_nationkey"), F.floor(F.col("s_suppkey") / 50)
    region = lambda kind, base, n: F.struct(F.lit(kind).alias("Type"), F.repeat(F.lit(base), n).alias("Sequence"))
    arr = lambda level, one, two: F.struct(F.col("s_suppkey").alias("Start"), (F.col("s_suppkey") + 100).alias("End"), level.cast("int").alias("Evidence_Level"), F.array(region("DR", "GTT", F.lit(3)), region("Spacer", "A", one), region("Spacer", "C", two)).alias("Regions"))
    k = F.col("s_suppkey").cast("int")
    arrays = F.array(arr(k % 5, 20 + k % 11, 30 + k % 3), arr(4 - k % 5, 10 + k % 40, 24 + k % 2))
    # A folder of a few parts is written by one task, so that it is committed as a whole, and listed by one task. Small
    # files cost by their number: partitions go by folders, not by bytes, which would leave them to few tasks.
    rows = sup.withColumn("batch", F.floor(part / FOLDER_PARTS)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch")
    docs = rows.groupBy("batch", sample.alias("sample"), part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("s"), F.lpad(s("s_suppkey"), 10, "0")).alias("Id"), arrays.alias("Crisprs")))).alias("Sequences"))
    text = F.to_json(F.struct("Sequences"), {"pretty": "true"})
    cut = F.when((F.col("sample") + F.col("part")) % 7 == 3, F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))).otherwise(text)
    path = scratch_dir(spark) + "/arrays"
    docs.select("batch", "sample", "part", cut.alias("value")).write.partitionBy("batch", "sample", "part").text(path)
    return FI.read_documents(spark, path, TX.CRISPR_SCHEMA, glob="*.txt", tags={"sample": r"/sample=(\d+)/", "part": r"/part=(\d+)/"})


_AF = """WITH f AS (SELECT s_nationkey AS sample, s_suppkey // 50 AS part, s_suppkey AS k, 's' || lpad(s_suppkey::VARCHAR, 10, '0') AS contig_id, (s_nationkey + s_suppkey // 50) % 7 = 3 AS bad FROM supplier),
 a AS (SELECT sample, contig_id, contig_id || '_CRISPR_1' AS array_id, k AS start, k % 5 AS lv, 20 + k % 11 AS s1, 30 + k % 3 AS s2 FROM f WHERE NOT bad UNION ALL SELECT sample, contig_id, contig_id || '_CRISPR_2', k, 4 - k % 5, 10 + k % 40, 24 + k % 2 FROM f WHERE NOT bad)"""


@register(
    "nested_array_files", "A13 A23 J10",
    _AF + " SELECT sample::VARCHAR AS sample, array_id, start, CAST((s1 >= 25)::INT + (s2 >= 25)::INT AS INTEGER) AS n_spacers, CAST((s1 < 25)::INT + (s2 < 25)::INT AS INTEGER) AS n_spacers_skipped, CAST(lv AS INTEGER) AS evidence_level FROM a WHERE lv >= 2",
)
def nested_array_files(spark, d):
    """Arrays of real files, found at any depth, with the sample that their folder names."""
    arrays, _ = TX.crispr_arrays(array_files(spark, d).filter("_corrupt is null"), keep=("sample",))
    return arrays.select("sample", "array_id", "start", "n_spacers", "n_spacers_skipped", "evidence_level")


@register("corrupt_array_files", "A13 L4", _AF + " SELECT sample::VARCHAR AS sample, part::VARCHAR AS part FROM f WHERE bad GROUP BY ALL")
def corrupt_array_files(spark, d):
    """Files that hold no whole document."""
    bad = array_files(spark, d).filter("_corrupt is not null and (Sequences is null or size(Sequences) >= 0)")  # the reader wants a data column too
    return bad.select("sample", "part").distinct()


KINDS = (("combined_text", "kind=combined_text"), ("combined_sequences", "kind=combined_sequences"), ("sequences", "kind=sequences"))


@register(
    "discovered_outputs", "A23 A24",
    """WITH c AS (SELECT c_custkey AS k, c_custkey // 200 AS g FROM customer), r AS (SELECT k, g, unnest([1, 2]) AS run, unnest([k, CASE WHEN g % 4 = 1 AND k % 5 = 0 THEN NULL ELSE k END]) AS line FROM c),
    f AS (SELECT g, run, count(line) AS n_lines, sha256(string_agg(line::VARCHAR || chr(10), '' ORDER BY line)) AS digest FROM r GROUP BY ALL)
    SELECT g::VARCHAR AS sample, CASE g % 3 WHEN 0 THEN 'combined_text' WHEN 1 THEN 'combined_sequences' ELSE 'sequences' END AS kind, CASE WHEN g % 4 = 1 THEN '2' ELSE '1' END AS run, digest AS sha256, sum(n_lines)::BIGINT AS n_lines
    FROM f WHERE run = CASE WHEN g % 4 = 1 THEN 2 ELSE 1 END GROUP BY ALL""",
)
def discovered_outputs(spark, d):
    """Outputs of two runs per sample below nested folders: the best kind that a sample has, then the run on record, else
    one of two that agree. Chosen files are read with the folder they lie in."""
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 200).alias("g"))
    kinds = F.array(*[F.when(F.col("g") % 3 <= i, F.lit(n)) for i, (n, _) in enumerate(KINDS)])
    lines = cust.select("k", "g", F.explode(F.array(F.lit(1), F.lit(2))).alias("run"), F.explode(F.array_compact(kinds)).alias("kind"))
    lines = lines.filter(~((F.col("run") == 2) & (F.col("g") % 4 == 1) & (F.col("k") % 5 == 0)))
    path = scratch_dir(spark) + "/runs"
    ready = lines.repartition("g", "run", "kind").sortWithinPartitions("g", "run", "kind", "k")
    ready.select(F.col("g").alias("sample"), "run", "kind", s("k").alias("value")).write.partitionBy("sample", "run", "kind").text(path)
    files = FI.found(spark, path, glob="*.txt", digest=True).withColumn("sample", F.regexp_extract("folder", r"sample=(\d+)", 1))
    kept = cust.filter((F.col("g") % 4 == 1) & (F.col("k") % 5 != 0)).groupBy("g").agg(F.sort_array(F.collect_list("k")).alias("_k"))
    content = F.array_join(F.transform("_k", lambda v: F.concat(v.cast("string"), F.lit("\n"))), "")
    record = kept.select("g", F.sha2(content, 256).alias("sha256"), F.explode(F.array(*[F.lit(n) for n, _ in KINDS])).alias("kind"))
    record = record.select(F.concat(F.lit("sample="), s("g"), F.lit("/run=2/kind="), F.col("kind")).alias("path"), "sha256")
    chosen = FI.chosen_outputs(files, KINDS, "sample", record)
    rows = spark.read.schema("value STRING").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    per = rows.groupBy(F.regexp_extract("_metadata.file_path", r"(sample=\d+/run=\d+/kind=\w+)/", 1).alias("folder")).agg(F.count("*").alias("n_lines"))
    return chosen.join(per, "folder").select("sample", "kind", F.regexp_extract("folder", r"run=(\d+)", 1).alias("run"), "sha256", "n_lines")


@register(
    "per_label_id_lists", "A26", "SELECT o_orderstatus AS label, o_orderkey::VARCHAR AS value FROM orders",
)
def per_label_id_lists(spark, d):
    path = scratch_dir(spark) + "/ids"
    SK.write_id_lists(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "label"), path, "label", "o_orderkey")
    return spark.read.schema("value STRING, label STRING").text(path).select("label", "value")


@register(
    "demultiplexed_samples", "A29 B13", "SELECT substr(o_orderpriority, 1, 1) AS sample, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1", "total",
)
def demultiplexed_samples(spark, d):
    path = scratch_dir(spark) + "/samples"
    pooled = table(spark, d, "orders").select(D.namespaced(F.substring("o_orderpriority", 1, 1), s("o_orderkey")).alias("entity_id"), "o_totalprice")
    SK.write_per_sample(pooled.withColumn("sample", D.split_namespace("entity_id")[0]), path)
    got = spark.read.schema("entity_id STRING, o_totalprice DOUBLE, sample STRING").parquet(path)
    return got.groupBy("sample").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@register("whitelist_export", "A28", "SELECT c_custkey, c_mktsegment FROM customer")
def whitelist_export(spark, d):
    return SK.whitelist(table(spark, d, "customer"), ["c_custkey", "c_mktsegment"])


@register(
    "separator_restore", "B12 B13",
    "SELECT o_orderkey, regexp_replace(raw, ',', '__') AS first_only, replace(raw, ',', '__') AS all_of FROM (SELECT o_orderkey, o_orderstatus || ',' || o_orderpriority || ',' || o_custkey AS raw FROM orders)",
)
def separator_restore(spark, d):
    raw = F.concat_ws(",", "o_orderstatus", "o_orderpriority", s("o_custkey"))
    o = table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))
    first = F.regexp_replace("raw", "^([^,]*),", "$1__")
    return o.select("o_orderkey", first.alias("first_only"), F.regexp_replace("raw", ",", "__").alias("all_of"))


@register(
    "genome_categories", "B18",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'gardnerella_phage' WHEN p_type = 'SMALL' THEN 'negative_control' WHEN p_type = 'MEDIUM' THEN 'anellovirus' ELSE 'unknown' END AS category,
      CASE WHEN p_type = 'PROMO' THEN 'gardnerella_phage' WHEN p_type = 'SMALL' THEN 'unknown' WHEN p_type = 'LARGE' THEN 'herpesvirus' WHEN p_type = 'MEDIUM' THEN 'unknown' WHEN p_brand = 'Brand#1' THEN 'negative_control' ELSE 'unknown' END AS target_category FROM part""",
)
def genome_categories(spark, d):
    """Category by description (source sequences) and by accession (mapping targets)."""
    t = F.col("p_type")
    sid = (
        F.when(t == "PROMO", "Gardnerella_phage_vB").when(t == "SMALL", "Lactobacillus_crispatus_ref").when(t == "LARGE", "NC_001806.2")
        .when(t == "MEDIUM", "TTV-like mini").when(F.col("p_brand") == "Brand#1", "NZ_CP0001.1").otherwise("XX_000.1")
    )
    return table(spark, d, "part").select("p_partkey", R.genome_category(sid).alias("category"), R.target_category(sid).alias("target_category"))


@register(
    "host_genus", "B21",
    "SELECT p_partkey, CASE WHEN p_size < 5 THEN '-' ELSE split_part(p_name, ' ', 1) END AS genus, contains(p_name, 'ring') AS flagged FROM part",
)
def host_genus(spark, d):
    listed = F.when(F.col("p_size") < 5, "-").otherwise(F.concat(F.col("p_name"), F.lit(", other species")))
    return table(spark, d, "part").select("p_partkey", R.first_host_genus(listed).alias("genus"), R.mentions("p_name", ("ring",)).alias("flagged"))


@register(
    "novelty_and_risk", "B29 B30",
    """SELECT p_partkey, CASE WHEN p_size < 10 OR ident < 95 THEN 'novel_below_95pct' WHEN ident >= 99 THEN 'same_species_in_metavr' ELSE 'close_relative_in_metavr' END AS novelty,
      CASE WHEN p_size >= 50 AND ident >= 95 THEN 'HIGH' WHEN p_size >= 10 AND ident >= 90 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM (SELECT *, 80 + p_retailprice % 20 AS ident FROM part)""",
)
def novelty_and_risk(spark, d):
    p = table(spark, d, "part").withColumn("ident", 80 + F.col("p_retailprice") % 20)
    return p.select("p_partkey", R.novelty_class(F.when(F.col("p_size") >= 10, F.col("ident"))).alias("novelty"), R.homology_risk("p_size", "ident").alias("risk"))


@register(
    "community_strata", "B25 B26",
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'CST-I' WHEN 'MACHINERY' THEN 'CST-IV-B' WHEN 'AUTOMOBILE' THEN 'CST-IV-A' WHEN 'HOUSEHOLD' THEN 'CST-IV-other' END AS stratum, CASE c_mktsegment WHEN 'BUILDING' THEN 'low' WHEN 'FURNITURE' THEN 'low' ELSE 'high' END AS arm FROM customer""",
)
def community_strata(spark, d):
    seg = F.col("c_mktsegment")
    base = F.when(seg == "BUILDING", "I").when(seg == "MACHINERY", "IV-B").when(seg == "AUTOMOBILE", "IV-A").when(seg == "HOUSEHOLD", "IV-C").otherwise("III")
    return table(spark, d, "customer").select("c_custkey", R.community_stratum(base, F.lit("")).alias("stratum"), R.diversity_arm(base).alias("arm"))


@register(
    "quality_topology_bins", "B8 B7",
    """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'complete' WHEN '2-HIGH' THEN 'high_medium' ELSE 'low_undetermined' END AS topology, CASE WHEN o_totalprice < 5000 THEN 'L1' WHEN o_totalprice < 100000 THEN 'L2' ELSE 'L3' END AS length_bin, count(*) AS n FROM orders GROUP BY ALL""",
)
def quality_topology_bins(spark, d):
    pr = F.col("o_orderpriority")
    q = F.when(pr == "1-URGENT", "Complete").when(pr == "2-HIGH", "High-quality").otherwise("Low-quality")
    o = table(spark, d, "orders").select(R.completeness_bin(q).alias("topology"), R.length_bin("o_totalprice", (5000, 100000), ("L1", "L2", "L3")).alias("length_bin"))
    return o.groupBy("topology", "length_bin").agg(F.count("*").alias("n"))


@register(
    "display_rounding", "M L8",
    f"""SELECT l_suppkey, printf('%.3f', round(CAST(m AS DECIMAL(38, 20)), 3)::DOUBLE) AS shown FROM (SELECT l_suppkey, {MCC_SQL} AS m FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS tp, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'O') AS fp,
      count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'O') AS tn, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'O') AS fn FROM lineitem GROUP BY l_suppkey))""",
)
def display_rounding(spark, d):
    from scoreloom.functions import metrics as M

    y, p = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    return c.select("l_suppkey", X.half_up_text(M.mcc(), 3).alias("shown"))


@register(
    "logit_normalisation", "M", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x > 1 OR x < 0 THEN 1 / (1 + exp(-x)) ELSE x END AS score FROM (SELECT *, l_quantity / 10 - 1 AS x FROM lineitem)", "score",
)
def logit_normalisation(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", X.unit_interval(F.col("l_quantity") / 10 - 1).alias("score"))
