"""Interval algebra and catalogue matching on line items read as alignment hits."""

from pyspark.sql import functions as F

from scoreloom.catalog.base import HITS_SQL, hit_rows, register, table
from scoreloom.functions import rules as R
from scoreloom.functions.scalars import ratio
from scoreloom.operators import intervals as I
from scoreloom.operators import labelling as L
from scoreloom.operators import ordered as O
from scoreloom.operators import setops as S

KEY = ("qseqid", "sseqid")
# Brute force: every position of every hit, best hit per position.
_TILE = HITS_SQL + """,
 posn AS (SELECT qseqid, sseqid, pident, bitscore, evalue, sstart, send, line_no, unnest(range(qstart, qend + 1)) AS p FROM hits),
 won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qseqid, sseqid, p ORDER BY bitscore DESC, line_no) AS rn FROM posn) WHERE rn = 1),
 acc AS (SELECT qseqid, sseqid, line_no, pident, bitscore, evalue, sstart, send, count(*) AS bases FROM won GROUP BY ALL),
 subj AS (SELECT qseqid, sseqid, count(DISTINCT p) AS covered_s FROM (SELECT qseqid, sseqid, unnest(range(sstart, send + 1)) AS p FROM acc) GROUP BY ALL),
 tile AS (SELECT a.qseqid, a.sseqid, 3000::BIGINT AS qlen, 2000::BIGINT AS slen, CAST(sum(bases) AS BIGINT) AS covered_q, any_value(covered_s) AS covered_s, count(*) AS n_accepted,
   sum(pident * bases) / sum(bases) AS weighted_identity, sum(bases) / 3000::DOUBLE * 100 AS q_af, any_value(covered_s) / 2000::DOUBLE * 100 AS s_af,
   any_value(covered_s) / 2000::DOUBLE * 100 AS af_shorter, sum(bitscore) AS total_bitscore, min(evalue) AS best_evalue, sum(pident * bases) / 100 AS identical_bases
   FROM acc a JOIN subj USING (qseqid, sseqid) GROUP BY a.qseqid, a.sseqid)"""
_TD = "weighted_identity q_af s_af af_shorter total_bitscore best_evalue identical_bases"


def tiles(spark, d):
    return I.tile_hits(hit_rows(spark, d))


@register("hit_tiling", "J6 C15", _TILE + " SELECT * FROM tile", _TD)
def hit_tiling(spark, d):
    return tiles(spark, d)


@register(
    "best_subject_per_query", "J6 E5",
    _TILE + " SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY round(identical_bases, 9) DESC, total_bitscore DESC, sseqid) AS rn FROM tile) WHERE rn = 1", _TD,
)
def best_subject_per_query(spark, d):
    return I.best_subject(tiles(spark, d))


@register(
    "interval_union", "D29 C15 J6",
    HITS_SQL + " SELECT qseqid, count(DISTINCT p) AS covered FROM (SELECT qseqid, unnest(range(qstart, qend + 1)) AS p FROM hits) GROUP BY qseqid",
)
def interval_union(spark, d):
    return I.union_length(hit_rows(spark, d), ["qseqid"], F.col("qstart"), F.col("qend"))


@register(
    "genome_homology", "D29 B30",
    HITS_SQL + """, u AS (SELECT qseqid, count(DISTINCT p) AS covered FROM (SELECT qseqid, unnest(range(qstart, qend + 1)) AS p FROM hits) GROUP BY qseqid),
    l AS (SELECT qseqid, sseqid, row_number() OVER (PARTITION BY qseqid ORDER BY length DESC, line_no) AS rn FROM hits), b AS (SELECT qseqid, max(pident) AS best_identity FROM hits GROUP BY qseqid)
    SELECT u.qseqid, covered, 3000::BIGINT AS genome_length, best_identity, l.sseqid AS longest_hit_subject, covered / 3000::DOUBLE * 100 AS covered_pct,
      CASE WHEN covered / 3000::DOUBLE * 100 >= 50 AND best_identity >= 95 THEN 'HIGH' WHEN covered / 3000::DOUBLE * 100 >= 10 AND best_identity >= 90 THEN 'MODERATE' ELSE 'LOW' END AS risk
    FROM u JOIN b USING (qseqid) JOIN l ON l.qseqid = u.qseqid AND rn = 1""",
    "best_identity covered_pct",
)
def genome_homology(spark, d):
    out = I.genome_homology(hit_rows(spark, d), genome="qseqid", other="sseqid", glen="qlen", lo=F.col("qstart"), hi=F.col("qend"))
    return out.withColumn("risk", R.homology_risk("covered_pct", "best_identity"))


@register(
    "summed_identity", "D30",
    HITS_SQL + """ SELECT qseqid, sum(pident * length) / sum(length) AS ani, sum(length) / 3000::DOUBLE * 100 AS aligned_frac, min(evalue) AS evalue, arg_max(sseqid, line_no) AS last_subject FROM hits GROUP BY qseqid""",
    "ani aligned_frac evalue",
)
def summed_identity(spark, d):
    return I.summed_identity(hit_rows(spark, d))


@register(
    "target_coverage", "D31",
    HITS_SQL + """, b AS (SELECT sseqid, qseqid, row_number() OVER (PARTITION BY sseqid ORDER BY pident DESC, line_no) AS rn FROM hits)
    SELECT h.sseqid AS target, CAST(sum(length) AS BIGINT) AS aligned, 2000::BIGINT AS target_length, max(pident) AS best_identity, any_value(b.qseqid) AS best_query, sum(length) / 2000::DOUBLE * 100 AS aligned_frac
    FROM hits h JOIN b ON b.sseqid = h.sseqid AND rn = 1 GROUP BY h.sseqid""",
    "best_identity aligned_frac",
)
def target_coverage(spark, d):
    h = hit_rows(spark, d).select(F.col("sseqid").alias("target"), F.col("qseqid").alias("query"), "pident", F.col("length").alias("aligned"), F.col("slen").alias("tlen"), "line_no")
    return I.target_coverage(h)


@register(
    "estimator_audit", "K9 D30 J6 G2",
    _TILE + """, m AS (SELECT q.qseqid, coalesce(q.s, false) AS summed, coalesce(t.t, false) AS tiled FROM
      (SELECT qseqid, sum(pident * length) / sum(length) >= 94.5 AND sum(length) / 30.0::DOUBLE >= 50 AS s FROM hits GROUP BY qseqid) q
      LEFT JOIN (SELECT qseqid, bool_or(weighted_identity >= 94.5 AND q_af >= 50) AS t FROM tile GROUP BY qseqid) t USING (qseqid))
    SELECT CASE WHEN summed AND tiled THEN 'kept' WHEN summed THEN 'lost' WHEN tiled THEN 'gained' ELSE 'absent' END AS change, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM m)::DOUBLE AS pct FROM m GROUP BY 1""",
    "pct",
)
def estimator_audit(spark, d):
    """Membership under the unmerged and the tiled estimator, and their agreement."""
    h = hit_rows(spark, d)
    old = I.summed_identity(h).select("qseqid", ((F.col("ani") >= 94.5) & (F.col("aligned_frac") >= 50)).alias("call"))
    new = I.tile_hits(h).groupBy("qseqid").agg(F.bool_or((F.col("weighted_identity") >= 94.5) & (F.col("q_af") >= 50)).alias("call"))
    from pyspark.sql import Window

    n = S.membership_change(old, new, ["qseqid"]).groupBy("change").agg(F.count("*").alias("n"))
    # At most four rows reach this window.
    return n.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


_BEST = _TILE + """, best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY round(identical_bases, 9) DESC, total_bitscore DESC, sseqid) AS rn FROM tile) WHERE rn = 1)"""


@register(
    "catalogue_classification", "J7 C6",
    _BEST + """ SELECT s_suppkey AS qseqid, CASE WHEN weighted_identity IS NULL THEN 'no_detectable_homology' WHEN weighted_identity >= 94.5 AND q_af >= 60 THEN 'homolog' ELSE 'partial' END AS status,
      CASE WHEN weighted_identity IS NULL THEN 'absent' WHEN weighted_identity >= 94.5 AND af_shorter >= 90 THEN 'species' ELSE 'relative' END AS species_status, coalesce(sseqid, '') AS subject
    FROM supplier LEFT JOIN best ON qseqid = s_suppkey""",
)
def catalogue_classification(spark, d):
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qseqid"))
    best = I.best_subject(tiles(spark, d))
    out = L.catalogue_status(q, best, identity=94.5, fraction=60.0)
    sp = L.species_status(q, best, identity=94.5, fraction=90.0).select("qseqid", F.col("status").alias("species_status"))
    return out.join(sp, "qseqid").select("qseqid", "status", "species_status", F.coalesce("sseqid", F.lit("")).alias("subject"))


@register(
    "panel_classification", "J7 A7",
    _BEST + """, sk AS (SELECT * FROM (SELECT o_custkey % 150 AS q, 'g' || o_orderkey AS ref, o_totalprice / 5200 AS ani, greatest(o_totalprice / 5400, 20.0::DOUBLE) AS fr, row_number() OVER (PARTITION BY o_custkey % 150 ORDER BY o_totalprice / 5200 DESC, o_orderkey) AS rn FROM orders WHERE o_totalprice < 500000 AND o_custkey % 150 < 60) WHERE rn = 1)
    SELECT s_suppkey AS qseqid, CASE WHEN coalesce(ani >= 94.5 AND fr >= 90, false) OR coalesce(weighted_identity >= 94.5 AND af_shorter >= 90, false) THEN 'species' WHEN sseqid IS NOT NULL OR ref IS NOT NULL THEN 'relative' ELSE 'absent' END AS status,
      CASE WHEN ani >= 94.5 AND fr >= 90 THEN 'whole_genome' WHEN weighted_identity >= 94.5 AND af_shorter >= 90 THEN 'hits' END AS species_by, coalesce(sseqid, ref, '') AS match, ani, fr AS ani_fraction, weighted_identity, af_shorter AS hit_fraction
    FROM supplier LEFT JOIN best ON qseqid = s_suppkey LEFT JOIN sk ON q = s_suppkey""",
    "ani ani_fraction weighted_identity hit_fraction",
)
def panel_classification(spark, d):
    """Species by whole-genome identity or by hits, whichever shows it."""
    o = table(spark, d, "orders").filter("o_totalprice < 500000 and o_custkey % 150 < 60").select((F.col("o_custkey") % 150).alias("query"), F.concat(F.lit("g"), F.col("o_orderkey").cast("string")).alias("ref"), "o_orderkey",
        (F.col("o_totalprice") / 5200).alias("ani"), F.greatest(F.col("o_totalprice") / 5400, F.lit(20.0)).alias("af_shorter"))
    ani = O.best_per_key(o, ["query"], "ani", ["o_orderkey"])
    q = table(spark, d, "supplier").select(F.col("s_suppkey").alias("qseqid"))
    return L.panel_status(q, I.best_subject(tiles(spark, d)), ani, identity=94.5, fraction=90.0)


@register(
    "catalogue_metadata_chain", "C5 J7",
    _BEST + """ SELECT qseqid, sseqid, n_name, r_name FROM best JOIN supplier ON s_suppkey = qseqid LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""",
)
def catalogue_metadata_chain(spark, d):
    """Member -> representative -> metadata by two left joins."""
    best = I.best_subject(tiles(spark, d)).select("qseqid", "sseqid")
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    j = best.join(s, F.col("qseqid") == F.col("s_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.join(r, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("qseqid", "sseqid", "n_name", "r_name")


@register(
    "preferred_search_task", "J8",
    _TILE + """, c AS (SELECT *, sseqid AS task, weighted_identity >= 94.8 AND af_shorter >= 90 AS species FROM tile)
    SELECT qseqid, task, covered_q, species, CASE WHEN weighted_identity >= 95 AND q_af >= 60 THEN true ELSE false END AS near_identical FROM (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY species DESC, covered_q DESC, total_bitscore DESC, task) AS rn FROM c) WHERE rn = 1""",
)
def preferred_search_task(spark, d):
    t = tiles(spark, d).select(
        "qseqid", F.col("sseqid").alias("task"), "covered_q", "total_bitscore", "weighted_identity", "q_af",
        ((F.col("weighted_identity") >= 94.8) & (F.col("af_shorter") >= 90)).alias("species"),
    )
    best = L.prefer_task(t, ["qseqid"], species="species", largest=["covered_q", "total_bitscore"], tie=["task"])
    near = (F.col("weighted_identity") >= 95) & (F.col("q_af") >= 60)
    return best.select("qseqid", "task", "covered_q", "species", near.alias("near_identical"))


@register(
    "best_hit_per_key", "E5 D44",
    HITS_SQL + " SELECT qseqid, sseqid, bitscore, pident, line_no FROM (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY bitscore DESC, line_no) AS rn FROM hits) WHERE rn = 1", "bitscore pident",
)
def best_hit_per_key(spark, d):
    h = hit_rows(spark, d).select("qseqid", "sseqid", "bitscore", "pident", "line_no")
    return O.best_per_key(h, ["qseqid"], "bitscore", ["line_no"])


@register(
    "best_order_per_customer", "E5",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "o_totalprice",
)
def best_order_per_customer(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return O.best_per_key(o, ["o_custkey"], "o_totalprice", ["o_orderkey"])


@register(
    "strong_hit_summary", "D37",
    HITS_SQL + """, s AS (SELECT *, row_number() OVER (PARTITION BY qseqid ORDER BY pident DESC, line_no) AS rn FROM hits WHERE pident >= 95 AND length >= 40)
    SELECT qseqid, count(*) AS n_hits, max(sseqid) FILTER (WHERE rn = 1) AS top_subject, max(pident) AS top_identity FROM s GROUP BY qseqid""",
    "top_identity",
)
def strong_hit_summary(spark, d):
    strong = hit_rows(spark, d).filter((F.col("pident") >= 95) & (F.col("length") >= 40))
    rank = F.struct((-F.col("pident")).alias("k"), F.col("line_no"))
    return strong.groupBy("qseqid").agg(F.count("*").alias("n_hits"), F.min_by("sseqid", rank).alias("top_subject"), F.max("pident").alias("top_identity"))


# Spacer hits: line item = spacer hit, supplier = source, part's home supplier = target.
_SP = """WITH sp AS (SELECT 's' || l_suppkey || '_CRISPR_1_spacer_' || l_linenumber AS spacer_id, 's' || l_suppkey AS source, 's' || (l_partkey % 100) AS target, 100.0::DOUBLE - 100.0::DOUBLE * l_discount AS pident,
   CAST(l_quantity AS BIGINT) AS length, greatest(CAST(l_quantity AS BIGINT), 26) AS qlen, concat_ws('-', lpad(l_orderkey::VARCHAR, 12, '0'), l_linenumber::VARCHAR, lpad(l_partkey::VARCHAR, 10, '0')) AS line_no FROM lineitem),
 k AS (SELECT *, coalesce(length * 100.0 / nullif(qlen, 0)::DOUBLE, 0) AS coverage FROM sp WHERE qlen >= 25 AND target <> source AND pident >= 95 AND coalesce(length * 100.0 / nullif(qlen, 0)::DOUBLE, 0) >= 95)"""


def spacer_hits(spark, d):
    li = table(spark, d, "lineitem")
    sid = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("_CRISPR_1_spacer_"), F.col("l_linenumber").cast("string"))
    return li.select(
        sid.alias("spacer_id"), R.spacer_source(sid).alias("source"), F.concat(F.lit("s"), (F.col("l_partkey") % 100).cast("string")).alias("target"),
        (100.0 - 100.0 * F.col("l_discount")).alias("pident"), F.col("l_quantity").cast("bigint").alias("length"),
        F.greatest(F.col("l_quantity").cast("bigint"), F.lit(26)).alias("qlen"),
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"), F.lpad(F.col("l_partkey").cast("string"), 10, "0")).alias("line_no"),
    )


@register(
    "spacer_evidence", "J9 B32 C13 D36 E5",
    _SP + """, c AS (SELECT spacer_id FROM k GROUP BY spacer_id HAVING count(*) <= 25)
    SELECT target, spacer_id, source, pident, coverage FROM (SELECT k.*, row_number() OVER (PARTITION BY target ORDER BY pident DESC, line_no) AS rn FROM k SEMI JOIN c USING (spacer_id)) WHERE rn = 1""",
    "pident coverage",
)
def spacer_evidence(spark, d):
    return L.spacer_evidence(spacer_hits(spark, d), max_hits=25)


@register(
    "promiscuous_spacers", "D36", _SP + " SELECT spacer_id, count(*) AS n_hits FROM k GROUP BY spacer_id HAVING count(*) > 25",
)
def promiscuous_spacers(spark, d):
    h = spacer_hits(spark, d)
    cov = ratio(F.col("length") * 100.0, F.col("qlen"))
    kept = h.filter((F.col("qlen") >= 25) & (F.col("target") != F.col("source")) & (F.col("pident") >= 95) & (cov >= 95))
    return kept.groupBy("spacer_id").agg(F.count("*").alias("n_hits")).filter(F.col("n_hits") > 25)


@register(
    "same_sample_spacer_filter", "B34 B13",
    """SELECT CASE WHEN o_orderpriority[1] = l_linenumber::VARCHAR THEN 'same' ELSE 'cross' END AS kind, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def same_sample_spacer_filter(spark, d):
    """Hits whose target and source share the sample prefix, and the complement."""
    from scoreloom.operators.decide import namespaced, split_namespace

    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.select("l_orderkey", "l_linenumber").join(o.select("o_orderkey", "o_orderpriority"), F.col("o_orderkey") == F.col("l_orderkey"))
    target = namespaced(F.substring("o_orderpriority", 1, 1), F.col("o_orderkey").cast("string"))
    source = namespaced(F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string"))
    same = split_namespace(target)[0] == split_namespace(source)[0]
    return j.groupBy(F.when(same, "same").otherwise("cross").alias("kind")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ mapping labels
_MAP = """WITH h AS (SELECT l_orderkey AS entity_id, l_returnflag AS flag, CASE l_returnflag WHEN 'R' THEN 'NC_001526.' || l_linenumber ELSE 'NZ_' || l_suppkey END AS target, 100.0::DOUBLE - 100.0::DOUBLE * l_discount AS pident, l_quantity * 2 AS coverage,
   concat_ws('-', lpad(l_linenumber::VARCHAR, 3, '0'), lpad(l_partkey::VARCHAR, 10, '0'), lpad(l_suppkey::VARCHAR, 10, '0')) AS line_no FROM lineitem),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pident DESC, line_no) AS rn FROM h WHERE flag = 'R' AND pident >= 95 AND coverage >= 60) WHERE rn = 1),
 n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pident DESC, line_no) AS rn FROM h WHERE flag = 'A' AND pident >= 95 AND coverage >= 60) WHERE rn = 1)"""


def map_hits(spark, d):
    li = table(spark, d, "lineitem")
    target = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("NC_001526."), F.col("l_linenumber").cast("string"))).otherwise(F.concat(F.lit("NZ_"), F.col("l_suppkey").cast("string")))
    return li.select(
        F.col("l_orderkey").alias("entity_id"), F.col("l_returnflag").alias("flag"), target.alias("target"),
        (100.0 - 100.0 * F.col("l_discount")).alias("pident"), (F.col("l_quantity") * 2).alias("coverage"),
        F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 10, "0"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0")).alias("line_no"),
    )


@register(
    "mapping_labels", "J11 C14 E5 B18",
    _MAP + """ SELECT o_orderkey AS entity_id, CASE WHEN p.target LIKE 'NC_001526.7%' THEN 'excluded_chimeric_risk' WHEN p.target IS NOT NULL THEN 'viral' WHEN n.target IS NOT NULL THEN 'bacterial' ELSE 'background' END AS label,
      coalesce(p.target, n.target, '-') AS source, CASE WHEN p.target IS NOT NULL THEN 'hpv' WHEN n.target IS NOT NULL THEN 'negative_control' ELSE '-' END AS source_category,
      coalesce(p.pident, n.pident) AS pident, coalesce(p.coverage, n.coverage) AS coverage FROM orders LEFT JOIN p ON p.entity_id = o_orderkey LEFT JOIN n ON n.entity_id = o_orderkey""",
    "pident coverage",
)
def mapping_labels(spark, d):
    ents = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"))
    h = map_hits(spark, d)
    return L.mapping_labels(ents, h.filter("flag = 'R'"), h.filter("flag = 'A'"), excluded_prefixes=["NC_001526.7"], min_coverage=60.0)


@register(
    "native_homolog_exclusion", "J12 D29 B30",
    HITS_SQL + """, f AS (SELECT * FROM hits WHERE pident >= 92 AND length >= 5), c AS (SELECT qseqid, sseqid, count(DISTINCT p) / 3000::DOUBLE * 100 AS cov FROM (SELECT qseqid, sseqid, unnest(range(qstart, qend + 1)) AS p FROM f) GROUP BY ALL),
    b AS (SELECT qseqid, sseqid, max(pident) AS best FROM f GROUP BY ALL)
    SELECT sseqid AS background, qseqid AS genome, cov AS covered_pct, best, s.label FROM c JOIN b USING (qseqid, sseqid) JOIN (VALUES ('A', 'excluded_native'), ('N', 'excluded_native'), ('R', 'excluded_native')) s(x, label) ON x = sseqid WHERE cov >= 50 AND best >= 95""",
    "covered_pct best",
)
def native_homolog_exclusion(spark, d):
    """(background, genome) pairs whose genome is largely covered by near-identical native
    sequence, with the label their contigs get."""
    h = hit_rows(spark, d).filter((F.col("pident") >= 92) & (F.col("length") >= 5))
    cov = I.union_length(h, ["qseqid", "sseqid"], F.col("qstart"), F.col("qend"))
    best = h.groupBy("qseqid", "sseqid").agg(F.max("pident").alias("best"))
    j = cov.join(best, ["qseqid", "sseqid"]).withColumn("covered_pct", ratio(F.col("covered"), F.lit(3000)) * 100.0)
    high = j.filter(R.homology_risk("covered_pct", "best") == "HIGH")
    return high.select(F.col("sseqid").alias("background"), F.col("qseqid").alias("genome"), "covered_pct", "best", F.lit("excluded_native").alias("label"))


_BG = lambda c: f"CASE {c} WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'N' ELSE 'R' END"


@register(
    "native_exclusion_relabelling", "J12 J11",
    HITS_SQL + f""", f AS (SELECT * FROM hits WHERE pident >= 92 AND length >= 5), c AS (SELECT qseqid, sseqid, count(DISTINCT p) / 3000::DOUBLE * 100 AS cov FROM (SELECT qseqid, sseqid, unnest(range(qstart, qend + 1)) AS p FROM f) GROUP BY ALL),
    b AS (SELECT qseqid, sseqid, max(pident) AS best FROM f GROUP BY ALL), ex AS (SELECT sseqid AS background, qseqid AS genome FROM c JOIN b USING (qseqid, sseqid) WHERE cov >= 50 AND best >= 95),
    h AS (SELECT l_orderkey AS entity_id, l_suppkey AS target, row_number() OVER (PARTITION BY l_orderkey ORDER BY 100.0::DOUBLE - 100.0::DOUBLE * l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE 100.0::DOUBLE - 100.0::DOUBLE * l_discount >= 95 AND l_quantity * 2 >= 60),
    lb AS (SELECT {_BG('o_orderpriority')} AS background, target FROM orders LEFT JOIN h ON entity_id = o_orderkey AND rn = 1)
    SELECT lb.background, CASE WHEN target IS NULL THEN 'background' WHEN genome IS NOT NULL THEN 'excluded_chimeric_risk' ELSE 'viral' END AS label, count(*) AS n FROM lb LEFT JOIN ex ON ex.background = lb.background AND genome = target GROUP BY ALL""",
)
def native_exclusion_relabelling(spark, d):
    """Contigs labelled by mapping, then again without the genomes that their background holds natively."""
    line = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_linenumber", "l_partkey", "l_suppkey")])
    hits = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("entity_id"), F.col("l_suppkey").cast("string").alias("target"), (100.0 - 100.0 * F.col("l_discount")).alias("pident"), (F.col("l_quantity") * 2).alias("coverage"), line.alias("line_no"))
    pr = F.col("o_orderpriority")
    ents = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.when(pr == "1-URGENT", "A").when(pr == "2-HIGH", "N").otherwise("R").alias("background"))
    labels = L.mapping_labels(ents, hits, hits.filter("false"), min_coverage=60.0)
    native = native_homolog_exclusion(spark, d).select("background", F.col("genome").cast("string").alias("genome"))
    return L.exclude_native(labels, native).groupBy("background", "label").agg(F.count("*").alias("n"))


@register(
    "depth_breadth", "D28 A15",
    """WITH g AS (SELECT l_suppkey AS contig, count(*) FILTER (WHERE l_quantity > 10) AS cb, sum(CASE WHEN l_quantity > 10 THEN l_quantity ELSE 0 END)::DOUBLE AS s FROM lineitem GROUP BY 1)
    SELECT s_suppkey AS contig, 2000::BIGINT AS length, coalesce(cb, 0) AS covered_bases, coalesce(cb, 0) / 2000::DOUBLE * 100 AS breadth_pct, coalesce(s, 0) / 2000::DOUBLE AS mean_depth FROM supplier LEFT JOIN g ON contig = s_suppkey""",
    "breadth_pct mean_depth",
)
def depth_breadth(spark, d):
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    depth = li.select(F.col("l_suppkey").alias("contig"), F.when(q > 10, q).otherwise(0).alias("depth"))
    lengths = table(spark, d, "supplier").select(F.col("s_suppkey").alias("contig"), F.lit(2000).cast("bigint").alias("length"))
    return I.depth_summary(depth, lengths)


@register(
    "catalogue_status_counts", "D26",
    _BEST + """, s AS (SELECT CASE WHEN weighted_identity >= 94.5 AND q_af >= 60 THEN 'homolog' ELSE 'partial' END AS status, r_name, s_nationkey FROM best JOIN supplier ON s_suppkey = qseqid JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
    SELECT status, r_name, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM s)::DOUBLE AS pct FROM s GROUP BY CUBE (status, r_name)""",
    "pct",
)
def catalogue_status_counts(spark, d):
    """Joint contingency with all margins."""
    from pyspark.sql import Window

    best = I.best_subject(tiles(spark, d))
    q = best.select("qseqid")
    st = L.catalogue_status(q, best, identity=94.5, fraction=60.0).select("qseqid", "status")
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    j = st.join(s, F.col("qseqid") == F.col("s_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    cells = j.groupBy("status", "r_name").agg(F.count("*").alias("c"))
    cube = cells.cube("status", "r_name").agg(F.sum("c").alias("n"))
    return cube.withColumn("pct", F.col("n") * 100.0 / F.max("n").over(Window.partitionBy(F.lit(1))))


@register(
    "integrated_evidence", "C7 B20",
    HITS_SQL + """, x AS (SELECT s_suppkey AS entity_id, s_acctbal FROM supplier),
    a AS (SELECT qseqid, string_agg(DISTINCT sseqid, ',' ORDER BY sseqid) AS subjects FROM hits WHERE pident >= 99 GROUP BY 1),
    b AS (SELECT l_suppkey, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses FROM lineitem WHERE l_tax >= 0.08 GROUP BY 1), c AS (SELECT l_suppkey, max(l_quantity) AS top_q FROM lineitem GROUP BY 1)
    SELECT entity_id, coalesce(subjects, '') AS subjects, coalesce(statuses, '') AS statuses, top_q, s_acctbal > 5000 AS flagged FROM x LEFT JOIN a ON a.qseqid = entity_id LEFT JOIN b ON b.l_suppkey = entity_id LEFT JOIN c ON c.l_suppkey = entity_id""",
    "top_q",
)
def integrated_evidence(spark, d):
    """Several sources per entity, folded by one aggregate before the join."""
    h = hit_rows(spark, d).select(F.col("qseqid").alias("entity_id"), F.when(F.col("pident") >= 99, F.col("sseqid")).alias("subject"))
    li = table(spark, d, "lineitem")
    per = li.groupBy(F.col("l_suppkey").alias("entity_id")).agg(
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("l_tax") >= 0.08, F.col("l_linestatus"))))).alias("statuses"), F.max("l_quantity").alias("top_q"),
    )
    subj = h.groupBy("entity_id").agg(F.concat_ws(",", F.sort_array(F.collect_set("subject"))).alias("subjects"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity_id"), (F.col("s_acctbal") > 5000).alias("flagged"))
    return s.join(subj, "entity_id", "left").join(per, "entity_id", "left").fillna("", ["subjects", "statuses"])
