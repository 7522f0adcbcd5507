"""Sequences, communities, selection, set operations, checks and publication tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.catalog.base import COUNTS_SQL, LIBRARY_SQL, M_DOUBLES, MCC_SQL, MODELS, RULES, W, auprc_sql, calls, metric_sql, predictions, register, table, truth
from scoreloom.catalog.inputs import sequence_records
from scoreloom.catalog.labels import _LABEL, _PRED, labelled
from scoreloom.functions import metrics as M
from scoreloom.functions import rules as R
from scoreloom.functions.scalars import ratio
from scoreloom.operators import composition as K
from scoreloom.operators import confusion as C
from scoreloom.operators import decide as D
from scoreloom.operators import labelling as L
from scoreloom.operators import mixture as X
from scoreloom.operators import ordered as O
from scoreloom.operators import quality as QC
from scoreloom.operators import selection as SEL
from scoreloom.operators import sequences as Q
from scoreloom.operators import setops as S
from scoreloom.operators import stats as T
from scoreloom.plans import publish as PB
from scoreloom.plans import studies as ST
from scoreloom.plans import sweeps
from scoreloom.plans.benchmark import full_metrics
from scoreloom.sources.scratch import settle

s = lambda c: F.col(c).cast("string")
_SEQ = "WITH sq AS (SELECT 'doc_' || doc_id AS id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq, lang FROM documents)"


# --------------------------------------------------------------------------- sequences
@register(
    "fragment_manifest", "J13",
    _SEQ + """ SELECT id || '_frag_' || i || '_L' || fl AS fragment_id, id AS source, fl AS fragment_length, CAST(length(seq) AS INTEGER) AS source_length, md5(substr(seq, CAST((i - 1) * fl + 1 AS INTEGER), fl)) AS digest
      FROM (SELECT *, unnest(range(1, CAST(length(seq) // fl + 1 AS BIGINT))) AS i FROM sq, (VALUES (500), (1000), (3000)) v(fl))""",
)
def fragment_manifest(spark, d):
    f = Q.fragments(sequence_records(spark, d), (500, 1000, 3000))
    return f.select("fragment_id", "source", "fragment_length", "source_length", F.md5("fragment").alias("digest"))


_WIN = _SEQ + """, w AS (SELECT id AS parent, seq, length(seq) AS n, unnest(CASE WHEN length(seq) <= 500 THEN [0] ELSE range(0, length(seq) - 200 + 1, 250) END) AS start FROM sq WHERE length(seq) >= 200),
 fr AS (SELECT parent, start, least(500, n - start) AS wl, length(regexp_replace(substr(seq, CAST(start + 1 AS INTEGER), 500), '[^AEIOU]', '', 'g')) / least(500, n - start)::DOUBLE AS score FROM w)"""


@register("sliding_windows", "J14", _WIN + " SELECT parent, CAST(start AS INTEGER) AS start, CAST(wl AS INTEGER) AS window_length, score FROM fr", "score")
def sliding_windows(spark, d):
    return window_scores(spark, d).select("parent", "start", "window_length", "score")


def window_scores(spark, d):
    w = Q.windows(sequence_records(spark, d), 500, 200)
    return w.withColumn("score", F.length(F.regexp_replace("fragment", "[^AEIOU]", "")) / F.col("window_length"))


@register(
    "window_score_folding", "D35",
    _WIN + """ SELECT id AS parent, coalesce(avg(score), 0) AS score, count(fr.parent) AS n_windows, count(*) FILTER (WHERE score >= 0.4) * 2 > count(fr.parent) AS is_positive FROM sq LEFT JOIN fr ON fr.parent = id GROUP BY id""",
    "score",
)
def window_score_folding(spark, d):
    parents = sequence_records(spark, d).select(F.col("id").alias("parent"))
    return Q.fold_windows(parents, window_scores(spark, d).select("parent", "score"), positive=F.col("score") >= 0.4)


_N50 = """, c AS (SELECT {g}len, sum(bp) OVER ({p}ORDER BY len DESC) AS cum, sum(bp) OVER ({q}) AS tot FROM (SELECT {g}len, CAST(sum(len) AS BIGINT) AS bp FROM x GROUP BY ALL))"""


@register(
    "n50_by_group", "D40",
    "WITH x AS (SELECT source AS grp, n_chars AS len FROM documents)" + _N50.format(g="grp, ", p="PARTITION BY grp ", q="PARTITION BY grp")
    + " SELECT grp, n50, med FROM (SELECT grp, max(len) AS n50 FROM c WHERE cum * 2 >= tot GROUP BY grp) JOIN (SELECT grp, median(len) AS med FROM x GROUP BY grp) USING (grp)", "med",
)
def n50_by_group(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("grp"), F.col("n_chars").alias("len"))
    med = O.exact_quantiles(x, "len", [0.5], group=["grp"]).select("grp", F.col("quantiles")[0].alias("med"))
    return O.n50(x, "len", group=["grp"]).join(med, "grp")


@register(
    "assembly_statistics", "D43 D40",
    "WITH x AS (SELECT n_chars AS len FROM documents)" + _N50.format(g="", p="", q="")
    + " SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS total, max(len) AS longest, min(len) AS shortest, count(*) FILTER (WHERE len >= 1000) AS n_ge_1000, count(*) FILTER (WHERE len >= 5000) AS n_ge_5000, count(*) FILTER (WHERE len >= 10000) AS n_ge_10000, (SELECT max(len) FROM c WHERE cum * 2 >= tot) AS n50 FROM x",
)
def assembly_statistics(spark, d):
    return Q.assembly_stats(table(spark, d, "documents").select(F.col("n_chars").alias("len")), "len")


# ------------------------------------------------------------------------- communities
_COM = """WITH ab AS (SELECT user_id AS sample, event_type || '_' || (event_id % 3) AS taxon, count(*) AS count FROM events GROUP BY ALL)"""


def abundance(spark, d):
    e = table(spark, d, "events")
    tax = F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string"))
    return e.groupBy(F.col("user_id").alias("sample"), tax.alias("taxon")).agg(F.count("*").alias("count"))


@register(
    "wide_table_melt", "A18",
    "SELECT o_custkey AS sample, status AS taxon, coalesce(v, 0) AS count FROM (SELECT o_custkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS F, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY o_custkey) , LATERAL (VALUES ('F', F), ('O', O)) t(status, v)",
    "count",
)
def wide_table_melt(spark, d):
    o = table(spark, d, "orders")
    wide = o.groupBy(F.col("o_custkey").alias("sample")).agg(*[F.sum(F.when(F.col("o_orderstatus") == c, F.col("o_totalprice"))).alias(c) for c in "FO"])
    return K.melt(wide, "sample")


@register(
    "community_diversity", "D32",
    _COM + """, t AS (SELECT sample, sum(count)::DOUBLE AS total FROM ab GROUP BY sample)
    SELECT sample, total, -sum(count / total * ln(count / total)) AS shannon, count(*) FILTER (WHERE count / total >= 0.05) AS richness, coalesce(sum(count) FILTER (WHERE taxon LIKE 'click%') / total, 0) AS genus_fraction FROM ab JOIN t USING (sample) GROUP BY sample, total""",
    "total shannon genus_fraction",
)
def community_diversity(spark, d):
    return K.diversity(abundance(spark, d), min_share=0.05, genus=F.col("taxon").startswith("click"))


@register(
    "taxon_collapse", "D33",
    _COM + """ SELECT sample, CASE WHEN taxon LIKE 'view%' THEN 'g_view' WHEN taxon LIKE 'click%' OR taxon LIKE 'signup%' THEN 'merged' WHEN taxon LIKE 'purchase%' THEN 'BOUGHT' ELSE 'error' END AS taxon, CAST(sum(count) AS BIGINT) AS count FROM ab GROUP BY ALL""",
)
def taxon_collapse(spark, d):
    name = K.collapsed_name(
        "taxon", prefixes=(("click", "merged"), ("signup", "merged")), renames={"purchase": "BOUGHT"}, reference=("g_view", "error")
    )
    name = F.when(F.col("taxon").startswith("view"), "g_view").otherwise(name)
    return K.collapse_taxa(abundance(spark, d), name)


@register(
    "community_export", "D33 D34",
    """WITH ab AS (SELECT user_id AS sample, event_type AS taxon FROM events) SELECT sample, count(*) AS read_count, count(*) FILTER (WHERE taxon = 'click') AS click, count(*) FILTER (WHERE taxon = 'error') AS error, count(*) FILTER (WHERE taxon = 'purchase') AS purchase FROM ab GROUP BY sample""",
)
def community_export(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("taxon")).agg(F.count("*").alias("count"))
    return K.widen(e, ["click", "error", "purchase"])


@register(
    "sample_composition", "D34",
    """SELECT strftime(o_orderdate, '%Y-%m') AS sample, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)::DOUBLE AS positive_fraction FROM orders GROUP BY 1""",
    "positive_fraction",
)
def sample_composition(spark, d):
    o = table(spark, d, "orders").withColumn("sample", F.date_format("o_orderdate", "yyyy-MM"))
    p = o.groupBy("sample").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)
    n = F.col("F") + F.col("O") + F.col("P")
    return p.select("sample", n.alias("n"), F.col("F").alias("n_f"), F.col("O").alias("n_o"), F.col("P").alias("n_p"), ratio(F.col("F"), n).alias("positive_fraction"))


@register(
    "community_type_merge", "J18 B26",
    "SELECT c_custkey AS sample, c_acctbal AS cst_score, n_name AS cst FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey", "cst_score",
)
def community_type_merge(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("cst_score"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cst"))
    return c.join(n, "c_nationkey", "left").drop("c_nationkey")


# --------------------------------------------------------------------------- selection
_PANEL = """WITH c AS (SELECT o_orderkey AS contig_id, o_custkey AS sample, CAST(floor(o_totalprice) AS BIGINT) AS length, CASE WHEN o_orderpriority = '1-URGENT' THEN 'homology_free' ELSE 'homology_detectable' END AS substratum, o_orderstatus = 'P' AS prov FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000),
 b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY prov, -length, contig_id) AS rn FROM c WHERE substratum = 'homology_free') WHERE rn = 1),
 p1 AS (SELECT *, row_number() OVER (ORDER BY prov, -length, contig_id) AS r FROM b1 QUALIFY row_number() OVER (ORDER BY prov, -length, contig_id) <= 12),
 b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY prov, -length, contig_id) AS rn FROM c WHERE substratum = 'homology_detectable' AND sample NOT IN (SELECT sample FROM p1)) WHERE rn = 1),
 p2 AS (SELECT *, 12 + row_number() OVER (ORDER BY prov, -length, contig_id) AS r FROM b2 QUALIFY row_number() OVER (ORDER BY prov, -length, contig_id) <= 8)"""


@register(
    "quota_panel_selection", "E13 E15 B28 B27",
    _PANEL + " SELECT sample, contig_id, length, substratum, CAST(r AS INTEGER) AS panel_no, 'novel_exp_' || lpad(r::VARCHAR, 3, '0') AS panel_id FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)",
)
def quota_panel_selection(spark, d):
    pr = F.col("o_orderpriority")
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("contig_id"), F.col("o_custkey").alias("sample"), F.floor("o_totalprice").cast("bigint").alias("length"),
        F.when(pr == "1-URGENT", "homology_free").otherwise("homology_detectable").alias("substratum"),
        F.when(F.col("o_orderstatus") == "P", "Yes").otherwise("No").alias("provirus"),
        F.when(pr.isin("1-URGENT", "2-HIGH"), "High-quality").otherwise("Low-quality").alias("quality"),
        F.lit("novel_below_95pct").alias("novelty"), F.lit("7").alias("viral_genes"), F.lit("0").alias("host_genes"),
    )
    ok = R.panel_eligible("novelty", "quality", "length", "viral_genes", "host_genes", "provirus", min_length=100000)
    order = [F.col("provirus") == "Yes", -F.col("length"), F.col("contig_id")]
    out = SEL.quota_selection(o.filter(ok), sample="sample", klass="substratum", quotas=[("homology_free", 12), ("homology_detectable", 8)], order=order, id_prefix="novel_exp_")
    return out.select("sample", "contig_id", "length", "substratum", "panel_no", "panel_id")


@register(
    "balanced_cohort_draw", "E14 C12",
    """WITH p AS (SELECT o_orderkey AS run, o_orderpriority AS stratum, o_orderstatus AS cohort FROM orders ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_tax >= 0.08) f ON l_orderkey = o_orderkey),
    k AS (SELECT *, row_number() OVER (PARTITION BY stratum, cohort ORDER BY run) AS r FROM p), e AS (SELECT *, r > CASE cohort WHEN 'F' THEN 5 WHEN 'O' THEN 3 ELSE 2 END AS extra, CASE cohort WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS c FROM k)
    SELECT stratum, cohort, run, CAST(pick AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY extra, c, r) AS pick FROM e) WHERE pick <= 14""",
)
def balanced_cohort_draw(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("stratum"), F.col("o_orderstatus").alias("cohort"))
    flagged = table(spark, d, "lineitem").filter(F.col("l_tax") >= 0.08).select(F.col("l_orderkey").alias("run"))
    pool = o.join(flagged, "run", "left_anti")
    return SEL.balanced_draw(pool, stratum="stratum", cohort="cohort", targets={"F": 5, "O": 3, "P": 2}, total=14, order=[F.col("run")]).select("stratum", "cohort", "run", "pick")


@register(
    "candidate_summary", "J15 B27 B29 E5",
    """WITH h AS (SELECT l_orderkey AS id, 100.0::DOUBLE - 100.0::DOUBLE * l_discount AS pident, l_suppkey AS subject, row_number() OVER (PARTITION BY l_orderkey ORDER BY 100.0::DOUBLE - 100.0::DOUBLE * l_discount DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem WHERE l_quantity >= 25)
    SELECT o_orderkey AS id, coalesce(subject, -1) AS subject, pident, CASE WHEN pident IS NULL OR pident < 95 THEN 'novel_below_95pct' WHEN pident >= 99 THEN 'same_species_in_metavr' ELSE 'close_relative_in_metavr' END AS novelty
    FROM orders LEFT JOIN h ON h.id = o_orderkey AND rn = 1 WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 10000""",
    "pident",
)
def candidate_summary(spark, d):
    pr = F.col("o_orderpriority")
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(pr == "1-URGENT", "Complete").when(pr == "2-HIGH", "High-quality").otherwise("Low-quality").alias("q"), F.col("o_totalprice").alias("len"), F.lit(9).alias("vg")
    ).filter(R.high_quality_candidate("q", "vg", "len"))
    h = table(spark, d, "lineitem").filter(F.col("l_quantity") >= 25).select(
        F.col("l_orderkey").alias("id"), (100.0 - 100.0 * F.col("l_discount")).alias("pident"), F.col("l_suppkey").alias("subject"), "l_linenumber", "l_partkey"
    )
    best = O.best_per_key(h, ["id"], "pident", ["l_linenumber", "l_partkey", "subject"]).select("id", "pident", "subject")
    return o.select("id").join(best, "id", "left").select("id", F.coalesce("subject", F.lit(-1)).alias("subject"), "pident", R.novelty_class("pident").alias("novelty"))


@register(
    "pareto_models", "E12",
    """WITH m AS (SELECT p_brand AS model, sum(p_size)::DOUBLE AS cost, max(p_retailprice) AS gain FROM part GROUP BY p_brand), w AS (SELECT *, max(gain) OVER (ORDER BY cost, gain DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m)
    SELECT model, cost, gain FROM w WHERE b IS NULL OR gain > b""",
    "cost gain",
)
def pareto_models(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("model")).agg(F.sum("p_size").cast("double").alias("cost"), F.max("p_retailprice").alias("gain"))
    return O.pareto_front(m, "cost", "gain")


@register(
    "runtime_scaling", "D41",
    """WITH r AS (SELECT l_returnflag AS model, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS a, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS b, count(*) FILTER (WHERE l_linestatus = 'O') AS na, count(*) FILTER (WHERE l_linestatus = 'F') AS nb FROM lineitem GROUP BY 1)
    SELECT model, b / a AS raw, (b / a) / (nb / na::DOUBLE) AS norm FROM r""",
    "raw norm",
)
def runtime_scaling(spark, d):
    li = table(spark, d, "lineitem")
    on = lambda st, e: F.sum(F.when(F.col("l_linestatus") == st, e))
    r = li.groupBy(F.col("l_returnflag").alias("model")).agg(on("O", F.col("l_quantity")).alias("a"), on("F", F.col("l_quantity")).alias("b"), on("O", F.lit(1)).alias("na"), on("F", F.lit(1)).alias("nb"))
    raw = ratio(F.col("b"), F.col("a"), None)
    return r.select("model", raw.alias("raw"), (raw / ratio(F.col("nb"), F.col("na"), None)).alias("norm"))


@register(
    "peak_resource_use", "D45", "SELECT user_id AS run, max(value) AS peak_memory, max(CASE WHEN event_type = 'error' THEN value END) AS peak_error FROM events GROUP BY user_id", "peak_memory peak_error",
)
def peak_resource_use(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("run")).agg(F.max("value").alias("peak_memory"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("peak_error"))


CFG = (  # model, external_db, refseq, ncbi, genbank, uvig, partial
    ("disc", False, True, False, False, False, False), ("qty", False, False, True, True, False, False),
    ("price", True, False, False, False, False, False), ("tax", False, False, False, False, True, True),
)


@register(
    "training_overlap", "B23",
    """WITH cfg(model, external_db, refseq, ncbi, genbank, uvig, partial) AS (VALUES """ + ", ".join(f"('{m}', {', '.join(str(x).upper() for x in rest)})" for m, *rest in CFG) + """),
    g AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'NC_1' WHEN 'SMALL' THEN 'MW_1' WHEN 'LARGE' THEN 'IMGVR_UViG_1' ELSE 'XX' END AS acc, CASE WHEN p_size > 45 THEN 'novel' ELSE 'standard' END AS panel FROM part)
    SELECT model, cls, count(*) AS n FROM (SELECT model, CASE WHEN external_db THEN 'db_dependent' WHEN panel = 'novel' THEN 'not_in_training'
       WHEN acc = 'NC_1' THEN CASE WHEN refseq OR ncbi OR genbank THEN 'likely_in_training' WHEN partial THEN 'possible' ELSE 'not_in_training' END
       WHEN acc = 'MW_1' THEN CASE WHEN genbank THEN 'likely_in_training' WHEN ncbi THEN 'possible' ELSE 'not_in_training' END
       WHEN acc = 'IMGVR_UViG_1' THEN CASE WHEN uvig THEN 'likely_in_training' ELSE 'not_in_training' END ELSE 'possible' END AS cls FROM g, cfg) GROUP BY ALL""",
)
def training_overlap(spark, d):
    t = F.col("p_type")
    acc = F.when(t == "PROMO", "NC_1").when(t == "SMALL", "MW_1").when(t == "LARGE", "IMGVR_UViG_1").otherwise("XX")
    names = ("external_db", "refseq", "ncbi", "genbank", "uvig", "partial")
    cfg = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), *[F.lit(v).alias(n) for n, v in zip(names, rest)]) for m, *rest in CFG])).alias("c")
    g = table(spark, d, "part").select(acc.alias("acc"), F.when(F.col("p_size") > 45, "novel").otherwise("standard").alias("panel"), cfg)
    cls = R.training_overlap(F.lit(""), "acc", "panel", F.col("c"))
    return g.groupBy(F.col("c.model").alias("model"), cls.alias("cls")).agg(F.count("*").alias("n"))


@register(
    "homology_dependence", "B24 D19",
    W + """ SELECT model, arm, CASE WHEN model IN ('qty', 'price') THEN 'marker/reference-dependent' ELSE 'composition-based' END AS dependence, CASE WHEN model = 'disc' AND arm = 'low' THEN 'no' ELSE 'yes' END AS evaluable, count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE AS recall FROM calls WHERE label = 1 GROUP BY ALL""",
    "recall",
)
def homology_dependence(spark, d):
    per = calls(spark, d).filter(F.col("label") == 1).groupBy("model", "arm").agg((F.count_if(F.col("call") == 1) / F.count("*")).alias("recall"))
    length = F.when(F.col("arm") == "low", 1500).otherwise(3000)
    need = F.when(F.col("model") == "disc", 2048).otherwise(0)
    return per.select("model", "arm", R.homology_dependence("model", ("qty", "price")).alias("dependence"), Q.evaluable(length, need).alias("evaluable"), "recall")


# ------------------------------------------------------------------------ set operations
@register(
    "pooled_union", "G1",
    "SELECT entity_id, count(DISTINCT src) AS n_sources FROM (SELECT l_orderkey AS entity_id, 'a' AS src FROM lineitem WHERE l_discount >= 0.1 UNION SELECT l_orderkey, 'b' FROM lineitem WHERE l_quantity >= 49 UNION SELECT o_orderkey, 'c' FROM orders WHERE o_totalprice > 450000) GROUP BY entity_id",
)
def pooled_union(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    a = li.filter(F.col("l_discount") >= 0.1).select(F.col("l_orderkey").alias("entity_id"), F.lit(0).alias("src"))
    b = li.filter(F.col("l_quantity") >= 49).select(F.col("l_orderkey").alias("entity_id"), F.lit(1).alias("src"))
    c = o.filter(F.col("o_totalprice") > 450000).select(F.col("o_orderkey").alias("entity_id"), F.lit(2).alias("src"))
    # Three sources fit in a bit mask, so no distinct rows are shuffled twice.
    mask = F.bit_or(F.expr("shiftleft(1, src)"))
    return a.unionByName(b).unionByName(c).groupBy("entity_id").agg(F.bit_count(mask).cast("bigint").alias("n_sources"))


@register(
    "membership_change", "G2",
    W + """, q AS (SELECT entity_id, max(call) FILTER (WHERE model = 'qty') AS b, max(call) FILTER (WHERE model = 'price') AS a, any_value(label) AS label FROM calls GROUP BY entity_id)
    SELECT label, CASE WHEN a = 1 AND b = 0 THEN 'gained' WHEN a = 0 AND b = 1 THEN 'lost' WHEN a = 1 THEN 'kept' ELSE 'absent' END AS change, count(*) AS n FROM q GROUP BY ALL""",
)
def membership_change(spark, d):
    c = calls(spark, d)
    of = lambda m: c.filter(F.col("model") == m).select("entity_id", "label", "call")
    return S.membership_change(of("qty"), of("price"), ["entity_id", "label"]).groupBy("label", "change").agg(F.count("*").alias("n"))


@register(
    "call_set_arithmetic", "G3", W + f" SELECT {COUNTS_SQL} FROM calls WHERE model = 'qty'",
)
def call_set_arithmetic(spark, d):
    """Counts from set sizes: |calls|, |positives| and their intersection."""
    t = truth(spark, d).select("entity_id", "label")
    called = D.dense_calls(t, predictions(spark, d).filter(F.col("model") == "qty"), [r for r in RULES if r.model == "qty"]).filter("call = 1").select("entity_id", F.lit(1).alias("c"))
    j = t.join(called, "entity_id", "left")
    c, y = F.col("c").isNotNull(), F.col("label") == 1
    return j.agg(F.count_if(c & y).alias("tp"), F.count_if(c & ~y).alias("fp"), F.count_if(~c & ~y).alias("tn"), F.count_if(~c & y).alias("fn"))


@register(
    "model_set_difference", "G4 C10 C12",
    "SELECT p_brand, CASE WHEN bool_or(p_size >= 40) AND NOT bool_or(p_size < 40 AND p_type = 'SMALL') THEN 'left_only' ELSE 'right_only' END AS side FROM part WHERE p_size >= 48 OR p_type = 'SMALL' AND p_size < 8 GROUP BY p_brand HAVING bool_or(p_size >= 48) <> bool_or(p_type = 'SMALL' AND p_size < 8)",
)
def model_set_difference(spark, d):
    p = table(spark, d, "part")
    return S.set_difference(p.filter("p_size >= 48"), p.filter("p_type = 'SMALL' AND p_size < 8"), "p_brand")


_PB = f", pb AS (SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, block, {COUNTS_SQL} FROM calls GROUP BY ALL))"


@register(
    "leave_one_block_out", "G5 D42",
    W + _PB + " SELECT a.model, a.block AS omitted, avg(z.mcc) AS mean_mcc FROM pb a JOIN pb z ON a.model = z.model AND a.block <> z.block GROUP BY ALL", "mean_mcc",
)
def leave_one_block_out(spark, d):
    per = C.confusion(calls(spark, d), ("model", "block")).withColumn("mcc", M.mcc())
    return S.leave_one_out(per, "block", ["model"], ["mcc"])


@register(
    "keyed_patch_rescore", "G6",
    W + f""" SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, {COUNTS_SQL} FROM (SELECT * REPLACE (CASE WHEN stratum = '5-LOW' THEN 1 - label ELSE label END AS label) FROM calls WHERE stratum <> '4-NOT SPECIFIED') GROUP BY model)""",
    "mcc",
)
def keyed_patch_rescore(spark, d):
    """Drop some ids, replace others by rows of another label variant, rescore."""
    base = truth(spark, d)
    drop = base.filter(F.col("stratum").isin("4-NOT SPECIFIED", "5-LOW"))
    add = base.filter(F.col("stratum") == "5-LOW").withColumn("label", 1 - F.col("label"))
    patched = S.patch(base, drop, add, ["entity_id"])
    return C.confusion(D.dense_calls(patched, predictions(spark, d), RULES)).withColumn("mcc", M.mcc())


@register(
    "top_k_overlap", "F2",
    W + f""", ms AS (SELECT model, arm, {MCC_SQL} AS mcc FROM (SELECT model, arm, {COUNTS_SQL} FROM calls GROUP BY ALL)), rk AS (SELECT model, arm, row_number() OVER (PARTITION BY arm ORDER BY round(mcc, 9) DESC, model) AS r FROM ms)
    SELECT count(*) AS overlap, 2 AS k FROM rk a JOIN rk b ON a.model = b.model AND a.arm = 'low' AND b.arm = 'high' AND a.r <= 2 AND b.r <= 2""",
)
def top_k_overlap(spark, d):
    m = C.confusion(calls(spark, d), ("model", "arm")).select("model", "arm", F.round(M.mcc(), 9).alias("mcc"))
    r = O.rank_by(m, "mcc", group=["arm"], tie=["model"])
    return S.top_k_overlap(r.filter("arm = 'low'"), r.filter("arm = 'high'"), "model", 2)


@register(
    "custom_category_order", "F3 F1", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
)
def custom_category_order(spark, d):
    agg = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return PB.in_order(agg, "o_orderstatus", ["P", "O", "F"], "o_orderpriority")


# ----------------------------------------------------------------------------- publication
@register(
    "notes_composite_join", "C8 B19",
    """SELECT o_orderkey, o_orderstatus, l_linenumber, max(l_quantity) AS q, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND substr(o_orderpriority, 1, 1) = l_linenumber::VARCHAR GROUP BY ALL""",
    "q",
)
def notes_composite_join(spark, d):
    """Equi-join on (sample, original id)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("l_linenumber"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return o.join(li, ["o_orderkey", "l_linenumber"]).groupBy("o_orderkey", "o_orderstatus", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))


@register(
    "context_table", "C10 E16",
    W + f""", cx AS (SELECT model, stratum, {MCC_SQL} AS v FROM (SELECT model, stratum, {COUNTS_SQL} FROM calls GROUP BY ALL))
    SELECT model, max(v) FILTER (WHERE stratum = '1-URGENT') AS c0, max(v) FILTER (WHERE stratum = '3-MEDIUM') AS c1, max(v) FILTER (WHERE stratum = '5-LOW') AS c2, true AS complete FROM cx GROUP BY model""",
    "c0 c1 c2",
)
def context_table(spark, d):
    v = C.confusion(calls(spark, d), ("model", "stratum")).select("model", F.col("stratum").alias("context"), M.mcc().alias("v"))
    return PB.across_contexts(v, ["1-URGENT", "3-MEDIUM", "5-LOW"])


@register(
    "template_ordered_table", "C11 C9",
    W + f""" SELECT model, CASE model WHEN 'disc' THEN 1 WHEN 'qty' THEN 2 WHEN 'price' THEN 3 ELSE 4 END AS row_no, 'model ' || model AS title, recall, mcc, true AS agrees FROM ({metric_sql('model')})""",
    "recall mcc",
)
def template_ordered_table(spark, d):
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i + 1).alias("row_no"), F.lit(f"model {m}").alias("title")) for i, m in enumerate(MODELS)]))
    template = spark.range(1).select(rows)
    m = C.metric_table(calls(spark, d)).select("model", "recall", "mcc")
    again = C.confusion(calls(spark, d)).select("model", M.mcc().alias("mcc_again"))
    out = PB.attach_context(PB.from_template(template, m, ["model"], ["recall", "mcc"]), again, m.select("model"), ["model"], "mcc", "mcc_again", 1e-9)
    return out.drop("mcc_again").orderBy("row_no")


@register(
    "background_coverage_metrics", "K11 D42",
    W + f" SELECT m.*, auprc FROM ({metric_sql('model, source, arm')}) m JOIN ({auprc_sql('model, source, arm', 'calls')}) USING (model, source, arm)", M_DOUBLES + " auprc",
)
def background_coverage_metrics(spark, d):
    """Metrics and AUPRC per (background, coverage) for every model."""
    return full_metrics(calls(spark, d), ("source", "arm")).drop("rank_mcc", "rank_auprc")


@register(
    "arm_means_drop", "D42 K6",
    W + f""", pb AS (SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, block, arm, {COUNTS_SQL} FROM calls GROUP BY ALL))
    SELECT model, avg(mcc) FILTER (WHERE arm = 'low') AS mean_low, avg(mcc) FILTER (WHERE arm = 'high') AS mean_high, (avg(mcc) FILTER (WHERE arm = 'low') - avg(mcc) FILTER (WHERE arm = 'high')) / avg(mcc) FILTER (WHERE arm = 'low') * 100 AS drop_pct FROM pb GROUP BY model""",
    "mean_low mean_high drop_pct",
)
def arm_means_drop(spark, d):
    per = C.confusion(calls(spark, d), ("model", "block", "arm")).withColumn("mcc", M.mcc())
    mean = lambda a: F.avg(F.when(F.col("arm") == a, F.col("mcc")))
    out = per.groupBy("model").agg(mean("low").alias("mean_low"), mean("high").alias("mean_high"))
    return out.withColumn("drop_pct", ratio(F.col("mean_low") - F.col("mean_high"), F.col("mean_low"), None) * 100.0)


@register(
    "block_rank_consistency", "K6 E6",
    W + _PB + """, r AS (SELECT model, block, row_number() OVER (PARTITION BY block ORDER BY round(mcc, 9) DESC, model) AS rk FROM pb)
    SELECT model, min(rk)::INTEGER AS best_rank, max(rk)::INTEGER AS worst_rank, avg(rk) AS mean_rank, count(*) FILTER (WHERE rk = 1) AS n_first FROM r GROUP BY model""",
    "mean_rank",
)
def block_rank_consistency(spark, d):
    per = C.confusion(calls(spark, d), ("model", "block")).select("model", "block", F.round(M.mcc(), 9).alias("m9"))
    r = O.rank_by(per, "m9", group=["block"], tie=["model"])
    return r.groupBy("model").agg(F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.avg("rank").alias("mean_rank"), F.count_if(F.col("rank") == 1).alias("n_first"))


# ----------------------------------------------------------------------------------- checks
@register(
    "tolerance_check", "L1 L5",
    W + f""", g AS (SELECT model, block, {MCC_SQL} AS mcc FROM (SELECT model, block, {COUNTS_SQL} FROM calls GROUP BY ALL)), w AS (SELECT model, avg(mcc) AS want FROM g GROUP BY model)
    SELECT model, block, 'mcc' AS metric, mcc AS got, want FROM g JOIN w USING (model) WHERE abs(mcc - want) > 0.15""",
    "got want",
)
def tolerance_check(spark, d):
    """Block metrics further than the tolerance from the model mean."""
    per = C.confusion(calls(spark, d), ("model", "block")).select("model", "block", M.mcc().alias("mcc"))
    mean = per.withColumn("mcc", F.avg("mcc").over(Window.partitionBy("model")))
    return QC.tolerance_violations(per, mean, ["model", "block"], ["mcc"], 0.15)


@register(
    "count_total_check", "L2",
    W + f""" SELECT model, tp, fp, tn, fn, n_pos, n_neg FROM (SELECT model, {COUNTS_SQL} FROM calls WHERE emitted GROUP BY model), (SELECT count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM truth) WHERE tp + fn <> n_pos OR fp + tn <> n_neg""",
)
def count_total_check(spark, d):
    """Counts over emitted rows only do not add up to the label totals: the check reports it."""
    t = truth(spark, d)
    totals = t.agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
    return QC.total_violations(C.confusion(calls(spark, d).filter("emitted")), totals, [])


@register(
    "expected_key_check", "L3",
    "SELECT o_custkey AS c_custkey, 'unexpected' AS problem FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def expected_key_check(spark, d):
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    want = table(spark, d, "customer").filter(F.col("c_mktsegment") != "BUILDING").select("c_custkey")
    return QC.missing_keys(have, want, ["c_custkey"])


@register(
    "execution_completeness", "L4",
    """WITH r AS (SELECT user_id AS block, event_type AS model, max(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS exit_code, bool_or(value > 20) AS has_artifact FROM events GROUP BY ALL), want AS (SELECT DISTINCT block, m.model FROM r, (VALUES ('click'), ('error'), ('view')) m(model))
    SELECT want.block, want.model, CASE WHEN exit_code IS NULL THEN 'absent' WHEN exit_code <> 0 THEN 'failed' ELSE 'no_artifact' END AS problem FROM want LEFT JOIN r ON r.block = want.block AND r.model = want.model WHERE exit_code IS NULL OR exit_code <> 0 OR NOT has_artifact""",
)
def execution_completeness(spark, d):
    e = table(spark, d, "events")
    runs = e.groupBy(F.col("user_id").alias("block"), F.col("event_type").alias("model")).agg(
        F.max((F.col("value") > 200).cast("int")).alias("exit_code"), F.bool_or(F.col("value") > 20).alias("has_artifact")
    )
    return QC.incomplete_runs(runs, ["click", "error", "view"])


@register(
    "baseline_diff", "L5",
    W + f""", n AS (SELECT model, block, round({MCC_SQL}, 4) AS v FROM (SELECT model, block, {COUNTS_SQL} FROM calls GROUP BY ALL)), o AS (SELECT model, block, round({MCC_SQL}, 4) AS v FROM (SELECT model, block, {COUNTS_SQL} FROM calls WHERE stratum <> '5-LOW' GROUP BY ALL))
    SELECT model, block, n.v AS new, o.v AS old FROM n JOIN o USING (model, block) WHERE n.v IS DISTINCT FROM o.v AND model <> 'tax'""",
    "new old",
)
def baseline_diff(spark, d):
    c = calls(spark, d)
    new = C.confusion(c, ("model", "block")).withColumn("mcc", M.mcc())
    old = C.confusion(c.filter(F.col("stratum") != "5-LOW"), ("model", "block")).withColumn("mcc", M.mcc())
    allowed = new.filter(F.col("model") == "tax").select("model", "block")
    return QC.baseline_changes(new, old, ["model", "block"], "mcc", allowed=allowed)


@register(
    "clean_partition_check", "L6 C12",
    """SELECT c_name AS id, 'several_parents' AS problem FROM (SELECT l_suppkey::VARCHAR AS c_name, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1) UNION ALL SELECT DISTINCT l_returnflag, 'unknown_parent' FROM lineitem WHERE l_returnflag NOT IN (SELECT o_orderstatus FROM orders)""",
)
def clean_partition_check(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_returnflag").alias("parent"))
    return QC.partition_violations(m, table(spark, d, "orders").select(F.col("o_orderstatus").alias("parent")))


@register(
    "independent_call_check", "L7 G3",
    W + """, x AS (SELECT l_orderkey AS entity_id, max(CAST(l_quantity >= 45 AS INTEGER)) AS again FROM lineitem GROUP BY 1) SELECT c.call, coalesce(x.again, 0) AS again, count(*) AS n FROM calls c LEFT JOIN x USING (entity_id) WHERE model = 'qty' GROUP BY ALL""",
)
def independent_call_check(spark, d):
    """Calls derived a second way from the raw table, cross-tabulated."""
    again = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("entity_id")).agg(F.max((F.col("l_quantity") >= 45).cast("int")).alias("again"))
    c = calls(spark, d).filter(F.col("model") == "qty").select("entity_id", "call")
    return c.join(again, "entity_id", "left").fillna(0, ["again"]).groupBy("call", "again").agg(F.count("*").alias("n"))


@register(
    "metric_range_check", "L8",
    W + f""", m AS ({metric_sql('model, block')}) SELECT model, block, 'precision' AS metric, precision AS value, 0.2::DOUBLE AS lo, 0.6::DOUBLE AS hi FROM m WHERE NOT precision BETWEEN 0.2 AND 0.6 UNION ALL SELECT model, block, 'mcc', mcc, -0.1::DOUBLE, 0.1::DOUBLE FROM m WHERE NOT mcc BETWEEN -0.1 AND 0.1""",
    "value lo hi",
)
def metric_range_check(spark, d):
    m = C.metric_table(calls(spark, d), ("model", "block"))
    return QC.range_violations(m, {"precision": (0.2, 0.6), "mcc": (-0.1, 0.1)}, ["model", "block"])


# ---------------------------------------------------------------------------------- mixture
def _values(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.log10(F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", 100.0).when(F.col("l_returnflag") == "A", 0.01).otherwise(1.0)).alias("x"))


_EM_STARTS, _EM_SEED = 10, 17
_C = range(3)


def _em_sql(values: str) -> str:
    """CTEs hx, em and fit: EM over the histogram of ``values`` (column x) from the same starts, round by round."""
    per = lambda f, sep=", ": sep.join(f(i) for i in _C)
    quantile = lambda q: f"(SELECT arg_min(xb, bin) FILTER (WHERE cum >= {q!r} * nn) FROM hx, tot)"
    first = " UNION ALL ".join(f"SELECT {s} AS s, {', '.join(f'{quantile(q)} AS m{i}' for i, q in enumerate(X.start_places(s, 3, _EM_SEED)))}" for s in range(_EM_STARTS))
    logs = per(lambda i: f"ln(w{i}) - 0.5 * ln(2 * pi() * v{i}) - (xb - m{i}) * (xb - m{i}) / (2 * v{i}) AS l{i}")
    top = "greatest(l0, l1, l2)"
    shares = lambda rel, keep: f"SELECT {keep}, n, sx, sxx, {per(lambda i: f'exp(l{i} - top) / tot_ AS r{i}')}, top + ln(tot_) AS lse FROM (SELECT *, {per(lambda i: f'exp(l{i} - top)', ' + ')} AS tot_ FROM (SELECT *, {top} AS top FROM (SELECT {keep}, n, sx, sxx, {logs} FROM {rel}, hx)))"
    return f"""hb AS (SELECT floor(x / {X.WIDTH!r})::BIGINT AS bin, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx FROM {values} WHERE isfinite(x) GROUP BY 1),
 hx AS (SELECT *, sx / n AS xb, sum(n) OVER (ORDER BY bin) AS cum FROM hb), tot AS (SELECT sum(n) AS nn, greatest(sum(sxx) / sum(n) - (sum(sx) / sum(n)) ** 2, {X.FLOOR!r}) AS var FROM hx),
 em AS (SELECT s, 0 AS it, {per(lambda i: f'1 / 3.0::DOUBLE AS w{i}')}, {per(lambda i: f'm{i}')}, {per(lambda i: f'var / 9 AS v{i}')}, -1e300::DOUBLE AS ll, false AS done FROM ({first}), tot
  UNION ALL SELECT s, it + 1, {per(lambda i: f'n{i} / nn')}, {per(lambda i: f's{i} / n{i}')}, {per(lambda i: f'greatest((q{i} - 2 * (s{i} / n{i}) * s{i}) / n{i} + (s{i} / n{i}) * (s{i} / n{i}), 0) + {X.FLOOR!r}')}, now, abs(now - ll) < 1e-3
   FROM (SELECT s, it, ll, sum(n * lse) / any_value(nn) AS now, any_value(nn) AS nn, {per(lambda i: f'sum(n * r{i}) AS n{i}, sum(sx * r{i}) AS s{i}, sum(sxx * r{i}) AS q{i}')} FROM ({shares('em', 's, it, ll, done')}), tot WHERE NOT done AND it < 500 GROUP BY s, it, ll)),
 fin AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY s ORDER BY it DESC) = 1),
 lk AS (SELECT s, sum(n * lse) AS log_likelihood FROM ({shares('fin', 's')}) GROUP BY s),
 fit AS (SELECT fin.*, log_likelihood, nn FROM fin JOIN lk USING (s), tot QUALIFY row_number() OVER (ORDER BY log_likelihood DESC, s) = 1),
 comp AS (SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS component, w AS weight, m AS mean, sqrt(v) AS sd FROM ({' UNION ALL '.join(f'SELECT w{i} AS w, m{i} AS m, v{i} AS v FROM fit' for i in _C)})),
 flat AS (SELECT {per(lambda i: ', '.join(f'max({c}) FILTER (WHERE component = {i}) AS {c}{i}' for c in ('weight', 'mean', 'sd')))} FROM comp)"""


_LOGS = lambda x: ", ".join(f"ln(weight{i} / sd{i}) - ({x} - mean{i}) * ({x} - mean{i}) / (2.0 * sd{i} * sd{i}) AS l{i}" for i in _C)
_POST = lambda i: "(" + f"exp(l{i} - greatest(l0, l1, l2))" + ") / (" + " + ".join(f"exp(l{j} - greatest(l0, l1, l2))" for j in _C) + ")"


@register(
    "mixture_fit", "H14 H15",
    "WITH RECURSIVE vals AS (SELECT log10(l_extendedprice * CASE l_returnflag WHEN 'R' THEN 100.0::DOUBLE WHEN 'A' THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END) AS x FROM lineitem), " + _em_sql("vals") + f""",
     bis AS (SELECT 0 AS step, -3.0::DOUBLE AS lo, 9.0::DOUBLE AS hi UNION ALL SELECT step + 1, CASE WHEN p < 0.95 THEN 0.5 * (lo + hi) ELSE lo END, CASE WHEN p < 0.95 THEN hi ELSE 0.5 * (lo + hi) END
       FROM (SELECT *, {_POST(2)} AS p FROM (SELECT step, lo, hi, {_LOGS('(0.5 * (lo + hi))')} FROM bis, flat WHERE step < 80)))
    SELECT component, weight, mean, sd, log_likelihood, -2 * log_likelihood + 8 * ln(nn) AS bic, CAST(nn AS BIGINT) AS n, 0.5 * (lo + hi) AS cut FROM comp, fit, bis WHERE step = 80""",
    "weight mean sd log_likelihood bic cut",
)
def mixture_fit(spark, d):
    """Three-component mixture on a log ratio, ten starts of up to 500 rounds: parameters, BIC and the 95% posterior point."""
    fit = ST.with_cut(X.best_mixture(_values(spark, d), "x", starts=_EM_STARTS, seed=_EM_SEED), 0.95, lo=-3.0, hi=9.0)
    parts = F.posexplode(F.arrays_zip("weight", "mean", "sd")).alias("component", "_c")
    return fit.select("*", parts).select("component", "_c.weight", "_c.mean", "_c.sd", "log_likelihood", "bic", "n", "cut")


P_HIGH, P_MIDDLE = 0.9, 0.6
_MIX = LIBRARY_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", vals AS (SELECT log10(ratio) AS x FROM lab WHERE ratio > 0 AND isfinite(ratio)), " + _em_sql("vals") + f""",
    lx AS (SELECT *, CASE WHEN ratio > 0 AND isfinite(ratio) THEN log10(ratio) ELSE 0 END AS x FROM lab), lo AS (SELECT lx.*, {_LOGS('x')} FROM lx, flat),
    po AS (SELECT *, CASE WHEN ratio = 0 THEN 0 WHEN isinf(ratio) THEN 1 ELSE {_POST(2)} END AS p_high, CASE WHEN ratio = 0 OR isinf(ratio) THEN 0 ELSE {_POST(1)} END AS p_middle FROM lo),
    mx AS (SELECT *, {_LABEL} AS label, CASE WHEN p_high > {P_HIGH} AND is_viral THEN 'TP' WHEN p_high > {P_HIGH} AND viral_genes = 0 AND host_genes = 0 AND NOT classified THEN 'dark_matter' WHEN p_high > {P_HIGH} THEN 'excluded'
      WHEN p_middle > {P_MIDDLE} AND NOT is_viral AND domain = 'Bacteria' THEN 'TN' ELSE 'excluded' END AS mixture_label FROM po)"""


def mixture_labelled(spark, d):
    """Entities with their label by thresholds and by the mixture fitted to their own ratios."""
    read = ("entity_id", "ratio", "quality", "viral_genes", "host_genes", "provirus", "classified", "domain", "label")
    t = settle(labelled(spark, d).select(*read))  # texts of reasons are not derived for nothing
    logs = t.select(F.when(F.col("ratio") > 0, F.log10("ratio")).alias("x"))
    fit = X.best_mixture(logs, "x", starts=_EM_STARTS, seed=_EM_SEED)
    t = t.withColumn("_fit", fit.select(F.struct("weight", "mean", "sd")).scalar())
    params = [tuple(F.col(f"_fit.{c}")[i] for c in ("weight", "mean", "sd")) for i in _C]
    return L.mixture_label(t, params, p_high=P_HIGH, p_middle=P_MIDDLE, domains=("Bacteria",)).drop("_fit")


@register("mixture_relabelling", "K3 H15", _MIX + " SELECT entity_id, p_high, p_middle, mixture_label FROM mx", "p_high p_middle")
def mixture_relabelling(spark, d):
    return mixture_labelled(spark, d).select("entity_id", "p_high", "p_middle", "mixture_label")


@register("mixture_label_changes", "K3 H15", _MIX + " SELECT label AS before, mixture_label AS after, count(*) AS n FROM mx GROUP BY ALL")
def mixture_label_changes(spark, d):
    return mixture_labelled(spark, d).groupBy(F.col("label").alias("before"), F.col("mixture_label").alias("after")).agg(F.count("*").alias("n"))


@register(
    "mixture_rank_changes", "K3 E16",
    _MIX + _PRED + f""", two AS (SELECT entity_id, 'thresholds' AS variant, label AS lab FROM mx UNION ALL SELECT entity_id, 'mixture', mixture_label FROM mx),
      m AS (SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, variant, {COUNTS_SQL} FROM (SELECT b.model, variant, call, CAST(lab = 'TP' AS INTEGER) AS label FROM base b JOIN two USING (entity_id) WHERE lab IN ('TP', 'TN')) GROUP BY ALL)),
      rk AS (SELECT *, CAST(rank() OVER (PARTITION BY variant ORDER BY round(mcc, 9) DESC) AS INTEGER) AS rank FROM m)
    SELECT model, max(mcc) FILTER (WHERE variant = 'thresholds') AS mcc_thresholds, max(mcc) FILTER (WHERE variant = 'mixture') AS mcc_mixture, max(rank) FILTER (WHERE variant = 'thresholds') AS rank_thresholds, max(rank) FILTER (WHERE variant = 'mixture') AS rank_mixture FROM rk GROUP BY model""",
    "mcc_thresholds mcc_mixture",
)
def mixture_rank_changes(spark, d):
    """MCC and rank of every model under both labellings."""
    names = ("thresholds", "mixture")
    rows = mixture_labelled(spark, d).select("entity_id", sweeps.label_vector([F.col("label"), F.col("mixture_label")]).alias("labels"))
    counts = sweeps.relabel_grid(D.dense_calls(rows, predictions(spark, d), RULES), names).fillna(0.0, ["mcc"]).withColumn("m9", F.round("mcc", 9))
    ranked = O.rank_by(counts, "m9", group=["variant"], method="min")
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    return ranked.groupBy("model").agg(*[pick(v, "mcc").alias(f"mcc_{v}") for v in names], *[pick(v, "rank").alias(f"rank_{v}") for v in names])


# --------------------------------------------------------------- real labels on documents
_DOC = """WITH dd AS (SELECT d.doc_id AS entity_id, l.quality AS label, l.toxic, d.lang, d.source, d.n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


@register(
    "document_label_metrics", "D1 D2 D3",
    _DOC + f", calls AS (SELECT *, CAST(n_chars >= 1000 AS INTEGER) AS call FROM dd) SELECT *, {MCC_SQL} AS mcc FROM (SELECT lang, {COUNTS_SQL} FROM calls GROUP BY lang)", "mcc",
)
def document_label_metrics(spark, d):
    """Truth joined to documents; the call is a length rule."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    c = docs.join(lab, "doc_id").withColumn("call", (F.col("n_chars") >= 1000).cast("int"))
    return C.confusion(c, ("lang",)).withColumn("mcc", M.mcc())
