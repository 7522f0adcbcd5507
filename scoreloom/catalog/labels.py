"""Truth construction and label sensitivity."""

from pyspark.sql import functions as F

from scoreloom.catalog.base import (
    COUNTS_SQL, EVIDENCE_SQL, LIBRARY_SQL, M_DOUBLES, MCC_SQL, N_STD, RULES, TIERS_SQL, auprc_sql, evidence_context, evidence_lines, libraries, metric_sql, predictions,
    quality_context, register, table, tier_sql,
)
from scoreloom.functions import metrics as M
from scoreloom.functions import rules as R
from scoreloom.operators import confusion as C
from scoreloom.operators import decide as D
from scoreloom.operators import labelling as L
from scoreloom.operators import ordered as O
from scoreloom.operators import setops as S
from scoreloom.operators import stats as T
from scoreloom.plans import benchmark, sweeps


def flags(spark, d):
    return L.evidence_flags(evidence_context(spark, d), evidence_lines(spark, d))


def tiers(spark, d):
    return L.evidence_tier(flags(spark, d))


_EV = "concat_ws(',', CASE WHEN e1a THEN 'E1a' END, CASE WHEN e1b THEN 'E1b' END, CASE WHEN e2 THEN 'E2' END, CASE WHEN e3 THEN 'E3' END, CASE WHEN e4 THEN 'E4' END, CASE WHEN e5 THEN 'E5' END)"


@register(
    "evidence_tiers", "J1 C2 B33",
    TIERS_SQL + f""" SELECT entity_id, n_evidence, tier, category, {_EV} AS evidence,
    concat_ws('; ',
      CASE WHEN n_evidence = 0 AND host_genes > 0 AND viral_genes = 0 THEN 'checkv:' || viral_genes || '_viral_genes' END,
      CASE WHEN n_evidence = 0 AND NOT (host_genes > 0 AND viral_genes = 0) AND taxon IS NOT NULL THEN 'kraken2:' || taxon END,
      CASE WHEN n_evidence = 0 AND taxon IS NULL AND host_genes = 0 AND viral_genes = 0 THEN 'no_gene_classification' END,
      CASE WHEN n_evidence > 0 AND e3 THEN 'phigaro:' || coords END,
      CASE WHEN n_evidence > 0 AND NOT e3 AND e1a AND family NOT IN ('phage', 'unknown') THEN 'family:' || family END,
      CASE WHEN n_evidence > 0 AND NOT e3 AND e5 THEN 'rca_validated' END,
      CASE WHEN n_evidence > 0 AND NOT e3 AND NOT (e1a AND family NOT IN ('phage', 'unknown')) AND NOT e5 AND e4 THEN 'crispr_spacer_hit:' || spacer_id END) AS notes
    FROM tiers""",
)
def evidence_tiers(spark, d):
    return tiers(spark, d).select(
        "entity_id", "n_evidence", "tier", "category", F.concat_ws(",", "evidence_lines").alias("evidence"), F.concat_ws("; ", "notes").alias("notes")
    )


VARIANTS = {
    "standard": {}, "merged": {"merge_first_two": True}, "no_e1b": {"exclude": ("E1b",)},
    "no_e4": {"exclude": ("E4",)}, "no_e5": {"exclude": ("E5",)},
}
_VSQL = " UNION ALL ".join(
    f"SELECT entity_id, block, '{name}' AS variant, {expr} FROM ev"
    for name, expr in (
        ("standard", tier_sql(N_STD)),
        ("merged", tier_sql("((e1a OR e1b OR e2)::INT + e3::INT + e4::INT + e5::INT)")),
        ("no_e1b", tier_sql("(e1a::INT + e2::INT + e3::INT + e4::INT + e5::INT)")),
        ("no_e4", tier_sql("((e1a OR e1b)::INT + e2::INT + e3::INT + e5::INT)")),
        ("no_e5", tier_sql("((e1a OR e1b)::INT + e2::INT + e3::INT + e4::INT)")),
    )
)
_W = EVIDENCE_SQL + f", vt AS ({_VSQL})"


@register("evidence_variants", "K4 J1", _W + " SELECT variant, tier, category, count(*) AS n FROM vt GROUP BY ALL")
def evidence_variants(spark, d):
    return sweeps.tier_variant_counts(flags(spark, d), VARIANTS)


# Calls of the scoring models over the tiered truth, in SQL.
_PRED = """, models(model, threshold, pvalue_below) AS (VALUES ('disc', 0.9::DOUBLE, 0.05::DOUBLE), ('qty', 0.9::DOUBLE, NULL::DOUBLE), ('price', 0.6::DOUBLE, NULL::DOUBLE), ('tax', 0.95::DOUBLE, NULL::DOUBLE)),
raw AS (SELECT l_orderkey AS entity_id, 'disc' AS model, l_discount * 10.0::DOUBLE AS score, l_tax AS pvalue FROM lineitem
  UNION ALL SELECT l_orderkey, 'qty', l_quantity / 50.0::DOUBLE, NULL FROM lineitem
  UNION ALL SELECT l_orderkey, 'price', l_extendedprice / 131072.0::DOUBLE, NULL FROM lineitem WHERE l_extendedprice >= 20000
  UNION ALL SELECT l_orderkey, 'tax', l_tax * 12.5::DOUBLE, NULL FROM lineitem),
topp AS (SELECT entity_id, model, max(score) AS score FROM raw GROUP BY ALL),
pred AS (SELECT t.entity_id, t.model, t.score, min(r.pvalue) AS pvalue FROM topp t JOIN raw r ON t.entity_id = r.entity_id AND t.model = r.model AND t.score = r.score GROUP BY ALL),
base AS (SELECT o_orderkey AS entity_id, m.model, coalesce(p.score, 0) AS score, CAST(coalesce(p.score, 0) >= threshold AND (pvalue_below IS NULL OR coalesce(p.pvalue, 1) < pvalue_below) AS INTEGER) AS call
  FROM orders CROSS JOIN models m LEFT JOIN pred p ON p.entity_id = o_orderkey AND p.model = m.model)"""


def _calls(spark, d, truth):
    return D.dense_calls(truth, predictions(spark, d), RULES)


def variant_labels(spark, d):
    """(entity_id, labels): tiers 1 and 2 are positive, tier 0 negative, under each variant."""
    tiers = [L.tier_columns(**opt)["tier"] for opt in VARIANTS.values()]
    return flags(spark, d).select("entity_id", sweeps.label_vector([F.when(t.isin(1, 2), "TP").when(t == 0, "TN") for t in tiers]).alias("labels"))


@register(
    "evidence_variant_ranks", "K4 E16",
    _W + _PRED + f""", m AS (SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, variant, {COUNTS_SQL} FROM (SELECT b.model, variant, call, CAST(tier > 0 AS INTEGER) AS label FROM base b JOIN vt USING (entity_id) WHERE tier IN (0, 1, 2)) GROUP BY ALL)),
    r AS (SELECT model, variant, mcc, CAST(rank() OVER (PARTITION BY variant ORDER BY round(mcc, 9) DESC) AS INTEGER) AS rank FROM m)
    SELECT model, {', '.join(f"max(round(mcc, 6)) FILTER (WHERE variant = '{v}') AS mcc_{v}, max(rank) FILTER (WHERE variant = '{v}') AS rank_{v}" for v in VARIANTS)},
      max(round(mcc, 6)) FILTER (WHERE variant = 'no_e5') - max(round(mcc, 6)) FILTER (WHERE variant = 'standard') AS delta_no_e5 FROM r GROUP BY model""",
    "delta_no_e5 " + " ".join(f"mcc_{v}" for v in VARIANTS),
)
def evidence_variant_ranks(spark, d):
    """Wide MCC and min-rank per label variant; an entity carries its labels under all variants as one short text."""
    counts = sweeps.relabel_grid(_calls(spark, d, variant_labels(spark, d)), list(VARIANTS))
    ranked = O.rank_by(counts.withColumn("m9", F.round("mcc", 9)), "m9", group=["variant"], method="min")
    pick = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    cols = []
    for v in VARIANTS:
        cols += [F.round(pick(v, "mcc"), 6).alias(f"mcc_{v}"), pick(v, "rank").alias(f"rank_{v}")]
    return ranked.groupBy("model").agg(*cols).withColumn("delta_no_e5", F.col("mcc_no_e5") - F.col("mcc_standard"))


@register(
    "label_rank_stability", "E16 K4",
    _W + _PRED + f""", m AS (SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, variant, {COUNTS_SQL} FROM (SELECT b.model, variant, call, CAST(tier > 0 AS INTEGER) AS label FROM base b JOIN vt USING (entity_id) WHERE tier IN (0, 1, 2)) GROUP BY ALL))
    SELECT model, variant, mcc, CAST(row_number() OVER (PARTITION BY variant ORDER BY round(mcc, 9) DESC, model) AS INTEGER) AS rank,
      round(mcc, 9) - round(max(mcc) FILTER (WHERE variant = 'standard') OVER (PARTITION BY model), 9) AS delta FROM m""",
    "mcc delta",
)
def label_rank_stability(spark, d):
    from pyspark.sql import Window

    counts = sweeps.relabel_grid(_calls(spark, d, variant_labels(spark, d)), list(VARIANTS)).withColumn("m9", F.round("mcc", 9))
    ranked = O.rank_by(counts, "m9", group=["variant"], tie=["model"])
    std = F.max(F.when(F.col("variant") == "standard", F.col("m9"))).over(Window.partitionBy("model"))
    return ranked.select("model", "variant", "mcc", "rank", (F.col("m9") - std).alias("delta"))


@register(
    "tier_distribution", "D22", TIERS_SQL + " SELECT tier, category, count(*) AS n, CAST(sum(length) AS BIGINT) AS total_bp FROM tiers GROUP BY ALL",
)
def tier_distribution(spark, d):
    return tiers(spark, d).groupBy("tier", "category").agg(F.count("*").alias("n"), F.sum("length").alias("total_bp"))


@register(
    "evidence_membership", "D23",
    TIERS_SQL + " SELECT tier, upper(substr(line, 1, 1)) || substr(line, 2) AS line, count(*) AS n FROM (UNPIVOT (SELECT tier, e1a, e1b, e2, e3, e4, e5 FROM tiers WHERE n_evidence > 0) ON e1a, e1b, e2, e3, e4, e5 INTO NAME line VALUE v) WHERE v GROUP BY ALL",
)
def evidence_membership(spark, d):
    hit = tiers(spark, d).filter(F.col("n_evidence") > 0)
    return hit.select("tier", F.explode("evidence_lines").alias("line")).groupBy("tier", "line").agg(F.count("*").alias("n"))


@register(
    "evidence_combinations", "D23 F4",
    TIERS_SQL + f" SELECT replace({_EV}, ',', '+') AS combination, count(*) AS n FROM tiers GROUP BY ALL",
)
def evidence_combinations(spark, d):
    return S.combination_counts(tiers(spark, d), F.col("evidence_lines")).orderBy(F.col("n").desc(), "combination")


@register(
    "evidence_co_occurrence", "D24",
    EVIDENCE_SQL + """, l AS (UNPIVOT (SELECT entity_id, e1a, e1b, e2, e3, e4, e5 FROM ev) ON e1a, e1b, e2, e3, e4, e5 INTO NAME line VALUE v)
    SELECT a.line AS line_a, b.line AS line_b, count(*) FILTER (WHERE a.v AND b.v) AS n_both, count(*) FILTER (WHERE a.v) AS n_a,
      coalesce(count(*) FILTER (WHERE a.v AND b.v) * 100.0 / nullif(count(*) FILTER (WHERE a.v), 0)::DOUBLE, 0) AS pct FROM l a JOIN l b USING (entity_id) GROUP BY ALL""",
    "pct",
)
def evidence_co_occurrence(spark, d):
    return S.co_occurrence(flags(spark, d), ("e1a", "e1b", "e2", "e3", "e4", "e5"))


@register(
    "truth_flow_counts", "D25",
    TIERS_SQL + """ SELECT count(*) AS n_all, count(*) FILTER (WHERE tier IN (1, 2)) AS n_positive, count(*) FILTER (WHERE tier = 0) AS n_negative, count(*) FILTER (WHERE tier = 3) AS n_single,
      count(*) FILTER (WHERE tier = -1) AS n_ambiguous, count(*) FILTER (WHERE tier IN (1, 2) AND (e3 OR e4 OR e5)) AS n_orthogonal, count(*) FILTER (WHERE tier IN (1, 2) AND NOT (e3 OR e4 OR e5)) AS n_homology_only,
      count(*) FILTER (WHERE tier = 0 AND host_genes > 0 AND viral_genes = 0) AS n_by_genes, count(*) FILTER (WHERE tier = 0 AND NOT (host_genes > 0 AND viral_genes = 0)) AS n_by_taxon FROM tiers""",
)
def truth_flow_counts(spark, d):
    pos, zero = F.col("tier").isin(1, 2), F.col("tier") == 0
    orth = F.arrays_overlap("evidence_lines", F.array(F.lit("E3"), F.lit("E4"), F.lit("E5")))
    genes = (F.col("host_genes") > 0) & (F.col("viral_genes") == 0)
    return tiers(spark, d).agg(
        F.count("*").alias("n_all"), F.count_if(pos).alias("n_positive"), F.count_if(zero).alias("n_negative"),
        F.count_if(F.col("tier") == 3).alias("n_single"), F.count_if(F.col("tier") == -1).alias("n_ambiguous"),
        F.count_if(pos & orth).alias("n_orthogonal"), F.count_if(pos & ~orth).alias("n_homology_only"),
        F.count_if(zero & genes).alias("n_by_genes"), F.count_if(zero & ~genes).alias("n_by_taxon"),
    )


_DEFS = """, df AS (SELECT b.model, call, score, CAST(tier > 0 AS INTEGER) AS label, unnest(['all', CASE WHEN tier = 0 OR e3 OR e4 OR e5 THEN 'orthogonal' END, CASE WHEN tier = 0 OR NOT (e3 OR e4 OR e5) THEN 'homology' END]) AS definition
  FROM base b JOIN tiers USING (entity_id) WHERE tier IN (0, 1, 2)), dd AS (SELECT * FROM df WHERE definition IS NOT NULL)"""


@register(
    "orthogonal_truth_metrics", "K7",
    TIERS_SQL + _PRED + _DEFS + f""" SELECT m.*, auprc, CAST(rank() OVER (PARTITION BY definition ORDER BY round(mcc, 9) DESC) AS INTEGER) AS rank_mcc, CAST(rank() OVER (PARTITION BY definition ORDER BY round(auprc, 9) DESC) AS INTEGER) AS rank_auprc
      FROM ({metric_sql('model, definition', 'dd')}) m JOIN ({auprc_sql('model, definition', 'dd')}) USING (model, definition)""",
    M_DOUBLES + " auprc",
)
def orthogonal_truth_metrics(spark, d):
    """Rescoring and ranks against positives with orthogonal support only and homology only."""
    orth = F.arrays_overlap("evidence_lines", F.array(F.lit("E3"), F.lit("E4"), F.lit("E5")))
    t = tiers(spark, d).filter(F.col("tier").isin(0, 1, 2)).select(
        "entity_id", (F.col("tier") > 0).cast("int").alias("label"),
        F.array_compact(F.array(F.lit("all"), F.when((F.col("tier") == 0) | orth, "orthogonal"), F.when((F.col("tier") == 0) | ~orth, "homology"))).alias("defs"),
    )
    return benchmark.full_metrics(_calls(spark, d, t).select("model", "label", "call", "score", F.explode("defs").alias("definition")), ("definition",))


@register(
    "positive_stratum_recall", "K7 D8",
    TIERS_SQL + _PRED + " SELECT model, category, count(*) AS n, count(*) FILTER (WHERE call = 1) AS k, count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE AS recall FROM base JOIN tiers USING (entity_id) WHERE tier IN (1, 2) GROUP BY ALL",
    "recall",
)
def positive_stratum_recall(spark, d):
    t = tiers(spark, d).filter(F.col("tier").isin(1, 2)).select("entity_id", "category")
    agg = _calls(spark, d, t).groupBy("model", "category").agg(F.count("*").alias("n"), F.count_if(F.col("call") == 1).alias("k"))
    return agg.withColumn("recall", F.col("k") / F.col("n"))


@register(
    "composition_pooled_benchmark", "J16",
    TIERS_SQL + _PRED + f""" SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, block, {COUNTS_SQL} FROM (SELECT b.model, block, call, CAST(tier > 0 AS INTEGER) AS label FROM base b JOIN tiers USING (entity_id) WHERE tier IN (0, 1, 2)) GROUP BY GROUPING SETS ((model, block), (model)))""",
    "mcc",
)
def composition_pooled_benchmark(spark, d):
    """Evidence -> tiers -> dense calls -> per-block audit and pooled metrics in one job."""
    from scoreloom.plans.benchmark import pooled_benchmark

    return pooled_benchmark(flags(spark, d), predictions(spark, d), RULES, block="block")


_FULL = ", po AS (SELECT b.model, call, score, CAST(tier > 0 AS INTEGER) AS label FROM base b JOIN tiers USING (entity_id) WHERE tier IN (0, 1, 2))"


@register(
    "pooled_benchmark_table", "J16 E1",
    TIERS_SQL + _PRED + _FULL + f""" SELECT m.*, auprc, CAST(rank() OVER (ORDER BY round(mcc, 9) DESC) AS INTEGER) AS rank_mcc, CAST(rank() OVER (ORDER BY round(auprc, 9) DESC) AS INTEGER) AS rank_auprc FROM ({metric_sql('model', 'po')}) m JOIN ({auprc_sql('model', 'po')}) USING (model)""",
    M_DOUBLES + " auprc",
)
def pooled_benchmark_table(spark, d):
    """The pooled table: all metrics, AUPRC and ranks per model over tiered truth."""
    t = tiers(spark, d).filter(F.col("tier").isin(0, 1, 2)).select("entity_id", (F.col("tier") > 0).cast("int").alias("label"))
    return benchmark.full_metrics(_calls(spark, d, t))


# ------------------------------------------------------------------ enrichment
def enriched(spark, d):
    a, b, size = libraries(spark, d)
    return L.enrichment_ratio(a, b, size, n_first="n_a", n_second="n_b")


@register(
    "enrichment_ratios", "J2 C3", LIBRARY_SQL + " SELECT entity_id, length, depth_a, depth_b, ratio_raw, ratio, enrichment_class FROM enriched",
    "depth_a depth_b ratio_raw ratio",
)
def enrichment_ratios(spark, d):
    return enriched(spark, d)


def labelled(spark, d):
    return L.enrichment_label(L.with_context(enriched(spark, d), quality_context(spark, d)), domains=("Bacteria",))


_SIG = "CASE WHEN quality IN ('Medium-quality', 'High-quality', 'Complete') THEN 'checkv_quality=' || quality WHEN viral_genes >= 1 THEN 'viral_genes=' || viral_genes WHEN provirus = 'Yes' THEN 'provirus=Yes' ELSE 'no_viral_signal' END"
_LABEL = """CASE WHEN enrichment_class = 'enriched' AND is_viral THEN 'TP'
  WHEN enrichment_class = 'enriched' AND viral_genes = 0 AND host_genes = 0 AND NOT classified THEN 'dark_matter'
  WHEN enrichment_class = 'background' AND NOT is_viral AND domain = 'Bacteria' THEN 'TN' ELSE 'excluded' END"""


_R = lambda name, places: f"'{name}(R=' || CASE WHEN isinf(ratio) THEN 'inf' ELSE printf('%.{places}f', ratio) END || ')'"


@register(
    "enrichment_labels", "J3 C4",
    LIBRARY_SQL + f""" SELECT entity_id, {_LABEL} AS label, CASE
      WHEN enrichment_class = 'enriched' AND is_viral THEN {_R('enriched', 1)} || '+' || {_SIG}
      WHEN enrichment_class = 'enriched' AND viral_genes = 0 AND host_genes = 0 AND NOT classified THEN {_R('enriched', 1)} || '+no_checkv+unclassified'
      WHEN enrichment_class = 'enriched' AND host_genes > 0 AND viral_genes = 0 THEN {_R('enriched', 1)} || '+host_genes=' || host_genes || '+no_viral'
      WHEN enrichment_class = 'enriched' THEN {_R('enriched', 1)} || '+ambiguous(' || {_SIG} || ')'
      WHEN enrichment_class = 'background' AND NOT is_viral AND domain = 'Bacteria' THEN {_R('background', 2)} || '+' || {_SIG} || '+kraken2=' || taxon
      WHEN enrichment_class = 'background' AND is_viral THEN {_R('background', 2)} || '+viral_signal(' || {_SIG} || ')'
      WHEN enrichment_class = 'background' THEN {_R('background', 2)} || '+domain=' || domain
      WHEN enrichment_class = 'moderate' THEN {_R('moderate_enrichment', 2)} ELSE {_R('depleted', 2)} END AS reason FROM lab""",
)
def enrichment_labels(spark, d):
    return labelled(spark, d).select("entity_id", "label", "reason")


HIGH, BANDS = (2.0, 3.0, 10.0), ((0.33, 3.0), (0.5, 2.0), (0.8, 1.25))
_GRID = " UNION ALL ".join(
    f"""SELECT entity_id, 'R{h}_{lo}_{hi}' AS variant, CASE WHEN ratio > {h} AND is_viral THEN 'TP' WHEN ratio > {h} THEN 'excluded' WHEN ratio > {lo} AND ratio < {hi} AND NOT is_viral AND domain = 'Bacteria' THEN 'TN' ELSE 'excluded' END AS lab FROM lab"""
    for h in HIGH for lo, hi in BANDS
)


def _grid_counts(spark, d):
    t = labelled(spark, d)
    viral = R.quality_signal("quality", "viral_genes", "provirus") != "no_viral_signal"
    unknown = (F.col("viral_genes") == 0) & (F.col("host_genes") == 0) & ~F.col("classified")
    neg = ~viral & (F.col("domain") == "Bacteria")
    variants = {f"R{h}_{lo}_{hi}": sweeps.enrichment_variant(h, lo, hi, viral=viral, unknown=unknown, negative=neg) for h in HIGH for lo, hi in BANDS}
    rows = t.select("entity_id", sweeps.label_vector(list(variants.values())).alias("labels"))
    return sweeps.relabel_grid(_calls(spark, d, rows), list(variants))


_GRIDM = LIBRARY_SQL + _PRED + f""", g AS ({_GRID}),
 gm AS (SELECT *, {MCC_SQL} AS m FROM (SELECT model, variant, {COUNTS_SQL} FROM (SELECT b.model, variant, call, CAST(lab = 'TP' AS INTEGER) AS label FROM base b JOIN g USING (entity_id) WHERE lab <> 'excluded') GROUP BY ALL)),
 gg AS (SELECT *, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN m END AS mcc FROM gm)"""


@register("enrichment_grid", "K2", _GRIDM + " SELECT model, variant, tp, fp, tn, fn, mcc FROM gg", "mcc")
def enrichment_grid(spark, d):
    return _grid_counts(spark, d).select("model", "variant", "tp", "fp", "tn", "fn", "mcc")


@register(
    "enrichment_grid_top", "K2 E11",
    _GRIDM + """, rk AS (SELECT variant, model, row_number() OVER (PARTITION BY variant ORDER BY round(mcc, 9) DESC NULLS LAST, model) AS rn FROM gg)
    SELECT variant, max(model) FILTER (WHERE rn = 1) AS rank_1, max(model) FILTER (WHERE rn = 2) AS rank_2, max(model) FILTER (WHERE rn = 3) AS rank_3 FROM rk GROUP BY variant""",
)
def enrichment_grid_top(spark, d):
    g = _grid_counts(spark, d).withColumn("m9", F.round("mcc", 9))
    return O.top_k_wide(g, ["variant"], "m9", F.col("model"), 3, "model")


@register(
    "enrichment_label_changes", "K3 G2",
    LIBRARY_SQL + f""", chg AS (SELECT entity_id, {_LABEL} AS before, CASE WHEN ratio > 3 AND is_viral THEN 'TP' WHEN ratio > 3 AND viral_genes = 0 AND host_genes = 0 AND NOT classified THEN 'dark_matter'
      WHEN ratio > 3 THEN 'excluded' WHEN ratio > 0.8 AND ratio < 1.25 AND NOT is_viral AND domain = 'Bacteria' THEN 'TN' ELSE 'excluded' END AS after FROM lab)
    SELECT before, after, count(*) AS n FROM chg GROUP BY ALL""",
)
def enrichment_label_changes(spark, d):
    t = labelled(spark, d)
    viral = R.quality_signal("quality", "viral_genes", "provirus") != "no_viral_signal"
    unknown = (F.col("viral_genes") == 0) & (F.col("host_genes") == 0) & ~F.col("classified")
    after = sweeps.enrichment_variant(3.0, 0.8, 1.25, viral=viral, unknown=unknown, negative=~viral & (F.col("domain") == "Bacteria"))
    return t.withColumn("after", after).groupBy(F.col("label").alias("before"), "after").agg(F.count("*").alias("n"))


# ---------------------------------------------------------- read recruitment
def recruitment(spark, d):
    """Read pairs and breadth per order, from its line items."""
    li = table(spark, d, "lineitem")
    agg = li.groupBy(F.col("l_orderkey").alias("entity_id")).agg(
        F.floor(F.count("*") / 2).cast("bigint").alias("n_read_pairs"), F.least(F.lit(100.0), F.sum("l_quantity") / 2.0).alias("breadth_pct")
    )
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), F.date_format("o_orderdate", "yyyy-MM").alias("block"), F.col("o_orderpriority").alias("category"))
    return o.join(agg, "entity_id", "left").fillna(0, ["n_read_pairs", "breadth_pct"])


_REC = """, rec AS (SELECT o_orderkey AS entity_id, strftime(o_orderdate, '%Y-%m') AS block, o_orderpriority AS category, coalesce(p, 0) AS n_read_pairs, coalesce(br, 0::DOUBLE) AS breadth_pct
   FROM orders LEFT JOIN (SELECT l_orderkey, CAST(floor(count(*) / 2) AS BIGINT) AS p, least(100.0::DOUBLE, sum(l_quantity) / 2.0::DOUBLE) AS br FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey),
 st AS (SELECT *, CASE WHEN n_read_pairs = 0 THEN 'absent' WHEN n_read_pairs >= 2 AND breadth_pct >= 50 THEN 'positive' ELSE 'ambiguous' END AS status FROM rec)"""
_CM = """a / nullif(a + d, 0)::DOUBLE AS recall, a / nullif(a + b, 0)::DOUBLE AS precision, coalesce(2.0 * a / nullif(2 * a + b + d, 0)::DOUBLE, 0) AS f1,
 coalesce((a::DOUBLE * e::DOUBLE - b::DOUBLE * d::DOUBLE) / nullif(sqrt((a + b)::DOUBLE * (a + d)::DOUBLE * (e + b)::DOUBLE * (e + d)::DOUBLE), 0), 0) AS mcc,
 (a + b) / nullif(a + b + d + e, 0)::DOUBLE AS calling_rate, (a / nullif(a + d, 0)::DOUBLE) / nullif((a + b) / nullif(a + b + d + e, 0)::DOUBLE, 0) AS enrichment"""
_CC = """count(*) FILTER (WHERE call = 1 AND status = 'positive') AS a, count(*) FILTER (WHERE call = 1 AND status = 'absent') AS b,
 count(*) FILTER (WHERE call = 0 AND status = 'positive') AS d, count(*) FILTER (WHERE call = 0 AND status = 'absent') AS e"""
_CD = "recall precision f1 mcc calling_rate enrichment"
_WB = "WITH dummy AS (SELECT 1)" + _PRED + _REC


@register("recruitment_status", "J5", _WB + " SELECT entity_id, n_read_pairs, breadth_pct, status FROM st", "breadth_pct")
def recruitment_status(spark, d):
    r = recruitment(spark, d)
    return r.select("entity_id", "n_read_pairs", "breadth_pct", L.recruitment_status("n_read_pairs", "breadth_pct", 2, 50.0).alias("status"))


def recruited_calls(spark, d):
    r = recruitment(spark, d).withColumn("status", L.recruitment_status("n_read_pairs", "breadth_pct", 2, 50.0))
    return _calls(spark, d, r)


@register(
    "concordance", "D15", _WB + f" SELECT *, {_CM} FROM (SELECT model, {_CC} FROM base JOIN st USING (entity_id) WHERE status <> 'ambiguous' GROUP BY model)", _CD,
)
def concordance(spark, d):
    return C.concordance(recruited_calls(spark, d), ["model"])


@register(
    "concordance_by_category", "D16",
    _WB + f" SELECT *, {_CM} FROM (SELECT model, category, block, {_CC} FROM base JOIN st USING (entity_id) WHERE status <> 'ambiguous' GROUP BY GROUPING SETS ((model), (model, category), (model, block)))", _CD,
)
def concordance_by_category(spark, d):
    """Three grains at once; the grains share one aggregate of block x category counts."""
    from scoreloom.plans.benchmark import concordance_grains

    return concordance_grains(recruited_calls(spark, d), "category", "block")


B_GRID, P_GRID = (30.0, 50.0, 70.0), (1, 2, 3)
_BP = ", ".join(f"({b}::DOUBLE, {p})" for b in B_GRID for p in P_GRID)


@register(
    "recruitment_grid", "K1",
    _WB + f""" SELECT *, {_CM} FROM (SELECT model, min_breadth, min_pairs, {_CC} FROM (
      SELECT b.model, call, min_breadth, min_pairs, CASE WHEN n_read_pairs = 0 THEN 'absent' WHEN n_read_pairs >= min_pairs AND breadth_pct >= min_breadth THEN 'positive' ELSE 'ambiguous' END AS status
      FROM base b JOIN rec USING (entity_id) CROSS JOIN (VALUES {_BP}) v(min_breadth, min_pairs)) GROUP BY model, min_breadth, min_pairs)""",
    _CD + " min_breadth",
)
def recruitment_grid(spark, d):
    return sweeps.recruitment_grid(_calls(spark, d, recruitment(spark, d)), B_GRID, P_GRID)


@register(
    "quantile_grid", "H16",
    _WB + """, q AS (SELECT unnest([0.25, 0.5, 0.75, 0.9]) AS p), v AS (SELECT quantile_cont(breadth_pct, [0.25, 0.5, 0.75, 0.9]) AS l, quantile_cont(n_read_pairs::DOUBLE, [0.25, 0.5, 0.75, 0.9]) AS m FROM rec WHERE n_read_pairs > 0)
    SELECT DISTINCT 'breadth' AS axis, CAST(round_even(x / 5, 0) * 5 AS INTEGER) AS grid_value FROM (SELECT unnest(l) AS x FROM v) UNION SELECT 'breadth', 70
    UNION SELECT 'pairs', CAST(round_even(x, 0) AS INTEGER) FROM (SELECT unnest(m) AS x FROM v) WHERE round_even(x, 0) > 1 UNION SELECT 'pairs', 10""",
)
def quantile_grid(spark, d):
    r = recruitment(spark, d).filter(F.col("n_read_pairs") > 0)
    a = T.quantile_grid(r, "breadth_pct", step=5.0, anchor=70).select(F.lit("breadth").alias("axis"), "grid_value")
    b = T.quantile_grid(r, "n_read_pairs", step=None, anchor=10).select(F.lit("pairs").alias("axis"), "grid_value")
    return a.unionByName(b)


@register(
    "two_setting_comparison", "K8 G2",
    _PRED.replace(", models", "WITH models", 1) + """, x AS (SELECT o_orderkey AS entity_id, o_orderstatus = 'F' AS pos FROM orders),
      s AS (SELECT entity_id, pos, coalesce(max(l_quantity) >= 45, false) AS lo, coalesce(max(l_quantity) >= 49, false) AS hi FROM x LEFT JOIN lineitem ON l_orderkey = entity_id GROUP BY ALL)
    SELECT pos, CASE WHEN lo AND hi THEN 'kept' WHEN lo THEN 'lost' WHEN hi THEN 'gained' ELSE 'absent' END AS change, count(*) AS n FROM s GROUP BY ALL""",
)
def two_setting_comparison(spark, d):
    """Per-entity flow between two settings of one model, split by truth."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), (F.col("o_orderstatus") == "F").alias("pos"))
    base = predictions(spark, d).filter(F.col("model") == "qty")
    one = lambda thr: D.dense_calls(o, base, [D.Rule("qty", thr)])
    change = S.membership_change(one(0.9), one(0.98), ["entity_id", "pos"])
    return change.groupBy("pos", "change").agg(F.count("*").alias("n"))
