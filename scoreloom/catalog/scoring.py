"""Decision rules, joins, confusion counts, curves and thresholds on the order/line-item tables."""

from pyspark.sql import functions as F

from scoreloom.catalog.base import (
    COUNTS_SQL, M_DOUBLES, MCC_SQL, METRICS_SQL, MODELS, RULES, W, W_TRUTH, calls, metric_sql, predictions, register, table, truth,
)
from scoreloom.functions import metrics as M
from scoreloom.functions import rules as R
from scoreloom.operators import confusion as C
from scoreloom.operators import curves as V
from scoreloom.operators import decide as D
from scoreloom.operators import ordered as O
from scoreloom.plans import sweeps


def rank_models(spark, d):
    table_ = C.metric_table(calls(spark, d))
    return O.rank_by(table_, "mcc", tie=["model"]).orderBy("rank")


register(
    "rank_models_by_mcc", "B1 B2 C1 D1 D2 F1 E6",
    W + f"SELECT *, CAST(row_number() OVER (ORDER BY mcc DESC, model) AS INTEGER) AS rank FROM ({metric_sql('model')})", M_DOUBLES,
)(rank_models)


@register("decision_calls", "B1 B2 C1", W + "SELECT entity_id, model, score, pvalue, emitted, call FROM calls", "score pvalue")
def decision_calls(spark, d):
    c = D.dense_calls(truth(spark, d), predictions(spark, d), RULES, with_pvalue=True)
    return c.select("entity_id", "model", "score", "pvalue", "emitted", "call")


@register(
    "threshold_zero_presence", "B2 B3",
    W + """SELECT model, count(*) FILTER (WHERE score >= 0 AND (pvalue_below IS NULL OR pvalue < pvalue_below)) AS called,
      count(*) FILTER (WHERE emitted AND score >= 0 AND (pvalue_below IS NULL OR pvalue < pvalue_below)) AS called_present
    FROM grid GROUP BY model""",
)
def threshold_zero_presence(spark, d):
    grid = D.dense_grid(truth(spark, d), predictions(spark, d), D.with_thresholds(RULES, 0.0))
    both = D.decide(D.decide(grid), require_present=True, name="call_present")
    return both.groupBy("model").agg(F.sum("call").alias("called"), F.sum("call_present").alias("called_present"))


@register(
    "threshold_override", "B3",
    W + f"SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, {COUNTS_SQL} FROM (SELECT *  REPLACE (CAST(score >= CASE model WHEN 'qty' THEN 0.5 ELSE threshold END AND (pvalue_below IS NULL OR pvalue < pvalue_below) AS INTEGER) AS call) FROM calls) GROUP BY model)",
    "mcc",
)
def threshold_override(spark, d):
    rules = D.with_thresholds(RULES, {"qty": 0.5})
    c = C.confusion(D.dense_calls(truth(spark, d), predictions(spark, d), rules))
    return c.withColumn("mcc", M.mcc())


@register(
    "tier_filtered_metrics", "B4 B6",
    W + metric_sql("model", "(SELECT * REPLACE (CASE WHEN stratum IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS label) FROM calls WHERE stratum IN ('1-URGENT', '2-HIGH', '5-LOW'))"),
    M_DOUBLES,
)
def tier_filtered_metrics(spark, d):
    """Positives are tiers 1..2, negatives tier 0, all else is left out."""
    tier = F.when(F.col("stratum") == "1-URGENT", 1).when(F.col("stratum") == "2-HIGH", 2).when(F.col("stratum") == "5-LOW", 0).otherwise(3)
    t = truth(spark, d).withColumn("tier", tier)
    ready = t.filter(F.col("tier").isin(0, 1, 2)).withColumn("label", (F.col("tier") > 0).cast("int"))
    return C.metric_table(D.dense_calls(ready, predictions(spark, d), RULES))


@register("length_gate_metrics", "B5", W + metric_sql("model", where="length >= 250000"), M_DOUBLES)
def length_gate_metrics(spark, d):
    t = truth(spark, d).filter(F.col("length") >= 250000)
    return C.metric_table(D.dense_calls(t, predictions(spark, d), RULES))


@register(
    "length_bin_metrics", "B7 D3 D4",
    W + metric_sql("model, CASE WHEN length < 100000 THEN 'S' WHEN length < 250000 THEN 'M' WHEN length < 400000 THEN 'L' ELSE 'XL' END AS length_bin"),
    M_DOUBLES,
)
def length_bin_metrics(spark, d):
    c = calls(spark, d).withColumn("length_bin", R.length_bin("length", (100000, 250000, 400000), ("S", "M", "L", "XL")))
    return C.stratified_metrics(c, "length_bin")


@register("confusion_by_block", "D1", W + f"SELECT model, block, {COUNTS_SQL} FROM calls GROUP BY ALL")
def confusion_by_block(spark, d):
    return C.confusion(calls(spark, d), ("model", "block"))


@register("metrics_by_stratum", "D3", W + metric_sql("model, stratum"), M_DOUBLES)
def metrics_by_stratum(spark, d):
    return C.stratified_metrics(calls(spark, d), "stratum")


@register(
    "metrics_by_stratum_min_size", "D4",
    W + f"SELECT * FROM ({metric_sql('model, block')}) WHERE n_total >= 180 AND tp + fn > 0 AND fp + tn > 0", M_DOUBLES,
)
def metrics_by_stratum_min_size(spark, d):
    return C.stratified_metrics(calls(spark, d), "block", min_size=180, two_class=True)


@register(
    "category_vs_all_negatives", "D5",
    W + f"""SELECT *, {METRICS_SQL} FROM (SELECT p.model, p.stratum, p.tp, n.fp, n.tn, p.fn FROM
      (SELECT model, stratum, count(*) FILTER (WHERE call = 1) AS tp, count(*) FILTER (WHERE call = 0) AS fn FROM calls WHERE label = 1 GROUP BY ALL HAVING count(*) >= 5) p
      JOIN (SELECT model, count(*) FILTER (WHERE call = 1) AS fp, count(*) FILTER (WHERE call = 0) AS tn FROM calls WHERE label = 0 GROUP BY ALL) n USING (model))""",
    M_DOUBLES,
)
def category_vs_all_negatives(spark, d):
    return C.category_vs_negatives(calls(spark, d), "stratum")


@register("first_tier_rescoring", "D6", W + metric_sql("model", where="label = 0 OR stratum = '1-URGENT'"), M_DOUBLES)
def first_tier_rescoring(spark, d):
    c = calls(spark, d).filter((F.col("label") == 0) | (F.col("stratum") == "1-URGENT"))
    return C.metric_table(c)


@register(
    "macro_summary", "D7",
    W + """, per AS (SELECT model, source, label, count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE AS rate FROM calls GROUP BY ALL),
    worst AS (SELECT model, source, row_number() OVER (PARTITION BY model ORDER BY rate DESC, source) AS rn FROM per WHERE label = 0)
    SELECT p.model, avg(rate) FILTER (WHERE label = 1) AS macro_recall, min(rate) FILTER (WHERE label = 1) AS min_recall,
      max(rate) FILTER (WHERE label = 1) AS max_recall, avg(rate) FILTER (WHERE label = 0) AS macro_fpr, max(rate) FILTER (WHERE label = 0) AS max_fpr,
      any_value(w.source) AS worst_negative_source, count(*) FILTER (WHERE label = 1) AS n_positive_sources, count(*) FILTER (WHERE label = 0) AS n_negative_sources
    FROM per p JOIN worst w ON w.model = p.model AND w.rn = 1 GROUP BY p.model""",
    "macro_recall min_recall max_recall macro_fpr max_fpr",
)
def macro_summary(spark, d):
    return C.macro_summary(calls(spark, d), "source")


@register(
    "recall_by_category", "D8",
    W + "SELECT model, stratum, count(*) AS n, count(*) FILTER (WHERE call = 1) AS k, count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE AS recall FROM calls WHERE label = 1 GROUP BY ALL",
    "recall",
)
def recall_by_category(spark, d):
    pos = calls(spark, d).filter(F.col("label") == 1)
    agg = pos.groupBy("model", "stratum").agg(F.count("*").alias("n"), F.count_if(F.col("call") == 1).alias("k"))
    return agg.withColumn("recall", F.col("k") / F.col("n"))


@register(
    "family_aggregate", "D9",
    W + f"""SELECT *, {METRICS_SQL} FROM (SELECT family, {COUNTS_SQL}, string_agg(DISTINCT model, ',' ORDER BY model) AS members FROM calls GROUP BY family)""",
    M_DOUBLES,
)
def family_aggregate(spark, d):
    return C.family_metrics(C.confusion(calls(spark, d), ("model", "family")))


@register(
    "model_coverage", "D10",
    W + "SELECT model, count(*) AS n_entities, count(*) FILTER (WHERE emitted) AS n_scored, count(*) FILTER (WHERE emitted) / count(*)::DOUBLE AS coverage FROM grid GROUP BY model",
    "coverage",
)
def model_coverage(spark, d):
    return C.coverage(calls(spark, d))


LENGTHS = (0, 50000, 100000, 200000, 300000, 400000)
_L = ", ".join(f"({x}::BIGINT)" for x in LENGTHS)


@register(
    "coverage_length_sweep", "D11",
    W + f""", g AS (SELECT model, min_length, count(*) AS n_entities, count(*) FILTER (WHERE emitted) AS n_scored FROM grid JOIN (VALUES {_L}) v(min_length) ON length >= min_length GROUP BY ALL)
    SELECT *, n_scored / n_entities::DOUBLE AS coverage, bool_and(n_scored / n_entities::DOUBLE >= 0.95) OVER (PARTITION BY min_length) AS all_covered FROM g""",
    "coverage",
)
def coverage_length_sweep(spark, d):
    out = sweeps.coverage_audit(calls(spark, d), LENGTHS, least=0.95)
    return out.withColumn("min_length", F.col("min_length").cast("bigint"))


@register(
    "metrics_length_sweep", "K5 B5",
    W + f"SELECT *, {METRICS_SQL} FROM (SELECT model, min_length, {COUNTS_SQL} FROM calls JOIN (VALUES {_L}) v(min_length) ON length >= min_length GROUP BY ALL)",
    M_DOUBLES,
)
def metrics_length_sweep(spark, d):
    out = sweeps.min_length_metrics(calls(spark, d), LENGTHS)
    return out.withColumn("min_length", F.col("min_length").cast("bigint"))


@register(
    "taxon_stress_test", "D12",
    W + "SELECT model, count(*) AS n_neg, count(*) FILTER (WHERE call = 1) AS fp, count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE AS fpr FROM calls WHERE label = 0 AND contains(lower(notes), 'lactobacillus') GROUP BY model",
    "fpr",
)
def taxon_stress_test(spark, d):
    neg = calls(spark, d).filter((F.col("label") == 0) & R.mentions("notes", ("lactobacillus",)))
    agg = neg.groupBy("model").agg(F.count("*").alias("n_neg"), F.count_if(F.col("call") == 1).alias("fp"))
    return agg.withColumn("fpr", F.col("fp") / F.col("n_neg"))


_GROUND = """CASE WHEN contains(notes, 'Homo sapiens') OR contains(notes, '9606') THEN 'human' WHEN notes LIKE 'kraken2:%' THEN 'bact_arch' WHEN notes LIKE 'checkv%' THEN 'checkv_host' END"""


@register(
    "fpr_by_grounding", "B19 D13",
    W + f""", g AS (SELECT model, {_GROUND} AS grounding, count(*) AS n, count(*) FILTER (WHERE call = 1) AS fp FROM calls WHERE label = 0 GROUP BY ALL)
    SELECT model, max(fp / n::DOUBLE) FILTER (WHERE grounding = 'human') AS human, max(fp / n::DOUBLE) FILTER (WHERE grounding = 'bact_arch') AS bact_arch,
      max(fp / n::DOUBLE) FILTER (WHERE grounding = 'checkv_host') AS checkv_host,
      max(fp / n::DOUBLE) FILTER (WHERE grounding = 'human') - sum(fp) FILTER (WHERE grounding <> 'human') / sum(n) FILTER (WHERE grounding <> 'human')::DOUBLE AS human_minus_other
    FROM g WHERE grounding IS NOT NULL GROUP BY model""",
    "human bact_arch checkv_host human_minus_other",
)
def fpr_by_grounding(spark, d):
    neg = calls(spark, d).filter(F.col("label") == 0).withColumn("g", R.grounding_class("notes")).filter(F.col("g").isNotNull())
    per = neg.groupBy("model", "g").agg(F.count("*").alias("n"), F.count_if(F.col("call") == 1).alias("fp"))
    rate = lambda g: F.max(F.when(F.col("g") == g, F.col("fp") / F.col("n")))
    other = F.col("g") != "human"
    return per.groupBy("model").agg(
        rate("human").alias("human"), rate("bact_arch").alias("bact_arch"), rate("checkv_host").alias("checkv_host"),
        (rate("human") - F.sum(F.when(other, F.col("fp"))) / F.sum(F.when(other, F.col("n")))).alias("human_minus_other"),
    )


@register(
    "false_positive_strata", "D14",
    W + """, g AS (SELECT model, stratum, count(*) AS n_neg, count(*) FILTER (WHERE call = 1) AS fp FROM calls WHERE label = 0 GROUP BY ALL)
    SELECT *, coalesce(fp / nullif(sum(fp) OVER (PARTITION BY model), 0)::DOUBLE, 0) AS share_of_fp, fp / n_neg::DOUBLE AS fp_rate FROM g""",
    "share_of_fp fp_rate",
)
def false_positive_strata(spark, d):
    return C.false_positive_strata(calls(spark, d), "stratum")


_PER_SAMPLE = f"(SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, block, {COUNTS_SQL} FROM calls GROUP BY ALL))"


@register(
    "pooled_vs_mean_per_sample", "D17",
    W + f"SELECT model, any_value(pooled) AS pooled_mcc, avg(mcc) AS mean_mcc FROM {_PER_SAMPLE} JOIN (SELECT model AS m2, {MCC_SQL} AS pooled FROM (SELECT model, {COUNTS_SQL} FROM calls GROUP BY ALL)) ON m2 = model GROUP BY model",
    "pooled_mcc mean_mcc",
)
def pooled_vs_mean_per_sample(spark, d):
    per = C.confusion(calls(spark, d), ("model", "block")).withColumn("mcc", M.mcc())
    agg = per.groupBy("model").agg(*[F.sum(c).alias(c) for c in M.COUNTS], F.avg("mcc").alias("mean_mcc"))
    return agg.select("model", M.mcc().alias("pooled_mcc"), "mean_mcc")


@register(
    "arm_rates", "D18 B25",
    W + f""", g AS (SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, arm, count(DISTINCT block) AS n, {COUNTS_SQL} FROM calls GROUP BY ALL)),
    r AS (SELECT model, arm, (tp + fp + tn + fn) / n::DOUBLE AS per_sample, (tp + fn) / n::DOUBLE AS positives, (tp + fp) / n::DOUBLE AS called,
        tp / (tp + fn)::DOUBLE AS recall, fp / (fp + tn)::DOUBLE AS fpr, tp / nullif(tp + fp, 0)::DOUBLE AS precision, mcc FROM g)
    SELECT l.model, l.per_sample AS per_sample_low, h.per_sample AS per_sample_high, h.recall - l.recall AS recall_delta, h.fpr - l.fpr AS fpr_delta,
      h.precision - l.precision AS precision_delta, h.mcc - l.mcc AS mcc_delta, h.positives / l.positives AS positive_ratio, h.called / l.called AS call_ratio,
      (h.called / l.called) / (h.positives / l.positives) AS calls_vs_positives
    FROM r l JOIN r h ON l.model = h.model AND l.arm = 'low' AND h.arm = 'high'""",
    "per_sample_low per_sample_high recall_delta fpr_delta precision_delta mcc_delta positive_ratio call_ratio calls_vs_positives",
)
def arm_rates(spark, d):
    from scoreloom.plans.contrast import arm_contrast

    counts = C.confusion(calls(spark, d), ("model", "block", "arm"))
    return arm_contrast(counts)


@register(
    "recall_by_stratum_delta", "D19",
    W + """, g AS (SELECT model, arm, count(DISTINCT source) AS n_sources, count(*) AS n, count(*) FILTER (WHERE call = 1) AS tp FROM calls WHERE label = 1 GROUP BY ALL)
    SELECT l.model, l.n_sources AS n_sources_low, h.n_sources AS n_sources_high, l.tp / l.n::DOUBLE AS recall_low, h.tp / h.n::DOUBLE AS recall_high,
      h.tp / h.n::DOUBLE - l.tp / l.n::DOUBLE AS delta FROM g l JOIN g h ON l.model = h.model AND l.arm = 'low' AND h.arm = 'high'""",
    "recall_low recall_high delta",
)
def recall_by_stratum_delta(spark, d):
    # Distinct sources come from a second, small aggregate: one row per (model, arm, source).
    per = calls(spark, d).filter(F.col("label") == 1).groupBy("model", "arm", "source").agg(
        F.count("*").alias("n"), F.count_if(F.col("call") == 1).alias("tp")
    )
    on = lambda a, c: F.sum(F.when(F.col("arm") == a, F.col(c)))
    low, high = on("low", "tp") / on("low", "n"), on("high", "tp") / on("high", "n")
    return per.groupBy("model").agg(
        F.count_if(F.col("arm") == "low").alias("n_sources_low"), F.count_if(F.col("arm") == "high").alias("n_sources_high"),
        low.alias("recall_low"), high.alias("recall_high"), (high - low).alias("delta"),
    )


@register(
    "group_rates", "D20",
    W + """, g AS (SELECT model, grp, count(*) AS n, count(*) FILTER (WHERE call = 1) AS k FROM (
        SELECT model, call, unnest(CASE WHEN arm = 'high' AND length >= 250000 THEN ['all', 'high', 'long'] WHEN arm = 'high' THEN ['all', 'high']
          WHEN length >= 250000 THEN ['all', 'long'] ELSE ['all'] END) AS grp FROM calls) GROUP BY ALL)
    SELECT model, grp, format('{}/{} ({:.1f}%)', k, n, k * 100.0::DOUBLE / n) AS rate FROM g""",
)
def group_rates(spark, d):
    """Every entity counts in each group it belongs to."""
    groups = F.array_compact(F.array(F.lit("all"), F.when(F.col("arm") == "high", "high"), F.when(F.col("length") >= 250000, "long")))
    rows = calls(spark, d).select("model", "call", F.explode(groups).alias("grp"))
    agg = rows.groupBy("model", "grp").agg(F.count("*").alias("n"), F.count_if(F.col("call") == 1).alias("k"))
    return agg.select("model", "grp", F.format_string("%d/%d (%.1f%%)", "k", "n", F.col("k") * 100.0 / F.col("n")).alias("rate"))


@register(
    "detections_per_entity", "D21",
    W + "SELECT entity_id, count(*) FILTER (WHERE call = 1) AS n_models, coalesce(string_agg(model, ',' ORDER BY model) FILTER (WHERE call = 1), '') AS models FROM calls GROUP BY entity_id",
)
def detections_per_entity(spark, d):
    hit = F.col("call") == 1
    return calls(spark, d).groupBy("entity_id").agg(
        F.count_if(hit).alias("n_models"), F.concat_ws(",", F.sort_array(F.collect_list(F.when(hit, F.col("model"))))).alias("models")
    )


@register(
    "or_aggregate_by_family", "D38",
    W + f"SELECT *, {MCC_SQL} AS mcc FROM (SELECT family, {COUNTS_SQL} FROM (SELECT entity_id, family, label, max(call) AS call FROM calls GROUP BY ALL) GROUP BY family)",
    "mcc",
)
def or_aggregate_by_family(spark, d):
    any_call = calls(spark, d).groupBy("entity_id", "family", "label").agg(F.max("call").alias("call"))
    return C.confusion(any_call, ("family",)).withColumn("mcc", M.mcc())


@register(
    "correctness_matrix", "D39",
    W + """SELECT entity_id, max(CAST(call = label AS INTEGER)) FILTER (WHERE model = 'disc') AS disc, max(CAST(call = label AS INTEGER)) FILTER (WHERE model = 'qty') AS qty,
      max(CAST(call = label AS INTEGER)) FILTER (WHERE model = 'price') AS price, max(CAST(call = label AS INTEGER)) FILTER (WHERE model = 'tax') AS tax FROM calls GROUP BY entity_id""",
)
def correctness_matrix(spark, d):
    right = (F.col("call") == F.col("label")).cast("int")
    return calls(spark, d).groupBy("entity_id").agg(*[F.max(F.when(F.col("model") == m, right)).alias(m) for m in MODELS])


_HIST = """, h AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM calls GROUP BY ALL),
 c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg
       FROM h WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@register(
    "average_precision", "E1",
    W + _HIST + "SELECT model, CAST(any_value(n_pos) AS BIGINT) AS n_pos, CAST(any_value(n_neg) AS BIGINT) AS n_neg, count(*) AS n_scores, sum(pos * cp / (cp + cn)::DOUBLE) / any_value(n_pos) AS auprc FROM c GROUP BY model",
    "auprc",
)
def average_precision(spark, d):
    return V.average_precision(calls(spark, d))


@register(
    "average_precision_two_level", "E1",
    W + _HIST + "SELECT model, sum(pos * cp / (cp + cn)::DOUBLE) / any_value(n_pos) AS auprc FROM c GROUP BY model", "auprc",
)
def average_precision_two_level(spark, d):
    """Same measure with ranges refined twice, the setting for clustered scores."""
    return V.average_precision(calls(spark, d), ranges=64).select("model", "auprc")


@register(
    "average_precision_by_arm", "E1 D3",
    W + _HIST.replace("model, score,", "model, arm, score,").replace("PARTITION BY model", "PARTITION BY model, arm")
    + "SELECT model, arm, sum(pos * cp / (cp + cn)::DOUBLE) / any_value(n_pos) AS auprc FROM c GROUP BY ALL", "auprc",
)
def average_precision_by_arm(spark, d):
    return V.average_precision(calls(spark, d), ("model", "arm")).select("model", "arm", "auprc")


@register(
    "pr_curve_points", "E2",
    W + """, h AS (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) AS n FROM calls WHERE emitted GROUP BY ALL),
    c AS (SELECT model, score, sum(pos) OVER w AS cp, sum(n) OVER w AS ca FROM h WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
    t AS (SELECT model, count(*) FILTER (WHERE label = 1) AS n_pos FROM calls GROUP BY model)
    SELECT model, score AS threshold, cp / n_pos::DOUBLE AS recall, cp / ca::DOUBLE AS precision FROM c JOIN t USING (model)
    UNION ALL SELECT model, NULL, 0.0, 1.0 FROM t""",
    "threshold recall precision",
)
def pr_curve_points(spark, d):
    return V.pr_points(calls(spark, d))


_THR = """, cand AS (SELECT DISTINCT model, score FROM grid WHERE emitted UNION SELECT model, 0.0 FROM models UNION SELECT model, 1.0 FROM models),
 h AS (SELECT model, score, sum(pos) AS pos, sum(neg) AS neg FROM (
   SELECT model, score, CAST(label = 1 AS INTEGER) AS pos, CAST(label = 0 AS INTEGER) AS neg FROM grid WHERE pvalue_below IS NULL OR pvalue < pvalue_below
   UNION ALL SELECT model, score, 0, 0 FROM cand) GROUP BY ALL),
 n AS (SELECT model, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM grid GROUP BY model),
 c AS (SELECT model, score AS threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM h WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
 pts AS (SELECT c.*, n_neg - fp AS tn, n_pos - tp AS fn FROM c JOIN n USING (model)),
 sc AS (SELECT *, """ + MCC_SQL + """ AS mcc FROM pts)"""


@register("threshold_points", "E3", W + _THR + "SELECT * FROM sc", "threshold mcc")
def threshold_points(spark, d):
    return V.threshold_metrics(calls(spark, d))


@register(
    "best_threshold", "E3",
    W + _THR + f""", dflt AS (SELECT model, {MCC_SQL} AS m FROM (SELECT model, {COUNTS_SQL} FROM calls GROUP BY model)),
    best AS (SELECT model, threshold, round(mcc, 4) AS m4, row_number() OVER (PARTITION BY model ORDER BY round(mcc, 4) DESC, threshold) AS rn, count(*) OVER (PARTITION BY model) AS n_thresholds FROM sc)
    SELECT b.model, n_thresholds, k.threshold AS default_threshold, round(d.m, 4) AS default_mcc,
      CASE WHEN m4 > round(d.m, 4) THEN b.threshold ELSE k.threshold END AS best_threshold, CASE WHEN m4 > round(d.m, 4) THEN m4 ELSE round(d.m, 4) END AS best_mcc,
      round(CASE WHEN m4 > round(d.m, 4) THEN m4 ELSE round(d.m, 4) END - round(d.m, 4), 4) AS delta_mcc
    FROM best b JOIN dflt d USING (model) JOIN models k USING (model) WHERE rn = 1""",
    "default_threshold default_mcc best_threshold best_mcc delta_mcc",
)
def best_threshold(spark, d):
    c = calls(spark, d)
    base = C.confusion(c, ("model", "threshold")).select("model", F.col("threshold").alias("default_threshold"), M.mcc().alias("default_mcc"))
    return V.best_threshold(c, base)


SWEEP = tuple(round(0.05 * i, 2) for i in range(1, 20))
_S = ", ".join(f"({x}::DOUBLE)" for x in SWEEP)


@register(
    "threshold_sweep", "E4",
    W + f"""SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, {MCC_SQL} AS mcc FROM (
      SELECT model, t AS threshold, count(*) FILTER (WHERE label = 1 AND score >= t) AS tp, count(*) FILTER (WHERE label = 0 AND score >= t) AS fp,
        count(*) FILTER (WHERE label = 0 AND score < t) AS tn, count(*) FILTER (WHERE label = 1 AND score < t) AS fn
      FROM grid CROSS JOIN (VALUES {_S}) v(t) GROUP BY ALL)""",
    "threshold precision recall mcc",
)
def threshold_sweep(spark, d):
    return V.threshold_sweep(calls(spark, d), SWEEP)


@register(
    "rank_min_by_block", "E6 K6",
    W + f"SELECT model, block, mcc, CAST(rank() OVER (PARTITION BY block ORDER BY round(mcc, 9) DESC) AS INTEGER) AS rank FROM {_PER_SAMPLE}", "mcc",
)
def rank_min_by_block(spark, d):
    per = C.confusion(calls(spark, d), ("model", "block")).select("model", "block", M.mcc().alias("mcc"), F.round(M.mcc(), 9).alias("m9"))
    return O.rank_by(per, "m9", group=["block"], method="min").drop("m9")


@register(
    "mid_rank_by_block", "E7",
    W + f"SELECT model, block, rank() OVER (PARTITION BY model ORDER BY round(mcc, 9)) + (count(*) OVER (PARTITION BY model, round(mcc, 9)) - 1) / 2.0::DOUBLE AS mid_rank FROM {_PER_SAMPLE}", "mid_rank",
)
def mid_rank_by_block(spark, d):
    per = C.confusion(calls(spark, d), ("model", "block")).select("model", "block", F.round(M.mcc(), 9).alias("m9"))
    return O.mid_ranks(per, "m9", group=["model"]).drop("m9")


@register(
    "mid_rank_entities", "E7",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS mid_rank FROM lineitem", "mid_rank",
)
def mid_rank_entities(spark, d):
    """Ranks over one unbounded group: distributed running totals instead of a global sort."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return O.mid_ranks_large(li, "l_extendedprice")


@register(
    "top_models_per_block", "E11",
    W + f""", r AS (SELECT block, model, mcc, row_number() OVER (PARTITION BY block ORDER BY round(mcc, 9) DESC, model) AS rn FROM {_PER_SAMPLE})
    SELECT block, max(format('{{}} ({{:.3f}})', model, mcc)) FILTER (WHERE rn = 1) AS rank_1, max(format('{{}} ({{:.3f}})', model, mcc)) FILTER (WHERE rn = 2) AS rank_2,
      max(format('{{}} ({{:.3f}})', model, mcc)) FILTER (WHERE rn = 3) AS rank_3 FROM r GROUP BY block""",
)
def top_models_per_block(spark, d):
    per = C.confusion(calls(spark, d), ("model", "block")).select("model", "block", F.round(M.mcc(), 9).alias("mcc"))
    return O.top_k_wide(per, ["block"], "mcc", F.format_string("%s (%.3f)", "model", "mcc"), 3, "model")


@register(
    "threshold_calibrated_metrics", "E3 K11",
    W + _THR + f""", best AS (SELECT model, threshold, row_number() OVER (PARTITION BY model ORDER BY round(mcc, 4) DESC, threshold) AS rn FROM sc)
    SELECT *, {MCC_SQL} AS mcc FROM (SELECT model, block, {COUNTS_SQL} FROM (SELECT g.model, block, label, CAST(score >= b.threshold AND (pvalue_below IS NULL OR pvalue < pvalue_below) AS INTEGER) AS call
      FROM grid g JOIN best b ON b.model = g.model AND b.rn = 1) GROUP BY ALL)""",
    "mcc",
)
def threshold_calibrated_metrics(spark, d):
    """Thresholds learned once on all blocks, then applied per block."""
    c = calls(spark, d)
    pts = V.threshold_metrics(c).withColumn("m4", F.round("mcc", 4))
    best = pts.groupBy("model").agg(F.min_by("threshold", F.struct(-F.col("m4"), F.col("threshold"))).alias("threshold"))
    applied = D.decide(c.drop("threshold", "call").join(best, "model"))
    return C.confusion(applied, ("model", "block")).withColumn("mcc", M.mcc())
