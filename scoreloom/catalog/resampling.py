"""Bootstraps, permutations and hypothesis tests over the order blocks."""

from pyspark.sql import functions as F

from scoreloom.catalog.base import COUNTS_SQL, MCC_SQL, MODELS, RULES, W, calls, register, table
from scoreloom.functions import metrics as M
from scoreloom.functions import pvalues as P
from scoreloom.functions.scalars import ratio
from scoreloom.operators import confusion as C
from scoreloom.operators import curves as V
from scoreloom.operators import ordered as O
from scoreloom.operators import replicates as R
from scoreloom.operators import resample as B
from scoreloom.operators import stats as T
from scoreloom.plans import contrast as K
from scoreloom.plans import studies as ST
from scoreloom.sources.scratch import settle

# The published number of block replicates, and of permutations below.
REPS, SEED = 2000, 12345


def block_counts(spark, d, *extra):
    """Models x blocks counts, written once: everything after them is small."""
    return settle(C.confusion(calls(spark, d), ("model", "block", *extra)))


# Dense index in the operator's order, hashed draws and replicate counts, in SQL.
def _idx(key: str, rel: str, alias: str = "idx") -> str:
    return f"{alias} AS (SELECT {key}, row_number() OVER (ORDER BY substr(md5({key}::VARCHAR), 1, 3), {key}) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {rel}))"


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


BC = f", bc AS (SELECT model, block, {COUNTS_SQL} FROM calls GROUP BY ALL)"
WEIGHTS = f""", {_idx('block', 'bc')},
 w AS (SELECT b, pos.block, count(*) AS w FROM (SELECT b, {_draw(f"'{SEED}'", 'b', 'idx')} % n AS p FROM idx, range({REPS}) r(b)) dr JOIN idx pos ON pos.idx = dr.p GROUP BY ALL),
 rep AS (SELECT model, b, CAST(sum(w * tp) AS BIGINT) AS tp, CAST(sum(w * fp) AS BIGINT) AS fp, CAST(sum(w * tn) AS BIGINT) AS tn, CAST(sum(w * fn) AS BIGINT) AS fn FROM bc JOIN w USING (block) GROUP BY ALL),
 rm AS (SELECT *, {MCC_SQL} AS mcc FROM rep)"""
WB = W + BC + WEIGHTS


def weights(spark, d, blocks):
    return B.unit_weights(blocks, ["block"], REPS, SEED)


def replicates(spark, d):
    counts = block_counts(spark, d)
    w = weights(spark, d, counts.select("block").distinct())
    return counts, B.block_replicates(counts, w, ["block"])


@register("block_bootstrap_weights", "I4", WB + " SELECT CAST(b AS INTEGER) AS b, block, w FROM w")
def block_bootstrap_weights(spark, d):
    blocks = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("block")).distinct()
    return weights(spark, d, blocks)


@register("block_bootstrap_counts", "I4", WB + " SELECT model, CAST(b AS INTEGER) AS b, tp, fp, tn, fn FROM rep")
def block_bootstrap_counts(spark, d):
    return replicates(spark, d)[1]


@register(
    "block_bootstrap_ci", "I4 H17",
    WB + f""" SELECT model, quantile_cont(mcc, 0.025) AS lo, quantile_cont(mcc, 0.975) AS hi, stddev_samp(mcc) AS se, count(*) AS n_valid,
      (SELECT {MCC_SQL} FROM (SELECT {COUNTS_SQL} FROM calls c WHERE c.model = rm.model)) AS mcc FROM rm GROUP BY model""",
    "lo hi se mcc",
)
def block_bootstrap_ci(spark, d):
    counts, reps = replicates(spark, d)
    ci = B.interval(reps.withColumn("mcc", M.mcc()), "mcc")
    point = counts.groupBy("model").agg(*[F.sum(c).alias(c) for c in M.COUNTS]).select("model", M.mcc().alias("mcc"))
    return ci.join(point, "model")


_PAIRS = ", pd AS (SELECT a.model AS model_a, z.model AS model_b, a.b, a.mcc - z.mcc AS diff FROM rm a JOIN rm z ON a.b = z.b AND a.model < z.model)"


@register(
    "paired_mcc_difference", "I2 C16",
    WB + _PAIRS + " SELECT model_a, model_b, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi, stddev_samp(diff) AS se, count(*) AS n_valid FROM pd GROUP BY ALL",
    "lo hi se",
)
def paired_mcc_difference(spark, d):
    reps = replicates(spark, d)[1].withColumn("mcc", M.mcc())
    return B.interval(B.paired_difference(reps), "diff", ["model_a", "model_b"])


@register(
    "margin_verdicts", "I9",
    WB + _PAIRS + """ SELECT model_a, model_b, avg((diff >= 0)::INT) AS p_at_least, avg((diff <= -0.02)::INT) AS p_below_margin,
      CASE WHEN quantile_cont(diff, 0.975) < -0.02 THEN 'below' WHEN quantile_cont(diff, 0.025) > 0.02 THEN 'above' ELSE 'not separated' END AS verdict FROM pd GROUP BY ALL""",
    "p_at_least p_below_margin",
)
def margin_verdicts(spark, d):
    reps = replicates(spark, d)[1].withColumn("mcc", M.mcc())
    return ST.margin_verdict(B.paired_difference(reps), ["model_a", "model_b"], margin=0.02)


# Replicate vectors in SQL: the residues of keys and replicates, the uniform numbers, and Poisson variables by inversion.
E_REPS = 1000
_P = R.PRIME


def _residues(seed, key, a="a", c="c"):
    half = lambda i, n: f"('0x' || substr(md5(concat_ws('|', '{seed}', {key})), {i}, 8))::BIGINT % {_P} AS {n}"
    return f"{half(1, a)}, {half(9, c)}"


def _uniform(rel, keep, a="a", c="c"):
    """Rows of ``rel`` x replicates with their uniform number u."""
    return f"(SELECT {keep}, b, x4 * x % {_P} AS u FROM (SELECT *, x2 * x2 % {_P} AS x4 FROM (SELECT *, x * x % {_P} AS x2 FROM (SELECT {keep}, b, ({a} + {c} * r) % {_P} AS x FROM {rel}, rb))))"


_steps = lambda mean: " + ".join(f"(u >= {t})::INTEGER" for t in R.STEPS[mean]) or "0"


def _draws(seed):
    """``ew``: entity_id, b, w of every draw; ``nw``: the same where blocks are drawn first."""
    return f""", rb AS (SELECT b, ('0x' || substr(md5(concat_ws('|', '{seed}', 'b', b)), 1, 8))::BIGINT % {_P} AS r FROM range({E_REPS}) t(b)),
 par AS (SELECT entity_id, block, {_residues(seed, 'entity_id')} FROM truth),
 ew AS (SELECT entity_id, b, {_steps(1)} AS w FROM {_uniform('par', 'entity_id')} WHERE u >= {R.STEPS[1][0]}),
 bpar AS (SELECT block, {_residues(seed, "'block', block")} FROM (SELECT DISTINCT block FROM truth)),
 kb AS (SELECT block, b, {_steps(1)} AS k FROM {_uniform('bpar', 'block')} WHERE u >= {R.STEPS[1][0]}),
 nw AS (SELECT entity_id, b, w FROM (SELECT entity_id, e.b, CASE k {' '.join(f"WHEN {k} THEN {_steps(k)}" for k in range(1, len(R.STEPS)))} END AS w
   FROM {_uniform('par', 'entity_id, block')} e JOIN kb ON kb.block = e.block AND kb.b = e.b) WHERE w > 0)"""


def _boot_counts(rel, mode):
    pick = lambda c: f"CAST(coalesce(sum(w) FILTER (WHERE {c}), 0) AS BIGINT)"
    return f"""SELECT '{mode}' AS mode, model, b, {pick('label = 1 AND call = 1')} AS tp, {pick('label = 0 AND call = 1')} AS fp, {pick('label = 0 AND call = 0')} AS tn, {pick('label = 1 AND call = 0')} AS fn
      FROM {rel} JOIN (SELECT entity_id, model, label, call FROM calls) USING (entity_id) GROUP BY ALL"""


def _boot_auprc(rel, mode):
    return f"""SELECT '{mode}' AS mode, model, b, CASE WHEN count(*) <= 1 THEN NULL WHEN sum(pos) = 0 THEN 0 ELSE sum(pos * cp / (cp + cn)::DOUBLE) / sum(pos) END AS auprc
      FROM (SELECT *, sum(pos) OVER w1 AS cp, sum(neg) OVER w1 AS cn FROM (SELECT b, model, score, coalesce(sum(w) FILTER (WHERE label = 1), 0) AS pos, coalesce(sum(w) FILTER (WHERE label = 0), 0) AS neg
        FROM {rel} JOIN (SELECT entity_id, model, label, score FROM calls) USING (entity_id) GROUP BY ALL) WINDOW w1 AS (PARTITION BY b, model ORDER BY score DESC)) GROUP BY ALL"""


_PATTERN = f""", pat AS (SELECT label, string_agg(call::VARCHAR, '' ORDER BY CASE model {' '.join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS))} END) AS pattern FROM calls GROUP BY entity_id, label),
 pc AS (SELECT label, pattern, count(*) AS n_entities FROM pat GROUP BY ALL)"""


@register("outcome_patterns", "D39 H2", W + _PATTERN + " SELECT * FROM pc")
def outcome_patterns(spark, d):
    return B.outcome_patterns(calls(spark, d), MODELS)


def boot_counts(spark, d, seed, mode="naive"):
    """(model, b) counts of the replicates: entities meet the weights through their pattern of calls only."""
    rows = B.entity_patterns(calls(spark, d), MODELS, extra=["block"])
    return B.pattern_counts(R.cell_replicates(rows, ["label", "pattern"], "entity_id", E_REPS, seed, mode=mode, block="block"), MODELS, "w")


@register(
    "entity_bootstrap_ci", "I1 H17",
    W + _draws(42) + f", rep AS ({_boot_counts('ew', 'naive')}) SELECT model, quantile_cont(mcc, 0.025) AS lo, quantile_cont(mcc, 0.975) AS hi, stddev_samp(mcc) AS se, count(*) AS n_valid FROM (SELECT model, {MCC_SQL} AS mcc FROM rep) GROUP BY model",
    "lo hi se",
)
def entity_bootstrap_ci(spark, d):
    return B.interval(boot_counts(spark, d, 42).withColumn("mcc", M.mcc()), "mcc")


@register("entity_bootstrap_multinomial", "I1 I2")
def entity_bootstrap_multinomial(spark, d):
    """Same bootstrap drawn per replicate from the pattern multinomial; cost independent of n."""
    pat = settle(B.outcome_patterns(calls(spark, d), MODELS))
    reps = B.pattern_counts(B.multinomial_pattern_weights(pat, 1000, 42), MODELS, "w")
    return B.interval(reps.withColumn("mcc", M.mcc()), "mcc")


def settled_calls(spark, d):
    """The calls written once: sampling for ranges, chunks, checks and point values all read them."""
    return settle(calls(spark, d).select("entity_id", "model", "label", "score", "call", "block"))


def boot_auprc(c, seed, modes=("naive",)):
    return R.auprc_replicates(c, "model", "entity_id", E_REPS, seed, modes=modes, block="block")


def family_delta(df, value, *keys):
    """Mean of the marker models minus mean of the composition models."""
    mean = lambda f: F.avg(F.when(F.col("model").isin(*[r.model for r in RULES if r.family == f]), F.col(value)))
    return df.groupBy(*keys).agg((mean("marker") - mean("composition")).alias("diff"))


_FAMILY = lambda v: f"avg({v}) FILTER (WHERE family = 'marker') - avg({v}) FILTER (WHERE family = 'composition')"
_DIFFS = W + _draws(7) + f", ap AS ({_boot_auprc('ew', 'naive')}), df AS (SELECT b, {_FAMILY('auprc')} AS diff FROM ap JOIN models USING (model) GROUP BY b)"


@register("entity_bootstrap_auprc_groups", "I3 I1", _DIFFS + " SELECT CAST(b AS INTEGER) AS b, diff FROM df", "diff")
def entity_bootstrap_auprc_groups(spark, d):
    """Paired difference of group-mean AUPRC in every replicate; all models see the same weights."""
    return family_delta(boot_auprc(settled_calls(spark, d), 7), "auprc", "b")


_POINT_AP = """SELECT model, sum(pos * cp / (cp + cn)::DOUBLE) / sum(pos) AS auprc FROM (SELECT *, sum(pos) OVER w1 AS cp, sum(neg) OVER w1 AS cn FROM (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
   FROM calls GROUP BY ALL) WINDOW w1 AS (PARTITION BY model ORDER BY score DESC)) GROUP BY model"""


@register(
    "auprc_group_verdict", "I3 I9",
    _DIFFS + f""", pt AS (SELECT {_FAMILY('auprc')} AS point_delta FROM ({_POINT_AP}) JOIN models USING (model)), q AS (SELECT quantile_cont(diff, 0.025) AS ci_lo, quantile_cont(diff, 0.975) AS ci_hi, count(*) AS n_valid FROM df WHERE diff IS NOT NULL)
    SELECT point_delta, ci_lo, ci_hi, n_valid, ci_lo > 0 OR ci_hi < 0 AS significant FROM pt, q""",
    "point_delta ci_lo ci_hi",
)
def auprc_group_verdict(spark, d):
    """Point difference of group-mean AUPRC, its interval, and whether it excludes 0."""
    c = settled_calls(spark, d)
    point = family_delta(V.average_precision(c), "auprc").select(F.col("diff").alias("point_delta"))
    q = B.interval(family_delta(boot_auprc(c, 7), "auprc", "b"), "diff", []).select(F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"), F.col("n_valid"))
    return q.withColumn("point_delta", point.scalar()).withColumn("significant", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))


_BCA = f", bca AS (SELECT model, block || '/' || arm AS block, arm, {COUNTS_SQL} FROM calls GROUP BY ALL)"
_AIDX = f""", aidx AS (SELECT arm, block, row_number() OVER (PARTITION BY arm ORDER BY substr(md5(concat_ws('|', arm, block)), 1, 3), arm, block) - 1 AS idx, count(*) OVER (PARTITION BY arm) AS n FROM (SELECT DISTINCT arm, block FROM bca)),
 aw AS (SELECT dr.arm, b, pos.block, count(*) AS w FROM (SELECT arm, b, {_draw(f"'{SEED}'", 'arm', 'b', 'idx')} % n AS p FROM aidx, range({REPS}) r(b)) dr JOIN aidx pos ON pos.idx = dr.p AND pos.arm = dr.arm GROUP BY ALL),
 arep AS (SELECT model, arm, b, sum(w) AS n, CAST(sum(w * tp) AS BIGINT) AS tp, CAST(sum(w * fp) AS BIGINT) AS fp, CAST(sum(w * tn) AS BIGINT) AS tn, CAST(sum(w * fn) AS BIGINT) AS fn, sum(w * m) / sum(w) AS mean_mcc
   FROM (SELECT *, {MCC_SQL} AS m FROM bca) JOIN aw USING (arm, block) GROUP BY ALL)"""
WARM = W + _BCA + _AIDX
_PI = lambda tpr, fpr, pi: f"""coalesce((({pi}) * ({tpr}) * (1 - ({pi})) * (1 - ({fpr})) - (1 - ({pi})) * ({fpr}) * ({pi}) * (1 - ({tpr}))) / nullif(sqrt(
  (({pi}) * ({tpr}) + (1 - ({pi})) * ({fpr})) * (({pi}) * ({tpr}) + ({pi}) * (1 - ({tpr}))) * ((1 - ({pi})) * (1 - ({fpr})) + (1 - ({pi})) * ({fpr})) * ((1 - ({pi})) * (1 - ({fpr})) + ({pi}) * (1 - ({tpr})))), 0), 0)"""


def arm_counts(spark, d):
    return settle(C.confusion(calls(spark, d).withColumn("block", F.concat_ws("/", "block", "arm")), ("model", "block", "arm")))


def arm_replicates(spark, d):
    counts = arm_counts(spark, d)
    w = B.unit_weights(counts.select("arm", "block").distinct(), ["arm", "block"], REPS, SEED, strata=["arm"])
    return counts, counts.join(w, ["arm", "block"])


@register(
    "stratified_bootstrap_delta", "I5 B25",
    WARM + f""", m AS (SELECT *, {MCC_SQL} AS mcc FROM arep), dl AS (SELECT l.model, l.b, h.mcc - l.mcc AS delta FROM m l JOIN m h ON l.model = h.model AND l.b = h.b AND l.arm = 'low' AND h.arm = 'high')
    SELECT model, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi, stddev_samp(delta) AS se, count(*) AS n_valid FROM dl GROUP BY model""",
    "lo hi se",
)
def stratified_bootstrap_delta(spark, d):
    _, rows = arm_replicates(spark, d)
    reps = rows.groupBy("model", "b", "arm").agg(*[F.sum(F.col("w") * F.col(c)).cast("bigint").alias(c) for c in M.COUNTS])
    tot = K.arm_totals(reps, ("model", "b"), n_blocks=False)
    delta = M.mcc("tp_h", "fp_h", "tn_h", "fn_h") - M.mcc("tp_l", "fp_l", "tn_l", "fn_l")
    return B.interval(tot, delta)


_EST = f""", lh AS (SELECT l.model, l.b, l.tp AS tpl, l.fp AS fpl, l.tn AS tnl, l.fn AS fnl, h.tp AS tph, h.fp AS fph, h.tn AS tnh, h.fn AS fnh, h.mean_mcc - l.mean_mcc AS mean_per_sample,
   l.tp / (l.tp + l.fn)::DOUBLE AS tprl, l.fp / (l.fp + l.tn)::DOUBLE AS fprl, h.tp / (h.tp + h.fn)::DOUBLE AS tprh, h.fp / (h.fp + h.tn)::DOUBLE AS fprh,
   (l.tp + l.fn) / (l.tp + l.fp + l.tn + l.fn)::DOUBLE AS pil FROM arep l JOIN arep h ON l.model = h.model AND l.b = h.b AND l.arm = 'low' AND h.arm = 'high'),
 pc0 AS (SELECT count(*) FILTER (WHERE label = 1) / count(*)::DOUBLE AS pi FROM truth),
 est AS (SELECT model, b, mean_per_sample, mh - ml AS pooled, {_PI('tprh', 'fprh', 'pil')} - ml AS prev_std_low, {_PI('tprh', 'fprh', 'pi')} - {_PI('tprl', 'fprl', 'pi')} AS prev_std_cohort
   FROM (SELECT lh.*, pi, {MCC_SQL.replace('tp', 'tpl').replace('fp', 'fpl').replace('tn', 'tnl').replace('fn', 'fnl')} AS ml, {MCC_SQL.replace('tp', 'tph').replace('fp', 'fph').replace('tn', 'tnh').replace('fn', 'fnh')} AS mh FROM lh, pc0))"""


def estimand_replicates(spark, d):
    counts, rows = arm_replicates(spark, d)
    rows = rows.withColumn("m", M.mcc())
    reps = rows.groupBy("model", "b", "arm").agg(
        *[F.sum(F.col("w") * F.col(c)).cast("bigint").alias(c) for c in M.COUNTS], (F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("mean_mcc")
    )
    tot = K.arm_totals(reps, ("model", "b"), n_blocks=False)
    mean = lambda a: F.max(F.when(F.col("arm") == a, F.col("mean_mcc")))
    per = reps.groupBy("model", "b").agg(mean("low").alias("mean_l"), mean("high").alias("mean_h"))
    pos = counts.agg(F.sum(F.col("tp") + F.col("fn")) / F.sum(F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).scalar()
    return K.estimands(tot.withColumn("_pi", pos), per, F.col("_pi"), ("model", "b"))


EST = ("pooled", "mean_per_sample", "prev_std_low", "prev_std_cohort")


@register(
    "four_estimand_contrast", "I6 H12 D17",
    WARM + _EST + " SELECT model, " + ", ".join(f"quantile_cont({e}, 0.025) AS {e}_lo, quantile_cont({e}, 0.975) AS {e}_hi" for e in EST) + " FROM est GROUP BY model",
    " ".join(f"{e}_lo {e}_hi" for e in EST),
)
def four_estimand_contrast(spark, d):
    est = estimand_replicates(spark, d)
    q = F.array(F.lit(0.025), F.lit(0.975))
    agg = est.groupBy("model").agg(*[F.percentile(e, q).alias(e) for e in EST])
    return agg.select("model", *[F.col(e)[i].alias(f"{e}_{s}") for e in EST for i, s in enumerate(("lo", "hi"))])


RATE = ("recall_delta", "fpr_delta", "precision_delta", "positive_ratio", "call_ratio", "calls_vs_positives")


@register(
    "rate_contrast_bootstrap", "I7 D18",
    WARM + """, lr AS (SELECT l.model, l.b, h.tp / (h.tp + h.fn)::DOUBLE - l.tp / (l.tp + l.fn)::DOUBLE AS recall_delta, h.fp / (h.fp + h.tn)::DOUBLE - l.fp / (l.fp + l.tn)::DOUBLE AS fpr_delta,
      h.tp / nullif(h.tp + h.fp, 0)::DOUBLE - l.tp / nullif(l.tp + l.fp, 0)::DOUBLE AS precision_delta, ((h.tp + h.fn) / h.n::DOUBLE) / ((l.tp + l.fn) / l.n::DOUBLE) AS positive_ratio,
      ((h.tp + h.fp) / h.n::DOUBLE) / ((l.tp + l.fp) / l.n::DOUBLE) AS call_ratio FROM arep l JOIN arep h ON l.model = h.model AND l.b = h.b AND l.arm = 'low' AND h.arm = 'high'),
      lr2 AS (SELECT *, call_ratio / positive_ratio AS calls_vs_positives FROM lr)
    SELECT model, """ + ", ".join(f"quantile_cont({r}, 0.025) AS {r}_lo, quantile_cont({r}, 0.975) AS {r}_hi" for r in RATE) + " FROM lr2 GROUP BY model",
    " ".join(f"{r}_lo {r}_hi" for r in RATE),
)
def rate_contrast_bootstrap(spark, d):
    """Same draws as the MCC contrast (same seed, strata and units)."""
    _, rows = arm_replicates(spark, d)
    reps = rows.groupBy("model", "b", "arm").agg(
        *[F.sum(F.col("w") * F.col(c)).cast("bigint").alias(c) for c in M.COUNTS], F.sum("w").alias("n")
    )
    tot = K.arm_totals(reps, ("model", "b"), n_blocks=False)
    n = reps.groupBy("model", "b").agg(*[F.max(F.when(F.col("arm") == a, F.col("n"))).alias(f"n_{s}") for a, s in (("low", "l"), ("high", "h"))])
    rates = K.arm_deltas(tot.join(n, ["model", "b"]), ("model", "b"))
    q = F.array(F.lit(0.025), F.lit(0.975))
    agg = rates.groupBy("model").agg(*[F.percentile(r, q).alias(r) for r in RATE])
    return agg.select("model", *[F.col(r)[i].alias(f"{r}_{s}") for r in RATE for i, s in enumerate(("lo", "hi"))])


@register("nested_block_bootstrap", "I8", W + _draws(99) + f", rep AS ({_boot_counts('nw', 'nested')}) SELECT model, CAST(b AS INTEGER) AS b, {MCC_SQL} AS mcc FROM rep", "mcc")
def nested_block_bootstrap(spark, d):
    """Blocks are drawn first, then the entities of each drawn block."""
    return boot_counts(spark, d, 99, "nested").select("model", "b", M.mcc().alias("mcc"))


_NN = " UNION ALL ".join
_Q2 = lambda v: f"quantile_cont({v}, 0.025) AS {v}_lo, quantile_cont({v}, 0.975) AS {v}_hi"


@register(
    "nested_and_naive_bootstrap", "I8 I3",
    W + _draws(99) + f""", rep AS ({_NN([_boot_counts('nw', 'nested'), _boot_counts('ew', 'naive')])}), ap AS ({_NN([_boot_auprc('nw', 'nested'), _boot_auprc('ew', 'naive')])}),
     pt AS (SELECT model, {MCC_SQL} AS mcc FROM (SELECT model, {COUNTS_SQL} FROM calls GROUP BY model)), pa AS ({_POINT_AP}),
     cm AS (SELECT mode, model, {_Q2('mcc')} FROM (SELECT mode, model, {MCC_SQL} AS mcc FROM rep) GROUP BY ALL), ca AS (SELECT mode, model, {_Q2('auprc')} FROM ap GROUP BY ALL)
    SELECT mode, model, mcc, mcc_lo, mcc_hi, auprc, auprc_lo, auprc_hi FROM cm JOIN ca USING (mode, model) JOIN pt USING (model) JOIN pa USING (model)""",
    "mcc mcc_lo mcc_hi auprc auprc_lo auprc_hi",
)
def nested_and_naive_bootstrap(spark, d):
    """Intervals of MCC and AUPRC where blocks are drawn first, beside those of a plain draw of entities."""
    c = settled_calls(spark, d)
    point = C.confusion(c, ("model",)).select("model", M.mcc().alias("mcc")).join(V.average_precision(c).select("model", "auprc"), "model")
    rows = B.entity_patterns(c, MODELS, extra=["block"])
    counts = B.pattern_counts(R.cell_replicates_by_mode(rows, ["label", "pattern"], "entity_id", E_REPS, 99, block="block"), MODELS, "w", keys=["mode", "b"])
    ends = lambda df, v: B.interval(df, v, ["mode", "model"]).select("mode", "model", F.col("lo").alias(f"{v}_lo"), F.col("hi").alias(f"{v}_hi"))
    both = ends(counts.withColumn("mcc", M.mcc()), "mcc").join(ends(boot_auprc(c, 99, R.MODES), "auprc"), ["mode", "model"])
    return both.join(point, "model").select("mode", "model", *[x for v in ("mcc", "auprc") for x in (v, f"{v}_lo", f"{v}_hi")])


RATIOS, S_REPS, S_SEED = (1, 2, 4, 8), 200, 5


@register(
    "class_ratio_subsampling", "I16",
    W + f""", rb AS (SELECT b, ('0x' || substr(md5(concat_ws('|', '{S_SEED}', 'b', b)), 1, 8))::BIGINT % {_P} AS r FROM range({S_REPS}) t(b)), par AS (SELECT entity_id, {_residues(S_SEED, 'entity_id')} FROM truth WHERE label = 0),
    hs AS (SELECT b AS rep, entity_id, row_number() OVER (PARTITION BY b ORDER BY u, a, c) AS rk FROM {_uniform('par', 'entity_id, a, c')}), np AS (SELECT count(*) AS n_pos FROM truth WHERE label = 1),
    pick AS (SELECT rep, ratio, entity_id FROM hs, np, (VALUES {', '.join(f'({x})' for x in RATIOS)}) v(ratio) WHERE rk <= ratio * n_pos),
    f AS (SELECT ratio, rep, model, count(*) FILTER (WHERE call = 1) AS fp, count(*) FILTER (WHERE call = 0) AS tn FROM pick JOIN calls USING (entity_id) GROUP BY ALL),
    p AS (SELECT model, count(*) FILTER (WHERE call = 1) AS tp, count(*) FILTER (WHERE call = 0) AS fn FROM calls WHERE label = 1 GROUP BY model)
    SELECT ratio, model, avg(mcc) AS mean_mcc, count(*) AS repeats FROM (SELECT ratio, rep, model, {MCC_SQL} AS mcc FROM f JOIN p USING (model)) GROUP BY ALL""",
    "mean_mcc",
)
def class_ratio_subsampling(spark, d):
    """The published setting: ratios 1 to 8, 200 repeats."""
    rows = settle(B.entity_patterns(calls(spark, d), MODELS))
    w = R.subsampled_cells(rows, ["label", "pattern"], "entity_id", RATIOS, S_REPS, S_SEED)
    counts = B.pattern_counts(w, MODELS, "w", keys=["ratio", "rep"])
    return counts.withColumn("mcc", M.mcc()).groupBy("ratio", "model").agg(F.avg("mcc").alias("mean_mcc"), F.count("*").alias("repeats"))


@register("class_ratio_subsampling_by_pattern", "I16")
def class_ratio_subsampling_by_pattern(spark, d):
    """The published setting (ratios 1 to 8, 200 repeats) at a cost independent of n."""
    pat = settle(B.outcome_patterns(calls(spark, d), MODELS))
    w = B.hypergeometric_pattern_weights(pat, (1, 2, 4, 8), 200, 5)
    counts = B.pattern_counts(w, MODELS, "w", keys=["ratio", "rep"]).withColumn("mcc", M.mcc())
    return counts.groupBy("ratio", "model").agg(F.avg("mcc").alias("mean_mcc"), F.count("*").alias("repeats"))


@register(
    "block_mean_bootstrap", "I15 D42",
    WARM + """ SELECT l.model, CAST(l.b AS INTEGER) AS b, l.mean_mcc AS mean_low, h.mean_mcc AS mean_high, (round(l.mean_mcc, 9) - round(h.mean_mcc, 9)) / nullif(round(l.mean_mcc, 9), 0) * 100 AS drop_pct
      FROM arep l JOIN arep h ON l.model = h.model AND l.b = h.b AND l.arm = 'low' AND h.arm = 'high'""",
    "mean_low mean_high drop_pct",
)
def block_mean_bootstrap(spark, d):
    """Units are block metrics: weighted means of per-block MCC in each arm."""
    _, rows = arm_replicates(spark, d)
    rows = rows.withColumn("m", M.mcc())
    mean = lambda a: F.sum(F.when(F.col("arm") == a, F.col("w") * F.col("m"))) / F.sum(F.when(F.col("arm") == a, F.col("w")))
    out = rows.groupBy("model", "b").agg(mean("low").alias("mean_low"), mean("high").alias("mean_high"))
    low, high = F.round("mean_low", 9), F.round("mean_high", 9)  # a mean of no effect may sum to a few 1e-18
    return out.withColumn("drop_pct", ratio(low - high, low, None) * 100.0)


# ----------------------------------------------------------- two cohorts, correlation
def cohort_counts(spark, d):
    """Two cohorts: orders before 1998 and from 1998 on."""
    c = calls(spark, d).withColumn("cohort", F.when(F.col("source") < "1998", "early").otherwise("late"))
    return settle(C.confusion(c, ("model", "block", "cohort")))


def _cohort(name, seed):
    cond = "source < '1998'" if name == "early" else "source >= '1998'"
    p = name[0]
    return f""", {p}c AS (SELECT model, block, {COUNTS_SQL} FROM calls WHERE {cond} GROUP BY ALL), {_idx('block', f'{p}c', f'{p}i')},
 {p}w AS (SELECT b, pos.block, count(*) AS w FROM (SELECT b, {_draw(f"'{seed}'", 'b', 'idx')} % n AS p FROM {p}i, range({REPS}) r(b)) dr JOIN {p}i pos ON pos.idx = dr.p GROUP BY ALL),
 {p}m AS (SELECT model, b, round({MCC_SQL}, 9) AS mcc FROM (SELECT model, b, CAST(sum(w * tp) AS BIGINT) AS tp, CAST(sum(w * fp) AS BIGINT) AS fp, CAST(sum(w * tn) AS BIGINT) AS tn, CAST(sum(w * fn) AS BIGINT) AS fn FROM {p}c JOIN {p}w USING (block) GROUP BY ALL)),
 {p}p AS (SELECT model, round({MCC_SQL}, 9) AS mcc FROM (SELECT model, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM {p}c GROUP BY ALL))"""


_TWO = W + _cohort("early", 1) + _cohort("late", 2)
_RANKED = lambda rel: f"(SELECT scope, b, rank() OVER (PARTITION BY scope, b ORDER BY x) + (count(*) OVER (PARTITION BY scope, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY scope, b ORDER BY y) + (count(*) OVER (PARTITION BY scope, b, y) - 1) / 2.0 AS ry FROM {rel})"


@register(
    "two_cohort_rank_correlation", "I10 H8 I12",
    _TWO + f""", xy AS (SELECT 'both' AS scope, e.b, e.mcc AS x, l.mcc AS y FROM em e JOIN lm l ON e.model = l.model AND e.b = l.b
      UNION ALL SELECT 'early_only', e.b, e.mcc, l.mcc FROM em e JOIN lp l ON e.model = l.model UNION ALL SELECT 'late_only', l.b, e.mcc, l.mcc FROM ep e JOIN lm l ON e.model = l.model),
    rho AS (SELECT scope, b, CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END AS r FROM {_RANKED('xy')} GROUP BY ALL)
    SELECT scope, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi, count(r) AS n_valid FROM rho GROUP BY scope""",
    "lo hi",
)
def two_cohort_rank_correlation(spark, d):
    counts = cohort_counts(spark, d)
    reps, points = {}, {}
    for name, seed in (("early", 1), ("late", 2)):
        part = counts.filter(F.col("cohort") == name)
        w = B.unit_weights(part.select("block").distinct(), ["block"], REPS, seed)
        reps[name] = B.block_replicates(part, w, ["block"]).select("model", "b", F.round(M.mcc(), 9).alias("v"))
        points[name] = part.groupBy("model").agg(*[F.sum(c).alias(c) for c in M.COUNTS]).select("model", F.round(M.mcc(), 9).alias("v"))
    return ST.two_cohort_rho(reps["early"], reps["late"], points["early"], points["late"]).select("scope", "lo", "hi", "n_valid")


GRID = tuple(round(0.01 * i, 2) for i in range(1, 100))
_G = ", ".join(f"({g}::DOUBLE)" for g in GRID)


@register(
    "prevalence_crossover", "H13 H12 I11",
    W + f""", rt AS (SELECT model, count(*) FILTER (WHERE label = 1 AND call = 1) / count(*) FILTER (WHERE label = 1)::DOUBLE AS tpr, count(*) FILTER (WHERE label = 0 AND call = 1) / count(*) FILTER (WHERE label = 0)::DOUBLE AS fpr FROM calls GROUP BY model)
    SELECT a.model AS model_a, b.model AS model_b, min(pi) FILTER (WHERE {_PI('a.tpr', 'a.fpr', 'pi')} - {_PI('b.tpr', 'b.fpr', 'pi')} >= 0) AS crossover
    FROM rt a JOIN rt b ON a.model < b.model CROSS JOIN (VALUES {_G}) g(pi) GROUP BY ALL""",
    "crossover",
)
def prevalence_crossover(spark, d):
    r = C.confusion(calls(spark, d)).select("model", M.recall(empty=None).alias("tpr"), M.fpr().alias("fpr"))
    pairs = ST.model_pairs(r, ["tpr", "fpr"])
    return T.prevalence_crossover(pairs, GRID, keys=["model_a", "model_b"])


def cohort_replicates(spark, d):
    """(model, cohort, b) counts: both cohorts' blocks drawn under one replicate number; b = -1 is the cohort itself."""
    counts = cohort_counts(spark, d)
    blocks = counts.select("cohort", "block").distinct()
    w = B.unit_weights(blocks, ["cohort", "block"], REPS, SEED, strata=["cohort"]).select("cohort", "block", "b", "w")
    whole = blocks.select("cohort", "block", F.lit(-1).alias("b"), F.lit(1).cast("bigint").alias("w"))
    return B.block_replicates(counts, w.unionByName(whole), ["cohort", "block"], ("model", "cohort"))


_COH = W + f""", cb AS (SELECT model, block, CASE WHEN source < '1998' THEN 'early' ELSE 'late' END AS cohort, {COUNTS_SQL} FROM calls GROUP BY ALL),
 cix AS (SELECT cohort, block, row_number() OVER (PARTITION BY cohort ORDER BY substr(md5(concat_ws('|', cohort, block)), 1, 3), cohort, block) - 1 AS idx, count(*) OVER (PARTITION BY cohort) AS n FROM (SELECT DISTINCT cohort, block FROM cb)),
 cwt AS (SELECT dr.cohort, b, pos.block, count(*) AS w FROM (SELECT cohort, b, {_draw(f"'{SEED}'", 'cohort', 'b', 'idx')} % n AS p FROM cix, range({REPS}) r(b)) dr JOIN cix pos ON pos.idx = dr.p AND pos.cohort = dr.cohort GROUP BY ALL),
 crp AS (SELECT model, cohort, b, CAST(sum(w * tp) AS BIGINT) AS tp, CAST(sum(w * fp) AS BIGINT) AS fp, CAST(sum(w * tn) AS BIGINT) AS tn, CAST(sum(w * fn) AS BIGINT) AS fn FROM cb JOIN (SELECT * FROM cwt UNION ALL SELECT cohort, -1, block, 1 FROM cix) USING (cohort, block) GROUP BY ALL),
 crt AS (SELECT model, cohort, b, tp / nullif(tp + fn, 0)::DOUBLE AS tpr, fp / nullif(fp + tn, 0)::DOUBLE AS fpr, (tp + fn) / (tp + fp + tn + fn)::DOUBLE AS share, {MCC_SQL} AS mcc FROM crp)"""
_SPREAD = [f"{c}_{n}" for n in ("early", "late") for c in ("tpr", "fpr")] + ["mcc_carried", "delta_carried"]


@register(
    "cross_cohort_rates", "I11 H13",
    _COH + f""", xo AS (SELECT a.cohort, a.b, a.model AS model_a, z.model AS model_b, min(pi) FILTER (WHERE {_PI('a.tpr', 'a.fpr', 'pi')} - {_PI('z.tpr', 'z.fpr', 'pi')} >= 0) AS x FROM crt a JOIN crt z ON a.b = z.b AND a.cohort = z.cohort AND a.model < z.model CROSS JOIN (VALUES {_G}) g(pi) GROUP BY ALL)
    SELECT cohort, model_a, model_b, max(x) FILTER (WHERE b < 0) AS crossover, quantile_cont(x, 0.025) FILTER (WHERE b >= 0) AS lo, quantile_cont(x, 0.975) FILTER (WHERE b >= 0) AS hi, count(x) FILTER (WHERE b >= 0) AS n_crossing FROM xo GROUP BY ALL""",
    "crossover lo hi",
)
def cross_cohort_rates(spark, d):
    """Positive share at which one model's MCC reaches another's, under each cohort's own error rates."""
    reps = cohort_replicates(spark, d).select("cohort", "model", "b", M.recall(empty=None).alias("tpr"), M.fpr().alias("fpr"))
    x = T.prevalence_crossover(ST.model_pairs(reps, ["tpr", "fpr"], keys=["cohort", "b"]), GRID, keys=["cohort", "b", "model_a", "model_b"])
    drawn = F.when(F.col("b") >= 0, F.col("crossover"))
    q = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    return x.groupBy("cohort", "model_a", "model_b").agg(F.max(F.when(F.col("b") < 0, F.col("crossover"))).alias("crossover"), q[0].alias("lo"), q[1].alias("hi"), F.count(drawn).alias("n_crossing"))


@register(
    "carried_cohort_rates", "I11 H12",
    _COH + f""", met AS (SELECT e.model, e.b, {', '.join(f'{s}.{c} AS {c}_{n}' for s, n in (('e', 'early'), ('l', 'late')) for c in ('tpr', 'fpr', 'share', 'mcc'))}, {_PI('l.tpr', 'l.fpr', 'e.share')} AS mcc_carried FROM crt e JOIN crt l ON e.model = l.model AND e.b = l.b AND e.cohort = 'early' AND l.cohort = 'late'),
     dm AS (SELECT *, mcc_carried - mcc_early AS delta_carried FROM met),
     agg AS (SELECT model, {', '.join(f'max({c}) FILTER (WHERE b < 0) AS {c}' for c in [*(f'{c}_{n}' for n in ('early', 'late') for c in ('share', 'mcc')), *_SPREAD])}, {', '.join(f'quantile_cont({c}, {q}) FILTER (WHERE b >= 0) AS {c}_{e}' for c in _SPREAD for e, q in (('lo', 0.025), ('hi', 0.975)))} FROM dm GROUP BY model)
    SELECT *, delta_carried_lo > 0 OR delta_carried_hi < 0 AS excludes_0 FROM agg""",
    " ".join([*(f"{c}_{n}" for n in ("early", "late") for c in ("share", "mcc")), *[x for c in _SPREAD for x in (c, f"{c}_lo", f"{c}_hi")]]),
)
def carried_cohort_rates(spark, d):
    """How much of the cohorts' difference in MCC is their positive share: late rates at the early share, with intervals."""
    return ST.carried_rates(cohort_replicates(spark, d), "early", "late")


PERM = 10_000
_BX = f""", bx AS (SELECT block, n_pos / n_all::DOUBLE AS x, round(mcc, 9) AS y, model FROM (SELECT block, model, tp + fn AS n_pos, tp + fp + tn + fn AS n_all, {MCC_SQL} AS mcc FROM bc))"""


def block_xy(spark, d):
    c = block_counts(spark, d)
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return c.select("model", "block", ((F.col("tp") + F.col("fn")) / total).alias("x"), F.round(M.mcc(), 9).alias("y"))


_SP = "CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END"
_MID = lambda keys, v: f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0"


@register(
    "spearman_by_model", "H8 E7", W + BC + _BX + f" SELECT model, count(*) AS n, {_SP} AS r FROM (SELECT model, {_MID('model', 'x')} AS rx, {_MID('model', 'y')} AS ry FROM bx) GROUP BY model", "r",
)
def spearman_by_model(spark, d):
    return T.spearman(block_xy(spark, d), "x", "y", ["model"])


@register("pearson_by_model", "H8", W + BC + _BX + " SELECT model, count(*) AS n, corr(x, y) AS r FROM bx GROUP BY model", "r")
def pearson_by_model(spark, d):
    return T.pearson(block_xy(spark, d), "x", "y", ["model"])


@register(
    "spearman_ordinal", "H9",
    W + BC + _BX + f" SELECT model, count(*) AS n, {_SP} AS r FROM (SELECT model, row_number() OVER (PARTITION BY model ORDER BY x DESC, block) AS rx, row_number() OVER (PARTITION BY model ORDER BY y DESC, block) AS ry FROM bx) GROUP BY model", "r",
)
def spearman_ordinal(spark, d):
    return T.spearman(block_xy(spark, d), "x", "y", ["model"], ties="ordinal", tie=["block"])


@register(
    "lin_concordance", "H11", W + BC + _BX + " SELECT model, 2 * covar_pop(x, y) / (var_pop(x) + var_pop(y) + (avg(x) - avg(y)) * (avg(x) - avg(y))) AS ccc FROM bx GROUP BY model", "ccc",
)
def lin_concordance(spark, d):
    return T.lin_concordance(block_xy(spark, d), "x", "y", ["model"])


@register(
    "permutation_test", "I13 I14",
    W + BC + _BX + f""", rk AS (SELECT model, block, row_number() OVER (PARTITION BY model ORDER BY block) AS i, {_MID('model', 'x')} AS rx, {_MID('model', 'y')} AS ry FROM bx),
    ob AS (SELECT model, {_SP} AS r FROM rk GROUP BY model),
    sh AS (SELECT model, b, i, rx, ry, row_number() OVER (PARTITION BY model, b ORDER BY {_draw("'11'", 'b', 'i')}, i) AS j FROM rk, range({PERM}) p(b)),
    pr AS (SELECT l.model, l.b, covar_pop(l.rx, z.ry) / sqrt(var_pop(l.rx) * var_pop(z.ry)) AS rep FROM sh l JOIN sh z ON l.model = z.model AND l.b = z.b AND z.j = l.i GROUP BY ALL)
    SELECT model, r, (count(*) FILTER (WHERE abs(rep) >= abs(r) - 1e-12) + 1) / (count(*) + 1)::DOUBLE AS p_perm FROM pr JOIN ob USING (model) GROUP BY ALL""",
    "r p_perm",
)
def permutation_test(spark, d):
    xy = O.mid_ranks(O.mid_ranks(block_xy(spark, d), "x", group=["model"], name="rx"), "y", group=["model"], name="ry")
    observed = T.pearson(xy, "rx", "ry", ["model"]).select("model", "r")
    return B.permutation_p(observed, B.permuted_correlations(xy, PERM, 11, keys=["model"], unit="block", x="rx", y="ry"), "r", ["model"])


@register(
    "correlation_battery", "I14",
    W + BC + _BX + f""", sc AS (SELECT 'all' AS scope, * FROM bx UNION ALL SELECT 'recent', * FROM bx WHERE block >= '1998-01'),
    {_idx('block', 'bx', 'ci')}, cw AS (SELECT b, pos.block, count(*) AS w FROM (SELECT b, {_draw("'3'", 'b', 'idx')} % n AS p FROM ci, range({REPS}) r(b)) dr JOIN ci pos ON pos.idx = dr.p GROUP BY ALL),
    ex AS (SELECT scope, model, b, x, y FROM sc JOIN cw USING (block), range(CAST(w AS BIGINT))),
    rr AS (SELECT scope, model, b, {_SP} AS r FROM (SELECT scope, model, b, {_MID('scope, model, b', 'x')} AS rx, {_MID('scope, model, b', 'y')} AS ry FROM ex) GROUP BY ALL)
    SELECT scope, model, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM rr GROUP BY ALL""",
    "lo hi",
)
def correlation_battery(spark, d):
    """Spearman intervals over two scopes; drawn blocks are repeated by their weight."""
    xy = block_xy(spark, d)
    scopes = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("block") >= "1998-01", "recent"))))
    w = B.unit_weights(xy.select("block").distinct(), ["block"], REPS, 3)
    rows = xy.withColumn("scope", scopes).join(w, "block").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    rho = T.spearman(rows, "x", "y", ["scope", "model", "b"])
    return B.interval(rho, "r", ["scope", "model"]).select("scope", "model", "lo", "hi")


@register(
    "replication_sensitivity", "I12 H11",
    _TWO + f""", st(tool_set, model) AS (SELECT 'all', model FROM models UNION ALL SELECT 'marker', model FROM models WHERE family = 'marker'),
    xy AS (SELECT tool_set, e.mcc AS x, l.mcc AS y FROM ep e JOIN lp l USING (model) JOIN st USING (model))
    SELECT tool_set, count(*) AS n, 2 * covar_pop(x, y) / nullif(var_pop(x) + var_pop(y) + (avg(x) - avg(y)) * (avg(x) - avg(y)), 0) AS ccc FROM xy GROUP BY tool_set""",
    "ccc",
)
def replication_sensitivity(spark, d):
    c = cohort_counts(spark, d).groupBy("model", "cohort").agg(*[F.sum(x).alias(x) for x in M.COUNTS]).withColumn("v", F.round(M.mcc(), 9))
    xy = c.groupBy("model").agg(F.max(F.when(F.col("cohort") == "early", F.col("v"))).alias("x"), F.max(F.when(F.col("cohort") == "late", F.col("v"))).alias("y"))
    sets = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("model").isin("qty", "price"), "marker")))).alias("tool_set")
    rows = xy.select("x", "y", sets)
    return T.lin_concordance(rows, "x", "y", ["tool_set"]).join(rows.groupBy("tool_set").agg(F.count("*").alias("n")), "tool_set")


# ------------------------------------------------------------------ hypothesis tests
_COR = ", cor AS (SELECT entity_id, model, label, CAST(call = label AS INTEGER) AS correct FROM calls)"
_Q = """SELECT count(*) AS n, 4::BIGINT AS k, 3::BIGINT AS df, (3 * (4 * (SELECT sum(t * t) FROM cs) - (SELECT sum(t) FROM cs) ** 2)) / (4 * (SELECT sum(t) FROM cs) - sum(l * l)::DOUBLE) AS q, 'ok' AS note FROM rs"""


def _gamma_tail(a: str, x: str) -> str:
    """Upper regularised incomplete gamma function by its series; beyond 700 the tail is nothing at six places."""
    return f"CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 700 THEN 0.0 ELSE greatest(0.0, 1 - (SELECT sum(exp(({a} + gt.k) * ln({x}) - ({x}) - lgamma({a} + gt.k + 1.0))) FROM range(3000) gt(k))) END"


def _normal_tail(z: str) -> str:
    """P(Z >= z): the square of a normal variable is chi-square with one degree of freedom."""
    return f"CASE WHEN {z} >= 0 THEN 0.5 * ({_gamma_tail('0.5', f'(({z}) ** 2 / 2)')}) ELSE 1 - 0.5 * ({_gamma_tail('0.5', f'(({z}) ** 2 / 2)')}) END"


def _adjusted(rel: str, order: str) -> str:
    """Benjamini-Hochberg over the rows of ``rel`` with a p_value."""
    return f"""SELECT * EXCLUDE (rn, m), least(1.0, min(p_value * m / rn) OVER (ORDER BY p_value, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj
      FROM (SELECT *, row_number() OVER (ORDER BY p_value, {order}) AS rn, count(*) OVER () AS m FROM {rel})"""


_TOT = ", cs AS (SELECT model, sum(correct)::DOUBLE AS t FROM cor GROUP BY model), rs AS (SELECT entity_id, sum(correct)::DOUBLE AS l FROM cor GROUP BY entity_id)"


@register(
    "cochran_q", "H1", W + _COR + ", cs AS (SELECT model, sum(correct)::DOUBLE AS t FROM cor GROUP BY model), rs AS (SELECT entity_id, sum(correct)::DOUBLE AS l FROM cor GROUP BY entity_id) " + _Q, "q",
)
def cochran_q(spark, d):
    c = calls(spark, d).select("entity_id", "model", (F.col("call") == F.col("label")).cast("int").alias("correct"))
    return T.cochran_q(c)


@register(
    "cochran_q_p_value", "H1 O2", W + _COR + _TOT + f", qq AS ({_Q}) SELECT *, {_gamma_tail('1.5', '(q / 2)')} AS p_value FROM qq", "q p_value",
)
def cochran_q_p_value(spark, d):
    return T.cochran_p(cochran_q(spark, d))


@register(
    "cochran_q_positives", "H1",
    W + _COR + ", cs AS (SELECT model, sum(correct)::DOUBLE AS t FROM cor WHERE label = 1 GROUP BY model), rs AS (SELECT entity_id, sum(correct)::DOUBLE AS l FROM cor WHERE label = 1 GROUP BY entity_id) " + _Q, "q",
)
def cochran_q_positives(spark, d):
    return T.cochran_q(calls(spark, d).filter(F.col("label") == 1).withColumn("correct", F.col("call")))


_DISC = ", dp AS (SELECT a.model AS model_a, z.model AS model_b, count(*) FILTER (WHERE a.correct = 1 AND z.correct = 0) AS b, count(*) FILTER (WHERE a.correct = 0 AND z.correct = 1) AS c FROM cor a JOIN cor z ON a.entity_id = z.entity_id AND a.model < z.model {w} GROUP BY ALL)"
_MCN = " SELECT *, CASE WHEN b + c = 0 THEN 'no_discordant' WHEN b + c < 25 THEN 'exact_binomial' ELSE 'chi2_corrected' END AS test, CASE WHEN b + c >= 25 THEN (abs(b - c) - 1.0) ** 2 / (b + c) END AS statistic FROM dp"


def _pairs(spark, d, extra=()):
    names = sorted(MODELS)
    return T.discordant_pairs(B.outcome_patterns(calls(spark, d), names, extra=extra), names, keys=extra)


@register("mcnemar_pairs", "H2 C16", W + _COR + _DISC.format(w="") + _MCN, "statistic")
def mcnemar_pairs(spark, d):
    return T.mcnemar(_pairs(spark, d), with_p=False).drop("p_exact")


_EXACT = "least(1.0, 2.0 * (SELECT sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0))) FROM range(CAST(least(b, c) + 1 AS BIGINT)) t(i)) / 2.0 ** (b + c))"


@register(
    "mcnemar_p_values", "H2 O2 E9 E10",
    W + _COR + _DISC.format(w="") + f""", mc AS ({_MCN}),
    mp AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 WHEN b + c < 25 THEN {_EXACT} ELSE {_gamma_tail('0.5', '(statistic / 2)')} END AS p_value FROM mc) """ + _adjusted("mp", "model_a, model_b"),
    "statistic p_value p_adj",
)
def mcnemar_p_values(spark, d):
    return O.adjust_bh(T.mcnemar(_pairs(spark, d)), tie=["model_a", "model_b"])


@register(
    "mcnemar_exact_small", "H2 O3",
    W + """, cor AS (SELECT entity_id, block, model, CAST(call = label AS INTEGER) AS correct FROM calls WHERE stratum = '1-URGENT' AND label = 1),
    dp AS (SELECT a.block, a.model AS model_a, z.model AS model_b, count(*) FILTER (WHERE a.correct = 1 AND z.correct = 0) AS b, count(*) FILTER (WHERE a.correct = 0 AND z.correct = 1) AS c FROM cor a JOIN cor z ON a.entity_id = z.entity_id AND a.model < z.model GROUP BY ALL)
    SELECT block, model_a, model_b, b, c, CASE WHEN b + c = 0 THEN 1.0 WHEN b + c < 25 THEN least(1.0, 2.0 * (SELECT sum(gamma(b + c + 1.0) / (gamma(i + 1.0) * gamma(b + c - i + 1.0))) FROM range(CAST(least(b, c) + 1 AS BIGINT)) t(i)) / 2.0 ** (b + c)) END AS p_exact FROM dp""",
    "p_exact",
)
def mcnemar_exact_small(spark, d):
    names = sorted(MODELS)
    c = calls(spark, d).filter((F.col("stratum") == "1-URGENT") & (F.col("label") == 1))
    pairs = T.discordant_pairs(B.outcome_patterns(c, names, extra=["block"]), names, keys=["block"])
    return T.mcnemar(pairs, with_p=False).select("block", "model_a", "model_b", "b", "c", "p_exact")


@register(
    "group_mcnemar", "H3 D38",
    W + """, og AS (SELECT entity_id, label, max(call) FILTER (WHERE family = 'marker') AS m, max(call) FILTER (WHERE family = 'composition') AS s FROM calls WHERE label = 1 AND stratum IN ('1-URGENT', '2-HIGH') GROUP BY ALL)
    SELECT count(*) AS n, count(*) FILTER (WHERE m = 1 AND s = 0) AS b, count(*) FILTER (WHERE m = 0 AND s = 1) AS c FROM og""",
)
def group_mcnemar(spark, d):
    sub = calls(spark, d).filter((F.col("label") == 1) & F.col("stratum").isin("1-URGENT", "2-HIGH"))
    on = lambda f: F.max(F.when(F.col("family") == f, F.col("call")))
    per = sub.groupBy("entity_id").agg(on("marker").alias("m"), on("composition").alias("s"))
    return per.agg(F.count("*").alias("n"), F.count_if((F.col("m") == 1) & (F.col("s") == 0)).alias("b"), F.count_if((F.col("m") == 0) & (F.col("s") == 1)).alias("c"))


@register(
    "group_mcnemar_test", "H3 D38",
    W + f""", g AS (SELECT entity_id, label, coalesce(max(call) FILTER (WHERE family = 'marker'), 0) AS m, coalesce(max(call) FILTER (WHERE family = 'composition'), 0) AS s FROM calls JOIN (SELECT model AS gm, family AS gf FROM models) ON gm = model WHERE stratum IN ('1-URGENT', '2-HIGH') GROUP BY ALL),
    a AS (SELECT count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_negative, count(*) FILTER (WHERE label = 1 AND m = 1) / count(*) FILTER (WHERE label = 1)::DOUBLE AS recall_first, count(*) FILTER (WHERE label = 1 AND s = 1) / count(*) FILTER (WHERE label = 1)::DOUBLE AS recall_second,
      count(*) FILTER (WHERE m = label AND s <> label) AS b, count(*) FILTER (WHERE m <> label AND s = label) AS c FROM g),
    t AS (SELECT *, (abs(b - c) - 1) * (abs(b - c) - 1) / (b + c)::DOUBLE AS st FROM a)
    SELECT n_positive, n_negative, recall_first, recall_second, b, c, 'chi2_corrected' AS test, st AS statistic, {_gamma_tail('0.5', '(st / 2)')} AS p_value, 'ok' AS note FROM t""",
    "recall_first recall_second statistic p_value",
)
def group_mcnemar_test(spark, d):
    """Marker against composition models on two strata, positives and negatives, with test and minimum."""
    return T.group_mcnemar(calls(spark, d).filter(F.col("stratum").isin("1-URGENT", "2-HIGH")), "family", "marker", "composition")


@register(
    "fisher_table", "H4",
    W + """ SELECT *, a::DOUBLE * d / nullif(b::DOUBLE * c, 0) AS odds_ratio FROM (SELECT count(*) FILTER (WHERE family = 'composition' AND call = 1) AS a, count(*) FILTER (WHERE family = 'composition' AND call = 0) AS b,
      count(*) FILTER (WHERE family = 'marker' AND call = 1) AS c, count(*) FILTER (WHERE family = 'marker' AND call = 0) AS d FROM calls WHERE label = 1)""",
    "odds_ratio",
)
def fisher_table(spark, d):
    fam, on = F.col("family"), F.col("call") == 1
    cells = calls(spark, d).filter(F.col("label") == 1).agg(
        F.count_if((fam == "composition") & on).alias("a"), F.count_if((fam == "composition") & ~on).alias("b"),
        F.count_if((fam == "marker") & on).alias("c"), F.count_if((fam == "marker") & ~on).alias("d"),
    )
    return T.fisher_table(cells, "a", "b", "c", "d")


_LC = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - ({k}) + 1.0))"
_FISHER = """SELECT *, a::DOUBLE * d / nullif(b::DOUBLE * c, 0) AS odds_ratio FROM (SELECT count(*) FILTER (WHERE family = 'composition' AND call = 1) AS a, count(*) FILTER (WHERE family = 'composition' AND call = 0) AS b,
      count(*) FILTER (WHERE family = 'marker' AND call = 1) AS c, count(*) FILTER (WHERE family = 'marker' AND call = 0) AS d FROM calls WHERE label = 1)"""


@register(
    "fisher_p_value", "H4 O4",
    W + f""", ft AS ({_FISHER}) SELECT *, least(1.0, (SELECT sum(exp({_LC('(a + c)', 'k')} + {_LC('(b + d)', '(a + b - k)')} - {_LC('(a + b + c + d)', '(a + b)')}))
      FROM range(CAST(greatest(0, a - d) AS BIGINT), CAST(a + 1 AS BIGINT)) r(k))) AS p_less FROM ft""",
    "odds_ratio p_less",
)
def fisher_p_value(spark, d):
    return fisher_table(spark, d).withColumn("p_less", P.fisher_less("a", "b", "c", "d"))


_ARMM = f", am AS (SELECT model, arm, round({MCC_SQL}, 9) AS v FROM (SELECT model, block, arm, {COUNTS_SQL} FROM calls GROUP BY ALL))"


def arm_block_metric(spark, d):
    c = C.confusion(calls(spark, d), ("model", "block", "arm"))
    return c.select("model", "block", "arm", F.round(M.mcc(), 9).alias("v"))


@register(
    "rank_sum_between_arms", "H5 E7",
    W + _ARMM + """, rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY model, v) AS t FROM am)
    SELECT model, count(*) FILTER (WHERE arm = 'low') AS n_a, count(*) FILTER (WHERE arm = 'high') AS n_b, median(v) FILTER (WHERE arm = 'low') AS median_a, median(v) FILTER (WHERE arm = 'high') AS median_b,
      sum(r) FILTER (WHERE arm = 'low') - count(*) FILTER (WHERE arm = 'low') * (count(*) FILTER (WHERE arm = 'low') + 1) / 2.0 AS u,
      median(v) FILTER (WHERE arm = 'low') - median(v) FILTER (WHERE arm = 'high') AS delta, sum(t * t - 1)::DOUBLE AS tie_term, 'ok' AS note FROM rk GROUP BY model""",
    "median_a median_b u delta tie_term",
)
def rank_sum_between_arms(spark, d):
    return T.rank_sum(arm_block_metric(spark, d), "v", "arm", "low", "high")


_RSUM = """SELECT model, count(*) FILTER (WHERE arm = 'low') AS n_a, count(*) FILTER (WHERE arm = 'high') AS n_b, median(v) FILTER (WHERE arm = 'low') AS median_a, median(v) FILTER (WHERE arm = 'high') AS median_b,
      sum(r) FILTER (WHERE arm = 'low') - count(*) FILTER (WHERE arm = 'low') * (count(*) FILTER (WHERE arm = 'low') + 1) / 2.0 AS u,
      median(v) FILTER (WHERE arm = 'low') - median(v) FILTER (WHERE arm = 'high') AS delta, sum(t * t - 1)::DOUBLE AS tie_term, 'ok' AS note
      FROM (SELECT *, rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY model, v) AS t FROM am) GROUP BY model"""
_RZ = "((greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - tie_term / ((n_a + n_b) * (n_a + n_b - 1.0)))))"


@register(
    "rank_sum_p_values", "H5 O5",
    W + _ARMM + f", rs AS ({_RSUM}), rz AS (SELECT *, {_RZ} AS z FROM rs) SELECT * EXCLUDE (z), least(1.0, 2 * ({_normal_tail('z')})) AS p_value FROM rz",
    "median_a median_b u delta tie_term p_value",
)
def rank_sum_p_values(spark, d):
    return T.rank_sum_p(rank_sum_between_arms(spark, d))


_REC = ", br AS (SELECT block, family, avg(rec) AS rec FROM (SELECT block, model, family, count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE AS rec FROM calls WHERE label = 1 GROUP BY ALL) GROUP BY ALL), df AS (SELECT m.block, m.rec - s.rec AS diff FROM br m JOIN br s ON m.block = s.block AND m.family = 'marker' AND s.family = 'composition')"


def family_recall_diff(spark, d):
    pos = calls(spark, d).filter(F.col("label") == 1)
    per = pos.groupBy("block", "model", "family").agg((F.count_if(F.col("call") == 1) / F.count("*")).alias("rec"))
    mean = lambda f: F.avg(F.when(F.col("family") == f, F.col("rec")))
    return per.groupBy("block").agg((mean("marker") - mean("composition")).alias("diff"))


@register(
    "signed_rank_groups", "H6",
    W + _REC + """, nz AS (SELECT diff, round(abs(diff), 12) AS a FROM df), rk AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY a) AS t FROM nz WHERE a > 0)
    SELECT (SELECT count(*) FROM nz) AS n, (SELECT avg(diff) FROM nz) AS mean_diff, (SELECT count(*) FROM nz WHERE a = 0) AS n_zero, coalesce(sum(r) FILTER (WHERE diff > 0), 0) AS w_plus, count(*) AS n_nonzero, sum(t * t - 1)::DOUBLE AS tie_term FROM rk""",
    "mean_diff w_plus tie_term",
)
def signed_rank_groups(spark, d):
    return T.signed_rank(family_recall_diff(spark, d), "diff")


_SRANK = """SELECT (SELECT count(*) FROM nz) AS n, (SELECT avg(diff) FROM nz) AS mean_diff, (SELECT count(*) FROM nz WHERE a = 0) AS n_zero, coalesce(sum(r) FILTER (WHERE diff > 0), 0) AS w_plus, count(*) AS n_nonzero, sum(t * t - 1)::DOUBLE AS tie_term FROM rk"""
_SZ = "((w_plus - n_nonzero * (n_nonzero + 1) / 4.0) / sqrt(n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24.0 - tie_term / 48.0))"


@register(
    "signed_rank_p_value", "H6 O5",
    W + _REC + f""", nz AS (SELECT diff, round(abs(diff), 12) AS a FROM df), rk AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY a) AS t FROM nz WHERE a > 0),
    sr AS ({_SRANK}), sz AS (SELECT *, {_SZ} AS z FROM sr) SELECT * EXCLUDE (z), {_normal_tail('z')} AS p_greater FROM sz""",
    "mean_diff w_plus tie_term p_greater",
)
def signed_rank_p_value(spark, d):
    return signed_rank_groups(spark, d).withColumn("p_greater", P.signed_rank_p_greater("w_plus", "n_nonzero", "tie_term", "n_zero"))


@register(
    "exact_group_permutation", "H7 K10",
    W + f""", pb AS (SELECT source, model, family, round(count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE, 9) AS rec FROM calls WHERE label = 1 GROUP BY ALL),
    un AS (SELECT stratum AS s, model, family, round(count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE, 9) AS rec FROM calls WHERE label = 1 GROUP BY ALL),
    rk AS (SELECT model, family, s, rank() OVER (ORDER BY rec) + (count(*) OVER (PARTITION BY rec) - 1) / 2.0 AS r, family = 'marker' AS inn FROM un),
    us AS (SELECT row_number() OVER (ORDER BY r, inn) - 1 AS i, r, inn FROM rk),
    mk AS (SELECT m, sum(r) AS s FROM (SELECT m FROM range(1048576) t(m) WHERE bit_count(m) = 10) JOIN us ON (m >> i) & 1 = 1 GROUP BY m), ob AS (SELECT sum(r) AS o FROM us WHERE inn)
    SELECT 'recall' AS metric, 10 AS n_first, 10 AS n_second, any_value(o) - 55 AS u, least(1.0, 2 * least(avg((s <= o + 1e-9)::INT), avg((s >= o - 1e-9)::INT))) AS p_two_sided, avg((s >= o - 1e-9)::INT) AS p_greater, avg((s <= o + 1e-9)::INT) AS p_less FROM mk, ob""",
    "u p_two_sided p_greater p_less",
)
def exact_group_permutation(spark, d):
    """Units are (model, stratum) recalls; marker models against composition models."""
    pos = calls(spark, d).filter(F.col("label") == 1)
    per = pos.groupBy("stratum", "model", "family").agg(F.round(F.count_if(F.col("call") == 1) / F.count("*"), 9).alias("rec")).withColumn("metric", F.lit("recall"))
    return T.exact_rank_permutation(per, "rec", F.col("family") == "marker", keys=["metric"])


@register(
    "group_contrast_summary", "K10 D8",
    W + """, un AS (SELECT model, family, count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE AS rec FROM calls WHERE label = 1 GROUP BY ALL)
    SELECT family, count(*) AS n, avg(rec) AS mean, min(rec) AS min, max(rec) AS max FROM un GROUP BY family""",
    "mean min max",
)
def group_contrast_summary(spark, d):
    pos = calls(spark, d).filter(F.col("label") == 1)
    per = pos.groupBy("model", "family").agg((F.count_if(F.col("call") == 1) / F.count("*")).alias("rec"))
    return per.groupBy("family").agg(F.count("*").alias("n"), F.avg("rec").alias("mean"), F.min("rec").alias("min"), F.max("rec").alias("max"))


_CTX = f""", cx AS (SELECT model, stratum, round({MCC_SQL}, 9) AS v FROM (SELECT model, stratum, {COUNTS_SQL} FROM calls GROUP BY ALL)),
 cr AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY v) + (count(*) OVER (PARTITION BY stratum, v) - 1) / 2.0 AS r FROM cx),
 cc AS (SELECT a.stratum AS context_a, z.stratum AS context_b, count(*) AS n, CASE WHEN var_pop(a.r) > 0 AND var_pop(z.r) > 0 THEN covar_pop(a.r, z.r) / sqrt(var_pop(a.r) * var_pop(z.r)) END AS rho FROM cr a JOIN cr z ON a.model = z.model AND a.stratum < z.stratum GROUP BY ALL)"""


@register("context_correlation_matrix", "H10 C10", W + _CTX + " SELECT * FROM cc", "rho")
def context_correlation_matrix(spark, d):
    c = settle(C.confusion(calls(spark, d), ("model", "stratum"))).select("model", F.col("stratum").alias("context"), F.round(M.mcc(), 9).alias("v"))
    return ST.context_correlations(c)


# With the four models of these tables t has two degrees of freedom, and its two-sided tail is 1 - |rho|.
@register(
    "context_correlation_p_values", "H10 O2 E9",
    W + _CTX + ", cp AS (SELECT *, 1 - abs(round(rho, 12)) AS p_value FROM cc) " + _adjusted("cp", "context_a, context_b"), "rho p_value p_adj",
)
def context_correlation_p_values(spark, d):
    m = context_correlation_matrix(spark, d).withColumn("p_value", P.correlation_p("rho", "n"))
    return O.adjust_bh(m, tie=["context_a", "context_b"])


@register(
    "bh_adjustment", "E9",
    W + """, p0 AS (SELECT block, model, count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE AS p FROM calls GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, block) AS rn, count(*) OVER (PARTITION BY model) AS n FROM p0)
    SELECT block, model, p, least(1.0, min(p * n / rn) OVER (PARTITION BY model ORDER BY p, block ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM rk""",
    "p p_adj",
)
def bh_adjustment(spark, d):
    rate = calls(spark, d).groupBy("block", "model").agg((F.count_if(F.col("call") == 1) / F.count("*")).alias("p"))
    return O.adjust_bh(rate, "p", family=["model"], tie=["block"])


@register(
    "bh_across_families", "E10",
    W + """, p0 AS (SELECT block, model, count(*) FILTER (WHERE call = 1) / count(*)::DOUBLE AS p FROM calls GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (ORDER BY p, model, block) AS rn, count(*) OVER () AS n FROM p0)
    SELECT block, model, p, least(1.0, min(p * n / rn) OVER (ORDER BY p, model, block ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM rk""",
    "p p_adj",
)
def bh_across_families(spark, d):
    rate = calls(spark, d).groupBy("block", "model").agg((F.count_if(F.col("call") == 1) / F.count("*")).alias("p"))
    return O.adjust_bh(rate, "p", tie=["model", "block"])
