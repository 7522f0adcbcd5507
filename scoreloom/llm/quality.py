"""Quality rules: fixed limits first, then robust multivariate outliers per language and source.

Every document gets a vector of transformed text statistics. Per (language, source) the minimum-covariance-
determinant estimate is approached by concentration steps: start from medians and absolute deviations, keep
the ``share`` of documents that lie nearest, take their mean and covariance, and repeat. A document whose
Mahalanobis distance from its group's estimate exceeds the cutoff is rejected.

Everything is column expressions and additive aggregates: group moments are sums that combine in the map
tasks, order statistics are counts over fixed-width bins of a logarithmic scale, and the Cholesky factor of
each group's covariance is written out as columns. A hot source therefore costs one row per task.

Defined results: a null or blank text has no words and fails the base rules; null language or source is a
group of its own; groups with fewer than ``min_rows`` usable documents use the estimate over all documents,
and if those are too few as well, the method rejects nothing; repeated rows are judged alike; an empty table
gives an empty table; columns other than the named ones are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.columns import WS, columns_of, let, whole, words
from scoreloom.sources.scratch import settle

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Robust:
    """``share``: part of a group that the estimate must fit. ``tail``: part of Gaussian documents that the
    cutoff may reject. ``floors``: least standard deviation of each statistic, so that one which hardly
    varies among clean documents (symbols, repeated lines) does not make every difference an outlier."""

    share: float = 0.75
    steps: int = 3
    tail: float = 1e-9
    min_rows: int = 100
    floors: tuple[float, ...] = (0.6, 0.1, 0.08, 0.1, 0.12)


def repeat_words(w: Column) -> Column:
    """Words lying in a three-word window that occurs at least twice in ``w``.

    Window hashes carry their position in the low bits, just as many as this text needs, so one sort of plain
    longs brings equal windows together; equal hashes are confirmed on the words themselves.
    """

    def marked(w: Column) -> Column:
        n = F.size(w)
        return let(F.pow(F.lit(2.0), F.length(F.bin(n.cast("long")))).cast("long") - 1, lambda mask: grams(w, n, mask))

    def grams(w: Column, n: Column, mask: Column) -> Column:
        packed = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")),
        )
        return let(F.sort_array(packed), lambda s: spread(hits(w, s, mask)))

    def hits(w: Column, s: Column, mask: Column) -> Column:
        def twin(v: Column, u: Column) -> Column:
            def same(k: int) -> Column:
                return F.get(w, v.bitwiseAND(mask).cast("int") + k) == F.get(w, u.bitwiseAND(mask).cast("int") + k)

            return (v.bitwiseXOR(u).bitwiseAND(F.bitwise_not(mask)) == 0) & same(0) & same(1) & same(2)

        near = F.filter(s, lambda v, j: F.coalesce(twin(v, F.get(s, j - 1)), F.lit(False)) | F.coalesce(twin(v, F.get(s, j + 1)), F.lit(False)))
        return F.sort_array(F.transform(near, lambda v: v.bitwiseAND(mask)))

    def spread(pos: Column) -> Column:
        return let(pos, lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0).cast("long"),
                        lambda a, j: a + F.coalesce(F.least(F.get(p, j) - F.get(p, j - 1), F.lit(3).cast("long")), F.lit(3).cast("long")))))

    return F.when(F.size(w) >= 4, marked(w)).otherwise(F.lit(0).cast("long"))


def text_stats(text: str) -> Column:
    """Struct of the five base statistics of a whole text."""
    t = whole(text)

    def of_words(w: Column) -> Column:
        with_word = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        )

    return let(words(text), of_words)


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_s", text_stats(text))


def vector(s: Column) -> list[Column]:
    """The transformed statistics: size and word length on log scales, shares on log or square-root scales."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return [
        F.log1p(s["n_words"].cast("double")),
        F.log(F.greatest(s["word_chars"], F.lit(1)).cast("double") / n),
        F.log1p(s["n_symbols"] / n),
        F.sqrt(s["n_dup_lines"] / n),
        F.sqrt(s["n_repeat_words"] / n),
    ]


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def chi2_cdf(x: float, d: int) -> float:
    """Distribution function by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= h / k
        total += term
    return total * math.exp(a * math.log(h) - h - math.lgamma(a))


def chi2_tail(p: float, d: int) -> float:
    """The value that a chi-square variable exceeds with probability ``p``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_cdf(mid, d) > p else (low, mid)
    return high


BINS = 200


def _quantiles(binned: DataFrame, group: list[str], values: list[str], share: float) -> DataFrame:
    """Per group, the upper edge of the bin in which ``share`` of each value is reached: exact counts, so the
    outcome does not depend on how rows meet."""
    long = binned.select(*group, F.posexplode(F.array(*[F.col(v) for v in values])).alias("_k", "_v"))
    bins = long.groupBy(*group, "_k", F.floor(F.col("_v") * BINS).cast("long").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    per = bins.groupBy(*group, "_k").agg(F.sort_array(F.collect_list(F.struct("_b", "_n"))).alias("_h"), F.sum("_n").alias("_t"))
    reached = F.aggregate(
        "_h", F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("long").alias("b")),
        lambda a, x: F.struct((a["c"] + x["_n"]).alias("c"), F.when(a["b"].isNull() & (a["c"] + x["_n"] >= F.col("_t") * share), x["_b"]).otherwise(a["b"]).alias("b")),
    )["b"]
    per = per.select(*group, "_k", ((reached + 1) / BINS).alias("_q"))
    return per.groupBy(*group).agg(*[F.max(F.when(F.col("_k") == k, F.col("_q"))).alias(f"_q{k}") for k in range(len(values))])


def _on(group: list[str], a: str, b: str) -> Column:
    cond = F.lit(True)
    for g in group:
        cond = cond & F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}"))
    return cond


def _joined(rows: DataFrame, per: DataFrame, group: list[str]) -> DataFrame:
    extra = [c for c in per.columns if c not in group]
    return rows.alias("r").join(per.alias("p"), _on(group, "r", "p")).select("r.*", *[F.col(f"p.{c}") for c in extra])


def distance(d: int) -> Column:
    """Squared Mahalanobis distance of columns _x* from centre _m* by forward substitution in the factor _l*."""

    def step(i: int, y: list[Column]) -> Column:
        if i == d:
            total = F.lit(0.0)
            for v in y:
                total = total + v * v
            return total
        r = F.col(f"_x{i}") - F.col(f"_m{i}")
        for j, v in enumerate(y):
            r = r - F.col(f"_l{i}_{j}") * v
        return let(r / F.col(f"_l{i}_{i}"), lambda v: step(i + 1, [*y, v]))

    return step(0, [])


def factor(moments: DataFrame, group: list[str], d: int, scale: float, floors: tuple[float, ...]) -> DataFrame:
    """Centre and Cholesky factor from a group's sums _n, _s*, _p*_*."""
    out = moments.select(
        *group, "_n", *[(F.col(f"_s{i}") / F.col("_n")).alias(f"_m{i}") for i in range(d)],
        *[F.col(f"_p{i}_{j}") for i in range(d) for j in range(i + 1)],
    )
    for i in range(d):
        for j in range(i + 1):
            c = (F.col(f"_p{i}_{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}")) * scale
            if i == j:
                c = F.greatest(c, F.lit(0.0)) + floors[i] ** 2
            for k in range(j):
                c = c - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
            out = out.withColumn(f"_l{i}_{j}", F.sqrt(F.greatest(c, F.lit(floors[i] ** 2))) if i == j else c / F.col(f"_l{j}_{j}"))
    return out.select(*group, "_n", *[f"_m{i}" for i in range(d)], *[f"_l{i}_{j}" for i in range(d) for j in range(i + 1)])


def estimates(vectors: DataFrame, group: list[str], d: int, how: Robust) -> DataFrame:
    """Centre and factor per group from rows (group, _x0 .. _x{d-1})."""
    x = [f"_x{i}" for i in range(d)]
    mid = _quantiles(vectors, group, x, 0.5)
    away = _joined(vectors, mid, group).select(*group, *[F.abs(F.col(f"_x{i}") - F.col(f"_q{i}")).alias(f"_x{i}") for i in range(d)])
    mad = _quantiles(away, group, x, 0.5).select(*group, *[F.greatest(F.col(f"_q{i}") * 1.4826, F.lit(how.floors[i])).alias(f"_d{i}") for i in range(d)])
    zero = [F.lit(0.0).alias(f"_l{i}_{j}") for i in range(d) for j in range(i)]
    now = mid.alias("r").join(mad.alias("p"), _on(group, "r", "p")).select(
        *[F.col(f"r.{g}") for g in group], *[F.col(f"_q{i}").alias(f"_m{i}") for i in range(d)],
        *[F.col(f"_d{i}").alias(f"_l{i}_{i}") for i in range(d)], *zero)
    scale = how.share / chi2_cdf(chi2_tail(1 - how.share, d), d + 2)
    for _ in range(how.steps):
        far = _joined(vectors, now, group).withColumn("_v", F.log1p(distance(d))).select(*group, *x, "_v")
        cut = _quantiles(far, group, ["_v"], how.share)
        near = _joined(far, cut, group).filter(F.floor(F.col("_v") * BINS) < F.round(F.col("_q0") * BINS))
        moments = near.groupBy(*group).agg(
            F.count(F.lit(1)).alias("_n"), *[F.sum(f"_x{i}").alias(f"_s{i}") for i in range(d)],
            *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_p{i}_{j}") for i in range(d) for j in range(i + 1)])
        now = settle(factor(moments, group, d, scale, how.floors))
    return now


def judge(stats: DataFrame, group: list[str], how: Robust = Robust()) -> DataFrame:
    """Add base_failed and kept to rows with the statistics struct ``_s``. ``stats`` is read several times:
    give a written table."""
    d = len(how.floors)
    g = [f"_g{i}" for i in range(len(group))]
    keyed = stats.select("*", *[F.col(f"`{c}`").alias(k) for c, k in zip(group, g, strict=True)], *[v.alias(f"_x{i}") for i, v in enumerate(vector(F.col("_s")))],
                         base_failed(F.col("_s")).alias("base_failed"))
    level = F.explode(F.array(F.struct(F.lit(1).alias("_lvl"), *g), F.struct(F.lit(0).alias("_lvl"), *[F.lit(None).cast(dict(keyed.dtypes)[k]).alias(k) for k in g])))
    vectors = keyed.filter(~F.col("base_failed")).select(level.alias("_g"), *[f"_x{i}" for i in range(d)]).select("_g.*", *[f"_x{i}" for i in range(d)])
    found = estimates(vectors, ["_lvl", *g], d, how).filter(F.col("_n") >= how.min_rows * how.share)
    params = [f"_m{i}" for i in range(d)] + [f"_l{i}_{j}" for i in range(d) for j in range(i + 1)]
    overall = found.filter("_lvl = 0").select(F.struct(*params)).scalar()
    own = found.filter("_lvl = 1").select(*g, F.struct(*params).alias("_own"))
    rows = keyed.alias("r").join(own.alias("p"), _on(g, "r", "p"), "left").select("r.*", F.coalesce("p._own", overall).alias("_p")).select("*", "_p.*")
    cut = chi2_tail(how.tail, d)
    return rows.withColumn("distance2", distance(d)).withColumn(
        "kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(F.col("distance2") <= cut, F.lit(True)))
    ).drop(*params, *g, *[f"_x{i}" for i in range(d)], "_p")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group: tuple[str, ...] = ("lang", "source"), how: Robust = Robust()) -> DataFrame:
    """id, the five statistics, base_failed, kept and the squared distance of every document."""
    stats = settle(with_stats(columns_of(docs, id_col, text, *group), text).drop(text))
    return judge(stats, list(group), how).select(F.col(id_col), *[F.col(f"_s.{c}").alias(c) for c in STATS], "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group: tuple[str, ...] = ("lang", "source"), how: Robust = Robust()) -> DataFrame:
    """The documents that the rules keep, with their own columns. A verdict depends on a row's text and group
    alone, so it is looked up by id, text hash and group; equal rows share it."""
    g = [f"_k{i}" for i in range(len(group))]
    key = [F.col(f"`{id_col}`").alias("_i"), F.xxhash64(whole(f"`{text}`")).alias("_t"), *[F.col(f"`{c}`").alias(k) for c, k in zip(group, g, strict=True)]]
    stats = settle(docs.select(*key, F.col(f"`{text}`").alias("_text")).withColumn("_s", text_stats("_text")).drop("_text"))
    good = judge(stats, g, how).filter("kept").select("_i", "_t", *g).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *key)
    return rows.alias("r").join(good.alias("p"), _on(["_i", "_t", *g], "r", "p"), "left_semi").select("_doc.*")
