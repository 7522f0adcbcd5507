"""Tail probabilities.

Exact binomial and hypergeometric tails are SQL expressions. Chi-square and
Student-t tails, and exact rank-test nulls, need functions Spark lacks; they are
vectorised UDFs applied to result tables of a few rows per test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.scalars import col


def binomial_two_sided(b: Column | str, c: Column | str) -> Column:
    """Exact two-sided p of b successes in b+c fair trials (callers keep b+c small)."""
    b, c = col(b).cast("bigint"), col(c).cast("bigint")
    n, k = b + c, F.least(b, c)
    # C(n, i) built by the product recurrence; the sum over i = 0..k is one tail.
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, i):
        term = acc["term"] * (n - i + 1).cast("double") / i.cast("double")
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    seq = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(seq, start, step, lambda acc: acc["total"])
    return F.least(F.lit(1.0), 2.0 * tail / F.pow(F.lit(2.0), n.cast("double")))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(chi-square with df degrees of freedom >= x)."""

    def one(v, k):
        if v is None or k is None or math.isnan(v) or k <= 0:
            return float("nan")
        if v <= 0:
            return 1.0
        h = v / 2.0
        if k % 2:
            total, s = math.erfc(math.sqrt(h)), 0.5
        else:
            total, s = math.exp(-h), 1.0
        log_h = math.log(h)
        while s < k / 2.0:
            total += math.exp(s * log_h - h - math.lgamma(s + 1.0))
            s += 1.0
        return min(1.0, total)

    return pd.Series([one(a, int(b)) for a, b in zip(x, df)], dtype="float64")


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided t-approximation p of a correlation r over n pairs."""

    def one(v, k):
        if v is None or math.isnan(v) or k < 3:
            return float("nan")
        if abs(v) >= 1.0:
            return 0.0
        dof = k - 2
        return incomplete_beta(dof / 2.0, 0.5, 1.0 - v * v)

    return pd.Series([one(a, int(b)) for a, b in zip(r, n)], dtype="float64")


def _u_counts(m: int, n: int) -> list[int]:
    """Arrangements of two tie-free samples by U: the coefficients of the Gaussian binomial, as whole numbers."""
    m, n = min(m, n), max(m, n)
    top = m * n
    c = [1] + [0] * top
    for i in range(1, m + 1):
        for u in range(top, n + i - 1, -1):
            c[u] -= c[u - n - i]
        for u in range(i, top + 1):
            c[u] += c[u - i]
    return c


@F.pandas_udf(T.DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, tie_term: pd.Series, side: pd.Series) -> pd.Series:
    """Rank-sum p-value: exact null for tie-free samples when the smaller holds at
    most 8, else the tie- and continuity-corrected normal. ``side`` is
    'two-sided' or 'greater' (group one larger)."""

    def one(v, m, n, t, s):
        if v is None or math.isnan(v) or m < 1 or n < 1:
            return float("nan")
        m, n = int(m), int(n)
        if t == 0 and min(m, n) <= 8:
            freq = _u_counts(m, n)
            total = float(sum(freq))
            stat = v if s == "greater" else max(v, m * n - v)
            tail = sum(freq[int(math.ceil(stat)):]) / total
            return min(1.0, tail if s == "greater" else 2.0 * tail)
        total_n = m + n
        var = m * n / 12.0 * ((total_n + 1) - t / (total_n * (total_n - 1.0)))
        if var <= 0:
            return 1.0
        stat = v if s == "greater" else max(v, m * n - v)
        z = (stat - m * n / 2.0 - 0.5) / math.sqrt(var)
        tail = 0.5 * math.erfc(z / math.sqrt(2.0))
        return min(1.0, tail if s == "greater" else 2.0 * tail)

    return pd.Series([one(*row) for row in zip(u, n1, n2, tie_term, side)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def signed_rank_p_greater(w_plus: pd.Series, n: pd.Series, tie_term: pd.Series, n_zero: pd.Series) -> pd.Series:
    """One-sided signed-rank p (positive shift): exact for n <= 50 without ties or
    zeros, else the normal approximation."""

    def one(w, k, t, z0):
        if w is None or k is None or k < 1:
            return 1.0
        k = int(k)
        top = k * (k + 1) // 2
        if t == 0 and z0 == 0 and k <= 50:
            freq = [0] * (top + 1)
            freq[0] = 1
            for i in range(1, k + 1):
                for s in range(top, i - 1, -1):
                    freq[s] += freq[s - i]
            return sum(freq[int(math.ceil(w)):]) / float(2**k)
        var = k * (k + 1) * (2 * k + 1) / 24.0 - t / 48.0
        if var <= 0:
            return 1.0
        z = (w - top / 2.0) / math.sqrt(var)
        return 0.5 * math.erfc(z / math.sqrt(2.0))

    return pd.Series([one(*row) for row in zip(w_plus, n, tie_term, n_zero)], dtype="float64")


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1.0) - math.lgamma(k + 1.0) - math.lgamma(n - k + 1.0)


@F.pandas_udf(T.DoubleType())
def fisher_less(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided Fisher exact p: chance of a table with a cell no larger than ``a``."""

    def one(a_, b_, c_, d_):
        n, row, colm = a_ + b_ + c_ + d_, a_ + b_, a_ + c_
        if n == 0:
            return float("nan")
        lo = max(0, int(row + colm - n))
        # Terms fall off geometrically below a_, so stop once they no longer count.
        base = _log_choose(n, row)
        total, k = 0.0, int(a_)
        while k >= lo:
            term = math.exp(_log_choose(colm, k) + _log_choose(n - colm, row - k) - base)
            total += term
            if term < 1e-18 * max(total, 1e-300) and k < row * colm / n:
                break
            k -= 1
        return min(1.0, total)

    return pd.Series([one(int(p), int(q), int(r), int(s)) for p, q, r, s in zip(a, b, c, d)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("p_less", T.DoubleType()), T.StructField("p_greater", T.DoubleType())]))
def exact_rank_tails(ranks: pd.Series, k: pd.Series, observed: pd.Series) -> pd.DataFrame:
    """Chances of a rank sum no larger and no smaller than observed, over all ways to choose ``k`` of the units.

    Doubled mid-ranks are whole numbers, so ways are counted by (chosen units, sum), one unit after the other: ties
    are kept and the cost grows with a power of the number of units, not with the number of assignments.
    """

    def one(r, m, o):
        v = np.rint(np.asarray(r, float) * 2).astype(int)
        ways = np.zeros((int(m) + 1, int(v.sum()) + 1))
        ways[0, 0] = 1.0
        for x in v:
            ways[1:, x:] += ways[:-1, : ways.shape[1] - x].copy()
        share, at = ways[-1] / ways[-1].sum(), np.arange(ways.shape[1]) / 2.0
        return share[at <= o + 1e-9].sum(), share[at >= o - 1e-9].sum()

    rows = [one(*x) for x in zip(ranks, k, observed)]
    return pd.DataFrame({"p_less": [a for a, _ in rows], "p_greater": [b for _, b in rows]}, dtype="float64")
