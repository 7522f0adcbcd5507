"""Gaussian mixtures of one variable, fitted on a fine histogram.

Entities are read once, by an aggregate that keeps count, sum and sum of squares of each bin: a table bounded by range
over width, however many entities there are. Expectation-maximisation then runs on the bins, one task per start; the
moments of a bin are exact, only responsibilities are those of its mean.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scalars import is_finite
from scoreloom.sources.scratch import settle

WIDTH, FLOOR = 2.0**-10, 1e-6


def histogram(df: DataFrame, value: str, *, width: float = WIDTH) -> DataFrame:
    """(bin, n, sx, sxx) of the finite values."""
    x = F.col("_x")
    some = df.filter(is_finite(value)).select(F.col(value).cast("double").alias("_x"))
    return some.groupBy(F.floor(x / width).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))


def start_places(start: int, k: int, seed: int) -> list[float]:
    """Quantiles at which the means of a start lie: one at a hashed place of each k-th of the values."""
    part = lambda i: int(hashlib.md5(f"{seed}|{start}|{i}".encode()).hexdigest()[:8], 16) / 2.0**32
    return [(i + part(i)) / k for i in range(k)]


def mixture_starts(hist: DataFrame, *, k: int = 3, starts: int = 10, max_iter: int = 500, tol: float = 1e-3, seed: int = 17) -> DataFrame:
    """(start, weight, mean, sd, first, log_likelihood, n, iterations, converged): components by mean, for every start.

    A start ends when the mean log-likelihood changes by less than ``tol``, or after ``max_iter`` rounds.
    """

    def fit(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        start = int(bins["start"].iloc[0])
        n, sx, sxx = (bins[c].to_numpy() for c in ("n", "sx", "sxx"))
        x, total = sx / n, n.sum()
        first = np.array([x[np.searchsorted(np.cumsum(n), q * total)] for q in start_places(start, k, seed)])
        mu = sx.sum() / total
        w, m, v, old, done, rounds = np.full(k, 1.0 / k), first, np.full(k, max(sxx.sum() / total - mu * mu, FLOOR) / (k * k)), -math.inf, False, 0

        def shares() -> tuple[np.ndarray, np.ndarray]:
            with np.errstate(divide="ignore"):
                logs = np.log(w) - 0.5 * np.log(2 * math.pi * v) - (x[:, None] - m) ** 2 / (2 * v)
            top = logs.max(axis=1)
            each = np.exp(logs - top[:, None])
            return each / each.sum(axis=1)[:, None], top + np.log(each.sum(axis=1))

        while not done and rounds < max_iter:
            r, lse = shares()
            own = (r * n[:, None]).sum(axis=0)
            safe = np.maximum(own, 1e-300)
            m = (r * sx[:, None]).sum(axis=0) / safe
            v = np.maximum(((r * sxx[:, None]).sum(axis=0) - 2 * m * (r * sx[:, None]).sum(axis=0)) / safe + m * m, 0.0) + FLOOR
            w, now = own / total, float((n * lse).sum() / total)
            done, old, rounds = abs(now - old) < tol, now, rounds + 1
        order = np.argsort(m, kind="stable")
        return pd.DataFrame({"start": [start], "weight": [w[order].tolist()], "mean": [m[order].tolist()], "sd": [np.sqrt(v[order]).tolist()], "first": [first.tolist()],
                             "log_likelihood": [float((n * shares()[1]).sum())], "n": [int(total)], "iterations": [rounds], "converged": [done]})

    each = hist.select("*", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    return each.groupBy("start").applyInPandas(fit, "start int, weight array<double>, mean array<double>, sd array<double>, first array<double>, log_likelihood double, n long, iterations int, converged boolean")


def best_mixture(df: DataFrame, value: str, *, k: int = 3, starts: int = 10, max_iter: int = 500, tol: float = 1e-3, seed: int = 17) -> DataFrame:
    """One row: the start of highest log-likelihood, with its BIC. No row without values. Written once: what reads the
    parameters must not fit again."""
    every = mixture_starts(histogram(df, value), k=k, starts=starts, max_iter=max_iter, tol=tol, seed=seed)
    best = every.agg(F.max_by(F.struct(*every.columns), F.struct("log_likelihood", -F.col("start"))).alias("_b")).filter("_b is not null").select("_b.*")
    return settle(best.withColumn("bic", -2.0 * F.col("log_likelihood") + (3 * k - 1) * F.log(F.col("n").cast("double"))))
