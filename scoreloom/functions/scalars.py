"""Scalar expressions shared by the readers and operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no value" in the input files.
MISSING_WORDS = ("NA", "", "-", "nan", "none", "\\N", "None")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Trimmed text, NULL for any spelling of a missing value."""
    t = F.trim(col(c))
    return F.when(t.isin(*MISSING_WORDS), None).otherwise(t)


def to_double(c: Column | str) -> Column:
    """Tolerant text -> DOUBLE. The cast itself trims and reads nan/inf spellings; one
    reference to the input keeps pushed-down filters from repeating the parse."""
    return col(c).try_cast("double")


def to_long(c: Column | str, default: int | None = None) -> Column:
    v = col(c).try_cast("bigint")
    return v if default is None else F.coalesce(v, F.lit(default))


def is_finite(c: Column | str) -> Column:
    x = col(c)
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def at_least(score: Column | str, threshold: Column | float) -> Column:
    """``score >= threshold`` with NaN and NULL counted as "no"."""
    s = col(score)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce(~F.isnan(s) & (s >= t), F.lit(False))


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num/den in DOUBLE; ``empty`` (or NULL) when the denominator is zero."""
    r = F.try_divide(num.cast("double"), den.cast("double"))
    return r if empty is None else F.coalesce(r, F.lit(float(empty)))


def softmax_share(logits: Sequence[Column], index: int) -> Column:
    """Softmax probability of ``logits[index]`` as 1 / sum(exp(x_j - x_i)). An overflowing
    term gives 1/inf = 0, the right limit, so no shift by the maximum is needed."""
    total = F.lit(0.0)
    for x in logits:
        total = total + F.exp(x - logits[index])
    return 1.0 / total


def unit_interval(c: Column | str) -> Column:
    """Scores outside [0, 1] are read as logits and squashed."""
    x = col(c)
    return F.when((x > 1.0) | (x < 0.0), 1.0 / (1.0 + F.exp(-x))).otherwise(x)


def half_up_text(c: Column, places: int) -> Column:
    """Display text rounded half-up once, from the unrounded value."""
    return F.format_string(f"%.{places}f", F.round(c.cast("decimal(38,20)"), places).cast("double"))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def first_keyword(text: Column, table: Sequence[tuple[Sequence[str], str]], default: Column | str | None):
    """First row of ``table`` all of whose words occur in ``text`` decides the class."""
    expr = None
    for words, value in table:
        cond = F.lit(True)
        for w in words:
            cond = cond & text.contains(w)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def rank_path(c: Column | str) -> Column:
    """``d__X;p__Y;...`` -> MAP(rank letter -> name)."""
    return F.str_to_map(col(c), F.lit(";"), F.lit("__"))


def leading_token(c: Column | str) -> Column:
    return F.element_at(F.split(F.trim(col(c)), "\\s+"), 1)


def url_basename(c: Column | str) -> Column:
    return F.element_at(F.split(col(c), "/"), -1)


def hashed_uniform(*parts: Column | str | int) -> Column:
    """32-bit integer drawn from md5 of the joined parts; same value on every engine and retry."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
