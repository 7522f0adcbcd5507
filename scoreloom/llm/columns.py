"""Column expressions shared by the text operators. Nothing here shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words and around lines: space, tab, line feed, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\f\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and however deep ``body`` names it.

    A plain column used inside a lambda may be inlined by the optimiser and then runs once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """The words of a text, unchanged; null and blank texts have none."""
    return let(F.btrim(whole(text), F.lit(WS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_RUN)))


def word_count(text: str | Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased and every other character kept. The built-in lower() agrees unless an upper-case
    letter outside ASCII occurs, so only such strings take the slower path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(s.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{M}\p{Nd}\p{P}]"), F.translate(s, upper, upper.lower())).otherwise(F.lower(s))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the input can clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])
