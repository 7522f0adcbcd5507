"""Fragmenting sequences and folding window scores back to parents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.scalars import ratio
from scoreloom.operators.ordered import n50


def fragments(seqs: DataFrame, lengths: Sequence[int], *, seq_id: str = "id", seq: str = "seq", keep: Sequence[str] = ()) -> DataFrame:
    """Adjacent non-overlapping fragments at every length; the short tail is dropped.

    A sequence is cut by one regular-expression pass per length. Taking substrings by
    position would walk the sequence again from its start for every fragment.
    """

    def cut(n: int) -> Column:
        pieces = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{{n}}}"), F.lit(0))
        return F.transform(pieces, lambda x, i: F.struct(F.lit(n).alias("fragment_length"), (i + 1).alias("i"), x.alias("fragment")))

    cuts = [cut(n) for n in lengths]
    rows = seqs.select(seq_id, *keep, F.length(seq).alias("source_length"), F.inline(F.concat(*cuts)))
    return rows.select(
        F.format_string("%s_frag_%d_L%d", F.col(seq_id).cast("string"), "i", "fragment_length").alias("fragment_id"),
        F.col(seq_id).alias("source"), *keep, "fragment_length", "source_length", "i", "fragment",
    )


def windows(seqs: DataFrame, size: int, min_length: int, *, seq_id: str = "id", seq: str = "seq") -> DataFrame:
    """Half-overlapping windows of an even size. Sequences below ``min_length`` are
    skipped, those that fit one window stay whole, and no window is shorter than
    ``min_length``.

    The sequence is cut once into half windows and neighbouring halves are joined.
    """
    if size % 2:
        raise ValueError("window size must be even")
    step = size // 2
    base = seqs.select(seq_id, seq, F.length(seq).alias("n")).filter(F.col("n") >= min_length)
    halves = F.regexp_extract_all(F.col(seq), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    last = F.when(F.col("n") <= size, 0).otherwise(F.floor((F.col("n") - min_length) / step).cast("int"))
    rows = base.withColumn("_h", halves).withColumn("_w", F.sequence(F.lit(0), last))
    piece = F.expr("transform(_w, w -> struct(w AS w, concat(_h[w], coalesce(get(_h, w + 1), '')) AS fragment))")
    return rows.select(F.col(seq_id).alias("parent"), F.inline(piece)).select(
        "parent", "w", (F.col("w") * step).alias("start"), F.length("fragment").alias("window_length"), "fragment"
    )


def fold_windows(parents: DataFrame, scores: DataFrame, *, parent: str = "parent", positive: Column | None = None) -> DataFrame:
    """Mean window score, strict-majority class and window count; parents without
    windows get zeros."""
    pos = positive if positive is not None else F.col("score") >= 0.5
    agg = scores.groupBy(parent).agg(F.avg("score").alias("score"), F.count_if(pos).alias("_p"), F.count("*").alias("n_windows"))
    out = parents.join(agg, parent, "left").fillna(0, ["score", "_p", "n_windows"])
    return out.withColumn("is_positive", F.col("_p") * 2 > F.col("n_windows")).drop("_p")


def assembly_stats(lengths: DataFrame, length: str, *, group: Sequence[str] = (), at_least: Sequence[int] = (1000, 5000, 10000)) -> DataFrame:
    """Count, total, longest, shortest, cumulative length counts and N50."""
    agg = lengths.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(length).alias("total"), F.max(length).alias("longest"), F.min(length).alias("shortest"),
        *[F.count_if(F.col(length) >= t).alias(f"n_ge_{t}") for t in at_least],
    )
    half = n50(lengths, length, group=group)
    return agg.join(half, list(group)) if group else agg.withColumn("n50", half.scalar())


def evaluable(length: Column | str, minimum: Column | int) -> Column:
    x = F.col(length) if isinstance(length, str) else length
    return F.when(x < minimum, "no").otherwise("yes")


def share(num: Column, den: Column) -> Column:
    return ratio(num, den)
