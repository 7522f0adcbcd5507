"""Ordered computations that stay distributed on skewed or single groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.scalars import col
from scoreloom.sources.scratch import settle


def laid_out(df: DataFrame, group: Sequence[str], value: str, *, ranges: int | None = None) -> DataFrame:
    """``df`` in an exchange by (group, value): ranges of about as many rows each, wherever the values lie, whose
    numbers ``_p`` follow the order. Written once, since whatever reads it must see the same ranges."""
    cols = [F.col(f"`{c}`") for c in (*group, value)]
    dealt = df.repartitionByRange(ranges, *cols) if ranges else df.repartitionByRange(*cols)
    return settle(dealt.withColumn("_p", F.spark_partition_id()))


def running_totals(
    df: DataFrame, group: Sequence[str], value: str, sums: Sequence[str], *, descending: bool = True, ranges: int | None = None, prefix: str = "cum_",
) -> DataFrame:
    """Inclusive running sums of ``sums`` in the order of ``value`` within ``group``.

    Needs one row per (group, value), i.e. pre-aggregated input, or such a table as ``laid_out`` gives. A plain window
    would sort a whole group in one task. Here a range exchange cuts all groups together into ranges of about as many
    rows; the totals of a group's earlier ranges are its offset in a range (one row per group and range), and the
    row-level window runs inside one range.
    """
    key = list(group)
    rows = df if "_p" in df.columns else laid_out(df, group, value, ranges=ranges)
    turn = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    part = [F.col(f"`{k}`") for k in key] or [F.lit(0)]
    before = Window.partitionBy(*part).orderBy(turn("_p")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "_p").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    totals = totals.select(*key, "_p", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy(*key, "_p").orderBy(turn(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(totals, [*key, "_p"]).select("*", *[(F.col(f"_o_{s}") + F.sum(s).over(inside)).alias(prefix + s) for s in sums])
    return out.drop("_p", *[f"_o_{s}" for s in sums])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], *, group: Sequence[str] = (), name: str = "quantiles") -> DataFrame:
    """Exact quantiles (linear between neighbours) of an unbounded group, as an array in the order of ``probs``.

    Rows are counted per value, the counts accumulated over ranges, and each quantile picks the one or two values
    whose places it lies between: no task holds a group. Null and NaN values do not count; without any, null.
    """
    key = list(group)
    some = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    freq = laid_out(some.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_c")), key, value)
    cum = running_totals(freq, key, value, ["_c"], descending=False, prefix="_upto")
    n = freq.groupBy(*key).agg(F.sum("_c").alias("_n"))
    placed = cum.join(n, key) if key else cum.withColumn("_n", n.select("_n").scalar())
    at = lambda k: F.max(F.when((F.col("_upto_c") > k) & (F.col("_upto_c") - F.col("_c") <= k), F.col(value).cast("double")))
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ends = [c for i, x in enumerate(place) for c in (at(F.floor(x)).alias(f"_l{i}"), at(F.ceil(x)).alias(f"_h{i}"))]
    found = placed.groupBy(*key, "_n").agg(*ends) if key else placed.groupBy("_n").agg(*ends)
    line = lambda i, x: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (x - F.floor(x))
    return found.select(*key, F.array(*[line(i, x) for i, x in enumerate(place)]).alias(name))


def dense_index(
    df: DataFrame, keys: Sequence[str], *, group: Sequence[str] = (), name: str = "idx", digits: int = 3
) -> DataFrame:
    """0-based dense index plus the row count ``n`` (per group), without a global sort.

    Rows are ordered by (leading md5 hex digits of the key, key): 16**digits even
    buckets whatever the key distribution, numbered inside their bucket and shifted
    by the sizes of the earlier buckets.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    tagged = df.withColumn("_h", F.substring(F.md5(text), 1, digits))
    slot = [*group, "_h"]
    sizes = tagged.groupBy(*slot).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*group).orderBy("_h")  # at most 16**digits rows per group
    starts = sizes.select(
        *slot,
        F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"),
        F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    )
    inside = Window.partitionBy(*slot).orderBy(*keys)
    return (
        tagged.withColumn("_r", F.row_number().over(inside))
        .join(starts, slot)
        .withColumn(name, (F.col("_s") + F.col("_r") - 1).cast("bigint"))
        .drop("_h", "_r", "_s")
    )


def best_per_key(
    df: DataFrame, keys: Sequence[str], metric: str, tie: Sequence[str], *, largest: bool = True
) -> DataFrame:
    """Best row per key; ties go to the smallest tie columns (file order).

    An aggregate, not a window: each map task keeps one candidate per key, so a key
    holding a third of the rows costs no more than any other.
    """
    rank = F.struct((-F.col(metric) if largest else F.col(metric)).alias("_k"), *[F.col(t) for t in tie])
    rest = [c for c in df.columns if c not in keys]
    return (
        df.filter(F.col(metric).isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), rank).alias("_best"))
        .select(*keys, *[F.col("_best")[c].alias(c) for c in rest])
    )


def top_k_wide(
    df: DataFrame, keys: Sequence[str], metric: str, label: Column, k: int, tie: str
) -> DataFrame:
    """rank_1..rank_k columns per key, NaN and NULL last."""
    w = Window.partitionBy(*keys).orderBy(F.nanvl(F.col(metric), F.lit(None)).desc_nulls_last(), F.col(tie))
    ranked = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).withColumn("_l", label)
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_r") == i, F.col("_l"))).alias(f"rank_{i}") for i in range(1, k + 1)])


def mid_ranks(df: DataFrame, value: str, *, group: Sequence[str] = (), name: str = "mid_rank") -> DataFrame:
    """Average ranks (ties share the mean), ascending. For bounded groups such as
    models or blocks; ``mid_ranks_large`` handles unbounded ones."""
    w = Window.partitionBy(*group).orderBy(value)
    ties = Window.partitionBy(*group, value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def mid_ranks_large(df: DataFrame, value: str, *, group: Sequence[str] = (), name: str = "mid_rank") -> DataFrame:
    """Average ranks of an unbounded group: distinct-value counts, distributed running
    totals, then one join back on the value."""
    freq = df.groupBy(*group, value).agg(F.count("*").alias("_c"))
    cum = running_totals(freq, group, value, ["_c"], descending=False, prefix="_cum")
    ranks = cum.select(*group, value, (F.col("_cum_c") - (F.col("_c") - 1) / 2.0).alias(name))
    return df.join(ranks, [*group, value])


def adjust_bh(df: DataFrame, p: str = "p_value", *, family: Sequence[str] = (), tie: Sequence[str], name: str = "p_adj"):
    """Benjamini-Hochberg within a family (result tables: one row per test).
    NULL and NaN p-values stay NULL and do not count as tests."""
    good = F.col(p).isNotNull() & ~F.isnan(p)
    tested = df.filter(good)
    part = Window.partitionBy(*family)
    asc = part.orderBy(p, *tie)
    n = F.count("*").over(part)
    rank = F.row_number().over(asc)
    back = asc.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    step = tested.withColumn("_raw", F.col(p) * n / rank)
    done = step.withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(back))).drop("_raw")
    return done.unionByName(df.filter(~F.coalesce(good, F.lit(False))).withColumn(name, F.lit(None).cast("double")))


def carry_forward(
    df: DataFrame, line_no: str, marker: Column, value: Column, *, file: str = "file", name: str = "enclosing", block: int = 4096
) -> DataFrame:
    """Value of the nearest marker line at or above each line of an ordered file.

    Lines are cut into fixed blocks; the last marker of every block is carried over
    the (few) blocks first, so one long file never sits in one task.
    """
    tagged = df.withColumn("_blk", F.floor(F.col(line_no) / block)).withColumn("_m", F.when(marker, value))
    ends = tagged.filter(F.col("_m").isNotNull()).groupBy(file, "_blk").agg(F.max_by("_m", line_no).alias("_end"))
    blocks = tagged.select(file, "_blk").distinct().join(ends, [file, "_blk"], "left")
    before = Window.partitionBy(file).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(file, "_blk", F.last("_end", ignorenulls=True).over(before).alias("_start"))
    inside = Window.partitionBy(file, "_blk").orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        tagged.join(starts, [file, "_blk"])
        .withColumn(name, F.coalesce(F.last("_m", ignorenulls=True).over(inside), F.col("_start")))
        .drop("_blk", "_m", "_start")
    )


def pareto_front(df: DataFrame, cost: str, gain: str, *, group: Sequence[str] = ()) -> DataFrame:
    """Rows whose gain beats every cheaper (or equally cheap but better-placed) row."""
    w = Window.partitionBy(*group).orderBy(F.col(cost), F.col(gain).desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(gain).over(w)
    return df.withColumn("_b", best).filter(F.col("_b").isNull() | (F.col(gain) > F.col("_b"))).drop("_b")


def n50(lengths: DataFrame, length: str, *, group: Sequence[str] = ()) -> DataFrame:
    """N50 per group: running totals over distinct lengths (bounded by the number of
    distinct lengths, not of rows)."""
    mass = laid_out(lengths.groupBy(*group, length).agg((F.count("*") * F.col(length)).cast("bigint").alias("bp")), group, length)
    cum = running_totals(mass, group, length, ["bp"], descending=True)
    if group:
        joined = cum.join(mass.groupBy(*group).agg(F.sum("bp").alias("_total")), list(group))
    else:
        joined = cum.withColumn("_total", mass.agg(F.sum("bp")).scalar())
    hit = joined.filter(F.col("cum_bp") * 2 >= F.col("_total"))
    return hit.groupBy(*group).agg(F.max(length).alias("n50"))


def rank_by(df: DataFrame, metric: str, *, group: Sequence[str] = (), tie: Sequence[str] = (), method: str = "ordinal",
            name: str = "rank") -> DataFrame:
    """Descending rank: 'ordinal' (ties broken by ``tie``) or 'min'."""
    w = Window.partitionBy(*group).orderBy(F.col(metric).desc(), *(tie if method == "ordinal" else ()))
    return df.withColumn(name, (F.row_number() if method == "ordinal" else F.rank()).over(w))
