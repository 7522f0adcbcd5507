"""Interval algebra on alignment hits.

Unions cut intervals at wide fixed bins, in which at most one row per starting position
remains after a map-side merge; tiling cuts deeply covered (query, subject) pairs into
bins that follow the number of hits. A pair holding a large share of all hits is spread
over its bins in both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions.scalars import ratio

WIDTH = 1 << 14


def clip_to_bins(df: DataFrame, lo: Column, hi: Column, width: int = WIDTH) -> DataFrame:
    """One row per position bin an interval touches, with the clipped bounds."""
    binned = df.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", hi.cast("bigint"))
    binned = binned.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    return binned.withColumn("_lo", F.greatest(F.col("_lo"), F.col("_bin") * width)).withColumn(
        "_hi", F.least(F.col("_hi"), F.col("_bin") * width + width - 1)
    )


def union_length(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column, *, name: str = "covered", width: int = WIDTH) -> DataFrame:
    """Positions covered by the union of inclusive intervals per key."""
    parts = clip_to_bins(df, lo, hi, width).groupBy(*keys, "_bin", "_lo").agg(F.max("_hi").alias("_hi"))
    w = Window.partitionBy(*keys, "_bin").orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("_hi").over(w), F.lit(-(2**62)))
    fresh = F.greatest(F.lit(0), F.col("_hi") - F.greatest(F.col("_lo") - 1, reach))
    return parts.withColumn("_new", fresh).groupBy(*keys).agg(F.sum("_new").alias(name))


def _dyadic(first: Column, end: Column) -> Column:
    """(level, place) of the aligned blocks of 2**level bins that make up the bins first .. end - 1."""
    up = lambda x, k: F.ceil(x / F.pow(F.lit(2), k)).cast("bigint")
    down = lambda x, k: F.floor(x / F.pow(F.lit(2), k)).cast("bigint")
    node = lambda k, at: F.struct(k.cast("int").alias("level"), at.alias("place"))

    def at_level(k: Column) -> Column:
        lo, hi = up(first, k), down(end, k)
        some = lo < hi
        return F.array_compact(F.array(F.when(some & (F.pmod(lo, F.lit(2)) == 1), node(k, lo)), F.when(some & (F.pmod(hi, F.lit(2)) == 1), node(k, hi - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.log2((end - first + 1).cast("double"))).cast("int")), at_level))


def _owned(table: pa.Table, slot: Sequence[str]) -> np.ndarray:
    """Positions that each piece (_lo, _hi) owns. Pieces come slot by slot, the least rank first.

    End points cut a slot into elementary segments. A piece marks the two blocks of 2**level segments that make up its
    span, level by level from above; a mark goes down to both halves of its block where no lesser one is. What is left at
    single segments are their owners: work and memory follow the pieces, not their overlaps.
    """
    k = len(table)
    lo, hi = (table.column(c).to_numpy() for c in ("_lo", "_hi"))
    own_slot = np.zeros(k, np.int64)
    own_slot[_turns(table, slot)] = 1
    own_slot = np.cumsum(own_slot)
    at, of = np.concatenate([lo, hi + 1]), np.concatenate([own_slot, own_slot])
    order = np.lexsort((at, of))
    fresh = np.concatenate([[True], (np.diff(at[order]) != 0) | (np.diff(of[order]) != 0)])
    place = np.empty(2 * k, np.int64)
    place[order] = np.cumsum(fresh) - 1
    start, end = place[:k], place[k:]
    points = at[order][fresh]
    level = np.frexp((end - start).astype(np.float64))[1] - 1
    owner = np.full(len(points), k)
    for j in range(int(level.max()), -1, -1):
        mine = np.flatnonzero(level == j)
        np.minimum.at(owner, start[mine], mine)
        np.minimum.at(owner, end[mine] - (1 << j), mine)
        if j:
            half = 1 << (j - 1)
            lower = owner.copy()
            lower[half:] = np.minimum(lower[half:], owner[:-half])
            owner = lower
    held = np.flatnonzero(owner < k)
    bases = np.zeros(k, np.int64)
    np.add.at(bases, owner[held], points[held + 1] - points[held])
    return bases


def _turns(rows: pa.RecordBatch | pa.Table, slot: Sequence[str]) -> np.ndarray:
    """Rows whose slot is not that of the row before."""
    new = np.zeros(len(rows) - 1, bool)
    for c in slot:
        new |= pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def owned_segments(hits: DataFrame, key: Sequence[str], rank: Sequence[str], *, deep: int = 1024) -> DataFrame:
    """(key, rank, bases): positions that each hit owns, the hit of least ``rank`` owning a position that several cover.

    ``hits`` have key, rank columns, _lo and _hi; keys hold no null. A key with at most ``deep`` hits is one stretch. Others
    are cut into bins so wide that about ``deep`` hits begin in each: a hit enters its two outer bins clipped, and the bins
    between as few aligned blocks of bins, of which only the best hit is kept before they are opened. So a bin holds about
    as many clipped hits as end points lie in it, and one hit that spans it, however many hits and however long. One
    exchange brings bins together; tasks sort them (the sort spills) and read them in batches.
    """
    key, rank = list(key), list(rank)
    hits = hits.dropna(subset=[*key, "_lo", "_hi"]).select(*key, *rank, "_lo", "_hi")
    many = hits.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_lo").alias("_a"), F.max("_hi").alias("_z")).filter(F.col("_n") > deep)
    width = F.pow(F.lit(2), F.greatest(F.lit(0), F.ceil(F.log2((F.col("_z") - F.col("_a") + 1) * F.lit(float(deep)) / F.col("_n"))))).cast("bigint")
    many = many.select(*key, width.alias("_w"))
    bins = [F.floor(F.col(c) / F.col("_w")).cast("bigint") for c in ("_lo", "_hi")]
    placed = hits.join(many, key, "left").select("*", F.coalesce(bins[0], F.lit(0)).alias("_b"), F.coalesce(bins[1], F.lit(0)).alias("_e"))
    piece = lambda b, lo, hi: F.struct(b.alias("_bin"), lo.alias("_lo"), hi.alias("_hi"))
    b, e, w = F.col("_b"), F.col("_e"), F.col("_w")
    ends = F.when(b == e, F.array(piece(b, F.col("_lo"), F.col("_hi")))).otherwise(F.array(piece(b, F.col("_lo"), (b + 1) * w - 1), piece(e, e * w, F.col("_hi"))))
    clipped = placed.select(*key, *rank, F.inline(ends))
    best = F.min(F.struct(*rank)).alias("_r")
    long = hits.join(many, key).select(*key, *rank, "_w", bins[0].alias("_b"), bins[1].alias("_e")).filter("_e - _b > 1")
    blocks = long.select(*key, *rank, "_w", F.inline(_dyadic(b + 1, e))).groupBy(*key, "_w", "level", "place").agg(best)
    size = F.pow(F.lit(2), F.col("level")).cast("bigint")
    opened = blocks.select(*key, "_w", "_r", F.explode(F.sequence(F.col("place") * size, F.col("place") * size + size - 1)).alias("_bin"))
    spanning = opened.select(*key, *[F.col(f"_r.{r}").alias(r) for r in rank], "_bin", (F.col("_bin") * w).alias("_lo"), (F.col("_bin") * w + w - 1).alias("_hi"))
    slot = [*key, "_bin"]
    pieces = clipped.unionByName(spanning).repartition(*[F.col(c) for c in slot]).sortWithinPartitions(*slot, *rank)
    out = [*key, *rank, "bases"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last slot, which may go on

        def close(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows)
            bases = _owned(table, slot)
            won = table.append_column("bases", pa.array(bases)).select(out).filter(pa.array(bases > 0))
            yield from won.to_batches()

        first = lambda batch, i: [batch.column(c)[i].as_py() for c in slot]
        for batch in batches:
            if not len(batch):
                continue
            if held and first(held[-1], len(held[-1]) - 1) != first(batch, 0):
                yield from close(held)
                held = []
            turns = _turns(batch, slot)
            if len(turns):
                yield from close([*held, batch.slice(0, turns[-1])])
                held = [batch.slice(turns[-1])]
            else:
                held.append(batch)
        if held:
            yield from close(held)

    kinds = {f.name: f for f in pieces.schema.fields}
    owners = pieces.mapInArrow(sweep, T.StructType([kinds[c] for c in out[:-1]]).add("bases", "long"))
    return owners.groupBy(*key, *rank).agg(F.sum("bases").alias("bases"))


def tile_hits(
    hits: DataFrame, *, query: str = "qseqid", subject: str = "sseqid", tie: Sequence[str] = ("line_no",), deep: int = 1024, width: int = WIDTH
) -> DataFrame:
    """Tiled coverage and identity per (query, subject).

    Every query position belongs to the highest-scoring hit covering it (file order
    on ties); identity is weighted by the positions won; a hit is accepted when it
    wins at least one position, and only accepted hits feed the totals and the
    subject coverage. ``tie`` names a hit within its pair.
    """
    key = [query, subject]
    slot = [*key, "_bin"]
    light = hits.select(*key, (-F.col("bitscore")).alias("_minus"), *tie, F.least("qstart", "qend").cast("bigint").alias("_lo"), F.greatest("qstart", "qend").cast("bigint").alias("_hi"))
    won = owned_segments(light, key, ["_minus", *tie], deep=deep).drop("_minus")
    accepted = won.join(hits.select(*key, *tie, "pident", "bitscore", "evalue", "sstart", "send", "qlen", "slen"), [*key, *tie])
    # Subject coverage and totals in one pass: a hit's totals ride on its first bin.
    spread = clip_to_bins(accepted, F.least("sstart", "send"), F.greatest("sstart", "send"), width)
    first = F.col("_lo") == F.least("sstart", "send")
    once = lambda c: F.sum(F.when(first, c).otherwise(0))
    parts = spread.groupBy(*slot, "_lo").agg(
        F.max("_hi").alias("_hi"), once(F.col("bases")).alias("_b"), once(F.col("pident") * F.col("bases")).alias("_num"),
        once(F.col("bitscore")).alias("_bits"), F.min("evalue").alias("_ev"), once(F.lit(1)).alias("_n"),
        F.max("qlen").alias("qlen"), F.max("slen").alias("slen"),
    )
    w = Window.partitionBy(*slot).orderBy("_lo").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("_hi").over(w), F.lit(-(2**62)))
    fresh = F.greatest(F.lit(0), F.col("_hi") - F.greatest(F.col("_lo") - 1, reach))
    totals = parts.withColumn("_new", fresh).groupBy(*key).agg(
        F.max("qlen").alias("qlen"), F.max("slen").alias("slen"), F.sum("_b").alias("covered_q"), F.sum("_new").alias("covered_s"),
        F.sum("_n").alias("n_accepted"), F.sum("_num").alias("_num"), F.sum("_bits").alias("total_bitscore"), F.min("_ev").alias("best_evalue"),
    )
    qf, sf = ratio(F.col("covered_q"), F.col("qlen")), ratio(F.col("covered_s"), F.col("slen"))
    ident = ratio(F.col("_num"), F.col("covered_q"))
    return totals.select(
        *key, "qlen", "slen", "covered_q", "covered_s", "n_accepted", ident.alias("weighted_identity"),
        (qf * 100.0).alias("q_af"), (sf * 100.0).alias("s_af"),
        (F.when(F.col("qlen") <= F.col("slen"), qf).otherwise(sf) * 100.0).alias("af_shorter"),
        "total_bitscore", "best_evalue", (ident / 100.0 * F.col("covered_q")).alias("identical_bases"),
    )


def best_subject(tiles: DataFrame, *, query: str = "qseqid", subject: str = "sseqid") -> DataFrame:
    """Subject with the most identical bases per query, then the highest total accepted score, then by name."""
    rank = F.struct((-F.round("identical_bases", 9)).alias("i"), (-F.col("total_bitscore")).alias("s"), F.col(subject).alias("n"))
    rows = F.struct(*[F.col(c) for c in tiles.columns])
    return tiles.groupBy(query).agg(F.min_by(rows, rank).alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in tiles.columns])


def summed_identity(hits: DataFrame, *, query: str = "qseqid", subject: str = "sseqid", tie: Sequence[str] = ("line_no",)) -> DataFrame:
    """Unmerged estimator per query: overlapping hits are counted repeatedly, so the
    aligned fraction can exceed 100. The subject is that of the last line."""
    order = F.struct(*tie)
    return hits.groupBy(query).agg(
        ratio(F.sum(F.col("pident") * F.col("length")), F.sum("length")).alias("ani"),
        (ratio(F.sum("length"), F.max("qlen")) * 100.0).alias("aligned_frac"),
        F.min("evalue").alias("evalue"), F.max_by(subject, order).alias("last_subject"),
    )


def target_coverage(
    paf: DataFrame, *, target: str = "target", length: str = "tlen", tie: Sequence[str] = ("line_no",),
    min_identity: float | None = None, min_fraction: float | None = None,
) -> DataFrame:
    """Cumulative aligned fraction and best identity per target (overlaps add up)."""
    rank = F.struct((-F.col("pident")).alias("_k"), *tie)
    out = paf.groupBy(target).agg(
        F.sum("aligned").alias("aligned"), F.max(length).alias("target_length"),
        F.max("pident").alias("best_identity"), F.min_by("query", rank).alias("best_query"),
    ).withColumn("aligned_frac", ratio(F.col("aligned"), F.col("target_length")) * 100.0)
    if min_identity is not None:
        out = out.filter(F.col("best_identity") >= min_identity)
    return out if min_fraction is None else out.filter(F.col("aligned_frac") >= min_fraction)


def genome_homology(hits: DataFrame, *, genome: str, other: str, glen: str, lo: Column, hi: Column) -> DataFrame:
    """Merged-interval coverage of each genome by foreign hits, best identity and the
    subject of the longest hit."""
    cov = union_length(hits, [genome], lo, hi, name="covered")
    top = hits.groupBy(genome).agg(
        F.max(glen).alias("genome_length"), F.max("pident").alias("best_identity"),
        F.min_by(other, F.struct((-F.col("length")).alias("_l"), F.col("line_no"))).alias("longest_hit_subject"),
    )
    return cov.join(top, genome).withColumn("covered_pct", ratio(F.col("covered"), F.col("genome_length")) * 100.0)


def depth_summary(depth: DataFrame, lengths: DataFrame, *, contig: str = "contig", reads: str | None = None) -> DataFrame:
    """Breadth % and mean depth over the contig length (not over covered positions)."""
    agg = depth.groupBy(contig).agg(F.count_if(F.col("depth") > 0).alias("covered_bases"), F.sum("depth").alias("_sum"))
    out = lengths.join(agg, contig, "left").fillna(0, ["covered_bases", "_sum"])
    out = out.withColumn("breadth_pct", ratio(F.col("covered_bases"), F.col("length")) * 100.0).withColumn(
        "mean_depth", ratio(F.col("_sum"), F.col("length"))
    )
    if reads:
        out = out.withColumn("n_read_pairs", F.floor(F.col(reads) / 2).cast("bigint"))
    return out.drop("_sum")
