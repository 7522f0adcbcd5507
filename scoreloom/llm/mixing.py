"""Mixing sources to target weights over fixed-length token blocks.

Each source's documents, in a pseudorandom order, form one stream of words that is cut into blocks of fixed
length. A source's target in words gives its number of slots: whole passes over its blocks and one part of a
pass. Output shards have a fixed number of slots; each shard draws its source counts from the multinomial
distribution with the sources' shares of all slots, and draws beyond a source's number are returned, those short
of it go to a last shard. A slot's number within its source is mapped through a pseudorandom permutation of the
source's block indices, a new one for each pass, and slots and blocks are joined by (source, index).

Streams need no task that sees a whole source: documents fall into hash buckets of about ``bucket_rows``, sizes
are summed per bucket, and only those sums are accumulated along a source.

Defined results: a null text has no words; a null source is a source of its own, last in order; a document
without words takes nothing; repeated rows are separate documents; if there are no words at all every target is
0; an empty table gives an empty table; other columns are ignored (``mix_sizes``) or carried along (``mix``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.arrays import mix as mix64
from scoreloom.llm.arrays import stream
from scoreloom.llm.columns import columns_of, let, whole, word_count, words
from scoreloom.sources.scratch import settle


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code-point order. ``most``: times a source may be used."""

    weights: tuple[float, ...] = (5, 2, 1)
    most: int = 3
    block: int = 128
    shard_slots: int = 4096
    bucket_rows: int = 4096
    seed: int = 2024


def targets(sizes: DataFrame, how: Mix) -> DataFrame:
    """_s (rank), source, source_size, n_docs, target from rows (source, size). One row per source.

    Sorted by the level at which a source reaches its limit, the common level is the first that does not exceed
    its own row's: everything before it stops at the limit, everything after takes its weight times the level.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = by.withColumn("_s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.get(F.array(*[F.lit(float(x)) for x in how.weights]), F.col("_s") % len(how.weights))
    ranked = ranked.withColumn("_w", w).withColumn("_limit", F.lit(float(how.most)) * F.col("source_size")).withColumn("_at", F.col("_limit") / F.col("_w"))
    before = Window.orderBy("_at", "_s").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_s", "_level"))).over(everything)
    return ranked.withColumn("target", F.least(F.col("_limit"), first["_level"] * F.col("_w"))).select("_s", "source", "source_size", "n_docs", "target")


def plan(per: DataFrame, how: Mix) -> DataFrame:
    """Add blocks, slots and the words of the last slot to the sources."""
    goal = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    out = per.withColumn("blocks", F.ceil(F.col("source_size") / how.block).cast("long")).withColumn("_goal", F.when(F.col("source_size") > 0, goal).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("_pass", F.expr("_goal div greatest(source_size, 1)")).withColumn("_rest", F.col("_goal") - F.col("_pass") * size)
    part = F.ceil(F.col("_rest") / how.block).cast("long")
    return out.withColumn("slots", F.col("_pass") * F.col("blocks") + part).withColumn(
        "last_words", F.when(part > 0, F.col("_rest") - (part - 1) * how.block).otherwise(F.lit(how.block))).drop("_goal", "_pass", "_rest")


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 for each key: four Feistel rounds on the least even number of bits
    that holds n, walked until the value falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half[todo], out[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (mix64(right + key[todo] * np.uint64(4) + np.uint64(r)) & mask[todo])
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def draws(sources: DataFrame, how: Mix) -> DataFrame:
    """(shard, _s, first, end): the slots of each source that each shard takes."""
    all_slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("t"), F.sort_array(F.collect_list(F.struct("_s", "slots"))).alias("per"))
    shards = all_slots.select("t", "per", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("t") / how.shard_slots).cast("long"))).alias("shard")).repartition("shard")
    slots = how.shard_slots
    seed = how.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, src, count = [], [], []
            for row in batch.to_pylist():
                want = np.array([x["slots"] for x in row["per"]], np.float64)
                if row["t"]:
                    got = np.random.Generator(np.random.Philox(key=[seed, row["shard"]])).multinomial(min(slots, max(0, row["t"] - row["shard"] * slots)), want / want.sum())
                    shard += [row["shard"]] * len(want)
                    src += [x["_s"] for x in row["per"]]
                    count += got.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(src, pa.int32()), pa.array(count, pa.int64())], names=["shard", "_s", "n"])

    drawn = shards.mapInArrow(run, "shard long, _s int, n long")
    upto = Window.partitionBy("_s").orderBy("shard")
    total = F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    end_of = F.lead(F.lit(1)).over(upto).isNull()
    placed = drawn.withColumn("_e", total).withColumn("_last", end_of).join(sources.select("_s", "slots", "blocks", "last_words"), "_s")
    return placed.select("shard", "_s", "slots", "blocks", "last_words", F.least(F.col("_e") - F.col("n"), "slots").alias("first"),
                         F.when(F.col("_last"), F.col("slots")).otherwise(F.least("_e", "slots")).alias("end"))


def slot_blocks(sources: DataFrame, how: Mix) -> DataFrame:
    """(shard, _s, slot, index, words): which block each slot takes, and how many of its words."""
    slots = draws(sources, how).filter("first < end").select("shard", "_s", "slots", "blocks", "last_words", F.explode(F.sequence("first", F.col("end") - 1)).alias("slot"))
    block, seed = how.block, how.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, slot, n = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_s", "slot", "blocks"))
            last = (slot == b.column(b.schema.get_field_index("slots")).to_numpy() - 1)
            key = mix64(s.astype(np.uint64) * np.uint64(1_000_003) + (slot // n).astype(np.uint64) + stream(seed, 1))
            words = np.where(last, b.column(b.schema.get_field_index("last_words")).to_numpy(), block)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("shard")), pa.array(s, pa.int32()), pa.array(slot), pa.array(permute(slot % n, n, key)), pa.array(words.astype(np.int64))],
                                             names=["shard", "_s", "slot", "index", "words"])

    return slots.mapInArrow(run, "shard long, _s int, slot long, index long, words long")


def streams(rows: DataFrame, sources: DataFrame, how: Mix) -> DataFrame:
    """Add _s, source_size, target and _at, the place of a row's first word in its source's stream.
    ``rows`` have id, size, source and any others."""
    order = F.xxhash64("id", F.lit(how.seed))
    known = rows.join(sources.select("_s", F.col("source").alias("_name"), "source_size", "target", "n_docs"), F.col("source").eqNullSafe(F.col("_name")))
    known = known.withColumn("_b", F.pmod(F.xxhash64("id", "size"), F.expr(f"n_docs div {how.bucket_rows} + 1"))).withColumn("_o", order)
    sums = known.groupBy("_s", "_b").agg(F.sum("size").alias("_n"))
    base = sums.select("_s", "_b", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_n")).alias("_base"))
    inside = F.sum("size").over(Window.partitionBy("_s", "_b").orderBy("_o", "id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return known.withColumn("_in", inside).join(base, ["_s", "_b"]).withColumn("_at", F.col("_base") + F.col("_in")).drop("_name", "n_docs", "_b", "_o", "_in", "_base")


def pieces(placed: DataFrame, uses: DataFrame, how: Mix) -> DataFrame:
    """One row per document and block: _s, _at, lo and hi (words of the document), whole (times taken), part (words
    of the block that the part slot takes)."""
    cut = placed.filter("size > 0").select("_s", "_at", "size", F.explode(F.sequence(F.expr(f"_at div {how.block}"), F.expr(f"(_at + size - 1) div {how.block}"))).alias("index"))
    start = F.col("index") * how.block
    return cut.join(uses, ["_s", "index"], "left").select(
        "_s", "_at", "size", F.greatest(start - F.col("_at"), F.lit(0).cast("long")).alias("lo"), F.least(start + how.block - F.col("_at"), "size").alias("hi"),
        F.coalesce("whole", F.lit(0)).alias("whole"), F.least(F.greatest(start + F.coalesce("part", F.lit(0)) - F.col("_at"), F.lit(0).cast("long")), "size").alias("part_hi"))


def block_uses(sources: DataFrame, how: Mix) -> DataFrame:
    whole = F.col("words") == how.block
    return slot_blocks(sources, how).groupBy("_s", "index").agg(F.count_if(whole).alias("whole"), F.max(F.when(~whole, F.col("words"))).alias("part"))


def part_words() -> Column:
    return F.greatest(F.col("part_hi") - F.col("lo"), F.lit(0).cast("long"))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", how: Mix = Mix()) -> DataFrame:
    """id, size, source_size, target, taken of every document."""
    sized = settle(columns_of(docs, id_col, text, source).select(F.col(id_col).alias("id"), word_count(text).alias("size"), F.col(source).alias("source")))
    sources = settle(plan(targets(sized, how), how))
    placed = streams(sized, sources, how)
    got = pieces(placed.select("_s", "_at", "size"), block_uses(sources, how), how).groupBy("_s", "_at").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("whole") + part_words()).alias("taken"))
    some = placed.filter("size > 0").join(got, ["_s", "_at"], "left")
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none).select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars", how: Mix = Mix()) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: one row for each time that words of a document are taken.
    A document taken whole keeps its text; one taken in part keeps the taken words, joined by single spaces."""
    key = ["id", "_t", "source", "size"]
    light = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(whole(f"`{text}`")).alias("_t"), F.col(f"`{source}`").alias("source"), word_count(f"`{text}`").alias("size"))
    light = settle(light)
    sources = settle(plan(targets(light.select("source", "size"), how), how))
    placed = streams(light.filter("size > 0"), sources, how)
    cut = pieces(placed.select("_s", "_at", "size"), block_uses(sources, how), how)
    runs = cut.groupBy("_s", "_at").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "whole", "part_hi"))).alias("_p"))
    # Rows that agree in all of ``key`` are interchangeable: each takes one of the places that were given to them.
    places = placed.join(runs, ["_s", "_at"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_at", "_p"))).alias("_places"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(whole(f"`{text}`")).alias("_t"), F.col(f"`{source}`").alias("source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    nth = F.row_number().over(Window.partitionBy("id", "_t").orderBy("source", F.xxhash64("_doc"))) - F.rank().over(Window.partitionBy("id", "_t").orderBy("source"))
    rows = rows.withColumn("_nth", nth).withColumnRenamed("id", "_i").withColumnRenamed("source", "_src").withColumnRenamed("_t", "_h")
    met = rows.join(places, F.col("_i").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("_t")) & F.col("_src").eqNullSafe(F.col("source")))
    each = met.select("_doc", "size", F.get("_places", F.col("_nth"))["_p"].alias("_p"))

    def nth_copy(k: int) -> Column:
        return F.transform("_p", lambda x: F.struct(x["lo"].alias("lo"), F.when(x["whole"] >= k, x["hi"]).otherwise(x["lo"]).alias("hi")))

    copies = [nth_copy(k) for k in range(1, how.most + 1)]
    copies.append(F.transform("_p", lambda x: F.struct(x["lo"].alias("lo"), F.greatest(F.least(x["part_hi"], x["hi"]), x["lo"]).alias("hi"))))
    taken = F.aggregate("_c", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    each = each.select("_doc", "size", F.explode(F.array(*copies)).alias("_c")).withColumn("_n", taken).filter("_n > 0")
    some = F.filter("_c", lambda x: x["hi"] > x["lo"])
    part = let(words(F.col(f"_doc.`{text}`")), lambda w: F.array_join(F.flatten(F.transform(some, lambda x: F.slice(w, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))), " "))
    out = each.withColumn("_text", F.when(F.col("_n") == F.col("size"), F.col(f"_doc.`{text}`")).otherwise(part))
    pick = {text: F.col("_text"), length: F.length("_text").cast(dict(docs.dtypes).get(length, "long"))}
    return out.select(*[pick.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])
