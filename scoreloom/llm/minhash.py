"""Near-duplicate documents: MinHash bands for candidates, odd sketches to judge them, full sets to confirm.

1. Every text gives its distinct word shingles, MinHash samples, band keys, and an odd sketch: a bitmap in which
   each sample flips one bit, so that the population count of two sketches' XOR tells how many samples differ.
2. Texts with equal shingle sets form one class; a class is one node however many copies it has.
3. In each band bucket every class is tied to the bucket's least class. The components of these ties are
   clusters; both ends of any pair that shares a bucket lie in one cluster. No pairs are formed here.
4. Clusters are cut into blocks by size of their sets. Each pair of blocks is one task, which compares sketches
   by matrix operations, confirms likely pairs on the full sets, and skips pairs that are already connected. It
   returns at most one edge per member, all of them confirmed.
5. The components of the confirmed edges are the answer.

A pair of similarity 0.85 shares no band with probability (1 - 0.85**5)**24 < 1e-6 and is missed by its
sketches, cut at five standard deviations, about as rarely.

Defined results: texts without words have an empty set, no link and are kept; a row without id is linked with
nothing, has a null component and is kept; rows that share an id are judged by their texts; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm import arrays as A
from scoreloom.llm.columns import columns_of
from scoreloom.llm.graph import components
from scoreloom.sources.scratch import settle


@dataclass(frozen=True)
class Near:
    """``per_cent``: link when 100 * intersection >= per_cent * union. ``block_mb``: set bytes of a block."""

    shingle: int = 5
    per_cent: int = 80
    bands: int = 24
    rows: int = 5
    bits: int = 512
    block_mb: float = 16.0

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """XOR population count beyond which a pair is below the limit by at least five standard deviations."""
        j = self.per_cent / 100
        low = j - 5 * math.sqrt(j * (1 - j) / self.samples)
        apart = 2 * self.samples * (1 - low)
        return math.ceil(self.bits / 2 * (1 - math.exp(-2 * apart / self.bits)) + 5)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer than ``k`` words count as one shingle."""
    for a, b, data, offs in A.slices(texts):
        starts, ends, first = A.spans(data, offs)
        h = A.hash_spans(data, starts, ends, lower=True)
        grams = A.windows(h, k)
        short = [A.windows(h, i, seed=1000 + i) for i in range(1, k)]
        for i in range(b - a):
            p, q = first[i], first[i + 1]
            if q - p >= k:
                yield np.unique(grams[p : q - k + 1])
            else:
                yield short[q - p - 1][p : p + 1] if q > p else np.zeros(0, np.uint64)


def signature(s: np.ndarray, how: Near) -> tuple[bytes, list[int], bytes]:
    """Class key, band keys and odd sketch of a set."""
    key = np.array([np.bitwise_xor.reduce(A.mix(s + np.uint64(5))), A.mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64).tobytes()
    factors = (A.stream(77, how.samples) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    small = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(how.samples, 0xFFFFFFFF, np.uint32)
    for p in range(0, len(s), 2048):
        x = small[p : p + 2048, None] * factors[None, :]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=0), out=least)
    v = A.mix(least.astype(np.uint64) + A.stream(78, how.samples))
    flips = np.bincount((v % np.uint64(how.bits)).astype(np.int64), minlength=how.bits) & 1
    bands = A.mix((v.reshape(how.bands, how.rows) * (A.stream(79, how.rows) | np.uint64(1))).sum(axis=1, dtype=np.uint64) + A.stream(80, how.bands))
    return key, A.signed(bands).tolist(), np.packbits(flips.astype(np.uint8)).tobytes()


SIGNED = "id long, t long, n long, key binary, bands array<long>, sketch binary"


def signatures(docs: DataFrame, how: Near) -> DataFrame:
    """``docs``: id, text. ``t`` is the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands, sketches = [], [], [], []
            for s in shingle_sets(batch.column(1), how.shingle):
                k, b, x = signature(s, how) if len(s) else (None, None, None)
                n.append(len(s))
                keys.append(k)
                bands.append(b)
                sketches.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["id", "t", "n", "key", "bands", "sketch"])

    return docs.select("id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).mapInArrow(run, SIGNED)


def ties(classes: DataFrame) -> DataFrame:
    """(a, b): every class of a shared bucket and the bucket's least class."""
    rows = classes.select("key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("key").alias("b"), F.max("key").alias("z")).filter("b < z").select("band", "b")
    return rows.join(shared, "band").filter("key <> b").select(F.col("key").alias("a"), "b").distinct()


def _confirm(table: pa.Table, how: Near) -> list[tuple[bytes, bytes]]:
    """Edges among the members of one task: (cluster, side, key, sketch, set). Sides 0 and 1 are two blocks, to be
    compared across; side 2 is one block, to be compared within."""
    rows: dict[bytes, list[int]] = {}
    cluster, side, key = (table.column(c).to_pylist() for c in ("cluster", "side", "key"))
    sketch, sets = table.column("sketch").to_pylist(), table.column("shingles").to_pylist()
    seen: set[tuple[bytes, int, bytes]] = set()
    for i, x in enumerate(zip(cluster, side, key, strict=True)):
        if x not in seen:
            seen.add(x)
            rows.setdefault(x[0], []).append(i)
    out = []
    for members in rows.values():
        sk = np.frombuffer(b"".join(sketch[i] for i in members), np.uint64).reshape(len(members), -1)
        own = [np.frombuffer(sets[i], np.uint64) for i in members]
        n = np.array([len(s) for s in own])
        sides = np.array([side[i] for i in members])
        up = list(range(len(members)))

        def root(i: int, up=up) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i in range(len(members)):
            if sides[i] == 1:
                continue
            js = np.flatnonzero(sides == 1) if sides[i] == 0 else np.arange(i + 1, len(members))
            if not len(js):
                continue
            js = js[100 * np.minimum(n[js], n[i]) >= how.per_cent * np.maximum(n[js], n[i])]
            apart = np.bitwise_count(sk[js] ^ sk[i]).sum(axis=1)
            near = apart <= how.most_bits
            for j in js[near][np.argsort(apart[near], kind="stable")].tolist():
                if root(i) != root(j):
                    both = np.intersect1d(own[i], own[j], assume_unique=True).size
                    if 100 * both >= how.per_cent * (n[i] + n[j] - both):
                        up[root(j)] = root(i)
                        out.append((key[members[i]], key[members[j]]))
    return out


def confirmed(docs: DataFrame, classes: DataFrame, clusters: DataFrame, how: Near) -> DataFrame:
    """(a, b): confirmed edges that connect every cluster's similar classes. ``docs``: id, text."""
    members = clusters.select(F.col("v").alias("key"), F.col("c").alias("cluster")).join(classes.select("key", "rep", "n", "sketch"), "key")
    block = int(how.block_mb * 1e6)
    sizes = members.groupBy("cluster").agg(F.sum(F.col("n") * 8 + 200).alias("bytes")).select("cluster", F.ceil(F.col("bytes") / block).cast("int").alias("blocks"), "bytes")
    sizes = settle(sizes)
    total = sizes.filter("blocks = 1").agg(F.sum("bytes")).first()[0] or 0
    bins = max(1, math.ceil(total / (block / 4)))
    part = F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int")
    small = F.array(F.struct(F.lit(None).cast("binary").alias("of"), F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    large = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.col("cluster").alias("of"), F.least(F.col("part"), o).alias("i"), F.greatest(F.col("part"), o).alias("j"),
        F.when(F.col("part") < o, 0).when(F.col("part") > o, 1).otherwise(2).alias("side")))
    placed = members.join(sizes.drop("bytes"), "cluster").withColumn("part", part).select(
        "key", F.col("rep").alias("id"), "cluster", "sketch", F.when(F.col("blocks") == 1, small).otherwise(large).alias("tasks"))
    k = how.shingle

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(shingle_sets(batch.column(batch.schema.get_field_index("text")), k))
            want = batch.column(batch.schema.get_field_index("key")).to_pylist()
            same = [signature(s, how)[0] == w if len(s) else False for s, w in zip(made, want, strict=True)]
            out = batch.drop_columns(["text"]).append_column("shingles", pa.array([s.tobytes() for s in made], pa.binary()))
            yield out.filter(pa.array(same, pa.bool_()))

    rows = placed.join(docs, "id").select("key", "cluster", "sketch", "tasks", "text").mapInArrow(
        sets, "key binary, cluster binary, sketch binary, tasks array<struct<of:binary,i:int,j:int,side:int>>, shingles binary")
    rows = rows.select("key", "cluster", "sketch", "shingles", F.explode("tasks").alias("t")).select("key", "cluster", "sketch", "shingles", F.col("t.of").alias("of"), F.col("t.i").alias("i"), F.col("t.j").alias("j"), F.col("t.side").alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        found = _confirm(table, how)
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return rows.groupBy("of", "i", "j").applyInArrow(compare, "a binary, b binary")


def decisions(source: DataFrame, how: Near) -> DataFrame:
    """(id, t, n, key, group, component_id) of every row of ``source`` (id, text); key and group are null for rows
    that take no part, and group is one value per group of linked texts."""
    signed = settle(signatures(source, how))
    classes = settle(signed.filter("n > 0 and id is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    edges = confirmed(source, classes, settle(components(ties(classes))), how)
    linked = settle(components(edges))
    least = linked.join(classes.select(F.col("key").alias("v"), "rep"), "v").groupBy("c").agg(F.min("rep").alias("component_id"))
    by_class = classes.select("key", "rep").join(linked.join(least, "c").select(F.col("v").alias("key"), F.col("c").alias("group"), "component_id"), "key", "left").select(
        "key", F.coalesce("group", "key").alias("group"), F.coalesce("component_id", "rep").alias("component_id"))
    return signed.select("id", "t", "n", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(by_class, "key", "left")


def _source(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return columns_of(docs, id_col, text).select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Near = Near()) -> DataFrame:
    """id, n_shingles, component_id, kept of every row."""
    out = decisions(_source(docs, id_col, text), how)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Near = Near()) -> DataFrame:
    """``docs`` with one row of each group: that of the least id. Rows without words or id all stay.

    The rows to leave out are few: per group, all (id, class) but the first. A row is one of them if its id and
    the hash of its text are; of several rows with the first id and class, one stays.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{id_col}`").cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_t"))
    known = settle(decisions(source, how).filter("group is not null").select(F.col("id").alias("_id"), F.col("t").alias("_t"), "group"))
    first = known.groupBy("group").agg(F.min(F.struct("_id", "_t")).alias("f"))
    lost = known.join(first, "group").filter(F.struct("_id", "_t") != F.col("f")).select("_id", "_t").distinct().withColumn("_gone", F.lit(True))
    left = rows.join(lost, ["_id", "_t"], "left").filter("_gone is null")
    has_words = F.col(f"_doc.`{text}`").rlike(r"[^\x20\x09-\x0D]") & F.col("_id").isNotNull()
    nth = F.row_number().over(Window.partitionBy("_id", "_t").orderBy(F.xxhash64("_doc")))
    return left.withColumn("_nth", nth).filter((F.col("_nth") == 1) | ~F.coalesce(has_words, F.lit(False))).select("_doc.*")
