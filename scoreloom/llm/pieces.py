"""SentencePiece encoding and decoding with a given piece table: a relational lattice per word.

The lattice of a word has an edge for each of its substrings that is a piece: substrings of bounded length are
listed, equi-joined to the piece table, grouped by word, and folded into the best path (Viterbi). No piece spans
a point where a space follows another character, or touches a line feed, so the best path of a text is the
chain of its words' best paths; ``load`` verifies both facts for the table at hand.

``word_paths`` states this with DataFrame operations on a table of words, the fold being a higher-order
aggregate. ``with_ids`` takes its ids from there: the distinct words of parts of the texts go to the lattice, and their
paths come back to the parts. ``Lattice.encode`` (for ``encoding_digest``) does the same join and fold on the distinct
words of each Arrow batch, in columns, without a shuffle (figures in the README).

Scores: the public model is a merge-ranked vocabulary without probabilities, so a piece's log-probability is
taken from its rank by Zipf's law; bytes, used where no piece fits, lie ten below the worst piece.

Defined results: null and empty texts have no ids and decode to the empty text; any other text decodes to
itself, byte by byte, whatever characters it holds; repeated rows are encoded alike; an empty table gives an
empty table; columns other than the named ones are ignored (``encode``) or carried along (``with_ids``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm import arrays as A
from scoreloom.llm.columns import columns_of, let
from scoreloom.sources.scratch import settle

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORDS_AT_ONCE = 50_000
PART, FINER, FRAGMENT, BLOCK = 16_000_000, 8, 64, 256


@dataclass(frozen=True)
class Pieces:
    """``text``: the bytes of each id, a space standing for the word mark. ``score``: -inf for ids that take no
    part. ``byte``: the id of each byte value."""

    text: tuple[bytes, ...]
    score: np.ndarray
    byte: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score), pieces as bytes: as many rows as the model has pieces. Bytes that are no piece stand for themselves."""
        skip = set(self.byte.tolist())
        rows = {t: (i, float(s)) for i, (t, s) in enumerate(zip(self.text, self.score, strict=True)) if np.isfinite(s) and i not in skip}
        rows = {bytes([b]): (i, float(self.score[i])) for b, i in enumerate(self.byte.tolist())} | rows
        return spark.createDataFrame([(bytearray(t), i, s) for t, (i, s) in rows.items()], "piece binary, id int, score double")


def load(path: str = MODEL) -> Pieces:
    """Read a model file. Its size bounds everything that is sent to the tasks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    raw = np.array([sp.get_score(i) for i in range(n)])
    use = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
    rank = np.zeros(n)
    rank[use] = np.argsort(np.argsort(-raw[use], kind="stable"), kind="stable")
    score = np.where(use, -np.log(rank + 1) - math.log(math.log(max(use.sum(), 2)) + 0.5772), -np.inf)
    text, byte = [], np.full(256, -1)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        else:
            text.append(piece.replace("▁", " ").encode() if use[i] else b"")
    if (byte < 0).any():
        raise ValueError("the model has no piece for every byte")
    for t in (x for x, u in zip(text, use, strict=True) if u):
        if b"\n" in t or b" " in t.lstrip(b" "):
            raise ValueError(f"piece {t!r} spans words")
    score[byte] = score[use].min() - 10
    return Pieces(tuple(text), score, byte)


class Lattice:
    """The piece table as a hash table over byte strings, and the fold over words."""

    def __init__(self, pieces: Pieces):
        self.byte, self.byte_score = pieces.byte.astype(np.int32), float(pieces.score[pieces.byte[0]])
        skip = set(pieces.byte.tolist())
        own = [(t, i) for i, (t, s) in enumerate(zip(pieces.text, pieces.score, strict=True)) if np.isfinite(s) and i not in skip]
        self.lengths = sorted({len(t) for t, _ in own})
        data = np.frombuffer(b"".join(t for t, _ in own), np.uint8)
        ends = np.cumsum([len(t) for t, _ in own])
        h = A.hash_spans(data, ends - [len(t) for t, _ in own], ends)
        self.bits = max(10, math.ceil(math.log2(len(own))) + 3)
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.id = np.full(1 << self.bits, -1, np.int32)
        self.score = pieces.score
        self.probes = 1
        for x, (_, i) in zip(h, own, strict=True):
            p, tries = int(x) & (len(self.id) - 1), 1
            while self.id[p] >= 0:
                p, tries = (p + 1) & (len(self.id) - 1), tries + 1
            self.key[p], self.id[p] = x, i
            self.probes = max(self.probes, tries)
        self.n_bytes = np.array([len(t) for t in pieces.text])
        self.flat = np.frombuffer(b"".join(pieces.text), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.n_bytes)])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of each hash, -1 where it is no piece."""
        out = np.full(len(h), -1, np.int32)
        slot = (h & np.uint64(len(self.id) - 1)).astype(np.int64)
        todo = np.arange(len(h))
        for _ in range(self.probes):
            got = self.id[slot]
            hit = (self.key[slot] == h[todo]) & (got >= 0)
            out[todo[hit]] = got[hit]
            on = ~hit & (got >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.id) - 1)
            if not len(todo):
                break
        return out

    def paths(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best paths of words (bytes and offsets), one after the other, and how many each has."""
        n = len(data)
        size = np.diff(offs)
        word_end = np.repeat(offs[1:], size)
        place = np.arange(n)
        edge: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in self.lengths:
            start = place[place + k <= word_end]
            if len(start):
                ids = self.find(A.hash_spans(data, start, start + k))
                hit = ids >= 0
                if hit.any():
                    full = np.full(n, -1, np.int32)
                    full[start[hit]] = ids[hit]
                    edge[k] = full, np.where(full >= 0, self.score[full], -np.inf)
        back, used = np.ones(n + 1, np.int64), np.full(n + 1, -1, np.int32)
        order = np.argsort(-size, kind="stable")
        begin, longest = offs[:-1][order], size[order]
        value = np.zeros(n)  # best score of the path that ends before byte i of its word; 0 at its start
        final_back, final_used = np.ones(len(size), np.int64), np.full(len(size), -1, np.int32)
        for t in range(1, int(longest[0]) + 1 if len(longest) else 0):
            live = int(np.searchsorted(-longest, -t, "right"))
            p = begin[:live] + t
            top = value[p - 1] + self.byte_score
            via, by = np.ones(live, np.int64), self.byte[data[p - 1]]
            for k, (ids, score) in edge.items():
                if k > t:
                    break
                now = value[p - k] + score[p - k]
                better = now > top
                if better.any():
                    top = np.where(better, now, top)
                    via = np.where(better, k, via)
                    by = np.where(better, ids[p - k], by)
            ends = longest[:live] == t
            final_back[order[:live][ends]], final_used[order[:live][ends]] = via[ends], by[ends]
            inner = ~ends
            value[p[inner]], back[p[inner]], used[p[inner]] = top[inner], via[inner], by[inner]
        steps = []
        alive = np.flatnonzero(size > 0)
        at, via, by = offs[1:][alive], final_back[alive], final_used[alive]
        count = np.zeros(len(size), np.int64)
        while len(alive):
            steps.append((alive, by))
            count[alive] += 1
            at = at - via
            go = at > offs[:-1][alive]
            alive, at = alive[go], at[go]
            via, by = back[at], used[at]
        total = np.cumsum(count)
        out = np.zeros(int(total[-1]) if len(total) else 0, np.int32)
        for depth, (who, ids) in enumerate(steps):
            out[total[who] - 1 - depth] = ids
        return out, count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        n = self.n_bytes[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.at[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids of each text, and whether they decode to it."""
        for a, b, data, offs in A.slices(texts):
            filled = np.flatnonzero(np.diff(offs) > 0)
            data = np.insert(data, offs[:-1][filled], 32)  # the word mark before a text
            offs = offs + np.concatenate([[0], np.cumsum(np.diff(offs) > 0)])
            start = np.zeros(len(data) + 1, bool)
            start[offs] = True
            space, line = data == 32, data == 10
            start[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
            begin = np.flatnonzero(start[:-1])
            end = np.append(begin[1:], len(data))
            h = A.hash_spans(data, begin, end)
            _, first, where = np.unique(h, return_index=True, return_inverse=True)
            ids, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for p in range(0, len(first), WORDS_AT_ONCE):
                s, e = begin[first[p : p + WORDS_AT_ONCE]], end[first[p : p + WORDS_AT_ONCE]]
                o = np.concatenate([[0], np.cumsum(e - s)])
                i, c = self.paths(data[np.repeat(s - o[:-1], e - s) + np.arange(o[-1])], o)
                ids.append(i)
                count.append(c)
            ids, count = np.concatenate(ids), np.concatenate(count)
            at = np.cumsum(count) - count
            n = count[where]
            ends = np.cumsum(n)
            flat = ids[np.repeat(at[where] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
            stop = np.concatenate([[0], ends])[np.searchsorted(begin, offs, "left")]
            for r in range(b - a):
                own = flat[stop[r] : stop[r + 1]]
                yield own, bool(np.array_equal(self.decode(own), data[offs[r] : offs[r + 1]]))


def tiles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with the word mark before each that is not empty (bytes, offsets), and starts and ends of their words."""
    filled = np.diff(offs) > 0
    data = np.insert(data, offs[:-1][filled], 32)
    offs = offs + np.concatenate([[0], np.cumsum(filled)])
    start = np.zeros(len(data) + 1, bool)
    start[offs] = True
    space, line = data == 32, data == 10
    start[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    begin = np.flatnonzero(start[:-1])
    return data, offs, begin, np.append(begin[1:], len(data))[: len(begin)]


def coded(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the distinct ones, and these. Words lie one after the other."""
    ends = np.append(begin, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.cast(pa.binary())


def in_parts(rows: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``rows`` with _part, about PART bytes of text each and dealt by content, and the number of parts."""
    size = rows.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = max(1, math.ceil(size / PART), min(2 * cores, math.ceil(size / 1_000_000)))
    plain = [f.name for f in rows.schema if isinstance(f.dataType, T.AtomicType)]
    return rows.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(n)).cast("int")), n


def part_words(parts: DataFrame, text: str) -> DataFrame:
    """(_part, word): the distinct words of each part."""

    def run(rows: pa.Table) -> pa.Table:
        own = [coded(data, begin)[1] for _, _, d, o in A.slices(rows.column(1)) for data, _, begin, _ in [tiles(d, o)]]
        words = pc.unique(pa.chunked_array(own, pa.binary()))
        return pa.table({"_part": pa.repeat(rows.column(0)[0], len(words)), "word": words})

    return parts.select("_part", text).groupBy("_part").applyInArrow(run, "_part int, word binary")


def encoded(rows: DataFrame, model: Pieces, made: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]], schema: str | T.StructType) -> DataFrame:
    """Columns c0, c1, ... of ``rows`` and, from the ids of their texts t, what ``made`` makes of them.

    The words of each part of the texts are found, the paths of all distinct words come from the lattice, and go back
    to the parts that hold the word; there a text's ids are read off its words. ``made`` gets ids, offsets of the texts
    in them, and the texts' bytes with offsets.
    """
    spark = rows.sparkSession
    parts, n = in_parts(rows, "t")
    words = settle(part_words(parts, "t"))
    paths = word_paths(words, model.table(spark), max(map(len, model.text)), n_parts=FINER * n).select("word", "ids")
    lists = words.join(paths, "word", "left").select("_part", "word", "ids")
    n_keep = len(rows.columns) - 1

    def run(texts: pa.Table, lists: pa.Table) -> pa.Table:
        known = lists.column("word").combine_chunks()
        ids = lists.column("ids").combine_chunks()
        flat, size = ids.flatten().to_numpy(), pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        at = np.cumsum(size) - size
        out = []
        for _, _, d, o in A.slices(texts.column("t")):
            data, offs, begin, _ = tiles(d, o)
            code, some = coded(data, begin)
            row = pc.index_in(some, value_set=known).to_numpy(zero_copy_only=False)[code]
            count = size[row]
            ends = np.cumsum(count)
            own = flat[np.repeat(at[row] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]
            stop = np.concatenate([[0], ends])[np.searchsorted(begin, offs, "left")].astype(np.int64)
            out.append(made(own, stop, data, offs))
        more = [pa.chunked_array(c) for c in zip(*out, strict=True)]
        return pa.Table.from_arrays([*(texts.column(i) for i in range(n_keep)), *more], names=[*texts.column_names[:n_keep], *(f"m{i}" for i in range(len(more)))])

    return parts.groupBy("_part").cogroup(lists.groupBy("_part")).applyInArrow(run, schema)


def with_ids(docs: DataFrame, text: str = "text", pieces: Pieces | None = None) -> DataFrame:
    """``docs`` with column ids (array<int>) in place of the text."""
    keep = [c for c in docs.columns if c not in (text, "ids")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    schema = T.StructType([*rows.drop("t").schema.fields, T.StructField("m0", T.ArrayType(T.IntegerType()))])

    def made(ids: np.ndarray, stop: np.ndarray, data: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(ids, pa.int32()))]

    return encoded(rows, pieces or load(), made, schema).toDF(*keep, "ids")


def decode(encoded: DataFrame, ids: str = "ids", text: str = "text", pieces: Pieces | None = None) -> DataFrame:
    """``encoded`` with the text of its ids in their place."""
    sent = encoded.sparkSession.sparkContext.broadcast(pieces or load())
    keep = [c for c in encoded.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for batch in batches:
            out = [lattice.decode(np.array(x or [], np.int64)).tobytes()[1:].decode() for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], names=[*keep, text])

    rows = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`"))
    return rows.mapInArrow(run, rows.drop(ids).schema.add(text, "string"))


def encoding_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", pieces: Pieces | None = None) -> DataFrame:
    """id, n_ids, n_byte_ids, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        is_byte = np.zeros(len(lattice.n_bytes), bool)
        is_byte[lattice.byte] = True
        for batch in batches:
            rows = [(len(ids), int(is_byte[ids].sum()), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), same) for ids, same in lattice.encode(batch.column(1))]
            n, nb, sha, same = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(nb, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                                             names=[id_col, "n_ids", "n_byte_ids", "ids_sha256", "round_trip"])

    return columns_of(docs, id_col, text).mapInArrow(run, f"`{id_col}` long, n_ids long, n_byte_ids long, ids_sha256 string, round_trip boolean")


def word_paths(words: DataFrame, pieces: DataFrame, longest: int, word: str = "word", n_parts: int | None = None) -> DataFrame:
    """(word, score, ids) of each distinct word: the lattice as a join.

    Substrings of at most ``longest`` bytes are exploded and equi-joined to ``pieces`` (piece, id, score), which holds
    every single byte; a word's edges are grouped and, in order of their ends, folded: a cell for every position holds
    the best score up to it and the edge that gives it, the shorter one among equals. A second fold follows these edges
    back. A word is written with a space for the word mark. Long words are cut into overlapping fragments and named by
    a digest, so that no row of a substring carries the word; both folds go block by block, as each step of a
    higher-order aggregate copies its whole state.
    """
    kind = words.schema[word].dataType
    each = words.select(F.col(f"`{word}`").cast("binary").alias("w")).filter("length(w) > 0").distinct()
    key = F.when(F.length("w") <= FRAGMENT, F.col("w")).otherwise(F.concat(F.lit(b"\xff"), F.unhex(F.sha2("w", 256))))
    named = each.select("w", key.alias("key"))
    dealt = named.repartition(n_parts, "key") if n_parts else named.repartition("key")
    base = dealt.select("key", "w", F.explode(F.sequence(F.lit(0), F.length("w") - 1, F.lit(FRAGMENT))).alias("b"))
    frag = base.select("key", "b", F.when(F.col("b") == 0, F.col("w")).alias("w"), F.substring("w", F.col("b") + 1, F.lit(FRAGMENT + longest - 1)).alias("f"))
    start = frag.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(FRAGMENT), F.length("f")))).alias("s"))
    sub = start.select("key", "b", F.when(F.col("s") == 1, F.col("w")).alias("w"), "s", "f", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("f") - F.col("s") + 1))).alias("k"))
    sub = sub.select("key", F.when(F.col("k") == 1, F.col("w")).alias("w"), (F.col("b") + F.col("s") - 1 + F.col("k")).alias("e"), "k", F.substring("f", F.col("s"), F.col("k")).alias("piece"))
    table = F.broadcast(pieces.select(F.col("piece").cast("binary").alias("piece"), "id", "score"))
    edges = sub.join(table, "piece").groupBy("key").agg(F.max("w").alias("w"), F.sort_array(F.collect_list(F.struct("e", "k", "id", "score"))).alias("g"))

    cell = "struct<v:double,k:int,id:int>"
    width = longest + 1

    def step(held):
        def run(a, x):
            v, n = F.get(a, x["e"] - x["k"] - held)["v"] + x["score"], F.size(a)
            new = F.array(F.struct(v.alias("v"), x["k"].alias("k"), x["id"].alias("id")))
            return F.when(x["e"] == held + n, F.concat(a, new)).when(v > F.get(a, n - 1)["v"], F.concat(F.slice(a, F.lit(1), n - 1), new)).otherwise(a)

        return run

    def block(a, edges):
        def moved(c):
            gone = F.greatest(F.size(c) - width, F.lit(0))
            return F.struct((a["held"] + gone).alias("held"), F.concat(a["full"], F.array(F.slice(c, F.lit(1), gone))).alias("full"), F.slice(c, gone + 1, F.lit(width)).alias("last"))

        return let(F.aggregate(edges, a["last"], step(a["held"])), moved)

    zero = F.struct(F.lit(0).alias("held"), F.array().cast(f"array<array<{cell}>>").alias("full"), F.array(F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("k"), F.lit(-1).alias("id"))).alias("last"))
    in_blocks = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - 1, F.lit(BLOCK)), lambda i: F.slice(g, i + 1, F.lit(BLOCK)))
    cells = F.aggregate(let(F.col("g"), in_blocks), zero, block, lambda a: F.flatten(F.concat(a["full"], F.array(a["last"]))))

    def back(c):
        def follow(a, i):
            return F.when(a["p"] == i, F.struct((i - F.get(c, i)["k"]).alias("p"), F.concat(a["ids"], F.array(F.get(c, i)["id"])).alias("ids"))).otherwise(a)

        def part(a, i):
            own = F.aggregate(F.sequence(i, F.greatest(i - (BLOCK - 1), F.lit(1)), F.lit(-1)), F.struct(a["p"].alias("p"), F.array().cast("array<int>").alias("ids")), follow)
            return let(own, lambda b: F.struct(b["p"].alias("p"), F.concat(a["ids"], F.array(b["ids"])).alias("ids")))

        end = F.size(c) - 1
        ids = F.aggregate(F.sequence(end, F.lit(1), F.lit(-BLOCK)), F.struct(end.alias("p"), F.array().cast("array<array<int>>").alias("ids")), part, lambda a: F.reverse(F.flatten(a["ids"])))
        return F.struct(F.get(c, end)["v"].alias("v"), ids.alias("ids"))

    return edges.select("w", let(cells, back).alias("b")).select(F.col("w").cast(kind).alias(word), F.col("b.v").alias("score"), F.col("b.ids").alias("ids"))
