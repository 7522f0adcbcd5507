"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and how often ids meet in them.

A text is encoded by both tokenizers. Where tokens of both end at the same byte a group ends, so a group is the
shortest stretch that both cut out whole. Every A token of a group is linked with every B token of it, and a pair of
ids counts in how many documents it is linked.

1. Merge-path partitioning: the token ends A and B of a run of texts are two sorted lists. Binary searches along
   evenly spaced diagonals of their merge matrix find, for every piece at once, where the merge has got to; equal
   ends never fall on two sides of a border. Pieces are of equal work, whatever text they come from, and are treated
   independently: each emits the common ends it holds. An overlap that is still open at a piece's border is closed by
   the first common end of a later piece, which stitches the pieces into groups.
2. A document's linked pairs of ids, each once with its number of links. Groups of many tokens are first reduced to
   their distinct ids, so a long text without common ends costs ids times ids, not tokens times tokens.
3. Documents per pair, and the highest count of each A id, by aggregates that combine before the shuffle.
4. Counts back to documents. A pair that holds more than 1/``heavy`` of all (document, pair) rows is heavy; there can
   be at most ``heavy`` such pairs, so these are broadcast and need no shuffle. The others are joined by pair, where
   no pair then has more than that part of the rows.

Defined results: null and empty texts, and texts whose tokens of A or B do not spell a space and the text (such as
those holding the word mark of B), have no tokens: zeros, and an empty digest. Repeated rows, rows without id and rows
of one id are documents of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.arrays import slices
from scoreloom.llm.columns import columns_of
from scoreloom.sources.scratch import settle

FOLDER = "/opt/tokenizers"


@dataclass(frozen=True)
class Pairing:
    """``a``: a byte-level BPE file; ``b``: a piece model with a space mark and byte pieces. ``piece``: merged ends a
    piece holds. ``heavy``: bound on the number of broadcast pairs. ``block``: pairs written out at once. ``text``: bytes
    of whole texts encoded at once."""

    a: str = f"{FOLDER}/byte_bpe_50k.json"
    b: str = f"{FOLDER}/piece_bpe_32k.model"
    piece: int = 1 << 16
    heavy: int = 100_000
    block: int = 1 << 20
    text: int = 1_000_000


class Spelling:
    """The bytes of each id."""

    def __init__(self, spelled: list[bytes]):
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.at = np.cumsum(self.length) - self.length

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.flat[np.repeat(self.at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 as itself, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(2)
def byte_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    letters, vocab = byte_letters(), t.get_vocab()
    spelled = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        spelled[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return t, Spelling(spelled)


@lru_cache(2)
def piece_tokenizer(path: str):
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [s.id_to_piece(i) for i in range(s.get_piece_size())]
    return s, Spelling([bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])


def splits(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted lists crosses the diagonals 0, size, 2 * size ... and the end: how much of each is
    used up. On equal values ``a`` goes first; a border between two equal values moves behind them."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, size), total)
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        first = a[mid] <= b[d[open_] - 1 - mid]
        lo[open_] = np.where(first, mid + 1, lo[open_])
        hi[open_] = np.where(first, hi[open_], mid)
    i, j = lo, d - lo
    tied = np.flatnonzero((i > 0) & (j < len(b)))
    j[tied] += a[i[tied] - 1] == b[j[tied]]
    return i, j


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values that both sorted lists hold."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    hit = np.flatnonzero(b[at] == a)
    return hit, at[hit]


def groups(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """End positions in ``a`` and in ``b`` of each group, from 0 on; one more than groups, for the first start."""
    i, j = splits(a, b, size)
    ends_a, ends_b = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for p in range(len(i) - 1):
        x, y = common(a[i[p] : i[p + 1]], b[j[p] : j[p + 1]])
        ends_a.append(i[p] + x + 1)
        ends_b.append(j[p] + y + 1)
    return np.concatenate(ends_a), np.concatenate(ends_b)


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of their weights."""
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(weight[order], first)


def crossed(top: np.ndarray, wa: np.ndarray, start: np.ndarray, count: np.ndarray, b: np.ndarray, wb: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``top + b`` of each A entry with the B entries of its group, weights multiplied, some ``block`` at a time."""
    upto = np.cumsum(count)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    x = 0
    while x < len(top):
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + block, "right")))
        n = count[x:y]
        own = np.repeat(np.arange(x, y), n)
        at = start[own] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(summed(top[own] + b[at], wa[own] * wb[at]))
        x = y
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return out[0] if len(out) == 1 else summed(np.concatenate([k for k, _ in out]), np.concatenate([w for _, w in out]))


def linked(doc: np.ndarray, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, wide: tuple[int, int], block: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, links): every linked pair of every document once. ``doc``: the document of each group; the key is
    (doc * |A| + id of A) * |B| + id of B."""
    na, nb = np.diff(ends_a), np.diff(ends_b)
    ga, gb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    big = na * nb > 64

    def keys(own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (doc[own] * wide[0] + ids) * wide[1]

    few = np.flatnonzero(~big[ga])
    one = np.ones(len(a), np.int64)
    parts = [crossed(keys(ga[few], a[few]), one[few], ends_b[:-1][ga[few]], nb[ga[few]], b, np.ones(len(b), np.int64), block)]
    if big.any():
        many_a, many_b = np.flatnonzero(big[ga]), np.flatnonzero(big[gb])
        ka, wa = summed(ga[many_a] * wide[0] + a[many_a], one[many_a])
        kb, wb = summed(gb[many_b] * wide[1] + b[many_b], np.ones(len(many_b), np.int64))
        own = ka // wide[0]
        start, end = np.searchsorted(kb, own * wide[1]), np.searchsorted(kb, (own + 1) * wide[1])
        parts.append(crossed(keys(own, ka % wide[0]), wa, start, end - start, kb % wide[1], wb, block))
    return parts[0] if len(parts) == 1 else summed(np.concatenate([k for k, _ in parts]), np.concatenate([w for _, w in parts]))


class Encoded:
    """The tokens of a run of texts, those of texts without tokens left out, and their groups."""

    def __init__(self, texts: list[str], how: Pairing):
        (ta, sa), (tb, sb) = byte_tokenizer(how.a), piece_tokenizer(how.b)
        full = [i for i, t in enumerate(texts) if t]
        some = [texts[i] for i in full]
        ids_a = [np.array(e.ids, np.int64) for e in ta.encode_batch_fast([" " + t for t in some], add_special_tokens=False)] if some else []
        ids_b = [np.array(x, np.int64) for x in tb.encode(some, num_threads=1)] if some else []
        want = [b" " + t.encode() for t in some]
        ok = [sa.length[x].sum() == len(w) == sb.length[y].sum() for x, y, w in zip(ids_a, ids_b, want, strict=True)]
        while True:  # once more without the texts that are spelled differently
            keep = [i for i, good in enumerate(ok) if good]
            self.a = np.concatenate([np.zeros(0, np.int64), *(ids_a[i] for i in keep)])
            self.b = np.concatenate([np.zeros(0, np.int64), *(ids_b[i] for i in keep)])
            data = np.frombuffer(b"".join(want[i] for i in keep), np.uint8)
            upto = np.cumsum([len(want[i]) for i in keep])
            wrong = np.flatnonzero((sa.bytes_of(self.a) != data) | (sb.bytes_of(self.b) != data))
            if not len(wrong):
                break
            for i in np.unique(np.searchsorted(upto, wrong, "right")):
                ok[keep[i]] = False
        self.rows = np.array([full[i] for i in keep], np.int64)
        self.na, self.nb = (np.array([len(ids[i]) for i in keep], np.int64) for ids in (ids_a, ids_b))
        self.byte_a, self.byte_b = np.cumsum(sa.length[self.a]), np.cumsum(sb.length[self.b])
        self.ends_a, self.ends_b = groups(self.byte_a, self.byte_b, how.piece)
        self.group_at = np.searchsorted(self.ends_a, np.concatenate([[0], np.cumsum(self.na)]))  # a text's end ends a group

    def digests(self) -> list[str]:
        """sha256 of each text's groups, ``a1,a2|b1;a3|b2``."""
        na, nb = np.diff(self.ends_a), np.diff(self.ends_b)
        seq, sep = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        seq[np.arange(len(self.a)) + np.repeat(self.ends_b[:-1], na)] = self.a
        seq[np.arange(len(self.b)) + np.repeat(self.ends_a[1:], nb)] = self.b
        sep[self.ends_a[1:] + self.ends_b[:-1] - 1] = ord("|")
        sep[self.ends_a[1:] + self.ends_b[1:] - 1] = ord(";")
        figures, digits = decimals(int(seq.max(initial=0)) + 1)
        n = digits[seq]
        rows = figures[seq]
        rows[np.arange(len(seq)), n] = sep
        flat = memoryview(rows[np.arange(rows.shape[1])[None, :] <= n[:, None]])
        upto = np.concatenate([[0], np.cumsum(n + 1)])[np.concatenate([[0], np.cumsum(self.na + self.nb)])]
        return [hashlib.sha256(flat[x : y - 1]).hexdigest() for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


@lru_cache(4)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal figures of 0 .. n-1, one free place behind the longest, and their number."""
    texts = [str(i) for i in range(n)]
    wide = len(texts[-1]) + 1
    return np.frombuffer("".join(t.ljust(wide) for t in texts).encode(), np.uint8).reshape(n, wide), np.array([len(t) for t in texts], np.int64)


def runs_of(batches: Iterator[pa.RecordBatch], how: Pairing) -> Iterator[tuple[pa.RecordBatch, Encoded]]:
    """Whole texts of the last column, encoded some megabytes at a time."""
    for batch in batches:
        for x, y, _, _ in slices(batch.column(batch.num_columns - 1), how.text):
            part = batch.slice(x, y - x)
            yield part, Encoded([t or "" for t in part.column(batch.num_columns - 1).to_pylist()], how)


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def spread(rows: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[rows] = values
    return out


def encoded(docs: DataFrame, id_col: str, text: str, how: Pairing) -> DataFrame:
    """_row, id, n_a, n_b, n_groups, n_links, digest, pairs (pair, links) of every row; a pair is id of A * |B| + id of B."""
    wide = len(byte_tokenizer(how.a)[1].length), len(piece_tokenizer(how.b)[1].length)
    kind, arrow = ("int", pa.int32()) if wide[0] * wide[1] < 2**31 else ("long", pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, e in runs_of(batches, how):
            n, at = len(part), e.group_at
            doc = np.repeat(np.arange(len(e.rows)), np.diff(at))
            links = np.concatenate([[0], np.cumsum(np.diff(e.ends_a) * np.diff(e.ends_b))])[at]
            key, weight = linked(doc, e.a, e.b, e.ends_a, e.ends_b, wide, how.block)
            per = np.bincount(key // (wide[0] * wide[1]), minlength=len(e.rows)).astype(np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(key % (wide[0] * wide[1]), arrow), pa.array(weight)], names=["pair", "links"])
            digest = np.full(n, "", object)
            digest[e.rows] = e.digests()
            counts = [spread(e.rows, n, v) for v in (e.na, e.nb, np.diff(at), np.diff(links))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int64()), *map(pa.array, counts), pa.array(digest, pa.string()), lists(pairs, spread(e.rows, n, per))],
                                             names=["_row", "id", "n_a", "n_b", "n_groups", "n_links", "digest", "pairs"])

    numbered = columns_of(docs, id_col, text).select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return numbered.mapInArrow(run, f"_row long, id long, n_a long, n_b long, n_groups long, n_links long, digest string, pairs array<struct<pair:{kind},links:long>>")


def pair_counts(coded: DataFrame, how: Pairing) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id has more. One row per
    A id, at most the vocabulary, is broadcast."""
    wide = len(piece_tokenizer(how.b)[1].length)
    per = settle(coded.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    top = per.groupBy(F.expr(f"pair div {wide}").alias("_a")).agg(F.max("n").alias("_top"))
    return per.withColumn("_a", F.expr(f"pair div {wide}")).join(F.broadcast(top), "_a").select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def alignment_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Pairing = Pairing()) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    coded = settle(encoded(docs, id_col, text, how))
    counts = settle(pair_counts(coded, how))
    rows = coded.select("_row", F.inline("pairs"))
    limit = (counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]) // how.heavy
    heavy, light = counts.filter(F.col("n") > limit), counts.filter(F.col("n") <= limit)
    met = rows.join(F.broadcast(heavy), "pair").select("_row", "links", "n", "best")
    rest = rows.join(F.broadcast(heavy.select("pair")), "pair", "left_anti").join(light, "pair").select("_row", "links", "n", "best")
    sums = [F.sum(F.when(F.col("best"), F.col("links"))).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")]
    per = met.groupBy("_row").agg(*sums).union(rest.groupBy("_row").agg(*sums)).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return coded.drop("pairs").join(per, "_row", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *zero, F.col("digest").alias("groups_sha256"))


def id_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Pairing = Pairing()) -> DataFrame:
    """(a, b, n, best): the map between the vocabularies that the documents show."""
    wide = len(piece_tokenizer(how.b)[1].length)
    return pair_counts(settle(encoded(docs, id_col, text, how)), how).select(F.expr(f"int(pair div {wide})").alias("a"), F.expr(f"int(pair % {wide})").alias("b"), "n", "best")


def token_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Pairing = Pairing()) -> DataFrame:
    """id and groups (start, end, a, b) of every row: bytes of space and text, end exclusive, and the ids of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, e in runs_of(batches, how):
            text_at = np.repeat(np.concatenate([[0], np.cumsum(np.diff(np.concatenate([[0], e.byte_a[np.cumsum(e.na) - 1]])))])[: len(e.rows)], np.diff(e.group_at))
            end = e.byte_a[e.ends_a[1:] - 1]
            start = np.concatenate([[0], end])[:-1]
            each = pa.StructArray.from_arrays([pa.array(start - text_at), pa.array(end - text_at), lists(pa.array(e.a.astype(np.int32)), np.diff(e.ends_a)), lists(pa.array(e.b.astype(np.int32)), np.diff(e.ends_b))],
                                              names=["start", "end", "a", "b"])
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists(each, spread(e.rows, len(part), np.diff(e.group_at)))], names=[id_col, "groups"])

    return columns_of(docs, id_col, text).mapInArrow(run, f"`{id_col}` long, groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>")
