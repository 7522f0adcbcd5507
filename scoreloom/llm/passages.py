"""Substring dedup: words covered by a passage that an earlier document holds too.

Seed: of every window of ``window`` words, the least hash among its ``seed``-word runs is its anchor (winnowing), so
two documents that share a window share its anchor, and only a fifth of all runs are anchors. Anchors are
counted over documents, and only those held by two documents or more go on.

Extend: around a shared anchor, the windows that it anchors are the ways in which a match can reach out to the
left and right; each is identified by a 128-bit hash of all its words. Windows meet by that hash, and a window is
a repeat if a smaller id holds it too. Neighbouring repeats join into maximal passages, which are cut out.
Matching windows by hash instead of pairing documents finds the same passages without a row per pair, so a
passage that a third of all documents hold costs no pairs. Tasks settle among themselves what they can: of an
anchor or a window they send one row each, and tell their own documents directly, so that such a passage sends a
row per task.

Texts that equal an earlier document's text are found first, by their hash: all their windows repeat.

Defined results: a null or blank text has no words; texts shorter than the window lose nothing; a row without id
neither takes words from others nor loses any; rows that share an id take nothing from each other; an empty
table gives an empty table; other columns are ignored (``passage_digest``) or carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import arrays as A
from scoreloom.llm.columns import columns_of, whole


@dataclass(frozen=True)
class Passages:
    window: int = 13
    seed: int = 5

    def __post_init__(self):
        if not 1 <= self.seed <= self.window:
            raise ValueError("a seed must fit into the window")


def _slide(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """Least or greatest of every ``n`` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= n:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(x) - n + 1], out[n - have : len(out)][: len(x) - n + 1]) if have < n else out


@dataclass
class Slice:
    """Words, window anchors and window hashes of a run of whole texts."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # offset of each text's first word, and the total
    least: np.ndarray  # anchor hash of the window that starts at each word, where `valid`
    valid: np.ndarray
    runs: np.ndarray  # hash of the seed-word run at each word


def cut(data: np.ndarray, offs: np.ndarray, how: Passages) -> Slice:
    starts, ends, first = A.spans(data, offs)
    h = A.hash_spans(data, starts, ends)
    runs = A.windows(h, how.seed)
    span = how.window - how.seed + 1
    n = max(0, len(h) - how.window + 1)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))  # words to the end of the text
    valid = left[:n] >= how.window
    least = _slide(runs, span, np.minimum) if n else np.zeros(0, A.U)
    return Slice(data, starts, ends, first, least, valid, runs)


def anchors(texts: pa.Array, how: Passages) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice: its first row, and row number and hash of its texts' distinct anchors."""
    for a, _, data, offs in A.slices(texts):
        s = cut(data, offs, how)
        owner = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first))[: len(s.least)]
        owner, least = owner[s.valid], s.least[s.valid]
        if not len(least):
            continue
        new = np.ones(len(least), bool)  # neighbours share an anchor most of the time
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        owner, least = owner[new], least[new]
        order = np.lexsort((least, owner))
        owner, least = owner[order], least[order]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        yield a, owner[new] + a, least[new]


def keys(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Add _none, whether the id is missing; _id, then some other number; and _t, a hash of the text that tells apart
    rows which share an id. _id is never null, so that no filter on it is pushed below the shuffle of the texts,
    which all later steps then share."""
    t = F.xxhash64(whole(f"`{text}`"))
    return docs.select("*", F.coalesce(F.col(f"`{id_col}`").cast("long"), t).alias("_id"), F.col(f"`{id_col}`").isNull().alias("_none"), t.alias("_t"))


ROWS_AT_ONCE = 4_000_000


def streamed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys`` from sorted batches. A run holds a row per task that sent one."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
        same = np.ones(len(t), bool)
        for k in keys:
            v = t.column(k).to_numpy()
            same &= v == v[-1]
        cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield rest


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def spread(per_run: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(per_run, np.diff(np.append(first, n)))


def blobs(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Values of each owner as bytes; owners are row numbers."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    first = starts_of(owner) if len(owner) else np.zeros(0, np.int64)
    return owner[first], [x.tobytes() for x in np.split(values, first[1:])] if len(first) else []


def seed_rows(h: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
    """What a task says about its (anchor, id) pairs. An anchor of one id: that pair. An anchor of several ids is
    known to be shared: one row tells other tasks, and its ids get it in a row of their own, placed by id. So an
    anchor of many documents sends a row per task, not per document."""
    order = np.lexsort((i, h))
    h, i = h[order], i[order]
    both = starts_of(h, i)
    h, i = h[both], i[both]
    first = starts_of(h)
    size = np.diff(np.append(first, len(h)))
    many = spread(size > 1, first, len(h))
    lead = first[size > 1]
    who, seeds = blobs(i[many], h[many]) if many.any() else (np.zeros(0, np.int64), [])
    n, m = int((~many).sum()), len(lead)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([A.signed(h[~many]), A.signed(h[lead]), A.signed(A.mix(who.view(A.U)))])), pa.array(np.concatenate([i[~many], i[lead], who])),
         pa.array(np.arange(n + m + len(who)) >= n), pa.array([None] * (n + m) + seeds, pa.binary())], names=["k", "id", "told", "hs"])


def shared_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, hs) of the anchors that another id has too, from rows sorted by (k, id)."""
    for t in streamed(batches, ["k"]):
        blob = t.column("hs")
        known = t.filter(pc.is_valid(blob))
        t = t.filter(pc.is_null(blob))
        k, i = t.column("k").to_numpy(), t.column("id").to_numpy()
        if len(k):
            first = starts_of(k)
            differ = spread(i[first] != i[np.append(first[1:], len(k)) - 1], first, len(k)) & ~t.column("told").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(i[differ]), pa.array(k[differ]), pa.nulls(int(differ.sum()), pa.binary())], names=["id", "h", "hs"])
        if len(known):
            known = known.combine_chunks()
            yield pa.RecordBatch.from_arrays([known.column("id").chunk(0), pa.nulls(len(known), pa.int64()), known.column("hs").chunk(0)], names=["id", "h", "hs"])


WINDOWS = "x long, y long, id long, t long, p int, ps binary"


def window_rows(x: np.ndarray, y: np.ndarray, i: np.ndarray, t: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """What a task says about its windows: the holders with the least id of each, with the window's first place (p)
    and any others (ps). Holders with a greater id are known to lose it: their places go in a row of their own,
    placed by id, with p null."""
    order = np.lexsort((p, t, i, y, x))
    x, y, i, t, p = x[order], y[order], i[order], t[order], p[order]
    window = starts_of(x, y)
    lose = i != spread(i[window], window, len(x))
    rows = starts_of(x, y, i, t)
    size = np.diff(np.append(rows, len(x)))
    own = rows[~lose[rows]]
    more = [None if n == 1 else p[r + 1 : r + n].tobytes() for r, n in zip(own.tolist(), size[~lose[rows]].tolist(), strict=True)] if len(own) else []
    who, places, ids, texts = np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lose.any():
        li, lt, lp = i[lose], t[lose], p[lose]
        order = np.lexsort((lp, lt, li))
        li, lt, lp = li[order], lt[order], lp[order]
        who = starts_of(li, lt)
        ids, texts, places = li[who], lt[who], [v.tobytes() for v in np.split(lp, who[1:])]
    key = A.signed(A.mix(ids.view(A.U) ^ texts.view(A.U)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([A.signed(x[own]), key])), pa.array(np.concatenate([A.signed(y[own]), texts])), pa.array(np.concatenate([i[own], ids])), pa.array(np.concatenate([t[own], texts])),
         pa.array(np.concatenate([p[own], np.zeros(len(who), np.int32)]).astype(np.int32), mask=np.arange(len(own) + len(who)) >= len(own)), pa.array(more + places, pa.binary())],
        names=["x", "y", "id", "t", "p", "ps"])


def lost_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, p, ps) of the windows that a smaller id holds, from rows sorted by (x, y, id)."""
    for t in streamed(batches, ["x", "y"]):
        told = pc.is_null(t.column("p")).to_numpy(zero_copy_only=False)
        i = t.column("id").to_numpy()
        # A row of known losses keeps its places; it meets no window unless two 128-bit keys are equal.
        first = starts_of(t.column("x").to_numpy(), t.column("y").to_numpy())
        out = t.filter(pa.array(told | (i > spread(i[first], first, len(i))))).select(["id", "t", "p", "ps"]).combine_chunks()
        yield from out.to_batches()


def repeats(docs: DataFrame, how: Passages) -> DataFrame:
    """(_id, found array of (t, at, ats)): first words of each text's repeated windows, per text hash. ``docs``: _id,
    _t, text and _skip, for rows that take no part. The rows are used twice, partitioned by _id."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, i, n = [], [], 0
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column(2)))
            ids = batch.column(0).to_numpy()
            for _, row, got in anchors(batch.column(1), how):
                h.append(got)
                i.append(ids[row])
                n += len(got)
                if n > ROWS_AT_ONCE:
                    yield seed_rows(np.concatenate(h), np.concatenate(i))
                    h, i, n = [], [], 0
        if n:
            yield seed_rows(np.concatenate(h), np.concatenate(i))

    seed = docs.select("_id", "text", "_skip").mapInArrow(seeds, "k long, id long, told boolean, hs binary")
    wanted = seed.repartition("k").sortWithinPartitions("k", "id").mapInArrow(shared_seeds, "id long, h long, hs binary")
    wanted = wanted.groupBy(F.col("id").alias("_id")).agg(F.collect_list("h").alias("h"), F.collect_list("hs").alias("hs"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            return window_rows(*(np.concatenate(c) for c in zip(*parts, strict=True)))

        for batch in batches:
            batch = batch.filter(pc.invert(batch.column(5)))
            ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offs in A.slices(batch.column(2)):
                s = cut(data, offs, how)
                h1 = A.windows(A.hash_spans(data, s.starts, s.ends), how.window, seed=3)
                h2 = A.windows(A.hash_spans(data, s.starts, s.ends, seed=2), how.window, seed=4)
                for r in range(b - a):
                    p, q = int(s.first[r]), int(s.first[r + 1]) - how.window + 1
                    if q <= p:
                        continue
                    hs = np.sort(np.concatenate([batch.column(3)[a + r].values.to_numpy().view(A.U), *(np.frombuffer(v, A.U) for v in batch.column(4)[a + r].as_py())]))
                    spot = np.minimum(np.searchsorted(hs, s.least[p:q]), len(hs) - 1)
                    hit = np.flatnonzero(hs[spot] == s.least[p:q])
                    parts.append([h1[p:q][hit], h2[p:q][hit], np.full(len(hit), ids[a + r]), np.full(len(hit), ts[a + r]), hit.astype(np.int32)])
                    n += len(hit)
                if n > ROWS_AT_ONCE:
                    yield flush()
                    parts, n = [], 0
        if n:
            yield flush()

    around = docs.select("_id", "_t", "text", "_skip").join(wanted, "_id").select("_id", "_t", "text", "h", "hs", "_skip").mapInArrow(extend, WINDOWS)
    lost = around.repartition("x", "y").sortWithinPartitions("x", "y", "id").mapInArrow(lost_windows, "id long, t long, p int, ps binary")
    per_text = lost.groupBy("id", "t").agg(F.collect_list("p").alias("at"), F.collect_list("ps").alias("ats"))
    return per_text.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("t", "at", "ats")).alias("found"))


def places(at: list[int] | np.ndarray | None, more: list[bytes] | None) -> np.ndarray:
    return np.concatenate([np.asarray(at if at is not None else [], np.int64), *(np.frombuffer(v, np.int32) for v in more or [])]).astype(np.int64)


def keep_words(text: bytes, at: np.ndarray, whole_text: bool, window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by single spaces."""
    w = text.split()
    if whole_text and len(w) >= window:
        return len(w), len(w), b""
    if not len(at):
        return len(w), 0, b" ".join(w)
    gone = np.zeros(len(w) + 1, np.int64)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + window, -1)
    keep = np.cumsum(gone)[:-1] == 0
    return len(w), len(w) - int(keep.sum()), b" ".join([w[i] for i in np.flatnonzero(keep).tolist()])


def _marked(docs: DataFrame, id_col: str, text: str, how: Passages) -> DataFrame:
    """``docs`` with _at and _ats (repeated windows) and _copy (the whole text occurs in a smaller id)."""
    rows = keys(docs, id_col, text)
    light = rows.filter(~F.col("_none")).select("_id", "_t", F.md5(f"`{text}`").alias("m")).filter("m is not null")
    first = light.groupBy("m").agg(F.min("_id").alias("a"))
    copies = light.join(first, "m").filter("_id > a").groupBy("_id").agg(F.collect_set("_t").alias("_c"))
    same = F.coalesce(F.array_contains("_c", F.col("_t")), F.lit(False))
    flagged = rows.repartition("_id").join(copies, "_id", "left").withColumn("_copy", same & ~F.col("_none"))
    body = flagged.select("_id", "_t", F.col(f"`{text}`").alias("text"), (F.col("_none") | F.col("_copy")).alias("_skip"))
    own = F.get(F.filter("found", lambda x: (x["t"] == F.col("_t")) & ~F.col("_none")), F.lit(0))
    return flagged.join(repeats(body, how), "_id", "left").withColumn("_f", own).withColumns({"_at": F.col("_f.at"), "_ats": F.col("_f.ats")})


def passage_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Passages = Passages()) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 of every row."""
    window = how.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column(1).cast(pa.large_binary())
            for i in range(len(batch)):
                at = batch.column(2)[i]
                n, gone, kept = keep_words(texts[i].as_py() or b"", places(at.values.to_numpy() if at.is_valid else None, batch.column(3)[i].as_py()), bool(batch.column(4)[i].as_py()), window)
                out.append((n, gone, hashlib.sha256(kept).hexdigest()))
            n, gone, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    marked = _marked(columns_of(docs, id_col, text), id_col, text, how)
    return marked.select(F.when(~F.col("_none"), F.col("_id")).alias("_id"), F.col(f"`{text}`"), "_at", "_ats", "_copy").mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string")


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Passages = Passages()) -> DataFrame:
    """``docs`` with repeated passages cut out. A text that loses nothing keeps its white space."""
    window, names = how.window, docs.columns
    place, n = names.index(text), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, at, ats, copy in zip(*(batch.column(i).to_pylist() for i in range(n, n + 4)), strict=True):
                _, gone, kept = keep_words((t or "").encode(), places(at, ats), bool(copy), window)
                out.append(kept.decode() if gone else t)
            cols = list(batch.columns[:n])
            cols[place] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text}`").alias("x"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    marked = _marked(rows, "i", "x", how)
    return marked.select(*[F.col(f"doc.`{c}`").alias(f"c{k}") for k, c in enumerate(names)], "x", "_at", "_ats", "_copy").mapInArrow(run, docs.schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(len(w) - 12)) AS p, w FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, p, array_to_string(list_slice(w, p + 1, p + 13), ' ') AS s FROM g),
o AS (SELECT s, min(doc_id) AS a FROM s GROUP BY s HAVING count(DISTINCT doc_id) >= 2),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM s JOIN o USING (s) WHERE doc_id > a),
x AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
k AS (SELECT x.doc_id, string_agg(t, ' ' ORDER BY x.i) FILTER (r.i IS NULL) AS kept, count(r.i) AS n FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.i = r.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
