"""Bootstrap replicates of entities as vectors of weights.

An entity is drawn Poisson(1) times in a replicate (the limit of drawing n of n with replacement, and the form that
needs no total). Its weights in all replicates are one vector, derived from two numbers that belong to the entity and
one per replicate, wherever the entity's row happens to be: any two tables, models or tasks see the same draws, and a
task that runs again does too. In the nested form a block is drawn K ~ Poisson(1) times, and its entities Poisson(K)
times each.

Vectors are added up inside the tasks. What leaves a task is one vector per cell (confusion counts) or per chunk of
rows in score order (precision-recall), never a row per entity and replicate.

The uniform number of entity (a, c) in replicate r is the fifth power of ``a + c * r`` modulo the prime 2**31 - 1, a
permutation of the residues. Products stay below 2**62, so any engine with 64-bit integers gives the same numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.scalars import is_finite
from scoreloom.sources.scratch import settle

PRIME = (1 << 31) - 1
ROWS = 32  # rows whose vectors are made at once: these arrays stay in a processor's cache
SPLIT = 100  # replicates that one task accumulates along a model's chunks


def key_numbers(seed: int, *parts: Column | str) -> tuple[Column, Column]:
    """The two residues of a key."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))
    half = lambda i: F.conv(F.substring(text, i, 8), 16, 10).cast("bigint") % PRIME
    return half(1), half(9)


def replicate_numbers(seed: int, replicates: int) -> np.ndarray:
    return np.array([int(hashlib.md5(f"{seed}|b|{b}".encode()).hexdigest()[:8], 16) % PRIME for b in range(replicates)], np.int64)


def poisson_steps(mean: float) -> list[int]:
    """The residues from which on the Poisson variable is at least 1, 2, ...: inversion of its distribution."""
    out, k, p = [], 0, math.exp(-mean)
    total = p
    while (step := math.ceil(total * PRIME)) < PRIME:
        out.append(step)
        k += 1
        p *= mean / k
        total += p
    return out


MOST = len(poisson_steps(1.0))
STEPS = [poisson_steps(float(k)) if k else [] for k in range(MOST + 1)]
_FROM = np.concatenate([[0], np.cumsum([len(s) for s in STEPS])])
_ALL = np.array([k * PRIME + t for k, s in enumerate(STEPS) for t in s], np.int64)
_BITS, _OPEN = 12, 255  # residues are looked up by their highest bits; where a step lies inside, _OPEN
_LOOKUP = np.zeros(((MOST + 1) << _BITS), np.uint8)
for _k, _s in enumerate(STEPS):
    _edges = np.arange((1 << _BITS) + 1, dtype=np.int64) << (31 - _BITS)
    _low, _high = (np.searchsorted(_s, x, side="right") for x in (_edges[:-1], _edges[1:] - 1))
    _LOOKUP[_k << _BITS : (_k + 1) << _BITS] = np.where(_low == _high, _low, _OPEN)


@lru_cache(maxsize=8)
def _powers(numbers: bytes) -> np.ndarray:
    """Powers 0 to 5 of the replicate numbers, as exact doubles."""
    r = np.frombuffer(numbers, np.int64)
    out = [np.ones(len(r), np.int64)]
    for _ in range(5):
        out.append(out[-1] * r % PRIME)
    return np.array(out, np.float64)


def uniforms(a: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Entities x replicates residues.

    The fifth power of a + c r is a sum of six products, of numbers of the entity and powers of r: two matrix products, of
    the numbers' upper and lower halves. All sums stay below 2**53, where doubles are exact.
    """
    pa_, pc_ = [np.ones(len(a), np.int64)], [np.ones(len(a), np.int64)]
    for _ in range(5):
        pa_.append(pa_[-1] * a % PRIME)
        pc_.append(pc_[-1] * c % PRIME)
    own = np.array([math.comb(5, j) * pa_[5 - j] % PRIME * pc_[j] % PRIME for j in range(6)]).T
    powers = _powers(np.ascontiguousarray(r, np.int64).tobytes())
    x = (own >> 16).astype(np.float64) @ powers
    t = np.multiply(x, 1.0 / PRIME)
    np.floor(t, out=t)
    t *= PRIME
    x -= t
    x *= 65536.0
    x += (own & 65535).astype(np.float64) @ powers
    np.multiply(x, 1.0 / PRIME, out=t)
    np.floor(t, out=t)
    t *= PRIME
    x -= t
    u = x.astype(np.int32)
    if u.size and u.max() == PRIME:  # stands for 0
        u[u == PRIME] = 0
    return u


def plain_weights(u: np.ndarray) -> np.ndarray:
    w = (u >= np.int32(STEPS[1][0])).view(np.uint8)
    for t in STEPS[1][1:3]:
        w += u >= np.int32(t)
    rare = np.flatnonzero(u >= np.int32(STEPS[1][3]))
    w.reshape(-1)[rare] = np.searchsorted(STEPS[1], u.reshape(-1)[rare], side="right")
    return w


def nested_weights(u: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Weights under block weights ``blocks`` of the same shape."""
    place = blocks.astype(np.int32)
    place <<= _BITS
    place |= u >> np.int32(31 - _BITS)
    w = _LOOKUP[place]
    rare = np.flatnonzero(w == _OPEN)
    k = blocks.reshape(-1)[rare]
    w.reshape(-1)[rare] = np.searchsorted(_ALL, k * np.int64(PRIME) + u.reshape(-1)[rare], side="right") - _FROM[k]
    return w


MODES = ("naive", "nested")
KNOWN = 4096  # blocks whose weights a task keeps


def weights(mode: str, u: np.ndarray, ka: np.ndarray, kc: np.ndarray, r: np.ndarray, known: dict[tuple[int, int], np.ndarray] | None = None) -> np.ndarray:
    """``known`` keeps weights of blocks from call to call."""
    if mode == "naive":
        return plain_weights(u)
    known = {} if known is None else known
    keys = list(zip(ka.tolist(), kc.tolist(), strict=True))
    new = [k for k in dict.fromkeys(keys) if k not in known]
    if new:
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = list(dict.fromkeys(keys))
        n = np.array(new, np.int64)
        known.update(zip(new, plain_weights(uniforms(n[:, 0], n[:, 1], r)), strict=True))
    return nested_weights(u, np.stack([known[k] for k in keys]))


def _numbers(df: DataFrame, seed: int, entity: str, block: str | None) -> list[Column]:
    a, c = key_numbers(seed, entity)
    ka, kc = key_numbers(seed, F.lit("block"), block) if block else (F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return [a.alias("_a"), c.alias("_c"), ka.alias("_ka"), kc.alias("_kc")]


def cell_replicates(entities: DataFrame, cells: Sequence[str], entity: str, replicates: int, seed: int, *, mode: str = "naive", block: str | None = None) -> DataFrame:
    """(cells, b, w): summed weights of the entities of each cell. One row per entity comes in; a statistic can depend on
    an entity through its cell only, so cells are few (label and the calls of all models)."""
    return cell_replicates_by_mode(entities, cells, entity, replicates, seed, modes=(mode,), block=block).drop("mode")


def cell_replicates_by_mode(entities: DataFrame, cells: Sequence[str], entity: str, replicates: int, seed: int, *, modes: Sequence[str] = MODES, block: str | None = None) -> DataFrame:
    """(mode, cells, b, w): several forms of the draw from the same uniform numbers, in one pass."""
    modes = tuple(modes)
    r = replicate_numbers(seed, replicates)
    text = F.to_json(F.struct(*cells))
    rows = entities.select(text.alias("_cell"), *_numbers(entities, seed, entity, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            own = names.indices.to_numpy()
            order = np.argsort(own, kind="stable")
            own = own[order]
            a, c, ka, kc = (batch.column(i).to_numpy()[order] for i in range(1, 5))
            total = {m: np.zeros((len(names.dictionary), replicates), np.int64) for m in modes}
            for x in range(0, len(batch), ROWS):
                part = slice(x, x + ROWS)
                first = np.flatnonzero(np.concatenate([[True], np.diff(own[part]) > 0]))
                u = uniforms(a[part], c[part], r)
                for m in modes:
                    w = weights(m, u, ka[part], kc[part], r, known)
                    total[m][own[part][first]] += np.add.reduceat(w, first, axis=0, dtype=np.int64)
            for m in modes:
                for name, w in zip(names.dictionary.to_pylist(), total[m], strict=True):
                    sums[m, name] = sums[m, name] + w if (m, name) in sums else w
        for (m, name), w in sums.items():
            some = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(some), pa.string()), pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(w[some])], names=["mode", "_cell", "b", "w"])

    types = dict(entities.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in cells)
    summed = rows.mapInArrow(run, "mode string, _cell string, b int, w long").groupBy("mode", "_cell", "b").agg(F.sum("w").alias("w"))
    return summed.select("mode", F.from_json("_cell", schema).alias("_s"), "b", "w").select("mode", "_s.*", "b", "w")


BUCKETS = 1024


def subsampled_cells(entities: DataFrame, cells: Sequence[str], entity: str, ratios: Sequence[int], repeats: int, seed: int, *, label: str = "label") -> DataFrame:
    """(cells, ratio, rep, w): all positives, and ratio x positives of the negatives drawn without replacement.

    The negatives of least uniform number are the sample (ties by key). A repeat's numbers are counted in ``BUCKETS``
    buckets, which tells the bucket of the last one drawn. Negatives in earlier buckets are counted per cell inside the
    task; only those of that bucket, a thousandth of them, are ranked. One row per entity comes in. The driver sees the
    bucket counts' cuts: repeats x ratios rows.
    """
    ratios = sorted(ratios)
    r = replicate_numbers(seed, repeats)
    shift = 31 - int(math.log2(BUCKETS))
    text = F.to_json(F.struct(*cells))
    rows = entities.select(text.alias("_cell"), label, *_numbers(entities, seed, entity, None)[:2])
    negatives = rows.filter(F.col(label) == 0).drop(label)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(repeats * BUCKETS, np.int64)
        for batch in batches:
            for x in range(0, len(batch), ROWS):
                a, c = (batch.column(i).to_numpy()[x : x + ROWS] for i in (1, 2))
                total += np.bincount(((uniforms(a, c, r) >> shift) + np.arange(repeats) * BUCKETS).ravel(), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((some // BUCKETS).astype(np.int32)), pa.array((some % BUCKETS).astype(np.int32)), pa.array(total[some])], names=["rep", "bucket", "n"])

    held = negatives.mapInArrow(count, "rep int, bucket int, n long").groupBy("rep", "bucket").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("rep").orderBy("bucket"))
    n_pos = rows.agg(F.count_if(F.col(label) == 1)).scalar()
    wanted = held.withColumn("_upto", upto).withColumn("_pos", n_pos).select("rep", "bucket", "n", "_upto", F.inline(F.array(*[F.struct(F.lit(i).alias("j"), (F.lit(x) * F.col("_pos")).alias("k")) for i, x in enumerate(ratios)])))
    last = wanted.filter((F.col("_upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("_upto"))).select("rep", "j", "bucket", (F.col("k") - F.col("_upto") + F.col("n")).alias("need"))
    cuts = settle(last)
    cut = np.full((len(ratios), repeats), BUCKETS)  # without a cut, all negatives are drawn
    for x in cuts.toLocalIterator():
        cut[x["j"], x["rep"]] = x["bucket"]
    if not entities.agg(F.count_if(F.col(label) == 1)).first()[0]:
        cut[:] = -1

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        shape = ["_cell", "j", "rep", "w", "u", "a", "c"]
        for batch in batches:
            for x in range(0, len(batch), ROWS):
                part = batch.slice(x, ROWS)
                names = part.column(0).to_pylist()
                a, c = (part.column(i).to_numpy() for i in (1, 2))
                u = uniforms(a, c, r)
                bucket = u >> shift
                own: dict[str, list[int]] = {}
                for i, name in enumerate(names):
                    own.setdefault(name, []).append(i)
                for name, at in own.items():
                    got = np.stack([(bucket[at] < cut[j]).sum(axis=0) for j in range(len(ratios))])
                    sums[name] = sums[name] + got if name in sums else got
                j, i, b = np.nonzero(bucket[None, :, :] == cut[:, None, :])
                if len(i):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), pa.array(j.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(np.ones(len(i), np.int64)), pa.array(u[i, b].astype(np.int64)), pa.array(a[i]), pa.array(c[i])], names=shape)
        for name, got in sums.items():
            j, b = np.nonzero(got)
            none = pa.nulls(len(j), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(j), pa.string()), pa.array(j.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(got[j, b]), none, none, none], names=shape)

    drawn = settle(negatives.mapInArrow(draw, "_cell string, j int, rep int, w long, u long, a long, c long"))
    rank = F.row_number().over(Window.partitionBy("rep", "j").orderBy("u", "a", "c"))
    edge = drawn.filter("u is not null").withColumn("_r", rank).join(cuts.select("rep", "j", "need"), ["rep", "j"]).filter("_r <= need").select("_cell", "j", "rep", "w")
    each = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")
    positives = rows.filter(F.col(label) == 1).groupBy("_cell").agg(F.count(F.lit(1)).alias("w")).select("_cell", F.explode(F.array(*[F.lit(j) for j in range(len(ratios))])).alias("j"), "w").select("_cell", "j", each, "w")
    both = drawn.filter("u is null").select("_cell", "j", "rep", "w").union(edge).groupBy("_cell", "j", "rep").agg(F.sum("w").alias("w")).unionByName(positives)
    types = dict(entities.dtypes)
    out = both.select(F.from_json("_cell", ", ".join(f"{c} {types[c]}" for c in cells)).alias("_s"), F.get(F.array(*[F.lit(x) for x in ratios]), F.col("j")).alias("ratio"), "rep", "w")
    return out.select("_s.*", "ratio", "rep", "w")


_LONGS = pa.int64()
_CHUNK = "chunk long, {k}, score array<double>, pos array<boolean>, a array<long>, c array<long>, ka array<long>, kc array<long>"


def chunked(scored: DataFrame, key: str, entity: str, seed: int, block: str | None, size: int) -> DataFrame:
    """Rows of each key from the highest score down, packed into chunks of at most ``size`` whose numbers follow the order.
    Ties are dealt by the entity's number, so a score that holds many rows spreads over chunks."""
    rows = scored.select(F.col(key).alias("k"), "score", (F.col("label") == 1).alias("pos"), *_numbers(scored, seed, entity, block))
    order = [F.col("k"), F.col("score").desc(), F.col("_a")]
    dealt = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id().cast("bigint")).sortWithinPartitions(*order)
    names = ["chunk", key, "score", "pos", "a", "c", "ka", "kc"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def chunk(number: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            own = (int(t.column("_p")[0].as_py()) << 32) + number
            lists = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).chunk(0)) for c in ("score", "pos", "_a", "_c", "_ka", "_kc")]
            return pa.RecordBatch.from_arrays([pa.array([own], _LONGS), t.column("k").chunk(0).slice(0, 1), *lists], names=names)

        for batch in batches:
            k = batch.column(0).dictionary_encode().indices.to_numpy()
            for x, y in zip((cut := [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)])[:-1], cut[1:], strict=True):
                for z in range(x, y, size):
                    part = batch.slice(z, min(size, y - z))
                    if held and (held[0].column(0)[0] != part.column(0)[0] or sum(map(len, held)) + len(part) > size):
                        yield chunk(n, held)
                        held, n = [], n + 1
                    if len(part):
                        held.append(part)
        if held:
            yield chunk(n, held)

    kind = f"{key} {dict(scored.dtypes)[key]}"
    return settle(dealt.mapInArrow(pack, _CHUNK.format(k=kind)))


class Chunk:
    """One chunk as arrays, and the ends of its equal scores."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        col = lambda name: batch.column(batch.schema.get_field_index(name))[i].values.to_numpy(zero_copy_only=False)
        self.number = batch.column(0)[i].as_py()
        self.score, self.pos = col("score"), col("pos").astype(bool)
        self.a, self.c, self.ka, self.kc = (col(x) for x in ("a", "c", "ka", "kc"))
        turns = np.flatnonzero(np.diff(self.score)) + 1
        self.first = int(turns[0]) if len(turns) else len(self.score)  # end of the first score
        self.last = int(turns[-1]) if len(turns) else len(self.score)  # start of the last score, if another one

    def drawn(self, x: int, y: int, modes: Sequence[str], r: np.ndarray, known: dict[tuple[int, int], np.ndarray]) -> dict[str, np.ndarray]:
        u = uniforms(self.a[x:y], self.c[x:y], r)
        return {m: weights(m, u, self.ka[x:y], self.kc[x:y], r, known) for m in modes}

    def total(self, x: int, y: int, modes: Sequence[str], r: np.ndarray, known: dict[tuple[int, int], np.ndarray]) -> dict[str, np.ndarray]:
        """Positive and negative weights of rows x to y, as two rows."""
        out = {m: np.zeros((2, len(r)), np.int64) for m in modes}
        for z in range(x, y, ROWS):
            end = min(y, z + ROWS)
            sides = np.array([self.pos[z:end], ~self.pos[z:end]], np.float32)
            for m, w in self.drawn(z, end, modes, r, known).items():
                out[m] += (sides @ w.astype(np.float32)).astype(np.int64)
        return out


class Descent:
    """Counts above the current row of a chunk in every replicate, and the contributions of complete scores so far."""

    def __init__(self, pos: np.ndarray, neg: np.ndarray):
        self.pos, self.all = pos, pos + neg  # above, complete scores only
        self.open_pos, self.open_all = np.zeros_like(pos), np.zeros_like(pos)  # of the score that is not complete
        self.area, self.drawn = np.zeros_like(pos), np.zeros_like(pos)

    def take(self, w: np.ndarray, positive: np.ndarray, ends: np.ndarray) -> None:
        """The next rows' weights; ``ends`` are the rows that complete a score."""
        w = w.astype(np.float64)
        if not len(ends):
            self.open_pos, self.open_all = self.open_pos + w[positive].sum(axis=0), self.open_all + w.sum(axis=0)
            return
        n, rest = len(ends), ends[-1] + 1 < len(w)
        if n == len(w):
            some, gp = np.flatnonzero(positive), w[positive]
            if len(some) and some[0] == 0:
                gp[0] += self.open_pos
            elif self.open_pos.any():
                some, gp = np.append(0, some), np.vstack([self.open_pos, gp])
            here = w
        else:
            starts = np.concatenate([[0], ends[: n if rest else n - 1] + 1])
            here, gp = np.add.reduceat(w, starts, axis=0), np.add.reduceat(w * positive[:, None], starts, axis=0)
            gp[0] += self.open_pos
            after = (gp[n], here[n]) if rest else None
            some = np.arange(n)
            here, gp = here[:n], gp[:n]
        here[0] += self.open_all
        zero = np.zeros_like(self.pos)
        self.open_pos, self.open_all = after if rest else (zero, zero)
        self.drawn = self.drawn + np.count_nonzero(here, axis=0)
        here[0] += self.all
        upto = np.cumsum(here, axis=0)
        self.all = upto[-1]
        if len(some):
            # A score without positive weight adds nothing; where there is some, the count is at least that.
            cp = gp.copy()
            cp[0] += self.pos
            cp = np.cumsum(cp, axis=0)
            self.pos = cp[-1]
            gp *= cp
            gp /= np.maximum(upto if len(some) == n else upto[some], 1.0)
            self.area = self.area + gp.sum(axis=0)


def auprc_replicates(
    scored: DataFrame, key: str, entity: str, replicates: int, seed: int, *, modes: Sequence[str] = ("naive",), block: str | None = None, chunk: int = 1 << 16
) -> DataFrame:
    """(mode, key, b, auprc) of every replicate; null where a replicate has drawn at most one score, 0 without positives.

    Two passes over the chunks. The first sums each chunk's first score, last score and what lies between. Along the
    chunks of a key (sums only, ``SPLIT`` replicates in a task) these give the counts above each chunk, and the
    contributions of scores at chunk borders. The second pass walks down the scores between a chunk's borders. A key
    with a non-finite score has no result.
    """
    r, modes = replicate_numbers(seed, replicates), tuple(modes)
    kind = dict(scored.dtypes)[key]
    chunks = chunked(scored.filter(is_finite("score")), key, entity, seed, block, chunk)
    parts = [(i, min(i + SPLIT, replicates)) for i in range(0, replicates, SPLIT)]
    arrays = "fp array<long>, fn array<long>, ip array<long>, inn array<long>, lp array<long>, ln array<long>"

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i in range(len(batch)):
                c = Chunk(batch, i)
                n = len(c.score)
                first, inner, last = (c.total(x, y, modes, r, known) for x, y in ((0, c.first), (c.first, c.last), (c.last, n)))
                rows = [(m, part, x, y) for m in modes for part, (x, y) in enumerate(parts)]
                cols = [[first[m][0][x:y], first[m][1][x:y], inner[m][0][x:y], inner[m][1][x:y], last[m][0][x:y], last[m][1][x:y]] for m, _, x, y in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m for m, *_ in rows], pa.string()), pa.array([batch.column(1)[i].as_py()] * len(rows), batch.schema.field(1).type), pa.array([p for _, p, *_ in rows], pa.int32()), pa.array([c.number] * len(rows), _LONGS),
                     pa.array([float(c.score[0])] * len(rows)), pa.array([float(c.score[-1])] * len(rows)), pa.array([c.last < n] * len(rows)), pa.array([c.last > c.first] * len(rows)), *(pa.array([x[j].tolist() for x in cols], pa.list_(_LONGS)) for j in range(6))],
                    names=["mode", key, "part", "chunk", "top", "low", "two", "more", "fp", "fn", "ip", "inn", "lp", "ln"])

    sums = settle(chunks.mapInArrow(first_pass, f"mode string, {key} {kind}, part int, chunk long, top double, low double, two boolean, more boolean, {arrays}"))

    def along(table: pa.Table) -> pa.Table:
        """Counts above the rows between each chunk's borders (chunk >= 0), and the sums of the border scores (chunk -1)."""
        t = table.sort_by("chunk")
        get = lambda name: t.column(name).to_pylist()
        size = len(t.column("fp")[0].as_py())
        zero = lambda: np.zeros(size)
        up, un, area, drawn = zero(), zero(), zero(), zero()
        open_score, gp, gn = None, zero(), zero()
        out: list[tuple[int, list, list, list]] = []

        def close() -> None:
            nonlocal up, un, area, drawn, gp, gn
            up, un = up + gp, un + gn
            area = area + np.divide(gp * up, up + un, out=zero(), where=(up + un) > 0)
            drawn = drawn + ((gp + gn) > 0)
            gp, gn = zero(), zero()

        for number, top, low, two, more, fp, fn, ip, inn, lp, ln in zip(*(get(c) for c in ("chunk", "top", "low", "two", "more", "fp", "fn", "ip", "inn", "lp", "ln")), strict=True):
            if open_score is not None and open_score != top:
                close()
            open_score, gp, gn = top, gp + np.array(fp, float), gn + np.array(fn, float)
            if two:
                close()
                if more:
                    out.append((number, up.tolist(), un.tolist(), []))
                    up, un = up + np.array(ip, float), un + np.array(inn, float)
                open_score, gp, gn = low, np.array(lp, float), np.array(ln, float)
        close()
        out.append((-1, area.tolist(), up.tolist(), drawn.tolist()))
        same = [t.column(c).slice(0, 1).to_pylist() * len(out) for c in ("mode", key, "part")]
        return pa.table({"mode": pa.array(same[0], pa.string()), key: pa.array(same[1], t.schema.field(key).type), "part": pa.array(same[2], pa.int32()), "chunk": pa.array([x[0] for x in out], _LONGS),
                         **{n: pa.array([x[j] for x in out], pa.list_(pa.float64())) for j, n in ((1, "x"), (2, "y"), (3, "z"))}})

    met = settle(sums.groupBy("mode", key, "part").applyInArrow(along, f"mode string, {key} {kind}, part int, chunk long, x array<double>, y array<double>, z array<double>"))
    above = met.filter("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("mode", "part", "x", "y"))).alias("above"))

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[np.ndarray]] = {}
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i in range(len(batch)):
                c, k = Chunk(batch, i), batch.column(1)[i].as_py()
                start: dict[str, list[list]] = {m: [[], []] for m in modes}
                for x in batch.column(batch.schema.get_field_index("above"))[i].as_py():
                    start[x["mode"]][0] += x["x"]
                    start[x["mode"]][1] += x["y"]
                state = {m: Descent(np.array(s[0]), np.array(s[1])) for m, s in start.items()}
                for x in range(c.first, c.last, ROWS):
                    y = min(c.last, x + ROWS)
                    ends = np.flatnonzero(np.append(c.score[x:y - 1] != c.score[x + 1 : y], c.score[y - 1] != c.score[y]))
                    for m, w in c.drawn(x, y, modes, r, known).items():
                        state[m].take(w, c.pos[x:y], ends)
                for m, s in state.items():
                    old = sums.get((m, k), [0.0, 0.0])
                    sums[m, k] = [old[0] + s.area, old[1] + s.drawn]
        for (m, k), (area, drawn) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(r), pa.string()), pa.array([k] * len(r), batch.schema.field(1).type), pa.array(np.arange(len(r), dtype=np.int32)), pa.array(area), pa.array(np.zeros(len(r))), pa.array(drawn.astype(float))],
                                             names=["mode", key, "b", "area", "n_pos", "drawn"])

    shape = f"mode string, {key} {kind}, b int, area double, n_pos double, drawn double"
    inner = chunks.join(above, "chunk").mapInArrow(second_pass, shape)
    border = met.filter("chunk = -1").select("mode", key, "part", F.posexplode(F.arrays_zip("x", "y", "z")).alias("i", "v")).select(
        "mode", key, (F.col("part") * SPLIT + F.col("i")).alias("b"), F.col("v.x").alias("area"), F.col("v.y").alias("n_pos"), F.col("v.z").alias("drawn"))
    both = inner.union(border).groupBy("mode", key, "b").agg(*[F.sum(c).alias(c) for c in ("area", "n_pos", "drawn")])
    fine = scored.groupBy(key).agg(F.bool_and(is_finite("score")).alias("_ok")).filter("_ok").drop("_ok")
    value = F.when(F.col("drawn") <= 1, None).when(F.col("n_pos") == 0, 0.0).otherwise(F.col("area") / F.col("n_pos"))
    return both.join(fine, key).select("mode", key, "b", value.alias("auprc"))
