"""Periodic runs of words, found online by a suffix automaton whose link tree answers accesses like a link-cut tree.

A run is a stretch of words with smallest period q, at least ``exponent`` periods and ``least`` words long, that no
neighbouring word extends.

Words are appended one by one. The path from the new prefix's state to the root of the automaton's link tree falls
into segments of equal colour, the last place where the strings of the segment ended. Each segment that the path
meets says: the suffix of length ``l`` (that of the state where the path enters the segment) has ended here and,
last, ``d`` words earlier. If ``d <= l`` the two occurrences touch or overlap: a square of period d that goes back to
``l`` words before the earlier end, and it cannot go back further. The last place is the nearest one, so d is its
smallest period. The same square met again one word later is the same run, extended. The whole path is then
recoloured with the new place: an access, during which splay trees, one per segment, keep the cost at a logarithm
per word, amortised. New states hang on the path; a state split off another is put above it in the same tree.

Only stretches that can hold a run are appended. Every word of a run occurs in it at least ``exponent`` times and
every pair of neighbours once less, so text is cut at rarer words and pairs, and the parts again until nothing
changes. This loses nothing and leaves little but periodic text. A document is one sequence and is handled in one
task, beside others; memory follows the longest stretch of one document.

Defined results: a null, empty or blank text has no words and no runs; repeated rows give equal results; a document
without id is taken as it is (no words repeated by number); an empty table gives an empty table; other columns are
ignored (``periodic_runs``, ``run_digest``) or carried along (``collapse``).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scoreloom.llm.arrays import slices
from scoreloom.llm.columns import columns_of

Run = tuple[int, int, int]  # start, length, period


class Automaton:
    """Suffix automaton of the words so far; its link tree as splay trees, one per segment of one colour.

    State 1 is the empty string, 0 stands for none. In a splay tree, left is towards the root of the link tree. A tree's
    root holds its colour, and its parent is the state that the segment hangs on.
    """

    def __init__(self) -> None:
        self.length, self.link, self.next = [0, 0], [0, 0], [{}, {}]
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.size = 1, 0

    def state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        for column in (self.left, self.right, self.up):
            column.append(0)
        self.colour.append(-1)
        return len(self.length) - 1

    def splay(self, x: int) -> None:
        """Make x the root of its tree."""
        left, right, up = self.left, self.right, self.up
        p = top = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while True:
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                a = up[g]
                outer = a and (left[a] == g or right[a] == g)
                top = g
                steps = (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
            else:
                outer, top, steps = 0, p, (x,)
            for y in steps:
                q = up[y]
                h = up[q]
                if left[q] == y:
                    c = left[q] = right[y]
                    right[y] = q
                else:
                    c = right[q] = left[y]
                    left[y] = q
                if c:
                    up[c] = q
                up[q], up[y] = y, h
                if h:
                    if left[h] == q:
                        left[h] = y
                    elif right[h] == q:
                        right[h] = y
            if not outer:
                break
            p = up[x]
        self.colour[x] = self.colour[top]

    def append(self, word: int) -> list[tuple[int, int]]:
        """(period, start) of every square with a longest left end that ends at this word."""
        length, link, following, left, up = self.length, self.link, self.next, self.left, self.up
        new = self.state(length[self.last] + 1, 1, {})
        p = self.last
        while p and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p:
            q = following[p][word]
            if length[q] != length[p] + 1:
                old = q
                q = self.state(length[p] + 1, link[old], dict(following[old]))
                link[old] = q
                self.splay(old)
                child = left[q] = left[old]
                if child:
                    up[child] = q
                left[old], up[q] = q, old
                while p and following[p].get(word) == old:
                    following[p][word] = q
                    p = link[p]
            link[new] = q
        up[new] = link[new]
        self.last = new
        here, self.size = self.size, self.size + 1
        return self.access(new, here)

    def access(self, state: int, here: int) -> list[tuple[int, int]]:
        """Colour the path from a state to the root with ``here``."""
        length, right, up, colour = self.length, self.right, self.up, self.colour
        found = []
        below, x = 0, state
        while x:
            self.splay(x)
            was = colour[x]
            if was >= 0 and here - was <= length[x]:
                found.append((here - was, was - length[x] + 1))
            cut = right[x]
            if cut:
                colour[cut] = was
            right[x] = below
            if below:
                up[below] = x
            below, x = x, up[x]
        colour[below] = here
        return found


def repetitions(words: list[int]) -> list[Run]:
    """All maximal repetitions of two periods or more, by start and period."""
    tree, ends = Automaton(), {}
    for i, w in enumerate(words):
        for period, start in tree.append(w):
            ends[start, period] = i
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


def frequent(key: np.ndarray, least: int) -> np.ndarray:
    """Whether each key occurs ``least`` times."""
    _, place, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[place] >= least


def stretches(ids: np.ndarray, joined: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches that may hold a run. ``joined``: whether a word and the next are of one text."""
    at, joined = np.arange(len(ids)), joined.copy()
    if len(ids) < least:
        return []
    wide = int(ids.max()) + 1
    pair = np.append(np.unique(ids[:-1] * wide + ids[1:], return_inverse=True)[1], 0)
    while len(at):
        part = np.concatenate([[0], np.cumsum(~joined)])
        good = frequent(part * wide + ids, exponent)
        still = joined & good[:-1] & good[1:]
        some = np.flatnonzero(still)
        still[some] = frequent(part[some] * (len(pair) + 1) + pair[some], exponent - 1)
        after = np.concatenate([[0], np.cumsum(~still)])
        keep = np.flatnonzero(np.bincount(after)[after] >= least)
        if len(keep) == len(at) and (still == joined).all():
            break
        joined = (np.diff(keep) == 1) & still[keep[:-1]]
        at, ids, pair = at[keep], ids[keep], pair[keep]
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], ~joined]))
    return [(int(at[x]), int(at[y - 1]) + 1) for x, y in zip(first, [*first[1:], len(at)], strict=True)]


def runs_of(ids: np.ndarray, sizes: np.ndarray, exponent: int, least: int) -> list[list[Run]]:
    """The runs of each of several texts, given as one sequence of word numbers and the texts' sizes."""
    upto = np.cumsum(sizes)
    joined = np.ones(max(len(ids) - 1, 0), bool)
    borders = upto[(upto > 0) & (upto < len(ids))] - 1
    joined[borders] = False
    out: list[list[Run]] = [[] for _ in sizes]
    for a, b in stretches(ids, joined, exponent, least):
        text = int(np.searchsorted(upto, a, "right"))
        offset = a - int(upto[text] - sizes[text])
        out[text] += [(offset + s, n, q) for s, n, q in repetitions(ids[a:b].tolist()) if n >= max(least, exponent * q)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def numbered(words: list[bytes]) -> np.ndarray:
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def looped(doc_id: int | None, n: int) -> np.ndarray:
    """Which word stands at each place of a document whose number says that it repeats itself from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not n:
        return np.arange(n)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def texts_of(batches: Iterator[pa.RecordBatch], column: int, exponent: int, least: int, loops: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[list[Run]]]]:
    """Some rows, the words of their texts and their runs. ``loops``: the column of ids whose words ``looped`` repeats."""
    for batch in batches:
        for x, y, data, offs in slices(batch.column(column)):
            part = batch.slice(x, y - x)
            flat = data.tobytes()
            words = [flat[a:b].split() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            if loops is not None:
                words = [[w[j] for j in looped(i, len(w)).tolist()] for i, w in zip(part.column(loops).to_pylist(), words, strict=True)]
            sizes = np.array([len(w) for w in words], np.int64)
            yield part, words, runs_of(numbered([w for t in words for w in t]), sizes, exponent, least)


def kept(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """id and runs (start, length, period), in words, of every row."""
    item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, runs in texts_of(batches, 1, exponent, least):
            each = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], item)
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), each], names=[id_col, "runs"])

    return columns_of(docs, id_col, text).mapInArrow(run, f"`{id_col}` long, runs array<struct<start:long,length:long,period:long>>")


def collapse(docs: DataFrame, text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """``docs`` with each run cut down to its first period; texts without a run stay as they are."""
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, runs in texts_of(batches, place, exponent, least):
            old = part.column(place).to_pylist()
            cols = list(part.columns)
            cols[place] = pa.array([kept(w, r).decode() if r else t for t, w, r in zip(old, words, runs, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def run_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", exponent: int = 4, least: int = 6) -> DataFrame:
    """id, n_runs, the run of most periods, and digests of all runs and of the collapsed text, every tenth document (by a
    checksum of its id) repeating itself from some word on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words, runs in texts_of(batches, 1, exponent, least, loops=0):
            best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else (None, None, None) for r in runs]
            told = [hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest() for r in runs]
            rest = [hashlib.sha256(kept(w, r)).hexdigest() for w, r in zip(words, runs, strict=True)]
            longs = [[len(r) for r in runs], *([b[i] for b in best] for i in range(3)), [1000 * b[1] // b[2] if b[2] else None for b in best]]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in longs), pa.array(told, pa.string()), pa.array(rest, pa.string())],
                                             names=[id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return columns_of(docs, id_col, text).mapInArrow(
        run, f"`{id_col}` long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
