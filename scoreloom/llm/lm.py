"""Language-model scoring by cross-entropy difference.

A target model is learned from the documents labelled good, a matched background model from all others: the
same character vocabulary (that of the whole corpus), orders, smoothing and hash table, and background counts
scaled to the target's number of tokens, so that both are smoothed alike. A token's loss under a model is the
weighted sum over the orders of minus log ((count(n-gram) + a) / (count(context) + a * vocabulary)). A document's
score is the mean difference of its tokens' losses, target minus background: the lower, the more like the target.

Counts cover every text. Each task adds up n-grams in columns and returns its non-empty cells, which meet by
cell; what is shuffled follows the corpus. The finished tables have ``cells`` entries for each model whatever the
corpus, and only they are broadcast.

Defined results: a null or empty text has no tokens, null losses and a null score; without target or
background documents both models are that of the other side and every score is 0; a label of an unknown id is
ignored, labels repeated for an id count as good if one is good and none toxic; rows without id are background;
repeated rows are scored alike; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.arrays import U, mix, stream
from scoreloom.llm.columns import columns_of
from scoreloom.llm.langid import runs


@dataclass(frozen=True)
class Grams:
    """``weights``: of orders 1, 2, ... ``cells``: size of the hash table that all orders share."""

    weights: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4)
    cells: int = 1 << 21
    smoothing: float = 0.5


@dataclass(frozen=True)
class Loss:
    """What an n-gram adds to a text's loss, by order and cell, under either model."""

    target: np.ndarray
    background: np.ndarray


def cells_of(texts: list[str], how: Grams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, cell, text) of all n-grams within texts."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    h = mix(points + U(77))
    for n in range(1, len(how.weights) + 1):
        m = len(h) - n + 1
        if m <= 0:
            continue
        mult = stream(900 + n, n) | U(1)
        g = h[:m] * mult[0]
        for i in range(1, n):
            g += h[i : i + m] * mult[i]
        inside = owner[:m] == owner[n - 1 :]
        g = mix(g[inside] + U(n))
        yield n, (g % U(how.cells)).astype(np.int64), owner[:m][inside]


def counts(docs: DataFrame, how: Grams) -> DataFrame:
    """(cell, one, target, background) from rows (good, text): n-gram counts of both sides, and whether a single
    character falls into the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, how.cells), np.int64)
        order = np.zeros(how.cells, np.int8)
        for batch in batches:
            good = np.array(batch.column(0).to_pylist(), bool)
            for a, texts in runs(batch.column(1)):
                own = good[a : a + len(texts)]
                for n, cell, doc in cells_of(texts, how):
                    side = own[doc]
                    total[1] += np.bincount(cell[side], minlength=how.cells)
                    total[0] += np.bincount(cell[~side], minlength=how.cells)
                    if n == 1:
                        order[cell] = 1
        some = np.flatnonzero(total.any(axis=0))
        for p in range(0, len(some), 1 << 16):
            c = some[p : p + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(order[c].astype(np.int32)), pa.array(total[1, c]), pa.array(total[0, c])], names=["cell", "one", "target", "background"])

    part = docs.select("good", "text").mapInArrow(run, "cell int, one int, target long, background long")
    return part.groupBy("cell").agg(F.max("one").alias("one"), F.sum("target").alias("target"), F.sum("background").alias("background"))


def fit(docs: DataFrame, how: Grams = Grams()) -> Loss:
    """Learn from rows (good boolean, text). The driver receives the finished table, ``cells`` rows at most."""
    t, b, one = np.zeros(how.cells), np.zeros(how.cells), np.zeros(how.cells, bool)
    packed = counts(docs, how).groupBy((F.col("cell") / 8192).cast("int").alias("block")).agg(F.collect_list(F.struct("cell", "one", "target", "background")).alias("r"))
    columns = packed.select(*[F.col(f"r.{c}").alias(c) for c in ("cell", "one", "target", "background")])
    for row in columns.toLocalIterator():
        at = np.array(row.cell)
        t[at], b[at], one[at] = row.target, row.background, np.array(row.one, bool)
    vocabulary = max(1, int(one.sum()))
    if not t.sum() or not b.sum():
        t = b = t + b
    else:
        b = b * (t.sum() / b.sum())
    tokens = t[one].sum()

    def loss(c: np.ndarray) -> np.ndarray:
        """By order and cell: an n-gram's part as the predicted token of its order, and as the next order's context."""
        w, a = how.weights, how.smoothing
        count, context = -np.log(c + a), np.log(c + a * vocabulary)
        rows = [w[n] * count + (w[n + 1] * context if n + 1 < len(w) else 0) for n in range(len(w))]
        rows[0] = rows[0] + w[0] * np.log(tokens + a * vocabulary)
        return np.stack(rows).astype(np.float32)

    return Loss(loss(t), loss(b))


def score(docs: DataFrame, model: Loss, how: Grams = Grams(), text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` with n_tokens, loss_target, loss_background (per token) and score, their difference."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            size, lt, lb = [], [], []
            for _, texts in runs(batch.column(len(keep))):
                n = np.array([len(x) for x in texts], np.int64)
                total = np.zeros((2, len(texts)))
                for order, cell, doc in cells_of(texts, how):
                    for i, table in enumerate((m.target, m.background)):
                        total[i] += np.bincount(doc, weights=table[order - 1][cell], minlength=len(texts))
                size.append(n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    lt.append(total[0] / n)
                    lb.append(total[1] / n)
            n = np.concatenate(size) if size else np.zeros(0, np.int64)
            t, b = (np.concatenate(x) if x else np.zeros(0) for x in (lt, lb))
            none = n == 0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n), pa.array(t, mask=none), pa.array(b, mask=none), pa.array(t - b, mask=none)],
                                             names=[*keep, "n_tokens", "loss_target", "loss_background", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = rows.drop("_text").schema.add("n_tokens", "long").add("loss_target", "double").add("loss_background", "double").add("score", "double")
    return rows.mapInArrow(run, schema)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic", how: Grams = Grams()) -> DataFrame:
    """id, n_tokens, loss_target, loss_background, score of every row. Good: quality 1 and not toxic."""
    good = columns_of(labels, id_col, quality, toxic).groupBy(F.col(id_col).alias("_id")).agg(
        ((F.max(quality) == 1) & (F.coalesce(F.max(toxic), F.lit(0)) == 0)).alias("_g"))
    rows = columns_of(docs, id_col, text)
    # Labels grow with the corpus: they are never broadcast, and the plan is the same for every size.
    known = rows.join(good.hint("merge"), F.col(id_col) == F.col("_id"), "left").select(F.coalesce("_g", F.lit(False)).alias("good"), F.col(text).alias("text"))
    return score(rows, fit(known, how), how, text, (id_col,))
