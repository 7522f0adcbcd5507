"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of every labelled text in columns: each task adds them up per language and bucket and
returns one row per language and block of buckets, so what is shuffled follows the number of tasks, not the
text. The log-probabilities of all buckets and languages form one matrix that is broadcast; its size is
``languages * buckets * 8`` bytes whatever the corpus, and is checked against ``most_model_mb``. Scoring gathers
matrix rows at a text's n-grams and adds them up per text.

N-grams run over lower-cased letters; every run of other characters is one space, and a space stands before and
after a text.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if there is
nothing to learn from; rows without label or text, and (in the query) without id, teach nothing; a row
without id is not held out; repeated rows are predicted alike; an empty table gives an empty table; other
columns are ignored.
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

BLOCK = 4096
_LETTER = np.full(0x110000, -1, np.int8)


@dataclass(frozen=True)
class Bayes:
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 16
    smoothing: float = 0.5
    most_model_mb: float = 256.0


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prior: np.ndarray
    matrix: np.ndarray  # buckets x languages


def letters(points: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    new = points[_LETTER[points] < 0]
    for p in np.unique(new).tolist():
        _LETTER[p] = chr(p).isalpha()
    return _LETTER[points].astype(bool)


def runs(texts: pa.Array, size: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of whole texts of about ``size`` characters."""
    rows = texts.to_pylist()
    a = n = 0
    for i, t in enumerate(rows):
        n += len(t or "")
        if n >= size:
            yield a, [x or "" for x in rows[a : i + 1]]
            a, n = i + 1, 0
    if a < len(rows):
        yield a, [x or "" for x in rows[a:]]


def grams(texts: list[str], how: Bayes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: buckets of all n-grams, the text of each, and (once the same) which texts have letters."""
    joined = "\x00".join(x.lower().replace("\x00", " ") for x in texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    stop = points == 0
    doc = np.cumsum(stop) - stop
    letter = letters(points)
    keep = letter | stop
    keep[1:] |= ~letter[1:] & letter[:-1]  # of a run of others only the first, which follows a letter
    has = np.zeros(len(texts), bool)
    has[doc[letter]] = True
    value = np.where(letter, points, 32)[keep].astype(U)
    owner = doc[keep]
    h = mix(value + U(1_000_003))
    for n in how.orders:
        m = len(h) - n + 1
        if m <= 0:
            continue
        mult = stream(500 + n, n) | U(1)
        g = h[:m] * mult[0]
        for i in range(1, n):
            g = g + h[i : i + m] * mult[i]
        inside = owner[:m] == owner[n - 1 :]
        yield (mix(g[inside]) % U(how.buckets)).astype(np.int64), owner[:m][inside], has


def counts(labelled: DataFrame, how: Bayes) -> DataFrame:
    """(lang, block, i, c, texts): n-gram counts of rows (lang, text), added up per task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            out = [(k, j, seen[k] if j == 0 else 0, v[j * BLOCK : (j + 1) * BLOCK]) for k, v in total.items() for j in range(-(-how.buckets // BLOCK))]
            out = [x for x in out if x[1] == 0 or x[3].any()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.list_(pa.int64()))],
                names=["lang", "block", "texts", "n"])

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, texts in runs(batch.column(1)):
                own = langs[a : a + len(texts)]
                names = sorted(set(own))
                index = np.array([names.index(x) for x in own])
                for x in names:
                    if x not in total:
                        total[x], seen[x] = np.zeros(how.buckets, np.int64), 0
                    seen[x] += own.count(x)
                for bucket, doc, _ in grams(texts, how):
                    both = np.bincount(index[doc] * how.buckets + bucket, minlength=len(names) * how.buckets).reshape(len(names), -1)
                    for i, x in enumerate(names):
                        total[x] += both[i]
            if len(total) > 64:  # bounds a task's memory where labels are many
                yield rows()
                total.clear()
                seen.clear()
        if total:
            yield rows()

    part = labelled.select("lang", "text").mapInArrow(run, "lang string, block int, texts long, n array<long>")
    cells = part.select("lang", "block", "texts", F.posexplode("n").alias("i", "c")).filter("c > 0 or (block = 0 and i = 0)")
    return cells.groupBy("lang", "block", "i").agg(F.sum("c").alias("c"), F.sum(F.when(F.col("i") == 0, F.col("texts")).otherwise(0)).alias("texts"))


def fit(labelled: DataFrame, how: Bayes = Bayes()) -> Model:
    """Learn from rows (lang, text), nulls left out. The driver receives the counts of the model's own cells."""
    known = labelled.filter("lang is not null and text is not null")
    cells = counts(known, how).groupBy("lang", "block").agg(F.sum("texts").alias("texts"), F.collect_list(F.struct("i", "c")).alias("n"))
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for row in cells.toLocalIterator():
        if row.lang not in total:
            total[row.lang], texts[row.lang] = np.zeros(how.buckets), 0
            if len(total) * how.buckets * 8 > how.most_model_mb * 1e6:
                raise ValueError(f"more languages than a model of {how.most_model_mb} MB holds; lower buckets or raise most_model_mb")
        texts[row.lang] += row.texts
        for i, c in row.n:
            total[row.lang][row.block * BLOCK + i] = c
    names = tuple(sorted(total))
    if not names:
        return Model((), np.zeros(0), np.zeros((how.buckets, 0)))
    n = np.stack([total[x] for x in names], axis=1) + how.smoothing
    prior = np.array([texts[x] for x in names], float)
    return Model(names, np.log(prior / prior.sum()), np.log(n / n.sum(axis=0)))


def predict(docs: DataFrame, model: Model, how: Bayes = Bayes(), text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score, the posterior probability of the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            pred, score = [], []
            for _, texts in runs(batch.column(len(keep))):
                total = np.tile(m.prior, (len(texts), 1))
                has = np.zeros(len(texts), bool)
                for bucket, doc, has in grams(texts, how):
                    if len(m.languages) and len(bucket):
                        first = np.flatnonzero(np.diff(doc, prepend=-1))
                        total[doc[first]] += np.add.reduceat(m.matrix[bucket], first, axis=0)
                if not len(m.languages):
                    pred += ["und"] * len(texts)
                    score += [0.0] * len(texts)
                    continue
                best = total.argmax(axis=1)
                post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                pred += [m.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
                score += np.where(has, post, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, rows.drop("_text").schema.add("lang_pred", "string").add("score", "double"))


def held_out_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", how: Bayes = Bayes()) -> DataFrame:
    """id, held_out, lang_pred, score. Learns from the rows whose id's checksum leaves another remainder than 1
    modulo 3, predicts every row."""
    rest = F.crc32(F.col(id_col).cast("string")) % 3
    rows = columns_of(docs, id_col, text, lang).withColumn("held_out", F.coalesce(rest == 1, F.lit(False)))
    model = fit(rows.filter(F.col(id_col).isNotNull() & ~F.col("held_out")).select(F.col(lang).alias("lang"), F.col(text).alias("text")), how)
    return predict(rows, model, how, text, (id_col, "held_out"))
