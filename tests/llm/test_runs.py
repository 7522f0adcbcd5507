"""Periodic runs against the plain definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from scoreloom.llm import runs

from .conftest import prose


def brute_runs(w, exponent, least):
    """By every period: maximal stretches of words equal to the one a period back, smallest period first."""
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(least, exponent * q) and not any(all(w[k] == w[k + p] for k in range(start, start + length - p)) for p in range(1, q)):
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters,size", [(1, 30), (2, 40), (3, 60), (4, 30)])
def test_repetitions_of_small_words(letters, size):
    r = random.Random(letters)
    for _ in range(150):
        w = [r.randrange(letters) for _ in range(r.randint(0, size))]
        assert runs.repetitions(w) == brute_runs(w, 2, 2)


def planted(r):
    w = []
    for _ in range(r.randint(1, 6)):
        part = [r.randrange(6) for _ in range(r.randint(1, 7))]
        w += (part * r.randint(1, 9))[: r.randint(1, 40)] + [r.randrange(40) for _ in range(r.randint(0, 9))]
    return w


def test_cut_stretches_lose_no_run():
    r = random.Random(7)
    for _ in range(150):
        texts = [planted(r) for _ in range(r.randint(1, 5))] + [[]]
        r.shuffle(texts)
        got = runs.runs_of(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]), 4, 6)
        assert got == [brute_runs(t, 4, 6) for t in texts]


def test_many_words_in_one_run_stay_fast():
    w = [1] * 20_000 + [2, 3] * 20_000 + list(range(10, 1010)) * 12
    assert runs.runs_of(np.array(w), np.array([len(w)]), 4, 6) == [[(0, 20_000, 1), (20_000, 40_000, 2), (60_000, 12_000, 1000)]]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_highly_repetitive_words():
    w = fibonacci(600)
    assert runs.repetitions(w) == brute_runs(w, 2, 2)
    assert len(runs.repetitions(fibonacci(20_000))) > 10_000


def brute(row):
    doc_id, text = row[:2]
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = brute_runs(w, 4, 6)
    drop = {k for s, n, q in found for k in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


def test_digest(docs, odd_texts):
    r = random.Random(11)
    rows = [x for x in odd_texts if len(x[1] or "") < 60_000] + [(i, prose(i, 90)) for i in range(100, 160)] + [(i, " ".join(map(str, planted(r)))) for i in range(200, 260)] + [(7, "a " * 50), (7, "a " * 50)]
    got = sorted(map(tuple, runs.run_digest(docs(rows)).collect()), key=str)
    assert got == sorted(map(brute, rows), key=str)
    assert sum(x[1] > 0 for x in got) > 20 and runs.run_digest(docs([])).count() == 0


def test_runs_and_collapsed_texts(docs, odd_texts):
    rows = [(1, "one  two " + "no way " * 5 + "end"), (2, None), (3, "a\nb")]
    out = {x.doc_id: [tuple(y) for y in x.runs] for x in runs.periodic_runs(docs(rows)).collect()}
    assert out == {1: [(2, 10, 2)], 2: [], 3: []}
    flat = runs.collapse(docs(rows))
    assert flat.columns == docs([]).columns and {x.doc_id: x.text for x in flat.collect()} == {1: "one two no way end", 2: None, 3: "a\nb"}
    assert runs.collapse(docs(odd_texts)).count() == len(odd_texts) and runs.collapse(docs([])).count() == 0
