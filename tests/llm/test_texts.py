"""Operators on texts: odd inputs, empty tables, and brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import arrays, langid, lines, lm, minhash, passages, pieces, pii, quality
from scoreloom.llm.queries import QUERIES

from .conftest import prose

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def table():
    t = ds.dataset(f"{SF}/documents.parquet").to_table().to_pydict()
    return list(zip(t["doc_id"], t["text"], t["lang"], t["source"], strict=True))


# --- arrays ---------------------------------------------------------------------------------------------------


def test_spans_and_hashes_follow_words():
    texts = ["a bc  d", None, "", " x\ty\n", "bc", "Aé bc"]
    for _, _, data, offs in arrays.slices(pa.array(texts)):
        s, e, first = arrays.spans(data, offs)
        got = [bytes(data[a:b]).decode() for a, b in zip(s, e, strict=True)]
        assert got == [w for t in texts for w in split(t)]
        assert np.diff(first).tolist() == [len(split(t)) for t in texts]
        h = arrays.hash_spans(data, s, e)
        assert len(set(h[[i for i, w in enumerate(got) if w == "bc"]].tolist())) == 1
        assert len(set(h.tolist())) == len(set(got))


def test_slices_cover_every_row_once(monkeypatch):
    monkeypatch.setattr(arrays, "SLICE", 10)
    texts = ["x" * n for n in (3, 0, 25, 9, 1, 0)]
    assert [(a, b) for a, b, _, _ in arrays.slices(pa.array(texts))][0][0] == 0
    assert sum(b - a for a, b, _, _ in arrays.slices(pa.array(texts))) == len(texts)
    assert b"".join(bytes(d) for _, _, d, _ in arrays.slices(pa.array(texts))) == "".join(texts).encode()


# --- language identification ------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    import zlib

    held = [(i, lang) for i, _, lang, _ in table() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([got[i].lang_pred == lang for i, lang in held if lang]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


MASK = (1 << 64) - 1


def brute_mix(h):
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & MASK
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def brute_grams(text, how):
    """Buckets of a text's n-grams, by hand: letters, one space for each run of others behind a letter, one at the end."""
    seq, before = [], False
    for c in (text or "").lower():
        if c.isalpha() or before:
            seq.append(ord(c) if c.isalpha() else 32)
        before = c.isalpha()
    seq = [brute_mix(v + 1_000_003) for v in [*seq, 32]]
    out = []
    for n in how.orders:
        mult = [int(x) | 1 for x in arrays.stream(500 + n, n)]
        out += [brute_mix(sum(v * m for v, m in zip(seq[i : i + n], mult, strict=True)) & MASK) % how.buckets for i in range(len(seq) - n + 1)]
    return out


def test_language_by_hand(docs, odd_texts):
    how = langid.Bayes(buckets=1 << 9)
    rows = [(i, prose(i, 40, "etaoin" if i % 3 else "uvwxyzé"), "xx" if i % 3 else "yy") for i in range(40)] + [(100 + i, t, "zz" if i % 2 else "xx") for i, t in enumerate(["Ab1 c", "--", "", None, "ÀB\x00c", "\U0001f600 a", "a" * 900])]
    known = docs([r for r in rows]).select("lang", "text")
    model = langid.fit(known, how)
    n, texts = {}, Counter()
    for _, t, lang in rows:
        if t is not None:
            texts[lang] += 1
            n.setdefault(lang, np.full(how.buckets, how.smoothing))
            np.add.at(n[lang], brute_grams(t, how), 1)
    names = sorted(n)
    assert model.languages == tuple(names)
    matrix = np.stack([np.log(n[x] / n[x].sum()) for x in names], axis=1)
    prior = np.log(np.array([texts[x] for x in names]) / sum(texts.values()))
    assert np.allclose(model.matrix, matrix) and np.allclose(model.prior, prior)
    asked = [*rows, *((1000 + i, r[1], None) for i, r in enumerate(odd_texts) if len(r[1] or "") < 1000)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs([(i, t, lang) for i, t, lang in asked]), model, how, keep=("doc_id",)).collect()}
    for i, t, _ in asked:
        total = prior + matrix[brute_grams(t, how)].sum(axis=0)
        post = np.exp(total - total.max())
        letters = any(c.isalpha() for c in t or "")
        want = (names[int(total.argmax())], float(post.max() / post.sum())) if letters else ("und", 0.0)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1]), (i, t)


def test_language_odd_inputs(docs, odd_texts):
    rows = langid.held_out_languages(docs([*odd_texts, (20, "123 456"), (21, "abc", None)])).collect()
    assert len(rows) == len(odd_texts) + 2
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [by[i][0].lang_pred for i in (1, 2, 3, 20)] == ["und"] * 4 and by[20][0].score == 0
    assert by[5][0].lang_pred == "en" and not by[None][0].held_out
    nothing = langid.held_out_languages(docs([(1, "abc", None), (2, None, "en")])).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.held_out_languages(docs([])).count() == 0


def test_language_model_size_is_checked(docs):
    small = langid.Bayes(buckets=1 << 12, most_model_mb=0.05)
    with pytest.raises(ValueError, match="more languages"):
        langid.fit(docs([(i, "text", f"l{i}") for i in range(5)]).select("lang", "text"), small)


# --- lines ------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    owner = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                owner[key(x)].add(i)
    out = []
    for i, t, *_ in rows:
        x = (t or "").split("\n")
        keep = [y for y in x if i is None or len(key(y)) < 10 or len(owner[key(y)]) < 2 or i == min(owner[key(y)])]
        out.append((i, len(x), len(x) - len(keep), sha("\n".join(keep))))
    return Counter(out)


def test_line_dedup(docs, odd_texts):
    rows = [*odd_texts, (30, "Short\nA LINE of words\t\nÉcole normale supérieure"), (31, "a line of words\nshort\nécole normale supérieure\nÉcole Normale SUPÉRIEURE "), (32, "\n".join(f"line number {i}" for i in range(200))),
            (33, "\n".join(f"Line Number {i}" for i in range(0, 400, 2)))]
    got = Counter(tuple(r) for r in lines.line_digest(docs(rows)).collect())
    assert got == brute_lines(rows)
    assert lines.line_digest(docs([])).count() == 0
    cut = lines.drop_repeated_lines(docs(rows))
    assert cut.columns == docs([]).columns and cut.filter("n_chars <> length(text)").count() == 0
    assert cut.filter("doc_id = 31").first().text == "short\nécole normale supérieure\nÉcole Normale SUPÉRIEURE "
    assert cut.filter("doc_id = 1").first().text is None


# --- passages ---------------------------------------------------------------------------------------------------


def brute_passages(rows, k=13):
    first = {}
    for i, t, *_ in rows:
        w = split(t)
        if i is not None:
            for p in range(len(w) - k + 1):
                g = tuple(w[p : p + k])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w, gone = split(t), set()
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return Counter(out)


def test_passages(docs, odd_texts):
    shared = prose(5, 60)
    rows = [*odd_texts, *[(40 + i, prose(100 + i, 30) + " " + shared + "\n" + prose(200 + i, 30)) for i in range(12)], (60, "a b " * 40), (61, "b a " * 9), (62, " ".join(shared.split()[:12])), (63, " ".join(shared.split()[20:33]))]
    got = Counter(tuple(r) for r in passages.passage_digest(docs(rows)).collect())
    assert got == brute_passages(rows)
    assert passages.passage_digest(docs([])).count() == 0
    cut = passages.drop_repeated_passages(docs(rows))
    assert cut.columns == docs([]).columns
    assert cut.filter("doc_id = 5").first().text == dict((r[0], r[1]) for r in odd_texts)[5] and cut.filter("doc_id = 6").first().text == ""


# --- personal data ----------------------------------------------------------------------------------------------


def plain_base(t):
    """The published patterns as they stand."""
    def drop(kind, m):
        d = re.sub(r"[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and pii.luhn(d)
        return kind == "email" or 9 <= len(d) <= 15

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    return {k: [m.span() for m in re.finditer(p, t) if drop(k, m[0])] for k, p in patterns.items()}


PII_TEXTS = [
    "", "mail a.b+c@x-y.example.com, or a@b@c.de x@y", "@a.b.c @ .@. a@b", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890123",
    "+1 (415) 555-0132; +49 30 1234567 +1 2 +12", "9" * 3000 + ".1.1.1", "+1" + " " * 2000 + "x", "a" * 3000 + "@b", "é1.1.1.1é", "٤" * 5,
]


@pytest.mark.parametrize("t", PII_TEXTS)
def test_base_equals_plain_patterns(t):
    assert pii.base(t) == plain_base(t)


def test_base_equals_plain_patterns_on_documents():
    for _, t, *_ in table():
        assert pii.base(t or "") == plain_base(t or "")


@pytest.mark.parametrize(("t", "kind", "found"), [
    ("write to jane [at] example [dot] com now", "email", "jane [at] example [dot] com"),
    ("write to jane dot doe at example dot co dot uk now", "email", "jane dot doe at example dot co dot uk"),
    ("jаne(at)example.com", "email", "jаne(at)example.com"),
    ("mail jane＠example．com.", "email", "jane＠example．com"),
    ("ja​ne@exam​ple.com", "email", "ja​ne@exam​ple.com"),
    ("call plus four nine three zero one two three four five six seven today", "phone", "plus four nine three zero one two three four five six seven"),
    ("card four one one one, one one one one, 1111 1111 end", "card", "four one one one, one one one one, 1111 1111"),
    ("host １９２．１６８．０．１ up", "ip", "１９２．１６８．０．１"),
])
def test_disguised(t, kind, found):
    plain, every = pii.scan(t)
    assert found in [t[a:b] for a, b in every[kind]]
    assert all(s in every[k] for k in plain for s in plain[k])


@pytest.mark.parametrize(("found", "kind"), [
    *[(f"jane{a}example.com", "email") for a in (" at ", " AT ", "  at  ", " @ ", " arroba ", "[at]", " (at) ", " {ät} ", "<@>", "-at-", "_AT_")],
    *[(f"jane@example{d}com", "email") for d in (" dot ", " punto ", " punkt ", " point ", "[.]", " (dot) ", "-dot-", "_DOT_")],
    ("+1 five five 5 oh one two 3 four seven eight", "phone"), ("+1 415 five 5 5 0132", "phone"), ("+49 four 3 triple one double five six 7 8 nine", "phone"),
    ("4111 one 1 1 1 1111 one 1 1 1", "card"), ("one.two.3.4", "ip"), ("cuatro 111 1111 1111 1111", "card"),
])
def test_each_disguise_alone(found, kind):
    """A rewrite needs no other hint beside it."""
    for t in (f"write to {found}", f"{prose(5, 60)}; {found}, {prose(6, 60)}"):
        _, every = pii.scan(t)
        assert any(t[a:b] == found for a, b in every[kind]), (t, every)


@pytest.mark.parametrize("t", ["We met at home and saw one, two, three of them.", "The dot at the end. Look at this: a point of view at noon", prose(3, 400), "one two three four five six seven eight"])
def test_clean_prose_is_left_alone(t):
    assert not any(pii.scan(t)[1].values())


def test_pii_rows(docs, odd_texts):
    rows = pii.find_pii(docs([*odd_texts, (20, "a@b.cd")])).collect()
    assert len(rows) == len(odd_texts) + 1
    assert {r.base_sha256 for r in rows if r.doc_id in (1, 2)} == {sha("")} and [r.spans for r in rows if r.doc_id == 20] == ["email:0:6"]
    assert pii.find_pii(docs([])).count() == 0
    out = pii.redact(docs([(1, "x a@b.cd y"), (2, None)])).collect()
    assert [r.text for r in out] == ["x <email> y", None]


# --- near-duplicates ----------------------------------------------------------------------------------------------


def brute_near(rows, k, limit):
    sets = []
    for _, t, *_ in rows:
        w = split((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= limit * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    out = Counter()
    for i, r in enumerate(rows):
        c = None if r[0] is None else least[root(i)]
        out[(r[0], len(sets[i]), c, r[0] is None or r[0] == c)] += 1
    return out


def family(seed, n, edits, size=150):
    """Copies of one text with different numbers of changed words, around the limit."""
    import random

    base = prose(seed, size).split()
    out = []
    for i in range(n):
        r = random.Random(seed * 1000 + i)
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(size)] = f"w{r.randrange(9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block_mb", [16.0, 0.02])
def test_near_duplicates(docs, odd_texts, block_mb):
    texts = family(1, 40, 8) + family(2, 25, 3) + [prose(50 + i, 60) for i in range(20)]
    rows = [*odd_texts, *[(100 + 7 * i % 997, t) for i, t in enumerate(texts)]]
    how = minhash.Near(shingle=3, per_cent=85, block_mb=block_mb)
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs(rows), how=how).collect()) == brute_near(rows, 3, 85)


def test_near_duplicates_empty_and_keep_one(docs, odd_texts):
    assert minhash.near_duplicates(docs([])).count() == 0
    texts = family(3, 12, 1)
    rows = [*odd_texts, *[(100 + i, t) for i, t in enumerate(texts)], (100, texts[0])]
    kept = minhash.keep_one(docs(rows))
    assert kept.columns == docs([]).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[100] == 1 and ids[101] == 0 and ids[6] == 0 and ids[5] == 1 and ids[None] == 2 and ids[1] == ids[2] == ids[3] == 1 and ids[8] == 0


# --- pieces -------------------------------------------------------------------------------------------------------


def test_piece_paths_are_best_and_decode(spark):
    model = pieces.load()
    lat = pieces.Lattice(model)
    text = {t: i for i, t in enumerate(model.text) if np.isfinite(model.score[i]) and i not in set(model.byte.tolist())}
    longest = max(map(len, text))

    def brute(w):
        best = [0.0] + [-np.inf] * len(w)
        for e in range(1, len(w) + 1):
            best[e] = best[e - 1] + model.score[model.byte[w[e - 1]]]
            for s in range(max(0, e - longest), e):
                if w[s:e] in text:
                    best[e] = max(best[e], best[s] + model.score[text[w[s:e]]])
        return best[-1]

    words = [b" the", b" thedning", "  éàü日本".encode(), b"\n", b" " + b"x" * 300, "\U0001f600".encode(), b" of", "▁".encode()]
    ids, count = lat.paths(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
    at = 0
    for w, n in zip(words, count, strict=True):
        own = ids[at : at + n]
        assert bytes(lat.decode(own)) == w
        assert model.score[own].sum() == pytest.approx(brute(w))
        at += n
    small = [" the", " thedning", " ofthand", " and"]
    rel = {r.word: r for r in pieces.word_paths(spark.createDataFrame([(w,) for w in small], "word string"), model.table(spark), 16).collect()}
    ids, count = lat.paths(np.frombuffer("".join(small).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in small])]))
    at = 0
    for w, n in zip(small, count, strict=True):
        assert rel[w].score == pytest.approx(model.score[ids[at : at + n]].sum())
        at += n


def test_word_paths_hold_words_that_no_piece_covers_and_long_ones(spark):
    model = pieces.load()
    lat = pieces.Lattice(model)
    words = [" the", "\U0001f600", " \U0001f600日本\x00", "\n", " " + "x" * 700, " " + "ab日" * 100, " internationalisation", "q" * 64, "q" * 65]
    raw = [w.encode() for w in words]
    ids, count = lat.paths(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw])]))
    ends = np.cumsum(count)
    rel = pieces.word_paths(spark.createDataFrame([(w,) for w in [*words, "", words[0], None]], "word string"), model.table(spark), max(map(len, model.text)))
    assert {r.word: r.ids for r in rel.collect()} == {w: ids[e - n : e].tolist() for w, n, e in zip(words, count, ends, strict=True)}


def test_with_ids_takes_its_ids_from_the_lattice(docs, odd_texts, monkeypatch):
    seen = []
    whole = pieces.word_paths
    monkeypatch.setattr(pieces, "word_paths", lambda words, *a, **k: seen.append(words) or whole(words, *a, **k))
    rows = [r for r in odd_texts if r[0] != 8]
    out = pieces.with_ids(docs(rows)).select("doc_id", "ids").collect()
    assert len(seen) == 1 and seen[0].columns == ["_part", "word"]
    want = [ids.tolist() for ids, _ in pieces.Lattice(pieces.load()).encode(pa.array([r[1] for r in rows], pa.string()))]
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((r[0], tuple(i)) for r, i in zip(rows, want, strict=True))
    assert pieces.with_ids(docs([])).count() == 0 and pieces.with_ids(docs([(1, None), (2, "")])).filter("size(ids) = 0").count() == 2


def test_pieces_round_trip(docs, odd_texts):
    rows = [*odd_texts, (50, "▁ literal ▁mark"), (51, "  two  spaces \n\n end "), (52, "\n")]
    out = pieces.encoding_digest(docs(rows)).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    assert {r.n_ids for r in out if r.doc_id in (1, 2)} == {0}
    with_ids = pieces.with_ids(docs(rows))
    assert set(with_ids.columns) == set(docs([]).columns) - {"text"}
    back = pieces.decode(with_ids.select("doc_id", "ids"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows)
    assert pieces.encoding_digest(docs([])).count() == 0


# --- quality ------------------------------------------------------------------------------------------------------


def brute_stats(t):
    w = split(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    x = [y for y in (t or "").split("\n") if split(y)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(x) - len(set(x)), len(hit)


def test_quality_base(docs, odd_texts):
    rows = [*odd_texts, (30, "a b c " * 30), (31, "a a a a a"), (32, "a b c d a b c"), (33, "x|y <z> #1\nx|y <z> #1\n \nx|y <z> #1"), *[(i + 100, t) for i, t, *_ in table()]]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs(rows)).collect())
    want = Counter()
    for i, t, *_ in rows:
        s = brute_stats(t)
        want[(i, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert got == want


def test_quality_outliers(docs):
    rows = [(i, prose(i, 60 + i % 90), "en", "a" if i % 3 else "b") for i in range(400)]
    rows += [(900 + i, " ".join(w + "###" for w in prose(900 + i, 80).split()), "en", "a") for i in range(30)]
    rows += [(990, prose(990, 100), None, None), (991, "$$$ " * 30 + prose(991, 100), "xx", "rare")]
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs(rows)).collect()}
    assert not any(kept[900 + i] for i in range(30)) and sum(kept[i] for i in range(400)) >= 398 and kept[990]
    out = quality.keep_good(docs(rows))
    assert out.columns == docs([]).columns and {r.doc_id for r in out.collect()} == {i for i, k in kept.items() if k}
    assert quality.quality_rules(docs([])).count() == 0
    assert {r.kept for r in quality.quality_rules(docs([(1, prose(1, 70)), (1, prose(1, 70))])).collect()} == {True}


def test_robust_estimate_against_numpy(spark):
    """The estimate of one group equals the same concentration steps in NumPy."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal([1, 2], [0.5, 1], (400, 2)), rng.normal([9, 9], 0.1, (80, 2))])
    how = quality.Robust(floors=(0.01, 0.01))
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in x], "g string, _x0 double, _x1 double")
    r = quality.estimates(df, ["g"], 2, how).first()
    up = lambda v, s: (np.floor(np.sort(v)[int(np.ceil(len(v) * s)) - 1] * quality.BINS) + 1) / quality.BINS
    m = np.array([up(x[:, i], 0.5) for i in range(2)])
    c = np.diag([max(up(abs(x[:, i] - m[i]), 0.5) * 1.4826, 0.01) ** 2 for i in range(2)])
    scale = how.share / quality.chi2_cdf(quality.chi2_tail(1 - how.share, 2), 4)
    for _ in range(how.steps):
        d = np.log1p(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))
        near = x[np.floor(d * quality.BINS) < round(up(d, how.share) * quality.BINS)]
        m, c = near.mean(0), np.cov(near.T, bias=True) * scale + np.eye(2) * 0.01**2
    low = np.linalg.cholesky(c)
    assert np.allclose([r._m0, r._m1], m) and np.allclose([r._l0_0, r._l1_0, r._l1_1], [low[0, 0], low[1, 0], low[1, 1]])
    assert abs(r._m0 - 1) < 0.2 and abs(r._m1 - 2) < 0.3


def test_chi_square():
    assert quality.chi2_tail(0.05, 1) == pytest.approx(3.841458820694124)
    assert quality.chi2_tail(0.01, 5) == pytest.approx(15.08627246938899)


# --- language models ------------------------------------------------------------------------------------------------


def test_lm_scores(spark, docs, odd_texts):
    good, bad = [(i, prose(i, 40, "aeioubcd")) for i in range(100, 130)], [(i, prose(i, 40, "xyzwvkq#")) for i in range(200, 230)]
    labels = spark.createDataFrame([(i, 1, 0, "x") for i, _ in good[:20]] + [(i, 0, 0, "x") for i, _ in bad] + [(100, 1, 1, "x"), (101, 1, 0, "x"), (7777, 1, 0, "x"), (None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    rows = [*good, *bad, *odd_texts]
    how = lm.Grams(cells=1 << 14)
    got = defaultdict(list)
    for r in lm.cross_entropy_difference(docs(rows), labels, how=how).collect():
        got[r.doc_id].append(r)
    assert max(got[i][0].score for i, _ in good) < min(got[i][0].score for i, _ in bad)
    assert got[1][0].score is None and got[2][0].n_tokens == 0 and len(got[6]) == 2
    assert sum(map(len, got.values())) == len(rows)
    none = lm.cross_entropy_difference(docs(rows), labels.filter("false"), how=how)
    assert none.filter("score <> 0").count() == 0
    assert lm.cross_entropy_difference(docs([]), labels, how=how).count() == 0


def test_lm_loss_by_hand(spark):
    """One order: minus log of the smoothed share of each character."""
    how = lm.Grams(weights=(1.0,), cells=1 << 12, smoothing=0.5)
    rows = spark.createDataFrame([(True, "aab"), (False, "abbbbb")], "good boolean, text string")
    r = lm.score(spark.createDataFrame([("ab",)], "text string"), lm.fit(rows, how), how).first()
    t = -(np.log(2.5 / 4) + np.log(1.5 / 4)) / 2
    b = -(np.log((1 * 0.5 + 0.5) / 4) + np.log((5 * 0.5 + 0.5) / 4)) / 2
    assert r.loss_target == pytest.approx(t, rel=1e-5) and r.loss_background == pytest.approx(b, rel=1e-5)
    assert r.score == pytest.approx(t - b, rel=1e-4)


def test_queries_read_every_document(spark):
    for name in ("op4_lm_scoring", "op5_pii", "op9_sentencepiece"):
        out = QUERIES[name](spark, SF)
        assert out.select(F.countDistinct("doc_id")).first()[0] == out.count() == 200
