"""Two tokenizers held against each other, by hand."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scoreloom.llm import tokalign
from scoreloom.llm.tokalign import Pairing

from .conftest import prose


def brute_groups(text, how):
    """[(a ids, b ids)] of a text, token by token."""
    (ta, sa), (tb, sb) = tokalign.byte_tokenizer(how.a), tokalign.piece_tokenizer(how.b)
    if not text:
        return []
    a, b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)

    def spelled(side, ids):
        return [side.flat[side.at[i] : side.at[i] + side.length[i]].tobytes() for i in ids]

    wa, wb = spelled(sa, a), spelled(sb, b)
    if not b"".join(wa) == b"".join(wb) == (" " + text).encode():
        return []
    out, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            out[-1][0].append(a[i])
            x += len(wa[i])
            i += 1
        else:
            out[-1][1].append(b[j])
            y += len(wb[j])
            j += 1
        if x == y and i and j and out[-1][0] and out[-1][1]:
            out.append(([], []))
    return out[:-1]


def brute(rows, how):
    groups = [brute_groups(r[1], how) for r in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    docs = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    out = []
    for r, g, c in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((r[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if docs[p] == top[p[0]]),
                    sum(n * docs[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


ODD = ["a▁b", "<|endoftext|> and <s> </s> <unk>", "  two  spaces \n\n\t tab", "naïve 東京 \U0001f600\U0001f1e9\U0001f1ea \x00 é", "x" * 700, "aaaaaaab" * 40, "don't  stop1234567890", "́​", "ſecret K"]


@pytest.mark.parametrize("piece,heavy,block", [(3, 1, 5), (64, 40, 64), (1 << 16, 100_000, 1 << 22)])
def test_alignment_is_that_of_each_token(docs, odd_texts, piece, heavy, block):
    how = Pairing(piece=piece, heavy=heavy, block=block)
    rows = [*(r for r in odd_texts if len(r[1] or "") < 60_000), *((100 + i, t) for i, t in enumerate(ODD)), *((200 + i, prose(i % 9, 60)) for i in range(15))]
    got = sorted(map(tuple, tokalign.alignment_digest(docs(rows), how=how).collect()), key=str)
    assert got == sorted(brute(rows, how), key=str)
    assert tokalign.alignment_digest(docs([]), how=how).count() == 0


def test_groups_and_id_pairs(docs):
    how, rows = Pairing(), [(1, "Some words, dénommés ça"), (2, ""), (3, None), (4, "Some other words")]
    out = {r.doc_id: r.groups for r in tokalign.token_groups(docs(rows)).collect()}
    assert out[2] == [] and out[3] == []
    for i, text in ((1, rows[0][1]), (4, rows[3][1])):
        assert [(list(g.a), list(g.b)) for g in out[i]] == brute_groups(text, how)
        assert [g.start for g in out[i]] == [0] + [g.end for g in out[i]][:-1] and out[i][-1].end == len((" " + text).encode())
    pairs = {(r.a, r.b): (r.n, r.best) for r in tokalign.id_pairs(docs(rows)).collect()}
    both = brute_groups("Some", how)[0]
    assert pairs[both[0][0], both[1][0]] == (2, True)


def test_diagonals_give_equal_pieces():
    r = random.Random(3)
    for _ in range(200):
        a, b = (np.array(sorted(r.sample(range(60), r.randint(1, 40)))) for _ in "ab")
        size = r.randint(1, 12)
        i, j = tokalign.splits(a, b, size)
        work = np.diff(i) + np.diff(j)
        assert (i[0], j[0], i[-1], j[-1]) == (0, 0, len(a), len(b)) and work.max() <= size + 1 and (np.diff(j) >= 0).all()
        ends = tokalign.groups(a, b, size)
        same = np.intersect1d(a, b)
        assert a[ends[0][1:] - 1].tolist() == b[ends[1][1:] - 1].tolist() == same.tolist()
