"""Personal data in disguise: offset-preserving normalisation, detection, and mapping back.

A transducer turns a text into a normalised one and remembers, for each character of it, the span of source
characters that it stands for: look-alike letters and digits become ASCII, invisible characters vanish, spelled
digits become digits, and ``at``/``dot`` disguises become ``@`` and ``.``. Identifiers are found in the normalised
text and their spans are mapped back. Only stretches around a hint (a disguise word, a look-alike next to an
identifier character) are normalised, with all the text that an identifier touching the hint could span.

``base`` finds plain identifiers by fixed rules; all spans are the base ones and, where they overlap no base
span of their kind, those that normalisation adds.

Defined results: a null text is empty and has no spans; repeated rows give equal spans; spans count code points,
end exclusive; an empty table gives an empty table; columns other than the named ones are ignored (``find_pii``)
or carried along (``redact``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.columns import columns_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# The local part is sought leftwards from each @, and digits only from the start of a run: both give the leftmost
# matches of the plain patterns, in time linear in the text.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(t: str) -> list[Span]:
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        a = at
        while a > done and t[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(t, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)  # no later match can begin before a failed @
        at = t.find("@", max(at + 1, done))
    return out


def ips(t: str) -> list[Span]:
    return [m.span() for m in IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]


def cards(t: str) -> list[Span]:
    return [m.span() for m in CARD.finditer(t) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]


def phones(t: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(t) if 9 <= len(digits_of(m[0])) <= 15]


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base(t: str) -> dict[str, list[Span]]:
    return {k: f(t) for k, f in FINDERS.items()}


# Letters of other scripts that look like ASCII ones, by Unicode name.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "－": "-", "＋": "+", "＿": "_", "（": "(", "）": ")", " ": " ", " ": " ", " ": " ", "　": " ",
    **{chr(0xFF10 + i): str(i) for i in range(10)}, **{chr(0xFF21 + i): chr(65 + i) for i in range(26)}, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)},
    **{chr(0x0660 + i): str(i) for i in range(10)}, **{chr(0x06F0 + i): str(i) for i in range(10)}, **{chr(0x0966 + i): str(i) for i in range(10)}, **{chr(0x1D7CE + i): str(i % 10) for i in range(50)},
})
INVISIBLE = "​‌‍⁠﻿­᠎"
# Digit words of the corpus's languages.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_AT = r"\s{0,3}[\[({<]\s{0,3}(?:at|@|arroba|ät)\s{0,3}[\])}>]\s{0,3}|(?<=[A-Za-z0-9])\s{1,3}(?:at|@|arroba)\s{1,3}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[-_](?:at|AT)[-_](?=[A-Za-z0-9])"
_DOT = r"\s{0,3}[\[({<]\s{0,3}(?:dot|\.|punto|punkt|point)\s{0,3}[\])}>]\s{0,3}|(?<=[A-Za-z0-9])\s{1,3}(?:dot|punto|punkt|point)\s{1,3}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[-_](?:dot|DOT)[-_](?=[A-Za-z0-9])"
DISGUISE = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.IGNORECASE)
SPELLED = re.compile(rf"\b(?:{_WORD})\b(?:[\s,.-]{{0,3}}\b(?:double |triple )?(?:{_WORD})\b|[\s,.-]{{0,3}}[0-9]+)+", re.IGNORECASE)
SPELLED_PLUS = re.compile(r"\bplus\s{1,3}\Z", re.IGNORECASE)
EACH = re.compile(rf"(?P<n>double |triple )?\b(?P<w>{_WORD})\b|(?P<d>[0-9])", re.IGNORECASE)
# A disguise word, a spelled run or a look-alike may be present at all. Hints take in all that DISGUISE and SPELLED rewrite,
# but for a spaced ``at`` without a domain behind it; a disguised domain has hints of its own.
HINT = re.compile(r"[\[({<]\s{0,3}(?:at|@|arroba|ät|dot|\.|punto|punkt|point)\s{0,3}[\])}>]|\s(?:(?:dot|punto|punkt|point)\s|(?:at|@|arroba)\s{1,3}(?=[A-Za-z0-9-]++\.[A-Za-z0-9-]))|[-_](?:at|dot)[-_]", re.IGNORECASE)
ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(LOOKALIKES)) + INVISIBLE + "]")
SPELLED_HINT = re.compile(rf"\b(?:{_WORD})\b[\s,.-]{{0,3}}(?:\b(?:double |triple )?(?:{_WORD})\b|[0-9])", re.IGNORECASE)


class Tape:
    """Normalised characters, each with the source span that it stands for."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.start, self.end = text, list(range(at, at + len(text))), list(range(at + 1, at + len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the current text, given in order; a replacement stands for the whole span."""
        if not edits:
            return
        parts, start, end, done = [], [], [], 0
        for a, b, new in edits:
            if a < done:
                continue
            parts += [self.text[done:a], new]
            start += self.start[done:a] + [self.start[a]] * len(new)
            end += self.end[done:a] + [self.end[b - 1]] * len(new)
            done = b
        parts.append(self.text[done:])
        self.text, self.start, self.end = "".join(parts), start + self.start[done:], end + self.end[done:]

    def back(self, span: Span) -> Span:
        return self.start[span[0]], self.end[span[1] - 1]


def normalise(t: str, at: int = 0) -> Tape:
    tape = Tape(t, at)
    tape.rewrite([(m.start(), m.end(), "") for m in re.finditer(f"[{INVISIBLE}]", tape.text)])
    tape.text = tape.text.translate(LOOKALIKES)  # one character for one
    edits = []
    for m in SPELLED.finditer(tape.text):
        plus = SPELLED_PLUS.search(tape.text, max(0, m.start() - 8), m.start())
        if plus:
            edits.append((plus.start(), m.start(), "+"))
        for w in EACH.finditer(tape.text, m.start(), m.end()):
            if w["w"]:
                times = {"double ": 2, "triple ": 3}.get((w["n"] or "").lower(), 1)
                edits.append((w.start(), w.end(), DIGITS[w["w"].lower()] * times))
    tape.rewrite(edits)
    edits = [(m.start(), m.end(), " ") for m in re.finditer(r"(?<=[0-9])[\s,]{1,3}(?=[0-9])", tape.text)] if edits else []
    tape.rewrite(edits)
    tape.rewrite([(m.start(), m.end(), "@" if m["at"] else ".") for m in DISGUISE.finditer(tape.text)])
    return tape


REACH = 160


def stretches(t: str) -> list[Span]:
    """Parts of a text worth normalising: around each hint, as far as text without a break reaches."""
    hints = [m.span() for p in (HINT, SPELLED_HINT) for m in p.finditer(t)]
    if not t.isascii():
        hints += [m.span() for m in ODD.finditer(t)]
    out: list[list[int]] = []
    for a, b in sorted(hints):
        a, b = max(0, a - REACH), min(len(t), b + REACH)
        while a > 0 and not t[a - 1].isspace():
            a -= 1
        while b < len(t) and not t[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


TOP = re.compile(r"[A-Za-z]{2,24}\Z")


def added(t: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only normalisation shows."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    for a, b in stretches(t):
        tape = normalise(t[a:b], a)
        if tape.text == t[a:b]:
            continue
        for kind, find in FINDERS.items():
            for s in find(tape.text):
                x, y = tape.back(s)
                new = tape.text[s[0] : s[1]]
                if new == t[x:y] or (kind == "email" and not TOP.search(new)):
                    continue
                if not any(x < q and p < y for p, q in plain[kind]) and not any(x < q and p < y for p, q in out[kind]):
                    out[kind].append((x, y))
    return out


def told(spans: dict[str, list[Span]]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    every = sorted((a, rank[k], b) for k, v in spans.items() for a, b in v)
    return ",".join(f"{KINDS[r]}:{a}:{b}" for a, r, b in every)


def scan(t: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    plain = base(t)
    more = added(t, plain)
    return plain, {k: plain[k] + more[k] for k in KINDS}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, base counts per kind, base_sha256, spans, n_added of every row."""
    schema = f"`{id_col}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in batch.column(1):
                plain, every = scan(t.as_py() or "")
                row = [*(len(plain[k]) for k in KINDS), hashlib.sha256(told(plain).encode()).hexdigest(), told(every), sum(map(len, every.values())) - sum(map(len, plain.values()))]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return columns_of(docs, id_col, text).mapInArrow(run, schema)


def redacted(t: str) -> str:
    _, every = scan(t)
    out, done = [], 0
    for a, b, k in sorted((a, b, k) for k, v in every.items() for a, b in v):
        if a >= done:
            out += [t[done:a], f"<{k}>"]
            done = b
        done = max(done, b)
    return "".join(out) + t[done:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind."""
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[place] = pa.array([None if (t := x.as_py()) is None else redacted(t) for x in cols[place]], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
