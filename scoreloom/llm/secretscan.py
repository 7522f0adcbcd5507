"""Secrets in texts: assignment-aware lexing of source and configuration syntax.

1. A lexer cuts a text into names, string literals, bare values, operators and brackets. It knows quotes with escapes
   and prefixes, triple quotes, comments' markers as breaks, flags, element tags and user parts of addresses.
2. A parser reads name-literal pairs off the tokens: assignments and mapping entries (``=``, ``:=``, ``:``, ``=>``),
   keyed items (``x["name"] = ...``), setters and two-argument calls (``setName("...")``, ``put("name", "...")``),
   ``--name value`` flags, ``<name>...</name>`` elements, name/value attributes and ``scheme://user:...@host``.
3. Constants are propagated forwards: a name stands for the literals last assigned to it, joined by ``+``, ``.``,
   ``..``, ``&`` or by standing side by side, passed through calls, or put into ``${name}``, ``{name}`` and ``#{name}``.
4. Every literal that reaches a target is scored: how sensitive the parts of the target's name are, times how likely
   the whole value is a secret (length, kinds of characters, entropy; place holders, paths, prose and names score 0).
   Literals that reach a score of ``limit`` are reported, each with its own place.

The texts are scanned for the base patterns as a whole; the parser runs on texts that hold a sensitive part of a name
and a sign of syntax, which every pair must, or an address. ``base`` are the spans of fixed rules; all spans are the base ones and added ones
(kind ``assign``, the literal without quotes) that overlap no base span of that kind.

Defined results: a null text is empty and has no spans; repeated rows give equal spans; spans count code points, end
exclusive; an empty table gives an empty table; other columns are ignored (``find_secrets``) or carried along
(``redact``).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from scoreloom.llm.columns import columns_of

KINDS = ("assign", "access", "hex")
Span = tuple[int, int]

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A greedy run that is too short fails as a whole, and so would every later start in it: the length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def base(t: str) -> dict[str, list[Span]]:
    return {
        "assign": [m.span() for m in ASSIGN.finditer(t) if len(m[1]) >= 6],
        "access": [m.span() for m in ACCESS.finditer(t)],
        "hex": [m.span() for m in HEX.finditer(t)],
    }


# Parts of names and how sensitive they make a target; ``None`` parts make it harmless.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passwort": 1.0, "pwd": 1.0, "passphrase": 1.0, "contraseña": 1.0, "motdepasse": 1.0, "pass": 0.8, "pw": 0.6, "pin": 0.5,
    "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "signingkey": 1.0, "encryptionkey": 1.0, "authkey": 1.0,
    "credential": 0.9, "credentials": 0.9, "creds": 0.9, "bearer": 0.9, "authorization": 0.8, "auth": 0.6, "signature": 0.6, "salt": 0.6, "dsn": 0.6, "connectionstring": 0.7,
}
PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("auth", "key"), ("master", "key"), ("shared", "key"), ("connection", "string"), ("mot", "passe")}
HARMLESS = {"count", "length", "len", "size", "max", "min", "limit", "name", "type", "field", "label", "hint", "prompt", "url", "uri", "path", "file", "dir", "regex", "pattern", "policy", "expiry", "expires", "expiration", "ttl", "format", "header", "column", "enabled", "required", "valid", "index", "id", "placeholder", "message", "error", "text", "title"}
SYNTAX = re.compile(r"[=:(<]|--")
STEM = re.compile(r"pass|pwd|pw|pin|secret|token|key|cred|bearer|auth|signature|salt|dsn|connection|contraseña", re.IGNORECASE)
PLACE_HOLDER = re.compile(r"(?:x+|\*+|\.+|-+|_+|0+|1?2?3?4?5?6?7?8?9?0?|(?:your|my|the|some|insert|enter|example|sample|dummy|test|fake|change|replace|todo|none|null|nil|undefined|true|false|empty|redacted|hidden|masked|removed|secret|password|passwd|token|default|changeme|string|value|key|here|placeholder)(?:[-_ .]?[A-Za-z]+)*)\Z", re.IGNORECASE)
TEMPLATE = re.compile(r"(?:\$\{[^}]*\}|\$\([^)]*\)|\{\{[^}]*\}\}|<[^>]*>|%[A-Za-z_]+%|\$[A-Za-z_][A-Za-z0-9_]*|%[sd])\Z")
NAME_LIKE = re.compile(r"[A-Za-z][A-Za-z]*(?:[-_.:/ ][A-Za-z]+)*\Z")
WORDS = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|[0-9]+")


def name_score(name: str) -> float:
    """How sensitive a target is: its most sensitive part, nothing if a part behind it makes it harmless."""
    parts = [w.lower() for w in WORDS.findall(name)]
    best, at = 0.0, -1
    for i, w in enumerate(parts):
        s = SENSITIVE.get(w, SENSITIVE.get(w[:-1], 0.0) if w.endswith("s") else 0.0)
        if i and (parts[i - 1], w) in PAIRS:
            s = 1.0
        if s > 0 and s >= best:
            best, at = s, i
    if any(w in HARMLESS for w in parts[at + 1 :]) or (parts and parts[0] in ("max", "min", "num", "count", "is", "has", "no")):
        return 0.0
    return best


def value_score(v: str) -> float:
    """How likely a whole value is a secret, 0 to 1."""
    if len(v) < 6 or len(v) > 4096 or PLACE_HOLDER.match(v) or TEMPLATE.match(v):
        return 0.0
    if any(c.isspace() for c in v):
        # A phrase of several words is prose unless it is a block of encoded key material.
        return 1.0 if "PRIVATE KEY-----" in v or re.fullmatch(r"[A-Za-z]+ [A-Za-z0-9+/_.=-]{16,}", v) else 0.0
    if re.match(r"[a-z][a-z0-9+.-]*://[^:@/]*(?:/|\Z)|\.{0,2}/[A-Za-z]", v):
        return 0.0
    kinds = sum(bool(re.search(p, v)) for p in (r"[a-zß-ÿ]", r"[A-ZÀ-Þ]", r"[0-9]", r"[^\w]"))
    n = Counter(v)
    entropy = -sum(c / len(v) * math.log2(c / len(v)) for c in n.values())
    if NAME_LIKE.match(v) and kinds < 3 and entropy < 3.6:
        return 0.45 if len(v) >= 8 and v.isalpha() else 0.2
    return min(1.0, 0.25 + 0.15 * kinds + 0.12 * max(0.0, entropy - 1.5) + 0.01 * min(len(v), 20))


TOKEN = re.compile(
    r"""(?P<nl>\r?\n|;)
    |(?P<triple>(?<!\w)[bBrRfFuU]{0,2}(?:\"{3}(?P<t1>(?:[^\\"]|\\.|"(?!""))*+)\"{3}|'{3}(?P<t2>(?:[^\\']|\\.|'(?!''))*+)'{3}))
    |(?P<string>(?<!\w)[bBrRfFuU@$]{0,2}(?:"(?P<s1>(?:[^"\\\n]|\\.)*+)"|'(?P<s2>(?:[^'\\\n]|\\.)*+)'|`(?P<s3>(?:[^`\\\n]|\\.)*+)`))
    |(?P<tag></?[A-Za-z_][\w.:-]*+)
    |(?P<flag>(?<![\w-])--[A-Za-z][\w-]*+)
    |(?P<name>[$@]?[^\W\d]\w*+(?:(?:\.|->|::|-(?=[^\W\d]))[$]?[^\W\d]\w*+)*)
    |(?P<op>===?|!==?|<=|>=|=>|:=|\?\?=|\|\|=|\?=|\+=|\.\.|[=:+&.,()\[\]{}<>])
    |(?P<bare>[^\s"'`=:+&,()\[\]{}<>;]+)
    """, re.VERBOSE | re.DOTALL)
USER = re.compile(r"""://[^\s:/@"'<>]{0,200}:([^\s/@"'<>]{1,400})@""")
ASSIGNS = {"=", ":=", ":", "=>", "?=", "||=", "??=", "+="}
JOINS = {"+", ".", "..", "&"}
FILLED = re.compile(r"[$#]\{\s*([A-Za-z_]\w*)\s*\}|\{\s*([A-Za-z_]\w*)\s*\}|\$([A-Za-z_]\w*)")
LINE_VALUE = re.compile(r"[ \t]*([^\s\"'`#;,<>(){}\[\]][^\s\"'`;,<>(){}]*)[ \t]*(?:[#;].*)?(?=\r?$)", re.MULTILINE)
LINE_KEY = re.compile(r"(?:^|\n)[ \t]*(?:-[ \t]+|export[ \t]+|set[ \t]+|ENV[ \t]+|[#/*]+[ \t]*)?\Z")
VARIABLE = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*")
ELEMENT = re.compile(r"\s*([^\s<>&][^<>\n]{0,400}?)\s*</")


@dataclass
class Token:
    kind: str
    start: int
    end: int
    text: str


@dataclass
class Value:
    """A constant: its text, and the literals that it is made of."""

    text: str = ""
    parts: list[Span] = field(default_factory=list)

    def __add__(self, other: Value) -> Value:
        return Value(self.text + other.text, self.parts + other.parts)


def lex(t: str) -> list[Token]:
    out = []
    for m in TOKEN.finditer(t):
        kind = m.lastgroup or ""
        for outer in ("triple", "string"):
            if m[outer] is not None:
                kind = outer
        if kind in ("triple", "string"):
            g = next(x for x in (("t1", "t2") if kind == "triple" else ("s1", "s2", "s3")) if m[x] is not None)
            out.append(Token("literal", *m.span(g), m[g]))
        else:
            out.append(Token(kind, *m.span(), m[0]))
    return out


class Parser:
    """Reads pairs of a target and a constant off the tokens, in order, keeping the constants of names."""

    def __init__(self, t: str):
        self.t, self.tokens, self.known = t, lex(t), {}
        self.read: dict[tuple[int, int], tuple[Value | None, int]] = {}
        self.pairs: list[tuple[str, Value]] = [("password", Value(m[1], [m.span(1)])) for m in USER.finditer(t)]

    def at(self, i: int) -> Token:
        return self.tokens[i] if 0 <= i < len(self.tokens) else Token("end", len(self.t), len(self.t), "")

    def literal(self, tok: Token) -> Value:
        """A literal with the constants put in that it names."""
        out, done = Value(), tok.start
        for m in FILLED.finditer(tok.text):
            name = next(g for g in m.groups() if g)
            if name in self.known:
                if tok.start + m.start() > done:
                    out += Value(self.t[done : tok.start + m.start()], [(done, tok.start + m.start())])
                out += self.known[name]
                done = tok.start + m.end()
        return out + Value(self.t[done : tok.end], [(done, tok.end)]) if done < tok.end else out

    def term(self, i: int, deep: int) -> tuple[Value | None, int]:
        tok = self.at(i)
        if tok.kind == "literal":
            out, i = self.literal(tok), i + 1
            while True:  # side by side, in brackets also on the next lines
                j = i
                while deep and self.at(j).kind == "nl":
                    j += 1
                if self.at(j).kind != "literal":
                    return out, i
                out, i = out + self.literal(self.at(j)), j + 1
        if tok.kind == "name":
            nxt = self.at(i + 1)
            if nxt.text == "(" and nxt.start == tok.end and deep < 8:
                return self.arguments(i + 2, deep + 1)
            return self.known.get(tok.text.lstrip("$@").split(".")[-1]), i + 1
        if tok.text == "(" and deep < 8:
            return self.arguments(i + 1, deep + 1)
        return None, i + 1

    def arguments(self, i: int, deep: int) -> tuple[Value | None, int]:
        """The last constant up to the closing bracket, a block or a semicolon. Every place is read once for each depth,
        with the constants known then."""
        seen: list[int] = []
        out, last = None, -1
        while True:
            tok = self.at(i)
            if (i, deep) in self.read:
                more, end = self.read[i, deep]
                out, last = (more, i) if more is not None else (out, last)
                break
            if tok.kind == "end" or tok.text in (")", "{", "}", ";"):
                end = i + (tok.text == ")")
                break
            seen.append(i)
            if tok.kind == "nl" or tok.text == ",":
                i += 1
                continue
            got, j = self.expression(i, deep)
            out, last, i = (got, i, j) if got is not None else (out, last, j)
        for p in seen:
            self.read[p, deep] = (out if p <= last else None), end
        return out, end

    def expression(self, i: int, deep: int = 0) -> tuple[Value | None, int]:
        out, i = self.term(i, deep)
        while self.at(i).text in JOINS and self.at(i).kind == "op":
            more, i = self.term(i + 1, deep)
            out = out + more if out is not None and more is not None else out if more is None else more
        return out, i

    def target(self, i: int) -> str | None:
        """The name that an assignment at token i is made to."""
        tok = self.at(i)
        if tok.kind in ("name", "flag", "literal"):
            return tok.text.lstrip("$@-")
        if tok.text == "]" and self.at(i - 1).kind == "literal":
            return self.at(i - 1).text
        return None

    def line_value(self, key: Token, i: int) -> Value | None:
        """The rest of a line that starts with a key: configuration without quotes."""
        m = LINE_VALUE.match(self.t, self.at(i).end)
        if not m or not LINE_KEY.search(self.t, max(0, key.start - 40), key.start):
            return None
        if VARIABLE.fullmatch(m[1]) and not (m[1].isalnum() and (len(m[1]) >= 16 or all(re.search(p, m[1]) for p in ("[a-z]", "[A-Z]", "[0-9]")))):
            return None
        return Value(m[1], [m.span(1)])

    def put(self, name: str, value: Value | None, tok: Token) -> None:
        own = name.split(".")[-1].split("->")[-1].split("::")[-1]
        if value is None or not value.parts:
            self.known.pop(own, None)
            return
        self.pairs.append((name, value))
        if tok.text == "+=" and own in self.known:
            value = self.known[own] + value
            self.pairs.append((name, value))
        self.known[own] = value

    def run(self) -> list[tuple[str, Value]]:
        i = 0
        while i < len(self.tokens):
            tok, nxt = self.at(i), self.at(i + 1)
            if tok.kind == "op" and tok.text in ASSIGNS:
                name = self.target(i - 1)
                if name:
                    value, j = self.expression(i + 1)
                    if value is None and self.at(i - 1).kind == "name":
                        value = self.line_value(self.at(i - 1), i)
                    self.put(name, value, tok)
                    i += 1  # nested entries are read as well
                    continue
            elif tok.kind == "flag" and nxt.kind in ("literal", "name", "bare") and nxt.start == tok.end + 1:
                end = re.compile(r"\S*").match(self.t, nxt.start).end() if nxt.kind != "literal" else nxt.end
                self.put(tok.text.lstrip("-"), Value(self.t[nxt.start : end], [(nxt.start, end)]), tok)
            elif tok.kind == "name" and nxt.text == "(" and nxt.start == tok.end:
                last = WORDS.findall(tok.text)
                if last and last[0].lower() in ("set", "with", "put", "add", "define", "append") or "set" in (w.lower() for w in last):
                    value, _ = self.arguments(i + 2, 1)
                    if value is not None:
                        self.pairs.append((tok.text, value))
                if self.at(i + 2).kind == "literal" and self.at(i + 3).text == ",":
                    value, _ = self.expression(i + 4)
                    if value is not None:
                        self.pairs.append((self.at(i + 2).text, value))
            elif tok.kind == "tag" and not tok.text.startswith("</"):
                self.element(tok, i)
            i += 1
        return self.pairs

    def element(self, tok: Token, i: int) -> None:
        if self.at(i + 1).text == ">":
            m = ELEMENT.match(self.t, self.at(i + 1).end)
            if m:
                self.pairs.append((tok.text[1:], Value(m[1], [m.span(1)])))
            return
        attributes, j = {}, i + 1
        while self.at(j).kind not in ("end", "tag") and self.at(j).text != ">" and j < i + 64:
            if self.at(j).kind == "name" and self.at(j + 1).text == "=" and self.at(j + 2).kind == "literal":
                attributes[self.at(j).text.lower()] = self.at(j + 2)
                j += 2
            j += 1
        key = next((attributes[k] for k in ("key", "name", "id") if k in attributes), None)
        if key and "value" in attributes:
            self.pairs.append((key.text, self.literal(attributes["value"])))


@dataclass(frozen=True)
class Scan:
    """``limit``: score from which a literal is reported. ``least``: characters of a value."""

    limit: float = 0.5


def added(t: str, plain: list[Span], how: Scan) -> list[Span]:
    """Literals that reach sensitive targets and overlap no base span."""
    if not (STEM.search(t) and SYNTAX.search(t)) and "://" not in t:
        return []
    best: dict[Span, float] = {}
    for name, value in Parser(t).run():
        sensitive = name_score(name)
        if sensitive:
            score = sensitive * value_score(value.text)
            for part in value.parts:
                best[part] = max(best.get(part, 0.0), score)
    out: list[Span] = []
    taken = sorted(plain)
    for a, b in sorted(s for s, score in best.items() if score >= how.limit and s[0] < s[1]):
        if not (out and a < out[-1][1]) and not any(a < y and x < b for x, y in taken):
            out.append((a, b))
    return out


def told(spans: dict[str, list[Span]]) -> str:
    every = sorted((a, r, b) for r, k in enumerate(KINDS) for a, b in spans[k])
    return ",".join(f"{KINDS[r]}:{a}:{b}" for a, r, b in every)


def scan(t: str, how: Scan = Scan()) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and all spans."""
    plain = base(t)
    return plain, plain | {"assign": plain["assign"] + added(t, plain["assign"], how)}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", how: Scan = Scan()) -> DataFrame:
    """id, base counts per kind, base_sha256, spans, n_added of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in batch.column(1):
                plain, every = scan(t.as_py() or "", how)
                row = [*(len(plain[k]) for k in KINDS), hashlib.sha256(told(plain).encode()).hexdigest(), told(every), len(every["assign"]) - len(plain["assign"])]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return columns_of(docs, id_col, text).mapInArrow(run, f"`{id_col}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def redacted(t: str, how: Scan) -> str:
    _, every = scan(t, how)
    out, done = [], 0
    for a, b in sorted(s for v in every.values() for s in v):
        if a >= done:
            out += [t[done:a], "<secret>"]
        done = max(done, b)
    return "".join(out) + t[done:]


def redact(docs: DataFrame, text: str = "text", how: Scan = Scan()) -> DataFrame:
    """``docs`` with every span replaced by a mark."""
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[place] = pa.array([None if (t := x.as_py()) is None else redacted(t, how) for x in cols[place]], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
