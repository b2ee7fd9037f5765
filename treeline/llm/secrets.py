"""Secret scans: fixed base patterns plus assignment-aware lexing.

The lexer cuts source and configuration text into strings, names, operators and
comments and parses these into name-literal pairs: assignments with and without a
type, entries, arguments of calls, flags, elements and attributes, with literals
that are joined or wrapped. Names that are bound to a literal anywhere in the text
stand for it, through any number of steps. Each pair is scored by how sensitive its
name is and by whether the literal looks like generated material rather than a
placeholder.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, their order and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run that is shorter would be dropped
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "lexed")

#: Points of a name's words; two-word names add up. A literal is reported from LEXED_LEAST points.
NAME_POINTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "passcode": 3.0, "secret": 3.0,
    "token": 2.5, "credential": 2.5, "credentials": 2.5, "apikey": 3.0, "bearer": 2.0, "auth": 1.5,
    "authorization": 2.0, "private": 1.5, "access": 1.0, "api": 1.0, "client": 0.5, "key": 1.5,
    "signing": 1.5, "encryption": 1.5, "session": 0.5, "dsn": 1.5, "salt": 1.0, "cookie": 1.0,
}
LEXED_LEAST = 4.0
LITERAL_LEAST = 6

_TOKEN = re.compile(
    r"""(?P<block>/\*.*?\*/|<!--.*?-->)
    |(?P<line>(?<![:\w/])//|(?<!\S)\#+(?=[\x20\t!]))
    |(?P<element><(?P<tag>[A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>(?P<body>[^<>]*)</(?P=tag)\s*>)
    |(?<![A-Za-z0-9_])[A-Za-z]{0,3}(?P<hashes>\#{1,8})"(?P<hashed>.*?)"(?P=hashes)
    |(?<![A-Za-z0-9_])[A-Za-z]{0,2}(?P<triple>\"{3}|'{3})(?P<long>(?:\\.|(?!(?P=triple))[^\\])*)(?P=triple)
    |(?<![A-Za-z0-9_])[A-Za-z@$]{0,2}(?P<quote>["'])(?P<short>(?:\\.|(?!(?P=quote))[^\\\n])*)(?P=quote)
    |`(?P<tick>(?:\\.|[^`\\])*)`
    |(?P<name>[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_][\w$]*)*)
    |(?P<op>=>|:=|::|->|[=!<>+\-*/%&|^~?]{2,}|=|:|\+)
    |(?P<end>\n)
    |(?P<mark>[^\w\s])""",
    re.X | re.S,
)
_BARE = re.compile(r"""[ \t]*([^\s"'`,;(){}<>\[\]&|]+)""")
_FLAG_VALUE = re.compile(r"""[ \t]+(?!-)([^\s"'`,;(){}<>\[\]&|]+)""")
#: Calls whose argument says where to look, not what the secret is.
_LOOKUP = re.compile(r"(?i)get|env|read|input|prompt|load|fetch|find|lookup|require|open|config|param|ask|select|query")
#: Attributes that name what the attribute after them holds.
_KEYS = frozenset({"key", "name", "id", "property"})
#: Operators that bind, and those that compare with a value worth the same care.
_BINDS, _COMPARES = "= := => += ||= ??=", "== != === !=="
#: What stands before another choice of a value.
_CHOICES = frozenset({"?", ":", "or", "||", "??", "else"})
_IDENTIFIER = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.]*)\}?\Z")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)(?:x+|\*+|\.+|0+|1234\w*|change_?me|example|sample|placeholder|your[_-].*|none|null|true|false|todo|redacted|<.*>|\$\{.*\}|%\(.*\)s|\{\{.*\}\})\Z")
#: Words with points that no shorter one is part of.
_ROOTS = [w for w in sorted(NAME_POINTS) if not any(v != w and v in w for v in NAME_POINTS)]
def name_points(name: str) -> float:
    """How sensitive a target name is, from its words."""
    words = (w.lower() for w in _WORDS.findall(name))
    return sum(NAME_POINTS.get(w, NAME_POINTS.get(w[:-1], 0.0) if w.endswith("s") else 0.0) for w in words)


def literal_points(value: str) -> float:
    """How much a literal looks like generated material: 0 to 2, or minus infinity for placeholders."""
    if len(value) < LITERAL_LEAST or _PLACEHOLDER.match(value) or value.isspace():
        return -math.inf
    counts = Counter(value)
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    digits = any("0" <= c <= "9" for c in value)
    return min(1.0, bits / 3.0) * (0.5 if " " in value else 1.0) + (0.5 if digits else 0.0) + (0.5 if len(value) >= 16 and digits else 0.0)


Part = tuple[int, int, bool]


@dataclass
class _Token:
    kind: str  # text (a string), name, op, end (of a line), mark
    text: str
    start: int
    end: int


@dataclass
class _Pair:
    """A name and what it is bound to: spans of literals and of names of other constants (True), in order."""

    name: str
    at: int
    parts: list[Part]


def _tokens(text: str, start: int, end: int) -> tuple[list[_Token], list[_Pair], list[tuple[int, int]]]:
    """Tokens, pairs of elements, and bodies of comments."""
    out, pairs, comments = [], [], []
    for m in _TOKEN.finditer(text, start, end):
        kind = m.lastgroup
        if m["block"] is not None:
            comments.append((m.start() + 2, m.end()))
        elif m["element"] is not None:
            a, b = m.span("body")
            body = text[a:b]
            a, b = a + len(body) - len(body.lstrip()), b - len(body) + len(body.rstrip())
            if a < b:
                pairs.append(_Pair(m["tag"], m.start(), [(a, b, False)]))
            comments.append((m.start() + 1, m.start("body")))  # its attributes
        elif m["line"] is not None:
            out.append(_Token("end", "", m.start(), m.end()))
        elif m["end"] is not None:
            out.append(_Token("end", "", m.start(), m.end()))
        elif m["name"] is not None or m["op"] is not None or m["mark"] is not None:
            kind = "name" if m["name"] is not None else "op" if m["op"] is not None else "mark"
            out.append(_Token(kind, m[0], m.start(), m.end()))
        else:
            group = next(g for g in ("hashed", "long", "short", "tick") if m[g] is not None)
            out.append(_Token("text", m[group], *m.span(group)))
    return out, pairs, comments


class _Reader:
    """Reads the tokens of one text into pairs."""

    def __init__(self, text: str, tokens: list[_Token]):
        self.text, self.tokens, self.typed = text, tokens, None

    def is_mark(self, k: int, marks: str) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind in ("mark", "op") and self.tokens[k].text in marks.split()

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def past_ends(self, k: int) -> int:
        while self.kind(k) == "end":
            k += 1
        return k

    def operand(self, k: int) -> tuple[list[Part], int, bool]:
        """A literal or a name, or the place after a call's bracket (True); nothing where it is none of these."""
        if self.kind(k) == "text":
            t = self.tokens[k]
            k += 1
            while self.is_mark(k, ".") and self.kind(k + 1) == "name" and self.is_mark(k + 2, "(") and self.is_mark(k + 3, ")"):
                k += 4  # a conversion such as .to_string()
            return [(t.start, t.end, False)], k, False
        if self.kind(k) != "name":
            return [], k, False
        name, k = self.tokens[k], k + 1
        while self.is_mark(k, "::") and self.kind(k + 1) == "name":
            name, k = self.tokens[k + 1], k + 2
        if self.is_mark(k, "("):
            return ([], k, False) if _LOOKUP.search(name.text) else ([], self.past_ends(k + 1), True)
        return ([], k, False) if self.is_mark(k, "[ {") else ([(name.start, name.end, True)], k, False)

    def joined(self, k: int, last: Part) -> int | None:
        """Where the next operand begins, if one is joined to the last by + or stands beside it."""
        after = self.past_ends(k)
        if self.is_mark(after, "+ . .. ++ <> &") and (self.kind(self.past_ends(after + 1)) == "text" or self.is_mark(after, "+")):
            return self.past_ends(after + 1)
        return after if not last[2] and self.kind(after) == "text" and not self.is_entry(after) else None

    def value(self, k: int) -> tuple[list[Part], int]:
        """Operands that are joined, each in any number of brackets and calls; (parts, where they end)."""
        calls: list[tuple[list[Part], int, int]] = []  # of every open call: parts before it, where they ended, brackets around it
        parts, end, at = [], k, k
        while True:
            wraps = 0
            while self.is_mark(at, "& * ( ["):
                wraps, at = wraps + 1, self.past_ends(at + 1)
            new, stop, called = self.operand(at)
            if called:
                calls.append((parts, end, wraps))
                parts, end, at = [], stop, stop
                continue
            while True:
                for _ in range(wraps):
                    stop += self.is_mark(stop, ") ]")
                if new:
                    parts += new
                    end = stop
                    if (follows := self.joined(end, parts[-1])) is not None:
                        at = follows
                        break
                if not calls:
                    return parts, end
                within, inner_end = parts, end
                parts, end, wraps = calls.pop()
                new, stop = (within, inner_end + 1) if within and self.is_mark(self.past_ends(inner_end), ")") else ([], inner_end)

    def is_entry(self, k: int) -> bool:
        """Whether the string is the key of the next entry."""
        return self.is_mark(k + 1, ": = =>")

    def bound(self, k: int) -> list[Part]:
        """What stands after an operator: a value, or a bare word up to the next space or mark."""
        op = self.tokens[k - 1]
        after = self.past_ends(k)
        parts, _ = self.value(after if self.kind(after) == "text" or self.is_mark(after, "( [") else k)
        if parts and not parts[0][2]:
            return parts
        bare = _BARE.match(self.text, op.end)
        if not bare:
            return parts
        named = _IDENTIFIER.match(bare[1])
        if named and (not parts or len(parts) == 1):
            return [(*(x + bare.start(1) for x in named.span(1)), True)]
        return parts if len(parts) > 1 else [(*bare.span(1), False)]

    def after_type(self, k: int) -> int:
        """Where a type that begins here ends in an assignment, else 0."""
        if self.typed is None:
            self.typed = self._types()
        return self.typed[k] if k < len(self.typed) and self.typed[k] > k else 0

    def _types(self) -> list[int]:
        """For every token, where a type from there on meets its assignment; one pass from the end, brackets skipped whole."""
        n, step = len(self.tokens), {"[": 1, "(": 1, "<": 1, "]": -1, ")": -1, ">": -1, ">>": -2}
        found, depth = [0] * (n + 1), [0] * (n + 1)
        for k, t in enumerate(self.tokens):
            depth[k + 1] = depth[k] + (step.get(t.text, 0) if t.kind in ("mark", "op") else 0)
        lower: list[int] = []  # places after tokens, deepest first: where the depth falls to a value again
        stop = n  # the next token that no type holds at any depth
        for k in range(n - 1, -1, -1):
            while lower and depth[lower[-1]] >= depth[k + 1]:
                lower.pop()
            lower.append(k + 1)
            t = self.tokens[k]
            turn = step.get(t.text, 0) if t.kind in ("mark", "op") else 0
            if t.kind == "op" and t.text in ("=", ":="):
                found[k], stop = k, k
            elif turn > 0:
                at, low, high = 0, 0, len(lower)
                while low < high:  # the first place, from the end of the list, not deeper than here
                    mid = (low + high) // 2
                    if depth[lower[mid]] <= depth[k]:
                        low = mid + 1
                    else:
                        high = mid
                at = lower[low - 1] if low else 0
                found[k] = found[at] if at and depth[at] == depth[k] and stop >= at else 0
            elif turn < 0:
                found[k] = 0
            elif t.kind in ("text", "end") or (t.kind == "mark" and t.text not in "&*.?'" and t.text != ",") or (t.kind == "op" and t.text not in ("|", "::", "->", "?", ":")):
                stop = k
            elif t.text != ",":
                found[k] = found[k + 1]
        return found

    def choices(self, k: int) -> Iterator[list[Part]]:
        """Literals after ?, :, or, else and their like, up to the end of the line or the next assignment."""
        while k < len(self.tokens) and self.kind(k) != "end" and not self.is_mark(k, _BINDS + " ;"):
            if self.tokens[k].text in _CHOICES and self.tokens[k].kind != "text":
                parts, _ = self.value(k + 1)
                if parts and not parts[0][2]:
                    yield parts
            k += 1

    def others(self, k: int) -> Iterator[list[Part]]:
        """The second and later literals of a list that begins here."""
        if not self.is_mark(k, "[ { ("):
            return
        _, k = self.value(self.past_ends(k + 1))
        while self.is_mark(self.past_ends(k), ","):
            after = self.past_ends(self.past_ends(k) + 1)
            if self.kind(after) != "text" or self.is_entry(after):
                return
            parts, k = self.value(after)
            yield parts

    def together(self, k: int) -> list[_Pair]:
        """Pairs of ``a, b = 1, 2``, whose last name is this token; none where the sides differ in number."""
        names, j = [self.tokens[k]], k
        while self.is_mark(j - 1, ",") and self.kind(j - 2) == "name":
            j -= 2
            names.append(self.tokens[j])
        if len(names) == 1:
            return []
        at, out = k + 2, []
        for name in reversed(names):
            parts, at = self.value(at)
            if not parts or (name is not names[0]) != self.is_mark(at, ","):
                return []
            out.append(_Pair(name.text, name.start, parts))
            at += 1
        return out

    def pairs(self) -> Iterator[_Pair]:
        """Pairs, with the names of enclosing entries before their own."""
        around: list[str] = []
        opened: dict[int, str] = {}  # brackets that a name opens
        for k, t in enumerate(self.tokens):
            if t.kind in ("name", "text") and self.is_mark(k + 1, _BINDS + " :") and self.is_mark(self.past_ends(k + 2), "{"):
                opened[self.past_ends(k + 2)] = t.text
            if t.kind == "mark" and t.text == "{":
                around.append(opened.get(k, ""))
            elif t.kind == "mark" and t.text == "}" and around:
                around.pop()
            for pair in self.pairs_at(k, t):
                yield pair
                if around and around[-1] and not name_points(pair.name):
                    yield _Pair(f"{around[-1]}.{pair.name}", pair.at, pair.parts)

    def pairs_at(self, k: int, t: _Token) -> Iterator[_Pair]:
        if t.kind not in ("name", "text"):
            return
        j = k + 1
        if t.kind == "name" and self.is_mark(j, "=") and (pairs := self.together(k)):
            yield from pairs
            return
        if self.is_mark(j, _COMPARES):
            if t.kind == "name" and self.kind(j + 1) == "text":
                yield _Pair(t.text, t.start, self.value(j + 1)[0])
            elif t.kind == "text" and self.kind(j + 1) == "name":
                yield _Pair(self.tokens[j + 1].text, t.start, [(t.start, t.end, False)])
        if t.kind == "text" and self.is_mark(j, ","):  # an argument that names the next one, or an attribute
            parts, _ = self.value(self.past_ends(j + 1))
            if parts and not parts[0][2]:
                yield _Pair(t.text, t.start, parts)
        if t.kind == "name" and self.is_mark(j, "( {") and self.kind(j + 1) == "text" and not _LOOKUP.search(t.text):
            parts, end = self.value(j + 1)
            if self.is_mark(end, ") }"):
                yield _Pair(t.text, t.start, parts)
        if t.kind == "name" and self.is_mark(k - 1, "- --") and self.text[t.start - 2 : t.start] == "--" and (flag := _FLAG_VALUE.match(self.text, t.end)):
            yield _Pair(t.text, t.start, [(*flag.span(1), False)])
        if t.kind == "name" and self.is_mark(k - 1, "- --") and self.kind(j) == "text" and self.text[t.end : t.end + 1] == " ":
            yield _Pair(t.text, t.start, self.value(j)[0])
        while self.is_mark(j, "] )") or (self.is_mark(j, "[") and self.is_mark(j + 1, "]")):
            j += 2 if self.is_mark(j, "[") else 1
        if t.kind == "name" and self.kind(j) in ("name", "mark") and (typed := self.after_type(j)):  # a type stands between name and operator
            yield _Pair(t.text, t.start, self.bound(typed + 1))
        elif self.is_mark(j, _BINDS):
            parts = self.bound(j + 1)
            yield _Pair(t.text, t.start, parts)
            yield from (_Pair(t.text, t.start, more) for more in (*self.choices(j + 1), *self.others(self.past_ends(j + 1))))
            if t.text.lower() in _KEYS and len(parts) == 1 and not parts[0][2] and self.kind(j + 2) == "name" and self.is_mark(j + 3, "="):
                yield _Pair(self.text[slice(*parts[0][:2])], t.start, self.bound(j + 4))
        elif self.is_mark(j, ":"):
            typed = self.after_type(j + 1)
            yield _Pair(t.text, t.start, self.bound((typed or j) + 1))
            yield from (_Pair(t.text, t.start, more) for more in self.others(self.past_ends(j + 1)))


def _binding(name: str, at: int, bound: dict[str, list[_Pair]]) -> _Pair | None:
    """The last binding of a name before a place, else its first one."""
    options = bound.get(name) or bound.get(name.rsplit(".", 1)[-1]) or []
    return options[max(0, bisect_left(options, at, key=lambda p: p.at) - 1)] if options else None


def _origin(text: str, pair: _Pair, bound: dict[str, list[_Pair]], known: dict[int, _Pair | None]) -> _Pair | None:
    """Where a chain of lone names ends, and None for one that runs in a circle; every step is taken once for all pairs."""
    path: list[_Pair] = []
    on: set[int] = set()
    while id(pair) not in known:
        on.add(id(pair))
        path.append(pair)
        a, b, named = pair.parts[0]
        ahead = _binding(text[a:b], pair.at, bound) if named and len(pair.parts) == 1 else None
        if ahead is None:
            known[id(pair)] = pair
        elif id(ahead) in on:
            known[id(pair)] = None
        else:
            pair = ahead
    for passed in path:
        known[id(passed)] = known[id(pair)]
    return known[id(pair)]


def _resolved(text: str, pair: _Pair, bound: dict[str, list[_Pair]], known: dict[int, _Pair | None]) -> list[tuple[int, int]]:
    """Spans of the literals that a pair stands for, through any steps.

    A lone word that nothing binds is a literal itself if it has a digit, as in configuration files.
    """
    first = _origin(text, pair, bound, known)
    if first is None:
        return []
    out, through, todo = [], {id(first)}, [(first, part) for part in reversed(first.parts)]
    while todo:
        of, (a, b, named) = todo.pop()
        if not named:
            out.append((a, b))
            continue
        other = _binding(text[a:b], of.at, bound)
        if other is None:
            if len(of.parts) == 1 and any("0" <= c <= "9" for c in text[a:b]):
                out.append((a, b))
            continue
        ahead = _origin(text, other, bound, known)
        if ahead is not None and id(ahead) not in through:
            through.add(id(ahead))
            todo += [(ahead, part) for part in reversed(ahead.parts)]
    return out


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose own or forwarded target names are sensitive."""
    lower = text.lower()
    if not any(w in lower for w in _ROOTS):  # no name can have points
        return []
    pairs, todo = [], [(0, len(text))]
    while todo:
        tokens, elements, comments = _tokens(text, *todo.pop())
        pairs += elements + [p for p in _Reader(text, tokens).pairs() if p.parts]
        todo += comments
    pairs.sort(key=lambda p: p.at)
    bound: dict[str, list[_Pair]] = {}
    for p in pairs:
        bound.setdefault(p.name, []).append(p)
    found: set[tuple[int, int]] = set()
    known: dict[int, _Pair | None] = {}
    for p in pairs:
        points = name_points(p.name)
        if not points:
            continue
        spans = _resolved(text, p, bound, known)
        if spans and points + literal_points("".join(text[a:b] for a, b in spans)) >= LEXED_LEAST:
            found.update(s for s in spans if s[0] < s[1])
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, in reporting order."""
    out = []
    lower = text.lower()
    if "passw" in lower or "secret" in lower or "token" in lower or "key" in lower:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, of one whole text."""
    base = base_spans(text)
    more = [(a, 3, b) for a, b in lexed_spans(text)]
    return base, sorted(base + more)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed.

    Spans are code points of the whole text, end exclusive, ordered by start and
    then kind. A null text is empty: no spans. Identifiers pass through, null or
    repeated; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                base, spans = scan(text.as_py() or "")
                kinds = Counter(k for _, k, _ in spans)
                row = (kinds[0], kinds[1], kinds[2], hashlib.sha256(_named(base).encode()).hexdigest(), _named(spans), kinds[3])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every found span (overlapping ones as one) replaced by ``mark``."""
    _, spans = scan(text)
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced in the text, its length column kept in step; all rows and columns stay."""
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [None if t is None else redact(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.string())
            if length_col in names:
                k = names.index(length_col)
                lengths = columns[k].to_pylist()
                columns[k] = pa.array([n if a is None or a == b else len(b) for n, a, b in zip(lengths, old, new, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
