"""Tree queries: S-expression patterns with fields, captures, quantifiers, anchors and predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from treeline.functions.rust_tree import COMMENTS, Node


class QueryError(ValueError):
    def __init__(self, code: str, offset: int = 0):
        super().__init__(f"{code} at byte {offset} of query")
        self.code, self.offset = code, offset


# Kinds that the two supertypes stand for.
SUPERTYPES = {
    "_literal": frozenset("string_literal raw_string_literal char_literal boolean_literal integer_literal float_literal".split()),
    "_type": frozenset("type_identifier primitive_type reference_type pointer_type tuple_type unit_type array_type generic_type scoped_type_identifier function_type abstract_type dynamic_type bounded_type never_type macro_invocation".split()),
}
PREDICATES = frozenset("eq? not-eq? any-eq? any-not-eq? match? not-match? any-match? any-not-match? any-of? not-any-of? rust-arity?".split())
MAX_PATTERNS = 64
_TOKEN = re.compile(r"""\s+|;[^\n]*|(?P<string>"(?:\\.|[^"\\])*")|(?P<capture>@[\w.\-]+)|(?P<predicate>\#[\w\-]+[?!])|(?P<field>[A-Za-z_]\w*:)|(?P<negated>![A-Za-z_]\w*)|(?P<name>[A-Za-z_]\w*)|(?P<mark>[()\[\].?*+])""")


@dataclass
class Item:
    kind: str | None = None  # None: a wildcard
    named: bool | None = True
    children: list[tuple[str | None, Item]] = field(default_factory=list)
    anchors: set[int] = field(default_factory=set)  # before child k; len(children): after the last
    negated: list[str] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    either: list[tuple[str | None, Item]] | None = None
    group: bool = False
    quantifier: str = ""


@dataclass
class Query:
    patterns: list[tuple[Item, list[tuple[str, list[tuple[str, str]]]]]]


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError("INVALID_QUERY", len(text[:at].encode()))
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], len(text[:at].encode())))
            at = m.end()
        self.tokens.append(("end", "", len(text.encode())))
        self.k, self.predicates = 0, []

    def now(self):
        return self.tokens[self.k]

    def take(self, text: str | None = None):
        t = self.tokens[self.k]
        if t[0] == "end" or (text is not None and t[1] != text):
            raise QueryError("INVALID_QUERY", t[2])
        self.k += 1
        return t

    def item(self) -> Item:
        kind, text, at = self.now()
        if kind == "string":
            out = Item(_unquoted(self.take()[1]), False)
        elif text == "_" and kind == "name":
            self.take()
            out = Item(None, None)
        elif text == "[":
            self.take()
            out = Item(either=[])
            while self.now()[1] != "]":
                out.either.append(self.fielded())
            self.take()
        elif text == "(":
            self.take()
            kind, text, at = self.now()
            if kind in ("name",):
                out = Item(None if text == "_" else text)
                self.take()
            else:
                out = Item(group=True)
            while self.now()[1] != ")":
                kind, text, at = self.now()
                if text == "." and kind == "mark":
                    self.take()
                    out.anchors.add(len(out.children))
                elif kind == "predicate":
                    raise QueryError("INVALID_QUERY", at)
                elif kind == "negated":
                    out.negated.append(self.take()[1][1:])
                elif text == "(" and self.tokens[self.k + 1][0] == "predicate":
                    self.predicate()
                else:
                    out.children.append(self.fielded())
            self.take()
        else:
            raise QueryError("INVALID_QUERY", at)
        while self.now()[0] == "capture" or (self.now()[0] == "mark" and self.now()[1] in "?*+"):
            t = self.take()
            if t[0] == "capture":
                out.captures.append(t[1][1:])
            else:
                out.quantifier = t[1]
        return out

    def fielded(self) -> tuple[str | None, Item]:
        if self.now()[0] == "field":
            return self.take()[1][:-1], self.item()
        return None, self.item()

    def predicate(self) -> None:
        self.take("(")
        _, text, at = self.take()
        name, args = text[1:], []
        if name not in PREDICATES:
            raise QueryError("UNSUPPORTED_QUERY_OPERATION", at)
        while self.now()[1] != ")":
            kind, text, at = self.take()
            args.append(("capture", text[1:]) if kind == "capture" else ("text", _unquoted(text) if kind == "string" else text))
        self.take(")")
        if len(args) < 2 or args[0][0] != "capture" or (name == "rust-arity?" and not args[1][1].isdigit()):
            raise QueryError("INVALID_QUERY", at)
        self.predicates.append((name, args))


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}.get(m[1], m[1]), text[1:-1])


def _captures(item: Item) -> list[str]:
    inner = [c for _, i in [*item.children, *(item.either or [])] for c in _captures(i)]
    return item.captures + inner


def compile_query(text: str) -> Query:
    """1 to 64 rooted patterns, each with exactly one ``@match``."""
    reader, out = _Reader(text), []
    while reader.now()[0] != "end":
        at = reader.now()[2]
        reader.predicates = []
        item = reader.item()
        while item.group and len(item.children) == 1 and not item.captures:
            item = item.children[0][1]
        if item.group or item.quantifier:
            raise QueryError("INVALID_QUERY_ROOT", at)
        if _captures(item).count("match") != 1:
            raise QueryError("INVALID_QUERY_ROOT", at)
        known = set(_captures(item))
        if any(kind == "capture" and name not in known for _, args in reader.predicates for kind, name in args):
            raise QueryError("INVALID_QUERY", at)
        out.append((item, list(reader.predicates)))
    if not 1 <= len(out) <= MAX_PATTERNS:
        raise QueryError("INVALID_QUERY")
    return Query(out)


def _kind_fits(item: Item, node: Node) -> bool:
    if item.kind is None:
        return node.named or item.named is None
    if item.kind == "_expression":
        return node.named and node.expression
    if item.kind in SUPERTYPES:
        return node.named and node.kind in SUPERTYPES[item.kind]
    return node.kind == item.kind and node.named == item.named


def _fits(item: Item, node: Node, bound: tuple):
    """Every way (as tuples of (capture, node)) in which the item matches the node."""
    if item.either is not None:
        for name, inner in item.either:
            if name is None or node.name == name:
                yield from ((*b, *((c, node) for c in item.captures)) for b in _fits(inner, node, bound))
        return
    if not _kind_fits(item, node) or any(node.child(n) is not None for n in item.negated):
        return
    here = (*bound, *((c, node) for c in item.captures))
    for end, b in _siblings(item, node.children, 0, 0, here, False):
        if len(item.children) in item.anchors and any(map(_counts, node.children[end:])):
            continue
        yield b


def _counts(node: Node) -> bool:
    """Whether an anchor sees the node."""
    return node.named and node.kind not in COMMENTS


def _siblings(item: Item, nodes: list[Node], k: int, at: int, bound: tuple, tight: bool):
    """(end, bound) of every way in which children ``k``.. of the item match nodes from ``at``.

    Gaps are free where no anchor stands; ``tight`` says that one stands before the
    first child.
    """
    if k == len(item.children):
        yield at, bound
        return
    name, want = item.children[k]
    tight = k in item.anchors or (k == 0 and tight)
    if not want.quantifier:
        for end, b in _once(want, name, nodes, at, bound, tight):
            yield from _siblings(item, nodes, k + 1, end, b, False)
        return
    # as many as there are; fewer only where nothing fits after more
    for count, end, b in reversed(_repeats(want, name, nodes, at, bound, tight)):
        if want.quantifier == "+" and not count:
            return
        met = False
        for way in _siblings(item, nodes, k + 1, end, b, False):
            met = True
            yield way
        if met:
            return


def _repeats(want: Item, name: str | None, nodes: list[Node], at: int, bound: tuple, tight: bool) -> list[tuple[int, int, tuple]]:
    """(count, end, bound) after no, one, two ... occurrences, each at the first place where it fits."""
    out = [(0, at, bound)]
    while want.quantifier != "?" or len(out) < 2:
        count, end, b = out[-1]
        after = next(_once(want, name, nodes, end, b, tight and not count), None)
        if after is None or after[0] == end:
            break
        out.append((count + 1, *after))
    return out


def _once(want: Item, name: str | None, nodes: list[Node], at: int, bound: tuple, tight: bool):
    """(end, bound) of every occurrence of one child, or of a group of siblings, from ``at`` on."""
    if want.group:
        for end, b in _siblings(want, nodes, 0, at, bound, tight):
            yield end, (*b, *((c, nodes[at]) for c in want.captures if at < len(nodes)))
        return
    for j in range(at, len(nodes)):
        if name is None or nodes[j].name == name:
            for b in _fits(want, nodes[j], bound):
                yield j + 1, b
        if tight and _counts(nodes[j]):
            return


def arity(node: Node) -> int | None:
    """Number of comma-separated argument expressions; None where errors, attributes or bad punctuation stand."""
    if node.kind != "arguments":
        raise QueryError("INVALID_QUERY")
    inner = node.significant()[1:-1]
    if inner and inner[-1].kind == ",":
        inner = inner[:-1]
    if any((c.kind == ",") != bool(k % 2) or (c.named and not c.expression) or c.missing for k, c in enumerate(inner)):
        return None
    return (len(inner) + 1) // 2


def _holds(predicate: tuple, captured: dict[str, list[Node]], source: bytes) -> bool:
    name, args = predicate
    nodes = captured.get(args[0][1], [])
    texts = [n.text(source) for n in nodes]
    if name == "rust-arity?":
        return len(nodes) == 1 and arity(nodes[0]) == int(args[1][1])
    if name in ("any-of?", "not-any-of?"):
        among = {v.encode() for _, v in args[1:]}
        return all((t in among) == (name == "any-of?") for t in texts)
    exists = name.startswith("any-")
    negative = "not-" in name
    if "match" in name:
        rule = re.compile(args[1][1].encode())
        tests = [bool(rule.search(t)) != negative for t in texts]
    else:
        others = [n.text(source) for n in captured.get(args[1][1], [])] if args[1][0] == "capture" else None
        tests = [(t == args[1][1].encode() if others is None else (k < len(others) and t == others[k])) != negative for k, t in enumerate(texts)]
    return any(tests) if exists and tests else all(tests)


def run_query(query: Query, tree: Node, source: bytes):
    """(pattern index, match node, captures) sorted by range; equal tuples once."""
    found = {}
    for index, (item, predicates) in enumerate(query.patterns):
        for node in tree.walk():
            for bound in _fits(item, node, ()):
                captured: dict[str, list[Node]] = {}
                for name, n in bound:
                    captured.setdefault(name, []).append(n)
                if all(_holds(p, captured, source) for p in predicates):
                    m = captured["match"][0]
                    key = (m.start, m.end, index, tuple(sorted((c, tuple((n.start, n.end) for n in ns)) for c, ns in captured.items())))
                    found[key] = (index, m, captured)
    return [found[k] for k in sorted(found)]
