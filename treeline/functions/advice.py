"""Explainable advice on splitting one file: signals, ownership candidates and partition drafts.

All of it works on the items of one file, which bounds it; the plan module runs it
inside one pass over files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from treeline.functions import items as _items
from treeline.functions.rust_tree import COMMENTS, Node

# Soft limits of an item, prefixes that say little, and collision-free suffixes of a file name.
SOFT_BYTES, SOFT_LINES = 64 << 10, 256
WEAK_PREFIXES = frozenset(("get", "set", "new"))
SUFFIXES = range(2, 100)
NAMES = frozenset(("identifier", "type_identifier", "field_identifier"))


@dataclass
class Signal:
    kind: str
    basis: str
    items: list[int]
    source: int | None = None
    target: int | None = None
    count: int = 0
    label: str | None = None


@dataclass
class Candidate:
    items: list[int]
    support: int
    internal: int
    boundary: int


@dataclass
class Draft:
    kind: str
    groups: list[list[int]]
    names: list[str] = field(default_factory=list)


def draftable(item: _items.Item) -> bool:
    return item.eligible and item.impl_start is None


def prefixes(units: list[_items.Item]) -> list[Signal]:
    """Cumulative word prefixes of three letters or more that at least two names share."""
    met: dict[str, list[int]] = {}
    for k, item in enumerate(units):
        said = ""
        for word in _items.words(item.name or ""):
            said = f"{said}_{word}" if said else word
            if len(said) >= 3:
                met.setdefault(said, []).append(k)
    return [Signal("name_prefix", "written_name", ks, count=len(ks), label=p) for p, ks in sorted(met.items()) if len(ks) >= 2]


def sizes(units: list[_items.Item], source: bytes) -> list[Signal]:
    out = []
    for k, item in enumerate(units):
        lines = source.count(b"\n", item.start, item.end) + 1
        if item.end - item.start > SOFT_BYTES or lines > SOFT_LINES:
            out.append(Signal("item_size", "written_span", [k], count=item.end - item.start))
    return out


def binders(item: Node, source: bytes) -> set[bytes]:
    """Names that parameters, patterns and nested items of an item bind."""
    out = set()
    for node in item.walk():
        if node.name == "pattern" or node.kind in ("closure_parameters", "type_parameter", "const_parameter") or (node.kind in _items.KINDS and node is not item):
            targets = [node.child("name")] if node.kind in _items.KINDS or node.kind.endswith("_parameter") else list(node.walk())
            out |= {n.text(source) for n in targets if n is not None and n.kind in NAMES}
    return out


def mentions(item: _items.Item, within: Node, k: int, by_name: dict[bytes, list[int]], source: bytes) -> dict[int, int]:
    """How often a part of unit ``k`` writes the unique name of each other unit, outside macros, fields and the unit's own bindings."""
    bound, seen = binders(item.node, source), {}
    own = item.node.child("name")
    for node in within.walk():
        if node.kind not in ("identifier", "type_identifier") or node is own or node.name == "field":
            continue
        if node.parent is not None and (node.parent.kind == "token_tree" or (node.parent.kind.startswith("scoped") and node.name == "name")):
            continue
        text = node.text(source)
        others = by_name.get(text, [])
        if len(others) == 1 and others[0] != k and text not in bound:
            seen[others[0]] = seen.get(others[0], 0) + 1
    return seen


def references(units: list[_items.Item], source: bytes) -> list[Signal]:
    """One signal for each (unit, other unit) whose unique name the first writes outside macros, fields and own bindings."""
    by_name: dict[bytes, list[int]] = {}
    for k, item in enumerate(units):
        if item.name and item.impl_start is None:
            by_name.setdefault(item.name.encode(), []).append(k)
    out = []
    for k, item in enumerate(units):
        if item.impl_start is not None:
            continue
        seen = mentions(item, item.node, k, by_name, source)
        out += [Signal("reference_candidate", "written_name", [k, j], k, j, n) for j, n in sorted(seen.items())]
    for k, item in enumerate(units):  # an impl belongs to its nominal type
        if item.kind == "impl" and (t := item.node.child("type")) is not None:
            base = t if t.kind == "type_identifier" else t.child("type")
            others = by_name.get(base.text(source), []) if base is not None else []
            if len(others) == 1:
                out.append(Signal("impl_association", "written_type", [k, others[0]], k, others[0], 1))
    return out


def banners(units: list[_items.Item], tree: Node, source: bytes) -> list[Signal]:
    """Items from one banner comment to the next."""
    marks = [n for n in tree.children if n.kind in COMMENTS and n.text(source)[2:].lstrip().startswith((b"---", b"===", b"***", b"###"))]
    out = []
    for k, mark in enumerate(marks):
        end = marks[k + 1].start if k + 1 < len(marks) else tree.end
        own = [j for j, i in enumerate(units) if mark.end <= i.start < end and i.impl_start is None]
        if len(own) >= 2:
            out.append(Signal("banner_section", "written_comment", own, count=len(own), label=mark.text(source).decode("utf-8", "replace").strip("/*-=# \t\n")))
    return out


def strongly_connected(n: int, edges: list[tuple[int, int]]) -> list[list[int]]:
    """Components of two or more by two iterative passes, each sorted."""
    ahead, back = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in edges:
        ahead[a].append(b)
        back[b].append(a)

    def order(graph: list[list[int]], starts) -> list[list[int]]:
        seen, out = [False] * n, []
        for s in starts:
            if seen[s]:
                continue
            seen[s], stack, done = True, [(s, 0)], []
            while stack:
                v, k = stack.pop()
                if k < len(graph[v]):
                    stack.append((v, k + 1))
                    if not seen[graph[v][k]]:
                        seen[graph[v][k]] = True
                        stack.append((graph[v][k], 0))
                else:
                    done.append(v)
            out.append(done)
        return out

    finished = [v for part in order(ahead, range(n)) for v in part]
    return sorted(sorted(part) for part in order(back, reversed(finished)) if len(part) > 1)


def candidates(units: list[_items.Item], signals: list[Signal]) -> list[Candidate]:
    """Cores: connected draftable units by references, best first; names and banners only break ties."""
    ok = [draftable(i) or i.kind == "impl" for i in units]
    edges = [(s.source, s.target) for s in signals if s.kind in ("reference_candidate", "impl_association") and ok[s.source] and ok[s.target]]
    up = list(range(len(units)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    groups: dict[int, list[int]] = {}
    for k in range(len(units)):
        if ok[k] and units[k].impl_start is None:
            groups.setdefault(root(k), []).append(k)
    every = [(s.source, s.target) for s in signals if s.kind == "reference_candidate"]
    out = []
    for own in groups.values():
        if len(own) < 2:
            continue
        inside = set(own)
        typed = any(s.kind == "impl_association" and s.source in inside for s in signals)
        whole = all(draftable(units[k]) for k in own)
        internal = sum(a in inside and b in inside for a, b in edges)
        out.append(Candidate(own, 3 if typed and whole else 2, internal, sum((a in inside) != (b in inside) for a, b in every)))
    agree = lambda c: sum(set(c.items) <= set(s.items) for s in signals if s.kind in ("name_prefix", "banner_section"))
    return sorted(out, key=lambda c: (-c.support, -c.internal, c.boundary, -agree(c), c.items))


def primary_draft(units: list[_items.Item], found: list[Candidate]) -> Draft | None:
    """The first two disjoint cores leave; all else stays, and something always stays."""
    chosen: list[list[int]] = []
    for c in found:
        if len(chosen) < 2 and not any(set(c.items) & set(g) for g in chosen):
            chosen.append(list(c.items))
    if not chosen:
        return None
    top = [k for k, i in enumerate(units) if i.impl_start is None]
    kept = [k for k in top if not any(k in g for g in chosen)]
    if not kept:
        first = min(k for g in chosen for k in g)
        chosen = [g2 for g in chosen if (g2 := [k for k in g if k != first])]
        kept = [first]
    return Draft("primary", [kept, *chosen])


def balanced_draft(units: list[_items.Item]) -> Draft | None:
    """The earliest eligible unit stays; the rest is cut once, at the first boundary where both sides are most alike in bytes."""
    able = [k for k, i in enumerate(units) if draftable(i)]
    if len(able) < 2:
        return None
    rest = [k for k, i in enumerate(units) if i.impl_start is None and k not in able]
    stay, able = sorted([*rest, able[0]]), able[1:]
    if len(able) == 1:
        return Draft("balanced", [stay, able])
    size = [units[k].end - units[k].start for k in able]
    gap = lambda b: abs(sum(size[:b]) - sum(size[b:]))
    at = min(range(1, len(able)), key=lambda b: (gap(b), b))
    return Draft("balanced", [stay, able[:at], able[at:]])


def group_name(units: list[_items.Item], own: list[int], signals: list[Signal], stem: str, taken: set[str]) -> str | None:
    """A file name: the longest telling prefix that covers the group, else ``<stem>_part``; then _2 to _99."""
    covering = [s.label for s in signals if s.kind == "name_prefix" and set(own) <= set(s.items) and s.label not in WEAK_PREFIXES]
    base = min(covering, key=lambda p: (-len(p), p)) if covering else f"{stem}_part" if stem.isidentifier() else "split_part"
    for name in [base, *(f"{base}_{k}" for k in SUFFIXES)]:
        if name.lower() not in taken:
            return name
    return None


def payoff(units: list[_items.Item], total: int) -> tuple[list[int], list[int]]:
    """The three largest items, and those that hold at least half of the file and cannot be divided."""
    top = [k for k, i in enumerate(units) if i.impl_start is None]
    largest = sorted(top, key=lambda k: (units[k].start - units[k].end, units[k].start))[:3]
    return largest, [k for k in largest if units[k].end - units[k].start >= -(-total // 2) and units[k].kind != "impl"]


def advise(path: str, tree: Node, source: bytes, balanced: bool = False) -> dict:
    """Signals, candidates, drafts and outcome of one file."""
    units = _items.inventory(tree, source)
    signals = [*prefixes(units), *banners(units, tree, source), *references(units, source), *sizes(units, source)]
    eligible = sum(map(draftable, units))
    found = candidates(units, signals) if not tree.broken else []
    outcome = "incomplete_analysis" if tree.broken else "insufficient_input" if eligible < 2 else "credible_written_candidates" if found else "no_credible_written_partition"
    drafts = [d for d in (primary_draft(units, found) if eligible >= 2 else None, balanced_draft(units) if balanced and not tree.broken else None) if d]
    stem = path.rsplit("/", 1)[-1].removesuffix(".rs")
    for d in drafts:
        taken = {stem.lower()}
        for own in d.groups[1:]:
            name = group_name(units, own, signals, stem, taken)
            d.names.append(name or "")
            taken.add((name or "").lower())
    largest, dominant = payoff(units, len(source))
    return {"units": units, "signals": signals, "candidates": found, "drafts": drafts, "outcome": outcome, "largest": largest, "dominant": dominant}


def member_links(units: list[_items.Item], source: bytes) -> list[Signal]:
    """What members write: calls of siblings through ``self`` or ``Self`` (self_call), top-level types of their signatures (signature_type) and other top-level units in their bodies (reference_candidate)."""
    types: dict[bytes, list[int]] = {}
    siblings: dict[tuple[int, bytes], list[int]] = {}
    for k, item in enumerate(units):
        if item.name and item.impl_start is None:
            types.setdefault(item.name.encode(), []).append(k)
        elif item.name:
            siblings.setdefault((item.impl_start, item.name.encode()), []).append(k)
    out = []
    for k, item in enumerate(units):
        if item.impl_start is None:
            continue
        called: dict[int, int] = {}
        for node in item.node.walk():
            target = node.child("function") if node.kind == "call_expression" else None
            if target is None or target.kind not in ("field_expression", "scoped_identifier"):
                continue
            owner, name = (target.child("value"), target.child("field")) if target.kind == "field_expression" else (target.child("path"), target.child("name"))
            if owner is not None and name is not None and owner.text(source) in (b"self", b"Self"):
                own = siblings.get((item.impl_start, name.text(source)), [])
                if len(own) == 1 and own[0] != k:
                    called[own[0]] = called.get(own[0], 0) + 1
        written: dict[int, int] = {}
        for part in (item.node.child("parameters"), item.node.child("return_type")):
            for node in part.walk() if part is not None else ():
                own = types.get(node.text(source), []) if node.kind == "type_identifier" else []
                if len(own) == 1:
                    written[own[0]] = written.get(own[0], 0) + 1
        out += [Signal("self_call", "written_receiver", [k, j], k, j, n) for j, n in sorted(called.items())]
        out += [Signal("signature_type", "written_signature", [k, j], k, j, n) for j, n in sorted(written.items())]
        body = item.node.child("body")
        seen = mentions(item, body, k, types, source) if body is not None else {}
        out += [Signal("reference_candidate", "written_name", [k, j], k, j, n) for j, n in sorted(seen.items()) if j not in written]
    return out
