"""What one file writes about names: where bindings open and close, what leaves them unproved, and where names are used.

Facts only, one row each and in no order; which binding a use meets is decided over
all files by ``treeline.plans.scopes``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from treeline.functions import items as _items
from treeline.functions.rust_tree import COMMENTS, Node

# Reasons of an uncertain binding.
UNSUPPORTED = "unsupported_pattern"
BINDING_OR_CONSTANT = "identifier_pattern_binding_or_constant"
TYPE_POSITION = "value_binding_in_type_position"
LOCAL_IMPORT = "relevant_local_import"
CONDITIONAL = "conditional_local_context"
RECOVERY = "syntax_recovery"

#: A binder that only a constant of its name could contest; settled by the rivals in scope.
CONTESTABLE = "contestable"
#: Order in which a scope is asked for a name; a smaller rank answers first.
RANKS = {name: k for k, name in enumerate(("recovery", "pattern", "parameter", "generic", "let", "item", "nested"))}

_VALUES = ("function_item", "const_item", "static_item")
_NAMED = (*_VALUES, "struct_item", "enum_item", "type_item", "union_item", "trait_item", "mod_item")
_OPAQUE = ("token_tree", "macro_definition", "attribute_item", "inner_attribute_item", "use_declaration", "lifetime", "loop_label")
_LITERALS = ("integer_literal", "float_literal", "negative_literal", "boolean_literal", "char_literal", "string_literal", "raw_string_literal")
_SEPARATE = (*_LITERALS, "or_pattern", "scoped_identifier", "scoped_type_identifier", *COMMENTS)
_INERT = re.compile(rb"#!?\[allow\(.*|#\[inline(\((always|never)\))?\]|#!?\[repr\(.*|#!?\[\s*doc\s*[(=].*|#!?\[\s*doc\s*\]", re.DOTALL)


class Fact(NamedTuple):
    role: str  # scope, barrier, rival or use
    module: int  # start of the innermost module written in this file, -1 outside
    name: str | None  # None: any name
    at: int
    until: int
    scope: int = 0  # preorder number of the node that answers
    rank: int = 0
    seq: int = 0
    value: bool = False
    reason: str | None = None
    witness: Node | None = None
    wide: Node | None = None  # the whole pattern of a binder


def _text(node: Node, source: bytes) -> str:
    return node.text(source).decode().removeprefix("r#")


def _named(node: Node) -> list[Node]:
    return [c for c in node.children if c.named]


def _outer(node: Node) -> bool:
    """Whether an attribute stands right before a node."""
    around = [c for c in node.parent.children if c.named] if node.parent else []
    at = next((k for k, c in enumerate(around) if c is node), 0)
    return at > 0 and around[at - 1].kind == "attribute_item"


def _macro(statement: Node) -> bool:
    inner = next(iter(_named(statement)), None) if statement.kind == "expression_statement" else statement
    return inner is not None and inner.kind == "macro_invocation"


def binds(pattern: Node, source: bytes, simple: bool) -> dict[str | None, tuple[str | None, Node]]:
    """What a pattern says of each name it writes: (None or why it is unproved, witness); the key None answers for all other names.

    A second binder of a name and a name in one of several composite alternatives are
    unsupported; a bare name may be a constant unless ``simple`` or marked by ref, mut, @ or
    shorthand; an argument of a constructor is contestable.
    """
    out: dict[str | None, tuple[str | None, Node]] = {}
    unknown: list[tuple[int, str | None, str, Node]] = []
    stack, order = [(pattern, "explicit" if simple else "bare")], 0
    while stack:
        node, place = stack.pop()
        order += 1
        below: list[tuple[Node, str]] = []
        kids = [c for c in _named(node) if c.kind not in COMMENTS]
        if node.missing or node.kind == "ERROR" or any(c.kind == "ERROR" or c.missing for c in node.children):
            unknown.append((order, None, RECOVERY, node))
            continue
        if node.kind in ("identifier", "shorthand_field_identifier"):
            name = _text(node, source)
            if place == "alternative":
                unknown.append((order, name, UNSUPPORTED, node))
            elif place == "bare":
                unknown.append((order, name, BINDING_OR_CONSTANT, node))
            elif name in out:
                unknown.append((order, name, UNSUPPORTED, node))
            else:
                out[name] = (CONTESTABLE if place == "argument" else None, node)
        elif node.kind in ("mut_pattern", "ref_pattern", "reference_pattern"):
            below = [(c, place if node.kind == "reference_pattern" else "explicit") for c in kids if c.kind != "mutable_specifier"]
        elif node.kind == "captured_pattern" and kids and kids[0].kind == "identifier":
            below = [(kids[0], "explicit"), *((c, "bare") for c in kids[1:])]
        elif node.kind == "or_pattern":
            below = [(c, "bare" if c.kind in _SEPARATE else "alternative") for c in kids]
        elif node.kind in ("tuple_pattern", "slice_pattern", "tuple_struct_pattern", "struct_pattern"):
            below = [(c, "argument") for c in kids if c.name != "type"]
        elif node.kind == "field_pattern" and (node.child("pattern") or node.child("name")):
            below = [(node.child("pattern"), "argument")] if node.child("pattern") else [(node.child("name"), "explicit")]
        elif node.kind == "match_pattern":
            below = [(c, "bare") for c in kids if c.name != "condition"]
        elif node.kind not in ("scoped_identifier", "scoped_type_identifier", "_", "remaining_field_pattern", *_LITERALS, *COMMENTS) and node.text(source) != b"_":
            unknown.append((order, None, UNSUPPORTED, node))
        if node.kind == "match_pattern" and not kids and node.text(source) != b"_":
            unknown.append((order, None, UNSUPPORTED, node))
        stack += [(c, "alternative" if place == "alternative" else p) for c, p in reversed(below)]
    first = next(((r, n) for _, name, r, n in unknown if name is None), None)
    for _, name, reason, node in reversed(unknown):  # the earliest stays
        if name is not None:
            out[name] = (reason, node)
    if first:
        earliest = next(o for o, name, _, _ in unknown if name is None)
        told = {name for o, name, _, _ in unknown if name is not None and o < earliest}
        out = {name: held for name, held in out.items() if name in told} | {None: first}
    return out


def facts(tree: Node, source: bytes) -> list[Fact]:
    """All facts of a file."""
    order = list(tree.walk())
    number = {id(n): k for k, n in enumerate(order)}
    broken: set[int] = set()
    module: dict[int, int] = {}
    for n in order:
        up = n.parent
        module[id(n)] = -1 if up is None else up.start if up.kind == "mod_item" else module[id(up)]
        if n.kind == "ERROR" or n.missing:
            at = n
            while at is not None and id(at) not in broken:
                broken.add(id(at))
                at = at.parent
    out: list[Fact] = []

    def pattern(p: Node, scope: Node, rank: str, at: int, until: int, seq: int = 0, answers: Node | None = None, simple: bool = False) -> None:
        whole = answers or scope
        add = lambda name, reason, witness, value=False: out.append(
            Fact("scope", module[id(scope)] if scope.kind != "mod_item" else scope.start, name, at, until, number[id(whole)], RANKS[rank], seq, value, reason, witness, p)
        )
        if _outer(scope) or _outer(p):
            add(None, CONDITIONAL, p)
            return
        for name, (reason, node) in binds(p, source, simple).items():
            add(name, reason, node, reason in (None, CONTESTABLE))

    for n in order:
        own, k = module[id(n)], number[id(n)]
        kids = _named(n)
        if id(n) in broken and n.kind not in ("source_file", "mod_item") and n.children:
            out.append(Fact("scope", own, None, n.start, n.end, k, RANKS["recovery"], 0, False, RECOVERY, n, n))
        _rivals(n, own if n.kind != "declaration_list" or n.parent.kind != "mod_item" else n.parent.start, source, out)
        if n.kind == "for_expression" and n.child("pattern") and n.child("body"):
            pattern(n.child("pattern"), n, "pattern", n.child("body").start, n.child("body").end)
        elif n.kind == "match_arm" and n.child("pattern") and n.child("value"):
            p, v = n.child("pattern"), n.child("value")
            guard = p.child("condition")
            at = guard.start if guard else v.start
            attributes = [c for c in kids if c.kind in ("attribute_item", "inner_attribute_item")]
            if guard is not None and any(c.kind == "let_condition" for c in guard.walk() if _chained(c, guard)):
                out.append(Fact("scope", own, None, at, v.end, k, RANKS["pattern"], 0, False, UNSUPPORTED, guard, guard))
            elif any(not _INERT.fullmatch(a.text(source)) for a in attributes):
                out.append(Fact("scope", own, None, at, v.end, k, RANKS["pattern"], 0, False, CONDITIONAL, p, p))
            else:
                pattern(p, n, "pattern", at, v.end)
        elif n.kind in ("if_expression", "while_expression") and n.child("condition"):
            body = n.child("consequence" if n.kind == "if_expression" else "body")
            if body is not None:
                for seq, c in enumerate(c for c in n.child("condition").walk() if c.kind == "let_condition" and _chained(c, n.child("condition"))):
                    if c.child("pattern"):
                        pattern(c.child("pattern"), n, "pattern", c.end, body.end, seq)
        if n.child("body") is not None and n.child("parameters") is not None:
            body = n.child("body")
            for seq, c in enumerate(_named(n.child("parameters"))):
                if c.kind in (*COMMENTS, "self_parameter", "attribute_item"):
                    continue
                p = c.child("pattern") or (c if n.kind == "closure_expression" and c.kind != "parameter" else None)
                if p is not None:
                    pattern(p, n, "parameter", body.start, body.end, seq, simple=n.kind in ("function_item", "closure_expression"))
        if n.child("type_parameters") is not None and n.kind != "mod_item":
            for seq, c in enumerate(_named(n.child("type_parameters"))):
                if c.child("name") is not None and c.kind in ("type_parameter", "const_parameter"):
                    out.append(Fact("scope", own, _text(c.child("name"), source), n.start, n.end, k, RANKS["generic"], seq, c.kind == "const_parameter", None, c, c))
        if n.kind == "block":
            _block(n, kids, own, k, source, out, pattern)
        if n.kind in _VALUES and n.parent is not None and n.parent.kind == "block":
            out.append(Fact("scope", own, None, n.start, n.end, k, RANKS["nested"], 0, False, CONDITIONAL, None, None))
    _uses(tree, module, source, out)
    return out


def _chained(node: Node, top: Node) -> bool:
    """Whether only conjunctions lie between a condition and the whole condition."""
    while node is not top:
        node = node.parent
        if node is not top and node.kind not in ("binary_expression", "let_chain"):
            return False
    return True


def _block(n: Node, kids: list[Node], own: int, k: int, source: bytes, out: list[Fact], pattern) -> None:
    for seq, s in enumerate(kids):
        inert = s.kind != "attribute_item" or _INERT.fullmatch(s.text(source))
        if not inert or _macro(s):
            out.append(Fact("barrier", own, None, n.start, n.end, k, 0, seq, False, CONDITIONAL if not inert else UNSUPPORTED, s, s))
        if s.kind == "let_declaration" and s.child("pattern") is not None:
            pattern(s.child("pattern"), s, "let", s.end, n.end, seq, answers=n, simple=True)
        elif s.kind == "use_declaration":
            for name in {b and b.removeprefix("r#") for _, b, _ in _items.use_leaves(s, source)}:
                out.append(Fact("scope", own, name, n.start, n.end, k, RANKS["item"], seq, False, LOCAL_IMPORT, s, s))
        elif s.kind in _NAMED and s.child("name") is not None:
            reason = CONDITIONAL if _outer(s) else None
            out.append(Fact("scope", own, _text(s.child("name"), source), n.start, n.end, k, RANKS["item"], seq, reason is None and s.kind in _VALUES, reason, s, s))


def _rivals(n: Node, own: int, source: bytes, out: list[Fact]) -> None:
    """Constants, unit constructors, imports and unknown output that a bare name in a pattern may mean."""
    names: list[str | None] = []
    written = n.kind in ("block", "source_file") or (n.kind == "declaration_list" and n.parent.kind == "mod_item")
    for c in _named(n) if written or n.kind == "declaration_list" else []:
        if _macro(c):
            names.append(None)
        elif not written:
            continue
        elif c.kind in ("const_item", "static_item") or (c.kind == "struct_item" and c.child("body") is None):
            names += [_text(c.child("name"), source)] if c.child("name") else []
        elif c.kind == "use_declaration":
            names += [b and b.removeprefix("r#") for _, b, _ in _items.use_leaves(c, source)]
        elif c.kind == "enum_item" and c.child("body") is not None:
            names += [_text(v.child("name"), source) for v in _named(c.child("body")) if v.kind == "enum_variant" and v.child("body") is None and v.child("name")]
    if n.child("type_parameters") is not None:
        names += [_text(c.child("name"), source) for c in _named(n.child("type_parameters")) if c.kind == "const_parameter" and c.child("name")]
    until = n.end if n.kind != "source_file" else n.end + 1
    at = n.start if n.kind != "source_file" else 0
    out += [Fact("rival", own, name, at, until) for name in dict.fromkeys(names)]


def _uses(tree: Node, module: dict[int, int], source: bytes, out: list[Fact]) -> None:
    stack = [(tree, False)]
    while stack:
        n, inside = stack.pop()
        if n.kind in _OPAQUE or n.kind == "macro_invocation":
            continue
        inside = inside and n.kind not in ("function_item", "block")
        if n.kind in ("identifier", "type_identifier"):
            up = n.parent
            declared = n.name == "name" and up.kind != "struct_expression"
            bare = n.kind == "identifier" and up.kind == "closure_parameters"
            field = n.name == "field" and up.kind == "field_expression"
            if not (inside or declared or bare or field or n.missing or (n.name == "pattern" and n.parent is not None)):
                out.append(Fact("use", module[id(n)], _text(n, source), n.start, n.end, value=n.kind == "identifier"))
        for c in reversed(n.children):
            guard = n.kind == "match_pattern" and c.name == "condition"
            stack.append((c, not guard and (inside or c.name == "pattern")))
