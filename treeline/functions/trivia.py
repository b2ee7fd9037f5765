"""Comments and attributes: what they belong to, by one cascade of tests."""

from __future__ import annotations

from dataclasses import dataclass

from treeline.functions.rust_tree import COMMENTS, Node

#: What a banner begins with.
BANNERS = ("---", "===", "***", "###")
ATTRIBUTES = ("attribute_item", "inner_attribute_item")


@dataclass
class Trivia:
    start: int
    end: int
    kind: str
    classification: str
    reason: str
    protected: bool
    owner: Node | None


def _doc(text: str) -> str | None:
    """inner, outer or None: which documentation a comment is."""
    if text.startswith(("//!", "/*!")):
        return "inner"
    if (text.startswith("///") and not text.startswith("////")) or (text.startswith("/**") and not text.startswith(("/***", "/**/"))):
        return "outer"
    return None


def _blank(gap: bytes) -> bool:
    """Whether a gap holds an empty line."""
    return gap.replace(b"\r\n", b"\n").replace(b"\r", b"\n").replace(b" ", b"").replace(b"\t", b"").count(b"\n") >= 2


def is_trivia(node: Node) -> bool:
    return node.kind in COMMENTS or node.kind in ATTRIBUTES


def marker(owner: Node | None) -> tuple[int, int] | None:
    """The first written leaf of an owner, by which it is known again; nothing of a whole file."""
    if owner is None or owner.kind == "source_file":
        return None if owner is None else (0, 0)
    stack = [owner]
    while stack:
        node = stack.pop()
        if is_trivia(node):
            continue
        if not node.children and node.end > node.start:
            return node.start, node.end
        stack += reversed(node.children)
    return None


def inventory(tree: Node, source: bytes) -> list[Trivia]:
    """Every comment and attribute with its classification, in source order."""
    out = []
    for node in tree.walk():
        if not is_trivia(node) or node.parent is None:
            continue
        text = node.text(source).decode("utf-8", "replace")
        around = node.parent.children
        k = around.index(node)
        before = next((c for c in reversed(around[:k]) if c.named and not is_trivia(c)), None)
        after = next((c for c in around[k + 1 :] if c.named and not is_trivia(c)), None)
        doc = _doc(text) if node.kind in COMMENTS else None
        line = source.rfind(b"\n", 0, node.start) + 1
        gap_before = source[(around[k - 1].end if k else node.parent.start) : node.start]
        gap_after = source[node.end : (around[k + 1].start if k + 1 < len(around) else node.parent.end)]
        inner, outer = node.kind == "inner_attribute_item" or doc == "inner", node.kind == "attribute_item" or doc == "outer"
        said = text.lstrip("/*! \t")
        raw = text[2:].lstrip()
        if inner:
            found = ("scope", "scope_prologue", node.parent)
        elif outer:
            found = ("leading", "outer_attachment", after)
        elif before is not None and source[line : node.start].strip() and not source[before.end : node.start].strip():
            found = ("trailing", "same_line", before)
        elif raw.startswith(BANNERS) or said.startswith(BANNERS):
            found = ("ambiguous", "banner", None)
        elif _blank(gap_before) or _blank(gap_after):
            found = ("ambiguous", "blank_separator", None)
        elif before is None and node.parent.kind in ("source_file", "declaration_list"):
            found = ("scope", "scope_prologue", node.parent)
        elif after is not None:
            found = ("leading", "contiguous_preceding", after)
        else:
            found = ("ambiguous", "competing_neighbors", None)
        classification, reason, owner = found
        out.append(Trivia(node.start, node.end, node.kind, classification, reason, inner or outer or classification == "scope", owner))
    return sorted(out, key=lambda t: (t.start, t.end))
