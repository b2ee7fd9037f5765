"""Reviews of imports after a move: names that nothing writes any more."""

from __future__ import annotations

from collections import Counter

from treeline.functions import items as _items
from treeline.functions.rust_tree import Node, lex


def identifier_counts(source: bytes) -> Counter:
    """How often each identifier is written outside comments, strings and characters; raw prefixes are dropped."""
    return Counter(t.text.removeprefix("r#") for t in lex(source)[0] if t.kind == "word")


def dead_imports(tree: Node, source: bytes) -> tuple[list[str], list[str]]:
    """(private imports whose bound name is written only in imports, wildcard imports that cannot be enumerated)."""
    counts, dead, wild = identifier_counts(source), [], []
    inside: Counter = Counter()
    private = []
    for node in tree.children:
        if node.kind == "use_declaration":
            inside.update(identifier_counts(node.text(source)))
            if _items.visibility_key(node, source) == "private":
                private.append(node)
    for node in private:
        for path, name, star in _items.use_leaves(Node("source_file", node.start, node.end, [node]), source):
            if star:
                wild.append(path)
            elif name != "_" and counts[name] == inside[name]:
                dead.append(path)
    return dead, wild


def common_region(paths: list[str]) -> str:
    """The smallest module that holds all paths: their longest common prefix of segments."""
    parts = [p.split("::") for p in paths]
    out = []
    for step in zip(*parts, strict=False):
        if len(set(step)) > 1:
            break
        out.append(step[0])
    return "::".join(out)
