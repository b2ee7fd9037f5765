"""Written items of a file: names, visibility, eligibility, members, imports, words and cfg predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from treeline.functions.rust_tree import COMMENTS, Node

# Kinds of items, those that a plan can move, and attributes that change nothing.
KINDS = {
    "function_item": "function", "struct_item": "struct", "enum_item": "enum", "union_item": "union", "type_item": "type_alias", "const_item": "const", "static_item": "static",
    "trait_item": "trait", "impl_item": "impl", "mod_item": "module", "use_declaration": "use", "macro_definition": "macro", "macro_invocation": "macro_call",
    "extern_crate_declaration": "extern_crate", "foreign_mod_item": "foreign_module", "function_signature_item": "function_signature",
}
MOVABLE = frozenset("function struct enum union type_alias const static trait".split())
INERT = frozenset("allow warn deny forbid doc inline must_use deprecated cold".split())


@dataclass
class Item:
    kind: str
    name: str | None
    visibility: str
    start: int
    end: int
    eligible: bool
    reasons: list[str] = field(default_factory=list)
    impl_start: int | None = None
    node: Node | None = None


def visibility_key(node: Node, source: bytes) -> str:
    """private, pub, or the restriction written without spaces; ``pub(self)`` is private and ``pub(in crate)`` is ``pub(crate)``."""
    own = next((c for c in node.children if c.kind == "visibility_modifier"), None)
    if own is None:
        return "private"
    text = re.sub(rb"//[^\n]*|/\*.*?\*/|\s+", b" ", own.text(source), flags=re.S).decode()
    words = re.findall(r"\w+|::", text)
    if words == ["pub"]:
        return "pub"
    inside = "".join(w for w in words[1:] if w != "in") if words[1] != "in" or words[2:] in (["crate"], ["self"], ["super"]) else "in " + "".join(words[2:])
    return "private" if inside == "self" else f"pub({inside})"


def attributes_before(node: Node, source: bytes) -> list[str]:
    """Names of the outer attributes directly above a node."""
    around = node.parent.children if node.parent else []
    out = []
    for c in reversed(around[: around.index(node)] if node in around else []):
        if c.kind == "attribute_item":
            m = re.match(rb"#\s*\[\s*([\w:]+)", c.text(source))
            out.append(m[1].decode() if m else "?")
        elif c.kind not in COMMENTS:
            break
    return out[::-1]


def _name(node: Node, source: bytes) -> str | None:
    own = node.child("name")
    return own.text(source).decode().removeprefix("r#") if own else None


def describe(node: Node, source: bytes, impl: Node | None = None) -> Item:
    kind = KINDS[node.kind]
    reasons = []
    if kind not in MOVABLE and not (impl is not None and kind == "function"):
        reasons.append("unsupported_unit_kind")
    key = visibility_key(node, source)
    if key.startswith("pub("):
        reasons.append("visibility_scope_unproved")
    elif key == "pub":
        reasons.append("public_path_change")
    if any(a not in INERT and a != "derive" for a in attributes_before(node, source)):
        reasons.append("conditional_or_inherited_context")
    if node.broken:
        reasons.append("syntax_recovery")
    eligible = not {"unsupported_unit_kind", "syntax_recovery"} & set(reasons)
    return Item(kind, _name(node, source), key, node.start, node.end, eligible, reasons, impl.start if impl else None, node)


def inventory(tree: Node, source: bytes, members: bool = True) -> list[Item]:
    """Top-level items in order, and with ``members`` the functions of inherent impls after their impl."""
    out = []
    for node in tree.children:
        if node.kind == "expression_statement" and node.children[0].kind == "macro_invocation":
            node = node.children[0]
        if node.kind not in KINDS:
            continue
        out.append(describe(node, source))
        if members and node.kind == "impl_item" and node.child("trait") is None:
            body = node.child("body")
            out += [describe(c, source, node) for c in (body.children if body else []) if c.kind == "function_item"]
    return out


def use_leaves(tree: Node, source: bytes) -> list[tuple[str, str | None, bool]]:
    """(full path, bound name, wildcard) of every leaf of every import; ``self`` in a group is the group's path."""
    out: list[tuple[str, str | None, bool]] = []

    def text(n: Node) -> str:
        return re.sub(r"\s+", "", n.text(source).decode())

    def flat(n: Node, prefix: str) -> None:
        join = lambda a: f"{prefix}::{a}" if prefix else a
        if n.kind == "use_list":
            for c in n.children:
                if c.named and c.kind not in COMMENTS:
                    flat(c, prefix)
        elif n.kind == "scoped_use_list":
            path = n.child("path")
            flat(n.child("list"), join(text(path)) if path else prefix)
        elif n.kind == "use_as_clause":
            path = text(n.child("path"))
            out.append((prefix if path == "self" and prefix else join(path), text(n.child("alias")), False))
        elif n.kind == "use_wildcard":
            path = text(n).removesuffix("*").removesuffix("::")
            out.append((join(path) if path else prefix, None, True))
        else:
            path = text(n)
            full = prefix if path == "self" and prefix else join(path)
            out.append((full, full.rsplit("::", 1)[-1].removeprefix("r#"), False))

    for node in tree.walk():
        if node.kind == "use_declaration" and node.child("argument") is not None:
            flat(node.child("argument"), "")
    return out


def words(name: str) -> list[str]:
    """Lower-case words of a name: separators, humps and acronyms divide; digits don't; a name that isn't ASCII has none."""
    name = name.removeprefix("r#")
    if not name.isascii():
        return []
    parts = re.split("[^A-Za-z0-9]+", re.sub(r"([A-Z])([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z])(?=[A-Z])", r"\1_", name)))
    return [p.lower() for p in parts if p]


def cfg_value(text: str, on: set[str]) -> bool | None:
    """A cfg predicate where listed atoms hold and unlisted ones are unknown; every operand is examined, so an unknown one is never hidden."""
    tokens = re.findall(r'"[^"]*"|\w+|[(),=]', text)
    k = 0

    def one(depth: int) -> bool | None:
        nonlocal k
        if depth > 32 or k >= len(tokens):
            raise ValueError("cfg")
        head = tokens[k]
        k += 1
        if k < len(tokens) and tokens[k] == "(" and head in ("not", "all", "any"):
            k += 1
            values = []
            while tokens[k] != ")":
                values.append(one(depth + 1))
                if tokens[k] == ",":
                    k += 1
            k += 1
            if None in values:
                return None
            return not values[0] if head == "not" else all(values) if head == "all" else any(values)
        if k + 1 < len(tokens) and tokens[k] == "=":
            head = f"{head}={tokens[k + 1]}"
            k += 2
        if head in ("true", "false"):
            return head == "true"
        return True if head in on else None

    value = one(0)
    if k != len(tokens):
        raise ValueError("cfg")
    return value


def child_module_paths(file: str, name: str, is_root: bool) -> tuple[str, str]:
    """The two places of a child module: beside the root file or a ``mod.rs``, else in the folder of the file's stem."""
    folder, _, base = file.rpartition("/")
    at = folder if is_root or base == "mod.rs" else f"{folder}/{base.removesuffix('.rs')}".lstrip("/")
    prefix = f"{at}/" if at else ""
    return f"{prefix}{name}.rs", f"{prefix}{name}/mod.rs"


def module_declarations(tree: Node, source: bytes) -> list[str]:
    """Names that a file declares as modules in other files."""
    return [_name(n, source) for n in tree.children if n.kind == "mod_item" and n.child("body") is None]
