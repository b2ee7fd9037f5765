"""A Rust lexer and recursive-descent parser that yields concrete syntax trees with byte ranges.

Kinds and field names are those of the common Rust tree grammar, so patterns and
tree queries can name them. What cannot be parsed becomes an ERROR node up to the
next statement or item boundary; recovery is conservative, not that of any other
parser. Macro arguments stay token trees.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field


@dataclass(eq=False, slots=True)
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)
    name: str | None = None  # field in the parent
    named: bool = True
    expression: bool = False  # stands where an expression may stand
    parent: Node | None = None
    missing: bool = False

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)

    def significant(self) -> list[Node]:
        return [c for c in self.children if c.kind not in COMMENTS]

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def text(self, source: bytes) -> bytes:
        return source[self.start : self.end]

    @property
    def broken(self) -> bool:
        return any(n.kind == "ERROR" or n.missing for n in self.walk())


COMMENTS = ("line_comment", "block_comment")

# The language's words and marks.
PRIMITIVES = frozenset("u8 i8 u16 i16 u32 i32 u64 i64 u128 i128 isize usize f32 f64 bool str char".split())
KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
MARKS = ["<<=", ">>=", "...", "..=", "::", "->", "=>", "==", "!=", "<=", ">=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<", ">>", ".."]
BINDING = [("||",), ("&&",), ("==", "!=", "<", ">", "<=", ">="), ("|",), ("^",), ("&",), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]
RESUMING = ("fn", "pub", "struct", "enum", "impl", "trait", "mod", "use", "const", "static", "type", "let")
COMPOUND = frozenset("+= -= *= /= %= ^= &= |= <<= >>=".split())
POWER = {op: k for k, ops in enumerate(BINDING) for op in ops}

_WORD = rb"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*"
_SUFFIX = rb"(?:[iu](?:8|16|32|64|128|size))?"
_TOKEN = re.compile(
    rb"\s*(?:(?P<line_comment>//[^\n]*)|(?P<block>/\*)"
    rb"|(?P<raw>(?:br|cr|r)(?P<hashes>#*)\")|(?P<string>[bc]?\"(?:\\.|[^\"\\])*\")"
    rb"|(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\'\x80-\xff]|[\xc0-\xff][\x80-\xbf]+)')|(?P<lifetime>'" + _WORD + rb")"
    rb"|(?P<float>[0-9][0-9_]*(?:\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?(?:f32|f64)?|[eE][+-]?[0-9_]+(?:f32|f64)?|f32|f64|\.(?![.A-Za-z_0-9])))"
    rb"|(?P<int>(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[0-9][0-9_]*)" + _SUFFIX + rb")"
    rb"|(?P<meta>\$" + _WORD + rb")|(?P<word>(?:r#)?" + _WORD + rb")|(?P<mark>" + b"|".join(re.escape(m.encode()) for m in MARKS) + rb"|.)|(?P<stop>\Z))",
    re.S,
)
LITERALS = {"int": "integer_literal", "float": "float_literal", "string": "string_literal", "raw": "raw_string_literal", "char": "char_literal"}


@dataclass(slots=True)
class Token:
    kind: str  # word, meta, lifetime, mark, int, float, string, raw, char, end
    text: str
    start: int
    end: int


def lex(source: bytes) -> tuple[list[Token], list[Node]]:
    """Tokens, and comments as nodes."""
    tokens, comments, at, known = [], [], 0, {}
    match, size = _TOKEN.match, len(source)
    while at < size:
        m = match(source, at)
        kind = m.lastgroup
        if kind == "hashes":
            kind = "raw"
        at, end = m.start(kind), m.end()
        if kind == "stop":
            break
        if kind == "raw":
            stop = source.find(b'"' + m["hashes"], end)
            end = size if stop < 0 else stop + 1 + len(m["hashes"])
        if kind == "block":
            depth, end = 1, at + 2
            while depth and end < size:
                two = source[end : end + 2]
                depth += (two == b"/*") - (two == b"*/")
                end += 2 if two in (b"/*", b"*/") else 1
            comments.append(Node("block_comment", at, end))
        elif kind == "line_comment":
            comments.append(Node(kind, at, end))
        else:
            raw = source[at:end]
            text = known.get(raw)
            if text is None:
                text = known[raw] = raw.decode("utf-8", "replace")
            tokens.append(Token(kind, text, at, end))
        at = end
    tokens.append(Token("end", "", len(source), len(source)))
    return tokens, comments


class Failure(Exception):
    def __init__(self, at: int, what: str):
        super().__init__(what)
        self.at = at


class Parser:
    def __init__(self, source: bytes, patterns: bool = False):
        self.source, self.patterns = source, patterns
        self.tokens, self.comments = lex(source)
        self.k = 0

    # -- tokens; `now` is the one at `k`, looked at far more often than it changes
    @property
    def k(self) -> int:
        return self._k

    @k.setter
    def k(self, at: int) -> None:
        self._k = at
        self.now = self.tokens[at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.k + n, len(self.tokens) - 1)]

    def at(self, *texts: str) -> bool:
        t = self.now
        return t.text in texts and t.kind in ("word", "mark")

    def take(self, text: str | None = None) -> Node:
        """The current token as an anonymous node; ``text`` may be the first part of a longer mark."""
        t = self.now
        if text is not None and t.text != text:
            if t.kind == "mark" and t.text.startswith(text):
                self.tokens[self.k : self.k + 1] = [Token("mark", text, t.start, t.start + len(text)), Token("mark", t.text[len(text) :], t.start + len(text), t.end)]
                self.k = self.k
                t = self.now
            else:
                raise Failure(t.start, f"expected {text}")
        if t.kind == "end":
            raise Failure(t.start, "unexpected end")
        self.k += 1
        return Node(t.text, t.start, t.end, named=False)

    def leaf(self, kind: str) -> Node:
        n = self.take()
        n.kind, n.named = kind, True
        return n

    def word(self, kind: str = "identifier") -> Node:
        t = self.now
        if t.kind != "word" or t.text in KEYWORDS:
            raise Failure(t.start, "expected a name")
        return self.leaf(kind)

    @staticmethod
    def make(kind: str, children: list[Node | None], **fields: Node | None) -> Node:
        kids = [c for c in children if c is not None]
        for name, node in fields.items():
            if node is not None:
                node.name = name
        return Node(kind, kids[0].start, kids[-1].end, kids)

    def listed(self, kind: str, opening: str, closing: str, item) -> Node:
        """Items with commas between brackets."""
        kids = [self.take(opening)]
        while not (self.now.kind == "mark" and self.now.text.startswith(closing)):
            kids.extend(self.attributes())
            made = item()
            kids.extend(made if isinstance(made, list) else [made])
            if self.at(","):
                kids.append(self.take())
            elif not (self.now.kind == "mark" and self.now.text.startswith(closing)):
                raise Failure(self.now.start, f"expected , or {closing}")
        kids.append(self.take(closing))
        return self.make(kind, kids)

    def token_tree(self, kind: str = "token_tree") -> Node:
        pairs = {"(": ")", "[": "]", "{": "}"}
        if self.now.text not in pairs or self.now.kind != "mark":
            raise Failure(self.now.start, "expected a token tree")
        close = pairs[self.now.text]
        kids = [self.take()]
        while not self.at(close):
            if self.now.kind == "end" or self.at(")", "]", "}"):
                raise Failure(self.now.start, "unbalanced token tree")
            if self.at("(", "[", "{"):
                kids.append(self.token_tree())
            else:
                t = self.now
                named = {"word": "identifier", "meta": "metavariable", "lifetime": "lifetime", **LITERALS}.get(t.kind)
                if t.kind == "word" and t.text in PRIMITIVES:
                    named = "primitive_type"
                elif t.kind == "word" and t.text in KEYWORDS:
                    named = {"self": "self", "super": "super", "crate": "crate", "true": "boolean_literal", "false": "boolean_literal"}.get(t.text)
                kids.append(self.leaf(named) if named else self.take())
        kids.append(self.take())
        return self.make(kind, kids)

    # -- whole files
    def file(self) -> Node:
        kids = []
        while self.now.kind != "end":
            kids.append(self.recovering(self.item_or_statement, False))
        root = Node("source_file", 0, len(self.source), kids)
        return finish(root, self.comments)

    def recovering(self, rule, in_block: bool) -> Node:
        begin, k = self.now.start, self.k
        try:
            return rule()
        except (Failure, RecursionError):
            self.k = k
            depth = 0
            kids = []
            while self.now.kind != "end":
                if in_block and depth == 0 and self.at("}"):
                    break
                t = self.now
                line = self.source[self.source.rfind(b"\n", 0, t.start) + 1 : t.start]
                if kids and depth <= 0 and not line.strip() and self.at(*RESUMING):
                    break
                depth += (t.text in ("(", "[", "{") and t.kind == "mark") - (t.text in (")", "]", "}") and t.kind == "mark")
                kids.append(self.leaf("identifier") if t.kind == "word" and t.text not in KEYWORDS else self.take())
                if depth <= 0 and t.kind == "mark" and t.text in (";", "}"):
                    break
            return Node("ERROR", begin, kids[-1].end if kids else begin, kids)

    def attributes(self) -> list[Node]:
        out = []
        while self.at("#") and (self.peek().text == "[" or (self.peek().text == "!" and self.peek(2).text == "[")):
            kids = [self.take()]
            inner = self.at("!")
            if inner:
                kids.append(self.take())
            kids.append(self.take("["))
            path = self.path()
            body = [path]
            if self.at("("):
                body.append(self.token_tree())
                body[-1].name = "arguments"
            elif self.at("="):
                body += [self.take(), self.expression()]
                body[-1].name = "value"
            elif self.at("[", "{"):
                body.append(self.token_tree())
            kids += [self.make("attribute", body), self.take("]")]
            out.append(self.make("inner_attribute_item" if inner else "attribute_item", kids))
        return out

    # -- items
    def item_or_statement(self) -> Node:
        found = self.attributes()
        if found:  # one at a time, as siblings
            self.k = bisect_left(self.tokens, found[0].end, key=lambda t: t.start)
            return found[0]
        if (item := self.item()) is not None:
            return item
        return self.statement()

    def visibility(self) -> Node | None:
        if not self.at("pub"):
            return None
        kids = [self.take()]
        if self.at("(") and self.peek().text in ("crate", "self", "super", "in"):
            kids.append(self.take())
            if self.at("in"):
                kids += [self.take(), self.path()]
            else:
                kids.append(self.leaf(self.now.text))
            kids.append(self.take(")"))
        return self.make("visibility_modifier", kids)

    def item(self) -> Node | None:
        k = self.k
        seen = self.visibility()
        head = [seen]
        t = self.now.text if self.now.kind == "word" else ""
        nxt = self.peek().text
        if t in ("fn",) or (t in ("const", "async", "unsafe", "extern") and self._function_ahead()):
            return self.function(head)
        if t == "struct" or (t == "union" and self.peek().kind == "word" and self.peek(2).text in ("{", "<")):
            return self.structure(head)
        if t == "enum":
            kids = [*head, self.take(), n := self.word("type_identifier"), g := self.generics(), w := self.where(), b := self.listed("enum_variant_list", "{", "}", self.variant)]
            return self.make("enum_item", kids, name=n, type_parameters=g, body=b)
        if t == "type":
            return self.type_alias(head)
        if t in ("const", "static") and (nxt not in ("{", "|", "||", "move")):
            return self.constant(head)
        if t == "trait" or (t == "unsafe" and nxt in ("trait", "auto")) or (t == "auto" and nxt == "trait"):
            kids = [*head]
            while not self.at("trait"):
                kids.append(self.take())
            kids += [self.take(), n := self.word("type_identifier"), g := self.generics()]
            bounds = self.bounds() if self.at(":") else None
            kids += [bounds, w := self.where(), b := self.declarations()]
            return self.make("trait_item", kids, name=n, type_parameters=g, bounds=bounds, body=b)
        if t == "impl" or (t == "unsafe" and nxt == "impl"):
            return self.implementation(head)
        if t == "mod" and self.peek().kind == "word":
            kids = [*head, self.take(), n := self.word()]
            b = self.declarations() if self.at("{") else None
            kids.append(b or self.take(";"))
            return self.make("mod_item", kids, name=n, body=b)
        if t == "use":
            kids = [*head, self.take(), a := self.use_tree(), self.take(";")]
            return self.make("use_declaration", kids, argument=a)
        if t == "extern" and nxt == "crate":
            kids = [*head, self.take(), self.leaf("crate"), n := self.leaf("identifier")]
            alias = None
            if self.at("as"):
                kids += [self.take(), alias := self.word()]
            return self.make("extern_crate_declaration", [*kids, self.take(";")], name=n, alias=alias)
        if t == "extern" and (nxt == "{" or self.peek(2).text == "{"):
            kids = [*head, self.extern_modifier(), b := self.declarations()]
            return self.make("foreign_mod_item", kids, body=b)
        if t == "macro_rules" and nxt == "!":
            kids = [self.take(), self.take("!"), n := self.word(), self.token_tree("token_tree")]
            if self.at(";"):
                kids.append(self.take())
            return self.make("macro_definition", kids, name=n)
        self.k = k
        return None

    def _function_ahead(self) -> bool:
        n = 0
        while self.peek(n).text in ("const", "async", "unsafe", "extern") or self.peek(n).kind == "string":
            n += 1
        return self.peek(n).text == "fn"

    def extern_modifier(self) -> Node:
        kids = [self.take("extern")]
        if self.now.kind == "string":
            kids.append(self.leaf("string_literal"))
        return self.make("extern_modifier", kids)

    def function(self, head: list) -> Node:
        mods = []
        while not self.at("fn"):
            mods.append(self.extern_modifier() if self.at("extern") else self.take())
        kids = [*head, self.make("function_modifiers", mods) if mods else None, self.take("fn")]
        n = self.word() if self.now.kind != "meta" else self.leaf("metavariable")
        g = self.generics()
        p = self.listed("parameters", "(", ")", self.parameter)
        kids += [n, g, p]
        r = None
        if self.at("->"):
            kids += [self.take(), r := self.type()]
        kids.append(self.where())
        b = None if self.at(";") else self.block()
        kids.append(b or self.take(";"))
        return self.make("function_item" if b else "function_signature_item", kids, name=n, type_parameters=g, parameters=p, return_type=r, body=b)

    def parameter(self) -> Node:
        k = self.k
        kids = []
        if self.at("&"):
            kids.append(self.take())
            if self.now.kind == "lifetime":
                kids.append(self.lifetime())
        mut = self.leaf("mutable_specifier") if self.at("mut") else None
        kids.append(mut)
        if self.at("self"):
            kids.append(self.leaf("self"))
            if not self.at(":"):
                return self.make("self_parameter", kids)
            kids += [self.take(), self.type()]
            return self.make("self_parameter", kids)
        self.k = k
        if self.at("..."):
            return self.make("variadic_parameter", [self.take()])
        mut = self.leaf("mutable_specifier") if self.at("mut") else None
        p = self.pattern()
        kids = [mut, p, self.take(":"), t := self.type()]
        return self.make("parameter", kids, pattern=p, type=t)

    def structure(self, head: list) -> Node:
        kind = "struct_item" if self.at("struct") else "union_item"
        kids = [*head, self.take(), n := self.word("type_identifier"), g := self.generics(), self.where()]
        b = None
        if self.at("{"):
            kids.append(b := self.listed("field_declaration_list", "{", "}", self.field_declaration))
        elif self.at("("):
            kids += [b := self.listed("ordered_field_declaration_list", "(", ")", self.ordered_field), self.where(), self.take(";")]
        else:
            kids.append(self.take(";"))
        return self.make(kind, kids, name=n, type_parameters=g, body=b)

    def field_declaration(self) -> Node:
        kids = [self.visibility(), n := self.word("field_identifier"), self.take(":"), t := self.type()]
        return self.make("field_declaration", kids, name=n, type=t)

    def ordered_field(self) -> list[Node]:
        out = [v for v in [self.visibility()] if v]
        t = self.type()
        t.name = "type"
        return [*out, t]

    def variant(self) -> Node:
        kids = [self.visibility(), n := self.word()]
        b = v = None
        if self.at("{"):
            kids.append(b := self.listed("field_declaration_list", "{", "}", self.field_declaration))
        elif self.at("("):
            kids.append(b := self.listed("ordered_field_declaration_list", "(", ")", self.ordered_field))
        if self.at("="):
            kids += [self.take(), v := self.expression()]
        return self.make("enum_variant", kids, name=n, body=b, value=v)

    def type_alias(self, head: list) -> Node:
        kids = [*head, self.take(), n := self.word("type_identifier"), g := self.generics()]
        bounds = self.bounds() if self.at(":") else None
        kids += [bounds, self.where()]
        t = None
        if self.at("="):
            kids += [self.take(), t := self.type(), self.where()]
        kids.append(self.take(";"))
        return self.make("type_item" if t else "associated_type", kids, name=n, type_parameters=g, type=t, bounds=bounds)

    def constant(self, head: list) -> Node:
        kind = "const_item" if self.at("const") else "static_item"
        kids = [*head, self.take()]
        if self.at("mut"):
            kids.append(self.leaf("mutable_specifier"))
        kids += [n := self.leaf("identifier") if self.at("_") else self.word(), self.take(":"), t := self.type()]
        v = None
        if self.at("="):
            kids += [self.take(), v := self.expression()]
        return self.make(kind, [*kids, self.take(";")], name=n, type=t, value=v)

    def implementation(self, head: list) -> Node:
        kids = [*head]
        if self.at("unsafe"):
            kids.append(self.take())
        kids += [self.take("impl"), g := self.generics()]
        if self.at("!"):
            kids.append(self.take())
        first, trait = self.type(), None
        kids.append(first)
        if self.at("for"):
            trait = first
            kids += [self.take(), first := self.type()]
        kids += [self.where(), b := self.declarations()]
        return self.make("impl_item", kids, type_parameters=g, trait=trait, type=first, body=b)

    def declarations(self) -> Node:
        kids = [self.take("{")]
        while not self.at("}"):
            if self.now.kind == "end":
                raise Failure(self.now.start, "expected }")
            kids.append(self.recovering(self.item_or_statement, True))
        kids.append(self.take())
        return self.make("declaration_list", kids)

    def use_tree(self) -> Node:
        if self.at("{"):
            return self.listed("use_list", "{", "}", self.use_tree)
        if self.at("*"):
            return self.make("use_wildcard", [self.take()])
        left = None
        if self.at("::"):
            mark = self.take()
            if self.at("{"):
                tail = self.use_tree()
                return self.make("scoped_use_list", [mark, tail], list=tail)
            n = self.use_name()
            left = self.make("scoped_identifier", [mark, n], name=n)
        else:
            left = self.use_name()
        while self.at("::"):
            mark = self.take()
            if self.at("{"):
                tail = self.listed("use_list", "{", "}", self.use_tree)
                return self.make("scoped_use_list", [left, mark, tail], path=left, list=tail)
            if self.at("*"):
                return self.make("use_wildcard", [left, mark, self.take()])
            n = self.use_name()
            left = self.make("scoped_identifier", [left, mark, n], path=left, name=n)
        if self.at("as"):
            kids = [left, self.take(), a := self.leaf("identifier")]
            return self.make("use_as_clause", kids, path=left, alias=a)
        return left

    def use_name(self) -> Node:
        if self.at("crate", "self", "super"):
            return self.leaf(self.now.text)
        return self.word()

    # -- generics, bounds, types
    def generics(self) -> Node | None:
        return self.listed("type_parameters", "<", ">", self.type_parameter) if self.at("<") else None

    def type_parameter(self) -> Node:
        if self.now.kind == "lifetime":
            n = self.lifetime()
            b = self.bounds() if self.at(":") else None
            return self.make("lifetime_parameter", [n, b], name=n, bounds=b)
        if self.at("const"):
            kids = [self.take(), n := self.word(), self.take(":"), t := self.type()]
            v = None
            if self.at("="):
                kids += [self.take(), v := self.primary(False)]
            return self.make("const_parameter", kids, name=n, type=t, value=v)
        n = self.word("type_identifier")
        b = self.bounds() if self.at(":") else None
        kids, d = [n, b], None
        if self.at("="):
            kids += [self.take(), d := self.type()]
        return self.make("type_parameter", kids, name=n, bounds=b, default_type=d)

    def bounds(self) -> Node:
        kids = [self.take(":")]
        while not self.at("{", ";", ",", "=", ">", "where", ")") and self.now.kind != "end":
            kids.append(self.bound())
            if not self.at("+"):
                break
            kids.append(self.take())
        return self.make("trait_bounds", kids)

    def bound(self) -> Node:
        if self.now.kind == "lifetime":
            return self.lifetime()
        if self.at("?"):
            return self.make("removed_trait_bound", [self.take(), self.type_one()])
        if self.at("("):
            self.take()
            inner = self.bound()
            self.take(")")
            return inner
        return self.type_one()

    def where(self) -> Node | None:
        if not self.at("where"):
            return None
        kids = [self.take()]
        while not self.at("{", ";", "="):
            left = self.lifetime() if self.now.kind == "lifetime" else self.type_one()
            b = self.bounds()
            kids.append(self.make("where_predicate", [left, b], left=left, bounds=b))
            if not self.at(","):
                break
            kids.append(self.take())
        return self.make("where_clause", kids)

    def lifetime(self) -> Node:
        t = self.now
        if t.kind != "lifetime":
            raise Failure(t.start, "expected a lifetime")
        self.k += 1
        return Node("lifetime", t.start, t.end, [Node("'", t.start, t.start + 1, named=False), Node("identifier", t.start + 1, t.end)])

    def type(self) -> Node:
        first = self.type_one()
        if not self.at("+"):
            return first
        kids = [first]
        while self.at("+"):
            kids += [self.take(), self.bound()]
        return self.make("bounded_type", kids)

    def type_one(self) -> Node:
        t = self.now
        if t.kind == "meta":
            return self.leaf("metavariable")
        if t.kind == "mark" and t.text.startswith("&"):
            kids = [self.take("&")]
            if self.now.kind == "lifetime":
                kids.append(self.lifetime())
            if self.at("mut"):
                kids.append(self.leaf("mutable_specifier"))
            kids.append(inner := self.type_one())
            return self.make("reference_type", kids, type=inner)
        if self.at("*"):
            kids = [self.take(), self.leaf("mutable_specifier") if self.at("mut") else self.take("const"), inner := self.type_one()]
            return self.make("pointer_type", kids, type=inner)
        if self.at("("):
            kids = self.listed("tuple_type", "(", ")", self.type)
            if len(kids.children) == 2:
                kids.kind = "unit_type"
            return kids
        if self.at("["):
            kids = [self.take(), e := self.type()]
            n = None
            if self.at(";"):
                kids += [self.take(), n := self.expression()]
            return self.make("array_type", [*kids, self.take("]")], element=e, length=n)
        if self.at("!"):
            return self.make("never_type", [self.take()])
        if self.at("_"):
            return self.leaf("_")
        if self.at("impl"):
            kids = [self.take(), b := self.bound()]
            while self.at("+"):
                kids += [self.take(), self.bound()]
            return self.make("abstract_type", kids, trait=b)
        if self.at("dyn"):
            kids = [self.take(), b := self.bound()]
            return self.make("dynamic_type", kids, trait=b)
        if self.at("for"):
            kids = [self.take(), self.listed("type_parameters", "<", ">", self.type_parameter)]
            inner = self.type_one()
            return self.make("higher_ranked_trait_bound", [self.make("for_lifetimes", kids), inner], type=inner)
        if self.at("fn", "unsafe", "extern"):
            kids = []
            while not self.at("fn"):
                kids.append(self.extern_modifier() if self.at("extern") else self.take())
            kids += [self.take(), p := self.listed("parameters", "(", ")", self.type_in_parameters)]
            r = None
            if self.at("->"):
                kids += [self.take(), r := self.type_one()]
            return self.make("function_type", kids, parameters=p, return_type=r)
        return self.type_path()

    def type_in_parameters(self) -> Node:
        if self.now.kind == "word" and self.peek().text == ":" and self.now.text not in KEYWORDS:
            kids = [p := self.word(), self.take(), t := self.type()]
            return self.make("parameter", kids, pattern=p, type=t)
        return self.type()

    def type_path(self) -> Node:
        left = None
        if self.at("<"):
            left = self.qualified()
        elif self.at("::"):
            pass
        elif self.now.kind == "word" and self.now.text in PRIMITIVES and self.peek().text != "::":
            return self.leaf("primitive_type")
        else:
            left = self.leaf(self.now.text) if self.at("crate", "self", "super") else self.leaf("type_identifier") if self.at("Self") else self.word("type_identifier")
            left = self.generic_type(left)
        while self.at("::") and (self.peek().kind == "word" or self.peek().text == "<"):
            mark = self.take()
            if self.at("<"):
                left = self.make("generic_type", [left, mark, a := self.type_arguments()], type=left, type_arguments=a)
                continue
            if left is not None and left.kind == "type_identifier":
                left.kind = "identifier"
            elif left is not None and left.kind == "scoped_type_identifier":
                left.kind = "scoped_identifier"
                left.children[-1].kind = "identifier"
            n = self.leaf("type_identifier")
            left = self.make("scoped_type_identifier", [left, mark, n], path=left, name=n)
            left = self.generic_type(left)
        if self.at("!") and self.peek().text in ("(", "[", "{"):
            kids = [left, self.take(), self.token_tree()]
            return self.make("macro_invocation", kids, macro=left)
        if left is None:
            raise Failure(self.now.start, "expected a type")
        return left

    def generic_type(self, left: Node) -> Node:
        if self.at("<"):
            a = self.type_arguments()
            return self.make("generic_type", [left, a], type=left, type_arguments=a)
        if self.at("(") and left.kind in ("type_identifier", "scoped_type_identifier") and left.text(self.source).endswith((b"Fn", b"FnMut", b"FnOnce")):
            kids = [left, p := self.listed("parameters", "(", ")", self.type)]
            r = None
            if self.at("->"):
                kids += [self.take(), r := self.type_one()]
            return self.make("function_type", kids, trait=left, parameters=p, return_type=r)
        return left

    def type_arguments(self) -> Node:
        return self.listed("type_arguments", "<", ">", self.type_argument)

    def type_argument(self) -> Node:
        t = self.now
        if t.kind == "lifetime":
            return self.lifetime()
        if t.kind in LITERALS or self.at("true", "false", "-"):
            return self.unary(False)
        if self.at("{"):
            return self.block()
        if t.kind == "word" and self.peek().text in ("=", ":") and t.text not in KEYWORDS:
            n = self.word("type_identifier")
            if self.at(":"):
                b = self.bounds()
                return self.make("constrained_type_parameter", [n, b], left=n, bounds=b)
            kids = [n, self.take(), v := self.type()]
            return self.make("type_binding", kids, name=n, type=v)
        return self.type()

    def qualified(self) -> Node:
        kids = [self.take("<"), t := self.type()]
        if self.at("as"):
            kids += [self.take(), a := self.type()]
            q = self.make("qualified_type", kids[1:], type=t, alias=a)
            kids = [kids[0], q]
        return self.make("bracketed_type", [*kids, self.take(">")])

    # -- patterns
    def pattern(self, alternatives: bool = True) -> Node:
        opened = self.take() if alternatives and self.at("|") else None
        first = self.pattern_one()
        while alternatives and self.at("|"):
            first = self.make("or_pattern", [opened, first, self.take(), self.pattern_one()])
            opened = None
        return first

    def pattern_one(self) -> Node:
        t = self.now
        if t.kind == "meta":
            return self.leaf("metavariable")
        if t.kind == "mark" and t.text.startswith("&"):
            kids = [self.take("&")]
            if self.at("mut"):
                kids.append(self.leaf("mutable_specifier"))
            return self.make("reference_pattern", [*kids, self.pattern_one()])
        if self.at("_"):
            return self.take()
        if self.at(".."):
            return self.make("remaining_field_pattern", [self.take()])
        if self.at("ref"):
            return self.make("ref_pattern", [self.take(), self.pattern_one()])
        if self.at("mut"):
            return self.make("mut_pattern", [self.leaf("mutable_specifier"), self.pattern_one()])
        if self.at("("):
            return self.listed("tuple_pattern", "(", ")", self.pattern)
        if self.at("["):
            return self.listed("slice_pattern", "[", "]", self.pattern)
        if t.kind in LITERALS or self.at("-", "true", "false"):
            return self.range_pattern(self.literal_pattern())
        if self.at("const") and self.peek().text == "{":
            return self.make("const_block", [self.take(), self.block()])
        left = self.path()
        if self.at("!"):
            return self.macro(left)
        if self.at("("):
            left.name = "type"
            p = self.listed("tuple_struct_pattern", "(", ")", self.pattern)
            return self.make("tuple_struct_pattern", [left, *p.children], type=left)
        if self.at("{"):
            p = self.listed("struct_pattern", "{", "}", self.field_pattern)
            return self.make("struct_pattern", [left, *p.children], type=left)
        if self.at("@"):
            return self.make("captured_pattern", [left, self.take(), self.pattern_one()])
        return self.range_pattern(left)

    def literal_pattern(self) -> Node:
        if self.at("-"):
            return self.make("negative_literal", [self.take(), self.literal()])
        return self.literal()

    def range_pattern(self, left: Node) -> Node:
        if not self.at("..=", "...", "..") or (self.at("..") and self.peek().text in (",", ")", "]", "}")):
            return left
        kids = [left, self.take()]
        if self.now.kind in LITERALS or self.at("-"):
            kids.append(self.literal_pattern())
        elif self.now.kind == "word" and self.now.text not in ("if",):
            kids.append(self.path())
        return self.make("range_pattern", kids)

    def field_pattern(self) -> Node:
        if self.at(".."):
            return self.make("remaining_field_pattern", [self.take()])
        head = []
        if self.at("ref"):
            head.append(self.take())
        if self.at("mut"):
            head.append(self.leaf("mutable_specifier"))
        if not head and self.peek().text == ":":
            kids = [n := self.leaf("field_identifier"), self.take(), p := self.pattern()]
            return self.make("field_pattern", kids, name=n, pattern=p)
        n = self.word("shorthand_field_identifier")
        return self.make("field_pattern", [*head, n], name=n)

    # -- statements and blocks
    def block(self) -> Node:
        label = None
        if self.now.kind == "lifetime":
            label = self.make("label", [self.lifetime(), ])
            self.take(":")
        kids = [label, self.take("{")]
        while not self.at("}"):
            if self.now.kind == "end":
                raise Failure(self.now.start, "expected }")
            kids.append(self.recovering(self.item_or_statement, True))
        kids.append(self.take())
        node = self.make("block", kids)
        node.expression = True
        return node

    #: Statements of these kinds need no semicolon.
    BLOCKISH = frozenset("block unsafe_block async_block const_block if_expression match_expression while_expression loop_expression for_expression".split())

    def statement(self) -> Node:
        if self.at(";"):
            return self.make("empty_statement", [self.take()])
        if self.at("let"):
            kids = [self.take()]
            if self.at("mut"):
                kids.append(self.leaf("mutable_specifier"))
            kids.append(p := self.pattern())
            t = v = e = None
            if self.at(":"):
                kids += [self.take(), t := self.type()]
            if self.at("="):
                kids += [self.take(), v := self.expression()]
                if self.at("else"):
                    kids += [self.take(), e := self.block()]
            return self.make("let_declaration", [*kids, self.take(";")], pattern=p, type=t, value=v, alternative=e)
        begin = self.k
        if self.now.text in ("{", "unsafe", "async", "if", "match", "while", "loop", "for") or (self.now.kind == "lifetime" and self.peek().text == ":"):
            first = self.primary(True)
            if first.kind in self.BLOCKISH and not self.at(".", "?"):
                return self.make("expression_statement", [first, self.take()] if self.at(";") else [first]) if not self.at("}") else first
            self.k = begin
        e = self.expression()
        if self.at(";"):
            return self.make("expression_statement", [e, self.take()])
        if self.at("}") or self.now.kind == "end":
            return e
        if e.kind in self.BLOCKISH:
            return self.make("expression_statement", [e])
        if e.kind == "macro_invocation" and e.children[-1].kind == "token_tree" and self.source[e.end - 1 : e.end] == b"}":
            return self.make("expression_statement", [e])
        raise Failure(self.now.start, "expected ;")

    # -- expressions
    def expression(self, structs: bool = True) -> Node:
        return self.assignment(structs)

    def marked(self, node: Node) -> Node:
        node.expression = True
        return node

    def assignment(self, structs: bool) -> Node:
        left = self.range(structs)
        if self.at("="):
            kids = [left, self.take(), r := self.assignment(structs)]
            return self.marked(self.make("assignment_expression", kids, left=left, right=r))
        if self.now.kind == "mark" and self.now.text in COMPOUND:
            kids = [left, o := self.take(), r := self.assignment(structs)]
            return self.marked(self.make("compound_assignment_expr", kids, left=left, operator=o, right=r))
        return left

    def range(self, structs: bool) -> Node:
        if self.at("..", "..="):
            kids = [self.take()]
            if self.starts(structs):
                kids.append(self.binary(structs, 0))
            return self.marked(self.make("range_expression", kids))
        left = self.binary(structs, 0)
        if self.at("..", "..=", "..."):
            kids = [left, self.take()]
            if self.starts(structs):
                kids.append(self.binary(structs, 0))
            return self.marked(self.make("range_expression", kids))
        return left

    def starts(self, structs: bool) -> bool:
        t = self.now
        if t.kind in ("meta", *LITERALS) or (t.kind == "lifetime" and self.peek().text == ":"):
            return True
        if t.kind == "word":
            return t.text not in KEYWORDS or t.text in "self Self super crate true false if match loop while for unsafe async move return break continue".split()
        return t.text in ("(", "[", "-", "*", "!", "&", "&&", "|", "||", "<", "::") or (t.text == "{" and structs)

    def binary(self, structs: bool, least: int) -> Node:
        left = self.unary(structs)
        while True:
            if self.at("as"):
                kids = [left, self.take(), t := self.type_one()]
                left = self.marked(self.make("type_cast_expression", kids, value=left, type=t))
                continue
            op = self.now.text if self.now.kind == "mark" else ""
            power = POWER.get(op, -1)
            if power < least:
                return left
            o = self.take()
            right = self.binary(structs, power + 1)
            left = self.marked(self.make("binary_expression", [left, o, right], left=left, operator=o, right=right))

    def unary(self, structs: bool) -> Node:
        if self.at("-", "*", "!"):
            return self.marked(self.make("unary_expression", [self.take(), self.unary_cast(structs)]))
        if self.now.kind == "mark" and self.now.text.startswith("&") and self.now.text in ("&", "&&"):
            kids = [self.take("&")]
            if self.at("raw") and self.peek().text in ("const", "mut"):
                kids += [self.take(), self.take()]
            elif self.at("mut"):
                kids.append(self.leaf("mutable_specifier"))
            kids.append(v := self.unary_cast(structs))
            return self.marked(self.make("reference_expression", kids, value=v))
        return self.postfix(self.primary(structs))

    def unary_cast(self, structs: bool) -> Node:
        return self.unary(structs)

    def postfix(self, left: Node) -> Node:
        while True:
            if self.at("?"):
                left = self.marked(self.make("try_expression", [left, self.take()]))
            elif self.at("("):
                a = self.listed("arguments", "(", ")", self.expression)
                left = self.marked(self.make("call_expression", [left, a], function=left, arguments=a))
            elif self.at("["):
                left = self.marked(self.make("index_expression", [left, self.take(), self.expression(), self.take("]")]))
            elif self.at("."):
                dot = self.take()
                if self.at("await"):
                    left = self.marked(self.make("await_expression", [left, dot, self.take()]))
                    continue
                t = self.now
                if t.kind == "float" and re.fullmatch(r"\d+\.\d*", t.text):  # x.0.1
                    a, _, b = t.text.partition(".")
                    cut = t.start + len(a)
                    parts = [Token("int", a, t.start, cut), Token("mark", ".", cut, cut + 1)]
                    self.tokens[self.k : self.k + 1] = [*parts, *([Token("int", b, cut + 1, t.end)] if b else [])]
                    self.k = self.k
                if self.now.kind == "int":
                    f = self.leaf("integer_literal")
                elif self.now.kind == "meta":
                    raise Failure(self.now.start, "placeholder")
                else:
                    f = self.word("field_identifier")
                left = self.marked(self.make("field_expression", [left, dot, f], value=left, field=f))
                if self.at("::"):
                    mark = self.take()
                    a = self.type_arguments()
                    left = self.marked(self.make("generic_function", [left, mark, a], function=left, type_arguments=a))
            else:
                return left

    def literal(self) -> Node:
        t = self.now
        if t.kind in LITERALS:
            node = self.leaf(LITERALS[t.kind])
        elif self.at("true", "false"):
            node = self.leaf("boolean_literal")
        else:
            raise Failure(t.start, "expected a literal")
        return self.marked(node)

    def path(self) -> Node:
        """A path in expression or pattern position."""
        left = None
        if self.at("<"):
            left = self.qualified()
        elif not self.at("::"):
            left = self.leaf(self.now.text) if self.at("self", "super", "crate") else self.leaf("identifier") if self.at("Self") else self.word()
        while self.at("::"):
            mark = self.take()
            if self.at("<"):
                a = self.type_arguments()
                kind = "generic_function"
                left = self.make(kind, [left, mark, a], function=left, type_arguments=a)
                continue
            if self.now.kind == "meta":
                raise Failure(self.now.start, "placeholder")
            if left is not None and left.kind == "generic_function":
                left.kind = "generic_type"
                left.children[0].name = "type"
                if left.children[0].kind == "identifier":
                    left.children[0].kind = "type_identifier"
            n = self.leaf(self.now.text) if self.at("self", "super", "crate") else self.word()
            left = self.make("scoped_identifier", [left, mark, n], path=left, name=n)
        if left is None:
            raise Failure(self.now.start, "expected a path")
        return left

    def macro(self, path: Node) -> Node:
        kids = [path, self.take("!"), self.token_tree()]
        return self.marked(self.make("macro_invocation", kids, macro=path))

    def primary(self, structs: bool) -> Node:
        t = self.now
        if t.kind == "meta":
            return self.marked(self.leaf("metavariable"))
        if t.kind in LITERALS or self.at("true", "false"):
            return self.literal()
        if t.kind == "lifetime":
            label = self.make("label", [self.lifetime(), self.take(":")])
            inner = self.primary(structs)
            inner.children.insert(0, label)
            inner.start = label.start
            return inner
        if t.kind == "mark":
            if t.text == "(":
                return self.parenthesis()
            if t.text == "[":
                return self.array()
            if t.text == "{":
                return self.block()
            if t.text in ("|", "||"):
                return self.closure([])
            if t.text not in ("<", "::"):
                raise Failure(t.start, "expected an expression")
        rule = {
            "if": self.conditional, "match": self.matching, "while": self.loop, "loop": self.loop, "for": self.loop, "unsafe": self.prefixed_block, "async": self.prefixed_block,
            "const": self.prefixed_block, "move": self.prefixed_block, "static": self.prefixed_block, "return": self.leaving, "break": self.leaving, "continue": self.leaving, "let": self.let_condition,
        }.get(t.text if t.kind == "word" else "")
        if rule:
            return self.marked(rule(structs))
        if t.kind == "word" and t.text in PRIMITIVES and self.peek().text == "::":
            left = self.leaf("identifier")
            self.k -= 1
        left = self.path()
        if self.at("!") and self.peek().text in ("(", "[", "{") and left.kind in ("identifier", "scoped_identifier"):
            return self.macro(left)
        if structs and self.at("{") and left.kind in ("identifier", "scoped_identifier", "generic_function") and self.struct_ahead():
            return self.structure_value(left)
        return self.marked(left)

    def struct_ahead(self) -> bool:
        a, b = self.peek(), self.peek(2)
        return a.text in ("}", "..", "#") or ((a.kind in ("word", "int")) and b.text in (":", ",", "}") and a.text not in KEYWORDS)

    def structure_value(self, left: Node) -> Node:
        if left.kind == "identifier":
            left.kind = "type_identifier"
        elif left.kind == "scoped_identifier":
            left.kind = "scoped_type_identifier"
            left.children[-1].kind = "type_identifier"
        else:
            left.kind = "generic_type_with_turbofish"
            left.children[0].name = "type"
        b = self.listed("field_initializer_list", "{", "}", self.field_initializer)
        return self.marked(self.make("struct_expression", [left, b], name=left, body=b))

    def field_initializer(self) -> Node:
        if self.at(".."):
            kids = [self.take()]
            if not self.at("}"):
                kids.append(self.expression())
            return self.make("base_field_initializer", kids)
        if self.peek().text == ":":
            kids = [f := self.leaf("integer_literal" if self.now.kind == "int" else "field_identifier"), self.take(), v := self.expression()]
            return self.make("field_initializer", kids, field=f, value=v)
        return self.make("shorthand_field_initializer", [self.marked(self.word())])

    def parenthesis(self) -> Node:
        kids, commas = [self.take("(")], 0
        while not self.at(")"):
            kids.extend(self.attributes())
            kids.append(self.expression())
            if self.at(","):
                commas += 1
                kids.append(self.take())
            elif not self.at(")"):
                raise Failure(self.now.start, "expected )")
        kids.append(self.take())
        kind = "unit_expression" if len(kids) == 2 else "tuple_expression" if commas else "parenthesized_expression"
        return self.marked(self.make(kind, kids))

    def array(self) -> Node:
        kids, length = [self.take("[")], None
        while not self.at("]"):
            kids.extend(self.attributes())
            kids.append(self.expression())
            if self.at(";"):
                kids += [self.take(), length := self.expression()]
            elif self.at(","):
                kids.append(self.take())
            elif not self.at("]"):
                raise Failure(self.now.start, "expected ]")
        return self.marked(self.make("array_expression", [*kids, self.take()], length=length))

    def closure(self, head: list[Node]) -> Node:
        if self.at("||"):
            t = self.now
            self.k += 1
            p = Node("closure_parameters", t.start, t.end, [Node("|", t.start, t.start + 1, named=False), Node("|", t.end - 1, t.end, named=False)])
        else:
            kids = [self.take("|")]
            while not self.at("|"):
                one = self.pattern(False)
                if self.at(":"):
                    one = self.make("parameter", [one, self.take(), ty := self.type()], pattern=one, type=ty)
                kids.append(one)
                if self.at(","):
                    kids.append(self.take())
            p = self.make("closure_parameters", [*kids, self.take()])
        kids, r = [*head, p], None
        if self.at("->"):
            kids += [self.take(), r := self.type_one()]
        b = self.block() if r is not None else self.expression()
        return self.marked(self.make("closure_expression", [*kids, b], parameters=p, return_type=r, body=b))

    def prefixed_block(self, structs: bool) -> Node:
        head = []
        while self.at("unsafe", "async", "const", "move", "static"):
            head.append(self.take())
        if self.at("|", "||"):
            return self.closure(head)
        kind = {"unsafe": "unsafe_block", "const": "const_block"}.get(head[0].kind, "async_block")
        return self.make(kind, [*head, self.block()])

    def condition(self) -> Node:
        first = self.expression(False)
        return first

    def let_condition(self, structs: bool) -> Node:
        kids = [self.take(), p := self.pattern(), self.take("="), v := self.binary(False, POWER["&&"] + 1)]
        return self.make("let_condition", kids, pattern=p, value=v)

    def conditional(self, structs: bool) -> Node:
        kids = [self.take(), c := self.condition(), b := self.block()]
        e = None
        if self.at("else"):
            mark = self.take()
            e = self.make("else_clause", [mark, self.marked(self.conditional(structs)) if self.at("if") else self.block()])
            kids.append(e)
        return self.make("if_expression", kids, condition=c, consequence=b, alternative=e)

    def matching(self, structs: bool) -> Node:
        kids = [self.take(), v := self.expression(False)]
        arms = [self.take("{")]
        while not self.at("}"):
            own = self.attributes()
            p = self.pattern()
            guard = []
            if self.at("if"):
                guard = [self.take(), c := self.expression()]
                c.name = "condition"
            pattern = self.make("match_pattern", [p, *guard])
            mark = self.take("=>")
            value = self.block() if self.at("{") else self.expression()
            if value.kind == "block" and self.at(".", "?"):
                value = self.postfix(value)
            tail = [self.take()] if self.at(",") else []
            arms.append(self.make("match_arm", [*own, pattern, mark, value, *tail], pattern=pattern, value=value))
        b = self.make("match_block", [*arms, self.take()])
        return self.make("match_expression", [*kids, b], value=v, body=b)

    def loop(self, structs: bool) -> Node:
        kind = self.now.text
        kids = [self.take()]
        if kind == "for":
            kids += [p := self.pattern(), self.take("in"), v := self.expression(False), b := self.block()]
            return self.make("for_expression", kids, pattern=p, value=v, body=b)
        c = self.condition() if kind == "while" else None
        b = self.block()
        return self.make(f"{kind}_expression", [*kids, c, b], condition=c, body=b)

    def leaving(self, structs: bool) -> Node:
        kind = self.now.text
        kids = [self.take()]
        if kind != "return" and self.now.kind == "lifetime":
            kids.append(self.make("label", [self.lifetime()]))
        if kind != "continue" and self.starts(structs):
            kids.append(self.expression(structs))
        return self.make(f"{kind}_expression", kids)


def finish(root: Node, comments: list[Node]) -> Node:
    """Put comments where they lie and link parents."""
    for comment in comments:
        node = root
        while True:
            inner = next((c for c in node.children if c.start < comment.start and comment.end < c.end or (c.start <= comment.start and comment.end < c.end and c.children)), None)
            if inner is None or not inner.children:
                break
            node = inner
        at = next((k for k, c in enumerate(node.children) if c.start >= comment.end), len(node.children))
        node.children.insert(at, comment)
    for node in root.walk():
        for c in node.children:
            c.parent = node
    return root


def parse(source: bytes) -> Node:
    """The tree of a whole file."""
    return Parser(source).file()
