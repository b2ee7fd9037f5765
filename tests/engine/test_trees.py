import random

import pytest

from treeline.functions import advice, edits, items, moves, rust_tree, trivia
from treeline.functions.rust_patterns import PatternError, compile_pattern, compile_template, matches
from treeline.functions.tree_queries import QueryError, arity, compile_query, run_query

SOURCE = b"""fn shop() {
    let till = open_till("north");
    till.close(); till.close(now); till.close::<Fast>(); log!(till.close());
    till.close(/* soon */);
    swap(left, right); swap(0, 0); swap(left /* first */, left); swap((a), (a)); swap(a + 1, a+1); swap(0, 0,);
    rate = price * 3 + tax;
    limit(price*3 + tax, "till.close()");
}
"""


def found(pattern, source=SOURCE):
    tree = rust_tree.parse(source)
    return [n.text(source).decode() for n, _ in matches(compile_pattern(pattern), tree, source)]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("$who.close()", ["till.close()", "till.close(/* soon */)"]),
        ("open_till($side)", ['open_till("north")']),
        ("swap($p, $p)", ["swap(0, 0)", "swap(left /* first */, left)", "swap((a), (a))"]),
        ("swap($p, $q)", ["swap(left, right)", "swap(0, 0)", "swap(left /* first */, left)", "swap((a), (a))", "swap(a + 1, a+1)"]),
        ("swap($p, $q,)", ["swap(0, 0,)"]),
        ("$n * 3 + tax", ["price * 3 + tax", "price*3 + tax"]),
    ],
)
def test_golden_patterns(pattern, want):
    assert found(pattern) == want


@pytest.mark.parametrize(
    ("pattern", "code"),
    [("$a.$b()", "UNSUPPORTED_PLACEHOLDER_POSITION"), ("{ 1 }", "UNSUPPORTED_PATTERN_FORM"), ("x as u8", "UNSUPPORTED_PATTERN_FORM"), ("m!(x)", "UNSUPPORTED_PATTERN_FORM"), ("a;", "INVALID_PATTERN"), ("", "INVALID_PATTERN"), ("$", "UNSUPPORTED_PLACEHOLDER_POSITION")],
)
def test_refused_patterns(pattern, code):
    with pytest.raises(PatternError) as e:
        compile_pattern(pattern)
    assert e.value.code == code


def test_templates():
    assert compile_template("$b($a)", ["a", "b"]).expand({"a": b"1", "b": b"f"}) == b"f(1)"
    with pytest.raises(PatternError) as e:
        compile_template("$c", ["a"])
    assert e.value.code == "UNBOUND_METAVARIABLE"


def test_trees_cover_their_source():
    source = b"""//! doc
#![allow(x)]
pub(crate) struct A<'a, T: Clone + 'a> where T: Copy { pub x: &'a [T; 3], y: Option<Vec<Vec<u8>>>, }
impl<'a, T> A<'a, T> { const fn m(&mut self, (a, b): (u8, i32)) -> impl Fn(u8) -> u8 + '_ { move |x| x as u8 + 1 } }
enum E { A(u8), B { x: i32 }, C = 3 }
fn g() -> Result<(), Box<dyn Error>> { let Some(x) = y else { return Ok(()) }; 'a: loop { break 'a; } match x { 1 | 2 if z => {}, A::B { x, .. } => {} ref r @ 3..=4 => (), _ => {} }
  if let Some(q) = w && q > 1 { x.0.1 = 2; } else if a < b { &mut *c } for i in 0..10 { s += i; } unsafe { f::<u8>()?.await } ; let r = r#"a"b"#; A { x: 1, ..d } }
use std::{fmt::{self, Display as D}, io::*};
macro_rules! m { ($a:expr) => { $a }; }
trait T: U { type X: Y; fn f(&self); }
"""
    tree = rust_tree.parse(source)
    assert not tree.broken
    for n in tree.walk():
        assert all(n.start <= c.start <= c.end <= n.end for c in n.children)
        assert all(a.end <= b.start for a, b in zip(n.children, n.children[1:], strict=False))


def test_recovery_keeps_what_follows():
    source = b"fn a() { let = ; x.unwrap(); }\nfn ] b\nfn c() { y.unwrap(); }\n"
    tree = rust_tree.parse(source)
    assert tree.broken and "y.unwrap()" in found("$a.unwrap()", source)
    draw = random.Random(0)
    for _ in range(300):  # any bytes give a tree
        rust_tree.parse(bytes(draw.choice(b"fn(){}[]<>;:,.'\"/*#!=&|x1 \n") for _ in range(60)))


def test_tree_queries():
    tree = rust_tree.parse(SOURCE)
    texts = lambda q: [m.text(SOURCE).decode() for _, m, _ in run_query(compile_query(q), tree, SOURCE)]
    assert texts('((call_expression function: (field_expression field: (field_identifier) @m) arguments: (arguments) @n) @match (#eq? @m "close") (#rust-arity? @n "0"))') == ["till.close()", "till.close(/* soon */)"]
    assert texts("(source_file (function_item name: (identifier) @n) @match)") == [SOURCE.decode().rstrip("\n")]
    assert len(texts("(block_comment) @match")) == 2
    assert texts('(call_expression arguments: (arguments . (string_literal) .)) @match') == ['open_till("north")']
    assert texts('[(integer_literal) (string_literal)] @match') == ['"north"', "0", "0", "1", "1", "0", "0", "3", "3", '"till.close()"']
    assert texts('((call_expression function: (identifier) @f) @match (#match? @f "^s.*p$") (#not-any-of? @f "x"))')[:1] == ["swap(left, right)"]
    for bad, code in [("(a)", "INVALID_QUERY_ROOT"), ("(a) @match @match", "INVALID_QUERY_ROOT"), ("((a) @match (#set! x y))", "INVALID_QUERY"), ("(a", "INVALID_QUERY"), ("", "INVALID_QUERY")]:
        with pytest.raises(QueryError) as e:
            compile_query(bad)
        assert e.value.code in (code, "UNSUPPORTED_QUERY_OPERATION")
    two = rust_tree.parse(b"fn f() { g(a, b,); }")
    assert [arity(n) for n in two.walk() if n.kind == "arguments"] == [2]


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("(arguments ((identifier) @a) (integer_literal) @b) @match", [("(x, 1)", ["x"], ["1"])]),
        ('(arguments ((identifier) @a ",")* (identifier) @b) @match', [("(x, 1)", [], ["x"]), ("(x, y, z)", ["x", "y"], ["z"])]),
        ("(arguments (identifier)* @a (identifier) @b) @match", [("(x, 1)", [], ["x"]), ("(x, y, z)", ["x", "y"], ["z"])]),
        ("(arguments ((identifier) @a . (identifier) @b)) @match", [("(x, y, z)", ["x"], ["y"]), ("(x, y, z)", ["y"], ["z"])]),
        ("(arguments (identifier)? @a (integer_literal) @b) @match", [("(x, 1)", ["x"], ["1"]), ("(1)", [], ["1"])]),
        ("(arguments . (integer_literal) @b .) @match", [("(1)", [], ["1"])]),
        ("(arguments ((identifier) @a (identifier) @b)+) @match", [("(x, y, z)", ["x"], ["y"])]),
        ("(arguments (identifier)+ @a . (integer_literal) @b) @match", [("(x, 1)", ["x"], ["1"])]),
    ],
)
def test_groups_and_quantifiers(query, want):
    source = b"fn f() { g(x, 1); h(x, y, z); k(1); }"
    tree = rust_tree.parse(source)
    got = [(m.text(source).decode(), *([n.text(source).decode() for n in c.get(k, [])] for k in "ab")) for _, m, c in run_query(compile_query(query), tree, source)]
    assert got == want


def test_edits_and_diffs():
    source = b"one\ntwo\nthree"
    made = [edits.Edit(4, 7, b"two", b"2"), edits.Edit(0, 0, b"", b"zero\n")]
    assert edits.reconstruct(source, made) == b"zero\none\n2\nthree"
    assert edits.conflicts([edits.Edit(0, 3, b"", b""), edits.Edit(2, 4, b"", b"")])
    assert edits.conflicts([edits.Edit(3, 3, b"", b"a"), edits.Edit(3, 5, b"", b"")])
    assert not edits.conflicts([edits.Edit(0, 3, b"", b""), edits.Edit(3, 5, b"", b"")])
    assert edits.quoted("a\tb é") == '"a\\tb \\303\\251"' and edits.quoted("src/a.rs") == '"src/a.rs"' and edits.quoted("a\a\v\\") == '"a\\007\\013\\\\"'
    for bad in ("", "/a", "a//b", "a/../b", "./a", "a\0"):
        with pytest.raises(edits.EditError):
            edits.diff_section(bad, source, b"x")
    assert "\\ No newline at end of file" in edits.diff_section("a", source, b"one\ntwo\nthree!")
    assert edits.diff_section("a", source, source) == "" and "/dev/null" in edits.diff_section("a", None, b"x\n")


def test_removal_gaps():
    source = b"fn a() {}\n\nfn b() {}\n\nfn c() {}\n\n  fn d() {}\n"
    of = lambda *names: [(source.index(n), source.index(n) + len(n)) for n in names]
    gone = lambda names, **more: edits.removal_gaps(source, of(*names), **more)
    assert gone([b"fn b() {}"]) == [(9, 22, b"\n\n")]  # four line breaks would stay
    assert gone([b"fn c() {}", b"fn b() {}"]) == [(9, 35, b"\n\n  ")]
    assert gone([b"fn a() {}"]) == [(0, 11, b"\n")]
    assert gone([b"fn d() {}"]) == [(31, len(source), b"\n\n")]
    assert gone([b"fn b() {}"], insertions=[15]) == []
    assert gone([b"fn b() {}"], kept=[(9, 10)]) == [(10, 22, b"\n\n")]
    assert edits.removal_gaps(b"a;b;c", [(2, 4)]) == []


def test_patches_apply(tmp_path):
    import subprocess

    (tmp_path / "a.rs").write_bytes(b"fn a() {}\n\nfn b() { x.unwrap(); }")
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    new = b"fn a() {}\n\nfn b() { x.expect(1); }"
    subprocess.run(["git", "apply", "-"], input=edits.diff_section("a.rs", (tmp_path / "a.rs").read_bytes(), new).encode(), cwd=tmp_path, check=True)
    assert (tmp_path / "a.rs").read_bytes() == new


def test_trivia_cascade():
    source = b"//! in\n// lead\nfn a() {} // same\n\n// --- part ---\nfn b() {}\n\n// alone\n\n/// doc\n#[inline]\nfn c() {}\n"
    got = [(t.classification, t.reason) for t in trivia.inventory(rust_tree.parse(source), source)]
    assert got == [("scope", "scope_prologue"), ("scope", "scope_prologue"), ("trailing", "same_line"), ("ambiguous", "banner"), ("ambiguous", "blank_separator"), ("leading", "outer_attachment"), ("leading", "outer_attachment")]


def test_items_and_words():
    source = b"pub fn a() {}\npub(in crate::x) struct B;\npub(self) const C: u8 = 1;\nimpl B { fn m() {} }\n#[cfg(test)] mod t { }\nuse a::{self, b::{C as D, e}, f::*};\n"
    tree = rust_tree.parse(source)
    assert [(i.kind, i.name, i.visibility) for i in items.inventory(tree, source)] == [
        ("function", "a", "pub"), ("struct", "B", "pub(in crate::x)"), ("const", "C", "private"), ("impl", None, "private"), ("function", "m", "private"), ("module", "t", "private"), ("use", None, "private")
    ]
    assert items.use_leaves(tree, source) == [("a", "a", False), ("a::b::C", "D", False), ("a::b::e", "e", False), ("a::f", None, True)]
    assert items.words("parseHTTPRequest_v2") == ["parse", "http", "request", "v2"] and items.words("größe") == []
    assert items.words("utf8Decode") == ["utf8decode"] and items.words("read_v2Header") == ["read", "v2header"] and items.words("r#IOError2X") == ["io", "error2x"]
    assert items.cfg_value('all(unix, feature = "x")', {"unix", 'feature="x"'}) is True
    assert items.cfg_value("any(unix, other)", {"unix"}) is None and items.cfg_value("not(unix)", {"unix"}) is False and items.cfg_value("any()", set()) is False
    assert items.child_module_paths("src/lib.rs", "a", True) == ("src/a.rs", "src/a/mod.rs") and items.child_module_paths("src/foo.rs", "a", False) == ("src/foo/a.rs", "src/foo/a/mod.rs")


def test_advice():
    source = b"""
fn parse_a() { parse_b() }
fn parse_b() { parse_a() }
struct S;
impl S { fn m(&self) {} }
fn lone() {}
"""
    a = advice.advise("src/x.rs", rust_tree.parse(source), source, balanced=True)
    assert a["outcome"] == "credible_written_candidates"
    assert sorted(c.items for c in a["candidates"]) == [[0, 1], [2, 3]]
    assert [s.label for s in a["signals"] if s.kind == "name_prefix"] == ["parse"]
    for d in a["drafts"]:  # every top-level unit exactly once
        assert sorted(k for g in d.groups for k in g) == [0, 1, 2, 3, 5] and d.groups[0]
    assert "parse" in a["drafts"][0].names
    assert advice.advise("x.rs", rust_tree.parse(b"fn a() {}"), b"fn a() {}")["outcome"] == "insufficient_input"
    assert advice.strongly_connected(5, [(0, 1), (1, 2), (2, 0), (3, 4)]) == [[0, 1, 2]]


def test_moves():
    files = {"src/a.rs": b"use std::fmt::Debug;\n\n/// note\npub(crate) fn go(x: u8) -> u8 { x + help() }\npub fn help() -> u8 { 1 }\nfn stay<T: Debug>(t: T) {}\n", "src/b.rs": b"fn keep() {}\n"}
    module = {"src/a.rs": "crate::a", "src/b.rs": "crate::b"}
    refused = moves.plan_move(files, "src/a.rs", "go", "src/b.rs", module)
    assert not refused.applicable and ("visibility_scope_unproved", "go") in refused.decisions
    plain = {**files, "src/a.rs": files["src/a.rs"].replace(b"pub(crate) fn go", b"fn go")}
    plan = moves.plan_move(plain, "src/a.rs", "go", "src/b.rs", module)
    assert plan.applicable
    after = {p: edits.reconstruct(plain[p], e) for p, e in plan.edits.items()}
    assert b"fn go" not in after["src/a.rs"] and after["src/b.rs"] == b"use crate::a::help;\n\nfn keep() {}\n\n/// note\nfn go(x: u8) -> u8 { x + help() }\n"
    assert moves.plan_move(plain, "src/a.rs", "stay", "src/b.rs", module).applicable
    clash = moves.plan_move({**plain, "src/b.rs": b"fn go() {}\n"}, "src/a.rs", "go", "src/b.rs", module)
    assert ("destination_binding_conflict", "go") in clash.decisions


def test_new_sibling_applies(tmp_path):
    import subprocess

    files = {"src/lib.rs": b"mod a;\n\n#[cfg(test)]\nmod t { }\n", "src/a.rs": b"/// doc\nfn go() -> u8 { 1 }\nfn stay() {}\n"}
    module = {"src/lib.rs": "crate", "src/a.rs": "crate::a"}
    for p, raw in files.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(raw)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    plan = moves.plan_new_sibling(files, "src/a.rs", "go", "b", "src/lib.rs", module)
    assert plan.applicable
    subprocess.run(["git", "apply", "-"], input=plan.patch.encode(), cwd=tmp_path, check=True)
    assert (tmp_path / "src/b.rs").read_bytes() == b"/// doc\nfn go() -> u8 { 1 }\n"
    assert (tmp_path / "src/lib.rs").read_bytes() == b"mod a;\nmod b;\n\n#[cfg(test)]\nmod t { }\n"
    refusals = [moves.plan_new_sibling(files, "src/a.rs", "go", stem, parent, module).decisions[0][0] for stem, parent in [("fn", "src/lib.rs"), ("A", "src/lib.rs"), ("b", "src/x.rs"), ("t", "src/lib.rs")]]
    assert refusals == ["INVALID_NEW_FILE_NAME", "DESTINATION_ALREADY_EXISTS", "INVALID_DECLARATION_PARENT", "MODULE_DECLARATION_CONFLICT"]
    tree = rust_tree.parse(b"fn a() {}\n// c\n#[cfg(test)]\nmod t {}\n")
    assert moves.declaration_point(tree, b"fn a() {}\n// c\n#[cfg(test)]\nmod t {}\n") == 10
