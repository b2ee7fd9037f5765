import random

import pytest
from pyspark.sql import functions as F

from treeline.functions import binding_sites as sites
from treeline.functions import rust_tree
from treeline.operators import intervals
from treeline.operators.scratch import settled
from treeline.plans import scopes

#: (source with the use marked by @, its name, binding, reason, text of the witness)
CASES = [
    ("fn f(a: u8) { @a; }", "independent", None, "a"),
    ("fn f() { @a; }", "absent", None, None),
    ("fn f(a: u8) { let a = @a; }", "independent", None, "a"),
    ("fn f() { let a = 1; { let a = 2; } @a; }", "independent", None, "a"),
    ("fn f(v: u8) { let a = 1; let a = g(v) else { @a; return }; }", "independent", None, "a"),
    ("fn f() { @a; let a = 1; }", "absent", None, None),
    ("fn f() { @a(); fn a() {} }", "independent", None, "fn a() {}"),
    ("fn f() { let x: @a; const a: u8 = 1; }", "uncertain", sites.TYPE_POSITION, "const a: u8 = 1;"),
    ("fn f<T>(x: @T) {}", "independent", None, "T"),
    ("fn f<const N: usize>() { @N; }", "independent", None, "const N: usize"),
    ("fn f(a: u8) { for a in g() { @a; } }", "uncertain", sites.BINDING_OR_CONSTANT, "a"),
    ("fn f() { for mut a in g() { @a; } }", "independent", None, "a"),
    ("fn f() { for a in @a {} }", "absent", None, None),
    ("fn f() { match m { Some(a) if @a > 1 => 1, _ => 2 } }", "independent", None, "a"),
    ("const a: u8 = 1; fn f() { match m { Some(a) => @a, _ => 2 } }", "uncertain", sites.BINDING_OR_CONSTANT, "a"),
    ("enum E { a, b(u8) } fn f() { match m { Some(a) => @a, _ => 2 } }", "uncertain", sites.BINDING_OR_CONSTANT, "a"),
    ("enum E { a, b(u8) } fn f() { match m { Some(b) => @b, _ => 2 } }", "independent", None, "b"),
    ("use x::*; fn f() { if let Some(a) = g() { @a; } }", "uncertain", sites.BINDING_OR_CONSTANT, "a"),
    ("use x::*; mod m { fn f() { if let Some(a) = g() { @a; } } }", "independent", None, "a"),
    ("fn f() { if let Some(a) = g() && let Some(b) = @a { b; } }", "independent", None, "a"),
    ("fn f() { if let Some(a) = g() { 1 } else { @a } }", "absent", None, None),
    ("fn f() { while let S { a, .. } = g() { @a; } }", "independent", None, "a"),
    ("fn f() { match m { R { v: 1 } | R { v: 2 } => @a::b(), _ => 0 } }", "absent", None, None),
    ("fn f() { match m { R { a } | R { a } => @a::b(), _ => 0 } }", "uncertain", sites.UNSUPPORTED, "a"),
    ("fn f() { match m { R { v: p!() } => @a, _ => 0 } }", "uncertain", sites.UNSUPPORTED, "p!()"),
    ("fn f() { match m { a @ (1 | 2) => @a, _ => 0 } }", "independent", None, "a"),
    ("fn f() { let h = |a, b: u8| @a + b; }", "independent", None, "a"),
    ("fn f() { use x::a; @a(); }", "uncertain", sites.LOCAL_IMPORT, "use x::a;"),
    ("fn f() { use x::*; let a = 1; @a; }", "independent", None, "a"),
    ("fn f() { use x::*; @a; }", "uncertain", sites.LOCAL_IMPORT, "use x::*;"),
    ("fn f(a: u8) { fn g() { @a; } }", "uncertain", sites.CONDITIONAL, None),
    ("fn f(a: u8) { fn g(a: u8) { @a; } }", "independent", None, "a"),
    ("fn f(a: u8) { m!(); @a; }", "uncertain", sites.UNSUPPORTED, "m!();"),
    ("fn f(a: u8) { @a; m!(); }", "uncertain", sites.UNSUPPORTED, "m!();"),
    ("fn f(a: u8) { #[cfg(x)] let b = 1; @a; }", "uncertain", sites.CONDITIONAL, "#[cfg(x)]"),
    ("fn f(a: u8) { #[allow(x)] let b = 1; @a; }", "uncertain", sites.CONDITIONAL, "b"),
    ("fn f(a: u8) { mod m { fn g() { @a; } } }", "absent", None, None),
    ("fn f(a: u8) { let r#b = 1; @b; }", "independent", None, "r#b"),
    ("#[inline] fn f(a: u8) { @a; }", "uncertain", sites.CONDITIONAL, "a"),
]


@pytest.fixture(scope="module")
def assessed(spark):
    rows = [(f"{k:02d}.rs", bytearray(_plain(c[0])[0].encode())) for k, c in enumerate(CASES)]
    files = spark.createDataFrame(rows, "path string, source binary")
    facts = settled(scopes.fact_table(files))
    return facts, {(r.path, r.start_byte): r for r in scopes.assess(facts).collect()}


def _plain(marked):
    """The source without its mark, which is the last @ (a capture holds another), and the place it marked."""
    at = marked.rindex("@") if not marked.count("=> @") else marked.index("=> @") + 3
    return marked[:at] + marked[at + 1 :], at


@pytest.mark.parametrize("k", range(len(CASES)))
def test_uses_meet_the_binding_written_for_them(assessed, k):
    marked, binding, reason, witness = CASES[k]
    source, at = _plain(marked)
    r = assessed[1][f"{k:02d}.rs", at]
    got = source[r.witness_start : r.witness_end] if r.witness_start is not None else None
    assert (r.binding, r.reason, got) == (binding, reason, witness)


def test_macros_tell_on_which_side_they_stand(assessed):
    found = {CASES[int(p[:2])][0]: r.witness_relation for (p, _), r in assessed[1].items() if r.witness_relation}
    assert found == {"fn f(a: u8) { m!(); @a; }": "statement_macro_before_reference", "fn f(a: u8) { @a; m!(); }": "block_macro_may_introduce_items"}


def test_assessment_against_a_loop_over_all_facts_of_a_file(assessed):
    """Every use against every fact of its file, without sorting or sums."""
    facts, found = assessed
    wanted = 0
    for k, case in enumerate(CASES):
        source = _plain(case[0])[0].encode()
        own = sites.facts(rust_tree.parse(source), source)
        for use in (f for f in own if f.role == "use"):
            around = [f for f in own if f.role in ("scope", "barrier") and f.module == use.module and f.at <= use.at < f.until and f.name in (None, use.name)]
            best = max(around, key=lambda f: (f.role == "barrier", f.scope, -f.rank, f.at, -f.seq, f.name is not None), default=None)
            r = found[f"{k:02d}.rs", use.at]
            wanted += 1
            assert (r.binding == "absent") == (best is None)
            if best is not None and r.reason != sites.TYPE_POSITION:
                assert r.witness_start == (best.witness.start if best.witness else None)
    assert wanted == len(found)


def test_binders_and_their_uses(assessed):
    got: dict[str, list] = {}
    for r in scopes.pattern_binders(assessed[0]).collect():
        got.setdefault(r.path, []).append((r.start_byte, r.uses))
    places = lambda k: [i for i, c in enumerate(_plain(CASES[k][0])[0]) if c == "a"]
    bound, used = places(0)
    assert got["00.rs"] == [(bound, [used])]
    outer, shadow, inner, last = (CASES[3][0].replace("@", "").index(t) for t in ("a = 1", "a = 2", "a = 2", "a; }"))
    assert sorted(got["03.rs"]) == [(outer, [last]), (shadow, [])] and inner == shadow
    assert got["10.rs"] == [(places(10)[0], [])]  # the parameter; the loop's name is not proved
    assert not {"14.rs", "15.rs", "17.rs", "23.rs", "32.rs"} & {p for p, held in got.items() if any(uses for _, uses in held)}


@pytest.mark.parametrize("seed", range(3))
def test_innermost_against_brute_force(spark, seed):
    draw = random.Random(seed)
    rows, points = [], []

    def nest(key, a, b, depth):
        while a < b and depth < 6:
            end = draw.randint(a, b)
            rows.append((key, a, end, depth, len(rows)))
            nest(key, a, end, depth + 1)
            a = end + draw.randint(0, 2)

    for key in ("x", "y", None):
        nest(key, 0, 40, 0)
        points += [(key, p, k) for k, p in enumerate([*range(-1, 44), 7, 7])]
    held = spark.createDataFrame(rows, "key string, at int, until int, depth int, id int")
    asked = spark.createDataFrame(points, "key string, p int, k int")
    got = {(r.key, r.p, r.k): r.met for r in intervals.innermost(asked, held, ["key"], "p", [F.col("depth")], "id", "met").collect()}
    assert len(got) == len(points)
    for key, p, k in points:
        around = [r for r in rows if key is not None and r[0] == key and r[1] <= p < r[2]]
        assert got[key, p, k] == max(around, key=lambda r: r[3], default=(None,) * 5)[4]


def test_empty_and_broken_files(spark):
    files = spark.createDataFrame([("a.rs", bytearray(b"")), ("b.rs", bytearray(b"fn f(a: u8) { g(a; }"))], "path string, source binary")
    found = scopes.assess(scopes.fact_table(files)).collect()
    assert found and {(r.path, r.binding, r.reason) for r in found} == {("b.rs", "uncertain", sites.RECOVERY)}
    assert scopes.assess(scopes.fact_table(files.limit(0))).count() == 0
