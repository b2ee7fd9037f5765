import random

import pytest

from treeline.functions import edits as plain
from treeline.functions import rust_tree, trivia
from treeline.operators.scratch import settled
from treeline.plans import origin_queries, origins, structural

EDITS = "path string, edit int, start long, end long, size long"
KEPT = "path string, edit int, start long, end long, at long"
HELD = "path string, start int, end int, kind string, protected boolean, owner_kind string, marker_start int, marker_end int"
PIECES = "path string, original_start long, original_end long, output_path string, output_start long"


def _files(spark, sources):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in sources.items()], "path string, source binary")


def _held(spark, sources):
    rows = [(p, t.start, t.end, t.kind, t.protected, t.owner and t.owner.kind, *(trivia.marker(t.owner) or (None, None))) for p, s in sources.items() for t in trivia.inventory(rust_tree.parse(s), s)]
    return spark.createDataFrame(rows, HELD)


@pytest.mark.parametrize("seed", range(2))
def test_pieces_map_every_range_to_its_bytes(spark, seed):
    """Random edits: what a range maps to has its bytes, and ranges map unless an edit cuts them."""
    draw = random.Random(seed)
    sources, edits, new = {}, [], {}
    for path in ("a", "b", "none"):
        source = bytes(draw.choices(range(97, 123), k=60))
        cuts = sorted(draw.sample(range(60), 8)) if path != "none" else []
        made = [plain.Edit(a, b, source[a:b], b"#" * draw.randint(0, 9)) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        edits += [(path, k, e.start, e.end, len(e.replacement)) for k, e in enumerate(made)]
        sources[path], new[path] = source, plain.reconstruct(source, made)
    sizes = spark.createDataFrame([(p, len(s)) for p, s in sources.items()], "path string, size long")
    pieces = settled(origins.copies(sizes, spark.createDataFrame(edits, EDITS), spark.createDataFrame([], KEPT)))
    assert origins.altered(pieces, _files(spark, sources), _files(spark, new)).count() == 0
    asked = [(p, a, a + n) for p in sources for a in range(60) for n in (1, 3) if a + n <= 60]
    for r in origins.mapped(spark.createDataFrame(asked, "path string, s int, e int"), pieces, "s", "e", "went").collect():
        cut = any(p == r.path and max(a, r.s) < min(b, r.e) or (p == r.path and a == b and r.s < a < r.e) for p, _, a, b, _ in edits)
        between = any(p == r.path and r.s < a and b < r.e for p, _, a, b, _ in edits)
        if cut or between:
            assert r.went == []
        elif r.went:
            (w,) = r.went
            assert new[r.path][w.start : w.end] == sources[r.path][r.s : r.e]
        else:  # an edit ends or begins inside
            assert any(p == r.path and (r.s < b < r.e or r.s < a < r.e) for p, _, a, b, _ in edits)


SOURCES = {
    "kept.rs": b"/// about\nfn f() { // why\n    a.unwrap(); // after\n}\n",
    "allowed.rs": b"fn f() { #[allow(x)] a.unwrap(); }\n",
    "inside.rs": b"fn f() { g(/* in */ a).unwrap(); }\n",
}


def test_an_edit_that_gives_an_attribute_another_owner_is_refused(spark):
    files = _files(spark, SOURCES)
    same = {r.path: (r.applicable, r.blockers) for r in structural.replace(files, "$a.unwrap()", '$a.expect("r")').collect()}
    assert same == {p: (True, []) for p in SOURCES}
    rows = {r.path: r for r in structural.replace(files, "$a.unwrap()", "wrap($a)").collect()}
    assert {p: (r.applicable, r.blockers) for p, r in rows.items()} == {"kept.rs": (True, []), "inside.rs": (True, []), "allowed.rs": (False, [origins.ATTACHMENT])}
    assert rows["allowed.rs"].edits is None and rows["allowed.rs"].new_source is None and rows["allowed.rs"].patch is None
    assert bytes(rows["inside.rs"].new_source) == b"fn f() { wrap(g(/* in */ a)); }\n"
    assert structural.replace(files.limit(0), "$a.unwrap()", "$a").count() == 0


def test_copies_inside_a_replacement_count(spark):
    twice = structural.replace(_files(spark, {"t.rs": b"fn f() { one(g(/* c */ a)); // end\n}\n"}), "one($a)", "two($a, $a)").first()
    assert twice.applicable and bytes(twice.new_source).count(b"/* c */") == 2


def test_problems_are_rows(spark):
    old = b"#[a]\nfn f() {}\n/// d\nfn g() {}\n"
    new = b"fn f() {}\n#[a]\n/// d\nfn g() {}\n"  # the attribute went to g
    sizes = spark.createDataFrame([("m", len(old))], "path string, size long")
    pieces = spark.createDataFrame([("m", 5, 15, "m", 0), ("m", 0, 5, "m", 10), ("m", 15, len(old), "m", 15)], PIECES)
    got = {(r.start, r.end, r.problem) for r in origins.verify(_held(spark, {"m": old}), _held(spark, {"m": new}), pieces).collect()}
    assert got == {(0, 4, "owner_moved")}
    assert origins.altered(pieces, _files(spark, {"m": old}), _files(spark, {"m": new})).count() == 0
    cut = origins.copies(sizes, spark.createDataFrame([("m", 0, 16, 18, 0)], EDITS), spark.createDataFrame([], KEPT))
    gone = old[:16] + old[18:]
    got = {(r.start, r.problem) for r in origins.verify(_held(spark, {"m": old}), _held(spark, {"m": gone}), cut).collect()}
    assert got == {(15, "origin_missing")}


def test_moves_between_files_keep_all_trivia_exactly_once(spark):
    old = {"a": b"#[x]\nfn f() {}\n// own\nfn g() {}\n", "b": b"//! file\nfn h() {}\n"}
    pieces = [("a", 0, 15, "b", 19), ("a", 15, len(old["a"]), "a", 0), ("b", 0, len(old["b"]), "b", 0)]
    new = {"a": old["a"][15:], "b": old["b"] + old["a"][:15]}
    check = lambda new, pieces: {(r.path, r.start, r.problem) for r in origins.verify(_held(spark, old), _held(spark, new), spark.createDataFrame(pieces, PIECES), once=True).collect()}
    assert check(new, pieces) == set()
    assert ("a", 0, "origin_ambiguous") in check({**new, "a": old["a"]}, [*pieces, ("a", 0, 15, "a", 0)])
    assert check({**new, "b": new["b"] + b"// new\n"}, pieces) == {("b", len(new["b"]), "trivia_unexpected")}
    assert ("b", 0, "owner_moved") in check({"a": old["b"] + new["a"], "b": old["a"][:15]}, [("a", 0, 15, "b", 0), ("a", 15, len(old["a"]), "a", 19), ("b", 0, 19, "a", 0)])


def test_an_order_is_dealt_once_for_each_reading_of_its_lines(spark):
    """Pieces, ranges and lookups stay where the order's lines were dealt to; only the readings of the table are shuffled."""
    plan = origin_queries.origin_map(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("FileScan parquet") == 3
