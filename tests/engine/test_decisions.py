import json

import pytest

from treeline.functions import cursors, imports, retention, rust_tree
from treeline.operators import decisions as dec

SCHEMA = "ordinal long, reason string, category string, route string, blocks boolean, consequence string, classes array<string>, item_ids array<long>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [
            (0, "public_path_change", "a", "r", True, "c", ["x", "x", "y"], [1]), (1, "public_path_change", "a", "r", True, "c", None, [2]), (2, "glob_consumer_unrepaired", "b", "r", False, "c", [], []),
            (3, "public_path_change", "a", "r", True, "c", ["x"], [1]), (4, "strange", "b", "r", True, "c", [], [3]),
        ],
        SCHEMA,
    )


def test_groups_runs_and_previews(rows):
    got = {r.reason: (r.decisions, r.first, r.runs) for r in dec.groups(rows).collect()}
    assert got == {"public_path_change": (3, 0, 2), "glob_consumer_unrepaired": (1, 2, 1), "strange": (1, 4, 1)}
    assert sorted((r.first, r.last) for r in dec.runs(rows).collect()) == [(0, 1), (2, 2), (3, 3), (4, 4)]
    shown, left = dec.preview(rows)
    assert [r.ordinal for r in shown.collect()] == [0, 2, 4] and left.first().omitted == 2
    shown, left = dec.preview(rows, 2, plain=True)
    assert [r.ordinal for r in shown.collect()] == [0, 1] and left.first().omitted == 3


def test_summaries(spark, rows):
    got = {(r.reason, r["class"]): (r.decisions, r.first) for r in dec.blocked_summary(rows).collect()}
    assert got == {("public_path_change", "x"): (2, 0), ("public_path_change", "y"): (1, 0), ("public_path_change", None): (1, 1), ("strange", None): (1, 4)}
    got = {r["class"]: r.decisions for r in dec.consequences(rows).collect()}
    assert got == {"public_path_change": 3, "written_context_unprovable": 1, "consumer_outside_supported_repair": 1, "unmapped:strange": 1}
    members = spark.createDataFrame([("g1", 1), ("g2", 2), ("g2", 3)], "group string, item_id long")
    got = {(r.group, r["class"]): r.decisions for r in dec.consequences(rows, members).collect()}
    assert got[("g1", "public_path_change")] == 2 and got[("g2", "public_path_change")] == 1 and got[("g1", "written_context_unprovable")] == 1


def test_cursors():
    now = [0.0]
    held = cursors.Cursors(clock=lambda: now[0])
    request = {"pattern": "$a", "paths": ["b", "a"]}
    token = held.issue(request, "s1", ["x.rs", 3])
    assert held.resume(token, {"paths": ["a", "b", "a"], "pattern": "$a", "cursor": token}, "s1") == ["x.rs", 3]
    for args, code in [((token, {"pattern": "$b"}, "s1"), "CURSOR_SCOPE_MISMATCH"), ((token, request, "s2"), "STALE_CURSOR"), ((token[:-4] + "AAAA", request, "s1"), "INVALID_CURSOR"), (("?", request, "s1"), "INVALID_CURSOR")]:
        with pytest.raises(cursors.CursorError) as e:
            held.resume(*args)
        assert e.value.code == code
    for _ in range(31):
        held.issue(request, "s1", [])
    with pytest.raises(cursors.CursorError):
        held.issue(request, "s1", [])
    now[0] = 901
    with pytest.raises(cursors.CursorError):
        held.resume(token, request, "s1")
    assert cursors.search_status("work", True, True, 0)["has_more"] is None and cursors.search_status(None, True, True, 0)["status"] == "complete"


def test_retained_advice(spark, tmp_path):
    now = [0.0]
    store = retention.Store(clock=lambda: now[0])
    rows = spark.createDataFrame([(f"s/{k}", "a" if k % 2 else "b") for k in range(5)], "id string, reason string")
    handle = store.publish("snap", {"signals": rows}, 100)
    assert [r.id for r in store.page(handle, "snap", "signals", after="s/1", size=2).collect()] == ["s/2", "s/3"]
    assert store.page(handle, "snap", "signals", reason="zzz").count() == 0
    assert [r.id for r in store.records(handle, "snap", "signals", ["s/3", "s/0"]).collect()] == ["s/3", "s/0"]
    for call, code in [
        (lambda: store.records(handle, "snap", "signals", ["s/9"]), "UNKNOWN_ADVICE_ID"), (lambda: store.page(handle, "other", "signals"), "ADVICE_SNAPSHOT_MISMATCH"),
        (lambda: store.page("x", "snap", "signals"), "ADVICE_SNAPSHOT_UNKNOWN"), (lambda: store.page(handle, "snap", "signals", nope="1"), "INVALID_ADVICE_PAGE"),
        (lambda: store.publish("t", {}, 1), "capacity"), (lambda: store.publish("t", {}, 1 << 40), "record_too_large"),
    ]:
        with pytest.raises(retention.AdviceError) as e:
            call()
        assert e.value.code == code
    retention.spill({"signals": rows}, str(tmp_path / "out"), "snap")
    assert spark.read.json(str(tmp_path / "out/signals")).count() == 5
    assert json.loads(spark.read.text(str(tmp_path / "out/index")).first().value)["collections"] == ["signals"]
    now[0] = 901
    with pytest.raises(retention.AdviceError):
        store.page(handle, "snap", "signals")


def test_imports():
    source = b"use a::{b, c as d, self};\nuse e::*;\npub use f::g;\nfn x() { b(); /* d */ \"d\"; a::q(); }\n"
    assert imports.dead_imports(rust_tree.parse(source), source) == (["a::c"], ["e"])
    assert imports.common_region(["crate::a::b", "crate::a::c::d"]) == "crate::a"
