import pytest

from treeline.operators.scratch import settled
from treeline.plans import structural, twigs

SOURCES = {
    "a.rs": b'fn shop() { till.close(); till.close(now); till.close(/* soon */); swap(left /* first */, left); swap((a), (a)); swap(a + 1, a+1); swap(0, 0,); x = y * 3 + tax; }\n',
    "b.rs": "fn ü() { let é = [1, 2, 3][i].close().close(); (swap(swap(0, 0), swap(0, 0)), !f(-1)?.await, &mut *q, 1..=2, a += \"é\") }".encode(),
    "c.rs": b"fn broken( { swap(1, 1) }\nfn g() { swap(2, 2); ",
    "d.rs": b"",
}
PATTERNS = [
    "$who.close()", "swap($p, $p)", "swap($p, $q)", "swap($p, $q,)", "$n * 3 + tax", "$a", "till", "0", "swap(swap($a, $a), $b)", "$a[$i]", "[$a, $b, $c]", "!$a", "$a?", "$a.await",
    "f(-1)?.await", "&mut $a", "*$a", "$a..=$b", "$a += $b", "($a)", '"é"', "swap($p /* any */, $q)", "nothing.here()",
]


@pytest.fixture(scope="module")
def sources(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in SOURCES.items()], "path string, source binary")
    return files, settled(twigs.node_table(files))


def _rows(found):
    return sorted((r.path, r.match_ordinal, r.start_byte, r.end_byte, r.start_line, r.start_col, r.end_line, r.end_col, r.text, {k: [tuple(x) for x in v] for k, v in r.captures.items()}) for r in found.collect())


@pytest.mark.parametrize("pattern", PATTERNS)
def test_joins_find_what_the_walk_finds(sources, pattern):
    files, table = sources
    assert _rows(twigs.search(table, files, pattern)) == _rows(structural.search(files, pattern))


def test_nothing_is_parsed_again(sources, capsys):
    files, table = sources
    twigs.search(table, files, "swap($p, $p)").explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" not in plan and "PushedFilters" in plan and "EqualTo(kind" in plan


def test_a_file_beyond_the_guard_says_so(sources, monkeypatch):
    files, table = sources
    monkeypatch.setattr(structural, "MAX_CANDIDATES", 3)
    rows = {(r.path, r.match_ordinal, r.stopped) for r in twigs.search(table, files, "swap($p, $q)").collect()}
    assert ("a.rs", 0, None) in rows and ("b.rs", 2, None) in rows
    rows = twigs.search(table, files, "$a").collect()
    assert {(r.path, r.match_ordinal, r.text, r.stopped) for r in rows if r.path == "a.rs"} == {("a.rs", None, None, structural.CANDIDATE_LIMIT)}
