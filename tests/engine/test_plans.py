import subprocess

import pytest

import __spark_entry__ as entry
from treeline.functions import cursors, rust_tree
from treeline.plans import structural
from treeline.sources import worktree


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    for name, raw in {
        "src/lib.rs": b"mod a;\nmod gone;\nfn f() { x.unwrap(); y.unwrap(/* c */); }\n", "src/a.rs": b"fn g() { h().unwrap(); }", "src/.hidden.rs": b"fn h() {}\n", "src/nul.rs": b"fn\0",
        "src/bad.rs": b"fn \xff", "target/t.rs": b"fn t() {}\n", "skip/s.rs": b"fn s() {}\n", "keep/k.txt": b"", ".gitignore": b"skip/\n*.gen.rs\n!src/b.gen.rs\n", "src/b.gen.rs": b"fn b() {}\n", "src/c.gen.rs": b"",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    (root / "src/link.rs").symlink_to("a.rs")
    return str(root)


def test_discovery(spark, repository):
    root = worktree.resolve_root(repository)
    files = worktree.discover(spark, root)
    got = {r.path: r.reason for r in files.collect()}
    assert got == {"src/lib.rs": None, "src/a.rs": None, "src/.hidden.rs": None, "src/b.gen.rs": None, "src/nul.rs": "binary", "src/bad.rs": "non_utf8", "src/link.rs": "symlink"}
    counts = {r.reason: (r.skipped, r.examples) for r in worktree.skip_counts(files).collect()}
    assert set(counts) == set(worktree.REASONS) and {k: v for k, v in counts.items() if v[0]} == {"binary": (1, ["src/nul.rs"]), "non_utf8": (1, ["src/bad.rs"]), "symlink": (1, ["src/link.rs"])}
    assert worktree.snapshot_id(files, root) == worktree.snapshot_id(files.repartition(3), root) != worktree.snapshot_id(files, root + "x")
    scope = worktree.Scope.of(root, ["src"], ["src/*.rs", "**/lib.rs"])
    assert {r.path for r in files.where(scope.condition()).collect()} == {p for p in got if scope.admits(p)}
    assert {r.reason for r in worktree.discover(spark, root, max_file_bytes=10).where("path = 'src/lib.rs'").collect()} == {"oversized"}
    for bad, code in [(["../x"], "OUTSIDE_ROOT"), (["nope"], "PATH_NOT_FOUND")]:
        with pytest.raises(worktree.ScopeError) as e:
            worktree.Scope.of(root, bad)
        assert e.value.code == code
    with pytest.raises(worktree.ScopeError):
        worktree.limits(max_files=0)


def test_discovery_stops_at_boundaries_and_limits(spark, tmp_path):
    root = tmp_path / "w"
    for name, raw in {
        ".git/HEAD": b"", ".gitignore": b"*.{log,tmp}.rs\n{\n[\n/only.rs\nsub/deep.rs\n\\#odd.rs\nkeep*.rs\n!keep1.rs\n", "a.log.rs": b"", "b.tmp.rs": b"", "only.rs": b"", "x/only.rs": b"fn o() {}", "sub/deep.rs": b"",
        "x/sub/deep.rs": b"fn d() {}", "#odd.rs": b"", "keep1.rs": b"fn k() {}", "keep2.rs": b"", "nested/.git": b"gitdir: elsewhere", "nested/n.rs": b"fn n() {}", "big.rs": b"// " + b"x" * 500,
        "many/a.rs": b"\0", "many/b.rs": b"\0", "many/c.rs": b"\0", "many/d.rs": b"\0",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    (root / "folder").symlink_to("x")
    with open(bytes(root) + b"/caf\xe9.rs", "wb") as f:
        f.write(b"fn c() {}")
    found = worktree.survey(spark, str(root))
    got = {(r.path or r.path_bytes_hex, r.reason, r.detail_code) for r in found.files.collect()}
    fine = {(p, None, None) for p in ("x/only.rs", "x/sub/deep.rs", "keep1.rs", "big.rs")}
    binary = {(f"many/{c}.rs", "binary", "FILE_INELIGIBLE") for c in "abcd"}
    odd = {("nested", "nested_repository", "POLICY_BOUNDARY"), ("folder", "symlink", "POLICY_BOUNDARY"), (b"caf\xe9.rs".hex(), "non_utf8_path", "PATH_ENCODING"), (".", "traversal_error", "IGNORE_READ_FAILED")}
    assert got == fine | binary | odd
    counts = {r.reason: r for r in worktree.skip_counts(found.files).collect()}
    assert (counts["binary"].skipped, counts["binary"].examples, counts["binary"].examples_omitted) == (4, ["many/a.rs", "many/b.rs", "many/c.rs"], 1)
    assert found.coverage() == {"scan_exhausted": True, "eligible_scan_complete": False, "scope_exhaustive": False}
    few = worktree.survey(spark, str(root), max_files=3)
    assert few.truncation == ["max_files: narrow paths/globs"] and not few.scan_exhausted and few.discovered == 3
    small = worktree.survey(spark, str(root), max_source_bytes=510)  # big.rs has 503, the next eligible one 9
    assert [r.path for r in small.files.where("reason is null").collect()] == ["big.rs"] and small.truncation == ["max_source_bytes: narrow paths/globs"]
    for bad in ("a{b", "[z-a].rs", "/x", "!x", "x/", "{a,b}.rs"):
        with pytest.raises(worktree.ScopeError):
            worktree.glob_regex(bad)


def test_discovery_is_one_snapshot(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "a.rs").write_bytes(b"fn a() {}\n")
    (tmp_path / "b.rs").write_bytes(b"\0")
    files = worktree.discover(spark, str(tmp_path))
    first, before = worktree.snapshot_id(files, str(tmp_path)), sorted((r.path, r.source, r.reason) for r in files.collect())
    (tmp_path / "a.rs").write_bytes(b"fn changed() {}\n")
    (tmp_path / "b.rs").unlink()
    assert worktree.snapshot_id(files, str(tmp_path)) == first and sorted((r.path, r.source, r.reason) for r in files.collect()) == before
    assert worktree.snapshot_id(worktree.discover(spark, str(tmp_path)), str(tmp_path)) != first
    capped = worktree.survey(spark, str(tmp_path), max_source_bytes=5)
    assert capped.truncation == ["max_source_bytes: narrow paths/globs"] and capped.files.count() == 0


def test_new_paths_and_manifest(tmp_path):
    for name, raw in {".git/HEAD": b"", ".gitignore": b"gen/\n*.out.rs\n!keep.out.rs\n", "src/a.rs": b"", "src/.gitignore": b"/local.rs\n", "dep/.git": b"", "plain": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "link").symlink_to("src")
    root = str(tmp_path)
    want = {
        "src/b.rs": None, "new/deep/b.rs": None, "src/keep.out.rs": None, "src/a.rs": "DESTINATION_ALREADY_EXISTS", "gen/b.rs": "IGNORED_PATH", "x.out.rs": "IGNORED_PATH", "src/local.rs": "IGNORED_PATH",
        "new/local.rs": None, "dep/b.rs": "NESTED_REPOSITORY", "link/b.rs": "OUTSIDE_ROOT", "../b.rs": "OUTSIDE_ROOT", "/b.rs": "OUTSIDE_ROOT", "target/b.rs": "OUTSIDE_ROOT", "src/b.txt": "OUTSIDE_SCOPE", "plain/b.rs": "OUTSIDE_ROOT",
    }
    assert {p: worktree.admit_new_path(root, p) for p in want} == want
    assert worktree.admit_new_path(root, "src/b.rs", worktree.Scope.of(root, ["dep"])) == "OUTSIDE_SCOPE"
    rows, digest = worktree.scope_manifest(root)
    assert [(r[0], r[1] is None) for r in rows] == [("", False), ("src", False)]
    (tmp_path / "src/.gitignore").write_bytes(b"/other.rs\n")
    assert worktree.scope_manifest(root)[1] != digest


def test_search_page(spark, tmp_path, monkeypatch):
    (tmp_path / ".git").mkdir()
    (tmp_path / "a.rs").write_bytes(b"".join(b"fn a%d() { x%d.unwrap(); }\n" % (k, k) for k in range(5)))
    (tmp_path / "b.rs").write_bytes(b"fn broken( { \n// lead\n#[inline]\nfn b() {\n    // near\n    y.unwrap(); }\n")
    (tmp_path / "c.rs").write_bytes(b"fn c() { z.unwrap(); z.unwrap(); }\n")
    root, opened = str(tmp_path), cursors.Cursors()
    ask = lambda **more: structural.search_page(spark, root, opened, "$a.unwrap()", **more)
    whole = ask()
    assert [m["id"] for m in whole.matches if m["path"] != "b.rs"] == [*(f"m/0/{k}" for k in range(5)), "m/2/0", "m/2/1"]
    assert (whole.has_more, whole.next_cursor, whole.counts["total_is_exact"], whole.counts["eligible_files"]) == (False, None, True, 3)
    assert whole.status == "complete" and whole.coverage["scope_exhaustive"] and {d["path"] for d in whole.diagnostics} == {"b.rs"}
    got, token = [], None
    while True:
        page = ask(cursor=token, page_size=3)
        got += [m["id"] for m in page.matches]
        token = page.next_cursor
        if token is None:
            break
        assert page.has_more and page.status == "partial" and "page_size" in page.truncation and page.counts["total_matches"] is None
    assert got == [m["id"] for m in whole.matches]
    tight = ask(response_bytes=10)
    assert len(tight.matches) == 1 and tight.matches[0]["text"] is None and {"field_omissions", "response_bytes"} <= set(tight.truncation)
    token = ask(page_size=1).next_cursor
    with pytest.raises(cursors.CursorError) as e:
        ask(cursor=token, page_size=2)
    assert e.value.code == "CURSOR_SCOPE_MISMATCH"
    (tmp_path / "c.rs").write_bytes(b"fn c() {}\n")
    with pytest.raises(cursors.CursorError) as e:
        ask(cursor=token, page_size=1)
    assert e.value.code == "STALE_CURSOR"
    near = [m for m in whole.matches if m["path"] == "b.rs"]
    assert all(m["file_has_recovery"] for m in near) and all(t["classification"] for m in near for t in m["trivia"])
    monkeypatch.setattr(structural, "MAX_CANDIDATES", 3)
    rows = structural._rendered("a.rs", b"f(1);", rust_tree.parse(b"f(1);"), [(0, None, {})] * 4, 10, 0, 0)
    assert [r[-2] for r in rows] == [structural.CANDIDATE_LIMIT]


def test_match_enrichment(spark):
    source = b"// intro\n\n// lead\n#[inline]\nfn b() {\n    // near\n    y.unwrap() /* after */;\n}\n"
    files = spark.createDataFrame([("b.rs", bytearray(source))], "path string, source binary")
    row = structural.search(files, "$a.unwrap()").first()
    assert (row.item_start, row.leading_start) == (source.index(b"fn b"), 0)
    assert (row.file_has_recovery, row.subtree_has_recovery, row.enclosing_has_recovery) == (False, False, False)
    assert [source[t.start : t.end].decode() for t in row.trivia] == ["// intro", "// lead", "// near", "/* after */"]


def test_search_pages_and_replacement(spark, repository):
    files = worktree.discover(spark, repository).where("reason is null").cache()
    found = structural.search(files, "$a.unwrap()")
    every = [(r.path, r.match_ordinal) for r in found.orderBy("path", "match_ordinal").collect()]
    assert every == [("src/a.rs", 0), ("src/lib.rs", 0), ("src/lib.rs", 1)]
    pages, after = [], None
    while True:
        page, more = structural.page(found, after, 2)
        pages += [(r.path, r.match_ordinal) for r in page.collect()]
        after = pages[-1]
        if not more.first().has_more:
            break
    assert pages == every
    plan = structural.replace(files, "$a.unwrap()", '$a.expect("r")')
    assert {r.path: (r.applicable, r.blockers) for r in plan.collect()} == {"src/a.rs": (True, []), "src/lib.rs": (False, ["UNRETAINED_TRIVIA"])}
    assert not structural.plan_state(plan).first().applicable
    chosen = found.where("match_ordinal = 0").select("path", "start_byte", "end_byte", found["text"].alias("expected_text"))
    plan = structural.replace(files, "$a.unwrap()", '$a.expect("r")', chosen)
    state = structural.plan_state(plan).first()
    assert state.applicable and state.selected == 2 and structural.stale_selection(chosen, found).count() == 0
    for r in plan.collect():
        subprocess.run(["git", "apply", "--check", "-"], input=r.patch.encode(), cwd=repository, check=True)
    chain = {(r.path, r.depth, r.problem) for r in structural.module_chain(files, "src/lib.rs").collect()}
    assert chain == {("src/lib.rs", 0, None), ("src/a.rs", 1, None), ("src/gone.rs", 1, "chain_file_missing")}
    nodes = structural.nodes(files).where("path = 'src/a.rs'").toPandas()
    assert ((nodes.last_desc >= nodes.node_id) & (nodes.parent_id.isna() | (nodes.parent_id < nodes.node_id))).all()
    assert structural.advice(files).count() == 4
    moved = structural.move_item(files, "src/a.rs", "g", "src/.hidden.rs", {"src/a.rs": "crate::a", "src/.hidden.rs": "crate::h"})
    assert not moved.applicable and moved.decisions == [("destination_binding_conflict", "g")] or ("external_or_missing_binding", "h") not in moved.decisions


def test_queries_agree_with_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from treeline.plans import origin_queries, ownership_queries, relational, scope_queries, structural_queries, twig_queries

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    own = relational.QUERIES | structural_queries.QUERIES | twig_queries.QUERIES | ownership_queries.QUERIES | scope_queries.QUERIES | origin_queries.QUERIES
    for name, run in own.items():
        got = run(spark, sf).toPandas()
        want = db.execute(entry.oracle_sql()[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns), name
        rows = lambda f: sorted(map(str, f[columns].itertuples(index=False, name=None)))  # noqa: B023, E731
        assert rows(got) == rows(want), name


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
