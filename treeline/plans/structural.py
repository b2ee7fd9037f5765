"""Structural search, replacement plans and inventories over files, as one narrow pass per file.

Every function takes ``files`` (path string, source binary, and for plans mode int);
rows stay in their partitions, so nothing is shuffled but pages and summaries.
"""

from __future__ import annotations

import gc
import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions import edits as _edits
from treeline.functions import items as _items
from treeline.functions import cursors, rust_patterns, rust_tree, tree_queries, trivia
from treeline.operators import graphs, ordering
from treeline.operators.scratch import settled
from treeline.plans import origins
from treeline.sources import worktree

SLICE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
MATCHES = (
    "path string, match_ordinal int, pattern_index int, start_byte long, end_byte long, start_line int, start_col int, end_line int, end_col int, text string, "
    "captures map<string, array<struct<start:long,end:long,text:string>>>, context_before array<string>, context_after array<string>, file_has_recovery boolean, "
    "subtree_has_recovery boolean, enclosing_has_recovery boolean, item_start long, leading_start long, trivia array<struct<start:long,end:long,classification:string,reason:string>>, "
    "stopped string, diagnostics array<struct<code:string,start:long,end:long>>"
)
_TRIVIA = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("classification", pa.string()), ("reason", pa.string())])
_DIAGNOSTIC = pa.struct([("code", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_MATCH_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.list_(SLICE)), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.bool_()] * 3, pa.int64(), pa.int64(), pa.list_(_TRIVIA), pa.string(), pa.list_(_DIAGNOSTIC)]
#: A file with more matches stops a search: it gives one row that says so.
MAX_CANDIDATES = 100_000
CANDIDATE_LIMIT = "candidate_match_limit"
#: Estimated bytes of sources for each task that parses them.
TASK_BYTES = 8 << 20


class Lines:
    """Byte offsets to lines from 1 and columns from 0, and whole lines around them."""

    def __init__(self, source: bytes):
        self.source = source
        self.starts = [0] + [k + 1 for k, b in enumerate(source) if b == 10]

    def at(self, byte: int) -> tuple[int, int]:
        line = bisect_right(self.starts, byte)
        return line, byte - self.starts[line - 1]

    def text(self, line: int) -> str:
        end = self.starts[line] - 1 if line < len(self.starts) else len(self.source)
        return self.source[self.starts[line - 1] : end].decode("utf-8", "replace").removesuffix("\r")

    def around(self, start: int, end: int, before: int, after: int) -> tuple[list[str], list[str]]:
        a, b = self.at(start)[0], self.at(max(start, end - 1))[0]
        last = len(self.starts) - (self.starts[-1] == len(self.source) and len(self.starts) > 1)
        return [self.text(k) for k in range(max(1, a - before), a)], [self.text(k) for k in range(b + 1, min(last, b + after) + 1)]


def _arrow(files: DataFrame, columns: list[str], rule: Callable[..., list[tuple]], types: list[pa.DataType], schema: str) -> DataFrame:
    names = [f.split()[0] for f in _split(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 20, 50)  # trees are many small objects that die together
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += rule(*row)
                if len(out) >= 4096:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return _spread(files.select(*columns)).mapInArrow(run, schema)


def _spread(files: DataFrame) -> DataFrame:
    """Deal files anew at every size, since parsing costs far more than moving them: at least a task for every core, and one for each TASK_BYTES."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files.repartition(max(cores, -(-size // TASK_BYTES)) if size < 1 << 50 else cores)  # an unknown size counts as huge


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[at:k].strip())
            at = k + 1
    return [*out, schema[at:].strip()]


def _ancestry(node: rust_tree.Node) -> tuple[bool, int, int]:
    """Whether a node below the root holds an error around this one, where the outermost item begins, and where what leads up to that begins."""
    enclosing, item, up = False, node, node.parent
    while up is not None and up.kind != "source_file":
        enclosing = enclosing or up.broken
        if up.kind.endswith("_item"):
            item = up
        up = up.parent
    leading = item
    if item.parent is not None:
        for other in reversed([c for c in item.parent.children if c.named and c.end <= item.start]):
            if other.kind not in (*rust_tree.COMMENTS, "attribute_item"):
                break
            leading = other
    return enclosing, item.start, leading.start


def _near(comments: list[trivia.Trivia], node: rust_tree.Node, source: bytes, item: int, leading: int) -> list[dict]:
    """Comments inside a match, before its item, and next to it."""
    kept = [
        t for t in comments
        if (node.start <= t.start and t.end <= node.end) or (leading <= t.start and t.end <= item)
        or (t.end <= node.start and not source[t.end : node.start].strip()) or (t.start >= node.end and not source[node.end : t.start].strip())
    ]
    return [{"start": t.start, "end": t.end, "classification": t.classification, "reason": t.reason} for t in kept]


def _rendered(path: str, source: bytes, tree: rust_tree.Node, found: list[tuple], text_bytes: int, before: int, after: int) -> list[tuple]:
    lines, rows = Lines(source), []
    errors = [n for n in tree.walk() if n.kind == "ERROR" or n.missing]
    shown = [{"code": "MISSING_SYNTAX" if n.missing else "SYNTAX_ERROR", "start": n.start, "end": n.end} for n in errors]
    nothing = (None,) * 16
    if len(found) > MAX_CANDIDATES:
        return [(path, *nothing, None, None, CANDIDATE_LIMIT, shown)]
    comments = [t for t in trivia.inventory(tree, source) if t.kind in rust_tree.COMMENTS] if found else []
    cut = lambda n: n.text(source).decode("utf-8", "replace") if n.end - n.start <= text_bytes else None
    for ordinal, (index, node, captures) in enumerate(found):
        a, b = lines.around(node.start, node.end, before, after)
        held = [(name, [{"start": n.start, "end": n.end, "text": cut(n)} for n in nodes]) for name, nodes in sorted(captures.items())]
        enclosing, item, leading = _ancestry(node) if errors or comments else (False, *_ancestry(node)[1:])
        subtree = any(node.start <= e.start and e.end <= node.end for e in errors)
        rows.append((path, ordinal, index, node.start, node.end, *lines.at(node.start), *lines.at(node.end), cut(node), held, a, b, bool(errors), subtree, enclosing, item, leading, _near(comments, node, source, item, leading), None, None))
    if errors:
        rows.append((path, *nothing, None, None, None, shown))
    return rows


def _holding(files: DataFrame, compiled: rust_patterns.Pattern) -> DataFrame:
    """Only files that hold every name and literal of a pattern; the others cannot match and are never parsed."""
    for token in rust_patterns.required_tokens(compiled):
        files = files.where(F.contains(F.col("source"), F.lit(bytearray(token))))
    return files


def _scan(files: DataFrame, pattern: str | None, query: str | None, text_bytes: int, before: int, after: int, pruned: bool = True) -> DataFrame:
    """Matches, and one row without an ordinal for each file that stops the search or holds syntax errors."""
    if (pattern is None) == (query is None):
        raise ValueError("either a pattern or a query")
    if pattern is not None:
        compiled = rust_patterns.compile_pattern(pattern)
        files = _holding(files, compiled) if pruned else files
        find = lambda tree, source: [(0, n, c) for n, c in rust_patterns.matches(compiled, tree, source)]
    else:
        asked = tree_queries.compile_query(query)
        find = lambda tree, source: tree_queries.run_query(asked, tree, source)

    def rule(path, source):
        source = bytes(source)
        tree = rust_tree.parse(source)
        return _rendered(path, source, tree, find(tree, source), text_bytes, before, after)

    return _arrow(files, ["path", "source"], rule, _MATCH_TYPES, MATCHES)


def search(files: DataFrame, pattern: str, text_bytes: int = 8192, before: int = 2, after: int = 2) -> DataFrame:
    """Matches of an expression pattern; a file beyond the candidate guard gives one row whose ``stopped`` says so."""
    return _scan(files, pattern, None, text_bytes, before, after).where("match_ordinal is not null or stopped is not null").drop("diagnostics")


def search_query(files: DataFrame, query: str, text_bytes: int = 8192, before: int = 2, after: int = 2) -> DataFrame:
    """Matches of a tree query, as of :func:`search`."""
    return _scan(files, None, query, text_bytes, before, after).where("match_ordinal is not null or stopped is not null").drop("diagnostics")


@dataclass
class Envelope:
    """One page of a search and what it may claim."""

    status: str
    snapshot: str | None
    matches: list[dict]
    counts: dict
    coverage: dict
    skipped: dict
    diagnostics: list[dict]
    diagnostics_omitted: int
    truncation: list[str]
    has_more: bool | None
    next_cursor: str | None


def search_page(
    spark: SparkSession, root: str, open_cursors: cursors.Cursors, pattern: str | None = None, query: str | None = None, scope: worktree.Scope | None = None, cursor: str | None = None,
    response_bytes: int = 1 << 20, diagnostic_count: int = 100, **given: int,
) -> Envelope:
    """Discover, search and return one page in total order: file by path, matches by position.

    A page ends at ``page_size`` matches, at ``response_bytes`` of them, or before a
    file that stops the search; a single match beyond the budget is returned as a
    descriptor without texts. A cursor goes on where a page ended, as long as
    request and sources are the same.
    """
    bound, scope = worktree.limits(**given), scope or worktree.Scope()
    found = worktree.survey(spark, root, scope, **given)
    files = found.files
    coverage = found.coverage()
    snapshot = worktree.snapshot_id(files, root, scope) if coverage["eligible_scan_complete"] else None
    request = {"root": root, "pattern": pattern, "query": query, "paths": scope.paths, "globs": scope.globs, "limits": bound, "response_bytes": response_bytes}
    skips = {r["reason"]: {"count": r["skipped"], "examples": r["examples"], "examples_omitted": r["examples_omitted"]} for r in worktree.skip_counts(files).collect()}  # eight rows
    eligible, truncation, after = files.where("reason is null"), list(found.truncation), None
    counts = {"discovered_files": found.discovered, "eligible_files": eligible.count()}
    counts["scanned_files"] = files.where("detail_code is null or detail_code = 'FILE_INELIGIBLE'").count()
    if cursor is not None:
        if snapshot is None:
            return Envelope("partial", None, [], counts, coverage, skips, [], 0, [*truncation, "scan_incomplete: cannot validate continuation; narrow paths/globs"], None, None)
        after = tuple(open_cursors.resume(cursor, request, snapshot))
        eligible = eligible.where(F.col("path") >= after[0])
    scanned = settled(_scan(eligible, pattern, query, bound["text_bytes"], bound["context_before"], bound["context_after"], pruned=False))
    stop = scanned.where("stopped is not null").agg(F.min("path").alias("path")).first()["path"]
    matches = scanned.where("match_ordinal is not null")
    matches = matches if stop is None else matches.where(F.col("path") < stop)
    if after is not None:
        matches = matches.where((F.col("path") > after[0]) | (F.col("match_ordinal") >= after[1]))
    size = bound["page_size"]
    rows = ordering.keyset_page(matches.drop("stopped", "diagnostics"), ["path", "match_ordinal"], None, size + 1).collect()  # a page and one more
    counts["matched_files"] = eligible.count() if stop is None else eligible.where(F.col("path") < stop).count()
    counts["observed_matches"] = matches.count()
    noted = scanned.where("match_ordinal is null").select("path", F.explode("diagnostics").alias("d")).select("path", "d.*")
    diagnostics = noted.orderBy("path", "start", "end").limit(max(0, diagnostic_count - sum(len(v["examples"]) for v in skips.values()))).collect()
    omitted = noted.count() - len(diagnostics)
    numbers = {r["path"]: r["ordinal"] for r in ordering.ordinals(files.where("reason is null").select("path"), ["path"]).join(F.broadcast(spark.createDataFrame([(p,) for p in {r["path"] for r in rows}], "path string")), "path").collect()}
    page, used, ended = [], 0, None
    for row in rows:
        if len(page) == size:
            ended = "page_size"
            break
        record = {"id": f"m/{numbers[row['path']]}/{row['match_ordinal']}", **row.asDict(recursive=True)}
        cost = len(json.dumps(record))
        if used + cost > response_bytes:
            if page:
                ended = "response_bytes"
                break
            record |= {"text": None, "captures": {}, "context_before": [], "context_after": [], "trivia": []}  # a descriptor
            truncation.append("field_omissions")
            cost = len(json.dumps(record))
        used += cost
        page.append(record)
    position = [rows[len(page)]["path"], rows[len(page)]["match_ordinal"]] if ended else [stop, 0] if stop is not None else None
    truncation += [ended] if ended else [CANDIDATE_LIMIT] if stop is not None else []
    token = open_cursors.issue(request, snapshot, position) if position and snapshot and coverage["eligible_scan_complete"] else None
    said = cursors.search_status("page" if ended else "work" if stop is not None else None, coverage["eligible_scan_complete"], coverage["scope_exhaustive"], 0)
    coverage["scope_exhaustive"] = said["scope_exhaustive"]
    exact = position is None and coverage["eligible_scan_complete"] and cursor is None
    counts |= {"returned_matches": len(page), "total_matches": counts["observed_matches"] if exact else None, "total_is_exact": exact}
    return Envelope(said["status"], snapshot, page, counts, coverage, skips, [d.asDict() for d in diagnostics], omitted, truncation, said["has_more"], token)


def page(matches: DataFrame, after: tuple[str, int] | None = None, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(the page in total order, whether there is more as a one-row frame); rows of files that stop a search are left out."""
    ahead = ordering.keyset_page(matches.where("match_ordinal is not null"), ["path", "match_ordinal"], after, size + 1)
    return ahead.limit(size), ahead.agg((F.count("*") > size).alias("has_more"))


NODES = "path string, node_id int, parent_id int, last_desc int, ordinal int, field string, kind string, named boolean, is_error boolean, is_leaf boolean, start_byte int, end_byte int"


def nodes(files: DataFrame) -> DataFrame:
    """Every tree node in preorder with its last descendant, so ancestry is an interval test."""

    def rule(path, source):
        tree = rust_tree.parse(bytes(source))
        order = list(tree.walk())
        ids = {id(n): k for k, n in enumerate(order)}
        last = list(range(len(order)))
        for k in range(len(order) - 1, 0, -1):
            up = ids[id(order[k].parent)]
            last[up] = max(last[up], last[k])
        place = {id(c): k for n in order for k, c in enumerate(n.children)}
        return [(path, k, ids[id(n.parent)] if n.parent else None, last[k], place.get(id(n), 0), n.name, n.kind, n.named, n.kind == "ERROR", not n.children, n.start, n.end) for k, n in enumerate(order)]

    i, s, b = pa.int32(), pa.string(), pa.bool_()
    return _arrow(files, ["path", "source"], rule, [s, i, i, i, i, s, s, b, b, b, i, i], NODES)


TRIVIA = "path string, start_byte int, end_byte int, kind string, classification string, reason string, protected boolean, owner_kind string, owner_start int, owner_end int, marker_start int, marker_end int"


def trivia_table(files: DataFrame) -> DataFrame:
    """Comments and attributes with class, reason, owner and the owner's marker (its first leaf)."""

    def rule(path, source):
        source = bytes(source)
        found = trivia.inventory(rust_tree.parse(source), source)
        return [(path, t.start, t.end, t.kind, t.classification, t.reason, t.protected, t.owner and t.owner.kind, t.owner and t.owner.start, t.owner and t.owner.end, *(trivia.marker(t.owner) or (None, None))) for t in found]

    i, s = pa.int32(), pa.string()
    return _arrow(files, ["path", "source"], rule, [s, i, i, s, s, s, pa.bool_(), s, i, i, i, i], TRIVIA)


ITEMS = "path string, item_ordinal int, kind string, name string, visibility_key string, start_byte int, end_byte int, bytes int, lines int, eligible boolean, reasons array<string>, impl_start int"


def items(files: DataFrame) -> DataFrame:
    """Top-level items and inherent members."""

    def rule(path, source):
        source = bytes(source)
        found = _items.inventory(rust_tree.parse(source), source)
        return [(path, k, i.kind, i.name, i.visibility, i.start, i.end, i.end - i.start, source.count(b"\n", i.start, i.end) + 1, i.eligible, i.reasons, i.impl_start) for k, i in enumerate(found)]

    i, s = pa.int32(), pa.string()
    return _arrow(files, ["path", "source"], rule, [s, i, s, s, s, i, i, i, i, pa.bool_(), pa.list_(s), i], ITEMS)


def imports(files: DataFrame) -> DataFrame:
    """Leaves of import trees: path, leaf_path, name, wildcard."""

    def rule(path, source):
        source = bytes(source)
        return [(path, *leaf) for leaf in _items.use_leaves(rust_tree.parse(source), source)]

    s = pa.string()
    return _arrow(files, ["path", "source"], rule, [s, s, s, pa.bool_()], "path string, leaf_path string, name string, wildcard boolean")


def module_chain(files: DataFrame, crate_root: str) -> DataFrame:
    """(path, depth, problem): files reachable from the root by module declarations.

    Exactly one of the two places of a child must exist: both give
    ``competing_file_layout``, none ``chain_file_missing`` (with the first place).
    """

    def rule(path, source):
        source = bytes(source)
        return [(path, n, *_items.child_module_paths(path, n, path == crate_root)) for n in _items.module_declarations(rust_tree.parse(source), source) if n]

    s = pa.string()
    declared = settled(_arrow(files, ["path", "source"], rule, [s, s, s, s], "parent string, name string, beside string, inside string"))  # one parse for all levels
    have = files.select("path")
    a = declared.join(have.select(F.col("path").alias("beside"), F.lit(True).alias("has_beside")), "beside", "left")
    b = a.join(have.select(F.col("path").alias("inside"), F.lit(True).alias("has_inside")), "inside", "left")
    problem = F.when(F.col("has_beside") & F.col("has_inside"), "competing_file_layout").when(F.col("has_beside").isNull() & F.col("has_inside").isNull(), "chain_file_missing")
    placed = b.select("parent", F.when(F.col("has_beside").isNull() & F.col("has_inside"), F.col("inside")).otherwise(F.col("beside")).alias("child"), problem.alias("problem"))
    sound = placed.where(F.col("problem").isNull()).select("parent", "child")
    reached = graphs.reach(sound, have.where(F.col("path") == crate_root).select(F.col("path").alias("node")))
    good = reached.select(F.col("node").alias("path"), "depth", F.lit(None).cast("string").alias("problem"))
    bad = placed.where(F.col("problem").isNotNull()).join(reached, F.col("parent") == F.col("node")).select(F.col("child").alias("path"), (F.col("depth") + 1).alias("depth"), "problem")
    return good.unionByName(bad)


PLAN = "path string, applicable boolean, blockers array<string>, matches int, edits array<struct<start:long,end:long,original:string,replacement:string>>, new_source binary, patch string"
_EDIT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("original", pa.string()), ("replacement", pa.string())])
_KEPT = pa.struct([("edit", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("at", pa.int64())])
_HELD = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("protected", pa.bool_()), ("owner_kind", pa.string()), ("marker_start", pa.int32()), ("marker_end", pa.int32())])
_HELD_SQL = "array<struct<start:int,end:int,kind:string,protected:boolean,owner_kind:string,marker_start:int,marker_end:int>>"
_PROOF = f"{PLAN}, size long, kept array<struct<edit:int,start:long,end:long,at:long>>, before {_HELD_SQL}, after {_HELD_SQL}"


def _held(found: list[trivia.Trivia]) -> list[dict]:
    rows = ((t, trivia.marker(t.owner) or (None, None)) for t in found)
    return [{"start": t.start, "end": t.end, "kind": t.kind, "protected": t.protected, "owner_kind": t.owner and t.owner.kind, "marker_start": a, "marker_end": b} for t, (a, b) in rows]


def replace(files: DataFrame, pattern: str, replacement: str, selection: DataFrame | None = None) -> DataFrame:
    """One row for each file with selected matches: edits, new bytes and its patch section, or the blockers.

    ``selection`` (path, start_byte, end_byte, expected_text) narrows the matches;
    entries that meet none are what :func:`stale_selection` returns. Comments inside
    a match that no copied capture keeps, overlapping edits and syntax errors before
    or after block the file, and so does a comment or attribute that isn't found again
    where its bytes went, or is protected and belongs to something else there
    (``origins.verify``). A plan applies only if no file is blocked. The plan is
    settled, since the proof reads it more than once.
    """
    compiled = rust_patterns.compile_pattern(pattern)
    template = rust_patterns.compile_template(replacement, compiled.variables)
    used = {p.decode() for named, p in template.parts if named}

    def rule(path, source, mode, chosen):
        source = bytes(source)
        tree = rust_tree.parse(source)
        found = rust_patterns.matches(compiled, tree, source)
        if chosen is not None:
            wanted = {(c["start_byte"], c["end_byte"], c["expected_text"]) for c in chosen}
            found = [(n, c) for n, c in found if (n.start, n.end, n.text(source).decode()) in wanted]
        if not found:
            return []
        blockers = ["PREEXISTING_SYNTAX_ERROR"] if tree.broken else []
        made, comments, copied = [], trivia.inventory(tree, source), []
        for node, bound in found:
            kept = [(ns[0].start, ns[0].end) for name, ns in bound.items() if name in used]
            lost = [t for t in comments if node.start <= t.start and t.end <= node.end and not any(a <= t.start and t.end <= b for a, b in kept)]
            if lost:
                blockers.append("UNRETAINED_TRIVIA")
            new = template.expand({name: ns[0].text(source) for name, ns in bound.items()})
            if new != node.text(source):
                at = 0
                for named, part in template.parts:
                    if named:
                        first = bound[part.decode()][0]
                        copied.append({"edit": len(made), "start": first.start, "end": first.end, "at": at})
                    at += first.end - first.start if named else len(part)
                made.append(_edits.Edit(node.start, node.end, node.text(source), new))
        new_source, patch, after = None, None, []
        try:
            new_source = _edits.reconstruct(source, made)
            proposed = rust_tree.parse(new_source)
            if not tree.broken and proposed.broken:
                blockers.append("NEW_SYNTAX_ERROR")
            after = trivia.inventory(proposed, new_source)
            patch = _edits.diff_section(path, source, new_source, mode or 0o644)
        except _edits.EditError as e:
            blockers.append(e.code)
        ok = not blockers
        shown = [{"start": e.start, "end": e.end, "original": e.original.decode(), "replacement": e.replacement.decode()} for e in made]
        plain = (path, ok, sorted(set(blockers)), len(found), shown if ok else None, new_source if ok else None, patch if ok else None)
        return [(*plain, *((len(source), copied, _held(comments), _held(after)) if ok else (None,) * 4))]

    types = [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int32(), pa.list_(_EDIT), pa.binary(), pa.string(), pa.int64(), pa.list_(_KEPT), pa.list_(_HELD), pa.list_(_HELD)]
    wanted = "array<struct<start_byte:long,end_byte:long,expected_text:string>>"
    files = _holding(files, compiled)
    mode = F.col("mode") if "mode" in files.columns else F.lit(None).cast("int").alias("mode")
    if selection is None:
        rows = files.select("path", "source", mode, F.lit(None).cast(wanted).alias("chosen"))
    else:  # at most max_matches anchors, so one file's are few
        anchors = selection.groupBy("path").agg(F.collect_list(F.struct(F.col("start_byte").cast("long").alias("start_byte"), F.col("end_byte").cast("long").alias("end_byte"), "expected_text")).alias("chosen"))
        rows = files.select("path", "source", mode).join(anchors, "path")
    return origins.proved(settled(_arrow(rows, ["path", "source", "mode", "chosen"], rule, types, _PROOF)))


def stale_selection(selection: DataFrame, matches: DataFrame) -> DataFrame:
    """Selected anchors that no current match meets exactly."""
    own = matches.select("path", "start_byte", "end_byte", F.col("text").alias("expected_text"))
    return selection.join(own, ["path", "start_byte", "end_byte", "expected_text"], "left_anti")


def plan_state(plan: DataFrame, max_matches: int = 500) -> DataFrame:
    """One row: whether the whole plan applies (no file is blocked and no more than ``max_matches`` are selected), with counts."""
    if not 1 <= max_matches <= 5000:
        raise ValueError("max_matches is 1 to 5000")
    selected = F.coalesce(F.sum("matches"), F.lit(0))
    sound = F.coalesce(F.bool_and("applicable"), F.lit(True))
    return plan.agg((sound & (selected <= max_matches)).alias("applicable"), selected.alias("selected"), F.count_if(~F.col("applicable")).alias("blocked_files"), (selected > max_matches).alias("beyond_max_matches"))


ADVICE = (
    "path string, outcome string, units int, signals array<struct<kind:string,basis:string,items:array<int>,count:int,label:string>>, "
    "candidates array<struct<items:array<int>,support:int,internal:int,boundary:int>>, drafts array<struct<kind:string,groups:array<array<int>>,names:array<string>>>, largest array<int>, dominant array<int>"
)


def advice(files: DataFrame, balanced: bool = False) -> DataFrame:
    """Splitting advice for every file, in one pass; unit numbers are ordinals of :func:`items`."""
    from treeline.functions.advice import advise

    def rule(path, source):
        source = bytes(source)
        a = advise(path, rust_tree.parse(source), source, balanced)
        signals = [{"kind": s.kind, "basis": s.basis, "items": s.items, "count": s.count, "label": s.label} for s in a["signals"]]
        cores = [{"items": c.items, "support": c.support, "internal": c.internal, "boundary": c.boundary} for c in a["candidates"]]
        drafts = [{"kind": d.kind, "groups": d.groups, "names": d.names} for d in a["drafts"]]
        return [(path, a["outcome"], len(a["units"]), signals, cores, drafts, a["largest"], a["dominant"])]

    i, s = pa.int32(), pa.string()
    signal = pa.struct([("kind", s), ("basis", s), ("items", pa.list_(i)), ("count", i), ("label", s)])
    core = pa.struct([("items", pa.list_(i)), ("support", i), ("internal", i), ("boundary", i)])
    draft = pa.struct([("kind", s), ("groups", pa.list_(pa.list_(i))), ("names", pa.list_(s))])
    return _arrow(files, ["path", "source"], rule, [s, s, i, pa.list_(signal), pa.list_(core), pa.list_(draft), pa.list_(i), pa.list_(i)], ADVICE)


def move_item(files: DataFrame, origin: str, name: str, destination: str, module: dict[str, str], prelude: frozenset[str] = frozenset()):
    """A move plan between two files; only those two reach the driver."""
    from treeline.functions.moves import plan_move

    two = {r["path"]: bytes(r["source"]) for r in files.where(F.col("path").isin(origin, destination)).select("path", "source").collect()}
    return plan_move(two, origin, name, destination, module, prelude)
