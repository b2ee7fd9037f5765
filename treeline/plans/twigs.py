"""Expression patterns answered from a stored table of syntax nodes, as joins between its rows.

:func:`node_table` parses every file once. Each row carries what a pattern may ask of
a node and of its significant children, so one row answers for a pattern node and all
leaves and metavariables below it; only pattern nodes that have children of their own
cost a join, on (path, node_id). Kinds, sizes and leaf bytes are plain filters that
reach the scan. Any number of patterns is answered from one settled table, and no
Python runs while they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import rust_patterns, rust_tree
from treeline.plans import structural

CHILD = "struct<id:int,field:string,kind:string,named:boolean,expression:boolean,missing:boolean,size:int,leaf:binary,start:int,end:int>"
TABLE = (
    "path string, node_id int, parent_id int, last_desc int, kind string, named boolean, expression boolean, missing boolean, start_byte int, end_byte int, "
    f"start_line int, start_col int, end_line int, end_col int, leaf binary, children array<{CHILD}>"
)
_CHILD = pa.struct([
    ("id", pa.int32()), ("field", pa.string()), ("kind", pa.string()), ("named", pa.bool_()), ("expression", pa.bool_()), ("missing", pa.bool_()),
    ("size", pa.int32()), ("leaf", pa.binary()), ("start", pa.int32()), ("end", pa.int32()),
])


def node_table(files: DataFrame) -> DataFrame:
    """One row per syntax node of ``files`` (path, source), in preorder, with its significant children.

    ``leaf`` holds the bytes of nodes without significant children. Write the table
    once and query that: every action on the frame itself parses again.
    """

    def rule(path, source):
        source = bytes(source)
        tree, lines, ids, rows = rust_tree.parse(source), structural.Lines(source), {}, []
        order = list(tree.walk())
        for k, n in enumerate(order):
            ids[id(n)] = k
        last = list(range(len(order)))
        for k in range(len(order) - 1, 0, -1):
            up = ids[id(order[k].parent)]
            last[up] = max(last[up], last[k])
        held = [n.significant() for n in order]
        leaves = [None if own else n.text(source) for n, own in zip(order, held, strict=True)]
        for k, n in enumerate(order):
            children = []
            for c in held[k]:
                at = ids[id(c)]
                children.append({
                    "id": at, "field": c.name, "kind": c.kind, "named": c.named, "expression": c.expression, "missing": c.missing,
                    "size": len(held[at]), "leaf": leaves[at], "start": c.start, "end": c.end,
                })
            up = None if n.parent is None else ids[id(n.parent)]
            rows.append((path, k, up, last[k], n.kind, n.named, n.expression, n.missing, n.start, n.end, *lines.at(n.start), *lines.at(n.end), leaves[k], children))
        return rows

    i, s, b = pa.int32(), pa.string(), pa.bool_()
    return structural._arrow(files, ["path", "source"], rule, [s, i, i, i, s, b, b, b, i, i, i, i, i, i, pa.binary(), pa.list_(_CHILD)], TABLE)


@dataclass
class Branch:
    """A pattern node with children, and where it hangs: the branch above and its place there."""

    node: rust_tree.Node
    above: int | None
    place: int
    #: (place, name of the metavariable)
    names: list[tuple[int, str]] = field(default_factory=list)


def lower(pattern: rust_patterns.Pattern) -> list[Branch]:
    """The branches of a pattern, parents first; a pattern without children has one branch."""
    branches = [Branch(pattern.root, None, 0)]
    for k, branch in enumerate(branches):  # grows while it is read
        for place, child in enumerate(branch.node.significant()):
            if child.kind == "metavariable":
                branch.names.append((place, child.text(pattern.source)[1:].decode()))
            elif child.significant():
                branches.append(Branch(child, k, place))
    return branches


def _takes(node: Column | None, pattern: rust_tree.Node, own: bytes) -> Column:
    """Whether a row (None) or a child of one may stand for a pattern node, its own children aside."""
    get = (lambda name: F.col(name)) if node is None else (lambda name: node[name])
    if pattern.kind == "metavariable":
        return get("named") & get("expression") & ~get("missing") & (get("kind") != "metavariable")
    same = (get("kind") == pattern.kind) & (get("named") == pattern.named)
    size = F.size("children") if node is None else node["size"]
    same = same & (size == len(pattern.significant()))
    return same if pattern.significant() else same & (get("leaf") == F.lit(bytearray(own[pattern.start : pattern.end])))


def _holds(branch: Branch, own: bytes) -> Column:
    """Whether a row is the branch's node with fitting children."""
    whole = _takes(None, branch.node, own)
    for place, child in enumerate(branch.node.significant()):
        at = F.get("children", F.lit(place))
        whole = whole & at["field"].eqNullSafe(F.lit(child.name)) & _takes(at, child, own)
    return whole


def search(table: DataFrame, files: DataFrame, pattern: str) -> DataFrame:
    """Matches of an expression pattern in a stored node table: the rows of ``structural.search`` without their surroundings.

    Columns: path, match_ordinal, start_byte, end_byte, start_line, start_col, end_line,
    end_col, text, captures, stopped. ``files`` gives the texts of the matches alone and
    meets them by path. A file beyond the candidate guard gives one row that says so.
    """
    compiled = rust_patterns.compile_pattern(pattern)
    branches = lower(compiled)
    own = compiled.source
    place = ["start_byte", "end_byte", "start_line", "start_col", "end_line", "end_col"]
    found = table.where(F.col("expression") & _holds(branches[0], own)).select("path", "node_id", *place, F.col("children").alias("c0"))
    for k, branch in enumerate(branches[1:], 1):
        side = table.where(_holds(branch, own)).select(F.col("path").alias(f"p{k}"), F.col("node_id").alias(f"n{k}"), F.col("children").alias(f"c{k}"))
        found = found.join(side, (F.col("path") == F.col(f"p{k}")) & (F.get(f"c{branch.above}", F.lit(branch.place))["id"] == F.col(f"n{k}"))).drop(f"p{k}", f"n{k}")

    spans: dict[str, list[Column]] = {}
    if compiled.root.kind == "metavariable":
        spans[compiled.root.text(own)[1:].decode()] = [F.struct(F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))]
    for k, branch in enumerate(branches):
        for at, name in branch.names:
            child = F.get(f"c{k}", F.lit(at))
            spans.setdefault(name, []).append(F.struct(child["start"].alias("start"), child["end"].alias("end")))
    names = sorted(spans)
    found = found.select("path", "node_id", *place, *(F.array_sort(F.array(*spans[n])).alias(f"v{k}") for k, n in enumerate(names)))

    source = F.col("source")
    cut = lambda a, b: source.substr(a + 1, b - a)
    texts = found.join(files.select("path", "source"), "path")
    for k, name in enumerate(names):
        if len(spans[name]) > 1:  # a repeated metavariable stands for equal bytes
            first = F.get(f"v{k}", F.lit(0))
            texts = texts.where(F.forall(f"v{k}", lambda s: cut(s["start"], s["end"]) == cut(first["start"], first["end"])))  # noqa: B023
    text = lambda a, b: F.decode(cut(a, b), "UTF-8")
    long = lambda c: c.cast("long")
    caught = lambda k: F.transform(f"v{k}", lambda s: F.struct(long(s["start"]).alias("start"), long(s["end"]).alias("end"), text(s["start"], s["end"]).alias("text")))
    empty = F.create_map().cast("map<string,array<struct<start:bigint,end:bigint,text:string>>>")
    captures = F.create_map(*(x for k, n in enumerate(names) for x in (F.lit(n), caught(k)))) if names else empty
    rows = texts.select("path", "node_id", *place, text(F.col("start_byte"), F.col("end_byte")).alias("text"), captures.alias("captures"))

    of_file = Window.partitionBy("path")
    rows = rows.withColumn("match_ordinal", F.row_number().over(of_file.orderBy("start_byte", "end_byte", "node_id")) - 1).withColumn("n", F.count("*").over(of_file))
    guarded = F.col("n") > structural.MAX_CANDIDATES
    rows = rows.where(~guarded | (F.col("match_ordinal") == 0))
    plain = lambda c: F.when(~guarded, F.col(c)).alias(c)
    return rows.select("path", *(plain(c) for c in ("match_ordinal", *place, "text", "captures")), F.when(guarded, structural.CANDIDATE_LIMIT).alias("stopped"))
