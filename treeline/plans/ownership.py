"""Ownership of the units of all files at once: cores, their companions and a ranking, as joins over a table of written links.

One pass parses each file and leaves a row for every unit with its links; all that
follows runs on that table. A core is a group of units held together by cycles of
references (strong components) and by two seed rules; what it reaches beyond itself
are its companions, each with the reasons why a walk stops there.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.functions import advice as _advice
from treeline.functions import items as _items
from treeline.functions import rust_tree
from treeline.operators import graphs
from treeline.operators.scratch import dropped, settled
from treeline.plans import structural

LINK = "struct<to:int,kind:string,count:int>"
UNITS = f"path string, unit int, name string, kind string, visibility string, eligible boolean, impl int, links array<{LINK}>"
#: Links that hold units together; an implementation's link to its type only bundles them.
SUPPORTED = ("reference_candidate", "self_call", "signature_type")
PAYLOADS = ("struct", "enum")
IMPORTS = ("use", "extern_crate")


def unit_table(files: DataFrame) -> DataFrame:
    """One row per unit of every file with what it links to. Write it once and query that."""

    def rule(path, source):
        source = bytes(source)
        units = _items.inventory(rust_tree.parse(source), source)
        at = {i.start: k for k, i in enumerate(units) if i.impl_start is None}
        whole = {at.get(i.impl_start) for i in units if i.impl_start is not None}  # their members speak for them
        links: dict[int, list[dict]] = {}
        for s in (*_advice.references(units, source), *_advice.member_links(units, source)):
            if s.kind == "reference_candidate" and s.source in whole:
                continue
            links.setdefault(s.source, []).append({"to": s.target, "kind": s.kind, "count": s.count})
        return [(path, k, i.name, i.kind, i.visibility, i.eligible, at.get(i.impl_start), links.get(k, [])) for k, i in enumerate(units)]

    i, s = pa.int32(), pa.string()
    link = pa.struct([("to", i), ("kind", s), ("count", i)])
    return structural._arrow(files, ["path", "source"], rule, [s, i, s, s, s, pa.bool_(), i, pa.list_(link)], UNITS)


def _key(path: str, unit: str) -> Column:
    """A node that sorts by file and position."""
    return F.concat(F.col(path), F.lit("#"), F.lpad(F.col(unit).cast("string"), 9, "0"))


def _links(units: DataFrame) -> DataFrame:
    """a, b (nodes), kind, and of both ends whether they are eligible and which implementation they are in."""
    told = units.select(_key("path", "unit").alias("node"), "eligible", "impl")
    out = units.select("path", _key("path", "unit").alias("a"), F.col("eligible").alias("a_eligible"), F.col("impl").alias("a_impl"), F.explode("links").alias("l"))
    out = out.select("a", "a_eligible", "a_impl", _to("path").alias("b"), F.col("l.kind").alias("kind"))
    return out.join(told.select(F.col("node").alias("b"), F.col("eligible").alias("b_eligible"), F.col("impl").alias("b_impl")), "b")


def _to(path: str) -> Column:
    return F.concat(F.col(path), F.lit("#"), F.lpad(F.col("l.to").cast("string"), 9, "0"))


def member_seeds(links: DataFrame) -> DataFrame:
    """(a, b): a member and the one sibling that it writes, where nothing else writes that sibling."""
    supported = links.where(F.col("kind").isin(*SUPPORTED))
    beside = supported.where("a <> b and a_impl = b_impl")
    single = beside.groupBy("a").agg(F.count_distinct("b").alias("n")).where("n = 1").select("a")
    alone = links.groupBy("b").agg(F.count_distinct("a").alias("n")).where("n = 1").select("b")
    return beside.where("a_eligible and b_eligible").join(single, "a", "left_semi").join(alone, "b", "left_semi").select("a", "b").distinct()


def payload_seeds(links: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b): members of one implementation that alone, two or more of them, write a private type without implementations in their signatures.

    Members with several payloads or several sibling targets say nothing for or against.
    """
    bundled = links.where("kind = 'impl_association'").select("b").distinct()
    private = units.where((F.col("visibility") == "private") & F.col("kind").isin(*PAYLOADS)).select(_key("path", "unit").alias("b"))
    payload = private.join(bundled, "b", "left_anti")
    signed = links.where("kind = 'signature_type'").join(payload, "b", "left_semi")
    many = signed.groupBy("a").agg(F.count_distinct("b").alias("n")).where("n > 1").select("a")
    beside = links.where(F.col("kind").isin(*SUPPORTED) & (F.col("a") != F.col("b")) & (F.col("a_impl") == F.col("b_impl")))
    busy = beside.groupBy("a").agg(F.count_distinct("b").alias("n")).where("n > 1").select("a")
    heard = links.join(payload, "b", "left_semi").join(many.union(busy), "a", "left_anti")
    fit = (F.col("kind") == "signature_type") & F.col("a_eligible") & F.col("a_impl").isNotNull()
    owned = heard.groupBy("b").agg(F.bool_and(fit).alias("fit"), F.count_distinct("a_impl").alias("owners"), F.count_distinct("a").alias("consumers"), F.min("a").alias("first"))
    owned = owned.where("fit and owners = 1 and consumers >= 2").select("b", "first")
    return heard.join(owned, "b").where("a <> first").select(F.col("first").alias("a"), F.col("a").alias("b")).distinct()


def cores(units: DataFrame) -> DataFrame:
    """(core, node): groups of two or more eligible units; a core is named by its first node."""
    links = settled(_links(units))
    held = links.where(F.col("kind").isin(*SUPPORTED) & F.col("a_eligible") & F.col("b_eligible")).select("a", "b")
    strong = graphs.strong_components(held)
    joins = strong.select(F.col("component").alias("a"), F.col("node").alias("b")).union(member_seeds(links)).union(payload_seeds(links, units))
    found = graphs.components(joins.where("a <> b"))
    dropped(links)
    return found.select(F.col("component").alias("core"), "node")


def companions(edges: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """What every core reaches beyond itself: core, node, reasons (sorted array), classification.

    ``edges`` (a, b, uncertain), ``nodes`` (node, exposed, imported, unsupported),
    ``members`` (core, node). A companion that is exposed, imported, unsupported, met by
    an uncertain edge from what the core reaches, or written by anything that the core
    doesn't reach is listed with those reasons and not walked through. It is
    ``undetermined`` where it is uncertain or unsupported, else ``observed_shared`` where
    something beyond the core's reach writes it, else ``observed_exclusive``. All cores
    walk at once; the result depends on no order.
    """
    # read once a round, so made once; all sides of a join here grow with the graph, so none is broadcast
    edges = settled(edges.where("a <> b").groupBy("a", "b").agg(F.bool_or("uncertain").alias("uncertain")))
    plain = edges.select("a", "b")
    roots = members.select(F.col("core").alias("label"), "node")
    reached = graphs.labelled_reach(plain, roots)
    beyond = reached.join(roots.hint("merge"), ["label", "node"], "left_anti")
    sources = beyond.join(edges.select(F.col("b").alias("node"), "a", "uncertain").hint("merge"), "node")
    inside = reached.select("label", F.col("node").alias("a"), F.lit(True).alias("inside"))
    judged = sources.join(inside.hint("merge"), ["label", "a"], "left").groupBy("label", "node")
    judged = judged.agg(F.bool_or("inside").alias("met"), F.bool_or(F.col("inside") & F.col("uncertain")).alias("uncertain"), F.bool_or(F.col("inside").isNull()).alias("shared"))
    told = judged.join(nodes.hint("merge"), "node")
    names = {"exposed": "public_or_exposed_boundary", "imported": "import_boundary", "unsupported": "unsupported_context", "uncertain": "uncertain_identity", "shared": "observed_shared_node"}
    reasons = F.array_sort(F.filter(F.array(*(F.when(F.col(c), F.lit(r)) for c, r in names.items())), lambda r: r.isNotNull()))
    undetermined = F.coalesce("uncertain", F.lit(False)) | F.col("unsupported")
    label = F.when(undetermined, "undetermined").when(F.col("shared"), "observed_shared").otherwise("observed_exclusive")
    told = settled(told.select("label", "node", reasons.alias("reasons"), label.alias("classification"), (F.size(reasons) == 0).alias("passable")))
    passing = told.select("label", "node", "passable").unionByName(roots.withColumn("passable", F.lit(True)))
    walked = graphs.labelled_reach(plain, roots, passing)
    out = settled(told.join(walked.hint("merge"), ["label", "node"], "left_semi").select(F.col("label").alias("core"), "node", "reasons", "classification"))
    dropped(edges, reached, walked, told)
    return out


def unit_companions(units: DataFrame, members: DataFrame) -> DataFrame:
    """:func:`companions` of the cores of :func:`cores`; a type leads to its implementations."""
    links = _links(units)
    bundle = F.col("kind") == "impl_association"
    edges = links.select(F.when(bundle, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(bundle, F.col("a")).otherwise(F.col("b")).alias("b"), F.lit(False).alias("uncertain")).distinct()
    nodes = units.select(
        _key("path", "unit").alias("node"), (F.col("visibility") != "private").alias("exposed"), F.col("kind").isin(*IMPORTS).alias("imported"), (~F.col("eligible") & (F.col("kind") != "impl")).alias("unsupported")
    )
    return companions(edges, nodes, members)


def ranked(units: DataFrame, members: DataFrame) -> DataFrame:
    """Cores by file, best first: path, rank, core, units (array), internal, boundary links."""
    links = _links(units).where(F.col("kind").isin(*SUPPORTED)).select("a", "b").distinct()
    of = lambda end, name: members.select(F.col("node").alias(end), F.col("core").alias(name))
    both = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    sides = both.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("core"), (F.col("x") == F.col("y")).alias("within")).where("core is not null")
    counts = sides.groupBy("core").agg(F.count_if("within").alias("internal"), F.count_if(~F.coalesce("within", F.lit(False))).alias("boundary"))
    told = units.select("path", "unit", _key("path", "unit").alias("node"))
    groups = members.join(told, "node").groupBy("path", "core").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    order = Window.partitionBy("path").orderBy(F.desc("internal"), "boundary", "core")
    return groups.join(counts, "core").select("path", F.row_number().over(order).alias("rank"), "core", "units", "internal", "boundary")
