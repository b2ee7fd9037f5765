"""Which written binding every use of a name meets, for all files at once.

One pass leaves a table of facts: intervals in which a name is bound or its meaning
is unproved, and the uses of names. Intervals of a file nest, so the innermost one at
a use follows from running sums and one as-of lookup by depth (``intervals.innermost``);
no use meets more than one interval of each kind, however often a name is bound.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions import binding_sites, rust_tree
from treeline.operators import intervals
from treeline.operators.scratch import settled
from treeline.plans import structural

FACTS = (
    "path string, role string, module int, name string, at int, until int, scope int, rank int, seq int, value boolean, reason string, "
    "witness_start int, witness_end int, witness_kind string, wide_start int, wide_end int, wide_kind string"
)
_ANSWER = ["scope", "rank", "at", "seq", "value", "reason", "witness_start", "witness_end", "witness_kind", "wide_start", "wide_end", "wide_kind", "contested"]


def fact_table(files: DataFrame) -> DataFrame:
    """One row per scope, barrier, rival and use of ``files`` (path, source). Write it once and query that."""

    def place(node):
        return (None, None, None) if node is None else (node.start, node.end, node.kind)

    def rule(path, source):
        source = bytes(source)
        return [(path, *f[:10], *place(f.witness), *place(f.wide)) for f in binding_sites.facts(rust_tree.parse(source), source)]

    i, s = pa.int32(), pa.string()
    return structural._arrow(files, ["path", "source"], rule, [s, s, i, s, i, i, i, i, i, pa.bool_(), s, i, i, s, i, i, s], FACTS)


def assess(facts: DataFrame) -> DataFrame:
    """Every use with what it is bound to as written.

    Columns: path, name, start_byte, end_byte, binding (independent: a local binding
    answers; uncertain; absent: no enclosing scope writes the name), reason,
    witness_start, witness_end, witness_kind, witness_relation. Unproved blocks come
    first, then the innermost scope; in one scope a smaller rank, the latest ``let``
    and the earliest of equals. Scopes beyond the innermost module don't count.
    """
    inside = ["path", "module"]
    uses = facts.where("role = 'use'").select(*inside, "name", F.col("at").alias("start_byte"), F.col("until").alias("end_byte"), "value")
    scopes = settled(_contested(facts))
    order = [F.col("scope").asc(), F.col("rank").desc(), F.col("seq").desc()]
    told = lambda rows: rows.select(*inside, "name", "at", "until", "scope", "rank", "seq", F.struct(*_ANSWER).alias("answer"))
    found = uses.withColumn("point", F.col("start_byte"))
    found = intervals.innermost(found, told(scopes.where("name is not null")), [*inside, "name"], "point", order, "answer", "named")
    found = intervals.innermost(found, told(scopes.where("name is null")).drop("name"), inside, "point", order, "answer", "any")
    barriers = facts.where("role = 'barrier'").withColumn("contested", F.lit(False))
    found = intervals.innermost(found, told(barriers).drop("name"), inside, "point", order, "answer", "barrier")

    key = lambda a: F.struct(a["scope"], -a["rank"], a["at"], -a["seq"])
    named, anyone, barrier = F.col("named"), F.col("any"), F.col("barrier")
    walked = F.when(anyone.isNull() | (named.isNotNull() & (key(named) >= key(anyone))), named).otherwise(anyone)
    found = found.withColumn("met", F.coalesce(barrier, walked))
    met = F.col("met")
    contested = met["contested"] & met["reason"].eqNullSafe(binding_sites.CONTESTABLE)
    reason = (
        F.when(contested, binding_sites.BINDING_OR_CONSTANT)
        .when(met["reason"].isNotNull() & (met["reason"] != binding_sites.CONTESTABLE), met["reason"])
        .when(met["value"] & ~F.col("value"), binding_sites.TYPE_POSITION)
    )
    whole = reason.eqNullSafe(binding_sites.TYPE_POSITION)
    witness: list[Column] = [F.when(whole, met[f"wide_{c}"]).otherwise(met[f"witness_{c}"]).alias(f"witness_{c}") for c in ("start", "end", "kind")]
    macro = barrier["reason"] == binding_sites.UNSUPPORTED
    relation = F.when(macro & (barrier["witness_start"] <= F.col("start_byte")), "statement_macro_before_reference").when(macro, "block_macro_may_introduce_items")
    binding = F.when(met.isNull(), "absent").when(reason.isNull(), "independent").otherwise("uncertain")
    return found.select("path", "name", "start_byte", "end_byte", binding.alias("binding"), reason.alias("reason"), *witness, relation.alias("witness_relation"))


def _contested(facts: DataFrame) -> DataFrame:
    """Scopes, and of contestable binders whether a constant of their name or unknown output is in scope of their pattern."""
    inside = ["path", "module"]
    scopes = facts.where("role = 'scope'").drop("role")
    open_, plain = scopes.where(F.col("reason") == binding_sites.CONTESTABLE), scopes.where(~F.col("reason").eqNullSafe(binding_sites.CONTESTABLE))
    rivals = facts.where("role = 'rival'").select(*inside, "name", "at", "until", F.lit(True).alias("rival"))
    order = [F.col("until").desc()]
    open_ = intervals.innermost(open_, rivals.where("name is not null"), [*inside, "name"], "wide_start", order, "rival", "named")
    open_ = intervals.innermost(open_, rivals.where("name is null").drop("name"), inside, "wide_start", order, "rival", "any")
    open_ = open_.withColumn("contested", F.col("named").isNotNull() | F.col("any").isNotNull()).drop("named", "any")
    return open_.unionByName(plain.withColumn("contested", F.lit(False)))


def pattern_binders(facts: DataFrame) -> DataFrame:
    """Binders of patterns that are proved, with the uses that meet them: path, name, start_byte, end_byte, pattern_start, pattern_end, uses (starts, in order)."""
    proved = _contested(facts).where("value and name is not null and wide_kind is not null and witness_kind in ('identifier', 'shorthand_field_identifier')")
    proved = proved.where(~(F.col("contested") & F.col("reason").eqNullSafe(binding_sites.CONTESTABLE)))
    proved = proved.select("path", "name", F.col("witness_start").alias("start_byte"), F.col("witness_end").alias("end_byte"), F.col("wide_start").alias("pattern_start"), F.col("wide_end").alias("pattern_end")).distinct()
    met = assess(facts).where("binding = 'independent'").groupBy("path", F.col("witness_start").alias("start_byte")).agg(F.array_sort(F.collect_list(F.struct("name", F.col("start_byte").alias("at")))).alias("met"))
    return proved.join(met, ["path", "start_byte"], "left").select(
        "path", "name", "start_byte", "end_byte", "pattern_start", "pattern_end", F.coalesce(F.transform("met", lambda m: m["at"]), F.array().cast("array<int>")).alias("uses")
    )
