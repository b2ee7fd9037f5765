"""Bindings of names on sources whose shape differs from row to row, and nested scopes on the supplied tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import intervals
from treeline.operators.scratch import settled
from treeline.plans import scopes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Sources by p_partkey % 7, K the key: shadowing, a loop, a guard beside a constant, hoisted items, alternatives, a macro, a nested item.
_SHAPES = [
    "fn f(aK: u8) { g(aK); { let aK = aK + 1; g(aK); } g(aK); }\n",
    "fn f() { for aK in bK { g(aK); } for mut bK in h { g(bK); } }\n",
    "const cK: u8 = K;\nfn f() { match m { Some(cK) => g(cK), Some(dK) if dK > 1 => g(dK), _ => g(eK) } }\n",
    "fn f() { g(aK); let x: bK = 1; use p::dK; g(dK); const aK: u8 = K; const bK: u8 = K; }\n",
    "fn f() { match m { R { v: 1 } | R { v: 2 } => aK::g(), R { aK } | R { aK } => aK::g(), _ => 0 } }\n",
    "fn f(aK: u8) { g(aK); w!(); }\nfn h(bK: u8) { g(bK); }\n",
    "fn f<T>(aK: T) { fn g(bK: u8) { h(aK); h(bK); } let c: T = aK; }\n",
]
#: (shape, name, binding, reason, text that the witness starts, how many uses)
_WANTED = [
    (0, "aK", "independent", "", "aK: u8", 3), (0, "aK", "independent", "", "aK = aK + 1", 1), (0, "g", "absent", "", "", 3),
    (1, "aK", "uncertain", "identifier_pattern_binding_or_constant", "aK in", 1), (1, "bK", "absent", "", "", 1), (1, "bK", "independent", "", "bK in h", 1), (1, "g", "absent", "", "", 2), (1, "h", "absent", "", "", 1),
    (2, "cK", "uncertain", "identifier_pattern_binding_or_constant", "cK) =>", 1), (2, "dK", "independent", "", "dK) if", 2), (2, "eK", "absent", "", "", 1), (2, "g", "absent", "", "", 3), (2, "m", "absent", "", "", 1),
    (3, "aK", "independent", "", "const aK", 1), (3, "bK", "uncertain", "value_binding_in_type_position", "const bK", 1), (3, "dK", "uncertain", "relevant_local_import", "use p", 1), (3, "g", "absent", "", "", 2),
    (4, "aK", "absent", "", "", 1), (4, "aK", "uncertain", "unsupported_pattern", "aK } | R { aK } =>", 1), (4, "m", "absent", "", "", 1),
    (5, "aK", "uncertain", "unsupported_pattern", "w!();", 1), (5, "bK", "independent", "", "bK: u8", 1), (5, "g", "uncertain", "unsupported_pattern", "w!();", 1), (5, "g", "absent", "", "", 1),
    (6, "T", "independent", "", "T>", 2), (6, "aK", "independent", "", "aK: T", 1), (6, "aK", "uncertain", "conditional_local_context", "", 1), (6, "bK", "independent", "", "bK: u8", 1), (6, "h", "uncertain", "conditional_local_context", "", 2),
]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("src/p"), k, F.lit(".rs")).alias("path"), F.encode(F.replace(shape, F.lit("K"), k), "UTF-8").alias("source"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_CASES = ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _text(x) for x in row) + ")" for row in _WANTED)
_SOURCE = "CASE p_partkey % 7 " + " ".join(f"WHEN {n} THEN {_text(s)}" for n, s in enumerate(_SHAPES)) + " END"


@query(f"""
    WITH p AS (SELECT p_partkey % 7 AS shape, CAST(p_partkey AS VARCHAR) AS k, {_SOURCE} AS source FROM part),
    w(shape, name, binding, reason, witness, uses) AS (VALUES {_CASES})
    SELECT 'src/p' || k || '.rs' AS path, replace(name, 'K', k) AS name, binding, reason,
           CASE WHEN witness = '' THEN -1 ELSE CAST(strpos(replace(source, 'K', k), replace(witness, 'K', k)) AS INTEGER) - 1 END AS witness_start, CAST(uses AS BIGINT) AS uses
    FROM p JOIN w USING (shape)""")
def lexical_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2, L3: what every used name is bound to as written, with reason and witness."""
    found = scopes.assess(settled(scopes.fact_table(files(spark, sf_dir))))
    return found.groupBy("path", "name", "binding", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("witness_start", F.lit(-1)).alias("witness_start")).agg(F.count("*").alias("uses"))


@query(f"""
    WITH p AS (SELECT p_partkey % 7 AS shape, CAST(p_partkey AS VARCHAR) AS k, {_SOURCE} AS source FROM part),
    w(shape, name, text, uses) AS (VALUES (0, 'aK', 'aK: u8', 3), (0, 'aK', 'aK = aK', 1), (1, 'bK', 'bK in h', 1), (2, 'dK', 'dK) if', 2), (3, 'x', 'x: bK', 0), (5, 'aK', 'aK: u8', 0), (5, 'bK', 'bK: u8', 1), (6, 'aK', 'aK: T', 1), (6, 'bK', 'bK: u8', 1), (6, 'c', 'c: T', 0))
    SELECT 'src/p' || k || '.rs' AS path, replace(name, 'K', k) AS name, CAST(strpos(replace(source, 'K', k), replace(text, 'K', k)) AS INTEGER) - 1 AS start_byte, uses FROM p JOIN w USING (shape)""")
def lexical_binders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: binders of patterns that are proved, with how many uses meet them."""
    found = scopes.pattern_binders(settled(scopes.fact_table(files(spark, sf_dir))))
    return found.select("path", "name", "start_byte", F.size("uses").alias("uses"))


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, o_orderpriority FROM orders),
    s AS (SELECT o_custkey, o_orderkey, level, day // width * width AS a, day // width * width + width AS u
          FROM o JOIN (VALUES ('1-URGENT', 512, 0), ('2-HIGH', 64, 1), ('3-MEDIUM', 8, 2)) w(priority, width, level) ON o_orderpriority = priority)
    SELECT o.o_orderkey, coalesce(i.o_orderkey, -1) AS scope
    FROM o LEFT JOIN LATERAL (SELECT s.o_orderkey FROM s WHERE s.o_custkey = o.o_custkey AND s.a <= o.day AND o.day < s.u ORDER BY s.level DESC, s.o_orderkey DESC LIMIT 1) i ON true""")
def innermost_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: the innermost of a customer's nested spans of 512, 64 and 8 days around the day of every order; equal spans by the later order."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", day.alias("day"), "o_orderpriority")
    width = F.when(F.col("o_orderpriority") == "1-URGENT", 512).when(F.col("o_orderpriority") == "2-HIGH", 64).when(F.col("o_orderpriority") == "3-MEDIUM", 8)
    spans = orders.withColumn("width", width).where("width is not null").withColumn("at", (F.floor(F.col("day") / F.col("width")) * F.col("width")).cast("int"))
    spans = spans.select("o_custkey", "at", (F.col("at") + F.col("width")).alias("until"), "o_orderkey")
    return intervals.innermost(orders, spans, ["o_custkey"], "day", [F.col("o_orderkey")], "o_orderkey", "scope").select("o_orderkey", F.coalesce("scope", F.lit(-1)).cast("long").alias("scope"))
