"""Origin maps on the supplied tables and proofs of kept trivia on sources of five shapes, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.plans import origins, structural

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Sources by p_partkey % 5, K the key: a kept comment, an attribute whose owner begins anew, a comment copied along, one between attributes, a lost one.
_SHAPES = [
    "/// doc K\nfn f() { aK.unwrap(); // after\n}\n",
    "fn f() { #[allow(x)] aK.unwrap(); }\n",
    "fn f() { g(/* in */ aK).unwrap(); }\n",
    "#[inline]\nfn f() { bK(); #[allow(x)] cK(aK.unwrap()); }\n",
    "fn f() { aK /* lost */ .unwrap(); }\n",
]
_OUTCOMES = [
    (0, 1, "", "/// doc K\nfn f() { wrap(aK); // after\n}\n"), (1, 0, origins.ATTACHMENT, ""), (2, 1, "", "fn f() { wrap(g(/* in */ aK)); }\n"),
    (3, 1, "", "#[inline]\nfn f() { bK(); #[allow(x)] cK(wrap(aK)); }\n"), (4, 0, "UNRETAINED_TRIVIA", ""),
]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("src/p"), k, F.lit(".rs")).alias("path"), F.encode(F.replace(shape, F.lit("K"), k), "UTF-8").alias("source"))


@query("""
    WITH e AS (SELECT l_orderkey AS path, l_linenumber * 200 AS a, l_linenumber * 200 + CAST(min(l_quantity) AS BIGINT) AS b, min(l_partkey % 70) AS size FROM lineitem GROUP BY l_orderkey, l_linenumber),
    p AS (SELECT path, a + 90 AS s, a + 100 AS e FROM e UNION ALL SELECT path, b - 3, b + 3 FROM e UNION ALL SELECT DISTINCT path, 0, 5 FROM e)
    SELECT p.path, CAST(p.s AS BIGINT) AS range_start, CAST(p.s + coalesce(sum(e.size - (e.b - e.a)) FILTER (e.b <= p.s), 0) AS BIGINT) AS went
    FROM p JOIN e USING (path) GROUP BY p.path, p.s, p.e HAVING NOT bool_or(e.a < p.e AND p.s < e.b)""")
def origin_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: where ranges of an order's bytes go when each of its lines replaces some; ranges that an edit cuts go nowhere."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey").repartition("l_orderkey")  # all that follows stays with its order
    lines = lines.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % 70).alias("size"))
    lines = lines.groupBy("path", "n").agg(F.min("q").alias("q"), F.min("size").alias("size"))  # edits of a file must be apart
    edit = F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1
    edits = lines.select("path", edit.alias("edit"), (F.col("n") * 200).alias("start"), (F.col("n") * 200 + F.col("q")).alias("end"), "size")
    sizes = edits.where("edit = 0").select("path", F.lit(2000).cast("long").alias("size"))
    pieces = origins.copies(sizes, edits, edits.select("path", "edit", "start", "end", F.lit(0).cast("long").alias("at")).limit(0))
    ranges = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    head = F.when(F.col("edit") == 0, ranges(F.lit(0).cast("long"), F.lit(5).cast("long")))
    each = F.array(ranges(F.col("start") + 90, F.col("start") + 100), ranges(F.col("end") - 3, F.col("end") + 3), head)
    asked = edits.select("path", F.explode(F.array_compact(each)).alias("r")).select("path", "r.*")
    found = origins.mapped(asked, pieces, "s", "e", "places").where(F.size("places") > 0)
    return found.select("path", F.col("s").alias("range_start"), F.col("places")[0]["start"].alias("went"))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_ROWS = ", ".join(f"({n}, {ok}, {_text(why)}, {_text(source)})" for n, ok, why, source in _OUTCOMES)


@query(f"""
    WITH o(shape, applicable, blockers, source) AS (VALUES {_ROWS})
    SELECT 'src/p' || p_partkey || '.rs' AS path, applicable, blockers, replace(source, 'K', CAST(p_partkey AS VARCHAR)) AS proposed FROM part JOIN o ON p_partkey % 5 = shape""")
def replacement_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5: a replacement is refused where an attribute would belong to another node or a comment would be lost."""
    plan = structural.replace(files(spark, sf_dir), "$a.unwrap()", "wrap($a)")
    return plan.select("path", F.col("applicable").cast("int").alias("applicable"), F.array_join("blockers", ",").alias("blockers"), F.coalesce(F.decode("new_source", "UTF-8"), F.lit("")).alias("proposed"))
