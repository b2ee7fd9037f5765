"""Ownership on the supplied tables and on sources written from ``part``, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.operators import graphs
from treeline.operators.scratch import settled
from treeline.plans import ownership

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
    WITH RECURSIVE s AS (
        SELECT user_id, user_id || '/' || event_type AS a, value, lead(user_id || '/' || event_type) OVER w AS b, lead(value) OVER w AS after
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    e AS (SELECT DISTINCT a, b FROM s WHERE a <> b AND after > value),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events that lead into each other for a user, by steps that raise the value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    node = F.concat(F.col("user_id").cast("string"), F.lit("/"), "event_type")
    steps = spark.read.parquet(f"{sf_dir}/events.parquet").select(node.alias("a"), F.lead(node).over(w).alias("b"), "value", F.lead("value").over(w).alias("after"))
    return graphs.strong_components(steps.where("after > value").select("a", "b"))


_GRAPH = """
    n AS (SELECT p_partkey AS k, p_brand AS brand, p_size AS size FROM part),
    e AS (
        SELECT a.k AS a, b.k AS b, (a.k + b.k) % 13 = 0 AS uncertain FROM n a JOIN n b ON b.k IN (2 * a.k, 2 * a.k + 1)
        UNION SELECT a.k, b.k, false FROM n a JOIN n b ON b.k = a.k + 7 WHERE a.k % 5 = 0),
    m AS (SELECT brand AS core, k AS node FROM n WHERE size < 3)"""


@query(f"""
    WITH RECURSIVE {_GRAPH},
    r(core, node) AS (SELECT core, node FROM m UNION SELECT r.core, e.b FROM r JOIN e ON e.a = r.node),
    j AS (
        SELECT r.core, r.node, bool_or(i.node IS NOT NULL AND e.uncertain) AS uncertain, bool_or(i.node IS NULL) AS shared
        FROM r JOIN e ON e.b = r.node LEFT JOIN r i ON i.core = r.core AND i.node = e.a
        WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.core = r.core AND m.node = r.node) GROUP BY r.core, r.node),
    t AS (SELECT j.*, size = 40 AS exposed, size = 41 AS imported, size = 42 AS unsupported FROM j JOIN n ON n.k = j.node),
    p AS (SELECT core, node FROM m UNION SELECT core, node FROM t WHERE NOT (exposed OR imported OR unsupported OR uncertain OR shared)),
    w(core, node) AS (SELECT core, node FROM m UNION SELECT w.core, e.b FROM w JOIN p ON p.core = w.core AND p.node = w.node JOIN e ON e.a = w.node)
    SELECT t.core, t.node,
           concat_ws(',', CASE WHEN imported THEN 'import_boundary' END, CASE WHEN shared THEN 'observed_shared_node' END, CASE WHEN exposed THEN 'public_or_exposed_boundary' END,
                     CASE WHEN uncertain THEN 'uncertain_identity' END, CASE WHEN unsupported THEN 'unsupported_context' END) AS reasons,
           CASE WHEN uncertain OR unsupported THEN 'undetermined' WHEN shared THEN 'observed_shared' ELSE 'observed_exclusive' END AS classification
    FROM t JOIN w ON w.core = t.core AND w.node = t.node""")
def companion_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companions of the parts of each brand, with reasons where the walk stops."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), "p_brand", "p_size")
    here = parts.select("k")
    steps = parts.select(F.col("k").alias("a"), F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("b")).withColumn("uncertain", (F.col("a") + F.col("b")) % 13 == 0)
    steps = steps.unionByName(parts.where("k % 5 = 0").select(F.col("k").alias("a"), (F.col("k") + 7).alias("b"), F.lit(False).alias("uncertain"))).distinct()
    steps = steps.join(here.select(F.col("k").alias("b")).hint("merge"), "b")  # as many parts as steps
    nodes = parts.select(F.col("k").alias("node"), (F.col("p_size") == 40).alias("exposed"), (F.col("p_size") == 41).alias("imported"), (F.col("p_size") == 42).alias("unsupported"))
    members = parts.where("p_size < 3").select(F.col("p_brand").alias("core"), F.col("k").alias("node"))
    found = ownership.companions(steps, nodes, members)
    return found.withColumn("reasons", F.array_join("reasons", ","))


#: Sources by p_partkey % 5: a cycle, a member seed, a payload seed (with two public users), a chain without a core, a cycle beside a shared helper.
_SHAPES = [
    "fn aK() { bK(); }\nfn bK() { cK(); }\nfn cK() { aK(); help(); }\nfn help() {}\n",
    "struct T;\nimpl T {\n    fn aK(&self) { self.bK(); }\n    fn bK(&self) {}\n    fn cK(&self) {}\n}\n",
    "struct Load { x: u8 }\nstruct T;\nimpl T {\n    fn aK(&self, l: Load) {}\n    fn bK(&self) -> Load { make() }\n    fn cK(&self) {}\n}\n",
    "fn aK() { bK(); }\nfn bK() { cK(); }\nfn cK() {}\n",
    "pub fn help() {}\nfn aK() { bK(); help(); }\nfn bK() { aK(); only(); }\nfn only() {}\nfn other() { help(); }\n",
]
_CORES = [(0, "aK,bK,cK"), (1, "aK,bK"), (2, "aK,bK"), (4, "aK,bK")]
_BESIDE = [(0, "help", "observed_exclusive", ""), (4, "help", "observed_shared", "observed_shared_node,public_or_exposed_boundary"), (4, "only", "observed_exclusive", ""), (2, "Load", "observed_exclusive", "")]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("src/p"), k, F.lit(".rs")).alias("path"), F.encode(F.replace(shape, F.lit("K"), k), "UTF-8").alias("source"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


@query(f"""
    SELECT 'src/p' || p_partkey || '.rs' AS path, replace(names, 'K', CAST(p_partkey AS VARCHAR)) AS names, 1 AS rank
    FROM part JOIN (VALUES {_values(_CORES)}) c(shape, names) ON p_partkey % 5 = shape""")
def ownership_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cores of every file by cycles and by the two seed rules, ranked."""
    units = settled(ownership.unit_table(files(spark, sf_dir)))
    best = ownership.ranked(units, ownership.cores(units))
    named = best.select("path", "rank", F.posexplode("units").alias("place", "unit")).join(units.select("path", "unit", "name"), ["path", "unit"])
    return named.groupBy("path", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ",").alias("names"))


@query(f"""
    SELECT 'src/p' || p_partkey || '.rs' AS path, name, classification, reasons FROM part JOIN (VALUES {_values(_BESIDE)}) c(shape, name, classification, reasons) ON p_partkey % 5 = shape""")
def ownership_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companions of the cores of every file."""
    units = settled(ownership.unit_table(files(spark, sf_dir)))
    found = ownership.unit_companions(units, ownership.cores(units))
    named = units.select("path", "name", ownership._key("path", "unit").alias("node"))
    return found.join(named, "node").select("path", "name", "classification", F.array_join("reasons", ",").alias("reasons"))
