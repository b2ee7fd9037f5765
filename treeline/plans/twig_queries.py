"""Patterns over a stored node table, on sources whose shape differs from row to row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.scratch import settled
from treeline.plans import structural, twigs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Shapes by p_partkey % 6; K stands for the key and S for the size of the part.
_SHAPES = [
    "fn pK() { aS.unwrap(); pair(S, K) }\n",
    "fn pK() { hK.get(aS.unwrap()).unwrap(); pair(pair(S, S), pair(S, S)); }\n",
    'fn pK() {\n    let s = "aS.unwrap()";\n    aS\n        .unwrap(/* later */);\n    pair(f(S), f(S));\n}\n',
    "fn pK() { aS.unwrap(0); m!(aS.unwrap()); pair(f(S), f( S)); // aS.unwrap()\n}\n",
    "struct TK;\nimpl TK {\n    fn aS(&self) -> u8 { if self.bK.unwrap() { pair(-S, -S) } else { pair(S, -S) } }\n}\n",
    "fn pK() { aS.unwrap() }\n}\nfn q() { pair(K, K); }\n",
]
#: (shape, text of a match, capture, how many equal texts before it)
_UNWRAPPED = [
    (0, "aS.unwrap()", "aS"), (1, "aS.unwrap()", "aS"), (1, "hK.get(aS.unwrap()).unwrap()", "hK.get(aS.unwrap())"),
    (2, "aS\n        .unwrap(/* later */)", "aS"), (4, "self.bK.unwrap()", "self.bK"), (5, "aS.unwrap()", "aS"),
]
_EQUAL = [(1, "pair(S, S)", "S", 2), (1, "pair(pair(S, S), pair(S, S))", "pair(S, S)", 1), (2, "pair(f(S), f(S))", "f(S)", 1), (4, "pair(-S, -S)", "-S", 1), (5, "pair(K, K)", "K", 1)]


def _filled(template: str) -> str:
    """SQL of a template: letters K and S replaced by the part's numbers."""
    quoted = template.replace("'", "''").replace("\n", "' || chr(10) || '")
    return f"replace(replace('{quoted}', 'K', CAST(k AS VARCHAR)), 'S', CAST(s AS VARCHAR))"


_SOURCES = "f AS (SELECT p_partkey AS k, p_size AS s FROM part), g AS (SELECT k, s, 'src/p' || k || '.rs' AS path, CASE k % 6 " + " ".join(f"WHEN {n} THEN {_filled(t)}" for n, t in enumerate(_SHAPES)) + " END AS source FROM f)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    shape = F.element_at(F.array(*map(F.lit, _SHAPES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    body = F.replace(F.replace(shape, F.lit("K"), k), F.lit("S"), s)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("src/p"), k, F.lit(".rs")).alias("path"), F.encode(body, "UTF-8").alias("source"))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(files(spark, sf_dir))
        ORACLE_SQL[f.__name__] = f"WITH {_SOURCES}, {sql}"
        return f

    return add


_FOUND = " UNION ALL ".join(f"SELECT path, source, {_filled(t)} AS match_text, {_filled(c)} AS capture FROM g WHERE k % 6 = {n}" for n, t, c in _UNWRAPPED)
_LINES = "length(before) - length(replace(before, chr(10), '')) + 1 AS start_line"


@query(
    f"""m AS ({_FOUND}), p AS (SELECT *, substr(source, 1, CAST(strpos(source, match_text) AS INTEGER) - 1) AS before FROM (
            SELECT * REPLACE (CASE WHEN source LIKE '%let s = %' THEN replace(source, '"' || capture || '.unwrap()"', '"' || repeat('?', length(capture) + 9) || '"') ELSE source END AS source) FROM m))
        SELECT path, length(before) AS start_byte, length(before) + length(match_text) AS end_byte, {_LINES}, match_text, capture,
               row_number() OVER (PARTITION BY path ORDER BY length(before), length(match_text)) - 1 AS match_ordinal FROM p"""
)
def twig_search(t):
    """PM4, PM13, PM17: ``$a.unwrap()`` by joins over a stored node table; strings, comments, macros and other arities hold what must not be found."""
    found = twigs.search(settled(twigs.node_table(t)), t, "$a.unwrap()")
    return found.select(
        "path", F.col("start_byte").cast("long").alias("start_byte"), F.col("end_byte").cast("long").alias("end_byte"), F.col("start_line").cast("long").alias("start_line"),
        F.col("text").alias("match_text"), F.col("captures")["a"][0]["text"].alias("capture"), F.col("match_ordinal").cast("long").alias("match_ordinal"),
    )


@query("m AS (" + " UNION ALL ".join(f"SELECT path, {_filled(t)} AS match_text, {_filled(c)} AS capture, {n} AS occurrences FROM g WHERE k % 6 = {shape}" for shape, t, c, n in _EQUAL) + ") SELECT * FROM m")
def twig_unify(t):
    """PM5: a repeated metavariable stands for equal bytes, whole subtrees included."""
    found = twigs.search(settled(twigs.node_table(t)), t, "pair($a, $a)")
    return found.groupBy("path", F.col("text").alias("match_text"), F.col("captures")["a"][1]["text"].alias("capture")).agg(F.count("*").cast("int").alias("occurrences"))


@query("""c AS (SELECT path, (length(source) - length(replace(source, 'pair(', ''))) // 5 AS pairs FROM g), z AS (SELECT path, pairs FROM c WHERE pairs > 0) SELECT * FROM z""")
def twig_agrees(t):
    """PM4: two patterns from one stored table, as the walk of each tree finds them."""
    table = settled(twigs.node_table(t))
    keys = ["path", "start_byte", "end_byte", "text"]
    own = lambda found: found.select(*(F.col(c).cast("string").alias(c) for c in keys))
    walked, joined = own(structural.search(t, "pair($a, $b)")), own(twigs.search(table, t, "pair($a, $b)"))
    return joined.join(walked, keys, "full_outer").groupBy("path").agg(F.count("*").alias("pairs"))
