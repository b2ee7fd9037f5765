"""Structural operators on sources written from the ``part`` table, so that SQL can say what they must find."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.plans import structural

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SQL = """
    f AS (SELECT p_partkey AS k, p_size AS s, 'fn p' || p_partkey || '() { ' AS head, 'a' || p_size || '.unwrap()' AS call,
                 'pair(' || p_size || ', ' || p_partkey % 10 || ')' AS pair FROM part),
    g AS (SELECT *, 'src/p' || k || '.rs' AS path, head || call || '; ' || pair || '; /* b.unwrap() */ let t = "c.unwrap()"; m!(d.unwrap()); }' || chr(10) AS source FROM f)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small Rust file for each part; comments, strings and macros hold what must not be found."""
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    body = F.concat(
        F.lit("fn p"), k, F.lit("() { a"), s, F.lit(".unwrap(); pair("), s, F.lit(", "), (F.col("p_partkey") % 10).cast("string"),
        F.lit('); /* b.unwrap() */ let t = "c.unwrap()"; m!(d.unwrap()); }\n'),
    )
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("src/p"), k, F.lit(".rs")).alias("path"), F.encode(body, "UTF-8").alias("source"), F.lit(0o644).alias("mode"))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(files(spark, sf_dir))
        ORACLE_SQL[f.__name__] = f"WITH {_SQL} {sql}"
        return f

    return add


@query("SELECT path, length(head) AS start_byte, length(head) + length(call) AS end_byte, 1 AS start_line, length(head) AS start_col, call AS match_text, 'a' || s AS capture FROM g")
def structural_search(t):
    """PM1-PM5, PM13, PM17: ``$a.unwrap()`` with byte ranges."""
    return structural.search(t, "$a.unwrap()").select("path", "start_byte", "end_byte", "start_line", F.col("start_col").cast("long").alias("start_col"), F.col("text").alias("match_text"), F.col("captures")["a"][0]["text"].alias("capture"))


@query("SELECT path, pair AS match_text FROM g WHERE s = k % 10")
def structural_unify(t):
    """PM5: a repeated metavariable needs equal bytes."""
    return structural.search(t, "pair($a, $a)").select("path", F.col("text").alias("match_text"))


@query("SELECT path, replace(source, pair, 'swap(' || k % 10 || ', ' || s || ')') AS rebuilt, 1 AS edits FROM g")
def structural_replace(t):
    """A template, edits and the reconstructed file."""
    plan = structural.replace(t, "pair($a, $b)", "swap($b, $a)").where("applicable")
    return plan.select("path", F.decode("new_source", "UTF-8").alias("rebuilt"), F.size("edits").alias("edits"))


@query("SELECT path, 'p' || k AS name, 'function' AS kind, 'private' AS visibility_key, 0 AS start_byte, length(source) - 1 AS end_byte, true AS eligible FROM g")
def structural_items(t):
    """The inventory."""
    return structural.items(t).select("path", "name", "kind", "visibility_key", "start_byte", F.col("end_byte").cast("long").alias("end_byte"), "eligible")


@query("SELECT path, 'pair' AS callee, pair AS match_text FROM g")
def structural_query(t):
    """PM6-PM8: a tree query with predicates and arity."""
    found = structural.search_query(t, '((call_expression function: (identifier) @f arguments: (arguments) @n) @match (#eq? @f "pair") (#rust-arity? @n "2"))')
    return found.select("path", F.col("captures")["f"][0]["text"].alias("callee"), F.col("text").alias("match_text"))


@query("SELECT path, length(head || call || '; ' || pair || '; ') AS start_byte, 'block_comment' AS kind, 'trailing' AS classification, 'same_line' AS reason FROM g")
def structural_trivia(t):
    """Comments and what they belong to."""
    return structural.trivia_table(t).select("path", F.col("start_byte").cast("long").alias("start_byte"), "kind", "classification", "reason")


@query("SELECT path, 'fn p' || k || '() {' AS first_words, 0 AS before, 1 AS file_lines, false AS recovery, 0 AS item_start, 0 AS leading_start FROM g")
def structural_context(t):
    """PM10, PM14: recovery, item and lines around a match."""
    row = structural.search(t, "$a.unwrap()", before=3, after=3).join(t.select("path", "source"), "path")
    text = F.decode("source", "UTF-8")
    lines = F.size(F.split(text, "\n")) - 1
    return row.select(
        "path", F.substring_index(text, " ", 3).alias("first_words"), F.size("context_before").alias("before"), lines.alias("file_lines"),
        (F.col("file_has_recovery") | F.col("subtree_has_recovery") | F.col("enclosing_has_recovery")).alias("recovery"), F.col("item_start").cast("int").alias("item_start"), F.col("leading_start").cast("int").alias("leading_start"),
    )


@query("SELECT path, '/* b.unwrap() */' AS trivia FROM g")
def structural_match_trivia(t):
    """PM16: the comment after a statement is next to it, those in strings and macros are not comments."""
    found = structural.search_query(t, '((expression_statement (call_expression function: (identifier) @f)) @match (#eq? @f "pair"))').join(t.select("path", "source"), "path")
    body = F.expr("substring(source, trivia[0].start + 1, trivia[0].end - trivia[0].start)")
    return found.where(F.size("trivia") > 0).select("path", F.decode(body, "UTF-8").alias("trivia"))


@query("SELECT path, CAST(s AS VARCHAR) AS first, CAST(k % 10 AS VARCHAR) AS second FROM g")
def structural_groups(t):
    """PM6: a group of siblings and what follows it."""
    found = structural.search_query(t, '((call_expression function: (identifier) @f arguments: (arguments ((integer_literal) @a ",") . (integer_literal) @b)) @match (#eq? @f "pair"))')
    return found.select("path", F.col("captures")["a"][0]["text"].alias("first"), F.col("captures")["b"][0]["text"].alias("second"))


@query("SELECT path, 0 AS match_ordinal FROM g ORDER BY path LIMIT 25 OFFSET 10")
def structural_page(t):
    """PG1: the page after a key, in total order."""
    found = structural.search(t, "$a.unwrap()").select("path", "match_ordinal")
    ahead = structural.page(found, None, 10)[0].agg(F.max("path").alias("at"))
    return found.join(F.broadcast(ahead), F.col("path") > F.col("at")).select("path", "match_ordinal").orderBy("path").limit(25)  # one row
