"""Relational cores of the structural engine, run on the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.operators import graphs, intervals, ordering

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it must agree with."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def octets(column: str) -> Column:
    return F.octet_length(column).cast("long")


#: A small rule for files that are skipped, in order of precedence.
OVERSIZED, JUNK = 8192, "[$%&*#]{3}"
REASONS = ("junk", "oversized", "unreadable")
BYTE_CAP, WIRE_BUDGET = 500_000, 200_000


@query("SELECT page_id, url FROM pages WHERE split_part(url, '/', 4) = 'en' AND regexp_matches(url, '/[0-9]+$')")
def admit_paths_globs(t):
    """SC4: a path component and an anchored pattern."""
    return t("pages").where((F.split("url", "/")[3] == "en") & F.col("url").rlike("/[0-9]+$")).select("page_id", "url")


def _reason() -> Column:
    return F.when(F.col("text").isNull(), "unreadable").when(octets("text") > OVERSIZED, "oversized").when(F.col("text").rlike(JUNK), "junk")


_REASON_SQL = f"CASE WHEN text IS NULL THEN 'unreadable' WHEN octet_length(encode(text)) > {OVERSIZED} THEN 'oversized' WHEN regexp_matches(text, '[$%&*#]{{3}}') THEN 'junk' END"


@query(f"""
    WITH s AS (SELECT doc_id, {_REASON_SQL} AS reason FROM documents),
    r AS (SELECT doc_id, reason, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS n FROM s WHERE reason IS NOT NULL)
    SELECT d.reason, count(r.doc_id) AS skipped, coalesce(string_agg(CASE WHEN n <= 3 THEN CAST(doc_id AS VARCHAR) END, ',' ORDER BY doc_id), '') AS examples
    FROM (VALUES ('junk'), ('oversized'), ('unreadable')) d(reason) LEFT JOIN r ON r.reason = d.reason GROUP BY d.reason""")
def eligibility_skips(t):
    """SC8, SC10: reasons in order of precedence, a fixed domain with zeros, the first three examples."""
    skips = t("documents").select("doc_id", _reason().alias("reason")).where(F.col("reason").isNotNull())
    counted = skips.groupBy("reason").agg(F.count("*").alias("n"))
    # the three smallest of each part, then of all: no group is gathered whole
    examples = _smallest(skips, "reason", "doc_id", 3)
    spark = skips.sparkSession
    domain = spark.createDataFrame([(r,) for r in REASONS], "reason string")
    return domain.join(counted, "reason", "left").join(examples, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("skipped"), F.coalesce("examples", F.lit("")).alias("examples"))


def _smallest(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The ``k`` smallest values of each key, joined by commas, pre-reduced over salts."""
    salted = Window.partitionBy(key, "salt").orderBy(value)
    some = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(64))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k)
    return some.groupBy(key).agg(F.array_join(F.slice(F.array_sort(F.collect_list(value)), 1, k), ",").alias("examples"))


@query(f"SELECT doc_id, running FROM (SELECT doc_id, CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM documents) WHERE running <= {BYTE_CAP}")
def byte_cap_prefix(t):
    """SC9: the prefix before the first overflow of a byte cap."""
    return ordering.budget_prefix(t("documents").select("doc_id", octets("text").alias("size")), ["doc_id"], F.col("size"), BYTE_CAP).select("doc_id", "running")


@query(f"""
    SELECT count(*) AS discovered, count(*) FILTER (WHERE {_REASON_SQL} IS NULL) AS eligible,
           sum(octet_length(encode(text))) <= {BYTE_CAP} AS scan_exhausted,
           bool_and({_REASON_SQL} IS NULL) AS eligible_scan_complete FROM documents""")
def coverage_flags(t):
    """SC11: completeness as aggregates."""
    return t("documents").agg(
        F.count("*").alias("discovered"), F.count_if(_reason().isNull()).alias("eligible"), (F.sum(octets("text")) <= BYTE_CAP).alias("scan_exhausted"), F.bool_and(_reason().isNull()).alias("eligible_scan_complete")
    )


LITERAL = "(th[a-z]+) (of|und|la) ([a-z]+)"


@query(f"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS match_ordinal, regexp_extract_all(text, '{LITERAL}')[i] AS match_text, regexp_extract_all(text, '{LITERAL}', 1)[i] AS capture_a, regexp_extract_all(text, '{LITERAL}', 3)[i] AS capture_b
    FROM documents, unnest(range(1, len(regexp_extract_all(text, '{LITERAL}')) + 1)) u(i)""")
def literal_pattern_matches(t):
    """PM7, PM17: every match with its captures, one row each."""
    found = [F.regexp_extract_all("text", F.lit(LITERAL), F.lit(k)) for k in (0, 1, 3)]
    zipped = t("documents").where(F.col("text").rlike(LITERAL)).select("doc_id", F.posexplode(F.arrays_zip(*[x.alias(n) for x, n in zip(found, "mab", strict=True)])).alias("match_ordinal", "z"))
    return zipped.select("doc_id", "match_ordinal", F.col("z.m").alias("match_text"), F.col("z.a").alias("capture_a"), F.col("z.b").alias("capture_b"))


@query("SELECT conv_id, bool_or(regexp_matches(text, 'the')) AS any_match, bool_and(regexp_matches(text, 'e')) AS all_match, bool_or(role IN ('user', 'system')) AS any_of FROM conversations GROUP BY conv_id")
def any_all_predicates(t):
    """PM7: existential and universal predicates over the occurrences of a capture."""
    return t("conversations").groupBy("conv_id").agg(F.bool_or(F.col("text").rlike("the")).alias("any_match"), F.bool_and(F.col("text").rlike("e")).alias("all_match"), F.bool_or(F.col("role").isin("user", "system")).alias("any_of"))


@query("SELECT o_orderkey, count(*) AS arity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(*) = 3")
def arity_filter(t):
    """PM8: parents with exactly so many children; children are counted before the join."""
    arity = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("arity")).where("arity = 3")
    return t("orders").select("o_orderkey").join(arity, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "arity")


@query("""
    WITH w AS (SELECT doc_id, string_split(text, ' ') AS a FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS word_ordinal, a[i] AS word FROM w, unnest(range(1, len(a))) u(i) WHERE a[i] = a[i + 1] AND a[i] <> ''""")
def unify_repeated_capture(t):
    """PM5: two captures with one name must have equal text."""
    words = t("documents").select("doc_id", F.split("text", " ").alias("a"))
    pairs = F.zip_with(F.slice("a", 1, F.size("a") - 1), F.slice("a", 2, F.size("a")), lambda x, y: F.when((x == y) & (x != ""), x))
    return words.where(F.size("a") > 1).select("doc_id", F.posexplode(pairs).alias("p", "word")).where(F.col("word").isNotNull()).select("doc_id", (F.col("p") + 1).alias("word_ordinal"), "word")


@query("SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem)")
def dedup_sorted_matches(t):
    """PM11: equal tuples once."""
    rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return rows.union(rows).distinct()


@query("""
    SELECT user_id, event_id, n, total FROM (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total
        FROM events WHERE event_type = 'error') WHERE n <= 2""")
def diagnostics_topk(t):
    """PM12: a bounded list with the full count."""
    own = Window.partitionBy("user_id")
    errors = t("events").where("event_type = 'error'").select("user_id", "event_id")
    ranked = errors.withColumn("n", F.row_number().over(own.orderBy("event_id"))).withColumn("total", F.count("*").over(own))
    return ranked.where("n <= 2")


def _lines(t) -> DataFrame:
    """Lines of the documents with ordinal (from 1), text and first byte."""
    lines = t("documents").select("doc_id", F.split("text", "\n").alias("a")).select("doc_id", F.posexplode("a").alias("p", "line"))
    before = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(octets("line") + 1).over(before), F.lit(0))
    return lines.select("doc_id", (F.col("p") + 1).alias("line_number"), "line", start.alias("start_byte"))


_LINES_SQL = """
    l AS (SELECT doc_id, CAST(i AS INTEGER) AS line_number, string_split(text, chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)),
    b AS (SELECT doc_id, line_number, line, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM l)"""


@query(f"WITH {_LINES_SQL} SELECT doc_id, line_number, start_byte FROM b")
def line_index(t):
    """PM13: the byte at which each line starts."""
    return _lines(t).select("doc_id", "line_number", "start_byte")


@query(f"""
    WITH {_LINES_SQL},
    h AS (SELECT doc_id, line_number FROM b WHERE contains(line, 'Licen')),
    e AS (SELECT doc_id, max(line_number) AS last FROM b GROUP BY doc_id)
    SELECT h.doc_id, h.line_number, b.line_number AS context_line, CAST(least(2, h.line_number - 1) AS INTEGER) AS n_before, CAST(least(2, e.last - h.line_number) AS INTEGER) AS n_after
    FROM h JOIN e ON e.doc_id = h.doc_id JOIN b ON b.doc_id = h.doc_id AND b.line_number BETWEEN h.line_number - 2 AND h.line_number + 2""")
def context_lines(t):
    """PM14: two lines around each hit, with clipped counts; neighbours are generated, so there is no range join."""
    lines = t("documents").where(F.col("text").contains("Licen")).select("doc_id", F.split("text", "\n").alias("a"))
    hits = lines.select("doc_id", F.size("a").alias("last"), F.posexplode("a").alias("p", "line")).where(F.col("line").contains("Licen"))
    hits = hits.select("doc_id", "last", (F.col("p") + 1).alias("line_number"))
    near = F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_number") - 2), F.least(F.col("last"), F.col("line_number") + 2)))
    return hits.select("doc_id", "line_number", near.alias("context_line"), F.least(F.lit(2), F.col("line_number") - 1).alias("n_before"), F.least(F.lit(2), F.col("last") - F.col("line_number")).alias("n_after"))


_PAGE_KEY = (1000, 2, 0, 0)


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE (l_orderkey, l_linenumber, l_partkey, l_suppkey) > (1000, 2, 0, 0)
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50""")
def keyset_page(t):
    """PG1: a page after a key."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ordering.keyset_page(t("lineitem").select(*order), order, _PAGE_KEY, 50)


@query(f"""
    SELECT doc_id, running FROM (SELECT doc_id, octet_length(encode(text)) AS size, CAST(sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM documents)
    WHERE running <= {WIRE_BUDGET} OR running = size""")
def wire_budget_prefix(t):
    """PG2: as many records as the response holds, the first whatever its size."""
    return ordering.budget_prefix(t("documents").select("doc_id", octets("text").alias("size")), ["doc_id"], F.col("size"), WIRE_BUDGET, first_always=True).select("doc_id", "running")


@query("SELECT w.doc_id FROM (VALUES (1), (2), (-5), (99999999)) w(doc_id) ANTI JOIN documents d ON d.doc_id = w.doc_id")
def stale_selection(t):
    """Requested anchors that nothing consumes."""
    docs = t("documents").select("doc_id")
    return docs.sparkSession.createDataFrame([(1,), (2,), (-5,), (99999999,)], "doc_id int").join(docs, "doc_id", "left_anti")


@query("""
    SELECT e.event_id, s.event_id AS unit_id FROM events e ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY user_id, ts) s
    ON e.user_id = s.user_id AND e.ts >= s.ts""")
def enclosing_unit_asof(t):
    """The latest unit at or before each position, from one sort."""
    events = t("events").select("user_id", "ts", "event_id", "event_type")
    signups = (F.col("event_type") == "signup").cast("int")
    found = intervals.latest_before(events.withColumn("late", 1 - signups), ["user_id"], ["ts", "late", "event_id"], F.col("event_type") == "signup", "event_id", "unit_id")
    return found.where(F.col("unit_id").isNotNull()).select("event_id", F.when(F.col("event_type") == "signup", F.max("unit_id").over(Window.partitionBy("user_id", "ts"))).otherwise(F.col("unit_id")).alias("unit_id"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def uncovered_units(t):
    """Units that no group covers."""
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT n_name, min(s_suppkey) AS s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) = 1")
def unique_owner_bundle(t):
    """Targets with exactly one owner."""
    owners = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("s_suppkey")).where("n = 1")
    return owners.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_suppkey")


@query("""
    SELECT o_orderstatus, o_orderpriority, count(*) AS decisions, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def decision_groups(t):
    """AG2, PG9: groups with a count and an exemplar; ids are compressed by :func:`id_runs`, never gathered."""
    return t("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("decisions"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


@query("""
    SELECT min(doc_id) AS first_id, count(*) AS n FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM documents WHERE lang = 'en') GROUP BY g""")
def id_runs(t):
    """AG3: runs of consecutive ids; each run's first id is one whose predecessor is absent."""
    ids = ordering.ordinals(t("documents").where("lang = 'en'").select("doc_id"), ["doc_id"])
    return ids.groupBy((F.col("doc_id") - F.col("ordinal")).alias("g")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).select("first_id", "n")


_CLASSES = [("click", "advice"), ("error", "advice"), ("error", "missing"), ("purchase", "public")]
_CLASSES_SQL = "(VALUES ('click', 'advice'), ('error', 'advice'), ('error', 'missing'), ('purchase', 'public')) m(event_type, class)"


@query(f"SELECT class, count(DISTINCT user_id) AS users, count(*) AS decisions FROM events JOIN {_CLASSES_SQL} USING (event_type) GROUP BY class")
def consequence_classes(t):
    """AG5: reasons map to several classes; counts are not additive."""
    events = t("events").select("event_type", "user_id")
    table = events.sparkSession.createDataFrame(_CLASSES, "event_type string, class string")
    return events.join(F.broadcast(table), "event_type").groupBy("class").agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("decisions"))


@query("SELECT l_suppkey, l_partkey, count(*) AS occurrences, bool_or(l_returnflag = 'R') AS any_returned FROM lineitem GROUP BY l_suppkey, l_partkey")
def reference_edges(t):
    """AG6: one row for each (from, to) pair."""
    return t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("occurrences"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


@query("""
    SELECT p_brand, count(*) AS units, CAST(sum(p_size) AS BIGINT) AS bytes, max(p_size) FILTER (WHERE p_size % 2 = 0) AS largest_even, count(DISTINCT p_type) AS families FROM part GROUP BY p_brand""")
def group_facts(t):
    """AG7: sums, conditional maxima and distinct families of each group."""
    return t("part").groupBy("p_brand").agg(F.count("*").alias("units"), F.sum("p_size").alias("bytes"), F.max(F.when(F.col("p_size") % 2 == 0, F.col("p_size"))).alias("largest_even"), F.count_distinct("p_type").alias("families"))


@query("""
    SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS open_lines, count(*) FILTER (WHERE l_linestatus = 'F') AS filled_lines FROM lineitem GROUP BY l_returnflag""")
def expected_blocks_pivot(t):
    """AG8: counts by bucket, all buckets present."""
    return t("lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), F.count_if(F.col("l_linestatus") == "F").alias("filled_lines"))


def _windows(t) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("user_id", "event_id", start.alias("a"), (start + F.floor(F.col("value")).cast("long") * 1_000_000).alias("b"))


_WINDOWS_SQL = "w AS (SELECT user_id, event_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000000 AS b FROM events)"


@query(f"""
    WITH {_WINDOWS_SQL},
    r AS (SELECT user_id, a, b, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w)
    SELECT user_id, CAST(sum(greatest(0, b - greatest(a, coalesce(m, a)))) AS BIGINT) AS covered FROM r GROUP BY user_id""")
def interval_union_bytes(t):
    """AG11: the length that a union of intervals covers."""
    return intervals.union_length(_windows(t), ["user_id"], "a", "b")


@query("""
    SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source, lang) AS total FROM documents) WHERE 2 * n_chars >= total""")
def dominant_item(t):
    """AG12: units that hold at least half of their group."""
    docs = t("documents").select("doc_id", "n_chars", "source", "lang")
    totals = docs.groupBy("source", "lang").agg(F.sum("n_chars").alias("total"))
    return docs.join(totals, ["source", "lang"]).where(2 * F.col("n_chars") >= F.col("total")).select("doc_id", "n_chars")


@query(f"""
    WITH {_WINDOWS_SQL},
    r AS (SELECT *, lag(a) OVER o AS pa, lag(b) OVER o AS pb FROM w WINDOW o AS (PARTITION BY user_id ORDER BY a, b, event_id))
    SELECT user_id, event_id FROM r WHERE pb > a OR (pa = a AND pa = pb)""")
def edit_overlaps(t):
    """Edits in conflict with the one before."""
    return intervals.overlaps(_windows(t), ["user_id"], "a", "b", ["event_id"]).select("user_id", "event_id")


@query("""
    WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER o IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
    SELECT user_id, min(event_id) AS first_id, event_type, count(*) AS n FROM r GROUP BY user_id, run, event_type HAVING count(*) >= 2""")
def adjacency_runs(t):
    """Runs of at least two equal neighbours."""
    runs = ordering.runs(t("events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")
    return runs.groupBy("user_id", "run", "event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n")).where("n >= 2").select("user_id", "first_id", "event_type", "n")


@query("""
    WITH m AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events)
    SELECT user_id, min(event_id) AS banner_id, count(*) - 1 AS members FROM m WHERE s > 0 GROUP BY user_id, s""")
def banner_sections(t):
    """A banner's items until the next banner."""
    along = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = t("events").select("user_id", "event_id", F.count_if(F.col("event_type") == "signup").over(along).alias("s"))
    return marked.where("s > 0").groupBy("user_id", "s").agg(F.min("event_id").alias("banner_id"), (F.count("*") - 1).alias("members")).select("user_id", "banner_id", "members")


@query("""
    WITH c AS (SELECT p_brand, p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part),
    s AS (SELECT p_brand, p_partkey, sum(cents) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prefix, sum(cents) OVER (PARTITION BY p_brand) AS total FROM c)
    SELECT p_brand, arg_min(p_partkey, (abs(2 * prefix - total), p_partkey)) AS boundary, CAST(min(abs(2 * prefix - total)) AS BIGINT) AS imbalance FROM s GROUP BY p_brand""")
def balanced_split(t):
    """The first boundary that minimises |prefix - suffix|."""
    cents = t("part").select("p_brand", "p_partkey", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    summed = ordering.running_sum(cents, ["p_brand", "p_partkey"], F.col("cents"), "reached")  # along all brands, so a brand may span ranges
    brands = summed.groupBy("p_brand").agg(F.min(F.col("reached") - F.col("cents")).alias("base"), F.sum("cents").alias("total"))
    off = summed.join(brands, "p_brand").select("p_brand", "p_partkey", F.abs(2 * (F.col("reached") - F.col("base")) - F.col("total")).alias("off"))
    return off.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("off", "p_partkey")).alias("boundary"), F.min("off").alias("imbalance"))


@query("SELECT row_number() OVER (ORDER BY r_name, n_name) - 1 AS ordinal, r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def total_order_ids(t):
    """Ordinals along a total order."""
    rows = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name")
    return ordering.ordinals(rows, ["r_name", "n_name"])


@query("""
    WITH RECURSIVE e(parent, child) AS (
        SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
    t(node, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.node)
    SELECT node, depth FROM t""")
def module_reach(t):
    """G1: what is reachable from the roots, with depth."""
    edge = lambda a, x, b, y: [F.concat(F.lit(a), F.col(x)).alias("parent"), F.concat(F.lit(b), F.col(y)).alias("child")]
    edges = t("nation").select(*edge("r", "n_regionkey", "n", "n_nationkey")).union(t("customer").select(*edge("n", "c_nationkey", "c", "c_custkey")))
    return graphs.reach(edges, t("region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node")))


@query("""
    WITH RECURSIVE l AS (SELECT p_partkey AS name, p_partkey // 2 AS target FROM part WHERE p_partkey % 3 <> 0),
    w(name, at_, hops) AS (SELECT name, target, 1 FROM l UNION ALL SELECT w.name, l.target, w.hops + 1 FROM w JOIN l ON l.name = w.at_ WHERE w.hops < 8)
    SELECT name, at_ AS terminal, hops FROM w WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.name = w.at_)""")
def bounded_hops(t):
    """Follow unique links for at most eight hops."""
    links = t("part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("name"), F.floor(F.col("p_partkey") / 2).alias("target"))
    return graphs.bounded_hops(links, 8)


@query("""
    WITH p AS (SELECT split_part(url, '/', 3) AS host, string_split(url, '/')[4:] AS a FROM pages),
    m AS (SELECT host, min(a) AS lo, max(a) AS hi FROM p GROUP BY host)
    SELECT host, CAST(len(list_filter(range(1, least(len(lo), len(hi)) + 1), lambda i: lo[1:i] = hi[1:i])) AS INTEGER) AS common_segments FROM m""")
def common_prefix(t):
    """The longest common prefix of paths is that of the smallest and the largest."""
    paths = t("pages").select(F.split("url", "/").alias("a")).select(F.col("a")[2].alias("host"), F.slice("a", 4, F.size("a")).alias("a"))
    ends = paths.groupBy("host").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    same = F.expr("size(filter(sequence(1, least(size(lo), size(hi))), i -> slice(lo, 1, i) = slice(hi, 1, i)))")
    return ends.select("host", F.when(F.least(F.size("lo"), F.size("hi")) > 0, same).otherwise(0).alias("common_segments"))


@query("""
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'get,http,part' || p_size || 'body' WHEN 1 THEN 'utf8decode,x' || p_size WHEN 2 THEN 'read,v' || p_size || 'header'
           WHEN 3 THEN 'io,error' || p_size WHEN 4 THEN '' ELSE 'a' || p_size || 'b,c,d' END AS words FROM part""")
def name_words(t):
    """A1: words of names with humps, acronyms, digits and separators; names that are not ASCII have none."""
    size = F.col("p_size").cast("string")
    shapes = F.array(*(F.concat(F.lit(a), size, F.lit(b)) for a, b in (("getHTTPPart", "body"), ("utf8Decode_x", ""), ("read__v", "Header"), ("r#IOError", ""), ("größe", "X"), ("a", "b_C_d"))))
    name = F.regexp_replace(F.element_at(shapes, (F.col("p_partkey") % 6 + 1).cast("int")), "^r#", "")
    humps = F.regexp_replace(F.regexp_replace(name, "([a-z])(?=[A-Z])", "$1_"), "([A-Z])([A-Z][a-z])", "$1_$2")
    parts = F.array_remove(F.split(F.lower(humps), "[^a-z0-9]+"), "")
    return t("part").select("p_partkey", F.array_join(F.when(F.octet_length(name) == F.char_length(name), parts).otherwise(F.array().cast("array<string>")), ",").alias("words"))


@query("""
    WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a FROM part)
    SELECT array_to_string(a[1:i], ' ') AS prefix, count(*) AS members FROM w, unnest(range(1, len(a) + 1)) u(i) WHERE length(array_to_string(a[1:i], ' ')) >= 3 GROUP BY 1 HAVING count(*) >= 2""")
def word_prefixes(t):
    """A1, A2: cumulative word prefixes that at least two names share."""
    words = t("part").select(F.split(F.lower("p_name"), " ").alias("a"))
    prefixes = words.select(F.explode(F.expr("transform(sequence(1, size(a)), i -> array_join(slice(a, 1, i), ' '))")).alias("prefix"))
    return prefixes.where(F.length("prefix") >= 3).groupBy("prefix").agg(F.count("*").alias("members")).where("members >= 2")


@query("""
    SELECT doc_id, octet_length(encode(text)) AS bytes, len(string_split(text, chr(10))) AS lines, octet_length(encode(text)) > 4096 OR len(string_split(text, chr(10))) > 16 AS oversized FROM documents""")
def size_signal(t):
    """A3: soft limits by bytes and lines."""
    lines = F.size(F.split("text", "\n")).cast("long")
    return t("documents").select("doc_id", octets("text").alias("bytes"), lines.alias("lines"), ((octets("text") > 4096) | (lines > 16)).alias("oversized"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3")
def largest_three(t):
    """PG8: the three largest units."""
    return t("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(3)


@query("""
    SELECT min(i) AS suffix FROM range(2, 100) r(i) WHERE 'src' || i NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)""")
def name_probe(t):
    """A10: the first suffix of 2 to 99 that is not taken."""
    taken = t("documents").select("source").distinct()
    names = taken.sparkSession.range(2, 100).select("id", F.concat(F.lit("src"), F.col("id")).alias("source"))
    return names.join(taken, "source", "left_anti").agg(F.min("id").alias("suffix"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark) GROUP BY token")
def identifier_counts(t):
    """AG10: how often each identifier is written."""
    return t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("""
    SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark) b
    WHERE token NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents)""")
def unused_names(t):
    """Names that nothing uses."""
    tokens = lambda name: t(name).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    return tokens("benchmark").join(tokens("documents"), "token", "left_anti")


@query("SELECT doc_id, replace(text, ' the ', ' THE ') AS rebuilt, (length(text) - length(replace(text, ' the ', ''))) // 5 AS edits FROM documents WHERE contains(text, ' the ')")
def splice_reconstruct(t):
    """Original slices and replacements put together again, in order."""
    parts = t("documents").where(F.col("text").contains(" the ")).select("doc_id", F.split("text", " the ").alias("a"))
    # `split` leaves what lies between the edits; joining by the replacement splices them in order
    return parts.select("doc_id", F.array_join("a", " THE ").alias("rebuilt"), (F.size("a") - 1).cast("long").alias("edits"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> CASE WHEN l_linestatus = 'O' THEN 'N' ELSE l_returnflag END")
def noop_edits(t):
    """Edits that change something."""
    new = F.when(F.col("l_linestatus") == "O", "N").otherwise(F.col("l_returnflag"))
    return t("lineitem").where(F.col("l_returnflag") != new).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS blob FROM documents")
def blob_hash(t):
    """SC12: Git's name of a file's bytes."""
    return t("documents").select("doc_id", F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length("text")), "UTF-8"), F.unhex(F.lit("00")), F.encode("text", "UTF-8"))).alias("blob"))


@query("""
    SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counters
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def sorted_counters(t):
    """2.11 map: counters by name, in the order of names."""
    counted = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    # a user has as many entries as there are event types
    held = counted.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return held.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counters"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') IS NULL AS absent FROM events")
def json_fields(t):
    """2.11 json: a field of a canonical value, and one that isn't there."""
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").isNull().alias("absent"))


@query("SELECT event_id, strftime(ts + INTERVAL 900 SECOND, '%Y-%m-%d %H:%M:%S') AS expires FROM events")
def expiry_text(t):
    """2.11 date/time: when a series that began then expires, as text."""
    return t("events").select("event_id", F.date_format(F.col("ts") + F.expr("INTERVAL 900 SECOND"), "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("SELECT p_partkey, p_name, n FROM (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n FROM part) WHERE n > 1")
def name_duplicates(t):
    """AG9: names that are bound more than once; counted before the join, so no name's rows meet in one task."""
    part = t("part").select("p_partkey", "p_name")
    counted = part.groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")
    return part.join(counted, "p_name").select("p_partkey", "p_name", "n")


@query("""
    WITH s AS (SELECT l_orderkey, l_linenumber * 20 AS a, l_linenumber * 20 + CAST(l_quantity AS INTEGER) % 30 AS b FROM lineitem),
    m AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS gap FROM m)
    SELECT l_orderkey, CAST(min(a) AS BIGINT) AS gap_start, CAST(max(b) AS BIGINT) AS gap_end, count(*) AS removals, CASE WHEN gap = 1 THEN 1 ELSE 2 END AS newlines FROM g GROUP BY l_orderkey, gap""")
def removal_gaps(t):
    """Removals with no more than white space between them are one gap; the first keeps one line break, others two."""
    start = F.col("l_linenumber").cast("long") * 20
    spans = t("lineitem").select("l_orderkey", start.alias("a"), (start + F.col("l_quantity").cast("int") % 30).alias("b"))
    along = Window.partitionBy("l_orderkey").orderBy("a", "b")
    before = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("opens", (before.isNull() | (F.col("a") > before + 2)).cast("int"))
    gaps = marked.withColumn("gap", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rows = gaps.groupBy("l_orderkey", "gap").agg(F.min("a").alias("gap_start"), F.max("b").alias("gap_end"), F.count("*").alias("removals"))
    return rows.select("l_orderkey", "gap_start", "gap_end", "removals", F.when(F.col("gap") == 1, 1).otherwise(2).alias("newlines"))


@query("""
    SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (
        SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND l.l_shipdate >= o.o_orderdate AND l.l_shipdate < o.o_orderdate + INTERVAL 60 DAY)""")
def unowned_trivia(t):
    """What lies in no owner's interval."""
    owners = t("orders").select("o_orderkey", "o_orderdate")
    inside = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") < F.col("o_orderdate") + F.expr("INTERVAL 60 DAY"))
    return t("lineitem").join(owners, inside, "left_anti").select("l_orderkey", "l_linenumber")


@query("""
    WITH p AS (SELECT page_id, string_split(url, '/')[3:4] AS route FROM pages), d AS (SELECT route, min(page_id) AS declared, count(*) AS n FROM p GROUP BY route)
    SELECT page_id, declared FROM p JOIN d USING (route) WHERE n > 1 AND page_id <> declared""")
def route_declaration(t):
    """The declaration that a route of segments leads to."""
    pages = t("pages").select("page_id", F.slice(F.split("url", "/"), 3, 2).alias("route"))
    declared = pages.groupBy("route").agg(F.min("page_id").alias("declared"), F.count("*").alias("n")).where("n > 1")
    return pages.join(declared, "route").where("page_id <> declared").select("page_id", "declared")


@query("""
    WITH m AS (SELECT s_nationkey, s_name, min(s_suppkey) AS callee FROM supplier GROUP BY s_nationkey, s_name)
    SELECT c_custkey, callee FROM customer c JOIN m ON c.c_nationkey = m.s_nationkey AND replace(c.c_name, 'Customer', 'Supplier') = m.s_name""")
def self_calls(t):
    """A call to a sibling by (owner, name)."""
    members = t("supplier").groupBy("s_nationkey", "s_name").agg(F.min("s_suppkey").alias("callee"))
    calls = t("customer").select("c_custkey", "c_nationkey", F.regexp_replace("c_name", "Customer", "Supplier").alias("called"))
    return calls.join(members, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("called") == F.col("s_name"))).select("c_custkey", "callee")


@query("""
    SELECT o_custkey, string_agg(DISTINCT l_shipdate_flag, '' ORDER BY l_shipdate_flag) AS observations, count(*) AS members
    FROM (SELECT o_custkey, l_returnflag || l_linestatus AS l_shipdate_flag FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_custkey""")
def candidate_observations(t):
    """The distinct observations that a candidate's members are in."""
    seen = t("lineitem").groupBy("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("kind")).agg(F.count("*").alias("n"))
    met = t("orders").select("o_orderkey", "o_custkey").join(seen, F.col("o_orderkey") == F.col("l_orderkey"))
    # kinds of observations are few
    return met.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("kind")), "").alias("observations"), F.sum("n").alias("members"))


@query("""
    WITH d AS (SELECT DISTINCT c_mktsegment AS s FROM customer), h AS (SELECT DISTINCT c_nationkey AS k, c_mktsegment AS s FROM customer), n AS (SELECT n_nationkey AS k FROM nation)
    SELECT n.k AS nation, coalesce(string_agg(d.s, ',' ORDER BY d.s) FILTER (WHERE h.s IS NULL), '') AS missing, count(*) FILTER (WHERE h.s IS NULL) AS left_out
    FROM n CROSS JOIN d LEFT JOIN h ON h.k = n.k AND h.s = d.s GROUP BY n.k""")
def selection_completeness(t):
    """What of a fixed domain a selection leaves out."""
    segments = t("customer").select("c_mktsegment").distinct()
    domain = segments.agg(F.array_sort(F.collect_set("c_mktsegment")).alias("every"))  # a handful of segments, one row
    held = t("customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("some"))
    rows = t("nation").select(F.col("n_nationkey").alias("nation")).join(held, F.col("nation") == F.col("c_nationkey"), "left").join(F.broadcast(domain), F.lit(True))
    missing = F.array_except("every", F.coalesce("some", F.array().cast("array<string>")))
    return rows.select("nation", F.array_join(F.array_sort(missing), ",").alias("missing"), F.size(missing).cast("long").alias("left_out"))


@query("""
    SELECT doc_id, 'unexamined_context' AS reason FROM documents WHERE lang IS NULL
    UNION ALL SELECT doc_id, 'public_or_exposed_boundary' FROM documents WHERE contains(text, 'http')
    UNION ALL SELECT doc_id, 'unsupported_unit_kind' FROM documents WHERE n_chars < 40""")
def risk_decisions(t):
    """One decision for each risk that an item has, in one scan."""
    risks = F.array(
        F.when(F.col("lang").isNull(), F.lit("unexamined_context")), F.when(F.col("text").contains("http"), F.lit("public_or_exposed_boundary")), F.when(F.col("n_chars") < 40, F.lit("unsupported_unit_kind"))
    )
    return t("documents").select("doc_id", F.explode(F.array_compact(risks)).alias("reason"))


@query("""
    WITH e AS (SELECT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
    x AS (SELECT a AS nation, 'out' AS way, count(*) AS n FROM e WHERE a <> b GROUP BY a UNION ALL SELECT b, 'in', count(*) FROM e WHERE a <> b GROUP BY b)
    SELECT nation, way, n FROM x""")
def boundary_observations(t):
    """References that cross a group's boundary, by direction; edges are counted before they are looked at from both ends."""
    orders = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey"))
    ends = t("lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = ends.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("nation"), F.lit("out").alias("way")), F.struct(F.col("b").alias("nation"), F.lit("in").alias("way")))).alias("x"), "n")
    return both.groupBy("x.nation", "x.way").agg(F.sum("n").alias("n"))


@query("""
    SELECT r_regionkey AS impl_id, n_nationkey AS member_id, r_name < n_name AS impl_first
    FROM region JOIN nation ON n_regionkey = r_regionkey WHERE length(n_name) >= length(r_name)""")
def member_overlaps(t):
    """Members that are selected together with the block around them."""
    met = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).where(F.length("n_name") >= F.length("r_name"))  # five regions
    return met.select(F.col("r_regionkey").alias("impl_id"), F.col("n_nationkey").alias("member_id"), (F.col("r_name") < F.col("n_name")).alias("impl_first"))
