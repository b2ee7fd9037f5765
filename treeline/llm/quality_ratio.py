"""Quality rules and a hashed n-gram log-likelihood ratio; DataFrame functions only.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Two
multinomials over the buckets are counted exactly: one over the trusted target (all
rows marked good), one over the raw corpus (all rows). A text's score is the mean over
its n-grams of the log of their ratio, in whole millionths, so that sums do not depend
on their order. The threshold lies half way between the expected scores of the target's
and of the rejected rows' n-grams, both known from the same counts.

Everything about one text is computed in its row, by array functions: nothing of a text
is shuffled while it is judged. Counting shuffles the texts once, to meet their marks,
and then at most two rows a bucket and task.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, drop_cut

BUCKETS = 1 << 16
#: Added to every bucket of the target, and to the raw corpus in proportion.
SMOOTHING = 1.0
#: Scores are whole numbers of this part of a nat.
UNIT = 1_000_000
#: Base rules: fewest words, and the largest share of words in repeated windows of WINDOW words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 0.2, 5
SPACE = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def split_words(text: Column) -> Column:
    """Runs of what is no white space."""
    return F.array_remove(F.split(text, f"[{SPACE}]"), "")


def split_tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits, and runs of other characters, in their order."""
    return split_words(F.regexp_replace(F.lower(text), rf"([^\p{{L}}\p{{M}}\p{{N}}{SPACE}]++)", " $1 "))


def _first(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _second(before: Column, token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(before, token), F.lit(buckets)).cast("int")


def _long_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


@dataclass(frozen=True)
class Ratio:
    """Weights by bucket (a JSON list of ``buckets`` whole numbers) and the threshold of the mean weight."""

    weights: str
    threshold: float
    buckets: int


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", buckets: int = BUCKETS) -> Ratio:
    """Count the n-grams of the whole corpus and of all rows marked good (quality 1) or bad (0).

    An identifier with several marks counts by its lowest; null marks and null identifiers
    mark nothing. Without a good row every weight is 0 and every score reaches the
    threshold; without a bad one the threshold lies as far below the corpus' own mean as
    the target lies above it. Null texts hold nothing; an empty corpus gives weights of 0.
    """
    marks = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("mark_id")).agg(F.min(labels[quality_col].cast("int")).alias("mark")).where("mark is not null")
    texts = docs.select(docs[id_col].cast("long").alias("mark_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    # marks grow with the corpus, so both sides are shuffled at every size
    tokens = texts.join(marks.hint("merge"), "mark_id", "left").select("mark", split_tokens(F.col("t")).alias("tokens"))
    w = F.col("tokens")
    pairs = F.explode(F.arrays_zip(w.alias("x"), F.slice(w, 2, F.size(w)).alias("y")))
    x, y = F.col("pair.x"), F.col("pair.y")
    second = F.when(y.isNotNull(), _second(x, y, buckets))
    seen = tokens.select("mark", pairs.alias("pair")).select("mark", _first(x, buckets).alias("u"), second.alias("v"))
    share = lambda mark: F.count(F.when(F.col("mark") == mark, 1))
    apart = seen.groupingSets([["u"], ["v"]], "u", "v").agg(F.count("*").alias("raw"), share(1).alias("good"), share(0).alias("bad"))
    apart = apart.select(F.coalesce("u", "v").alias("bucket"), "raw", "good", "bad").where("bucket is not null")
    counts = cut(apart.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "good", "bad"))))  # one row for each bucket from here on
    raw, good, bad = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("raw", "good", "bad"))).first()
    weight = F.round(F.log((F.col("good") + SMOOTHING) / (F.col("raw") * F.lit(good / max(raw, 1)) + SMOOTHING)) * UNIT).cast("long") if good else F.lit(0).cast("long")
    weighed = counts.withColumn("w", weight)
    pairs = F.to_json(F.collect_list(F.struct("bucket", "w"))).alias("pairs")
    found = weighed.agg(*(F.coalesce(F.sum(F.col(c) * F.col("w")), F.lit(0)).alias(c) for c in ("raw", "good", "bad")), pairs).first()
    drop_cut(counts)
    target, corpus, rejected = (total / max(of, 1) for total, of in ((found["good"], good), (found["raw"], raw), (found["bad"], bad)))
    threshold = 0.0 if not good else (target + rejected) / 2 if bad else 2 * corpus - target
    of = {p["bucket"]: p["w"] for p in json.loads(found["pairs"] or "[]")}
    # a bucket that the corpus never fills weighs nothing
    return Ratio(json.dumps([of.get(k, 0) for k in range(buckets)]), threshold, buckets)


def measure(docs: DataFrame, model: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept.

    word_chars counts code points in words, n_symbols characters of ``#*$%&|<>``,
    n_dup_lines lines with a word that equal an earlier line, n_repeat_words the words
    that lie in a window of five words found at least twice in the text (windows are told
    apart by 64-bit hashes of their words). base_failed: fewer than ten words, or more
    than a fifth of them repeated. score is the mean log ratio in nats, null for a text
    without a word. kept: not base_failed, and the score reaches the threshold.

    A null text has no word. Rows that repeat an identifier are judged each by itself.
    Texts of any length are read whole, in memory of a few times their size. Other columns
    of ``docs`` are ignored, whatever their names. An empty table gives no rows.

    The rows are written once: a filter on them would otherwise be pushed below the
    steps that made them and repeat each step for every mention of the one before.
    """
    return cut(judged(docs, model, id_col, text_col))


def judged(docs: DataFrame, model: Ratio, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`measure` as a plan: one narrow pass over the texts."""
    text, w, h, v, s, p = (F.col(c) for c in ("t", "words", "hashes", "windows", "sorted", "places"))
    none = F.array().cast("array<bigint>")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("t"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    symbols = F.octet_length(text) * 0
    for symbol in SYMBOLS:
        symbols = symbols + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(symbol), F.lit("")))
    rows = rows.select("doc_id", split_words(text).alias("words"), split_tokens(text).alias("tokens"), symbols.cast("long").alias("n_symbols"), lines.alias("lines"))

    table = F.from_json(F.lit(model.weights), "array<bigint>")
    tokens = F.col("tokens")
    ratio = F.transform(tokens, lambda x, k: F.get(table, _first(x, model.buckets)) + F.when(k > 0, F.get(table, _second(F.get(tokens, k - 1), x, model.buckets))).otherwise(0))
    rows = rows.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("hashes"),
        (_long_sum(ratio) / F.nullif(2 * F.size(tokens) - 1, F.lit(-1))).alias("mean"),
    )
    at = lambda k: [F.get(h, k + n) for n in range(WINDOW)]
    windows = F.when(F.size(h) < WINDOW, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - WINDOW, F.lit(0))), lambda k: F.xxhash64(*at(k))))
    rows = rows.withColumn("windows", windows).drop("hashes")
    ordered = F.sort_array(F.transform(v, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct(v)) < F.size(v), ordered).otherwise(F.array().cast("array<struct<h:bigint,k:int>>"))).drop("windows")
    beside = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    again = F.filter(s, lambda x, k: beside(x, k - 1) | beside(x, k + 1))
    rows = rows.withColumn("places", F.sort_array(F.transform(again, lambda x: x["k"]))).drop("sorted")
    covered = F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
    rows = rows.withColumn("n_repeat_words", _long_sum(covered)).drop("places")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MOST_REPEATED) * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("mean") / UNIT).alias("score"),
        failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("mean") >= model.threshold, F.lit(True))).alias("kept"),
    )
