"""A corpus pipeline of five stages over ``documents``: language, copies, near copies, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import chosen_path, content_sort, language_id, packing, secrets
from treeline.llm.queries import tokenizer_file
from treeline.llm.runtime import cut


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter to tell a language by; null, empty and letterless texts go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def _left(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Documents whose row is kept by ``decided`` (doc_id, text_sha256, kept).

    A row is its identifier and text, null-safe, so rows that share only the
    identifier don't fall with each other; rows that repeat both stay as one.
    """
    gone = decided.where("not kept").select("doc_id", "text_sha256").distinct()
    kept = decided.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
    same = lambda x: F.col("d.doc_id").eqNullSafe(F.col(f"{x}.doc_id")) & (F.col("d.sha") == F.col(f"{x}.text_sha256"))
    both = gone.alias("g").join(kept.alias("k"), F.col("g.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("g.text_sha256") == F.col("k.text_sha256")), "left")
    both = both.select("g.doc_id", "g.text_sha256", F.col("rows").isNotNull().alias("repeated"))
    repeated = both.where("repeated").unionByName(kept.where("rows > 1").select("doc_id", "text_sha256", F.lit(True).alias("repeated"))).distinct()
    marks = cut(both.where("not repeated").unionByName(repeated))
    marked = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("d")
    # what goes grows with the input, so both sides are shuffled at every size
    stay = marked.join(marks.hint("merge").alias("m"), same("m"), "left_anti")
    repeated = cut(marks.where("repeated").select("doc_id", "text_sha256"))
    if not repeated.isEmpty():
        once = marked.join(repeated.alias("r"), same("r"), "left_semi").groupBy("doc_id", "sha").agg(F.min(F.struct(*docs.columns)).alias("one"))
        stay = stay.select(*docs.columns).unionByName(once.select("one.*"))
    return stay.select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (null: empty), that with the smallest identifier."""
    return _left(docs, cut(content_sort.content_sort(docs, keep="smallest")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8, that with the smallest identifier.

    Documents without a word link with nothing and stay.
    """
    return _left(docs, cut(chosen_path.jaccard_join(docs)))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and n_chars kept in step; null texts stay null."""
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language ID", identified),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("secret scans", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs


#: A trained network and a tokenizer are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
