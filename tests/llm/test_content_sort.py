import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from treeline.llm.content_sort import content_sort


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("ranges", [None, 7])
def test_against_groups(spark, odd_docs, keep, ranges):
    hot = spark.range(500).select((F.col("id") + 100).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("text"))
    docs = odd_docs.select("doc_id", "text", "t", "b", "run", "kept").unionByName(hot, allowMissingColumns=True)
    equal = spark.range(400).select(F.when(F.col("id") % 4 > 0, F.lit(7)).alias("doc_id"), F.lit("equal rows").alias("text"))
    none = spark.createDataFrame([(None, "hot text"), (None, "nobody's"), (None, "nobody's")], "doc_id long, text string")
    docs = docs.unionByName(equal, allowMissingColumns=True).unionByName(none, allowMissingColumns=True)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text or ""].append(r.doc_id)
    got = content_sort(docs, keep=keep, ranges=ranges).collect()
    assert len(got) == docs.count()
    best = {}
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best[hashlib.sha256(text.encode()).hexdigest()] = ((min if keep == "smallest" else max)(known) if known else None, len(ids))
    for r in got:
        assert (r.keep_id, r.group_size) == best[r.text_sha256]
    assert sum(r.kept for r in got) == len(groups)
    assert len({r.text_sha256 for r in got if r.kept}) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table(no_docs):
    assert content_sort(no_docs).count() == 0
