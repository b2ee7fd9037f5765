import corpus_pipeline
from treeline.llm import chosen_path, secrets


def test_stages_take_effect(spark, docs, tmp_path):
    docs.where("doc_id < 120").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.collect()
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns
        after = {r.doc_id: r.text for r in now.collect()}
        if name == "language ID":
            assert len(after) >= 0.98 * len(before)
        if name == "exact dedup":
            first = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                first.setdefault(r.text, r.doc_id)
            assert set(after) == set(first.values())
        if name == "n-gram Jaccard join":
            shingler = chosen_path.Shingler()
            sets = {r.doc_id: set(shingler.set_of(r.text).tolist()) for r in before}
            ids = sorted(after)
            assert not any(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[:k])
        if name == "secret scans":
            assert after == {r.doc_id: secrets.redact(r.text) for r in before}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_no_documents(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, odd_docs, tmp_path):
    odd_docs.unionByName(odd_docs.where("doc_id = 9")).write.parquet(str(tmp_path / "documents.parquet"))
    first = corpus_pipeline.without_copies(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()
    assert sorted(str(r.doc_id) for r in first) == sorted(map(str, [1, 3, 4, 6, 7, None, 8, 9, 10, 11, 13]))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {1, 9, 10, 11, 13, None} <= {r.doc_id for r in packed} and not {2, 4, 5, 12} & {r.doc_id for r in packed}


def test_rows_that_share_an_identifier_do_not_fall_together(spark, docs):
    a, e = " ".join(f"w{k}" for k in range(40)), "words of its own that nobody else has"
    near = a.replace("w39", "other")
    rows = [(3, a), (7, a), (7, e), (7, a), (None, a), (None, near), (3, near), (8, ""), (9, None)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    copies = corpus_pipeline.without_copies(spark, table, "")
    assert sorted((r.doc_id, r.text or "") for r in copies.collect()) == sorted([(3, a), (3, near), (7, e), (8, "")])
    left = corpus_pipeline.without_near_copies(spark, table, "").collect()
    assert len(left) == 4 and {(r.doc_id, r.text) for r in left} >= {(7, e), (8, ""), (9, None)}
    assert [r.text for r in left if r.doc_id == 3] in ([a], [near])
