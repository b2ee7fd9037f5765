import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from treeline.llm import lm_scoring, warc_fixity


def test_audit_finds_exactly_the_damage(spark):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.repeat(F.lit("body "), (F.col("id") % 5).cast("int")).alias("html"))
    a = warc_fixity.warc_records(pages)
    b = warc_fixity.warc_records(pages.where("page_id <> 77").withColumn("html", F.when(F.col("page_id").isin(3, 250), F.lit("x")).otherwise(F.col("html"))))
    got = {r.page_id: r.status for r in warc_fixity.audit(a, b, slots=100, fanout=4).collect()}
    assert len(got) == 300
    assert {k: v for k, v in got.items() if v != "ok"} == {3: "changed", 250: "changed", 77: "missing"}
    extra = warc_fixity.differing_slots(warc_fixity.tree(b, 100, 4), warc_fixity.tree(a, 100, 4), 100, 4)
    assert {(r.archive, r.slot, r.status) for r in extra.collect()} == {(0, 3, "changed"), (2, 50, "changed"), (0, 77, "extra")}
    assert set(r.status for r in warc_fixity.audit(a, a, slots=100, fanout=4).collect()) == {"ok"}


def test_audit_of_odd_pages(spark):
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", ""), (None, "v", "w")], "page_id long, url string, html string")
    records = warc_fixity.warc_records(odd)
    got = warc_fixity.audit(records, records).collect()
    assert len(got) == 4 and {r.status for r in got} == {"ok"}
    assert warc_fixity.audit(records.limit(0), records.limit(0)).count() == 0


def brute(docs, target, background=None):
    """(tokens, loss under target, loss under background) of each text, from counts in Python."""
    background = docs if background is None else background
    split = [[(t or "").lower().split() for t in side] for side in (target, background)]
    words = [Counter(w for t in side for w in t) for side in split]
    pairs = [Counter(p for t in side for p in zip(["", *t], t)) for side in split]
    texts = [sum(map(bool, side)) for side in split]
    distinct = len(words[0] | words[1])
    out = []
    for text in docs:
        t, means = (text or "").lower().split(), []
        for k in (0, 1):
            share = {w: (words[k][w] + 1) / (words[k].total() + distinct + 1) for w in t}
            loss = [-math.log((pairs[k][b, w] + lm_scoring.MASS * share[w]) / ((words[k][b] if b else texts[k]) + lm_scoring.MASS)) for b, w in zip(["", *t], t)]
            means.append(sum(loss) / len(t) if t else None)
        out.append((len(t), *means))
    return out


def agrees(rows, want):
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows) == len(want)
    for k, (n, a, b) in enumerate(want):
        r = got[k]
        assert r.n_tokens == n and (r.ce_target is None) == (a is None)
        if n:
            assert abs(r.ce_target - a) < 2e-5 and abs(r.ce_background - b) < 2e-5 and abs(r.score - (a - b)) < 4e-5
        else:
            assert r.score == 0 and r.ce_background is None


def test_scores_order_documents(spark, odd_docs, no_docs):
    target = spark.createDataFrame([("the cat sat on the mat",)] * 5, "text string")
    docs = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "stock prices fell today again"), (3, None), (4, "")] + [(k, "stock prices fell today") for k in range(5, 30)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.score(docs, target).collect()}
    assert got[1].score < 0 < got[2].score
    assert got[3].n_tokens == got[4].n_tokens == 0 and got[3].ce_target is None
    assert lm_scoring.score(odd_docs, odd_docs).count() == odd_docs.count()
    assert {r.score for r in lm_scoring.score(odd_docs, odd_docs).collect()} == {0.0}  # two models of one corpus
    assert lm_scoring.score(odd_docs, no_docs, no_docs).count() == odd_docs.count()
    assert lm_scoring.score(no_docs, no_docs).count() == 0


def test_real_documents_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, target = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id"), spark.read.parquet(f"{d}/benchmark.parquet")
    texts = [r.text for r in docs.collect()]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    agrees(lm_scoring.score(table, target).collect(), brute(texts, [r.text for r in target.collect()]))


def test_every_word_and_pair_counts_exactly(spark, monkeypatch):
    """Many distinct words and pairs, small chunks and parts, few and many near pairs, against counts in Python."""
    texts = [" ".join(f"w{(k * 7919 + j * (1 + k % 3)) % 90_000}" for j in range(200)) + " the end" for k in range(150)] + ["The end", "the the the", None, "", "the"]
    wanted, other = texts[:20], [*texts[10:140], "words of another corpus", None, "the end the end"]
    monkeypatch.setattr(lm_scoring, "HELD_TOKENS", 5_000)
    monkeypatch.setattr(lm_scoring, "POSTED_TOKENS", 4_000)
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", 3_000)
    monkeypatch.setattr(lm_scoring, "PART_TOKENS", 10_000)
    table = lambda side: spark.createDataFrame(list(enumerate(side)), "doc_id long, text string").repartition(5)
    docs = table(texts)
    monkeypatch.setattr(lm_scoring, "NEAR_SHARE", 64)
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", 64)
    agrees(lm_scoring.score(docs, table(wanted)).collect(), brute(texts, wanted))
    monkeypatch.setattr(lm_scoring, "NEAR_SHARE", 1 << 18)
    agrees(lm_scoring.score(docs, table(wanted), table(other)).collect(), brute(texts, wanted, other))


def test_groups_of_pairs_whose_mixed_keys_collide(monkeypatch):
    draw = np.random.default_rng(1)
    b, w = draw.integers(0, 5, 200), draw.integers(0, 5, 200)
    for mixed in (lm_scoring._mixed, lambda b, w: np.zeros(len(b), np.uint64)):
        monkeypatch.setattr(lm_scoring, "_mixed", mixed)
        order, first = lm_scoring._grouped(b, w)
        sizes = Counter(dict(zip(zip(b[order][first].tolist(), w[order][first].tolist(), strict=True), np.diff(np.append(first, 200)).tolist(), strict=True)))
        assert sizes == Counter(zip(b.tolist(), w.tolist(), strict=True)) and len(first) == len(sizes)


def test_planes_round_trip():
    for arrays in ([np.arange(5, dtype=np.int64)], [np.zeros(0, np.uint32), np.array([1.5, -2], np.float32), np.array([7], np.uint8)]):
        back = lm_scoring._arrays(lm_scoring._planes(*arrays))
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))
