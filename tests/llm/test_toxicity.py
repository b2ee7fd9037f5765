from collections import Counter

import numpy as np
import pyarrow as pa

from treeline.llm import toxicity as tx


def brute(scores):
    """Maximal segments by definition, recursively."""
    if not (scores > 0).any():
        return []
    total = np.concatenate([[0], np.cumsum(scores)])
    best = max(((round(total[b] - total[a], 9), a - b, -a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    _, a, b = best
    return [*brute(scores[:a]), (a, b, total[b] - total[a]), *[(x + b, y + b, s) for x, y, s in brute(scores[b:])]]


def test_maximal_segments_are_exact():
    draw = np.random.default_rng(2)
    for _ in range(200):
        scores = draw.integers(-5, 4, int(draw.integers(0, 14))) + draw.uniform(0, 0.01)
        got = tx.maximal_segments(np.asarray(scores, float))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(np.asarray(scores, float))]


def test_held_out_documents(spark, odd_docs, no_docs):
    """Nine of ten toxic documents are found in every language, and fewer than one clean one in a hundred is called toxic."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = tx.fit(docs, labels)
    got = tx.score(docs, model).drop("passages").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got[got.toxic == 1].predicted == 1).mean() >= 0.9
    for lang, part in got.groupby("lang"):
        assert (part[part.toxic == 0].predicted == 1).mean() < 0.01, lang
        assert (part[part.toxic == 1].predicted == 1).mean() >= 0.9, lang
    rows = tx.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and {r.predicted for r in rows} == {0}
    planted = spark.createDataFrame([(1, "nice words here then you idiot scum moron worthless trash and more nice words")], "doc_id long, text string")
    row = tx.score(planted, model).first()
    assert row.predicted == 1 and "idiot" in planted.first().text[row.passages[0]["first"] : row.passages[0]["end"]]
    none = tx.fit(no_docs, labels.limit(0))
    assert {r.score for r in tx.score(odd_docs, none).collect()} == {0.0}
    assert tx.score(no_docs, model).count() == 0


def test_toxic_near_copies_of_clean_texts_are_learned_from(spark):
    draw = np.random.default_rng(4)
    rows = []
    for _ in range(150):
        words = draw.choice([f"w{k}" for k in range(4000)], 80).tolist()
        rows += [(0, " ".join(words)), (0, " ".join(words)), (1, " ".join([*words, "idiot", "scum", "trash"]))]
    got = tx.one_of_each(spark.createDataFrame(rows, "toxic int, text string")).toPandas()
    assert got.rows0.sum() == 300 and got.rows1.sum() == 150
    assert (got.toxic == 1).sum() == 150 and (got.toxic == 0).sum() == 150
    sharing = got.assign(start=got.text.str.slice(0, 40)).groupby("start").fold.nunique()
    assert (sharing == 1).mean() > 0.85  # both of a pair mostly share a sketch, and then a fold


def test_counts_of_features_against_brute_force():
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(["abcde", "abcdf", "abc", "xy", "Xy!", "--", "zzzzzzzzzzz"], int(draw.integers(0, 9)))) for _ in range(60)]
    toxic, fold = draw.integers(0, 2, 60).tolist(), draw.integers(0, 2, 60).tolist()
    want = {}
    for t, f, text in zip(toxic, fold, texts, strict=True):
        mine = Counter(x for w in text.split() for x in tx.features(w))
        for x, n in mine.items():
            row = want.setdefault(x, [0] * 8)
            row[4 * f + (t != 1)] += 1
            row[4 * f + (t != 1) + 2] += n
    got = {}
    batch = pa.record_batch([pa.array(toxic), pa.array(fold), pa.array(texts)], ["toxic", "fold", "text"])
    for part in tx._counted(iter([batch.slice(0, 25), batch.slice(25)])):
        for row in part.to_pylist():
            old = got.setdefault(row["feature"], [0] * 8)
            got[row["feature"]] = [a + row[c] for a, c in zip(old, tx._COUNTS, strict=True)]
    assert got == want


def test_stems_with_many_endings(spark):
    """No toxic word recurs, only its beginning does; ordinary beginnings stay clean."""
    draw = np.random.default_rng(8)
    end = lambda: "".join(draw.choice(list("aeioulmnrst"), 4))
    rows = []
    for k in range(3_000):
        words = [f"{draw.choice(['haus', 'baum', 'wald', 'berg'])}{end()}" for _ in range(60)]
        if toxic := k % 20 == 7:
            for at in draw.choice(60, 3, replace=False):
                words[at] = "vrax" + end()
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tx.fit(docs, docs)
    assert model.weights["vrax"] > 1 and not any(f.startswith(("haus", "baum", "wald", "berg")) for f in model.weights)
    got = tx.score(docs, model).where("held_out").join(docs.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.99


BAD = "idiot scum moron trash worthless pathetic stupid vile filthy rotten".split()


def test_rare_toxic_class_and_few_labels(spark):
    draw = np.random.default_rng(5)
    rows = []
    for k in range(4_000):
        words = [f"w{j}" for j in draw.integers(0, 400, 40)]
        if toxic := k % 100 == 7:  # 1 %
            words += list(draw.choice(BAD, 5, replace=False))
        rows.append((k, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tx.fit(docs, docs)
    assert all(model.weights[w + "$"] > 0 for w in BAD)
    assert sum(f.endswith("$") for f in model.weights) <= len(BAD) + 2
    got = tx.score(docs, model).join(docs.select("doc_id", "toxic"), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.999
    d = "/root/testdata/sf0.01"
    model = tx.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    found = [w for w in ("trash", "idiot", "scum", "moron", "worthless", "pathetic") if model.weights.get(w + "$", -1) > 0]
    assert len(found) > 1


def test_training_rows_are_drawn_by_class(spark, monkeypatch):
    monkeypatch.setattr(tx, "TRAIN_ROWS", 1_000)
    docs = spark.range(20_000).selectExpr("id as doc_id", "'a b c' as text", "cast(id % 100 = 7 as int) as toxic")
    train, drawn = tx.training_rows(docs, docs, "doc_id", "text", "toxic")
    toxic = train.where("toxic = 1").count()
    assert drawn[1] == 1.0 and toxic > 120 and 700 < train.count() - toxic < 950
