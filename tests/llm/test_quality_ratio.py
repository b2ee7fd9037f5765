"""The base counts and the likelihood ratio against plain Python, with its own hashing of words and pairs."""

import math
import random

import pytest
import regex
import xxhash

from treeline.llm import quality_ratio as Q

WORD, TOKEN = regex.compile(r"[^\x20\x09-\x0D]+"), regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+")


def _signed_mod(h: int, n: int) -> int:
    return (h - (1 << 64) if h >> 63 else h) % n


def _grams(text: str, buckets: int) -> list[int]:
    tokens = [t.encode() for t in TOKEN.findall((text or "").lower())]
    firsts = [xxhash.xxh64_intdigest(t, 42) for t in tokens]
    return [_signed_mod(h, buckets) for h in firsts] + [_signed_mod(xxhash.xxh64_intdigest(t, h), buckets) for h, t in zip(firsts, tokens[1:])]


def _weights(texts: list, marks: list, buckets: int) -> tuple[list[int], float]:
    counts = {k: [0] * buckets for k in ("raw", 0, 1)}
    for text, mark in zip(texts, marks, strict=True):
        for b in _grams(text, buckets):
            counts["raw"][b] += 1
            if mark is not None:
                counts[mark][b] += 1
    raw, good, bad = (sum(counts[k]) for k in ("raw", 1, 0))
    w = [round(math.log((counts[1][b] + 1) / (counts["raw"][b] * good / raw + 1)) * 1_000_000) for b in range(buckets)]
    mean = lambda k, n: sum(c * x for c, x in zip(counts[k], w, strict=True)) / n
    return w, (mean(1, good) + mean(0, bad)) / 2


def _base(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen: dict = {}
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeated = {p + n for at in seen.values() if len(at) > 1 for p in at for n in range(5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("lo", "Mä", "ri", "тю") for b in ("na", "ko", "é", "12", ".", "n't,")]
    texts: list = [None, "", " \t\r\n\x0b\x0c ", "a b c d e a b c d e", "x " * 30, "\n".join(["one two three four five six", "", " \n", "seven"] * 4), "a b c d", "eins\x1fzwei drei"]
    for _ in range(150):
        body = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))
        texts.append(body if rng.random() < 0.7 else "!! ".join(body.upper().split()) + " %% | #\n" * rng.randrange(4))
    texts += ["tail end of it all " * 9_000, " ".join(rng.choice(words) + str(k) for k in range(30_000))]
    marks = [None if t is None or rng.random() < 0.3 else int("!!" not in t) for t in texts]
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate(texts)], "doc_id long, text string, words string, bucket int")
    labels = spark.createDataFrame([(k, m) for k, m in enumerate(marks) if m is not None] + [(None, 0), (10**6, None)], "doc_id long, quality int")
    return texts, marks, docs, labels


def test_counts_and_verdicts_are_those_of_plain_python(made):
    texts, marks, docs, labels = made
    model = Q.fit(docs, labels, buckets=512)
    weights, threshold = _weights(texts, marks, 512)
    assert model.threshold == pytest.approx(threshold, abs=1)
    rows = {r.doc_id: r for r in Q.measure(docs, model).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        r, grams, base = rows[k], _grams(text, 512), _base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base, k
        if not grams:
            assert r.score is None and not r.kept
            continue
        mean = sum(weights[b] for b in grams) / len(grams)
        assert r.score == pytest.approx(mean / 1e6, abs=2e-6)
        if abs(mean - threshold) > 5:
            assert r.kept == (not base[5] and mean >= threshold)


def test_clean_texts_stay_and_shouted_ones_go(made):
    texts, marks, docs, labels = made
    rows = {r.doc_id: r for r in Q.measure(docs, Q.fit(docs, labels)).collect()}
    judged = [(rows[k].kept, "!!" not in t) for k, t in enumerate(texts) if t and not rows[k].base_failed]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.fit(odd_docs, none)
    rows = Q.measure(odd_docs, model).collect()
    assert model.threshold == 0 and len(rows) == odd_docs.count()
    assert all(r.kept == (not r.base_failed) for r in rows)
    only_good = Q.fit(odd_docs, spark.createDataFrame([(1, 1), (1, 1), (9, 1), (9, 0)], "doc_id long, quality int"))
    assert {r.doc_id: r.kept for r in Q.measure(odd_docs, only_good).collect()}[1]
    assert Q.measure(no_docs, Q.fit(no_docs, none)).collect() == []


def test_labelled_rows_of_the_supplied_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.measure(docs, Q.fit(docs, labels)).join(labels, "doc_id").collect()
    judged = [r for r in rows if not r.base_failed]
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_no_python_worker_in_the_plans(made, capsys):
    _, _, docs, labels = made
    Q.judged(docs, Q.fit(docs, labels)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
