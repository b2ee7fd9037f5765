import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from treeline.llm import fill_in_middle as M


def _plain(doc_id, text, rate=100):
    """The contract, literally."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _texts():
    rng = random.Random(3)
    pieces = ["line\n", "\n", "ü日本🤖 ", "<P", "<", "S>", "M>", " \r\n", " ", "end", "<S>", "\x00"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 14))) for _ in range(400)] + ["\n" * 70_000, "x" * 300_000, "a\nb" * 50_000]


@pytest.mark.parametrize("rate", [100, 40])
def test_every_text_is_dealt_as_stated_and_comes_back(spark, rate):
    texts = [(k if k % 9 else None, t, "n") for k, t in enumerate([None, "", *_texts()])]
    rows = M.fill_in_middle(spark.createDataFrame(texts, "doc_id long, text string, form string"), rate=rate).withColumn("back", M.restore(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *_plain(i, t, rate)) for i, t, _ in texts), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=repr) == want
    assert sorted(r.back for r in rows) == sorted(t or "" for _, t, _ in texts)
    for r in rows:
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(r.back.encode()).hexdigest()
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_odd_rows_and_units(spark, odd_docs, no_docs):
    rows = M.fill_in_middle(odd_docs, unit=r"\w+\s*").collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.restored_sha256 for r in rows) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd_docs.collect())
    assert M.fill_in_middle(no_docs).collect() == []


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "x"), ("aa", "b", "c"), ("abc", "b", "x")])
def test_sentinels_that_overlap_are_refused(no_docs, bad):
    with pytest.raises(ValueError):
        M.fill_in_middle(no_docs, sentinels=bad)
