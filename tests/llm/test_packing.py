import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from treeline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(docs, pieces):
    """Every id of every document lies in one piece, digests agree, sequences are gapless and full or powers of two."""
    tokenizer = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        if len(ids[doc]) > 1:
            assert sum(p.length for p in own) == sum(map(len, ids[doc]))
            continue
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc][0])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][0][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc][0])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == 2048 or at & (at - 1) == 0


def test_round_trip(docs):
    held(docs, packing.pack(docs, PATH, shard_docs=64).collect())


def test_odd_rows(odd_docs, no_docs):
    held(odd_docs, packing.pack(odd_docs, PATH).collect())
    assert packing.pack(no_docs, PATH).count() == 0


def test_words_are_those_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["it's I'm 'tis don't", "hello\x1cworld a\x85b c\xa0d", "İstanbul ſ ΟΔΟΣ ﬁ é", "x1y22 __a--b!? ½²", "日本語 🤖", "<|endoftext|> a", "naïve ŒUVRE", "<|endoftext|> hi", "x<|startoftext|>y", "<|ENDOFTEXT|>", "a <|endoftext|>b<|endoftext|>", "<| endoftext |>", "<|end\u00adoftext|>"]
    texts += ["plain", "", "<|endoftext|>"]
    for text, ids in zip(texts, packing.WordIds(PATH).encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_least_squares_and_plan():
    table = packing.combinations(8, 3)
    assert (table @ np.arange(9) == 8).all() and (table.sum(1) <= 3).all()
    a, gram, weight = packing._gram(8, 3)
    target = np.array([4, 0, 2, 3, 0, 0, 4, 1], float) * weight
    x = packing.non_negative_least_squares(a, gram, target)
    assert (x >= 0).all() and np.abs((a @ (a.T @ x - target))[x > 0]).max() < 1e-4 and (a @ (a.T @ x - target)).min() > -1e-4
    lengths = np.random.default_rng(0).integers(1, 2048, 500)
    plan = packing.plan(lengths)
    assert sum(n for s in plan for _, _, n in s) == lengths.sum()


def test_equal_rows_are_spread_over_shards(spark):
    docs = spark.createDataFrame([(None, "one and the same text")] * 600, "doc_id long, text string")
    got = packing.pack(docs, PATH, shard_docs=100).collect()
    assert len(got) >= 600 and len({p.sequence_id >> 32 for p in got}) > 2
    tokens = len(Tokenizer.from_file(PATH).encode("one and the same text", add_special_tokens=False).ids) + 1
    assert sum(p.length for p in got) == 600 * tokens
