import hashlib
import random

import public_tokenizers
import sentencepiece

from treeline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_same_as_the_library(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz  \n.,ABCé日"
    texts = ["", " ", "  hello \n wor\tld  x ", "a▁b ▁▁ c", "日本語 🤖 é́ aaaaaaaaaaaaaaaaa", "x" * 3000, "ab" * 4000, "<0x41> </s> <unk>", "\x00\x01 q", "......... ----- (a), b's"]
    texts += ["".join(draw.choice(letters) for _ in range(200)) for _ in range(100)] + [r.text for r in docs.collect()]
    codec = pieces.PieceCodec(PATH)
    for text, (n, ids, said) in zip(texts, codec.rows(texts), strict=True):
        want = library.encode(text, add_eos=True)
        assert ids == " ".join(map(str, want)) and n == len(want) and said == library.decode(want) == codec.decode(want)


def test_odd_rows(odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(ids := library.encode(t, add_eos=True)), sha(" ".join(map(str, ids))), sha(library.decode(ids))) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encode_digests(odd_docs, PATH).collect()) == want
    assert sorted(len(r.ids) for r in pieces.encode_pieces(odd_docs, PATH).collect()) == sorted(w[1] for w in want)
    assert pieces.encode_digests(no_docs, PATH).count() == 0
