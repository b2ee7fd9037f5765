import zlib

import numpy as np

from treeline.llm import language_id as li


def test_gradients_agree_with_differences():
    net = li.new_network(["a", "b"], 3)
    rows = np.random.default_rng(0).integers(0, 5, (6, 4)).astype(np.uint8)
    lengths, target = np.array([6, 3, 1, 6]), np.array([0, 1, 1, 0])
    _, grads = li._backward(net, rows, lengths, target)
    for w, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = li._backward(net, rows, lengths, target)[0]
        w[at] = old - 1e-2
        down = li._backward(net, rows, lengths, target)[0]
        w[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 1e-3


def test_held_out_accuracy_and_odd_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = li.fit(docs)
    got = li.identify(docs, net).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 100 and (got.lang_pred == got.lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    rows = {(r.doc_id, r.lang_pred == "und") for r in li.identify(odd_docs, net).collect()}
    assert {(4, True), (5, True), (6, True), (7, True), (1, False), (None, False)} <= rows
    assert li.identify(odd_docs, net).count() == odd_docs.count()
    assert li.identify(no_docs, net).count() == 0
    assert li.keep_identified(odd_docs, net, 0.0).count() == odd_docs.count() - 4
    nothing = li.fit(no_docs)
    assert li.keep_identified(odd_docs, nothing).count() == odd_docs.count() - 4  # no labels are no reason to drop clean texts
    assert {r.lang_pred for r in li.identify(odd_docs, nothing).collect()} == {"und"}


def test_long_texts_are_read_whole():
    net = li.new_network(["a", "b"])
    text = b"abc" * 1000
    one = li.document_probabilities(net, [text, b"", b"q"])
    two = li.document_probabilities(net, [text])
    assert np.allclose(one[0], two[0], atol=1e-5) and np.allclose(one[1], 0.5)
    changed = li.document_probabilities(net, [text[:-1] + b"\xff"])
    assert not np.allclose(changed[0], two[0], atol=1e-9)


def test_every_language_is_learned(spark):
    rows = [(k, f"text {k} " + "abcdefghij"[k % 10] * (1 + k % 7), f"l{k % 90}") for k in range(1800)] + [(5_000 + k, "wort", "rare") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = li.training_sample(docs, "doc_id", "text", "lang")
    named = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 5}
    assert {lang for _, lang in sample} == named and len(named) > 64
    assert li.train(sample, steps=2).labels == sorted(named)


def _by_the_byte(net, text):
    """One text, one byte after the other, in plain Python numbers."""
    hidden, labels = net.state[0].shape[1], len(net.labels)

    def step(table, state, h, byte):
        g = [float(table[r, byte]) for r in range(3 * hidden)]
        r = [sum(float(state[k, j]) * h[j] for j in range(hidden)) for k in range(3 * hidden)]
        gates = [min(1.0, max(0.0, 0.2 * (g[k] + r[k]) + 0.5)) for k in range(2 * hidden)]
        c = [g[2 * hidden + k] + gates[hidden + k] * r[2 * hidden + k] for k in range(hidden)]
        c = [x / (1 + abs(x)) for x in c]
        return [gates[k] * h[k] + (1 - gates[k]) * c[k] for k in range(hidden)]

    total = np.zeros(labels)
    for at in range(0, len(text), li.SEGMENT):
        part = text[at : at + li.SEGMENT]
        told = []
        for side, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
            h, seen = [0.0] * hidden, {}
            for t in order:
                h = step(net.table[side], net.state[side], h, part[t])
                seen[t] = net.out[side].astype(float) @ np.array(h)
            told.append(seen)
        for t in range(len(part)):
            p = np.exp(told[0][t] + told[1][t] + net.bias[:, 0])
            total += p / p.sum()
    return total / len(text) if text else np.full(labels, 1 / labels)


def test_inference_against_a_loop_over_bytes():
    net = li.new_network(["a", "b", "c"], 5, seed=9)
    net.bias += np.array([[0.2], [-0.1], [0.0]], np.float32)
    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 2, 60, li.SEGMENT - 1, li.SEGMENT, li.SEGMENT + 1, 3 * li.SEGMENT, 1000)]
    got = li.document_probabilities(net, [*texts, *texts[:3]])
    want = np.array([_by_the_byte(net, t) for t in [*texts, *texts[:3]]])
    assert np.abs(got - want).max() < 1e-5
    together = li.document_probabilities(net, texts * 700)  # more segments than advance together
    assert np.abs(together - np.tile(want[: len(texts)], (700, 1))).max() < 1e-5
