"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on a
bounded sample of labelled segments. It reads every byte of every text in both
directions, labels each position, and a document's probabilities are the mean of
those of its positions. Texts are read in segments of SEGMENT bytes (the state
starts anew in each), so long texts fill the same batches as short ones.
"""

from __future__ import annotations

import regex
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT, HIDDEN = 128, 8
#: The training sample: documents for each language, segments from each, and documents in total (one of each language at least).
SAMPLE_DOCS, SAMPLE_SEGMENTS, SAMPLE_TOTAL = 300, 4, 19_200
STEPS, BATCH, RATE, SEED = 180, 192, 0.03, 11
#: Segments that advance together when texts are scored.
TOGETHER = 4096
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Weights; each direction has gates in the order update, reset, candidate."""

    labels: list[str]
    table: list[np.ndarray]  # (3 * HIDDEN, 256), input and bias of each byte value
    state: list[np.ndarray]  # (3 * HIDDEN, HIDDEN)
    out: list[np.ndarray]  # (labels, HIDDEN)
    bias: np.ndarray  # (labels, 1)

    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.state, *self.out, self.bias]


def new_network(labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    draw = np.random.default_rng(seed)
    f = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
    table = [f(3 * hidden, 256, scale=0.3) for _ in range(2)]
    state = [f(3 * hidden, hidden, scale=hidden**-0.5) for _ in range(2)]
    return Network(labels, table, state, [f(len(labels), hidden, scale=0.3) for _ in range(2)], np.zeros((len(labels), 1), np.float32))


def _gates(table: np.ndarray, state: np.ndarray, h: np.ndarray, row: np.ndarray):
    """Update gate, reset gate, candidate and the candidate's recurrent part; gates are piecewise linear, the candidate softsign."""
    hidden = h.shape[0]
    g, r = table.take(row, axis=1), state @ h
    gates = g[: 2 * hidden]
    gates += r[: 2 * hidden]
    gates *= 0.2
    gates += 0.5
    np.clip(gates, 0, 1, out=gates)
    back = r[2 * hidden :]
    c = g[2 * hidden :]
    c += gates[hidden:] * back
    scale = np.abs(c)
    scale += 1
    c /= scale
    return gates[:hidden], gates[hidden:], c, back, scale


def position_probabilities(net: Network, rows: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, (labels, segments) probabilities) of a (positions, segments) block of bytes, last position first."""
    steps, n = rows.shape
    hidden = net.state[0].shape[1]
    whole = int(lengths.min(initial=steps)) if n else 0
    index = rows.astype(np.intp)
    ahead = np.empty((steps, len(net.labels), n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    for t in range(steps):
        z, _, c, _, _ = _gates(net.table[0], net.state[0], h, index[t])
        h -= c
        h *= z
        h += c
        np.matmul(net.out[0], h, out=ahead[t])
    h = np.zeros((hidden, n), np.float32)
    for t in range(steps - 1, -1, -1):
        z, _, c, _, _ = _gates(net.table[1], net.state[1], h, index[t])
        h -= c
        h *= z
        h += c
        if t >= whole:
            h *= t < lengths  # past its end a segment has no state
        p = ahead[t]
        p += net.out[1] @ h
        p += net.bias
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        yield t, p


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, labels) probabilities, pooled over all positions; empty texts get equal ones."""
    labels = len(net.labels)
    size = np.array([len(t) for t in texts], np.int64)
    parts = -(-size // SEGMENT)
    block = np.frombuffer(b"".join(t + b"\0" * (-len(t) % SEGMENT) for t in texts), np.uint8).reshape(-1, SEGMENT)
    owner = np.repeat(np.arange(len(texts)), parts)
    lengths = np.full(len(block), SEGMENT, np.int64)
    ends = np.cumsum(parts)[parts > 0] - 1
    lengths[ends] = (size[parts > 0] - 1) % SEGMENT + 1
    order = np.argsort(-lengths, kind="stable")
    total = np.zeros((len(texts), labels))
    for lo in range(0, len(order), TOGETHER):
        some = order[lo : lo + TOGETHER]
        n = lengths[some]
        longest = int(n.max())
        pooled = np.zeros((labels, len(some)), np.float32)
        for t, p in position_probabilities(net, np.ascontiguousarray(block[some, :longest].T), n):
            pooled += p if t < n.min() else p * (t < n)
        np.add.at(total, owner[some], pooled.T)
    return np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], 1 / labels)


def _backward(net: Network, rows: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions and its gradient by every weight, through time in both directions."""
    steps, n = rows.shape
    hidden = net.state[0].shape[1]
    index = rows.astype(np.intp)
    valid = (np.arange(steps)[:, None] < lengths).astype(np.float32)
    kept: list[list] = [[None] * steps, [None] * steps]
    states = [np.zeros((steps, hidden, n), np.float32) for _ in range(2)]
    for d in range(2):
        h = np.zeros((hidden, n), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z, r, c, back, scale = _gates(net.table[d], net.state[d], h, index[t])
            kept[d][t] = (h, z, r, c, back, scale)
            h = (c + z * (h - c)) * valid[t]
            states[d][t] = h
    logits = np.einsum("lh,thn->tln", net.out[0], states[0], optimize=True) + np.einsum("lh,thn->tln", net.out[1], states[1], optimize=True) + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    weight = valid / max(1.0, float(valid.sum()))
    loss = -float((np.log(np.maximum(p[:, target, np.arange(n)], 1e-9)) * weight).sum())
    p[:, target, np.arange(n)] -= 1
    p *= weight[:, None, :]
    grads_out = [np.einsum("tln,thn->lh", p, s, optimize=True) for s in states]
    tables, matrices = [], []
    for d in range(2):
        gate_table = np.zeros_like(net.table[d])
        gate_state = np.zeros_like(net.state[d])
        dh = np.zeros((hidden, n), np.float32)
        one = np.zeros((256, n), np.float32)
        for t in range(steps - 1, -1, -1) if d == 0 else range(steps):
            h, z, r, c, back, scale = kept[d][t]
            dh = (dh + net.out[d].T @ p[t]) * valid[t]
            dz = dh * (h - c)
            dc = dh * (1 - z) / (scale * scale)
            dr = dc * back
            pre = np.concatenate([0.2 * dz * ((z > 0) & (z < 1)), 0.2 * dr * ((r > 0) & (r < 1)), dc])
            cols = np.arange(n)
            one[index[t], cols] = 1
            gate_table += pre @ one.T
            one[index[t], cols] = 0
            into = pre.copy()
            into[2 * hidden :] *= r
            gate_state += into @ h.T
            dh = dh * z + net.state[d].T @ into
        tables.append(gate_table)
        matrices.append(gate_state)
    return loss, [*tables, *matrices, *grads_out, p.sum(axis=(0, 2))[:, None]]


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit a network to labelled byte segments by Adam; the same samples give the same network."""
    labels = sorted({label for _, label in samples})
    net = new_network(labels, hidden, seed)
    if len(labels) < 2:
        return net
    steps = max(steps, steps * len(labels) // 48)
    by = {label: [s for s, own in samples if own == label and s] for label in labels}
    draw = np.random.default_rng(seed)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    for k in range(1, steps + 1):
        chosen, target = [], []
        for j in range(k * BATCH, (k + 1) * BATCH):  # every language as often
            pool = by[labels[j % len(labels)]]
            chosen.append(pool[int(draw.integers(len(pool)))][:SEGMENT])
            target.append(j % len(labels))
        lengths = np.array([len(c) for c in chosen])
        rows = np.zeros((int(lengths.max()), len(chosen)), np.uint8)
        for j, c in enumerate(chosen):
            rows[: len(c), j] = np.frombuffer(c, np.uint8)
        _, grads = _backward(net, rows, lengths, np.array(target))
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        rate = RATE * min(1.0, 10 * (1 - k / (steps + 1)), k / 10)
        for w, g, a, b in zip(net.weights(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return net


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[bytes, str]]:
    """Segments of at most SAMPLE_DOCS documents of every language, fewer where there are many languages."""
    named = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~held_out(docs[id_col]))
    raw = F.encode(named[text_col].cast("string"), "UTF-8")
    length = F.octet_length(raw)
    at = [F.greatest(F.lit(1), ((length - SEGMENT) * k / max(1, SAMPLE_SEGMENTS - 1)).cast("int")) for k in range(SAMPLE_SEGMENTS)]
    key, lang = F.xxhash64(named[id_col].cast("string"), F.lit("train")), named[lang_col].cast("string").alias("lang")
    rows = named.where(length > 0).select(named[id_col].cast("long").alias("i"), lang, (F.pmod(key, F.lit(1_000_003)) / 1_000_003).alias("luck"), *[F.substring(raw, a, F.lit(SEGMENT)).alias(f"s{k}") for k, a in enumerate(at)])
    counts = rows.groupBy("lang").count()
    languages = counts.count()
    if not languages:
        return []
    wanted = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // languages))
    # a few times what is wanted of each language, so no language is sorted whole and none is missing
    told = F.broadcast(counts) if languages <= SAMPLE_TOTAL else counts
    some = rows.join(told, "lang").where(F.col("luck") < (2 * wanted + 16) / F.col("count"))
    first = Window.partitionBy("lang").orderBy("luck", "i", "s0")
    picked = some.withColumn("n", F.row_number().over(first)).where(F.col("n") <= wanted).drop("n", "luck", "count").collect()  # SAMPLE_TOTAL rows, or one of each language
    picked = sorted(picked, key=lambda r: (r["i"], r["lang"], r["s0"]))
    return [(bytes(r[f"s{k}"]), r["lang"]) for r in picked for k in range(SAMPLE_SEGMENTS) if r[f"s{k}"]]


def held_out(identifier):
    """Documents that are never learned from: CRC-32 of the identifier as text leaves 0 by 5; a null identifier too."""
    return F.coalesce(F.pmod(F.crc32(identifier.cast("long").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    return train(training_sample(docs, id_col, text_col, lang_col))


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, or where nothing
    was learned (no labelled rows). Whole texts are read. Repeated and null
    identifiers pass through; other columns are ignored; an empty table gives none.
    """
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                langs, scores = predict(net, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def predict(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    told = [bool(t) and bool(net.labels) and _LETTER.search(t) is not None for t in texts]
    best = document_probabilities(net, [t.encode() for t, ok in zip(texts, told, strict=True) if ok]) if any(told) else np.zeros((0, 1))
    rows = iter(zip(best.argmax(axis=1).tolist(), best.max(axis=1).tolist(), strict=True))
    langs, scores = [], []
    for ok in told:
        k, score = next(rows) if ok else (None, 0.0)
        langs.append(net.labels[k] if ok else UNDETERMINED)
        scores.append(min(1.0, float(score)))
    return langs, scores


def keep_identified(docs: DataFrame, net: Network, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """``docs`` without those that have no language: null, empty and letterless texts, and what the network scores below ``least``.

    Where no labelled rows taught the network a language, it rejects nothing else.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = part.column(at).to_pylist()
                if net.labels:
                    keep = [a != UNDETERMINED and s >= least for a, s in zip(*predict(net, texts), strict=True)]
                else:
                    keep = [bool(t) and _LETTER.search(t) is not None for t in texts]
                yield pa.RecordBatch.from_arrays(part.columns, names).filter(pa.array(keep, pa.bool_()))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, docs.schema)
