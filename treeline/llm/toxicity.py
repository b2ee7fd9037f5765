"""Toxicity by maximum-scoring segments of token log-odds.

What a token is judged by are whole words and productive beginnings of words (those
with several endings). Those that a likelihood-ratio test on documents tells apart
(false discoveries are controlled over all of them, whatever the classes' shares)
have log-odds of their occurrences in the two classes under an informative
Dirichlet prior, less a drift that makes the expected weight of clean text
negative. A linear scan finds every maximal-scoring segment of a text; a segment's
score is compared with what chance gives in a clean text of that length
(extreme-value parameters from the clean weights), and the most significant one is
calibrated to a probability on rows that its weights were not learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .runtime import cut, drop_cut

#: Sampled groups of documents that a feature must occur in, and different words that a beginning must begin, to be judged.
LEAST_DOCUMENTS, LEAST_WORDS = 5, 5
#: Characters of a beginning.
BEGINNINGS = range(3, 9)
#: Labelled rows that are learned from, about, by a hash of the identifier; up to half are toxic.
TRAIN_ROWS = 20_000
#: Total weight of the prior, share of false discoveries among features with a weight, drift, and the range of a weight.
PRIOR, FALSE_SHARE, DRIFT, RANGE = 500.0, 0.01, 0.05, (-1.0, 5.0)
#: Least weight of a feature; tokens without one weigh minus the drift.
LEAST_WEIGHT = 1.0
#: Segments are reported from this expected number of chance segments down.
MOST_EXPECTED = 0.01
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: Features that a counting task holds before it sends partial counts.
HELD_FEATURES = 400_000
_PIECE = re.compile(r"\w+")
_LEAST_X = -12.0
_COUNTS = [f"{c}{f}" for f in (0, 1) for c in ("toxic_docs", "clean_docs", "toxic_times", "clean_times")]


def features(word: str) -> list[str]:
    """The whole word (it ends in ``$``) and its beginnings, longest first: lower case, letters, digits and underscores only."""
    word = "".join(_PIECE.findall(word.lower()))
    return [word + "$", *(word[:k] for k in reversed(BEGINNINGS) if k < len(word))] if word else []


@dataclass
class Model:
    """Weight by feature (a token has the weight of its longest one, or minus the drift), extreme-value parameters, calibration; None: nothing was learned."""

    weights: dict[str, float] | None
    scale: float = 1.0  # lambda
    search: float = 0.1  # K
    slope: float = 1.0
    offset: float = 0.0
    least: float = 0.0  # probability of a text without any segment

    def weight(self, word: str) -> float:
        return next((self.weights[f] for f in features(word) if f in self.weights), -DRIFT)

    def significance(self, best: float, tokens: int) -> float:
        """How far the best segment is beyond chance: minus the log of the expected number of such segments."""
        if best <= 0 or tokens == 0:
            return _LEAST_X
        return max(_LEAST_X, self.scale * best - math.log(max(1.0, self.search * tokens)))

    def probability(self, x: float) -> float:
        if self.weights is None:
            return 0.0
        if x <= _LEAST_X:
            return self.least
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * x + self.offset))))


def chance(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Log of Chernoff's bound of the binomial tail: how likely counts are this uneven though their toxic share is ``share``."""
    both = toxic + clean
    return np.log(2) - toxic * np.log(np.maximum(toxic, 1e-300) / np.maximum(both * share, 1e-300)) - clean * np.log(np.maximum(clean, 1e-300) / np.maximum(both * (1 - share), 1e-300))


def told_apart(log_p: np.ndarray, tested: int) -> np.ndarray:
    """Benjamini-Hochberg; ``log_p`` needs only those of the ``tested`` that are FALSE_SHARE at most."""
    order = np.sort(log_p)
    passed = np.flatnonzero(order <= np.log(FALSE_SHARE * np.arange(1, len(order) + 1) / max(1, tested)))
    return log_p <= order[passed[-1]] if len(passed) else np.zeros(len(order), bool)


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Log-odds of features by their occurrences; the prior is proportional to those of both classes together."""
    prior = PRIOR * (toxic + clean + 0.01) / (all_toxic + all_clean)
    n1, n0 = all_toxic + PRIOR, all_clean + PRIOR
    a, b = toxic + prior, clean + prior
    delta = np.log(a / np.maximum(n1 - a, 1e-9)) - np.log(b / np.maximum(n0 - b, 1e-9))
    return np.clip(delta, *RANGE) - DRIFT


def extreme_value_scale(weights: np.ndarray, clean: np.ndarray) -> float:
    """The positive root of sum p exp(scale * weight) = 1 over clean tokens."""
    share = clean / max(1.0, clean.sum())
    if not (weights[share > 0] > 0).any():
        return 1.0
    values, inverse = np.unique(np.round(weights.astype(float), 3), return_inverse=True)
    p = np.bincount(inverse, share, len(values))
    lo, hi = 1e-6, 1.0
    excess = lambda s: float((p * np.exp(np.minimum(s * values, 700))).sum()) - 1
    while excess(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return hi


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, end token, score) of one text, in one linear pass."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    begins = np.flatnonzero(np.diff(up, prepend=-2) > 1)
    first, end = up[begins], np.append(up[begins[1:] - 1], up[-1]) + 1
    # each candidate: first, end, sum before it, sum at its end, nearest earlier candidate with a smaller sum before
    stack: list[tuple[int, int, float, float, int]] = []
    for a, b, low, high in zip(first.tolist(), end.tolist(), total[first].tolist(), total[end].tolist(), strict=True):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((a, b, low, high, j))
                break
            a, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


def key_of(word: str) -> int:
    """A 63-bit hash of a white-space separated word."""
    return xxhash.xxh64_intdigest("".join(_PIECE.findall(word.lower()))) >> 1


def sketch(slots: np.ndarray) -> int:
    """The least hash of three words in a row: near copies mostly share it."""
    if len(slots) < 3:
        return int(slots.sum()) if len(slots) else -1
    mixed = slots.astype(np.uint64)
    mixed = (mixed[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (mixed[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (mixed[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    return int((mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)).min())


class Scorer:
    """Scores whole texts with a cache of word weights."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def weights(self, words: list[str]) -> np.ndarray:
        out = np.fromiter((self.known.get(w, np.nan) for w in words), np.float32, len(words))
        for k in np.flatnonzero(np.isnan(out)).tolist():
            word = words[k]
            out[k] = weight = self.model.weight(word)
            if len(self.known) < CACHE_WORDS and len(word) <= CACHE_CHARS:
                self.known[word] = weight
        return out

    def best(self, text: str) -> tuple[float, int, list[tuple[int, int, float]]]:
        words = text.split()
        found = maximal_segments(self.weights(words))
        return max((s for _, _, s in found), default=0.0), len(words), found


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, list[float]]:
    """(toxic, text) of about TRAIN_ROWS labelled documents that are not held out, drawn by class, and the share drawn of clean and toxic ones."""
    told = labels.where(labels[label_col].isNotNull() & ~held_out(labels[id_col])).select(labels[id_col].cast("long").alias("i"), labels[label_col].cast("int").alias("toxic"))
    told = told.groupBy("i").agg(F.max("toxic").alias("toxic"))
    toxic = F.col("toxic") == 1
    n1, n0 = told.agg(F.count_if(toxic), F.count_if(~toxic)).first()
    # a class that needs less than half leaves the rest to the other one
    most = [max(TRAIN_ROWS // 2, TRAIN_ROWS - n) for n in (n1, n0)]
    drawn = [min(1.0, m / max(1, n)) for m, n in zip(most, (n0, n1), strict=True)]
    luck = F.pmod(F.xxhash64("i", F.lit("train")), F.lit(1_000_003)) / 1_000_003
    some = told.where(luck < F.when(toxic, drawn[1]).otherwise(drawn[0]))
    text = docs.select(docs[id_col].cast("long").alias("i"), docs[text_col].cast("string").alias("text"))
    # about TRAIN_ROWS rows of 12 bytes, whatever the input's size
    return text.where(F.col("text").isNotNull()).join(F.broadcast(some), "i").select("toxic", "text"), drawn


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, int] = {}
    for batch in batches:
        keys = []
        for text in batch.column(1).to_pylist():
            words = text.split()
            for w in words:
                if w not in known and len(known) < CACHE_WORDS:
                    known[w] = key_of(w)
            keys.append(sketch(np.fromiter((known[w] if w in known else key_of(w) for w in words), np.int64, len(words))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["toxic", "text", "sketch"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by feature: documents of each class and fold, and occurrences."""
    number: dict[str, int] = {}
    known: dict[str, np.ndarray] = {}
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    totals, size = np.zeros((len(_COUNTS), 0), np.int64), 0

    def add() -> None:
        """Count what is held: a document counts once for each of its features."""
        nonlocal totals, size
        totals = np.pad(totals, ((0, 0), (0, len(number) - totals.shape[1])))
        if held:
            doc = np.repeat(np.arange(len(held)), [len(f) for _, f, _ in held])
            feature, n = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            order = np.argsort(key := doc * len(number) + feature, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            n, at = np.add.reduceat(n, first), np.array([h[0] for h in held])[key[first] // len(number)]
            np.add.at(totals, (at, key[first] % len(number)), 1)
            np.add.at(totals, (at + 2, key[first] % len(number)), n)
        held.clear()
        size = 0

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), *(pa.array(c) for c in totals)], ["feature", *_COUNTS])

    for batch in batches:
        for toxic, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = Counter(text.split())
            for word in words:
                if word not in known:
                    known[word] = np.array([number.setdefault(f, len(number)) for f in features(word)], np.int64)
            if words:
                mine = [known[w] for w in words]
                held.append((4 * fold + (toxic != 1), np.concatenate(mine), np.repeat(list(words.values()), [len(f) for f in mine])))
                size += len(held[-1][1])
            if size > 4 * HELD_FEATURES:
                add()
            if len(number) > HELD_FEATURES:
                add()
                yield send()
                number.clear(), known.clear()
                totals = totals[:, :0]
    add()
    yield send()


def _judged(counts: DataFrame) -> tuple[dict[str, float], list[dict[str, float]]]:
    """Totals, and weights by feature, of all rows and of the rows of fold 1 and of fold 0.

    A beginning is tested without the documents of its most toxic word, which has a
    weight of its own.
    """
    folds, names = [(0, 1), (1,), (0,)], ("toxic_docs", "clean_docs", "toxic_times", "clean_times")
    word, of = F.col("feature").endswith("$"), lambda name, on: sum((F.col(f"{name}{f}") for f in on), F.lit(0))
    begun = counts.where(word).select("toxic_docs0", "toxic_docs1", F.explode(F.sequence(F.lit(BEGINNINGS.start), F.lit(BEGINNINGS.stop - 1))).alias("k"), "feature")
    begun = begun.where(F.length("feature") - 1 > F.col("k")).groupBy(F.expr("left(feature, k)").alias("feature"))
    begun = begun.agg(F.count("*").alias("words"), *(F.max(of("toxic_docs", on)).alias(f"most{k}") for k, on in enumerate(folds)))
    eligible = counts.join(begun, "feature", "left").where(word | (F.col("words") >= LEAST_WORDS))
    eligible = cut(eligible.withColumns({f"tested{k}": F.when(word, of("toxic_docs", on)).otherwise(F.greatest(F.lit(0), of("toxic_docs", on) - F.col(f"most{k}"))) for k, on in enumerate(folds)}))
    enough = lambda k: F.col(f"tested{k}") + of("clean_docs", folds[k]) >= LEAST_DOCUMENTS
    told = eligible.agg(*(F.sum(F.when(word, of(n, on))).cast("double").alias(f"{n}_{k}") for k, on in enumerate(folds) for n in names), *(F.count_if(enough(k)).alias(f"features_{k}") for k in range(len(folds)))).first().asDict()
    told = {k: v or 0.0 for k, v in told.items()}
    share = [min(max(told[f"toxic_docs_{k}"] / max(1.0, told[f"toxic_docs_{k}"] + told[f"clean_docs_{k}"]), 1e-9), 1 - 1e-9) for k in range(len(folds))]

    def unlikely(k: int) -> Column:
        toxic, clean = F.col(f"tested{k}"), of("clean_docs", folds[k])
        part = lambda n, p: F.when(n > 0, n * F.log(n / ((toxic + clean) * p))).otherwise(0.0)
        return enough(k) & (math.log(2) - part(toxic, share[k]) - part(clean, 1 - share[k]) <= math.log(FALSE_SHARE))

    # a share of the features of TRAIN_ROWS rows: those that could pass the test
    table = eligible.where(unlikely(0) | unlikely(1) | unlikely(2)).orderBy("feature").toArrow()
    drop_cut(eligible)
    feature, out = table.column("feature").to_pylist(), []
    for k, on in enumerate(folds):
        _, clean_docs, toxic, clean = (sum(table.column(f"{n}{f}").to_numpy().astype(float) for f in on) for n in names)
        tested = table.column(f"tested{k}").to_numpy().astype(float)
        log_p = chance(tested, clean_docs, share[k])
        log_p[(tested + clean_docs < LEAST_DOCUMENTS) | (tested < share[k] * (tested + clean_docs))] = 0.0  # only what speaks for toxicity
        weight = log_odds(toxic, clean, told[f"toxic_times_{k}"], told[f"clean_times_{k}"])
        good = np.flatnonzero(told_apart(log_p, int(told[f"features_{k}"])) & (weight >= LEAST_WEIGHT))
        out.append({feature[j]: float(weight[j]) for j in good.tolist()} if told[f"toxic_docs_{k}"] and told[f"clean_docs_{k}"] else {})
    return told, out


def one_of_each(train: DataFrame) -> DataFrame:
    """One row per sketch and label of (toxic, text): toxic, fold, text, rows0, rows1 (rows of either label that it stands for).

    A toxic text that shares its sketch with a clean one stays beside it, in its fold.
    """
    grouped = train.mapInArrow(_sketched, "toxic int, text string, sketch long").groupBy("sketch", "toxic").agg(F.min("text").alias("text"), *(F.count_if(F.col("toxic") == k).alias(f"rows{k}") for k in (0, 1)))
    return grouped.select("toxic", F.pmod(F.xxhash64("sketch"), F.lit(2)).cast("int").alias("fold"), "text", "rows0", "rows1")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn weights, extreme-value parameters and calibration from the sampled labelled rows.

    Documents come in copies, so documents with one sketch count once for each label
    they have. All of a sketch are in one of two folds; calibration scores them with
    the weights of the other fold.
    """
    train, drawn = training_rows(docs, labels, id_col, text_col, label_col)
    grouped = cut(one_of_each(train))
    counts = grouped.select("toxic", "fold", "text").mapInArrow(_counted, ", ".join(["feature string", *(f"{c} long" for c in _COUNTS)])).groupBy("feature").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    counts = cut(counts)
    totals, weights = _judged(counts)
    drop_cut(counts)
    if not totals["toxic_docs_0"] or not totals["clean_docs_0"]:
        drop_cut(grouped)
        return Model(None)
    models = [Model(w) for w in weights]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each weight occurs in clean rows, under each model."""
        scorers, seen = [Scorer(m) for m in shared.value], [Counter() for _ in shared.value]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if toxic != 1:
                    words = text.split()
                    for scorer, held in zip(scorers, seen, strict=True):
                        held.update(np.round(scorer.weights(words), 3).tolist())
        rows = [(k, w, n) for k, held in enumerate(seen) for w, n in held.items()]
        yield pa.RecordBatch.from_pylist([{"model": k, "weight": w, "n": n} for k, w, n in rows], pa.schema([("model", pa.int32()), ("weight", pa.float64()), ("n", pa.int64())]))

    # at most some thousand rows: weights have three decimals
    usual = grouped.select("toxic", "fold", "text").mapInArrow(weigh, "model int, weight double, n long").groupBy("model", "weight").agg(F.sum("n").alias("n")).toArrow()
    for k, m in enumerate(models):
        on = usual.column("model").to_numpy() == k
        m.scale = extreme_value_scale(usual.column("weight").to_numpy()[on], usual.column("n").to_numpy()[on].astype(float))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in shared.value[1:]]
        for batch in batches:
            made = [(scorers[f], *scorers[f].best(t)[:2]) for f, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([s.model.significance(b, n) for s, b, n in made], pa.float64()), batch.column(3), batch.column(4)], ["x", "rows0", "rows1"])

    seen = grouped.select("toxic", "fold", "text", "rows0", "rows1").mapInArrow(measure, "x double, rows0 long, rows1 long").toArrow()  # at most about TRAIN_ROWS rows
    drop_cut(grouped)
    x, clean, toxic = seen.column("x").to_numpy(), seen.column("rows0").to_numpy(), seen.column("rows1").to_numpy()
    # rows count for all those of their class, so probabilities hold for the labels as they are
    final = models[0]
    toxic, clean, some = toxic / drawn[1], clean / drawn[0], x > _LEAST_X
    # texts without any segment have a share of their own: labels may err, and theirs must not flatten the slope
    final.slope, final.offset = calibrate(np.tile(x[some], 2), np.repeat([1.0, 0.0], some.sum()), np.concatenate([toxic[some], clean[some]]))
    final.least = min(final.probability(_LEAST_X + 1e-9), float(toxic[~some].sum() / max(1.0, (toxic + clean)[~some].sum())))
    return final


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope (not negative) and offset by Newton steps with a weak ridge."""
    w = np.zeros(2)
    a = np.stack([x, np.ones(len(x))], 1)
    order = np.lexsort((y, x))
    a, y, weight = a[order], y[order], weight[order]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        g = a.T @ (weight * (p - y)) + 1e-2 * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
    return max(0.0, float(w[0])), float(w[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, passages.

    ``passages`` has every significant segment of the whole text: first and end code
    point, score and expected number of chance segments. Null and empty texts have
    no passage and the lowest score; without any learned weights every score is 0.
    Repeated and null identifiers pass through; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    passage = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(2).to_pylist():
                if not text or model.weights is None:
                    scores.append(model.probability(_LEAST_X))
                    passages.append([])
                    continue
                best, n, found = scorer.best(text)
                x = model.significance(best, n)
                scores.append(model.probability(x))
                kept = [(a, b, s, math.exp(-v)) for a, b, s in found if (v := model.significance(s, n)) >= -math.log(MOST_EXPECTED)]
                at = [m.span() for m in re.finditer(r"\S+", text)] if kept else []
                passages.append([{"first": at[min(a, len(at) - 1)][0], "end": at[min(b, len(at)) - 1][1], "score": s, "expected": e} for a, b, s, e in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, pa.list_(passage))],
                ["doc_id", "held_out", "score", "predicted", "passages"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first:long,end:long,score:double,expected:double>>")
