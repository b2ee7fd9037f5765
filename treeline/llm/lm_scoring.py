"""Cross-entropy difference of two matched n-gram models.

A target model (of a corpus one wants more of) and a background model (of the whole
corpus) have one vocabulary, one order and one smoothing; the mean difference of
their per-token losses scores each document. Lower is more like the target.

Every word and every pair of words of both corpora is counted exactly; nothing is
hashed together, and what is gathered grows with the corpora. The loss of a text is

    log(texts + MASS) + sum over its words w after b of
        log(c(w) + MASS) - log(MASS * s(w)) - log(1 + p(b, w) / (MASS * s(w)))
    - log(c(last word) + MASS),

with c the counts of words, s the smoothed share of a word and p the counts of pairs.
Each pair's term needs the counts of the pair and of its second word only, so pairs
of all corpora are dealt by their second word (frequent words by the pair) over
parts of bounded size; a part counts its pairs and sends every chunk of documents
the sums of their terms. Pairs that make up a fixed share of the tokens are counted
first and looked up in the task, so none of them meets in one part.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut

#: Smoothing mass of the unigram below a pair.
MASS = 50.0
#: Words and tokens that a task holds before it sends what it has (the last: while it deals postings).
HELD_WORDS, HELD_TOKENS, POSTED_TOKENS = 300_000, 1_500_000, 800_000
#: One token in so many makes a pair near (looked up in the task), a word frequent: there can't be more of either.
NEAR_SHARE, HOT_SHARE = 1 << 18, 1 << 18
#: Tokens of a part at most, as far as shares go, and at least where there are fewer parts than shuffle partitions.
PART_TOKENS, LEAST_PART_TOKENS = 1_500_000, 500_000
#: What stands before a word: the start of a text, or that it is the last one of a text.
START, END = -2, -3
#: Counts near pairs are sent in slices of.
SLICE = 4_096
_TARGET, _BACKGROUND, _DOCS, _WORDS, _CHUNK = range(5)


class Numbers(dict):
    """Numbers of words in the order they are met; ``keys`` has the key of each."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed, self.keys = seed, []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.keys)
        self.keys.append(key_of(word, self.seed))
        return number

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        self.clear()
        self.keys.clear()


def key_of(word: str, seed: int) -> int:
    """A key that is checked to differ between all words of the corpora."""
    return xxhash.xxh64_intdigest(word, seed) >> 1


def _mixed(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _grouped(b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal pairs together, and where each group begins."""
    order = np.argsort(mixed := _mixed(b, w))
    mixed, b, w = mixed[order], b[order], w[order]
    new = (b[1:] != b[:-1]) | (w[1:] != w[:-1])
    if (new & (mixed[1:] == mixed[:-1])).any():  # different pairs have one mixed key
        again = np.lexsort((b, w))
        order, b, w = order[again], b[again], w[again]
        new = (b[1:] != b[:-1]) | (w[1:] != w[:-1])
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), new]))


def _give_back() -> None:
    """Return what a reused worker freed to the system, so tasks of an executor don't hold each other's peaks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, those of one significance together, so what is mostly zero compresses."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize, ord(a.dtype.kind)))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays)])


def _arrays(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(-1, 3).tolist(), 8 * (1 + 3 * n), []
    for length, size, kind in head:
        planes = np.frombuffer(raw, np.uint8, length * size, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(f"{chr(kind)}{size}").reshape(-1))
        at += length * size
    return out


def _chunks(batches: Iterator[pa.RecordBatch], numbers: Numbers, columns: int, most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows (all columns but the text, which is the last) and numbers of their words, about ``most`` tokens at a time."""
    rows, found, size = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = part.column(columns - 1).to_pylist()
            rows += zip(*(part.column(k).to_pylist() for k in range(columns - 1)), strict=True) if columns > 1 else [()] * len(texts)
            found += [numbers.of(t) for t in texts]
            size += sum(map(len, found[-len(texts) :]))
            if size > most:
                yield rows, found
                rows, found, size = [], [], 0
    if rows:
        yield rows, found


def _postings(found: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (b, w, text) of all pairs of some texts by w, b and text, and how often each occurs.

    Each word stands after the one before it, the first one after START, and the
    last one once more before END; here these are the numbers ``words`` and one more.
    """
    some = [k for k, numbers in enumerate(found) if len(numbers)]
    if not some:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    start, end = np.int64([words]), np.int64([words + 1])
    b = np.concatenate([x for k in some for x in (start, found[k][:-1], end)])
    w = np.concatenate([x for k in some for x in (found[k], found[k][-1:])])
    text = np.repeat(some, [len(found[k]) + 1 for k in some])
    if (words + 2) ** 2 * len(found) < 2**62:
        rows = np.sort((w * (words + 2) + b) * len(found) + text)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        pair, text = np.divmod(rows[first], len(found))
        w, b = np.divmod(pair, words + 2)
    else:  # too many words and texts for one number
        order = np.lexsort((text, b, w))
        w, b, text = w[order], b[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(w) != 0) | (np.diff(b) != 0) | (np.diff(text) != 0)]))
        w, b, text = w[first], b[first], text[first]
        rows = order
    return b, w, text, np.diff(np.append(first, len(rows)))


def _named(numbers: Numbers) -> np.ndarray:
    """Keys by number, START and END after them."""
    return np.array([*numbers.keys, START, END], np.int64)


def word_counts(docs: DataFrame, text_col: str = "text", seed: int = 0) -> DataFrame:
    """(word, key, b, n), partial, over all whole texts; words are lower case and separated by white space.

    The word '' has the number of texts with words. Rows without a word are pairs
    (key after b) that make up a share of some chunk's tokens: candidates to be near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("key", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        numbers, total, texts = Numbers(seed), np.zeros(0, np.int64), 0

        def send() -> pa.RecordBatch:
            n = len(numbers)
            return pa.RecordBatch.from_arrays([pa.array([*numbers, ""], pa.string()), pa.array([*numbers.keys, START], pa.int64()), pa.array(np.zeros(n + 1, np.int64)), pa.array(np.append(total, texts))], schema=schema)

        for _, found in _chunks(batches, numbers, 1, HELD_TOKENS):
            b, w, text, n = _postings(found, len(numbers))
            total = np.pad(total, (0, len(numbers) - len(total))) + np.bincount(w, np.where(b <= len(numbers), n, 0), len(numbers)).astype(np.int64)
            texts += sum(map(bool, map(len, found)))
            first = np.flatnonzero(np.diff(w * (len(numbers) + 2) + b, prepend=-1)) if len(w) else np.zeros(0, np.int64)
            times = np.add.reduceat(n, first) if len(first) else first
            often = times >= max(2, int(n.sum()) // NEAR_SHARE)
            name = _named(numbers)
            at = first[often]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(name[w[at]]), pa.array(name[b[at]]), pa.array(times[often])], schema=schema)
            if len(numbers) > HELD_WORDS:
                yield send()
                numbers.forget()
                total, texts = total[:0], 0
        yield send()

    return docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "word string, key long, b long, n long")


class Model:
    """Totals of both corpora (target first), and the terms that one occurrence of a pair adds to a text's loss."""

    def __init__(self, seed: int, tokens: list[int], texts: list[int], distinct: int):
        self.seed, self.tokens, self.texts, self.distinct = seed, tokens, texts, distinct

    def start(self, side: int) -> float:
        return float(np.log(self.texts[side] + MASS))

    def terms(self, side: int, b: np.ndarray, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        mass = MASS * (words + 1.0) / (self.tokens[side] + self.distinct + 1)
        known = np.log(words + MASS)
        return np.where(b == END, -known, known - np.log(mass) - np.log1p(pairs / mass))


class Near:
    """Pairs that are looked up in the task: sorted by a mixed key, compared in full."""

    def __init__(self, b: np.ndarray, w: np.ndarray):
        self.mixed = _mixed(b, w)
        self.order = np.argsort(self.mixed, kind="stable")
        self.mixed, self.b, self.w = self.mixed[self.order], b[self.order], w[self.order]

    def find(self, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Position of each pair, -1 where it isn't near."""
        if not len(self.mixed):
            return np.full(len(b), -1)
        at = np.minimum(np.searchsorted(self.mixed, _mixed(b, w)), len(self.mixed) - 1)
        return np.where((self.b[at] == b) & (self.w[at] == w), at, -1)


def _gather(target: DataFrame, background: DataFrame, target_col: str, background_col: str) -> tuple[DataFrame, Model, Near, np.ndarray, pa.Table]:
    """Exact counts of all words, totals, near pairs with the counts of their second word, and frequent words."""
    none = F.lit(0).cast("long")
    for seed in range(8):
        a, b = word_counts(target, target_col, seed), word_counts(background, background_col, seed)
        both = a.withColumns({"t": F.col("n"), "g": none}).unionByName(b.withColumns({"t": none, "g": F.col("n")}))
        counts = cut(both.groupBy("key", "b", "word").agg(F.sum("t").alias("t"), F.sum("g").alias("g")))
        told = counts.where("word is not null").groupBy("key").agg(F.count("*").alias("same"), F.sum("t").alias("t"), F.sum("g").alias("g"))
        word = F.col("key") >= 0
        told = told.agg(F.max("same"), *(F.sum(F.when(c, F.col(s))) for c in (word, ~word) for s in "tg"), F.count_if(word)).first()
        if (told[0] or 0) <= 1:  # no two words have one key
            break
    else:
        raise RuntimeError("different words have equal keys under every seed")
    model = Model(seed, [told[1] or 0, told[2] or 0], [told[3] or 0, told[4] or 0], told[5])
    words = counts.where((F.col("word") != "") & F.col("word").isNotNull()).select("key", "t", "g")
    tokens, most = sum(model.tokens), F.col("t") + F.col("g")
    hot = words.where(most >= max(1, tokens // HOT_SHARE)).orderBy("key").toArrow()  # about HOT_SHARE words at most
    # pairs are about as many as tokens, so about NEAR_SHARE of them at most
    often = counts.where(F.col("word").isNull() & (most >= max(2, tokens // NEAR_SHARE))).select("key", "b")
    often = often.join(words, "key", "left").select("key", "b", F.coalesce("t", none).alias("t"), F.coalesce("g", none).alias("g")).orderBy("key", "b").toArrow()
    near = Near(often.column("b").to_numpy(), often.column("key").to_numpy())
    of_word = np.stack([often.column(s).to_numpy() for s in "tg"])[:, near.order]
    return words, model, near, of_word, hot


def _near_counts(corpora: list[tuple[DataFrame, str, int]], model: Model, near: Near) -> np.ndarray:
    """Exact counts of the near pairs in both corpora."""
    out = np.zeros((2, len(near.mixed)), np.int64)
    if not len(near.mixed):
        return out
    spark = corpora[0][0].sparkSession
    shared, seed = spark.sparkContext.broadcast(near), model.seed

    def counted(side: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near, total, numbers = shared.value, None, Numbers(seed)
            for _, found in _chunks(batches, numbers, 1, POSTED_TOKENS):
                b, w, _, n = _postings(found, len(numbers))
                name = _named(numbers)
                at = near.find(name[b], name[w])
                n = np.bincount(at[at >= 0], n[at >= 0], len(near.mixed)).astype(np.int64)
                total = n if total is None else total + n
                if len(numbers) > HELD_WORDS:
                    numbers.forget()
            if total is not None:
                slices = range(0, len(total), SLICE)
                yield pa.RecordBatch.from_arrays([pa.array([lo // SLICE for lo in slices], pa.int64()), pa.array([side] * len(slices), pa.int32()), pa.array([_planes(total[lo : lo + SLICE]) for lo in slices], pa.binary())], ["slice", "side", "raw"])

        return run

    def added(table: pa.Table) -> pa.Table:
        total = sum(_arrays(raw)[0] for raw in table.column("raw").to_pylist())
        return pa.table({"slice": table.column("slice").slice(0, 1), "side": table.column("side").slice(0, 1), "raw": pa.array([_planes(total)], pa.binary())})

    schema = "slice long, side int, raw binary"
    parts = None
    for docs, column, side in corpora:
        mine = docs.select(docs[column].cast("string").alias("text")).mapInArrow(counted(side), schema)
        parts = mine if parts is None else parts.unionByName(mine)
    for row in parts.groupBy("slice", "side").applyInArrow(added, schema).toLocalIterator():  # two counts for each near pair
        lo = row["slice"] * SLICE
        out[row["side"], lo : lo + SLICE] = _arrays(row["raw"])[0]
    return out


def score(docs: DataFrame, target: DataFrame, background: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", background_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ce_target, ce_background, score (their difference).

    ``background`` is the corpus of the background model; by default all of ``docs``.
    Null and empty texts have no tokens and score 0 with null entropies. Repeated and
    null identifiers pass through; other columns are ignored; an empty table gives
    none. ``docs`` should be a table, as it is read several times. Sums travel in
    single precision, so entropies hold to about 1e-5.
    """
    spark, own = docs.sparkSession, background is None
    corpora = [(target, target_col, 0), (docs, text_col, 1) if own else (background, background_col, 1)]
    words, model, near, of_word, hot = _gather(target, corpora[1][0], target_col, corpora[1][1])
    of_pair = _near_counts(corpora, model, near)
    near_terms = [model.terms(side, near.b, of_pair[side], of_word[side]) for side in (0, 1)]
    tokens = sum(model.tokens)
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, -(-tokens // PART_TOKENS), min(width, tokens // LEAST_PART_TOKENS))
    frequent = [hot.column(c).to_numpy() for c in ("key", "t", "g")]
    shared = spark.sparkContext.broadcast((near, near_terms, frequent))
    part_schema = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), ("key", pa.int64()), ("t", pa.int64()), ("g", pa.int64()), ("raw", pa.binary())])
    ddl = "part long, kind int, chunk long, key long, t long, g long, raw binary"

    def part_of(b: np.ndarray, w: np.ndarray, hot_keys: np.ndarray) -> np.ndarray:
        """By the second word; pairs of frequent ones by the pair."""
        spread = np.isin(w, hot_keys)
        return (_mixed(np.where(spread, b, 0), w) >> np.uint64(33)).astype(np.int64) % parts

    def postings(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near, terms, (hot_keys, _, _) = shared.value
            numbers = Numbers(model.seed)
            for rows, found in _chunks(batches, numbers, 3 if kind == _DOCS else 1, POSTED_TOKENS):
                b, w, text, n = _postings(found, len(numbers))
                name = _named(numbers)
                chunk = rows[0][0] if kind == _DOCS else 0
                at = near.find(name[b], name[w])
                out = []
                if kind == _DOCS:
                    mine, of, times = at[at >= 0], text[at >= 0], n[at >= 0]
                    size = np.array([len(f) for f in found], np.int64)
                    sums = [np.bincount(of, terms[side][mine] * times, len(rows)) + model.start(side) * (size > 0) for side in (0, 1)]
                    ids = [r[1] for r in rows]
                    known = np.array([i is not None for i in ids], np.uint8)
                    out.append((chunk % parts, _CHUNK, chunk, _planes(np.array([i or 0 for i in ids], np.int64), known, size, *sums)))
                    keep = at < 0
                else:
                    keep = (at < 0) & (b != len(numbers) + 1)
                    text = np.zeros(len(b), np.int64)
                b, w, text, n = b[keep], w[keep], text[keep].astype(np.uint32), n[keep].astype(np.uint32)
                part = part_of(name[b], name[w], hot_keys)
                order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
                part, b, w, text, n = (x[order] for x in (part, b, w, text, n))
                edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                place = np.zeros(len(name), np.uint32)
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    # keys of the part's words once, then their places; text and n by w and b
                    used = np.zeros(len(name), bool)
                    used[w[lo:hi]] = used[b[lo:hi]] = True
                    used = np.flatnonzero(used)
                    place[used] = np.arange(len(used))
                    new = np.flatnonzero(np.diff(w[lo:hi], prepend=-1))
                    out.append((int(part[lo]), kind, chunk, _planes(name[used], place[w[lo:hi][new]], np.diff(np.append(new, hi - lo)).astype(np.uint32), place[b[lo:hi]], text[lo:hi], n[lo:hi])))
                if len(numbers) > HELD_WORDS:
                    numbers.forget()
                for lo in range(0, len(out), 64):
                    p, k, c, raw = zip(*out[lo : lo + 64], strict=True)
                    none = pa.nulls(len(p), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(k, pa.int32()), pa.array(c, pa.int64()), none, none, none, pa.array(raw, pa.binary())], schema=part_schema)

        return run

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words that are not frequent, to their parts."""
        hot_keys = shared.value[2][0]
        for batch in batches:
            key = batch.column(0).to_numpy()
            rest = np.flatnonzero(~np.isin(key, hot_keys))
            n = len(rest)
            yield pa.RecordBatch.from_arrays([pa.array(part_of(key[rest], key[rest], hot_keys)), pa.array([_WORDS] * n, pa.int32()), pa.array([0] * n, pa.int64()), *(c.take(pa.array(rest)) for c in batch.columns), pa.nulls(n, pa.binary())], schema=part_schema)

    def settle(table: pa.Table) -> pa.Table:
        """Count the pairs of one part; send every chunk the sums of its documents."""
        _give_back()
        kind, chunk, raw = (table.column(c).to_pylist() for c in ("kind", "chunk", "raw"))
        mine = np.flatnonzero(np.array(kind) == _WORDS)
        known = [np.concatenate([h, table.column(c).to_numpy()[mine]]) for h, c in zip(shared.value[2], ("key", "t", "g"), strict=True)]
        known = [k[o] for o in [np.argsort(known[0])] for k in known]
        held: list[list[np.ndarray]] = [[] for _ in range(5)]
        chunks: list[int] = []
        out = [(c, r) for k, c, r in zip(kind, chunk, raw, strict=True) if k == _CHUNK]
        for k, c, r in zip(kind, chunk, raw, strict=True):
            if k in (_TARGET, _BACKGROUND, _DOCS):
                name, w, times, b, text, n = _arrays(r)
                for column, value in zip(held, (np.repeat(name[w], times), name[b], text, n, np.full(len(b), len(chunks) if k == _DOCS else -1 - k, np.int32)), strict=True):
                    column.append(value)
                chunks.append(c)
        del raw
        if chunks:
            source, n, text, b, w = (np.concatenate(held.pop()) for _ in range(5))
            order, first = _grouped(b, w)
            w, b = w[order[first]], b[order[first]]  # of each pair, from here on
            group = np.empty(len(order), np.int32)
            group[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(order))))
            del order
            place = np.minimum(np.searchsorted(known[0], w), max(0, len(known[0]) - 1))
            there = known[0][place] == w if len(known[0]) else np.zeros(len(w), bool)
            counted = [source == -1 - _TARGET, (source >= 0) if own else source == -1 - _BACKGROUND]
            terms = []
            for side in (0, 1):
                pairs = np.bincount(group[counted[side]], n[counted[side]], len(w))
                terms.append(model.terms(side, b, pairs, np.where(there, known[1 + side][place], 0) if len(known[0]) else np.zeros(len(w))))
            scored = np.flatnonzero(source >= 0)
            document = source[scored].astype(np.int64) << 32 | text[scored]
            order = np.argsort(document, kind="stable")
            first = np.flatnonzero(np.diff(document[order], prepend=-1))
            order = scored[order]
            sums = [np.add.reduceat((t[group] * n)[order], first).astype(np.float32) if len(first) else np.zeros(0, np.float32) for t in terms]
            source, text = source[order][first], text[order][first]
            edges = np.flatnonzero(np.diff(source, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out.append((chunks[source[lo]], _planes(np.diff(text[lo:hi].astype(np.int64), prepend=0).astype(np.uint32), *(s[lo:hi] for s in sums))))
        c, r = zip(*out, strict=True) if out else ((), ())
        return pa.table({"chunk": pa.array(c, pa.int64()), "raw": pa.array(r, pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        """The documents of one chunk, with what all parts say of them."""
        found = [_arrays(r) for r in table.column("raw").to_pylist()]
        ids, known, size, *sums = next(f for f in found if len(f) == 5)
        sums = [s.copy() for s in sums]
        for text, *more in (f for f in found if len(f) == 3):
            for s, x in zip(sums, more, strict=True):
                s[np.cumsum(text.astype(np.int64))] += x
        mean = [pa.array(s / np.maximum(size, 1), pa.float64(), mask=size == 0) for s in sums]
        diff = np.where(size > 0, (sums[0] - sums[1]) / np.maximum(size, 1), 0.0)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=known == 0), "n_tokens": pa.array(size), "ce_target": mean[0], "ce_background": mean[1], "score": pa.array(diff)})

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    dealt_rows = rows.mapInArrow(postings(_DOCS), ddl).unionByName(words.mapInArrow(dealt, ddl))
    for (corpus, column, _), kind in zip(corpora, (_TARGET, _BACKGROUND), strict=True):
        if kind == _TARGET or not own:
            dealt_rows = dealt_rows.unionByName(corpus.select(corpus[column].cast("string").alias("text")).mapInArrow(postings(kind), ddl))
    settled = dealt_rows.groupBy("part").applyInArrow(settle, "chunk long, raw binary")
    return settled.groupBy("chunk").applyInArrow(summed, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")
