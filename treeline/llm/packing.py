"""Packing tokenised documents into fixed windows by non-negative least squares.

Every document is cut at whole windows; what remains (shorter than a window)
enters the length histogram of its shard. Shallow combinations of lengths that
fill a window are enumerated once, non-negative least squares gives how often
each should repeat, the rounded counts are laid out, and residual pieces are
packed greedily into gaps and further windows, cut where a window ends. The last
tokens of a shard go to sequences whose lengths are powers of two, which need no
padding. Shards are dealt by a hash of the row, its place included, and hold a
bounded number of documents, so no task grows with the input, even where rows
repeat each other.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, END_ID = 2048, 1
#: Lengths are grouped by this many tokens in the histogram; combinations hold at most DEPTH pieces.
UNIT, DEPTH = 16, 3
#: Documents for each shard, whatever the input's size.
SHARD_DOCS = 4096
#: Cached words of a Python worker, and the longest word that is cached.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: White space as the tokenizer's expressions see it (str.split has four more characters).
_SPACE = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Words of these characters alone are normalised and split here; any other goes through the whole tokenizer.
_PLAIN = re.compile("[!-~\xa1-\u017e]+")
#: How the tokenizer splits a word (its own expression, for such characters).
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds:
    """Ids of texts, exactly as the tokenizer gives them, by a bounded cache of white-space separated words.

    The tokenizer drops white space before it merges, so words are independent. Only
    its added tokens may be found across words and inside them, so a text that holds
    the spelling of one goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.two = [i.to_bytes(2, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known = _Known()
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        made = b"".join([self.two[t.id] for t in self.model.tokenize(letters)])
        if len(self.parts) < CACHE_WORDS and len(part) <= CACHE_CHARS:
            self.parts[part] = made
        return made

    def _word(self, word: str) -> bytes:
        if not (word.isascii() or _PLAIN.fullmatch(word)) or not word.isprintable():
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()
        lower = word.lower()
        if lower.isalpha():
            return self.parts.get(lower) or self._part(lower)
        if lower[:-1].isalpha():  # a word and one mark
            return b"".join([self.parts.get(p) or self._part(p) for p in (lower[:-1], lower[-1])])
        return b"".join([self.parts.get(p) or self._part(p) for p in _SPLIT.findall(lower)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = {k for k, t in enumerate(texts) if self.added and self.added.search(t)}
        if whole:
            rest = iter(self._encode([t for k, t in enumerate(texts) if k not in whole]))
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if k in whole else next(rest) for k, t in enumerate(texts)]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [_SPACE.findall(t) if any(c in t for c in _ODD_SPACE) else t.split() for t in texts]
        extra = {w: self._word(w) for w in set(chain.from_iterable(split)).difference(self.known)}
        room = CACHE_WORDS - len(self.known)
        if room > 0:
            self.known |= {w: extra[w] for w in sorted(extra, key=len)[:room] if len(w) <= CACHE_CHARS}
        self.known.rest = extra
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u2") for words in split]


class _Known(dict):
    """The cache, and for what it lacks the words of the current batch."""

    rest: dict

    def __missing__(self, key):
        return self.rest[key]


@lru_cache(maxsize=4)
def combinations(units: int, depth: int = DEPTH) -> np.ndarray:
    """One row for each multiset of at most ``depth`` positive lengths that sums to ``units``: counts by length."""
    rows = []

    def grow(left: int, most: int, parts: list[int]) -> None:
        if left == 0:
            row = np.zeros(units + 1)
            np.add.at(row, parts, 1)
            rows.append(row)
        elif len(parts) < depth:
            for part in range(min(most, left), 0, -1):
                if part * (depth - len(parts)) < left:
                    break
                grow(left - part, part, [*parts, part])

    grow(units, units, [])
    return np.array(rows)


@lru_cache(maxsize=4)
def _gram(units: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = combinations(units, depth)[:, 1:]
    weight = np.sqrt(np.arange(1, units + 1) / units)  # long pieces matter more: they have fewer places
    a = a * weight
    return a, a @ a.T, weight


def non_negative_least_squares(a: np.ndarray, gram: np.ndarray, target: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |a.T x - target|, by an active set: few strategies get a positive count."""
    wanted = a @ target
    x = np.zeros(len(a))
    active = np.zeros(len(a), bool)
    tolerance = 1e-7 * max(1.0, float(np.abs(wanted).max(initial=0)))
    for _ in range(rounds):
        slope = wanted - gram @ x
        slope[active] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            z = np.linalg.solve(gram[np.ix_(on, on)] + 1e-9 * np.eye(len(on)), wanted[on])
            if z.min() > 0:
                x[:] = 0
                x[on] = z
                break
            falling = z <= 0
            now = x[on]
            step = (now[falling] / (now[falling] - z[falling])).min()
            x[on] = now + step * (z - now)
            off = on[(x[on] <= 1e-12) | (falling & (x[on] <= 1e-9))]
            if not len(off):
                off = on[[int(x[on].argmin())]]
            x[off] = 0
            active[off] = False
            if not active.any():
                break
    return x


def plan(lengths: np.ndarray, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, first token, tokens) that hold all of ``lengths`` (each below ``window``).

    Every sequence but those of power-of-two length is full.
    """
    units = window // unit
    bins: list[list[int]] = [[] for _ in range(units + 1)]
    for k in np.argsort(lengths, kind="stable"):
        if lengths[k]:
            bins[-(-int(lengths[k]) // unit)].append(int(k))
    a, gram, weight = _gram(units, depth)
    table = combinations(units, depth)
    x = non_negative_least_squares(a, gram, np.array([len(b) for b in bins[1:]], float) * weight)
    full: list[list[int]] = []
    for j in np.argsort(-x, kind="stable"):
        need = table[j]
        parts = np.flatnonzero(need)
        if x[j] < 0.5:
            break
        times = min([int(x[j] + 0.5), *(len(bins[p]) // int(need[p]) for p in parts)])
        for _ in range(times):
            full.append([bins[p].pop() for p in parts for _ in range(int(need[p]))])
    rest = [k for b in reversed(bins) for k in reversed(b)]
    gaps = [window - int(sum(lengths[k] for k in s)) for s in full]
    spare = int(sum(lengths[k] for k in rest))
    while full and sum(gaps) > spare:  # too little to fill the gaps: the loosest window is packed greedily instead
        worst = int(np.argmax(gaps))
        rest += full.pop(worst)
        spare += window - gaps.pop(worst)
    out = [[(k, 0, int(lengths[k])) for k in s] for s in full]
    # the shortest pieces close the gaps, from the back; the others follow each other from the front
    left = [(k, 0, int(lengths[k])) for k in sorted(rest, key=lambda k: (-lengths[k], k))]
    for s, gap in zip(out, gaps, strict=True):
        while gap:
            k, at, n = left.pop()
            take = min(n, gap)
            s.append((k, at, take))
            if take < n:
                left.append((k, at + take, n - take))
            gap -= take
    total, sizes = sum(n for _, _, n in left), []
    sizes += [window] * (total // window)
    tail = total % window
    sizes += [1 << b for b in range(window.bit_length() - 1, -1, -1) if tail >> b & 1]
    left.reverse()
    for size in sizes:
        s = []
        while size:
            k, at, n = left.pop()
            take = min(n, size)
            s.append((k, at, take))
            if take < n:
                left.append((k, at + take, n - take))
            size -= take
        out.append(s)
    return out


_WORKER: dict[str, WordIds] = {}


def _tokenise(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORKER.get(path) or _WORKER.setdefault(path, WordIds(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[] for _ in range(7)]
                for doc_id, shard, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), words.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        whole = len(piece) == window
                        row = (shard, doc_id, at, len(piece), zlib.crc32(piece.tobytes()) if whole else None, len(ids), None if whole else piece.tobytes())
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["shard", "doc_id", "start", "length", "crc", "doc_tokens", "ids"])

    return run


def _lay_out(window: int, unit: int, depth: int):
    def run(table: pa.Table) -> pa.Table:
        order = [("start", "ascending"), ("doc_id", "ascending"), ("length", "ascending")]
        table = table.sort_by(order)
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "length", "crc", "doc_tokens", "ids")), strict=True))
        base = table.column("shard")[0].as_py() << 32
        out: list[tuple] = []
        whole = [r for r in rows if r[5] is None]
        parts = [r for r in rows if r[5] is not None]
        for doc_id, start, length, crc, tokens, _ in whole:
            out.append((doc_id, start, length, crc, tokens, base + len(out), 0))
        base += len(out)
        for s, sequence in enumerate(plan(np.array([r[2] for r in parts], int), window, unit, depth)):
            offset = 0
            for k, at, n in sequence:
                doc_id, start, _, _, tokens, ids = parts[k]
                out.append((doc_id, start + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), tokens, base + s, offset))
                offset += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    unit: int = UNIT,
    depth: int = DEPTH,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``; null and empty texts are the end id
    alone. Each id lies in exactly one piece, pieces of a sequence are gapless, and
    a sequence is either ``window`` long or a power of two long, so nothing is
    padded. Rows that repeat an identifier are packed each for itself (their pieces
    then share doc_id); a null identifier passes through. Other columns are
    ignored; an empty table gives no pieces. Sequence ids are unique, not dense.
    """
    if window % unit or window & (window - 1):
        raise ValueError("window must be a power of two and a multiple of unit")
    shards = max(1, -(-docs.count() // shard_docs))
    text = docs[text_col].cast("string")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        text.alias("text"),
        F.pmod(F.xxhash64(docs[id_col].cast("long"), F.length(text), F.substring(text, 1, 64), F.monotonically_increasing_id()), F.lit(shards)).alias("shard"),
    )
    pieces = rows.mapInArrow(_tokenise(tokenizer_path, window, end_id), "shard long, doc_id long, start long, length long, crc long, doc_tokens long, ids binary")
    return pieces.groupBy("shard").applyInArrow(_lay_out(window, unit, depth), PIECES)
