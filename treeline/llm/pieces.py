"""Byte-fallback BPE pieces: encoding by a merge-type prefix table, and decoding.

For every prefix of a word the table stores the last token of that prefix's one
valid encoding. Candidates are the vocabulary entries that end there, found by an
Aho-Corasick automaton; the valid one is compatible with the last token of the
prefix before it, meaning that no merge would cross the boundary between the two.
Ids are then read backwards. All words of a batch advance together in numpy.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Cached segments of a Python worker, the longest that is cached, and how many are encoded together.
CACHE_SEGMENTS, CACHE_CHARS, TOGETHER = 300_000, 48, 20_000
#: Remembered compatibility tests: two to this power.
TESTED_BITS = 21
_SEGMENT = re.compile(r" *[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[.,;:!? \n]|\Z)| *[^ \n]+|\n| +")
_NEVER = np.iinfo(np.int64).max


class PieceCodec:
    """Encoder and decoder for the BPE model file at ``path``."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only models without normalisation, with a dummy prefix and byte fallback, are supported")
        kind = pb.ModelProto.SentencePiece
        self.pieces = [p.piece for p in model.pieces]
        self.size = len(self.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.byte = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
        self.byte_ids = {int(i): b for b, i in enumerate(self.byte)}
        self.end = next((i for i, p in enumerate(model.pieces) if p.piece == "</s>"), 2)
        self.control = {i for i, p in enumerate(model.pieces) if p.type in (kind.CONTROL, kind.UNKNOWN)}
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces that go on after a space or a line end are not supported")
        if any(a.isalpha() and b in ".,;:!?" for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("pieces with punctuation after a letter are not supported")
        self._ranks(model, normal)
        self._automaton({p: i for p, i in normal.items() if self.reachable[i]})
        self.tested_keys = np.full(1 << TESTED_BITS, -1, np.int64)
        self.tested = np.zeros(1 << TESTED_BITS, bool)
        self.known: dict[str, tuple[int, str, str]] = _Known()
        self.written = [str(i) for i in range(self.size)]
        self.spoken = [p.replace(SPACE, " ") for p in self.pieces]
        self.last_byte = max([*self.byte_ids, *self.control])  # ids above it stand for their own text

    def _ranks(self, model, normal: dict[str, int]) -> None:
        """How each piece is merged: its last two parts, and its boundary chains from single characters up."""
        score = [p.score for p in model.pieces]
        order = sorted(normal.values(), key=lambda i: (-score[i], i))
        self.rank = np.full(self.size, _NEVER)
        for r, i in enumerate(order):
            self.rank[i] = r
        left, right = np.full(self.size, -1), np.full(self.size, -1)
        self.reachable = np.zeros(self.size, bool)
        pairs: dict[tuple[int, int], int] = {}
        for p, i in normal.items():
            for at in range(1, len(p)):
                a, b = normal.get(p[:at]), normal.get(p[at:])
                if a is not None and b is not None:
                    pairs[a, b] = i
            if len(p) == 1:
                self.reachable[i] = True
        for p, i in normal.items():
            if len(p) > 1:
                made = self._merge(p, normal)
                if len(made) == 1:
                    self.reachable[i] = True
                    left[i], right[i] = made[0][1]
        keys = np.array([a * self.size + b for a, b in pairs], np.int64)
        self.pair_keys = np.sort(keys)
        self.pair_rank = self.rank[np.array(list(pairs.values()), np.int64)][np.argsort(keys)]
        self.left, self.right = left, right
        # chain[i]: (nodes from the outermost single character up to i, the rank at which each is merged away)
        self.right_chain, self.left_chain = self._chains(right), self._chains(left)

    def _merge(self, text: str, normal: dict[str, int]) -> list[tuple[str, tuple[int, int] | None]]:
        """Plain merging of one piece's own characters, best rank and then leftmost first."""
        parts: list[tuple[str, tuple[int, int] | None]] = [(c, None) for c in text]
        while True:
            best = min(((self.rank[normal[a[0] + b[0]]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a[0] + b[0] in normal), default=None)
            if best is None:
                return parts
            k = best[1]
            a, b = parts[k][0], parts[k + 1][0]
            parts[k : k + 2] = [(a + b, (normal.get(a, -1), normal.get(b, -1)))]

    def _chains(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chains = []
        for i in range(self.size):
            chain = [i]
            while part[chain[-1]] >= 0:
                chain.append(int(part[chain[-1]]))
            chains.append(chain[::-1])
        most = max(map(len, chains)) + 1
        nodes, gone = np.full((self.size, most), -1), np.full((self.size, most), _NEVER)
        for i, chain in enumerate(chains):
            nodes[i, : len(chain)] = chain
            gone[i, : len(chain) - 1] = self.rank[chain[1:]]
        return nodes, gone

    def _automaton(self, normal: dict[str, int]) -> None:
        """Aho-Corasick over the pieces of several characters, as a dense table that all words step through together."""
        many = sorted(p for p in normal if len(p) > 1)
        letters = sorted({c for p in many for c in p})
        code = {c: k + 1 for k, c in enumerate(letters)}
        self.char_class = np.zeros(0x110000, np.int32)
        self.char_class[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.single = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        levels: list[list[tuple[int, int, int]]] = []  # (parent, class, node) by depth
        node = {"": 0}
        for depth in range(1, max(map(len, many), default=0) + 1):
            level = []
            for p in many:
                if len(p) >= depth and p[:depth] not in node:
                    node[p[:depth]] = len(node)
                    level.append((node[p[: depth - 1]], code[p[depth - 1]], node[p[:depth]]))
            levels.append(level)
        self.classes = len(letters) + 1
        step = np.zeros((len(node), self.classes), np.int32)
        fail = np.zeros(len(node), np.int64)
        own = np.full(len(node), -1, np.int64)
        for p in many:
            own[node[p]] = normal[p]
        first, after = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        for depth, level in enumerate(levels):
            parent, c, made = np.array(level, np.int64).reshape(-1, 3).T
            if depth:
                fail[made] = step[fail[parent], c]
            step[parent, c] = made
            step[made] = step[fail[made]]  # a suffix is shallower, so all its children are in place
            after[made] = first[fail[made]]
            first[made] = np.where(own[made] >= 0, made, after[made])
        self.step, self.first, self.after, self.own = step.ravel(), first, after, own

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token ``b`` may follow token ``a``: the outer parts grow in merge order and no merge crosses."""
        keys = a.astype(np.int64) * self.size + b
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TESTED_BITS)).astype(np.int64)
        out = self.tested[slot]
        new = np.flatnonzero(self.tested_keys[slot] != keys)
        if len(new):
            out[new] = self._test(a[new], b[new])
            self.tested[slot[new]] = out[new]
            self.tested_keys[slot[new]] = keys[new]
            clash = new[self.tested_keys[slot[new]] != keys[new]]  # another pair took the slot: its flag must be its own
            if len(clash):
                self.tested_keys[slot[clash]] = -1
        return out

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        on = np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(on):
            x, y = a[on], b[on]
            r, l = self.right_chain[0][x, i[on]], self.left_chain[0][y, j[on]]
            r_gone, l_gone = self.right_chain[1][x, i[on]], self.left_chain[1][y, j[on]]
            key = r * self.size + l
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            cross = np.where(self.pair_keys[at] == key, self.pair_rank[at], _NEVER)
            # of equal ranks the leftmost merge goes first
            bad = (cross < r_gone) & (cross <= l_gone) & (cross < _NEVER)
            ok[on[bad]] = False
            done = bad | ((r_gone == _NEVER) & (l_gone == _NEVER))
            first = r_gone <= l_gone
            i[on] += first
            j[on] += ~first
            on = on[~done]
        return ok

    def _encode_new(self, segments: list[str]) -> list[list[int]]:
        """Ids of distinct segments (spaces already replaced), all at once."""
        size = np.array([len(s) for s in segments], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        joined = "\n".join(segments)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds, singles = self.char_class[points], self.single[points]
        last = np.full(len(joined) + 1, -2, np.int64)  # last[k + 1]: last token of the prefix that ends with character k
        last[begin] = -3  # before a word nothing stands in the way; -1 is a character in bytes
        order = np.argsort(-size, kind="stable")
        longer = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        state = np.zeros(len(segments), np.int64)
        for k, rows in enumerate(longer.tolist()):
            at = begin[order[:rows]] + k
            state = self.step[state[:rows] * self.classes + kinds[at]].astype(np.int64)
            last[at + 1] = singles[at]
            node = self.first[state]
            on = np.flatnonzero(node)
            while len(on):
                token = self.own[node[on]]
                before = last[at[on] + 1 - self.length[token]]
                ok = before < 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.compatible(before[ask], token[ask])
                last[at[on[ok]] + 1] = token[ok]
                on = on[~ok]
                node[on] = self.after[node[on]]
                on = on[node[on] > 0]
        # backwards from the end of every word, one token each time
        cursor, on = begin + size, np.flatnonzero(size > 0)
        words, tokens, places = [], [], []
        while len(on):
            token = last[cursor[on]]
            words.append(on)
            tokens.append(token)
            places.append(cursor[on] - 1)
            cursor[on] -= np.where(token >= 0, self.length[np.maximum(token, 0)], 1)
            on = on[cursor[on] > begin[on]]
        if not words:
            return [[] for _ in segments]
        of, made, at = np.concatenate(words), np.concatenate(tokens), np.concatenate(places)
        order = np.argsort(at, kind="stable")
        of, made, at = of[order], made[order].tolist(), at[order]
        stop = np.searchsorted(of, np.arange(len(segments) + 1)).tolist()
        out = [made[a:b] for a, b in zip(stop, stop[1:], strict=False)]
        for w in np.unique(of[np.array(made) < 0]).tolist():
            own = zip(out[w], at[stop[w] : stop[w + 1]].tolist(), strict=True)
            out[w] = [i for t, k in own for i in ([t] if t >= 0 else self.byte[list(joined[k].encode())].tolist())]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, bytes as UTF-8, control ids nothing, the dummy prefix dropped."""
        return self._text(ids, True)

    def _text(self, ids: list[int], strip: bool) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_ids:
                raw.append(self.byte_ids[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i not in self.control:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if strip and text.startswith(" ") else text

    def segments(self, text: str) -> list[str]:
        """Parts of a text that no piece can straddle."""
        if not text:
            return []
        return _SEGMENT.findall(" " + text.replace(SPACE, " "))

    def _learn(self, new: list[str], into: dict) -> None:
        for lo in range(0, len(new), TOGETHER):
            part = new[lo : lo + TOGETHER]
            # line ends separate the words inside, and are themselves always a byte
            plain = [s for s in part if s != "\n"]
            for s, ids in zip(plain, self._encode_new([s.replace(" ", SPACE) for s in plain]), strict=True):
                text = "".join([self.spoken[i] for i in ids]) if min(ids) > self.last_byte else self._text(ids, False)
                into[s] = (len(ids), " ".join([self.written[i] for i in ids]), s if text == s else text)
            if len(plain) < len(part):
                into["\n"] = (1, str(int(self.byte[10])), "\n")

    def rows(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids with the end id, ids joined by a space, decoded text) of whole texts."""
        split = [self.segments(t) for t in texts]
        extra: dict[str, tuple[int, str, str]] = {}
        self._learn(sorted(set(chain.from_iterable(split)).difference(self.known)), extra)
        room = max(0, CACHE_SEGMENTS - len(self.known))
        if room and extra:
            self.known.update((s, extra[s]) for s in sorted(extra, key=len)[:room] if len(s) <= CACHE_CHARS)
        self.known.rest = extra
        out = []
        for parts in split:
            counts, ids, said = zip(*map(self.known.__getitem__, parts), strict=True) if parts else ((), (), ())
            text = "".join(said)
            out.append((sum(counts) + 1, " ".join([*ids, self.written[self.end]]), text[1:] if text.startswith(" ") else text))
        return out


class _Known(dict):
    """The cache, and for what it lacks the segments of the current batch."""

    rest: dict

    def __missing__(self, key):
        return self.rest[key]


_WORKER: dict[str, PieceCodec] = {}


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, decoded. The end id closes the ids; there is no begin id.

    Null and empty texts give the end id alone and decode to an empty text. Whole
    texts are encoded, however long. Identifiers pass through, null or repeated;
    other columns are ignored; an empty table gives no rows.
    """
    return _mapped(docs, model_path, id_col, text_col, False)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_pieces`, with SHA-256 of ids and decoded text in their place."""
    return _mapped(docs, model_path, id_col, text_col, True)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _WORKER.get(path) or _WORKER.setdefault(path, PieceCodec(path))
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = codec.rows([t or "" for t in part.column(1).to_pylist()])
                if digest:
                    second, third = [sha(r[1]) for r in rows], [sha(r[2]) for r in rows]
                else:
                    second, third = [[int(i) for i in r[1].split()] for r in rows], [r[2] for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(second, pa.string() if digest else pa.list_(pa.int32())), pa.array(third, pa.string())], names)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = "string" if digest else "array<int>"
    return rows.mapInArrow(run, f"doc_id long, n_tokens long, {names[2]} {kind}, {names[3]} string")
