"""Fill-in-middle transformation: whole texts cut at ends of units and dealt anew around three sentinels.

One Arrow-batched pandas UDF: ``regex`` finds the units and their ends go into one
compact array; the two cuts are two lookups there and three slices of the text.
``hashlib`` gives the draws, which depend on nothing but the seed and the
identifier, and the digests of the output and of the text rebuilt from it. The UDF
is narrow: nothing is shuffled, and a lost task repeats with the same draws.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines with their ends.
UNIT = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Per cent of the texts that are transformed, and of those the part in suffix-first order.
RATE, SUFFIX_FIRST = 100, 50
_SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def draws(seed: int, name: str) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of a document."""
    hashed = hashlib.sha256(f"{seed}:{name}".encode()).digest()
    return tuple(int.from_bytes(hashed[k : k + 4], "big") for k in (0, 4, 8, 12))


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where the units end, in code points."""
    return array("q", (found.end() for found in unit.finditer(text)))


def cut_points(ends: array, first: int, second: int) -> tuple[int, int]:
    """Ends of the prefix and of the middle, for two draws."""
    low, high = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    return (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)


def dealt(text: str, form: str, lo: int, hi: int, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    p, s, m = sentinels
    if form == "psm":
        return "".join((p, text[:lo], s, text[hi:], m, text[lo:hi]))
    if form == "spm":
        return "".join((s, text[hi:], p, text[:lo], m, text[lo:hi]))
    return text


def restored(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The exact text behind an output.

    No sentinel overlaps itself or another at its ends (checked by :func:`fill_in_middle`),
    so the first place of each is the one that was put there.
    """
    p, s, m = sentinels
    if form == "plain":
        return output
    one, two = (p, s) if form == "psm" else (s, p)
    b = output.index(two, len(one))
    c = output.index(m, b + len(two))
    first, second, middle = output[len(one) : b], output[b + len(two) : c], output[c + len(m) :]
    return first + middle + second if form == "psm" else second + middle + first


def _check(sentinels: tuple[str, str, str]) -> None:
    overlap = any(a[-k:] == b[:k] for a in sentinels for b in sentinels for k in range(1, min(len(a), len(b))))
    inside = any(a in b for k, a in enumerate(sentinels) for n, b in enumerate(sentinels) if k != n)
    if len(sentinels) != 3 or overlap or inside:
        raise ValueError("three sentinels are needed, none of which overlaps another or itself")


def transformer(unit: str, seed: int, rate: int, suffix_first: int, sentinels: tuple[str, str, str]):
    """The pandas UDF of (name, text) columns."""

    def whole(names: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(unit)
        rows = []
        for name, text in zip(names, texts, strict=True):
            h1, h2, h3, h4 = draws(seed, name)
            ends = unit_ends(text, pattern)
            form, lo, hi = "plain", None, None
            if text and h3 % 100 < rate and not any(x in text for x in sentinels):
                form = "spm" if h4 % 100 < suffix_first else "psm"
                lo, hi = cut_points(ends, h1, h2)
            output = text if form == "plain" else dealt(text, form, lo, hi, sentinels)
            back = restored(output, form, sentinels)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (output, back)]
            rows.append((len(ends), form, lo, None if lo is None else hi - lo, output, *digests))
        made = pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])
        return made.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return F.pandas_udf(whole, _SCHEMA)


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = UNIT,
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    n is the number of units, form is plain, psm or spm; the two lengths are code points
    and null where the form is plain. Plain stay empty texts, texts that hold a sentinel
    and those that ``rate`` leaves alone. A null text counts as empty, a null identifier
    as an empty name (all such rows share their draws). Rows that repeat an identifier
    are each transformed, with equal draws. Texts of any length are cut whole; a text in
    which the unit finds nothing is all suffix. Other columns of ``docs`` are ignored,
    whatever their names. An empty table gives no rows.
    """
    _check(sentinels)
    name = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    made = docs.select(docs[id_col].alias("doc_id"), transformer(unit, seed, rate, suffix_first, sentinels)(name, text).alias("m"))
    return made.select("doc_id", "m.*")


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """Column of the texts behind outputs; null where the output or form is null."""
    _check(sentinels)

    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restored(o, f, sentinels) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return F.pandas_udf(back, "string")(output, form)
