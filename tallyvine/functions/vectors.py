"""Vectors as arrays of numbers; sums are in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def usable(vector: Column) -> Column:
    """Not null or empty, all numbers finite, not all zero."""
    finite = F.forall(doubles(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & (norm(vector) > 0), F.lit(False))


def unit(vector: Column) -> Column:
    """Scaled to length one; a vector that isn't usable raises an error."""
    length = norm(vector)
    scaled = F.transform(doubles(vector), lambda x: x / length)
    return F.when(usable(vector), scaled).otherwise(F.raise_error(F.lit("vector is empty, zero or not finite")).cast("array<double>"))


#: Pairs of strings compared at a time, and the letters of the shorter one that a machine word holds.
PAIRS, WORD_BITS = 4096, 63


def indel_ratio(a: str, b: str) -> float:
    """200 x longest common subsequence / sum of lengths; 100 for two empty strings."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        kept = row & where.get(c, 0)
        row = ((row + kept) | (row - kept)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a row for each word, and lengths."""
    out = np.array(words, dtype=np.str_)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.ascontiguousarray(out).view(np.uint32).reshape(len(words), -1), lengths


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """indel_ratio of many pairs at once, of which one string has at most WORD_BITS letters: all pairs go through a letter of the other string together."""
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)), strict=True)
    (letters, n), (other, m) = _codes(short), _codes(long)
    bits = np.uint64(1) << np.arange(letters.shape[1], dtype=np.uint64)
    held = np.arange(letters.shape[1]) < n[:, None]
    full = (held * bits).sum(axis=1, dtype=np.uint64)
    row = full.copy()
    for j in range(other.shape[1]):
        same = ((letters == other[:, j : j + 1]) & held & (j < m)[:, None]) * bits
        kept = row & same.sum(axis=1, dtype=np.uint64)
        row = ((row + kept) | (row - kept)) & full
    common = n - np.bitwise_count(row)
    return np.where(n + m > 0, 200.0 * common / np.maximum(n + m, 1), 100.0)


def similarity_ratio(a: Column, b: Column) -> Column:
    """indel_ratio of each pair, many at a time; null counts as empty."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        left, right, out = x.fillna("").tolist(), y.fillna("").tolist(), np.empty(len(x))
        few = np.array([min(len(p), len(q)) <= WORD_BITS and max(len(p), len(q)) <= 8 * WORD_BITS for p, q in zip(left, right, strict=True)], bool)
        at = np.flatnonzero(few)
        for i in range(0, len(at), PAIRS):
            some = at[i : i + PAIRS]
            out[some] = indel_ratios([left[k] for k in some], [right[k] for k in some])
        for k in np.flatnonzero(~few):  # longer than a machine word
            out[k] = indel_ratio(left[k], right[k])
        return pd.Series(out, dtype=float)

    return F.pandas_udf(ratios, "double")(a, b)


def most_similar(a: Column, b: Column) -> Column:
    """No ratio of two strings of these lengths is larger."""
    return 200.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))
