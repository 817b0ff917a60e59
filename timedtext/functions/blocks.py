"""Similarity of two texts by their matching blocks: the longest common block, then the longest ones on both sides of it, and so on.

In a second text of 200 characters or more, characters that make up over a hundredth of it begin no block; they only extend one. All equal
pairs of the other characters are put together to diagonal runs once; a part of the texts then looks at the runs that
reach into it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this length of the second text, characters with more than 1 + a hundredth of it begin no block.
_LONG, _SHARE = 200, 100


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in both texts and lengths of all maximal diagonal runs of equal characters that can begin a block."""
    chars, at, n = np.unique(b, return_inverse=True, return_counts=True)
    rare = n <= (len(b) // _SHARE + 1 if len(b) >= _LONG else len(b))
    places = np.argsort(at, kind="stable")
    first = np.cumsum(n) - n
    own = np.minimum(np.searchsorted(chars, a), len(chars) - 1)
    i = np.flatnonzero((chars[own] == a) & rare[own])
    times = n[own[i]]
    left = np.repeat(i, times)
    right = places[np.repeat(first[own[i]], times) + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)]
    order = np.lexsort((left, right - left))
    left, right = left[order], right[order]
    starts = np.flatnonzero(np.r_[True, (np.diff(left) != 1) | (np.diff(right) != 1)]) if len(left) else np.zeros(0, int)
    return left[starts], right[starts], np.diff(np.r_[starts, len(left)])


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def block_ratio(first: str, second: str) -> float:
    """Twice the characters in matching blocks over the characters of both texts; 1 for two empty texts."""
    a, b = _codes(first), _codes(second)
    if not len(a) or not len(b):
        return 0.0 if len(a) + len(b) else 1.0
    matched, open_ = 0, [(0, len(a), 0, len(b), *_runs(a, b))]
    while open_:
        alo, ahi, blo, bhi, i, j, n = open_.pop()
        skip = np.maximum(0, np.maximum(alo - i, blo - j))
        n = np.minimum(n, np.minimum(ahi - i, bhi - j)) - skip
        some = n > 0
        i, j, n = (i + skip)[some], (j + skip)[some], n[some]
        x, y, k = alo, blo, 0
        if len(n):
            k = int(n.max())
            top = np.flatnonzero(n == k)
            best = top[np.lexsort((j[top], i[top]))[0]]
            x, y = int(i[best]), int(j[best])
            back = _alike(a[alo:x][::-1], b[blo:y][::-1])
            x, y, k = x - back, y - back, k + back
        k += _alike(a[x + k : ahi], b[y + k : bhi])
        if k:
            matched += k
            if x > alo and y > blo:
                before = (i < x) & (j < y)
                open_.append((alo, x, blo, y, i[before], j[before], n[before]))
            if x + k < ahi and y + k < bhi:
                after = (i + n > x + k) & (j + n > y + k)
                open_.append((x + k, ahi, y + k, bhi, i[after], j[after], n[after]))
    return 2.0 * matched / (len(a) + len(b))


def matching_ratio(first: str | Column, second: str | Column) -> Column:
    """``block_ratio`` of two columns, in Arrow batches; null if one is null. Work follows the pairs of equal rare characters."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else block_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return ratio(first, second)
