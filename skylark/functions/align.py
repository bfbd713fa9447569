"""Character alignment, for which there is no Column expression: Arrow-batched kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str, whole: bool = True) -> float:
    """Share of characters that match within half the longer string, less half the transpositions; whole: an odd one of these doesn't count."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    if whole:
        swaps = int(swaps)
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def winkler(a: str, b: str, weight: float = 0.1, longest: int = 4, whole: bool = True) -> float:
    base, same = jaro(a, b, whole), 0
    for x, y in zip(a[:longest], b[:longest], strict=False):
        if x != y:
            break
        same += 1
    return base + same * weight * (1 - base)


#: Pairs of the same two lengths from which on they are aligned together.
TOGETHER = 16


def _winkler_of(a: list[str], b: list[str], weight: float = 0.1, longest: int = 4, whole: bool = True) -> np.ndarray:
    """winkler of pairs whose first texts are of one length, and whose second ones too; neither empty. The same steps, for all pairs at once."""
    x, y = (np.frombuffer("".join(c).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(c), -1) for c in (a, b))
    n, k = x.shape[1], y.shape[1]
    reach, columns = max(0, max(n, k) // 2 - 1), [np.ascontiguousarray(y[:, j]) for j in range(k)]
    left, taken = np.zeros((n, len(a)), bool), np.zeros((k, len(a)), bool)
    for i in range(n):
        c = np.ascontiguousarray(x[:, i])
        for j in range(max(0, i - reach), min(k, i + reach + 1)):
            new = (c == columns[j]) & ~taken[j] & ~left[i]
            left[i] |= new
            taken[j] |= new
    m, least = left.sum(axis=0), min(n, k)
    matched = lambda t, by: np.take_along_axis(t, np.argsort(~by.T, axis=1, kind="stable"), axis=1)[:, :least]
    swaps = ((matched(x, left) != matched(y, taken)) & (np.arange(least) < m[:, None])).sum(axis=1) / 2
    if whole:
        swaps = np.floor(swaps)
    some = np.maximum(m, 1)
    base = np.where(m > 0, (m / n + m / k + (m - swaps) / some) / 3, 0.0)
    if n == k:
        base[(x == y).all(axis=1)] = 1.0
    first = min(longest, n, k)
    same = np.cumprod(x[:, :first] == y[:, :first], axis=1).sum(axis=1)
    return base + same * weight * (1 - base)


def winklers(a: list[str | None], b: list[str | None], whole: bool = True) -> list[float | None]:
    """winkler of each pair; null if either is. Pairs are taken together by their lengths."""
    found: list[float | None] = [None] * len(a)
    lots: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is not None and y is not None:
            lots.setdefault((len(x), len(y)), []).append(i)
    for (n, k), at in lots.items():
        # Long texts one by one: all pairs' windows would be many.
        if n and k and len(at) >= TOGETHER and max(n, k) <= 64:
            scores = _winkler_of([a[i] for i in at], [b[i] for i in at], whole=whole).tolist()
        else:
            scores = [winkler(a[i], b[i], whole=whole) for i in at]
        for i, score in zip(at, scores, strict=True):
            found[i] = score
    return found


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity; null if either is."""
    return pd.Series(winklers(a.tolist(), b.tolist()), dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_exact(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity in which an odd transposition counts as half of one; null if either is."""
    return pd.Series(winklers(a.tolist(), b.tolist(), whole=False), dtype="float64")
