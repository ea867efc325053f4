"""Longest shared substring of two texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shipping

SHORTEST = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _window_hashes(codes: np.ndarray, k: int, prefix: np.ndarray, powers: np.ndarray) -> np.ndarray:
    n = len(codes)
    return (prefix[k : n + 1] - prefix[: n - k + 1]) * powers[len(powers) - 1 - np.arange(n - k + 1)]


def shared_length(a: str, b: str) -> int:
    """Length of the longest common substring, 0 below five characters.

    Binary search on the length with rolling hashes, each hit confirmed on the
    text: O(n log n) for whole texts of any length.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(a) < SHORTEST:
        return 0
    if a in b:
        return len(a)
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(y) + 1, _BASE, np.uint64)]), dtype=np.uint64)
    zero = np.zeros(1, np.uint64)
    px = np.concatenate([zero, np.cumsum(x * powers[: len(x)], dtype=np.uint64)])
    py = np.concatenate([zero, np.cumsum(y * powers[: len(y)], dtype=np.uint64)])

    def shared(k: int) -> bool:
        hx = _window_hashes(x, k, px, powers)
        hy = _window_hashes(y, k, py, powers)
        starts = np.flatnonzero(np.isin(hx, hy))
        return any(a[i : i + k] in b for i in starts.tolist())

    low, high = SHORTEST - 1, len(a) - 1
    while low < high:
        mid = (low + high + 1) // 2
        if shared(mid):
            low = mid
        else:
            high = mid - 1
    return low if low >= SHORTEST else 0


@F.pandas_udf(T.LongType())
def shared_length_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    out = [
        None if x is None or y is None else shared_length(x, y)
        for x, y in zip(a.where(a.notna(), None), b.where(b.notna(), None))
    ]
    return pd.Series(out, dtype="Int64")


shipping.by_value(__name__)
