"""Jaro-Winkler similarity as a vectorised Python function: Spark has none."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    """Jaro similarity, raised for a common beginning of up to four characters."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    matched = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                matched.append(x)
                break
    if not matched:
        return 0.0
    other = [b[j] for j in range(len(b)) if taken[j]]
    m, swaps = len(matched), sum(x != y for x, y in zip(matched, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * prefix_weight * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler_similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


# Filters on the result must not run the function again.
jaro_winkler_similarity = jaro_winkler_similarity.asNondeterministic()
