"""Similarity of titles: the share of text in common blocks, found as the longest common block and what is left and right of it."""

import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col, normal_title


def plain(s: str) -> str:
    return " ".join(re.sub(r"[^\w]+", " ", s.casefold()).split())


def ratio(a: str | None, b: str | None) -> float:
    """In [0, 1]; 0 if either is null or empty. The order of the arguments counts."""
    if not a or not b:
        return 0.0
    x, y = plain(a), plain(b)
    return SequenceMatcher(None, x, y).ratio()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)])


def may_reach(a: Column | str, b: Column | str, least: float) -> Column:
    """Whether the lengths allow a similarity: a bound from above, evaluated before any Python runs."""
    m, n = F.length(normal_title(a)), F.length(normal_title(b))
    return (m + n > 0) & (2 * F.least(m, n) >= F.lit(least) * (m + n)) & col(a).isNotNull() & col(b).isNotNull()


#: Letter pairs are counted in so many classes, and so many titles are compared with all others at once.
CLASSES, ROWS = 512, 256


def may_match(a: list[str], b: list[str], least: float) -> Iterator[np.ndarray]:
    """For each title of ``a`` the places in ``b`` of all that could reach a similarity, and of few others.

    A similarity of ``least`` leaves M >= least (m + n) / 2 letters of both in common order. Each of the m - M letters
    that are left out takes at most two neighbouring pairs of letters away, and each of the n - M put in at most one: of
    the different pairs of ``a`` at most 2 (m - M) + (n - M) are missing in ``b``, and the other way round. This also
    holds for classes of pairs.
    """

    def read(titles: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, size = np.zeros((len(titles), CLASSES), np.float32), np.zeros(len(titles), np.float32)
        for i, t in enumerate(map(plain, titles)):
            known[i, [zlib.crc32(t[k : k + 2].encode("utf-8", "surrogatepass")) % CLASSES for k in range(len(t) - 1)]] = 1
            size[i] = len(t)
        return known, size, known.sum(axis=1)

    (x, m, p), (y, n, q) = read(a), read(b)
    for at in range(0, len(a), ROWS):
        both, mm, pp = x[at : at + ROWS] @ y.T, m[at : at + ROWS, None], p[at : at + ROWS, None]
        total = mm + n
        kept = 1.5 * least * total
        ok = (2 * np.minimum(mm, n) >= least * total - 1e-3) & (mm > 0) & (n > 0)
        ok &= (both >= pp - 2 * mm - n + kept - 1e-2) & (both >= q - 2 * n - mm + kept - 1e-2)
        yield from map(np.flatnonzero, ok)
