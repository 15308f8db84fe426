"""Text rules without a built-in expression, as Arrow-batched pandas functions. Use them after blocking only."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


def _codes(texts: list[str], pad: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts), default=0)), pad, np.int32)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return out


def common_length(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair: one step for a character of the left texts, over all pairs at once."""
    left, right = _codes(a, -1), _codes(b, -2)
    row = np.zeros((len(a), right.shape[1] + 1), np.int32)
    for i in range(left.shape[1]):
        step = row[:, :-1] + (right == left[:, i : i + 1])
        row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], step), axis=1)
    return row[:, -1]


@pandas_udf(DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two texts that is common in order, 0 to 1, as they are or with their words sorted, whichever is more; 0 for empty ones, null if either is null."""
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    x, y = a[known].tolist(), b[known].tolist()
    words = lambda texts: [" ".join(sorted(t.split())) for t in texts]
    best = np.zeros(len(x))
    for p, q in ((x, y), (words(x), words(y))):
        size = np.array([len(s) + len(t) if s and t else 0 for s, t in zip(p, q, strict=True)])
        best = np.maximum(best, np.divide(2.0 * common_length(p, q), size, out=np.zeros(len(p)), where=size > 0))
    out[known] = best
    return pd.Series(out).where(known)


@pandas_udf(StringType())
def dashed(text: pd.Series) -> pd.Series:
    """Plain ASCII letters and digits in lower case, all else one dash."""
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        return re.sub(r"[^a-z0-9]+", "-", plain.lower()).strip("-")

    return text.map(one)
