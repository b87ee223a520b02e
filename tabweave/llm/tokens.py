"""Word and punctuation tokens: the matches of `\\w+|[^\\w\\s]+` with Unicode classes, found by table lookup.

Each code point has a class (space, word, other) and a token is a longest run of one class other than space, so tokens
are where the class changes. That takes a few array operations a text instead of one regex match a token.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, 2, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() or c == "_":
            table[i] = 1
        elif c.isspace():
            table[i] = 0
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def token_starts(points: np.ndarray) -> np.ndarray:
    """Offsets in code points at which tokens begin."""
    kind = _classes()[points]
    new = kind != 0
    new[1:] &= kind[1:] != kind[:-1]
    return np.flatnonzero(new)


def count(text: str | None) -> int:
    if not text:
        return 0
    kind = _classes()[code_points(text)]
    return int(np.count_nonzero((kind[1:] != kind[:-1]) & (kind[1:] != 0))) + int(kind[0] != 0)


@F.pandas_udf(T.LongType())
def count_tokens(text: pd.Series) -> pd.Series:
    """Tokens of each text; 0 for a null or empty one."""
    return pd.Series([count(t) for t in text], dtype="int64")
