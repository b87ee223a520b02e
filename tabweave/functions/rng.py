"""A counter-based random generator and the normal distribution, as Column expressions.

A draw depends on (seed, row, draw) and nothing else: not on partitioning, order or retries.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, row: Column, draw: int | str | Column) -> Column:
    """In [0, 1): the first 8 hex digits of md5('seed|row|draw') over 2^32."""
    d = draw if isinstance(draw, Column) else F.lit(str(draw))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), row.cast("string"), d.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def gaussian(seed: int, row: Column, draw: int | str) -> Column:
    """Standard normal by Box-Muller from two draws."""
    u = F.greatest(uniform(seed, row, f"{draw}a"), F.lit(1e-12))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * uniform(seed, row, f"{draw}b"))


def _horner(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


# Coefficients of the approximation 26.2.17 of the normal distribution function in Abramowitz and Stegun, Handbook of
# Mathematical Functions (1964), to the seven digits in which the results to be matched use them.
_TAIL = [0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274]


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + 0.2316419 * F.abs(x))
    p = 0.3989422804014327 * F.exp(-x * x / 2) * t * _horner(t, _TAIL[::-1])
    return F.when(x >= 0, 1 - p).otherwise(p)


# Coefficients of Acklam's approximation of the inverse normal distribution function.
_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
_LOW = 0.02425


def probit(p: Column) -> Column:
    """The inverse of the normal distribution function; null outside (0, 1)."""
    tail = lambda q: _horner(q, _C) / _horner(q, _D)
    r = (p - 0.5) * (p - 0.5)
    middle = _horner(r, _A) * (p - 0.5) / _horner(r, _B)
    low = tail(F.sqrt(-2 * F.log(p)))
    high = -tail(F.sqrt(-2 * F.log(1 - p)))
    return F.when((p > 0) & (p < _LOW), low).when((p >= _LOW) & (p <= 1 - _LOW), middle).when((p > 1 - _LOW) & (p < 1), high)


def probit_array(p: np.ndarray) -> np.ndarray:
    """probit() of an array; NaN outside (0, 1)."""
    with np.errstate(all="ignore"):
        r = (p - 0.5) ** 2
        middle = np.polyval(_A, r) * (p - 0.5) / np.polyval(_B, r)
        tail = lambda q: np.polyval(_C, q) / np.polyval(_D, q)
        low, high = tail(np.sqrt(-2 * np.log(p))), -tail(np.sqrt(-2 * np.log(1 - p)))
        out = np.where(p < _LOW, low, np.where(p > 1 - _LOW, high, middle))
    return np.where((p > 0) & (p < 1), out, np.nan)
