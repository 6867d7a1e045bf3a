"""Tail probabilities of the normal, chi-square, Student t and fair-coin binomial laws.

These run on report rows that are already aggregated (one row per variable, pair or
model), as Arrow batches. Series and continued fractions are the textbook ones
(Abramowitz & Stegun 1964, chapters 6 and 26).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

#: A series ends when a step changes less than this; one that doesn't end within MOST_STEPS gives NaN.
SMALLEST_STEP, MOST_STEPS = 1e-15, 100_000

def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if math.isnan(x) or math.isnan(a):
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * SMALLEST_STEP:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, MOST_STEPS):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = c * d
        h *= step
        if abs(step - 1) < SMALLEST_STEP:
            return h * scale
    return math.nan


def _beta_i(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_i(1 - x, b, a)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, MOST_STEPS):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            step = c * d
            h *= step
        if abs(step - 1) < SMALLEST_STEP:
            return math.exp(log_front) * h / a
    return math.nan


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _t_two_sided(t: float, dof: float) -> float:
    if math.isnan(t) or math.isnan(dof):
        return math.nan
    return _beta_i(dof / (dof + t * t), dof / 2, 0.5)


def _coin_two_sided(k: float, n: float) -> float:
    """Exact two-sided binomial test of k successes in n fair tosses."""
    k, n = int(k), int(n)
    low = min(k, n - k)
    tail = sum(math.comb(n, i) for i in range(low + 1))
    return min(1.0, 2 * tail / 2**n)


def _batched(fn, *columns: pd.Series) -> pd.Series:
    arrays = [pd.to_numeric(c).to_numpy(dtype=float, na_value=np.nan) for c in columns]
    return pd.Series([math.nan if any(math.isnan(v) for v in row) else fn(*row) for row in zip(*arrays)],
                     dtype=float)


@F.pandas_udf(DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return _batched(_normal_two_sided, z)


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _batched(lambda v, k: _gamma_q(k / 2, v / 2), x, dof)


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _batched(_t_two_sided, t, dof)


@F.pandas_udf(DoubleType())
def _coin_p(k: pd.Series, n: pd.Series) -> pd.Series:
    return _batched(_coin_two_sided, k, n)


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def normal_p(z: Column | str) -> Column:
    """Two-sided normal p value."""
    return F.nanvl(_normal_p(_double(z)), F.lit(None).cast("double"))


def chi2_p(x: Column | str, dof: Column | str) -> Column:
    """Upper chi-square tail."""
    return F.nanvl(_chi2_p(_double(x), _double(dof)), F.lit(None).cast("double"))


def t_p(t: Column | str, dof: Column | str) -> Column:
    """Two-sided Student t p value."""
    return F.nanvl(_t_p(_double(t), _double(dof)), F.lit(None).cast("double"))


def coin_p(k: Column | str, n: Column | str) -> Column:
    """Exact two-sided binomial p value for probability one half."""
    return F.nanvl(_coin_p(_double(k), _double(n)), F.lit(None).cast("double"))
