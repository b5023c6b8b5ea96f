"""Rounding as printed reports do it, and the p-value of a rank correlation."""

from __future__ import annotations

import sys
from math import erfc, lgamma, pi, sqrt

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Send the code of this module with the task, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def round_scaled(x: str, digits: int) -> Column:
    """Scale, round half to even, scale back: how array libraries round. ``x`` is an expression."""
    scale = f"{10 ** digits}.0D"
    return F.expr(f"rint(({x}) * {scale}) / {scale} + 0.0D")


def round_exact(x: str, digits: int) -> Column:
    """Correct rounding of the stored binary value, half to even. ``x`` is an expression.

    0.9195 is stored slightly below the tie and gives 0.919; ``round`` would give 0.920. The
    rounding error of the scaled product decides on which side of a tie the value lies; it is
    computed with the usual splitting of both factors into halves (Dekker 1971).
    """
    scale = float(10 ** digits)
    splitter = 134217729.0  # 2^27 + 1
    scale_hi = splitter * scale - (splitter * scale - scale)
    scale_lo = scale - scale_hi
    number = lambda v: f"{v!r}D"
    product = f"(({x}) * {number(scale)})"
    big = f"(({x}) * {number(splitter)})"
    hi = f"({big} - ({big} - ({x})))"
    lo = f"(({x}) - {hi})"
    error = (f"((({hi} * {number(scale_hi)} - {product}) + {hi} * {number(scale_lo)} "
             f"+ {lo} * {number(scale_hi)}) + {lo} * {number(scale_lo)})")
    whole = f"CAST(floor({product}) AS DOUBLE)"
    above = f"({product} - {whole} - 0.5D)"
    rounded = (f"CASE WHEN {above} > 0 OR ({above} = 0 AND {error} > 0) THEN {whole} + 1 "
               f"WHEN {above} < 0 OR {error} < 0 THEN {whole} ELSE rint({product}) END")
    return F.expr(f"({rounded}) / {number(scale)} + 0.0D")


def _t_tail_fraction(df: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(df/2, 1/2) by the modified Lentz continued fraction."""
    a = df / 2.0
    log_beta = np.array([lgamma(v) + lgamma(0.5) - lgamma(v + 0.5) for v in a])
    flip = x > (a + 1.0) / (a + 2.5)
    p, q = np.where(flip, 0.5, a), np.where(flip, a, 0.5)
    z = np.where(flip, 1.0 - x, x)
    nonzero = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + 0.5 * np.log1p(-x) - log_beta) / p
        c = np.ones_like(z)
        d = 1.0 / nonzero(1.0 - (p + q) * z / (p + 1.0))
        fraction = d
        for m in range(1, 3000):
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            for term in (even, odd):
                d = 1.0 / nonzero(1.0 + term * d)
                c = nonzero(1.0 + term / c)
                fraction = fraction * d * c
            if np.all(np.abs(d * c - 1.0) < 1e-15):
                break
        value = np.where(flip, 1.0 - front * fraction, front * fraction)
        value = np.where(np.abs(d * c - 1.0) < 1e-9, value, np.nan)  # the fraction has not settled
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, value))


def _t_tail_normal(df: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Normal tail with its first-order correction, for very many degrees of freedom."""
    t = np.minimum(np.abs(t), 40.0)
    tail = np.array([erfc(v / sqrt(2.0)) for v in t])
    density = np.exp(-t * t / 2.0) / sqrt(2.0 * pi)
    return tail + density * (t ** 3 + t) / (2.0 * df)


@F.pandas_udf(DoubleType())
def spearman_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation over ``n`` pairs (t test, n - 2 degrees of freedom)."""
    r = rho.to_numpy(dtype=float, na_value=np.nan)
    df = n.to_numpy(dtype=float, na_value=np.nan) - 2.0
    out = np.full(len(r), np.nan)
    small = ~np.isnan(r) & (df > 0) & (df <= 1e6)
    large = ~np.isnan(r) & (df > 1e6)
    rest = np.clip(1.0 - r ** 2, 0.0, 1.0)  # df / (df + t^2)
    if small.any():
        out[small] = _t_tail_fraction(df[small], rest[small])
    if large.any():
        with np.errstate(divide="ignore"):
            t = r[large] * np.sqrt(df[large] / rest[large])
        out[large] = _t_tail_normal(df[large], t)
    return pd.Series(out).astype("Float64").mask(np.isnan(out))
