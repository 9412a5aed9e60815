"""Distribution functions as column expressions, and one vectorised p-value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from specgrid.functions.quantile import let

#: Coefficients of Wichura's AS241 (PPND16) normal quantile: fixed values, numerators and denominators of its three ranges from the highest power down.
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
MIDDLE = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def ratio(x: Column, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    return polynomial(x, parts[0]) / polynomial(x, parts[1])


def qnorm(p: Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    def tail(p: Column, r: Column) -> Column:
        x = F.when(r <= 5, ratio(r - 1.6, MIDDLE)).otherwise(ratio(r - 5, FAR))
        return F.when(p < 0.5, -x).otherwise(x)

    def inside(p: Column) -> Column:
        inner = let(p - 0.5, lambda q: q * ratio(F.lit(0.180625) - q * q, CENTRE))
        return F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(F.abs(p - 0.5) <= 0.425, inner).otherwise(let(F.sqrt(-F.log(F.least(p, 1 - p))), lambda r: tail(p, r)))

    return let(p, inside)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 10."""
    x, shift = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    for _ in range(10):
        low = x < 10
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
        tiny = 1e-300
        c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, rounds):
            for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + t * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + t / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        value = np.where(x <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


def t_p_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t; NaN where t or df is missing or df is not positive."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    good = np.isfinite(df) & (df > 0) & ~np.isnan(t)
    safe = np.where(good, df, 1.0)
    with np.errstate(over="ignore", invalid="ignore"):
        p = incomplete_beta(safe / 2, np.full_like(safe, 0.5), np.where(np.isfinite(t), safe / (safe + t * t), 0.0))
    return np.where(good, p, np.nan)


def chi2_p_values(x: np.ndarray, df: int) -> np.ndarray:
    """Upper tail of chi-square for a whole number of degrees of freedom, by its finite recurrence."""
    x = np.maximum(np.asarray(x, float), 0)
    erfc = np.vectorize(__import__("math").erfc)
    if df % 2:
        q, term = erfc(np.sqrt(x / 2)), np.sqrt(2 * x / np.pi) * np.exp(-x / 2)
        for k in range(3, df + 1, 2):
            q = q + term
            term = term * x / k
        return q
    q, term = np.zeros_like(x), np.exp(-x / 2)
    for k in range(2, df + 1, 2):
        q = q + term
        term = term * x / k
    return q


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t, null where it isn't defined (Arrow batches)."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        got = t_p_values(t.to_numpy(float, na_value=np.nan), df.to_numpy(float, na_value=np.nan))
        return pd.Series(got).astype("Float64").mask(np.isnan(got))

    return p(t.cast("double"), df.cast("double"))
