"""Distribution functions. Spark has no error function, so normal tails are column series; the incomplete beta is a
small vectorised helper for rows that are already aggregated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from effortloom.functions.numbers import ColumnLike, as_col

SERIES_TERMS = 150
FRACTION_TERMS = 60

# Coefficients of Acklam's probit approximation, highest power first.
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02,
            -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01,
            -1.328068155288572e01, 1.0)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00,
            4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def norm_pdf(z: ColumnLike) -> Column:
    x = as_col(z).cast("double")
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_sf(z: ColumnLike) -> Column:
    """Upper tail of the standard normal: a power series near 0, a continued fraction in the tails."""
    x = as_col(z).cast("double")
    a = F.abs(x)
    # phi(a) * sum of a^(2k+1) / (1*3*...*(2k+1))
    steps = F.sequence(F.lit(1), F.lit(SERIES_TERMS))
    near = F.lit(0.5) - norm_pdf(a) * F.aggregate(
        steps,
        F.struct(a.alias("term"), a.alias("total")),
        lambda s, k: F.struct(
            (s["term"] * a * a / (2 * k + 1)).alias("term"),
            (s["total"] + s["term"] * a * a / (2 * k + 1)).alias("total"),
        ),
        lambda s: s["total"],
    )
    # phi(a) / (a + 1/(a + 2/(a + ...))), evaluated from the innermost level outwards
    levels = F.sequence(F.lit(FRACTION_TERMS), F.lit(1), F.lit(-1))
    far = norm_pdf(a) / F.aggregate(levels, a, lambda acc, k: a + k / acc)
    upper = F.when(a < 4, near).otherwise(far)
    return F.when(x < 0, 1 - upper).otherwise(upper)


def norm_cdf(z: ColumnLike) -> Column:
    return norm_sf(-as_col(z).cast("double"))


def norm_ppf(p: ColumnLike) -> Column:
    """Probit by the published rational approximation of Acklam; relative error below 1.2e-9."""
    q = as_col(p).cast("double")
    def poly(coefficients, x):
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out

    r = q - 0.5
    middle = poly(PROBIT_A, r * r) * r / poly(PROBIT_B, r * r)
    s = F.sqrt(-2 * F.log(F.least(q, 1 - q)))
    tail = poly(PROBIT_C, s) / poly(PROBIT_D, s)
    start = F.when((q > 0.02425) & (q < 1 - 0.02425), middle).when(q <= 0.5, tail).otherwise(-tail)
    return F.when((q > 0) & (q < 1), start)


def chi2_sf(statistic: ColumnLike, df: int) -> Column:
    """Upper tail of chi-square; a finite sum for whole degrees of freedom."""
    x = as_col(statistic).cast("double")
    if df % 2 == 0:
        term, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, df // 2):
            term = term * (x / 2) / i
            total = total + term
        return F.exp(-x / 2) * total
    root = F.sqrt(x)
    term, total = root, F.lit(0.0)
    for i in range(1, (df - 1) // 2 + 1):
        total = total + term
        term = term * x / (2 * i + 1)
    return 2 * norm_sf(root) + 2 * norm_pdf(root) * total


def _stirling_rest(z: np.ndarray) -> np.ndarray:
    """ln gamma(z) less its leading Stirling terms; it is small and smooth, so no digits are lost for large z."""
    exact = np.vectorize(lambda v: math.lgamma(v) - (v - 0.5) * math.log(v) + v - 0.5 * math.log(2 * math.pi), otypes=[float])
    inverse = 1 / z
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 * (1 / 1260 - inverse**2 / 1680)))
    return np.where(z < 20, exact(np.minimum(z, 20.0)), series)


def _log_power(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """ln of (x / x0)^a (y / (1 - x0))^b with y = 1 - x and x0 = a / (a + b): never positive, zero at x0."""
    n = a + b
    off = np.where(x < y, x * n - a, b - y * n)  # exact near x0, where the two logarithms nearly cancel
    with np.errstate(divide="ignore", invalid="ignore"):
        return a * np.log1p(off / a) + b * np.log1p(-off / b)


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b); ``y`` is 1 - x where that is known more exactly.

    Lentz's continued fraction, run until it stands still. It needs about the root of the parameters in steps where x is
    near the mean, so for two large parameters Temme's uniform expansion takes over, whose error falls with a + b.
    """
    a, b, x, y = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x, 1 - np.asarray(x) if y is None else y))
    out = np.where(x <= 0, 0.0, 1.0)
    inside = (x > 0) & (y > 0)
    large = inside & (np.minimum(a, b) > 1e5)
    out[large] = _beta_large(a[large], b[large], x[large], y[large])
    small = inside & ~large
    out[small] = _beta_small(a[small], b[small], x[small], y[small])
    return out


def _beta_large(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    n = a + b
    x0 = a / n
    gap = np.where(x < y, x * n - a, b - y * n) / n
    power = np.minimum(_log_power(a, b, x, y), 0.0)
    eta = np.sign(gap) * np.sqrt(-2 * power / n)
    erfc = np.vectorize(math.erfc, otypes=[float])
    root = np.sqrt(x0 * (1 - x0))
    # near the mean both terms of the correction are large and opposite: its limit there
    close = np.abs(eta) < 1e-5
    with np.errstate(divide="ignore", invalid="ignore"):
        first = np.where(close, (1 - 2 * x0) / (3 * root), 1 / eta - root / gap)
    value = 0.5 * erfc(-eta * np.sqrt(n / 2)) + np.exp(power) / np.sqrt(2 * math.pi * n) * first
    return np.clip(value, 0.0, 1.0)


def _beta_small(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    flip = x > (a + 1) / (a + b + 2)
    # with a far above b the fraction starts from a difference of nearly equal numbers; from the other end it does not
    flip = flip | ((a > 1e4 * b) & (y * (a + b) < 4 * (b + 1)))
    a, b, x, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, y, x), np.where(flip, x, y)
    n = a + b
    log_front = _log_power(a, b, x, y) + _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b)
    front = np.sqrt(a * b / (2 * math.pi * n)) * np.exp(log_front) / a
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1 / guard(1 - n * x / (a + 1))
    h = d
    m = 0
    moving = np.ones(x.shape, dtype=bool)
    while moving.any():
        m += 1
        change = np.ones_like(x)
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (n + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / guard(1 + numerator * d)
            c = guard(1 + numerator / c)
            change = change * d * c
        h = h * np.where(moving, change, 1.0)
        moving = moving & (np.abs(change - 1) > 1e-15)
        if m % 64 == 0:  # rounding may keep the last digit moving
            moving = moving & (np.abs(change - 1) > 4e-15)
    value = np.clip(front * h, 0.0, 1.0)
    return np.where(flip, 1 - value, value)


@F.pandas_udf(T.DoubleType())
def beta_inc(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    frame = pd.DataFrame({"a": a, "b": b, "x": x, "y": y}).astype(float)
    known = frame.dropna()
    out = pd.Series(np.nan, index=frame.index)
    if len(known):
        out[known.index] = beta_fraction(*(known[c].to_numpy() for c in "abxy"))
    return out.astype(object).where(out.notna(), None)


def student_two_sided(t: ColumnLike, df: ColumnLike) -> Column:
    """Two-sided p-value of a t statistic."""
    value, n = as_col(t).cast("double"), as_col(df).cast("double")
    whole = n + value * value
    return beta_inc(n / 2, F.lit(0.5), n / whole, value * value / whole)


def binomial_cdf(successes: ColumnLike, trials: ColumnLike, p: ColumnLike) -> Column:
    """P(X <= successes), exact, through the incomplete beta."""
    k, n = as_col(successes).cast("double"), as_col(trials).cast("double")
    share = as_col(p).cast("double")
    inner = beta_inc(F.greatest(n - k, F.lit(0.5)), k + 1, 1 - share, share)
    return F.when(k >= n, F.lit(1.0)).otherwise(inner)
