"""Estimators over aggregates, and tail probabilities for result rows."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def skewness_adjusted(column):
    """Bias-adjusted sample skewness: NULL below 3 values, 0 for a constant column."""
    n = F.count(column).cast("double")
    g1 = F.when(F.var_pop(column) == 0, F.lit(0.0)).otherwise(F.skewness(column))
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * g1)


def kurtosis_adjusted(column):
    """Bias-adjusted excess kurtosis: NULL below 4 values, 0 for a constant column."""
    n = F.count(column).cast("double")
    g2 = F.kurtosis(column)
    value = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(F.var_pop(column) == 0, F.lit(0.0)).otherwise(value))


def pearson(x, y):
    """Pairwise-complete Pearson r; NULL when either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull() if isinstance(x, str) else x.isNotNull() & y.isNotNull()
    a, b = (F.col(x), F.col(y)) if isinstance(x, str) else (x, y)
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return F.covar_samp(a, b) / F.nullif(spread, F.lit(0.0))


def entropy(share):
    """Natural-log entropy of shares padded by 1e-9 and renormalised; an aggregate."""
    p = share + F.lit(1e-9)
    total = F.sum(p)
    return -(F.sum(p * F.log(p)) / total - F.log(total))


def _stirling_error(n):
    """log(n!) minus Stirling's leading terms, without cancellation for large n."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n > 0 else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / m) / m) / m) / n


def _deviance(x, mean):
    """x*log(x/mean) + mean - x, stable when x is near mean."""
    if x == 0:
        return mean
    d = (x - mean) / mean
    if abs(d) < 0.1:
        term, total, k = d * d, 0.0, 2
        power = d * d
        while True:
            # (1+d)log(1+d) - d = sum_{k>=2} (-1)^k d^k / (k(k-1))
            add = power / (k * (k - 1)) * (1 if k % 2 == 0 else -1)
            if total + add == total:
                return mean * total
            total += add
            power *= d
            k += 1
    return x * math.log(x / mean) + mean - x


def _beta_front(x, a, b):
    """x^a (1-x)^b / (a B(a,b)) by the saddle-point form when the arguments are large."""
    if a > 10 and b > 10:
        n = a + b
        log_p = (_stirling_error(n) - _stirling_error(a) - _stirling_error(b)
                 - _deviance(a, n * x) - _deviance(b, n * (1 - x)))
        return math.exp(log_p) * math.sqrt(a * b / (2 * math.pi * n)) / a
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                    + a * math.log(x) + b * math.log1p(-x)) / a


def incomplete_beta(x, a, b):
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return _beta_front(x, a, b) * h


def binomial_tail(correct, total, p0=0.5):
    """P(X >= correct) for X ~ Binomial(total, p0)."""
    return 1.0 if correct <= 0 else incomplete_beta(p0, correct, total - correct + 1)


def student_two_sided(t, df):
    return incomplete_beta(df / (df + t * t), df / 2.0, 0.5)


@F.pandas_udf(DoubleType())
def binomial_tail_udf(correct: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(k) or pd.isna(n) or n <= 0 else binomial_tail(int(k), int(n))
                      for k, n in zip(correct, total)], dtype="float64")


@F.pandas_udf(DoubleType())
def correlation_p_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation by the t distribution on n-2 degrees of freedom."""
    out = []
    for r, m in zip(rho, n):
        if pd.isna(r) or m < 3:
            out.append(None)
        elif abs(r) >= 1:
            out.append(0.0)
        else:
            out.append(student_two_sided(r * math.sqrt((m - 2) / (1 - r * r)), m - 2))
    return pd.Series(out, dtype="float64")


def shapiro_wilk(values):
    """(W, p) of the Shapiro-Wilk test by Royston's 1995 approximation, 4 <= n <= 5000."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 4 or x[-1] - x[0] < 1e-19:
        return (1.0, 1.0) if n >= 4 else (float("nan"), float("nan"))
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    m2 = float(m @ m)
    root = 1.0 / math.sqrt(n)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(m2)], root)
    a = np.empty(n)
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(m2)], root)
        phi = (m2 - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last ** 2 - 2 * second ** 2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = second, -second
    else:
        phi = (m2 - 2 * m[-1] ** 2) / (1 - 2 * last ** 2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[-1], a[0] = last, -last
    centred = x - x.mean()
    w = min(1.0, float(a @ x) ** 2 / float(centred @ centred))
    if 1 - w <= 0:
        return w, 1.0
    if n <= 11:
        gamma = 0.459 * n - 2.273
        inner = gamma - math.log(1 - w)
        if inner <= 0:
            return w, 0.0
        y = -math.log(inner)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, log_n = math.log(1 - w), math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return w, 1.0 - normal.cdf((y - mu) / sigma)
