"""p-values for the two-sample tests, applied to one row per tested column.

SciPy is not available, so the three distributions are written out from
their textbook definitions: Student t through the regularised incomplete
beta function (continued fraction, modified Lentz), the normal tail through
``erfc``, and the asymptotic Kolmogorov distribution through its alternating
series (with Stephens' small-sample adjustment of the statistic).

Small samples get exact null distributions: Mann-Whitney if one sample has at
most 8 values and no value repeats (the counts of U are the coefficients of a
Gaussian binomial), Kolmogorov-Smirnov if neither sample has more than 10,000
values (lattice paths that stay within the statistic).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    front = math.exp(lbeta)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided(t: float, dof: float) -> float:
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def normal_two_sided(z: float) -> float:
    if z is None or math.isnan(z):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


def ks_two_sided(d: float, n1: float, n2: float) -> float:
    if d is None or not n1 or not n2:
        return float("nan")
    en = math.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    if lam < 1e-3:
        return 1.0
    s = 0.0
    for k in range(1, 101):
        term = 2.0 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam)
        s += term
        if abs(term) < 1e-16:
            break
    return min(1.0, max(0.0, s))


#: Largest samples with exact distributions.
MANN_WHITNEY_EXACT = 8
KS_EXACT = 10_000


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U of distinct values: twice the share of deals with a U at least as far above the middle, at most 1."""
    few, many = sorted((int(n1), int(n2)))
    high = int(round(max(u, n1 * n2 - u)))
    counts = np.zeros(few * many + 1)
    counts[0] = 1.0
    for k in range(1, few + 1):  # times (1 - q^(many + k)) / (1 - q^k), scaled to shares of all deals
        counts[many + k:] -= counts[: -(many + k)].copy()
        for r in range(k):
            counts[r::k] = np.cumsum(counts[r::k])
        counts *= k / (many + k)
    return float(min(1.0, 2.0 * max(0.0, counts[high:].sum())))


def ks_exact(d: float, n1: int, n2: int) -> float:
    """P(D >= d) of two samples without ties: 1 - the share of lattice paths on which |i / n1 - j / n2| stays below d."""
    n1, n2 = int(n1), int(n2)
    unit = n1 // math.gcd(n1, n2) * n2
    least = int(round(d * unit))  # D is a multiple of 1 / unit
    if least <= 0:
        return 1.0
    per1, per2 = unit // n1, unit // n2
    j = np.arange(n2 + 1)
    row, scale = (j * per2 < least).astype(float), 0.0  # paths along the first side
    for i in range(1, n1 + 1):
        inside = np.abs(i * per1 - j * per2) < least
        row = np.cumsum(np.where(inside, row, 0.0)) * inside
        most = row.max()
        if most <= 0.0:
            return 1.0
        row, scale = row / most, scale + math.log(most)
    if row[-1] <= 0.0:
        return 1.0
    every = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    return float(min(1.0, max(0.0, -math.expm1(math.log(row[-1]) + scale - every))))


@pandas_udf(T.DoubleType())
def p_value(kind: pd.Series, stat: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """kind 't' (stat, dof), 'z' (stat), 'u' (U, n1, n2; distinct values), 'ks' (stat, n1, n2) -> two-sided p."""
    out = []
    for k, s, x, y in zip(kind.tolist(), stat.tolist(), a.tolist(), b.tolist()):
        if s is None or (isinstance(s, float) and math.isnan(s)):
            out.append(float("nan"))
        elif k == "t":
            out.append(t_two_sided(float(s), float(x)))
        elif k == "z":
            out.append(normal_two_sided(float(s)))
        elif k == "u":
            out.append(mann_whitney_exact(float(s), x, y))
        elif max(x or 0, y or 0) <= KS_EXACT and x and y:
            out.append(ks_exact(float(s), x, y))
        else:
            out.append(ks_two_sided(float(s), float(x), float(y)))
    return pd.Series(out, dtype="float64")
