"""Distribution functions and keyed random numbers, without SciPy."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for k in range(1000):
        m = k // 2
        if k == 0:
            step = 1.0
        elif k % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    return float("nan") if math.isnan(t) or df <= 0 else beta_inc(df / 2, 0.5, df / (df + t * t))


def student_quantile(p: float, df: float) -> float:
    """The t for which a share p of the distribution lies below, by bisection."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -student_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - student_p(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if 1 - student_p(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def f_tail(f: float, df1: float, df2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def _each(f, *values) -> np.ndarray:
    """f of each row of the values, made once for each different row."""
    rows, at = np.unique(np.stack(values), axis=1, return_inverse=True)
    return np.array([f(*r) for r in rows.T.tolist()], float)[at.ravel()]


def beta_incs(a, b, x) -> np.ndarray:
    """beta_inc() of arrays."""
    a, b, x = (v.ravel() for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x))))
    out = np.where(np.isnan(x), np.nan, (x >= 1).astype(float))
    live = np.flatnonzero((x > 0) & (x < 1))
    turned = x[live] > (a[live] + 1) / (a[live] + b[live] + 2)
    p, q, z = np.where(turned, b[live], a[live]), np.where(turned, a[live], b[live]), np.where(turned, 1 - x[live], x[live])
    front = np.exp(_each(lambda u, v: math.lgamma(u + v) - math.lgamma(u) - math.lgamma(v), p, q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny, done, at = 1e-300, np.zeros(len(live)), np.arange(len(live))
    f, c, d = np.ones(len(live)), np.ones(len(live)), np.zeros(len(live))
    for k in range(1000):
        if not len(at):
            break
        m, u, v, w = k // 2, p[at], q[at], z[at]
        if k == 0:
            step = np.ones(len(at))
        elif k % 2 == 0:
            step = m * (v - m) * w / ((u + 2 * m - 1) * (u + 2 * m))
        else:
            step = -(u + m) * (u + v + m) * w / ((u + 2 * m) * (u + 2 * m + 1))
        below = 1 + step * d
        d = 1 / np.where(below == 0, tiny, below)
        c = 1 + step / c
        c = np.where(c == 0, tiny, c)
        f = f * c * d
        done[at] = f
        more = np.abs(c * d - 1) >= 1e-15
        at, f, c, d = at[more], f[more], c[more], d[more]
    value = front * (done - 1)
    out[live] = np.where(turned, 1 - value, value)
    return out


def student_ps(t, df) -> np.ndarray:
    """student_p() of arrays."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    good = ~np.isnan(t) & (df > 0)
    n, square = np.where(good, df, 1.0), np.where(good, t, 0.0) ** 2
    return np.where(good, beta_incs(n / 2, 0.5, n / (n + square)), np.nan)


def student_quantiles(p, df) -> np.ndarray:
    """student_quantile() of arrays."""
    p, df = (v.ravel() for v in np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float)))
    upper = np.where(p < 0.5, 1 - p, p)
    low, high = np.zeros(len(p)), np.ones(len(p))
    at = np.flatnonzero(upper != 0.5)
    while len(at):
        at = at[1 - student_ps(high[at], df[at]) / 2 < upper[at]]
        high[at] *= 2
    at = np.flatnonzero(upper != 0.5)
    for _ in range(200):
        mid = (low[at] + high[at]) / 2
        more = (mid != low[at]) & (mid != high[at])
        at, mid = at[more], mid[more]
        if not len(at):
            break
        less = 1 - student_ps(mid, df[at]) / 2 < upper[at]
        low[at[less]], high[at[~less]] = mid[less], mid[~less]
    return np.where(upper == 0.5, 0.0, np.where(p < 0.5, -1.0, 1.0) * (low + high) / 2)


def f_tails(f, df1, df2) -> np.ndarray:
    """f_tail() of arrays."""
    f = np.asarray(f, float)
    some = np.where(f > 0, f, 1.0)
    return np.where(f <= 0, 1.0, beta_incs(df2 / 2, df1 / 2, df2 / (df2 + df1 * some)))


def gamma_qs(a: float, x) -> np.ndarray:
    """gamma_q() of an array x."""
    x = np.asarray(x, float)
    out = np.where(np.isnan(x), np.nan, 1.0)
    front = np.exp(-np.maximum(x, 1e-300) + a * np.log(np.maximum(x, 1e-300)) - math.lgamma(a))
    at = np.flatnonzero((x > 0) & (x < a + 1))
    term = total = np.full(len(at), 1 / a)
    k = a
    while (np.abs(term) > np.abs(total) * 1e-16).any():
        k += 1
        term = term * x[at] / k
        total = total + term
    out[at] = 1 - total * front[at]
    at = np.flatnonzero(x >= a + 1)
    b = x[at] + 1 - a
    c, d = np.full(len(at), 1e300), 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b = b + 2
        d = 1 / (an * d + b)
        c = b + an / c
        h = h * d * c
        if not (np.abs(d * c - 1) >= 1e-15).any():
            break
    out[at] = front[at] * h
    return out


def chi2_tails(x, df: float) -> np.ndarray:
    """chi2_tail() of an array x."""
    return gamma_qs(df / 2, np.asarray(x, float) / 2)


def splitmix64(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def normal_tail(x: float) -> float:
    """P(Z > x)."""
    return math.erfc(x / math.sqrt(2)) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
