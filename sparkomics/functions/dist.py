"""Distribution functions in numpy and as Arrow-batched column functions.

Only feature-level or model-level tables (one row per feature, pair or method) go through the column functions, never
the samples themselves.  Null or NaN arguments, and degrees of freedom that aren't positive, give null.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def norm_sf(x):
    return 0.5 * _erfc(np.asarray(x, dtype=float) / math.sqrt(2))


def norm_ppf(p: float) -> float:
    """By bisection on the tail function."""
    return _invert(lambda x: 1 - float(norm_sf(x)), p, -40.0, 40.0)


def _invert(cdf, p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b) by the modified Lentz continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    with np.errstate(all="ignore"):
        x = np.clip(x, 0.0, 1.0)
        swap = x > (a + 1) / (a + b + 2)
        p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
        c, d = np.ones_like(z), 1 / guard(1 - (p + q) * z / (p + 1))
        h = d
        for m in range(1, 400):
            for term in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / guard(1 + term * d)
                c = guard(1 + term / c)
                h = h * d * c
        out = np.where(z > 0, front * h, 0.0)
        return np.where(swap, 1 - out, out)


def gamma_inc_upper(a, x):
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(x) - _lgamma(a))
        term = total = 1 / a
        for k in range(1, 600):
            term = term * x / (a + k)
            total = total + term
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / b
        h = d
        for i in range(1, 600):
            an = -i * (i - a)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
        return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(all="ignore"):
        return beta_inc(df / 2, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    return _invert(lambda x: 1 - 0.5 * float(t_two_sided(x, df)) if x >= 0 else 0.5 * float(t_two_sided(x, df)), p, -1e6, 1e6)


def f_sf(f, d1, d2):
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    with np.errstate(all="ignore"):
        return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x, df):
    return gamma_inc_upper(np.asarray(df, dtype=float) / 2, np.asarray(x, dtype=float) / 2)


def tukey_sf(q: float, groups: int, df: float) -> float:
    """Upper tail of the studentised range, by quadrature over the scale and the least of ``groups`` normals."""
    if not q > 0:
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(200)
    z, wz = 8 * z, 8 * wz
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = 1 - norm_sf(z)

    def range_cdf(w: np.ndarray) -> np.ndarray:
        inner = cdf[None, :] - (1 - norm_sf(z[None, :] - w[:, None]))
        return groups * (density * wz * np.clip(inner, 0, 1) ** (groups - 1)).sum(axis=1)

    if df > 25_000:
        return float(1 - range_cdf(np.array([q]))[0])
    u, wu = np.polynomial.legendre.leggauss(200)
    top = 1 + 12 / math.sqrt(df) if df > 4 else 12.0
    low = max(1e-8, 1 - 12 / math.sqrt(df)) if df > 200 else 1e-8
    s, ws = (top - low) / 2 * u + (top + low) / 2, (top - low) / 2 * wu
    log = df / 2 * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(np.clip(1 - (ws * np.exp(log) * range_cdf(q * s)).sum(), 0, 1))


def wilcoxon_exact(w: float, n1: int, n2: int) -> float:
    """Two-sided p of the rank-sum statistic without ties: the counts come from the Gaussian binomial recurrence."""
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1
    for i in range(1, n1 + 1):
        up = n2 + i
        if up <= n1 * n2:
            counts[up:] -= counts[:-up].copy()
        for j in range(i, n1 * n2 + 1):
            counts[j] += counts[j - i]
    total = counts.sum()
    low = counts[: int(math.floor(w)) + 1].sum() / total
    high = counts[int(math.ceil(w)) :].sum() / total
    return float(min(1.0, 2 * min(low, high)))


def wilcoxon_p(w: float, n1: int, n2: int, ties: float) -> float:
    """Exact below 50 in each class without ties, else normal with tie-corrected variance and continuity correction.

    ``ties`` is the sum of t^3 - t over groups of equal values.
    """
    if not n1 or not n2:
        return float("nan")
    if n1 < 50 and n2 < 50 and not ties:
        return wilcoxon_exact(w, n1, n2)
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    if not sigma:
        return float("nan")
    z = w - n1 * n2 / 2
    z = (z - math.copysign(0.5, z) * (z != 0)) / sigma
    return float(min(1.0, 2 * min(norm_sf(z), norm_sf(-z))))


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's 1995 approximation, for 3 to 5000 values that aren't all equal; else NaN."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or n > 5000 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssm = (m * m).sum()
    u = 1 / math.sqrt(n)
    a = m / math.sqrt(ssm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            phi = (ssm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a = m / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = last, second, -last, -second
        else:
            phi = (ssm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = last, -last
    w = min(1.0, (a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return w, 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        if math.log(1 - w) >= g:
            return w, 0.0
        y = -math.log(g - math.log(1 - w))
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, k = math.log(1 - w), math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, float(norm_sf((y - mu) / sigma))


def _column(function):
    @F.pandas_udf(DoubleType())
    def run(*args: pd.Series) -> pd.Series:
        values = [a.to_numpy(dtype=float) for a in args]
        ok = np.isfinite(values[0])
        for v in values[1:]:
            ok &= np.isfinite(v) & (v > 0)
        out = np.full(len(ok), np.nan)
        if ok.any():
            out[ok] = function(*(v[ok] for v in values))
        return pd.Series(out).where(ok, None).astype(float)

    return lambda *columns: F.nullif(run(*columns), F.lit(float("nan")))


#: Two-sided p of (t, df); upper tails of (F, df1, df2) and (chi-squared, df).
t_pvalue, f_pvalue, chi2_pvalue = _column(t_two_sided), _column(f_sf), _column(chi2_sf)
t_quantile_975 = _column(lambda ignored, df: np.array([t_ppf(0.975, d) for d in df]))


@F.pandas_udf(DoubleType())
def _wilcoxon(w: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_p(a, int(b), int(c), d) if a == a else None for a, b, c, d in zip(w, n1, n2, ties, strict=True)], dtype=float)


def wilcoxon_pvalue(w, n1, n2, ties):
    return F.nullif(_wilcoxon(w, n1, n2, ties), F.lit(float("nan")))


def adjust(p: np.ndarray, method: str) -> np.ndarray:
    """p.adjust: holm, hochberg, hommel, bonferroni, BH (fdr), BY, none.  NaN stays NaN and doesn't count."""
    p = np.asarray(p, dtype=float)
    out, ok = np.full(len(p), np.nan), ~np.isnan(p)
    v = p[ok]
    n = len(v)
    order = np.argsort(v, kind="stable")
    s, k = v[order], np.arange(1, n + 1)
    if method == "none" or not n:
        r = s
    elif method == "bonferroni":
        r = np.minimum(1, n * s)
    elif method == "holm":
        r = np.minimum(1, np.maximum.accumulate((n - k + 1) * s))
    elif method in ("hochberg", "BH", "fdr", "BY"):
        factor = n - k + 1 if method == "hochberg" else n / k * ((1 / k).sum() if method == "BY" else 1)
        r = np.minimum(1, np.minimum.accumulate((factor * s)[::-1])[::-1])
    elif method == "hommel":
        q = np.full(n, (n * s / k).min())
        best = q.copy()
        for m in range(n - 1, 1, -1):
            head, tail = np.arange(n - m + 1), np.arange(n - m + 1, n)
            least = (m * s[tail] / np.arange(2, m + 1)).min()
            q[head] = np.minimum(m * s[head], least)
            q[tail] = q[n - m]
            best = np.maximum(best, q)
        r = np.minimum(1, np.maximum(best, s))
    else:
        raise ValueError(f"unknown method: {method}")
    back = np.empty(n)
    back[order] = r
    out[ok] = back
    return out
