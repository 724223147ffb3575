"""Tails of the normal, t, F and chi-squared distributions in NumPy."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(x, a, b) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    out = np.full(x.shape, np.nan)
    out[x <= 0] = 0.0
    out[x >= 1] = 1.0
    live = (x > 0) & (x < 1)
    if live.any():
        xs, p, q = x[live], a[live], b[live]
        swap = xs > (p + 1) / (p + q + 2)
        p, q, xs = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - xs, xs)
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(xs) + q * np.log1p(-xs)) / p
        value = front * _fraction(xs, p, q)
        out[live] = np.where(swap, 1 - value, value)
    return out


def _fraction(x, a, b, rounds: int = 500) -> np.ndarray:
    """Evaluates the continued fraction from the front, keeping numerator and denominator ratios."""
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, h = np.ones_like(x), d.copy()
    for m in range(1, rounds):
        last = h
        for coefficient in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + coefficient * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + coefficient / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(h - last) <= 1e-15 * np.abs(h)):
            break
    return h


def gamma_inc(a, x) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper regularised incomplete gamma functions."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    low = np.zeros(a.shape)
    for k in np.ndindex(a.shape):
        s, v = a[k], x[k]
        if not v > 0:
            low[k] = 0.0 if v <= 0 else np.nan
        elif np.isinf(v):
            low[k] = 1.0
        elif v < s + 1:
            term = total = 1 / s
            n = s
            while abs(term) > 1e-17 * abs(total):
                n += 1
                term *= v / n
                total += term
            low[k] = total * math.exp(-v + s * math.log(v) - math.lgamma(s))
        else:
            b, c, d = v + 1 - s, 1e300, 1 / (v + 1 - s)
            h = d
            for i in range(1, 1000):
                an = -i * (i - s)
                b += 2
                d = 1 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-16:
                    break
            low[k] = 1 - h * math.exp(-v + s * math.log(v) - math.lgamma(s))
    return low, 1 - low


def normal_tail(x) -> np.ndarray:
    """P(Z > x)."""
    return 0.5 * _erfc(np.asarray(x, float) / math.sqrt(2))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|); the normal's where df isn't finite; nan stays nan."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    finite = np.isfinite(df)
    v = np.where(finite, df, 1.0)
    with np.errstate(all="ignore"):
        p = np.where(finite, beta_inc(v / (v + t * t), v / 2, 0.5), 2 * normal_tail(np.abs(np.where(np.isnan(t), 0, t))))
    p = np.where(np.isinf(t), 0.0, p)
    return np.where(np.isnan(t), np.nan, p)


def f_tails(f, d1, d2) -> tuple[np.ndarray, np.ndarray]:
    """P(F < f), P(F > f)."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, d1, d2)))
    with np.errstate(all="ignore"):
        x = d1 * f / (d1 * f + d2)
        low, high = beta_inc(x, d1 / 2, d2 / 2), beta_inc(d2 / (d1 * f + d2), d2 / 2, d1 / 2)
    return np.where(np.isnan(f), np.nan, low), np.where(np.isnan(f), np.nan, high)


def chi2_tails(x, df) -> tuple[np.ndarray, np.ndarray]:
    """P(X < x), P(X > x)."""
    return gamma_inc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)
