"""How many tables a dish's customers sit at: generalised Stirling numbers and draws from the seating's conditional.

S(n, m) sums, over all ways to seat n customers at m tables, the product over tables of (1-d)(2-d)..(size-1-d). Given the
mass x with which a table opens, m tables have weight S(n, m) x**m.
"""

from __future__ import annotations

from functools import lru_cache
from math import gamma, log, pi

import numpy as np

#: Up to so many customers S comes from its recursion; beyond, from its asymptotic forms.
EXACT = 256


def large_lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x of 8 or more."""
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * log(2 * pi) + series


def lgamma(x) -> np.ndarray:
    """log of the gamma function for x > 0."""
    x = np.asarray(x, float)
    product, y = np.ones_like(x), x.copy()
    for _ in range(8):  # up to where the series is exact
        small = y < 8
        product = np.where(small, product * y, product)
        y = y + small
    return large_lgamma(y) - np.log(product)


@lru_cache(maxsize=8)
def table(discount: float, n: int = EXACT) -> np.ndarray:
    """log S(c, m) at [c, m], minus infinity where there is no way."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0.0
    m = np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, n):
            stay = np.where(m[1:] <= c, np.log(np.maximum(c - m[1:] * discount, 0)) + out[c, 1:], -np.inf)
            out[c + 1, 1:] = np.logaddexp(stay, out[c, :-1])
    return out


def log_stirling(n: np.ndarray, m: np.ndarray, d: float) -> np.ndarray:
    """log S(n, m) of large n, 1 <= m <= n. S(n, m) = n! / (m! d**m) times the n-th coefficient of (1 - (1-x)**d)**m.

    Few tables for n: the singularity at 1, term by term. Else: the saddle point.
    """
    n, m = np.asarray(n, float), np.asarray(m, float)
    few = m * n**-d < min(2.5, 0.7 / (d**d * 20 ** (d - 1)))  # where the terms still fall
    out = np.zeros(len(n))
    out[few] = singular(n[few], m[few], d)
    between = ~few & (m < n)
    out[between] = saddle(n[between], m[between], d)
    return out


def singular(n: np.ndarray, m: np.ndarray, d: float) -> np.ndarray:
    total, choose, first = np.zeros_like(n), np.ones_like(n), large_lgamma(n - d)
    for j in range(1, 80):
        choose = choose * (m - j + 1) / j
        if abs(j * d - round(j * d)) < 1e-9:  # such terms are zero
            continue
        term = (-1) ** j / gamma(-j * d) * choose * (np.exp(large_lgamma(n - j * d) - first) if j > 1 else 1.0)
        total += term
        if not (np.abs(term) > 1e-10 * np.abs(total)).any():
            break
    return first - lgamma(m + 1) - m * log(d) + np.log(np.maximum(total, 1e-300))


def saddle(n: np.ndarray, m: np.ndarray, d: float) -> np.ndarray:
    """x = 1 - exp(-v); the saddle is where m a(x) = n, with a(x) the logarithmic derivative of 1 - (1-x)**d."""
    lo, hi = np.full_like(n, -30.0), np.full_like(n, 8.0)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for _ in range(48):
            middle = (lo + hi) / 2
            v = np.exp(middle)
            above = np.log(m * d) + (1 - d) * v + np.log(-np.expm1(-v)) - np.log(-np.expm1(-d * v)) > np.log(n)
            lo, hi = np.where(above, lo, middle), np.where(above, middle, hi)
        v = np.exp((lo + hi) / 2)
        x, rest = -np.expm1(-v), -np.expm1(-d * v)
        a = n / m
        bend = a + x * x * d * (1 - d) * np.exp((2 - d) * v) / rest - a * a
        head = large_lgamma(n + 1) - lgamma(m + 1) - m * log(d)
        return head + m * np.log(rest) - n * np.log(x) - 0.5 * np.log(2 * pi * m * np.maximum(bend, 1e-12))


def draw_tables(customers: np.ndarray, mass: np.ndarray, now: np.ndarray, d: float, rng: np.random.Generator, steps: int = 6) -> np.ndarray:
    """Tables of each dish, from weights S(c, m) mass**m, m from 1 to c; none without customers.

    Exactly from these weights up to ``EXACT`` customers. Beyond, ``steps`` Metropolis steps from ``now``, with a normal
    proposal around the greatest weight: any number of customers costs the same.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    known = table(d)
    few = np.flatnonzero((customers >= 2) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    log_mass = np.log(np.maximum(mass, 1e-300))
    for own in np.split(few, np.flatnonzero(np.diff(customers[few])) + 1) if len(few) else []:
        c = int(customers[own[0]])
        for at in range(0, len(own), max(1, (1 << 19) // c)):
            part = own[at : at + max(1, (1 << 19) // c)]
            weight = known[c, 1 : c + 1] + log_mass[part, None] * np.arange(1, c + 1)
            weight -= weight.max(axis=1, keepdims=True)
            upto = np.cumsum(np.exp(weight), axis=1)
            out[part] = 1 + (upto < (rng.random(len(part)) * upto[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        c, lm = customers[many].astype(float), log_mass[many]
        weight = lambda m: log_stirling(c, m, d) + m * lm
        lo, hi = np.ones_like(c), c.copy()
        while (hi - lo > 1).any():  # the weight has one peak
            middle = np.floor((lo + hi) / 2)
            rising = weight(np.minimum(middle + 1, c)) > weight(middle)
            lo, hi = np.where(rising & (hi - lo > 1), middle, lo), np.where(~rising & (hi - lo > 1), middle, hi)
        peak = np.where(weight(hi) > weight(lo), hi, lo)
        inner = np.clip(peak, 2, c - 1)
        bend = 2 * weight(inner) - weight(inner - 1) - weight(inner + 1)
        spread = np.maximum(1.0, 1.2 / np.sqrt(np.maximum(bend, 1e-9)))
        spread = np.minimum(spread, c)
        state = np.clip(now[many].astype(float), 1, c)
        score = lambda m: weight(m) + (m - peak) ** 2 / (2 * spread * spread)
        held = score(state)
        for _ in range(steps):
            new = np.round(peak + spread * rng.standard_normal(len(c)))
            inside = (new >= 1) & (new <= c)
            got = score(np.clip(new, 1, c))
            move = inside & (np.log(rng.random(len(c))) < got - held)
            state, held = np.where(move, new, state), np.where(move, got, held)
        out[many] = state.astype(np.int64)
    return out
