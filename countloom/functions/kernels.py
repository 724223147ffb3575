"""Dense linear algebra and fitting of one taxon or one coefficient: what runs inside a task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Fit:
    """Coefficients (nan where aliased), fitted values and residual degrees of freedom."""

    coef: np.ndarray
    fitted: np.ndarray
    dof: int


def pivots(x: np.ndarray, tol: float = 1e-7) -> list[int]:
    """The columns that are independent of those kept before them, in order: one whose part outside their span is
    shorter than ``tol`` of it is left out."""
    kept: list[int] = []
    basis = np.zeros((len(x), 0))
    for j in range(x.shape[1]):
        v = x[:, j].astype(float)
        own = np.linalg.norm(v) or 1.0
        for _ in range(2):  # twice is enough for full accuracy
            v = v - basis @ (basis.T @ v)
        if np.linalg.norm(v) >= tol * own and len(kept) < len(x):
            kept.append(j)
            basis = np.column_stack([basis, v / np.linalg.norm(v)])
    return kept


def gram_pivots(gram: np.ndarray, tol: float = 1e-13, columns: list[int] | None = None) -> list[int]:
    """As ``pivots``, from X'X: a column is left out if less than ``tol`` of its square is outside the span of those kept.
    (Squares: ``tol`` is near rounding; columns should be centred or of like size.)"""
    kept: list[int] = []
    for j in range(len(gram)) if columns is None else columns:
        own = gram[j, j]
        rest = own - gram[j, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, j]) if kept else own
        if own > 0 and rest > tol * own:
            kept.append(j)
    return kept


def least_squares(x: np.ndarray, y: np.ndarray, tol: float = 1e-7) -> Fit:
    """Least squares of the columns of y on x; dependent columns of x are aliased."""
    y = y.reshape(len(x), -1)
    kept = pivots(x, tol)
    q, r = np.linalg.qr(x[:, kept])
    coef = np.full((x.shape[1], y.shape[1]), np.nan)
    coef[kept] = np.linalg.solve(r, q.T @ y) if kept else 0
    return Fit(coef, q @ (q.T @ y), len(x) - len(kept))


def fit_taxon(x: np.ndarray, y: np.ndarray, levels: np.ndarray | None, contrast_levels: dict[int, int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, fitted values of all samples and degrees of freedom of one taxon.

    ``levels``: each sample's level of the group (-1: none); ``contrast_levels``: the level of each group column. Full
    rank: plain least squares; samples without a response are fitted too... as 0, since they are never used. Otherwise
    contrasts of unobserved levels and of the lowest observed one are dropped, and are 0, other aliased columns null. A
    taxon seen in one level only has no coefficient.
    """
    n, p = x.shape
    use = np.isfinite(y) & np.isfinite(x).all(axis=1)
    coef, fitted = np.full(p, np.nan), np.full(n, np.nan)
    if not use.any():
        return coef, fitted, 999.0
    own = least_squares(x[use], y[use])
    if not np.isnan(own.coef).any():
        out = np.zeros(n)
        out[use] = own.fitted[:, 0]
        return own.coef[:, 0], out, float(own.dof)
    drop: list[int] = []
    if levels is not None:
        seen = sorted(set(levels[use].tolist()) - {-1})
        if len(seen) < 2:
            return coef, fitted, 999.0
        drop = [j for j, k in contrast_levels.items() if k not in seen or k == seen[0]]
    keep = [j for j in range(p) if j not in drop]
    own = least_squares(x[np.ix_(use, keep)], y[use])
    if np.isnan(own.coef).all():
        return coef, fitted, 999.0
    coef[keep] = own.coef[:, 0]
    coef[drop] = 0.0
    out = np.zeros(n)
    out[use] = own.fitted[:, 0]
    return coef, out, float(own.dof)


def ginv(a: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(a, rcond=float(np.sqrt(np.finfo(float).eps)), hermitian=True)


def sandwich(x: np.ndarray, residual: np.ndarray, bread: np.ndarray, missing: float = 0.1) -> np.ndarray:
    """G (sum of e2 x x') G; a sample with a missing part adds ``missing`` to every cell of the sum."""
    whole = np.isfinite(residual) & np.isfinite(x).all(axis=1)
    xs = x[whole] * residual[whole, None]
    return bread @ (xs.T @ xs + missing * (~whole).sum()) @ bread


GOLDEN = (5**0.5 - 1) / 2


def minimise(f: Callable[[float], float], start: float, lower: float = 0.0, tol: float = 1e-8) -> float:
    """Where f is least above ``lower``, near ``start``: an interval around a lower point is found by doubling steps, then
    cut by the golden section until it is narrower than ``tol`` (of the place, beyond 1)."""
    middle = max(lower, start)
    width = max(abs(middle), 1.0) / 4
    left, right = max(lower, middle - width), middle + width
    best, at_left, at_right = f(middle), f(left), f(right)
    while at_right < best:  # downhill to the right
        left, middle, best, width = middle, right, at_right, 2 * width
        right = middle + width
        at_right = f(right)
        if width > 1e12:
            break
    while left > lower and at_left < best:  # downhill to the left
        right, middle, best, width = middle, left, at_left, 2 * width
        left = max(lower, middle - width)
        at_left = f(left)
    u, v = right - GOLDEN * (right - left), left + GOLDEN * (right - left)
    at_u, at_v = f(u), f(v)
    while right - left > tol * max(1.0, abs(middle)):
        if at_u <= at_v:
            right, v, at_v = v, u, at_u
            u = right - GOLDEN * (right - left)
            at_u = f(u)
        else:
            left, u, at_u = u, v, at_v
            v = left + GOLDEN * (right - left)
            at_v = f(v)
        middle = (left + right) / 2
    # A minimum at the bound itself is only ever approached.
    return min((lower, middle), key=f) if left <= lower else middle


@dataclass
class Mixture:
    """A three-part normal mixture of a coefficient's values around its bias."""

    pi: np.ndarray
    delta: float
    l1: float
    l2: float
    kappa1: float
    kappa2: float
    rounds: int
    delta_wls: float
    var_delta: float


def density(x, mean, var):
    return np.exp(-((x - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)


def log_density(x, mean, var):
    return -((x - mean) ** 2) / (2 * var) - np.log(2 * np.pi * var) / 2


def bias_mixture(beta: np.ndarray, nu: np.ndarray, tol: float = 1e-5, most: int = 100) -> Mixture:
    """EM for the bias of a coefficient over taxa, and its weighted least squares estimate with variance."""
    ok = np.isfinite(beta) & np.isfinite(nu)
    b, v = beta[ok], nu[ok]
    if not len(b):
        return Mixture(np.array([1.0, 0, 0]), np.nan, 0, 0, 1, 1, 0, np.nan, 0.0)
    if (v == 0).any():
        raise ValueError("a coefficient has zero variance")
    q = np.quantile(b, [0.125, 0.25, 0.75, 0.875])
    delta = b[(b >= q[1]) & (b <= q[2])].mean()
    low, high = b[b < q[0]], b[b > q[3]]
    l1 = low.mean() if len(low) else b.min()
    l2 = high.mean() if len(high) else b.max()
    spread = lambda x: x.var(ddof=1) if len(x) > 1 and x.var(ddof=1) > 0 else 1.0
    k1, k2, pi, rounds = spread(low), spread(high), np.array([0.75, 0.125, 0.125]), 0

    def tail(r, shift, start):
        def loss(kappa):
            with np.errstate(all="ignore"):
                log = -0.5 * np.log(2 * np.pi * (v + kappa)) - (b - delta - shift) ** 2 / (2 * (v + kappa))
            return -float((r * np.where(np.isfinite(log), log, 0.0)).sum())

        return minimise(loss, start)

    while rounds < most:
        rounds += 1
        parts = np.stack([pi[0] * density(b, delta, v), pi[1] * density(b, delta + l1, v + k1), pi[2] * density(b, delta + l2, v + k2)])
        with np.errstate(all="ignore"):
            r = np.nan_to_num(parts / parts.sum(axis=0))
            if not r.any():  # all underflow, as with very small variances: their ratios come from their logs
                logs = np.log(pi)[:, None] + np.stack([log_density(b, delta, v), log_density(b, delta + l1, v + k1), log_density(b, delta + l2, v + k2)])
                r = np.exp(logs - logs.max(axis=0))
                r /= r.sum(axis=0)
        new_pi = r.mean(axis=1)
        w0, w1, w2 = r[0] / v, r[1] / (v + k1), r[2] / (v + k2)
        new_delta = (w0 * b + w1 * (b - l1) + w2 * (b - l2)).sum() / (w0 + w1 + w2).sum()
        with np.errstate(all="ignore"):
            new_l1 = min(0.0, np.nan_to_num((w1 * (b - delta)).sum() / w1.sum()))
            new_l2 = max(0.0, np.nan_to_num((w2 * (b - delta)).sum() / w2.sum()))
        new_k1, new_k2 = tail(r[1], l1, k1), tail(r[2], l2, k2)
        moved = np.sqrt(((new_pi - pi) ** 2).sum() + (new_delta - delta) ** 2 + (new_l1 - l1) ** 2 + (new_l2 - l2) ** 2 + (new_k1 - k1) ** 2 + (new_k2 - k2) ** 2)
        pi, delta, l1, l2, k1, k2 = new_pi, new_delta, new_l1, new_l2, new_k1, new_k2
        if moved <= tol:
            break
    lo, hi = np.quantile(b, min(1.0, pi[1])), np.quantile(b, max(0.0, 1 - pi[2]))
    var, centre = v.copy(), b.copy()
    under, over = b < lo, b >= hi
    var[under], centre[under] = v[under] + k1, b[under] - l1
    var[over], centre[over] = v[over] + k2, b[over] - l2
    return Mixture(pi, float(delta), float(l1), float(l2), float(k1), float(k2), rounds, float((centre / var).sum() / (1 / var).sum()), float(1 / (1 / var).sum()))
