"""Linear mixed models of one taxon from sums by group of the random term: what runs inside a task.

The model is y = X b + Z u + e, with Z u of one grouping factor: u of each group has covariance s2 L L', e has s2. By the
Woodbury identity all that a fit needs of a group are Z'Z, Z'X and Z'y, so a fit costs as much as there are groups, and
with one random effect per group, as there are different Z'Z (for an intercept: group sizes), since those enter by sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from countloom.functions.dist import chi2_tails
from countloom.functions.kernels import gram_pivots, minimise


@dataclass
class Sums:
    """``full``: the products of (X, y) with itself over all observations; per group, or per class of groups of one size:
    ``zz`` (q x q), ``zv`` (q x (p + 1), Z'(X, y)), or for classes ``outer``, the sum of zv' zv, and ``times``."""

    n: float
    groups: float
    full: np.ndarray
    zz: np.ndarray
    zv: np.ndarray | None = None
    outer: np.ndarray | None = None
    times: np.ndarray | None = None

    def only(self, columns: list[int]) -> Sums:
        at = [*columns, len(self.full) - 1]
        return Sums(
            self.n,
            self.groups,
            self.full[np.ix_(at, at)],
            self.zz,
            None if self.zv is None else self.zv[:, :, at],
            None if self.outer is None else self.outer[:, at][:, :, at],
            self.times,
        )


@dataclass
class MixedFit:
    """Coefficients, their covariance, Satterthwaite degrees of freedom, the random term's factor L and residual variance."""

    beta: np.ndarray
    vcov: np.ndarray
    dof: np.ndarray
    factor: np.ndarray
    sigma2: float
    deviance: float


def lower(params: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((q, q))
    out[np.tril_indices(q)] = params
    return out


def weighed(s: Sums, params: np.ndarray) -> tuple[np.ndarray, float]:
    """(X, y)' V^-1 (X, y) and log |V|, V in units of the residual variance."""
    q = s.zz.shape[1]
    if s.outer is not None:
        ratio = float(params[0]) ** 2
        sizes = s.zz[:, 0, 0]
        return s.full - np.einsum("m,mij->ij", ratio / (1 + ratio * sizes), s.outer), float((s.times * np.log1p(ratio * sizes)).sum())
    f = lower(params, q)
    inner = np.eye(q) + f.T @ s.zz @ f
    half = f.T @ s.zv
    return s.full - np.einsum("mqi,mqj->ij", half, np.linalg.solve(inner, half)), float(np.linalg.slogdet(inner)[1].sum())


def profile(s: Sums, params: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """log |V|, log |X'V^-1 X|, the residual sum of squares, coefficients and (X'V^-1 X)^-1 at the best coefficients."""
    m, log_v = weighed(s, params)
    a, b = m[:-1, :-1], m[:-1, -1]
    scale = 1 / np.sqrt(np.diag(a))
    inverse = np.linalg.inv(a * scale[:, None] * scale) * scale[:, None] * scale
    beta = inverse @ b
    return log_v, float(np.linalg.slogdet(a)[1]), float(max(m[-1, -1] - b @ beta, 1e-300)), beta, inverse


def deviance(s: Sums, params: np.ndarray, reml: bool) -> float:
    """Minus twice the log likelihood, the residual variance at its best."""
    log_v, log_a, rss, *_ = profile(s, params)
    left = s.n - (len(s.full) - 1) * reml
    return log_v + log_a * reml + left * (1 + np.log(2 * np.pi * rss / left))


def simplex_least(f, start: np.ndarray, rounds: int = 2000, tol: float = 1e-12) -> np.ndarray:
    """A point where f is locally least, by a shrinking simplex (Nelder and Mead's moves)."""
    points = np.vstack([start, *(start + 0.5 * e for e in np.eye(len(start)))])
    values = np.array([f(v) for v in points])
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tol * (1 + abs(values[0])) and np.ptp(points, axis=0).max() < 1e-7:
            break
        centre = points[:-1].mean(axis=0)
        tried = {k: centre + k * (points[-1] - centre) for k in (-1.0,)}
        far = f(tried[-1.0])
        if far < values[0]:
            further = centre - 2 * (points[-1] - centre)
            at = f(further)
            points[-1], values[-1] = (further, at) if at < far else (tried[-1.0], far)
        elif far < values[-2]:
            points[-1], values[-1] = tried[-1.0], far
        else:
            near = centre + (0.5 if far >= values[-1] else -0.5) * (points[-1] - centre)
            at = f(near)
            if at < min(far, values[-1]):
                points[-1], values[-1] = near, at
            else:
                points[1:] = (points[1:] + points[0]) / 2
                values[1:] = [f(v) for v in points[1:]]
    return points[np.argmin(values)]


def polished(f, at: np.ndarray) -> np.ndarray:
    """A few Newton steps from near an inner minimum: function values alone place it to half their digits only."""
    for _ in range(3):
        first, second = derivatives(f, at, 1e-3 * max(1.0, float(np.abs(at).max())))
        if not np.isfinite(second).all() or np.linalg.eigvalsh(second)[0] <= 0:
            break
        step = np.linalg.solve(second, first)
        if np.abs(step).max() > 1e-3 * max(1.0, float(np.abs(at).max())):
            break
        at = at - step
    return at


def best_params(s: Sums, reml: bool) -> np.ndarray:
    q = s.zz.shape[1]
    if q == 1:
        found = minimise(lambda v: deviance(s, np.array([v]), reml), 1.0)
        return polished(lambda v: deviance(s, v, reml), np.array([found])) if found > 1e-2 else np.array([found if found > 1e-6 else 0.0])
    start = np.eye(q)[np.tril_indices(q)]
    found = simplex_least(lambda v: deviance(s, v, reml), start)
    found = simplex_least(lambda v: deviance(s, v, reml), found)  # again from there, with a fresh simplex
    zero = np.zeros_like(found)
    return zero if deviance(s, zero, reml) <= deviance(s, found, reml) else polished(lambda v: deviance(s, v, reml), found)


def derivatives(f, at: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives of a vector-valued function, by central differences of two steps combined."""
    k = len(at)

    def once(h: float):
        e = np.eye(k) * h
        plus, minus, middle = [f(at + v) for v in e], [f(at - v) for v in e], f(at)
        first = np.array([(a - b) / (2 * h) for a, b in zip(plus, minus, strict=True)])
        second = np.empty((k, k, *np.shape(middle)))
        for i in range(k):
            second[i, i] = (plus[i] - 2 * middle + minus[i]) / h**2
            for j in range(i):
                second[i, j] = second[j, i] = (f(at + e[i] + e[j]) - f(at + e[i] - e[j]) - f(at - e[i] + e[j]) + f(at - e[i] - e[j])) / (4 * h**2)
        return first, second

    (a1, a2), (b1, b2) = once(step), once(step / 2)
    return (4 * b1 - a1) / 3, (4 * b2 - a2) / 3


def satterthwaite(s: Sums, params: np.ndarray, sigma2: float) -> np.ndarray:
    """Degrees of freedom 2 v^2 / var(v) of each coefficient's variance v, by the delta method from the information on the
    random term's factor and the residual deviation. A direction without information counts for nothing."""
    p = len(s.full) - 1

    def parts(v: np.ndarray) -> np.ndarray:
        log_v, log_a, rss, _, inverse = profile(s, v)
        return np.concatenate([[log_v + log_a, rss], np.diag(inverse)])

    first, second = derivatives(parts, params, 1e-3 * max(1.0, float(np.abs(params).max())))
    value, sigma, left = parts(params), np.sqrt(sigma2), s.n - p
    k = len(params)
    hessian = np.empty((k + 1, k + 1))
    hessian[:k, :k] = second[:, :, 0] + second[:, :, 1] / sigma2
    hessian[:k, k] = hessian[k, :k] = -2 * first[:, 1] / sigma**3
    hessian[k, k] = -2 * left / sigma2 + 6 * value[1] / sigma2**2
    spread, axes = np.linalg.eigh(hessian)
    known = spread > 1e-8 * max(spread.max(), 1e-300)
    gradient = np.vstack([first[:, 2:] * sigma2, 2 * sigma * value[2:]])
    size = ((axes[:, known].T @ gradient) ** 2 / spread[known, None]).sum(axis=0)
    with np.errstate(all="ignore"):
        return (sigma2 * value[2:]) ** 2 / size  # the covariance is twice the inverse: the 2 cancels


def mixed_fit(s: Sums, reml: bool = True, dof: bool = True) -> MixedFit | None:
    """The restricted (or full) likelihood fit. Dependent columns of X are dropped: coefficient 0, variance 0.1. None where
    the model can't be fitted: fewer than two groups, or no more observations than random effects or coefficients."""
    p, q = len(s.full) - 1, s.zz.shape[1]
    kept = gram_pivots(s.full[:p, :p])
    if s.groups < 2 or s.n <= s.groups * q or s.n <= len(kept) or not kept:
        return None
    own = s.only(kept)
    params = best_params(own, reml)
    _, _, rss, beta, inverse = profile(own, params)
    sigma2 = rss / (s.n - len(kept) * reml)
    out = MixedFit(np.zeros(p), np.eye(p) * 0.1, np.full(p, 999.0), lower(params, q), float(sigma2), deviance(own, params, reml))
    out.beta[kept] = beta
    out.vcov[np.ix_(kept, kept)] = inverse * sigma2
    if dof and reml:
        out.dof[kept] = satterthwaite(own, params, sigma2)
    return out


def effects(factor: np.ndarray, beta: np.ndarray, zz: np.ndarray, zv: np.ndarray) -> np.ndarray:
    """The predicted random effects of groups: (m, q) from their zz and zv."""
    rest = zv[:, :, -1] - zv[:, :, :-1] @ beta
    inner = np.eye(len(factor)) + factor.T @ zz @ factor
    return np.linalg.solve(inner, (rest @ factor)[:, :, None])[:, :, 0] @ factor.T


def ratio_test(s: Sums, dropped: list[int]) -> tuple[float, float]:
    """Twice the log likelihood ratio of the model with and without the columns ``dropped``, and its chi-squared tail; nan
    and 1 where either can't be fitted or nothing is dropped."""
    p = len(s.full) - 1
    kept = gram_pivots(s.full[:p, :p])
    rest = [j for j in kept if j not in dropped]
    if s.groups < 2 or s.n <= s.groups * s.zz.shape[1] or s.n <= len(kept) or not rest or len(rest) == len(kept):
        return np.nan, 1.0
    full, reduced = (deviance(own, best_params(own, False), False) for own in (s.only(kept), s.only(rest)))
    w = max(0.0, reduced - full)
    return w, float(chi2_tails(w, len(kept) - len(rest))[1])
