"""How far results depend on the pseudo-count that zeros get.

Two ways: the whole analysis again at a few pseudo-counts ("conservative"), or only the last step, a plain linear model of
the bias-corrected table, over a grid of values that replace its zeros. A result is robust if all runs agree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.functions.dist import f_tails, t_two_sided
from countloom.functions.kernels import gram_pivots
from countloom.operators.transforms import sensitivity_scores
from countloom.plans.analysis import Config, Result, analyze, kept, prepare
from countloom.plans.formula import Design, moments
from countloom.plans.group_tests import dunnett, trend
from countloom.plans.sheets import Batch, add, by_taxon, centred_rows, sheets

PSEUDO_COUNTS = (0.1, 0.5, 1.0)
GRID = tuple(k / 100 for k in range(1, 51))

#: Result tables: the attribute or function that gives one, the column that names a test beside the taxon, and whose refits
#: score it. A trend is scored by the global test's refits, as in published results; many-against-one tests by their
#: coefficients'.
TABLES = {
    "primary": ("primary", "coef", "primary"),
    "global": ("global_test", None, "global"),
    "pairwise": ("pairwise", "contrast", "pairwise"),
    "dunnett": ("dunnett", "contrast", "primary"),
    "trend": ("trend", None, "global"),
}
Patterns = dict[str, tuple[np.ndarray, int]]


def term_of(column: str | None) -> Column:
    return F.col(column) if column else F.lit("global")


def tables_of(run: Result, cfg: Config, many_to_one: bool, patterns: Patterns | None) -> dict[str, DataFrame]:
    """A run's tables. Simulated nulls are drawn by taxon and seed, so those of every run are the same draws."""
    found = {"primary": run.primary, "global": run.global_test, "pairwise": run.pairwise}
    if many_to_one:
        found["dunnett"] = kept(dunnett(run, cfg), "many-to-one")
    if patterns:
        found["trend"] = kept(trend(run, cfg, patterns), "trends")
    return {k: v for k, v in found.items() if v is not None}


def conservative(counts: DataFrame, samples: DataFrame, cfg: Config, main: Result | None = None, pseudos: tuple[float, ...] = PSEUDO_COUNTS, many_to_one: bool = False, patterns: Patterns | None = None, own_trend: bool = False) -> dict[str, DataFrame]:
    """The main run's tables with ss (the share of all runs whose q exceeds alpha; null counts), passed_ss (all agree)
    and diff_robust. Tables that the configuration doesn't ask for are left out. ``many_to_one`` and ``patterns`` add those
    tests; trends are scored by the global test, which must be asked for, or with ``own_trend`` by their own q."""
    if patterns and not (cfg.global_test or own_trend):
        raise ValueError("trends are scored by the global test")
    ready = prepare(counts, samples, cfg)  # screens, design and counts by sample don't depend on the pseudo-count
    runs = [main or analyze(counts, samples, cfg, ready), *(analyze(counts, samples, replace(cfg, pseudo=v), ready) for v in pseudos)]
    tables = [tables_of(r, cfg, many_to_one, patterns if k == 0 or own_trend else None) for k, r in enumerate(runs)]
    out = {}
    for name, table in tables[0].items():
        source = "global" if name == "trend" and not own_trend else name
        column = TABLES[source][1]
        values = reduce(DataFrame.unionByName, [t[source].select("taxon", term_of(column).alias("term"), F.col("q").alias("value")) for t in tables])
        scores = kept(sensitivity_scores(values, cfg.alpha), "scores").withColumnRenamed("passed", "passed_ss")
        joined = table.withColumn("term", term_of(column)).join(scores, ["taxon", "term"]).drop("term")
        out[name] = joined.withColumn("diff_robust", F.col("diff") & F.col("passed_ss"))
    return out


def pairs_of(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


@dataclass
class Sums:
    """A taxon's sums over samples, of which those with a bias and all covariates are in use. ``u`` is the log of a count that
    isn't zero, and 0 elsewhere; ``z`` marks zeros. ``seen``, ``total_u`` and ``zeros``: of all samples, in use or not."""

    gram: np.ndarray
    x1: np.ndarray
    xu: np.ndarray
    xz: np.ndarray
    xt: np.ndarray
    used: float
    u: float
    uu: float
    ut: float
    z: float
    zt: float
    t: float
    tt: float
    seen: float
    total_u: float
    zeros: float


def refit_sums(m: Sums, columns: list[str], group_columns: dict[int, int], back: np.ndarray, grid: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
    """For each test its p-values over the grid: a linear model of one taxon's log counts less the sample biases. Tests
    that can't be made are nan. A value that replaces zeros enters by its log alone, so all refits follow from one taxon's
    sums; ``back`` gives the design's coefficients from those of the sums' x."""
    group = sorted(group_columns)
    tests = [("primary", c) for c in columns] + [("pairwise", c) for c in (columns[j] for j in group)]
    tests += [("pairwise", f"{columns[b]}_{columns[a]}") for k, a in enumerate(group) for b in group[k + 1 :]] + [("global", "global")]
    out = {t: np.full(len(grid), np.nan) for t in tests}
    keep = gram_pivots(m.gram) if m.used > 0.5 else []
    dof = round(m.used) - len(keep)
    if not keep or dof < 1:
        return out
    with np.errstate(all="ignore"):
        g = np.log(grid)
        mean = (m.total_u + g * m.zeros) / m.seen
        xy = m.xu[:, None] + g * m.xz[:, None] - mean * m.x1[:, None] - m.xt[:, None]
        v, vt, vv = m.u + g * m.z, m.ut + g * m.zt, m.uu + g * g * m.z
        yy = vv + mean * mean * m.used + m.tt - 2 * mean * v - 2 * vt + 2 * mean * m.t
        root = np.linalg.cholesky(m.gram[np.ix_(keep, keep)])
        inverse = np.linalg.inv(root)
        effects = inverse @ xy[keep]
        sigma2 = np.maximum(0.0, yy - (effects**2).sum(axis=0)) / dof
        coef, cov = np.zeros((len(columns), len(grid))), np.zeros((len(columns), len(columns)))
        coef[keep], cov[np.ix_(keep, keep)] = inverse.T @ effects, inverse.T @ inverse
        coef, cov = back @ coef, back @ cov @ back.T
        for j in keep:
            p = t_two_sided(coef[j] / np.sqrt(cov[j, j] * sigma2), dof)
            out["primary", columns[j]] = p
            if j in group:
                out["pairwise", columns[j]] = p
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                if a in keep and b in keep:
                    var = (cov[a, a] + cov[b, b] - 2 * cov[a, b]) * sigma2
                    out["pairwise", f"{columns[b]}_{columns[a]}"] = t_two_sided((coef[b] - coef[a]) / np.sqrt(var), dof)
        own = [keep.index(j) for j in group if j in keep]
        if own:  # the group's sequential sum of squares
            f = (effects[own] ** 2).sum(axis=0) / len(own) / sigma2
            out["global", "global"] = f_tails(f, len(own), dof)[1]
    return out


def refit(d: Design, n: np.ndarray, theta: np.ndarray, grid: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
    """``refit_sums`` of one taxon's counts, all samples beside each other."""
    seen = np.isfinite(n)
    use = seen & np.isfinite(theta) & np.isfinite(d.x).all(axis=1)
    x, t, zero = d.x[use], theta[use], n[use] == 0
    with np.errstate(all="ignore"):
        u = np.where(n == 0, 0.0, np.log(np.where(n == 0, 1.0, n)))
    own = u[use]
    m = Sums(x.T @ x, x.sum(axis=0), x.T @ own, x[zero].sum(axis=0), x.T @ t, float(use.sum()), own.sum(), own @ own, own @ t, float(zero.sum()), t[zero].sum(), t.sum(), t @ t, float(seen.sum()), float(np.nansum(u[seen])), float((n[seen] == 0).sum()))
    return refit_sums(m, d.columns, d.group_columns, np.eye(len(d.columns)), grid)


def refit_scores(main: Result, cfg: Config, grid: np.ndarray) -> DataFrame:
    """taxon, kind, term, ss. Only cells that aren't zero are read: the sums of a taxon's zeros are those of all samples less
    those of its other cells. Nothing is as long as the samples are many."""
    f = main.design
    gram, _, every = moments(f)
    counts = main.table.select("taxon", "sample", F.coalesce(F.col("n"), F.lit(float("nan"))).alias("y"))
    s = sheets(counts, f, gram, every)
    s = replace(s, rows=s.rows.join(main.theta.select("sample", "theta"), "sample", "left"))
    p, pairs, taxa, back = s.p, pairs_of(s.p), s.taxa, np.linalg.inv(s.basis)
    use = F.col("whole") & F.col("theta").isNotNull() & ~F.isnan("theta")
    x, t = [F.get("x", F.lit(j)) for j in range(p)], F.col("theta")
    wanted = [*(x[i] * x[j] for i, j in pairs), *x, *(v * t for v in x), F.lit(1.0), t, t * t]
    total = centred_rows(f, s.basis).join(main.theta.select("sample", "theta"), "sample", "left").agg(*(F.coalesce(F.sum(F.when(use, v)), F.lit(0.0)).alias(f"s{k}") for k, v in enumerate(wanted)))
    every_sum = np.array(total.first(), float)
    columns, group_columns, alpha = f.columns, f.group_columns, cfg.alpha
    n_gone, n_off = len(pairs) + 2 * p + 4, p + 3

    def own(b: Batch, sums: np.ndarray) -> None:
        ready = b.whole & np.isfinite(b.theta)
        x, t = b.x, np.where(ready, b.theta, 0.0)
        off = b.y != 0  # missing ones too
        gone = np.isnan(b.y)
        with np.errstate(all="ignore"):
            u = np.where(off & ~gone, np.log(np.where(off, b.y, 1.0)), 0.0)
        at = 0

        def put(cells: np.ndarray, weights: np.ndarray) -> None:
            nonlocal at
            add(sums, at, b.at[cells], weights[cells])
            at += 1

        one, row = np.ones(len(b.row)), b.row
        cells = gone & ready[row]
        for i, j in pairs:
            put(cells, (x[:, i] * x[:, j])[row])
        for j in range(p):
            put(cells, x[row, j])
        for j in range(p):
            put(cells, (x[:, j] * t)[row])
        for v in (one, t[row], (t * t)[row]):
            put(cells, v)
        put(gone, one)
        cells = off & ready[row]
        for j in range(p):
            put(cells, x[row, j])
        for v in (one, t[row]):
            put(cells, v)
        put(off, one)
        for j in range(p):
            put(cells, x[row, j] * u)
        for v in (u, u * u, u * t[row]):
            put(cells, v)
        put(off & np.isfinite(u), u)

    def score(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                v = np.array(r[1:], float)
                gone, off, present = v[:n_gone], v[n_gone : n_gone + n_off], v[n_gone + n_off :]
                sums = every_sum - gone[:-1]
                flat, x1, xt, (used, t, tt) = np.split(sums, [len(pairs), len(pairs) + p, len(pairs) + 2 * p])
                gram = np.zeros((p, p))
                for c, (i, j) in enumerate(pairs):
                    gram[i, j] = gram[j, i] = flat[c]
                k = len(pairs)
                xz, z, zt = every_sum[k : k + p] - off[:p], every_sum[k + 2 * p] - off[p], every_sum[k + 2 * p + 1] - off[p + 1]
                m = Sums(gram, x1, present[:p], xz, xt, used, present[p], present[p + 1], present[p + 2], z, zt, t, tt, every - gone[-1], present[p + 3], every - off[-1])
                for (kind, term), q in refit_sums(m, columns, group_columns, back, grid).items():
                    rows.append((taxa[r.k], kind, term, float((np.isnan(q) | (q > alpha)).mean())))
            yield pd.DataFrame(rows, columns=["taxon", "kind", "term", "ss"])

    sums = by_taxon(s, n_gone + n_off + p + 4, own).where("k >= 0")
    with s.batches():
        return kept(sums.mapInPandas(score, "taxon string, kind string, term string, ss double"), "scores")


def nonconservative(main: Result, cfg: Config, grid: tuple[float, ...] = GRID, many_to_one: bool = False, patterns: Patterns | None = None) -> dict[str, DataFrame]:
    """As ``conservative``, but ss is the share of the grid whose p-value exceeds alpha, and a result passes if the main
    run's p-value is on the same side as all of them."""
    scores = refit_scores(main, cfg, np.array(grid))
    out = {}
    for name, own in tables_of(main, cfg, many_to_one, patterns).items():
        _, column, source = TABLES[name]
        above = F.coalesce(F.col("p"), F.lit(1.0)) > cfg.alpha
        joined = own.withColumn("term", term_of(column)).join(scores.where(F.col("kind") == source).drop("kind"), ["taxon", "term"]).drop("term")
        joined = joined.withColumn("passed_ss", ((F.col("ss") == 0) & ~above) | ((F.col("ss") == 1) & above))
        out[name] = joined.withColumn("diff_robust", F.col("diff") & F.col("passed_ss"))
    return out
