"""Tests of a group's levels whose null distributions are simulated: many against one, and ordered patterns.

Draws are seeded by the taxon's name, so a retried task draws the same.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.functions.dist import t_two_sided
from countloom.functions.padjust import adjust
from countloom.plans.analysis import Config, Result, group_blocks, within_taxa


def seeded(taxon: str, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(taxon.encode())])


def block_of(row, p: int, cols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A taxon's group coefficients and their covariance, with the final variances on its diagonal."""
    v = np.array(row.vcov, float).reshape(p, p).copy()
    np.fill_diagonal(v, np.array(row.se, float) ** 2)
    return np.array(row.b, float)[cols], v[np.ix_(cols, cols)]


def dunnett(result: Result, cfg: Config, draws: int = 100, seed: int = 1) -> DataFrame:
    """taxon, contrast, lfc, se, W, p, q, diff: each level against the first. Taxa pass a screen by their largest W
    against the largest of ``draws`` simulated sets; p is 1 for the others."""
    d, cols = result.design, sorted(result.design.group_columns)
    names, size = [d.columns[j] for j in cols], len(d.columns)

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                b, v = block_of(row, size, cols)
                with np.errstate(all="ignore"):
                    se = np.sqrt(np.diag(v))
                    w = b / se
                rng, shape = seeded(row.taxon, seed), (draws, int(np.isfinite(w).sum()))
                null = rng.standard_t(row.dof, shape) if np.isfinite(row.dof) else rng.standard_normal(shape)
                screen = float((np.abs(null).max(axis=1) > np.nanmax(np.abs(w))).mean()) if shape[1] else 1.0
                p = np.where(np.isnan(w), 1.0, t_two_sided(w, row.dof))
                rows += zip([row.taxon] * len(names), names, b, se, w, p, [screen] * len(names), strict=True)
            yield pd.DataFrame(rows, columns=["taxon", "contrast", "lfc", "se", "W", "p", "screen_p"])

    schema = "taxon string, contrast string, lfc double, se double, W double, p double, screen_p double"
    tested = group_blocks(result.primary, result.vcov, d).mapInPandas(run, schema)
    screen = adjust(tested.groupBy("taxon").agg(F.first("screen_p").alias("screen_p")), "screen_p", [], "taxon", "bh")
    return within_taxa(tested.drop("screen_p"), screen.select("taxon", (F.col("q") <= cfg.alpha).alias("screened")), len(names), cfg.fwer, cfg.alpha, cfg.strict)


def faces(contrast: np.ndarray) -> list[np.ndarray]:
    """All independent sets of constraints that may hold with equality."""
    k = len(contrast)
    subsets = [contrast[list(s)] for n in range(k + 1) for s in combinations(range(k), n)]
    return [s for s in subsets if not len(s) or np.linalg.matrix_rank(s) == len(s)]


def nearest(b: np.ndarray, v: np.ndarray, contrast: np.ndarray) -> np.ndarray:
    """For each row of b the point nearest to it, in the metric of v's inverse, at which contrast @ point >= 0.

    Constraints are few, so each face is tried: the nearest feasible one of the projections on all faces is the answer.
    """
    metric = np.linalg.pinv(v)
    best, cost = np.zeros_like(b), np.full(len(b), np.inf)
    for face in faces(contrast):
        point = b if not len(face) else b - (v @ face.T @ np.linalg.pinv(face @ v @ face.T) @ (face @ b.T)).T
        feasible = (point @ contrast.T >= -1e-9).all(axis=1)
        own = np.einsum("ij,jk,ik->i", b - point, metric, b - point)
        better = feasible & (own < cost)
        best[better], cost[better] = point[better], own[better]
    return best


def reach(points: np.ndarray, node: int) -> np.ndarray:
    """The larger of what a pattern gains up to its node (from 0) and from there to its end."""
    return np.maximum(np.abs(points[:, node]), np.abs(points[:, node] - points[:, -1]))


def trend(result: Result, cfg: Config, patterns: dict[str, tuple[np.ndarray, int]], draws: int = 100, seed: int = 2) -> DataFrame:
    """taxon, pattern (the best fitting), lfc and se (arrays over the group's coefficients), W, p, q, diff.

    ``patterns``: by name, the constraints (rows, each times the coefficients at least 0) and the node, from 0. A taxon
    with a missing coefficient or covariance has a null W and a p-value of 1.
    """
    d, cols = result.design, sorted(result.design.group_columns)
    k, size, eye = len(cols), len(d.columns), np.eye(len(cols))

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                b, v = block_of(row, size, cols)
                if not (np.isfinite(b).all() and np.isfinite(v).all()):
                    rows.append((row.taxon, None, None, None, None, 1.0))
                    continue
                fitted = {name: nearest(b[None, :], v, c) for name, (c, _) in patterns.items()}
                gain = {name: float(reach(fitted[name], node)[0]) for name, (_, node) in patterns.items()}
                pick = max(gain, key=gain.get)
                null, se = seeded(row.taxon, seed).standard_normal((draws, k)), np.sqrt(np.diag(v))
                w_null = np.max([reach(nearest(null, eye, c) * se, node) for c, node in patterns.values()], axis=0)
                rows.append((row.taxon, pick, fitted[pick][0].tolist(), se.tolist(), gain[pick], float((w_null > gain[pick]).mean())))
            yield pd.DataFrame(rows, columns=["taxon", "pattern", "lfc", "se", "W", "p"])

    schema = "taxon string, pattern string, lfc array<double>, se array<double>, W double, p double"
    tested = group_blocks(result.primary, result.vcov, d).mapInPandas(run, schema)
    return adjust(tested, "p", [], "taxon", cfg.p_adjust).withColumn("diff", F.col("q") <= cfg.alpha)
