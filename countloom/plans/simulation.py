"""Simulated count tables with known effects, and how well an analysis recovers them.

A grid of cells times replicates is a table; each of its rows is simulated by the task that holds it, seeded by cell and
replicate, so a retried task makes the same counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Setting:
    """What is the same for all cells."""

    seed: int = 1
    abundance_sd: float = 1.0
    dispersion: float = 2.0
    confounder: float = 0.3


FACTORS = {"n_taxa": "int", "n_samp": "int", "da_proportion": "double", "log_fc": "double", "zero_inflation": "double", "lib_mean": "double", "lib_cv": "double", "confound": "boolean"}


def grid(spark: SparkSession, reps: int, **levels) -> DataFrame:
    """cell, rep and a column for each factor: every combination of the levels given, ``reps`` times."""
    if missing := [f for f in FACTORS if not levels.get(f)]:
        raise ValueError(f"no level of {missing[0]}")
    cells = [(k, *values) for k, values in enumerate(product(*(levels[f] for f in FACTORS)))]
    table = spark.createDataFrame(cells, "cell int, " + ", ".join(f"{f} {t}" for f, t in FACTORS.items()))
    return table.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition("cell", "rep")


def effects(cell, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Baseline log abundances and each taxon's direction (-1, 0, 1): the same in all replicates of a cell."""
    rng = np.random.default_rng([setting.seed, int(cell.cell)])
    mu = rng.normal(0, setting.abundance_sd, cell.n_taxa)
    direction = np.zeros(cell.n_taxa, int)
    own = rng.permutation(cell.n_taxa)[: int(round(cell.da_proportion * cell.n_taxa))]
    direction[own] = rng.choice([-1, 1], len(own))
    return mu, direction


def replicate(cell, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """Counts (taxa by samples) and each sample's group (0, 1): negative binomial around log-normal library sizes, with
    cells set to zero at random; in a confounded cell labelled taxa have no effect but more zeros in the first group."""
    mu, direction = effects(cell, setting)
    rng = np.random.default_rng([setting.seed, int(cell.cell), 1 + int(cell.rep)])
    group = (np.arange(cell.n_samp) >= cell.n_samp // 2).astype(int)
    spread = np.log1p(cell.lib_cv**2)
    library = rng.lognormal(np.log(cell.lib_mean) - spread / 2, np.sqrt(spread), cell.n_samp)
    fold = np.zeros(cell.n_taxa) if cell.confound else cell.log_fc * direction
    raw = np.exp(mu[:, None] + fold[:, None] * group)
    mean = library * raw / raw.sum(axis=0)
    zero = np.full(mean.shape, float(cell.zero_inflation))
    if cell.confound:
        zero[np.ix_(direction != 0, group == 0)] += setting.confounder
    n = rng.poisson(rng.gamma(setting.dispersion, mean / setting.dispersion))
    n[rng.random(mean.shape) < np.minimum(zero, 1)] = 0
    return n, group


def taxon_names(n: int) -> list[str]:
    return [f"taxon{i:05}" for i in range(n)]


def simulate(cells: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """cell, rep, taxon, sample, grp (control, treated), n: all non-zero counts of each replicate."""

    def run(batches):
        for pdf in batches:
            for cell in pdf.itertuples():
                n, group = replicate(cell, setting)
                i, j = np.nonzero(n)
                yield pd.DataFrame({"cell": cell.cell, "rep": cell.rep, "taxon": np.array(taxon_names(cell.n_taxa))[i], "sample": np.array([f"sample{k:04}" for k in range(cell.n_samp)])[j], "grp": np.array(["control", "treated"])[group[j]], "n": n[i, j].astype(float)})

    return cells.mapInPandas(run, "cell int, rep int, taxon string, sample string, grp string, n double")


def truth(cells: DataFrame, setting: Setting = Setting()) -> DataFrame:
    """cell, rep, taxon, is_da, has_effect, confounded, direction, log_fc."""

    def run(batches):
        for pdf in batches:
            for cell in pdf.itertuples():
                _, direction = effects(cell, setting)
                labelled, real = direction != 0, not cell.confound
                yield pd.DataFrame({"cell": cell.cell, "rep": cell.rep, "taxon": taxon_names(cell.n_taxa), "is_da": labelled, "has_effect": labelled & real, "confounded": labelled & (not real), "direction": direction, "log_fc": direction * cell.log_fc * real})

    return cells.mapInPandas(run, "cell int, rep int, taxon string, is_da boolean, has_effect boolean, confounded boolean, direction int, log_fc double")


def recovery(results: DataFrame, known: DataFrame, *by: str) -> DataFrame:
    """Per group of ``by`` (cell, rep): fdr, power, f1, jaccard, sign concordance, bias, rmse and mae of the effects.

    ``results``: by, taxon, lfc, diff; ``known``: as ``truth`` returns. Ratios without cases are null.
    """
    rows = results.join(known, [*by, "taxon"])
    effect, called, err = F.col("has_effect"), F.coalesce(F.col("diff"), F.lit(False)), F.col("lfc") - F.col("log_fc")
    counts = rows.groupBy(*by).agg(
        F.count_if(effect & called).alias("tp"),
        F.count_if(~effect & called).alias("fp"),
        F.count_if(effect & ~called).alias("fn"),
        F.count_if(effect & (F.signum("lfc") == F.signum("log_fc"))).alias("hits"),
        F.count_if(F.col("confounded") & called).alias("confounded_called"),
        F.count_if("confounded").alias("confounded"),
        F.avg(err).alias("bias"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
    )
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return counts.select(*by, share(fp, tp + fp).alias("fdr"), share(tp, tp + fn).alias("power"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(tp, tp + fp + fn).alias("jaccard"), share(F.col("hits"), tp + fn).alias("sign_concordance"), share(F.col("confounded_called"), F.col("confounded")).alias("confounded_rate"), "bias", "rmse", "mae", "tp", "fp", "fn")


def pooled(recovered: DataFrame, *by: str) -> DataFrame:
    """Fdr and power over all replicates of a cell, from pooled counts, each with its binomial standard error."""
    sums = recovered.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.count("*").alias("reps"))

    def with_se(part, whole, name):
        p = F.try_divide(part.cast("double"), whole.cast("double"))
        return p.alias(name), F.sqrt(F.try_divide(p * (1 - p), whole.cast("double"))).alias(f"{name}_se")

    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return sums.select(*by, "reps", *with_se(fp, tp + fp, "fdr"), *with_se(tp, tp + fn, "power"))
