"""The whole analysis: screens, bias-corrected log-linear fits, tests.

Counts stay long and distributed, fits are passes over a table by sample (``sheets``); what meets on the driver has a row
for each taxon, coefficient or group level.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.functions.dist import chi2_tails, f_tails, t_two_sided
from countloom.functions.kernels import Mixture, bias_mixture, ginv
from countloom.functions.padjust import adjust
from countloom.operators import screens, transforms
from countloom.plans.formula import Design, Frame, check_identifiable, frame, parse
from countloom.plans.sheets import Sheets, count_sheets, estimates, fit, iterate, log_sheets, only_taxa, sheets, solvers, theta_of, unscaled, with_biases
from countloom.sources.counts import densify
from countloom.sources.results import checked
from countloom.sources.shared import kept


@dataclass(frozen=True)
class Config:
    formula: str
    group: str | None = None
    p_adjust: str = "holm"
    pseudo: float = 0.0
    prv_cut: float = 0.1
    lib_cut: float = 0.0
    s0_perc: float = 0.05
    struc_zero: bool = False
    neg_lb: bool = False
    alpha: float = 0.05
    global_test: bool = False
    pairwise: bool = False
    tol: float = 0.01
    max_iter: int = 20
    em_tol: float = 1e-5
    em_max_iter: int = 100
    fwer: str = "holm"
    #: The sandwich skips missing cells (else each adds 0.1 to every entry), and a p-value of 0 stays 0 in pairwise tests.
    strict: bool = False


@dataclass
class Result:
    primary: DataFrame
    vcov: DataFrame
    theta: DataFrame
    zeros: DataFrame | None
    design: Frame
    mixtures: dict[str, Mixture]
    epsilons: list[float]
    warnings: list[str] = field(default_factory=list)
    global_test: DataFrame | None = None
    pairwise: DataFrame | None = None
    corrected: DataFrame | None = None
    table: DataFrame | None = None
    samples: DataFrame | None = None
    #: Seconds of each stage, as the driver waits for it.
    seconds: dict[str, float] = field(default_factory=dict)


class Stopwatch:
    """Seconds between calls, by stage."""

    def __init__(self):
        self.seconds: dict[str, float] = {}
        self.at = time.perf_counter()

    def stage(self, name: str) -> None:
        now = time.perf_counter()
        self.seconds[name] = self.seconds.get(name, 0.0) + now - self.at
        self.at = now


def packed(logs: DataFrame, d: Design, center: bool = False) -> DataFrame:
    """taxon, at (sample numbers), y: the observed responses of a taxon, in one row (as long as the study has samples); with
    ``center`` less their mean, of the samples that the design leaves out too."""
    order = logs.sparkSession.createDataFrame([(s, k) for k, s in enumerate(d.samples)], "sample string, k int")
    own = logs.where("y IS NOT NULL").join(F.broadcast(order), "sample", "left" if center else "inner")
    row = F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "y"))))
    rows = own.groupBy("taxon").agg(row.alias("cells"), F.avg("y").alias("mean"))
    y = F.transform("cells.y", lambda v: v - F.col("mean")) if center else F.col("cells.y")
    return rows.select("taxon", F.col("cells.k").alias("at"), y.alias("y"))


#: Cells of a dense block of taxa: what a task holds at a time is a few such blocks, however many samples there are.
BLOCK_CELLS = 4_000_000


def blocks(batches, n: int):
    """Batches of taxa in slices whose dense form has ``BLOCK_CELLS`` cells or fewer, or one taxon."""
    for pdf in batches:
        step = max(1, BLOCK_CELLS // max(1, n))
        for at in range(0, len(pdf), step):
            yield pdf.iloc[at : at + step].reset_index(drop=True)


def responses(pdf: pd.DataFrame, n: int) -> np.ndarray:
    y = np.full((len(pdf), n), np.nan)
    for i, (at, v) in enumerate(zip(pdf["at"], pdf["y"], strict=True)):
        y[i, at] = v
    return y


def long_estimates(est: DataFrame, d: Frame) -> DataFrame:
    """taxon, coef, j, lfc, variance, dof."""
    p = len(d.columns)
    names = F.array(*map(F.lit, d.columns))
    own = est.select("taxon", "vcov", "dof", F.posexplode("beta").alias("j", "lfc"))
    return own.select("taxon", F.get(names, F.col("j")).alias("coef"), "j", "lfc", F.get("vcov", F.col("j") * (p + 1)).alias("variance"), "dof")


def mixtures(long: DataFrame, columns: list[str], tol: float, most: int) -> dict[str, Mixture]:
    """The bias mixture of each coefficient: one task for each, which holds two numbers a taxon."""

    def run(pdf):
        order = pdf.sort_values("taxon")
        m = bias_mixture(order["lfc"].to_numpy(float), order["variance"].to_numpy(float), tol, most)
        return pd.DataFrame([[order["coef"].iloc[0], *m.pi, m.delta, m.l1, m.l2, m.kappa1, m.kappa2, m.rounds, m.delta_wls, m.var_delta]], columns=["coef", *names])

    names = ["pi0", "pi1", "pi2", "delta", "l1", "l2", "kappa1", "kappa2", "rounds", "delta_wls", "var_delta"]
    schema = "coef string, " + ", ".join(f"{c} {'int' if c == 'rounds' else 'double'}" for c in names)
    found = {r.coef: Mixture(np.array([r.pi0, r.pi1, r.pi2]), *(np.nan if r[c] is None else r[c] for c in names[3:])) for r in long.groupBy("coef").applyInPandas(run, schema).collect()}
    return {c: found[c] for c in columns if c in found}


@F.pandas_udf(T.DoubleType())
def t_test(w: pd.Series, dof: pd.Series) -> pd.Series:
    """The two-sided p-value of w; 1 where w is missing."""
    return pd.Series(t_two_sided(w.to_numpy(float), dof.to_numpy(float))).fillna(1.0)


@F.pandas_udf(T.DoubleType())
def normal_test(w: pd.Series) -> pd.Series:
    """The two-sided p-value of w under the normal distribution."""
    return pd.Series(t_two_sided(w.to_numpy(float), np.inf))


def variance_chain(long: DataFrame, var_delta: DataFrame, s0_perc: float) -> DataFrame:
    """Adds the variance of the bias, then the regulariser s0 (a quantile over taxa): taxon, coef, j, lfc, se, W, dof."""
    own = long.join(F.broadcast(var_delta), "coef")
    raised = own.withColumn("variance", F.col("variance") + F.col("vd") + 2 * F.sqrt(F.col("variance") * F.col("vd")))
    s0 = raised.groupBy("coef").agg(F.percentile("variance", F.lit(s0_perc)).alias("s0"))
    se = F.when(F.col("lfc").isNotNull(), F.sqrt(F.col("variance") + F.col("s0")))
    return raised.join(F.broadcast(s0), "coef").withColumn("se", se).select("taxon", "coef", "j", "lfc", "se", (F.col("lfc") / F.col("se")).alias("W"), "dof")


def primary_test(chain: DataFrame, method: str, alpha: float) -> DataFrame:
    tested = chain.withColumn("p", t_test("W", "dof"))
    return adjust(tested, "p", ["coef"], "taxon", method).withColumn("diff", F.col("q") <= alpha)


def group_blocks(result: DataFrame, est: DataFrame, d: Frame) -> DataFrame:
    """taxon, b, v (the group's coefficients and covariance, with the final variances on its diagonal), dof."""
    rows = result.groupBy("taxon").agg(F.sort_array(F.collect_list(F.struct("j", "lfc", "se"))).alias("own"), F.first("dof").alias("dof"))
    return rows.join(est.select("taxon", "vcov"), "taxon").select("taxon", F.col("own.lfc").alias("b"), F.col("own.se").alias("se"), "vcov", "dof")


def global_test(result: DataFrame, est: DataFrame, d: Frame, method: str, alpha: float) -> DataFrame:
    """taxon, W, p, q, diff: whether any of the group's coefficients differs from zero."""
    p, cols = len(d.columns), sorted(d.group_columns)

    def run(batches):
        for pdf in batches:
            stat, prob = np.full(len(pdf), np.nan), np.full(len(pdf), 1.0)
            for i, (b, se, v, dof) in enumerate(zip(pdf["b"], pdf["se"], pdf["vcov"], pdf["dof"], strict=True)):
                v = np.array(v, float).reshape(p, p).copy()
                np.fill_diagonal(v, np.array(se, float) ** 2)
                b, block = np.array(b, float)[cols], v[np.ix_(cols, cols)]
                if np.isfinite(b).all() and np.isfinite(block).all():
                    stat[i] = b @ ginv(block) @ b
                    tails = f_tails(stat[i], len(cols), dof) if np.isfinite(dof) else chi2_tails(stat[i], len(cols))
                    prob[i] = min(1.0, 2 * float(min(tails)))
            yield pd.DataFrame({"taxon": pdf["taxon"], "W": stat, "p": prob})

    tested = group_blocks(result, est, d).mapInPandas(run, "taxon string, W double, p double")
    tested = tested.withColumn("W", F.when(~F.isnan("W"), F.col("W")))
    return adjust(tested, "p", [], "taxon", method).withColumn("diff", F.col("q") <= alpha)


def pairwise_test(result: DataFrame, est: DataFrame, d: Frame, method: str, alpha: float, strict: bool = False) -> DataFrame:
    """taxon, contrast, lfc, se, W, p, q, diff: each level against the first and against each other, the mixed directional
    false discovery rate held: taxa that pass a global screen are adjusted within themselves. Without any such taxon
    every q is 1."""
    p, cols = len(d.columns), sorted(d.group_columns)
    names = [d.columns[j] for j in cols]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    labels = names + [f"{names[j]}_{names[i]}" for i, j in pairs]

    def run(batches):
        for pdf in batches:
            rows = []
            for taxon, b, se, v, dof in zip(pdf["taxon"], pdf["b"], pdf["se"], pdf["vcov"], pdf["dof"], strict=True):
                v = np.array(v, float).reshape(p, p).copy()
                np.fill_diagonal(v, np.array(se, float) ** 2)
                b, block = np.array(b, float)[cols], v[np.ix_(cols, cols)]
                lfc = np.append(b, [b[j] - b[i] for i, j in pairs])
                var = np.append(np.diag(block), [block[j, j] + block[i, i] - 2 * block[i, j] for i, j in pairs])
                with np.errstate(all="ignore"):
                    se_all = np.where(var > 0, np.sqrt(np.maximum(var, 0)), np.nan)
                    w = lfc / se_all
                prob = np.where(np.isnan(w), 1.0, t_two_sided(w, dof))
                rows += zip([taxon] * len(labels), labels, lfc, se_all, w, prob, strict=True)
            yield pd.DataFrame(rows, columns=["taxon", "contrast", "lfc", "se", "W", "p"])

    tested = group_blocks(result, est, d).mapInPandas(run, "taxon string, contrast string, lfc double, se double, W double, p double")
    screen = global_test(result, est, d, "bh", alpha).select("taxon", F.col("diff").alias("screened"))
    return within_taxa(tested, screen, len(labels), method, alpha, strict)


def within_taxa(tested: DataFrame, screen: DataFrame, tests: int, method: str, alpha: float, strict: bool = False) -> DataFrame:
    """p is 1 for taxa that fail the screen (taxon, screened); q is adjusted within each taxon, for as many tests as a
    taxon has times the share of taxa that pass. Unless ``strict``, a p-value of exactly 0 becomes 1, as in published results."""
    sizes = screen.agg(F.count("*").alias("taxa"), F.count_if("screened").alias("r")).first()
    counts = F.col("screened") if strict else F.col("screened") & (F.col("p") != 0)
    own = tested.join(screen, "taxon").withColumn("p", F.when(counts, F.col("p")).otherwise(1.0)).drop("screened")
    if not sizes.r:
        return own.withColumn("q", F.lit(1.0)).withColumn("diff", F.lit(False))
    return adjust(own, "p", ["taxon"], "contrast", method, n=F.lit(tests * sizes.taxa / sizes.r), short=True).withColumn("diff", F.col("q") <= alpha)


def centred(counts: DataFrame, samples: DataFrame, pseudo: float) -> DataFrame:
    """The centred log table; only a positive pseudo-count asks for the absent cells."""
    logs = log_table(counts, samples, pseudo)
    return transforms.center(kept(logs, "dense") if pseudo > 0 else logs)  # read twice


@dataclass
class Prepared:
    """What runs share whose configurations differ in the pseudo-count only: screened tables, the design, counts by sample."""

    first: DataFrame
    second: DataFrame
    samples: DataFrame
    zeros: DataFrame | None
    warnings: list[str]
    counts: Sheets


def prepare(counts: DataFrame, samples: DataFrame, cfg: Config) -> Prepared:
    formula = parse(cfg.formula)
    counts, samples = kept(counts, "counts"), kept(samples, "samples")  # each is read many times
    warnings = checked(counts, samples)[1]
    if cfg.group:
        warnings += screens.check_groups(samples, cfg.group)
    zeros = None
    if cfg.struc_zero:
        if not cfg.group:
            raise ValueError("structural zeros need a group")
        zeros = kept(screens.structural_zeros(counts, samples.select("sample", F.col(cfg.group).alias("grp")), cfg.neg_lb), "zeros")
    # Every counted sample has covariates: ``checked`` raises otherwise.
    o1, o2 = screens.two_tables(counts, samples.count(), zeros, cfg.prv_cut, cfg.lib_cut)
    own = samples if cfg.lib_cut <= 0 else samples.join(screens.library_size(o1).where(F.col("size") >= cfg.lib_cut).select("sample"), "sample", "left_semi")
    d = frame(own, formula, cfg.group)
    gram, _, every = check_identifiable(d)
    return Prepared(o1, o2, own, zeros, warnings, count_sheets(o1, d, gram, every))


def analyze(counts: DataFrame, samples: DataFrame, cfg: Config, ready: Prepared | None = None) -> Result:
    """``counts``: taxon, sample, n. ``samples``: sample and covariates; a null group is no group. ``ready``: what ``prepare``
    gave for them and a configuration that differs from ``cfg`` in the pseudo-count at most."""
    spark: SparkSession = counts.sparkSession
    watch = Stopwatch()
    ready = ready or prepare(counts, samples, cfg)
    o2, own, zeros, warnings, d = ready.second, ready.samples, ready.zeros, list(ready.warnings), ready.counts.frame
    missing = None if cfg.strict else 0.1
    s1 = log_sheets(ready.counts, cfg.pseudo)
    watch.stage("preprocess")
    known = solvers(s1)
    watch.stage("pattern_grouping")
    beta1, _, trace = iterate(s1, known, cfg.tol, cfg.max_iter)
    watch.stage("mle1")
    est1 = estimates(s1, known, beta1, beta1, missing)
    watch.stage("sandwich1")
    mix = mixtures(long_estimates(est1, d), d.columns, cfg.em_tol, cfg.em_max_iter)
    delta = np.array([mix[c].delta if c in mix else 0.0 for c in d.columns])
    watch.stage("em")
    s1 = with_biases(s1, unscaled(np.linalg.inv(s1.basis), beta1) - delta)
    theta = theta_of(s1)
    if lost := theta.where("theta IS NULL").count():
        warnings.append(f"the biases of {lost} samples can't be estimated: too few counts")
    s2 = s1
    if zeros is not None:
        s2 = only_taxa(s1, {r.taxon for r in o2.select("taxon").distinct().collect()})  # a name a taxon
    watch.stage("correction")
    if zeros is not None or lost:  # else the same samples are observed as before
        known = solvers(s2)
    beta2, _ = fit(s2, known, None, None)
    watch.stage("mle2")
    est2 = estimates(s2, known, beta2, None, missing)
    watch.stage("sandwich2")
    vd = spark.createDataFrame([(c, mix[c].var_delta if c in mix else 0.0) for c in d.columns], "coef string, vd double")
    chain = variance_chain(long_estimates(est2, d), vd, cfg.s0_perc)
    primary = kept(primary_test(chain, cfg.p_adjust, cfg.alpha), "primary")
    watch.stage("tests")
    theta_table = theta
    wide = cfg.group is not None and len(d.group_levels) >= 3
    return Result(
        primary=primary,
        vcov=est2,
        theta=theta_table,
        zeros=zeros,
        design=d,
        mixtures=mix,
        epsilons=trace,
        warnings=warnings,
        global_test=global_test(primary, est2, d, cfg.p_adjust, cfg.alpha) if cfg.global_test and wide else None,
        pairwise=pairwise_test(primary, est2, d, cfg.fwer, cfg.alpha, cfg.strict) if cfg.pairwise and wide else None,
        corrected=transforms.subtract_by_sample(transforms.center(log_table(o2, own, cfg.pseudo)), theta_table),
        table=o2,
        samples=own,
        seconds=watch.seconds,
    )


@dataclass
class PlainResult:
    primary: DataFrame
    theta: DataFrame
    zeros: DataFrame | None
    mixtures: dict[str, Mixture]


def analyze_plain(counts: DataFrame, samples: DataFrame, cfg: Config, conserve: bool = False) -> PlainResult:
    """The earlier form of the analysis: one table, a pseudo-count for all cells, normal tests, no regulariser.

    Structural zeros stay in the table; where a level differs from the group's first in being one, se, p and q of its
    coefficient are 0 and it is called different.
    """
    spark: SparkSession = counts.sparkSession
    counts, samples = kept(counts, "counts"), kept(samples, "samples")  # each is read many times
    screened = screens.library_filter(screens.prevalence_filter(counts, samples.count(), cfg.prv_cut), cfg.lib_cut)
    own = samples if cfg.lib_cut <= 0 else samples.join(screened.select("sample").distinct(), "sample", "left_semi")
    d = frame(own, parse(cfg.formula), cfg.group)
    gram, _, every = check_identifiable(d)
    t = sheets(kept(log_table(screened, own, cfg.pseudo), "logs"), d, gram, every)
    known = solvers(t)
    beta, _, _ = iterate(t, known, cfg.tol, cfg.max_iter)
    est = estimates(t, known, beta, beta, None if cfg.strict else 0.1)
    long = long_estimates(est, d)
    mix = mixtures(long, d.columns, cfg.em_tol, cfg.em_max_iter)
    bias = spark.createDataFrame([(c, float(m.delta), float(m.var_delta)) for c, m in mix.items()], "coef string, delta double, vd double")
    v = F.col("variance") + F.col("vd") + 2 * F.sqrt(F.col("variance") * F.col("vd")) if conserve else F.col("variance")
    table = long.join(F.broadcast(bias), "coef").select("taxon", "coef", (F.col("lfc") - F.col("delta")).alias("lfc"), F.sqrt(v).alias("se"))
    table = table.withColumn("W", F.try_divide("lfc", "se")).withColumn("p", normal_test("W"))
    table = adjust(table.withColumn("p", F.when(~F.isnan("p"), F.col("p"))), "p", ["coef"], "taxon", cfg.p_adjust)
    zeros = None
    if cfg.struc_zero:
        if not cfg.group:
            raise ValueError("structural zeros need a group")
        zeros = kept(screens.structural_zeros(counts, samples.select("sample", F.col(cfg.group).alias("grp")), cfg.neg_lb), "zeros")
        names = spark.createDataFrame([(d.columns[j], d.group_levels[k]) for j, k in d.group_columns.items()], "coef string, grp string")
        first = zeros.where(F.col("grp") == d.group_levels[0]).select("taxon", F.col("is_zero").alias("base"))
        marks = zeros.join(F.broadcast(names), "grp").join(first, "taxon").where("is_zero <> base").select("taxon", "coef", F.lit(True).alias("apart"))
        table = table.join(marks, ["taxon", "coef"], "left")
        table = table.withColumns({c: F.when(F.col("apart"), 0.0).otherwise(F.col(c)) for c in ("se", "p", "q")}).drop("apart")
    primary = table.withColumn("diff", F.coalesce(F.col("q") <= cfg.alpha, F.lit(False)))
    delta = np.array([mix[c].delta if c in mix else 0.0 for c in d.columns])
    theta = theta_of(with_biases(t, unscaled(np.linalg.inv(t.basis), beta) - delta))
    return PlainResult(primary, theta, zeros, mix)


def log_table(counts: DataFrame, samples: DataFrame, pseudo: float) -> DataFrame:
    """The log table as it is."""
    return transforms.log_counts(densify(counts, samples) if pseudo > 0 else counts, pseudo)
