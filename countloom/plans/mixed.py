"""The analysis with a random term: restricted likelihood fits of every taxon, iterated with the samples' biases.

Cells stand by sample (``sheets``) and stay where they are. Of a taxon's cells in one group of the random term only sums are
needed (``functions.mixed``), made in passes over these rows; with one random effect per group, groups of one size are
summed again, so that a taxon's task has a row for each size, not for each group. Biases are recomputed within a pass.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.functions.dist import t_two_sided
from countloom.functions.kernels import Mixture
from countloom.functions.mixed import Sums, effects, mixed_fit, ratio_test
from countloom.functions.padjust import adjust
from countloom.operators import screens, transforms
from countloom.plans.analysis import Config, Result, group_blocks, log_table, mixtures, primary_test, variance_chain, within_taxa
from countloom.plans.formula import Frame, RandomTerm, check_identifiable, frame, parse, parse_random
from countloom.plans.sheets import BATCH_CELLS, Batch, Sheets, count_sheets, log_sheets, only_taxa, theta_of, with_biases
from countloom.sources.results import checked
from countloom.sources.shared import batches_of, kept

FIT = "taxon string, beta array<double>, vcov array<double>, dofs array<double>, factor array<double>, sigma2 double, fitted boolean"


def random_frame(samples: DataFrame, cfg: Config, term: RandomTerm) -> tuple[Frame, int]:
    """The design with the random term's group and z (an array), and the number of random effects of a group. A sample is
    whole if it has these too."""
    kinds = {f.name: f.dataType for f in samples.schema.fields}
    if missing := [v for v in (term.group, *term.slopes) if v not in kinds]:
        raise ValueError(f"no such covariate: {missing[0]}")
    if odd := [v for v in term.slopes if isinstance(kinds[v], T.StringType)]:
        raise ValueError(f"{odd[0]} can't have slopes: it isn't numeric")
    z = F.array(*([F.lit(1.0)] if term.intercept else []), *(F.col(v).cast("double") for v in term.slopes))
    d = frame(samples.withColumn("_subject", F.col(term.group).cast("string")).withColumn("_z", z), parse(cfg.formula), cfg.group, ("_subject", "_z"))
    whole = F.col("whole") & F.col("_subject").isNotNull() & F.forall("_z", lambda v: v.isNotNull())
    return replace(d, rows=d.rows.withColumn("whole", whole)), int(term.intercept) + len(term.slopes)


def dot(a: str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b) if isinstance(b, str) else b, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)


def group_sums(cells: DataFrame, p: int, q: int) -> DataFrame:
    """taxon, subject, n, full, zz (half), zv: sums of products over a taxon's cells in a group. ``cells``: taxon, y, x, z,
    subject of complete samples."""
    v = [F.get("x", F.lit(j)) for j in range(p)] + [F.col("y")]
    z = [F.get("z", F.lit(i)) for i in range(q)]
    total = lambda pairs: F.array(*(F.sum(a * b) for a, b in pairs))
    return cells.groupBy("taxon", "subject").agg(
        F.count("*").cast("double").alias("n"),
        total([(v[i], v[j]) for i in range(p + 1) for j in range(i, p + 1)]).alias("full"),
        total([(z[i], z[j]) for i in range(q) for j in range(i, q)]).alias("zz"),
        total([(z[i], v[j]) for i in range(q) for j in range(p + 1)]).alias("zv"),
    )


def class_sums(groups: DataFrame, p: int, q: int) -> DataFrame:
    """taxon, n, times, full, zz, zv, outer: for one random effect, sums over groups of one zz; else the groups as they are."""
    none = F.lit(None).cast("array<double>")
    if q > 1:
        return groups.select("taxon", "n", F.lit(1.0).alias("times"), "full", "zz", "zv", none.alias("outer"))
    k = (p + 1) * (p + 2) // 2
    each = [F.get("zv", F.lit(i)) * F.get("zv", F.lit(j)) for i in range(p + 1) for j in range(i, p + 1)]
    sums = groups.groupBy("taxon", "zz").agg(F.sum("n").alias("n"), F.count("*").cast("double").alias("times"), F.array(*(F.sum(F.get("full", F.lit(c))) for c in range(k))).alias("full"), F.array(*map(F.sum, each)).alias("outer"))
    return sums.select("taxon", "n", "times", "full", "zz", none.alias("zv"), "outer")


def squared(half: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from their upper halves, one a row."""
    out = np.zeros((len(half), size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = out[:, j, i] = half
    return out


def sums_of(pdf: pd.DataFrame, p: int, q: int) -> Sums:
    stacked = lambda c: np.array(pdf[c].tolist(), float)
    outer = squared(stacked("outer"), p + 1) if q == 1 else None
    return Sums(float(pdf["n"].sum()), float(pdf["times"].sum()), squared(stacked("full").sum(axis=0)[None], p + 1)[0], squared(stacked("zz"), q), None if q == 1 else stacked("zv").reshape(-1, q, p + 1), outer, pdf["times"].to_numpy(float))


def fits(classes: DataFrame, p: int, q: int, dof: bool) -> DataFrame:
    """A fit for each taxon, in a task of its own rows. Taxa that can't be fitted have null coefficients."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = mixed_fit(sums_of(pdf, p, q), dof=dof)
        taxon = pdf["taxon"].iloc[0]
        if found is None:
            return pd.DataFrame([(taxon, [None] * p, [None] * (p * p), [999.0] * p, [0.0] * (q * q), None, False)], columns=[c.split()[0] for c in FIT.split(", ")])
        return pd.DataFrame([(taxon, found.beta.tolist(), found.vcov.reshape(-1).tolist(), found.dof.tolist(), found.factor.reshape(-1).tolist(), found.sigma2, True)], columns=[c.split()[0] for c in FIT.split(", ")])

    return classes.groupBy("taxon").applyInPandas(run, FIT)


def predicted(groups: DataFrame, fitted: DataFrame, p: int, q: int) -> DataFrame:
    """taxon, subject, u: each group's random effects in each fitted taxon."""

    def run(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), q))
            zz, zv = squared(np.array(pdf["zz"].tolist(), float).reshape(len(pdf), -1), q), np.array(pdf["zv"].tolist(), float).reshape(-1, q, p + 1)
            for _, at in pdf.groupby("taxon").indices.items():
                one = pdf.iloc[at[0]]
                out[at] = effects(np.array(one["factor"], float).reshape(q, q), np.array(one["beta"], float), zz[at], zv[at])
            yield pd.DataFrame({"taxon": pdf["taxon"], "subject": pdf["subject"], "u": out.tolist()})

    own = groups.select("taxon", "subject", "zz", "zv").join(fitted.where("fitted").select("taxon", "beta", "factor"), "taxon")
    return own.mapInPandas(run, "taxon string, subject string, u array<double>")


def table_of(logs: DataFrame, d: Frame) -> DataFrame:
    """taxon, sample, y, x, z, subject, whole: the observed cells of the design's samples."""
    rows = d.rows.select("sample", "x", F.col("_z").alias("z"), F.col("_subject").alias("subject"), "whole")
    return kept(logs.where("y IS NOT NULL").join(rows, "sample"), "cells")


def shifted(cells: DataFrame, theta: DataFrame | None) -> DataFrame:
    return cells if theta is None else cells.join(theta, "sample").withColumn("y", F.col("y") - F.col("theta")).drop("theta").where("y IS NOT NULL")


#: So many sums a task holds before it hands them on.
HELD_SUMS = 4_000_000


def rows_of(cells: DataFrame, d: Frame, p: int) -> Sheets:
    """The cells of a table by sample."""
    taxa = sorted(r.taxon for r in cells.select("taxon").distinct().collect())  # a name a taxon
    numbers = cells.sparkSession.createDataFrame(list(zip(taxa, range(len(taxa)), strict=True)), "taxon string, k int")
    own = cells.join(F.broadcast(numbers), "taxon").groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("k", "y"))).alias("cells"), *(F.first(c).alias(c) for c in ("x", "z", "subject", "whole")))
    rows = own.select("sample", "x", "whole", F.lit(-1).alias("level"), F.col("z").alias("_z"), F.col("subject").alias("_subject"), F.col("cells.k").alias("at"), F.col("cells.y").alias("y"))
    return Sheets(kept(rows, "sheets"), d, taxa, np.eye(p), np.eye(p), 0)


def round_biases(b: Batch, batch: pa.RecordBatch, z: np.ndarray, beta: np.ndarray, name: str) -> np.ndarray:
    """By sample, the mean over fitted taxa of the response less its fit with random effects, which stand in column ``name``
    beside their taxa's numbers (``uk``). A sample that a taxon's fit leaves out has a fit of 0 there."""
    taxa, q = len(beta), z.shape[1]
    u = np.zeros((batch.num_rows, taxa, q))
    at = batch.column("uk")
    row = np.repeat(np.arange(batch.num_rows), np.nan_to_num(at.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
    u[row, at.flatten().to_numpy()] = np.nan_to_num(batch.column(name).flatten().flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, q)
    return b.mean_rest(b.fitted(beta) + np.einsum("ij,ij->i", z[b.row], u[b.row, b.at]) * b.whole[b.row])


def sums_by_group(s: Sheets, q: int, rounds: list[tuple[np.ndarray, DataFrame]]) -> DataFrame:
    """``group_sums`` of responses less biases, from rows by sample, and beside them the squared change of the biases (taxon
    null). Biases follow from the last of ``rounds`` (coefficients by taxon, random effects by taxon and subject), their
    change from the one before it too; without rounds they are the rows' theta, or 0."""
    p, taxa, names = s.p, len(s.taxa), s.taxa
    pairs, halves = [(i, j) for i in range(p + 1) for j in range(i, p + 1)], [(i, j) for i in range(q) for j in range(i, q)]
    width = 1 + len(pairs) + len(halves) + q * (p + 1)
    rows, betas = s.rows, [beta for beta, _ in rounds]
    if rounds:
        numbers = s.rows.sparkSession.createDataFrame(list(zip(names, range(taxa), strict=True)), "taxon string, k int")
        effects_of = [u.withColumnRenamed("u", f"u{k}") for k, (_, u) in enumerate(rounds)]
        both = effects_of[0] if len(rounds) == 1 else effects_of[0].join(effects_of[1], ["taxon", "subject"], "full")
        none = F.array_repeat(F.lit(0.0), q)
        own = both.join(F.broadcast(numbers), "taxon").groupBy("subject").agg(F.collect_list(F.struct("k", *(F.coalesce(f"u{k}", none).alias(f"u{k}") for k in range(len(rounds))))).alias("own"))
        by_subject = kept(own.select(F.col("subject").alias("_subject"), F.col("own.k").alias("uk"), *(F.col(f"own.u{k}").alias(f"u{k}") for k in range(len(rounds)))), "effects")
        rows = rows.join(by_subject, "_subject", "left")

    def run(batches):
        held: dict[str, np.ndarray] = {}
        change = 0.0

        def out():
            who = list(held)
            sums = np.array([held[w] for w in who]).reshape(len(who), taxa, width)
            i, k = np.nonzero(sums[:, :, 0])
            own = pa.RecordBatch.from_arrays([pa.array([names[j] for j in k], pa.string()), pa.array([who[j] for j in i], pa.string()), *(pa.array(sums[i, k, c]) for c in range(width))], ["taxon", "subject", *(f"v{c}" for c in range(width))])
            held.clear()
            return own

        for batch in batches:
            if not batch.num_rows:
                continue
            b = Batch(batch, p)
            b.whole = np.array(b.whole, bool)
            z = np.zeros((batch.num_rows, q))
            z[b.whole] = np.array(batch.column("_z").filter(pa.array(b.whole)).to_pylist(), float).reshape(-1, q)
            theta = b.theta
            if betas:
                every = [round_biases(b, batch, z, beta, f"u{k}") for k, beta in enumerate(betas)]
                theta = every[-1]
                change += float(np.nansum((theta - (every[0] if len(every) > 1 else 0.0)) ** 2))
            value = b.y - theta[b.row]
            use = b.whole[b.row] & np.isfinite(value)
            at, row = b.at[use], b.row[use]
            who, home = np.unique(np.array(["" if w is None else w for w in batch.column("_subject").to_pylist()], object).astype(str), return_inverse=True)
            cell, size = home[row] * taxa + at, len(who) * taxa
            x = b.x[row]
            v = [*(x[:, j] for j in range(p)), value[use]]
            zz = [z[row, i] for i in range(q)]
            columns = [np.ones(len(row)), *(v[i] * v[j] for i, j in pairs), *(zz[i] * zz[j] for i, j in halves), *(zz[i] * v[j] for i in range(q) for j in range(p + 1))]
            sums = np.stack([np.bincount(cell, c, minlength=size) for c in columns], axis=1).reshape(len(who), taxa, width)
            for w, own in zip(who.tolist(), sums, strict=True):
                held[w] = held[w] + own if w in held else own
            if len(held) * taxa * width > HELD_SUMS:
                yield out()
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), *(pa.array([change if c == 0 else 0.0]) for c in range(width))], ["taxon", "subject", *(f"v{c}" for c in range(width))])

    own = [F.sum(f"v{c}").alias(f"v{c}") for c in range(width)]
    found = rows.mapInArrow(run, "taxon string, subject string, " + ", ".join(f"v{c} double" for c in range(width))).groupBy("taxon", "subject").agg(*own)
    at = np.cumsum([1, len(pairs), len(halves), q * (p + 1)])
    part = lambda lo, hi: F.array(*(F.col(f"v{c}") for c in range(lo, hi)))
    with batches_of(rows.sparkSession, max(1, BATCH_CELLS // (8 * max(1, taxa)))):
        return kept(found.select("taxon", "subject", F.col("v0").alias("n"), part(at[0], at[1]).alias("full"), part(at[1], at[2]).alias("zz"), part(at[2], at[3]).alias("zv")), "groups")


def coefficients(found: DataFrame, s: Sheets) -> np.ndarray:
    """Taxa x p; nan where a taxon has no fit."""
    number, beta = {t: k for k, t in enumerate(s.taxa)}, np.full((len(s.taxa), s.p), np.nan)
    for r in found.select("taxon", "beta").collect():  # a row a taxon
        beta[number[r.taxon]] = [np.nan if v is None else v for v in r.beta]
    return beta


def rounds_of(s: Sheets, q: int, tol: float, most: int) -> tuple[DataFrame, list[tuple[np.ndarray, DataFrame]], list[float]]:
    """The last round's fits, the last two rounds (the later one last), and each round's change of coefficients and biases.
    A round is a pass over rows by sample: biases are recomputed within it, so no cell is shuffled."""
    held, fitted, trace, moved = [], None, [], 0.0
    while True:
        groups = sums_by_group(s, q, held)
        if held:
            # The round's biases follow from its fits; their change is found while the next sums are made.
            trace.append(float(np.sqrt(moved + (groups.where("taxon IS NULL").agg(F.sum("n")).first()[0] or 0.0))))
            if trace[-1] <= tol or len(trace) >= most:
                return fitted, held, trace
        groups = groups.where("taxon IS NOT NULL")
        fitted = kept(fits(class_sums(groups, s.p, q), s.p, q, dof=False), "fits")
        beta = coefficients(fitted, s)
        moved = float(np.nansum((beta - held[-1][0]) ** 2)) if held else 0.0
        held = [*held[-1:], (beta, kept(predicted(groups, fitted, s.p, q), "predicted"))]


def iterate(cells: DataFrame, p: int, q: int, tol: float, most: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """``rounds_of`` the cells of ``table_of``: the last round's fits, the biases after it (sample, theta), and the changes."""
    s = rows_of(cells, Frame(cells, [""] * p, []), p)
    now, held, trace = rounds_of(s, q, tol, most)
    beta, effects_of = now.where("fitted").select("taxon", "beta"), held[-1][1]
    fitted = cells.join(beta, "taxon").join(effects_of, ["taxon", "subject"], "left")
    value = F.when(F.col("whole"), dot("x", "beta") + F.coalesce(dot("z", "u"), F.lit(0.0))).otherwise(0.0)
    return now, kept(fitted.groupBy("sample").agg(F.avg(F.col("y") - value).alias("theta")), "biases"), trace


def long_fits(found: DataFrame, columns: list[str]) -> DataFrame:
    """taxon, coef, j, lfc, variance, dof: as of the analysis, with degrees of freedom of each coefficient's own."""
    p, names = len(columns), F.array(*map(F.lit, columns))
    own = found.select("taxon", "vcov", "dofs", F.posexplode("beta").alias("j", "lfc"))
    return own.select("taxon", F.get(names, F.col("j")).alias("coef"), "j", "lfc", F.get("vcov", F.col("j") * (p + 1)).alias("variance"), F.get("dofs", F.col("j")).alias("dof"))


def group_columns_in(d: Frame, group: str) -> list[int]:
    """Columns of every term that has the group."""
    return [j for j, c in enumerate(d.columns) if any(part == f"{group}{level}" for part in c.split(":") for level in d.group_levels)]


def likelihood_ratio_test(classes: DataFrame, d: Frame, q: int, group: str, method: str, alpha: float) -> DataFrame:
    """taxon, W, p, q, diff: twice the log likelihood ratio of the models with and without the group's columns, both fitted
    by full likelihood in one pass over a taxon's sums, against chi-squared."""
    p, dropped = len(d.columns), group_columns_in(d, group)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, prob = ratio_test(sums_of(pdf, p, q), dropped)
        return pd.DataFrame([(pdf["taxon"].iloc[0], None if np.isnan(w) else w, prob)], columns=["taxon", "W", "p"])

    tested = kept(classes.groupBy("taxon").applyInPandas(run, "taxon string, W double, p double"), "ratios")
    return adjust(tested, "p", [], "taxon", method).withColumn("diff", F.col("q") <= alpha)


def pairwise_test(primary: DataFrame, est: DataFrame, d: Frame, screen: DataFrame, method: str, alpha: float, strict: bool) -> DataFrame:
    """As the pairwise test of the analysis, screened by the likelihood ratio. A difference of two levels has the smaller of
    their degrees of freedom."""
    p, cols = len(d.columns), sorted(d.group_columns)
    names = [d.columns[j] for j in cols]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    labels = names + [f"{names[j]}_{names[i]}" for i, j in pairs]

    def run(batches):
        for pdf in batches:
            rows = []
            for taxon, b, se, v, dofs in zip(pdf["taxon"], pdf["b"], pdf["se"], pdf["vcov"], pdf["dofs"], strict=True):
                v, dofs = np.array(v, float).reshape(p, p).copy(), np.array(dofs, float)[cols]
                np.fill_diagonal(v, np.array(se, float) ** 2)
                b, block = np.array(b, float)[cols], v[np.ix_(cols, cols)]
                lfc = np.append(b, [b[j] - b[i] for i, j in pairs])
                var = np.append(np.diag(block), [block[j, j] + block[i, i] - 2 * block[i, j] for i, j in pairs])
                with np.errstate(all="ignore"):
                    se_all = np.where(var > 0, np.sqrt(np.maximum(var, 0)), np.nan)
                    w = lfc / se_all
                prob = t_two_sided(w, np.append(dofs, [min(dofs[i], dofs[j]) for i, j in pairs]))
                rows += zip([taxon] * len(labels), labels, lfc, se_all, w, np.where(np.isnan(w), 1.0, prob), strict=True)
            yield pd.DataFrame(rows, columns=["taxon", "contrast", "lfc", "se", "W", "p"])

    blocks = group_blocks(primary, est, d).drop("dof").join(est.select("taxon", "dofs"), "taxon")
    tested = blocks.mapInPandas(run, "taxon string, contrast string, lfc double, se double, W double, p double")
    return within_taxa(tested, screen.select("taxon", F.col("diff").alias("screened")), len(labels), method, alpha, strict)


def mixed_fits(logs: DataFrame, samples: DataFrame, cfg: Config, random: str, theta: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Frame, int]:
    """The fits of each taxon of ``logs`` (taxon, sample, y) less the biases ``theta``, the sums that they need, the design
    and the number of random effects of a group."""
    d, q = random_frame(samples, cfg, parse_random(random))
    check_identifiable(d)
    p = len(d.columns)
    classes = kept(class_sums(group_sums(shifted(table_of(logs, d), theta).where("whole"), p, q), p, q), "sums")
    return kept(fits(classes, p, q, dof=True), "fits"), classes, d, q


def analyze_mixed(counts: DataFrame, samples: DataFrame, cfg: Config, random: str) -> Result:
    """The analysis with ``random``, e.g. ``(1 | subject)``, beside the formula's fixed terms. The global test is the
    likelihood ratio's, pairwise tests are screened by it. Taxa that can't be fitted have null estimates and p-values of 1."""
    spark, term = counts.sparkSession, parse_random(random)
    counts, samples = kept(counts, "counts"), kept(samples, "samples")
    warnings = checked(counts, samples)[1]
    if cfg.group:
        warnings += screens.check_groups(samples, cfg.group)
    zeros = None
    if cfg.struc_zero:
        if not cfg.group:
            raise ValueError("structural zeros need a group")
        zeros = kept(screens.structural_zeros(counts, samples.select("sample", F.col(cfg.group).alias("grp")), cfg.neg_lb), "zeros")
    o1, o2 = screens.two_tables(counts, samples.count(), zeros, cfg.prv_cut, cfg.lib_cut)
    own = samples if cfg.lib_cut <= 0 else samples.join(screens.library_size(o1).where(F.col("size") >= cfg.lib_cut).select("sample"), "sample", "left_semi")
    d, q = random_frame(own, cfg, term)
    check_identifiable(d)
    p = len(d.columns)
    s1 = log_sheets(count_sheets(o1, d, np.eye(p), own.count(), np.eye(p), ("_z", "_subject")), cfg.pseudo)
    first, held, trace = rounds_of(s1, q, cfg.tol, cfg.max_iter)
    mix: dict[str, Mixture] = mixtures(long_fits(first, d.columns), d.columns, cfg.em_tol, cfg.em_max_iter)
    delta = np.array([mix[c].delta if c in mix else 0.0 for c in d.columns])
    s1 = with_biases(s1, held[-1][0] - delta)
    theta = theta_of(s1)
    if lost := theta.where("theta IS NULL").count():
        warnings.append(f"the biases of {lost} samples can't be estimated: too few counts")
    s2 = s1 if zeros is None else only_taxa(s1, {r.taxon for r in o2.select("taxon").distinct().collect()})  # a name a taxon
    classes = kept(class_sums(sums_by_group(s2, q, []).where("taxon IS NOT NULL"), p, q), "sums")
    est = kept(fits(classes, p, q, dof=True), "fits")
    vd = spark.createDataFrame([(c, mix[c].var_delta if c in mix else 0.0) for c in d.columns], "coef string, vd double")
    primary = kept(primary_test(variance_chain(long_fits(est, d.columns), vd, cfg.s0_perc), cfg.p_adjust, cfg.alpha), "primary")
    wide = cfg.group is not None and len(d.group_levels) >= 3
    screen = likelihood_ratio_test(classes, d, q, cfg.group, "bh", cfg.alpha) if cfg.pairwise and wide else None
    return Result(
        primary=primary,
        vcov=est,
        theta=theta,
        zeros=zeros,
        design=d,
        mixtures=mix,
        epsilons=trace,
        warnings=warnings,
        global_test=likelihood_ratio_test(classes, d, q, cfg.group, cfg.p_adjust, cfg.alpha) if cfg.global_test and wide else None,
        pairwise=pairwise_test(primary, est, d, screen, cfg.fwer, cfg.alpha, cfg.strict) if screen is not None else None,
        corrected=transforms.subtract_by_sample(transforms.center(log_table(o2, own, cfg.pseudo)), theta),
        table=o2,
        samples=own,
    )
