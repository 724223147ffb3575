"""Log-linear fits of all taxa at once, in passes over a table with a row for each sample.

A row holds a sample's design values and its observed responses, as long as the taxa are many, so no row is as long as the
study. What a pass returns is summed by taxon before and after the shuffle. A sample's bias follows from the coefficients
of all taxa and its own row, so biases are never collected: they are recomputed within a pass, or a table by sample. On
the driver, and broadcast, are only the coefficients: a row a taxon. Covariates are centred and scaled inside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.functions.kernels import ginv, gram_pivots
from countloom.plans.formula import Frame
from countloom.sources.shared import batches_of, kept

#: So many responses go to Python at a time.
BATCH_CELLS = 1_000_000
#: Degrees of freedom of a taxon without a fit.
NO_FIT = 999.0


@dataclass
class Sheets:
    """``rows``: sample, x (centred), whole, level, at (numbers of taxa), y. ``basis``: x times it is the design's row."""

    rows: DataFrame
    frame: Frame
    taxa: list[str]
    basis: np.ndarray
    gram: np.ndarray
    n_samples: int

    @property
    def p(self) -> int:
        return len(self.frame.columns)

    def batches(self):
        return batches_of(self.rows.sparkSession, max(1, BATCH_CELLS // max(1, len(self.taxa))))


def basis_of(frame: Frame, gram: np.ndarray) -> np.ndarray:
    """The design in terms of centred, scaled covariates; without an intercept they are scaled only."""
    basis = np.eye(len(gram))
    for j in frame.numeric:
        n = gram[0, 0] if frame.intercept else 1.0
        mean = gram[0, j] / n if frame.intercept and n else 0.0
        spread = gram[j, j] / n - mean**2 if n else 0.0
        basis[j, j] = np.sqrt(spread) if spread > 0 else 1.0
        if frame.intercept and j:
            basis[0, j] = mean
    return basis


def centred_rows(frame: Frame, basis: np.ndarray) -> DataFrame:
    """The design's rows in terms of centred, scaled covariates."""
    inverse = np.linalg.inv(basis)
    x = F.array(*(sum((F.get("x", F.lit(i)) * float(inverse[i, j]) for i in range(len(basis)) if inverse[i, j]), F.lit(0.0)) for j in range(len(basis))))
    return frame.rows.withColumn("x", x)


def sheets(logs: DataFrame, frame: Frame, gram: np.ndarray, n_samples: int) -> Sheets:
    """``logs``: taxon, sample, y; responses that are null or of samples outside the design are left out."""
    spark = logs.sparkSession
    seen = logs.where("y IS NOT NULL")
    taxa = sorted(r.taxon for r in seen.select("taxon").distinct().collect())  # a name a taxon
    numbers = spark.createDataFrame(list(zip(taxa, range(len(taxa)), strict=True)), "taxon string, k int")
    basis = basis_of(frame, gram)
    cells = seen.join(F.broadcast(numbers), "taxon").groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("k", "y"))).alias("cells"))
    rows = cells.join(centred_rows(frame, basis), "sample")
    rows = rows.select("sample", "x", "whole", "level", F.col("cells.k").alias("at"), F.col("cells.y").alias("y"))
    return Sheets(kept(rows, "sheets"), frame, taxa, basis, gram, n_samples)


def count_sheets(counts: DataFrame, frame: Frame, gram: np.ndarray, n_samples: int, basis: np.ndarray | None = None, keep: tuple[str, ...] = ()) -> Sheets:
    """Sheets whose responses are the counts themselves (nan: missing), with a row for every sample of the design. ``counts``:
    taxon, sample, n, of samples of the design. They pass the shuffle once, whatever is made of them by ``log_sheets``.
    ``keep``: columns of the frame to carry along."""
    taxa = sorted(r.taxon for r in counts.where("taxon IS NOT NULL").select("taxon").distinct().collect())  # a name a taxon
    numbers = counts.sparkSession.createDataFrame(list(zip(taxa, range(len(taxa)), strict=True)), "taxon string, k int")
    basis = basis_of(frame, gram) if basis is None else basis
    own = counts.select("taxon", "sample", F.coalesce(F.col("n").cast("double"), F.lit(float("nan"))).alias("y"))
    cells = own.join(F.broadcast(numbers), "taxon").groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("k", "y"))).alias("cells"))
    rows = centred_rows(frame, basis).join(cells, "sample", "left")
    at, y = F.coalesce("cells.k", F.array().cast("array<int>")), F.coalesce("cells.y", F.array().cast("array<double>"))
    rows = rows.select("sample", "x", "whole", "level", *keep, at.alias("at"), y.alias("y"))
    return Sheets(kept(rows, "counts-by-sample"), frame, taxa, basis, gram, n_samples)


def logs_of(n: np.ndarray, pseudo: float) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(n + pseudo > 0, np.log(n + pseudo), np.nan)


def log_sheets(c: Sheets, pseudo: float) -> Sheets:
    """Sheets of the logs of counts, less their taxon's mean over all samples; a positive pseudo-count is added to every cell,
    those of absent taxa too. Rows stay where they are: nothing is shuffled but sums by taxon. Taxa without a log go."""

    def first(b: Batch) -> np.ndarray:
        new = np.ones(len(b.at), bool)
        new[1:] = (b.row[1:] != b.row[:-1]) | (b.at[1:] != b.at[:-1])
        return new

    def own(b: Batch, total: np.ndarray) -> None:
        y = logs_of(b.y, pseudo)
        ok = np.isfinite(y)
        add(total, 0, b.at, first(b).astype(float))
        add(total, 1, b.at[ok], np.ones(int(ok.sum())))
        add(total, 2, b.at[ok], y[ok])

    sums = np.zeros((len(c.taxa), 3))
    with c.batches():
        for r in by_taxon(c, 3, own).where("k >= 0").collect():  # a row a taxon
            sums[r.k] = [r.v0, r.v1, r.v2]
    absent = (c.n_samples - sums[:, 0]) * (pseudo > 0)
    observed = sums[:, 1] + absent
    with np.errstate(all="ignore"):
        mean = (sums[:, 2] + absent * (np.log(pseudo) if pseudo > 0 else 0.0)) / observed
    number, taxa, p = numbers_of(observed > 0), len(c.taxa), c.p

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                b = Batch(batch, p)
                row, at, y = b.row, b.at, logs_of(b.y, pseudo)
                if pseudo > 0:
                    there = np.zeros((batch.num_rows, taxa), bool)
                    there[row, at] = True
                    zero_row, zero_at = np.nonzero(~there)
                    row, at, y = np.append(row, zero_row), np.append(at, zero_at), np.append(y, np.full(len(zero_row), np.log(pseudo)))
                    order = np.argsort(row * taxa + at, kind="stable")
                    row, at, y = row[order], at[order], y[order]
                yield with_cells(batch, row, at, y - mean[at], np.isfinite(y), number)

    with c.batches():
        rows = kept(c.rows.mapInArrow(run, c.rows.schema), "sheets")
    return replace(c, rows=rows, taxa=[t for t, k in zip(c.taxa, number, strict=True) if k >= 0])


def numbers_of(stay: np.ndarray) -> np.ndarray:
    """New numbers of the taxa that stay; -1 of the others."""
    return np.where(stay, np.cumsum(stay) - 1, -1)


def with_cells(batch: pa.RecordBatch, row: np.ndarray, at: np.ndarray, y: np.ndarray, use: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """The batch with other cells, in order of rows: those in use whose taxon has a number."""
    use = use & (number[at] >= 0)
    ends = pa.array(np.append(0, np.cumsum(np.bincount(row[use], minlength=batch.num_rows))).astype(np.int32))
    new = {"at": pa.array(number[at[use]].astype(np.int32)), "y": pa.array(y[use])}
    columns = [pa.ListArray.from_arrays(ends, new[c]) if c in new else batch.column(c) for c in batch.schema.names]
    return pa.RecordBatch.from_arrays(columns, batch.schema.names)


def only_taxa(s: Sheets, names: set[str]) -> Sheets:
    """The sheets without the cells of other taxa; rows stay, without a cell too."""
    number, p = numbers_of(np.array([t in names for t in s.taxa], bool)), s.p

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                b = Batch(batch, p)
                yield with_cells(batch, b.row, b.at, b.y, np.ones(len(b.at), bool), number)

    with s.batches():
        return replace(s, rows=kept(s.rows.mapInArrow(run, s.rows.schema), "sheets"), taxa=[t for t in s.taxa if t in names])


class Batch:
    """Arrays of a batch of rows: x (0 where missing) and whole by row; row, taxon and response by cell."""

    def __init__(self, batch: pa.RecordBatch, p: int):
        x = batch.column("x")
        self.x = np.nan_to_num(x.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(x), p)
        self.whole = batch.column("whole").to_numpy(zero_copy_only=False)
        self.level = batch.column("level").to_numpy()
        self.at = batch.column("at").flatten().to_numpy()
        self.y = batch.column("y").flatten().to_numpy()
        self.row = np.repeat(np.arange(len(x)), batch.column("at").value_lengths().to_numpy())
        self.samples = batch.column("sample")
        self.theta = batch.column("theta").to_numpy(zero_copy_only=False) if "theta" in batch.schema.names else np.zeros(len(x))

    def fitted(self, beta: np.ndarray) -> np.ndarray:
        """0 for samples with a missing covariate; nan for taxa without a fit."""
        out = np.einsum("ij,ij->i", self.x[self.row], np.nan_to_num(beta)[self.at]) * self.whole[self.row]
        out[~np.isfinite(beta).any(axis=1)[self.at]] = np.nan
        return out

    def mean_rest(self, fitted: np.ndarray) -> np.ndarray:
        """By sample, the mean over taxa of the response less its fit; nan where there is none."""
        rest = self.y - fitted
        ok = np.isfinite(rest)
        count = np.bincount(self.row[ok], minlength=len(self.x))
        with np.errstate(all="ignore"):
            return np.bincount(self.row[ok], rest[ok], minlength=len(self.x)) / count

    def biases(self, beta: np.ndarray | None) -> np.ndarray:
        return self.theta if beta is None else self.mean_rest(self.fitted(beta))


def by_taxon(s: Sheets, width: int, own: Callable[[Batch, np.ndarray], float | None]) -> DataFrame:
    """k, v0, v1, ...: sums by taxon of what ``own`` adds to a task's array (taxa x width); its numbers add up at k = -1."""
    names = [f"v{j}" for j in range(width)]
    p, taxa = s.p, len(s.taxa)

    def run(batches):
        total, other, seen = np.zeros((taxa, width)), 0.0, np.zeros(taxa, bool)
        for batch in batches:
            if batch.num_rows:
                b = Batch(batch, p)
                seen[b.at] = True
                other += own(b, total) or 0.0
        at = np.flatnonzero(seen)
        columns = [np.append(total[at, j], other if j == 0 else 0.0) for j in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), *map(pa.array, columns)], ["k", *names])

    return s.rows.mapInArrow(run, "k int, " + ", ".join(f"{c} double" for c in names)).groupBy("k").agg(*(F.sum(c).alias(c) for c in names))


def add(total: np.ndarray, column: int, at: np.ndarray, weights: np.ndarray) -> None:
    total[:, column] += np.bincount(at, weights, minlength=len(total))


def solver(gram: np.ndarray, used: float, seen_levels: np.ndarray, group_columns: dict[int, int], has_group: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """The matrix that gives a taxon's coefficients from its X'y, which coefficients are missing, and degrees of freedom.

    Full rank: least squares. Otherwise contrasts of levels that aren't observed, and of the lowest observed one, are
    dropped and are 0, other dependent columns missing. A taxon seen in one level only has no coefficient.
    """
    p = len(gram)
    none = (np.zeros((p, p)), np.ones(p, bool), NO_FIT)
    if not used:
        return none
    kept = gram_pivots(gram)
    dropped: list[int] = []
    if len(kept) < p:
        if has_group:
            seen = np.flatnonzero(seen_levels)
            if len(seen) < 2:
                return none
            dropped = [j for j, k in group_columns.items() if k not in seen or k == seen[0]]
        kept = gram_pivots(gram, columns=[j for j in range(p) if j not in dropped])
        if not kept:
            return none
    out = np.zeros((p, p))
    scale = 1 / np.sqrt(np.diag(gram)[kept])
    out[np.ix_(kept, kept)] = scale[:, None] * np.linalg.inv(gram[np.ix_(kept, kept)] * scale[:, None] * scale) * scale
    return out, np.array([j not in kept and j not in dropped for j in range(p)]), float(used - len(kept))


def solvers(s: Sheets) -> DataFrame:
    """k, solver (p x p, in a row), missing, dof of each taxon: its pattern of observed samples settled once."""
    p, levels, group_columns = s.p, len(s.frame.group_levels), s.frame.group_columns
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def own(b: Batch, total: np.ndarray) -> None:
        use = b.whole[b.row] & np.isfinite(b.theta)[b.row]
        at, row = b.at[use], b.row[use]
        for c, (i, j) in enumerate(pairs):
            add(total, c, at, (b.x[:, i] * b.x[:, j])[row])
        add(total, len(pairs), at, np.ones(len(at)))
        for k in range(levels):
            add(total, len(pairs) + 1 + k, at, (b.level == k)[row].astype(float))

    def solve(batches):
        for pdf in batches:
            out, known = [], {}
            for r in pdf.itertuples(index=False):
                values = np.nan_to_num(np.array(r[1:], float))
                if (key := values.tobytes()) not in known:
                    gram = np.zeros((p, p))
                    for c, (i, j) in enumerate(pairs):
                        gram[i, j] = gram[j, i] = values[c]
                    known[key] = solver(gram, values[len(pairs)], values[len(pairs) + 1 :], group_columns, levels > 0)
                m, missing, dof = known[key]
                out.append((r[0], m.reshape(-1).tolist(), missing.tolist(), dof))
            yield pd.DataFrame(out, columns=["k", "solver", "missing", "dof"])

    every = s.rows.sparkSession.range(len(s.taxa)).select(F.col("id").cast("int").alias("k"))
    sums = every.join(by_taxon(s, len(pairs) + 1 + levels, own), "k", "left")
    with s.batches():
        return kept(sums.mapInPandas(solve, "k int, solver array<double>, missing array<boolean>, dof double"), "solvers")


def fit(s: Sheets, known: DataFrame, last: np.ndarray | None, before: np.ndarray | None) -> tuple[np.ndarray, float]:
    """The coefficients (taxa x p, nan: missing) of y less the biases that follow from the coefficients ``last`` (None: the
    rows' theta, or 0), and the squared change of these biases since ``before``."""
    p = s.p

    def own(b: Batch, total: np.ndarray) -> float:
        theta = b.biases(last)
        value = b.y - theta[b.row]
        use = b.whole[b.row] & np.isfinite(value)
        for j in range(p):
            add(total, j, b.at[use], b.x[b.row[use], j] * value[use])
        return 0.0 if last is None else float(np.nansum((theta - b.biases(before)) ** 2))

    def solve(batches):
        for pdf in batches:
            m = np.array(pdf["solver"].tolist(), float).reshape(-1, p, p)
            beta = np.einsum("kij,kj->ki", m, pdf[[f"v{j}" for j in range(p)]].to_numpy(float))
            beta[np.array(pdf["missing"].tolist(), bool).reshape(-1, p)] = np.nan
            out = pd.DataFrame(beta, columns=[f"b{j}" for j in range(p)])
            out.insert(0, "k", pdf["k"].to_numpy())
            yield out

    sums = by_taxon(s, p, own)
    other = sums.where("k = -1").select("k", *(F.col(f"v{j}").alias(f"b{j}") for j in range(p)))
    solved = sums.where("k >= 0").join(known, "k").mapInPandas(solve, "k int, " + ", ".join(f"b{j} double" for j in range(p)))
    with s.batches():
        got = solved.unionByName(other).toPandas()  # a row a taxon
    beta = np.full((len(s.taxa), p), np.nan)
    rows = got[got["k"] >= 0]
    beta[rows["k"]] = rows.iloc[:, 1:].to_numpy(float)
    return beta, float(got.loc[got["k"] == -1, "b0"].sum())


def iterate(s: Sheets, known: DataFrame, tol: float, most: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Coefficients after the last round and of the one before it (zero biases' if there is one round), and each round's
    change of coefficients and biases."""
    beta, _ = fit(s, known, None, None)
    before, trace, moved = None, [], 0.0
    while True:
        # The round's biases follow from its coefficients; their change is found while the next ones are fitted.
        new, change = fit(s, known, beta, before)
        trace.append(float(np.sqrt(moved + change)))
        if trace[-1] <= tol or len(trace) >= most:
            return beta, before, trace
        moved = float(((np.nan_to_num(new - beta) @ np.linalg.inv(s.basis).T) ** 2).sum())
        before, beta = beta, new


def estimates(s: Sheets, known: DataFrame, beta: np.ndarray, after: np.ndarray | None, missing: float | None = 0.1) -> DataFrame:
    """taxon, beta, vcov (row by row), dof. Residuals are those of ``beta`` and of the biases that follow from ``after`` (None:
    the rows' theta). A sample without a residual adds ``missing`` to every cell of the sandwich's middle; None: nothing."""
    p, taxa, n = s.p, s.taxa, s.n_samples
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    basis, back, bread = s.basis, np.linalg.inv(s.basis), ginv(s.gram)

    def own(b: Batch, total: np.ndarray) -> None:
        rest = b.y - b.fitted(beta) - b.biases(after)[b.row]
        use = np.isfinite(rest) & b.whole[b.row]
        at, row, square = b.at[use], b.row[use], rest[use] ** 2
        for c, (i, j) in enumerate(pairs):
            add(total, c, at, (b.x[:, i] * b.x[:, j])[row] * square)
        add(total, len(pairs), at, np.ones(len(at)))

    def finish(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                k, values = r.k, np.nan_to_num([getattr(r, f"v{c}") for c in range(len(pairs) + 1)])
                middle = np.zeros((p, p))
                for c, (i, j) in enumerate(pairs):
                    middle[i, j] = middle[j, i] = values[c]
                middle = basis.T @ middle @ basis + (missing or 0.0) * (n - values[len(pairs)])
                own_beta = unscaled(back, beta[k])
                out.append((taxa[k], [None if np.isnan(v) else float(v) for v in own_beta], (bread @ middle @ bread).reshape(-1).tolist(), r.dof))
            yield pd.DataFrame(out, columns=["taxon", "beta", "vcov", "dof"])

    sums = by_taxon(s, len(pairs) + 1, own)
    with s.batches():
        return kept(known.select("k", "dof").join(sums, "k", "left").mapInPandas(finish, "taxon string, beta array<double>, vcov array<double>, dof double"), "fit")


def unscaled(back: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Coefficients of the design from those of its centred form (one taxon's or a row each); missing ones stay missing and
    count as 0 for the intercept."""
    return np.where(np.isnan(beta), np.nan, np.nan_to_num(beta) @ back.T)


def with_biases(s: Sheets, beta: np.ndarray) -> Sheets:
    """The rows with theta: the mean over taxa of y less the fit of ``beta`` (of the design itself), whose missing
    coefficients, and missing covariates, count as 0."""
    p, held, scale, shift = s.p, np.nan_to_num(beta), np.diag(s.basis), s.basis[0] * (np.arange(s.p) > 0)
    names = s.rows.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                b = Batch(batch, p)
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
                x = np.nan_to_num(x * scale + (x[:, :1] * shift if p else 0.0))
                theta = b.mean_rest(np.einsum("ij,ij->i", x[b.row], held[b.at]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(theta, from_pandas=True)], [*names, "theta"])

    with s.batches():
        return replace(s, rows=kept(s.rows.mapInArrow(run, T.StructType([*s.rows.schema.fields, T.StructField("theta", T.DoubleType())])), "biases"))


def theta_of(s: Sheets) -> DataFrame:
    """sample, theta for every sample of the design; null where no taxon is observed."""
    return s.frame.rows.select("sample").join(s.rows.select("sample", "theta"), "sample", "left")
