"""Tests of all log-ratios: how many other taxa each taxon differs from.

A log-ratio's fit follows from sums over samples: of the design's products with itself, with the ratio, and of the ratio's
square. They add up inside tasks from a row a sample, so neither the driver nor a task holds the study's samples.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countloom.functions.dist import f_tails, t_two_sided
from countloom.functions.kernels import gram_pivots
from countloom.functions.padjust import adjust
from countloom.operators import screens
from countloom.plans.analysis import kept
from countloom.plans.formula import Frame, frame, moments, parse
from countloom.plans.sheets import Batch, Sheets, count_sheets, sheets

CUTOFFS = (0.9, 0.8, 0.7, 0.6)
#: Bytes of the sums of pairs that a task holds.
SUM_BYTES = 256 << 20
#: A pair is summed again, value by value, where the squares of its residuals are less than this share of the taxa's.
UNSURE = 1e-6


def tested_design(samples: DataFrame, main: str, adjust_for: str | None) -> Frame:
    """The design of a test of ``main``; samples with a covariate that is missing or no finite number aren't whole."""
    f = frame(samples, parse(main if not adjust_for else f"{main} + {adjust_for}"), main if isinstance(samples.schema[main].dataType, T.StringType) else None)
    finite = F.transform("x", lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v))
    f.rows = f.rows.withColumn("x", finite).withColumn("whole", F.forall("x", lambda v: v.isNotNull()))
    return f


class Sums:
    """Names and places of a pair's sums, over the samples of the design that have both taxa: their number, products of the
    design's columns, their products with the ratio y (of b less a), its square, and the taxa's squares."""

    def __init__(self, p: int):
        self.p = p
        self.pairs = [(i, j) for i in range(p) for j in range(i, p)]
        self.names = ["n", *(f"g{i}_{j}" for i, j in self.pairs), *(f"v{j}" for j in range(p)), "vv", "squares"]
        self.xy, self.vv = 1 + len(self.pairs), 1 + len(self.pairs) + p

    def gram(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros((self.p, self.p))
        for c, (i, j) in enumerate(self.pairs):
            out[i, j] = out[j, i] = values[1 + c]
        return out


def summed(s: Sheets, p: int, names: list[str], own: Callable, dense: Callable) -> DataFrame:
    """i, j and sums by pair. ``own`` makes an adder and a closing from nothing: the adder takes x, y (nan: missing; of samples
    that aren't whole too) and whole of a batch, the closing gives i, j and the sums, a row each."""

    def run(batches):
        add, close = own()
        for batch in batches:
            if batch.num_rows:
                b = Batch(batch, p)
                add(b.x, dense(b), b.whole)
        i, j, sums = close()
        for part in np.array_split(np.arange(len(i)), max(1, len(i) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(i[part].astype(np.int32)), pa.array(j[part].astype(np.int32)), *(pa.array(c[part]) for c in sums)], ["i", "j", *names])

    rows = s.rows.coalesce(max(1, s.rows.sparkSession.sparkContext.defaultParallelism)) if len(s.taxa) > 200 else s.rows
    return rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names))


def pair_sums(s: Sheets, z: Sums, dense: Callable, block: int) -> DataFrame:
    """i, j (numbers of taxa, i < j) and ``z``'s sums. Where i = j, n is the number of samples that have the taxon, whole or
    not. Blocks of taxa, of ``block`` or fewer, take a pass each."""
    taxa, p, width = len(s.taxa), z.p, len(z.names)
    step = max(1, min(block, SUM_BYTES // (8 * (width + 2) * max(1, taxa))))

    def of(lo: int, hi: int):
        def own():
            total, shared, seen = np.zeros((width, hi - lo, taxa)), np.zeros(z.xy), np.zeros(taxa)

            def add(x, y, whole):
                there = np.isfinite(y)
                seen[:] += there.sum(axis=0)
                x, y, there = x[whole], y[whole], there[whole]
                every = there.all(axis=1)
                if every.any():  # samples that have all taxa add the same to all pairs' design
                    u, v = x[every], y[every]
                    shared[0] += len(u)
                    for c, (i, j) in enumerate(z.pairs):
                        shared[1 + c] += u[:, i] @ u[:, j]
                    xy, square = u.T @ v, np.einsum("ij,ij->j", v, v)
                    total[z.xy : z.vv] += xy[:, None, :] - xy[:, lo:hi, None]
                    total[z.vv] -= 2 * (v[:, lo:hi].T @ v)
                    total[z.vv + 1] += square[None, :] + square[lo:hi, None]
                if not every.all():
                    u, m = x[~every], there[~every].astype(float)
                    v = np.where(m > 0, y[~every], 0.0)
                    left, low = m[:, lo:hi].T.copy(), v[:, lo:hi].T.copy()
                    total[0] += left @ m
                    for c, (i, j) in enumerate(z.pairs):
                        total[1 + c] += (left * (u[:, i] * u[:, j])) @ m
                    for j in range(p):
                        total[z.xy + j] += (left * u[:, j]) @ v - (low * u[:, j]) @ m
                    total[z.vv] -= 2 * (low @ v)
                    total[z.vv + 1] += left @ (v * v) + (low * low) @ m

            def close():
                total[z.vv] += total[z.vv + 1]
                total[: z.xy] += shared[:, None, None]
                i, j = np.nonzero(np.arange(lo, hi)[:, None] <= np.arange(taxa))
                sums = [total[c][i, j] for c in range(width)]
                sums[0] = np.where(i + lo == j, seen[j], sums[0])
                return i + lo, j, sums

            return add, close

        return summed(s, p, z.names, own, dense)

    found = reduce(DataFrame.unionByName, [of(lo, min(taxa, lo + step)) for lo in range(0, max(1, taxa), step)])
    return found.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in z.names))


def fits(z: Sums, rows: np.ndarray, known: dict) -> tuple[np.ndarray, list]:
    """Each pair's effects (the ratio along the design's columns, each less those before it) and what gives them from the
    products; nan and None where samples are too few or columns depend on each other."""
    effects, inverses = np.full((len(rows), z.p), np.nan), []
    for k, values in enumerate(rows):
        key = values[: z.xy].tobytes()
        if key not in known:
            gram = z.gram(values)
            full = values[0] > z.p and len(gram_pivots(gram)) == z.p
            known[key] = np.linalg.inv(np.linalg.cholesky(gram)) if full else None
        inverses.append(known[key])
        if known[key] is not None:
            effects[k] = known[key] @ values[z.xy : z.vv]
    return effects, inverses


def again(s: Sheets, z: Sums, dense: Callable, left: np.ndarray) -> DataFrame:
    """i, j, ``z``'s sums and rss of the pairs ``left`` (i and j in a row), from their ratios and, in a second pass, residuals."""
    p, at = z.p, 64

    def sliced(add_one):
        def add(x, y, whole):
            x, y = x[whole], y[whole]
            for k in range(0, len(left), at):
                v = y[:, left[k : k + at, 1]] - y[:, left[k : k + at, 0]]
                add_one(slice(k, k + at), x, np.isfinite(v), np.where(np.isfinite(v), v, 0.0))

        return add

    def ratios():
        total = np.zeros((len(z.names), len(left)))

        def add_one(k, x, there, v):
            total[0, k] += there.sum(axis=0)
            for c, (i, j) in enumerate(z.pairs):
                total[1 + c, k] += (x[:, i] * x[:, j]) @ there
            total[z.xy : z.vv, k] += x.T @ v
            total[z.vv, k] += np.einsum("ij,ij->j", v, v)

        return sliced(add_one), lambda: (left[:, 0], left[:, 1], list(total))

    got = summed(s, p, z.names, ratios, dense).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in z.names))
    held = got.toPandas().set_index(["i", "j"]).loc[list(map(tuple, left))]  # a row a pair that fits almost exactly
    effects, inverses = fits(z, held[z.names].to_numpy(float), {})
    beta = np.stack([np.full(p, np.nan) if m is None else m.T @ e for m, e in zip(inverses, effects, strict=True)])

    def residuals():
        total = np.zeros(len(left))

        def add_one(k, x, there, v):
            rest = np.where(there, v - x @ beta[k].T, 0.0)
            total[k] += np.einsum("ij,ij->j", rest, rest)

        return sliced(add_one), lambda: (left[:, 0], left[:, 1], [total])

    rest = summed(s, p, ["rss"], residuals, dense).groupBy("i", "j").agg(F.sum("rss").alias("rss"))
    return s.rows.sparkSession.createDataFrame(held.reset_index()).join(rest, ["i", "j"])


def tests_of(s: Sheets, main: str, dense: Callable, block: int) -> tuple[DataFrame, int]:
    """As ``pair_tests``; ``dense`` gives a batch's responses as samples x taxa, nan where missing."""
    f, z, taxa = s.frame, Sums(s.p), s.taxa
    cols = sorted(f.group_columns) or [f.columns.index(main)]
    by_f, p, known = len(cols) > 1, s.p, "a string, b string, stat double, p double"

    def run(batches):
        held: dict = {}
        for pdf in batches:
            rows = pdf[z.names].to_numpy(float)
            effects, inverses = fits(z, rows, held)
            dof = rows[:, 0] - p
            rss = np.where(np.isnan(pdf["rss"].to_numpy(float)), rows[:, z.vv] - (effects**2).sum(axis=1), pdf["rss"].to_numpy(float))
            dof = np.where(dof > 0, dof, np.nan)
            with np.errstate(all="ignore"):
                if by_f:
                    stat = (effects[:, cols] ** 2).sum(axis=1) / len(cols) / (rss / dof)
                    tail = f_tails(stat, len(cols), np.where(dof > 0, dof, 1.0))[1]
                else:
                    own = np.stack([np.full(p, np.nan) if m is None else m[:, cols[0]] for m in inverses]) if len(rows) else np.zeros((0, p))
                    stat = (own * effects).sum(axis=1) / np.sqrt((own * own).sum(axis=1) * rss / dof)
                    tail = t_two_sided(stat, np.where(dof > 0, dof, 1.0))
            names = np.array(taxa, object)
            yield pd.DataFrame({"a": names[pdf["i"].to_numpy()], "b": names[pdf["j"].to_numpy()], "stat": stat, "p": np.where(np.isnan(stat), np.nan, tail)})

    def sure(batches):
        """Adds whether the residuals' squares are sure to many digits."""
        held: dict = {}
        for pdf in batches:
            rows = pdf[z.names].to_numpy(float)
            rss = rows[:, z.vv] - (fits(z, rows, held)[0] ** 2).sum(axis=1)
            yield pdf.assign(sure=~(rss <= UNSURE * rows[:, z.vv + 1]))

    with s.batches():
        sums = pair_sums(s, z, dense, block)
        sums = kept(sums.mapInPandas(sure, T.StructType([*sums.schema.fields, T.StructField("sure", T.BooleanType())])), "ratio-sums")
    seen = {r.i for r in sums.where("i = j AND n > 0").select("i").collect()}  # a number a taxon
    pairs = sums.where("i < j")
    if gone := [k for k in range(len(taxa)) if k not in seen]:
        pairs = pairs.where(~F.col("i").isin(gone) & ~F.col("j").isin(gone))
    left = pairs.where("NOT sure").select("i", "j").toPandas().to_numpy()
    done = pairs.where("sure").drop("sure").withColumn("rss", F.lit(None).cast("double"))
    if len(left):
        with s.batches():
            done = done.unionByName(kept(again(s, z, dense, left), "ratios-again").select(*done.columns))
    found = done.mapInPandas(run, known)
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select("a", "b", number("stat"), number("p")), len(seen)


def observed(taxa: int) -> Callable:
    """A batch's responses; cells that aren't there are missing."""

    def dense(b: Batch) -> np.ndarray:
        y = np.full((len(b.x), taxa), np.nan)
        y[b.row, b.at] = b.y
        return y

    return dense


def logs_of_counts(taxa: int) -> Callable:
    """The logs of a batch's counts and 1; cells that aren't there are zero."""

    def dense(b: Batch) -> np.ndarray:
        y = np.zeros((len(b.x), taxa))
        y[b.row, b.at] = np.log1p(b.y)
        return y

    return dense


def pair_tests(logs: DataFrame, samples: DataFrame, main: str, adjust_for: str | None = None, block: int = 256) -> tuple[DataFrame, int]:
    """a, b (a < b), stat, p of log b - log a, and the number of taxa. ``logs``: taxon, sample, y.

    A text variable with more than two levels is tested by its sequential F, any other by its coefficient's t. A pair
    without enough common samples, or of equal rows, has null values.
    """
    f = tested_design(samples, main, adjust_for)
    gram, _, every = moments(f)
    s = sheets(logs, f, gram, every)
    return tests_of(s, main, observed(len(s.taxa)), block)


def log_ratio_tests(counts: DataFrame, samples: DataFrame, main: str, *, adjust_for: str | None = None, method: str = "holm", alpha: float = 0.05, prv_cut: float = 0.1, lib_cut: float = 0.0, struc_zero: bool = False, neg_lb: bool = False, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """Two tables: taxon, W (other taxa that it differs from; infinite for structural zeros), detected_0.9 .. 0.6; and
    the tests, taxon, other, stat, p, q, once in either direction (a missing p counts as 1)."""
    zeros = kept(screens.structural_zeros(counts, samples.select("sample", F.col(main).alias("grp")), neg_lb), "zeros") if struc_zero else None
    first, second = screens.two_tables(counts, samples.count(), zeros, prv_cut, lib_cut)
    own = samples if lib_cut <= 0 else samples.join(screens.library_size(first).where(F.col("size") >= lib_cut).select("sample"), "sample", "left_semi")
    f = tested_design(own, main, adjust_for)
    gram, _, every = moments(f)
    s = count_sheets(second, f, gram, every)
    pairs, n_taxa = tests_of(s, main, logs_of_counts(len(s.taxa)), block)
    pairs = kept(pairs, "pairs")
    text = isinstance(samples.schema[main].dataType, T.StringType)
    by_f = text and samples.select(main).where(F.col(main).isNotNull()).distinct().count() > 2
    p, stat = F.coalesce("p", F.lit(1.0)).alias("p"), F.coalesce("stat", F.lit(0.0))
    both = pairs.select(F.col("b").alias("taxon"), F.col("a").alias("other"), stat.alias("stat"), p).unionByName(pairs.select(F.col("a").alias("taxon"), F.col("b").alias("other"), (stat if by_f else -stat).alias("stat"), p))
    tests = adjust(both, "p", ["taxon"], "other", method, n=F.lit(float(n_taxa)))
    taxa = second.select("taxon").distinct().join(tests.groupBy("taxon").agg(F.count_if(F.col("q") <= alpha).cast("double").alias("W")), "taxon", "left").fillna(0.0, ["W"])
    found = taxa.select("taxon", "W", *((F.col("W") > c * (n_taxa - 1)).alias(f"detected_{c}") for c in CUTOFFS))
    if zeros is not None:
        gone = first.select("taxon").distinct().join(taxa.select("taxon"), "taxon", "left_anti")
        found = found.unionByName(gone.select("taxon", F.lit(float("inf")).alias("W"), *(F.lit(True).alias(f"detected_{c}") for c in CUTOFFS)))
    return found, tests
