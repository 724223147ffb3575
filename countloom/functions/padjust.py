"""Adjustment of p-values for multiple tests.

A family's p-values are ranked (ties by a key, so that results are the same in any order); nulls stay null and don't
count as ranked. ``n`` may exceed the number of p-values, and need not be whole. Families may be as long as a table:
ranks, and greatest and least values along them, are carried between ranges of the sort order (``running``). Families
that are known to be short (a taxon's few contrasts) are plain windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions import running

METHODS = ("holm", "hochberg", "hommel", "bh", "fdr", "by", "bonferroni", "none")

#: Steps of the ranked p-values, each as a factor of p, and the side whose values bound it.
STEPS = {"holm": "so_far", "hochberg": "onward", "bh": "onward", "by": "onward"}


def step(method: str, p: Column, n: Column, i: Column) -> Column:
    if method in ("holm", "hochberg"):
        return (n + 1 - i) * p
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n).cast("int"))), F.lit(0.0), lambda a, k: a + 1.0 / k) if method == "by" else F.lit(1.0)
    return harmonic * n / i * p


def adjust(table: DataFrame, p: str, by: list[str], key: str, method: str, out: str = "q", n: Column | None = None, short: bool = False) -> DataFrame:
    """Adds ``out``, the adjusted p-values within each group of ``by``. ``short``: every family fits a task easily."""
    method = {"fdr": "bh"}.get(method.lower(), method.lower())
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    if method == "hommel":
        return hommel(table, p, by, out, n)
    if method == "none":
        return table.withColumn(out, F.col(p))
    if method == "bonferroni" and n is None:
        if not by:
            own = table.withColumn("_n", F.lit(float(table.where(F.col(p).isNotNull()).count())))
        else:
            sizes = table.groupBy(*by).agg(F.count(p).cast("double").alias("_n"))
            own = table.join(sizes.select(*(F.col(c).alias(f"_{c}") for c in by), "_n"), _same(table, by))
        return own.withColumn(out, _final(p, F.col("_n") * F.col(p))).drop("_n", *(f"_{c}" for c in by))
    if method == "bonferroni":
        return table.withColumn("_n", n.cast("double")).withColumn(out, _final(p, F.col("_n") * F.col(p))).drop("_n")
    if short:
        family = Window.partitionBy(*by, F.col(p).isNull())
        up = family.orderBy(F.col(p), F.col(key))
        ranked = table.withColumn("_n", (F.count(p).over(family) if n is None else n).cast("double")).withColumn("_v", step(method, F.col(p), F.col("_n"), F.row_number().over(up)))
        value = F.max("_v").over(up.rowsBetween(Window.unboundedPreceding, 0)) if STEPS[method] == "so_far" else F.min("_v").over(up.rowsBetween(0, Window.unboundedFollowing))
        return ranked.withColumn(out, _final(p, value)).drop("_n", "_v")
    # Missing p-values sort last, so that they don't count, and have no step.
    ordered = running.in_order(table.withColumn("_none", F.col(p).isNull()), [*by, "_none"], [F.col(p), F.col(key)])
    ranked = running.numbered(ordered, [*by, "_none"], "_i", "_size")
    ranked = ranked.withColumn("_n", (F.col("_size") if n is None else n).cast("double")).withColumn("_v", step(method, F.col(p), F.col("_n"), F.col("_i")))
    bounded = getattr(running, STEPS[method])(ranked, [*by, "_none"], "_v", "_bound")
    return bounded.withColumn(out, _final(p, F.col("_bound"))).select(*table.columns, out)


def _same(table: DataFrame, by: list[str]) -> Column:
    condition = F.lit(True)
    for c in by:
        condition = condition & table[c].eqNullSafe(F.col(f"_{c}"))
    return condition


def _final(p: str, value: Column) -> Column:
    """At most 1; a family of one test or less keeps its p-value."""
    return F.when(F.col(p).isNotNull(), F.when(F.col("_n") <= 1, F.col(p)).otherwise(F.least(F.lit(1.0), value)))


def hommel_array(p: np.ndarray, family: float | None = None) -> np.ndarray:
    """Hommel's procedure, as the closure of Simes' tests; a ``family`` larger than p is filled up with ones.

    Of all sets of m hypotheses the m largest p-values have the greatest Simes value s(m): m times the least slope from
    the place before them, at height 0, to their points (rank, p), which the lower convex hull of these points gives. With
    t(m), the greatest of s(m + 1), ..., s(n), all sets of more than m are rejected from t(m) on, and then so is every
    hypothesis with m p <= the level: its adjusted value is the least over m of max(m p, t(m)).
    """
    given = len(p)
    s = np.sort(p)
    if family is not None and int(family) > given:
        s = np.append(s, np.ones(int(family) - given))
        s.sort()
    n = len(s)
    if n <= 1:
        return np.asarray(p, float).copy()
    simes = np.zeros(n + 1)
    hull: list[int] = []  # ranks (from 1) of the hull's points, the leftmost last
    value = s.tolist()
    for left in range(n - 1, -1, -1):
        rank = left + 1
        while len(hull) > 1 and (value[hull[-1] - 1] - value[left]) * (hull[-2] - rank) >= (value[hull[-2] - 1] - value[left]) * (hull[-1] - rank):
            hull.pop()
        hull.append(rank)
        low, high = 0, len(hull) - 1  # slopes from (left, 0) fall, then rise along the hull
        while low < high:
            middle = (low + high) // 2
            u, v = hull[middle], hull[middle + 1]
            if value[u - 1] * (v - left) < value[v - 1] * (u - left):
                high = middle
            else:
                low = middle + 1
        simes[n - left] = (n - left) * value[hull[low] - 1] / (hull[low] - left)
    level = np.append(np.maximum.accumulate(simes[::-1])[::-1][1:], 0.0)  # t(0), ..., t(n)
    p = np.asarray(p, float)
    # t falls and m p rises with m: the least of the larger one is beside the place where they cross.
    low, high = np.zeros(given, int), np.full(given, n)
    while (low < high).any():
        middle = (low + high) // 2
        over = middle * p >= level[middle]
        high, low = np.where(over, middle, high), np.where(over, low, np.minimum(middle + 1, high))
    best = np.maximum(low * p, level[low])
    before = np.maximum(low - 1, 0)
    return np.minimum(1.0, np.maximum(p, np.minimum(best, np.maximum(before * p, level[before]))))


def hommel(table: DataFrame, p: str, by: list[str], out: str, n: Column | None = None) -> DataFrame:
    """A family's p-values meet in one task, sorted: a few numbers each, in time n log n."""
    schema = table.withColumn(out, F.lit(None).cast("double")).schema

    def run(pdf):
        family = pdf.pop("_n").iloc[0]
        pdf[out] = np.nan
        seen = pdf[p].notna()
        pdf.loc[seen, out] = hommel_array(pdf.loc[seen, p].to_numpy(), family if family > 0 else None)
        return pdf

    sized = table.withColumn("_n", F.lit(0.0) if n is None else n.cast("double"))
    return sized.groupBy(*by).applyInPandas(run, schema)
