"""Inputs checked against each other, several tables as one, and results in their wide form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW_TAXA = 50


def checked(counts: DataFrame, samples: DataFrame) -> tuple[DataFrame, list[str]]:
    """The covariates of the samples that have counts, and warnings. A counted sample without covariates, or one whose
    covariates are listed twice, is an error; fewer than ``FEW_TAXA`` taxa are a warning."""
    named = counts.select("sample").distinct()
    if lost := named.join(samples, "sample", "left_anti").take(1):
        raise ValueError(f"no covariates of sample {lost[0].sample}")
    if twice := samples.groupBy("sample").count().where("count > 1").take(1):
        raise ValueError(f"sample {twice[0].sample} is listed twice")
    taxa = counts.select("taxon").distinct().limit(FEW_TAXA).count()
    warnings = [f"only {taxa} taxa: estimates of sample biases may be unreliable"] if taxa < FEW_TAXA else []
    return samples.join(named, "sample", "left_semi"), warnings


def transposed(table: DataFrame, taxa_are_rows: bool, names: str = "name") -> DataFrame:
    """A wide table of numbers as long counts, its column ``names`` being taxa or samples. A column that isn't a number is
    an error."""
    cells = [c for c in table.columns if c != names]
    if odd := [f.name for f in table.schema.fields if f.name in cells and f.dataType.simpleString().split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]:
        raise ValueError(f"column {odd[0]} isn't numeric")
    row, column = ("taxon", "sample") if taxa_are_rows else ("sample", "taxon")
    long = table.select(F.col(names).alias(row), F.explode(F.array(*(F.struct(F.lit(c).alias(column), F.col(f"`{c}`").cast("double").alias("n")) for c in cells))).alias("cell"))
    return long.select(row, f"cell.{column}", "cell.n").select("taxon", "sample", "n").where("n IS NULL OR n <> 0")


def common_samples(tables: list[DataFrame], least: int = 10) -> DataFrame:
    """The samples that all tables have; fewer than ``least`` are an error."""
    both = reduce(lambda x, y: x.join(y, "sample", "left_semi"), [t.select("sample").distinct() for t in tables])
    if both.limit(least).count() < least:
        raise ValueError(f"fewer than {least} samples in common")
    return both


def bound(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables, columns that one lacks as null; taxa are named after their table."""
    named = [t.withColumn("taxon", F.concat_ws(" - ", F.lit(n), "taxon")) for n, t in tables.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), named)


def fractions_across(theta: dict[str, DataFrame]) -> DataFrame:
    """sample and each table's sampling fraction, null where a table lacks the sample. ``theta``: sample, theta."""
    return reduce(lambda x, y: x.join(y, "sample", "full"), [t.select("sample", F.col("theta").alias(n)) for n, t in theta.items()])


def wide(result: DataFrame, term: str, columns: list[str], terms: list[str]) -> DataFrame:
    """A row for each taxon: each of ``columns`` for every term, as column_term, in the order given. Terms are few: one for
    each coefficient or contrast."""
    cells = [F.max(F.when(F.col(term) == t, F.col(c))).alias(f"{c}_{t}") for c in columns for t in terms]
    return result.groupBy("taxon").agg(*cells)


def arms(cells: DataFrame, keys: list[str], arm: str, value: str) -> DataFrame:
    """Each two arms of a cell beside each other: keys, arm_a < arm_b, and the difference of their values, b less a."""
    a, b = (cells.select(*keys, F.col(arm).alias(f"{arm}_{s}"), F.col(value).alias(f"{value}_{s}")) for s in "ab")
    both = a.join(b, keys).where(F.col(f"{arm}_a") < F.col(f"{arm}_b"))
    return both.select(*keys, f"{arm}_a", f"{arm}_b", (F.col(f"{value}_b") - F.col(f"{value}_a")).alias("difference"))


def calibration(estimates: DataFrame, *by: str) -> DataFrame:
    """How standard errors compare with the spread of estimates over replicates: n, spread, mean_se, ratio (mean_se /
    spread). ``estimates``: columns of ``by``, lfc, se."""
    own = estimates.groupBy(*by).agg(F.count("lfc").alias("n"), F.stddev_samp("lfc").alias("spread"), F.avg("se").alias("mean_se"))
    return own.withColumn("ratio", F.try_divide("mean_se", "spread"))


def verdicts(rates: DataFrame, target: float, *by: str) -> DataFrame:
    """Pooled rates of hits in trials and whether they are within 3 standard errors of ``target``: rate, se, within.
    ``rates``: columns of ``by``, hits, trials."""
    own = rates.groupBy(*by).agg((F.sum("hits") / F.sum("trials")).alias("rate"), F.sum("trials").alias("trials"))
    se = F.sqrt(F.lit(target * (1 - target)) / F.col("trials"))
    return own.select(*by, "rate", se.alias("se"), (F.abs(F.col("rate") - target) <= 3 * se).alias("within"))
