"""Logs, centring, patterns and row statistics of long count tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions import running


def log_counts(counts: DataFrame, pseudo: float = 0.0) -> DataFrame:
    """taxon, sample, y: the log of n + pseudo; null where that isn't positive. With pseudo > 0 give a dense table."""
    if pseudo < 0:
        raise ValueError("a negative pseudo-count")
    v = F.col("n") + F.lit(pseudo) if pseudo else F.col("n")
    return counts.select("taxon", "sample", F.when(v > 0, F.log(v)).alias("y"))


def log_zero_replaced(dense: DataFrame, value: float) -> DataFrame:
    """The log with zeros replaced, other cells as they are."""
    v = F.when(F.col("n") == 0, F.lit(value)).otherwise(F.col("n"))
    return dense.select("taxon", "sample", F.when(v > 0, F.log(v)).alias("y"))


def row_means(logs: DataFrame) -> DataFrame:
    return logs.groupBy("taxon").agg(F.avg("y").alias("mean"), F.count("y").alias("observed"))


def center(logs: DataFrame) -> DataFrame:
    """Subtracts each taxon's mean. Means are pre-aggregated and broadcast, so a taxon's cells need not meet in one task."""
    means = logs.groupBy("taxon").agg(F.avg("y").alias("mean"))
    return logs.join(F.broadcast(means), "taxon").select("taxon", "sample", (F.col("y") - F.col("mean")).alias("y"))


def subtract_by_sample(logs: DataFrame, theta: DataFrame) -> DataFrame:
    """y - theta of its sample; null where either is. ``theta``: sample, theta."""
    return logs.join(theta, "sample", "left").select("taxon", "sample", (F.col("y") - F.col("theta")).alias("y"))


def pattern_groups(logs: DataFrame) -> DataFrame:
    """taxon, pattern: taxa with the same observed samples share a number, by the first such taxon's name."""
    seen = logs.where("y IS NOT NULL").groupBy("taxon").agg(F.sha2(F.concat_ws("\x1f", F.sort_array(F.collect_list("sample"))), 256).alias("key"))
    first = seen.groupBy("key").agg(F.min("taxon").alias("first"))
    number = running.numbered(running.in_order(first, [], [F.col("first")]), [], "pattern").select("key", F.col("pattern").cast("int").alias("pattern"))
    return seen.join(number, "key").select("taxon", "pattern")


def variances(logs: DataFrame) -> DataFrame:
    return logs.groupBy("taxon").agg(F.var_samp("y").alias("variance"))


def quantile(values: DataFrame, column: str, p: float, *by: str) -> DataFrame:
    """The type-7 quantile (linear interpolation) of a column, nulls skipped."""
    return values.groupBy(*by).agg(F.percentile(column, F.lit(p)).alias("quantile"))


def winsorize(logs: DataFrame, share: float) -> DataFrame:
    """Clips each taxon to its quantiles at ``share`` and 1 - ``share``."""
    q = logs.groupBy("taxon").agg(F.percentile("y", F.array(F.lit(share), F.lit(1 - share))).alias("q"))
    joined = logs.join(F.broadcast(q), "taxon")
    return joined.select("taxon", "sample", F.when(F.col("y").isNotNull(), F.greatest(F.least("y", F.col("q")[1]), F.col("q")[0])).alias("y"))


def average_rank(logs: DataFrame) -> DataFrame:
    """Ranks within a taxon, ties by their mean; nulls stay null."""
    seen = logs.where("y IS NOT NULL")
    w = Window.partitionBy("taxon").orderBy("y")
    tied = Window.partitionBy("taxon", "y")
    return seen.select("taxon", "sample", (F.rank().over(w) + (F.count("*").over(tied) - 1) / 2).cast("double").alias("rank"))


def cooccurrence(counts: DataFrame) -> DataFrame:
    """a, b, n: in how many samples both taxa are non-zero, for a < b that share one."""
    own = counts.where("n <> 0").select("sample", "taxon")
    pairs = own.withColumnRenamed("taxon", "a").join(own.withColumnRenamed("taxon", "b"), "sample").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def correlation(x: Column, y: Column) -> Column:
    """The aggregate correlation over rows that have both; null where either doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(logs: DataFrame) -> DataFrame:
    """a, b, r, n over the samples that both taxa have."""
    own = logs.where("y IS NOT NULL")
    pairs = own.select("sample", F.col("taxon").alias("a"), F.col("y").alias("x")).join(own.select("sample", F.col("taxon").alias("b"), "y"), "sample").where("a < b")
    return pairs.groupBy("a", "b").agg(correlation(F.col("x"), F.col("y")).alias("r"), F.count("*").alias("n"))


def contrasts(estimates: DataFrame) -> DataFrame:
    """taxon, contrast, lfc: the group coefficients, then each later minus each earlier one, named later_earlier.
    ``estimates``: taxon, coef, lfc, of one group's coefficients."""
    single = estimates.select("taxon", F.col("coef").alias("contrast"), "lfc")
    x, y = estimates.alias("x"), estimates.alias("y")
    both = x.join(y, "taxon").where(F.col("x.coef") < F.col("y.coef"))
    pairs = both.select("taxon", F.concat_ws("_", "y.coef", "x.coef").alias("contrast"), (F.col("y.lfc") - F.col("x.lfc")).alias("lfc"))
    return single.unionByName(pairs)


def weighted_difference(theta: DataFrame) -> DataFrame:
    """sample, diff: the mean of y over taxa weighted by 1 / variance, infinite weights dropped. ``theta``: sample, y, variance."""
    w = F.try_divide(F.lit(1.0), F.col("variance"))
    own = theta.where(F.col("y").isNotNull() & (F.col("variance") > 0)).withColumn("w", w)
    return own.groupBy("sample").agg(F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("diff"))


def sensitivity_scores(refits: DataFrame, alpha: float = 0.05) -> DataFrame:
    """taxon, term, ss, passed: the share of refits whose value exceeds alpha (null counts), and whether all agree.
    ``refits``: taxon, term, value."""
    above = F.when(F.coalesce(F.col("value") > alpha, F.lit(True)), 1.0).otherwise(0.0)
    return refits.groupBy("taxon", "term").agg(F.avg(above).alias("ss")).withColumn("passed", F.col("ss").isin(0.0, 1.0))
