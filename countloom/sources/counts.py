"""Count tables: long rows (taxon, sample, n); an absent row is zero, a null n is missing."""

from __future__ import annotations

import csv

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = ("", "NA", "NaN")
CORRUPT = "_whole_row"


def number(cell: Column) -> Column:
    """A text cell as a double; empty, NA and NaN are missing."""
    return F.when(F.trim(cell).isin(*MISSING), None).otherwise(F.trim(cell).try_cast("double"))


def separator(path: str) -> str:
    return "," if path.removesuffix(".gz").endswith(".csv") else "\t"


def first_rows(spark: SparkSession, path: str, n: int) -> list[list[str]]:
    """The cells of a file's first lines; quotes may hold separators."""
    lines = [r[0] for r in spark.read.text(path).take(n)]
    return list(csv.reader(lines, delimiter=separator(path)))


def body(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All lines but a file's first, as text columns. A row of another width is an error."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*columns, CORRUPT])
    rows = spark.read.csv(path, sep=separator(path), header=True, quote='"', escape='"', schema=schema, enforceSchema=True, columnNameOfCorruptRecord=CORRUPT)
    # Every column is asked for, since a reader that skips columns doesn't see a row's width.
    whole = F.concat_ws("", *(F.col(f"`{c.replace('`', '``')}`") for c in columns)) >= ""
    if bad := rows.where(F.col(CORRUPT).isNotNull() & whole).select(CORRUPT).take(1):
        raise ValueError(f"a row's width differs from the header's: {bad[0][0]!r}")
    return rows.drop(CORRUPT)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """A wide table whose header names the samples, after an empty cell or without one, as long rows. Zero cells are
    dropped, missing cells kept.

    A taxon or sample that occurs twice, or a row of another width than the header asks for, is an error.
    """
    header = first_rows(spark, path, 1)
    if not header:
        raise ValueError("an empty counts file")
    names = [c.strip() for c in header[0]]
    if names and names[0] == "":
        names = names[1:]
    if len(set(names)) < len(names):
        raise ValueError("a sample occurs twice")
    places = [f"c{k}" for k in range(len(names))]
    rows = body(spark, path, ["taxon", *places])
    if twice := rows.groupBy("taxon").count().where("count > 1").take(1):
        raise ValueError(f"taxon {twice[0].taxon} occurs twice")
    cells = F.array(*(F.struct(F.lit(n).alias("sample"), number(F.col(c)).alias("n")) for c, n in zip(places, names, strict=True)))
    long = rows.select("taxon", F.explode(cells).alias("cell")).select("taxon", "cell.sample", "cell.n")
    return long.where("n IS NULL OR n <> 0")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A table of covariates, all text, whose header may lack the sample column's name."""
    top = first_rows(spark, path, 2)
    if not top:
        raise ValueError("an empty metadata file")
    names = [c.strip() for c in top[0]]
    lacks = len(top) > 1 and len(top[1]) == len(names) + 1
    return body(spark, path, ["sample", *(names if lacks else names[1:])])


def typed(table: DataFrame, keep: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Text columns whose cells are all numbers or missing (and some a number) as doubles; missing cells as null."""
    own = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not own:
        return table
    some = {c: ~F.coalesce(F.trim(F.col(c)).isin(*MISSING), F.lit(True)) for c in own}
    sums = table.agg(*(F.count_if(some[c]).alias(f"n{k}") for k, c in enumerate(own)), *(F.count_if(some[c] & number(F.col(c)).isNull()).alias(f"t{k}") for k, c in enumerate(own))).first()
    numeric = [c for k, c in enumerate(own) if sums[f"n{k}"] and not sums[f"t{k}"]]
    return table.withColumns({c: number(F.col(c)) if c in numeric else F.when(some[c], F.col(c)) for c in own})


def from_events(rows: DataFrame, taxon: Column, sample: Column, value: Column | None = None) -> DataFrame:
    """Counts of rows, or sums of a value, by taxon and sample."""
    n = F.count("*") if value is None else F.sum(value)
    return rows.groupBy(taxon.alias("taxon"), sample.alias("sample")).agg(n.cast("double").alias("n"))


def aggregate_taxa(counts: DataFrame, taxonomy: DataFrame, level: str) -> DataFrame:
    """Counts summed to a rank: ``taxonomy`` has taxon and a column ``level``; taxa without one go under their own name."""
    named = taxonomy.select("taxon", F.col(level).alias("rank"))
    joined = counts.join(named, "taxon", "left")
    return joined.groupBy(F.coalesce("rank", "taxon").alias("taxon"), "sample").agg(F.sum("n").alias("n"))


def densify(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """Every taxon with every sample, absent cells as zero. A sample's absent taxa are found beside its own, so only counts
    that are there pass a shuffle; the names of the taxa are broadcast."""
    taxa = counts.select("taxon").distinct().agg(F.collect_list(F.struct("taxon")).alias("every"))
    own = counts.where("taxon IS NOT NULL").groupBy("sample").agg(F.collect_list(F.struct("taxon", F.col("n").cast("double").alias("n"))).alias("own"))
    beside = samples.select("sample").distinct().join(own, "sample", "left").join(F.broadcast(taxa))
    absent = F.when(F.col("own").isNull(), F.col("every.taxon")).otherwise(F.array_except("every.taxon", "own.taxon"))
    zeros = F.transform(absent, lambda t: F.struct(t.alias("taxon"), F.lit(0.0).alias("n")))
    cells = F.when(F.col("own").isNull(), zeros).otherwise(F.concat("own", zeros))
    return beside.select("sample", F.explode(cells).alias("cell")).select("cell.taxon", "sample", "cell.n")


def number_text(v: float) -> str:
    """Whole numbers bare; others as the shortest decimal that reads back as the same number, or with an exponent if that is
    longer than 15 decimals and exponent; NA, Inf and -Inf."""
    if np.isnan(v):
        return "NA"
    if np.isinf(v):
        return "Inf" if v > 0 else "-Inf"
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    plain = np.format_float_positional(v, unique=True, trim="-")
    head, tail = f"{v:.15e}".split("e")
    power = f"{head}e{int(tail)}"
    return plain if len(plain) <= len(power) else power


@F.pandas_udf(T.StringType())
def printed(values: pd.Series) -> pd.Series:
    return values.astype(float).map(number_text)


def write_table(table: DataFrame, path: str) -> None:
    """A result, by its first column, as tab-separated text with a header; missing values as NA."""
    numbers = {f.name for f in table.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    flags = {f.name for f in table.schema if isinstance(f.dataType, T.BooleanType)}
    named = [(printed(F.col(c).cast("double")) if c in numbers else F.upper(F.col(c).cast("string")) if c in flags else F.col(c).cast("string")).alias(c) for c in table.columns]
    table.sort(table.columns[0]).select(*named).write.csv(path, sep="\t", header=True, nullValue="NA", mode="overwrite")
