"""Results as files: wide tables in a fixed column order, run metadata, JSON lines, and data folders read back."""

from __future__ import annotations

from dataclasses import asdict, fields
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import countloom
from countloom.sources.counts import read_counts, read_metadata, typed, write_table
from countloom.sources.results import wide

if TYPE_CHECKING:
    from countloom.plans.analysis import Config, Result

MEASURES = ["lfc", "se", "W", "p", "q", "diff"]


def contract_tables(result: Result, sensitivity: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """By name: ``res`` (a measure of all coefficients, then the next one; with sensitivity also passed_ss and diff_robust),
    ``res_global``, ``res_pair`` (all measures of a contrast, then the next one), ``zero_ind``, ``samp_frac``,
    ``bias_correct_log_table`` (a row a taxon and sample) and ``ss_tab``. Tables that the run didn't make are left out."""
    scored = sensitivity or {}
    primary = scored.get("primary", result.primary)
    out = {"res": wide(primary, "coef", MEASURES + (["passed_ss", "diff_robust"] if "primary" in scored else []), result.design.columns)}
    if result.global_test is not None:
        table = scored.get("global", result.global_test)
        more = [F.col("passed_ss"), F.col("diff_robust").alias("diff_robust_abn")] if "global" in scored else []
        out["res_global"] = table.select("taxon", "W", F.col("p").alias("p_val"), F.col("q").alias("q_val"), F.col("diff").alias("diff_abn"), *more)
    if result.pairwise is not None:
        table = scored.get("pairwise", result.pairwise)
        names = [result.design.columns[j] for j in sorted(result.design.group_columns)]
        labels = names + [f"{b}_{a}" for k, a in enumerate(names) for b in names[k + 1 :]]
        own = wide(table, "contrast", MEASURES, labels)
        out["res_pair"] = own.select("taxon", *(F.col(f"`{m}_{c}`") for c in labels for m in MEASURES))
    if result.zeros is not None:
        levels = result.design.group_levels
        out["zero_ind"] = result.zeros.groupBy("taxon").agg(*(F.max(F.when(F.col("grp") == v, F.col("is_zero"))).alias(f"structural_zero_{v}") for v in levels))
    out["samp_frac"] = result.theta
    if result.corrected is not None:
        out["bias_correct_log_table"] = result.corrected
    if scored:
        terms = [t.select("taxon", F.lit(n).alias("table"), (F.col(c) if c else F.lit(n)).alias("term"), "ss") for n, t in scored.items() for c in [next((x for x in ("coef", "contrast") if x in t.columns), None)]]
        table = terms[0]
        for t in terms[1:]:
            table = table.unionByName(t)
        out["ss_tab"] = table
    return out


def metadata(result: Result, cfg: Config) -> list[tuple[str, str]]:
    """Options, the seconds of each stage, each round's change, warnings and the version, as keys and values."""
    rows = [("version", countloom.__version__), *((f"option_{k}", "" if v is None else str(v)) for k, v in asdict(cfg).items())]
    rows += [(f"seconds_{k}", f"{v:.3f}") for k, v in result.seconds.items()]
    rows += [(f"epsilon_{k + 1}", repr(v)) for k, v in enumerate(result.epsilons)]
    return rows + [(f"warning_{k + 1}", w) for k, w in enumerate(result.warnings)]


def write_results(result: Result, cfg: Config, folder: str, sensitivity: dict[str, DataFrame] | None = None) -> None:
    """Every table as tab-separated text in a folder of its name, and ``run``: keys and values."""
    for name, table in contract_tables(result, sensitivity).items():
        write_table(table, f"{folder}/{name}")
    spark = result.primary.sparkSession
    write_table(spark.createDataFrame(metadata(result, cfg), "key string, value string"), f"{folder}/run")


def summary(result: Result) -> DataFrame:
    """coef, taxa, tested (taxa with an estimate), different, and the coefficient's bias: what a run found, in a few rows."""
    spark = result.primary.sparkSession
    bias = spark.createDataFrame([(c, float(m.delta)) for c, m in result.mixtures.items()], "coef string, bias double")
    own = result.primary.groupBy("coef").agg(F.count("*").alias("taxa"), F.count("lfc").alias("tested"), F.count_if("diff").alias("different"))
    return own.join(F.broadcast(bias), "coef", "left")


def read_dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Config]:
    """Counts, covariates and options of a folder with ``counts.tsv``, ``meta.tsv`` and ``analysis.tsv`` (key and value: the
    options of ``Config``; p_adj_method is p_adjust; other keys are ignored)."""
    from countloom.plans.analysis import Config

    named = {"p_adj_method": "p_adjust", "fix_formula": "formula", "global": "global_test"}
    kinds = {f.name: type(f.default) if f.default is not None else str for f in fields(Config)}
    options = {}
    for r in spark.read.csv(f"{folder}/analysis.tsv", sep="\t", header=True, schema="key string, value string").collect():  # options
        key = named.get(r.key, r.key)
        if key in kinds and r.value is not None:
            kind = str if key in ("formula", "group") else kinds[key]
            options[key] = r.value.strip().lower() in ("true", "t", "1") if kind is bool else int(r.value) if kind is int else float(r.value) if kind is float else r.value
    if "formula" not in options:
        raise ValueError("analysis.tsv names no formula")
    return read_counts(spark, f"{folder}/counts.tsv"), typed(read_metadata(spark, f"{folder}/meta.tsv")), Config(**options)


def write_rows(table: DataFrame, path: str) -> None:
    """Rows as JSON lines. Not-a-number and infinite values, which JSON lacks, and missing ones are null."""
    inf = F.lit(float("inf"))
    plain = [F.when(~F.isnan(f.name) & (F.abs(f.name) < inf), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in table.schema]
    table.select(*plain).write.json(path, mode="overwrite", ignoreNullFields=False)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; a line that doesn't have it is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")
