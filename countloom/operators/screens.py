"""Screens: which taxa and samples take part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prevalence(counts: DataFrame, n_samples: int) -> DataFrame:
    """taxon, prevalence: the share of non-zero cells among those not missing; null if all are missing."""
    present = F.count_if((F.col("n").isNotNull()) & (F.col("n") != 0))
    missing = F.count_if(F.col("n").isNull())
    return counts.groupBy("taxon").agg(F.try_divide(present.cast("double"), (F.lit(n_samples) - missing).cast("double")).alias("prevalence"))


def prevalence_filter(counts: DataFrame, n_samples: int, cut: float = 0.1) -> DataFrame:
    """Rows of taxa with a prevalence of ``cut`` or more."""
    return counts.join(prevalence(counts, n_samples).where(F.col("prevalence") >= cut).select("taxon"), "taxon", "left_semi")


def library_size(counts: DataFrame) -> DataFrame:
    """sample, size: the sum over the taxa given, missing cells skipped."""
    return counts.groupBy("sample").agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("size"))


def library_filter(counts: DataFrame, cut: float = 0.0) -> DataFrame:
    """Rows of samples with a size of ``cut`` or more; 0 keeps all."""
    return counts if cut <= 0 else counts.join(library_size(counts).where(F.col("size") >= cut).select("sample"), "sample", "left_semi")


def structural_zeros(counts: DataFrame, groups: DataFrame, neg_lb: bool = False) -> DataFrame:
    """taxon, grp, is_zero. ``groups``: sample, grp; samples with a null group take no part.

    A taxon is a structural zero in a group without any of it or, with ``neg_lb``, where the lower bound of its share of
    the group's samples is not positive. The share is of all samples, the bound's spread of those not missing.
    """
    own = groups.where("grp IS NOT NULL")
    sizes = own.groupBy("grp").agg(F.count("*").alias("size"))
    seen = counts.join(own, "sample").groupBy("taxon", "grp").agg(F.count_if(F.col("n") != 0).alias("present"), F.count_if(F.col("n").isNull()).alias("missing"))
    # Groups are few (a level each), so the grid has a row for each taxon and level.
    grid = counts.select("taxon").distinct().join(F.broadcast(sizes))
    joined = grid.join(seen, ["taxon", "grp"], "left").fillna(0, ["present", "missing"])
    p = F.col("present") / F.col("size")
    bound = p - 1.96 * F.sqrt(F.try_divide(p * (1 - p), F.col("size") - F.col("missing")))
    flag = F.col("present") == 0
    if neg_lb:
        flag = flag | F.coalesce(bound <= 0, F.lit(False))
    return joined.select("taxon", "grp", flag.alias("is_zero"))


def without_structural_zeros(counts: DataFrame, zeros: DataFrame) -> DataFrame:
    """Rows of taxa that are a structural zero in no group."""
    return counts.join(zeros.where("is_zero").select("taxon").distinct(), "taxon", "left_anti")


def two_tables(counts: DataFrame, n_samples: int, zeros: DataFrame | None = None, prv_cut: float = 0.1, lib_cut: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The screened table, and the same without taxa that are structural zeros; both have the same samples."""
    first = library_filter(prevalence_filter(counts, n_samples, prv_cut), lib_cut)
    return first, first if zeros is None else without_structural_zeros(first, zeros)


def group_sizes(samples: DataFrame, group: str) -> DataFrame:
    return samples.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("grp")).agg(F.count("*").alias("size"))


def check_groups(samples: DataFrame, group: str) -> list[str]:
    """Warnings about the group's levels. Fewer than two, or a level of one sample, is an error."""
    sizes = {r.grp: r["size"] for r in group_sizes(samples, group).collect()}  # a row for each level
    if len(sizes) < 2:
        raise ValueError("the group has fewer than two levels")
    if min(sizes.values()) < 2:
        raise ValueError("a level of the group has fewer than two samples")
    found = ["fewer than three levels: no global or pairwise test"] if len(sizes) < 3 else []
    return found + [f"level {g} has fewer than five samples" for g, n in sorted(sizes.items()) if n < 5]
