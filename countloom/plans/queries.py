"""The registered queries over the star-schema tables, and the DuckDB SQL that checks them.

Counts are order lines by part attribute (the taxon) and customer (the sample); the group is the market segment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.functions.padjust import METHODS, adjust
from countloom.operators import screens, transforms
from countloom.sources.counts import aggregate_taxa, densify, from_events
from countloom.sources.shared import kept

Query = Callable[[SparkSession, str], DataFrame]

LEVELS = {"dense": "p_brand", "sparse": "concat_ws('/', p_brand, p_type)", "very_sparse": "concat_ws('/', p_brand, cast(p_size as string))"}


def counts(spark: SparkSession, d: str, kind: str = "dense") -> DataFrame:
    """Lines by taxon and customer. The three tables are joined on their keys; only the columns used are read."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(LEVELS[kind]).alias("name"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return from_events(rows, F.col("name"), F.col("o_custkey").cast("string"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("sample"), F.col("c_mktsegment").alias("grp"), F.col("c_acctbal").alias("x"))


def n_samples(spark: SparkSession, d: str) -> int:
    return spark.read.parquet(f"{d}/customer.parquet").count()


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def scores(spark: SparkSession, d: str) -> DataFrame:
    """taxon, coef, p: a p-value-like score with ties, from whole numbers."""
    own = counts(spark, d, "sparse").join(samples(spark, d), "sample").groupBy("taxon", F.col("grp").alias("coef")).agg(F.sum("n").cast("long").alias("total"))
    return own.select("taxon", "coef", (((F.col("total") * 37) % 200 + 1) / 4000).alias("p"))


def group_means(spark: SparkSession, d: str) -> DataFrame:
    """taxon, coef, lfc, variance: the group means of the centred logs and their squared standard errors."""
    logs = transforms.center(transforms.log_counts(counts(spark, d))).join(samples(spark, d), "sample")
    return logs.groupBy("taxon", F.col("grp").alias("coef")).agg(F.avg("y").alias("lfc"), (F.var_samp("y") / F.count("y")).alias("variance"))


_COUNTS = """WITH counts AS (
  SELECT {name} AS taxon, CAST(o_custkey AS VARCHAR) AS sample, CAST(count(*) AS DOUBLE) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), samples AS (SELECT CAST(c_custkey AS VARCHAR) AS sample, c_mktsegment AS grp, c_acctbal AS x FROM customer)"""
_NAMES = {"dense": "p_brand", "sparse": "p_brand || '/' || p_type", "very_sparse": "p_brand || '/' || CAST(p_size AS VARCHAR)"}
_DENSE = ", dense AS (SELECT taxon, sample, coalesce(n, 0.0) AS n FROM (SELECT DISTINCT taxon FROM counts) CROSS JOIN (SELECT sample FROM samples) LEFT JOIN counts USING (taxon, sample))"
_LOGS = ", logs AS (SELECT taxon, sample, ln(n) AS y FROM counts)"
_CENTRED = _LOGS + ", centred AS (SELECT taxon, sample, y - avg(y) OVER (PARTITION BY taxon) AS y FROM logs)"
_PREVALENCE = ", prevalence AS (SELECT taxon, count(*) FILTER (n <> 0) / (SELECT count(*) FROM samples)::DOUBLE AS prevalence FROM counts GROUP BY taxon)"
_ZEROS = """, sizes AS (SELECT grp, count(*) AS size FROM samples GROUP BY grp
), seen AS (SELECT taxon, grp, count(*) AS present FROM counts JOIN samples USING (sample) GROUP BY 1, 2
), shares AS (
  SELECT taxon, grp, size, coalesce(present, 0) AS present, coalesce(present, 0) / size::DOUBLE AS p
  FROM (SELECT DISTINCT taxon FROM counts) CROSS JOIN sizes LEFT JOIN seen USING (taxon, grp)
), zeros AS (SELECT taxon, grp, present = 0 AS is_zero FROM shares
), zeros_lb AS (SELECT taxon, grp, present = 0 OR p - 1.96 * sqrt(p * (1 - p) / size) <= 0 AS is_zero FROM shares)"""
_SCORES = """, scores AS (
  SELECT taxon, grp AS coef, ((CAST(sum(n) AS BIGINT) * 37) % 200 + 1) / 4000.0 AS p FROM counts JOIN samples USING (sample) GROUP BY 1, 2
), ranked AS (
  SELECT *, CAST(count(*) OVER (PARTITION BY coef) AS DOUBLE) AS n, CAST(row_number() OVER (PARTITION BY coef ORDER BY p, taxon) AS DOUBLE) AS i FROM scores)"""
_UP = "OVER (PARTITION BY coef ORDER BY p, taxon ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ON = "OVER (PARTITION BY coef ORDER BY p, taxon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_ADJUSTED = {
    "none": "p",
    "bonferroni": "least(1.0, n * p)",
    "holm": f"least(1.0, max((n + 1 - i) * p) {_UP})",
    "hochberg": f"least(1.0, min((n + 1 - i) * p) {_ON})",
    "bh": f"least(1.0, min(n / i * p) {_ON})",
    "by": f"least(1.0, min(list_sum(list_transform(range(1, CAST(n AS BIGINT) + 1), lambda k: 1.0 / k)) * n / i * p) {_ON})",
}


def sql(body: str, kind: str = "dense", *parts: str) -> str:
    return _COUNTS.format(name=_NAMES[kind]) + "".join(parts) + "\n" + body


_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, run: Query, oracle: str | None) -> None:
    _QUERIES[name] = (run, oracle)


register("counts_build", lambda s, d: counts(s, d), sql("SELECT * FROM counts"))
register("counts_build_very_sparse", lambda s, d: counts(s, d, "very_sparse"), sql("SELECT * FROM counts", "very_sparse"))
register("densify", lambda s, d: densify(counts(s, d), samples(s, d)), sql("SELECT * FROM dense", "dense", _DENSE))
register(
    "tax_aggregate",
    lambda s, d: aggregate_taxa(counts(s, d, "sparse"), counts(s, d, "sparse").select("taxon").distinct().withColumn("genus", F.split("taxon", "/")[0]), "genus"),
    sql("SELECT split_part(taxon, '/', 1) AS taxon, sample, sum(n) AS n FROM counts GROUP BY 1, 2", "sparse"),
)
register("prevalence", lambda s, d: rounded(screens.prevalence(counts(s, d, "sparse"), n_samples(s, d)), "prevalence", places=8), sql("SELECT taxon, round(prevalence, 8) AS prevalence FROM prevalence", "sparse", _PREVALENCE))
register("prevalence_filter", lambda s, d: screens.prevalence_filter(counts(s, d, "sparse"), n_samples(s, d), 0.2), sql("SELECT counts.* FROM counts JOIN prevalence USING (taxon) WHERE prevalence >= 0.2", "sparse", _PREVALENCE))
register("library_size", lambda s, d: screens.library_size(counts(s, d)), sql("SELECT sample, sum(n) AS size FROM counts GROUP BY sample"))
register("library_filter", lambda s, d: screens.library_filter(counts(s, d), 40), sql("SELECT * FROM counts WHERE sample IN (SELECT sample FROM counts GROUP BY sample HAVING sum(n) >= 40)"))
register("structural_zeros", lambda s, d: screens.structural_zeros(counts(s, d, "very_sparse"), samples(s, d)), sql("SELECT * FROM zeros", "very_sparse", _ZEROS))
register("structural_zeros_bound", lambda s, d: screens.structural_zeros(counts(s, d, "very_sparse"), samples(s, d), neg_lb=True), sql("SELECT * FROM zeros_lb", "very_sparse", _ZEROS))
register(
    "structural_zero_filter",
    lambda s, d: screens.without_structural_zeros(counts(s, d, "very_sparse"), screens.structural_zeros(counts(s, d, "very_sparse"), samples(s, d))),
    sql("SELECT * FROM counts WHERE taxon NOT IN (SELECT taxon FROM zeros WHERE is_zero)", "very_sparse", _ZEROS),
)
register(
    "two_table_screen",
    lambda s, d: (lambda c: (lambda pair: pair[0].withColumn("in_second", F.lit(False)).unionByName(pair[1].withColumn("in_second", F.lit(True))).groupBy("taxon").agg(F.sum("n").alias("total"), F.max("in_second").alias("in_second")))(screens.two_tables(c, n_samples(s, d), screens.structural_zeros(c, samples(s, d), True), 0.05)))(counts(s, d, "very_sparse")).withColumn("total", F.when(F.col("in_second"), F.col("total") / 2).otherwise(F.col("total"))),
    sql("SELECT taxon, sum(n) AS total, taxon NOT IN (SELECT taxon FROM zeros_lb WHERE is_zero) AS in_second FROM counts JOIN prevalence USING (taxon) WHERE prevalence >= 0.05 GROUP BY taxon", "very_sparse", _ZEROS, _PREVALENCE),
)
register("group_sizes", lambda s, d: screens.group_sizes(samples(s, d), "grp"), "SELECT c_mktsegment AS grp, count(*) AS size FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
register("log_center", lambda s, d: rounded(transforms.center(transforms.log_counts(counts(s, d))), "y"), sql("SELECT taxon, sample, round(y, 6) AS y FROM centred", "dense", _CENTRED))
register(
    "log_center_pseudo",
    lambda s, d: rounded(transforms.center(transforms.log_counts(densify(counts(s, d), samples(s, d)), 0.5)), "y"),
    sql("SELECT taxon, sample, round(ln(n + 0.5) - avg(ln(n + 0.5)) OVER (PARTITION BY taxon), 6) AS y FROM dense", "dense", _DENSE),
)
register(
    "zero_replaced_log_center",
    lambda s, d: rounded(transforms.center(transforms.log_zero_replaced(densify(counts(s, d), samples(s, d)), 0.1)), "y"),
    sql("SELECT taxon, sample, round(v - avg(v) OVER (PARTITION BY taxon), 6) AS y FROM (SELECT taxon, sample, ln(CASE WHEN n = 0 THEN 0.1 ELSE n END) AS v FROM dense)", "dense", _DENSE),
)
register("row_means", lambda s, d: rounded(transforms.row_means(transforms.log_counts(counts(s, d))), "mean"), sql("SELECT taxon, round(avg(y), 6) AS mean, count(y) AS observed FROM logs GROUP BY taxon", "dense", _LOGS))
register(
    "column_center",
    lambda s, d: (lambda y: rounded(transforms.subtract_by_sample(y, y.groupBy("sample").agg(F.avg("y").alias("theta"))), "y"))(transforms.center(transforms.log_counts(counts(s, d)))),
    sql("SELECT taxon, sample, round(y - avg(y) OVER (PARTITION BY sample), 6) AS y FROM centred", "dense", _CENTRED),
)
register(
    "pattern_groups",
    lambda s, d: transforms.pattern_groups(transforms.log_counts(counts(s, d, "very_sparse"))),
    sql("SELECT taxon, dense_rank() OVER (ORDER BY first)::INTEGER AS pattern FROM (SELECT taxon, min(taxon) OVER (PARTITION BY key) AS first FROM (SELECT taxon, string_agg(sample, ',' ORDER BY sample) AS key FROM counts GROUP BY taxon))", "very_sparse"),
)
register("variance", lambda s, d: rounded(transforms.variances(transforms.log_counts(counts(s, d))), "variance"), sql("SELECT taxon, round(var_samp(y), 6) AS variance FROM logs GROUP BY taxon", "dense", _LOGS))
register(
    "s0_quantile",
    lambda s, d: rounded(transforms.quantile(group_means(s, d), "variance", 0.05, "coef"), "quantile", places=9),
    sql("SELECT coef, round(quantile_cont(variance, 0.05), 9) AS quantile FROM (SELECT taxon, grp AS coef, var_samp(y) / count(y) AS variance FROM centred JOIN samples USING (sample) GROUP BY 1, 2) GROUP BY coef", "dense", _CENTRED),
)
register(
    "winsorize",
    lambda s, d: rounded(transforms.winsorize(transforms.log_counts(counts(s, d)), 0.05), "y"),
    sql("SELECT taxon, sample, round(greatest(least(y, hi), lo), 6) AS y FROM logs JOIN (SELECT taxon, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM logs GROUP BY taxon) USING (taxon)", "dense", _LOGS),
)
register(
    "average_rank",
    lambda s, d: transforms.average_rank(transforms.log_counts(counts(s, d))),
    sql("SELECT taxon, sample, rank() OVER (PARTITION BY taxon ORDER BY n) + (count(*) OVER (PARTITION BY taxon, n) - 1) / 2.0::DOUBLE AS rank FROM counts"),
)
register("cooccurrence", lambda s, d: transforms.cooccurrence(counts(s, d)), sql("SELECT x.taxon AS a, y.taxon AS b, count(*) AS n FROM counts x JOIN counts y ON x.sample = y.sample AND x.taxon < y.taxon GROUP BY 1, 2"))
register(
    "pearson",
    lambda s, d: rounded(transforms.pearson(transforms.log_counts(counts(s, d))), "r"),
    sql("SELECT x.taxon AS a, y.taxon AS b, round(corr(x.y, y.y), 6) AS r, count(*) AS n FROM logs x JOIN logs y ON x.sample = y.sample AND x.taxon < y.taxon GROUP BY 1, 2", "dense", _LOGS),
)
register(
    "contrasts",
    lambda s, d: rounded(transforms.contrasts(group_means(s, d).select("taxon", "coef", "lfc")), "lfc"),
    sql("SELECT taxon, coef AS contrast, round(lfc, 6) AS lfc FROM m UNION ALL SELECT x.taxon, y.coef || '_' || x.coef, round(y.lfc - x.lfc, 6) FROM m x JOIN m y ON x.taxon = y.taxon AND x.coef < y.coef", "dense", _CENTRED, ", m AS (SELECT taxon, grp AS coef, avg(y) AS lfc FROM centred JOIN samples USING (sample) GROUP BY 1, 2)"),
)
register(
    "weighted_difference",
    lambda s, d: rounded(transforms.weighted_difference(transforms.center(transforms.log_counts(counts(s, d))).join(transforms.variances(transforms.log_counts(counts(s, d))), "taxon")), "diff"),
    sql("SELECT sample, round(sum(y / variance) / sum(1 / variance), 6) AS diff FROM centred JOIN (SELECT taxon, var_samp(y) AS variance FROM logs GROUP BY taxon) USING (taxon) GROUP BY sample", "dense", _CENTRED),
)
register(
    "wald_one_factor",
    lambda s, d: rounded(group_means(s, d).select("taxon", "coef", (F.col("lfc") / F.sqrt("variance")).alias("W")), "W"),
    sql("SELECT taxon, grp AS coef, round(avg(y) / sqrt(var_samp(y) / count(y)), 6) AS W FROM centred JOIN samples USING (sample) GROUP BY 1, 2", "dense", _CENTRED),
)
register(
    "sensitivity_scores",
    lambda s, d: rounded(transforms.sensitivity_scores(counts(s, d, "sparse").join(samples(s, d), "sample").select("taxon", F.col("grp").alias("term"), (F.col("n") / 40).alias("value"))), "ss"),
    sql("SELECT taxon, grp AS term, round(avg(CASE WHEN n / 40 > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS ss, avg(CASE WHEN n / 40 > 0.05 THEN 1.0 ELSE 0.0 END) IN (0, 1) AS passed FROM counts JOIN samples USING (sample) GROUP BY 1, 2", "sparse"),
)
for _m in METHODS:
    if _m != "fdr":
        register(
            f"p_adjust_{_m}",
            lambda s, d, m=_m: rounded(adjust(scores(s, d), "p", ["coef"], "taxon", m), "q", places=9),
            sql(f"SELECT taxon, coef, p, round({_ADJUSTED[_m]}, 9) AS q FROM ranked", "sparse", _SCORES) if _m in _ADJUSTED else None,
        )
register(
    "p_adjust_holm_fractional",
    lambda s, d: rounded(adjust(scores(s, d), "p", ["taxon"], "coef", "holm", n=F.lit(7.5)), "q", places=9),
    sql("SELECT taxon, coef, p, round(least(1.0, max((7.5 + 1 - i) * p) OVER (PARTITION BY taxon ORDER BY p, coef ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM (SELECT taxon, coef, p, row_number() OVER (PARTITION BY taxon ORDER BY p, coef) AS i FROM scores)", "sparse", _SCORES),
)


register(
    "variance_chain",
    lambda s, d: (lambda g: _chain(s, g))(group_means(s, d)),
    sql("SELECT taxon, coef, round(sqrt(r + quantile_cont(r, 0.05) OVER (PARTITION BY coef)), 8) AS se FROM (SELECT taxon, coef, v + 0.0001 + 2 * sqrt(v * 0.0001) AS r FROM (SELECT taxon, grp AS coef, var_samp(y) / count(y) AS v FROM centred JOIN samples USING (sample) GROUP BY 1, 2))", "dense", _CENTRED),
)


def _chain(spark: SparkSession, means: DataFrame) -> DataFrame:
    from countloom.plans.analysis import variance_chain

    levels = [r.coef for r in means.select("coef").distinct().collect()]  # five segments
    long = means.select("taxon", "coef", F.lit(0).alias("j"), "lfc", "variance", F.lit(1.0).alias("dof"))
    out = variance_chain(long, spark.createDataFrame([(c, 0.0001) for c in levels], "coef string, vd double"), 0.05)
    return rounded(out.select("taxon", "coef", "se"), "se", places=8)


def _one_factor(spark: SparkSession, d: str, what: str, pseudo: float = 0.5, missing: float | None = 0.1, known_counts: DataFrame | None = None) -> DataFrame:
    """The fit of the segment alone to the centred logs of the filled-up table, or of the table with gaps (``pseudo`` 0), where
    closed forms exist."""
    import numpy as np

    from countloom.plans import sheets as passes
    from countloom.plans.analysis import centred, long_estimates
    from countloom.plans.formula import check_identifiable, frame, long_design, parse

    own = samples(spark, d)
    plan = frame(own, parse("grp"), "grp")
    if what == "design":
        return long_design(plan)
    gram, _, every = check_identifiable(plan)
    logs = centred(kept(counts(spark, d), "counts") if known_counts is None else known_counts, own, pseudo)
    table = passes.sheets(logs, plan, gram, every)
    known = passes.solvers(table)
    beta, _ = passes.fit(table, known, None, None)
    if what == "fit":
        fits = passes.estimates(table, known, beta, None, missing)
        return rounded(long_estimates(fits, plan).select("taxon", "coef", "lfc", "variance", "dof"), "lfc", places=8).withColumn("variance", F.round("variance", 10))
    theta = passes.theta_of(passes.with_biases(table, passes.unscaled(np.linalg.inv(table.basis), beta)))
    if what == "corrected":
        return rounded(transforms.subtract_by_sample(logs, theta), "y")
    return rounded(theta, "theta")


_FILLED = _DENSE + """, filled AS (SELECT taxon, sample, ln(n + 0.5) - avg(ln(n + 0.5)) OVER (PARTITION BY taxon) AS y FROM dense
), levels AS (SELECT min(grp) AS base FROM samples
), cells AS (SELECT taxon, grp, y, y - avg(y) OVER (PARTITION BY taxon, grp) AS e FROM filled JOIN samples USING (sample)
), level_fits AS (SELECT taxon, grp, avg(y) AS m, sum(e * e) / (count(*) * count(*)) AS v FROM cells GROUP BY 1, 2
), base_fits AS (SELECT taxon, m AS m0, v AS v0 FROM level_fits, levels WHERE grp = base
), size AS (SELECT (count(*) - count(DISTINCT grp))::DOUBLE AS dof FROM samples)"""
register(
    "one_factor_fit",
    lambda s, d: _one_factor(s, d, "fit"),
    sql("SELECT taxon, '(Intercept)' AS coef, round(m0, 8) AS lfc, round(v0, 10) AS variance, dof FROM base_fits, size UNION ALL SELECT taxon, 'grp' || grp, round(m - m0, 8), round(v + v0, 10), dof FROM level_fits JOIN base_fits USING (taxon), levels, size WHERE grp <> base", "dense", _FILLED),
)
_GAPS = _CENTRED + """, cells AS (SELECT taxon, grp, y, avg(y) OVER (PARTITION BY taxon, grp) AS m FROM centred JOIN samples USING (sample)
), sizes AS (SELECT grp, count(*)::DOUBLE AS n FROM samples GROUP BY grp
), level_fits AS (SELECT taxon, grp, any_value(m) AS m, any_value(n) AS n, sum((y - m) ** 2) / any_value(n) ** 2 AS v, count(*)::DOUBLE AS seen FROM cells JOIN sizes USING (grp) GROUP BY 1, 2
), gaps AS (SELECT taxon, (SELECT sum(n) FROM sizes) - sum(seen) AS gaps, sum(seen) - count(*) AS dof FROM level_fits GROUP BY taxon
), base_fits AS (SELECT taxon, m AS m0, v AS v0, (2 - (SELECT count(*) FROM sizes)) / n AS w0 FROM level_fits WHERE grp = (SELECT min(grp) FROM sizes))"""
for _rule, _missing in (("", 0.1), ("_strict", 0.0)):  # what a missing cell adds to every entry of the sandwich's middle
    register(
        f"one_factor_fit_gaps{_rule}",
        lambda s, d, m=_missing: _one_factor(s, d, "fit", 0.0, m or None),
        sql(
            f"SELECT taxon, '(Intercept)' AS coef, round(m0, 8) AS lfc, round(v0 + {_missing} * gaps * w0 ** 2, 10) AS variance, dof FROM base_fits JOIN gaps USING (taxon) "
            f"UNION ALL SELECT taxon, 'grp' || grp, round(m - m0, 8), round(v + v0 + {_missing} * gaps * (1 / n - w0) ** 2, 10), dof FROM level_fits JOIN base_fits USING (taxon) JOIN gaps USING (taxon) WHERE grp <> (SELECT min(grp) FROM sizes)",
            "dense",
            _GAPS,
        ),
    )
register(
    "sampling_fractions_one_factor",
    lambda s, d: _one_factor(s, d, "theta"),
    sql("SELECT sample, round(avg(y - m), 6) AS theta FROM filled JOIN samples USING (sample) JOIN level_fits USING (taxon, grp) GROUP BY sample", "dense", _FILLED),
)
register(
    "bias_corrected_one_factor",
    lambda s, d: _one_factor(s, d, "corrected"),
    sql("SELECT taxon, sample, round(y - avg(y - m) OVER (PARTITION BY sample), 6) AS y FROM filled JOIN samples USING (sample) JOIN level_fits USING (taxon, grp)", "dense", _FILLED),
)


def _across(spark: SparkSession, d: str) -> DataFrame:
    from countloom.sources.results import fractions_across

    own = kept(counts(spark, d), "counts")
    return fractions_across({n: _one_factor(spark, d, "theta", v, known_counts=own) for n, v in (("half", 0.5), ("whole", 1.0))})


register(
    "sampling_fractions_across",
    _across,
    sql(
        "SELECT sample, half, whole FROM (SELECT sample, round(avg(y - m), 6) AS half FROM filled JOIN samples USING (sample) JOIN level_fits USING (taxon, grp) GROUP BY sample) JOIN "
        "(SELECT sample, round(avg(y - m), 6) AS whole FROM (SELECT taxon, sample, y, avg(y) OVER (PARTITION BY taxon, grp) AS m FROM (SELECT taxon, sample, grp, ln(n + 1) - avg(ln(n + 1)) OVER (PARTITION BY taxon) AS y FROM dense JOIN samples USING (sample))) GROUP BY sample) USING (sample)",
        "dense",
        _FILLED,
    ),
)
register(
    "design_table",
    lambda s, d: _one_factor(s, d, "design"),
    "WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS sample, c_mktsegment AS grp FROM customer) SELECT sample, '(Intercept)' AS coef, 1.0::DOUBLE AS value FROM s UNION ALL SELECT sample, 'grp' || level, (grp = level)::INTEGER::DOUBLE FROM s, (SELECT DISTINCT grp AS level FROM s WHERE grp > (SELECT min(grp) FROM s))",
)


def _wide(spark: SparkSession, d: str) -> DataFrame:
    from countloom.sources.results import wide

    means = group_means(spark, d)
    levels = sorted(r.coef for r in means.select("coef").distinct().collect())  # five segments
    named = means.select("taxon", "coef", F.round("lfc", 6).alias("lfc"), F.round(F.sqrt("variance"), 6).alias("se"))
    return wide(named, "coef", ["lfc", "se"], levels)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]  # Fixed values: the levels of c_mktsegment.
register(
    "wide_results",
    _wide,
    sql("SELECT taxon, " + ", ".join(f"max({e}) FILTER (grp = '{g}') AS \"{c}_{g}\"" for c, e in (("lfc", "lfc"), ("se", "se")) for g in _SEGMENTS) + " FROM (SELECT taxon, grp, round(avg(y), 6) AS lfc, round(sqrt(var_samp(y) / count(y)), 6) AS se FROM centred JOIN samples USING (sample) GROUP BY 1, 2) GROUP BY taxon", "dense", _CENTRED),
)


def _bound(spark: SparkSession, d: str) -> DataFrame:
    from countloom.sources.results import bound, common_samples

    few, many = counts(spark, d), counts(spark, d, "very_sparse").withColumn("extra", F.lit(1))
    shared = common_samples([few, many])
    return bound({k: t.join(shared, "sample", "left_semi") for k, t in (("few", few), ("many", many))})


register(
    "bound_tables",
    _bound,
    _COUNTS.format(name=_NAMES["dense"]).split(", samples AS")[0] + ", more AS (SELECT p_brand || '/' || CAST(p_size AS VARCHAR) AS taxon, CAST(o_custkey AS VARCHAR) AS sample, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT 'few - ' || taxon AS taxon, sample, n, NULL::INTEGER AS extra FROM counts WHERE sample IN (SELECT sample FROM more) UNION ALL SELECT 'many - ' || taxon, sample, n, 1 FROM more WHERE sample IN (SELECT sample FROM counts)",
)


def _arms(spark: SparkSession, d: str) -> DataFrame:
    from countloom.sources.results import arms

    return rounded(arms(group_means(spark, d), ["taxon"], "coef", "lfc"), "difference")


register(
    "arm_differences",
    _arms,
    sql("SELECT x.taxon, x.coef AS coef_a, y.coef AS coef_b, round(y.lfc - x.lfc, 6) AS difference FROM m x JOIN m y ON x.taxon = y.taxon AND x.coef < y.coef", "dense", _CENTRED, ", m AS (SELECT taxon, grp AS coef, avg(y) AS lfc FROM centred JOIN samples USING (sample) GROUP BY 1, 2)"),
)


def _results(spark: SparkSession, d: str, what: str) -> DataFrame:
    from countloom.sources.results import calibration, verdicts

    if what == "calibration":
        return rounded(calibration(group_means(spark, d).withColumn("se", F.sqrt("variance")), "coef"), "spread", "mean_se", "ratio", places=8)
    hits = counts(spark, d).join(samples(spark, d), "sample").groupBy("taxon", "grp").agg(F.count_if(F.col("n") == 1).alias("hits"), F.count("*").alias("trials"))
    return rounded(verdicts(hits, 0.5, "grp"), "rate", "se", places=8)


register(
    "se_calibration",
    lambda s, d: _results(s, d, "calibration"),
    sql("SELECT coef, count(lfc) AS n, round(stddev_samp(lfc), 8) AS spread, round(avg(se), 8) AS mean_se, round(avg(se) / stddev_samp(lfc), 8) AS ratio FROM (SELECT taxon, grp AS coef, avg(y) AS lfc, sqrt(var_samp(y) / count(y)) AS se FROM centred JOIN samples USING (sample) GROUP BY 1, 2) GROUP BY coef", "dense", _CENTRED),
)
register(
    "rate_verdicts",
    lambda s, d: _results(s, d, "verdicts"),
    sql("SELECT grp, round(hits / trials, 8) AS rate, round(sqrt(0.25 / trials), 8) AS se, abs(hits / trials - 0.5) <= 3 * sqrt(0.25 / trials) AS within FROM (SELECT grp, (count(*) FILTER (n = 1))::DOUBLE AS hits, count(*)::DOUBLE AS trials FROM counts JOIN samples USING (sample) GROUP BY grp)"),
)


def _analysis(kind: str, out: str, **how) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from countloom.plans.analysis import Config, analyze

        result = analyze(counts(spark, d, kind), samples(spark, d), Config(**({"formula": "grp + x", "group": "grp"} | how)))
        return getattr(result, out)

    return run


register("analysis_primary", _analysis("dense", "primary"), None)
register("analysis_primary_structural_zeros", _analysis("very_sparse", "primary", struc_zero=True, neg_lb=True, prv_cut=0.05), None)
register("analysis_global", _analysis("dense", "global_test", global_test=True), None)
register("analysis_pairwise", _analysis("dense", "pairwise", pairwise=True), None)


def _reported(spark: SparkSession, d: str, what: str) -> DataFrame:
    from countloom.plans.analysis import Config, analyze
    from countloom.sources.sinks import contract_tables, summary

    result = analyze(counts(spark, d), samples(spark, d), Config("grp + x", group="grp", global_test=True, pairwise=True))
    return summary(result) if what == "summary" else contract_tables(result)[what]


for _table in ("res", "res_global", "res_pair", "summary"):
    register(f"analysis_table_{_table}", lambda s, d, w=_table: _reported(s, d, w), None)
register("analysis_sampling_fractions", _analysis("dense", "theta"), None)


def _blocks(spark: SparkSession, d: str, what: str) -> DataFrame:
    """Mixed models of a balanced table, where closed forms exist: lines by brand in each nation and segment, nations random."""
    from countloom.plans.analysis import Config
    from countloom.plans.mixed import likelihood_ratio_test, long_fits, mixed_fits

    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey")
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand")
    customer = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment")
    segments = sorted(r[0] for r in customer.select("c_mktsegment").distinct().collect())  # five
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("nation"))
    own = nations.withColumn("grp", F.explode(F.array(*map(F.lit, segments)))).withColumn("sample", F.concat_ws("/", "nation", "grp"))
    logs = transforms.log_counts(densify(from_events(rows, F.col("p_brand"), name), own), 0.5)
    est, classes, design, q = mixed_fits(logs, own, Config("1" if what == "one_way" else "grp", group="grp"), "(1 | nation)")
    if what == "ratio":
        return rounded(likelihood_ratio_test(classes, design, q, "grp", "none", 0.05).select("taxon", "W", "p"), "W", "p")
    return rounded(long_fits(est, design.columns).select("taxon", "coef", "lfc", "variance", "dof"), "lfc", "variance", places=7).withColumn("dof", F.round("dof", 3))


_BLOCKS = """WITH cells AS (
  SELECT taxon, nation, grp, ln(coalesce(n, 0) + 0.5) AS y FROM (SELECT DISTINCT p_brand AS taxon FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
  CROSS JOIN (SELECT n_nationkey AS nation FROM nation) CROSS JOIN (SELECT DISTINCT c_mktsegment AS grp FROM customer)
  LEFT JOIN (SELECT p_brand AS taxon, c_nationkey AS nation, c_mktsegment AS grp, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) USING (taxon, nation, grp)
), means AS (SELECT *, avg(y) OVER (PARTITION BY taxon) AS m, avg(y) OVER (PARTITION BY taxon, nation) AS mn, avg(y) OVER (PARTITION BY taxon, grp) AS mg FROM cells
), squares AS (SELECT taxon, count(DISTINCT nation)::DOUBLE AS a, count(DISTINCT grp)::DOUBLE AS k, any_value(m) AS m, sum((mn - m) ** 2) AS ssa, sum((mg - m) ** 2) AS sst, sum((y - mn - mg + m) ** 2) AS sse FROM means GROUP BY taxon
), size AS (SELECT *, a * k AS n, ssa / (a - 1) AS msa, sse / ((a - 1) * (k - 1)) AS mse, (sse + sst) / (a * (k - 1)) AS msw FROM squares)"""
register(
    "mixed_one_way",
    lambda s, d: _blocks(s, d, "one_way"),
    _BLOCKS + """ SELECT taxon, '(Intercept)' AS coef, round(m, 7) AS lfc, round(CASE WHEN msa > msw THEN msa ELSE (ssa + sse + sst) / (n - 1) END / n, 7) AS variance, round(CASE WHEN msa > msw THEN a - 1 ELSE n - 1 END, 3) AS dof FROM size""",
)
register(
    "mixed_blocks",
    lambda s, d: _blocks(s, d, "blocks"),
    _BLOCKS + """, parts AS (SELECT *, msa > mse AS inside, (ssa + sse) / (n - k) AS pooled, msa / k AS u, mse * (k - 1) / k AS v FROM size
), base AS (SELECT taxon, avg(y) AS m0 FROM cells WHERE grp = (SELECT min(c_mktsegment) FROM customer) GROUP BY taxon)
SELECT taxon, '(Intercept)' AS coef, round(m0, 7) AS lfc, round(CASE WHEN inside THEN u + v ELSE pooled END / a, 7) AS variance, round(CASE WHEN inside THEN (u + v) ** 2 / (u ** 2 / (a - 1) + v ** 2 / ((a - 1) * (k - 1))) ELSE n - k END, 3) AS dof FROM parts JOIN base USING (taxon)
UNION ALL SELECT taxon, 'grp' || grp, round(mg - m0, 7), round(2 * CASE WHEN inside THEN mse ELSE pooled END / a, 7), round(CASE WHEN inside THEN (a - 1) * (k - 1) ELSE n - k END, 3)
FROM parts JOIN base USING (taxon) JOIN (SELECT taxon, grp, avg(y) AS mg FROM cells GROUP BY 1, 2) USING (taxon) WHERE grp > (SELECT min(c_mktsegment) FROM customer)""",
)
register(
    "mixed_likelihood_ratio",
    lambda s, d: _blocks(s, d, "ratio"),
    _BLOCKS + """, best AS (SELECT *, CASE WHEN ssa / a > sse / (a * (k - 1)) THEN a * ln(ssa / a) + a * (k - 1) * ln(sse / (a * (k - 1))) ELSE n * ln((ssa + sse) / n) END AS full_dev,
  CASE WHEN ssa / a > (sse + sst) / (a * (k - 1)) THEN a * ln(ssa / a) + a * (k - 1) * ln((sse + sst) / (a * (k - 1))) ELSE n * ln((ssa + sse + sst) / n) END AS less_dev FROM size)
SELECT taxon, round(less_dev - full_dev, 6) AS W, round(exp((full_dev - less_dev) / 2) * (1 + (less_dev - full_dev) / 2), 6) AS p FROM best""",
)


def _mixed(spark: SparkSession, d: str, what: str) -> DataFrame:
    from countloom.plans.analysis import Config
    from countloom.plans.mixed import analyze_mixed

    own = samples(spark, d).join(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("sample"), F.col("c_nationkey").alias("nation")), "sample")
    cfg = Config("grp + x", group="grp", global_test=what == "global_test", pairwise=what == "pairwise")
    return getattr(analyze_mixed(counts(spark, d), own, cfg, "(1 | nation)"), what)


for _what in ("primary", "global_test", "pairwise"):
    register(f"analysis_mixed_{_what}", lambda s, d, w=_what: _mixed(s, d, w), None)


def _companion(spark: SparkSession, d: str, what: str) -> DataFrame:
    import numpy as np

    from countloom.plans import analysis, correlations, group_tests, log_ratios, sensitivity

    table, own = kept(counts(spark, d), "counts"), samples(spark, d)
    cfg = analysis.Config("grp + x", group="grp", global_test=True, pairwise=True)
    if what == "plain":
        return analysis.analyze_plain(table, own, analysis.Config("grp + x", group="grp", pseudo=1, tol=1e-5, max_iter=100)).primary
    if what == "conservative":
        return sensitivity.conservative(table, own, cfg)["primary"]
    if what == "nonconservative":
        return sensitivity.nonconservative(analysis.analyze(table, own, cfg), cfg)["primary"]
    if what == "dunnett":
        return group_tests.dunnett(analysis.analyze(table, own, cfg), cfg)
    if what == "trend":
        up = np.eye(4) - np.eye(4, k=-1)
        return group_tests.trend(analysis.analyze(table, own, cfg), cfg, {"up": (up, 3), "down": (-up, 3)})
    if what == "log_ratios":
        return log_ratios.log_ratio_tests(table, own, "grp")[0]
    if what == "many_to_one_sensitivity":
        return sensitivity.nonconservative(analysis.analyze(table, own, cfg), cfg, many_to_one=True)["dunnett"]
    if what == "distance":
        return correlations.distance_correlations(table, own, lib_cut=0, permutations=19)
    if what in ("pearson", "spearman"):
        return correlations.linear_correlations(table, own, lib_cut=0, method=what)
    raise ValueError(what)


def _two_tables(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of brands and of brands' sizes as two tables, over the customers of both."""
    from countloom.plans.correlations import linear_correlations

    tables = {"brand": kept(counts(spark, d), "counts"), "size": kept(counts(spark, d, "very_sparse"), "counts")}
    found = linear_correlations(tables, prv_cut=0.02, lib_cut=0, n_cv=2, corr_cut=0.3, regular=False)
    return rounded(found.select("a", "b", "n", "corr"), "corr")


def _abundances(name: str, counts: str) -> str:
    return f""", {name}_kept AS (SELECT taxon, sample, n FROM {counts} JOIN (SELECT taxon FROM {counts} GROUP BY taxon HAVING count(*) / (SELECT count(DISTINCT sample) FROM {counts})::DOUBLE >= 0.02) USING (taxon)
), {name}_logs AS (SELECT taxon, sample, ln(n) - avg(ln(n)) OVER (PARTITION BY taxon) AS y FROM {name}_kept
), {name}_bias AS (SELECT sample, sum(y / v) / sum(1 / v) AS diff FROM {name}_logs JOIN (SELECT taxon, var_samp(y) AS v FROM {name}_logs GROUP BY taxon HAVING var_samp(y) > 0) USING (taxon) GROUP BY sample
), {name}_y AS (SELECT '{name} - ' || taxon AS taxon, sample, y - diff AS y FROM {name}_logs JOIN {name}_bias USING (sample))"""


register(
    "correlations_two_tables",
    _two_tables,
    _COUNTS.format(name=_NAMES["dense"]).split(", samples AS")[0]
    + ", more AS (SELECT p_brand || '/' || CAST(p_size AS VARCHAR) AS taxon, CAST(o_custkey AS VARCHAR) AS sample, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
    + _abundances("brand", "counts")
    + _abundances("size", "more")
    + """, y AS (SELECT * FROM brand_y UNION ALL SELECT * FROM size_y
), clipped AS (SELECT taxon, sample, greatest(least(y, hi), lo) AS y FROM y JOIN (SELECT taxon, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.95) AS hi FROM y GROUP BY taxon) USING (taxon)
), marked AS (SELECT y.taxon, corr(y.y, b.diff) > 0.3 AS brand_like, corr(y.y, s.diff) > 0.3 AS size_like FROM y LEFT JOIN brand_bias b USING (sample) LEFT JOIN size_bias s USING (sample) GROUP BY y.taxon
), pairs AS (SELECT x.taxon AS a, z.taxon AS b, count(*) AS n, count(*) FILTER (x.y <> 0 AND z.y <> 0) AS shared, CASE WHEN count(*) > 1 AND stddev_pop(x.y) > 0 AND stddev_pop(z.y) > 0 THEN corr(x.y, z.y) END AS r FROM clipped x JOIN clipped z ON x.sample = z.sample AND x.taxon < z.taxon GROUP BY 1, 2)
SELECT a, b, n, round(CASE WHEN coalesce(p.brand_like AND q.brand_like, false) OR coalesce(p.size_like AND q.size_like, false) OR shared < 2 OR r IS NULL OR isnan(r) THEN 0 ELSE r END, 6) AS corr
FROM pairs JOIN marked p ON p.taxon = a JOIN marked q ON q.taxon = b""",
)


def _losses(spark: SparkSession, d: str) -> DataFrame:
    from countloom.plans.correlations import losses_of, pair_correlations, pair_rows, with_splits

    logs = kept(transforms.log_counts(counts(spark, d)).where("y IS NOT NULL"), "logs")
    together = with_splits(pair_rows(logs), logs.select("sample").distinct(), 3, 3)
    found = kept(pair_correlations(together, 3), "found")
    own = [losses_of(found, len(together.taxa), soft, 0.75, 31, (0.0, 0.01)).withColumn("soft", F.lit(soft)) for soft in (False, True)]
    return rounded(own[0].unionByName(own[1]), "thresh", "loss")


register(
    "threshold_losses",
    _losses,
    sql(
        """SELECT soft, round(t, 6) AS thresh, alpha, round(avg(0.5 * sqrt(2 * d2 + CASE WHEN soft THEN taxa * t * t ELSE 0 END) + alpha * 2 * penalty), 6) AS loss FROM (
  SELECT split, soft, t, sum((cut - r2) ** 2) AS d2, sum(CASE WHEN abs(r2) < 1e-12 THEN 0 ELSE abs(cut) / abs(r2 + 1e-10) END) AS penalty FROM (
    SELECT split, soft, t, r2, CASE WHEN abs(r1) <= t THEN 0 ELSE sign(r1) * (abs(r1) - CASE WHEN soft THEN t ELSE 0 END) END AS cut FROM rs, (SELECT 0.75::DOUBLE * k / 30 AS t FROM range(31) AS g(k)), (VALUES (false), (true)) AS s(soft)
  ) GROUP BY 1, 2, 3), (VALUES (0.0::DOUBLE), (0.01::DOUBLE)) AS al(alpha), (SELECT count(DISTINCT taxon) AS taxa FROM logs) GROUP BY soft, t, alpha""",
        "dense",
        _LOGS,
        """, size AS (SELECT n, n - floor(n / ln(n)) AS n1 FROM (SELECT count(DISTINCT sample) AS n FROM logs)
), splits AS (SELECT sample, split, row_number() OVER (PARTITION BY split ORDER BY md5(sample || '/' || split || '/3'), sample) <= n1 AS train FROM (SELECT DISTINCT sample FROM logs), range(1, 4) AS g(split), size
), rs AS (SELECT split, corr(x.y, z.y) FILTER (train) AS r1, corr(x.y, z.y) FILTER (NOT train) AS r2 FROM logs x JOIN logs z ON x.sample = z.sample AND x.taxon < z.taxon JOIN splits ON splits.sample = x.sample GROUP BY split, x.taxon, z.taxon
  HAVING r1 IS NOT NULL AND r2 IS NOT NULL AND NOT isnan(r1) AND NOT isnan(r2))""",
    ),
)


for _name, _what in (
    ("analysis_plain", "plain"),
    ("sensitivity_conservative", "conservative"),
    ("sensitivity_nonconservative", "nonconservative"),
    ("dunnett", "dunnett"),
    ("trend", "trend"),
    ("log_ratio_tests", "log_ratios"),
    ("linear_correlations_pearson", "pearson"),
    ("linear_correlations_spearman", "spearman"),
    ("sensitivity_many_to_one", "many_to_one_sensitivity"),
    ("distance_correlations", "distance"),
):
    register(_name, lambda s, d, w=_what: _companion(s, d, w), None)


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _QUERIES.items() if text}
