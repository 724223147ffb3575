from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countloom.functions import dist
from countloom.functions.kernels import bias_mixture, fit_taxon, least_squares, minimise, sandwich
from countloom.functions.padjust import adjust, hommel_array
from countloom.operators import screens, transforms
from countloom.plans import queries as plans
from countloom.plans.analysis import Config, analyze
from countloom.plans.formula import check_identifiable, design, frame, parse
from countloom.plans import sensitivity
from countloom.sources import sinks
from countloom.sources.counts import densify, number_text, read_counts, read_metadata, typed, write_table
from countloom.sources.results import transposed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got, want = plans.queries()[name](spark, SF).toPandas(), con.execute(plans.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(key(got), key(want), check_dtype=False, rtol=1e-9)


def test_missing_cells_are_not_zeros(spark):
    c = spark.createDataFrame([("a", "s1", 1.0), ("a", "s2", None), ("b", "s1", None), ("b", "s2", None)], "taxon string, sample string, n double")
    got = {r.taxon: r.prevalence for r in screens.prevalence(c, 2).collect()}
    assert got == {"a": 1.0, "b": None}
    assert {r.taxon for r in screens.prevalence_filter(c, 2, 0.0).collect()} == {"a"}
    s = spark.createDataFrame([("s1", "g"), ("s2", "h"), ("s3", None)], "sample string, grp string")
    dense = {(r.taxon, r.sample): r.n for r in densify(c, s).collect()}
    assert dense["a", "s2"] is None and dense["a", "s3"] == 0.0 and len(dense) == 6
    zeros = {(r.taxon, r.grp): r.is_zero for r in screens.structural_zeros(c, s).collect()}
    assert zeros == {("a", "g"): False, ("a", "h"): True, ("b", "g"): True, ("b", "h"): True}
    empty = c.limit(0)
    assert screens.prevalence(empty, 2).count() == transforms.center(transforms.log_counts(empty)).count() == 0


def test_tables_are_read_and_written(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("s1\ts2\ts3\nt1\t4\t0\tNA\nt2\t1.5\t\t2\n")
    got = {(r.taxon, r.sample): r.n for r in read_counts(spark, f"{tmp_path}/c.tsv").collect()}
    assert got == {("t1", "s1"): 4.0, ("t1", "s3"): None, ("t2", "s1"): 1.5, ("t2", "s2"): None, ("t2", "s3"): 2.0}
    (tmp_path / "twice.csv").write_text(",s1\nt1,4\nt1,5\n")
    with pytest.raises(ValueError, match="twice"):
        read_counts(spark, f"{tmp_path}/twice.csv")
    (tmp_path / "named.csv").write_text('"a,b",s2\na,1,2\nb,3,0\n')  # a taxon with another's sample's name; a quoted separator
    (tmp_path / "like.csv").write_text("a,s2\na,1,2\nb,3,0\n")
    assert {(r.taxon, r.sample): r.n for r in read_counts(spark, f"{tmp_path}/like.csv").collect()} == {("a", "a"): 1.0, ("a", "s2"): 2.0, ("b", "a"): 3.0}
    assert {r.sample for r in read_counts(spark, f"{tmp_path}/named.csv").collect()} == {"a,b", "s2"}
    for k, bad in enumerate(("s1,s2\nt1,4\n", "s1,s2\nt1,4,5,6\n")):
        (tmp_path / f"bad{k}.csv").write_text(bad)
        with pytest.raises(ValueError, match="width"):
            read_counts(spark, f"{tmp_path}/bad{k}.csv")
    (tmp_path / "m.tsv").write_text("group\tage\ns1\tg1\t3\ns2\tg2\tNA\n")
    assert {r.sample: (r.group, r.age) for r in read_metadata(spark, f"{tmp_path}/m.tsv").collect()} == {"s1": ("g1", "3"), "s2": ("g2", "NA")}
    assert {r.sample: (r.group, r.age) for r in typed(read_metadata(spark, f"{tmp_path}/m.tsv")).collect()} == {"s1": ("g1", 3.0), "s2": ("g2", None)}
    write_table(spark.createDataFrame([("a", None)], "taxon string, p double"), f"{tmp_path}/out")
    assert "NA" in spark.read.text(f"{tmp_path}/out").collect()[-1][0]
    odd = [("a", float("nan")), ("b", float("inf")), ("c", float("-inf")), ("d", 12.0), ("e", 0.1 + 0.2), ("f", -3.0e-5)]
    write_table(spark.createDataFrame(odd, "taxon string, p double").coalesce(1), f"{tmp_path}/odd")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/odd").collect()]
    assert [x.split("\t")[1] for x in lines if not x.startswith("taxon")] == ["NA", "Inf", "-Inf", "12", "0.30000000000000004", "-0.00003"]


P = [0.01, 0.02, 0.03, 0.04, 0.05, 0.011, 0.6]
# R's p.adjust of P.
HOLM = [0.07, 0.1, 0.12, 0.12, 0.12, 0.07, 0.6]
BH = [0.0385, 0.14 / 3, 0.0525, 0.056, 0.35 / 6, 0.0385, 0.6]


@pytest.mark.parametrize("method,want", [("holm", HOLM), ("BH", BH), ("fdr", BH), ("bonferroni", [min(1, 7 * p) for p in P]), ("none", P)])
def test_adjusted_values(spark, method, want):
    rows = [(k, p) for k, p in enumerate(P)] + [(9, None)]
    got = {r.k: r.q for r in adjust(spark.createDataFrame(rows, "k int, p double"), "p", [], "k", method).collect()}
    assert got.pop(9) is None and np.allclose([got[k] for k in range(7)], want)


def test_hommel_lies_between_hochberg_and_the_values():
    rng = np.random.default_rng(0)
    for _ in range(20):
        p = rng.random(rng.integers(2, 12)) ** 2
        q = hommel_array(p)
        order = np.argsort(p)
        hochberg = np.empty(len(p))
        hochberg[order] = np.minimum(1, np.minimum.accumulate(((len(p) - np.arange(len(p))) * p[order])[::-1])[::-1])
        assert (q >= p - 1e-15).all() and (q <= hochberg + 1e-12).all()
    assert np.allclose(hommel_array(np.array([0.01, 0.02])), [0.02, 0.02])
    for family in (2.0, 5.0, 7.9):
        assert np.allclose(hommel_array(np.array([0.01, 0.02]), family), hommel_array(np.array([0.01, 0.02] + [1.0] * (int(family) - 2)))[:2])


def test_hommel_takes_the_size_of_the_family(spark):
    rows = spark.createDataFrame([("x", 1, 0.01), ("x", 2, 0.02), ("x", 3, None)], "f string, k int, p double")
    got = {r.k: r.q for r in adjust(rows, "p", ["f"], "k", "hommel", n=F.lit(6.5)).collect()}
    want = hommel_array(np.array([0.01, 0.02, 1, 1, 1, 1]))
    assert np.allclose([got[1], got[2]], want[:2]) and got[3] is None


def test_tails():
    assert np.allclose(dist.t_two_sided([12.7062047364, 4.30265272991], [1, 2]), 0.05, atol=1e-11)
    assert np.allclose(dist.t_two_sided(1.959963984540054, np.inf), 0.05) and np.isnan(dist.t_two_sided(np.nan, 3))
    assert np.allclose(dist.f_tails(161.4476387975, 1, 1), (0.95, 0.05)) and np.allclose(dist.chi2_tails(5.991464547107979, 2), (0.95, 0.05))
    assert np.allclose(dist.beta_inc([0, 0.5, 1], 2, 2), [0, 0.5, 1])


def test_fits():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(9), rng.normal(size=9), np.repeat([0, 1, 0], 3), np.repeat([0, 0, 1], 3)])
    y = rng.normal(size=9)
    fit = least_squares(x, y)
    assert np.allclose(fit.coef[:, 0], np.linalg.lstsq(x, y, rcond=None)[0]) and fit.dof == 5
    assert np.isnan(least_squares(np.column_stack([x, x[:, 1] * 2]), y).coef[4, 0])
    y[6:] = np.nan  # the last level is never seen
    levels, cols = np.repeat([0, 1, 2], 3), {2: 1, 3: 2}
    coef, fitted, dof = fit_taxon(x, y, levels, cols)
    assert coef[3] == 0 and np.isfinite(coef[:3]).all() and (fitted[6:] == 0).all() and dof == 3
    y[3:] = np.nan
    assert np.isnan(fit_taxon(x, y, levels, cols)[0]).all() and fit_taxon(x, y, levels, cols)[2] == 999
    r = rng.normal(size=9)
    bread = np.linalg.inv(x.T @ x)
    assert np.allclose(sandwich(x, r, bread), bread @ sum(e * e * np.outer(v, v) for e, v in zip(r, x, strict=True)) @ bread)
    assert abs(minimise(lambda v: (v - 2) ** 2, 0.5) - 2) < 1e-2


def test_least_points_match_a_grid():
    rng = np.random.default_rng(6)
    for _ in range(200):
        at, start = rng.exponential(3) * (rng.random() < 0.8), rng.exponential(3)
        assert abs(minimise(lambda v: (v - at) ** 2 * (1 + 0.1 * np.cos(v - at)), start) - at) < 1e-4
    v, e = rng.uniform(0.01, 0.5, 300), rng.normal(0, 1.3, 300)
    loss = lambda k: float((np.log(v + k) + e**2 / (v + k)).sum())
    grid = np.linspace(0, 20, 20001)
    assert abs(minimise(loss, 0.1) - grid[np.argmin([loss(k) for k in grid])]) < 2e-3
    assert minimise(lambda v: v + 1, 5.0) == 0 and abs(minimise(lambda v: abs(v - 1e6), 0.0) - 1e6) < 2


def test_bias_is_found():
    rng = np.random.default_rng(3)
    nu = rng.uniform(0.01, 0.03, 400)
    beta = 0.7 + rng.normal(size=400) * np.sqrt(nu) + np.where(rng.random(400) < 0.1, 2.5, 0) - np.where(rng.random(400) < 0.1, 2.5, 0)
    m = bias_mixture(beta, nu)
    assert abs(m.delta - 0.7) < 0.03 and abs(m.delta_wls - 0.7) < 0.1 and m.l1 < 0 < m.l2
    with pytest.raises(ValueError):
        bias_mixture(beta, np.zeros(400))


def test_mixture_of_values_far_beyond_their_variances():
    beta = np.array([-3.0, -1.0, 0.5, 2.0])
    m = bias_mixture(beta, np.full(4, 1e-9))
    assert np.isfinite([m.delta, m.l1, m.l2, m.kappa1, m.kappa2, m.delta_wls, m.var_delta, *m.pi]).all() and -3 <= m.delta <= 2


def test_formulas(spark):
    assert parse("~ a + b:c + a*d - b").terms == (("a",), ("d",), ("b", "c"), ("a", "d"))
    assert not parse("a - 1").intercept and not parse("0 + a").intercept and parse("x.y").variables == ["x.y"]
    for bad in ("a | b", "log(a)", "a^2", "a +* b"):
        with pytest.raises(ValueError):
            parse(bad)
    s = spark.createDataFrame([(f"s{k}", "uvw"[k % 3], float(k), "pq"[k % 2]) for k in range(12)], "sample string, g string, x double, h string")
    d = design(s, parse("g + x + g:h"), "g")
    assert d.columns[:4] == ["(Intercept)", "gv", "gw", "x"] and d.group_columns == {1: 1, 2: 2}
    check_identifiable(frame(s, parse("g * x"), "g"))
    with pytest.raises(ValueError, match="not identifiable"):
        check_identifiable(frame(s.withColumn("y", s.x * 2), parse("x + y")))
    with pytest.raises(ValueError, match="no such covariate"):
        design(s, parse("nothing"))


# A published example of ten taxa and ten samples in two groups, and its estimates.
COUNTS = [
    [3108, 877, 1764, 846, 395, 635, 210, 641, 2779, 848],
    [1463, 2428, 217, 368, 154, 158, 118, 3178, 770, 845],
    [4910, 59, 1939, 7935, 453, 53, 90, 118, 4966, 762],
    [703, 50, 1629, 718, 55, 171, 311, 67, 809, 5692],
    [885, 699, 1799, 328, 258, 353, 116, 459, 1345, 632],
    [904, 551, 836, 243, 572, 610, 189, 2794, 7704, 1309],
    [330, 659, 1962, 11, 460, 293, 10, 47, 26, 2842],
    [1551, 3129, 4490, 561, 249, 86, 26, 7, 323, 201],
    [195, 340, 569, 217, 348, 118, 111, 230, 621, 198],
    [1199, 1348, 1113, 624, 271, 478, 256, 1035, 1490, 1290],
]
GROUPS = [1, 2, 2, 2, 1, 2, 1, 1, 1, 2]
LFC = [-0.12804373542539554, -0.3980060784316606, -0.44630588247508135, 0.6802468333063155, 0.13183702118576637, -0.8454046556116951, 1.5386279963687264, 1.5262393515424697, -0.23219071533148908, 0.0871273418702468]
SE = [0.43773839334081677, 0.832628616373524, 1.0581659370270007, 0.9158479272365035, 0.4238229491699019, 0.6709499944676526, 1.1177119851071533, 0.9922055151805873, 0.5488739789091792, 0.49314748965126476]
PROBABILITIES = [0.777338186706237, 0.6454307571285246, 0.684295946695071, 0.47887242155236476, 0.7637012414560183, 0.24317703822088102, 0.20593457328333828, 0.1625516844823703, 0.6834149786718093, 0.8641537035202167]

# Another, with a taxon that is rare in one group, at a pseudo-count of one half.
RARE = [
    [41, 41, 38, 44, 33, 25, 40, 36, 37, 52],
    [12, 0, 0, 0, 0, 53, 34, 48, 37, 45],
    [31, 52, 48, 31, 52, 50, 44, 46, 40, 38],
    [37, 49, 46, 39, 48, 37, 35, 32, 35, 35],
    [47, 40, 36, 45, 39, 25, 57, 45, 40, 40],
    [45, 36, 43, 40, 33, 42, 32, 36, 28, 46],
]
RARE_LFC = [0.020830948962377211, 0.11929950075883321, -0.143732718819157, 0.049642081937388595, 0.0015135134563606877]
RARE_SE = [0.24454232225934899, 0.28924106044002418, 0.25105693921242872, 0.24874363050072837, 0.22430875552678076]


def tables(spark, matrix, groups):
    cells = [(f"t{i:02}", f"s{j:02}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]
    return spark.createDataFrame(cells, "taxon string, sample string, n double"), spark.createDataFrame([(f"s{j:02}", str(g)) for j, g in enumerate(groups)], "sample string, group string")


def test_published_estimates(spark):
    result = analyze(*tables(spark, COUNTS, GROUPS), Config("group", group="group"))
    rows = result.primary.toPandas().query("coef == 'group2'").sort_values("taxon")
    assert np.allclose(rows["lfc"], LFC, atol=1e-8) and np.allclose(rows["se"], SE, atol=1e-8) and np.allclose(rows["p"], PROBABILITIES, atol=1e-7)
    assert (rows["q"] == 1).all() and len(result.epsilons) == 2 and abs(result.epsilons[0] - 2.4) < 0.1


def test_a_rare_taxon_is_a_structural_zero(spark):
    own = analyze(*tables(spark, RARE, [1] * 5 + [2] * 5), Config("group", group="group", p_adjust="BH", pseudo=0.5, prv_cut=0, struc_zero=True, neg_lb=True))
    rows = own.primary.toPandas().query("coef == 'group2'").sort_values("taxon")
    assert rows["taxon"].tolist() == ["t00", "t02", "t03", "t04", "t05"]
    # The published bias is of a search that stops within 1e-6 of the mixture's best spreads; ours differs by 1.2e-7.
    assert np.allclose(rows["lfc"], RARE_LFC, atol=1e-6) and np.allclose(rows["se"], RARE_SE, atol=1e-7)
    assert {(r.taxon, r.grp) for r in own.zeros.where("is_zero").collect()} == {("t01", "1")}


# A third, of which one taxon is missing and one zero in most samples of a group.
GAPS = [
    [37, 49, 47, 42, 39, 33, 41, 44, 36, 45],
    [52, 43, 50, 44, 32, 58, 46, 31, 50, 38],
    [None, None, None, 37, 42, 46, 41, 43, 41, 38],
    [0, 0, 0, 33, 47, 53, 36, 37, 49, 46],
    [42, 45, 30, 39, 34, 33, 33, 40, 38, 40],
    [39, 38, 32, 46, 31, 42, 40, 34, 47, 41],
]
GAPS_LFC = [-0.15374079128513832, -0.0809574138051027, -0.10589171020922465, 0.01538822292283294]
GAPS_SE = [0.4036937023148429, 0.431688469136437, 0.39484144102077334, 0.3776064744666667]


def test_missing_counts(spark):
    cells = [(f"t{i}", f"s{j:02}", None if v is None else float(v)) for i, row in enumerate(GAPS) for j, v in enumerate(row) if v != 0]
    counts = spark.createDataFrame(cells, "taxon string, sample string, n double")
    samples = spark.createDataFrame([(f"s{j:02}", "1" if j < 5 else "2") for j in range(10)], "sample string, group string")
    own = analyze(counts, samples, Config("group", group="group", p_adjust="BH", pseudo=0.5, prv_cut=0, struc_zero=True, neg_lb=True))
    rows = own.primary.toPandas().query("coef == 'group2'").sort_values("taxon")
    assert {(r.taxon, r.grp) for r in own.zeros.where("is_zero").collect()} == {("t2", "1"), ("t3", "1")}
    assert rows["taxon"].tolist() == ["t0", "t1", "t4", "t5"] and np.allclose(rows["lfc"], GAPS_LFC, atol=1e-7) and np.allclose(rows["se"], GAPS_SE, atol=1e-7)


# Three more of two groups of five samples: settings, counts, estimates and their errors, taxa kept, structural zeros.
ABSENT = [
    [0, 0, 0, 0, 0, 49, 44, 27, 47, 35],
    [42, 45, 42, 37, 43, 49, 55, 43, 37, 39],
    [36, 38, 37, 30, 45, 46, 48, 31, 33, 49],
    [41, 43, 40, 32, 41, 36, 34, 56, 35, 42],
    [47, 34, 34, 42, 46, 42, 38, 28, 39, 36],
    [43, 45, 49, 39, 26, 43, 30, 47, 31, 47],
]
ABSENT_LFC = [0.031088113063451561, 0.070855200249195158, -0.0075272359850871093, -0.12608414594877462, -0.041290413600772541]
ABSENT_SE = [0.13028313037023448, 0.14781320518939525, 0.16460749416842083, 0.15112798561276178, 0.18741820844627363]
PRESENT = [
    [35, 33, 34, 38, 36, 46, 42, 39, 40, 35],
    [40, 37, 29, 30, 44, 41, 38, 36, 38, 37],
    [31, 40, 38, 36, 43, 40, 47, 45, 39, 35],
    [28, 40, 45, 36, 42, 38, 34, 41, 44, 39],
    [36, 56, 45, 38, 39, 38, 40, 45, 46, 34],
    [47, 38, 41, 40, 36, 44, 33, 37, 48, 19],
]
PRESENT_LFC = [0.044091629778648091, -0.024042312146148652, 0.0015861597356090604, -0.054451898223066959, -0.13435311616085815, -0.23959348213573955]
PRESENT_SE = [0.10586844487741533, 0.12942310224898487, 0.10963496007417083, 0.12690274734212417, 0.11778281661246899, 0.16228891797296882]
AT_THE_CUT = [
    [0, 0, 0, 0, 0, 0, 0, 39, 44, 33],
    [0, 0, 0, 0, 0, 0, 0, 43, 46, 25],
    [0, 0, 0, 0, 0, 0, 0, 0, 38, 54],
    [42, 39, 47, 51, 46, 47, 37, 44, 39, 38],
    [60, 41, 34, 47, 46, 54, 48, 40, 28, 48],
]
AT_THE_CUT_LFC = [2.1010199052926417, 2.0745311858810496, -0.60354542957559842, -0.56292421922568314]
AT_THE_CUT_SE = [1.0368789537492109, 1.0332455657179902, 1.0135581041121311, 1.0612678529369637]


@pytest.mark.parametrize(
    "matrix,cut,zeros,lfc,se,kept,flagged",
    [
        (ABSENT, 0, True, ABSENT_LFC, ABSENT_SE, [1, 2, 3, 4, 5], {("t00", "1")}),
        (PRESENT, 0, True, PRESENT_LFC, PRESENT_SE, [0, 1, 2, 3, 4, 5], set()),
        (AT_THE_CUT, 0.3, False, AT_THE_CUT_LFC, AT_THE_CUT_SE, [0, 1, 3, 4], None),
    ],
    ids=["absent", "present", "at_the_cut"],
)
def test_published_small_cases(spark, matrix, cut, zeros, lfc, se, kept, flagged):
    own = analyze(*tables(spark, matrix, [1] * 5 + [2] * 5), Config("group", group="group", p_adjust="BH", pseudo=0.5, prv_cut=cut, struc_zero=zeros, neg_lb=zeros))
    rows = own.primary.toPandas().query("coef == 'group2'").sort_values("taxon")
    assert rows["taxon"].tolist() == [f"t{k:02}" for k in kept]
    assert np.allclose(rows["lfc"], lfc, atol=1e-6) and np.allclose(rows["se"], se, atol=1e-6)
    assert flagged is None or {(r.taxon, r.grp) for r in own.zeros.where("is_zero").collect()} == flagged


def test_inputs_are_checked(spark):
    counts, samples = tables(spark, COUNTS, GROUPS)
    with pytest.raises(ValueError, match="no covariates of sample s00"):
        analyze(counts, samples.where("sample <> 's00'"), Config("group"))
    with pytest.raises(ValueError, match="listed twice"):
        analyze(counts, samples.unionByName(samples.limit(1)), Config("group"))
    wide = spark.createDataFrame([("a", 1, 2.5, 0), ("b", None, 4.0, 7)], "name string, s1 int, s2 double, s3 int")
    got = {(r.taxon, r.sample): r.n for r in transposed(wide, True).collect()}
    assert got == {("a", "s1"): 1.0, ("a", "s2"): 2.5, ("b", "s1"): None, ("b", "s2"): 4.0, ("b", "s3"): 7.0}
    assert {(r.taxon, r.sample): r.n for r in transposed(wide, False).collect()} == {(b, a): n for (a, b), n in got.items()}
    with pytest.raises(ValueError, match="isn't numeric"):
        transposed(wide.withColumn("s4", F.lit("x")), True)


def test_results_are_written_and_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    groups = [k % 3 for k in range(30)]
    counts, samples = tables(spark, rng.poisson(40, (12, 30)), groups)
    cfg = Config("group", group="group", pseudo=0.5, global_test=True, pairwise=True, struc_zero=True)
    result = analyze(counts, samples, cfg)
    found = sinks.contract_tables(result, sensitivity.nonconservative(result, cfg, grid=(0.1, 0.2)))
    terms = ["(Intercept)", "group1", "group2"]
    assert found["res"].columns == ["taxon"] + [f"{m}_{c}" for m in [*sinks.MEASURES, "passed_ss", "diff_robust"] for c in terms]
    assert found["res_pair"].columns == ["taxon"] + [f"{m}_{c}" for c in ["group1", "group2", "group2_group1"] for m in sinks.MEASURES]
    assert found["res_global"].columns == ["taxon", "W", "p_val", "q_val", "diff_abn", "passed_ss", "diff_robust_abn"] and found["zero_ind"].columns[1:] == ["structural_zero_0", "structural_zero_1", "structural_zero_2"]
    assert found["ss_tab"].groupBy("table").count().count() == 3 and found["bias_correct_log_table"].count() == 360
    lfc = {(r.taxon, r.coef): r.lfc for r in result.primary.collect()}
    assert all(lfc[r.taxon, c] == r[f"lfc_{c}"] for r in found["res"].collect() for c in terms)
    sinks.write_results(result, cfg, f"{tmp_path}/out")
    back = spark.read.csv(f"{tmp_path}/out/res", sep="\t", header=True, inferSchema=True)
    assert all(lfc[r.taxon, "group2"] == r.lfc_group2 for r in back.collect())  # the shortest decimals read back as the same numbers
    run = {r.key: r.value for r in spark.read.csv(f"{tmp_path}/out/run", sep="\t", header=True).collect()}
    assert run["option_formula"] == "group" and float(run["epsilon_1"]) == result.epsilons[0] and float(run["seconds_mle1"]) > 0 and "only 12 taxa" in run["warning_1"]
    few = {r.coef: (r.taxa, r.tested) for r in sinks.summary(result).collect()}
    assert few == {c: (12, 12) for c in terms}
    rows = spark.createDataFrame([("a", 1.5, 2), ("b", None, None), ("c", float("nan"), 3)], "taxon string, x double, k int")
    sinks.write_rows(rows, f"{tmp_path}/rows")
    assert sorted(map(tuple, sinks.read_rows(spark, f"{tmp_path}/rows", "taxon string, x double, k int").collect())) == [("a", 1.5, 2), ("b", None, None), ("c", None, 3)]
    (tmp_path / "set").mkdir()
    (tmp_path / "set/counts.tsv").write_text("s1\ts2\nt1\t4\t0\n")
    (tmp_path / "set/meta.tsv").write_text("group\ns1\ta\ns2\tb\n")
    (tmp_path / "set/analysis.tsv").write_text("key\tvalue\nformula\tgroup\ngroup\tgroup\npseudo\t0.5\nstruc_zero\tTRUE\nmax_iter\t7\nelse\t1\np_adj_method\tBH\n")
    c, s, own = sinks.read_dataset(spark, f"{tmp_path}/set")
    assert own == Config("group", group="group", pseudo=0.5, struc_zero=True, max_iter=7, p_adjust="BH") and c.count() == 1 and s.count() == 2


@pytest.mark.parametrize("value,text", [(0.1, "0.1"), (1e15, "1000000000000000"), (-2.0, "-2"), (1e-7, "0.0000001"), (1.2345678901234567e-9, "1.234567890123457e-9"), (123456.789, "123456.789"), (5e300, "5.000000000000000e300"), (float("-inf"), "-Inf")])
def test_numbers_as_text(value, text):
    assert number_text(value) == text


def test_global_and_pairwise_tests(spark):
    rng = np.random.default_rng(5)
    groups = [k % 3 for k in range(45)]
    matrix = rng.poisson(40, (30, 45))
    matrix[:4] = rng.poisson(np.array([40, 40, 200])[groups], (4, 45))
    result = analyze(*tables(spark, matrix, groups), Config("group", group="group", pseudo=0.5, global_test=True, pairwise=True))
    assert {r.taxon for r in result.global_test.where("diff").collect()} >= {"t00", "t01", "t02", "t03"}
    pairs = result.pairwise.toPandas()
    assert set(pairs["contrast"]) == {"group1", "group2", "group2_group1"} and len(pairs) == 90
    assert set(pairs[pairs["diff"] & pairs["taxon"].isin(["t00", "t01", "t02", "t03"])]["contrast"]) >= {"group2", "group2_group1"}
    with pytest.raises(ValueError, match="fewer than two samples"):
        analyze(*tables(spark, COUNTS, [1] * 9 + [2]), Config("group", group="group"))


def closed(p):
    """The closure of Simes' tests over all subsets."""
    out = np.zeros(len(p))
    for m in range(1, len(p) + 1):
        for own in combinations(range(len(p)), m):
            simes = min(m * np.sort(p[list(own)]) / np.arange(1, m + 1))
            out[list(own)] = np.maximum(out[list(own)], simes)
    return np.minimum(1, out)


def test_hommel_is_the_closure_of_simes():
    rng = np.random.default_rng(2)
    for k in range(120):
        p = rng.random(rng.integers(1, 9)) ** rng.integers(1, 4)
        p = np.round(p, 1) if k % 3 == 0 else p
        assert np.allclose(hommel_array(p), closed(p), atol=1e-14)
        assert np.allclose(hommel_array(p, len(p) + 2.9), closed(np.append(p, [1, 1]))[: len(p)], atol=1e-14)
    assert hommel_array(np.array([])).size == 0 and (hommel_array(np.ones(4)) == 1).all()


@pytest.mark.parametrize("method", ["holm", "hochberg", "bh", "by"])
def test_adjustment_over_many_ranges_equals_one_window(spark, method):
    rng = np.random.default_rng(4)
    rows = [(None if k % 7 == 0 else "ab"[k % 2], k, None if k % 50 == 3 else float(np.round(rng.random() ** 3, 3))) for k in range(900)]
    table = spark.createDataFrame(rows, "f string, k int, p double").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # one range for each shuffle partition
    try:
        for by in (["f"], []):
            far, near = (adjust(table, "p", by, "k", method, short=s).toPandas().sort_values("k") for s in (False, True))
            assert len(far) == 900 and np.allclose(far["q"], near["q"], equal_nan=True) and far["q"].isna().sum() == 18
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert adjust(table.limit(0), "p", ["f"], "k", method).count() == 0
