"""Mixed models against dense NumPy fits, and the analysis with a random term."""

import numpy as np
import pytest

from countloom.functions.dist import chi2_tails
from countloom.functions.mixed import Sums, deviance, lower, mixed_fit, ratio_test
from countloom.plans.analysis import Config
from countloom.plans.formula import parse_random
from countloom.plans.mixed import analyze_mixed, iterate, long_fits, mixed_fits, random_frame, table_of


def covariance(params, g, z):
    own = lower(np.atleast_1d(np.asarray(params, float)), z.shape[1])
    v = np.eye(len(g))
    for k in set(g.tolist()):
        i = np.flatnonzero(g == k)
        v[np.ix_(i, i)] += z[i] @ own @ own.T @ z[i].T
    return v


def dense(params, x, y, g, z, reml=True):
    """Deviance, coefficients, their covariance and the random parts' fit, by n x n matrices."""
    v = covariance(params, g, z)
    inverse = np.linalg.inv(v)
    a = x.T @ inverse @ x
    beta = np.linalg.solve(a, x.T @ inverse @ y)
    rest = y - x @ beta
    rss, left = rest @ inverse @ rest, len(y) - x.shape[1] * reml
    dev = np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1] * reml + left * (1 + np.log(2 * np.pi * rss / left))
    return dev, beta, np.linalg.inv(a) * rss / left, (v - np.eye(len(y))) @ inverse @ rest, rss / left


def best(x, y, g, z, reml=True):
    """The best parameter of one random effect, by ever finer grids."""
    low, high = 0.0, 20.0
    for _ in range(18):
        grid = np.linspace(low, high, 21)
        k = int(np.argmin([dense([v], x, y, g, z, reml)[0] for v in grid]))
        low, high = grid[max(0, k - 1)], grid[min(20, k + 1)]
    return (low + high) / 2


def sums(x, y, g, z, classes):
    v = np.column_stack([x, y])
    zz, zv = (np.array([z[g == k].T @ m[g == k] for k in sorted(set(g.tolist()))]) for m in (z, v))
    if not classes:
        return Sums(len(y), len(zz), v.T @ v, zz, zv=zv)
    size = zz[:, 0, 0]
    each = np.unique(size)
    outer = np.array([np.einsum("mi,mj->ij", zv[size == a, 0], zv[size == a, 0]) for a in each])
    return Sums(len(y), len(zz), v.T @ v, each[:, None, None], outer=outer, times=np.array([float((size == a).sum()) for a in each]))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n, g = 70, rng.integers(0, 9, 70)
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.integers(0, 2, n)])
    y = x @ [1, 0.5, -0.2] + 0.8 * rng.normal(size=9)[g] + 0.6 * rng.normal(size=9)[g] * x[:, 1] + rng.normal(size=n)
    return x, y, g, x[:, :2]


@pytest.mark.parametrize("params,columns", [([0.0], [0]), ([0.7], [0]), ([0.4], [1]), ([0.7, 0.3, 0.5], [0, 1])])
@pytest.mark.parametrize("reml", [True, False])
def test_deviance_is_the_dense_one(data, params, columns, reml):
    x, y, g, z = data
    z = z[:, columns]
    for classes in (False, True) if len(columns) == 1 else (False,):
        assert abs(deviance(sums(x, y, g, z, classes), np.array(params), reml) - dense(params, x, y, g, z, reml)[0]) < 1e-10


@pytest.mark.parametrize("columns", [[0], [1]])
def test_fits_are_the_dense_ones(data, columns):
    x, y, g, z = data
    z = z[:, columns]
    at = best(x, y, g, z)
    _, beta, vcov, _, sigma2 = dense([at], x, y, g, z)
    found = mixed_fit(sums(x, y, g, z, True))
    assert np.allclose(found.beta, beta, atol=1e-6) and np.allclose(found.vcov, vcov, atol=1e-6) and abs(found.sigma2 - sigma2) < 1e-5 and abs(found.factor[0, 0] - at) < 1e-4

    # Satterthwaite's degrees of freedom from numerical derivatives in the two variances themselves.
    def minus_log(v):
        a = v[1] * np.eye(len(y)) + v[0] * (covariance([1.0], g, z) - np.eye(len(y)))
        inverse = np.linalg.inv(a)
        m = x.T @ inverse @ x
        b = np.linalg.solve(m, x.T @ inverse @ y)
        return np.linalg.slogdet(a)[1] + np.linalg.slogdet(m)[1] + (y - x @ b) @ inverse @ (y - x @ b), np.diag(np.linalg.inv(m))

    v, h = np.array([found.factor[0, 0] ** 2 * found.sigma2, found.sigma2]), 1e-4
    e = np.eye(2) * h
    hessian = np.array([[(minus_log(v + a + b)[0] - minus_log(v + a - b)[0] - minus_log(v - a + b)[0] + minus_log(v - a - b)[0]) / (4 * h * h) for a in e] for b in e])
    gradient = np.array([(minus_log(v + a)[1] - minus_log(v - a)[1]) / (2 * h) for a in e])
    own = minus_log(v)[1]
    want = [2 * own[j] ** 2 / (gradient[:, j] @ np.linalg.solve(hessian / 2, gradient[:, j])) for j in range(3)]
    assert np.allclose(found.dof, want, rtol=1e-4)


def test_slopes_and_intercepts_together(data):
    x, y, g, z = data
    found = mixed_fit(sums(x, y, g, z, False))
    at = found.factor[np.tril_indices(2)]
    dev = dense(at, x, y, g, z)[0]
    assert abs(found.deviance - dev) < 1e-9
    rng = np.random.default_rng(4)
    assert all(dense(at + rng.normal(size=3) * s, x, y, g, z)[0] >= dev - 1e-9 for s in (1e-3, 0.05, 0.5) for _ in range(30))
    assert (found.dof > 1).all() and (found.dof < 70).all()


def test_balanced_one_way_and_no_variance():
    rng = np.random.default_rng(2)
    a, m = 8, 5
    g = np.repeat(np.arange(a), m)
    y = rng.normal(size=a)[g] + 0.5 * rng.normal(size=a * m)
    one = np.ones((a * m, 1))
    means = y.reshape(a, m).mean(axis=1)
    msa, mse = m * means.var(ddof=1), ((y.reshape(a, m) - means[:, None]) ** 2).sum() / (a * (m - 1))
    found = mixed_fit(sums(one, y, g, one, True))
    assert np.allclose([found.sigma2, found.factor[0, 0] ** 2 * found.sigma2, found.vcov[0, 0]], [mse, (msa - mse) / m, msa / (a * m)]) and abs(found.dof[0] - (a - 1)) < 1e-4
    flat = (y.reshape(a, m) - means[:, None]).reshape(-1)  # groups with the same mean: the variance between them is 0
    found = mixed_fit(sums(one, flat, g, one, True))
    assert found.factor[0, 0] == 0 and abs(found.dof[0] - (a * m - 1)) < 1e-4
    assert mixed_fit(sums(one[:5], y[:5], g[:5], one[:5], True)) is None  # one group
    assert mixed_fit(sums(one[::5], y[::5], g[::5], one[::5], True)) is None  # a group for each observation
    twice = mixed_fit(sums(np.column_stack([one, one]), y, g, one, True))
    assert twice.beta[1] == 0 and twice.vcov[1, 1] == 0.1 and twice.dof[1] == 999


def test_likelihood_ratios_are_the_dense_ones(data):
    x, y, g, z = data
    z = z[:, :1]
    devs = [dense([best(own, y, g, z, False)], own, y, g, z, False)[0] for own in (x[:, [0, 2]], x)]
    w, p = ratio_test(sums(x, y, g, z, True), [1])
    assert abs(w - (devs[0] - devs[1])) < 1e-7 and np.isclose(p, chi2_tails(w, 1)[1])
    assert ratio_test(sums(x, y, g, z, True), []) [1] == 1.0


def test_random_terms():
    assert parse_random("(1|g)") == parse_random(" ( 1 | g ) ") and parse_random("(1|g)").slopes == ()
    assert parse_random("(x | g)").intercept and parse_random("(x + y | g)").slopes == ("x", "y") and not parse_random("(0 + x | g)").intercept
    for bad in ("1|g", "(1|g) + (1|h)", "(x:y|g)", "(0|g)", "(1|g:h)"):
        with pytest.raises(ValueError):
            parse_random(bad)


@pytest.fixture(scope="module")
def study(spark):
    """20 taxa of 60 samples of 12 subjects in three groups; a few cells, one covariate and one subject are missing."""
    rng = np.random.default_rng(7)
    subject, group = np.arange(60) % 12, (np.arange(60) % 12) // 4
    matrix = rng.poisson(np.exp(3.5 + 0.4 * rng.normal(size=(20, 12))[:, subject] + 0.5 * rng.normal(size=60) + 1.2 * (np.arange(20) < 3)[:, None] * (group == 2)))
    matrix[rng.random(matrix.shape) < 0.03] = 0
    x = rng.normal(size=60)
    counts = spark.createDataFrame([(f"t{i:02}", f"s{j:02}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v], "taxon string, sample string, n double")
    samples = spark.createDataFrame([(f"s{j:02}", "abc"[group[j]], None if j == 5 else float(x[j]), None if j == 9 else f"p{subject[j]}") for j in range(60)], "sample string, grp string, x double, who string")
    ok = np.array([j not in (5, 9) for j in range(60)])
    return matrix, counts, samples, subject, group, x, ok


def test_rounds_are_the_dense_ones(spark, study):
    matrix, counts, samples, subject, group, x, ok = study
    with np.errstate(divide="ignore"):
        y = np.where(matrix > 0, np.log(np.maximum(matrix, 1)), np.nan)
    y = y - np.nanmean(y, axis=1, keepdims=True)
    design = np.column_stack([np.ones(60), group == 1, group == 2, x]).astype(float)
    theta, before, trace = np.zeros(60), None, []
    for _ in range(3):
        fitted, betas = np.zeros_like(y), []
        for i in range(len(y)):
            use = ok & np.isfinite(y[i])
            own = (design[use], (y[i] - theta)[use], subject[use], np.ones((use.sum(), 1)))
            _, beta, _, u, _ = dense([best(*own)], *own)
            fitted[i, use] = own[0] @ beta + u
            betas.append(beta)
        new = np.nanmean(y - fitted, axis=0)
        trace.append(np.sqrt((0 if before is None else ((np.array(betas) - before) ** 2).sum()) + ((new - theta) ** 2).sum()))
        theta, before = new, np.array(betas)
    cfg = Config("grp + x", group="grp")
    d, q = random_frame(samples, cfg, parse_random("(1 | who)"))
    logs = spark.createDataFrame([(f"t{i:02}", f"s{j:02}", float(y[i, j])) for i in range(20) for j in range(60) if np.isfinite(y[i, j])], "taxon string, sample string, y double")
    last, got, found = iterate(table_of(logs, d), 4, q, 0.0, 3)
    assert np.allclose(np.array([r.beta for r in last.orderBy("taxon").collect()]), before, atol=1e-5)
    assert np.allclose([r.theta for r in got.orderBy("sample").collect()], theta, atol=1e-5) and np.allclose(found, trace, atol=1e-5)


def test_analysis_with_a_random_term(study):
    _, counts, samples, *_ = study
    cfg = Config("grp + x", group="grp", prv_cut=0, global_test=True, pairwise=True)
    result = analyze_mixed(counts, samples, cfg, "(1 | who)")
    rows = result.primary.toPandas()
    assert len(rows) == 80 and set(rows.query("coef == 'grpc' and diff")["taxon"]) <= {f"t{k:02}" for k in range(20)} and {"t00", "t01", "t02"} <= set(rows.query("coef == 'grpc'").nsmallest(6, "p")["taxon"])
    between, slope = rows.query("coef == 'grpc'")["dof"], rows.query("coef == 'x'")["dof"]
    assert (between < slope.max()).all() and (slope <= 54).all() and (between.median() < 20)  # subjects, not samples, tell groups apart
    whole = result.global_test.toPandas().set_index("taxon")
    assert len(whole) == 20 and whole["p"].nsmallest(4).index.isin(["t00", "t01", "t02"]).sum() >= 2 and ((whole["q"] >= whole["p"] - 1e-12)).all()
    assert len(result.pairwise.toPandas()) == 60 and any("only 20 taxa" in w for w in result.warnings)
    assert result.theta.count() == 60


def test_taxa_without_a_fit(spark, study):
    _, counts, samples, *_ = study
    few = spark.createDataFrame([("lonely", "s00", 1.0), ("lonely", "s12", 2.0), ("lonely", "s24", 0.5)], "taxon string, sample string, y double")
    est, classes, d, q = mixed_fits(few, samples, Config("grp + x", group="grp"), "(1 | who)")
    [row] = est.collect()
    assert not row.fitted and row.beta == [None] * 4 and long_fits(est, d.columns).where("lfc IS NULL AND dof = 999").count() == 4
    with pytest.raises(ValueError, match="no such covariate"):
        analyze_mixed(counts, samples, Config("grp"), "(1 | nobody)")
    with pytest.raises(ValueError, match="isn't numeric"):
        analyze_mixed(counts, samples, Config("x"), "(grp | who)")
