"""Sensitivity, simulated group tests, log-ratios, correlations and the simulator, against plain NumPy."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from countloom.plans import correlations, group_tests, log_ratios, sensitivity, simulation
from countloom.plans.analysis import Config, analyze, analyze_plain
from countloom.plans.formula import design, parse

GROUPS = [k % 3 for k in range(45)]


@pytest.fixture(scope="module")
def study(spark):
    """30 taxa, of which four are higher in the last group and one is a structural zero in the second."""
    rng = np.random.default_rng(5)
    matrix = rng.poisson(40, (30, 45))
    matrix[:4] = rng.poisson(np.array([40, 40, 200])[GROUPS], (4, 45))
    matrix[rng.random(matrix.shape) < 0.05] = 0
    matrix[29, np.array(GROUPS) == 1] = 0
    cells = [(f"t{i:02}", f"s{j:02}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v]
    counts = spark.createDataFrame(cells, "taxon string, sample string, n double")
    samples = spark.createDataFrame([(f"s{j:02}", f"g{g}", float(j % 7)) for j, g in enumerate(GROUPS)], "sample string, grp string, x double")
    return matrix, counts, samples


@pytest.fixture(scope="module")
def main(study):
    cfg = Config("grp", group="grp", global_test=True, pairwise=True)
    return cfg, analyze(study[1], study[2], cfg)


def test_conservative_sensitivity(study, main):
    cfg, result = main
    found = sensitivity.conservative(study[1], study[2], cfg, result, pseudos=(0.5,))
    assert set(found) == {"primary", "global", "pairwise"}
    rows = found["primary"].toPandas()
    assert set(rows["ss"]) <= {0.0, 0.5, 1.0} and (rows["passed_ss"] == rows["ss"].isin([0, 1])).all()
    assert (rows["diff_robust"] == (rows["diff"] & rows["passed_ss"])).all()
    assert len(found["global"].toPandas()) == 30 and len(found["pairwise"].toPandas()) == 90


def test_nonconservative_sensitivity(study, main):
    cfg, result = main
    found = {k: v.toPandas() for k, v in sensitivity.nonconservative(result, cfg).items()}
    assert set(found["pairwise"].query("diff_robust and taxon in ['t00', 't01', 't02', 't03']")["contrast"]) >= {"grpg2"}
    row = study[0][7].astype(float)
    theta = np.array([r.theta for r in result.theta.orderBy("sample").collect()])
    x = np.column_stack([np.ones(45), np.array(GROUPS) == 1, np.array(GROUPS) == 2]).astype(float)
    d = design(study[2], parse("grp"), "grp")
    p = sensitivity.refit(d, row, theta, np.array([0.2]))
    y = np.log(np.where(row == 0, 0.2, row))
    y = y - y.mean() - theta
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    cov = np.linalg.inv(x.T @ x) * rss[0] / 42
    from countloom.functions.dist import f_tails, t_two_sided

    assert np.allclose(p["primary", "grpg2"], t_two_sided(beta[2] / np.sqrt(cov[2, 2]), 42))
    assert np.allclose(p["pairwise", "grpg2_grpg1"], t_two_sided((beta[2] - beta[1]) / np.sqrt(cov[1, 1] + cov[2, 2] - 2 * cov[1, 2]), 42))
    f = (((y - y.mean()) ** 2).sum() - rss[0]) / 2 / (rss[0] / 42)
    assert np.allclose(p["global", "global"], f_tails(f, 2, 42)[1])
    assert all(np.isnan(v).all() for v in sensitivity.refit(d, np.full(45, np.nan), theta, np.array([0.2])).values())


def test_refits_come_from_sums(spark):
    """Against least squares by taxon, with a covariate far from zero, missing cells, missing covariates, a level that is
    unseen and zeros written as rows; no table of samples is collected."""
    rng = np.random.default_rng(21)
    n, taxa = 60, 8
    matrix = rng.poisson(6, (taxa, n)).astype(float) * (rng.random((taxa, n)) < 0.7)
    matrix[2, np.arange(n) % 3 == 1] = np.nan
    matrix[rng.random((taxa, n)) < 0.03] = np.nan
    group, x, theta = np.arange(n) % 3, 2000 + rng.normal(size=n), rng.normal(size=n)
    x[5], theta[7] = np.nan, np.nan
    cells = [(f"t{i}", f"s{j:02}", None if np.isnan(v) else float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row) if v != 0 or (i + j) % 2]
    counts = spark.createDataFrame(cells, "taxon string, sample string, n double")
    samples = spark.createDataFrame([(f"s{j:02}", f"g{group[j]}", None if np.isnan(x[j]) else float(x[j])) for j in range(n)], "sample string, grp string, x double")
    biases = spark.createDataFrame([(f"s{j:02}", None if np.isnan(theta[j]) else float(theta[j])) for j in range(n)], "sample string, theta double")
    from types import SimpleNamespace

    from countloom.functions.dist import t_two_sided
    from countloom.functions.kernels import pivots
    from countloom.plans.formula import frame

    cfg, grid = Config("grp + x", group="grp", alpha=0.3), np.array([0.05, 0.2, 0.5])
    main = SimpleNamespace(design=frame(samples, parse("grp + x"), "grp"), table=counts, samples=samples, theta=biases)
    got = sensitivity.refit_scores(main, cfg, grid).toPandas().set_index(["taxon", "kind", "term"])["ss"]
    assert len(got) == taxa * (4 + 3 + 1)
    full = np.column_stack([np.ones(n), group == 1, group == 2, x]).astype(float)
    for i in range(taxa):
        for c, name in enumerate(main.design.columns):
            above = []
            for value in grid:
                logs = np.log(np.where(matrix[i] == 0, value, matrix[i]))
                y = logs - np.nanmean(logs) - theta
                use = np.isfinite(y) & np.isfinite(x)
                keep = pivots(full[use])
                if c not in keep:
                    above.append(True)
                    continue
                own = full[use][:, keep]
                beta, rss = np.linalg.lstsq(own, y[use], rcond=None)[:2]
                se = np.sqrt(np.linalg.inv(own.T @ own)[keep.index(c), keep.index(c)] * rss[0] / (use.sum() - len(keep)))
                above.append(t_two_sided(beta[keep.index(c)] / se, use.sum() - len(keep)) > cfg.alpha)
            assert np.isclose(got[f"t{i}", "primary", name], np.mean(above)), (i, name)


def test_dunnett_and_trend(main):
    cfg, result = main
    rows = group_tests.dunnett(result, cfg, draws=200).toPandas()
    assert len(rows) == 60 and set(rows.query("diff")["taxon"]) >= {"t00", "t01", "t02", "t03"}
    assert (rows.query("diff and taxon in ['t00', 't01', 't02', 't03']")["contrast"] == "grpg2").all()
    up = np.array([[1.0, 0], [-1, 1]])
    got = group_tests.trend(result, cfg, {"up": (up, 1), "down": (-up, 1)}, draws=200).toPandas().set_index("taxon")
    assert (got.loc[["t00", "t01", "t02", "t03"], "pattern"] == "up").all() and got.loc["t00", "p"] == 0
    again = group_tests.trend(result, cfg, {"up": (up, 1), "down": (-up, 1)}, draws=200).toPandas().set_index("taxon")
    assert (got["p"].sort_index() == again["p"].sort_index()).all()


def test_constrained_estimates_are_the_nearest():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(3, 3))
    v = a @ a.T + np.eye(3)
    c = np.array([[1.0, 0, 0], [-1, 1, 0], [0, -1, 1]])
    b = rng.normal(size=(20, 3))
    got = group_tests.nearest(b, v, c)
    assert (got @ c.T >= -1e-8).all()
    inverse = np.linalg.inv(v)
    cost = lambda p, q: np.einsum("ij,jk,ik->i", p - q, inverse, p - q)
    steps = np.cumsum(rng.exponential(size=(4000, 3)), axis=1) * rng.choice([0.1, 0.5, 1], (4000, 1))  # feasible points
    for k in range(20):
        assert cost(b[k : k + 1], got[k : k + 1])[0] <= cost(np.repeat(b[k : k + 1], 4000, 0), steps).min() + 1e-9


def test_plain_analysis(study):
    result = analyze_plain(study[1], study[2], Config("grp", group="grp", pseudo=1, tol=1e-5, max_iter=100, struc_zero=True))
    rows = result.primary.toPandas().set_index(["taxon", "coef"])
    assert len(rows) == 90 and rows.loc[("t00", "grpg2"), "diff"]
    assert rows.loc[("t29", "grpg1"), ["se", "p", "q"]].tolist() == [0, 0, 0] and rows.loc[("t29", "grpg1"), "diff"]
    assert rows.loc[("t29", "grpg2"), "se"] > 0


@pytest.mark.parametrize("formula", ["grp", "x"])
def test_log_ratios(study, formula):
    matrix, counts, samples = study
    found, tests = log_ratios.log_ratio_tests(counts, samples, formula, adjust_for="x" if formula == "grp" else None, block=8)
    rows = tests.toPandas()
    assert len(rows) == 30 * 29 and not rows.duplicated(["taxon", "other"]).any()
    g, x1 = np.array(GROUPS), np.array([j % 7 for j in range(45)], float)
    logs = np.log1p(matrix)
    p = rows.set_index(["taxon", "other"])["p"]
    from countloom.functions.dist import f_tails, t_two_sided

    for a, b in [(0, 5), (7, 20), (3, 29)]:
        y = logs[b] - logs[a]
        rss = lambda m: np.linalg.lstsq(m, y, rcond=None)[1][0]
        one = np.ones((45, 1))
        if formula == "grp":
            dummies = np.column_stack([one, g == 1, g == 2]).astype(float)
            full = np.column_stack([dummies, x1])
            want = f_tails((((y - y.mean()) ** 2).sum() - rss(dummies)) / 2 / (rss(full) / 41), 2, 41)[1]
        else:
            full = np.column_stack([one, x1])
            t2 = (((y - y.mean()) ** 2).sum() - rss(full)) / (rss(full) / 43)
            want = t_two_sided(np.sqrt(t2), 43)
        assert np.allclose(p[f"t{a:02}", f"t{b:02}"], want) and np.allclose(p[f"t{b:02}", f"t{a:02}"], want)
    w = found.toPandas().set_index("taxon")["W"]
    for taxon in ("t00", "t02", "t10", "t29"):  # Holm's count over 30 values, of which one is the taxon itself
        ordered = np.sort(p[taxon].to_numpy())
        assert w[taxon] == (np.maximum.accumulate((30 - np.arange(29)) * ordered) <= 0.05).sum()
    if formula == "grp":
        assert w[["t00", "t01", "t02", "t03"]].min() > w["t10"]


@pytest.mark.parametrize("main,adjust_for", [("grp", "x"), ("x", None), ("half", "x")])
def test_log_ratios_are_sums_over_samples(spark, monkeypatch, main, adjust_for):
    """Missing cells and covariates, equal and nearly equal taxa, one that is seen in few samples: against a fit of each pair.
    The design doesn't come to the driver."""
    monkeypatch.setattr(log_ratios, "design", None, raising=False)
    rng = np.random.default_rng(17)
    n, y = 50, rng.normal(3, 1, (9, 50))
    x = rng.normal(1000, 1, n)
    x[4], x[5] = np.nan, np.inf
    y[rng.random(y.shape) < 0.1] = np.nan
    y[:3] = rng.normal(3, 1, (3, n))  # without missing cells
    y[3] = y[0]
    y[4] = y[1] + 1e-6 * rng.normal(size=n)
    y[5, 3:] = np.nan
    y[6] = np.nan
    g = np.array([k % 3 for k in range(n)])
    logs = spark.createDataFrame([(f"t{i}", f"s{j:02}", None if np.isnan(v) else float(v)) for i, row in enumerate(y) for j, v in enumerate(row)], "taxon string, sample string, y double")
    samples = spark.createDataFrame([(f"s{j:02}", f"g{g[j]}", f"h{j % 2}", None if j == 4 else float(x[j])) for j in range(n)], "sample string, grp string, half string, x double")
    own = {"grp": [g == 1, g == 2], "x": [x], "half": [np.arange(n) % 2 == 1]}[main]
    columns = np.column_stack([np.ones(n), *own, *([x] if adjust_for else [])]).astype(float)
    from countloom.functions.dist import f_tails, t_two_sided

    for block in (256, 2):
        found, n_taxa = log_ratios.pair_tests(logs, samples, main, adjust_for, block)
        rows = found.toPandas().set_index(["a", "b"])
        assert n_taxa == 8 and len(rows) == 28 and not rows.index.duplicated().any()
        for a, b in combinations([k for k in range(9) if k != 6], 2):
            v = y[b] - y[a]
            use = np.isfinite(v) & np.isfinite(columns).all(axis=1)
            got, m = rows.loc[(f"t{a}", f"t{b}")], columns[use] - np.append(0, columns[use][:, 1:].mean(axis=0)) if use.any() else None
            if use.sum() <= columns.shape[1] or (a, b) == (0, 3):
                assert np.isnan(got["stat"]) and np.isnan(got["p"])
                continue
            q, r = np.linalg.qr(m)
            e, k = q.T @ v[use], len(own)
            dof, rss = use.sum() - m.shape[1], ((v[use] - q @ (q.T @ v[use])) ** 2).sum()
            if k == 2:
                stat = (e[1:3] ** 2).sum() / 2 / (rss / dof)
                p = f_tails(stat, 2, dof)[1]
            else:
                inverse = np.linalg.inv(r)
                stat = (inverse @ e)[1] / np.sqrt((inverse @ inverse.T)[1, 1] * rss / dof)
                p = t_two_sided(stat, dof)
            assert np.allclose([got["stat"], got["p"]], [stat, p], rtol=1e-6)


def test_linear_correlations(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=60)
    logs = rng.normal(6, 0.6, (12, 60))
    logs[1] = logs[0] + rng.normal(0, 0.1, 60)
    counts = spark.createDataFrame([(f"t{i:02}", f"s{j}", float(np.exp(logs[i, j] + 0.1 * base[j]) // 1)) for i in range(12) for j in range(60) if (i, j) != (5, 3)], "taxon string, sample string, n double")
    samples = counts.select("sample").distinct()
    y, bias = correlations.corrected_abundances(counts, samples)
    wide = y.toPandas().pivot(index="sample", columns="taxon", values="y")
    clipped = wide.apply(lambda c: c.clip(c.quantile(0.05), c.quantile(0.95)))
    for method in ("pearson", "spearman"):
        got = correlations.linear_correlations(counts, samples, method=method, n_cv=3, thresh_len=20, corr_cut=2).toPandas().set_index(["a", "b"])
        assert len(got) == 66 and got.loc[("t05", "t06"), "n"] == 59
        for a, b in combinations(wide.columns, 2):
            both = clipped[[a, b]].dropna()
            both = both.rank() if method == "spearman" else both
            assert abs(got.loc[(a, b), "corr"] - np.corrcoef(both[a], both[b])[0, 1]) < 1e-9
        assert got.loc[("t00", "t01"), "corr_fl"] > 0.8 and got.loc[("t00", "t01"), "corr_th"] > 0.8 and got.loc[("t00", "t01"), "p"] < 1e-6
        assert (got["corr_th"] == 0).sum() > 10
    flagged = correlations.linear_correlations(counts, samples, n_cv=2, thresh_len=5, corr_cut=-2, soft=True, alphas=(0.0, 0.1)).toPandas()
    assert (flagged["corr"] == 0).all() and (flagged["p"] == 1).all()


def test_ranks_and_sums_of_pairs(spark):
    """Sparse, tied and constant values, with splits, against NumPy; no row is made for a pair and a sample."""
    rng = np.random.default_rng(22)
    y = np.round(rng.normal(size=(40, 7)), 1)
    y[rng.random(y.shape) < 0.4] = np.nan
    y[:, 6] = np.where(np.arange(40) < 2, 3.0, np.nan)
    y[:, 5] = np.where(np.isfinite(y[:, 5]), 0.1 + 0.2, np.nan)
    samples = spark.createDataFrame([(f"s{k:02}",) for k in range(40)], "sample string")
    values = spark.createDataFrame([(f"t{i}", f"s{k:02}", float(y[k, i])) for i in range(7) for k in range(40) if np.isfinite(y[k, i])], "taxon string, sample string, y double")
    t = correlations.with_splits(correlations.pair_rows(values), samples, 3, 3)
    marks = correlations.splits(samples, 3, 3).toPandas().pivot(index="sample", columns="split", values="train").sort_index().to_numpy(bool)
    for found, ranked in ((correlations.pair_correlations, False), (correlations.rank_correlations, True)):
        rows = found(t, 3).toPandas().set_index(["a", "b"])

        def r(i, j, use):
            x = pd.DataFrame(y[use][:, [i, j]]).dropna()
            x = x.rank() if ranked else x
            return np.corrcoef(x.T)[0, 1] if len(x) > 1 and (x.max() > x.min()).all() else np.nan

        for i, j in combinations(range(7), 2):
            n = int(np.isfinite(y[:, [i, j]]).all(axis=1).sum())
            assert ((f"t{i}", f"t{j}") in rows.index) == (n > 0)
            if n:
                row = rows.loc[(f"t{i}", f"t{j}")]
                number = lambda v: np.array([np.nan if w is None else w for w in v], float)
                assert row["n"] == n and np.allclose(np.array(row["r"], float), r(i, j, np.full(40, True)), equal_nan=True)
                assert np.allclose(number(row["r1"]), [r(i, j, marks[:, k]) for k in range(3)], equal_nan=True)
                assert np.allclose(number(row["r2"]), [r(i, j, ~marks[:, k]) for k in range(3)], equal_nan=True)


def test_taxa_come_to_a_task_one_by_one(spark, monkeypatch):
    """A row that is handed to a task has one taxon's values in a chunk of samples, of 8 bytes, and what is held for ranks has 4."""
    rng = np.random.default_rng(23)
    values = spark.createDataFrame([(f"t{i:02}", f"s{k:02}", float(rng.integers(9))) for i in range(20) for k in range(30) if rng.random() < 0.9], "taxon string, sample string, y double")
    tables, old = {}, correlations.kept
    monkeypatch.setattr(correlations, "kept", lambda df, name: tables.setdefault(name, old(df, name)))
    monkeypatch.setattr(correlations, "CHUNK_SAMPLES", 8)
    t = correlations.with_splits(correlations.pair_rows(values), values.select("sample").distinct(), 2, 3)
    got = correlations.rank_correlations(t, 2)
    rows = tables["blocks"].selectExpr("key", "lo", "hi", "k", "n", "length(y) AS y", "length(there) AS there").toPandas()
    taxa = rows[rows["k"] >= 0]
    assert taxa["n"].max() <= 8 and (taxa["y"] <= 8 * taxa["n"]).all() and (taxa["there"] <= (taxa["n"] + 7) // 8).all()
    assert rows.groupby("key")[["lo", "hi"]].nunique().max().max() == 1 and taxa.groupby(["lo", "hi"])["k"].nunique().max() <= 6
    wide = values.toPandas().pivot(index="sample", columns="taxon", values="y")
    want = wide.corr(method="spearman")
    assert all(abs(r.r - want.loc[r.a, r.b]) < 1e-9 for r in got.collect()) and got.count() == 190
    keys = correlations.spread_keys(spark, 45)
    spread = spark.createDataFrame([(k,) for k in keys], "key int").repartition(45, "key").selectExpr("spark_partition_id() AS at")
    assert len(keys) == len(set(keys)) == spread.distinct().count() == 45


def test_ranks_are_counted_by_code():
    rng = np.random.default_rng(24)
    v = np.where(rng.random(2000) < 0.8, np.round(rng.normal(size=2000), 2), np.nan)
    v[::3] = np.where(np.isfinite(v[::3]), rng.normal(size=len(v[::3])), np.nan)
    code = correlations.codes(v)
    assert code.dtype == np.int32 and ((code < 0) == np.isnan(v)).all()
    for use in (np.isfinite(v), np.isfinite(v) & (rng.random(2000) < 0.02)):  # all codes, and few of many
        rank, square = correlations.counted_ranks(code[use])
        want = pd.Series(v[use]).rank().to_numpy() - (use.sum() + 1) / 2
        assert np.allclose(rank, want) and np.isclose(square, (want**2).sum())
    assert correlations.counted_ranks(code[:1]) is None and correlations.counted_ranks(np.array([3, 3, 3])) is None


def test_distance_correlation_is_the_laid_out_one():
    rng = np.random.default_rng(14)

    def centred(v):
        d = np.abs(v[:, None] - v[None, :])
        return d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()

    for n in (2, 3, 7, 64, 100, 257):
        x, y = rng.normal(5, 2, n), rng.normal(size=n)
        if n % 2:
            x, y = np.round(x), np.round(y + 0.5 * x)  # ties
        a, b = centred(x), centred(y)
        scale = np.sqrt((a * a).mean() * (b * b).mean())
        got, p = correlations.distance_correlation(x, y, 20, np.random.default_rng(1))
        want = np.sqrt(max(0, (a * b).mean() / scale)) if scale > 1e-12 else 0.0
        assert abs(got - want) < 1e-6
        order = np.argsort(x, kind="stable")
        own, rng_p = b[np.ix_(order, order)], np.random.default_rng(1)
        drawn = [rng_p.permutation(n) for _ in range(20)]
        more = sum((a[np.ix_(order, order)] * own[np.ix_(k, k)]).mean() >= (a * b).mean() - 1e-12 * scale for k in drawn)
        assert p == (1 + more) / 21 or scale <= 1e-12


@pytest.mark.parametrize("kind", ["tied to each other", "unrelated", "with ties", "one line", "two values"])
def test_bounds_settle_draws_as_exact_products_do(kind, monkeypatch):
    """A draw's covariance is found exactly only where bounds leave open on which side of the one seen it is."""
    rng = np.random.default_rng(31)
    n = 3000
    x = rng.normal(size=n)
    y = {"tied to each other": x + rng.normal(size=n), "one line": 2 * x, "two values": (rng.random(n) < 0.3).astype(float)}.get(kind, rng.normal(size=n))
    if kind == "with ties":
        x, y = np.round(x), np.round(y, 1)
    calls, exact = [], correlations.products_of_distances
    monkeypatch.setattr(correlations, "products_of_distances", lambda *v: (calls.append(1), exact(*v))[1])
    got = correlations.distance_correlation(x, y, 40, np.random.default_rng(2))
    settled = len(calls)
    monkeypatch.setattr(correlations, "LEAST_GRID", n + 1)
    assert got == correlations.distance_correlation(x, y, 40, np.random.default_rng(2)) and len(calls) == settled + 41
    assert settled <= (1 if kind in ("tied to each other", "one line") else 12)
    order = np.argsort(x, kind="stable")
    x, y = x[order] - x.mean(), y[order] - y.mean()
    bounds = correlations.Bounds(x, y)
    for drawn in (np.arange(n), rng.permutation(n), rng.permutation(n)):
        at = float((np.abs(x[:, None] - x) * np.abs(y[drawn][:, None] - y[drawn])).sum())
        low, high = bounds.of(drawn)
        lower, higher = bounds.closer(drawn, low)
        assert low <= lower * (1 + 1e-12) and lower <= at * (1 + 1e-12) and at <= higher * (1 + 1e-12) and higher - lower < high - low
        monkeypatch.setattr(correlations, "CACHED_RANKS", 1 << 6)
        assert exact(x, y[drawn]) == pytest.approx(at, rel=1e-12)
        monkeypatch.undo()


def test_distance_correlations(spark):
    rng = np.random.default_rng(10)
    logs = rng.normal(6, 0.8, (6, 40))
    logs[1] = 6 + np.abs(logs[0] - 6) * 1.5
    counts = spark.createDataFrame([(f"t{i}", f"s{j:02}", float(np.exp(logs[i, j]) // 1)) for i in range(6) for j in range(40)], "taxon string, sample string, n double")
    got = correlations.distance_correlations(counts, counts.select("sample").distinct(), permutations=99, max_p=0.05, corr_cut=2, block=2).toPandas().set_index(["a", "b"])
    assert len(got) == 15 and got.loc[("t0", "t1"), "p"] == 0.01 and got.loc[("t0", "t1"), "dcorr_fl"] > 0.4
    x = rng.normal(size=30)
    r, p = correlations.distance_correlation(x, 3 * x - 1, 19, rng)
    assert abs(r - 1) < 1e-9 and p == 0.05 and correlations.distance_correlation(x, np.ones(30), 19, rng) == (0.0, 1.0)


def test_simulation_and_recovery(spark):
    cells = simulation.grid(spark, 2, n_taxa=[20], n_samp=[10], da_proportion=[0.25], log_fc=[1.5], zero_inflation=[0.1], lib_mean=[5000.0], lib_cv=[0.3], confound=[False, True])
    assert cells.count() == 4
    made, known = simulation.simulate(cells).toPandas(), simulation.truth(cells).toPandas()
    again = simulation.simulate(cells.repartition(3)).toPandas()
    order = ["cell", "rep", "taxon", "sample"]
    pd.testing.assert_frame_equal(made.sort_values(order).reset_index(drop=True), again.sort_values(order).reset_index(drop=True))
    assert (made["n"] > 0).all() and len(known) == 80 and known.query("cell == 0")["has_effect"].sum() == 10 and known.query("cell == 1")["confounded"].sum() == 10
    results = spark.createDataFrame(known.assign(lfc=known["log_fc"] + 0.5, diff=known["has_effect"] | (known["taxon"] == "taxon00000"))[["cell", "rep", "taxon", "lfc", "diff"]])
    got = simulation.recovery(results, simulation.truth(cells), "cell", "rep").toPandas().set_index(["cell", "rep"])
    assert np.allclose(got[["bias", "rmse", "mae"]], 0.5) and (got.loc[0, "power"] == 1).all() and got.loc[1, "power"].isna().all()
    total = simulation.pooled(simulation.recovery(results, simulation.truth(cells), "cell", "rep"), "cell").toPandas().set_index("cell")
    assert total.loc[0, "power"] == 1 and total.loc[0, "reps"] == 2
    with pytest.raises(ValueError, match="no level"):
        simulation.grid(spark, 1, n_taxa=[3])


def test_many_to_one_and_trend_sensitivity(study, main):
    cfg, result = main
    patterns = {"up": (np.array([[1.0, 0], [-1, 1]]), 1)}
    found = {k: v.toPandas() for k, v in sensitivity.nonconservative(result, cfg, many_to_one=True, patterns=patterns).items()}
    assert set(found) == {"primary", "global", "pairwise", "dunnett", "trend"}
    primary = found["primary"].set_index(["taxon", "coef"])
    for r in found["dunnett"].itertuples():
        assert r.ss == primary.loc[(r.taxon, r.contrast), "ss"] and r.passed_ss == ((r.ss == 0 and r.p <= cfg.alpha) or (r.ss == 1 and r.p > cfg.alpha))
    whole = found["global"].set_index("taxon")["ss"]
    assert (found["trend"].set_index("taxon")["ss"].sort_index() == whole.sort_index()).all() and len(found["trend"]) == 30
    assert {"t00", "t01"} <= set(found["dunnett"].query("diff_robust")["taxon"]) <= {"t00", "t01", "t02", "t03"}
    again = {k: v.toPandas() for k, v in sensitivity.conservative(study[1], study[2], cfg, result, pseudos=(0.0,), many_to_one=True, patterns=patterns, own_trend=True).items()}
    # The same data twice: with the same draws every score is 0 or 1.
    assert again["dunnett"]["passed_ss"].all() and again["trend"]["passed_ss"].all() and set(again["dunnett"]["ss"]) <= {0.0, 1.0}
    with pytest.raises(ValueError, match="global"):
        sensitivity.conservative(study[1], study[2], Config("grp", group="grp"), result, patterns=patterns)


def test_regularised_correlations(spark):
    rng = np.random.default_rng(11)
    for size in (2, 5, 12):
        m = rng.normal(size=(size, size))
        m = (m + m.T) / 2 * rng.choice([0.05, 1, 5])
        values = np.linalg.eigvalsh(m)[::-1].copy()
        values[values <= 0] = values[values > 0].min()
        ratios = values[0] / values
        at = max(range(size - 1), key=lambda k: ratios[k + 1] - ratios[k])
        while values[at] < 0.01 and at:
            at -= 1
        floor = min(1, max(0.01, values[at]))
        got = np.linalg.eigvalsh(correlations.floored(m))[::-1]
        assert np.allclose(np.sort(np.maximum(values, floor)), np.sort(got))
    y = rng.normal(size=(8, 15)) @ rng.normal(size=(15, 15))
    y[rng.random(y.shape) < 0.45] = np.nan  # few common samples: not semidefinite by pairs
    rows = [(f"t{i:02}", f"s{j}", float(y[j, i])) for j in range(8) for i in range(15) if np.isfinite(y[j, i])]
    values = spark.createDataFrame(rows, "taxon string, sample string, y double")
    for method in ("pearson", "spearman"):
        wide = pd.DataFrame(y, columns=[f"t{i:02}" for i in range(15)])
        wide = wide.rank() if method == "spearman" else wide
        cov, seen = wide.cov(min_periods=2).fillna(0).to_numpy(), wide.notna().to_numpy().astype(float)
        together = seen.T @ seen
        assert np.linalg.eigvalsh(cov)[0] < -1e-3
        got = np.eye(15)
        for r in correlations.regular_correlations(values, method).collect():
            i, j = int(r.a[1:]), int(r.b[1:])
            got[i, j] = got[j, i] = r.corr_reg
        present = np.diag(together) >= 2
        assert np.linalg.eigvalsh(got[np.ix_(present, present)])[0] > -1e-9 and (got[(together < 2) & ~np.eye(15, dtype=bool)] == 0).all()
        want = correlations.regularised(cov, together)
        assert np.allclose((got - want)[np.ix_(present, present)], 0, atol=1e-9)


def test_several_tables_are_correlated(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=40)
    cells = lambda n, rows, first: [(f"t{i}", f"s{j:02}", float(np.exp(6 + 0.5 * rng.normal() + (base[j] if i == 0 else 0)) // 1)) for i in range(rows) for j in range(first, n)]
    schema = "taxon string, sample string, n double"
    tables = {"one": spark.createDataFrame(cells(40, 5, 0), schema), "two": spark.createDataFrame(cells(40, 4, 12), schema)}
    got = correlations.linear_correlations(tables, prv_cut=0, lib_cut=0, n_cv=2, thresh_len=10, corr_cut=2).toPandas().set_index(["a", "b"])
    assert len(got) == 9 * 8 / 2 and got.loc[("one - t0", "one - t1"), "n"] == 40 and got.loc[("one - t0", "two - t0"), "n"] == 28
    assert got.loc[("one - t0", "two - t0"), "corr"] > 0.6 and got["corr_reg"].notna().all()
    flagged = correlations.linear_correlations(tables, prv_cut=0, lib_cut=0, n_cv=2, thresh_len=10, corr_cut=-2, regular=False).toPandas()
    assert (flagged["corr"] == 0).all() and (flagged["p"] == 1).all() and "corr_reg" not in flagged
    few = {"one": tables["one"], "two": tables["two"].where("sample > 's33'")}
    with pytest.raises(ValueError, match="in common"):
        correlations.linear_correlations(few, prv_cut=0, lib_cut=0)


def test_constant_abundances_have_no_correlation(spark):
    rows = [("a", f"s{k}", 1.0) for k in range(5)] + [("b", f"s{k}", float(k)) for k in range(5)]
    from countloom.operators import transforms

    [row] = transforms.pearson(spark.createDataFrame(rows, "taxon string, sample string, y double")).collect()
    assert row.r is None and row.n == 5


@pytest.mark.parametrize("soft", [False, True])
def test_losses_of_thresholds(spark, soft):
    """Against the plain definition, thresholds that equal correlations and greater correlations than any threshold included."""
    rng = np.random.default_rng(13)
    y = rng.normal(size=(24, 6))
    y[:, 1] = y[:, 0]  # r1 = 1, beyond the last threshold
    samples = spark.createDataFrame([(f"s{k:02}",) for k in range(24)], "sample string")
    values = spark.createDataFrame([(f"t{i}", f"s{k:02}", float(y[k, i])) for i in range(6) for k in range(24)], "taxon string, sample string, y double")
    got = {(round(r.thresh, 9), r.alpha): r.loss for r in correlations.threshold_losses(correlations.pair_rows(values), samples, 6, "pearson", soft, 0.5, 11, (0.0, 0.3), 4, 3).collect()}
    marks = correlations.splits(samples, 4, 3).toPandas()
    want = {}
    for k in range(11):
        t = 0.5 * k / 10
        for alpha in (0.0, 0.3):
            losses = []
            for split in range(1, 5):
                train = marks[marks["split"] == split].sort_values("sample")["train"].to_numpy()
                r1, r2 = np.corrcoef(y[train].T), np.corrcoef(y[~train].T)
                cut = np.where(np.abs(r1) <= t, 0, np.sign(r1) * (np.abs(r1) - t * soft))
                off = ~np.eye(6, dtype=bool)
                losses.append(0.5 * np.sqrt(((cut - r2) ** 2).sum()) + alpha * (np.abs(cut) / np.abs(r2 + 1e-10))[off].sum())
            want[round(t, 9), alpha] = np.mean(losses)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_strict_mode(spark, study):
    from countloom.plans.analysis import within_taxa

    tested = spark.createDataFrame([("a", "x", 0.0), ("a", "y", 0.01), ("b", "x", 0.02), ("b", "y", 0.5)], "taxon string, contrast string, p double")
    screen = spark.createDataFrame([("a", True), ("b", False)], "taxon string, screened boolean")
    for strict, p in ((False, 1.0), (True, 0.0)):
        got = {(r.taxon, r.contrast): (r.p, r.q) for r in within_taxa(tested, screen, 2, "holm", 0.05, strict).collect()}
        assert got["a", "x"][0] == p and got["b", "x"] == (1.0, 1.0) and np.isclose(got["a", "y"][1], 0.03 if strict else 0.04)
