"""What the passes do to the tables, where results alone would not show it."""

from __future__ import annotations

import pytest

from countloom.plans import sensitivity
from countloom.plans.analysis import Config, analyze, centred
from countloom.plans.formula import frame, moments, parse
from countloom.plans.mixed import analyze_mixed
from countloom.plans.sheets import count_sheets, log_sheets, only_taxa, sheets
from countloom.sources import shared


@pytest.fixture
def written(monkeypatch):
    """Names of the tables that go to the shared folder."""
    names, old = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, name: (names.append(name), old(df, name))[1])
    return names


@pytest.fixture(scope="module")
def study(spark):
    cells = [(f"t{i}", f"s{j:02}", float(1 + (7 * i + 5 * j + i * j) % 11)) for i in range(6) for j in range(29) if (3 * i + j) % 4]
    cells += [("t0", "s00", 0.0), ("t5", "s29", None), ("t6", "s01", None), ("t6", "s02", 0.0)]
    counts = spark.createDataFrame(cells, "taxon string, sample string, n double")
    samples = spark.createDataFrame([(f"s{j:02}", f"g{j % 3}", f"h{j % 5}", None if j == 4 else float(j % 7)) for j in range(31)], "sample string, grp string, home string, x double")
    return counts, samples


def long_cells(s) -> dict:
    rows = s.rows.select("sample", "at", "y").collect()
    return {(s.taxa[k], r.sample): y for r in rows for k, y in zip(r.at, r.y, strict=True)}


@pytest.mark.parametrize("pseudo", [0.0, 0.5])
def test_logs_by_sample_equal_long_logs(study, pseudo):
    counts, samples = study
    d = frame(samples, parse("grp + x"), "grp")
    gram, _, every = moments(d)
    want = sheets(centred(counts, samples, pseudo), d, gram, every)
    got = log_sheets(count_sheets(counts, d, gram, every), pseudo)
    assert got.taxa == want.taxa and long_cells(got) == pytest.approx(long_cells(want), abs=1e-12)
    some = only_taxa(got, {"t1", "t4"})
    assert some.taxa == ["t1", "t4"] and long_cells(some) == {k: v for k, v in long_cells(got).items() if k[0] in some.taxa}


def test_conservative_runs_share_counts_by_sample(study, written):
    counts, samples = study
    counts = counts.where("n > 0")
    found = sensitivity.conservative(counts, samples, Config("grp", group="grp", prv_cut=0), pseudos=(0.5, 1.0))["primary"].toPandas()
    assert len(found) == 18
    assert written.count("counts-by-sample") == written.count("samples") == 1 and not {"dense", "logs"} & set(written)


def test_corrected_table_is_asked_for(study, written):
    counts, samples = study
    counts = counts.where("n > 0")
    run = analyze(counts, samples, Config("grp", group="grp", prv_cut=0, pseudo=0.5))
    rows = {(r.taxon, r.sample): r.y for r in run.corrected.collect()}
    theta = {r.sample: r.theta for r in run.theta.collect()}
    want = {(r.taxon, r.sample): r.y - theta[r.sample] for r in centred(counts, samples, 0.5).collect()}
    assert rows == pytest.approx(want, abs=1e-12)


def test_mixed_rounds_shuffle_no_cells(study, written):
    """Cells are put together by sample once; rounds hand on sums by taxon and group only."""
    counts, samples = study
    run = analyze_mixed(counts.where("n > 0"), samples, Config("grp + x", group="grp", prv_cut=0, max_iter=3, tol=0.0), "(1 | home)")
    assert len(run.epsilons) == 3 and run.primary.count() == 24
    assert written.count("counts-by-sample") == 1 and not {"cells", "dense", "logs"} & set(written)
