import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.llm import licenses, pitman_yor, stirling, toxicity

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of which those with an insult, or a stem with any ending, are toxic; some labels are null or repeated."""
    rng = random.Random(1)
    docs, labels = [], []
    for k in range(1500):
        text, bad = prose(rng, rng.choice([8, 40, 150])), rng.random() < 0.15
        if bad:
            words = text.split(" ")
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["grobble", "snarkwit", "Vexoid" + rng.choice("abcdefg") * 2]))
            text = " ".join(words)
        docs.append((k, text, "junk"))
        labels.append((k, int(bad), 1))
    docs += [(5000, None, "x"), (5001, "", "x"), (None, "no id", "x"), (5002, "grobble snarkwit", "x")]
    labels += [(9999, 1, 1), (None, 1, 1), (3, None, 1), (4, labels[4][1], 1)]
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_finds_held_out_toxic_texts(labelled):
    docs, labels, docs_df, labels_df = labelled
    model = toxicity.train(docs_df, labels_df)
    got = {r.doc_id: r.score for r in toxicity.score(docs_df, model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    held = [(got[k], y) for k, y, _ in labels[:1500] if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.97
    assert got[5002] > 0.5 and got[5000] == got[5001] < 0.5
    left = toxicity.clean_documents(docs_df, model)
    assert left.columns == docs_df.columns and {r.doc_id for r in left.collect()} == {k for k, s in got.items() if s < 0.5}
    assert toxicity.score(docs_df.limit(0), model).count() == 0
    only_clean = toxicity.train(docs_df, labels_df.where("toxic = 0"))
    assert toxicity.score(docs_df, only_clean).agg(F.max("score")).first()[0] < 0.1
    assert toxicity.score(docs_df, toxicity.train(docs_df, labels_df.limit(0))).agg(F.max("score")).first()[0] == 0.5


def test_label_model_weighs_correlated_voters_once():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    vote = lambda acc: np.where(rng.random(4000) < acc, np.where(y, 1, -1), np.where(y, -1, 1))
    good, fair, weak = vote(0.9), vote(0.85), vote(0.6)
    votes = np.stack([good, fair, vote(0.8), weak, weak, weak], axis=1).astype(np.int8)
    m = toxicity.LabelModel.fit(votes, prior=0.3, correlated=0.5)
    assert any(set(b) == {3, 4, 5} for b in m.blocks)
    assert (np.abs(m.accuracies - [0.9, 0.85, 0.8, 0.6, 0.6, 0.6]) < 0.06).all()
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.9


TEXTS = [
    "Released under the MIT License.\nAnd more.",
    "x UNDER THE MIT LICENSE under the mit license",
    "Licensed under the Apache License, Version 2.0. All rights reserved.",
    "apache-license-version 2",
    "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "under the\nmit license",
    "undér the mit licensé",
    "", None, "   ", "mit", "license " * 3000 + "cc by nc", "the mit licence under",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided the following conditions are met:",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
    "released under the mit \u212a license; LICEN\u0130SE under the mit licen\u017fe",
    "Redistribution and use in source and binary forms,\n\nwith or without modification, are permitted provided that the following conditions are met",
]


def test_licenses_match_sql(spark):
    import duckdb

    rows = [(k, t, k) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    documents, matches = licenses.scan(df)
    got = sorted(tuple(r) for r in documents.drop("row").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows[:-1]])
    want = con.execute(licenses.oracle_sql()).fetchall()
    assert sorted(set(got), key=str) == sorted({tuple(r) for r in want}, key=str) and len(got) == len(rows)
    by = {r.doc_id: r for r in documents.collect()}
    assert by[1].n_base == 2 and (by[1].first_word, by[1].last_word) == (1, 5) and by[2].labels == "all-rights-reserved,apache-2"
    assert by[5].labels == "gpl-3" and by[6].base_labels == "mit" and by[7].base_labels == "" and by[14].labels == "bsd" and by[14].score < 1
    assert by[15].labels == "mit" and by[16].labels == "mpl-2" and by[17].base_labels == "" and by[18].labels == ""
    assert by[17].n_words == 11  # the Kelvin sign is no k, the dotted I no i
    assert matches.count() >= 6
    assert licenses.scan(df.limit(0))[0].count() == 0


def test_language_model(spark):
    rng = random.Random(8)
    docs = [(k, prose(rng, rng.choice([2, 60, 200]))) for k in range(300)] + [(400, None), (401, ""), (402, "  "), (403, "unseen " * 50), (404, "the " * 20000), (None, "of the of the"), (7, "twice")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, key int, chunk int").repartition(4)
    scored = pitman_yor.score_documents(df, chunk_bytes=20_000, part_bytes=40_000)
    got = scored.collect()
    tokens = [(i, (t or "").encode().lower().split() + [b"\n"]) for i, t in docs]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    ppl = {r.held_out: r for r in pitman_yor.perplexity(scored, "held_out").collect()}
    assert ppl[True].perplexity < ppl[True].base_perplexity and ppl[False].perplexity < ppl[False].base_perplexity
    assert pitman_yor.score_documents(df.limit(0)).count() == 0


def ways(n, m, d):
    """S(n, m) by its definition: over the sizes of m tables, the first of which has the first customer."""
    if m == 1:
        return math.prod(k - d for k in range(1, n))
    return sum(math.comb(n - 1, k - 1) * math.prod(j - d for j in range(1, k)) * ways(n - k, m - 1, d) for k in range(1, n - m + 2))


def test_tables_are_drawn_from_their_conditional():
    rng = np.random.default_rng(0)
    for d in (0.2, 0.5, 0.8):
        known = stirling.table(d)
        assert all(abs(math.exp(known[n, m]) / ways(n, m, d) - 1) < 1e-9 for n in range(1, 9) for m in range(1, n + 1))
        for c, x in ((2, 0.3), (7, 2.0), (8, 0.01)):
            weight = np.array([ways(c, m, d) * x**m for m in range(1, c + 1)])
            got = np.bincount(stirling.draw_tables(np.full(40000, c), np.full(40000, x), np.ones(40000), d, rng), minlength=c + 1)[1:] / 40000
            assert np.abs(got - weight / weight.sum()).max() < 0.01
    assert stirling.draw_tables(np.array([0, 1]), np.ones(2), np.zeros(2), 0.5, rng).tolist() == [0, 1]


@pytest.mark.parametrize("d", [0.3, 0.6, 0.8])
def test_many_customers_follow_the_same_weights(d):
    rng, known = np.random.default_rng(1), stirling.table(d, 1500)
    m = np.array([1, 2, 5, 20, 80, 400, 1200])
    assert np.abs(stirling.log_stirling(np.full(len(m), 1500), m, d) - known[1500, m]).max() < 0.05
    for x in (0.05, 4.0, 60.0):
        weight = known[1500, 1:] + np.arange(1, 1501) * math.log(x)
        weight = np.exp(weight - weight.max())
        mean = (weight * np.arange(1, 1501)).sum() / weight.sum()
        got = stirling.draw_tables(np.full(4000, 1500), np.full(4000, x), np.ones(4000), d, rng, steps=20)
        assert abs(got.mean() / mean - 1) < 0.03


def test_sweeps_match_an_enumerated_posterior():
    """Two contexts and two words: the mean tables of every cell under all seatings, and under the chain."""
    count = np.array([3, 2, 4, 1])  # cells (context, word): 00 01 10 11
    context, word = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    s = pitman_yor.Shape(0.6, 0.01, 0.8, 0.8, 2, 10)
    rising = lambda a, step, n: math.prod(a + step * k for k in range(n))
    total, mean = 0.0, np.zeros(4)
    for t in itertools.product(*(range(1, c + 1) for c in count)):
        seats = math.prod(ways(int(c), m, s.discount) for c, m in zip(count, t))
        rooms = math.prod(rising(s.strength, s.discount, sum(m for m, u in zip(t, context) if u == k)) for k in (0, 1))
        n = [t[0] + t[2], t[1] + t[3]]
        for r in itertools.product(*(range(1, k + 1) for k in n)):
            root = math.prod(ways(k, m, s.root_discount) for k, m in zip(n, r)) * rising(s.root_strength, s.root_discount, sum(r)) / rising(s.root_strength, 1, sum(n)) / 3 ** sum(r)
            total += seats * rooms * root
            mean += seats * rooms * root * np.array(t)
    rng, tables, root_tables = np.random.default_rng(4), np.ones(4, np.int64), np.ones(2, np.int64)
    seen, rounds = np.zeros(4), 40000
    for _ in range(rounds):
        at_root = np.bincount(word, tables, 2).astype(np.int64)
        weights = pitman_yor.word_weights(at_root, root_tables, s, rng)
        root = pitman_yor.Root.of(at_root.sum(), root_tables.sum(), weights.sum(), s, rng)
        masses = pitman_yor.context_masses(np.bincount(context, tables, 2), s, rng)
        tables = pitman_yor.seat(count, tables, masses[context], weights[word], s, root, rng)
        root_tables = pitman_yor.seat_root(np.bincount(word, tables, 2).astype(np.int64), root_tables, s, root, rng)
        seen += tables
    assert np.abs(seen / rounds - mean / total).max() < 0.03


def test_predictive_chances_sum_to_one():
    s = pitman_yor.Shape(0.7, 0.4, 1.0, 1.0, 3, 10)
    roots = [pitman_yor.Root(7, 4, 0, 0, 0), pitman_yor.Root(8, 5, 0, 0, 0)]
    # One context with customers 4, 2, 0 of three words and none of the unknown one; tables by sample.
    tables, at_root, root_tables = np.array([[2, 1, 0, 0], [3, 1, 0, 0]]), np.array([[4, 2, 1, 0], [5, 2, 1, 0]]), np.array([[2, 1, 1, 0], [3, 1, 1, 0]])
    chance = pitman_yor.predictive(np.array([4.0, 2, 0, 0]), tables.mean(axis=0), np.full(4, 6.0), [np.full(4, 3.0), np.full(4, 4.0)], at_root, root_tables, roots, s)
    assert abs(chance.sum() - 1) < 1e-12 and (chance > 0).all()


def test_arrays_survive_packing():
    arrays = [np.array([0, 255]), np.array([], np.int64), np.array([1 << 40, 3], np.uint64), np.array([1.5, -2.0], np.float32), np.array([True, False]), np.array([70000])]
    got = pitman_yor.unpack(pitman_yor.pack(*arrays))
    assert [a.tolist() for a in got] == [a.astype(int).tolist() if a.dtype == bool else a.tolist() for a in arrays]


def test_contexts_are_whole_words(spark):
    """Words with the same first letters are told apart, and what follows them is learned."""
    docs = [(k, " ".join(random.Random(k).choice(["abcx one", "abcy two"]) for _ in range(200))) for k in range(60)]
    got = pitman_yor.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").selectExpr("sum(score) / sum(n_tokens) s").first().s
    assert 10**-got < 1.6  # one choice of two for every two words: 1.41


def test_label_model_is_a_fixed_point_of_enumerated_em():
    """Posteriors by products over blocks of each row's vote chances, and these chances by weighted counts, row by row."""
    rng = np.random.default_rng(31)
    truth = rng.random(400) < 0.3
    votes = np.zeros((400, 5), int)
    for j, right in enumerate((0.9, 0.8, 0.75, 0.85, 0.7)):
        says = rng.random(400) < 0.7
        votes[:, j] = np.where(says, np.where((rng.random(400) < right) == truth, 1, -1), 0)
    m = toxicity.LabelModel.fit(votes, 0.3, rounds=500)
    post = m.posterior(votes)
    again = []
    for row in range(400):
        chance = [m.prior, 1 - m.prior]
        for block in m.blocks:
            for c in (0, 1):
                weight = lambda r, c=c: post[r] if c == 0 else 1 - post[r]
                same = sum(weight(r) for r in range(400) if (votes[r, block] == votes[row, block]).all()) + 0.1
                kinds = len({tuple(v) for v in votes[:, block].tolist()})
                chance[c] *= same / (sum(weight(r) for r in range(400)) + 0.1 * kinds)
        again.append(chance[0] / sum(chance))
    assert np.abs(np.array(again) - post).max() < 1e-3 and abs(m.prior - post.mean()) < 1e-3
    assert ((post > 0.5) == truth).mean() > 0.85


def test_logistic_regression_matches_newtons_method():
    rng = np.random.default_rng(32)
    width, n, l2 = 12, 300, 0.01
    rows = [np.unique(rng.integers(0, width, rng.integers(1, 6))) for _ in range(n)]
    x = np.zeros((n, width + 1))
    for k, r in enumerate(rows):
        x[k, r] = 1
    x[:, -1] = 1
    target = 1 / (1 + np.exp(-(x @ rng.normal(size=width + 1))))
    scale = np.append(1 / np.sqrt(np.maximum(1, x[:, :-1].sum(axis=0)) / n + 0.01), 1.0)
    xs, penalty, z = x * scale, np.append(np.full(width, l2), 0.0), np.zeros(width + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-xs @ z))
        z = z - np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs / n + np.diag(penalty), xs.T @ (p - target) / n + penalty * z)
    got = toxicity.logistic(rows, target, width, l2=l2, rounds=3000)
    assert np.abs(got - z * scale).max() < 1e-3
