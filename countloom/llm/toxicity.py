"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

1. A bounded sample of labelled training documents (``most_labelled``) gives word-start features with their counts
   among toxic and clean documents. The most telling ones become lexicon voters; pattern voters look at how many
   lexicon words a document has, how dense they are, and whether it has none. Each voter says toxic (1), clean (-1)
   or nothing (0).
2. The label model is generative: a document has a hidden class, and each block of voters a distribution of votes
   given the class. Voters that agree beyond what the class explains are merged into one block, whose joint votes are
   modelled together, so correlated voters count once. EM estimates prior, accuracies and block distributions
   without labels, starting from the vote of the majority.
3. A logistic regression on word-start features (present or not) learns the posterior labels.

Labels, language, source and id are never inputs of a score. Only the classifier is fitted on a sample; all documents
are scored whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import id_and_text, written
from countloom.llm.wordbpe import slices, split_words

LETTERS = re.compile(r"[^\W\d_]+")
STARTS = (4, 5, 6)


def starts(word: str) -> list[str]:
    """The features of a white-space-separated piece: the first letters of its words, a short word with an end mark."""
    found = []
    for w in LETTERS.findall(word.lower()):
        w += "$"
        found += {w[:n] for n in STARTS}
    return found


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(1))


def document_features(texts: pa.Array, vocabulary: dict[str, int] | None):
    """For each text its distinct features, as names or, with a vocabulary, as the numbers of those it holds; also its words."""
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    found = [starts(w) for w in coded.dictionary.to_pylist()]
    if vocabulary is not None:
        found = [[vocabulary[f] for f in x if f in vocabulary] for x in found]
    known = np.fromiter(map(bool, found), bool, len(found))
    index = coded.indices.to_numpy(zero_copy_only=False)
    hits = np.flatnonzero(known[index]) if len(found) else np.zeros(0, np.int64)
    at = np.searchsorted(hits, offsets)
    index = index[hits].tolist()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own: set = set()
        for i in set(index[a:b]):
            own.update(found[i])
        yield own, b - a


def labelled_sample(docs: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """doc_id, text, toxic of training rows, at most about ``most_labelled``, picked by a hash of their id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.count()
    if n > most_labelled:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most_labelled / n))
    # As many rows as most_labelled, so small at any size of the input.
    return docs.join(F.broadcast(own), "doc_id")


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature, toxic (documents), clean (documents)."""

    def run(batches):
        seen: dict[str, list[int]] = {}

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["feature", "toxic", "clean"])
            seen.clear()

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for (own, _), y in zip(document_features(part.column("text"), None), part.column("toxic").to_pylist(), strict=True):
                    for f in own:
                        seen.setdefault(f, [0, 0])[y] += 1
                if len(seen) > 400_000:
                    yield from rows()
        if seen:
            yield from rows()

    return sample.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class LabelModel:
    """Blocks of voters with a vote distribution for either class."""

    prior: float = 0.5
    blocks: list[list[int]] = field(default_factory=list)
    tables: list[dict[tuple, tuple[float, float]]] = field(default_factory=list)
    accuracies: np.ndarray | None = None

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.full(len(votes), np.log(self.prior) - np.log1p(-self.prior))
        for block, table in zip(self.blocks, self.tables, strict=True):
            keys, inverse = np.unique(votes[:, block], axis=0, return_inverse=True)
            gain = np.array([np.log(p / q) for p, q in (table.get(tuple(k), (1.0, 1.0)) for k in keys.tolist())])
            logit += gain[inverse.reshape(-1)]
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    @classmethod
    def fit(cls, votes: np.ndarray, prior: float, rounds: int = 25, correlated: float = 0.25, widest: int = 4) -> LabelModel:
        m, k = cls(prior=prior), votes.shape[1]
        m.blocks = [[j] for j in range(k)]
        m.merge(votes, np.zeros(len(votes)), 0.95, widest)  # voters that say the same thing are one from the start
        total = sum(np.sign(votes[:, b].sum(axis=1)) for b in m.blocks)
        post = np.clip(1 / (1 + np.exp(-2.0 * total)), 0.02, 0.98)
        for stage in range(2):
            for _ in range(rounds):
                m.tables = [m.table(votes[:, b], post) for b in m.blocks]
                m.prior = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
                new = m.posterior(votes)
                moved, post = np.abs(new - post).max(), new
                if moved < 1e-5:
                    break
            if stage == 0:
                m.merge(votes, post, correlated, widest)
        right = (votes == 1) * post[:, None] + (votes == -1) * (1 - post[:, None])
        m.accuracies = right.sum(axis=0) / np.maximum(1, (votes != 0).sum(axis=0))
        return m

    @staticmethod
    def table(votes: np.ndarray, post: np.ndarray) -> dict[tuple, tuple[float, float]]:
        keys, inverse = np.unique(votes, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        p = np.bincount(inverse, post, len(keys)) + 0.1
        q = np.bincount(inverse, 1 - post, len(keys)) + 0.1
        return {tuple(key): (a, b) for key, a, b in zip(keys.tolist(), (p / p.sum()).tolist(), (q / q.sum()).tolist(), strict=True)}

    def merge(self, votes: np.ndarray, post: np.ndarray, correlated: float, widest: int) -> None:
        """Joins blocks with voters whose residuals, given the class, correlate; the strongest pairs first, ``widest`` voters at most."""
        x = votes.astype(float)
        mean1 = (post @ x) / max(post.sum(), 1e-9)
        mean0 = ((1 - post) @ x) / max((1 - post).sum(), 1e-9)
        res = x - post[:, None] * mean1 - (1 - post[:, None]) * mean0
        scale = np.sqrt((res * res).mean(axis=0))
        corr = (res.T @ res) / len(x) / np.maximum(np.outer(scale, scale), 1e-12)
        pairs = [(abs(corr[i, j]), i, j) for i in range(len(corr)) for j in range(i) if abs(corr[i, j]) >= correlated]
        home = {j: b for b in map(list, self.blocks) for j in b}
        for _, i, j in sorted(pairs, reverse=True):
            a, b = home[i], home[j]
            if a is not b and len(a) + len(b) <= widest:
                a.extend(b)
                home.update(dict.fromkeys(b, a))
        self.blocks = [sorted(b) for b in {id(b): b for b in home.values()}.values()]


def logistic(rows: list[np.ndarray], target: np.ndarray, width: int, l2: float = 2e-4, rounds: int = 400) -> np.ndarray:
    """Weights and, last, the constant of a logistic regression on present features, by accelerated gradient descent."""
    size = np.array([len(r) for r in rows])
    col = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(col, minlength=width)) / max(1, len(rows)) + 0.01)
    w = z = np.zeros(width + 1)
    step, t = 4.0 / (1 + float(np.bincount(row, scale[col] ** 2, len(rows)).mean() if len(rows) else 1)), 1.0
    for _ in range(rounds):
        logit = np.bincount(row, (z[:-1] * scale)[col], len(rows)) + z[-1]
        err = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - target
        grad = np.append(np.bincount(col, err[row], width) * scale / len(rows) + l2 * z[:-1], err.mean())
        new = z - step * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return np.append(w[:-1] * scale, w[-1])


@dataclass
class ToxicityModel:
    """Features of the classifier with their weights, and the label model that taught it."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    labels: LabelModel | None = None

    def scores(self, texts: pa.Array) -> np.ndarray:
        bias, w = float(self.weights[-1]), self.weights
        logit = np.array([bias + sum(w[f] for f in sorted(own)) for own, _ in document_features(texts, self.vocabulary)])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def vote(rows: list[np.ndarray], toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """The votes of all voters: one for each lexicon feature, then the patterns."""
    n, place = len(rows), {int(f): k for k, f in enumerate(toxic)}
    quiet = {int(f) for f in clean}
    out = np.zeros((n, len(toxic) + 5), np.int8)
    for i, own in enumerate(rows):
        hits = [place[f] for f in own.tolist() if f in place]
        out[i, hits] = 1
        calm = sum(f in quiet for f in own.tolist())
        k = len(toxic)
        out[i, k] = 1 if len(hits) >= 3 else 0  # at least one lexicon word with all its starts
        out[i, k + 1] = 1 if len(hits) >= 5 else 0
        out[i, k + 2] = 1 if hits and len(hits) * 40 >= max(1, len(own)) else 0
        out[i, k + 3] = 0 if hits else -1
        out[i, k + 4] = -1 if not hits and calm >= 5 else 0
    return out


def train(docs: DataFrame, labels: DataFrame, *, most_labelled: int = 12_000, features: int = 1024, voters: int = 80, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits the three models. Without any labelled row, or with one class only, every score is that class's share (0.5 without)."""
    own = id_and_text(docs, id_col, text_col)
    sample = written(labelled_sample(own, labels, most_labelled), "toxicity")
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    if not n1 or not n0:
        share = 0.5 if not n1 + n0 else (n1 + 0.5) / (n1 + n0 + 1)
        return ToxicityModel({}, np.array([np.log(share / (1 - share))]))
    # How surprising a feature's counts are if it told nothing (the G statistic, with the direction as its sign): unlike
    # an odds ratio's z value it is largest for features that many toxic documents and no clean ones have, and small for
    # the words of a few copies. A bounded number of features leaves the cluster.
    n = n1 + n0
    both = F.col("toxic") + F.col("clean")

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g = 2 * (term(F.col("toxic"), both * n1 / n) + term(F.col("clean"), both * n0 / n) + term(n1 - F.col("toxic"), (n - both) * n1 / n) + term(n0 - F.col("clean"), (n - both) * n0 / n))
    g = F.when(F.col("toxic") * n0 > F.col("clean") * n1, g).otherwise(-g)
    told = feature_counts(sample).where(both >= 4).withColumn("g", F.when(both < n, g).otherwise(0.0))
    top = told.orderBy(F.desc(F.abs("g")), "feature").limit(features).collect()
    vocabulary = {r.feature: k for k, r in enumerate(top)}
    odds = np.array([((r.toxic + 0.5) / (n1 + 1)) / ((r.clean + 0.5) / (n0 + 1)) for r in top])
    gs = np.array([r.g for r in top])
    sure = np.array([r.toxic >= 9 * r.clean for r in top])  # a voter is right nine times of ten
    toxic = np.flatnonzero((odds > 20) & (gs > 20) & sure)[:voters]
    if not len(toxic):  # few labels: the strongest there are
        toxic = np.flatnonzero((odds > 4) & (gs > 4))[:voters]
    clean = np.flatnonzero(gs < -6)[:voters]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found = [(sorted(f), n) for f, n in document_features(part.column("text"), vocabulary)]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.int64())], ["features", "words"])

    seen = sample.select("text").mapInArrow(run, "features array<int>, words long").collect()  # as many rows as most_labelled
    seen.sort(key=lambda r: (list(r.features), r.words))
    rows = [np.array(r.features, np.int64) for r in seen]
    votes = vote(rows, toxic, clean)
    model = LabelModel.fit(votes, prior=n1 / (n1 + n0))
    return ToxicityModel(vocabulary, logistic(rows, model.posterior(votes), len(vocabulary)), model)


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1; a null or empty text has the model's constant) for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(part.column("text")), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def clean_documents(docs: DataFrame, model: ToxicityModel, *, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, columns unchanged."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            text = batch.column(batch.schema.get_field_index(text_col))
            keep = np.concatenate([model.scores(p.column(0)) for p in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text")] or [np.zeros(0)]) < threshold
            yield from table.filter(pa.array(keep)).to_batches()

    return docs.mapInArrow(run, docs.schema)
