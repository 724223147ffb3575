"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``radius`` bits of each other agree, on at least one of m disjoint bit partitions, to within that
partition's own threshold, whenever the thresholds sum to radius - m + 1 (a threshold of -1 leaves a partition out).
Bits that vary together are grouped into one partition, so that each partition's keys repeat as little as they can in
the others' place; thresholds are allocated by dynamic programming over the candidates that each partition would
make at each threshold, as estimated from bit statistics of all fingerprints. A fingerprint probes a partition at
threshold t with its key under every mask of t bits; what shares a masked key is a candidate and is verified.

Equal fingerprints are one node. A masked key held by more than ``bucket`` fingerprints is not expanded into pairs:
its members are linked exactly through keys with one bit left out of the whole fingerprint, or as many as the radius
asks for, on either side (any two fingerprints that share such a key are within the radius, and any within the radius
share one), each member to the key's smallest. So work stays linear in a group of near copies, and no link is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.llm.common import batches_of, binary_array, flat_binary, fresh, id_and_text, parts, sized, written
from countloom.llm.components import components
from countloom.llm.passages import MIX, multipliers, shingle_hashes
from countloom.llm.wordbpe import slices

BITS = 64


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """The unsigned fingerprint of a text's word shingles (A-Z lower-cased; null or no words: 0)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, width: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Disjoint bit partitions and a threshold for each."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are and, for each two bits, in how many both are set: over all of them."""

    def run(batches):
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint8).reshape(-1, 8)
            for at in range(0, len(x), 1 << 14):
                b = np.unpackbits(x[at : at + (1 << 14)], axis=1, bitorder="little").astype(np.float64)
                total += b.T @ b
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["both"])

    per_task = fps.select("fp").mapInArrow(run, "both array<double>")
    cells = per_task.select(F.posexplode("both").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v")).collect()  # 64 x 64 cells
    both = np.zeros(BITS * BITS)
    for r in cells:
        both[r.cell] = r.v
    return fps.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """m partitions of nearly equal size; each next bit joins the open partition with whose bits it correlates most."""
    mean = both.diagonal() / max(1, n)
    cov = both / max(1, n) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    room = [BITS // m + (k < BITS % m) for k in range(m)]
    free, out = set(range(BITS)), []
    for size in room:
        own = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < size:
            b = max(sorted(free), key=lambda b: corr[b, own].sum())
            own.append(b)
            free.discard(b)
        out.append(tuple(sorted(own)))
    return tuple(out)


def expected(n: int, both: np.ndarray, part: tuple[int, ...], most: int) -> list[float]:
    """The expected cost of a partition at thresholds -1, 0, .. most: its probes and the pairs they make.

    Two fingerprints agree on a bit as often as its mean tells; correlated bits count for less than their number, by
    the effective number of independent bits (the participation ratio of their correlation's eigenvalues).
    """
    own = list(part)
    mean = both.diagonal()[own] / max(1, n)
    differ = 2 * mean * (1 - mean)
    cov = both[np.ix_(own, own)] / max(1, n) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(cov.diagonal(), 1e-12))
    eigen = np.clip(np.linalg.eigvalsh(cov / np.outer(scale, scale)), 0, None)
    share = min(1.0, float(eigen.sum() ** 2 / max((eigen**2).sum(), 1e-12)) / len(own))
    chance = np.zeros(most + 2)
    chance[0] = 1.0
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    within = np.cumsum(chance)[: most + 1] ** share
    probes = [float(np.prod([len(own) - i for i in range(t)]) / np.prod(range(1, t + 1), initial=1)) for t in range(most + 1)]
    return [0.0, *(n * p + n * n / 2 * w for p, w in zip(probes, within.tolist(), strict=True))]


def allocate(costs: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds (-1 and up) of least cost that sum to ``total``, by dynamic programming over the partitions."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for s, (c, ts) in best.items():
            for k, own in enumerate(cost):
                cand = (c + own, (*ts, k - 1))
                if s + k - 1 not in new or cand < new[s + k - 1]:
                    new[s + k - 1] = cand
        best = new
    return best[total]


def plan(n: int, both: np.ndarray, radius: int, most_parts: int = 6) -> Plan:
    """The partitions and thresholds of least expected cost."""
    found = []
    for m in range(1, most_parts + 1):
        groups = group_bits(n, both, m)
        cost, thresholds = allocate([expected(n, both, g, min(radius, len(g))) for g in groups], radius - m + 1)
        found.append((cost, m, thresholds, groups))
    _, _, thresholds, groups = min(found)
    return Plan(groups, thresholds)


def masked_keys(fps: np.ndarray, parts: tuple[tuple[int, ...], ...], thresholds: tuple[int, ...]):
    """(partition and mask number, masked key) of every probe, one pair of arrays for each mask."""
    number = 0
    for part, t in zip(parts, thresholds, strict=True):
        if t < 0:
            continue
        whole = sum(1 << b for b in part)
        for left_out in combinations(part, t):
            mask = np.uint64(whole & ~sum(1 << b for b in left_out))
            yield number, fps & mask
            number += 1


def probes(nodes: DataFrame, parts, thresholds) -> DataFrame:
    """slot (partition and mask), key, fp."""

    def run(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(own), 1 << 14):
                fps = own[at : at + (1 << 14)]
                for number, key in masked_keys(fps, parts, thresholds):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), number, np.int32)), pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], ["slot", "key", "fp"])

    return nodes.select("fp").mapInArrow(run, "slot int, key long, fp long")


def star_keys(nodes: DataFrame, radius: int) -> DataFrame:
    """Keys shared exactly by fingerprints within the radius: slot, key, fp.

    Two fingerprints differ in at most 2h bits just if flipping at most h bits of each can make them equal; with an
    odd radius 2h + 1 both also lose one same bit.
    """
    half, odd = radius // 2, radius % 2

    def run(batches):
        flips = [sum(1 << b for b in c) for k in range(half + 1) for c in combinations(range(BITS), k)]
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(own), 1 << 14):
                fps = own[at : at + (1 << 14)]
                for lost in range(BITS) if odd else (None,):
                    mask = np.uint64((1 << BITS) - 1 if lost is None else ((1 << BITS) - 1) & ~(1 << lost))
                    slot = pa.array(np.full(len(fps), -1 if lost is None else lost, np.int32))
                    for flip in flips:
                        key = (fps ^ np.uint64(flip)) & mask
                        yield pa.RecordBatch.from_arrays([slot, pa.array(key.view(np.int64)), pa.array(fps.view(np.int64))], ["slot", "key", "fp"])

    return nodes.select("fp").mapInArrow(run, "slot int, key long, fp long")


def links(nodes: DataFrame, radius: int = 2, bucket: int = 32, own_plan: Plan | None = None) -> DataFrame:
    """Links between different fingerprints (column fp, distinct) within ``radius`` bits: a, b. Their transitive closure
    is exact; inside a group of near copies not every pair is listed."""
    if own_plan is None:
        n, both = moments(nodes)
        own_plan = plan(n, both, radius)
    probed = written(probes(nodes, own_plan.partitions, own_plan.thresholds), "probes")
    sizes = probed.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(probed.join(sizes, ["slot", "key"]), "shared")
    few = shared.where(F.col("n") <= bucket)
    pairs = few.alias("x").join(few.alias("y"), ["slot", "key"]).where("x.fp < y.fp").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    # Each fingerprint gets very many keys, which Spark can't foresee: they are made over all partitions and never broadcast.
    # Dealt by a hash of fp, as a shuffle by fp itself would be taken for done by distinct() and its few partitions kept.
    many = shared.where(F.col("n") > bucket).select("fp").distinct().repartition(parts(nodes.sparkSession), F.xxhash64("fp"))
    starred = star_keys(many, radius)
    hubs = starred.groupBy("slot", "key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("slot", "key", "a")
    stars = starred.hint("merge").join(hubs.hint("merge"), ["slot", "key"]).where("a <> fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, radius: int = 2, bucket: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id linked, directly or not) for every row.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Rows with a null id keep
    their row; a component with no other id has a null one. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, width=width, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = components(links(nodes, radius, bucket))
    own = nodes.join(found, nodes.fp == found.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = own.groupBy("component").agg(F.min("low").alias("component_id"))
    named = own.join(lows, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")



def band_keys(shingles: np.ndarray, begins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``bands`` keys (columns) of each text with shingles: a hash of ``rows`` of its min-hashes.

    Two texts agree on a min-hash as often as their shingles' Jaccard similarity J tells, wherever the words differ, and
    so share a key with a chance of 1 - (1 - J**rows)**bands.
    """
    starts = begins[:-1][np.diff(begins) > 0]
    keys = np.zeros((bands, len(starts)), np.uint64)
    if not len(starts):
        return keys.T
    mixed = shingles ^ (shingles >> np.uint64(31))
    for f, odd in enumerate(multipliers(bands * rows)):
        key = (keys[f // rows] ^ np.minimum.reduceat(mixed * odd, starts)) * MIX[0]
        keys[f // rows] = key ^ (key >> np.uint64(29))
    return keys.T


#: Bits of a parity sketch.
SKETCH = 1024


def sketches(shingles: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many different shingles each text has, and its parity sketch (rows of ``SKETCH`` / 64 longs).

    Each different shingle flips one bit. Shingles of both texts cancel out, so two sketches differ in no more bits than
    there are shingles in just one of the texts.
    """
    texts = len(begins) - 1
    owner = np.repeat(np.arange(texts), np.diff(begins))
    order = np.lexsort((shingles, owner))
    value, owner = shingles[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    place = ((value ^ (value >> np.uint64(32))) % np.uint64(SKETCH)).astype(np.int64)
    odd = np.bincount(owner * SKETCH + place, minlength=texts * SKETCH) % 2
    bits = np.packbits(odd.astype(np.uint8).reshape(texts, SKETCH), axis=1, bitorder="little")
    return np.bincount(owner, minlength=texts), bits.view("<i8").reshape(texts, SKETCH // 64)


def can_be_similar(x: str, y: str, similar: float) -> Column:
    """Whether two sketches (columns n and bits of the aliases) leave room for a Jaccard similarity of ``similar``: true for
    all pairs that have it. With J, two sets of n and m members have at most (1 - J) / (1 + J) * (n + m) in just one."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.bits")[k].bitwiseXOR(F.col(f"{y}.bits")[k])) for k in range(SKETCH // 64)), F.lit(0))
    even = F.least(n, m) >= F.lit(similar - 1e-9) * F.greatest(n, m)
    return even & (differ <= F.lit((1 - similar) / (1 + similar) + 1e-9) * (n + m))


def plausible(pairs: DataFrame, sketched: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) that ``can_be_similar``, by ``sketched`` (doc, n, bits)."""
    x, y = sketched.alias("x"), sketched.alias("y")
    joined = pairs.join(x, F.col("a") == F.col("x.doc")).join(y, (F.col("b") == F.col("y.doc")) & can_be_similar("x", "y", similar))
    return joined.select("a", "b").distinct()


def verified(pairs: DataFrame, docs: DataFrame, *, width: int, similar: float) -> DataFrame:
    """The pairs (a, b: ids of ``docs``, which has doc_id and text) whose sets of word shingles have a Jaccard similarity of
    ``similar`` or more. A text of fewer words has itself as its only shingle."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(sized(ids), F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))

    def shingles(text: pa.Array) -> np.ndarray:
        found = shingle_hashes(text, width)[0]
        if not len(found):
            found = np.array([xxhash.xxh64_intdigest(b" ".join((text[0].as_py() or "").encode().lower().split()))], np.uint64)
        return np.unique(found)

    def each(batch, side: str):
        last, own = None, None
        for k, i in enumerate(batch.column(side).to_pylist()):
            if i != last:
                own, last = shingles(batch.column("text").slice(k, 1)), i
            yield own

    def first(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                sets = [s.astype("<u8").tobytes() for s in each(batch, "a")]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sets, pa.binary())], ["a", "b", "shingles"])

    def second(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                raw, begins = flat_binary(batch.column("shingles"))
                keep = []
                for k, y in enumerate(each(batch, "b")):
                    x = raw[begins[k] : begins[k + 1]].view("<u8")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similar * (len(x) + len(y) - both))
                table = pa.Table.from_batches([batch]).select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
                yield from table.to_batches()

    one = pairs.join(texts.withColumnRenamed("doc_id", "a"), "a").mapInArrow(first, "a long, b long, shingles binary")
    return one.join(texts.withColumnRenamed("doc_id", "b"), "b").mapInArrow(second, "a long, b long")


def verified_links(keys: DataFrame, docs: DataFrame, *, width: int, similar: float, bucket: int, sketched: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that verify, among texts that share a key; ``keys`` has slot, key, doc. Texts of a key meet under the
    condition that ``sketched`` (doc, n, bits) leaves room for the similarity, so only such pairs leave the join.

    All pairs of a key with at most ``bucket`` texts are tried. In a larger one hubs are tried, in rounds, with all of its
    texts that aren't linked to them yet in any way: first one hub, then more, from the texts that aren't linked to the
    key's first hub, until each is or has been a hub. So no link between texts that would stay apart is lost. Keys draw
    their hubs by a hash, differently from each other.
    """
    sizes = keys.groupBy("slot", "key").agg(F.count("*").alias("texts")).where("texts > 1")
    own = keys.join(sizes, ["slot", "key"])
    if sketched is not None:
        own = own.join(sketched, "doc")
    marks = ["n", "bits"] if sketched is not None else []
    near = can_be_similar("x", "y", similar) if sketched is not None else F.lit(True)
    same = (F.col("x.slot") == F.col("y.slot")) & (F.col("x.key") == F.col("y.key"))
    shared = written(own, "shared")
    few, many = shared.where(F.col("texts") <= bucket), shared.where(F.col("texts") > bucket).select("slot", "key", "doc", *marks)
    pairs = few.alias("x").join(few.alias("y"), same & (F.col("x.doc") < F.col("y.doc")) & near).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    tried = written(pairs.distinct(), "candidates")
    found = written(verified(tried, docs, width=width, similar=similar), "verified")
    if many.isEmpty():
        return found
    # By partial aggregation, as a key may be very large yet.
    first = F.min(F.struct(F.xxhash64("slot", "key", "doc").alias("h"), "doc"))
    heads = written(many.groupBy("slot", "key").agg(first.alias("x")).select("slot", "key", F.col("x.doc").alias("hub")), "hubs")
    hubs, rest, hubs_each, labelled = heads, many.select("slot", "key", "doc"), 4 * bucket, many.withColumn("class", F.col("doc"))
    while True:
        of_hubs = labelled.join(hubs.withColumnRenamed("hub", "doc"), ["slot", "key", "doc"], "left_semi")
        apart = labelled.alias("x").join(of_hubs.alias("y"), same & (F.col("x.class") != F.col("y.class")) & near)
        new = apart.select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
        new = written(new.distinct().join(tried, ["a", "b"], "left_anti"), "candidates")
        tried = tried.unionByName(new)
        found = found.unionByName(written(verified(new, docs, width=width, similar=similar), "verified"))
        classes = components(found).select(F.col("node").alias("doc"), F.col("component"))
        labelled = written(many.join(classes, "doc", "left").select("slot", "key", "doc", *marks, F.coalesce("component", "doc").alias("class")), "classes")
        of_heads = heads.join(labelled.select("slot", "key", F.col("doc").alias("hub"), F.col("class").alias("head_class")), ["slot", "key", "hub"]).drop("hub")
        left = labelled.join(of_heads, ["slot", "key"]).where("class <> head_class").select("slot", "key", "doc")
        left = left.join(rest, ["slot", "key", "doc"], "left_semi").join(hubs.withColumnRenamed("hub", "doc"), ["slot", "key", "doc"], "left_anti")
        rest = written(left, "rest")
        if rest.isEmpty():
            return found
        order = Window.partitionBy("slot", "key").orderBy(F.xxhash64("slot", "key", "doc"), "doc")
        hubs = rest.withColumn("k", F.row_number().over(order)).where(F.col("k") <= hubs_each).select("slot", "key", F.col("doc").alias("hub"))
        hubs = written(hubs, "hubs")
        hubs_each *= 4


def near_copies(docs: DataFrame, *, width: int = 5, similar: float = 0.8, bands: int = 24, rows: int = 5, bucket: int = 32, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (the smallest id linked, directly or not) of rows with an id.

    Equal texts (A-Z lower-cased, white space as one space) are linked. Different ones are, if they share one of their
    band keys, or with ``radius`` their fingerprints are linked as ``near_duplicates`` links them, and their ``width``-word shingles verify; of pairs with a similarity of 0.8, 1 in 10,000 shares none, of
    more similar ones fewer. Null texts count as empty, and empty ones are linked like any other; so short a text that it
    has no shingle is only linked to equal ones.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                keys = [xxhash.xxh3_128_digest(b" ".join(t.encode().lower().split())) for t in part.column("text").to_pylist()]
                shingles, begins = shingle_hashes(part.column("text"), width)
                found = band_keys(shingles, begins, bands, rows)
                held = binary_array(found.astype("<u8"), np.where(np.diff(begins) > 0, 8 * bands, 0))
                n, bits = sketches(shingles, begins)
                bits = pa.ListArray.from_arrays(np.arange(0, bits.size + 1, SKETCH // 64, dtype=np.int32), pa.array(bits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), held, pa.array(n), bits], ["doc_id", "key", "bands", "n", "bits"])

    def spread(batches):
        for batch in batches:
            raw, begins = flat_binary(batch.column("bands"))
            own = batch.column("doc").filter(pa.array(np.diff(begins) > 0))
            keys = raw.view("<i8").reshape(-1, bands)
            for band in range(bands):
                cols = [pa.array(np.full(len(own), band, np.int32)), pa.array(np.ascontiguousarray(keys[:, band])), own]
                yield pa.RecordBatch.from_arrays(cols, ["slot", "key", "doc"])

    own = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    with batches_of(docs.sparkSession, 500):
        texts = written(own.mapInArrow(run, "doc_id long, key binary, bands binary, n long, bits array<long>"), "texts")
        firsts = (F.first(c).alias(c) for c in ("bands", "n", "bits"))
        nodes = written(texts.groupBy("key").agg(F.min("doc_id").alias("doc"), *firsts), "nodes")
        keys = nodes.select("doc", "bands").mapInArrow(spread, "slot int, key long, doc long")
        if radius is not None:
            alike = near_duplicates(own, width=width, radius=radius, bucket=bucket).groupBy("doc_id").agg(F.collect_set("component_id").alias("keys"))
            whole = nodes.where("n > 0").select("doc").join(alike, F.col("doc") == F.col("doc_id"))
            keys = keys.unionByName(whole.select(F.lit(bands).alias("slot"), F.explode("keys").alias("key"), "doc"))
        keys = written(keys, "keys")
        found = components(verified_links(keys, own, width=width, similar=similar, bucket=bucket, sketched=nodes.select("doc", "n", "bits")))
    grouped = nodes.join(found, nodes.doc == found.node, "left").select("key", F.coalesce("component", "doc").alias("component_id"))
    return texts.select("doc_id", "key").join(grouped, "key").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, groups: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The documents without those that ``groups`` (doc_id, component_id) links to a smaller id, columns unchanged.

    Rows with a null id stay, and so do all rows that share a kept id; null and empty texts are one group, as ``groups``
    has them. An empty table stays empty.
    """
    name = fresh(docs, "gone_id")
    gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(sized(gone), docs[id_col] == F.col(name), "left_anti")
