"""A hierarchical Pitman-Yor language model, its seating sampled by Gibbs, and scores of documents under it.

Each word is a context: a restaurant whose customers are the words that follow it in training documents (a document's
first word follows its neighbour's end). A new table's dish comes from the parent that all contexts share, the unigram
restaurant, where each table is one customer; its base is uniform over the vocabulary and one unknown word. Contexts,
words and cells (a word after a context) are as many as the corpus has.

A sweep draws, each given all else: for every context u a gamma variable g(u) of shape strength / discount + tables(u),
given which its dishes are independent; the shared weights P of the unigram restaurant, gamma variables by word; every
cell's number of tables m, from S(c, m) (discount g(u) P(w))**m, S being generalised Stirling numbers; and every word's
tables in the unigram restaurant in the same way. So all cells are drawn at once without approximating by old totals,
but for one thing: what the unigram restaurant takes from its base is spread evenly over words, not drawn. Predictive
probabilities are averaged over the samples after burn-in. Discounts are set from the counts of counts.

Nothing of the size of the vocabulary meets in one place. Words and contexts are dealt into parts by hash: a cell lives
in its word's part, a context's totals in the context's. Cells of one customer have one table for ever, so in a sweep
only cells of two or more travel: two small shuffles, of masses to the words' parts and of tables to the contexts'.
A task turns a run of documents into a chunk: its cells go to their parts once, its tokens wait in a table, and scores
of cells come back to it at the end. A word is known by a 64-bit hash. A part holds a word's cells whole, one for each
different context it has.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import dropped, reclaim, shared_dir
from countloom.llm.stirling import draw_tables
from countloom.llm.wordbpe import slices, split_words

CONTEXT = np.uint64(16)  # a context is known by the other 48 bits of its word's hash
END = np.uint64(xxhash.xxh64_intdigest("\n"))  # the end of a document, which no word can be

# ---------------------------------------------------------------- rows: arrays as bytes


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays (whole numbers from 0, or floats) in as few bytes as their greatest value needs, by byte planes."""
    heads, planes = [struct.pack("<H", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind == "f":
            a = a.astype("<f4")
            code = 14
        else:
            top = int(a.max()) if len(a) else 0
            code = next(k for k in (1, 2, 4, 8) if top < 1 << 8 * k)
            a = a.astype(f"<u{code}")
        heads.append(struct.pack("<BQ", code, len(a)))
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return b"".join(heads) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<H", blob)
    heads = [struct.unpack_from("<BQ", blob, 2 + 9 * k) for k in range(n)]
    body, at, out = zstandard.ZstdDecompressor().decompress(memoryview(blob)[2 + 9 * n :], max_output_size=max(1, sum(k % 10 * m for k, m in heads))), 0, []
    for code, m in heads:
        width = code % 10
        flat = np.ascontiguousarray(np.frombuffer(body, np.uint8, width * m, at).reshape(width, m).T).reshape(-1)
        out.append(flat.view("<f4" if code == 14 else f"<u{width}"))
        at += width * m
    return out


#: kind of row, the part (as its bucket) or chunk it is for, the part or chunk it is from, and its arrays.
ROW = "kind string, bucket int, peer long, blob binary"
NAMES, TYPES = ["kind", "bucket", "peer", "blob"], [pa.string(), pa.int32(), pa.int64(), pa.binary()]


def rows_of(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(NAMES, TYPES, strict=True))})


def buckets(spark: SparkSession, n: int) -> np.ndarray:
    """A number for each of n parts such that a shuffle into n partitions by it gives each its own."""
    ids = spark.range(4 * n * max(4, n.bit_length())).select(F.col("id").cast("int").alias("b"))
    first = ids.groupBy(F.pmod(F.hash("b"), F.lit(n)).alias("k")).agg(F.min("b").alias("b")).collect()  # n rows
    return np.array([r.b for r in sorted(first, key=lambda r: r.k)], np.int32)


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


# ---------------------------------------------------------------- counting


def tokens_of(batch: pa.RecordBatch, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' hashes by part, each token as a word's place there (words of a text, then its end), and texts' sizes."""
    runs, sizes = [], []
    for own in slices(batch, "text", 4 << 20):
        words, offsets = split_words(own.column("text"), lower=True)
        local = words.dictionary_encode()
        spelled = local.dictionary.to_pylist()
        size = np.diff(offsets) + 1
        token = np.full(int(size.sum()), len(spelled), np.int32)
        inner = np.ones(len(token), bool)
        inner[np.cumsum(size) - 1] = False
        token[inner] = local.indices.to_numpy(zero_copy_only=False)
        runs.append((np.append(np.fromiter((xxhash.xxh64_intdigest(w) for w in spelled), np.uint64, len(spelled)), END), token))
        sizes.append(size)
    keys = np.unique(np.concatenate([k for k, _ in runs]))
    order = np.lexsort((keys, part_of_word(keys, n_parts)))
    place = np.empty(len(keys), np.int32)
    place[order] = np.arange(len(keys), dtype=np.int32)
    tokens = np.concatenate([place[np.searchsorted(keys, k)][t] for k, t in runs])
    return keys[order], tokens, np.concatenate(sizes)


def part_of_word(keys: np.ndarray, n_parts: int) -> np.ndarray:
    return (keys >> CONTEXT) % np.uint64(n_parts)


def before(tokens: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each token's context: the token before; the end before the first."""
    return np.append(np.int32(np.flatnonzero(keys == END)[0]), tokens[:-1])


def chunked(docs: DataFrame, bucket: np.ndarray, chunk_bytes: int) -> DataFrame:
    """Rows "cells" (a chunk's words, contexts, cells and their training counts in one part) and "tokens" (a chunk's documents)."""
    n_parts = len(bucket)

    def run(batches):
        number = (TaskContext.get().partitionId() << 32) + TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, "text", chunk_bytes):
                keys, tokens, size = tokens_of(piece, n_parts)
                held = piece.column("held_out").to_numpy(zero_copy_only=False)
                pair = tokens.astype(np.int64) * len(keys)
                pair += before(tokens, keys)
                pair *= 2
                pair += np.repeat(held, size)
                pair.sort()
                cell = pair >> 1
                start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                count = np.add.reduceat(1 - (pair & 1), start)
                cell = cell[start]
                word, context = cell // len(keys), cell % len(keys)
                del pair, cell, start
                w = np.searchsorted(part_of_word(keys, n_parts), np.arange(n_parts + 1, dtype=np.uint64))
                c = np.searchsorted(word, w)
                rows = []
                for p in range(n_parts):
                    if c[p] < c[p + 1]:
                        own = slice(c[p], c[p + 1])
                        seen, at = np.unique(context[own], return_inverse=True)
                        rows.append(("cells", int(bucket[p]), number, pack(keys[w[p] : w[p + 1]], np.bincount(word[own] - w[p]), keys[seen] >> CONTEXT, at, count[own])))
                order = np.argsort(-np.bincount(tokens, minlength=len(keys)), kind="stable")  # frequent words get small numbers
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                ids = pc.fill_null(piece.column("doc_id"), 0).to_numpy().astype(np.int64)
                null = piece.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                first = np.flatnonzero(keys == END)
                rows.append(("tokens", int(bucket[number % n_parts]), number, pack(ids.view(np.uint64), null, held, size, first, order, rank[tokens])))
                number += 1
                yield from rows_of(rows).to_batches()

    return docs.mapInArrow(run, ROW)


def grouped(tables: list[DataFrame], n_parts: int, each: Callable[[int, dict[str, list]], list[tuple]]) -> DataFrame:
    """``each`` over the rows of one bucket: its bucket, and by kind the (peer, arrays) in order of peer. Rows "tokens" go
    through as they are."""

    def run(key, table):
        waiting = pc.equal(table.column("kind"), "tokens")
        through, table = table.filter(waiting), table.filter(pc.invert(waiting))
        found: dict[str, list] = {}
        for kind, peer, blob in sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "peer", "blob")), strict=True)):
            found.setdefault(kind, []).append((peer, unpack(blob)))
        made = rows_of(each(key[0].as_py(), found)) if found else through[:0]
        return pa.concat_tables([through.cast(made.schema), made])

    together = tables[0]
    for t in tables[1:]:
        together = together.unionByName(t)
    return together.repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(run, ROW)


def kept(df: DataFrame, name: str) -> str:
    """Rows as a table with a folder for each kind; its path."""
    path = f"{shared_dir(df.sparkSession)}/countloom/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy("kind").parquet(path)
    return path


def rows(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path).where(F.col("kind").isin(*kinds)).select(*NAMES)


def sums(spark: SparkSession, path: str) -> np.ndarray:
    """The sum of all parts' rows "sums": a few numbers a part."""
    found = [unpack(bytes(r.blob)) for r in rows(spark, path, "sums").collect()]
    return np.sum([[float(x) for a in arrays for x in a] for arrays in found], axis=0) if found else np.zeros(8)


def gathered(bucket: np.ndarray, owners: int) -> Callable:
    """Of a part's rows "cells": "full" (its words, their cells and counts), "maps" (where each chunk's cells are), "live" (the
    cells of two or more customers, one table each yet), "join" (to each context's part) and "sums"."""
    n_parts = np.uint64(len(bucket))
    part_of = {int(b): k for k, b in enumerate(bucket)}

    def each(own: int, found: dict[str, list]) -> list[tuple]:
        chunks = found["cells"]
        words = np.unique(np.concatenate([a[0] for _, a in chunks]))
        contexts = np.unique(np.concatenate([a[2] for _, a in chunks]))
        order = np.lexsort((contexts, contexts % n_parts))  # the order that they have in chunks
        place = np.empty(len(contexts), np.int64)
        place[order] = np.arange(len(contexts))
        keys = []
        for _, (w, size, u, at, _) in chunks:
            keys.append(np.repeat(np.searchsorted(words, w), size) * len(contexts) + place[np.searchsorted(contexts, u)][at])
        contexts = contexts[order]
        cells = np.unique(np.concatenate(keys))
        count = np.zeros(len(cells), np.int64)
        out = []
        for (chunk, a), key in zip(chunks, keys, strict=True):
            index = np.searchsorted(cells, key)
            np.add.at(count, index, a[4].astype(np.int64))
            out.append(("maps", own, chunk, pack(np.diff(index, prepend=0))))
        word, context = cells // len(contexts), cells % len(contexts)
        size = np.bincount(word, minlength=len(words))
        live, one = count >= 2, count == 1
        total = np.bincount(word, count, len(words)).astype(np.int64)
        started = np.zeros(len(contexts), bool)
        started[context[live]] = True
        q = np.searchsorted(contexts % n_parts * np.uint64(owners) // n_parts, np.arange(owners + 1, dtype=np.uint64))
        customers = np.bincount(context, count, len(contexts)).astype(np.int64)
        fixed, moving = np.bincount(context[one], minlength=len(contexts)), np.bincount(context[live], minlength=len(contexts))
        for k in range(owners):
            s = slice(q[k], q[k + 1])
            if q[k] < q[k + 1]:
                out.append(("join", int(bucket[k]), part_of[own], pack(contexts[s], started[s], customers[s], fixed[s], moving[s][started[s]])))
        per_part = np.add.reduceat(np.append(started, False).astype(np.int64), np.minimum(q[:-1], len(started))) * (q[:-1] < q[1:])
        number = np.cumsum(started) - 1
        tables = np.ones(int(live.sum()), np.int64)
        fixed_by_word = np.bincount(word[one], minlength=len(words))
        at_root = fixed_by_word + np.bincount(word[live], minlength=len(words))
        out.append(("full", own, 0, pack(size, context, count, total)))
        out.append(("live", own, 0, pack(word[live], number[context[live]], count[live], tables, 0 * tables, per_part, fixed_by_word, np.minimum(at_root, 1), np.zeros(len(words), np.float32))))
        numbers = [count.sum(), (total > 0).sum(), one.sum(), (count == 2).sum(), (at_root == 1).sum(), (at_root == 2).sum(), at_root.sum()]
        out.append(("sums", own, 0, pack(np.array(numbers, np.int64))))
        return out

    return each


# ---------------------------------------------------------------- Gibbs sampling


@dataclass(frozen=True)
class Shape:
    """What doesn't change from sweep to sweep: discounts of contexts and root, strengths, the vocabulary and all tokens."""

    discount: float
    root_discount: float
    strength: float
    root_strength: float
    types: int
    tokens: int

    @classmethod
    def of(cls, n: np.ndarray, strength: float) -> Shape:
        """From the sums: cells, and words' tables, that have one customer against those with two."""
        fair = lambda one, two: float(np.clip(one / max(1.0, one + 2 * two), 0.05, 0.9))
        return cls(fair(n[2], n[3]), fair(n[4], n[5]), strength, strength, int(n[1]), int(n[0]))


@dataclass(frozen=True)
class Root:
    """Of one seating: the unigram restaurant's customers and tables, its words' gamma weights' sum, the weight of its base,
    and its own gamma variable."""

    customers: int
    tables: int
    weights: float
    base: float
    mass: float

    @classmethod
    def of(cls, customers: float, tables: float, weights: float, s: Shape, rng: np.random.Generator) -> Root:
        base = rng.gamma(s.root_strength + s.root_discount * tables)
        return cls(int(customers), int(tables), weights, base, rng.gamma(s.root_strength / s.root_discount + tables))


def word_weights(at_root: np.ndarray, root_tables: np.ndarray, s: Shape, rng: np.random.Generator) -> np.ndarray:
    """A gamma variable for each word, of what its tables in the unigram restaurant hold."""
    return rng.gamma(np.maximum(at_root - s.root_discount * root_tables, 0.0))


def context_masses(tables: np.ndarray, s: Shape, rng: np.random.Generator) -> np.ndarray:
    return rng.gamma(s.strength / s.discount + tables)


def seat(count, tables, masses, weights, s: Shape, root: Root, rng: np.random.Generator) -> np.ndarray:
    """New tables of cells, given their contexts' masses and their words' weights."""
    chance = (weights + root.base / (s.types + 1)) / (root.weights + root.base)
    return draw_tables(count, s.discount * masses * chance, tables, s.discount, rng)


def seat_root(at_root: np.ndarray, root_tables: np.ndarray, s: Shape, root: Root, rng: np.random.Generator) -> np.ndarray:
    return draw_tables(at_root, np.full(len(at_root), s.root_discount * root.mass / (s.types + 1)), root_tables, s.root_discount, rng)


def weighed(bucket: np.ndarray, s: Shape, seed: int) -> Callable:
    """The first weights of a part's words."""

    def each(own: int, found: dict[str, list]) -> list[tuple]:
        ((_, a),) = found["live"]
        word, _, _, tables, _, _, fixed, root_tables = a[:8]
        at_root = fixed.astype(np.int64) + np.bincount(word, tables, len(fixed)).astype(np.int64)
        g = word_weights(at_root, root_tables, s, np.random.default_rng([seed, own, 1]))
        return [("live", own, 0, pack(*a[:8], g)), ("sums", own, 0, pack(np.array([at_root.sum(), root_tables.sum()], np.int64), np.array([g.sum()])))]

    return each


def swept(bucket: np.ndarray, s: Shape, root: Root, seed: int, number: int, keep: bool) -> Callable:
    """A sweep over one part's cells and words: "live" as it is then (with ``keep`` its seating is a sample), "part" (new
    tables for each context's part) and "sums"."""
    part_of = {int(b): k for k, b in enumerate(bucket)}

    def each(own: int, found: dict[str, list]) -> list[tuple]:
        ((_, a),) = found["live"]
        rng = np.random.default_rng([seed, own, 2, number])
        word, context, count, tables, total, per_part, fixed, root_tables, g = a[:9]
        masses = np.concatenate([m for _, (m,) in found.get("mass", [])] or [np.zeros(0)]).astype(float)
        tables = seat(count.astype(np.int64), tables, masses[context], g.astype(float)[word], s, root, rng)
        at_root = fixed.astype(np.int64) + np.bincount(word, tables, len(fixed)).astype(np.int64)
        root_tables = seat_root(at_root, root_tables, s, root, rng)
        g = word_weights(at_root, root_tables, s, rng).astype(np.float32)
        samples = [*a[9:], *([at_root, root_tables] if keep else [])]
        out = [("live", own, 0, pack(word, context, count, tables, total.astype(np.int64) + keep * tables, per_part, fixed, root_tables, g, *samples))]
        moved = np.bincount(context, tables, int(per_part.sum())).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(per_part.astype(np.int64))])
        out += [("part", int(bucket[k]), part_of[own], pack(moved[upto[k] : upto[k + 1]])) for k in np.flatnonzero(per_part)]
        return [*out, ("sums", own, 0, pack(np.array([at_root.sum(), root_tables.sum()], np.int64), np.array([g.astype(float).sum()])))]

    return each


def joined(bucket: np.ndarray, s: Shape, seed: int) -> Callable:
    """A part's contexts from the rows "join": "own" (its contexts' tables of one customer, and which contexts each part's
    moving cells are in), "all" (which contexts each part has, and customers) and the first "mass" rows."""
    part_of = {int(b): k for k, b in enumerate(bucket)}

    def each(own: int, found: dict[str, list]) -> list[tuple]:
        peers = found["join"]
        contexts = np.unique(np.concatenate([a[0] for _, a in peers]))
        customers, fixed, moving = (np.zeros(len(contexts), np.int64) for _ in range(3))
        every, live = [], []
        for _, (keys, started, n, f, m) in peers:
            at = np.searchsorted(contexts, keys)
            customers[at] += n.astype(np.int64)
            fixed[at] += f.astype(np.int64)
            at_live = at[started.astype(bool)]
            moving[at_live] += m.astype(np.int64)
            every.append(at)
            live.append(at_live)
        names, wide = np.array([p for p, _ in peers]), np.array([len(x) for x in every])
        keep = pack(names, np.array([len(x) for x in live]), np.concatenate(live), fixed)
        out = [("own", own, 0, keep), ("all", own, 0, pack(names, wide, np.concatenate(every), customers))]
        g = context_masses(fixed + moving, s, np.random.default_rng([seed, own, 3])).astype(np.float32)
        return out + [("mass", int(bucket[p]), part_of[own], pack(g[x])) for (p, _), x in zip(peers, live, strict=True) if len(x)]

    return each


def totalled(bucket: np.ndarray, s: Shape, seed: int, number: int, keep: bool, last: bool) -> Callable:
    """A sweep over one part's contexts: new masses for the parts with their cells or, at the ``last`` one, "ask" rows with
    each context's customers and its samples' tables."""
    part_of = {int(b): k for k, b in enumerate(bucket)}

    def each(own: int, found: dict[str, list]) -> list[tuple]:
        ((_, a),) = found["own"]
        names, wide, at, fixed = a[:4]
        upto = np.concatenate([[0], np.cumsum(wide.astype(np.int64))])
        lists = {int(p): at[upto[k] : upto[k + 1]] for k, p in enumerate(names)}
        tables = fixed.astype(np.int64)
        for p, (m,) in found.get("part", []):
            tables[lists[p]] += m.astype(np.int64)
        samples = [*a[4:], *([tables] if keep else [])]
        if last:
            ((_, (names, wide, at, customers)),) = found["all"]
            upto = np.concatenate([[0], np.cumsum(wide.astype(np.int64))])
            own_rows = [(int(p), at[upto[k] : upto[k + 1]]) for k, p in enumerate(names)]
            return [("ask", int(bucket[p]), part_of[own], pack(customers[x], *(t[x] for t in samples))) for p, x in own_rows]
        g = context_masses(tables, s, np.random.default_rng([seed, own, 4, number])).astype(np.float32)
        return [("own", own, 0, pack(*a[:4], *samples)), *(("mass", int(bucket[p]), part_of[own], pack(g[x])) for p, x in lists.items() if len(x))]

    return each


# ---------------------------------------------------------------- scoring


def predictive(count, mean_tables, customers, context_tables, at_root, root_tables, roots: list[Root], s: Shape) -> np.ndarray:
    """The chance of a word after a context, averaged over samples (lists of ``context_tables``, ``at_root`` and
    ``root_tables``, one a sample)."""
    chance = np.zeros(len(count))
    for t, n, r, root in zip(context_tables, at_root, root_tables, roots, strict=True):
        parent = (np.maximum(n - s.root_discount * r, 0) + (s.root_strength + s.root_discount * root.tables) / (s.types + 1)) / (s.root_strength + root.customers)
        chance += (s.strength + s.discount * t) / (s.strength + customers) * parent
    return np.maximum(count - s.discount * mean_tables, 0) / (s.strength + customers) + chance / len(roots)


def answered(s: Shape, roots: list[Root]) -> Callable:
    """For each chunk the log10 chances of its cells in a part, and the training counts of its words there."""

    def each(own: int, found: dict[str, list]) -> list[tuple]:
        ((_, (size, context, count, total)),) = found["full"]
        ((_, live),) = found["live"]
        asked = [a for _, a in found["ask"]]
        customers = np.concatenate([a[0] for a in asked]).astype(float)
        tables = [np.concatenate([a[1 + k] for a in asked]).astype(float)[context] for k in range(len(roots))]
        word = np.repeat(np.arange(len(size)), size)
        mean = np.minimum(count, 1).astype(float)
        mean[count >= 2] = live[4] / len(roots)
        at_root, root_tables = ([live[9 + 2 * k + j].astype(float)[word] for k in range(len(roots))] for j in (0, 1))
        chance = np.log10(predictive(count.astype(float), mean, customers[context], tables, at_root, root_tables, roots, s))
        out = []
        for chunk, (steps,) in found["maps"]:
            index = np.cumsum(steps.astype(np.int64))
            w = word[index]
            out.append(("score", own, chunk, pack(chance[index], total[w[np.append(True, w[1:] != w[:-1])]])))
        return out

    return each


def scored(s: Shape, bucket: np.ndarray) -> Callable:
    """Documents' rows of one chunk, from its tokens and all parts' scores."""
    base = s.tokens + 0.5 * (s.types + 1)
    part_of = {int(b): k for k, b in enumerate(bucket)}

    def finish(key, table):
        kinds, source, blobs = (table.column(c).to_pylist() for c in ("kind", "bucket", "blob"))
        if kinds.count("tokens") != 1:
            raise RuntimeError("a chunk is missing or doubled")
        ids, null, held, size, first, order, rank = unpack(blobs[kinds.index("tokens")])
        answers = [unpack(b) for _, b in sorted((part_of[p], b) for k, p, b in zip(kinds, source, blobs, strict=True) if k == "score")]
        chance, total = (np.concatenate([a[k] for a in answers]) for k in (0, 1))
        if len(total) != len(order):
            raise RuntimeError("a chunk misses words")
        tokens = order[rank].astype(np.int64)
        pairs = tokens * len(order)
        pairs[0] += int(first[0])
        pairs[1:] += tokens[:-1]
        distinct = np.unique(pairs)
        if len(distinct) != len(chance):
            raise RuntimeError("a chunk misses cells")
        each = np.empty(len(tokens), np.float32)
        for at in range(0, len(tokens), 1 << 18):
            each[at : at + (1 << 18)] = chance[np.searchsorted(distinct, pairs[at : at + (1 << 18)])]
        del pairs, distinct
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        score = np.add.reduceat(each, begin, dtype=np.float64)
        n = total.astype(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(ids.astype(np.uint64).view(np.int64), pa.int64(), mask=null.astype(bool)),
                "held_out": pa.array(held.astype(bool)),
                "n_tokens": pa.array(size),
                "n_known": pa.array(np.add.reduceat((n > 0)[tokens].astype(np.int64), begin)),
                "train_tokens": pa.array(np.full(len(size), s.tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(np.log10((n + 0.5) / base)[tokens], begin)),
                "score": pa.array(score),
            }
        )

    return finish


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, *, burn_in: int = 1, samples: int = 3, strength: float = 1.0, chunk_bytes: int = 8 << 20, part_bytes: int = 16 << 20, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Tokens are the text's words (A-Z lower-cased, ASCII white space) and one end. Training rows are those that are not
    held out. ``base_score`` is the add-half unigram's, ``score`` the model's log10 probability (of 32-bit cells'). A null
    or empty text is its end alone; null and repeated ids keep their rows. Without training rows every token has the
    root's chance. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // part_bytes))
    # Contexts are dealt into fewer parts than words, so messages between parts grow less than with the square of parts.
    owners = min(n, 2 * ceil(sqrt(n)))
    bucket = buckets(spark, n)
    cells = kept(grouped([chunked(own, bucket, chunk_bytes)], n, gathered(bucket, owners)), "cells")
    reclaim(spark)
    s = Shape.of(sums(spark, cells), strength)
    contexts = kept(grouped([rows(spark, cells, "join")], n, joined(bucket, s, seed)), "contexts")
    seating = kept(grouped([rows(spark, cells, "live")], n, weighed(bucket, s, seed)), "seating")
    dropped(spark, f"{cells}/kind=join")
    seen = sums(spark, seating)
    masses, roots = contexts, []
    for k in range(burn_in + samples):
        reclaim(spark)
        keep, last, rng = k >= burn_in, k + 1 == burn_in + samples, np.random.default_rng([seed, 0, 5, k])
        root = Root.of(*seen[:3], s, rng)
        new = kept(grouped([rows(spark, seating, "live"), rows(spark, masses, "mass")], n, swept(bucket, s, root, seed, k, keep)), "seating")
        dropped(spark, seating)
        seating = new
        seen = sums(spark, seating)
        if keep:
            roots.append(Root(int(seen[0]), int(seen[1]), 0.0, 0.0, 0.0))
        held = [rows(spark, masses, "own"), rows(spark, seating, "part"), *([rows(spark, contexts, "all")] if last else [])]
        new = kept(grouped(held, n, totalled(bucket, s, seed, k, keep, last)), "masses")
        if masses != contexts:
            dropped(spark, masses)
        masses = new
    dropped(spark, contexts)
    reclaim(spark)
    found = [rows(spark, cells, "full", "maps"), rows(spark, seating, "live"), rows(spark, masses, "ask")]
    answers = kept(grouped(found, n, answered(s, roots)), "answers")
    for path in (seating, masses, f"{cells}/kind=full", f"{cells}/kind=maps", f"{cells}/kind=live"):
        dropped(spark, path)
    reclaim(spark)
    by_chunk = rows(spark, cells, "tokens").unionByName(rows(spark, answers, "score"))
    return by_chunk.repartition(n, "peer").groupBy("peer").applyInArrow(scored(s, bucket), SCORES)


def perplexity(scored: DataFrame, *by: str) -> DataFrame:
    """Perplexity by token, of the model and of the base, over groups of scored documents."""
    n = F.sum("n_tokens")
    return scored.groupBy(*by).agg(n.alias("n_tokens"), F.pow(F.lit(10.0), -F.sum("score") / n).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / n).alias("base_perplexity"))
