"""Nearest neighbours by cosine with a vantage-point tree for each shard of the vectors.

Unit vectors' Euclidean distance falls as cosine rises, and obeys the triangle inequality. Each shard's tree parts its
points at the median distance to a vantage point and keeps, for either half, the least and largest distance. A half
whose gap to a query, times ``factor``, exceeds the query's k-th distance so far is skipped: factor 1 is exact, a
larger factor skips more. Every shard sees every query, in blocks; the k best of all shards are the answer.

Vectors that are null or zero, or hold null or non-finite components, take no part, as query or as candidate. Vectors
of different lengths are never compared. A query never finds rows with its own id. Ties go to the smaller id. Rows that
repeat both id and vector count once, so they take no places among the k best; an id with several vectors is a
candidate with each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from countloom.llm.common import written

LEAF = 96
#: Room for rounding: distances this close count as equal, so exact search loses no tie.
SLACK = 1e-7


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def numbers(df: DataFrame, vector_col: str) -> Column:
    """The vectors as they are if they are floats (tasks widen them, shuffles move half the bytes), else as doubles."""
    kind = df.schema[vector_col].dataType
    return F.col(vector_col) if kind == ArrayType(FloatType()) else F.col(vector_col).cast("array<double>")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scaled(points: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near 1: squares can't overflow or vanish, and no
    digit changes, so cosines are those of the vectors as given."""
    if not points.size:
        return points
    return np.ldexp(points, -np.frexp(np.abs(points).max(axis=1))[1][:, None])


class Tree:
    """``order`` lists points so that each leaf is one run of it; ``nodes`` rows are
    (vantage point or -1 for a leaf, begin, end, inner child, outer child, inner low, inner high, outer low, outer high)."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray | None = None, order: np.ndarray | None = None):
        self.points = points = scaled(points)
        self.norms = np.sqrt((points * points).sum(axis=1))
        self.unit = points / self.norms[:, None]
        if nodes is None:
            self.build()
        else:
            self.nodes, self.order = nodes, order

    def build(self) -> None:
        rng = np.random.default_rng(7)
        nodes: list[list[float]] = []
        order = np.arange(len(self.unit))

        todo = [(0, len(order), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            me = len(nodes)
            nodes.append([-1, a, b, -1, -1, 0, 0, 0, 0])
            if parent >= 0:
                nodes[parent][3 + side] = me
            if b - a <= LEAF:
                continue
            own = order[a:b]
            picks = own[rng.integers(0, b - a, 5)]
            spread = [self.distances(p, own).var() for p in picks]
            vantage = int(picks[int(np.argmax(spread))])
            d = self.distances(vantage, own)
            by = np.argsort(d, kind="stable")
            d, own = d[by], own[by]
            middle = d[len(d) // 2]
            cut = int(np.searchsorted(d, middle, "left"))
            if cut == 0:
                cut = int(np.searchsorted(d, middle, "right"))
            if cut in (0, len(d)):  # all at one distance: nothing to part
                continue
            order[a:b] = own
            nodes[me] = [vantage, a, b, -1, -1, d[0], d[cut - 1], d[cut], d[-1]]
            todo += [(a, a + cut, me, 0), (a + cut, b, me, 1)]
        self.nodes, self.order = np.array(nodes, np.float64).reshape(-1, 9), order

    def distances(self, point: int, others: np.ndarray) -> np.ndarray:
        x = self.unit[others] - self.unit[point]
        return np.sqrt((x * x).sum(axis=1))

    def search(self, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        """For each query its k best ids and cosines here (fewer, if there are fewer)."""
        queries = scaled(queries)
        norms = np.sqrt((queries * queries).sum(axis=1))
        unit = queries / norms[:, None]
        n = len(queries)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(n)]
        least = np.full(n, -np.inf)  # the k-th cosine so far
        far = np.full(n, np.inf)  # as a distance
        limit = 1 / factor

        def leaf(a: int, b: int, q: np.ndarray) -> None:
            at = self.order[a:b]
            near = unit[q] @ self.unit[at].T >= (least[q] - SLACK)[:, None]
            near &= ids[at][None, :] != own[q][:, None]
            for row in np.flatnonzero(near.any(axis=1)).tolist():
                i, pick = int(q[row]), at[near[row]]
                score = (self.points[pick] * queries[i]).sum(axis=1) / (self.norms[pick] * norms[i])
                name, value = np.concatenate([found[i][0], ids[pick]]), np.concatenate([found[i][1], score])
                best = np.lexsort((name, -value))[:k]
                found[i] = (name[best], value[best])
                if len(best) == k:
                    least[i] = value[best[-1]]
                    far[i] = np.sqrt(max(0.0, 2 - 2 * least[i]))

        # Depth first; (node, queries, side): a side of -1 parts the queries, else the half is entered if still in reach.
        todo: list[tuple] = [(0, np.arange(n), None, None)]
        while todo:
            node, q, low, high = todo.pop()
            if low is not None:
                q = q[(np.maximum(low, high) <= far[q] * limit + SLACK)]
            if not len(q):
                continue
            vantage, a, b, inner, outer, in_lo, in_hi, out_lo, out_hi = self.nodes[node].tolist()
            if vantage < 0:
                leaf(int(a), int(b), q)
                continue
            x = unit[q] - self.unit[int(vantage)]
            d = np.sqrt((x * x).sum(axis=1))
            inside = d <= (in_hi + out_lo) / 2
            # Pushed first, taken last: the farther halves wait until the nearer ones have lowered the k-th distance.
            todo += [
                (int(outer), q[inside], out_lo - d[inside], d[inside] - out_hi),
                (int(inner), q[~inside], in_lo - d[~inside], d[~inside] - in_hi),
                (int(outer), q[~inside], None, None),
                (int(inner), q[inside], None, None),
            ]
        return found


def build_index(vectors: DataFrame, *, shard_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a shard: dim, shard, ids, points, nodes, order (binary). Every usable row is in one shard."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), numbers(vectors, vector_col).alias("v")).where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    sizes = {r.dim: r.n for r in own.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    shards = max([1, *(-(-n // shard_rows) for n in sizes.values())])

    def grow(key, table):
        ids, points = table.column("vec_id").to_numpy(), matrix(table.column("v"))
        by = np.argsort(ids, kind="stable")
        ids, points = ids[by], points[by]
        tree = Tree(points)
        blobs = [[x.tobytes()] for x in (ids.astype("<i8"), points, tree.nodes, tree.order.astype("<i8"))]
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32())} | {c: pa.array(x, pa.binary()) for c, x in zip(("ids", "points", "nodes", "order"), blobs, strict=True)})

    # Repeats go before rows are dealt, map side first: however often one row stands in the table, no shard holds it twice.
    dealt = own.distinct().withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard int, ids binary, points binary, nodes binary, order binary")


def search(index: DataFrame, queries: DataFrame, *, k: int = 5, factor: float = 1.0, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of the index to each query: query_id, rank (from 1), vec_id, score (cosine in double precision)."""
    if factor < 1 or k < 1:
        raise ValueError("factor and k are 1 at least")
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), numbers(queries, vector_col).alias("v")).where(usable(F.col("v")) & F.col("query_id").isNotNull())
    q = q.withColumn("dim", F.size("v"))
    blocks = max(1, -(-q.count() // block))
    places = index.select(F.col("dim").alias("of_dim"), F.col("shard").alias("of_shard"))
    every = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    every = every.join(places, F.col("dim") == F.col("of_dim")).select("query_id", "v", "dim", F.col("of_shard").alias("shard"), "block")
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(key, left, right):
        names = ("query_id", "vec_id", "score")
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        ids, points, nodes, order = (np.frombuffer(left.column(c)[0].as_py(), t) for c, t in (("ids", "<i8"), ("points", "<f8"), ("nodes", "<f8"), ("order", "<i8")))
        tree = Tree(points.reshape(len(ids), -1), nodes.reshape(-1, 9), order)
        own = right.column("query_id").to_numpy()
        found = tree.search(ids, matrix(right.column("v")), own, k, factor)
        size = [len(x) for x, _ in found]
        cols = [np.repeat(own, size), np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found])]
        return pa.table(dict(zip(names, cols, strict=True)))

    keys = ("dim", "shard", "block")
    near = trees.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(look, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, *, every: int = 50, k: int = 5, factor: float = 1.0, shard_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Searches all vectors for those whose id is divisible by ``every``. An empty table gives no rows."""
    index = written(build_index(vectors, shard_rows=shard_rows, id_col=id_col, vector_col=vector_col), "vptree")
    return search(index, vectors.where(F.col(id_col) % every == 0), k=k, factor=factor, id_col=id_col, vector_col=vector_col)
