"""Filter interaction audit: what each of several filters removes, in every order of them.

1. Texts are range-sorted by fingerprint and id, within a range by fingerprint, full text and id. Each range compares every
   row with its predecessor, text with text, and notes the run's first id.
2. A run may begin in earlier ranges. Only a range's first fingerprint can do so, so what ranges carry to each other is a
   table of their first and last fingerprints' texts, with a few rows a range: a row repeats an earlier document if its id
   exceeds the smallest of its run, here or carried. Ties on all keys are dealt over ranges by row, so no text is too common.
3. Each document's failures are a mask of bits. Masks, merged with the labels, are counted by part: 2^filters counters that
   add up, so a common part is summed before the shuffle. All orders, steps and Shapley sums follow from a part's counters.

Nulls: a null text is empty, a null part the empty string. A null id repeats nothing, is repeated by nothing and has no
label. Rows that repeat an id count once each; rows of one id and text don't repeat each other, since neither id is smaller.
Several labels of an id count if any is 1. An empty table has no rows. Columns beside the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.llm.common import batches_of, sized, written

SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def standard() -> dict[str, Column]:
    """The failure conditions of one text (columns ``text`` and ``words``), by letter; null never occurs."""
    words, text = F.col("words"), F.col("text")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def runs(rows: DataFrame) -> DataFrame:
    """Rows in sort order (columns doc_id, part, mask, fp, text) as place, fp, digest, first (the run's first id in this
    range), doc_id, part, mask. What a task holds is a batch and the last row."""
    names = ["place", "fp", "digest", "first", "doc_id", "part", "mask"]

    def run(batches):
        place, last, known = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fp, ids, text = batch.column("fp"), batch.column("doc_id").to_numpy(), batch.column("text")
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = ~pc.and_(pc.equal(fp[1:], fp[:-1]), pc.equal(text[1:], text[:-1])).to_numpy(zero_copy_only=False)
            new[0] = known is None or (fp[0].as_py(), text[0].as_py()) != last
            digests, firsts = ([], []) if new[0] else ([known[0]], [known[1]])
            for k in np.flatnonzero(new).tolist():
                digests.append(hashlib.sha256(text[k].as_buffer()).digest())
                firsts.append(int(ids[k]))
            at = np.cumsum(new) - new[0]
            last, known = (fp[n - 1].as_py(), text[n - 1].as_py()), (digests[-1], firsts[-1])
            first = pa.array(np.array(firsts, np.int64)[at])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, place, np.int32)), fp, pa.array(digests, pa.binary()).take(pa.array(at)), first, batch.column("doc_id"), batch.column("part"), batch.column("mask")], names)

    return rows.mapInArrow(run, "place int, fp long, digest binary, first long, doc_id long, part string, mask int")


def failure_masks(docs: DataFrame, conditions: dict[str, Column], *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask for every row: a bit for each condition in order, then one for repeating a smaller id's text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))

    def masked(own: DataFrame, *columns: str) -> DataFrame:
        own = own.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
        mask = reduce(lambda a, b: a + b, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())])
        return own.select("doc_id", "part", mask.cast("int").alias("mask"), *columns)

    named = rows.where("doc_id IS NOT NULL").select("*", F.xxhash64("text").alias("fp"), F.monotonically_increasing_id().alias("row"))
    placed = named.repartitionByRange("fp", "doc_id", "row").sortWithinPartitions("fp", "text", "doc_id")
    with batches_of(spark, 1000):
        own = written(runs(masked(placed, "fp", "text")), "runs")
    ends = own.groupBy("place").agg(F.min("fp").alias("low"), F.max("fp").alias("high"))  # a row a range
    edge = own.join(F.broadcast(ends), "place").where("fp = low OR fp = high").groupBy("fp", "digest", "place").agg(F.min("first").alias("own"))
    earlier = Window.partitionBy("fp", "digest").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select("place", "fp", "digest", F.min("own").over(earlier).alias("carried")).where("carried IS NOT NULL")
    joined = own.join(sized(carried), ["place", "fp", "digest"], "left")
    repeats = F.col("doc_id") > F.least("first", "carried")  # the least skips nulls
    found = joined.select("doc_id", "part", (F.col("mask") + F.when(repeats, 1 << len(conditions)).otherwise(0)).alias("mask"))
    return found.unionByName(masked(rows.where("doc_id IS NULL")))


def counters(masks: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents, and those labelled of quality and toxic."""
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    flags = named.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    # Repeated ids meet the labels as one row each.
    own = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(flags, "doc_id", "left")
    return own.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")))


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and the counts of the step's filter, for every order of ``letters``."""
    k = len(letters)
    fields = ("n", "good", "toxic")
    held = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*fields)))).alias("by"))  # at most 2^k rows a part

    def filled(field: str):
        return lambda m: F.coalesce(F.element_at("by", m)[field], F.lit(0).cast("long"))

    every = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    held = held.select("part", *(F.transform(every, filled(f)).alias(f"{f}s") for f in fields))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    rows = held.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    before = reduce(lambda a, b: a + b, [F.when(F.instr(F.expr("left(filter_order, step - 1)"), c) > 0, 1 << j).otherwise(0) for j, c in enumerate(letters)])
    rows = rows.withColumn("bit", F.expr(f"shiftleft(1, instr('{letters}', substring(filter_order, step, 1)) - 1)")).withColumn("before", before)

    def total(field: str, condition: str, times: str = "1") -> Column:
        value = f"element_at({field}s, m + 1) * ({times})"
        return F.expr(f"aggregate(sequence(0, {(1 << k) - 1}), 0L, (a, m) -> a + if({condition}, {value}, 0L))")

    reached, fails = "(m & before) = 0", "(m & bit) <> 0"
    factorial = int(np.prod(np.arange(1, k + 1)))
    return rows.select(
        "part", "filter_order", "step",
        total("n", f"{reached} AND NOT {fails}").alias("kept"),
        total("n", f"{reached} AND {fails}").alias("removed"),
        total("n", f"NOT {reached} AND {fails}").alias("redundant"),
        F.expr("element_at(ns, bit + 1)").alias("unique_fails"),
        total("good", f"{reached} AND {fails}").alias("good_lost"),
        total("toxic", f"{reached} AND {fails}").alias("toxic_lost"),
        # Of the filters that a document fails, each comes first in an equal share of the orders.
        total("n", fails, f"{factorial} div greatest(1, bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, *, duplicates: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part,
    order of the filters and step. ``conditions`` (default ``standard``): failures by letter, over ``text`` and ``words``;
    ``duplicates``: the letter of repeating a smaller id's text."""
    conditions = conditions or standard()
    masks = failure_masks(docs, conditions, id_col=id_col, text_col=text_col, part_col=part_col)
    return interactions(counters(masks, labels, id_col=id_col), "".join(conditions) + duplicates)


def oracle_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
masks AS (SELECT doc_id, part,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS m FROM w),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counters AS (SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM masks LEFT JOIN flags USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM letters a, letters b, letters x, letters y, letters z WHERE a.bit + b.bit + x.bit + y.bit + z.bit = 31 AND a.bit | b.bit | x.bit | y.bit | z.bit = 31),
steps AS (SELECT filter_order, step::INT AS step, (SELECT bit FROM letters WHERE c = filter_order[step]) AS bit, (SELECT coalesce(sum(bit), 0)::INT FROM letters WHERE contains(filter_order[1:step - 1], c) AND step > 1) AS before FROM orders, range(1, 6) AS s(step))
SELECT part, filter_order, step,
    coalesce(sum(n) FILTER (m & before = 0 AND m & bit = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (m & before = 0 AND m & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (m & before <> 0 AND m & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (m = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (m & before = 0 AND m & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (m & before = 0 AND m & bit <> 0), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * (120 // greatest(bit_count(m), 1))) FILTER (m & bit <> 0), 0)::BIGINT AS shapley
FROM counters, steps GROUP BY part, filter_order, step"""
