"""The prefix trie of conversations, by distributed MSD radix partitioning of dictionary-encoded turns.

1. Turns are numbered in each conversation over ranges of the sort order. Every distinct turn (role, text) gets an id of
   eight bytes from a dictionary; frequent turns meet it by broadcast, the others by shuffle.
2. Conversations are rebuilt (a prefix of the conversation that begins their hundred, then their own rest).
3. A round takes the buckets of one depth that are too large for a task and deals their conversations by the id of the next
   turn: its groups are nodes and the next round's buckets. Only counts meet by group, pre-aggregated, so a common turn is
   not a hot key. A bucket of at most ``local`` conversations and ``turns`` turns is settled: it goes to one task, where
   multikey quicksort finishes it and emits its nodes as it recurses. A bucket of a single conversation is a chain and is
   emitted row by row, however long. There are as many rounds as the depth of the deepest bucket that isn't settled.
4. Sums over subtrees of the dealt nodes are added from the deepest round up. The ids that end at such a node are joined in
   chunks and hashed as a sorted stream, since SHA-256 needs them in one order.

A node is named by its depth and smallest member: at one depth every conversation is in one node.

Nulls: a null role or text is empty, null turns come first, ties of a turn go by role and text, repeated rows are turns of
their own. Rows without a conversation id belong to none. An empty table has no nodes, not even a root. The remainder of a
negative id is negative (-7 belongs to 0). Columns beside the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.functions import running
from countloom.llm.common import batches_of, joined_by_key, parts, written

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]
EMPTY = hashlib.sha256(b"").hexdigest()
#: Ids of so many neighbouring values are joined into one string before hashing.
CHUNK_BITS = 12


def digest_of(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def encoded_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, pos (from 0), id, chars of every turn; and conv_id, n of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role, text)
    short = [F.col("turn"), F.left("role", F.lit(16)), F.left("text", F.lit(32))]  # prefixes rise with what they begin
    slim = [F.col("conv_id"), digest_of(F.col("role"), F.col("text")).alias("digest"), F.length("text").cast("long").alias("chars")]
    ordered = running.in_order(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], slim, short)
    own = written(running.numbered(ordered, ["conv_id"], "number").select("conv_id", (F.col("number") - 1).cast("long").alias("pos"), "digest", "chars"), "turns")
    words = own.groupBy("digest").agg(F.count("*").alias("times"))
    dictionary = written(words.select("digest", "times", F.monotonically_increasing_id().alias("id")), "dictionary")
    coded = joined_by_key(own, dictionary, ["digest"], "times", own.count()).select("conv_id", "pos", "id", "chars")
    return written(coded, "coded"), written(own.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")


def rebuilt(coded: DataFrame, convs: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """The same two tables of rebuilt conversations: the first h turns of the one that begins their ``group`` (h below
    ``most``, from the id's checksum), then their own turns after the first h. Turnless ones are in the second only."""
    own = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    own = written(own.join(bases, "base", "left").withColumn("shared", F.least("h", F.coalesce("of_base", F.lit(0)))), "plans")
    first = coded.where((F.col("conv_id") % group == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    heads = own.select("conv_id", "base", "h").join(first, "base").where("pos < h").select("conv_id", "pos", "id", "chars")
    total = coded.count()
    tails = joined_by_key(coded, own.select("conv_id", "n", "h", "shared"), ["conv_id"], "n", total).where("pos >= h")
    tails = tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "id", "chars")
    rows = written(heads.unionByName(tails).sortWithinPartitions("pos"), "rebuilt")  # a round reads one position
    return rows, own.select("conv_id", (F.col("shared") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("n"))


def sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def sorted_nodes(convs: np.ndarray, start: np.ndarray, length: np.ndarray, ids: np.ndarray, chars: np.ndarray, depth: int, parent: int | None, top_chars: int) -> list[list]:
    """The nodes of one bucket, its top first, as columns. Conversations ascend; number m has the turns ``ids[start[m]:]``,
    ``length[m]`` of them. Multikey quicksort: members are split by the id at one place into lower, equal and higher ones;
    the equal ones are a node and go on at the next place."""
    at, first, above, n, last, ends = [depth], [int(convs[0])], [-1], [len(convs)], [top_chars], [EMPTY]
    stack = [(np.arange(len(convs)), 0, 0, True)]
    while stack:
        own, place, node, fresh = stack.pop()
        if fresh:
            over = length[own] == place
            if over.any():
                ends[node], own = sha(convs[own[over]]), own[~over]
        if not len(own):
            continue
        key = ids[start[own] + place]
        pivot = key[len(key) // 2]
        lower, higher = key < pivot, key > pivot
        for side in (lower, higher):
            if side.any():
                stack.append((own[side], place, node, False))
        equal = own[~(lower | higher)]
        at.append(depth + place + 1)
        first.append(int(convs[equal[0]]))
        above.append(node)
        n.append(len(equal))
        last.append(int(chars[start[equal[0]] + place]))
        ends.append(EMPTY)
        stack.append((equal, place + 1, len(at) - 1, True))
    children, leaves, saved = [0] * len(at), [0] * len(at), [(a - 1) * b for a, b in zip(n, last, strict=True)]
    for k in range(len(at) - 1, -1, -1):  # a node comes after its parent
        leaves[k] += not children[k]
        if k:
            children[above[k]] += 1
            leaves[above[k]] += leaves[k]
            saved[above[k]] += saved[k]
    return [first, at, [parent] + [first[a] for a in above[1:]], n, children, leaves, saved, ends]


def groups_of(batches, keys: list[str]):
    """Frames of the rows of one key each, from batches sorted by key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        pdf = batch.to_pandas()
        if not len(pdf):
            continue
        if held:
            pdf = pd.concat([*held, pdf], ignore_index=True)
        values = pdf[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pdf.iloc[a:b]
        held = [pdf.iloc[cuts[-1] :]]
    if held:
        yield held[0]


def finished(members: DataFrame, rows: DataFrame) -> DataFrame:
    """All nodes of settled buckets and whether they are a bucket's top. ``members``: conv_id, node, depth, parent, top_chars."""

    def run(batches):
        for pdf in groups_of(batches, ["depth", "node"]):
            convs, start = np.unique(pdf["conv_id"].to_numpy(), return_index=True)
            length = np.add.reduceat((pdf["pos"].to_numpy() >= 0).astype(np.int64), start)
            depth, parent, top_chars = (int(pdf[c].iloc[0]) for c in ("depth", "parent", "top_chars"))
            made = sorted_nodes(convs, start, length, pdf["id"].to_numpy(), pdf["chars"].to_numpy(), depth, parent if depth else None, top_chars)
            types = [pa.string() if c == "ends_sha256" else pa.int64() for c in COLUMNS] + [pa.bool_()]
            made.append([True] + [False] * (len(made[0]) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(made, types, strict=True)], [*COLUMNS, "top"])

    turns = members.join(rows.withColumnRenamed("conv_id", "of"), (F.col("conv_id") == F.col("of")) & (F.col("pos") >= F.col("depth")), "left").drop("of")
    # No nulls: they would make doubles of the numbers in a frame.
    whole = turns.fillna(-1, ["pos", "id", "chars", "parent"])
    dealt = whole.repartition(parts(rows.sparkSession), "depth", "node").sortWithinPartitions("depth", "node", "conv_id", "pos")
    return dealt.mapInArrow(run, NODE + ", top boolean")


def chains(members: DataFrame, rows: DataFrame) -> DataFrame:
    """All nodes of buckets of one conversation; a bucket of depth 0 has its root too. ``members`` as above, and len."""
    one = members.select(F.col("conv_id").alias("of"), "depth", "parent", "len")
    below = rows.join(one, (F.col("conv_id") == F.col("of")) & (F.col("pos") >= F.col("depth") - 1)).select("conv_id", (F.col("pos") + 1).alias("at"), "depth", "parent", "len")
    roots = members.where("depth = 0").select("conv_id", F.lit(0).cast("long").alias("at"), "depth", "parent", "len")
    top = F.col("at") == F.col("depth")
    return below.unionByName(roots).select(
        "conv_id",
        F.col("at").alias("depth"),
        F.when(top, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("at") < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("at") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
        top.alias("top"),
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """node, depth, ends_sha256 of the nodes at which any of ``ends`` (conv_id, node, depth) ends."""
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")  # at most 2^CHUNK_BITS ids
    chunks = ends.groupBy("depth", "node", chunk).agg(joined.alias("ids"))

    def run(batches):
        key, held, out = None, None, []
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) != key:
                    if key:
                        out.append((*key, held.hexdigest()))
                    key, held = (depth, node), hashlib.sha256()
                else:
                    held.update(b",")
                held.update(ids.encode())
        if key:
            out.append((*key, held.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], ["depth", "node", "ends_sha256"])

    return chunks.repartition(parts(ends.sparkSession), "depth", "node").sortWithinPartitions("depth", "node", "chunk").mapInArrow(run, "depth long, node long, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, local: int = 512, turns: int = 65_536) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, pos, id, chars), whose conversations are ``convs`` (conv_id, n)."""
    spark = rows.sparkSession
    all_of = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("node"), F.sum("n").alias("rest")).first()
    if not all_of.n:
        return spark.createDataFrame([], NODE)
    null = F.lit(None).cast("long")
    active = written(convs.select("conv_id", F.col("n").alias("len"), F.lit(all_of.node).alias("node"), F.lit(0).cast("long").alias("depth"), null.alias("parent"), F.lit(0).cast("long").alias("top_chars"), F.lit(all_of.n).alias("size"), F.lit(all_of.rest).alias("rest")), "buckets")
    settled, dealt, depth = [], [], 0
    large = (F.col("size") > 1) & ((F.col("size") > local) | (F.col("rest") > turns))
    while True:
        settled.append(active.where(~large))
        busy = active.where(large)
        count = busy.count()
        if not count:
            break
        here = busy.join(rows.where(F.col("pos") == depth).select("conv_id", "id", "chars"), "conv_id").select("conv_id", "len", "id", "chars", F.col("node").alias("parent"))
        here = written(here, "dealt")
        groups = here.groupBy("parent", "id").agg(F.count("*").alias("size"), F.min("conv_id").alias("node"), F.first("chars").alias("top_chars"), F.sum(F.col("len") - depth - 1).alias("rest"))
        groups = written(groups, "groups")
        dealt.append((busy, groups))
        depth += 1
        active = joined_by_key(here.select("conv_id", "len", "parent", "id"), groups, ["parent", "id"], "size", count)
        active = written(active.select("conv_id", "len", "node", F.lit(depth).cast("long").alias("depth"), "parent", "top_chars", "size", "rest"), "buckets")
    members = reduce(DataFrame.unionByName, settled)
    with batches_of(spark, 10_000):
        done = [written(finished(members.where("size > 1"), rows), "nodes"), written(chains(members.where("size = 1"), rows), "nodes")]
    tops = reduce(DataFrame.unionByName, [d.where("top").select("depth", "parent_conv_id", "n_leaves", "saved_tokens") for d in done])
    with batches_of(spark, 64):
        over = [busy.where(F.col("len") == F.col("depth")).select("conv_id", "node", "depth") for busy, _ in dealt]
        hashed = written(end_hashes(reduce(DataFrame.unionByName, over)), "ends") if over else None
    for level in range(len(dealt) - 1, -1, -1):
        # The dealt nodes of a depth: the root, or the groups of the round before that weren't settled.
        if level:
            nodes = dealt[level - 1][1].where(large).select("node", "parent", "size", "top_chars")
        else:
            nodes = spark.createDataFrame([(all_of.node, None, all_of.n, 0)], "node long, parent long, size long, top_chars long")
        below = tops.where(F.col("depth") == level + 1).groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        ends = hashed.where(F.col("depth") == level).select("node", "ends_sha256")
        own = nodes.join(below, "node", "left").join(ends, "node", "left").select(
            F.col("node").alias("conv_id"),
            F.lit(level).cast("long").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            F.col("size").alias("n_convs"),
            F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("size") - 1) * F.col("top_chars")).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
            F.lit(True).alias("top"),
        )
        own = written(own, "nodes")
        done.append(own)
        tops = tops.unionByName(own.select("depth", "parent_conv_id", "n_leaves", "saved_tokens"))
    return reduce(DataFrame.unionByName, done).select(*COLUMNS)


def conversation_trie(conversations: DataFrame, *, local: int = 512, turns: int = 65_536) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for
    each node of the trie of rebuilt conversations. ``conversations``: conv_id, turn, role, text."""
    return trie(*rebuilt(*encoded_turns(conversations)), local=local, turns=turns)


def oracle_sql() -> str:
    return r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS own FROM t GROUP BY 1),
plans AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_transform(split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda v, c: list_reduce(range(0, 8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(v, c)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM lists),
seqs AS (SELECT p.conv_id, coalesce(b.own[1:p.h::INT], []) || p.own[p.h::INT + 1:] AS turns FROM plans p LEFT JOIN lists b ON b.conv_id = p.base),
steps AS (SELECT conv_id, len(turns) AS len, turns, unnest(range(0, len(turns) + 1)) AS depth FROM seqs),
keyed AS (SELECT conv_id, len, depth::BIGINT AS depth, sha256(turns[1:depth]::VARCHAR || list_transform(turns[1:depth], lambda x: length(x.text) || '/' || length(x.role))::VARCHAR) AS key,
    CASE WHEN depth > 0 THEN sha256(turns[1:depth - 1]::VARCHAR || list_transform(turns[1:depth - 1], lambda x: length(x.text) || '/' || length(x.role))::VARCHAR) END AS above,
    CASE WHEN depth > 0 THEN length(turns[depth].text) ELSE 0 END AS chars FROM steps),
nodes AS (SELECT key, any_value(above) AS above, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256 FROM keyed GROUP BY key, depth),
kids AS (SELECT above AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
flat AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key, depth)),
-- A node of the subtree is met through its smallest member, which passes through all nodes above it.
below AS (SELECT k.key, k.depth, sum(d.saved) AS saved_tokens, count(*) FILTER (d.n_children = 0) AS n_leaves
  FROM keyed k JOIN flat d ON d.conv_id = k.conv_id AND d.depth >= k.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM flat f JOIN below b ON f.key = b.key AND f.depth = b.depth LEFT JOIN nodes p ON p.key = f.above AND p.depth = f.depth - 1"""
