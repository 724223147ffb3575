"""Passages that repeat, or nearly repeat, across documents, by compact windows.

A passage is a run of words; its set is that of its ``width``-word shingles (A-Z lower-cased, ASCII white space).

1. For each of ``hashes`` hash functions, the Cartesian tree over a document's hashed shingles has a node for each
   place c; every subsequence from [l, c] to [c, r] has c's shingle as its min-hash. Only nodes that span ``least``
   words are kept: they are exactly the places that are the minimum of some window of that length, about 2n / least a
   function, and among them the tree's spans are found with a stack.
2. Compact windows that share function and min-hash stand together after one shuffle. Each is linked to the one of the
   smallest document, to that of those which also share the shingle some places before c, and of those which share the
   one as far after c: linear in the bucket, whatever its size, and never all pairs. One of these two places lies
   within the passage wherever c does, so a group that shares a passage meets in its smallest document under every
   function, whatever stands around it. A window alone in both ways is also linked to the one before it. A frequent
   min-hash is dealt by document to several buckets, whose firsts then meet; its windows stand together again by either
   shingle as well.
3. Two documents' linked windows are joined as intervals: those of about one offset that overlap form a candidate if
   ``enough`` functions agree.
4. A candidate's shingles are compared: the stretches that share shingles are cut out, and stay if both have ``least``
   words and a Jaccard similarity of ``similar`` or more.
5. A window that shares c's shingle and one of the two beside it with a first, but not all words of the runs that have c as
   their min-hash, may share such a run with another one. A run of ``least`` words has one place c of a function, and two
   documents that share it are linked to one first there, so one function's windows are enough: their runs are matched
   word by word, each with the first document's equal one.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import batches_of, fresh, id_and_text, parts, reclaim, sized, written
from countloom.llm.wordbpe import slices, split_words

CONTEXT = 12  # shingles from c to those, before and after it, that windows may agree on beside c
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def multipliers(n: int) -> list[np.uint64]:
    """Fixed odd numbers, from a hash of 0, 1, .."""
    return [np.uint64(xxhash.xxh64_intdigest(str(k).encode(), 7) | 1) for k in range(n)]


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles, and where each text's begin (one place more than texts). A text of fewer words has none."""
    words, offsets = split_words(texts, lower=True)
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    each = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    n = len(each) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * MIX[1] + each[k : k + n]
    total ^= total >> np.uint64(29)
    total *= MIX[0]
    total ^= total >> np.uint64(32)
    size = np.maximum(np.diff(offsets) - width + 1, 0)
    inside = np.ones(n, bool)  # shingles that run over a text's end go
    for k in range(1, width):
        last = offsets[1:] - k
        last = last[(last >= 0) & (last < n)]
        inside[last] = False
    return total[inside], np.concatenate([[0], np.cumsum(size)])


def compact_windows(shingles: np.ndarray, begins: np.ndarray, least: int, function: int, odd: np.uint64):
    """text, l, c, r (places in the text) of all compact windows of one hash function that span ``least`` shingles."""
    n = len(shingles)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none, none, none
    mixed = (shingles ^ (shingles >> np.uint64(31))) * odd
    key = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    low, span = key, 1
    while span * 2 <= least:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    m = n - least + 1
    low = np.minimum(low[:m], low[least - span : least - span + m])
    size = np.diff(begins)
    valid = np.zeros(m + 1, np.int64)
    long = size >= least
    np.add.at(valid, begins[:-1][long], 1)
    np.add.at(valid, begins[1:][long] - least + 1, -1)
    at = (low & np.uint64(0xFFFFFFFF))[np.cumsum(valid[:-1]) > 0].astype(np.int64)
    at = at[np.append(True, np.diff(at) != 0)] if len(at) else at
    text = np.searchsorted(begins, at, "right") - 1
    # Cartesian tree of the nodes: the nearest smaller node on either side bounds a node's span.
    nodes, own = key[at], np.arange(len(at))
    low, high = np.searchsorted(text, text, "left"), np.searchsorted(text, text, "right")
    before, after = own - 1, own + 1
    for near, ends in ((before, low - 1), (after, high)):
        rest = own
        while len(rest):  # past nodes that are greater, by what these have passed
            rest = rest[near[rest] != ends[rest]]
            rest = rest[nodes[near[rest]] > nodes[rest]]
            near[rest] = near[near[rest]]
    base = begins[text]
    left = np.where(before >= low, at[before] + 1 - base, 0) if len(at) else none
    right = np.where(after < high, at[np.minimum(after, len(at) - 1)] - 1, begins[text + 1] - 1) - base if len(at) else none
    return text, left, at - base, right


def packed(context: np.ndarray, left: np.ndarray, c: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """near, far: the context and three places below 2**31, the low bits of all in ``near``, so that ``far`` is mostly zero."""
    back, ahead = c - left, right - c
    near = context.astype(np.uint32).astype(np.int64) << 32 | (ahead & 1023) << 22 | (back & 1023) << 12 | c & 4095
    return near, c >> 12 << 42 | back >> 10 << 21 | ahead >> 10


def places(near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of packed rows."""
    c = far >> 42 << 12 | near & 4095
    back, ahead = (far >> 21 & 0x1FFFFF) << 10 | near >> 12 & 1023, (far & 0x1FFFFF) << 10 | near >> 22 & 1023
    return c - back, c, c + ahead


WINDOW = ["doc_id", "split", "value", "near", "far"]
WINDOW_TYPES = ", ".join(f"{name} long" for name in WINDOW)
#: The low bits of a value are its function's number.
FUNCTION = 0xFF
LINK = ["a", "b", "near_a", "far_a", "near_b", "far_b"]
BESIDE, ALONE = 0x100, 0x200


def numbered(mixed: np.ndarray, f: np.ndarray | int) -> np.ndarray:
    """Hashes with a function's number in their low bits."""
    return (mixed & ~np.uint64(FUNCTION)).view(np.int64) | f


#: Stands in for the shingles before and after, in rows whose value tells one of them.
TOLD = np.uint32(0xFFFFFFFF)


def beside_value(value: np.ndarray, beside: np.ndarray, kind: int) -> np.ndarray:
    """A value for windows that share ``value`` and 16 bits of the shingle before (kind 1) or after (kind 2)."""
    mixed = (value.view(np.uint64) ^ (beside.astype(np.uint64) | np.uint64(kind << 16)) * MIX[1]) * MIX[2]
    return numbered((mixed ^ mixed >> np.uint64(32)) * MIX[0], value & FUNCTION)


def window_rows(docs: DataFrame, width: int, least: int, hashes: int, hot: np.ndarray = np.zeros(0, np.int64), splits: int = 1) -> DataFrame:
    """doc_id, split, value (min shingle and function), near and far (places; 16 bits each of the shingle before and after).

    Windows of values in ``hot`` are dealt to splits 1, 2, .. by their document; all others have split 0. They have two
    more rows, whose values are those of min shingle, function and the shingle before, or after; ``hot`` may have these too."""
    if hashes > FUNCTION + 1:
        raise ValueError(f"at most {FUNCTION + 1} hash functions")
    odds, hot = multipliers(hashes), np.sort(hot)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                shingles, begins = shingle_hashes(part.column("text"), width)
                short = np.append((shingles & np.uint64(0xFFFF)).astype(np.uint32), np.uint32(0))  # -1: none
                own = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                dealt = (own.view(np.uint64) * MIX[0] >> np.uint64(33)).astype(np.int64) % splits + 1
                for f, odd in enumerate(odds):
                    text, left, c, right = compact_windows(shingles, begins, least, f, odd)
                    at = begins[text] + c
                    value = numbered((shingles[at] ^ odd) * MIX[2], f)
                    before = np.where(c >= CONTEXT, at - CONTEXT, -1)
                    after = np.where(at + CONTEXT < begins[text + 1], at + CONTEXT, -1)
                    near, far = packed(short[before] | short[after] << np.uint32(16), left, c, right)
                    often = among(value, hot) if len(hot) else np.zeros(len(at), bool)
                    split = np.where(often, dealt[text], 0)
                    rows = [[own[text], split, value, near, far]]
                    for kind, beside in enumerate((before, after), 1):
                        k = np.flatnonzero(often & (beside >= 0))
                        if len(k):
                            told = beside_value(value[k], short[beside[k]], kind)
                            near, far = packed(np.full(len(k), TOLD), left[k], c[k], right[k])
                            rows.append([own[text[k]], np.where(among(told, hot), dealt[text[k]], 0), told, near, far])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], WINDOW)

    return docs.mapInArrow(run, WINDOW_TYPES)


def frequent_values(docs: DataFrame, width: int, least: int, hashes: int, *, one_in: int = 64, most: int = 1024, fewest: int = 32) -> np.ndarray:
    """Values of more than 1 in ``most`` windows of a sample, and at least ``fewest``: so there are fewer than ``most``.

    The sample is one in ``one_in`` documents, by a hash of their ids. It only says which values are split."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0)
    counted = window_rows(sample, width, least, hashes).rollup("value").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(most + 1).collect()
    total = max((r.n for r in rows if r.value is None), default=0)
    hot = np.array([r.value for r in rows if r.value is not None and r.n > total / most and r.n >= fewest], np.int64)
    if not len(hot):
        return hot
    told = window_rows(sample, width, least, hashes, hot).where((F.col("split") == 0) & (F.expr("shiftright(near, 32)") == -1)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return np.append(hot, np.array([r.value for r in told.where((F.col("n") > total / most) & (F.col("n") >= fewest)).collect()], np.int64))


def linked(windows: DataFrame, split: bool = False) -> DataFrame:
    """Links between windows of different documents: a < b, and packed places of either; the high half of the first is the
    function, plus ``BESIDE`` if they share the shingle before or after too, and ``ALONE`` if no third window does.

    With ``split`` a value's windows may be dealt to splits. Each split is linked within; then the windows of a split's
    first document meet those of the other splits, by value, and by value and shingle before or after. So no task holds
    a frequent value, and a group that shares a passage still meets, by way of its smallest document in each split.
    """

    def firsts(group: np.ndarray, key: np.ndarray) -> np.ndarray:
        """For each row the first of its group with the same 16 bits."""
        _, first, inverse = np.unique((group << 16) | (key & 0xFFFF), return_index=True, return_inverse=True)
        return first[inverse]

    def buckets(batches):
        """The rows, how many were there before, and of each the first of its bucket, with its shingle before, and after."""
        held = np.zeros((0, 5), np.int64)  # of the open bucket: all rows that are a first, and the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in WINDOW], axis=1)])
            at = np.arange(len(rows))
            start = np.append(True, (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1))
            group = np.cumsum(start)
            first, before, after = np.maximum.accumulate(np.where(start, at, 0)), firsts(group, rows[:, 3] >> 32), firsts(group, rows[:, 3] >> 48)
            yield rows, at, len(held), first, before, after
            held = rows[(group == group[-1]) & ((first == at) | (before == at) | (after == at) | (at == at[-1]))]

    def link(whole, batches):
        for rows, at, old, first, before, after in buckets(batches):
            closed = whole & (rows[:, 1] == 0) & (first >= old) & (first != first[-1])  # all windows of the value are in this batch
            two = closed & (np.bincount(before)[before] <= 2) & (np.bincount(after)[after] <= 2)
            alone = (before == at) & (after == at) & (first != at)
            partners = [(first, (rows[:, 1] == 0) | (rows[:, 3] >> 32 != -1)), (before, before != first), (after, (after != first) & (after != before)), (np.maximum(at - 1, 0), alone & (at - 1 != first))]
            y = [np.flatnonzero(keep & (at >= old) & (x != at) & (rows[x, 0] != rows[:, 0])) for x, keep in partners]
            x = np.concatenate([x[k] for (x, _), k in zip(partners, y, strict=True)])
            y = np.concatenate(y)
            two = two[y]
            if len(x):
                swap = rows[x, 0] > rows[y, 0]
                x, y = rows[np.where(swap, y, x)], rows[np.where(swap, x, y)]
                halves = [(x[:, 3] >> shift & 0xFFFF, y[:, 3] >> shift & 0xFFFF) for shift in (32, 48)]
                beside = np.logical_or(*((u == v) & (u != 0) for u, v in halves))
                kind = x[:, 2] & FUNCTION | np.where(beside, np.where(two, BESIDE | ALONE, BESIDE), 0)
                cols = [x[:, 0], y[:, 0], x[:, 3] & 0xFFFFFFFF | kind << 32, x[:, 4], y[:, 3] & 0xFFFFFFFF, y[:, 4]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], LINK)

    def remaining(batches):
        for rows, at, old, first, *_ in buckets(batches):
            own = rows[(rows[first, 0] == rows[:, 0]) & (at >= old)]
            told = own[:, 3] >> 32 == -1
            cols = [own[:, 0], np.zeros(len(own), np.int64), own[:, 2], np.where(told, own[:, 3], own[:, 3] & 0xFFFFFFFF), own[:, 4]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], WINDOW)

    def in_order(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions("value", "split", "doc_id", F.expr("shiftright(far, 42)"), F.expr("near & 4095"))

    types = ", ".join(f"{name} long" for name in LINK)
    n = parts(windows.sparkSession)
    together = windows.repartition(n, "value", "split")
    links = in_order(together).mapInArrow(partial(link, True), types)
    if not split:
        return links
    # A condition that isn't deterministic stays above the exchange, so that both readers share it.
    dealt = together.where(F.when(F.spark_partition_id() >= 0, F.col("split") > 0).otherwise(False))
    met = in_order(dealt).mapInArrow(remaining, WINDOW_TYPES).repartition(n, "value")
    return links.unionByName(in_order(met).mapInArrow(partial(link, False), types))


def candidates(links: np.ndarray, enough: int, drift: int = 8) -> list[tuple[int, int, int, int, int]]:
    """Spans (first and last shingle in a, in b, and how many functions agree) from rows f, la, ca, ra, lb, cb, rb."""
    out = []
    offset = links[:, 5] - links[:, 2]
    by = np.argsort(offset, kind="stable")
    for own in np.split(by, np.flatnonzero(np.diff(offset[by]) > drift) + 1):
        own = own[np.argsort(links[own, 1], kind="stable")]
        upto = np.maximum.accumulate(links[own, 3])
        for part in np.split(own, np.flatnonzero(links[own[1:], 1] > upto[:-1]) + 1):
            agree = len(np.unique(links[part, 0]))
            if agree >= enough:
                x = links[part]
                out.append((int(x[:, 1].min()), int(x[:, 3].max()), int(x[:, 4].min()), int(x[:, 6].max()), agree))
    return out


def among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b, which is sorted and not empty."""
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def stretches(a: np.ndarray, b: np.ndarray, least: int, similar: float, gaps: tuple[int, ...] = (16, 8, 4, 0)) -> list[tuple[int, int, int, int, float]]:
    """Stretches of a and b (first and last place of either, similarity) that share enough shingles."""
    out = []
    at = np.flatnonzero(among(a, np.sort(b))) if len(b) else np.zeros(0, np.int64)
    edges = np.flatnonzero(at[1:] - at[:-1] > gaps[0] + 1).tolist()
    for first, last in zip([0, *(k + 1 for k in edges)], [*edges, len(at) - 1], strict=True):
        if last < first or at[last] - at[first] + 1 < least * similar:
            continue
        s, e = int(at[first]), int(at[last])
        own = np.sort(a[s : e + 1])
        there = np.flatnonzero(among(b, own))
        cuts = np.flatnonzero(there[1:] - there[:-1] > gaps[0] + 1).tolist()
        runs = zip([0, *(k + 1 for k in cuts)], [*cuts, len(there) - 1], strict=True)
        p, q = max(runs, key=lambda run: run[1] - run[0])
        u, v = int(there[p]), int(there[q])
        x, y = own, np.sort(b[u : v + 1])
        x, y = x[np.append(True, x[1:] != x[:-1])], y[np.append(True, y[1:] != y[:-1])]
        both = int(np.count_nonzero(among(x, y)))
        share = both / (len(x) + len(y) - both)
        if share >= similar and min(e - s, v - u) + 1 >= least:
            out.append((s, e, u, v, share))
        elif len(gaps) > 1:
            out += [(s + p, s + q, u2, v2, f) for p, q, u2, v2, f in stretches(a[s : e + 1], b, least, similar, gaps[1:])]
    return out


def repeated_passages(docs: DataFrame, *, width: int = 5, least_words: int = 50, hashes: int = 8, enough: int = 3, similar: float = 0.8, hot: np.ndarray | None = None, splits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, last_word, source_id, source_first, source_last, similarity, n_hashes: a stretch of a
    document that an earlier one (of smaller id) has too. Words count from 0, both ends included.

    Documents with a null id, and null, empty or short texts, take no part. Rows that repeat an id count as one
    document with the greatest of their texts. In a group that shares a passage each later document has a row, with an
    earlier one as its source; not every pair is listed. An empty table gives no rows. Values in ``hot`` (by default
    those frequent in a sample) are dealt to ``splits`` buckets each, by document.
    """
    least = max(1, least_words - width + 1)
    own = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    hot = frequent_values(own, width, least, hashes) if hot is None else np.asarray(hot, np.int64)
    links = linked(window_rows(own, width, least, hashes, hot, splits), len(hot) > 0)

    def join_intervals(enough, batches):
        """Candidates, and with agree 0 the spans and places of function 0's links that share a shingle beside c; of those that
        are alone in this only the ones in no candidate."""
        names, types = ["a", "b", "a0", "a1", "b0", "b1", "agree", "ca", "cb"], [pa.int64(), pa.int64()] + [pa.int32()] * 7
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            lists = batch.column("links")
            flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            near_a, far_a, near_b, far_b = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            table = np.stack([near_a >> 32 & FUNCTION, *places(near_a, far_a), *places(near_b, far_b)], axis=1)
            rows, stars = [], near_a >> 32 & (FUNCTION | BESIDE) == BESIDE
            for k, (p, q) in enumerate(zip(a, b, strict=True)):
                own, spans = table[at[k] : at[k + 1]], candidates(table[at[k] : at[k + 1]], enough)
                rows += [(p, q, *c, None, None) for c in spans]
                for a0, a1, b0, b1, _ in spans:
                    inside = (own[:, 1] >= a0) & (own[:, 3] <= a1) & (own[:, 4] >= b0) & (own[:, 6] <= b1)
                    stars[at[k] : at[k + 1]][inside & (near_a[at[k] : at[k + 1]] >> 32 >= ALONE)] = False
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
            stars = np.flatnonzero(stars)
            pair = np.searchsorted(at, stars, "right") - 1
            x = table[stars]
            cols = [*(batch.column(c).to_numpy()[pair] for c in ("a", "b")), x[:, 1], x[:, 3], x[:, 4], x[:, 6], np.zeros(len(x)), x[:, 2], x[:, 5]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(cols, types, strict=True)], names)

    def cut(side: str, rest: list[str]):
        """The shingles of a pair's span on one side, beside the other columns."""

        def run(batches):
            last, shingles = None, None
            for batch in batches:
                ids, begin, end = (batch.column(c).to_pylist() for c in (side, side + "0", side + "1"))
                text, spans = batch.column("text"), []
                for k, i in enumerate(ids):
                    if i != last:
                        shingles, last = shingle_hashes(text.slice(k, 1), width)[0], i
                    spans.append(shingles[begin[k] : end[k] + 1])
                yield batch, spans

        return run

    def take_a(batches):
        for batch, spans in cut("a", [])(batches):
            cols = [batch.column(c) for c in ("a", "b", "a0", "b0", "b1", "agree")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([s.astype("<u8").tobytes() for s in spans], pa.binary())], ["a", "b", "a0", "b0", "b1", "agree", "shingles"])

    def compare(batches):
        for batch, spans in cut("b", [])(batches):
            rows = []
            for k, (a, b, a0, b0, agree, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a0", "b0", "agree", "shingles")), strict=True)):
                for s, e, u, v, share in stretches(np.frombuffer(raw, "<u8"), spans[k], least, similar):
                    rows.append((b, b0 + u, b0 + v + width - 1, a, a0 + s, a0 + e + width - 1, share, agree))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
            names = ["doc_id", "first_word", "last_word", "source_id", "source_first", "source_last", "similarity", "n_hashes"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    def intervals(links: DataFrame, enough: int) -> DataFrame:
        grouped = links.groupBy("a", "b").agg(F.collect_list(F.struct(*LINK[2:])).alias("links"))
        functions = F.array_distinct(F.transform("links.near_a", lambda x: F.shiftright(x, 32).bitwiseAND(FUNCTION)))
        # Few links: the condition saves a way to Python, where candidates are counted again.
        grouped = grouped.where((F.size("links") >= 16) | ((F.size("links") >= enough) & (F.size(functions) >= enough)) | F.exists("links.near_a", lambda x: F.shiftright(x, 32).bitwiseAND(FUNCTION | BESIDE) == BESIDE))
        with batches_of(docs.sparkSession, 1000):
            return written(grouped.mapInArrow(partial(join_intervals, enough), "a long, b long, a0 int, a1 int, b0 int, b1 int, agree int, ca int, cb int"), "passages")

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("agree > 0").drop("ca", "cb")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        ids = sized(ids)
        reclaim(docs.sparkSession)  # a job after those whose files go: until then Spark's listeners hold their plans
        texts = own.join(ids, F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        one = pairs.join(texts.withColumnRenamed("doc_id", "a"), "a").mapInArrow(take_a, "a long, b long, a0 int, b0 int, b1 int, agree int, shingles binary")
        both = one.join(texts.withColumnRenamed("doc_id", "b"), "b")
        return written(both.mapInArrow(compare, "doc_id long, first_word int, last_word int, source_id long, source_first int, source_last int, similarity double, n_hashes int").distinct(), "found")

    pairs = intervals(links, enough)
    found = compared(pairs)
    left = apart(pairs.where("agree = 0"), found, width, least)
    if left.isEmpty():
        return found
    met = run_links(left, found, own, width, least)
    known = (F.col("a") == F.col("p")) & (F.col("b") == F.col("q")) & F.col("ca").between(F.col("s"), F.col("e") - (least - 1)) & F.col("cb").between(F.col("u"), F.col("v") - (least - 1))
    met = met.join(spans_of(found, width), known, "left_anti")
    ahead = least - 1
    for side in "ab":  # packed: c is the run's begin
        c = F.col(f"c{side}")
        met = met.withColumn(f"near_{side}", c.bitwiseAND(4095) + ((ahead & 1023) << 22)).withColumn(f"far_{side}", F.shiftleft(F.shiftright(c, 12), 42) + (ahead >> 10))
    return found.unionByName(compared(intervals(met, 1))).distinct()


def spans_of(found: DataFrame, width: int) -> DataFrame:
    """p, q, s, e, u, v: found stretches in shingles, s to e of the source p and u to v of q."""
    last = width - 1
    return found.select(F.col("source_id").alias("p"), F.col("doc_id").alias("q"), F.col("source_first").alias("s"), (F.col("source_last") - last).alias("e"), F.col("first_word").alias("u"), (F.col("last_word") - last).alias("v"), "similarity")


def apart(stars: DataFrame, found: DataFrame, width: int, least: int) -> DataFrame:
    """doc_id, low, high: where the runs begin that have c as min-hash, of windows that share a shingle beside c with a first
    but not all these runs, and of such firsts. ``stars``: links of one function, a0 to a1 and b0 to b1 their windows.

    Left out are firsts whose every window has a stretch with them over all its runs."""
    begin, end = F.greatest(F.col("b0"), F.col("cb") - (least - 1)), F.least(F.col("b1"), F.col("cb") + (least - 1))
    over = (F.col("a") == F.col("p")) & (F.col("b") == F.col("q")) & (F.col("u") <= begin) & (F.col("v") >= end)
    equal = F.coalesce((F.col("similarity") == 1) & (F.col("e") - F.col("s") == F.col("v") - F.col("u")) & (F.col("s") - F.col("u") == F.col("ca") - F.col("cb")), F.lit(False))
    own = stars.join(spans_of(found, width), over, "left").groupBy(*stars.columns).agg(F.max(equal).alias("equal"), F.max(F.col("p").isNotNull()).alias("over"))
    own = written(own.where("NOT equal"), "stars")
    left = own.join(own.where("NOT over").select("a", "ca").distinct(), ["a", "ca"], "left_semi")

    def side(i: str) -> DataFrame:
        low, high = F.greatest(F.col(i + "0"), F.col("c" + i) - (least - 1)), F.least(F.col("c" + i), F.col(i + "1") - (least - 1))
        return left.select(F.col(i).alias("doc_id"), low.alias("low"), high.alias("high"))

    return written(side("a").unionByName(side("b")).distinct(), "apart")


def run_links(left: DataFrame, found: DataFrame, docs: DataFrame, width: int, least: int) -> DataFrame:
    """a, b, ca, cb: equal runs of ``least`` shingles, of those that begin where ``left`` says, each with the one of the smallest
    document. Runs inside a stretch that a document was found to have word by word from an earlier one are left out: the
    first that has such a run, and so all others, don't need them."""

    def runs(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                shingles, begins = shingle_hashes(part.column("text"), width)
                n = len(shingles) - least + 1
                if n <= 0:
                    continue
                held = part.column("places")
                base = np.repeat(begins[:-1], held.value_lengths().to_numpy())
                ends, marked = held.flatten(), []
                for known in (False, True):
                    k, marks = np.flatnonzero(ends.field("known").to_numpy(zero_copy_only=False) == known), np.zeros(n + 1, np.int64)
                    np.add.at(marks, ends.field("low").to_numpy()[k] + base[k], 1)
                    np.add.at(marks, ends.field("high").to_numpy()[k] + base[k] + 1, -1)
                    marked.append(np.cumsum(marks[:-1]) > 0)
                at = np.flatnonzero(marked[0] & ~marked[1])
                total = np.zeros(len(at), np.uint64)
                for k in range(least):
                    total = (total ^ shingles[at + k]) * MIX[1]
                    total ^= total >> np.uint64(29)
                text = np.searchsorted(begins, at, "right") - 1
                own = part.column("doc_id").to_numpy(zero_copy_only=False)[text]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total.view(np.int64)), pa.array((at - begins[text]).astype(np.int32))], ["doc_id", "run", "place"])

    def firsts(batches):
        held = np.zeros((3, 0), np.int64)  # the open run's first row
        for batch in batches:
            if not batch.num_rows:
                continue
            run, doc, place = np.concatenate([held, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("run", "doc_id", "place")])], axis=1)
            first = np.maximum.accumulate(np.where(np.append(True, run[1:] != run[:-1]), np.arange(len(run)), 0))
            met = np.flatnonzero(doc != doc[first])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[first[met]], doc[met], place[first[met]], place[met])], ["a", "b", "ca", "cb"])
            held = np.array([[run[first[-1]]], [doc[first[-1]]], [place[first[-1]]]])

    known = spans_of(found, width).where("similarity = 1 AND e - s = v - u").select(F.col("q").alias("doc_id"), F.col("u").alias("low"), (F.col("v") - (least - 1)).alias("high")).where("low <= high")
    known = known.distinct().withColumn("known", F.lit(True))
    places = left.withColumn("known", F.lit(False)).unionByName(known).groupBy("doc_id").agg(F.collect_list(F.struct("low", "high", "known")).alias("places"))
    places = places.where(F.exists("places", lambda x: ~x["known"]))
    own = docs.join(sized(places.select(F.col("doc_id").alias("id"))), F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    n = parts(docs.sparkSession)
    rows = own.join(places, "doc_id").select("doc_id", "places", "text").mapInArrow(runs, "doc_id long, run long, place int")
    ordered = rows.repartition(n, "run").sortWithinPartitions("run", "doc_id", "place")
    return ordered.mapInArrow(firsts, "a long, b long, ca long, cb long")


WORD = re.compile(r"[^ \t\n\r\f\v]+")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (first and last word). With a run of words goes the white space before it;
    that after it stays."""
    gone = np.zeros(max(e for _, e in spans) + 1, bool)
    for s, e in spans:
        gone[s : e + 1] = True
    out, at, last = [], 0, 0
    for k, m in enumerate(WORD.finditer(text)):
        if k < len(gone) and gone[k]:
            if k == 0 or not gone[k - 1]:
                out.append(text[at:last])
            at = m.end()
        last = m.end()
    out.append(text[at:])
    return "".join(out)


#: Spans of documents may be broadcast up to so many bytes.
MOST_SPANS = 64 << 20


def remove_passages(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the stretches that ``passages`` lists for them; other columns unchanged.

    The earliest document with a passage keeps it. A document of which no word is left goes; one without a listed
    stretch stays as it is: rows with a null id, null and empty texts too. Of rows that repeat an id those with the
    greatest text are cut, as that is the text whose words ``passages`` counts. An empty table stays empty.
    """
    of, gone, top = (fresh(docs, n) for n in ("of_doc", "gone", "greatest"))
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first_word", "last_word"))).alias(gone))
    spans = written(spans.select(F.col("doc_id").alias(of), gone), "spans")
    size = spans.agg(F.sum(16 + 8 * F.size(gone))).first()[0] or 0
    spans = F.broadcast(spans) if size <= MOST_SPANS else spans
    id_of = docs[id_col].cast("long")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    repeated = docs.where(id_of.isNotNull()).groupBy(id_of.alias(of)).agg(F.count(F.lit(1)).alias(top)).where(F.col(top) > 1).select(of)
    repeated = written(repeated, "repeated")
    joined = docs.join(spans, id_of == F.col(of), "left").drop(of)
    if not repeated.isEmpty():
        texts = docs.join(sized(repeated), id_of == F.col(of), "left_semi").groupBy(id_of.alias(of)).agg(F.xxhash64(F.max(text)).alias(top))
        joined = joined.join(sized(texts), joined[id_col].cast("long") == F.col(of), "left").drop(of)
        own = F.col(top).isNull() | (F.col(top) == F.xxhash64(F.coalesce(joined[text_col].cast("string"), F.lit(""))))
        joined = joined.withColumn(gone, F.when(own, F.col(gone))).drop(top)

    def run(batches):
        for batch in batches:
            gone = batch.column(batch.num_columns - 1).to_pylist()
            place = batch.schema.get_field_index(text_col)
            texts = batch.column(place).to_pylist()
            new = [t if g is None or t is None else without_spans(t, [(x["first_word"], x["last_word"]) for x in g]) for t, g in zip(texts, gone, strict=True)]
            keep = [g is None or bool((t or "").strip()) for t, g in zip(new, gone, strict=True)]
            cols = [pa.array(new, batch.schema.field(place).type) if k == place else batch.column(k) for k in range(batch.num_columns - 1)]
            yield from pa.Table.from_arrays(cols, names=batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_())).to_batches()

    return joined.mapInArrow(run, docs.schema)
