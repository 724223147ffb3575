"""Best-fit packing of tokenized documents into sequences under several capacities at once.

Method: vector best-fit. A sequence has three residual capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces are placed in falling order of length; of all open sequences that can take the piece in
every dimension the one is chosen whose residual vector is tightest, by weighted dot-product with the piece's demand
("dot") or by weighted norm of what would be left ("norm"). Only a piece that fits nowhere opens a sequence.

At scale pieces are dealt at random into groups of about ``group`` pieces, each packed in one task, since a few
thousand random pieces fill sequences as well as all pieces do. Sequences that stay below ``full`` of their tokens are
opened again and their pieces dealt into fewer groups, until one group holds all that is left. No step sees more than
a group's pieces at once.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import id_and_text, written
from countloom.llm.wordbpe import encoder, slices, vocabulary_path

PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, *, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of at most ``capacity`` ids; ``row`` is another number for each piece.

    A null or empty text has the end id alone; null or repeated document ids stay as they are. With ``keep_ids`` each
    row also has its ids.
    """

    def cut(batches):
        at, enc = TaskContext.get().partitionId() << 40, encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                ids, begins = enc.texts(part.column("text"))
                own = part.column("doc_id").to_pylist()
                rows: list[list] = [[], [], [], [], []]
                kept = []
                for doc, a, b in zip(own, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(whole), capacity)):
                        piece = whole[s : s + capacity]
                        for held, v in zip(rows, (doc, k, s, len(piece), zlib.crc32(piece.tobytes())), strict=True):
                            held.append(v)
                        if keep_ids:
                            kept.append(piece.astype(np.int32))
                n = len(rows[0])
                cols = [pa.array(range(at, at + n), pa.int64()), *(pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                at += n
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int, most_docs: int, most_cost: float, weights=(1.0, 0.1, 0.1), rule: str = "norm") -> np.ndarray:
    """The sequence (from 0) of each piece; ``lengths`` in falling order."""
    caps = np.array([capacity, most_docs, most_cost], float)
    w = np.asarray(weights, float)
    left = np.empty((3, 256))  # residual share of each capacity, of open sequences
    names = np.empty(256, np.int64)
    n = opened = 0
    out = np.empty(len(lengths), np.int64)
    slack = 1e-9
    for i, length in enumerate(lengths.tolist()):
        d = np.array([length, 1.0, float(length) * length]) / caps
        pick = -1
        if n:
            after = left[:, :n] - d[:, None]
            fits = (after >= -slack).all(axis=0)
            score = w @ (left[:, :n] * d[:, None]) if rule == "dot" else w @ (after * after)
            score[~fits] = np.inf
            pick = int(score.argmin())
            if not fits[pick]:
                pick = -1
        if pick < 0:
            if n == left.shape[1]:
                left, names = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([names, np.empty_like(names)])
            pick, names[n], left[:, n] = n, opened, 1.0
            n, opened = n + 1, opened + 1
        left[:, pick] -= d
        out[i] = names[pick]
        if (left[:, pick] < 0.5 / caps).any():  # nothing more goes in: no token, document or cost is left
            n -= 1
            left[:, pick], names[pick] = left[:, n], names[n]
    return out


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048, most_docs: int | None = None, most_cost: float | None = None, weights=(1.0, 0.1, 0.1), rule: str = "norm", group: int = 4096, full: float = 0.999) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``row`` and ``length`` (1 to ``capacity``).

    ``most_docs`` and ``most_cost`` default to values that the token capacity implies. A cost that a single piece of
    full length would exceed is an error. No pieces: no rows.
    """
    most_docs = capacity if most_docs is None else most_docs
    most_cost = float(capacity) ** 2 if most_cost is None else most_cost
    if most_cost < float(capacity) ** 2 or most_docs < 1:
        raise ValueError("a piece of full length must fit an empty sequence")

    def pack(round_no: int, last: bool):
        def run(table: pa.Table) -> pa.Table:
            row, size, g = (table.column(c).to_numpy() for c in ("row", "length", "g"))
            order = np.lexsort((row, -size))
            row, size = row[order], size[order]
            seq = best_fit(size, capacity, most_docs, most_cost, weights, rule)
            by = np.argsort(seq, kind="stable")
            row, size, seq = row[by], size[by], seq[by]
            fill = np.bincount(seq, weights=size)
            ends = np.cumsum(size)
            first = np.concatenate([[0], np.flatnonzero(np.diff(seq)) + 1]) if len(seq) else np.zeros(0, int)
            offset = ends - size - (ends - size)[first][seq]
            name = (np.int64(round_no) << 56) | (np.int64(g[0]) << 28) | seq
            return pa.table({"row": row, "length": size, "sequence_id": name, "offset": offset, "done": (fill[seq] >= full * capacity) | last})

        return run

    todo, packed, round_no = pieces.select("row", "length"), None, 0
    left = todo.count()
    while True:
        groups = max(1, -(-left // group))
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("row", F.lit(round_no)), F.lit(groups)))
        done = written(dealt.groupBy("g").applyInArrow(pack(round_no, groups == 1), "row long, length long, sequence_id long, offset long, done boolean"), "packed")
        kept = done.where("done").select("row", "sequence_id", "offset")
        packed = kept if packed is None else packed.unionByName(kept)
        if groups == 1:
            break
        todo, before, round_no = done.where("NOT done").select("row", "length"), left, round_no + 1
        left = todo.count()
        if left == 0:
            break
        if left > 0.9 * before:  # hardly any sequence fills up: more rounds cannot help
            packed = packed.unionByName(done.where("NOT done").select("row", "sequence_id", "offset"))
            break
    return pieces.join(packed, "row")


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, **how) -> DataFrame:
    """Documents as pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null texts count as empty and have the end id alone. Longer documents are cut every ``capacity`` ids, no others.
    An empty table gives no rows.
    """
    pieces = written(token_pieces(docs, tokenizer=tokenizer or vocabulary_path(), capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, keep_ids=keep_ids), "pieces")
    return pack_pieces(pieces, capacity=capacity, **how).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence from pieces with ids: sequence_id, ids, doc_ids. A sequence is bounded by its capacity."""
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("held")
    return packed.groupBy("sequence_id").agg(held).select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"))


