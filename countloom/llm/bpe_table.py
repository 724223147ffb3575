"""BPE encoding and decoding through a table of distinct words.

1. Each task splits its texts at white space, and words of letters from the marks after them, and turns a run of
   documents into a *chunk*: the chunk's distinct words, numbered by falling frequency (slots), and every document's
   words as slots, compressed. Texts move no further.
2. One shuffle by key, sorted by it, makes the table of words: each distinct word's rows stand together, and it is
   encoded once, with the tokenizers library. A chunk's row goes to its name's place.
3. Ids return to their chunk and slot, where they are laid out by position into every document's ids. Words' ids are
   joined to the vocabulary's pieces there (a map-side join: the vocabulary is as long as the tokenizer is), and the
   pieces of a document's words make its decoded text.

A frequent word has one row a chunk, not one an occurrence, so no key is hot. A chunk that misses a word raises.
"""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.common import flat_binary, id_and_text, parts
from countloom.llm.wordbpe import encoder, laid_out, slices, split_words, vocabulary_path


def pack_chunk(doc_ids: pa.Array, offsets: np.ndarray, slots: np.ndarray, distinct: int) -> bytes:
    """A chunk's documents and their words' slots, by byte planes, compressed."""
    raw = np.ascontiguousarray(slots.astype("<u4")).view(np.uint8).reshape(-1, 4)
    null = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    names = pc.fill_null(doc_ids, 0).to_numpy().astype("<i8")
    body = b"".join([names.tobytes(), null.tobytes(), offsets.astype("<i8").tobytes(), *(raw[:, k].tobytes() for k in range(4))])
    return struct.pack("<QQQ", len(names), len(slots), distinct) + zstandard.ZstdCompressor(level=1).compress(body)


def open_chunk(blob: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    n, words, distinct = struct.unpack_from("<QQQ", blob)
    body = zstandard.ZstdDecompressor().decompress(blob[24:])
    names = np.frombuffer(body, "<i8", n).tolist()
    null = np.frombuffer(body, np.uint8, n, 8 * n).tolist()
    offsets = np.frombuffer(body, "<i8", n + 1, 9 * n)
    planes = np.frombuffer(body, np.uint8, 4 * words, 17 * n + 8).reshape(4, words)
    slots = np.ascontiguousarray(planes.T).view("<u4").reshape(-1).view(np.int32)
    return [None if z else d for d, z in zip(names, null, strict=True)], offsets, slots, distinct


def chunked(docs: DataFrame, tokenizer: str, chunk_bytes: int) -> DataFrame:
    """Word rows (key: the word; chunk, slot) and chunk rows (key: the chunk, which no word can be; blob)."""
    names, types = ["key", "chunk", "slot", "blob"], [pa.string(), pa.string(), pa.int32(), pa.binary()]

    def run(batches):
        part, made, plain = TaskContext.get().partitionId(), 0, encoder(tokenizer).plain

        def spelled(w: str) -> tuple[str, ...]:
            m = plain(w)
            return (w,) if m is None else (m[1].lower(), m[2]) if m[2] else (w.lower(),)

        for batch in batches:
            for piece in slices(batch, "text", chunk_bytes):
                known: dict[str, int] = {}
                runs, lengths = [], []
                for own in slices(piece, "text", 4 << 20):
                    words, offsets = split_words(own.column("text"))
                    coded = words.dictionary_encode()
                    flat, size = [], []
                    for w in coded.dictionary.to_pylist():
                        found = spelled(w)
                        flat += [known.setdefault(x, len(known)) for x in found]
                        size.append(len(found))
                    index, ends = laid_out(np.array(flat, np.int32), np.array(size, np.int64), coded.indices.to_numpy(zero_copy_only=False))
                    runs.append(index)
                    lengths.append(np.diff(np.concatenate([[0], ends])[offsets]))
                index, many = np.concatenate(runs), len(known)
                del runs
                order = np.argsort(-np.bincount(index, minlength=many), kind="stable")
                slot = np.empty(many, np.int32)
                slot[order] = np.arange(many, dtype=np.int32)
                chunk, made = f"\n{part}:{made}", made + 1
                blob = pack_chunk(piece.column("doc_id"), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), slot[index], many)
                del index
                yield pa.RecordBatch.from_arrays([pa.array([chunk], types[0]), pa.nulls(1, types[1]), pa.nulls(1, types[2]), pa.array([blob], types[3])], names)
                words = list(known)
                del known, blob
                for at in range(0, many, 20_000):
                    own = words[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(own, types[0]), pa.array([chunk] * len(own), types[1]), pa.array(slot[at : at + 20_000]), pa.nulls(len(own), types[3])], names)

    return docs.mapInArrow(run, "key string, chunk string, slot int, blob binary")


def vocabulary(tokenizer: str) -> pa.Array:
    """The piece of every id, the whole vocabulary's."""
    with open(tokenizer) as f:
        spec = json.load(f)
    rows = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return pa.array([rows.get(i) for i in range(max(rows) + 1)], pa.string())


def encoded(words: DataFrame, tokenizer: str) -> DataFrame:
    """chunk, slot, ids (little-endian, two bytes each if the vocabulary allows) of rows sorted by word: each word is encoded once."""
    wide = np.dtype("<u2" if len(vocabulary(tokenizer)) <= 1 << 16 else "<u4")

    def run(batches):
        enc, last, last_ids = encoder(tokenizer), None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            enc.bodies.clear()  # every word comes once
            coded = batch.column("word").dictionary_encode()
            table = []
            for w in coded.dictionary.to_pylist():
                if w != last:
                    last, last_ids = w, np.frombuffer(enc.word(w), "<u4").astype(wide).tobytes()
                table.append(last_ids)
            ids = pa.array(table, pa.binary()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("slot"), ids], ["chunk", "slot", "ids"])

    return words.mapInArrow(run, "chunk string, slot int, ids binary")


def encode_decode(docs: DataFrame, *, tokenizer: str | None = None, chunk_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, with ``keep``, ids and decoded) for every row.

    A null or empty text has no ids and decodes to an empty text; null and repeated ids keep their rows.
    """
    tokenizer = tokenizer or vocabulary_path()
    n = parts(docs.sparkSession)
    pieces = vocabulary(tokenizer)
    wide = np.dtype("<u2" if len(pieces) <= 1 << 16 else "<u4")
    rows = chunked(id_and_text(docs, id_col, text_col), tokenizer, chunk_bytes).repartition(n, "key")
    # Both kinds of rows come from one shuffle: a filter that isn't deterministic and looks at every column stays above
    # it, so both branches have the same plan below and Spark reuses the exchange, with its partitioning by key.
    word_row = F.col("chunk").isNotNull() & F.col("slot").isNotNull() & F.col("blob").isNull()
    words = rows.where(F.when(F.spark_partition_id() >= 0, word_row).otherwise(False)).select(F.col("key").alias("word"), "chunk", "slot")
    placed = encoded(words.sortWithinPartitions("word"), tokenizer)
    chunks = rows.where(F.when(F.spark_partition_id() >= 0, ~word_row).otherwise(False)).select("key", "blob")

    def lay_out(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        if len(right) != 1:
            raise RuntimeError("a chunk is missing or doubled")
        names, offsets, slots, distinct = open_chunk(right.column("blob")[0].as_py())
        order = np.argsort(left.column("slot").to_numpy())
        if len(order) != distinct or (distinct and left.column("slot").to_numpy()[order[-1]] != distinct - 1):
            raise RuntimeError("a chunk misses words")
        raw_ids, begins = flat_binary(left.column("ids").take(pa.array(order)))
        held, size = raw_ids.view(wide).astype("<u4"), np.diff(begins) // wide.itemsize
        # The words' ids joined to their pieces; a word without ids has none.
        spelled = size > 0
        piece = pc.binary_join(pa.ListArray.from_arrays(pa.array((begins // wide.itemsize).astype(np.int32)), pieces.take(pa.array(held))), " ")
        at, ends = 0, offsets[1:]
        while at < len(names):  # a bounded number of words at a time
            stop = max(at + 1, int(np.searchsorted(ends, offsets[at] + (1 << 18), "right")))
            own = slots[offsets[at] : offsets[stop]]
            bounds = offsets[at : stop + 1] - offsets[at]
            flat, upto = laid_out(held, size, own)
            upto = np.concatenate([[0], upto])[bounds].tolist()
            raw = memoryview(np.ascontiguousarray(flat)).cast("B") if len(flat) else memoryview(b"")
            said = spelled[own] if len(own) else np.zeros(0, bool)
            places = np.concatenate([[0], np.cumsum(said)])[bounds]
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), piece.take(pa.array(own[said]))), " ")
            for doc, a, b, t in zip(names[at:stop], upto[:-1], upto[1:], text.to_pylist(), strict=True):
                values = (doc, b - a, hashlib.sha256(raw[4 * a : 4 * b]).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), flat[a:b].astype(np.int32) if keep else None, t if keep else None)
                for held_out, v in zip(out, values, strict=True):
                    held_out.append(v)
            at = stop
        cols = {"doc_id": pa.array(out[0], pa.int64()), "n_tokens": pa.array(out[1], pa.int64()), "ids_sha256": pa.array(out[2], pa.string()), "decoded_sha256": pa.array(out[3], pa.string())}
        return pa.table(cols | ({"ids": pa.array(out[4], pa.list_(pa.int32())), "decoded": pa.array(out[5], pa.string())} if keep else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return placed.groupBy("chunk").cogroup(chunks.groupBy("key")).applyInArrow(lambda left, right: lay_out(left, right), schema)
