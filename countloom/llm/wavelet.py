"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents as one wavelet matrix: for each bit of an id, from the highest, a plane
with that bit of every id, after which the ids are stably parted into zeros and ones for the next plane. Planes are
cut into blocks, compressed one by one, with the number of ones before each block beside them, so reading one id,
counting an id in a prefix (rank) and finding its k-th place (select) each open one or two blocks a plane.

Shards are rows of a Parquet table that Spark's writer commits, so they survive lost executors and need no file access
of their own on any store: part, shard, first (ids of the part before the shard), n_tokens, n_docs, blob.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import id_and_text, parts
from countloom.llm.wordbpe import encoder, slices, vocabulary_path

MAGIC = b"CLWM0001"
HEAD = struct.Struct("<8sBIQQI")  # magic, planes, bits of a block, ids, documents, blocks of a plane
SHARDS = "part int, shard int, first long, n_tokens long, n_docs long, blob binary"


def encode_shard(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, block_bits: int = 1 << 16) -> bytes:
    """One shard's bytes. ``ends``: for each document, the ids up to its end."""
    ids = np.ascontiguousarray(ids, np.uint32)
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    blocks = max(1, -(-len(ids) // block_bits))
    pack, zeros, ranks, sizes, body = zstandard.ZstdCompressor(level=1), [], [], [], []
    seq = ids
    for b in range(planes - 1, -1, -1):
        bit = (seq >> np.uint32(b)) & np.uint32(1) != 0
        low, high = seq[~bit], seq[bit]
        zeros.append(len(low))
        packed = np.packbits(bit, bitorder="little")
        step = block_bits // 8
        ones = np.add.reduceat(bit, np.arange(0, len(bit), block_bits), dtype=np.int64) if len(bit) else np.zeros(1, np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(ones)[:-1]]))
        for k in range(blocks):
            z = pack.compress(packed[k * step : (k + 1) * step].tobytes())
            sizes.append(len(z))
            body.append(z)
        seq = np.concatenate([low, high])
    held = pack.compress(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.asarray(ends, "<i8").tobytes())
    return b"".join(
        [
            HEAD.pack(MAGIC, planes, block_bits, len(ids), len(doc_ids), blocks),
            struct.pack("<Q", len(held)),
            np.array(zeros, "<i8").tobytes(),
            np.concatenate(ranks).astype("<i8").tobytes(),
            np.array(sizes, "<i8").tobytes(),
            held,
            *body,
        ]
    )


class Shard:
    """Reads a shard's bytes; blocks are opened when asked for."""

    def __init__(self, blob: bytes):
        magic, self.planes, self.block_bits, self.n, self.n_docs, self.blocks = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        (held,) = struct.unpack_from("<Q", blob, HEAD.size)
        at, cells = HEAD.size + 8, self.planes * self.blocks
        self.zeros = np.frombuffer(blob, "<i8", self.planes, at)
        self.ranks = np.frombuffer(blob, "<i8", cells, at := at + 8 * self.planes).reshape(self.planes, self.blocks)
        sizes = np.frombuffer(blob, "<i8", cells, at := at + 8 * cells)
        self.open = zstandard.ZstdDecompressor()
        docs, at = self.open.decompress(blob[at + 8 * cells : at + 8 * cells + held]), at + 8 * cells + held
        k = self.n_docs
        null = np.frombuffer(docs, np.uint8, k, 8 * k)
        self.doc_ids = [None if z else d for d, z in zip(np.frombuffer(docs, "<i8", k).tolist(), null.tolist(), strict=True)]
        self.ends = np.frombuffer(docs, "<i8", k, 9 * k)
        self.places = at + np.concatenate([[0], np.cumsum(sizes)]).reshape(-1)
        self.blob, self.seen = blob, {}

    def block(self, plane: int, k: int) -> np.ndarray:
        key = plane * self.blocks + k
        if key not in self.seen:
            if len(self.seen) >= 64:
                self.seen.clear()
            raw = self.open.decompress(self.blob[self.places[key] : self.places[key + 1]])
            self.seen[key] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self.seen[key]

    def ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i <= 0:
            return 0
        k = min(i // self.block_bits, self.blocks - 1)
        return int(self.ranks[plane, k]) + int(self.block(plane, k)[: i - k * self.block_bits].sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit = int(self.block(p, i // self.block_bits)[i % self.block_bits])
            before = self.ones(p, i)
            value, i = value << 1 | bit, int(self.zeros[p]) + before if bit else i - before
        return value

    def rank(self, token: int, i: int) -> int:
        """How often the id occurs among the first i."""
        lo, hi = self.span(token, min(max(i, 0), self.n))
        return hi - lo

    def span(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        if token >> self.planes or token < 0:
            return 0, 0
        for p in range(self.planes):
            a, b = self.ones(p, lo), self.ones(p, hi)
            if token >> (self.planes - 1 - p) & 1:
                lo, hi = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the id's k-th occurrence, from 0."""
        lo, hi = self.span(token, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - p) & 1
            i = self.place(p, i - int(self.zeros[p]), 1) if one else self.place(p, i, 0)
        return i

    def place(self, plane: int, k: int, bit: int) -> int:
        """The place of the k-th such bit of a plane: its block by the counts before blocks, then inside it."""
        before = self.ranks[plane] if bit else np.arange(self.blocks) * self.block_bits - self.ranks[plane]
        b = int(np.searchsorted(before, k, "right")) - 1
        own = self.block(plane, b)[: self.n - b * self.block_bits]
        return b * self.block_bits + int(np.flatnonzero(own == bit)[k - int(before[b])])

    def decode(self) -> np.ndarray:
        """All ids: the planes put together again from the last to the first."""
        seq = np.zeros(self.n, np.uint32)
        for p in range(self.planes - 1, -1, -1):
            raw = b"".join(self.open.decompress(self.blob[self.places[k] : self.places[k + 1]]) for k in range(p * self.blocks, (p + 1) * self.blocks))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n].view(bool)
            out, z = np.empty_like(seq), int(self.zeros[p])
            out[~bit] = seq[:z]
            out[bit] = seq[z:] | np.uint32(1 << (self.planes - 1 - p))
            seq = out
        return seq


def write_shards(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 1, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all documents, each followed by ``end_id``, to ``path`` in ascending order of document id.

    Null ids come first, equal ids in the order of their texts' hash; a null text counts as empty. A shard ends with
    the first document that fills it, so one longer document makes one larger shard. An empty table: no shard.
    """
    tokenizer = tokenizer or vocabulary_path()

    def shards(batches):
        part, enc, shard, first = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        n = 0

        def row():
            ids = np.concatenate(held)
            blob = encode_shard(ids, names, np.cumsum(sizes))
            cols = [[part], [shard], [first], [len(ids)], [len(names)], [blob]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "first", "n_tokens", "n_docs", "blob"])

        for batch in batches:
            for piece in slices(batch, "text"):
                ids, begins = enc.texts(piece.column("text"))
                for doc, a, b in zip(piece.column("doc_id").to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    held.append(np.append(ids[a:b], np.uint32(end_id)))
                    names.append(doc)
                    sizes.append(b - a + 1)
                    n += b - a + 1
                    if n >= shard_tokens:
                        yield row()
                        shard, first, n = shard + 1, first + n, 0
                        held, names, sizes = [], [], []
        if names:
            yield row()

    own = id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    ordered = own.repartitionByRange(parts(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(shards, SHARDS).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, part, shard."""
    table = spark.read.schema(SHARDS).parquet(path)
    # One total for each part: as many as the shuffle had partitions, however large the input is.
    totals = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in totals])]).tolist()
    offsets = {part: before[k] for k, (part, _) in enumerate(totals)}

    def docs(batches):
        for batch in batches:
            for part, shard, first, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "first", "blob")), strict=True):
                s = Shard(blob)
                raw = memoryview(s.decode().astype("<u4")).cast("B")
                ends = s.ends.tolist()
                begins = [0, *ends[:-1]]
                base, n = offsets[part] + first, len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s.doc_ids, pa.int64()),
                        pa.array([base + a for a in begins], pa.int64()),
                        pa.array([b - a for a, b in zip(begins, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                        pa.array([part] * n, pa.int32()),
                        pa.array([shard] * n, pa.int32()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard"],
                )

    return table.select("part", "shard", "first", "blob").mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Every place of one id, by select on each shard: part, shard, place (in the shard), doc_id."""

    def find(batches):
        for batch in batches:
            for part, shard, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "blob")), strict=True):
                s = Shard(blob)
                at = [s.select(token, k) for k in range(s.count(token))]
                doc = [s.doc_ids[i] for i in np.searchsorted(s.ends, at, "right").tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array([shard] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(doc, pa.int64())], ["part", "shard", "place", "doc_id"])

    return spark.read.schema(SHARDS).parquet(path).select("part", "shard", "blob").mapInArrow(find, "part int, shard int, place long, doc_id long")
