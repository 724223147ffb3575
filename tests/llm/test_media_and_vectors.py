import hashlib
import struct
import zlib

import numpy as np
import pytest

from countloom.llm import avi, vptree


def test_texts_come_back_from_the_media(docs, no_docs, texts):
    got = avi.store_texts(docs, keep_media=True).collect()
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((-1 if i is None else i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    same: dict = {}
    for r in got:
        assert same.setdefault(r.payload_sha256, (r.feature, r.media_sha256)) == (r.feature, r.media_sha256)
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert avi.store_texts(no_docs).count() == 0


def test_any_decoder_sees_the_samples():
    """The general decoder, which knows nothing of the fixed places, finds each byte as a flat block of 64 pixels."""
    payload = np.frombuffer(bytes(range(192)) + bytes([0, 255] * 96), np.uint8)
    media = avi.write_avi(avi.scans(payload))
    frames, micros = avi.read_avi(media)
    assert len(frames) == 2 and micros == 40_000
    for k, f in enumerate(frames):
        blocks = avi.decode_jpeg(f).reshape(avi.HIGH, 8, avi.WIDE, 8)
        own = payload[192 * k : 192 * k + 192].reshape(avi.HIGH, avi.WIDE)
        assert (blocks == own[:, None, :, None]).all()
    assert (avi.samples([avi.scan_of(f) for f in frames]).reshape(-1) == payload).all()


def test_code_table_is_complete():
    assert sorted(avi.DC_BITS.tolist()) == sorted(set(avi.DC_BITS.tolist())) and all(avi.DC_BACK[avi.DC_BITS[d + 255]] == d for d in range(-255, 256))


def colour_jpeg():
    """A 16 x 16 baseline colour JPEG, 2 x 2 subsampled, with AC values and restart marks, written bit by bit."""
    bits = ""
    codes = {0: "00", 3: "01", 5: "10"}  # DC sizes
    ac = {0x00: "00", 0x02: "01", 0x11: "10"}

    def block(dc, cells):
        size = abs(dc).bit_length()
        out = codes[{0: 0, 3: 3, 5: 5}[size]]
        if size:
            out += format(dc if dc > 0 else dc + (1 << size) - 1, f"0{size}b")
        for run_size, v in cells:
            s = run_size & 15
            out += ac[run_size] + format(v if v > 0 else v + (1 << s) - 1, f"0{s}b")
        return out + ac[0]

    for dc, cells in ((20, [(0x02, 3)]), (5, []), (0, [(0x11, -1)]), (-5, []), (0, []), (0, [])):
        bits += block(dc, cells)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = avi.segment
    frame = struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    dht = lambda kind, values: bytes([kind]) + bytes([0, len(values)] + [0] * 14) + bytes(values)
    return b"\xff\xd8" + seg(0xDB, bytes([0] + [2] * 64)) + seg(0xC0, frame) + seg(0xC4, dht(0x00, [0, 3, 5]) + dht(0x10, [0x00, 0x02, 0x11])) + seg(0xDD, struct.pack(">H", 1)) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_general_decoder_follows_the_standard():
    got = avi.decode_jpeg(colour_jpeg())
    want = np.zeros((16, 16))
    x = np.arange(8)
    for k, (dc, at, v) in enumerate(((20, (0, 1), 3), (25, None, 0), (25, (1, 0), -1), (20, None, 0))):
        block = np.full((8, 8), dc * 2 / 8)
        if at:
            wave = np.cos((2 * x + 1) * np.pi / 16) * v * 2 / 4 / np.sqrt(2)
            block = block + (wave[None, :] if at == (0, 1) else wave[:, None])
        want[8 * (k // 2) : 8 * (k // 2) + 8, 8 * (k % 2) : 8 * (k % 2) + 8] = block
    assert np.abs(got - np.clip(want + 128, 0, 255)).max() <= 0.51


def test_shots_and_clip_rows(spark):
    dark, light = np.full((10, 192), 20, np.uint8), np.full((6, 192), 220, np.uint8)
    media = avi.write_avi(avi.scans(np.concatenate([dark, light, dark]).reshape(-1)))
    rows = avi.clips_of(media)
    assert [r[1:3] for r in rows] == [(0, 10), (10, 6), (16, 10)] and rows[1][3:] == (400_000, 640_000, 220)
    df = spark.createDataFrame([(1, media), (2, None), (3, b"RIFFnothing"), (4, avi.write_avi([])), (None, media)], "doc_id long, media binary")
    got = avi.clips(df).collect()
    assert sorted((str(r.id), r.clip) for r in got if not r.error) == sorted([("1", k) for k in range(3)] + [("None", k) for k in range(3)])
    assert [r.id for r in got if r.error] == [3]
    with pytest.raises(ValueError):
        avi.decode_jpeg(b"\xff\xd8\xff\xc2")


def brute(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            near = sorted(((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i) for i, w in ok if i != q and len(w) == len(v)))[:k]
            out[q] = [i for _, i in near]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(700)]
    rows += [(700 + k, rows[3][1]) for k in range(150)]  # ties
    rows += [(900, None), (950, [0.0] * 8), (951, [1.0] + [None] * 7), (952, [float("nan")] * 8), (953, [float("inf")] * 8), (954, []), (None, rows[0][1]), (1000, [1.0, 2.0]), (1001, [2.0, 4.1]), (10, rows[10][1])]
    return rows, spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, dim int, block int")


def test_exact_search_matches_brute_force(vectors):
    rows, df = vectors
    got: dict = {}
    for r in vptree.neighbours(df, every=10, k=5, shard_rows=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(rows[:-1], 10, 5)
    assert got == want
    assert vptree.neighbours(df.limit(0)).count() == 0


def test_repeated_rows_take_no_places(spark):
    near = [(1, [1.0, 0.1])] * 9 + [(2, [1.0, 0.2])] * 7
    far = [(k, [1.0, float(k)]) for k in range(3, 9)]
    df = spark.createDataFrame([(0, [1.0, 0.0]), *near, *far], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in vptree.neighbours(df, every=50, k=5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    wide = df.select("vec_id", df.embedding.cast("array<double>").alias("embedding"))
    assert [(r.rank, r.vec_id) for r in vptree.neighbours(wide, every=50, k=5).orderBy("rank").collect()] == got


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324 * 2**60])
def test_very_large_and_small_components(spark, size):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=6)) for k in range(60)]
    want = brute([(i, v.tolist()) for i, v in rows], 10, 5)
    df = spark.createDataFrame([(i, (v * (size if i % 2 else 1.0)).tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in vptree.neighbours(df, every=10, k=5, shard_rows=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        v, w = rows[r.query_id][1], rows[r.vec_id][1]
        assert abs(r.score - v @ w / np.sqrt((v @ v) * (w @ w))) < (1e-9 if size != 5e-324 * 2**60 else 1e-6)
    assert got == want
    assert np.array_equal(vptree.scaled(np.array([[3.0, -0.1]])), np.array([[0.75, -0.025]]))


def test_relaxed_search_keeps_recall(vectors):
    rows, df = vectors
    want = brute(rows[:-1], 10, 5)
    got = {(r.query_id, r.vec_id) for r in vptree.neighbours(df, every=10, k=5, factor=1.3, shard_rows=400).collect()}
    assert np.mean([(q, i) in got for q, near in want.items() for i in near]) >= 0.9
    with pytest.raises(ValueError):
        vptree.search(df, df, factor=0.5)
