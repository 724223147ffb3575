"""Motion-JPEG in AVI: writing, reading, decoding and finding shots, as a media column.

Any AVI with baseline grey or colour JPEG frames can be parsed and decoded. For lossless storage of bytes the writer
uses frames in which each byte is one flat 8 x 8 block: with a DC quantiser of 8, a DC level of v - 128 decodes to
sample v in all 64 pixels, exactly, in any decoder. Its Huffman table gives the DC size s a code of 9 - s bits, so a
difference always takes 9 bits and a block 10 with its end mark; fixed places let whole frames be coded and decoded
as arrays. Other tables go through the general decoder, symbol by symbol.

Shots: a frame's 16-bin grey histogram differs from the one before by the L1 distance; a cut is a difference above
the mean of the shot so far by ``spread`` mean absolute deviations and above ``floor``, all in integers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from countloom.llm.common import id_and_text
from countloom.llm.wordbpe import slices

WIDE, HIGH, RATE = 16, 12, 25  # blocks across, blocks down, frames a second
FRAME = WIDE * HIGH
BINS = 16

# ---------------------------------------------------------------- JPEG


def dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """The 9 bits of each difference from -255 to 255, and the difference of each 9 bits."""
    bits, back = np.zeros(511, np.uint16), np.full(512, 32767, np.int16)
    code, length = 0, 1
    for size in range(8, -1, -1):  # canonical codes, the shortest for the largest size
        for low in range(1 << size):
            if size == 0:
                d = 0
            else:
                d = low if low >> (size - 1) else low - (1 << size) + 1
            word = code << size | low
            bits[d + 255], back[word] = word, d
        code, length = (code + 1) << 1, length + 1
    return bits, back


DC_BITS, DC_BACK = dc_codes()


def segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def jpeg_head() -> bytes:
    quant = bytes([0]) + bytes([8]) + bytes([1] * 63)
    frame = struct.pack(">BHHB", 8, HIGH * 8, WIDE * 8, 1) + bytes([1, 0x11, 0])
    dc = bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0])
    return b"\xff\xd8" + segment(0xDB, quant) + segment(0xC0, frame) + segment(0xC4, dc) + segment(0xC4, ac) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


HEAD = jpeg_head()


def scans(payload: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each frame of FRAME samples."""
    rows = payload.reshape(-1, FRAME).astype(np.int16)
    diff = np.diff(rows, axis=1, prepend=np.int16(128))
    words = (DC_BITS[diff + 255].astype(np.uint64) << np.uint64(1)).reshape(len(rows), FRAME // 4, 4)  # 9 bits, then the end mark 0
    five = words[:, :, 0] << np.uint64(30) | words[:, :, 1] << np.uint64(20) | words[:, :, 2] << np.uint64(10) | words[:, :, 3]
    out = np.ascontiguousarray(five.astype(">u8")).view(np.uint8).reshape(len(rows), FRAME // 4, 8)[:, :, 3:].tobytes()
    size = FRAME // 4 * 5
    return [out[k : k + size].replace(b"\xff", b"\xff\x00") for k in range(0, len(out), size)]


def samples(bodies: list[bytes]) -> np.ndarray:
    """Back from the scans of such frames: one row of samples a frame."""
    raw = np.frombuffer(b"".join(b.replace(b"\xff\x00", b"\xff") for b in bodies), np.uint8).reshape(len(bodies), FRAME // 4, 5).astype(np.uint64)
    five = raw[:, :, 0] << np.uint64(32) | raw[:, :, 1] << np.uint64(24) | raw[:, :, 2] << np.uint64(16) | raw[:, :, 3] << np.uint64(8) | raw[:, :, 4]
    words = np.stack([five >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=2).reshape(len(bodies), FRAME).astype(np.int32)
    level = np.cumsum(DC_BACK[words >> 1].astype(np.int32), axis=1)
    value = level + 128
    if (words & 1).any() or value.min(initial=0) < 0 or value.max(initial=0) > 255:
        raise ValueError("damaged frame")
    return value.astype(np.uint8)


ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
COS = np.array([[(0.5 if u else np.sqrt(0.125)) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])


def decode_jpeg(data: bytes) -> np.ndarray:
    """The grey (luma) picture of a baseline JPEG. Raises ValueError for other or damaged ones."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, tables, comps, size, restart = 2, {}, {}, [], None, 0
    try:
        while True:
            mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if mark == 0xDB:
                while body:
                    wide = body[0] >> 4
                    q = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                    quant[body[0] & 15], body = q, body[65 + 64 * wide :]
            elif mark == 0xC4:
                while body:
                    counts, codes, code, k = body[1:17], {}, 0, 17
                    for length, c in enumerate(counts, 1):
                        for _ in range(c):
                            codes[length, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    tables[body[0]], body = codes, body[k:]
            elif mark in (0xC0, 0xC1):
                size = struct.unpack_from(">HH", body, 1)
                comps = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(body[5])]
            elif 0xC2 <= mark <= 0xCF:
                raise ValueError("not a baseline JPEG")
            elif mark == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif mark == 0xDA:
                for k in range(body[0]):
                    for c in comps:
                        if c[0] == body[1 + 2 * k]:
                            c[4:] = [body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15]
                break
        return scan_picture(data[at:], size, comps, quant, tables, restart)
    except (IndexError, KeyError, struct.error, TypeError, StopIteration) as e:
        raise ValueError("damaged JPEG") from e


def scan_picture(scan: bytes, size, comps, quant, tables, restart: int) -> np.ndarray:
    pieces, k, begin = [], 0, 0
    while k < len(scan) - 1:  # split at restart marks, end at any other
        if scan[k] == 0xFF and scan[k + 1]:
            pieces.append(scan[begin:k])
            if not 0xD0 <= scan[k + 1] <= 0xD7:
                break
            begin = k + 2
        k += 1 + (scan[k] == 0xFF)
    else:
        pieces.append(scan[begin:])
    high, wide = size
    if len(comps) == 1:
        comps[0][1] = comps[0][2] = 1
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    across, down = -(-wide // (8 * hmax)), -(-high // (8 * vmax))
    luma = comps[0]
    plane = np.zeros((down * luma[2] * 8, across * luma[1] * 8))
    bits: list = []

    def refill(piece: bytes):
        raw = np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8)
        bits[:] = [np.unpackbits(raw).tolist(), 0]

    def take(n: int) -> int:
        v = 0
        for b in bits[0][bits[1] : bits[1] + n]:
            v = v << 1 | b
        if bits[1] + n > len(bits[0]):
            raise IndexError
        bits[1] += n
        return v

    def symbol(codes) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise KeyError

    def value(n: int) -> int:
        v = take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    feed = iter(pieces)
    last = [0] * len(comps)
    for mcu in range(across * down):
        if mcu == 0 or restart and mcu % restart == 0:
            refill(next(feed))
            last = [0] * len(comps)
        for ci, (_, h, v, q, dc, ac) in enumerate(comps):
            for by in range(v):
                for bx in range(h):
                    block = np.zeros(64)
                    last[ci] += value(symbol(tables[dc]))
                    block[0] = last[ci]
                    k = 1
                    while k < 64:
                        s = symbol(tables[16 + ac])
                        if s == 0:
                            break
                        k += s >> 4
                        if s & 15:
                            block[k] = value(s & 15)
                        k += 1
                    if ci == 0:
                        freq = np.zeros(64)
                        freq[ZIGZAG] = block * quant[q]
                        y, x = (mcu // across * v + by) * 8, (mcu % across * h + bx) * 8
                        plane[y : y + 8, x : x + 8] = COS @ freq.reshape(8, 8) @ COS.T
    return np.clip(np.rint(plane[:high, :wide] + 128), 0, 255).astype(np.uint8)


# ---------------------------------------------------------------- RIFF


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def riff_list(kind: bytes, body: bytes) -> bytes:
    return chunk(b"LIST", kind + body)


def write_avi(bodies: list[bytes]) -> bytes:
    """An AVI of such frames, with an index."""
    n = len(bodies)
    frames = [HEAD + b + b"\xff\xd9" for b in bodies]
    most = max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, WIDE * 8, HIGH * 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDE * 8, HIGH * 8)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDE * 8, HIGH * 8, 1, 24, b"MJPG", WIDE * HIGH * 192, 0, 0, 0, 0)
    head = riff_list(b"hdrl", chunk(b"avih", main) + riff_list(b"strl", chunk(b"strh", stream) + chunk(b"strf", form)))
    body, index, at = [], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        body.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return chunk(b"RIFF", b"AVI " + head + riff_list(b"movi", b"".join(body)) + chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[list[bytes], int]:
    """The frames named by the index (without one, all video chunks) and the microseconds a frame. ValueError if damaged."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    movi, index, micros, todo = None, None, 1_000_000 // RATE, [(12, len(data))]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end:
            name, (n,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
            if at + 8 + n > len(data):
                raise ValueError("damaged AVI")
            if name == b"LIST":
                if data[at + 8 : at + 12] == b"movi":
                    movi = (at + 8, at + 8 + n)
                else:
                    todo.append((at + 12, at + 8 + n))
            elif name == b"avih":
                (micros,) = struct.unpack_from("<I", data, at + 8)
            elif name == b"idx1":
                index = np.frombuffer(data, "<u4", n // 16 * 4, at + 8).reshape(-1, 4)
            at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("damaged AVI")
    frames, video = [], {struct.unpack("<I", x)[0] for x in (b"00dc", b"00db")}
    if index is not None:
        for name, _, at, n in index.tolist():
            if name in video:
                begin = movi[0] + at + 8  # places count from the list's kind; some writers count from the file's start
                if data[begin - 8 : begin - 4] not in (b"00dc", b"00db"):
                    begin = at + 8
                frames.append(data[begin : begin + n])
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            (n,) = struct.unpack_from("<I", data, at + 4)
            if data[at : at + 4] in (b"00dc", b"00db"):
                frames.append(data[at + 8 : at + 8 + n])
            at += 8 + n + (n & 1)
    return frames, micros


def scan_of(frame: bytes) -> bytes | None:
    """The scan of a frame with this writer's head, else None."""
    return frame[len(HEAD) : -2] if frame.startswith(HEAD) and frame.endswith(b"\xff\xd9") else None


# ---------------------------------------------------------------- shots


def cuts(hist: np.ndarray, total: int, spread: int = 3, floor: int = 4) -> list[int]:
    """The first frames of all shots but the first. ``floor``: the least difference, in eighths of the pixels."""
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1).tolist()
    found, seen, gone, apart = [], 0, 0, 0
    for k, d in enumerate(diff, 1):
        if seen and d * seen > gone + spread * apart and 8 * d > floor * total:
            found.append(k)
            seen = gone = apart = 0
            continue
        seen, gone = seen + 1, gone + d
        apart += abs(d * seen - gone) // seen
    return found


def histograms(frames: np.ndarray) -> np.ndarray:
    """A 16-bin histogram of each row."""
    n = len(frames)
    at = (np.arange(n) * BINS)[:, None] + (frames >> 4)
    return np.bincount(at.reshape(-1), minlength=n * BINS).reshape(n, BINS)


def pictures(frames: list[bytes]) -> list[np.ndarray]:
    """The grey samples of each frame: one a block for this writer's frames, else every pixel."""
    bodies = [scan_of(f) for f in frames]
    fast = [b for b in bodies if b is not None]
    rows = iter(samples(fast) if fast else ())
    return [decode_jpeg(f).reshape(-1) if b is None else next(rows) for f, b in zip(frames, bodies, strict=True)]


def clips_of(data: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """The shots of an AVI: clip, first frame, frames, begin and end in microseconds, mean grey."""
    frames, micros = read_avi(data)
    seen = pictures(frames)
    if not seen:
        return []
    same = len({len(p) for p in seen}) == 1
    hist = histograms(np.stack(seen)) if same else np.stack([histograms(p[None])[0] for p in seen])
    at = [0, *cuts(hist, len(seen[0])), len(seen)]
    return [(k, a, b - a, a * micros, b * micros, int(sum(int(p.sum()) for p in seen[a:b]) // sum(map(len, seen[a:b])))) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]


def clips(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of a column of AVI files: id, clip, first_frame, n_frames, begin_us, end_us, mean_grey, error.

    A null file gives no row; one that can't be read gives one row with nulls and the error.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    rows += [(name, *c, None) for c in clips_of(data)]
                except ValueError as e:
                    rows.append((name, *[None] * 6, str(e)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            names = ["id", "clip", "first_frame", "n_frames", "begin_us", "end_us", "mean_grey", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    kept = media.selectExpr(f"cast(`{id_col}` as bigint) AS id", f"`{media_col}` AS media")
    return kept.mapInArrow(run, "id long, clip int, first_frame long, n_frames long, begin_us long, end_us long, mean_grey int, error string")


# ---------------------------------------------------------------- texts


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text (null: empty) stored as an AVI, read back and measured.

    The text's UTF-8 bytes, with spaces up to a positive multiple of FRAME, are the samples of its frames. Returns
    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_frames, n_clips
    (and media). All but n_bytes, which the index can't tell from padding, come from the file as read back.
    """

    def run(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_clips"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                padded = [r + b" " * (-len(r) % FRAME if r else FRAME) for r in raw]
                coded = scans(np.frombuffer(b"".join(padded), np.uint8))
                media, at = [], 0
                for p in padded:
                    n = len(p) // FRAME
                    media.append(write_avi(coded[at : at + n]))
                    at += n
                # From here on only what the files hold.
                back = [[scan_of(f) for f in read_avi(m)[0]] for m in media]
                rows = samples([b for frames in back for b in frames])
                hist = histograms(rows)
                grey = rows.sum(axis=1, dtype=np.int64)
                cols: list[list] = [[] for _ in names]
                at = 0
                for doc, r, m, frames in zip(part.column("doc_id").to_pylist(), raw, media, back, strict=True):
                    n = len(frames)
                    own = rows[at : at + n].tobytes()
                    shots = [0, *cuts(hist[at : at + n], FRAME), n]
                    mean = np.add.reduceat(grey[at : at + n], shots[:-1]) // (np.diff(shots) * FRAME)
                    feature = f"{n}@{RATE};" + ",".join(f"{a}+{b - a}:{g}" for a, b, g in zip(shots[:-1], shots[1:], mean.tolist(), strict=True))
                    at += n
                    values = (doc, len(r), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, n, len(shots) - 1)
                    for held, v in zip(cols, values, strict=True):
                        held.append(v)
                arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(media, pa.binary())] * keep_media, names + ["media"] * keep_media)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_clips long"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema + (", media binary" if keep_media else ""))
