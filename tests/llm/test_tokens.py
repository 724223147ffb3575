import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from countloom.llm.bpe_table import encode_decode
from countloom.llm.packing import best_fit, pack_documents, sequences
from countloom.llm.wavelet import Shard, encode_shard, occurrences, read_documents, write_shards
from countloom.llm.wordbpe import WordEncoder, split_words, vocabulary_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_tokenizers_ids(tokenizer, texts):
    enc = WordEncoder(vocabulary_path(), most=5)
    column = pa.array([t for _, t in texts])
    for own in (column, column[7:30]):
        ids, begins = enc.texts(own)
        for k, t in enumerate(own.to_pylist()):
            assert ids[begins[k] : begins[k + 1]].tolist() == ids_of(tokenizer, t)


def test_split_matches_bytes_split(texts):
    for at in (0, 3, 50):
        own = pa.array([t for _, t in texts])[at : at + 20]
        for lower in (False, True):
            words, offsets = split_words(own, lower)
            for k, t in enumerate(own.to_pylist()):
                raw = (t or "").encode()
                assert [w.encode() for w in words[offsets[k] : offsets[k + 1]].to_pylist()] == (raw.lower() if lower else raw).split()


def test_word_table_encodes_and_decodes(docs, no_docs, texts, tokenizer):
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_decode(docs, chunk_bytes=3000).collect() if r.doc_id is not None)
    want = []
    for i, t in texts:
        if i is not None:
            ids = ids_of(tokenizer, t)
            want.append((False, i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert encode_decode(docs).where("doc_id IS NULL").count() == 2
    assert encode_decode(no_docs).count() == 0
    kept = encode_decode(docs.where("doc_id = 406"), keep=True).first()
    assert kept.ids == ids_of(tokenizer, texts[[i for i, _ in texts].index(406)][1]) and kept.decoded == tokenizer.decode(kept.ids, skip_special_tokens=False)


@pytest.mark.parametrize("n,top,block", [(0, 1, 64), (1, 1, 64), (200, 2, 64), (5000, 50000, 1024), (5000, 7, 4096)])
def test_wavelet_matrix(n, top, block):
    rng = np.random.default_rng(n + top)
    ids = (rng.zipf(1.3, n) % top).astype(np.uint32)
    ends = [n // 3, n // 3, n]
    s = Shard(encode_shard(ids, [3, None, 9], ends, block))
    assert s.decode().tolist() == ids.tolist() and s.doc_ids == [3, None, 9] and s.ends.tolist() == ends
    for i in rng.integers(0, n, 40).tolist() if n else []:
        assert s.access(i) == ids[i]
        assert s.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
    for token in {0, 1, 5, top - 1, top + 70000}:
        places = np.flatnonzero(ids == token)
        assert s.count(token) == len(places)
        for k in range(0, len(places), max(1, len(places) // 9)):
            assert s.select(token, k) == places[k]
    with pytest.raises(IndexError):
        s.access(n)


def test_shards_hold_all_documents(spark, docs, no_docs, texts, tokenizer, tmp_path):
    path = f"file://{tmp_path}/shards"
    write_shards(docs, path, end_id=1, shard_tokens=3000)
    got = read_documents(spark, path).collect()
    assert sorted(r.start for r in got) == [r.start for r in sorted(got, key=lambda r: (r.start, r.n_tokens))]
    by_start = sorted(got, key=lambda r: r.start)
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    named = [r.doc_id for r in by_start]
    assert named[:2] == [None, None] and named[2:] == sorted(named[2:])
    want = sorted((-1 if i is None else i, len(x) + 1, zlib.crc32(np.array([*x, 1], "<u4").tobytes())) for i, t in texts for x in [ids_of(tokenizer, t)])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert occurrences(spark, path, 1).count() == len(texts)
    write_shards(no_docs, path + "0")
    assert read_documents(spark, path + "0").count() == 0


def test_packing(docs, no_docs, texts, tokenizer):
    packed = pack_documents(docs, capacity=256, group=40, keep_ids=True)
    got = packed.collect()
    want = sorted((-1 if i is None else i, k, s, zlib.crc32(np.array(x[s : s + 256], "<u4").tobytes())) for i, t in texts for x in [[*ids_of(tokenizer, t), 0]] for k, s in enumerate(range(0, len(x), 256)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(by) <= 1.05 * total / 256 + 3
    joined = sequences(packed).collect()
    assert len(joined) == len(by) and sum(len(r.ids) for r in joined) == total
    assert pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 100, 700))[::-1]
    seq = best_fit(lengths, 100, 5, 10_000.0, rule=rule)
    for s in np.unique(seq):
        own = lengths[seq == s]
        assert own.sum() <= 100 and len(own) <= 5 and (own.astype(float) ** 2).sum() <= 10_000 + 1e-6
    free = best_fit(lengths, 100, 100, 10_000.0, rule=rule)
    assert len(np.unique(free)) <= 1.02 * lengths.sum() / 100 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("docs_each,cost", [(10**9, 1e18), (5, 6e5)])
def test_every_piece_goes_to_the_best_sequence(rule, docs_each, cost):
    """Against a plain simulation: of all sequences that hold the piece under every capacity, the chosen one has the least
    score; a new one is opened only where none holds it."""
    rng = np.random.default_rng(41)
    lengths = np.sort(rng.choice([1, 3, 50, 128, 256, 300, 511, 640, 777], 250))[::-1]
    caps, w = np.array([1024, docs_each, cost]), np.array([1.0, 0.1, 0.1])
    out, left = best_fit(lengths, 1024, docs_each, cost, rule=rule), []
    for length, place in zip(lengths.tolist(), out.tolist(), strict=True):
        d = np.array([length, 1.0, float(length) ** 2]) / caps
        scores = {k: float(w @ (v * d if rule == "dot" else (v - d) ** 2)) for k, v in enumerate(left) if ((v - d) >= -1e-9).all()}
        if place == len(left):
            assert not scores
            left.append(np.ones(3))
        else:
            assert scores[place] <= min(scores.values()) + 1e-12
        left[place] = left[place] - d
