"""Whole texts to ids of a word-level BPE tokenizer, each distinct word of a batch once.

The tokenizer drops white space and never joins characters across it, so the ids of a text are the ids of its
white-space-separated words in order. ASCII white space is split here; all else inside a word is left to the
tokenizers library.
"""

from __future__ import annotations

import ctypes
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of only these letters, followed by only these marks, pre-tokenize into the letters and the marks: none of
#: them changes under NFC, and each lower-cases to one letter.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes words with the tokenizers library. Remembers at most ``most`` plain word bodies at a time."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.most = path, most
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.bodies: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        with open(path) as f:
            spec = json.load(f)
        plain = spec["model"]["type"] == "BPE" and (spec["normalizer"] or {}).get("type") == "Sequence" and spec["model"]["end_of_word_suffix"] == "</w>"
        self.plain = PLAIN.fullmatch if plain else lambda _: None

    def slow(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one word, as little-endian unsigned 32-bit integers."""
        m = self.plain(word)
        if m is None:
            return self.slow(word)
        body, marks = m.groups()
        body = body.lower()
        ids = self.bodies.get(body)
        if ids is None:
            if len(self.bodies) >= self.most:
                self.bodies.clear()
            spelled = body.encode().decode("latin-1").translate(self.letters)
            ids = self.bodies[body] = np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
        if marks:
            if marks not in self.marks:
                if len(self.marks) >= self.most:
                    self.marks.clear()
                    self.marks[""] = b""
                self.marks[marks] = self.slow(marks)
            ids += self.marks[marks]
        return ids

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), one after the other, and where each text begins (one place more than texts)."""
        words, offsets = split_words(texts)
        coded = words.dictionary_encode()
        found = [self.word(w) for w in coded.dictionary.to_pylist()]
        held = np.frombuffer(b"".join(found), "<u4")
        ids, ends = laid_out(held, np.fromiter(map(len, found), np.int64, len(found)) // 4, coded.indices.to_numpy(zero_copy_only=False))
        return ids, np.concatenate([[0], ends])[offsets]


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts between ASCII white space, and the place of each text's first word (one place more than
    texts). ``lower``: A-Z lower-cased first."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.offset:  # some string kernels read a slice from its parent's start
        texts = pa.concat_arrays([texts, texts[:0]])
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace((pc.ascii_lower(texts) if lower else texts).cast(pa.large_string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words, offsets = lists.flatten(), offsets - offsets[0]
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not some.all():  # white space at a text's ends leaves empty words
        words, offsets = words.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[offsets]
    return words, offsets


def laid_out(held: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``held`` that ``picks`` names, one after the other, and where each ends."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    size = lengths[picks] if len(lengths) else np.zeros(len(picks), np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return held[:0], ends
    return held[np.arange(total) - np.repeat(ends - size - starts[picks], size)], ends


_HELD: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = WordEncoder(path)
    return _HELD[path]


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20):
    """The batch in runs of rows with about equally many bytes of text, ``most`` at most (one row at least)."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between runs; a worker lives long
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    most = -(-int(ends[-1]) // max(1, -(-int(ends[-1]) // most))) if len(ends) else most
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        trim()
        at = stop


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)
