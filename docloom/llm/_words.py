"""Whole Arrow batches of texts as flat NumPy arrays of words and word-window hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the same as runs of
code points other than those. Hashes are 64-bit polynomial hashes over randomised byte values,
finished by a mixer; they depend on content alone, so every task and retry computes the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; one longer text is handled alone.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For features: ASCII punctuation also ends words.
SPACE_OR_PUNCT = SPACE.copy()
SPACE_OR_PUNCT[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
CONTINUATION = (SAME & 0xC0) == 0x80

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_P, _Q = (int(x) | 5 for x in _rng.integers(1 << 40, 1 << 62, 2))


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand and kept for the process."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.concatenate((np.ones(1, U), np.cumprod(np.full(size - 1, U(b), U)))) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _spread(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.get(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return total, down


class Chunk:
    """Consecutive texts: buf holds their bytes, text i is buf[off[i]:off[i+1]]; first is its row in the batch.

    start, end, doc: byte range and text of each word; word_off[i]: index of the first word of text i.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int, space: np.ndarray = SPACE, fold: np.ndarray = SAME):
        self.buf, self.off, self.first, self.fold = buf, off, first, fold
        self.n = len(off) - 1
        inside = ~space[buf]
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = off[1:] > off[:-1]
        before[off[:-1][full]] = False
        after[off[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.word_off = np.searchsorted(self.start, off)
        self.counts = np.diff(self.word_off)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def word_hashes(self) -> np.ndarray:
        total, down = _spread(_BYTE[self.fold[self.buf]], _byte_powers)
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word's index and hash of every run of `size` words inside one text."""
        if len(hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[size - 1 :] == self.doc[: len(self.doc) - size + 1])
        total, down = _spread(hashes, _word_powers)
        return at, mix((total[at + size] - total[at]) * down[at] + U(size))

    def sequence_hashes(self, hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of each given text."""
        total, down = _spread(hashes, _word_powers)
        a, b = self.word_off[texts], self.word_off[texts + 1]
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(U))

    def char_counts(self) -> np.ndarray:
        """total[j] - total[i]: code points in buf[i:j]."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(~CONTINUATION[self.buf], out=total[1:])
        return total


def chunks(texts: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray = SAME, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts (null: empty) in chunks of about chunk_bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + chunk_bytes, "right")) - 1)
        to = min(to, len(texts))
        yield Chunk(data[off[at] : off[to]], off[at : to + 1] - off[at], at, space, fold)
        at = to


def grouped_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Marks of the n places that some run of `size` places starting in `at` covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + size, n), -1)
    return np.cumsum(step[:-1]) > 0


def repeated_in_text(chunk: Chunk, at: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Which of the windows (first word at[i], hash window[i]) occur twice or more in their own text."""
    twice = np.zeros(len(at), bool)
    if len(at) < 2:
        return twice
    key = mix(window ^ (chunk.doc[at].astype(U) * U(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    ordered, text = key[order], chunk.doc[at][order]
    same = (ordered[1:] == ordered[:-1]) & (text[1:] == text[:-1])
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice
