"""Words of a column of texts as numpy arrays: boundaries, 64-bit word hashes, window hashes. No per-word Python.

Used inside tasks only, on Arrow batches. Texts are cut into slices of bounded bytes (a longer text is a slice of its
own), so a task holds a few times ``SLICE_BYTES`` whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

# Byte classes. Both word patterns separate on ASCII bytes only, so UTF-8 can be read byte by byte.
SPACED = np.ones(256, bool)  # [^\x20\x09-\x0D]+
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.Generator(np.random.PCG64(20240131))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_STEP, i, 1 << 64) for i in range(4096)], np.uint64)
_BASES = (0xD1342543DE82EF95, 0xA24BAED4963EE407)  # two independent window hashes
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Words of some consecutive texts. ``starts``/``ends`` are byte offsets into ``data``; ``first`` has the number of
    the first word of each text, and one more entry for the end."""

    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def windows(self, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, hash) of each run of ``size`` words inside one text."""
        total = len(self.hashes)
        if total < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        owner = self.text_of
        at = np.flatnonzero(owner[: total - size + 1] == owner[size - 1 :])
        return at, mixed(rolled(self.hashes, size, which))[at]


def rolled(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Polynomial hash of every run of ``size`` hashes, by doubling."""
    base, out, done, block, span = _BASES[which], None, 0, hashes, 1
    while True:
        if size & span:
            if out is None:
                out, done = block, span
            else:
                n = len(hashes) - done - span + 1
                out = out[:n] * np.uint64(pow(base, span, 1 << 64)) + block[done : done + n]
                done += span
        if done == size:
            return out[: len(hashes) - size + 1]
        block = block[: len(block) - span] * np.uint64(pow(base, span, 1 << 64)) + block[span:]
        span *= 2


def slices(texts: pa.Array, is_word: np.ndarray = SPACED, lower: bool = False, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes; a null text has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        data = raw[offsets[at] : offsets[end]]
        if lower:
            data = LOWER[data]
        yield _words(slice(at, end), data, offsets[at : end + 1] - offsets[at], is_word)
        at = end


def _words(rows: slice, data: np.ndarray, cuts: np.ndarray, is_word: np.ndarray) -> Slice:
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = np.unique(cuts[:-1][cuts[:-1] < len(data)])
    begins[edges] = inside[edges]  # a word ends where its text ends
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    last = np.unique(cuts[1:][cuts[1:] > 0]) - 1
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, cuts)
    if not len(starts):
        return Slice(rows, data, starts, ends, first, np.zeros(0, np.uint64))
    sizes = ends - starts
    where = np.flatnonzero(inside)
    base = np.cumsum(sizes) - sizes
    spot = np.arange(len(where)) - np.repeat(base, sizes)
    powers = _POWERS if sizes.max() <= len(_POWERS) else _grown(int(sizes.max()))
    hashes = np.add.reduceat(_BYTE[data[where]] * powers[spot], base)
    return Slice(rows, data, starts, ends, first, mixed(hashes + sizes.astype(np.uint64)))


def _grown(size: int) -> np.ndarray:
    """Powers of the step up to one very long word, by doubling."""
    out = _POWERS
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(_STEP, len(out), 1 << 64))])
    return out


def spans(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge windows of ``size`` words that start at the sorted ``at`` into (start, end) of covered stretches."""
    if not len(at):
        return at, at
    new = np.flatnonzero(np.diff(at) > size)
    return at[np.r_[0, new + 1]], at[np.r_[new, len(at) - 1]] + size


def covered(total: int, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of ``total`` words lie in a window that starts at one of ``at``."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0
