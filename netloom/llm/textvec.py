"""Vectorised text helpers that run inside Spark's Arrow tasks.

A batch of texts is one byte array with document offsets; words are (start, end) byte ranges found by a table of
separator bytes, and hashes of words or of word windows come from prefix sums of a polynomial in a 64-bit ring, so a
word of any length and a window of any width cost the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Everything below 0x80 that is neither a digit nor a letter; bytes of multi-byte characters belong to words.
NOT_ALNUM = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A) for b in range(256)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
_BLOCK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if len(_powers.get("up", ())) < n:
        n = max(n, _BLOCK + 4096)
        inverse = pow(_BASE, -1, 2**64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / 2.0**53


def as_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """A text column as (bytes, offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the number of words before it."""
    inside = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, "right")))
        low, high = starts[at], ends[to - 1]
        up, down = powers(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_TABLE[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


class WindowHasher:
    """Hashes of any run of consecutive items of an array of hashes."""

    def __init__(self, items: np.ndarray, salt: int = 0):
        up, _ = powers(len(items) + 1)
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(mix(items, salt) * up[: len(items)], out=self.sums[1:])

    def of(self, at: np.ndarray, width) -> np.ndarray:
        _, down = powers(len(self.sums))
        return mix((self.sums[at + width] - self.sums[at]) * down[at] + np.uint64(width))


def windows(word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of every window of so many words that lies in one document."""
    sizes = np.diff(word_offsets)
    counts = np.maximum(sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    first = np.cumsum(counts) - counts
    return word_offsets[doc] + np.arange(len(doc)) - first[doc], doc


def cover(at: np.ndarray, width, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the given words."""
    edge = np.bincount(at, minlength=n + 1).astype(np.int64)
    edge -= np.bincount(at + width, minlength=n + 1)[: n + 1]
    return np.cumsum(edge[:n]) > 0


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_offsets: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Each document's kept words joined by one space."""
    docs = len(word_offsets) - 1
    doc = np.repeat(np.arange(docs), np.diff(word_offsets))[keep]
    s, e = starts[keep], ends[keep]
    spaced = np.zeros(len(s), bool)
    spaced[:-1] = doc[1:] == doc[:-1]
    data = np.append(data, np.uint8(0x20))
    data[e[spaced]] = 0x20
    edge = np.zeros(len(data) + 1, np.int8)
    edge[s] += 1
    edge[e + spaced] -= 1
    out = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    sizes = np.bincount(doc, weights=(e - s) + spaced, minlength=docs).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(docs, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())).cast(pa.string())


def put_planes(x: np.ndarray, width: int) -> bytes:
    """Integers as byte planes, which the shuffle's compression shrinks where high bytes are empty."""
    raw = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width].T).tobytes()


def get_planes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").reshape(-1)
