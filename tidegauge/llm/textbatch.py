"""Vectorised text primitives on Arrow batches (numpy over UTF-8 bytes).

Conventions shared by the operators:

* white space is exactly the bytes ``[\\x20\\x09-\\x0D]``; being ASCII they never occur inside
  a multi-byte UTF-8 character, so splitting bytes splits characters;
* a null text is an empty text;
* a batch is worked off in slices of at most ``SLICE_BYTES`` of text (a longer text is a slice
  of its own), which bounds a Python worker's memory whatever the batch size is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 21

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)
LONG_WORD, CHUNK_WORDS = 1024, 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on a copy."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def give_back() -> None:
    """Returns freed memory to the machine: a Python worker lives on from stage to stage, and beside its executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of each text (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = pc.fill_null(texts, "")
    else:
        texts = pc.fill_null(texts.cast(pa.string()), "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) of runs of texts of at most ``most`` bytes, or of one text."""
    buf, off = flat(texts)
    n, at = len(off) - 1, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, buf[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text its first word's place (one more than texts)."""
    solid = np.zeros(len(buf) + 2, dtype=bool)
    np.logical_not(IS_SPACE[buf], out=solid[1:-1])
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[off] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a step; another seed gives independent ones."""
    lens = ends - starts
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    view = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    if seed:
        h = mix(h ^ np.uint64(seed * 0x9FB21C651E98DF25 & (1 << 64) - 1))
    for at in range(0, len(starts), CHUNK_WORDS):  # keeps the temporary arrays small
        part = slice(at, at + CHUNK_WORDS)
        own, begin, size = h[part], starts[part], lens[part]
        live, k = np.flatnonzero(size <= LONG_WORD), 0
        while live.size:
            left = size[live] - 8 * k
            piece = view[begin[live] + 8 * k] & LOW_BYTES[np.minimum(left, 8)]
            own[live] = mix(own[live] ^ piece)
            live, k = live[left > 8], k + 1
    for i in np.flatnonzero(lens > LONG_WORD):
        h[i] = np.uint64(xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), seed))
    return h


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether the ranges of equal lengths from ``a`` and from ``b`` have the same bytes, eight at a step."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    view = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out, live, k = np.ones(len(a), dtype=bool), np.flatnonzero(lens > 0), 0
    while live.size:
        left = LOW_BYTES[np.minimum(lens[live] - 8 * k, 8)]
        equal = (view[a[live] + 8 * k] & left) == (view[b[live] + 8 * k] & left)
        out[live[~equal]] = False
        live, k = live[equal & (lens[live] - 8 * k > 8)], k + 1
    return out


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n consecutive words from each place; the last n - 1 places have none."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0xA24BAED4963EE407) + h[k : len(h) - n + 1 + k]
    return mix(out)


def code_points(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of code points of each text."""
    seen = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=seen[1:])
    return seen[off[1:]] - seen[off[:-1]]


#: Everything but ASCII letters, digits, apostrophes and the bytes of longer characters.
IS_BREAK = np.ones(256, dtype=bool)
IS_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = False


def runs(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``words``, for any mask of the bytes that belong to words."""
    padded = np.zeros(len(solid) + 2, dtype=bool)
    padded[1:-1] = solid
    cut = np.zeros(len(solid) + 1, dtype=bool)
    cut[off] = True
    starts = np.flatnonzero(solid & (~padded[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid & (~padded[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)
