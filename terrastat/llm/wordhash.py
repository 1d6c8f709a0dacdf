"""Words of Arrow string columns and their 64-bit hashes, in numpy over whole chunks of text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

CHUNK_BYTES, WIDE_BYTES = 512 << 10, 2 << 20  # text handled at once; the wide one where words that repeat in a chunk save work
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _UNBASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORDLESS = np.zeros(256, bool)
WORDLESS[:128] = [not chr(i).isalnum() for i in range(128)]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def frugal(run: Callable) -> Callable:
    """``run`` over Arrow batches, which hands back what it has freed when it ends: a worker lives on for other stages,
    and Arrow's pool and the C library keep freed memory for it otherwise."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return wrapped


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else _UNBASE
        have = np.empty(max(n, CHUNK_BYTES + 1), np.uint64)
        have[0], have[1:] = 1, base
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash (splitmix64's output function)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, factors): the hash of bytes a to b is mix((sums[b] - sums[a]) * factors[a])."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power("up", len(data)), out=sums[1:])
    return sums, _power("down", len(data) + 1)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal spans have equal hashes wherever they stand."""
    sums, down = running(data)
    return mix((sums[end] - sums[start]) * down[start])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last + 1) runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


class Words:
    """Words of a run of texts, A-Z lower-cased: ``start``/``end`` bytes, ``hash``, and ``first``, the
    index of each text's first word (one more entry closes the last text)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.bytes = LOWER[data]
        n = len(data)
        inside = ~separators[self.bytes]
        opens, shuts = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        shuts[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        opens[edges] = inside[edges]
        shuts[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = hash_spans(self.bytes, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def words_by_chunk(texts: pa.Array, separators: np.ndarray = SPACE, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) for consecutive runs of rows."""
    data, offsets = text_bytes(texts)
    for a, b in chunks(offsets, most):
        part = offsets[a : b + 1]
        yield a, b, Words(data[part[0] : part[-1]], part - part[0], separators)
