"""Words of Arrow text batches as 64-bit hashes, in numpy, a bounded slice of texts at a time.

Hash of a word: sum of (random 64-bit value of the byte) * BASE ** position, modulo 2 ** 64, then
mixed. Equal words have equal hashes; for different words equality has a chance of about 2 ** -64.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, np.int64).astype(_U) | _U(1)
_POW = np.cumprod(np.append(_U(1), np.full((1 << 12) - 1, BASE)))


def lean(run):
    """``run``, a function of Arrow batches, whose Python worker gives free memory back when a task ends: it lives
    on beside the executor's other work, and allocators keep what they once had."""
    @functools.wraps(run)
    def task(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)
    return task


def powers(n: int) -> np.ndarray:
    global _POW
    while len(_POW) < n:
        _POW = np.concatenate([_POW, _POW * (_POW[-1:] * BASE)])
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def texts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null is empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    n = len(array)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + n + 1]
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES, most: int = 1 << 30):
    """(first, last + 1) of runs of at most ``most`` texts and ``limit`` bytes, or one longer text."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, (b := min(b, n, a + most))
        a = b


def parts(batch: pa.RecordBatch, text: str = "text", limit: int = 2 * SLICE_BYTES):
    """A batch in slices of at most ``limit`` bytes of text, or one longer text."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    off = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    for a, b in slices(off, limit):
        yield batch.slice(a, b - a)


def _ascii_space() -> np.ndarray:
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def _letters() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return t


#: Bytes of words: all but ASCII white space; or ASCII letters and digits and all others' bytes.
NOT_SPACE, LETTERS = _ascii_space(), _letters()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTES = _BYTES[_LOWER]


def word_spans(data: np.ndarray, off: np.ndarray, kind: np.ndarray = NOT_SPACE):
    """(start, end, text number) of every word."""
    if not len(data):
        z = np.empty(0, np.int64)
        return z, z, z
    inside = kind[data]
    first = np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True  # a word never crosses into the next text
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of each word with A-Z in lower case."""
    if not len(s):
        return np.empty(0, _U)
    size = e - s
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    values = _LOWER_BYTES[data[np.repeat(s, size) + at]] * powers(int(size.max()))[at]
    return mix(np.add.reduceat(values, np.cumsum(size) - size))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (also across texts: the caller drops those)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * BASE + words[j:j + n]
    return mix(h)
