"""Vectorised text primitives over Arrow string columns.

Everything here works on the UTF-8 bytes of a whole column at once, in bounded
slices, so that word splitting and hashing cost a few NumPy passes per byte
instead of a Python object per word. Words are maximal runs of bytes other than
ASCII white space (0x20, 0x09-0x0D), which equals ``[^\\x20\\x09-\\x0D]+`` over
code points because UTF-8 continuation bytes are never ASCII.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_HASH_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


def release_memory() -> None:
    """Hand freed memory back to the system; a reused worker otherwise keeps its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Zero-copy row ranges of a batch of about ``limit`` text bytes, of 1 to ``rows`` rows."""
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, min(start + rows, int(np.searchsorted(at, at[start] + limit, "right")) - 1))
        yield batch.slice(start, end - start)
        start = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _LOWER[data]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the offsets of each document's words among them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(n + 1, bool)
    first[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at, "left")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands.

    A polynomial over random byte values, taken from prefix sums modulo 2**64 and
    shifted back by the inverse power, then finalised together with the length.
    Spans must be in order; they are hashed in runs of about a megabyte.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _HASH_BYTES, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        powers = np.full(high - low + 1, _MULTIPLIER, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        prefix = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * powers[:-1], out=prefix[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        back = np.full(high - low + 1, _INVERSE, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        out[i:j] = mix((prefix[e] - prefix[s]) * back[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def windows(hashes: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a document, and each document's offsets.

    A document of fewer words, but one at least, gives its whole sequence as one run.
    """
    counts = np.diff(of)
    n_runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(n_runs)])
    doc = np.repeat(np.arange(len(counts)), n_runs)
    first = of[doc] + (np.arange(out_at[-1]) - out_at[doc])
    length = np.minimum(size, counts[doc])
    run = np.zeros(len(first), np.uint64)
    for k in range(size):
        live = k < length
        nxt = mix(run * np.uint64(3) + hashes[np.where(live, first + k, first)] + np.uint64(k + 1))
        run = np.where(live, nxt, run)
    return run, out_at
