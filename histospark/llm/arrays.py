"""Vectorised text helpers for Arrow batches: words, 64-bit hashes, shingles.

All functions work on the byte buffer of a whole Arrow string column, so the
cost per word is a few numpy passes instead of Python objects. Hashes are
64-bit multilinear sums with a final mix; they depend on the bytes only and
are the same in every process.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def release() -> None:
    """Give memory that the allocators of this worker keep back to the system;
    workers serve many tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def task(run):
    """``run`` (batches in, batches out) that gives its memory back when its
    task ends, in whatever way."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_BYTE = stream(256, 11)
_PLACE = [stream(256, 23)]


def _places(n: int) -> np.ndarray:
    if n > len(_PLACE[0]):
        _PLACE[0] = stream(1 << (n - 1).bit_length(), 23)
    return _PLACE[0]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, ends, data = col.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of text (or one row)."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside`` true, none across two texts:
    (start, length, index of the text)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return start, end - start, doc


def run_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes."""
    if len(start) == 0:
        return np.zeros(0, U)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    at = place + np.repeat(start, length)
    terms = _BYTE[data[at]] * _places(int(length.max()))[place]
    return mix(np.add.reduceat(terms, first) + length.astype(U) * U(0xD6E8FEB86659FD93))


def words(col: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """(hash of each word, index of its text, number of texts)."""
    data, offsets = text_buffer(col)
    if lower:
        data = LOWER[data]
    start, length, doc = runs(data, offsets, ~IS_BLANK[data])
    return run_hashes(data, start, length), doc, len(offsets) - 1


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of ``n`` neighbouring words of one text:
    (hash, index of the text, index of the first word)."""
    if len(h) < n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z
    keys = stream(n, 37)
    m = len(h) - n + 1
    s = np.zeros(m, U)
    for i in range(n):
        s += h[i : i + m] * keys[i]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(s[at]), doc[at], at


def bounds(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs + 1 offsets of the sorted text index ``doc``."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def shingle_sets(col: pa.Array, n: int, lower: bool) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``n``-word windows; the
    whole word sequence as one shingle where there are fewer words; empty
    without words."""
    h, doc, docs = words(col, lower)
    at = bounds(doc, docs)
    counts = np.diff(at)
    s, sdoc, _ = windows(h, doc, n)
    cut = bounds(sdoc, docs)
    out = []
    for i in range(docs):
        if counts[i] >= n:
            out.append(np.unique(s[cut[i] : cut[i + 1]]))
        elif counts[i]:
            part = h[at[i] : at[i + 1]]
            out.append(mix((part * stream(len(part), 41)).sum(dtype=U, keepdims=True) + U(counts[i])))
        else:
            out.append(np.zeros(0, U))
    return out
