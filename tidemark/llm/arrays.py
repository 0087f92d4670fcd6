"""Texts of an Arrow batch as flat numpy arrays: bytes, word boundaries, word and shingle hashes.

The operators read texts in Arrow batches and never build one Python object per word. Null texts count as empty.
Batches are walked in slices of whole texts so that the temporary arrays stay small; a slice holds one text at least.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding what an Arrow batch of its session holds, in texts and in bytes (and one text at least).

    The bounds are read when the plan runs, so they stay set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def release() -> None:
    """Give memory that is free inside this process back to the system.

    A Python worker stays for later tasks, also while only the JVM computes, and all that it keeps counts against the
    executor's limit. Arrow's pool and the C library's heap keep freed arrays for themselves unless told otherwise.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to trim
        pass


def lean(run):
    """``run`` of mapInArrow, with ``release`` when the task's rows have been taken."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


RELEASE_BYTES = 32 << 20
_taken = 0


def lean_groups(run):
    """``run`` of applyInArrow, with ``release`` after every RELEASE_BYTES of groups."""

    @functools.wraps(run)
    def whole(first, second):  # a key and its table, or two tables
        global _taken
        out = run(first, second)
        _taken += sum(t.nbytes for t in (first, second) if isinstance(t, pa.Table))
        if _taken >= RELEASE_BYTES:
            _taken = 0
            release()
        return out

    return whole


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offset of each text (one more than there are texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = column.offset
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[at : at + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.zeros(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets) of successive groups of whole texts."""
    data, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 2**64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_BYTE = _BYTE[_LOWER]  # hashes A-Z like a-z


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Starts and ends of the words (runs of bytes outside ``gap``) and each text's first word, one more than texts."""
    inside = ~gap[data]
    edge = np.ones(len(data) + 1, bool)  # where a word may start or end whatever the neighbour is
    edge[1:-1] = False
    edge[offsets] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
    """Hash of every word without regard to ASCII case, and each text's first word."""
    starts, ends, first = word_spans(data, offsets, gap)
    return span_hashes(data, starts, ends, LOWER_BYTE), first


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle, an empty one none."""
    n = max(0, len(words) - k + 1)
    every = np.zeros(n, np.uint64)
    for j in range(k):
        every += words[j : j + n] * _SHINGLE[j]
    every = mixed(every)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= k:
            s = np.sort(every[lo : hi - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif hi > lo:
            own = (words[lo:hi] * _SHINGLE[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mixed(np.array([own], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of an Arrow column."""
    for lo, _, data, offsets in slices(column):
        words, first = word_hashes(data, offsets)
        yield from enumerate(shingles(words, first, k), lo)


def fingerprint(sorted_hashes: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set of hashes; 0 only for the empty set."""
    if not len(sorted_hashes):
        return 0
    total = mixed(sorted_hashes + np.uint64(0x1234567)).sum(dtype=np.uint64) + np.uint64(len(sorted_hashes))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0]) or 1


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end of all."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))
