"""Vectorised text kernels for Arrow batches: words, hashes and shingles by byte, without Python strings.

All byte classes used here are ASCII classes, so a UTF-8 text splits the same by byte as by character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Odd multipliers of the word hash.
BASE, STEP = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Longer words are hashed one by one.
LONG_WORD = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are not white space: ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of an Arrow batch that Spark hands to a Python worker, so that long texts don't fill its memory.
BATCH_BYTES = 6 << 20


def bounded(df: DataFrame) -> DataFrame:
    """The frame itself, after its session got BATCH_BYTES as limit, unless it has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``most`` bytes of text each; one longer text makes a part alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = column_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``kind`` bytes within rows, and each row's first word (n + 1)."""
    inside = kind[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the byte strings ``data[start:end]``, eight bytes at a time; ``fold`` lower-cases A-Z."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = LOWER[data] if fold else data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        live, at = np.arange(len(starts)), 0
        while len(live):
            left = size[live] - at
            part = eight[starts[live] + at]
            short = left < 8
            part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            h = out[live]
            out[live] = ((h ^ (h >> np.uint64(32))) * np.uint64(BASE)) ^ ((part ^ (part >> np.uint64(29))) * np.uint64(STEP))
            at += 8
            live = live[left > 8] if at < LONG_WORD else live[:0]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def word_hash(word: str) -> int:
    """The hash that ``hashes`` gives this word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingles(hashed: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within rows, and each row's first run (rows + 1).

    A row of fewer words, but not none, has its whole sequence as one run.
    """
    counts = np.diff(first)
    each = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(each, out=begin[1:])
    row = np.repeat(np.arange(len(counts)), each)
    at = np.arange(begin[-1]) - begin[row] + first[row]
    size = np.minimum(counts[row], n)
    total = size.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            ok = size > i
            step = hashed[np.minimum(at + i, max(len(hashed) - 1, 0))] if len(hashed) else np.zeros(0, np.uint64)
            total = np.where(ok, (total ^ (total >> np.uint64(29))) * np.uint64(BASE) + step, total)
    return mix(total), begin
