"""Vectorised word handling over Arrow string columns, for use inside Spark tasks.

A word is a run of bytes outside {0x20, 0x09-0x0D}; in UTF-8 that equals the
regular expression ``[^\\x20\\x09-\\x0D]+`` over code points. A null text has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits; a bijection."""
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """The words of a column of texts: byte spans, and where each text's words begin."""

    bytes: np.ndarray  # the texts' bytes, eight zero bytes after them
    text_at: np.ndarray  # byte offset of each text, and the end
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def left(self) -> np.ndarray:
        """How many words of the same text begin at each word or after it."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.bytes, self.start, self.end)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, padded by eight, and the offsets of each text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.concatenate([held, np.zeros(8, np.uint8)]), offsets - offsets[0]


def split(column: pa.Array | pa.ChunkedArray, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Words:
    """Words of every text; ``lower`` turns A-Z into a-z first, ``separator`` tells the bytes between words."""
    held, at = utf8(column)
    if lower:
        held = LOWER[held]
    inside = ~separator[held[:-8]]
    size = len(inside)
    before = np.zeros(size, bool)
    after = np.zeros(size, bool)
    if size:
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < size]] = False
        after[:-1] = inside[1:]
        after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(held, at, start, end, np.searchsorted(start, at))


def span_hashes(held: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time; ``held`` is padded by eight."""
    eight = np.ndarray((len(held) - 7,), "<u8", held, 0, (1,))
    length = end - start
    hashes = mix(length.astype(np.uint64) + np.uint64(1))
    hashes = mix(hashes ^ (eight[start] & _TAIL[np.minimum(length, 8)]))
    going, at = np.flatnonzero(length > 8), 8
    while len(going):
        rest = length[going] - at
        hashes[going] = mix(hashes[going] ^ (eight[start[going] + at] & _TAIL[np.minimum(rest, 8)]))
        going, at = going[rest > 8], at + 8
    return hashes


def window_sums(hashes: np.ndarray, length: int, base: int = 0) -> np.ndarray:
    """Polynomial of the ``length`` hashes from each position on; runs past a text's end are the caller's to drop."""
    padded = np.concatenate([hashes, np.zeros(length, np.uint64)])
    out = np.zeros(len(hashes), np.uint64)
    for k in range(length):
        out *= _BASES[base]
        out += padded[k : k + len(hashes)]
    return out


def widen(sums: np.ndarray, length: int, wider: int, hashes: np.ndarray, base: int = 0) -> np.ndarray:
    """From windows of ``length`` to windows of ``wider``, at most twice as long."""
    extra = wider - length
    power = np.uint64(pow(int(_BASES[base]), extra, 2**64))
    tail = window_sums(hashes, extra, base) if extra != length else sums
    shifted = np.concatenate([tail, np.zeros(length, np.uint64)])[length : length + len(sums)]
    return sums * power + shifted


def spread(sums: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    step = np.array([0x632BE59BD9B4E019], np.uint64)  # of arrays, products wrap around in silence
    return mix(sums + step * (np.atleast_1d(salt).astype(np.uint64) + np.uint64(1)))


def covered(at: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in a window of ``length`` that starts at one of ``at``."""
    steps = np.zeros(size + 1, np.int64)
    steps += np.bincount(at, minlength=size + 1)
    steps -= np.bincount(np.minimum(at + length, size), minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each word, or byte) within each text."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    held = words.bytes.copy()
    n = len(words.start)
    kept = np.flatnonzero(keep)
    counts = per_text(keep, words.first) if n else np.zeros(len(words.counts), np.int64)
    last = np.zeros(len(kept), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    start, end = words.start[kept], words.end[kept]
    held[end[~last]] = 32
    end = end + ~last
    steps = np.zeros(len(held) + 1, np.int8)
    steps[start] += 1
    steps[end] -= 1
    chosen = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    sizes = per_text(chosen[: words.text_at[-1]], words.text_at)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data = held[chosen]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from here on its session sends Arrow batches of ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` at most.

    The usual 10,000 texts of a few KB take tens of MB outside the heap, twice, in each
    running task.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def chunks(batches, column: str, limit: int = 4 << 20):
    """The rows of record batches anew, in batches that end with the text that brings them to ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        total = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while (end := int(np.searchsorted(total, limit)) + 1) <= len(total):
            yield pa.concat_batches([*held, batch.slice(begin, end - begin)])
            held, begin, total = [], end, total - total[end - 1]
        if begin < len(total):
            held.append(batch.slice(begin))
        size = int(total[-1])
    if held:
        yield pa.concat_batches(held)
