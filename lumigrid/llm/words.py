"""Words of text columns, found by whole Arrow batches.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased. In UTF-8 that class is a set of *bytes* (0-9, a-z and every byte of a
non-ASCII character), so NumPy finds and hashes the words of a batch in one pass over
its data buffer, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are expanded to NumPy arrays at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20
#: Powers of each base that a worker keeps.
KEPT_POWERS = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: spreads every input bit over a uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = {b: np.ones(1, np.uint64) for b in (_BASE, _BASE_INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64. Some are kept for the next call; workers live on
    after a task, so larger tables are made anew."""
    if len(_powers[base]) > n:
        return _powers[base]
    steps = np.full(max(n, KEPT_POWERS) + 1, base, np.uint64)
    steps[0] = 1
    made = np.cumprod(steps)
    if n <= KEPT_POWERS:
        _powers[base] = made
    return made


@dataclass
class Words:
    """Words of some texts: ``first[i]:first[i+1]`` are those of text i."""

    hash: np.ndarray
    first: np.ndarray
    text: np.ndarray

    def __len__(self) -> int:
        return len(self.hash)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n+1 offsets into them; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count and not (at[1:] == at[:-1])[~np.asarray(column.is_valid())].all():
        return utf8(column.fill_null(""))
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return text, at - at[0]


#: Bytes that are hashed at once: the numbers for them stay in a core's cache.
CHUNK = 1 << 15


def rolling_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start[i]:end[i]] for all i; start and end rise."""
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        low = int(start[k])
        stop = max(k + 1, int(np.searchsorted(end, low + CHUNK, side="right")))
        high = int(end[stop - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_CODE[data[low:high]] * _power(_BASE, high - low)[: high - low], out=sums[1:])
        begin = start[k:stop] - low
        out[k:stop] = (sums[end[k:stop] - low] - sums[begin]) * _power(_BASE_INVERSE, high - low)[begin]
        k = stop
    return mix(out)


def words(column: pa.Array) -> Words:
    """All words of a string array. Equal words have equal hashes; unequal ones differ
    but for 2**-64. A null or empty text has none."""
    data, at = utf8(column)
    data = _LOWER[data]
    inside = _IS_WORD[data]
    if not inside.any():
        n = np.zeros(len(at), np.int64)
        return Words(np.zeros(0, np.uint64), n, np.zeros(0, np.int64))
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # texts lie side by side
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    key = rolling_keys(data, start, end)
    first = np.searchsorted(start, at)
    return Words(key, first, np.repeat(np.arange(len(at) - 1), np.diff(first)))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of one text, as words() gives them."""
    return words(pa.array([text], pa.string())).hash


def shingles(found: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words and the text of each, in order. A text with fewer
    words, but not none, has one run: all its words."""
    counts = np.diff(found.first)
    runs = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(len(counts)), runs)
    begin = np.repeat(found.first[:-1] - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(len(text))
    length = np.minimum(counts, n)[text]
    total = np.zeros(len(begin), np.uint64)
    for k in range(n):
        there = length > k
        word = found.hash[np.minimum(begin + k, max(len(found) - 1, 0))] if len(found) else total
        total = np.where(there, total * _MIX2 + word, total)
    return mix(total ^ length.astype(np.uint64)), text


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut so that `column` holds about `limit` bytes
    at most in each piece; one longer text is a piece of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


#: Rows that go to Python at once, where rows hold whole texts.
BATCH_ROWS = 1000
#: Rows that are read from Parquet at once there.
READ_ROWS = 512


def small_batches(df) -> None:
    """Lets Spark send at most BATCH_ROWS rows at once to Python in df's session, and read
    READ_ROWS at once, unless the session says how many: its own 10,000 can be hundreds of
    megabytes of long texts, in the JVM and in Python, and its own 4,096 are arrays of many
    megabytes, doubled as they fill, for which an executor's heap grows and stays large."""
    held = df.sparkSession.conf.getAll
    for key, rows in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if key not in held:
            df.sparkSession.conf.set(key, str(rows))
