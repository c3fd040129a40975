"""Helpers the operators share: text columns in batches, hashed words, 64-bit mixing."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of texts that go to a Python worker at once.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Text bytes that a vectorised step holds at once; a longer single text is held whole.
PIECE_BYTES = 1 << 20


def batched(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches hold ``BATCH_ROWS`` rows at most.

    A batch is held by the JVM and by the worker at the same time, and ten thousand long
    texts, the usual bound, need more memory than executors leave beside their heap. A
    smaller bound that the session has stays.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return docs


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of large strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def buffers_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than there are texts, from 0) and the UTF-8 bytes."""
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return ends - ends[0], np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes of text each, every row in one of them."""
    ends = buffers_of(texts_of(batch.column(column)))[0]
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` well-spread 64-bit values that depend on ``seed`` alone."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


BYTE_VALUE = stream(1, 256)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
STEP = np.uint64(0x9DDFEA08EB382D69)


class Words(NamedTuple):
    """Words of a batch of texts: runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z."""

    start: np.ndarray  #: first byte, from the start of the batch
    end: np.ndarray
    hash: np.ndarray  #: 64 bits of the word's bytes
    first: np.ndarray  #: for each text and one past the last: the index of its first word
    data: np.ndarray  #: lower-cased bytes of the batch

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def words_of(texts: pa.Array) -> Words:
    ends, raw = buffers_of(texts)
    data = LOWER[raw]
    inside = IN_WORD[data]
    begins, finishes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    finishes[:-1] &= ~inside[1:]
    cuts = ends[(ends > 0) & (ends < len(data))]  # no word runs on from one text into the next
    begins[cuts] = inside[cuts]
    finishes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    first = np.searchsorted(start, ends)
    if not len(start):
        return Words(start, end, np.zeros(0, np.uint64), first, data)
    length = end - start
    at = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(at, length)
    power = np.full(int(length.max()), STEP)
    power[0] = 1
    power = np.multiply.accumulate(power)
    hashed = np.add.reduceat(BYTE_VALUE[data[inside]] * power[within], at)
    return Words(start, end, mixed(hashed + length.astype(np.uint64)), first, data)
