"""Words of many texts at once, as positions in one byte array.

Tasks receive texts as Arrow batches. Splitting, lower-casing and hashing work on the
batch's bytes with numpy, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbral.session import scratch_path

U64 = np.uint64
_MULTIPLIER, _FINISH, _STEP = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASKS = np.array([0, *[(1 << (8 * k)) - 1 for k in range(1, 8)], (1 << 64) - 1], dtype=U64)

#: Rows of a batch that goes to Python: texts have no bound, so batches are counted in few rows.
BATCH_ROWS = 256


def small_batches(spark) -> None:
    """Let tasks hand texts to Python in batches of ``BATCH_ROWS`` rows; this is a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def with_row_ids(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that number its rows, and their names: the file (as a hash) and the place in it, the same in every run.

    Rows that do not come from files with such places are written once and numbered.
    """
    names = ["__file", "__row"]
    while set(names) & set(df.columns):
        names = [f"_{n}" for n in names]
    try:
        file = df.metadataColumn("_metadata")
        out = df.select("*", F.xxhash64(file.getField("file_path")).alias(names[0]), file.getField("row_index").alias(names[1]))
        out.schema  # resolves the names
        return out, names
    except AnalysisException:
        path = scratch_path(df.sparkSession, "numbered")
        df.withColumn(names[1], F.monotonically_increasing_id()).write.parquet(path)
        return df.sparkSession.read.parquet(path), names[1:]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(inside) -> np.ndarray:
    """Which bytes belong to words."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words are runs without these six white-space bytes.
SPACED = byte_class(lambda b: not (b == 32 or 9 <= b <= 13))
#: Words are runs of ASCII letters, digits and every byte of other characters.
ALPHANUMERIC = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


@dataclass
class Tokens:
    """``data`` holds all texts; word i is ``data[start[i]:end[i]]``; text d has words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    edges: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    inside: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one more entry at the end). Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, what = texts.buffers()
    edges = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(what, np.uint8)[edges[0] : edges[-1]] if what is not None else np.zeros(0, np.uint8)
    return data, edges - edges[0]


def tokens(texts: pa.Array, word_bytes: np.ndarray, lower: bool) -> Tokens:
    data, edges = text_bytes(texts)
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[edges] = True
    before = np.r_[False, inside[:-1]] if len(data) else inside
    after = np.r_[inside[1:], False] if len(data) else inside
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Tokens(data, edges, start, end, np.searchsorted(start, edges), inside)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits."""
    h = (h ^ (h >> U64(30))) * _FINISH
    h = (h ^ (h >> U64(27))) * _STEP
    return h ^ (h >> U64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``, eight bytes at a time, the same in every batch and process."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    size = end - start
    out = size.astype(U64) * _MULTIPLIER
    left, at = np.arange(len(start)), 0
    while len(left):
        rest = size[left] - at
        chunk = eight[np.minimum(start[left] + at, len(data))] & _MASKS[np.clip(rest, 0, 8)]
        out[left] = mix(out[left] ^ chunk) + _MULTIPLIER
        left, at = left[rest > 8], at + 8
    return out


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashes; the runs do not stop where a text ends."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * _MULTIPLIER + hashes[k : k + n]
    return mix(out)


def within_texts(t: Tokens, size: int) -> np.ndarray:
    """Which runs of ``size`` words, by first word, lie in one text."""
    n = max(0, len(t.start) - size + 1)
    stop = np.repeat(t.first[1:], t.counts())
    return np.arange(n) + size <= stop[:n]


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``values[edges[d]:edges[d + 1]]`` for every d, empty ones included."""
    total = np.r_[0, np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)]
    return total[edges[1:]] - total[edges[:-1]]


def no_nulls(texts: pa.Array) -> list[str]:
    return ["" if x is None else x for x in texts.to_pylist()]


def slices(texts: pa.Array, most_bytes: int = 1 << 22) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most_bytes`` of text each (or one longer text), so that working arrays stay small."""
    sizes = np.cumsum(np.diff(text_bytes(texts)[1]))
    out, low = [], 0
    while low < len(texts):
        base = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, base + most_bytes, side="right")))
        out.append((low, high))
        low = high
    return out


def gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes (or one longer row): equal words are then met once in more text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def joined_words(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins and ends there."""
    sizes = t.end - t.start + 1
    stop = np.cumsum(sizes)
    begin = stop - sizes
    source = np.arange(stop[-1] if len(stop) else 0) + np.repeat(t.start - begin, sizes)
    out = np.r_[t.data, np.uint8(32)][np.minimum(source, len(t.data))]
    out[stop - 1] = 32
    return out, begin, stop - 1
