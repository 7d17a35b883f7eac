"""Word and shingle hashing in numpy, and the Arrow plumbing of the operators that run Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: A-Z to a-z; every other byte stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: A-Z to a-z, letters, digits and bytes from 0x80 stay, every other byte becomes a space.
ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(128)).lower() + bytes(range(128, 256))

#: Words of a document's shingles.
SHINGLE = 5

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S = (np.uint64(30), np.uint64(27), np.uint64(31))
_PLACE = [np.uint64(xxhash.xxh64_intdigest(bytes([i]), seed=11) | 1) for i in range(SHINGLE)]
_LOWER = np.frombuffer(LOWER, np.uint8)
_IS_SPACE = np.isin(np.arange(256), (*range(9, 14), 32))
#: Keeps the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64
_LENGTH = np.array([xxhash.xxh64_intdigest(i.to_bytes(2, "little"), seed=5) for i in range(_LONG + 1)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _S[0])) * _M1
    h = (h ^ (h >> _S[1])) * _M2
    return h ^ (h >> _S[2])


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return raw(text).translate(LOWER).split()


def word_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the bounds of every text's words among them. Words are those of words_of.

    A word is read as 8-byte numbers straight from the column's buffer, so no word becomes a Python object.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(at[-1] - at[0]) if len(texts) else 0
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    space = _IS_SPACE[data]
    apart = np.zeros(n + 1, bool)  # a word may not run over this place
    apart[at] = True
    apart[1:] |= space
    starts = np.flatnonzero(apart[:-1] & ~space)
    apart[:-1] |= space
    apart[at] = True
    stops = np.flatnonzero(apart[1:] & ~space) + 1
    del space, apart
    low = np.zeros(n + 8, np.uint8)
    np.take(_LOWER, data, out=low[:n])
    eight = np.ndarray((n + 1,), "<u8", low, strides=(1,))
    size = stops - starts
    h = mix(_LENGTH[np.minimum(size, _LONG)] ^ (eight[starts] & _FIRST[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= _LONG))
    done = 8
    while len(more):
        h[more] = mix(h[more] * _M2 ^ (eight[starts[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : stops[i]].tobytes())
    return h, np.searchsorted(starts, at)


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += words[i : i + n] * _PLACE[i]
    return mix(total)


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """The hash of every run of width words, in order; of the whole sequence where it is shorter; empty where there are no words."""
    return _runs(words, min(width, len(words))) if len(words) else words


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.empty(len(h), bool)
    new[:1] = True
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every whole text."""
    words, bounds = word_runs(texts)
    whole = _runs(words, SHINGLE) if len(words) >= SHINGLE else words[:0]
    bounds = bounds.tolist()
    return [_distinct(whole[a : b - SHINGLE + 1] if b - a >= SHINGLE else shingle_hashes(words[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)]


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.large_string()))[0]


#: Rows and bytes of a column that the Python side of an operator holds at once; a longer row is held by itself.
SLICE, SLICE_BYTES = 256, 4 << 20
#: Bytes after which Spark closes a batch for Python. The session's setting is lowered to it, as 10,000 long texts would be one batch.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(SLICE, SLICE * SLICE_BYTES // max(1, b.nbytes * SLICE // max(1, b.num_rows))))
    for i in range(0, b.num_rows, rows):
        part = b.slice(i, rows)
        if rows > 1 and part.nbytes > 2 * SLICE_BYTES:
            yield from (part.slice(k, 1) for k in range(part.num_rows))
        else:
            yield part


def give_back() -> None:
    """Returns a worker's free memory to the system: workers stay alive between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in slices of few rows and bytes, so that what a worker derives from long texts stays small."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(s for b in batches for s in _slices(b))
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(sliced, schema)


def small_batches(spark: SparkSession) -> None:
    held = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SETTING))
    if held > BATCH_BYTES:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
