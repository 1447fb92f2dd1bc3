"""Shared text helpers: word hashing in NumPy, bounded slices of Arrow batches.

Words are maximal runs of "word bytes" of the UTF-8 text.  A word's name is a
64-bit polynomial hash of its bytes, computed for all words of a slice at once
from prefix sums; the same word has the same name in every task, so names can
be compared across documents without a dictionary.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20       # text bytes worked on at once (a longer text is a slice of its own)
SEGMENT_BYTES = 1 << 19     # bytes hashed at once
LONG_WORD = 1 << 16         # longer words are named by a digest of their own

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salt(n: int) -> np.uint64:
    """The n-th odd multiplier of a fixed sequence."""
    return mix64(np.array([n + 1], dtype=np.uint64) * GOLDEN)[0] | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = int(salt(1000))
_SPAN = SEGMENT_BYTES + LONG_WORD + 1
_POW = _IPOW = None
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def _tables():
    """Power tables, made once per process."""
    global _POW, _IPOW
    if _POW is None:
        _POW, _IPOW = _powers(_BASE, _SPAN), _powers(pow(_BASE, -1, 1 << 64), _SPAN)
    return _POW, _IPOW


def byte_class(*outside: tuple[int, int]) -> np.ndarray:
    """256 flags: True for bytes that belong to words, i.e. outside the given inclusive ranges."""
    t = np.ones(256, dtype=bool)
    for lo, hi in outside:
        t[lo:hi + 1] = False
    return t


#: ``[^\x20\x09-\x0D]+``
SPACED = byte_class((0x09, 0x0D), (0x20, 0x20))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z)
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def hash_words(buf: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first bytes and ends of all words of ``buf``; memory beyond the
    result is bounded by ``SEGMENT_BYTES``."""
    arr = np.frombuffer(buf, dtype=np.uint8)
    flag = np.zeros(len(arr) + 2, dtype=np.int8)
    flag[1:-1] = is_word[arr]
    step = np.diff(flag)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    out = np.empty(len(start), dtype=np.uint64)
    power, inverse = _tables()
    i = 0
    while i < len(start):
        if end[i] - start[i] > LONG_WORD:
            out[i] = int.from_bytes(hashlib.blake2b(buf[start[i]:end[i]], digest_size=8).digest(), "little")
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT_BYTES)))
        long = np.flatnonzero(end[i:j] - start[i:j] > LONG_WORD)
        if len(long):
            j = i + int(long[0])
        lo, n = start[i], end[j - 1] - start[i]
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[arr[lo:lo + n]] * power[:n], out=total[1:])
        s = start[i:j] - lo
        out[i:j] = (total[end[i:j] - lo] - total[s]) * inverse[s]
        i = j
    return mix64(out), start, end


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of at most ``limit`` bytes each (or one text)."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def joined_words(texts: list, is_word: np.ndarray, lower: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts (None: none): the joined bytes, names, starts,
    ends, and for text i the range ``bounds[i]:bounds[i + 1]`` of its words."""
    parts = [t if t is not None else b"" for t in texts]
    buf = b"\n".join(parts)
    if lower:
        buf = buf.lower()  # bytes.lower touches A-Z only
    names, start, end = hash_words(buf, is_word)
    first = np.cumsum([0] + [len(p) + 1 for p in parts])
    return buf, names, start, end, np.searchsorted(start, first)


def grams(names: np.ndarray, k: int) -> np.ndarray:
    """Names of the k-word sequences that start at each word but the last k - 1."""
    n = len(names) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += names[j:j + n] * salt(j)
    return mix64(out)


def binary_column(batch: pa.RecordBatch, name: str) -> list:
    """A string column as a list of UTF-8 bytes (None for null)."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


PACKAGE = "geoseries-workers.zip"
#: What a task holds of its input at once, in the JVM, on the way and in Python; texts are long rows.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors with the job (once a SparkContext), so
    that Python workers import it wherever the driver found it."""
    sc = spark.sparkContext
    if PACKAGE in sc._python_includes:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="geoseries-ship-"), PACKAGE)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def release_memory() -> None:
    """Give back what a finished task has freed: workers are kept for the next
    task, and neither Arrow's pool nor the C library returns pages by itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """``mapInArrow`` with the package shipped first, batches of bounded size, and
    memory given back at the end of a task."""
    ship_package(df.sparkSession)
    for key, most in BATCH.items():
        df.sparkSession.conf.set(key, most)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(tidy, ddl)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``mapInArrow`` for functions that yield column dicts for slices of a batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for cols in fn(batch):
                    yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return map_arrow(df, run, ddl)


def texts_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The two columns the operators read; everything else is left in the scan."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
