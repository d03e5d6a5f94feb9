"""Shared pieces of the text operators: shared storage, words, row-batch plumbing.

Words follow one rule everywhere: the UTF-8 bytes of the text, A-Z lower-cased when the operator says so,
split at the six ASCII white-space bytes (``bytes.split`` splits at exactly those).
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step holds at once; larger Arrow batches are cut into runs of rows of about this size.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that driver and executors share; a local one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "sparkomics-checkpoints")
        spark.sparkContext.setCheckpointDir(found)
    return found


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialise`` wrote; a path that is gone already is no error."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    The plan above starts from replicated files, so a lost executor costs only the tasks that ran there, and values
    that depend on partition numbers stay fixed.  The table is deleted when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkomics_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete the table behind a frame that ``materialise`` returned and that no later plan reads."""
    path = getattr(df, "_sparkomics_path", None)
    if path:
        discard(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are out of use: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the JVM may be gone before us
            return


def runs(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes sum to about ``limit``; a larger row stands alone."""
    if not len(sizes):
        return
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Text values as bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches cut to about ``CHUNK_BYTES`` of their second column (the text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(1)).to_pylist()], dtype=np.int64)
            for a, b in runs(sizes + 64):
                yield from function(batch.slice(a, b - a))
        settle()

    return df.mapInArrow(each, schema)


def id_text(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Only the columns that count, under names of our own: other columns can't clash and aren't read."""
    small_batches(docs.sparkSession)
    rows = [F.col(row_col).alias("row_id")] if row_col else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *rows)


ROW = "__row_id"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written with a unique number ``ROW`` in every row, which stays fixed whatever reads it."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


#: Rows of an Arrow batch, where the session doesn't set its own: texts of some KB make Spark's default tens of MB.
BATCH_ROWS = "2000"


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_ROWS)


_claimed: list[dict] = []


def settle() -> None:
    """At a task's end: empties the tables and gives freed memory back, as the worker may idle while others need it."""
    for t in _claimed:
        t.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def claim(*tables: dict) -> None:
    """Empties the tables that another operator has left in this Python worker, which Spark uses again."""
    if _claimed and _claimed[0] is not tables[0]:
        settle()
    _claimed[:] = tables


class WordTable(dict):
    """word -> value, kept between texts in two generations of at most ``most`` words: words that are met again stay.

    Words of more than ``longest`` bytes are never kept, so a table has a bounded size whatever the corpus."""

    def __init__(self, most: int = 150_000, longest: int = 64) -> None:
        super().__init__()
        self.most, self.longest, self.old = most, longest, {}

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def make(self, word: bytes):
        raise NotImplementedError

    def __missing__(self, word: bytes):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = {}  # goes before the copy is made
            self.old = dict(self)
            super().clear()
        self[word] = value
        return value


class WordHashes(WordTable):
    """word -> 64-bit hash."""

    def __init__(self, most: int = 150_000, seed: int = 0) -> None:
        super().__init__(most)
        self.seed = seed

    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word, self.seed)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64, wrapping."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values; a plain sort is many times faster here than numpy's ``unique``."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; one hash of the whole sequence when it is shorter; none when it is empty."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i] + np.uint64(i + 1))
    return out + np.uint64(width)
