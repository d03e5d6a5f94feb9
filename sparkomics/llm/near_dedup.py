"""Near-duplicate documents by circulant MinHash, with exact Jaccard verification.

1. One pass over the texts makes, per row, the size and 128-bit key of its shingle set and its band values (about 300
   bytes, written once).  2. Equal sets become one class.  3. Classes that share a band value are candidates; only
   their texts are read a second time (a fixed-size bitmap of their ids keeps the others out) for the full sets.
4. ``linking.link`` verifies candidates on full sets and finds the components.

With 5 rows in 32 bands, a pair at similarity 0.8 is missed with probability 3e-6, at 0.85 with 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, WordHashes, claim, distinct, id_text, map_batches, materialise, numbered, shingles, utf8
from .exact_dedup import LAST, where_set
from .linking import CirculantMinHash, link, shared_bands

BANDS, ROWS = 32, 5

_hashes = WordHashes()
_minhash: dict[tuple, CirculantMinHash] = {}


def minhash(bands: int, rows: int) -> CirculantMinHash:
    if (bands, rows) not in _minhash:
        _minhash[bands, rows] = CirculantMinHash(bands, rows)
    return _minhash[bands, rows]


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles of a whole text."""
    return distinct(shingles(_hashes.of(text.lower().split()), width))


def set_key(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands``; key and bands are null for an empty set."""

    def sketch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        claim(_hashes)
        maker = minhash(bands, rows)
        sets = [shingle_set(t, width) for t in utf8(batch.column(1))]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        full = np.flatnonzero(sizes)
        keys = np.empty((0, bands), dtype=np.int64)
        if len(full):
            starts = np.cumsum(sizes[full]) - sizes[full]
            keys = maker.keys(maker.signatures(np.concatenate([sets[i] for i in full]), starts))
        ends = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(sizes == 0, False)), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array([set_key(s) for s in sets], type=pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "bands"])

    return map_batches(docs, sketch, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``set_key, items``: the whole shingle sets, as arrays."""

    def build(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        claim(_hashes)
        sets = [s for s in (shingle_set(t, width) for t in utf8(batch.column(1))) if len(s)]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        flat = np.concatenate([*sets, np.empty(0, dtype=np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], type=pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["set_key", "items"])

    return map_batches(docs, build, "set_key binary, items array<long>")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row: ``doc_id, n_shingles, component_id, kept``.

    Sets hold the distinct runs of ``width`` words (A-Z lower-cased); a text with fewer words is one run, one without
    words has an empty set and is linked with nothing.  ``component_id`` is the least id that verified links reach.
    Null texts are empty.  A row with a null id can't be named: its component is null, it is kept and links nothing.
    Rows that repeat an id share its component; an id with several texts joins their components.  An empty table gives
    no row.
    """
    given = id_text(docs, id_col, text_col)
    made = materialise(sketches(given, width, bands, rows), "sketches")
    named = made.where("set_key is not null and doc_id is not null")
    classes = materialise(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")), "classes")
    shared = shared_bands(classes)
    wanted = materialise(classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "set_key"), "wanted")
    read = where_set(given.where("doc_id is not null"), "doc_id", wanted.select(F.col("node").alias("doc_id")))
    sets = full_sets(read, width).join(wanted, "set_key").dropDuplicates(["node", "set_key"]).select("node", "items")
    found = link(shared, materialise(sets, "sets"), percent=percent)
    of_class = classes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    rows_ = made.select("doc_id", "n_shingles", "set_key").join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows_.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: of each component the one with the least id (null last).

    Rows are named by their place in the written table, so null and repeated ids are linked and dropped like others.
    """
    rows = numbered(docs)
    found = near_groups(rows, ROW, text_col, width).select(F.col("doc_id").alias(ROW), "component_id")
    ids = rows.select(ROW, F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"))
    first = found.join(ids, ROW).groupBy("component_id").agg(F.min(F.struct("id", ROW)).alias("first"))
    return rows.join(first.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").select(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
