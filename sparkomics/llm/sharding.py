"""Sharding by jump consistent hashing (Lamping & Veach 2014): a stable key and the shard count decide, with no ring table.

When one shard is appended, 1/(n+1) of the keys move, all of them into it.  The text never leaves the JVM: sizes and
checksums are built-in expressions, and only the hashed key passes through the vectorised jump loop.  ``slot`` numbers
the rows of a shard without gaps in two steps, so that no task sees a whole shard: a count within (partition, shard)
while the rows pass, then a running total over the small table of those counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_text, materialise

#: Added to the UTF-8 bytes of a text: what a row costs besides.
ROW_BYTES = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each uint64 key, for a number of shards of at least 1."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64).copy()
    at = np.zeros(len(key), dtype=np.int64)
    jumps = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = jumps[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        jumps[live] = np.floor((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[jumps[live] < shards]
    return at.astype(np.int32)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``key``: equal ids always share a shard, whatever else the table holds.  Null text counts as no bytes and
    as the empty string's checksum; null ids are one key; repeated rows get slots of their own; an empty table gives no
    row.  ``slot`` runs from 0 in each shard, in no promised order.
    """
    rows = id_text(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id").alias("key"),
    )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            keys = batch.column(3).to_numpy().view(np.uint64)
            shard, grown = jump(keys, shards), jump(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), dtype=np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            added = [pa.array(shard), pa.array(grown), pa.array(np.full(len(shard), part, dtype=np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *added], names=names)

    names = ["doc_id", "size", "text_crc32", "shard", "grown_shard", "part", "local"]
    dealt = materialise(rows.mapInArrow(deal, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, part int, local long"), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("part", "shard").agg(F.count("*").alias("n")).select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return dealt.join(bases, ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("local")).alias("slot"), "grown_shard"
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
