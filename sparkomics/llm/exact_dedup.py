"""Exact deduplication, in DataFrame operations only.

Rows are grouped by the 128-bit MD5 of their normalised text.  Only rows whose hash occurs twice or more have their
texts compared: a fixed-size bitmap of those hashes (``BITMAP_BITS``, 4 MB, built and read by built-in functions) keeps
the others' texts out of the shuffle, and grouping by (hash, text) collapses copies before they are sent.  A hash with
two different texts is then regrouped by the text itself, so a collision can't join documents.

All but the comparison works on rows of about 100 bytes, written once to the shared folder.  A hot hash is summed before
the shuffle; the join that brings its result back is one that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, id_text, materialise, numbered

BITMAP_BITS = 1 << 25
LAST = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """Null as empty, without the six ASCII white-space characters."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _keep(by: list[str], rows: DataFrame) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("a"), F.coalesce("doc_id", F.lit(LAST)).alias("b"), F.col("row_id").alias("c"), F.col("doc_id").alias("id"))).alias("keep"),
    )


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)) + 1


def where_set(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be among ``wanted``'s: a bitmap without false negatives, of at most BITMAP_BITS / 8 bytes."""
    bits = wanted.select(F.bitmap_bucket_number(_bit(F.col(key))).alias("bucket"), F.bitmap_bit_position(_bit(F.col(key))).alias("at"))
    bitmap = bits.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))  # at most BITMAP_BITS / 2**15 rows of 4 KB
    at = F.bitmap_bit_position(_bit(F.col(key)))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
    return rows.withColumn("bucket", F.bitmap_bucket_number(_bit(F.col(key)))).join(F.broadcast(bitmap), "bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("bucket", "bits")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=md5_128) -> DataFrame:
    """One row per row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal normalised texts the row with the most code points stays, then the smallest id (null last), then one of
    the repeated rows of that id: exactly one row of a group is kept.  Null and empty texts, and texts of white space
    alone, are one group.  An empty table gives no row.
    """
    return _groups(id_text(docs, id_col, text_col).withColumn("row_id", F.monotonically_increasing_id()), content_hash).drop("row_id")


def _groups(given: DataFrame, content_hash=md5_128) -> DataFrame:
    """The groups of ``given (doc_id, text, row_id)``, with the ``row_id`` of each row."""
    text = normalised(F.col("text"))
    base = materialise(
        given.select("doc_id", content_hash(text).alias("h"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.unhex(F.sha2(text, 256)).alias("sha"), "row_id"),
        "exact",
    )
    groups = _keep(["h"], base)
    repeated = base.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    texts = given.select(content_hash(text).alias("h"), text.alias("norm"))
    distinct = where_set(texts, "h", repeated).join(repeated, "h", "left_semi").groupBy("h", "norm").count()
    collided = materialise(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "collided")
    columns = ["doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.c")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row_id"]
    if collided.isEmpty():
        return base.join(groups, "h").select(*columns)
    clean = base.join(collided, "h", "left_anti").join(groups, "h").select(*columns)
    again = materialise(
        given.select("doc_id", content_hash(text).alias("h"), text.alias("norm"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.unhex(F.sha2(text, 256)).alias("sha"), "row_id").join(collided, "h", "left_semi"),
        "regrouped",
    )
    return clean.unionByName(again.join(_keep(["h", "norm"], again), ["h", "norm"]).select(*columns))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with all their columns, one of each group: rows are named by their place in the written
    table, so null and repeated ids are dropped like others."""
    rows = numbered(docs)
    kept = _groups(id_text(rows, id_col, text_col, ROW)).where("kept").select(F.col("row_id").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
