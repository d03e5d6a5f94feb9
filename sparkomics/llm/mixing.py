"""Mixing sources to target weights by Poisson replication.

A source with target weight w gets the mean repetition rate w * budget / size, where size is the bytes of its documents
and the budget is a number of epochs over all bytes.  Each document draws its count by inverting that Poisson
distribution at a uniform number hashed from (seed, id), is exploded by the count, and all copies are put in the global
order of another hash.  Everything is a built-in expression.  The table of rates has one row per source; it is
broadcast only when it has at most ``MOST_BROADCAST`` rows, and joined on salted keys beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BROADCAST = 10_000
SALTS = 64
#: A larger rate is drawn as the sum of equal parts of at most this rate, which exp() can still start from.
PART_RATE = 500.0


def uniform(*key: Column | str) -> Column:
    """In (0, 1), from the first 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.col(k) if isinstance(k, str) else k for k in key])), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def order_key(*key: Column | str) -> Column:
    """A 60-bit hash that gives the global order."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.col(k) if isinstance(k, str) else k for k in key])), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def source_rates(docs: DataFrame, source_col: str, text_col: str, weights: dict[str, float] | None, alpha: float, epochs: float) -> DataFrame:
    """``mix_source, rate``.  A document's size is its UTF-8 bytes plus 1 (null text: 1).

    Without ``weights``, a source's weight is its share of the bytes to the power ``alpha``; weights are normalised to
    sum to 1, and a source that ``weights`` doesn't name has weight 0.
    """
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long") + 1
    sizes = docs.select(F.col(source_col).cast("string").alias("mix_source"), size.alias("size")).groupBy("mix_source").agg(F.sum("size").alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(float(alpha)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce("mix_source", F.lit(""))), F.lit(0.0)) if pairs else F.lit(0.0)
    total = sizes.withColumn("weight", weight).agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return sizes.withColumn("weight", weight).crossJoin(F.broadcast(total)).select(  # total: one row
        "mix_source", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * float(epochs) * F.col("all_size") / F.col("size")).otherwise(F.lit(0.0)).alias("rate")
    )


def _with_table(rates: DataFrame) -> DataFrame:
    """Adds ``parts`` and ``cdf``, the distribution function of one part from 0 on, up to where it is 1 within rounding."""
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")).withColumn("part_rate", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("part_rate") + 12 * F.sqrt("part_rate") + 30).cast("int")
    first = F.exp(-F.col("part_rate"))
    start = F.struct(F.array(first).alias("cdf"), first.alias("p"), first.alias("s"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("part_rate") / k
        return F.struct(F.concat(acc["cdf"], F.array(acc["s"] + p)).alias("cdf"), p.alias("p"), (acc["s"] + p).alias("s"))

    return rates.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"])).drop("part_rate")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """Every column of ``docs`` for each copy, with ``mix_rate, mix_copies, mix_copy`` (from 0) and ``mix_key``, in the order of ``mix_key``.

    Rows of one id draw the same count.  Null ids share one draw; null sources are one source, which ``weights`` names
    by "" along with the empty source; null texts weigh as empty ones.  A rate of 0, an empty table or weights without
    any of the sources give no row.  Columns that begin with ``mix_`` are overwritten.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    spark = docs.sparkSession
    rates = source_rates(docs, source_col, text_col, weights, alpha, epochs)
    held = rates.limit(MOST_BROADCAST + 1).collect()
    source = F.col(source_col).cast("string")
    if len(held) <= MOST_BROADCAST:
        table = _with_table(spark.createDataFrame(held, rates.schema))
        joined = docs.join(F.broadcast(table), source.eqNullSafe(F.col("mix_source")))
    else:
        salted = _with_table(rates).withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("mix_own", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, source.eqNullSafe(F.col("mix_source")) & (F.col("mix_own") == F.col("mix_salt"))).drop("mix_own", "mix_salt")
    key = F.col(id_col).cast("string")
    draw = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, i: acc + F.size(F.filter("cdf", lambda c: c < uniform(F.lit(str(seed)), F.lit("n"), key, i.cast("string"))))
    )
    counted = joined.withColumn("mix_copies", draw).where("mix_copies > 0").withColumnRenamed("rate", "mix_rate").drop("mix_source", "parts", "cdf")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    copies = copies.withColumn("mix_key", order_key(F.lit(str(seed)), F.lit("o"), key, F.col("mix_copy").cast("string")))
    return copies.repartitionByRange(F.col("mix_key")).sortWithinPartitions("mix_key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "source", F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").cast("long").alias("copies"), F.col("mix_copy").cast("long").alias("copy"), F.col("mix_key").alias("order_key"))


OP7_SQL = """
WITH s AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source
), r AS (
  SELECT source, pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM s) * (SELECT sum(size) FROM s) / size AS rate FROM s
), c AS (
  SELECT source, rate, k, exp(-rate) * pow(rate, k) / gamma(k + 1) AS p
  FROM r, range(0, 150) AS g(k)
), cdf AS (
  SELECT source, rate, list(f ORDER BY k) AS cdf
  FROM (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS f FROM c) GROUP BY source, rate
), n AS (
  SELECT doc_id, d.source, rate,
         len(list_filter(cdf, lambda x: x < (('0x' || substr(md5('17:n:' || doc_id || ':1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)) AS copies
  FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
)
SELECT doc_id, source, round(rate, 6) AS rate, copies, copy,
       ('0x' || substr(md5('17:o:' || doc_id || ':' || copy), 1, 15))::BIGINT AS order_key
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM n WHERE copies > 0)
"""
