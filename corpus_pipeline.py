"""A training corpus in five stages, each written as Parquet and read again by the next.

Toxic documents go; of equal texts one stays; of near copies (five-word shingles, similarity 0.8) one stays; sources
are replicated to target weights in a global shuffle; what is left is packed into sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkomics.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from sparkomics.llm.common import materialise


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs)
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a smaller word table than alone: by now the executors' heaps have grown to what the earlier stages took
    pieces = packing.pack_documents(docs, packing.tokenizer_file(), words=packing.MOST_WORDS // 3)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", remove_toxic), ("exact_dedup", remove_copies), ("near_dedup", remove_near_copies), ("mixing", mix_sources), ("packing", pack)]
#: The first stage's classifier and the packing have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
