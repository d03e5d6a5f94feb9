"""The driver's tables as long and vector frames, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frame
from ..sources.tables import read_table

EMBEDDING_NAMES = [f"f{i:02d}" for i in range(64)]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def events_wide(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1)
    return e.select("event_id", "event_type", "value", F.when(k != "", k).cast("double").alias("k"), F.col("user_id").cast("double").alias("user"), (F.col("event_id") % 97).cast("double").alias("seq"))


def events(spark: SparkSession, sf: str, features: tuple[str, ...] = ("value", "k", "user", "seq")) -> DataFrame:
    return frame.to_long(events_wide(spark, sf), "event_id", list(features), "event_type")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Without a unique key: for order-free statistics only."""
    return frame.to_long(read_table(spark, sf, "lineitem"), "l_orderkey", LINE_FEATURES, "l_returnflag")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return frame.to_long(read_table(spark, sf, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"], "c_mktsegment")


def embeddings(spark: SparkSession, sf: str, labels: list[str] | None = None) -> DataFrame:
    long = frame.long_from_arrays(read_table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return long.where(F.col("cls").isin(labels)) if labels else long


def vectors(spark: SparkSession, sf: str, labels: list[str] | None = None, features: int | None = None) -> DataFrame:
    v = frame.vectors_from_arrays(read_table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    v = v.where(F.col("cls").isin(labels)) if labels else v
    return v.withColumn("features", F.slice("features", 1, features)) if features else v


def event_vectors(spark: SparkSession, sf: str, features: list[str]) -> DataFrame:
    return frame.vectors_from_columns(events_wide(spark, sf), "event_id", features, "event_type")


def _stack(table: str, key: str, cls: str, cells: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key} AS sample_id, {cls} AS cls, '{n}' AS feature, {i} AS feature_idx, CAST({e} AS DOUBLE) AS value FROM {table}" for i, (n, e) in enumerate(cells.items()))


EVENT_CELLS = {"value": "value", "k": "nullif(regexp_extract(props, '\"k\": *([0-9]+)', 1), '')", "user": "user_id", "seq": "event_id % 97"}
EV = f"ev AS ({_stack('events', 'event_id', 'event_type', EVENT_CELLS)})"
EV2 = f"ev AS ({_stack('events', 'event_id', 'event_type', {k: EVENT_CELLS[k] for k in ('value', 'k')})})"
LI = f"li AS ({_stack('lineitem', 'l_orderkey', 'l_returnflag', {c: c for c in LINE_FEATURES})})"
CU = f"cu AS ({_stack('customer', 'c_custkey', 'c_mktsegment', {c: c for c in ('c_acctbal', 'c_nationkey')})})"
EM = "em AS (SELECT vec_id AS sample_id, CAST(label AS VARCHAR) AS cls, 'f' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, i - 1 AS feature_idx, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) AS r(i))"
EM2 = EM.replace("FROM embeddings,", "FROM (SELECT * FROM embeddings WHERE label IN (0, 1)) AS e,")
