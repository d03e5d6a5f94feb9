"""Toxicity scores: FTRL-proximal logistic regression (McMahan et al. 2013) over hashed word n-grams and skip-grams.

The classifier is fitted in one task on at most ``MOST_LABELLED`` labelled rows, those with the least hash of their id;
the bound is the only sampling, and every whole text is scored.  L1 leaves a few hundred to a few thousand non-zero
weights out of 2**20, which travel with the closure (12 bytes each, at most 12 MB).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, claim, distinct, id_text, map_batches, mix64, runs, settle, utf8

BITS = 20
MOST_LABELLED = 10_000
#: Distances between the words of a pair: 1 is a bigram, the others are skip-grams.
GAPS = (1, 2, 3)
MARKS = b".,;:!?\"'()[]{}*#$%&|<>-_~`/\\=+"


class PlainWords(WordHashes):
    """Hashes of words without case (A-Z) and without punctuation at their ends."""

    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word.lower().strip(MARKS), 5)


_words = PlainWords()


def features(text: bytes) -> list[np.ndarray]:
    """Places of unigrams and of pairs at each gap, repeats included."""
    h = _words.of(text.split())
    mask = np.uint64((1 << BITS) - 1)
    out = [mix64(h) & mask]
    for gap in GAPS:
        if len(h) > gap:
            out.append(mix64(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + (h[gap:] ^ np.uint64(gap))) & mask)
    return out


@dataclass(frozen=True)
class Model:
    """Bias and the non-zero weights of present features."""

    bias: float
    places: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.places] = self.weights
        return out


def score_text(text: bytes, bias: float, dense: np.ndarray) -> float:
    hit = [p[dense[p] != 0] for p in features(text)]
    total = bias + float(dense[distinct(np.concatenate(hit))].sum(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(total, -60, 60))))


def feature_set(text: bytes) -> np.ndarray:
    """The distinct places of a whole text."""
    return distinct(np.concatenate(features(text))).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 4, alpha: float = 4.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0) -> Model:
    """FTRL-proximal with per-coordinate rates, rows (``feature_set``) in the order given; the bias starts at the base rate, unregularised.

    Without rows the score of any text is 1/11.
    """
    z, n, w = (np.zeros(1 << BITS, dtype=np.float64) for _ in range(3))
    base = (labels.sum() + 0.1) / (len(labels) + 1)
    bias, bias_n = float(np.log(base / (1 - base))) if len(labels) else float(np.log(0.1)), 1.0
    for _ in range(epochs):
        for places, y in zip(rows, labels, strict=True):
            g = 1 / (1 + np.exp(-np.clip(bias + w[places].sum(), -60, 60))) - y
            before = n[places]
            after = before + g * g
            z_now = z[places] + g - (np.sqrt(after) - np.sqrt(before)) / alpha * w[places]
            n[places], z[places] = after, z_now
            w[places] = np.where(np.abs(z_now) <= l1, 0.0, -(z_now - np.sign(z_now) * l1) / ((beta + np.sqrt(after)) / alpha + l2))
            bias_n += g * g
            bias -= 0.05 * g / np.sqrt(bias_n)
    kept = np.flatnonzero(w)
    return Model(float(bias), kept.astype(np.int64), w[kept].astype(np.float32))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_documents(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = MOST_LABELLED) -> Model:
    """From ``docs (doc_id, text)`` and labels that aren't held out.  Repeated labels of one id: the largest; null: none."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # at most `most` rows

    def extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        places = [feature_set(t).tobytes() for t in utf8(batch.column(1))]  # 4 bytes a feature: the fitting task gets no texts
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, type=pa.binary()), batch.column(2), pa.array(np.zeros(len(places), dtype=np.int32))], names=["doc_id", "places", "label", "all"])

    def train(given: pa.Table) -> pa.Table:
        ids, first = np.unique(given["doc_id"].to_numpy(), return_index=True)
        order = first[np.argsort(mix64(ids.astype(np.uint64)), kind="stable")]
        rows = [np.frombuffer(r, dtype=np.int32) for r in given["places"].take(order).to_pylist()]
        model = fit(rows, given["label"].to_numpy()[order].astype(np.float64))
        return pa.table([np.append(-1, model.places), np.append(model.bias, model.weights)], names=["place", "weight"])

    sets = map_batches(rows, extract, "doc_id long, places binary, label int, all int")
    found = sets.groupBy("all").applyInArrow(train, "place long, weight double").orderBy("place").collect()  # non-zero weights
    if not found:
        return fit([], np.zeros(0))
    return Model(found[0].weight, np.array([r.place for r in found[1:]], dtype=np.int64), np.array([r.weight for r in found[1:]], dtype=np.float32))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, held_out, score, predicted``.

    Only the text counts for the score; null and empty texts get the bias.  Null ids count as held out or not by the
    empty string; repeated rows are scored each; an empty table gives no row.
    """
    dense: list[np.ndarray] = []

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        claim(_words)
        if not dense:
            dense.append(model.dense())
        scores = [score_text(t, model.bias, dense[0]) for t in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, type=pa.float64())], names=["doc_id", "score"])

    scored = map_batches(id_text(docs, id_col, text_col), score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, without a shuffle: one pass scores and keeps."""
    model = fit_documents(id_text(docs, "doc_id", "text"), labels)
    names, at, dense = docs.columns, docs.columns.index("text"), []

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(_words)
        if not dense:
            dense.append(model.dense())
        for batch in batches:
            sizes = np.array([x or 0 for x in pa.compute.binary_length(batch.column(at)).to_pylist()], dtype=np.int64)
            for a, b in runs(sizes + 64):
                part = batch.slice(a, b - a)
                clean = [score_text(t, model.bias, dense[0]) < 0.5 for t in utf8(part.column(at))]
                yield part.filter(pa.array(clean, type=pa.bool_()))
        settle()

    return docs.select(*names).mapInArrow(keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit_documents(id_text(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
