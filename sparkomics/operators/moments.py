"""Class counts, means and centred cross-products of a vector frame, in one pass: what every linear model here is fitted from.

Each task folds its Arrow batches into one small state (Chan's update, so nothing cancels), states are summed in two
levels, and the driver gets one matrix of features squared for each resample.  PCA, LDA, PLS and OSC are then algebra
on that matrix, whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features up to which a cross-product matrix (8 bytes a cell: 128 MB) goes to the driver.
MOST_FEATURES = 4096
#: Bytes of all resamples' states that may come to the driver.
MOST_BYTES = 1 << 30
FAN_IN = 32


@dataclass
class Moments:
    """counts (g), means (g, p), within (p, p) or by class (g, p, p): sums of squares about the class means."""

    labels: list[str]
    counts: np.ndarray
    means: np.ndarray
    within: np.ndarray

    @classmethod
    def empty(cls, labels: list[str], p: int, by_class: bool = False) -> Moments:
        g = len(labels)
        return cls(labels, np.zeros(g), np.zeros((g, p)), np.zeros((g, p, p) if by_class else (p, p)))

    @property
    def n(self) -> float:
        return float(self.counts.sum())

    @property
    def pooled(self) -> np.ndarray:
        return self.within.sum(axis=0) if self.within.ndim == 3 else self.within

    @property
    def mean(self) -> np.ndarray:
        return self.counts @ self.means / max(self.n, 1.0)

    def total(self) -> np.ndarray:
        """Sums of squares about the overall mean."""
        d = self.means - self.mean
        return self.pooled + (d.T * self.counts) @ d

    def add(self, k: int, x: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Folds in rows of class ``k``."""
        n = float(len(x) if weight is None else weight.sum())
        if not n:
            return
        mean = x.mean(axis=0) if weight is None else weight @ x / n
        c = x - mean
        self._merge(k, n, mean, c.T @ c if weight is None else (c.T * weight) @ c)

    def _merge(self, k: int, n: float, mean: np.ndarray, cross: np.ndarray) -> None:
        old = self.counts[k]
        d = mean - self.means[k]
        cross = cross + np.outer(d, d) * (old * n / (old + n))
        if self.within.ndim == 3:
            self.within[k] += cross
        else:
            self.within += cross
        self.means[k] += d * (n / (old + n))
        self.counts[k] = old + n

    def merge(self, other: Moments) -> None:
        """Of disjoint rows."""
        zero = np.zeros((self.means.shape[1],) * 2)
        for k, n in enumerate(other.counts):
            if n:
                self._merge(k, n, other.means[k], other.within[k] if self.within.ndim == 3 else zero)
        if self.within.ndim == 2:
            self.within += other.within

    def project(self, center: np.ndarray, matrix: np.ndarray) -> Moments:
        """Of the rows (x - center) @ matrix."""
        within = np.einsum("ia,...ij,jb->...ab", matrix, self.within, matrix, optimize=True)
        return Moments(self.labels, self.counts, (self.means - center) @ matrix, within)

    def select(self, keep: np.ndarray) -> Moments:
        return Moments(self.labels, self.counts, self.means[:, keep], self.within[..., keep[:, None], keep])

    def pack(self) -> bytes:
        return np.concatenate([self.counts, self.means.ravel(), self.within.ravel()]).tobytes()

    @classmethod
    def unpack(cls, blob: bytes, labels: list[str], p: int, by_class: bool) -> Moments:
        flat, g = np.frombuffer(blob, dtype=np.float64).copy(), len(labels)
        return cls(labels, flat[:g], flat[g : g + g * p].reshape(g, p), flat[g + g * p :].reshape((g, p, p) if by_class else (p, p)))


def matrix_of(batch: pa.RecordBatch, column: str, p: int) -> np.ndarray:
    """The rows of an array column; one of another length or with a null cell is an error."""
    values = batch.column(batch.schema.get_field_index(column))
    flat = values.flatten()
    if values.null_count or flat.null_count or len(flat) != len(values) * p:
        raise ValueError(f"every row needs {p} values without nulls: fill or drop missing values first")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, p)


def width(vectors: DataFrame) -> int:
    first = vectors.select(F.size("features")).first()
    if first is None:
        raise ValueError("no rows")
    if first[0] > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    return first[0]


def gather(vectors: DataFrame, labels: list[str], resamples: int = 0, by_class: bool = False) -> list[Moments]:
    """One state for each resample (``mults`` has the training multiplicities), or one for all rows.

    Rows whose label isn't in ``labels`` are an error for a later model and are left out here.
    """
    p, place = width(vectors), {c: i for i, c in enumerate(labels)}
    g = len(labels)
    if 8 * max(1, resamples) * p * p * (g if by_class else 1) > MOST_BYTES:
        raise ValueError("these resamples need more than MOST_BYTES on the driver; use fewer features or resamples at a time")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = [Moments.empty(labels, p, by_class) for _ in range(max(1, resamples))]
        for batch in batches:
            x = matrix_of(batch, "features", p)
            k = np.array([place.get(c, -1) for c in batch.column(0).to_pylist()])
            weight = matrix_of(batch, "mults", resamples).astype(float) if resamples else None
            for c in range(g):
                mine = k == c
                if mine.any():
                    for s, state in enumerate(states):
                        state.add(c, x[mine], None if weight is None else weight[mine, s])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(states)), type=pa.int32()), pa.array([s.pack() for s in states], type=pa.binary())], names=["k", "state"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        out = Moments.empty(labels, p, by_class)
        for blob in frame["state"]:
            out.merge(Moments.unpack(blob, labels, p, by_class))
        return pd.DataFrame({"k": frame["k"].iloc[:1].to_numpy(), "part": frame["part"].iloc[:1].to_numpy(), "state": [out.pack()]})

    cells = vectors.select("cls", "features", *(["mults"] if resamples else [])).mapInArrow(fold, "k int, state binary")
    rows = merge_tree(cells, merged, "k int, part long, state binary").collect()  # one row per resample, within MOST_BYTES
    return [Moments.unpack(r.state, labels, p, by_class) for r in sorted(rows, key=lambda r: r.k)]


def merge_tree(cells: DataFrame, merged: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``cells (k, state)``, one for each task and ``k``, merged to one for each ``k``: first those of ``FAN_IN`` tasks, then of
    ``FAN_IN`` such groups, then the rest, which are ``FAN_IN`` at most up to FAN_IN ** 3 tasks.  ``merged`` keeps ``part``."""
    cells = cells.withColumn("part", F.spark_partition_id().cast("long"))
    for _ in range(2):
        cells = cells.groupBy("k", F.floor(F.col("part") / FAN_IN).alias("up")).applyInPandas(lambda f: merged(f.assign(part=f["part"] // FAN_IN)), schema)
    return cells.groupBy("k").applyInPandas(lambda f: merged(f), schema)
