"""Rows of resamples dealt to tasks that need them together, one task for each target, without a stop on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import matrix_of

#: ``(classes, mults) -> (target, places of rows, resample)`` of a batch.
Targets = Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, int]]]


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, dtype=np.float64).ravel()))


def deal(rows: DataFrame, p: int, resamples: int, targets: Targets, n: int, columns: list[np.ndarray] | None = None, of: int = 1) -> DataFrame:
    """``target, sample_id, cls, mult, h, features`` in one partition for each of ``n`` targets; ``columns`` has the features
    to send for each resample.  ``h`` is a hash of the id.  A partition takes ``of`` targets."""
    kind = dict(rows.dtypes)["sample_id"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mults = matrix_of(batch, "features", p), matrix_of(batch, "mults", resamples)
            for target, at, s in targets(np.array(batch.column(1).to_pylist(), dtype=object), mults):
                if len(at):
                    some, z = pa.array(at), x[at] if columns is None else x[np.ix_(at, columns[s])]
                    ids, cls, h = (batch.column(k).take(some) for k in (0, 1, 4))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), target, dtype=np.int32)), ids, cls, pa.array(mults[at, s].astype(np.int32)), h, lists(z)], names=["target", "sample_id", "cls", "mult", "h", "features"])

    rows = rows.select("sample_id", "cls", "features", "mults", F.xxhash64("sample_id").alias("h"))
    return rows.mapInArrow(send, f"target int, sample_id {kind}, cls string, mult int, h long, features array<double>").repartitionById(n, F.floor(F.col("target") / of).cast("int"))


def tasks(rows: DataFrame, resamples: int, most: int) -> int:
    """Targets for each resample, so that all cores have work."""
    return max(1, min(most, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // resamples)))


def enough(rows: DataFrame, most: int) -> None:
    """A user's function gets all rows of a resample in one task: more than ``most`` raise, as no sample would be theirs."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a user's function takes at most {most} rows: raise most_rows, or sample the rows yourself")


def received(batches: Iterator[pa.RecordBatch], by_id: bool = False) -> tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray] | None:
    """``target, ids, classes, mults, features`` of a partition of ``deal``, in the order of the ids' hashes, or of the ids."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    target, width = held[0].column(0)[0].as_py(), len(held[0].column(5)[0])
    ids, cls = (pa.concat_arrays([b.column(k) for b in held]) for k in (1, 2))
    mults, h = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in (3, 4))
    x, at = np.empty((len(h), width)), 0
    for k, b in enumerate(held):
        x[at : at + b.num_rows] = b.column(5).flatten().to_numpy().reshape(-1, width)
        at += b.num_rows
        held[k] = None
    place = pa.compute.rank(ids, tiebreaker="first").to_numpy()
    order = np.argsort(place) if by_id else np.lexsort((place, h))
    ids, cls = ids.take(pa.array(order)), cls.take(pa.array(order))
    return target, ids, np.array(cls.to_pylist(), dtype=object), mults[order], x[order]
