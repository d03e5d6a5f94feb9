"""Nearest neighbours by brute force in blocks: k-nearest-neighbour classes and ReliefF weights.

Every query is compared with every row, as in the definition.  A task holds a tile of at most ``TILE`` queries and what is
nearest to them so far; all rows pass by it in Arrow batches.  A matrix product bounds the distances of a batch, and only
pairs that may still be among the nearest get the exact one.  No distances of all pairs are kept anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import matrix_of, width

TILE = 32_768
#: Cells of a block of the matrix product, and pairs of exact distances taken at a time.
BLOCK, PAIRS = 1 << 20, 1 << 16


def _met(vectors: DataFrame, columns: list[str], passes: int = 1, asked: Column | None = None) -> DataFrame:
    """``tile, side`` and ``columns``: one partition for each tile, its queries (side 0) before all rows (side 1; with two
    passes once more as side 2)."""
    n, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, -(-n // TILE), min(cores, -(-n // 256)))
    tiles = tiles if tiles <= cores else -(-tiles // cores) * cores
    some = vectors if asked is None else vectors.where(asked)
    queries = some.select(F.pmod(F.xxhash64("sample_id"), F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("side"), *columns)
    every = vectors.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumn("side", F.explode(F.sequence(F.lit(1), F.lit(passes)))).select("tile", "side", *columns)
    return queries.unionByName(every).repartitionById(tiles, F.col("tile")).sortWithinPartitions("side")


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        side = batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), len(side)] if len(side) else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield int(side[a]), batch.slice(a, b - a)


class Near:
    """The nearest rows of some queries: for each, those at the k least distances counted with their weights and all at the
    last of them, or with ``ids`` the first k in the order of distance and id.  ``groups`` keeps k of each class."""

    def __init__(self, x: np.ndarray, k: int, groups: int = 1, by_id: bool = False) -> None:
        self.x, self.k, self.groups, self.by_id = x, k, groups, by_id
        self.last = np.full((len(x), groups), np.inf)  # the exact k-th distance so far
        self.center = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        z = x - self.center
        self.norm, self.size = (z * z).sum(axis=1), float(np.abs(x).max(initial=0))
        z = np.column_stack([z, np.ones(len(z))])  # the last place takes the other side's norm
        self.small = x.shape[1] > 16 and self.norm.max(initial=0) < 1e30
        self.z = z.astype(np.float32) if self.small else z
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = self.kept = 0

    def add(self, y: np.ndarray, marks: np.ndarray, weights: np.ndarray, group: int = 0, own: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Rows ``y`` with their marks (class numbers, or ids) and weights; with ``own`` the ids of the queries and of these
        rows, a query isn't its own neighbour."""
        if not len(self.x) or not len(y):
            return
        z = y - self.center
        norm = (z * z).sum(axis=1)
        top = float(norm.max())
        small = self.small and top < 1e30
        z = np.column_stack([-2 * z, norm])
        left, z, unit = (self.z, z.astype(np.float32), 2.0**-23) if small else (self.z.astype(float), z, 2.0**-52)
        size = max(self.size, float(np.abs(y).max()))
        step, k = max(1, BLOCK // len(y)), self.k + (own is not None)
        begun = np.isinf(self.last[:, group]).any()

        def below(near: np.ndarray, limit: np.ndarray) -> np.ndarray:
            return np.flatnonzero(near <= (limit.astype(np.float32) + np.abs(limit).astype(np.float32) * np.float32(1e-6) if small else limit)[:, None])

        for a in range(0, len(self.x), step):
            some = slice(a, a + step)
            q, last = self.norm[some], self.last[some, group]
            length = np.sqrt(q) + np.sqrt(top)
            slack = 2 * (y.shape[1] + 8) * unit * length**2 + 2.0**-48 * size * length + 1e-300
            near = left[some] @ z.T
            least = lambda: np.partition(near, k - 1, axis=1)[:, k - 1] + q + slack  # noqa: B023, E731
            if len(y) > k and np.isinf(last).any():
                last = np.minimum(last, least())
            hit = below(near, last - q + slack)
            if len(y) > k and len(hit) > 64 * k * len(q):  # rows that came in an unlucky order
                hit = below(near, np.minimum(last, least()) - q + slack)
            i, j = np.divmod(hit, len(y))
            if own is not None:
                other = own[0][i + a] != own[1][j]
                i, j = i[other], j[other]
            d = np.empty(len(i))
            for b in range(0, len(i), PAIRS):
                e = self.x[i[b : b + PAIRS] + a] - y[j[b : b + PAIRS]]
                d[b : b + PAIRS] = np.einsum("np,np->n", e, e)
            ok = d <= self.last[i + a, group]
            i, j, d = i[ok], j[ok], d[ok]
            self.held.append(((i + a) * self.groups + group, d, marks[j], weights[j]))
            self.waiting += len(i)
            if self.waiting > max(4 * self.kept, 8 * self.k * len(self.x), 1 << 18):
                self.settle()
        if begun and self.groups == 1:  # from now on the limits are known
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """``query * groups + group, distance, mark, weight`` in this order, what can't be among the nearest left out."""
        if not self.held:
            return np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        key, d, mark, weight = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((np.unique(mark, return_inverse=True)[1] if self.by_id else mark, d, key))
        key, d, mark, weight = key[order], d[order], mark[order], weight[order]
        if not self.by_id and len(key):  # equal distances of a class are one entry
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (d[1:] != d[:-1]) | (mark[1:] != mark[:-1])])
            weight = np.add.reduceat(weight, first)
            key, d, mark = key[first], d[first], mark[first]
        starts = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, dtype=bool)
        before = np.cumsum(weight) - weight
        group = starts if self.by_id else starts | np.r_[True, d[1:] != d[:-1]] if len(key) else starts
        of = np.cumsum(starts) - 1
        closer = before - before[np.flatnonzero(starts)][of] if len(key) else before
        if not self.by_id and len(key):
            at = np.flatnonzero(group)
            closer = closer[at][np.cumsum(group) - 1]
        keep = closer < self.k
        key, d, mark, weight, closer = key[keep], d[keep], mark[keep], weight[keep], closer[keep]
        if len(key):
            ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
            total = np.add.reduceat(weight, np.r_[0, ends[:-1] + 1])
            full = ends[total >= self.k]
            self.last.ravel()[key[full]] = d[full]
        self.held, self.waiting, self.kept = [(key, d, mark, weight)], 0, len(key)
        return self.held[0]


def knn_predict(vectors: DataFrame, resamples: int, k: int = 1, subsets: list[tuple[int, np.ndarray]] | None = None) -> DataFrame:
    """``sample_id, obs, split, pred, votes`` of the test rows (mults 0) of each resample by its training rows.

    ``subsets`` has a resample and the features to measure by for each split; without it the splits are the resamples.

    All rows at the k-th distance vote, a training row as often as it was drawn; the lowest label wins a tied vote.
    """
    from .frame import levels

    kind, p, labels = dict(vectors.dtypes)["sample_id"], width(vectors), levels(vectors)
    splits = subsets or [(r, np.arange(p)) for r in range(resamples)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[pa.RecordBatch] = []
        found: list[tuple[np.ndarray, Near]] = []

        def begin() -> None:
            x = np.concatenate([matrix_of(b, "features", p) for b in queries])
            mults = np.concatenate([matrix_of(b, "mults", resamples) for b in queries])
            for r, features in splits:
                at = np.flatnonzero(mults[:, r] == 0)
                found.append((at, Near(np.ascontiguousarray(x[np.ix_(at, features)]), k)))

        for side, batch in _sides(batches):
            if side == 0:
                queries.append(batch)
                continue
            if not queries:
                continue
            if not found:
                begin()
            x, mults = matrix_of(batch, "features", p), matrix_of(batch, "mults", resamples)
            code = np.searchsorted(labels, batch.column(3).to_pylist())
            for (r, features), (_, near) in zip(splits, found, strict=True):
                train = np.flatnonzero(mults[:, r] > 0)
                near.add(np.ascontiguousarray(x[np.ix_(train, features)]), code[train], mults[train, r].astype(np.int64))
        if not found:
            return
        ids, obs = (pa.concat_arrays([b.column(c) for b in queries]) for c in (2, 3))
        for s, (at, near) in enumerate(found):
            key, _, mark, weight = near.settle()
            if len(key):
                votes = np.zeros((len(at), len(labels)), dtype=np.int64)
                np.add.at(votes, (key, mark), weight)
                some = np.flatnonzero(votes.sum(axis=1))
                best, rows = votes[some].argmax(axis=1), pa.array(at[some])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), obs.take(rows), pa.array(np.full(len(some), s, dtype=np.int32)), pa.array(np.array(labels, dtype=object)[best], type=pa.string()), pa.array(votes[some, best])], names=["sample_id", "obs", "split", "pred", "votes"]
                )

    return _met(vectors, ["sample_id", "cls", "features", "mults"]).mapInArrow(work, f"sample_id {kind}, obs string, split int, pred string, votes long")


def fs_relief(vectors: DataFrame, names: list[str], k: int = 10, probes: DataFrame | None = None) -> DataFrame:
    """ReliefF: ``feature, feature_idx, stat, fs_rank``.  Every row is a probe unless ``probes (sample_id)`` names some.

    Per probe: less the mean difference to the k nearest of its class, plus those of the others weighted by
    prior / (1 - prior of its class); differences are divided by the feature's range.  A feature without range is last.
    Nearest of a class are in the order of distance and id.  A tile's rows pass twice: to find the nearest, and to sum
    the differences to them.
    """
    from .rank import ranked

    p = width(vectors)
    vectors = vectors.select("sample_id", "cls", "features")
    counts = {r[0]: r[1] for r in vectors.groupBy("cls").agg(F.count("*")).collect()}  # one row per class
    labels, total = sorted(counts), sum(counts.values())
    share = np.array([counts[c] / total for c in labels])
    asked = F.lit(True)
    if probes is not None:
        marked = probes.select("sample_id").distinct().withColumn("probe", F.lit(True))
        vectors, asked = vectors.join(marked, "sample_id", "left"), F.col("probe")
    n_probes = total if probes is None else probes.count()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[pa.RecordBatch] = []
        near, pairs, out = None, None, np.zeros(p)
        for side, batch in _sides(batches):
            if side == 0:
                queries.append(batch)
                continue
            if not queries:
                continue
            if near is None:
                x = np.concatenate([matrix_of(b, "features", p) for b in queries])
                own = np.searchsorted(labels, np.concatenate([b.column(3).to_pylist() for b in queries]))
                asking = np.concatenate([_ids(b.column(2)) for b in queries])
                near = Near(x, k, len(labels), by_id=True)
            y, ids = matrix_of(batch, "features", p), _ids(batch.column(2))
            if side == 1:
                code = np.searchsorted(labels, batch.column(3).to_pylist())
                for c in range(len(labels)):
                    some = np.flatnonzero(code == c)
                    near.add(y[some], ids[some], np.ones(len(some), dtype=np.int64), c, (asking, ids[some]))
                continue
            if pairs is None:
                key, _, mark, _ = near.settle()
                probe, other = np.divmod(key, len(labels))
                kk = np.bincount(key, minlength=len(own) * len(labels))[key]
                weight = np.where(other == own[probe], -1.0, share[other] / np.maximum(1 - share[own[probe]], 1e-300)) / kk / n_probes
                order = np.argsort(mark, kind="stable")
                pairs = mark[order], probe[order], weight[order]
                near.held.clear()
            first, last = np.searchsorted(pairs[0], ids), np.searchsorted(pairs[0], ids, "right")
            row = np.repeat(np.arange(len(ids)), last - first)
            at = np.arange(len(row)) + np.repeat(first - (np.cumsum(last - first) - (last - first)), last - first)
            for a in range(0, len(at), PAIRS):
                some = at[a : a + PAIRS]
                out += pairs[2][some] @ np.abs(x[pairs[1][some]] - y[row[a : a + PAIRS]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p)), pa.array(out)], names=["j", "v"])

    met = _met(vectors, ["sample_id", "cls", "features"], 2, asked)
    weights = met.mapInArrow(work, "j long, v double").groupBy("j").agg(F.sum("v").alias("v"))
    ranges = vectors.select(F.posexplode("features").alias("j", "value")).groupBy("j").agg((F.max("value") - F.min("value")).alias("r"))
    table = vectors.sparkSession.createDataFrame(list(enumerate(names)), "feature_idx int, feature string")
    stat = F.col("v") / F.nullif("r", F.lit(0.0))
    joined = weights.join(ranges.withColumn("j", F.col("j").cast("long")), "j").select(F.col("j").cast("int").alias("feature_idx"), stat.alias("stat"))
    return ranked(joined.join(table, "feature_idx").select("feature", "feature_idx", "stat"))


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist()) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
