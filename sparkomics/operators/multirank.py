"""Multivariate feature ranking: PCA, PLS and VIP statistics, recursive elimination, forest importance.

PCA and PLS rankings are algebra on one gathered cross-product.  Elimination fits the machine of each pair of classes on all
its rows, pairs and resamples dealt to tasks; the trees of forests are dealt the same way, each on all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bounded import MOST_OWN, TREES, columns_of, falls, linear_weights, over_error
from .dealt import deal, enough, received, tasks
from .frame import EPS, levels
from .models import PCA, PLS, cap_components
from .moments import Moments, gather, width
from .neighbours import fs_relief
from .rank import feature_ladder, ranked
from .resample import memberships


def table(vectors: DataFrame, names: list[str], stat: np.ndarray) -> DataFrame:
    """``feature, feature_idx, stat, fs_rank``: falling statistics, NaN last as null, ties by place."""
    clean = [None if v != v else float(v) for v in stat]
    order = sorted(range(len(names)), key=lambda j: (clean[j] is None, -(clean[j] or 0.0), j))
    place = {j: k + 1 for k, j in enumerate(order)}
    return vectors.sparkSession.createDataFrame([(names[j], j, clean[j], place[j]) for j in range(len(names))], "feature string, feature_idx int, stat double, fs_rank long")


def spread(rows: np.ndarray) -> np.ndarray:
    """sqrt((r - m)' S (r - m)) of each row, S their covariance: the covariance itself stands where its inverse would."""
    d = rows - rows.mean(axis=0)
    s = d.T @ d / max(len(rows) - 1, 1)
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, s, d), 0))


def pca_stat(m: Moments, threshold: float = 0.8) -> np.ndarray:
    """On the loadings of the components up to that share of variance, two at least; classes aren't used."""
    pca = PCA.fit(m)
    share = np.cumsum(pca.sdev**2) / max((pca.sdev**2).sum(), 1e-300)
    return spread(pca.rotation[:, : max(2, int(np.searchsorted(share, threshold - 1e-12) + 1))])


def pls_stat(m: Moments, ncomp: int = 10, pls: str = "simpls") -> np.ndarray:
    """On the PLS coefficients of the class indicators."""
    return spread(PLS.of_classes(m, ncomp, pls).coefficients())


def vip_stat(m: Moments, ncomp: int = 10) -> np.ndarray:
    """On the importance in projection for each class."""
    return spread(PLS.of_classes(m, ncomp, "oscorespls").vip())


def vip_mean(m: Moments, ncomp: int = 10) -> np.ndarray:
    """The mean absolute importance over the classes."""
    return np.abs(PLS.of_classes(m, ncomp, "oscorespls").vip()).mean(axis=1)


def vip_number(m: Moments, ncomp: int = 10) -> np.ndarray:
    """The importance for one response, the class number."""
    code = np.arange(1, len(m.labels) + 1, dtype=float)
    ymean = m.counts @ code / m.n
    xy = ((m.means - m.mean).T * m.counts) @ (code - ymean)
    return PLS.fit(m.total(), xy[:, None], m.mean, np.array([ymean]), cap_components(m, ncomp), "oscorespls").vip()[:, 0]


def fs_pca(vectors: DataFrame, names: list[str], threshold: float = 0.8) -> DataFrame:
    labelled = vectors.na.fill("", ["cls"])
    return table(vectors, names, pca_stat(gather(labelled, levels(labelled))[0], threshold))


def fs_pls(vectors: DataFrame, names: list[str], ncomp: int = 10, pls: str = "simpls") -> DataFrame:
    return table(vectors, names, pls_stat(gather(vectors, levels(vectors))[0], ncomp, pls))


def fs_plsvip(vectors: DataFrame, names: list[str], ncomp: int = 10) -> DataFrame:
    return table(vectors, names, vip_stat(gather(vectors, levels(vectors))[0], ncomp))


def fs_plsvip_1(vectors: DataFrame, names: list[str], ncomp: int = 10) -> DataFrame:
    return table(vectors, names, vip_mean(gather(vectors, levels(vectors))[0], ncomp))


def fs_plsvip_2(vectors: DataFrame, names: list[str], ncomp: int = 10) -> DataFrame:
    return table(vectors, names, vip_number(gather(vectors, levels(vectors))[0], ncomp))


def _eliminated(keeps: list[np.ndarray], lens, scored: Callable[[dict[int, np.ndarray]], dict[int, np.ndarray]]) -> list[np.ndarray]:
    """Places from the last of each resample's features after elimination down the ladder: at each length the kept prefix is
    ordered anew by its scores, the tail keeps its order.  One call scores a length of all resamples."""
    orders, ladders = [k.copy() for k in keeps], [feature_ladder(len(k), lens)[::-1] for k in keeps]
    for step in range(max(map(len, ladders), default=0)):
        now = {s: orders[s][: ladder[step]] for s, ladder in enumerate(ladders) if step < len(ladder)}
        for s, score in scored(now).items():
            orders[s][: len(now[s])] = now[s][np.argsort(-score, kind="stable")]
    out = []
    for keep, order in zip(keeps, orders, strict=True):
        place = dict(zip(order.tolist(), range(1, len(order) + 1), strict=True))
        out.append(np.array([len(order) - place[j] for j in keep.tolist()], dtype=float))
    return out


def _machine_weights(rows: DataFrame, states: list[Moments], kept: dict[int, np.ndarray], cost: float) -> dict[int, np.ndarray]:
    """Of each resample: the absolute weights of linear machines on its kept, scaled features, summed over pairs of classes."""
    p, labels = rows_width(states), states[0].labels
    has = {s: [k for k in range(len(labels)) if states[s].counts[k] > 0] for s in kept}
    if min(map(len, has.values())) < 2:
        raise ValueError("at least two classes are needed")
    pairs = [(s, a, b) for s in kept for i, a in enumerate(has[s]) for b in has[s][i + 1 :]]
    n = min(len(pairs), max(len(kept), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    dealt = np.array_split(np.arange(len(pairs)), n)  # pairs of few classes to a target
    meets: dict[tuple[int, int], list[int]] = {}
    for target, some in enumerate(dealt):
        for s, c in sorted({(pairs[i][0], c) for i in some for c in pairs[i][1:]}):
            meets.setdefault((s, c), []).append(target * len(states) + s)
    scales = {s: np.sqrt(np.diag(states[s].total())[kept[s]] / max(states[s].n - 1, 1)) for s in kept}
    columns = [kept.get(s, np.arange(0)) for s in range(len(states))]

    def targets(cls: np.ndarray, mults: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        for (s, c), into in meets.items():
            at = np.flatnonzero((cls == labels[c]) & (mults[:, s] > 0))
            for key in into:
                yield key, at, s

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, str], list] = {}
        for b in batches:
            keys, cls = b.column(0).to_numpy(), np.array(b.column(2).to_pylist(), dtype=object)
            for key in np.unique(keys).tolist():
                target, s = divmod(key, len(states))
                for c in set(cls[keys == key]):
                    at = np.flatnonzero((keys == key) & (cls == c))
                    some = b.take(pa.array(at))
                    held.setdefault((target, s, c), []).append((some.column(3).to_numpy(), some.column(5).flatten().to_numpy().reshape(len(at), -1) / scales[s]))
        for target in sorted({k[0] for k in held}):
            sums: dict[int, np.ndarray] = {}
            for i in dealt[target]:
                s, a, b = pairs[i]
                sides = [[np.concatenate(c) for c in zip(*held[target, s, labels[k]], strict=True)] for k in (a, b)]
                sign = np.repeat([1.0, -1.0], [len(side[0]) for side in sides])
                weight = np.abs(linear_weights(np.concatenate([side[1] for side in sides]), sign, cost * np.concatenate([side[0] for side in sides])))
                sums[s] = sums.get(s, 0) + weight
            for s, w in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([s]), pa.array([w.tolist()], type=pa.list_(pa.float64()))], names=["target", "s", "w"])

    # a target's rows of several resamples go to one partition; its key carries the resample
    sent = deal(rows, p, len(states), targets, n, columns, of=len(states))
    found = sent.mapInArrow(fit, "target long, s long, w array<double>").collect()  # a row of features for each target and resample
    out = {s: np.zeros(len(kept[s])) for s in kept}
    for r in sorted(found, key=lambda r: (r[0], r[1])):
        out[r[1]] += np.array(r[2])
    return out


def rows_width(states: list[Moments]) -> int:
    return states[0].means.shape[1]


def _rfe(rows: DataFrame, labels: list[str], resamples: int, lens="power2", cost: float = 1.0) -> list[np.ndarray]:
    rows = rows.persist()  # read again for each length
    states = gather(rows, labels, resamples)
    keeps = [varying(m) for m in states]
    stats = [np.full(rows_width(states), np.nan) for _ in states]
    for stat, keep, found in zip(stats, keeps, _eliminated(keeps, lens, lambda kept: _machine_weights(rows, states, kept, cost)), strict=True):
        stat[keep] = found
    rows.unpersist()
    return stats


def _forest_falls(rows: DataFrame, p: int, resamples: int, kept: dict[int, np.ndarray], trees: int, scaled: bool = False, seed: int = 1) -> dict[int, np.ndarray]:
    """Of each resample: the mean decrease in out-of-bag accuracy when a feature is permuted, over all trees."""
    parts = tasks(rows, len(kept), trees)
    columns, numbers = [kept.get(s, np.arange(0)) for s in range(resamples)], sorted(kept)

    def targets(cls: np.ndarray, mults: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        for k, s in enumerate(numbers):
            at = np.flatnonzero(mults[:, s] > 0)
            for part in range(parts):
                yield k * parts + part, at, s

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := received(batches)) is None:
            return
        target, _, cls, mults, x = got
        labels = sorted(set(cls))
        code, x = np.repeat(np.searchsorted(labels, cls), mults), columns_of(x)
        x = x if (mults == 1).all() else np.repeat(x, mults, axis=1)
        for t in range(target % parts, trees, parts):
            fall = falls(x, code, len(labels), seed, t)
            yield pa.RecordBatch.from_arrays([pa.array([numbers[target // parts]]), pa.array([t]), pa.array([fall.tolist()], type=pa.list_(pa.float64()))], names=["s", "t", "fall"])

    found = deal(rows, p, resamples, targets, parts * len(kept), columns).mapInArrow(work, "s long, t long, fall array<double>").collect()  # a row of features for each tree
    out = {}
    for s in numbers:
        v = np.array([r[2] for r in sorted(found, key=lambda r: r[1]) if r[0] == s])
        out[s] = over_error(v.mean(axis=0), v.std(axis=0, ddof=1), trees) if scaled else v.mean(axis=0)
    return out


def _rf(rows: DataFrame, labels: list[str], resamples: int, trees: int = TREES) -> list[np.ndarray]:
    states = gather(rows, labels, resamples)
    found = _forest_falls(rows, rows_width(states), resamples, {s: varying(m) for s, m in enumerate(states)}, trees)
    stats = [np.full(rows_width(states), np.nan) for _ in states]
    for s, stat in enumerate(stats):
        stat[varying(states[s])] = np.maximum(found[s], 0)
    return stats


def _rf_places(rows: DataFrame, labels: list[str], resamples: int, lens="power2", trees: int = TREES) -> list[np.ndarray]:
    rows = rows.persist()
    states = gather(rows, labels, resamples)
    p, keeps = rows_width(states), [varying(m) for m in states]
    stats = [np.full(p, np.nan) for _ in states]
    for stat, keep, found in zip(stats, keeps, _eliminated(keeps, lens, lambda kept: _forest_falls(rows, p, resamples, kept, trees, scaled=True)), strict=True):
        stat[keep] = found
    rows.unpersist()
    return stats


def _once(vectors: DataFrame) -> DataFrame:
    """All rows as the training rows of one resample."""
    return vectors.select("sample_id", "cls", "features", F.array(F.lit(1)).alias("mults"))


def fs_rfe(vectors: DataFrame, names: list[str], lens="power2", cost: float = 1.0) -> DataFrame:
    """Recursive elimination by the weights of linear support vector machines."""
    return table(vectors, names, _rfe(_once(vectors), levels(vectors), 1, lens, cost)[0])


def fs_rf(vectors: DataFrame, names: list[str], trees: int = TREES) -> DataFrame:
    """By the fall in out-of-bag accuracy under permutation, negatives as zero."""
    found = _forest_falls(_once(vectors), width(vectors), 1, {0: np.arange(len(names))}, trees)[0]
    return table(vectors, names, np.maximum(found, 0))


def fs_rf_1(vectors: DataFrame, names: list[str], lens="power2", trees: int = TREES) -> DataFrame:
    """Elimination down the ladder by that fall over its standard error."""
    found = _eliminated([np.arange(len(names))], lens, lambda kept: _forest_falls(_once(vectors), len(names), 1, kept, trees, scaled=True))
    return table(vectors, names, found[0])


#: Rankers by one gathered state, and by rows dealt to tasks.
BY_STATE = {"fs.pca": pca_stat, "fs.pls": pls_stat, "fs.plsvip": vip_stat, "fs.plsvip.1": vip_mean, "fs.plsvip.2": vip_number}
BY_ROWS = {"fs.rfe": _rfe, "fs.rf": _rf, "fs.rf.1": _rf_places}


def rank_resampled(vectors: DataFrame, names: list[str], splits: DataFrame, method: str | Callable, most_rows: int = MOST_OWN, **options) -> DataFrame:
    """``iter, rep, feature, feature_idx, stat, fs_rank``: a multivariate ranker on the training rows of every resample.

    PCA and PLS rankings of all resamples come from one pass.  Machines are dealt by pairs of classes and
    forests by trees.  A user's function ``method(x, y, **options)`` (one statistic for each column, higher is better) gets
    one task a resample, with all its rows (more than ``most_rows`` raise).  Drawn rows count as often as they were drawn.
    A feature without variation among the training rows has no statistic and is ranked last.  ReliefF ranks each
    resample in tiles.
    """
    places, resamples = memberships(splits)
    rows = vectors.select("sample_id", "cls", "features").join(places, "sample_id").select("sample_id", "cls", "features", "mults")
    if method == "fs.relief":
        return _relief_resampled(rows, names, resamples, **options)
    if isinstance(method, str) and method in BY_STATE:
        stats = []
        for m in gather(rows, levels(vectors), len(resamples)):
            keep, stat = varying(m), np.full(len(names), np.nan)
            stat[keep] = BY_STATE[method](m.select(keep), **options)
            stats.append(stat)
    elif isinstance(method, str) and method in BY_ROWS:
        stats = BY_ROWS[method](rows, levels(vectors), len(resamples), **options)
    elif callable(method):
        enough(rows, most_rows)
        stats = _each_resample(rows, len(resamples), len(names), method, options)
    else:
        raise ValueError(f"unknown ranker: {method}")
    cells = [(i, r, n, j, None if v != v else float(v)) for (i, r), stat in zip(resamples, stats, strict=True) for j, (n, v) in enumerate(zip(names, stat, strict=True))]
    return ranked(rows.sparkSession.createDataFrame(cells, "iter int, rep int, feature string, feature_idx int, stat double"), ["iter", "rep"])


def varying(m: Moments) -> np.ndarray:
    """The features that vary among the rows of a state."""
    return np.flatnonzero(np.sqrt(np.maximum(np.diag(m.total()), 0) / max(m.n - 1, 1)) > EPS)


def _each_resample(rows: DataFrame, n: int, p: int, score: Callable, options: dict) -> list[np.ndarray]:
    def targets(cls: np.ndarray, mults: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        for s in range(n):
            yield s, np.flatnonzero(mults[:, s] > 0), s

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := received(batches, by_id=True)) is None:
            return
        s, _, y, mults, x = got
        if (mults != 1).any():
            x, y = np.repeat(x, mults, axis=0), np.repeat(y, mults)
        keep, stat = np.flatnonzero([c.std() > EPS for c in x.T]), np.full(p, np.nan)
        stat[keep] = score(x if len(keep) == p else x[:, keep], y, **options)
        yield pa.RecordBatch.from_arrays([pa.array([s], type=pa.int64()), pa.array([stat.tolist()], type=pa.list_(pa.float64()))], names=["s", "stat"])

    found = deal(rows, p, n, targets, n).mapInArrow(work, "s long, stat array<double>").collect()  # one row per resample
    return [np.array(r[1], dtype=float) for r in sorted(found, key=lambda r: r[0])]


def _relief_resampled(rows: DataFrame, names: list[str], resamples: list[tuple[int, int]], **options) -> DataFrame:
    out = None
    for s, (i, r) in enumerate(resamples):
        copies = F.explode(F.sequence(F.lit(1), F.get("mults", F.lit(s))))
        train = rows.where(F.get("mults", F.lit(s)) > 0).withColumn("copy", copies).select(F.concat_ws("#", "sample_id", "copy").alias("sample_id"), "cls", "features")
        part = fs_relief(train, names, **options).select(F.lit(i).alias("iter"), F.lit(r).alias("rep"), "feature", "feature_idx", "stat", "fs_rank")
        out = part if out is None else out.unionByName(part)
    return out
