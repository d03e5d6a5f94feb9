"""Correlation and clustering of features.

Pearson's r of all pairs is one pass: each task sums five features-squared matrices under the observed masks, so pairs
are complete pairwise.  Spearman's ranks come from ``summary.value_ranks``; with missing values, and for Kendall, each
pair of features is ranked on its own complete rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import attach
from .moments import MOST_FEATURES, merge_tree
from .summary import value_ranks

SCHEMA = "feature_1 string, feature_2 string, idx_1 int, idx_2 int, n long, cor double"
#: Rows up to which a pair of features with missing values is ranked in one task.
MOST_PAIR = 20_000_000
#: Rows of a bucket of Kendall's counts, about.
BUCKET_ROWS = 200_000


def feature_names(long: DataFrame) -> list[tuple[int, str]]:
    found = sorted((r[0], r[1]) for r in long.select("feature_idx", "feature").distinct().limit(MOST_FEATURES + 1).collect())
    if len(found) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    return found


def _sample_vectors(long: DataFrame, names: list[tuple[int, str]]) -> DataFrame:
    """``sample_id, features`` in the order of ``names``, null where a cell is missing."""
    place = {i: k for k, (i, _) in enumerate(names)}
    table = long.sparkSession.createDataFrame([(i, k) for i, k in place.items()], "feature_idx int, k int")
    cells = long.join(F.broadcast(table), "feature_idx").groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m"))  # one entry per feature
    return cells.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.try_element_at("m", k)).alias("features"))


def _sums(vectors: DataFrame, p: int, split: int | None = None) -> list[np.ndarray]:
    """n, sum x, sum x^2, sum xy over complete pairs; columns from ``split`` on are the second side when given."""
    q = slice(0, p) if split is None else slice(0, split)
    r = slice(0, p) if split is None else slice(split, p)
    shape = (q.stop - q.start, r.stop - r.start)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, *shape))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
            if not len(x):
                continue
            seen = ~np.isnan(x)
            x = np.where(seen, x, 0.0)
            m = seen.astype(float)
            a, b, ma, mb = x[:, q], x[:, r], m[:, q], m[:, r]
            total += np.stack([ma.T @ mb, a.T @ mb, ma.T @ b, (a * a).T @ mb, ma.T @ (b * b), a.T @ b])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], type=pa.binary())], names=["k", "state"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(6 * shape[0] * shape[1])
        for blob in frame["state"]:
            out += np.frombuffer(blob)
        return pd.DataFrame({"k": [0], "part": frame["part"].iloc[:1].to_numpy(), "state": [out.tobytes()]})

    cells = vectors.select("features").mapInArrow(fold, "k long, state binary")
    rows = merge_tree(cells, merged, "k long, part long, state binary").collect()  # one row
    flat = np.frombuffer(rows[0].state) if rows else np.zeros(6 * shape[0] * shape[1])
    return list(flat.reshape(6, *shape))


def _r(sums: list[np.ndarray]) -> np.ndarray:
    n, sx, sy, sxx, syy, sxy = sums
    with np.errstate(all="ignore"):
        top = sxy - sx * sy / n
        var = (sxx - sx * sx / n) * (syy - sy * sy / n)
        r = np.where((n >= 2) & (var > 0), top / np.sqrt(np.where(var > 0, var, 1)), np.nan)
    return np.clip(r, -1, 1)


def _centred(long: DataFrame) -> DataFrame:
    """Less each feature's mean, so that sums of squares don't cancel."""
    means = long.groupBy("feature").agg(F.avg("value").alias("m"))
    return attach(long, means, ["feature"]).withColumn("value", F.col("value") - F.col("m")).drop("m")


def _ranks(long: DataFrame) -> DataFrame:
    """Values replaced by mid-ranks; long must have no missing value."""
    ranks = value_ranks(long.withColumn("cls", F.lit("")))
    return long.join(ranks.select("feature", "value", "midrank"), ["feature", "value"]).select("sample_id", "cls", "feature", "feature_idx", F.col("midrank").alias("value"))


def _pairwise(long: DataFrame) -> DataFrame:
    """By pair of features on its complete rows, each pair in one task; Spearman's with missing values."""
    a = long.select("sample_id", F.col("feature").alias("feature_1"), F.col("feature_idx").alias("idx_1"), F.col("value").alias("x")).where("x is not null")
    b = long.select("sample_id", F.col("feature").alias("feature_2"), F.col("feature_idx").alias("idx_2"), F.col("value").alias("y")).where("y is not null")
    pairs = a.join(b, "sample_id").where("idx_1 < idx_2")

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MOST_PAIR:
            raise ValueError(f"more than {MOST_PAIR} rows in a pair")
        x, y = frame["x"].to_numpy(), frame["y"].to_numpy()
        r = float(np.corrcoef(frame["x"].rank(), frame["y"].rank())[0, 1]) if len(x) > 1 and x.std() and y.std() else np.nan
        return pd.DataFrame({"feature_1": frame["feature_1"].iloc[:1], "feature_2": frame["feature_2"].iloc[:1], "idx_1": frame["idx_1"].iloc[:1].astype("int32"), "idx_2": frame["idx_2"].iloc[:1].astype("int32"), "n": [len(x)], "cor": [r]})

    return pairs.groupBy("idx_1", "idx_2").applyInPandas(each, SCHEMA)


def discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs of rows that x and y order differently: inversions of y in the order of x, in O(n log n)."""
    n = -(-len(x) // 64) * 64
    now = np.append(np.unique(y[np.lexsort((y, x))], return_inverse=True)[1], np.full(n - len(x), len(x)))  # what fills up is last and largest
    blocks, width = now.reshape(-1, 64), 64
    inversions = sum(int(np.count_nonzero(blocks[:, :-i] > blocks[:, i:])) for i in range(1, 64))
    now = np.sort(blocks, axis=1).ravel()
    while width < n:
        for a in range(0, n - width, 2 * width):
            left, right = now[a : a + width], now[a + width : a + 2 * width]
            inversions += int((len(left) - np.searchsorted(left, right, "right")).sum())
            now[a : a + 2 * width] = np.sort(now[a : a + 2 * width], kind="stable")
        width *= 2
    return inversions


def tied_pairs(*columns: np.ndarray) -> int:
    """Pairs of rows that are equal in all columns."""
    order = np.lexsort(columns)
    new = np.logical_or.reduce([np.diff(c[order]) != 0 for c in columns])
    sizes = np.diff(np.flatnonzero(np.r_[True, new, True])) if len(order) else np.empty(0, dtype=np.int64)
    return int((sizes * (sizes - 1) // 2).sum())


def kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Tau-b in O(n log n)."""
    n = len(x)
    if n < 2:
        return float("nan")
    return _tau_b(n, tied_pairs(x), tied_pairs(y), tied_pairs(x, y), discordant(x, y))


def _tau_b(n: int, tied_x: int, tied_y: int, tied: int, inverted: int) -> float:
    pairs = n * (n - 1) // 2
    low = float(pairs - tied_x) ** 0.5 * float(pairs - tied_y) ** 0.5
    return float(pairs - tied_x - tied_y + tied - 2 * inverted) / low if low else float("nan")


def _kendall(long: DataFrame, names: list[tuple[int, str]]) -> DataFrame:
    """Tau-b of all pairs of features, each on its complete rows.

    Quantiles cut each feature into buckets, and a value so frequent that it is a quantile has one of its own.  Pairs of rows
    that differ in both buckets follow from the counts of the cells.  Those of one bucket of x are counted in the task that
    gets it, those of one bucket of y that differ in the bucket of x likewise; a bucket of a single value has none.
    """
    p, rows = len(names), long.where("value is not null").count() // max(1, len(names))
    buckets = int(min(1024, max(8, rows // BUCKET_ROWS)))
    found = long.groupBy("feature_idx").agg(F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 10_000).alias("c")).collect()
    cuts = {r[0]: np.unique(np.array(r[1] or [], dtype=float)) for r in found}
    cuts = [cuts[i] for i, _ in names]
    pairs = [(a, b) for a in range(p) for b in range(a + 1, p)]

    def bucket(v: np.ndarray, k: int) -> np.ndarray:
        at = np.searchsorted(cuts[k], v)
        return 2 * at + (np.append(cuts[k], np.nan)[at] == v)  # odd: the cut itself

    def columns(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros((2 * len(cuts[a]) + 1, 2 * len(cuts[b]) + 1), dtype=np.int64) for a, b in pairs]
        for batch in batches:
            x = columns(batch)
            at = [bucket(x[:, k], k) for k in range(p)]
            for i, (a, b) in enumerate(pairs):
                ok = ~(np.isnan(x[:, a]) | np.isnan(x[:, b]))
                np.add.at(counts[i], (at[a][ok], at[b][ok]), 1)
        for i, c in enumerate(counts):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([c.tobytes()], type=pa.binary())], names=["k", "state"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, dtype=np.int64) for b in frame["state"])
        return pd.DataFrame({"k": frame["k"].iloc[:1].to_numpy(), "part": frame["part"].iloc[:1].to_numpy(), "state": [total.tobytes()]})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = columns(batch)
            at = [bucket(x[:, k], k) for k in range(p)]
            for i, (a, b) in enumerate(pairs):
                ok = ~(np.isnan(x[:, a]) | np.isnan(x[:, b]))
                for side, (u, v) in enumerate(((a, b), (b, a))):
                    some = np.flatnonzero(ok & (at[u] % 2 == 0))
                    if len(some):
                        group = (at[u][some] * len(pairs) + i) * 2 + side
                        yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(x[some, u]), pa.array(x[some, v]), pa.array(at[v][some])], names=["g", "u", "v", "w"])

    def count(table: pa.Table) -> pa.Table:
        g, u, v, w = (table[c].to_numpy() for c in ("g", "u", "v", "w"))
        side = int(g[0]) % 2
        if side == 0:  # of x: all pairs of the bucket
            inside, both = discordant(u, v), tied_pairs(u, v)
        else:  # of y: pairs of different buckets of x; equal rows where the bucket of x is a value
            odd = w % 2 == 1
            inside, both = discordant(w, u), tied_pairs(w[odd], u[odd])
        return pa.table({"pair": pa.array([int(g[0]) // 2 % len(pairs)]), "side": pa.array([side]), "tied": pa.array([tied_pairs(u)]), "both": pa.array([both]), "inside": pa.array([inside])})

    if p <= 32:  # one sum for each feature, in generated code
        vectors = long.groupBy("sample_id").agg(F.array(*[F.max(F.when(F.col("feature_idx") == i, F.col("value"))) for i, _ in names]).alias("features")).select("features")
    else:
        vectors = _sample_vectors(long, names).select("features")
    tables = merge_tree(vectors.mapInArrow(cells, "k long, state binary"), merged, "k long, part long, state binary").collect()  # one row for each pair of features
    counts = {r.k: np.frombuffer(r.state, dtype=np.int64).reshape(2 * len(cuts[pairs[r.k][0]]) + 1, -1) for r in tables}
    groups = vectors.mapInArrow(deal, "g long, u double, v double, w long").groupBy("g").applyInArrow(count, "pair long, side long, tied long, both long, inside long")
    sums = {(r[0], r[1]): r[2:] for r in groups.groupBy("pair", "side").agg(*[F.sum(c) for c in ("tied", "both", "inside")]).collect()}
    out, two = [], lambda c: int((c.astype(object) * (c.astype(object) - 1) // 2).sum()) if c.size else 0
    for i, (a, b) in enumerate(pairs):
        c = counts.get(i, np.zeros((1, 1), dtype=np.int64))
        (tx, bx, dx), (ty, by, dy) = (sums.get((i, side), (0, 0, 0)) for side in (0, 1))
        after = np.cumsum(c[::-1], axis=0)[::-1] - c  # rows of later buckets of x
        less = np.cumsum(after, axis=1) - after  # of these, earlier buckets of y
        apart = sum(int(k) * int(m) for k, m in zip(c.ravel().tolist(), less.ravel().tolist(), strict=True) if k and m)
        tied_x, tied_y = tx + two(c.sum(axis=1)[1::2]), ty + two(c.sum(axis=0)[1::2])
        tau = _tau_b(int(c.sum()), tied_x, tied_y, bx + by + two(c[1::2, 1::2]), apart + dx + dy)
        out.append((names[a][1], names[b][1], names[a][0], names[b][0], int(c.sum()), None if tau != tau else tau))
    return long.sparkSession.createDataFrame([r for r in out if r[4]], SCHEMA)


def correlations(long: DataFrame, method: str = "pearson") -> DataFrame:
    """``feature_1, feature_2, idx_1, idx_2, n, cor`` for idx_1 < idx_2; null where nothing varies."""
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown method: {method}")
    if method == "spearman" and not long.where("value is null").isEmpty():
        return _pairwise(long)
    names = feature_names(long)
    if method == "kendall":
        return _kendall(long, names)
    rows = _ranks(long) if method == "spearman" else long
    sums = _sums(_sample_vectors(_centred(rows), names), len(names))
    r, n = _r(sums), sums[0]
    i, j = np.triu_indices(len(names), 1)
    table = pd.DataFrame({"feature_1": [names[a][1] for a in i], "feature_2": [names[b][1] for b in j], "idx_1": np.array([names[a][0] for a in i], dtype="int32"), "idx_2": np.array([names[b][0] for b in j], dtype="int32"), "n": n[i, j].astype("int64"), "cor": r[i, j]})
    arrow = pa.Table.from_pandas(table, preserve_index=False)
    arrow = arrow.set_column(5, "cor", pa.array(r[i, j], from_pandas=True, type=pa.float64()))
    return long.sparkSession.createDataFrame(arrow, SCHEMA) if len(table) else long.sparkSession.createDataFrame([], SCHEMA)


def cor_cut(long: DataFrame, cutoff: float = 0.75, absolute: bool = False, method: str = "pearson") -> DataFrame:
    """Pairs at or above the cutoff: ``com1`` (the later feature), ``com2``, ``cor``."""
    r = correlations(long, method)
    return r.where((F.abs("cor") if absolute else F.col("cor")) >= cutoff).select(F.col("feature_2").alias("com1"), F.col("feature_1").alias("com2"), "cor")


def cross_correlations(first: DataFrame, second: DataFrame, method: str = "pearson") -> DataFrame:
    """Every feature of one long frame against every one of another, over the samples without any missing cell."""
    a, b = feature_names(first), feature_names(second)
    whole = lambda f, k: f.groupBy("sample_id").agg(F.count("value").alias("c")).where(F.col("c") == k).select("sample_id")
    ids = whole(first, len(a)).join(whole(second, len(b)), "sample_id")
    shift = len(a)
    moved = second.select("sample_id", F.lit(None).cast("string").alias("cls"), "feature", (F.lit(shift) + F.col("feature_idx")).cast("int").alias("feature_idx"), "value")
    base = {i: k for k, (i, _) in enumerate(a)}
    if sorted(base) != list(range(shift)):
        raise ValueError("feature_idx must run from 0")
    both = first.select("sample_id", F.lit(None).cast("string").alias("cls"), "feature", F.col("feature_idx").cast("int").alias("feature_idx"), "value")
    both = both.withColumn("feature", F.concat(F.lit("1:"), "feature")).unionByName(moved.withColumn("feature", F.concat(F.lit("2:"), "feature"))).join(ids, "sample_id", "left_semi")
    rows = _ranks(both) if method == "spearman" else both
    names = [(i, n) for i, n in a] + [(shift + i, n) for i, n in b]
    r = _r(_sums(_sample_vectors(_centred(rows), names), len(names), split=shift))
    cells = [(a[i][1], b[j][1], float(r[i, j]) if r[i, j] == r[i, j] else None) for i in range(len(a)) for j in range(len(b))]
    return first.sparkSession.createDataFrame(cells, "feature_1 string, feature_2 string, cor double")


def square(cor: DataFrame) -> tuple[list[str], np.ndarray]:
    """The full symmetric matrix of ``correlations`` on the driver: features squared, at most MOST_FEATURES squared."""
    rows = cor.toPandas()
    names = dict(zip(rows["idx_1"], rows["feature_1"], strict=True)) | dict(zip(rows["idx_2"], rows["feature_2"], strict=True))
    order = sorted(names)
    place = {i: k for k, i in enumerate(order)}
    m = np.eye(len(order))
    i, j = rows["idx_1"].map(place).to_numpy(dtype=int), rows["idx_2"].map(place).to_numpy(dtype=int)
    m[i, j] = m[j, i] = rows["cor"].to_numpy(dtype=float)
    return [names[i] for i in order], m


def complete_linkage(d: np.ndarray) -> tuple[list[tuple[int, int, float]], list[int]]:
    """Merges (left, right, height; node n + k is merge k) in rising height, and the leaf order, by nearest-neighbour chains."""
    n = len(d)
    d = np.array(d, dtype=float)
    np.fill_diagonal(d, np.inf)
    live, chain, raw = np.ones(n, dtype=bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        while True:
            at = chain[-1]
            row = np.where(live, d[at], np.inf)
            best = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[best]:
                best = chain[-2]
                break
            chain.append(best)
        a, b = chain.pop(), chain.pop()
        raw.append((min(a, b), max(a, b), float(d[a, b])))
        keep, gone = min(a, b), max(a, b)
        d[keep] = d[:, keep] = np.maximum(d[a], d[b])
        d[keep, keep] = np.inf
        live[gone] = False
    raw.sort(key=lambda m: m[2])
    parent, node, merges = list(range(n)), list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, b, h) in enumerate(raw):
        ra, rb = root(a), root(b)
        x, y = sorted((node[ra], node[rb]), key=lambda v: (v >= n, v))
        merges.append((x, y, h))
        parent[max(ra, rb)] = min(ra, rb)
        node[min(ra, rb)] = n + k
    order, todo = [], [2 * n - 2] if n > 1 else list(range(n))
    while todo:
        v = todo.pop()
        if v < n:
            order.append(v)
        else:
            todo += [merges[v - n][1], merges[v - n][0]]
    return merges, order


def cut_tree(merges: list[tuple[int, int, float]], n: int, height: float) -> list[int]:
    """Cluster numbers from 1, in the order of first appearance."""
    group = list(range(n))
    members = {i: [i] for i in range(n)}
    for k, (a, b, h) in enumerate(merges):
        members[n + k] = members[a] + members[b]
        if h <= height:
            least = min(group[i] for i in members[n + k])
            for i in members[n + k]:
                group[i] = least
    number: dict[int, int] = {}
    return [number.setdefault(g, len(number) + 1) for g in group]


def cor_hcl(long: DataFrame, cutoff: float = 0.75, method: str = "pearson") -> DataFrame:
    """``feature, cluster, size, leaf``: complete linkage on 1 - r cut at 1 - cutoff, and the dendrogram's leaf order.

    Clusters of one feature have a null number.
    """
    names, r = square(correlations(long, method))
    merges, order = complete_linkage(1 - np.nan_to_num(r))
    groups = cut_tree(merges, len(names), 1 - cutoff)
    place = {v: k for k, v in enumerate(order)}
    sizes = {g: groups.count(g) for g in set(groups)}
    number = {g: k + 1 for k, g in enumerate(g for g in dict.fromkeys(groups) if sizes[g] > 1)}
    rows = [(n, number.get(g), sizes[g], place[i]) for i, (n, g) in enumerate(zip(names, groups, strict=True))]
    return long.sparkSession.createDataFrame(rows, "feature string, cluster long, size long, leaf long")


def cor_heat(long: DataFrame, method: str = "pearson") -> tuple[DataFrame, DataFrame]:
    """Plot data of a heatmap: cells with their places in dendrogram order, and the merges of the dendrogram."""
    names, r = square(correlations(long, method))
    merges, order = complete_linkage(1 - np.nan_to_num(r))
    place = {v: k for k, v in enumerate(order)}
    cells = [(names[i], names[j], place[i], place[j], float(r[i, j]) if r[i, j] == r[i, j] else None) for i in range(len(names)) for j in range(len(names))]
    spark = long.sparkSession
    return spark.createDataFrame(cells, "feature_1 string, feature_2 string, place_1 long, place_2 long, cor double"), spark.createDataFrame([(k, a, b, h) for k, (a, b, h) in enumerate(merges)], "merge long, left long, right long, height double")


def cor_heat_gram(first: DataFrame, second: DataFrame, method: str = "pearson") -> DataFrame:
    """Cross-correlations with both axes in the order of clusters of their Euclidean profiles."""
    rows = cross_correlations(first, second, method).toPandas()
    m = rows.pivot(index="feature_1", columns="feature_2", values="cor").fillna(0.0)
    places = []
    for block in (m.to_numpy(), m.to_numpy().T):
        d = np.sqrt(np.maximum(((block[:, None, :] - block[None, :, :]) ** 2).sum(axis=2), 0)) if len(block) <= 512 else _distances(block)
        places.append({v: k for k, v in enumerate(complete_linkage(d)[1])})
    i, j = {n: places[0][k] for k, n in enumerate(m.index)}, {n: places[1][k] for k, n in enumerate(m.columns)}
    cells = [(a, b, i[a], j[b], c if c == c else None) for a, b, c in rows.itertuples(index=False)]
    return first.sparkSession.createDataFrame(cells, "feature_1 string, feature_2 string, place_1 long, place_2 long, cor double")


def _distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(axis=1)
    return np.sqrt(np.maximum(s[:, None] + s - 2 * x @ x.T, 0))
