"""Resampled error estimates: one classifier, several, by pairs of classes, over feature counts, and tuning.

A plan's multiplicities travel with each row as one array.  Linear classifiers (lda, qda, pcalda, plsc, plslda) of all
resamples are fitted from one pass over the rows, and one map predicts every test row of every resample; k nearest
neighbours go in tiles.  The trees of randomForest are dealt over tasks, and a user's classifier has a task for each
resample; such a task gets all rows of its resample and predicts its test rows, so that no model leaves it.  svm is
fitted on its bounded sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluate, models
from .bounded import BOUNDED, MOST_OWN, TREES, columns_of, sample, tree
from .dealt import deal, enough, lists, received, tasks
from .frame import EPS, class_pairs, levels
from .moments import Moments, gather, matrix_of, width
from .multirank import varying
from .neighbours import knn_predict
from .rank import borda, feature_ladder, name_of, rank_resampled
from .resample import Plan, checked_splits, memberships, pair_splits

METHODS = [*models.LINEAR, "knn", *BOUNDED, "randomForest"]


@dataclass
class Kept:
    """A model on the features that vary among its training rows."""

    keep: np.ndarray
    model: object

    labels = property(lambda self: self.model.labels)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return self.model.posterior(x[:, self.keep])


@dataclass
class Classifier:
    """A user's classifier: ``fit(x, y, **options)`` gives any model; ``predict(model, x)`` gives one label for each row, or
    a matrix of posteriors with one column for each sorted label of the training rows.

    It gets all training rows of a resample in one task; more than ``most_rows`` rows raise.  Labels alone give no margin
    and no AUC.
    """

    name: str
    fit: Callable
    predict: Callable
    most_rows: int = MOST_OWN


@dataclass
class Own:
    """The model of a user's classifier, with the labels it has seen."""

    labels: list[str]
    model: object
    predict: Callable

    def told(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        found = np.asarray(self.predict(self.model, x))
        if found.ndim == 1:
            return found.astype(str), None
        return np.array(self.labels, dtype=object)[found.argmax(axis=1)], found.astype(float)


def fit_moments(m: Moments, method: str, options: dict, features: np.ndarray | None = None) -> Kept:
    keep = varying(m) if features is None else features[np.isin(features, varying(m))]
    return Kept(keep, models.LINEAR[method](m.select(keep), **options))


def _fit_rows(vectors: DataFrame, method: str, resamples: int, options: dict, subsets: list[list[np.ndarray]] | None = None) -> list:
    """One task per resample (and a model for each of its subsets of features); the rows, a bounded sample, are in the closure."""
    fit, frame = BOUNDED[method][1], sample(vectors, BOUNDED[method][0])
    x, y, mults = np.stack(frame["features"].to_numpy()), frame["cls"].to_numpy(), np.stack(frame["mults"].to_numpy())
    every = [np.arange(x.shape[1])]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in f["id"]:
                rows = np.repeat(np.arange(len(y)), mults[:, s])
                varies = x[rows].std(axis=0) > EPS
                for k, features in enumerate(every if subsets is None else subsets[s]):
                    keep = features[varies[features]]
                    yield pd.DataFrame({"s": [s], "k": [k], "model": [cloudpickle.dumps(Kept(keep, fit(x[rows][:, keep], y[rows], **options)))]})

    found = vectors.sparkSession.range(0, resamples, 1, resamples).mapInPandas(work, "s long, k long, model binary").collect()  # bounded models
    return [pickle.loads(r[2]) for r in sorted(found, key=lambda r: r[:2])]


def _in_tasks(vectors: DataFrame, method: str | Classifier, labels: list[str], resamples: int, options: dict, resub: bool = False, subsets: list[list[np.ndarray]] | None = None) -> DataFrame:
    """``sample_id, obs, split, pred, posterior`` as ``_predict`` gives them, from tasks that fit and predict."""
    own, p, kind = isinstance(method, Classifier), width(vectors), dict(vectors.dtypes)["sample_id"]
    if own:
        enough(vectors, method.most_rows)
    sets = [[np.arange(p)]] * resamples if subsets is None else subsets
    trees, seed = options.get("trees", TREES), options.get("seed", 1)
    parts = 1 if own else tasks(vectors, resamples, trees)

    def targets(cls: np.ndarray, mults: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
        for s in range(resamples):
            at = np.flatnonzero(mults[:, s] > 0) if resub else np.arange(len(mults))
            for part in range(parts):
                yield s * parts + part, at, s

    def batch(ids: pa.Array, obs: np.ndarray, split: int, pred: np.ndarray | None, post: pa.Array) -> pa.RecordBatch:
        told = pa.nulls(len(obs), pa.string()) if pred is None else pa.array(pred, type=pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.array(obs, type=pa.string()), pa.array(np.full(len(obs), split, dtype=np.int32)), told, post], names=["sample_id", "obs", "split", "pred", "posterior"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := received(batches, by_id=own)) is None:
            return
        target, ids, cls, mults, x = got
        s, part = divmod(target, parts)
        rows, test = np.repeat(np.arange(len(cls)), mults), np.flatnonzero((mults == 0) != resub)
        tested, y = ids.take(pa.array(test)), cls[rows]
        low, high = x[mults > 0].min(axis=0), x[mults > 0].max(axis=0)
        varies = (high > low) & (spread_of(x, mults) > EPS)
        for k, features in enumerate(sets[s]):
            keep, split = features[varies[features]], s * len(sets[s]) + k
            if own:
                z = x if len(keep) == p and (keep == np.arange(p)).all() else x[:, keep]
                model = Own(sorted(set(y)), method.fit(z[rows], y, **options), method.predict)
                for a in range(0, len(test), 10_000):
                    some = test[a : a + 10_000]
                    pred, post = model.told(z[some])
                    yield batch(tested[a : a + 10_000], cls[some], split, pred, pa.nulls(len(some), pa.list_(pa.float64())) if post is None else lists(post))
                continue
            seen = sorted(set(y))
            code, columns, place = np.searchsorted(seen, y), columns_of(x[:, keep]), np.searchsorted(labels, seen)
            votes, train = np.zeros((len(test), len(labels))), columns if (mults == 1).all() else columns[:, rows]
            for t in range(part, trees, parts):
                grown = tree(train, code, len(seen), seed, t)[0]
                votes[np.arange(len(test)), place[grown.descend(columns, test)]] += 1
            for a in range(0, len(test), 10_000):
                yield batch(tested[a : a + 10_000], cls[test[a : a + 10_000]], split, None, lists(votes[a : a + 10_000]))

    found = deal(vectors, p, resamples, targets, resamples * parts).mapInArrow(work, f"sample_id {kind}, obs string, split int, pred string, posterior array<double>")
    if own:
        return found
    cells = found.select("sample_id", "obs", "split", *[F.get("posterior", F.lit(k)).alias(f"v{k}") for k in range(len(labels))])
    sums = cells.groupBy("sample_id", "obs", "split").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(len(labels))])
    votes = F.array(*[F.col(f"v{k}") / float(trees) for k in range(len(labels))])
    names = F.array(*[F.lit(c) for c in labels])
    return sums.withColumn("posterior", votes).select("sample_id", "obs", "split", F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int")).alias("pred"), "posterior")


def spread_of(x: np.ndarray, mults: np.ndarray) -> np.ndarray:
    """Deviations of the training rows, a feature at a time."""
    n = mults.sum()
    return np.array([np.sqrt(max(mults @ (c - (mults @ c) / n) ** 2, 0) / n) for c in x.T])


def _predict(vectors: DataFrame, fitted: list, p: int, test: bool, of: list[int] | None = None) -> DataFrame:
    """``sample_id, obs, split, pred, posterior`` of the rows with mult 0 (or above 0: resubstitution).  ``of`` has the
    resample of each model; without it there is one model for each."""
    kind = dict(vectors.dtypes)["sample_id"]
    of = list(range(len(fitted))) if of is None else of
    resamples = max(of) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mults = matrix_of(batch, "features", p), matrix_of(batch, "mults", resamples)
            for s, model in enumerate(fitted):
                at = np.flatnonzero((mults[:, of[s]] == 0) == test)
                if not len(at):
                    continue
                post = model.posterior(x[at])
                label, rows = np.array(model.labels, dtype=object)[post.argmax(axis=1)], batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(len(at), s, dtype=np.int32)), pa.array(label, type=pa.string()), lists(post)], names=["sample_id", "obs", "split", "pred", "posterior"])

    return vectors.select("sample_id", "cls", "features", "mults").mapInArrow(run, f"sample_id {kind}, obs string, split int, pred string, posterior array<double>")


@dataclass
class Accest:
    """``preds``: iter, rep, sample_id, obs, pred, posterior; ``folds``: iter, rep, err, acc, margin, auc;
    ``iters``: unweighted means of the folds; ``summary``: means of the iterations and the deviation of acc."""

    method: str
    plan: Plan
    labels: list[str]
    preds: DataFrame
    folds: DataFrame
    iters: DataFrame
    summary: DataFrame
    boot: DataFrame | None = None

    def confusion(self) -> DataFrame:
        return evaluate.confusion(self.preds)


def predictions(vectors: DataFrame, method: str | Classifier, splits: DataFrame, resub: bool = False, **options) -> tuple[DataFrame, list[str]]:
    """Test predictions of every resample: ``iter, rep, sample_id, obs, pred, posterior``."""
    table, names = memberships(splits)
    rows = vectors.select("sample_id", "cls", "features").join(table, "sample_id").select("sample_id", "cls", "features", "mults")
    labels = levels(vectors)
    if method == "knn":
        found = knn_predict(rows, len(names), **options).withColumn("posterior", F.lit(None).cast("array<double>"))
    elif isinstance(method, str) and method in models.LINEAR:
        fitted = [fit_moments(m, method, options) for m in gather(rows, labels, len(names), by_class=method == "qda")]
        found = _predict(rows, fitted, width(vectors), not resub)
    elif isinstance(method, Classifier) or method == "randomForest":
        found = _in_tasks(rows, method, labels, len(names), options, resub)
    elif method in BOUNDED:
        found = _predict(rows, _fit_rows(rows, method, len(names), options), width(vectors), not resub)
    else:
        raise ValueError(f"unknown method: {method}; one of {METHODS}, or a Classifier")
    place = F.create_map(*[x for s, (i, r) in enumerate(names) for x in (F.lit(s), F.struct(F.lit(i).alias("iter"), F.lit(r).alias("rep")))])
    at = F.element_at(place, F.col("split"))
    return found.select(at["iter"].alias("iter"), at["rep"].alias("rep"), "sample_id", "obs", "pred", "posterior"), labels


def fold_metrics(preds: DataFrame, labels: list[str], by: list[str] | None = None, with_auc: bool = True) -> DataFrame:
    """``err, acc, margin, auc`` of each fold; margin needs posteriors, auc two classes as well."""
    keys = [*(by or []), "iter", "rep"]
    marked = evaluate.margin(preds, labels)
    out = marked.groupBy(*keys).agg(F.avg((F.col("obs") != F.col("pred")).cast("double")).alias("err"), F.avg((F.col("obs") == F.col("pred")).cast("double")).alias("acc"), F.avg("margin").alias("margin"))
    if with_auc and len(labels) == 2:
        scored = preds.where("posterior is not null").select(*keys, F.element_at("posterior", 2).alias("stat"), (F.col("obs") == labels[1]).cast("int").alias("positive"), "sample_id")
        return out.join(evaluate.auc(scored, keys).select(*keys, "auc"), keys, "left")
    return out.withColumn("auc", F.lit(None).cast("double"))


def accest(vectors: DataFrame, method: str | Classifier, plan: Plan = Plan(), splits: DataFrame | None = None, **options) -> Accest:
    """Options go to the classifier (``k``, ``ncomp``, ``kernel``, ``cost`` ...), in every resample.

    Missing features and fewer than two classes are errors.  A bootstrap plan adds the .632 and .632+ errors.
    """
    splits = checked_splits(vectors, plan) if splits is None else splits
    preds, labels = predictions(vectors, method, splits, **options)
    if len(labels) < 2:
        raise ValueError("at least two classes are needed")
    folds = fold_metrics(preds, labels, with_auc=plan.sampling != "loocv")
    iters = folds.groupBy("iter").agg(*[F.avg(c).alias(c) for c in ("err", "acc", "margin", "auc")])
    summary = iters.agg(*[F.avg(c).alias(c) for c in ("err", "acc", "margin", "auc")], F.stddev_samp("acc").alias("acc_std")).withColumn("method", F.lit(name_of(method)))
    boot = None
    if plan.sampling == "boot":
        whole = vectors.select("sample_id").withColumns({"iter": F.lit(1), "rep": F.lit(1), "mult": F.lit(1)})
        resub = predictions(vectors, method, whole, resub=True, **options)[0] if method != "knn" else vectors.select(F.col("cls").alias("obs"), F.col("cls").alias("pred"))
        boot = evaluate.boot_err(preds, resub)
    return Accest(name_of(method), plan, labels, preds, folds, iters, summary, boot)


@dataclass
class Maccest:
    """Several classifiers on the same resamples: ``iters`` and ``summary`` have the method as a key."""

    results: dict[str, Accest]
    iters: DataFrame
    summary: DataFrame
    tests: dict = field(default_factory=dict)


def maccest(vectors: DataFrame, methods: list[str | Classifier], plan: Plan = Plan(), comp: str = "anova", options: dict[str, dict] | None = None) -> Maccest:
    from .compare import mc_anova, mc_fried

    splits = checked_splits(vectors, plan)
    results = {name_of(m): accest(vectors, m, plan, splits, **(options or {}).get(name_of(m), {})) for m in methods}
    iters = summary = None
    for m, r in results.items():
        part, line = r.iters.withColumn("method", F.lit(m)), r.summary
        iters, summary = (part, line) if iters is None else (iters.unionByName(part), summary.unionByName(line))
    tests = {}
    if len(methods) > 1 and plan.niter > 1 and plan.sampling != "loocv":
        tests = {"anova": mc_anova, "fried": mc_fried}[comp](iters.select("method", "iter", "acc"))
    return Maccest(results, iters, summary, tests)


def _for_pair(plan: Plan, rows: DataFrame) -> Plan:
    least = rows.groupBy("cls").count().agg(F.min("count")).first()[0]
    return Plan("loocv", seed=plan.seed) if plan.sampling == "cv" and plan.nreps > least else plan


def mbinest(vectors: DataFrame, methods: list[str | Classifier], choices=None, plan: Plan = Plan(), options: dict[str, dict] | None = None, with_auc: bool = True) -> DataFrame:
    """``pair, method, acc, auc, margin`` for pairs of classes; cv with more folds than the smaller class has rows
    becomes loocv.  Linear methods of all pairs are one plan: a pair's rows are the members of its resamples."""
    out, pairs = None, class_pairs(levels(vectors), choices)
    sizes = {r[0]: r[1] for r in vectors.groupBy("cls").count().collect()}  # one row per class
    alone = [(a, b) for a, b in pairs if plan.sampling == "loocv" or plan.sampling == "cv" and plan.nreps > min(sizes[a], sizes[b])]
    joint = [pair for pair in pairs if pair not in alone]
    linear = [m for m in methods if isinstance(m, str) and m in models.LINEAR]
    splits = pair_splits(vectors, joint, plan) if joint and linear else None
    for m in linear if joint else []:
        line = _pair_lines(vectors, joint, m, plan, splits, with_auc, (options or {}).get(m, {}))
        out = line if out is None else out.unionByName(line)
    for a, b in pairs:
        rows = vectors.where(F.col("cls").isin(a, b))
        for m in methods:
            if m in linear and (a, b) in joint:
                continue
            line = accest(rows, m, _for_pair(plan, rows), **(options or {}).get(name_of(m), {})).summary
            line = line.select(F.lit(f"{a}~{b}").alias("pair"), "method", "acc", "auc", "margin")
            out = line if out is None else out.unionByName(line)
    return out


def _pair_lines(vectors: DataFrame, pairs: list[tuple[str, str]], method: str, plan: Plan, splits: DataFrame, with_auc: bool, options: dict) -> DataFrame:
    labels, p = levels(vectors), width(vectors)
    names = [(k, i, r) for k in range(len(pairs)) for i in range(1, plan.niter + 1) for r in range(1, plan.nreps + 1)]
    cells = splits.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("pair", "iter", "rep"), "mult"))).alias("m"))  # one entry per resample
    order = F.array(*[F.struct(F.lit(k).alias("pair"), F.lit(i).alias("iter"), F.lit(r).alias("rep")) for k, i, r in names])
    table = cells.select("sample_id", F.transform(order, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(-1))).alias("mults"))  # -1: no member
    rows = vectors.select("sample_id", "cls", "features").join(table, "sample_id").select("sample_id", "cls", "features", "mults").persist()  # read for the fits and the predictions
    train = rows.withColumn("mults", F.transform("mults", lambda m: F.greatest(m, F.lit(0))))
    fitted = []
    for (k, _, _), m in zip(names, gather(train, labels, len(names), by_class=method == "qda"), strict=True):
        two = [labels.index(c) for c in pairs[k]]
        m = Moments([labels[c] for c in two], m.counts[two], m.means[two], m.within[two] if m.within.ndim == 3 else m.within)
        fitted.append(fit_moments(m, method, options))
    found, key = _predict(rows, fitted, p, True), F.col("split") + 1
    at = F.element_at(order, key)
    preds = found.select(at["pair"].alias("pair"), at["iter"].alias("iter"), at["rep"].alias("rep"), "sample_id", "obs", "pred", "posterior")
    second = F.element_at(F.array(*[F.lit(b) for _, b in pairs]), F.col("pair") + 1)
    first = F.element_at(F.array(*[F.lit(a) for a, _ in pairs]), F.col("pair") + 1)
    # all pairs have the classes "a" and "b" from here on
    same = preds.withColumns({"obs": F.when(F.col("obs") == second, "b").otherwise("a"), "pred": F.when(F.col("pred") == second, "b").otherwise("a")})
    folds = fold_metrics(same.persist() if with_auc else same, ["a", "b"], ["pair"], with_auc)
    iters = folds.groupBy("pair", "iter").agg(*[F.avg(c).alias(c) for c in ("acc", "margin", "auc")])
    means = iters.groupBy("pair").agg(*[F.avg(c).alias(c) for c in ("acc", "auc", "margin")])
    return means.select(F.concat(first, F.lit("~"), second).alias("pair"), F.lit(method).alias("method"), "acc", "auc", "margin")


def binest(vectors: DataFrame, method: str, choices=None, plan: Plan = Plan(), **options) -> DataFrame:
    return mbinest(vectors, [method], choices, plan, {name_of(method): options}, with_auc=False).select("pair", "acc")


def aam(vectors: DataFrame, methods: list[str | Classifier], plan: Plan = Plan(), options: dict[str, dict] | None = None) -> DataFrame:
    """``method, acc, auc, mar``, rounded to three places."""
    table = maccest(vectors, methods, plan, options=options).summary
    return table.select("method", F.round("acc", 3).alias("acc"), F.round("auc", 3).alias("auc"), F.round("margin", 3).alias("mar"))


def project(vectors: DataFrame, places: list[int]) -> DataFrame:
    """The vector frame of some features, in the order given."""
    return vectors.withColumn("features", F.array(*[F.get("features", F.lit(i)) for i in places]))


def _nested(vectors: DataFrame, method: str | Classifier, splits: DataFrame, orders: list[int] | dict[tuple[int, int], list[int]], prefixes: list[list[int]] | list[int], options: dict) -> DataFrame:
    """``set, iter, rep, sample_id, obs, pred, posterior``: every resample's test rows by models on several sets of features.

    ``prefixes`` has the lengths of the order to take (the resample's own, or one for all), or the sets themselves.  It is
    one plan with one fit of the rows, whatever the number of resamples and sets: linear models share the gathered state,
    the others fit all sets of a resample in its task, and one map (or one pass over the tiles) predicts.
    """
    table, names = memberships(splits)
    rows = vectors.select("sample_id", "cls", "features").join(table, "sample_id").select("sample_id", "cls", "features", "mults")
    one = lambda n: orders if isinstance(orders, list) else orders[n]
    subsets = [[np.array(k if isinstance(k, list) else one(n)[:k]) for k in prefixes] for n in names]
    flat = [(s, features) for s, sets in enumerate(subsets) for features in sets]
    if method == "knn":
        found = knn_predict(rows, len(names), subsets=flat, **options).withColumn("posterior", F.lit(None).cast("array<double>"))
    elif isinstance(method, str) and method in models.LINEAR:
        states = gather(rows, levels(vectors), len(names), by_class=method == "qda")
        fitted = [fit_moments(states[s], method, options, features) for s, features in flat]
        found = _predict(rows, fitted, width(vectors), True, [s for s, _ in flat])
    elif isinstance(method, Classifier) or method == "randomForest":
        found = _in_tasks(rows, method, levels(vectors), len(names), options, subsets=subsets)
    elif method in BOUNDED:
        found = _predict(rows, _fit_rows(rows, method, len(names), options, subsets), width(vectors), True, [s for s, _ in flat])
    else:
        raise ValueError(f"unknown method: {method}; one of {METHODS}, or a Classifier")
    key = F.col("split").cast("long")
    resample = F.element_at(F.array(*[F.struct(F.lit(i).alias("iter"), F.lit(r).alias("rep")) for i, r in names]), (F.floor(key / len(prefixes)) + 1).cast("int"))
    return found.select((key % len(prefixes)).alias("set"), resample["iter"].alias("iter"), resample["rep"].alias("rep"), "sample_id", "obs", "pred", "posterior")


def frank_err(vectors: DataFrame, order: list[int] | dict[tuple[int, int], list[int]], lens: list[int], method: str | Classifier, splits: DataFrame, **options) -> DataFrame:
    """``len, iter, rep, err`` of the best features of a given order (or one for each (iter, rep)) at each length."""
    preds = _nested(vectors, method, splits, order, lens, options)
    err = preds.groupBy("set", "iter", "rep").agg(F.avg((F.col("obs") != F.col("pred")).cast("double")).alias("err"))
    return err.select(_length(lens).alias("len"), "iter", "rep", "err")


def _length(lens: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(int(k)).cast("long") for k in lens]), (F.col("set") + 1).cast("int"))


@dataclass
class Frankvali:
    """``err_all``: len, iter, rep, err; ``err_iter``; ``err_avg``; ``ranks`` of all resamples; ``order``: by Borda."""

    method: str
    fs_method: str
    plan: Plan
    lens: list[int]
    err_all: DataFrame
    err_iter: DataFrame
    err_avg: DataFrame
    ranks: DataFrame
    order: DataFrame


def frankvali(vectors: DataFrame, long: DataFrame, method: str | Classifier = "svm", fs_method: str | Callable = "fs.auc", plan: Plan = Plan(), lens="power2", order: list[int] | None = None, fs_options: dict | None = None, **options) -> Frankvali:
    """Ranks the features on each resample's training rows (or takes ``order``) and classifies its test rows with the
    best k of them, for each k of the ladder.  ``fs_method`` is any ranker, univariate, multivariate or a function.  Each
    ranking has at most the number of features, and only they come to the driver, never rows."""
    ladder = feature_ladder(width(vectors), lens)
    splits = checked_splits(vectors, plan)
    ranks = rank_resampled(long, splits, fs_method, **(fs_options or {}))
    own = order
    if order is None:
        sorted_places = F.transform(F.array_sort(F.collect_list(F.struct("fs_rank", "feature_idx"))), lambda c: c["feature_idx"])
        own = {(r[0], r[1]): list(r[2]) for r in ranks.groupBy("iter", "rep").agg(sorted_places).collect()}
    err = frank_err(vectors, own, ladder, method, splits, **options)
    by_iter = err.groupBy("len", "iter").agg(F.avg("err").alias("err"))
    return Frankvali(name_of(method), name_of(fs_method), plan, ladder, err, by_iter, by_iter.groupBy("len").agg(F.avg("err").alias("err")), ranks, borda(ranks))


def _nested_metrics(vectors: DataFrame, method: str | Classifier, plan: Plan, order: list[int], prefixes: list, lens: list[int], options: dict) -> DataFrame:
    labels = levels(vectors)
    if len(labels) < 2:
        raise ValueError("at least two classes are needed")
    preds = _nested(vectors, method, checked_splits(vectors, plan), order, prefixes, options)
    folds = fold_metrics(preds, labels, ["set"], plan.sampling != "loocv")
    iters = folds.groupBy("set", "iter").agg(*[F.avg(c).alias(c) for c in ("acc", "auc", "margin")])
    means = iters.groupBy("set").agg(*[F.round(F.avg(c), 3).alias(c) for c in ("acc", "auc", "margin")])
    return means.select(_length(lens).alias("len"), "acc", "auc", F.col("margin").alias("mar"))


def fs_cl(vectors: DataFrame, order: list[int], lens: list[int], method: str | Classifier = "svm", plan: Plan = Plan(), all_fs: bool = False, **options) -> DataFrame:
    """``len, acc, auc, mar`` of prefixes of an order; the largest length goes unless ``all_fs``."""
    lens = sorted(lens) if all_fs else sorted(lens)[:-1]
    if not lens:
        raise ValueError("no length is left")
    return _nested_metrics(vectors, method, plan, list(order), lens, lens, options)


def fs_cl_1(vectors: DataFrame, order: list[int], method: str | Classifier = "svm", plan: Plan = Plan(), growing: bool = False, **options) -> DataFrame:
    """The same for each single feature, or for each growing prefix."""
    if growing:
        return fs_cl(vectors, order, list(range(1, len(order) + 1)), method, plan, True, **options)
    return _nested_metrics(vectors, method, plan, list(order), [[j] for j in order], list(range(1, len(order) + 1)), options)


def fs_cl_2(vectors: DataFrame, order: list[int], method: str | Classifier = "svm", plan: Plan = Plan(), growing: bool = False, **options) -> list[Accest]:
    """One result for each single feature, or each growing prefix."""
    splits = checked_splits(vectors, plan)
    return [accest(project(vectors, order[: k + 1] if growing else [j]), method, plan, splits, **options) for k, j in enumerate(order)]


@dataclass
class Tuned:
    ncomp: int
    table: DataFrame


def tune(vectors: DataFrame, method: str, ncomps: list[int], plan: Plan = Plan("rand", 1, 10), fit: Callable | None = None, **options) -> Tuned:
    """``ncomp, acc`` for each number of components, and the first best.

    All candidates of all resamples are fitted from the same one gathered state per resample, and one map predicts with
    each: the rows are read twice, whatever the number of candidates.
    """
    fit = fit or models.LINEAR[method]
    table, names = memberships(checked_splits(vectors, plan))
    rows = vectors.select("sample_id", "cls", "features").join(table, "sample_id").select("sample_id", "cls", "features", "mults")
    states = gather(rows, levels(vectors), len(names))
    keeps = [varying(m) for m in states]
    fitted = [[Kept(k, fit(m.select(k), ncomp=c, **options)) for c in ncomps] for m, k in zip(states, keeps, strict=True)]
    p = width(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit, n = np.zeros((len(names), len(ncomps)), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            x, mults, obs = matrix_of(batch, "features", p), matrix_of(batch, "mults", len(names)), np.array(batch.column(1).to_pylist(), dtype=object)
            for s in range(len(names)):
                at = mults[:, s] == 0
                n[s] += at.sum()
                for c, model in enumerate(fitted[s]) if at.any() else ():
                    hit[s, c] += (np.array(model.labels, dtype=object)[model.posterior(x[at]).argmax(axis=1)] == obs[at]).sum()
        s, c = np.indices(hit.shape)
        yield pa.RecordBatch.from_arrays([pa.array(s.ravel()), pa.array(np.array(ncomps)[c.ravel()]), pa.array(hit.ravel()), pa.array(np.repeat(n, len(ncomps)))], names=["split", "ncomp", "hit", "n"])

    sums = rows.mapInArrow(run, "split long, ncomp long, hit long, n long").groupBy("split", "ncomp").agg((F.sum("hit") / F.nullif(F.sum("n"), F.lit(0))).alias("acc"))
    by_iter = F.create_map(*[x for s, (i, _) in enumerate(names) for x in (F.lit(s).cast("long"), F.lit(i))])
    acc = sums.groupBy("ncomp", F.element_at(by_iter, F.col("split")).alias("iter")).agg(F.avg("acc").alias("acc")).groupBy("ncomp").agg(F.avg("acc").alias("acc"))
    best = acc.agg(F.max(F.struct("acc", (-F.col("ncomp")).alias("n")))["n"]).first()[0]
    return Tuned(-best, acc)


def tune_plsc(vectors: DataFrame, ncomp: int = 10, plan: Plan = Plan("rand", 1, 10), pls: str = "simpls") -> Tuned:
    return tune(vectors, "plsc", list(range(1, min(ncomp, width(vectors)) + 1)), plan, pls=pls)


def tune_plslda(vectors: DataFrame, ncomp: int = 10, plan: Plan = Plan("rand", 1, 10), pls: str = "simpls") -> Tuned:
    return tune(vectors, "plslda", list(range(1, min(ncomp, width(vectors)) + 1)), plan, pls=pls)


def tune_pcalda(vectors: DataFrame, ncomp: int | list[int] | None = None, plan: Plan = Plan("rand", 1, 4)) -> Tuned:
    """A number: 1 to it (default max(g, n - g), at most the number of features); a list: those; the value is returned."""
    if isinstance(ncomp, list):
        return tune(vectors, "pcalda", ncomp, plan)
    g, n = len(levels(vectors)), vectors.count()
    return tune(vectors, "pcalda", list(range(1, min(ncomp or max(g, n - g), width(vectors)) + 1)), plan)


def tune_pcalda_scores(vectors: DataFrame, ncomp: int | None = None, center: bool = True, scale: bool = False, plan: Plan = Plan("rand", 1, 4)) -> Tuned:
    """PCA of all rows once, then LDA on the first scores of each resample's training rows."""
    labels = levels(vectors)
    m = gather(vectors, labels)[0]
    pca = models.PCA.fit(m, scale, ncomp, center)
    z = models.map_rows(vectors, lambda x: [pca.scores(x)], len(m.mean), ["features"])

    @dataclass
    class First:
        k: int
        lda: models.LDA

        labels = property(lambda self: self.lda.labels)

        def posterior(self, x: np.ndarray) -> np.ndarray:
            return self.lda.posterior(x[:, : self.k])

    ncomps = list(range(1, len(pca.sdev) + 1))
    return tune(z, "lda", ncomps, plan, fit=lambda m, ncomp: First(min(ncomp, m.means.shape[1]), models.LDA.fit(m.select(np.arange(min(ncomp, m.means.shape[1]))))))
