"""Univariate feature ranking, aggregation of rankings over resamples, stability and consensus.

A ranking is ``feature, feature_idx, stat[, pval], fs_rank`` (1: best; nulls last; ties by feature order), under the
keys in ``by``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import summary
from .evaluate import feature_auc
from .frame import attach, to_vectors
from .summary import FEATURE, moments, two_classes


def ranked(stats: DataFrame, by: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """Adds ``fs_rank``; one row per feature and key comes in, so the window holds as many rows as there are features."""
    key = order if order is not None else F.col("stat").desc_nulls_last()
    return stats.withColumn("fs_rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(key, "feature_idx")).cast("long"))


def fs_welch(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By the absolute Welch t; p-values are kept."""
    return ranked(summary.welch(long, by).withColumn("stat", F.abs("stat")), by)


def fs_welch_1(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By ascending p; the statistic keeps its sign."""
    return ranked(summary.welch(long, by), by, F.col("pval").asc_nulls_last())


def fs_wilcox(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By the rank-sum statistic of the first class, largest first."""
    return ranked(summary.wilcoxon(long, by).withColumn("stat", F.abs("stat")), by)


def fs_anova(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranked(summary.anova(long, by), by)


def fs_kruskal(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    return ranked(summary.kruskal(long, by), by)


def fs_auc(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By the area under the ROC curve, folded to 0.5 or more; ``raw_auc`` keeps the direction."""
    return ranked(feature_auc(long, by), by)


def fs_snr(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By the distance of the class means over the sum of the class deviations."""
    t = two_classes(moments(long, by), by)
    stat = F.abs(F.col("m1") - F.col("m2")) / F.nullif(F.sqrt("v1") + F.sqrt("v2"), F.lit(0.0))
    return ranked(t.select(*(by or []), *FEATURE, stat.alias("stat")), by)


def fs_bw(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By the ratio of between-class to within-class sums of squares."""
    keys = [*(by or []), *FEATURE]
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    cells = moments(long, by)
    means = cells.groupBy(*keys).agg((F.sum(n * m) / F.sum("n")).alias("mean"))
    parts = attach(cells, means, keys).groupBy(*keys).agg(F.sum(n * (m - F.col("mean")) * (m - F.col("mean"))).alias("b"), F.sum(F.when(n > 1, (n - 1) * v).otherwise(F.lit(0.0))).alias("w"))
    return ranked(parts.select(*keys, (F.col("b") / F.nullif("w", F.lit(0.0))).alias("stat")), by)


RANKERS = {"fs.welch": fs_welch, "fs.welch.1": fs_welch_1, "fs.wilcox": fs_wilcox, "fs.anova": fs_anova, "fs.kruskal": fs_kruskal, "fs.auc": fs_auc, "fs.snr": fs_snr, "fs.bw": fs_bw}


def feature_ladder(p: int, lens: str | list[float] = "power2") -> list[int]:
    """Ascending feature counts: "full", "half", "power2", or given numbers (whole parts in 1..p, with p)."""
    if p < 1:
        return []
    if isinstance(lens, str):
        if lens == "full":
            return list(range(1, p + 1))
        if lens == "half":
            out = {p}
            while (p := p // 2) >= 1:
                out.add(p)
            return sorted(out)
        if lens == "power2":
            return sorted({p, *(2**k for k in range(math.ceil(math.log2(p)) if p > 1 else 0))})
        raise ValueError(f"unknown ladder: {lens}")
    return sorted({int(x) for x in lens if 1 <= int(x) <= p} | {p})


def rank_resampled(long: DataFrame, splits: DataFrame, method: str | Callable, **options) -> DataFrame:
    """The ranking of every resample's training rows: keys ``method, iter, rep``.

    ``method`` is the name of any ranker or a function ``(x, y) -> statistics`` (see ``multirank.rank_resampled``).
    Bootstrap rows count as often as they were drawn.  All resamples of a univariate ranker are one aggregation with
    more keys.
    """
    if isinstance(method, str) and method in RANKERS:
        rows = long.join(splits.where("mult > 0").select("sample_id", "iter", "rep", "mult"), "sample_id")
        rows = rows.withColumn("mult", F.explode(F.sequence(F.lit(1), F.col("mult")))).drop("mult")
        found = RANKERS[method](rows, ["iter", "rep"])
    else:
        from . import multirank

        found = multirank.rank_resampled(to_vectors(long), feature_names(long), splits, method, **options)
    return found.select(F.lit(name_of(method)).alias("method"), "iter", "rep", *FEATURE, "stat", "fs_rank")


def name_of(method: str | Callable) -> str:
    """Of a method or a user's function or object, as a key of result tables."""
    return method if isinstance(method, str) else getattr(method, "name", None) or getattr(method, "__name__", type(method).__name__)


def feature_names(long: DataFrame) -> list[str]:
    """In feature order; there are few features."""
    found = long.groupBy("feature_idx").agg(F.min("feature").alias("feature")).orderBy("feature_idx").collect()
    if [r[0] for r in found] != list(range(len(found))):
        raise ValueError("features must be numbered from 0 without gaps")
    return [r[1] for r in found]


def borda(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of ranks over the resamples, least first; ties keep the feature order.  ``stat`` is the mean statistic."""
    score = ranks.groupBy(*(by or []), *FEATURE).agg(F.sum("fs_rank").alias("score"), F.avg("stat").alias("stat"))
    return ranked(score, by, F.col("score").asc())


def feat_rank_re(long: DataFrame, splits: DataFrame, method: str | Callable, **options) -> DataFrame:
    return borda(rank_resampled(long, splits, method, **options), ["method"])


def feat_freq(ranks: DataFrame, cutoff: int = 50, freq_cutoff: float = 0.5) -> DataFrame:
    """``method, feature, freq, kept``: the share of resamples that have a feature among their best ``cutoff``.

    A cutoff above the number of features counts as that number.  Zero frequencies aren't rows.
    """
    runs = ranks.groupBy("method").agg(F.count_distinct("iter", "rep").alias("runs"))
    top = ranks.where(F.col("fs_rank") <= cutoff).groupBy("method", *FEATURE).agg(F.count("*").alias("n"))
    freq = F.col("n") / F.col("runs")
    return attach(top, runs, ["method"]).select("method", *FEATURE, freq.alias("freq"), (freq >= freq_cutoff).alias("kept"))


def stability(freq: DataFrame) -> DataFrame:
    """Mean frequency by method."""
    return freq.groupBy("method").agg(F.avg("freq").alias("stability"))


def feat_cons(freq: DataFrame, methods: list[str]) -> DataFrame:
    """Consensus table: one column of frequencies for each method, with the number of methods; kept features only."""
    table = freq.where("kept").groupBy(*FEATURE).pivot("method", methods).agg(F.first("freq"))
    n = sum((F.col(f"`{m}`").isNotNull().cast("long") for m in methods), F.lit(0).cast("long"))
    return table.withColumn("n_methods", n)


def feat_mfs(long: DataFrame, methods: list[str | Callable], splits: DataFrame | None = None, options: dict[str, dict] | None = None) -> DataFrame:
    """Several rankers, with resampling (Borda over ``splits``) or without: ``method, feature, stat, fs_rank``.

    Rankers are names or functions; ``options`` has arguments by the ranker's name.  Without resampling, rankers that
    take vectors see all rows as one resample.
    """
    out = whole = None
    for m in methods:
        own = (options or {}).get(name_of(m), {})
        if splits is not None:
            found = feat_rank_re(long, splits, m, **own)
        elif isinstance(m, str) and m in RANKERS:
            found = RANKERS[m](long).withColumn("method", F.lit(m))
        else:
            whole = long.select("sample_id").distinct().select("sample_id", F.lit(1).alias("iter"), F.lit(1).alias("rep"), F.lit(1).alias("mult")) if whole is None else whole
            found = rank_resampled(long, whole, m, **own)
        found = found.select("method", *FEATURE, "stat", "fs_rank")
        out = found if out is None else out.unionByName(found)
    return out


def order_table(ranks: DataFrame, methods: list[str]) -> DataFrame:
    """Features by place: one column for each method."""
    return ranks.groupBy("fs_rank").pivot("method", methods).agg(F.first("feature"))


def rank_table(ranks: DataFrame, methods: list[str]) -> DataFrame:
    """Places by feature: one column for each method."""
    return ranks.groupBy("feature").pivot("method", methods).agg(F.first("fs_rank"))


def feat_mfs_stab(long: DataFrame, methods: list[str | Callable], splits: DataFrame, cutoff: int = 20, freq_cutoff: float = 0.5, options: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """``freq``, ``stability`` and ``consensus`` of several resampled rankers."""
    out = None
    for m in methods:
        found = rank_resampled(long, splits, m, **(options or {}).get(name_of(m), {}))
        out = found if out is None else out.unionByName(found)
    freq = feat_freq(out, cutoff, freq_cutoff)
    return {"freq": freq, "stability": stability(freq), "consensus": feat_cons(freq, [name_of(m) for m in methods])}


def feat_mfs_stats(ranks: DataFrame, cumulative: bool = False) -> DataFrame:
    """``method, idx, feature, value``: statistics in falling order, or their running share of the method's sum."""
    w = Window.partitionBy("method")
    numbered = ranks.withColumn("idx", F.row_number().over(w.orderBy(F.col("stat").desc_nulls_last(), "feature_idx")).cast("long"))
    value = F.sum("stat").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(F.sum("stat").over(w), F.lit(0.0)) if cumulative else F.col("stat")
    return numbered.select("method", "idx", "feature", value.alias("value"))
