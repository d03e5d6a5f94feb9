"""Summaries by feature, two-class statistics, hypothesis tests and p-value adjustment.

Everything is one grouped aggregation with partial sums; tests on ranks first collapse equal values and number them with
``frame.running_totals``, so no task sees a whole feature.  ``by`` adds keys (pair, iter, rep) to the feature.  What
follows the aggregation works on a table with one row per feature.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist
from .frame import attach, running_totals

FEATURE = ["feature", "feature_idx"]


def quantiles(long: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (type 7) of ``value`` by ``keys``, which have no nulls: one column for each share.

    Equal values are one row from the first aggregation on; running totals place them, so no task sees a whole key.
    """
    values = long.where("value is not null").groupBy(*keys, "value").agg(F.count("*").alias("ties"))
    placed = attach(running_totals(values, keys, "value", ["ties"]), values.groupBy(*keys).agg(F.sum("ties").alias("size")), keys)
    at = {name: (F.col("size") - 1) * F.lit(float(q)) for name, q in shares.items()}
    has = lambda place: F.max(F.when((F.col("before_ties") <= place) & (place < F.col("before_ties") + F.col("ties")), F.col("value")))
    found = placed.groupBy(*keys).agg(F.max("size").alias("size"), *[f(name) for name, c in at.items() for f in (lambda n, c=c: has(F.floor(c)).alias(f"__low_{n}"), lambda n, c=c: has(F.ceil(c)).alias(f"__high_{n}"))])
    between = lambda name, c: F.when(F.col(f"__low_{name}") == F.col(f"__high_{name}"), F.col(f"__low_{name}")).otherwise((F.ceil(c) - c) * F.col(f"__low_{name}") + (c - F.floor(c)) * F.col(f"__high_{name}"))
    return found.select(*keys, *[between(name, c).alias(name) for name, c in at.items()])


def _with_quantiles(long: DataFrame, by: list[str], aggregates: list[Column], shares: dict[str, float]) -> DataFrame:
    """The aggregates and quantiles by feature and ``by``, whose nulls are a group as well."""
    marks = {f"__by_{c}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in by}
    rows, keys = long.withColumns(marks) if marks else long, [*FEATURE, *marks]
    return attach(rows.groupBy(*FEATURE, *by, *marks).agg(*aggregates), quantiles(rows, keys, shares), keys, "left").drop(*marks)


def vec_summ(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """N (values), min, mean, median, max, std."""
    found = _with_quantiles(
        long, by or [], [F.count("value").alias("n"), F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_samp("value").alias("std")], {"median": 0.5}
    )
    return found.select(*FEATURE, *(by or []), "n", "min", "mean", "median", "max", "std")


def vec_summ_1(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """N, mean, median, 95 % interval of the mean (one-sample t), interquartile range (type 7), std; null below two values."""
    base = _with_quantiles(long, by or [], [F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    half = dist.t_quantile_975(F.lit(0.0), (F.col("n") - 1).cast("double")) * F.col("std") / F.sqrt("n")
    enough = lambda c: F.when(F.col("n") >= 2, c)
    return base.select(
        *FEATURE, *(by or []), "n", enough(F.col("mean")).alias("mean"), enough(F.col("q2")).alias("median"), enough(F.col("mean") - half).alias("ci_low"), enough(F.col("mean") + half).alias("ci_high"), enough(F.col("q3") - F.col("q1")).alias("iqr"), enough(F.col("std")).alias("std")
    )


def df_summ(long: DataFrame, by: list[str] | None = None, method: dict[str, Column] | None = None) -> DataFrame:
    """``vec_summ`` by feature (and ``by``), or the aggregates of ``method``: name -> aggregate of ``value``."""
    if method is None:
        return vec_summ(long, by)
    return long.groupBy(*FEATURE, *(by or [])).agg(*[c.alias(n) for n, c in method.items()])


def moments(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per feature and class: n, mean, variance."""
    return long.where("value is not null and cls is not null").groupBy(*(by or []), *FEATURE, "cls").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))


def two_classes(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of ``moments``: the first label's columns n1, m1, v1 beside the second's n2, m2, v2; the least and the greatest
    label are taken, so that a table with pairs as keys gets each pair's own."""
    cell = F.struct("cls", "n", "m", "v")
    both = cells.groupBy(*(by or []), *FEATURE).agg(F.min(cell).alias("a"), F.max(cell).alias("b"))
    return both.select(*(by or []), *FEATURE, *[F.col(f"{side}.{c}").alias(f"{c}{k}") for k, side in ((1, "a"), (2, "b")) for c in ("cls", "n", "m", "v")])


def welch(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Welch's t by feature: ``stat, df, pval``; null where a class has fewer than two values or nothing varies."""
    t = two_classes(moments(long, by), by)
    se1, se2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    stat = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(se1 + se2), F.lit(0.0))
    df = (se1 + se2) * (se1 + se2) / F.nullif(se1 * se1 / F.nullif(F.col("n1") - 1, F.lit(0)) + se2 * se2 / F.nullif(F.col("n2") - 1, F.lit(0)), F.lit(0.0))
    t = t.select(*(by or []), *FEATURE, stat.alias("stat"), df.alias("df"))
    return t.withColumn("pval", dist.t_pvalue("stat", "df"))


def anova(long: DataFrame, by: list[str] | None = None, equal_var: bool = True) -> DataFrame:
    """One-way F by feature: ``stat, df1, df2, pval``, with equal variances or by Welch."""
    cells = moments(long, by)
    keys = [*(by or []), *FEATURE]
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    if equal_var:
        sums = cells.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(n * m).alias("nm"), F.sum(n * m * m).alias("nmm"), F.sum(F.when(n > 1, (n - 1) * v).otherwise(F.lit(0.0))).alias("within"))
        total = sums.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("k", "n", "within")], F.first(F.col("nm") / F.col("n")).alias("mean"))
        centred = attach(cells, total.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(n * (m - F.col("mean")) * (m - F.col("mean"))).alias("between"))
        out = attach(total, centred, keys).withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("n") - F.col("k"))
        stat = (F.col("between") / F.nullif("df1", F.lit(0))) / F.nullif(F.col("within") / F.nullif("df2", F.lit(0)), F.lit(0.0))
    else:
        w = n / F.nullif(v, F.lit(0.0))
        sums = cells.withColumn("w", w).groupBy(*keys).agg(F.count("*").alias("k"), F.sum("w").alias("w_all"), (F.sum(F.col("w") * m) / F.sum("w")).alias("mean"))
        joined = attach(cells.withColumn("w", w), sums, keys)
        parts = joined.groupBy(*keys).agg(F.first("k").alias("k"), F.sum(F.col("w") * (m - F.col("mean")) * (m - F.col("mean"))).alias("top"), F.sum((1 - F.col("w") / F.col("w_all")) * (1 - F.col("w") / F.col("w_all")) / F.nullif(n - 1, F.lit(0))).alias("t"))
        k, t = F.col("k"), F.col("t") / F.nullif(F.col("k") * F.col("k") - 1, F.lit(0))
        out = parts.withColumn("df1", k - 1).withColumn("df2", 1 / F.nullif(3 * t, F.lit(0.0)))
        stat = F.col("top") / F.nullif((k - 1) * (1 + 2 * (k - 2) * t), F.lit(0.0))
    out = out.select(*keys, stat.alias("stat"), F.col("df1").cast("double").alias("df1"), F.col("df2").cast("double").alias("df2"))
    return out.withColumn("pval", dist.f_pvalue("stat", "df1", "df2"))


def value_ranks(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mid-ranks of distinct values: keys, ``value``, ``ties``, ``midrank`` and ``counts`` (label -> rows).

    Equal values are one row from the first aggregation on, whatever their number.
    """
    keys = [*(by or []), *FEATURE]
    cells = long.where("value is not null and cls is not null").groupBy(*keys, "value", "cls").agg(F.count("*").alias("n"))
    values = cells.groupBy(*keys, "value").agg(F.sum("n").alias("ties"), F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias("counts"))  # one entry per class
    return running_totals(values, keys, "value", ["ties"]).withColumn("midrank", F.col("before_ties") + (F.col("ties") + 1) / 2).drop("before_ties")


def rank_sums(long: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, cls, n, rank_sum) and (keys, tie: sum of t^3 - t)."""
    keys = [*(by or []), *FEATURE]
    ranked = value_ranks(long, by)
    ties = ranked.groupBy(*keys).agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie"))
    sums = ranked.select(*keys, "midrank", F.explode("counts").alias("cls", "c")).groupBy(*keys, "cls").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("midrank")).alias("rank_sum"))
    return sums, ties


def wilcoxon(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """W of the first class: ``stat, pval`` (exact below 50 rows a class without ties)."""
    keys = [*(by or []), *FEATURE]
    sums, ties = rank_sums(long, by)
    cell = F.struct("cls", "n", "rank_sum")
    both = sums.groupBy(*keys).agg(F.min(cell).alias("a"), F.max(cell).alias("b"), F.count("*").alias("k")).where("k = 2")
    w = F.col("a.rank_sum") - F.col("a.n") * (F.col("a.n") + 1) / 2
    out = attach(both.select(*keys, w.alias("stat"), F.col("a.n").cast("double").alias("n1"), F.col("b.n").cast("double").alias("n2")), ties, keys)
    return out.withColumn("pval", dist.wilcoxon_pvalue("stat", "n1", "n2", "tie")).select(*keys, "stat", "pval")


def kruskal(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """H with tie correction: ``stat, df, pval``."""
    keys = [*(by or []), *FEATURE]
    sums, ties = rank_sums(long, by)
    total = sums.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").cast("double").alias("n"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("r"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("r") - 3 * (n + 1)) / F.nullif(1 - F.col("tie") / F.nullif(n * n * n - n, F.lit(0.0)), F.lit(0.0))
    out = attach(total, ties, keys).select(*keys, h.alias("stat"), (F.col("k") - 1).cast("double").alias("df"))
    return out.withColumn("pval", dist.chi2_pvalue("stat", "df"))


def pval_test(long: DataFrame, method: str | Callable[[DataFrame, list[str] | None], DataFrame] = "oneway.test", by: list[str] | None = None) -> DataFrame:
    """``pval`` by feature of a named test: oneway.test (Welch), aov, t.test, wilcox.test, kruskal.test; or of a function
    of the long frame and ``by`` that returns one row of ``feature, feature_idx, pval`` for each feature and key."""
    if callable(method):
        return method(long, by).select(*(by or []), *FEATURE, "pval")
    found = {"oneway.test": lambda: anova(long, by, equal_var=False), "aov": lambda: anova(long, by), "t.test": lambda: welch(long, by), "wilcox.test": lambda: wilcoxon(long, by), "kruskal.test": lambda: kruskal(long, by)}
    if method not in found:
        raise ValueError(f"unknown test: {method}")
    return found[method]().select(*(by or []), *FEATURE, "pval")


def p_adjust(df: DataFrame, method: str = "fdr", by: list[str] | None = None, column: str = "pval") -> DataFrame:
    """Adds ``padj`` among all rows, or those of each ``by``.  The table has one row per feature, so its windows are small.

    Hommel's method has no running form and goes through one Arrow call per key.
    """
    keys = by or []
    if method in ("hommel", "BY"):
        schema = df.withColumn("padj", F.lit(0.0)).schema

        def each(frame: pd.DataFrame) -> pd.DataFrame:
            return frame.assign(padj=dist.adjust(frame[column].to_numpy(dtype=float), method))

        return df.groupBy(*keys).applyInPandas(each, schema)
    p = F.col(column)
    every = Window.partitionBy(*keys)
    n = F.count(p).over(every)
    place = F.row_number().over(every.orderBy(p.asc_nulls_last()))
    numbered = df.withColumn("__n", n).withColumn("__i", place)
    up, down = every.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0), every.orderBy("__i").rowsBetween(0, Window.unboundedFollowing)
    n, i = F.col("__n"), F.col("__i")
    forms = {
        "none": p,
        "bonferroni": n * p,
        "holm": F.max((n - i + 1) * p).over(up),
        "hochberg": F.min((n - i + 1) * p).over(down),
        "BH": F.min(n / i * p).over(down),
    }
    forms["fdr"] = forms["BH"]
    if method not in forms:
        raise ValueError(f"unknown method: {method}")
    return numbered.withColumn("padj", F.when(p.isNotNull(), F.least(F.lit(1.0), forms[method]))).drop("__n", "__i")


def pval_reject(pvals: DataFrame, alphas: list[float], by: list[str] | None = None, column: str = "padj") -> DataFrame:
    """``alpha, n_reject``: how many p-values are at most alpha."""
    counts = [F.struct(F.lit(float(a)).alias("alpha"), F.count_if(F.col(column) <= float(a)).alias("n_reject")) for a in alphas]
    return pvals.groupBy(*(by or [])).agg(F.array(*counts).alias("found")).select(*(by or []), F.inline("found"))


def stats_mat(long: DataFrame, method: str | Callable[[Column], Column] = "mean", test: str | Callable = "wilcox.test", padj: str = "fdr", fc: bool = True, rounded: bool = False, by: list[str] | None = None) -> DataFrame:
    """Two-class table by feature: overall and class centres, fold change of the second class over the first, its log2,
    folded AUC, p and adjusted p.  ``rounded`` rounds each step as printed tables do (2 places; 4 for p-values)."""
    from .evaluate import feature_auc
    from .prep import fold_change, fold_change_to_log

    keys = [*(by or []), *FEATURE]
    centre = {"mean": F.avg, "median": F.median}[method] if isinstance(method, str) else method
    cells = long.where("value is not null").groupBy(*keys, "cls").agg(centre(F.col("value")).alias("c"))
    cell = F.struct("cls", "c")
    both = cells.groupBy(*keys).agg(F.min(cell)["c"].alias("center_1"), F.max(cell)["c"].alias("center_2"))
    overall = long.where("value is not null").groupBy(*keys).agg(centre(F.col("value")).alias("center"))
    rnd = (lambda c, k: F.round(c, k)) if rounded else (lambda c, k: c)
    out = attach(overall, both, keys)
    if fc:
        out = out.withColumn("fc", rnd(fold_change(F.col("center_2"), F.col("center_1")), 2)).withColumn("lfc", rnd(fold_change_to_log(F.col("fc")), 2))
    out = attach(out, feature_auc(long, by).select(*keys, F.col("stat").alias("auc")), keys, "left")
    out = attach(out, pval_test(long, test, by), keys, "left").withColumn("auc", rnd(F.col("auc"), 2)).withColumn("pval", rnd(F.col("pval"), 4))
    return p_adjust(out, padj, by).withColumn("padj", rnd(F.col("padj"), 4))
