"""Comparison of classifiers over iterations: ANOVA with Tukey's test, Friedman with paired methods, normality.

The input has one row per (method, iter) and comes to the driver, at most ``MOST_ROWS``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist

MOST_ROWS = 100_000


def _table(acc: DataFrame) -> pd.DataFrame:
    rows = acc.select("method", "iter", "acc").dropna().limit(MOST_ROWS + 1).toPandas()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    return rows


def mc_anova(acc: DataFrame) -> dict:
    """``F, df1, df2, pval`` and ``pairs``: method_1, method_2, diff, pval (Tukey)."""
    rows = _table(acc)
    groups = {m: g["acc"].to_numpy() for m, g in rows.groupby("method")}
    k, n = len(groups), len(rows)
    mean = rows["acc"].mean()
    between = sum(len(v) * (v.mean() - mean) ** 2 for v in groups.values())
    within = sum(((v - v.mean()) ** 2).sum() for v in groups.values())
    mse = within / max(n - k, 1)
    f = between / max(k - 1, 1) / mse if mse > 0 else float("nan")
    names = sorted(groups)
    pairs = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            diff = groups[b].mean() - groups[a].mean()
            q = abs(diff) / np.sqrt(mse / 2 * (1 / len(groups[a]) + 1 / len(groups[b]))) if mse > 0 else float("inf") if diff else 0.0
            pairs.append((a, b, float(diff), 0.0 if q == float("inf") else dist.tukey_sf(float(q), k, n - k)))
    spark = acc.sparkSession
    return {"stat": float(f), "df1": k - 1, "df2": n - k, "pval": float(dist.f_sf(f, k - 1, n - k)) if f == f else None, "pairs": spark.createDataFrame(pairs, "method_1 string, method_2 string, diff double, pval double")}


def mc_fried(acc: DataFrame, adjust: str = "holm") -> dict:
    """Friedman's test with iterations as blocks, and pairwise rank-sum tests with adjusted p-values."""
    wide = _table(acc).pivot(index="iter", columns="method", values="acc").dropna()
    n, k = wide.shape
    ranks = wide.rank(axis=1).to_numpy()
    ties = sum(float((t**3 - t).sum()) for t in (np.unique(r, return_counts=True)[1] for r in ranks))
    low = n * k * (k + 1) - ties / max(k - 1, 1)
    stat = 12 * ((ranks.sum(axis=0) - n * (k + 1) / 2) ** 2).sum() / low if low > 0 else float("nan")
    pairs, names = [], list(wide.columns)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = np.concatenate([wide[a], wide[b]])
            r = pd.Series(both).rank().to_numpy()
            t = np.unique(both, return_counts=True)[1].astype(float)
            pairs.append((a, b, dist.wilcoxon_p(float(r[:n].sum() - n * (n + 1) / 2), n, n, float((t**3 - t).sum()))))
    padj = dist.adjust(np.array([p for *_, p in pairs]), adjust)
    rows = [(a, b, *(None if v != v else float(v) for v in (p, q))) for (a, b, p), q in zip(pairs, padj, strict=True)]
    return {"stat": float(stat), "df": k - 1, "pval": float(dist.chi2_sf(stat, k - 1)) if stat == stat else None, "pairs": acc.sparkSession.createDataFrame(rows, "method_1 string, method_2 string, pval double, padj double")}


def mc_norm(acc: DataFrame) -> DataFrame:
    """``method, n, w, pval`` by Shapiro and Wilk; null outside 3 to 5000 values or when nothing varies."""

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        w, p = dist.shapiro(frame["acc"].dropna().to_numpy())
        return pd.DataFrame({"method": frame["method"].iloc[:1], "n": [int(frame["acc"].notna().sum())], "w": [w if w == w else None], "pval": [p if p == p else None]})

    known = F.when(~F.isnan("acc"), F.col("acc"))
    acc = acc.select("method", known.cast("double").alias("acc"))
    sizes = acc.groupBy("method").agg(F.count("acc").alias("n"))
    fit = sizes.where("n between 3 and 5000").select(F.col("method").alias("of"))  # only these are gathered, a method in a task
    tested = acc.where("acc is not null").join(fit, F.col("method").eqNullSafe(F.col("of")), "left_semi").groupBy("method").applyInPandas(each, "method string, n long, w double, pval double")
    none = F.lit(None).cast("double")
    return tested.unionByName(sizes.where("n not between 3 and 5000").select("method", "n", none.alias("w"), none.alias("pval")))
