"""Text summaries of results and models.  Tables that are printed have one row per class, method, iteration or length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, models

TOP = 10
#: Of a printed table; a longer one raises.
MOST_ROWS = 1_000


def _table(df: DataFrame, digits: int = 3) -> str:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a printed table holds at most {MOST_ROWS} rows; select or write the frame instead")
    cells = [df.columns, *[["" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r] for r in rows]]
    wide = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(r, wide, strict=True)) for r in cells)


def _confusion(preds: DataFrame, labels: list[str]) -> str:
    return _table(preds.groupBy("obs").pivot("pred", labels).count().na.fill(0).orderBy("obs"))


def accest(result, digits: int = 3, full: bool = False) -> str:
    s = result.summary.first()
    out = [f"Method: {result.method}", f"Sampling: {result.plan.sampling}, {result.plan.niter} x {result.plan.nreps}"]
    out += [f"{name}: {s[c]:.{digits}f}" for name, c in (("Accuracy", "acc"), ("AUC", "auc"), ("Margin", "margin")) if s[c] is not None]
    out.append("Confusion:\n" + _confusion(result.preds, result.labels))
    if full:
        out.append("By iteration:\n" + _table(result.iters.select("iter", "acc").orderBy("iter"), digits))
    return "\n".join(out)


def maccest(result, digits: int = 3, full: bool = False) -> str:
    out = ["By method:\n" + _table(result.summary.select("method", "acc", "acc_std", "auc", "margin").orderBy("method"), digits)]
    if result.tests:
        out += [f"Test: {result.tests['stat']:.{digits}f}, p {result.tests['pval']}", _table(result.tests["pairs"], digits)]
    if full:
        six = result.iters.groupBy("method").agg(F.min("acc").alias("min"), F.percentile("acc", F.lit(0.25)).alias("q1"), F.median("acc").alias("median"), F.avg("acc").alias("mean"), F.percentile("acc", F.lit(0.75)).alias("q3"), F.max("acc").alias("max"))
        out.append("Accuracy over iterations:\n" + _table(six.orderBy("method"), digits))
    return "\n".join(out)


def frankvali(result, digits: int = 3, full: bool = False) -> str:
    out = [f"Classifier: {result.method}", f"Ranking: {result.fs_method}", f"Sampling: {result.plan.sampling}, {result.plan.niter} x {result.plan.nreps}", "Error by length:\n" + _table(result.err_avg.orderBy("len"), digits)]
    out.append("Best features:\n" + _table(result.order.orderBy("fs_rank").limit(TOP).select("fs_rank", "feature"), digits))
    if full:
        out.append("Error by iteration:\n" + _table(result.err_iter.orderBy("iter", "len"), digits))
    return "\n".join(out)


def model(fitted, vectors: DataFrame, full: bool = False) -> str:
    """Of a fitted pcalda, plsc or plslda model on its rows: components, shares, confusion, accuracy in per cent."""
    preds = models.predict(vectors, fitted)
    rate = evaluate.cl_rate(preds).first()
    pls = hasattr(fitted, "pls")
    share = 100 * fitted.pls.xvar / fitted.pls.xtotvar if pls else 100 * fitted.lda.svd**2 / (fitted.lda.svd**2).sum()
    out = [f"Components: {fitted.pls.k if pls else len(fitted.keep)}", "Confusion:\n" + _confusion(preds, fitted.labels), f"Accuracy: {100 * rate['acc']:.2f}%"]
    if full or not pls:
        out.append("Shares of axes (%): " + ", ".join(f"{v:.2f}" for v in np.atleast_1d(share)))
    if full:
        out.append("Classes: " + ", ".join(fitted.labels))
    return "\n".join(out)


def osc(fitted: models.OSC, full: bool = False) -> str:
    out = [f"Method: {fitted.method}", f"R2: {fitted.r2:.2f}%", f"Angle: {fitted.angle:.2f} degrees"]
    if full:
        out.append(f"Features: {fitted.w.shape[0]}, components: {fitted.w.shape[1]}")
    return "\n".join(out)
