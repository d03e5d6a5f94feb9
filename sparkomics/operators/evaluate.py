"""Classification metrics from predictions ``obs, pred[, posterior]`` and from scores.

Counts of (obs, pred) are at most classes squared, whatever the number of predictions; curves number the distinct
scores with distributed running totals, in O(n log n) for all cutoffs together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import attach, running_totals
from .summary import FEATURE


def confusion(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return preds.groupBy(*(by or []), "obs", "pred").agg(F.count("*").alias("n"))


def cl_rate(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, error and Cohen's kappa by key: ``n, acc, err, kappa``."""
    cells = confusion(preds, by)
    keys = by or []
    rows = cells.groupBy(*keys, F.col("obs").alias("c")).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*keys, F.col("pred").alias("c")).agg(F.sum("n").alias("s"))
    both = rows.unionByName(cols, allowMissingColumns=True).groupBy(*keys, "c").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    by_chance = both.groupBy(*keys).agg(F.sum(F.col("r").cast("double") * F.col("s")).alias("chance"))
    hits = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("obs") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    joined = hits.join(by_chance, keys) if keys else hits.crossJoin(by_chance)  # without keys both have one row
    acc, pc = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return joined.select(*keys, "n", acc.alias("acc"), (1 - acc).alias("err"), ((acc - pc) / F.nullif(1 - pc, F.lit(0.0))).alias("kappa"))


def class_rate(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy of each observed class."""
    return preds.groupBy(*(by or []), "obs").agg(F.count("*").alias("n"), F.avg((F.col("obs") == F.col("pred")).cast("double")).alias("acc"))


def cl_perf(preds: DataFrame, pos: str, by: list[str] | None = None) -> DataFrame:
    """Two-class ``acc, tpr, fpr, sens, spec`` for a positive label; a label that is never predicted counts as zero."""
    o, p = F.col("obs") == pos, F.col("pred") == pos
    t = preds.groupBy(*(by or [])).agg(F.count_if(o & p).alias("tp"), F.count_if(~o & p).alias("fp"), F.count_if(o & ~p).alias("fn"), F.count_if(~o & ~p).alias("tn"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return t.select(*(by or []), "tp", "fp", "fn", "tn", acc.alias("acc"), share("tp", "fn").alias("tpr"), share("fp", "tn").alias("fpr"), share("tp", "fn").alias("sens"), share("tn", "fp").alias("spec"))


def auc(scores: DataFrame, by: list[str] | None = None, folded: bool = True) -> DataFrame:
    """Area under the ROC curve of ``stat, positive (0/1), sample_id`` by key; equal scores stand in the order of ids.

    The share of positives above a negative, averaged over the negatives; folded to 0.5 or more on request.  A key with
    one class only has a null area.
    """
    keys = by or ["__all"]
    rows = scores.where("stat is not null").select(*([F.lit(1).alias("__all")] if not by else by), (-F.col("stat").cast("double")).alias("__down"), F.col("positive").cast("long").alias("positive"), "sample_id")
    seen = running_totals(rows, keys, "__down", ["positive"], tie="sample_id")
    t = seen.groupBy(*keys).agg(
        F.sum("positive").alias("n_pos"), F.sum(1 - F.col("positive")).alias("n_neg"), F.sum(F.when(F.col("positive") == 0, F.col("before_positive")).otherwise(0)).cast("double").alias("above")
    )
    raw = F.col("above") / F.nullif(F.col("n_pos").cast("double") * F.col("n_neg"), F.lit(0.0))
    return t.select(*(by or []), "n_pos", "n_neg", raw.alias("raw_auc"), (F.greatest(raw, 1 - raw) if folded else raw).alias("auc"))


def feature_auc(long: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``stat`` (folded) and ``raw_auc`` by feature; the positive class is the greater of a key's two labels."""
    keys = by or []
    rows = long.where("value is not null and cls is not null")
    top = rows.groupBy(*keys, *FEATURE).agg(F.max("cls").alias("pos"))
    scored = attach(rows, top, [*keys, *FEATURE]).select(*keys, *FEATURE, F.col("value").alias("stat"), (F.col("cls") == F.col("pos")).cast("int").alias("positive"), "sample_id")
    return auc(scored, [*keys, *FEATURE]).select(*keys, *FEATURE, F.col("auc").alias("stat"), "raw_auc")


def roc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each distinct ``stat`` as cutoff (positive at or above it): ``cutoff, acc, tpr, fpr, sens, spec``."""
    keys = by or ["__all"]
    start = scores if by else scores.withColumn("__all", F.lit(1))
    values = start.where("stat is not null").groupBy(*keys, (-F.col("stat").cast("double")).alias("__down")).agg(F.sum(F.col("positive").cast("long")).alias("p"), F.sum(1 - F.col("positive").cast("long")).alias("q"))
    totals = values.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    seen = attach(running_totals(values, keys, "__down", ["p", "q"]), totals, keys)
    tp, fp = F.col("before_p") + F.col("p"), F.col("before_q") + F.col("q")
    tpr, fpr = tp / F.nullif("n_pos", F.lit(0)), fp / F.nullif("n_neg", F.lit(0))
    return seen.select(*(by or []), (-F.col("__down")).alias("cutoff"), ((tp + F.col("n_neg") - fp) / (F.col("n_pos") + F.col("n_neg"))).alias("acc"), tpr.alias("tpr"), fpr.alias("fpr"), tpr.alias("sens"), (1 - fpr).alias("spec"))


def margin(preds: DataFrame, labels: list[str]) -> DataFrame:
    """Adds ``margin``: the true class's share less the greatest other; rows whose values exceed 1 are normalised."""
    total = F.aggregate("posterior", F.lit(0.0), lambda a, b: a + b)
    share = F.when(F.exists("posterior", lambda v: v > 1), F.transform("posterior", lambda v: v / total)).otherwise(F.col("posterior"))
    places = F.array(*[F.lit(c) for c in labels])
    pairs = F.arrays_zip(share.alias("p"), places.alias("c"))
    own = F.element_at(F.filter(pairs, lambda x: x["c"] == F.col("obs")), 1)["p"]
    others = F.array_max(F.transform(F.filter(pairs, lambda x: x["c"] != F.col("obs")), lambda x: x["p"]))
    return preds.withColumn("margin", F.when(F.col("posterior").isNotNull() & F.array_contains(places, F.col("obs")), own - others))


def boot_err(preds: DataFrame, resub: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``.632`` and ``.632+`` errors from out-of-bag ``preds`` and resubstitution ``resub`` predictions.

    The no-information rate comes from the two label histograms of ``resub``, not from all pairs.
    """
    keys = by or []
    err = cl_rate(preds, by).select(*keys, F.col("err").alias("boot"))
    cells = confusion(resub, by)
    rows = cells.groupBy(*keys, F.col("obs").alias("c")).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*keys, F.col("pred").alias("c")).agg(F.sum("n").alias("s"))
    same = rows.join(cols, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("r").cast("double") * F.col("s")).alias("same"))
    rate = cl_rate(resub, by).select(*keys, "n", F.col("err").alias("ae"))
    merge = (lambda a, b: a.join(b, keys, "left")) if keys else (lambda a, b: a.join(b, F.lit(True), "left"))  # one row each
    t = merge(merge(err, rate), same)
    gamma = 1 - F.coalesce("same", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    t = t.withColumn("gamma", gamma)
    e, a, g = F.col("boot"), F.col("ae"), F.col("gamma")
    r = F.when((e > a) & (g > a), (e - a) / (g - a)).otherwise(F.lit(0.0))
    b632 = 0.368 * a + 0.632 * e
    plus = b632 + (F.least(e, g) - a) * (0.368 * 0.632 * r) / (1 - 0.368 * r)
    return t.select(*keys, "ae", "boot", "gamma", b632.alias("b632"), plus.alias("b632p"))
