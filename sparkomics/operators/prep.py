"""Missing values, scaling, transformations and column filters on the long frame.

A column operator sums each feature (partial sums before the shuffle) and joins the few sums back without moving the
samples; a row operator does the same by sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import EPS, LONG, attach


def mv_zene(long: DataFrame) -> DataFrame:
    """Zeros and negatives become missing."""
    return long.withColumn("value", F.when(F.col("value") >= EPS, F.col("value")))


def mv_fill(long: DataFrame, method: str | Callable[[Column], Column] | dict[str, float] = "mean", ze_ne: bool = False) -> DataFrame:
    """Missing values get their feature's mean, median, min or max, or what ``method`` (an aggregate of a
    column, or a table of values by feature) gives.

    ``ze_ne`` first makes zeros and negatives missing; not for data that may be negative.  A feature without any value
    stays missing.
    """
    known = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}
    rows = mv_zene(long) if ze_ne else long
    if isinstance(method, dict):
        fill = long.sparkSession.createDataFrame([(f, float(v)) for f, v in method.items()], "feature string, fill double")
        return attach(rows, fill, ["feature"], "left").withColumn("value", F.coalesce("value", "fill")).select(*LONG)
    fill = rows.groupBy("feature").agg((known[method] if isinstance(method, str) else method)(F.col("value")).alias("fill"))
    return attach(rows, fill, ["feature"]).withColumn("value", F.coalesce("value", "fill")).select(*LONG)


def mv_stats(long: DataFrame) -> DataFrame:
    """Missing rates overall, by feature and by feature and class, as grouping sets: ``level, feature, cls, rate``.

    The sums by (feature, class) are made once; the coarser levels are sums of that small table.
    """
    cells = long.groupBy("feature", "cls").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("miss"))
    f, c = F.col("feature"), F.col("cls")
    sets = cells.groupingSets([[], [f], [f, c]], f, c).agg((F.sum("miss") / F.sum("n")).alias("rate"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "feature").otherwise("class")
    return sets.select(level.alias("level"), "feature", "cls", "rate")


def mv_filter(long: DataFrame, most: float = 0.15) -> DataFrame:
    """The features whose missing rate is below ``most``."""
    rate = long.groupBy("feature").agg(F.avg(F.col("value").isNull().cast("int")).alias("rate")).where(F.col("rate") < most).select("feature")
    return attach(long, rate, ["feature"]).select(*LONG)


def mv_pattern(long: DataFrame) -> DataFrame:
    """Distinct patterns (1: observed, in feature order) with their counts and missing cells."""
    cells = F.sort_array(F.collect_list(F.struct("feature_idx", F.col("value").isNotNull().cast("int").alias("seen"))))
    rows = long.groupBy("sample_id").agg(F.array_join(F.transform(cells, lambda c: c["seen"].cast("string")), "").alias("pattern"))
    return rows.groupBy("pattern").agg(F.count("*").alias("n")).withColumn("n_missing", F.length(F.replace("pattern", F.lit("1"), F.lit(""))).cast("long"))


def _sd_guard(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(0.0))


COLUMN_METHODS: dict[str, Callable[[Column], Column]] = {
    "center": lambda v: v - F.col("m"),
    "auto": lambda v: (v - F.col("m")) / _sd_guard("s"),
    "range": lambda v: (v - F.col("m")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)),
    "pareto": lambda v: (v - F.col("m")) / F.sqrt(_sd_guard("s")),
    "vast": lambda v: (v - F.col("m")) * F.col("m") / (_sd_guard("s") * F.col("s")),
    "level": lambda v: (v - F.col("m")) / F.nullif(F.col("m"), F.lit(0.0)),
}
CELL_METHODS: dict[str, Callable[[Column, float], Column]] = {
    "log": lambda v, add: F.when(v + add > 0, F.ln(v + add)),
    "log10": lambda v, add: F.when(v + add > 0, F.log10(v + add)),
    "sqrt": lambda v, add: F.when(v >= 0, F.sqrt(v)),
    "asinh": lambda v, add: F.asinh(v),
}


def preproc(long: DataFrame, method: str | list[str] = "log", add: float = 1.0, grouped: bool = False) -> DataFrame:
    """Applies the methods in turn, each column by column.

    Constant columns give null under methods that divide by their spread, and so do logarithms and roots outside their
    domain.  ``TICnorm`` divides by the sample's total; with ``grouped``, by that total less the difference between its
    class's mean total and the mean of all totals.
    """
    for name in [method] if isinstance(method, str) else method:
        if name in CELL_METHODS:
            long = long.withColumn("value", CELL_METHODS[name](F.col("value"), float(add)))
        elif name in COLUMN_METHODS:
            stats = long.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            long = attach(long, stats, ["feature"]).withColumn("value", COLUMN_METHODS[name](F.col("value"))).select(*LONG)
        elif name == "TICnorm":
            long = _tic(long, grouped)
        else:
            raise ValueError(f"unknown method: {name}")
    return long


def _tic(long: DataFrame, grouped: bool) -> DataFrame:
    totals = long.groupBy("sample_id", "cls").agg(F.sum("value").alias("total"))
    divisor = F.col("total")
    if grouped:
        means = totals.groupBy("cls").agg(F.avg("total").alias("class_mean"))
        everything = totals.agg(F.avg("total").alias("all_mean")).first()[0]
        totals = attach(totals, means, ["cls"])
        divisor = F.col("total") - (F.col("class_mean") - F.lit(everything).cast("double"))
    shares = totals.select("sample_id", F.nullif(divisor, F.lit(0.0)).alias("divisor"))
    return long.join(shares, "sample_id").withColumn("value", F.col("value") / F.col("divisor")).select(*LONG)


def preproc_sd(long: DataFrame, by_class: bool = False) -> DataFrame:
    """Keeps the features whose deviation, or whose least deviation within a class, is above rounding."""
    keys = ["feature", "cls"] if by_class else ["feature"]
    spread = long.groupBy(*keys).agg(F.stddev_samp("value").alias("s")).groupBy("feature").agg(F.min("s").alias("s"))
    return attach(long, spread.where(F.col("s") > EPS).select("feature"), ["feature"]).select(*LONG)


def within_sd(long: DataFrame) -> DataFrame:
    """``feature, sd``: deviation of the class-centred column, with divisor n - 1."""
    cells = long.groupBy("feature", "cls").agg(F.count("value").alias("n"), F.var_samp("value").alias("v"))
    pooled = F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("v")).otherwise(F.lit(0.0)))
    return cells.groupBy("feature").agg(F.sqrt(pooled / F.nullif(F.sum("n") - 1, F.lit(0))).alias("sd"))


def preproc_const(long: DataFrame, tol: float = 1e-4) -> DataFrame:
    """Drops the features that are constant within classes, up to ``tol``."""
    return attach(long, within_sd(long).where(F.col("sd") >= tol).select("feature"), ["feature"]).select(*LONG)


def fold_change(num: Column, denom: Column) -> Column:
    """num / denom, or its negative inverse where num is less."""
    return F.when(num >= denom, num / F.nullif(denom, F.lit(0.0))).otherwise(-denom / F.nullif(num, F.lit(0.0)))


def fold_change_to_log(fc: Column, base: float = 2.0) -> Column:
    ratio = F.when(fc < 0, -1 / fc).otherwise(fc)
    return F.when(ratio > 0, F.log(float(base), ratio))


def log_to_fold_change(r: Column, base: float = 2.0) -> Column:
    power = F.pow(F.lit(float(base)), r)
    return F.when(power < 1, -1 / power).otherwise(power)
