"""Resampling plans as tables: ``splits (iter, rep, sample_id, mult)``; mult 0 is a test row, above 0 a training row.

Order and draws come from MD5 of (seed, iter, rep, id), never from the partitioning, so a plan is the same on any
cluster and after any lost task.  Rows are numbered by distributed running totals of that hash.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import attach, running_totals

MOST_ATTEMPTS = 20
#: Of leave-one-out's output, about.
ROWS_A_TASK = 20_000_000


@dataclass(frozen=True)
class Plan:
    """sampling: loocv, cv, rand or boot.  ``div`` is the training share of rand.  loocv has one iteration."""

    sampling: str = "cv"
    niter: int = 10
    nreps: int = 10
    strat: bool = False
    div: float = 2 / 3
    seed: int = 1

    def __post_init__(self) -> None:
        if self.sampling not in ("loocv", "cv", "rand", "boot"):
            raise ValueError(f"unknown sampling: {self.sampling}")
        if self.niter < 1 or self.nreps < 1 or self.sampling == "cv" and self.nreps < 2:
            raise ValueError("niter is at least 1, nreps at least 1 (cv: 2)")
        if not 0 < self.div < 1:
            raise ValueError("div lies between 0 and 1")
        if self.sampling == "loocv" and self.niter != 1:
            object.__setattr__(self, "niter", 1)


def hash_long(*parts: Column | str | int) -> Column:
    """The first 60 bits of an MD5 of the parts, as a long."""
    text = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _repeated(samples: DataFrame, plan: Plan, reps: bool) -> DataFrame:
    rows = samples.withColumn("iter", F.explode(F.sequence(F.lit(1), F.lit(plan.niter))))
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(plan.nreps)))) if reps else rows.withColumn("rep", F.lit(0))


def _numbered(rows: DataFrame, keys: list[str], seed: int, salt: str) -> DataFrame:
    """Adds ``place`` (from 0) in the order of the hash within each key, and the key's ``size``."""
    hashed = rows.withColumn("h", hash_long(seed, F.lit(salt), "iter", "rep", "sample_id")).withColumn("one", F.lit(1).cast("long"))
    placed = running_totals(hashed, keys, "h", ["one"], tie="sample_id").withColumnRenamed("before_one", "place")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("size"))
    return attach(placed, sizes, keys).drop("h", "one")


def splits(samples: DataFrame, plan: Plan, by: list[str] | None = None) -> DataFrame:
    """From ``samples (sample_id, cls)``, one row each, all rows of the plan, test rows included.  The rows of each key in ``by``
    have a plan of their own.

    cv deals the first ``size mod nreps`` folds one row more (by class with ``strat``); rand trains on
    floor(size * div) rows; boot draws as many rows as there are, with replacement, within each class with ``strat``.
    """
    by = by or []
    samples = samples.select(*by, "sample_id", F.col("cls").cast("string").alias("cls"))
    group = ["cls"] if plan.strat else []
    if plan.sampling == "loocv":
        placed = _numbered(_repeated(samples, plan, False), [*by, "iter", "rep"], plan.seed, "l").select(*by, "iter", "sample_id", F.col("place").alias("fold"))
        return _folds(placed, placed.groupBy(*by, "iter").agg((F.max("fold") + 1).alias("reps")), by, _spread(samples))
    if plan.sampling == "cv":
        placed = _numbered(_repeated(samples, plan, False), [*by, "iter", "rep", *group], plan.seed, "c")
        k = F.lit(plan.nreps).cast("long")
        each, more = F.floor(F.col("size") / k), F.col("size") % k
        fold = F.when(F.col("place") < more * (each + 1), F.floor(F.col("place") / (each + 1))).otherwise(more + F.floor((F.col("place") - more * (each + 1)) / F.greatest(each, F.lit(1))))
        placed = placed.select(*by, "iter", "sample_id", fold.cast("long").alias("fold"))
        return _folds(placed, placed.groupBy(*by, "iter").agg(F.lit(plan.nreps).cast("long").alias("reps")), by)
    rows = _repeated(samples, plan, True)
    if plan.sampling == "rand":
        placed = _numbered(rows, [*by, "iter", "rep", *group], plan.seed, "r")
        return placed.select(*by, "iter", "rep", "sample_id", (F.col("place") < F.floor(F.col("size") * plan.div)).cast("int").alias("mult"))
    placed = _numbered(rows, [*by, "iter", "rep", *group], plan.seed, "b")
    # every row makes one draw: the place that it draws is a hash of its own place
    drawn = F.pmod(hash_long(plan.seed, F.lit("d"), "iter", "rep", *([F.col("cls")] if plan.strat else []), F.col("place")), F.col("size"))
    draws = placed.select(*by, "iter", "rep", *group, drawn.alias("place")).groupBy(*by, "iter", "rep", *group, "place").agg(F.count("*").cast("int").alias("mult"))
    return placed.join(draws, [*by, "iter", "rep", *group, "place"], "left").select(*by, "iter", "rep", "sample_id", F.coalesce("mult", F.lit(0)).alias("mult"))


def _spread(samples: DataFrame) -> int:
    """Tasks for leave-one-out, whose rows are the square of the samples."""
    return max(samples.sparkSession.sparkContext.defaultParallelism, -(-(samples.count() ** 2) // ROWS_A_TASK))


def _folds(placed: DataFrame, reps: DataFrame, by: list[str], spread: int = 0) -> DataFrame:
    rows = attach(placed, reps, [*by, "iter"])
    if spread:  # few rows here, many after the next step
        rows = rows.repartition(spread, "sample_id")
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.col("reps"))))
    return rows.select(*by, "iter", F.col("rep").cast("int").alias("rep"), "sample_id", (F.col("fold") != F.col("rep") - 1).cast("int").alias("mult"))


def checked_splits(samples: DataFrame, plan: Plan) -> DataFrame:
    """As ``splits``, drawn again for the iterations in which a class has fewer than two training rows or no test row.

    The next attempt adds 1000 to the seed; after ``MOST_ATTEMPTS`` it is an error rather than an endless loop.  loocv
    isn't checked.
    """
    if plan.sampling == "loocv":
        return splits(samples, plan)
    labels = samples.select("sample_id", F.col("cls").cast("string").alias("cls"))
    kept, left = None, list(range(1, plan.niter + 1))
    for attempt in range(MOST_ATTEMPTS):
        now = splits(samples, replace(plan, seed=plan.seed + 1000 * attempt)).where(F.col("iter").isin(left))
        counts = now.join(labels, "sample_id").groupBy("iter", "rep", "cls").agg(F.sum((F.col("mult") > 0).cast("int") * F.col("mult")).alias("train"), F.count_if(F.col("mult") == 0).alias("test"))
        bad = sorted(r[0] for r in counts.where("train < 2 or test < 1").select("iter").distinct().collect())  # at most niter numbers
        good = [i for i in left if i not in bad]
        if good:
            part = now.where(F.col("iter").isin(good))
            kept = part if kept is None else kept.unionByName(part)
        left = bad
        if not left:
            return kept
    raise ValueError("some class is too small for this plan")


def pair_splits(samples: DataFrame, pairs: list[tuple[str, str]], plan: Plan) -> DataFrame:
    """``pair (its place in pairs), iter, rep, sample_id, mult``: for each pair of classes what ``checked_splits`` gives for its
    rows alone, in one plan.  Not for loocv."""
    labels = samples.select("sample_id", F.col("cls").cast("string").alias("cls"))
    places = samples.sparkSession.createDataFrame([(c, k) for k, pair in enumerate(pairs) for c in pair], "cls string, pair int")
    rows = labels.join(F.broadcast(places), "cls")
    kept, left = None, [(k, i) for k in range(len(pairs)) for i in range(1, plan.niter + 1)]
    for attempt in range(MOST_ATTEMPTS):
        wanted = samples.sparkSession.createDataFrame(left, "pair int, iter int")
        now = splits(rows, replace(plan, seed=plan.seed + 1000 * attempt), ["pair"]).join(F.broadcast(wanted), ["pair", "iter"])
        counts = now.join(labels, "sample_id").groupBy("pair", "iter", "rep", "cls").agg(F.sum("mult").alias("train"), F.count_if(F.col("mult") == 0).alias("test"))
        bad = sorted((r[0], r[1]) for r in counts.where("train < 2 or test < 1").select("pair", "iter").distinct().collect())
        good = [x for x in left if x not in set(bad)]
        if good:
            part = now.join(F.broadcast(samples.sparkSession.createDataFrame(good, "pair int, iter int")), ["pair", "iter"])
            kept = part if kept is None else kept.unionByName(part)
        left = bad
        if not left:
            return kept
    raise ValueError("some class is too small for this plan")


def memberships(plan_rows: DataFrame) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``sample_id, mults`` with one place for each (iter, rep), and the list of those; a plan has few of them (not loocv)."""
    names = sorted((r[0], r[1]) for r in plan_rows.select("iter", "rep").distinct().limit(100_001).collect())
    if len(names) > 100_000:
        raise ValueError("a plan has at most 100000 resamples here")
    cells = F.map_from_entries(F.collect_list(F.struct(F.struct("iter", "rep"), "mult")))  # one entry per resample
    order = F.array(*[F.struct(F.lit(i).alias("iter"), F.lit(r).alias("rep")) for i, r in names]) if len(names) <= 500 else None
    rows = plan_rows.groupBy("sample_id").agg(cells.alias("m"))
    if order is not None:
        return rows.select("sample_id", F.transform(order, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))).alias("mults")), names
    sorted_cells = F.transform(F.array_sort(F.map_entries("m")), lambda e: e["value"])
    return rows.select("sample_id", sorted_cells.alias("mults")), names
