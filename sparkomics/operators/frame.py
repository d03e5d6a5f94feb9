"""Long and vector frames, and the joins and running totals that the other operators share.

The long frame is ``sample_id, cls, feature, feature_idx, value`` (null: missing; NaN becomes null on the way in); the
vector frame is ``sample_id, cls, features array<double>``.  Class order is the order of the sorted labels; the baseline
class is the first, the positive class the second.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Zero or below, for intensities: the spacing of doubles at 1.
EPS = 2.220446049250313e-16
#: Rows up to which a small table is sent to every executor.
MOST_BROADCAST = 50_000
#: Copies of a small table's keys where it is too large for that.
SALTS = 16
MOST_CLASSES = 1_000
LONG = ["sample_id", "cls", "feature", "feature_idx", "value"]


def number(column: Column | str) -> Column:
    """As a double, with NaN as null."""
    return F.nullif((F.col(column) if isinstance(column, str) else column).cast("double"), F.lit(float("nan")))


def to_long(df: DataFrame, id_col: str, features: dict[str, Column | str] | list[str], cls: str | Column | None = None) -> DataFrame:
    """One row per sample and feature, in one pass without a shuffle (a generator over an array of structs)."""
    named = {f: f for f in features} if not isinstance(features, dict) else features
    cells = [F.struct(F.lit(name).alias("feature"), F.lit(i).alias("feature_idx"), number(c).alias("value")) for i, (name, c) in enumerate(named.items())]
    label = F.lit(None) if cls is None else F.col(cls) if isinstance(cls, str) else cls
    return df.select(F.col(id_col).alias("sample_id"), label.cast("string").alias("cls"), F.inline(F.array(*cells)))


def long_from_arrays(df: DataFrame, id_col: str, array_col: str, cls: str | None = None, prefix: str = "f") -> DataFrame:
    """The same from an array column; features are named by place, in two digits at least."""
    label = F.lit(None) if cls is None else F.col(cls)
    cells = df.select(F.col(id_col).alias("sample_id"), label.cast("string").alias("cls"), F.posexplode(array_col).alias("feature_idx", "value"))
    name = F.concat(F.lit(prefix), F.lpad(F.col("feature_idx").cast("string"), F.greatest(F.lit(2), F.length(F.col("feature_idx").cast("string"))), F.lit("0")))
    return cells.select("sample_id", "cls", name.alias("feature"), "feature_idx", number("value").alias("value"))


def vectors_from_arrays(df: DataFrame, id_col: str, array_col: str, cls: str | None = None) -> DataFrame:
    label = F.lit(None) if cls is None else F.col(cls)
    return df.select(F.col(id_col).alias("sample_id"), label.cast("string").alias("cls"), F.col(array_col).cast("array<double>").alias("features"))


def vectors_from_columns(df: DataFrame, id_col: str, features: list[str], cls: str | None = None) -> DataFrame:
    label = F.lit(None) if cls is None else F.col(cls)
    return df.select(F.col(id_col).alias("sample_id"), label.cast("string").alias("cls"), F.array(*[F.col(f).cast("double") for f in features]).alias("features"))


def to_vectors(long: DataFrame) -> DataFrame:
    """Gathers a sample's cells in feature order: a group has as many rows as there are features."""
    cells = F.sort_array(F.collect_list(F.struct("feature_idx", "value")))
    return long.groupBy("sample_id", "cls").agg(F.transform(cells, lambda c: c["value"]).alias("features"))


def to_wide(long: DataFrame, features: list[str]) -> DataFrame:
    """One column per named feature; the names are given, so no job looks for them."""
    return long.groupBy("sample_id", "cls").pivot("feature", features).agg(F.first("value", ignorenulls=True))


def model_frame(df: DataFrame, response: str, terms: list[str], id_col: str) -> DataFrame:
    """The formula front end: rows with a null in any term go, text terms become one 0/1 column for each level but the
    first, the intercept isn't kept.  Returns a vector frame; the levels of a text term are at most ``MOST_CLASSES``."""
    used = df.select(F.col(id_col).alias("sample_id"), F.col(response).cast("string").alias("cls"), *[F.col(t) for t in terms]).dropna()
    columns = []
    for t in terms:
        if dict(used.dtypes)[t] in ("string", "boolean"):
            columns += [(F.col(t).cast("string") == level).cast("double") for level in levels(used, t)[1:]]
        else:
            columns.append(F.col(t).cast("double"))
    return used.select("sample_id", "cls", F.array(*columns).alias("features"))


def levels(df: DataFrame, column: str = "cls") -> list[str]:
    """Sorted distinct labels; more than ``MOST_CLASSES`` is an error."""
    found = [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect()]
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{column} has more than {MOST_CLASSES} labels")
    return sorted(found)


def attach(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins a table that has one row per key.

    Its rows are counted first: up to ``MOST_BROADCAST`` it goes to every executor and ``rows`` isn't shuffled; beyond
    that both sides are dealt by the keys and a salt, so that a key with many rows is spread over ``SALTS`` tasks.
    """
    held = small.limit(MOST_BROADCAST + 1).toArrow()
    if held.num_rows <= MOST_BROADCAST:
        table = rows.sparkSession.createDataFrame(held, small.schema) if held.num_rows else small.limit(0)
        return rows.join(F.broadcast(table), keys, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return own.join(salted, [*keys, "__salt"], how).drop("__salt")


def running_totals(rows: DataFrame, keys: list[str], order: str, sums: list[str], tie: str | None = None, buckets: int = 64) -> DataFrame:
    """Adds ``before_<s>``: the total of ``s`` over the key's rows that come earlier by ``order`` (and then by ``tie``).

    A window over a whole key would put it in one task.  Here approximate quantiles cut each key into ``buckets``, the
    window runs inside a bucket, and the totals of earlier buckets (a small table) are added.  A value that is so
    frequent that it spans quantiles is cut further by ``tie``.  Without ``tie``, ``order`` must be unique in a key.
    """
    share = [i / buckets for i in range(1, buckets)]
    cuts = rows.groupBy(*keys).agg(
        F.percentile_approx(F.col(order).cast("double"), share, 1000).alias("__cuts"), *([F.min(tie).cast("double").alias("__low"), F.max(tie).cast("double").alias("__high")] if tie else [])
    )
    value = F.col(order).cast("double")
    bucket = 2 * F.size(F.filter("__cuts", lambda c: c < value)).cast("long")
    if tie:
        hot = F.size(F.filter("__cuts", lambda c: c == value)) >= 2
        share_of = (F.col(tie).cast("double") - F.col("__low")) / F.greatest(F.col("__high") - F.col("__low"), F.lit(1.0))
        bucket = F.when(hot, bucket + 1).otherwise(bucket) * (2 * buckets) + F.when(hot, F.floor(share_of * buckets)).otherwise(F.lit(0))
    dealt = attach(rows, cuts, keys).withColumn("__bucket", bucket).drop("__cuts", "__low", "__high")
    within = Window.partitionBy(*keys, "__bucket").orderBy(order, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = dealt.groupBy(*keys, "__bucket").agg(*[F.sum(s).alias(f"__of_{s}") for s in sums])
    bases = totals.select(*keys, "__bucket", *[zero(F.sum(f"__of_{s}").over(earlier)).alias(f"__base_{s}") for s in sums])
    counted = dealt.select("*", *[zero(F.sum(s).over(within)).alias(f"__in_{s}") for s in sums])
    joined = attach(counted, bases, [*keys, "__bucket"])
    return joined.select(*rows.columns, *[(F.col(f"__in_{s}") + F.col(f"__base_{s}")).alias(f"before_{s}") for s in sums])


def class_pairs(labels: list[str], choices: None | str | Iterable = None) -> list[tuple[str, str]]:
    """None: all pairs; one label: that one against each other; several: all pairs among them; a list that holds
    lists: the union of what each gives.  Labels must match exactly; pairs are in label order, without repeats."""
    place = {c: i for i, c in enumerate(labels)}

    def checked(c: str) -> str:
        if c not in place:
            raise ValueError(f"no class {c!r}")
        return c

    if choices is None:
        chosen = [(a, b) for i, a in enumerate(labels) for b in labels[i + 1 :]]
    elif isinstance(choices, str) or len(list(choices)) == 1 and isinstance(next(iter(choices)), str):
        one = checked(choices if isinstance(choices, str) else next(iter(choices)))
        chosen = [tuple(sorted((one, c), key=place.get)) for c in labels if c != one]
    elif all(isinstance(c, str) for c in choices):
        some = sorted({checked(c) for c in choices}, key=place.get)
        chosen = [(a, b) for i, a in enumerate(some) for b in some[i + 1 :]]
    else:
        chosen = [p for c in choices for p in class_pairs(labels, c)]
    return list(dict.fromkeys(chosen))


def select_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The rows of each pair of classes under a key ``pair`` ("a~b"): an equi-join on the label, not a theta join."""
    rows = [(c, f"{a}~{b}") for a, b in pairs for c in (a, b)]
    table = df.sparkSession.createDataFrame(rows, "cls string, pair string")  # at most MOST_CLASSES squared rows
    return df.join(F.broadcast(table), "cls")


def pair_membership(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``sample_id, cls, pair, member`` for every row and pair."""
    cells = F.array(*[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col("cls").isin(a, b).alias("member")) for a, b in pairs])
    return df.select("sample_id", "cls", F.inline(cells))


def indicator(df: DataFrame, labels: list[str]) -> DataFrame:
    """0/1 columns, one for each label."""
    return df.select("sample_id", *[(F.col("cls") == c).cast("int").alias(c) for c in labels])


def melt(wide: DataFrame, row_col: str, columns: list[str]) -> DataFrame:
    """``row, column, value`` from a wide table."""
    return wide.unpivot([row_col], columns, "column", "value").select(F.col(row_col).alias("row"), "column", "value")
