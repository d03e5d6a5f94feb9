"""Lists: ragged vectors to columns, nested lists to one level, lists without missing entries; the driver's objects."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_to_frame(spark: SparkSession, lists: dict[str, Sequence]) -> DataFrame:
    """Ragged vectors as columns, with nulls at the ends; vectors of one element each become one row."""
    n = max((len(v) for v in lists.values()), default=0)
    rows = [(k, *[v[k] if k < len(v) else None for v in lists.values()]) for k in range(n)]
    kinds = {name: "double" if all(isinstance(x, (int, float)) or x is None for x in v) else "string" for name, v in lists.items()}
    cast = [[r[0], *[None if x is None else float(x) if kinds[c] == "double" else str(x) for c, x in zip(lists, r[1:], strict=True)]] for r in rows]
    return spark.createDataFrame(cast, "row long" + "".join(f", `{c}` {kinds[c]}" for c in lists))


def arrays_to_rows(df: DataFrame, arrays: list[str]) -> DataFrame:
    """The same for array columns of a table: one row per place, nulls where an array is shorter; distributed."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    rest = [c for c in df.columns if c not in arrays]
    return df.select(*rest, F.posexplode(zipped).alias("row", "cell")).select(*rest, "row", *[F.col("cell")[a].alias(a) for a in arrays])


def flatten_list(x: dict[str, Any] | Sequence, prefix: str = "") -> dict[str, Any]:
    """Nested dicts and lists to one level, keys joined by "_"; tables and other objects are leaves."""
    items = x.items() if isinstance(x, dict) else enumerate(x, 1)
    out: dict[str, Any] = {}
    for k, v in items:
        name = f"{prefix}_{k}" if prefix else str(k)
        if isinstance(v, (dict, list, tuple)):
            out |= flatten_list(v, name)
        else:
            out[name] = v
    return out


def shrink_list(x: dict[str, Any] | list) -> dict[str, Any] | list:
    """Without entries that are None or NaN."""
    kept = lambda v: v is not None and v == v if not isinstance(v, (list, dict, tuple)) else True
    return {k: v for k, v in x.items() if kept(v)} if isinstance(x, dict) else [v for v in x if kept(v)]


def shrink_array(array: Column | str) -> Column:
    """The same for an array column of doubles."""
    return F.filter(array, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
