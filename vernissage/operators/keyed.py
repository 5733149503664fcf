"""Keyed tables: one row per key, and two keyed tables set side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest `order`: one aggregation, combined before the shuffle,
    so a key repeated a billion times still sends one row per task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def side_by_side(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two tables that are unique on `keys`: the keys, then the whole rows as
    the structs `cur` and `new`, null where a side has none."""
    left = current.select(*keys, F.struct(*current.columns).alias("cur"))
    right = incoming.select(*keys, F.struct(*incoming.columns).alias("new"))
    return left.join(right, list(keys), "full_outer")


def any_distinct(columns: Sequence[str], a: str = "cur", b: str = "new") -> Column:
    """Any of `columns` is distinct between the two rows, null being equal to null."""
    return reduce(
        lambda x, y: x | y,
        (~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns),
    )


def append_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-if-absent: the current rows, then the incoming keys it does not hold."""
    fresh = incoming.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti")
    return current.unionByName(fresh)


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys), list(keys), "left_anti")
