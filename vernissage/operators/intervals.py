"""Runs of days: which ones overlap.

A run is a first and a last day, both inclusive; a missing first day is open to the past and a
missing last day to the future. Neither operator compares all pairs of a group:

* `with_overlap` (existence) reduces each key to at most one row per day before any window;
* `overlap_pairs` (all pairs that overlap) is an equi-join on grid blocks sized to each run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Day numbers outside any calendar date.
OPEN_PAST = -10_000_000
OPEN_FUTURE = 10_000_000


def first_number(day: Column) -> Column:
    return F.coalesce(F.unix_date(day), F.lit(OPEN_PAST))


def last_number(day: Column) -> Column:
    return F.coalesce(F.unix_date(day), F.lit(OPEN_FUTURE))


def with_overlap(probes: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of `probes` (keys, first_day, last_day, ...) whose run shares a day with at least
    one run of the same keys in `runs` (keys, first_day, last_day).

    A probe [a, b] is met iff, among runs starting by b, the latest end is at least a. Both sides
    are reduced to one row per (keys, day) first, so the window over a key is bounded by the
    calendar however many rows share the key."""
    keys = list(keys)
    ends = runs.groupBy(*keys, first_number(F.col("first_day")).alias("_day")).agg(
        F.max(last_number(F.col("last_day"))).alias("_until")
    )
    probes = probes.withColumn("_day", last_number(F.col("last_day")))
    asked = probes.select(*keys, "_day").distinct()
    line = ends.withColumn("_ask", F.lit(0)).unionByName(
        asked.select(*keys, "_day", F.lit(None).cast("int").alias("_until"), F.lit(1).alias("_ask"))
    )
    so_far = Window.partitionBy(*keys).orderBy("_day", "_ask").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    reach = (
        line.withColumn("_until", F.max("_until").over(so_far))
        .filter("_ask = 1 AND _until IS NOT NULL")
        .drop("_ask")
    )
    return (
        probes.join(reach, [*keys, "_day"])
        .filter(F.col("_until") >= first_number(F.col("first_day")))
        .drop("_day", "_until")
    )


# (longest run, block size) in days per level; anything longer goes to one last level.
_LEVELS = ((64, 32), (2_048, 1_024), (65_536, 32_768))


def _blocks(level: int, low: Column, high: Column) -> Column:
    return F.transform(
        F.sequence(low, high), lambda b: F.struct(F.lit(level).alias("level"), b.alias("block"))
    )


def run_blocks(first: Column, last: Column) -> Column:
    """The blocks a run touches, at the one level that fits its length: never more than three."""
    blocks = None
    for level, (longest, size) in enumerate(_LEVELS):
        touched = _blocks(level, F.floor(first / size), F.floor(last / size))
        fits = last - first <= longest
        blocks = F.when(fits, touched) if blocks is None else blocks.when(fits, touched)
    top = F.array(F.struct(F.lit(len(_LEVELS)).alias("level"), F.lit(0).cast("long").alias("block")))
    return F.when(last >= first, blocks.otherwise(top)).otherwise(F.array())


def day_blocks(day: Column) -> Column:
    """The blocks one day lies in, one per level."""
    found = [
        F.struct(F.lit(level).alias("level"), F.floor(day / size).alias("block"))
        for level, (_, size) in enumerate(_LEVELS)
    ]
    top = F.struct(F.lit(len(_LEVELS)).alias("level"), F.lit(0).cast("long").alias("block"))
    return F.array(*found, top)


def overlap_pairs(requests: DataFrame, items: DataFrame, salts: int = 8) -> DataFrame:
    """Every (request, item) whose runs share a day. `requests` holds `_from`, `_to` and `items`
    `_first`, `_last`, all day numbers; the other column names must not clash.

    Two runs overlap iff the item starts inside the request, or it started before and the request
    starts inside it. Each half puts a day inside a run, which is an equality of grid blocks, and
    one join answers both. Requests (the small side by nature) are repeated over `salts`, so a
    block that holds a third of all items is still spread out; when they are small enough, the
    join broadcasts them by size and the items are not shuffled at all."""

    # Half, level, salt and block in one long: the cheapest key to shuffle, hash and compare.
    unit, shift, levels = 2**32, 10**6, len(_LEVELS) + 1

    def packed(half: int, blocks: Column) -> Column:
        code = lambda b: (half * levels + b["level"].cast("long")) * salts + F.col("_salt")
        return F.transform(blocks, lambda b: code(b) * unit + b["block"] + shift)

    salt = F.array(*(F.lit(n) for n in range(salts)))
    asked = requests.withColumn("_salt", F.explode(salt)).withColumn("_at", F.explode(F.concat(
        packed(0, run_blocks(F.col("_from"), F.col("_to"))), packed(1, day_blocks(F.col("_from")))))).drop("_salt")
    # The salt is a function of the row, not of the attempt: a recomputed task gives the same rows.
    held = items.withColumn(
        "_salt", F.pmod(F.xxhash64(*items.columns), F.lit(salts)).cast("int")
    ).withColumn("_at", F.explode(F.concat(
        packed(0, day_blocks(F.col("_first"))), packed(1, run_blocks(F.col("_first"), F.col("_last")))))).drop("_salt")
    inside = (F.col("_at") < levels * salts * unit) == (F.col("_first") >= F.col("_from"))
    return (
        asked.join(held, "_at")
        .filter(inside & (F.col("_first") <= F.col("_to")) & (F.col("_last") >= F.col("_from")))
        .drop("_at")
    )
