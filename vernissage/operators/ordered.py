"""Running values over long sequences.

A window over a key runs in one task. Sequences here are cut into blocks of their order value
first: each block is summed up where it lies, the summaries run over the key (one row a block), and
the rows run within their block, so a key with a third of all rows is spread like any other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def running(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, tuple[str, Column]], *,
    block: int = 10_000, before_only: bool = False,
) -> DataFrame:
    """`df` with each named running value: `sum`, `max` or the `last` one that is not null, up to the
    row (or, with `before_only`, up to the row before). `order` is an integer, unique in a key."""
    keys = list(keys)
    inputs = {f"_in_{n}": c for n, (_, c) in values.items()}
    cut = df.withColumns(inputs).withColumn("_block", F.floor(F.col(order) / block))

    def whole(name: str, kind: str) -> Column:
        c = F.col(f"_in_{name}")
        if kind == "last":
            return F.max_by(c, F.when(c.isNotNull(), F.col(order)))
        return _COMBINE[kind](c)

    summary = cut.groupBy(*keys, "_block").agg(
        *(whole(n, kind).alias(f"_all_{n}") for n, (kind, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, "_block", *(
        _COMBINE[kind](F.col(f"_all_{n}")).over(earlier).alias(f"_carry_{n}") for n, (kind, _) in values.items()))
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if before_only else Window.currentRow)

    def joined(name: str, kind: str) -> Column:
        here, carry = F.col(f"_here_{name}"), F.col(f"_carry_{name}")
        if kind == "last":
            return F.coalesce(here, carry)
        if kind == "max":
            return F.greatest(here, carry)
        return F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))

    rows = cut.withColumns({
        f"_here_{n}": _COMBINE[kind](F.col(f"_in_{n}")).over(within) for n, (kind, _) in values.items()
    }).join(carried, [*keys, "_block"])
    return rows.select(*df.columns, *(joined(n, kind).alias(n) for n, (kind, _) in values.items()))


_STEPS = 1_000


def percentiles(df: DataFrame, group: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(group, share, value): nearest-rank percentiles, the smallest value at least that share of
    the values are at.

    Equal values are counted first; then a group's range is cut into steps, the step that holds each
    rank is found from the steps' counts, and only the values inside that step are ordered."""
    group = list(group)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    keyed = counted.select(F.struct(F.lit(0).alias("_"), *group).alias("_g"), value, "n")
    span = keyed.groupBy("_g").agg(
        F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"), F.sum("n").alias("_total"))
    step = F.coalesce(
        F.floor(F.try_divide(F.col(value).cast("double") - F.col("_low"), F.col("_high") - F.col("_low")) * _STEPS),
        F.lit(0).cast("long"))
    placed = keyed.join(span, "_g").withColumn("_step", step)
    steps = placed.groupBy("_g", "_step", "_total").agg(F.sum("n").alias("_in"))
    before = Window.partitionBy("_g").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.greatest(F.ceil(F.col("share") * F.col("_total")), F.lit(1))
    chosen = (
        steps.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        .withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
        .withColumn("_rank", rank)
        .filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_in")))
        .select("_g", "_step", "_before", "share", "_rank")
    )
    so_far = Window.partitionBy("_g", "share").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("_g", "_step", value, "n").join(chosen, ["_g", "_step"]).withColumn(
        "_upto", F.col("_before") + F.sum("n").over(so_far))
    found = inside.filter(F.col("_upto") >= F.col("_rank")).groupBy("_g", "share").agg(F.min(value).alias(value))
    return found.select(*(F.col(f"_g.{g}").alias(g) for g in group), "share", value)
