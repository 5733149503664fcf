"""Items that already match, put in order of likeness to what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def rerank(matched: DataFrame, asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(request_id, position, id, likeness): the `k` likest of each request's matches (request_id,
    id); items without a vector come last. `asked` holds request_id, vector; `items` id, vector."""
    pairs = matched.join(asked.withColumnRenamed("vector", "_asked"), "request_id").join(
        items.withColumnRenamed("vector", "_item"), "id", "left")
    scored = pairs.select("request_id", "id", F.round(cosine(F.col("_asked"), F.col("_item")), 6).alias("likeness"))
    order = Window.partitionBy("request_id").orderBy(F.col("likeness").desc_nulls_last(), "id")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
