"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm.store import Store


def components(links: DataFrame, store: Store, name: str = "cc") -> DataFrame:
    """(node, component) for every end of `links` (a, b): component is the smallest node that can be
    reached. Each round takes the smallest label around a node and then the label of that label, so
    paths halve; every round is written to the shared folder. Nulls in a link are ignored."""
    both = store.put(
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select("a", "b").union(links.filter("a <> b").select("b", "a")).distinct(),
        f"{name}-edges",
    )
    labels = store.put(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    rounds = 0
    while total is not None:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        lower = lower.join(jump, "component", "left").select(
            "node", F.coalesce("further", "component").alias("component"))
        rounds += 1
        labels = store.put(lower, f"{name}-{rounds}")
        store.drop(f"{name}-{rounds - 1}")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            break
        total = now
    return labels
