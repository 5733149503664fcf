"""Model calls: what they cost and what they add up to."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.dates import local_day
from vernissage.operators.ordered import running

_CLASSES = ("input", "output", "cache_write_5m", "cache_write_1h", "cache_read")
_PRICE = "decimal(14,6)"
SUMMED = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(model, *prices) for model, prices in vocab.PRICES.items()]
    text = spark.createDataFrame(rows, "model string, " + ", ".join(f"{c} string" for c in _CLASSES))
    return text.select("model", *(F.col(c).cast(_PRICE).alias(c) for c in _CLASSES))


def call_cost(calls: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(priced, refused). Calls hold id, model and tokens per class (input_tokens, ...,
    cache_read_tokens); cost_usd is to a millionth, halves to even. A model with no price, or
    tokens of a class with none, is refused."""
    tokens = {c: F.coalesce(F.col(f"{c}_tokens"), F.lit(0)).cast("decimal(20,0)") for c in _CLASSES}
    listed = prices.select(
        "model", *(F.col(c).cast(_PRICE).alias(f"_{c}") for c in _CLASSES), F.lit(True).alias("_known"))
    joined = calls.join(listed, "model", "left")
    unpriced = F.lit(False)
    total: Column = F.lit(0).cast("decimal(38,6)")
    for c, n in tokens.items():
        unpriced = unpriced | ((n > 0) & F.col(f"_{c}").isNull())
        total = total + F.coalesce(n * F.col(f"_{c}"), F.lit(0).cast("decimal(38,6)"))
    reason = F.when(F.col("_known").isNull(), "unknown model").when(unpriced, "tokens without a price")
    cost = F.bround((total / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(38,12)"), 6)
    judged = joined.withColumn("reason", reason)
    return (
        judged.filter("reason IS NULL").select(*calls.columns, cost.cast("decimal(18,6)").alias("cost_usd")),
        judged.filter("reason IS NOT NULL").select("id", "model", "reason"),
    )


def call_costs(calls: DataFrame, *, since: date | None = None, purpose: str | None = None) -> DataFrame:
    """Calls by purpose and model, costliest first. `since` is a day at the venues."""
    if since is not None:
        calls = calls.filter(local_day(F.col("created_at")) >= F.lit(since))
    if purpose is not None:
        calls = calls.filter(F.col("purpose") == purpose)
    return (
        calls.groupBy("purpose", "model")
        .agg(
            F.count("*").alias("calls"), F.count("error_type").alias("errors"),
            *(F.sum(c).alias(c) for c in SUMMED), F.sum("cost_usd").alias("cost_usd"),
            F.min("created_at").alias("first_call"), F.max("created_at").alias("last_call"),
        )
        .orderBy(F.col("cost_usd").desc(), "purpose", "model")
    )


def trace_spend(calls: DataFrame, traces: DataFrame, *, purpose: str | None = None) -> DataFrame:
    """(trace_id, calls, cost_usd, token sums) for every trace asked about, zeros where it has none."""
    if purpose is not None:
        calls = calls.filter(F.col("purpose") == purpose)
    spent = calls.groupBy("trace_id").agg(
        F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"), *(F.sum(c).alias(c) for c in SUMMED))
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("calls", "cost_usd", *SUMMED)}
    return traces.select("trace_id").distinct().join(spent, "trace_id", "left").withColumns(filled)


def cache_share(calls: DataFrame) -> DataFrame:
    """(calls, read, sent) over the calls that could read the cache: those after a call of the same
    run whose prompt passed the cacheable minimum. Calls hold run_id, ord and the token counts."""
    prompt = F.col("input_tokens") + F.col("cache_read_input_tokens") + F.col("cache_creation_input_tokens")
    long_enough = F.when(prompt >= vocab.CACHE_MIN_TOKENS, 1).otherwise(0)
    seen = running(
        calls.withColumn("prompt", prompt), ["run_id"], "ord", {"warm": ("max", long_enough)}, before_only=True)
    return seen.filter("warm = 1").agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("cache_read_input_tokens"), F.lit(0)).cast("long").alias("read"),
        F.coalesce(F.sum("prompt"), F.lit(0)).cast("long").alias("sent"),
    )
