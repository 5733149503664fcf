"""The same work, run continuously.

Roll-ups use watermarks and windows; a window is written once, when the watermark has passed its end.
Table merges run per micro-batch into versions numbered by the batch, each computed from the one before,
so a batch that is retried after a failure writes the same version again; a version writes the hash
buckets that its batch touches and names the files of the others. Sessions keep a bounded state: the blocks of one user's day."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.dates import instant_to_utc, local_day, utc_to_instant
from vernissage.operators.keyed import last_per_key
from vernissage.plans import crawl, interactions, sync
from vernissage.plans.costs import SUMMED
from vernissage.sources.buckets import BucketedTable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATE = "2 hours"
BUCKETS = 64


# --- cost roll-ups -------------------------------------------------------------------------------


def cost_rollup(calls: DataFrame, every: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Calls by window, purpose and model: tumbling, or sliding by `slide`. Calls up to two hours late
    are counted; in append mode a window comes out once it can get no more of them, its state is
    dropped, and a call later than that is left out."""
    return (
        calls.withColumn("_at", utc_to_instant(F.col("created_at"))).withWatermark("_at", LATE)
        .groupBy(F.window("_at", every, slide or every), "purpose", "model")
        .agg(F.count("*").alias("calls"), F.count("error_type").alias("errors"),
             *(F.sum(c).alias(c) for c in SUMMED), F.sum("cost_usd").alias("cost_usd"))
        .select(instant_to_utc(F.col("window.start")).alias("window_start"),
                instant_to_utc(F.col("window.end")).alias("window_end"),
                "purpose", "model", "calls", "errors", *SUMMED, "cost_usd")
    )


# --- conversations -------------------------------------------------------------------------------

_SESSIONS = "user_id long, day date, session long, started_at timestamp_ntz, last_turn_at timestamp_ntz, turns long"
_IDLE_US = vocab.IDLE_HOURS * 3_600_000_000
_BLOCKS = -(-25 // vocab.IDLE_HOURS) + 1  # blocks that the longest local day can touch
_DAY_LATE = "26 hours"  # a day and its lateness


def _join_blocks(done: Column, block: Column) -> Column:
    """The sessions so far with one more block: it goes on with the last, or opens another."""
    last = F.element_at(done, -1)
    goes_on = (F.size(done) > 0) & (block["first"] - F.try_element_at(done, F.lit(-1))["last"] <= _IDLE_US)
    grown = F.struct(last["first"].alias("first"), block["last"].alias("last"), (last["n"] + block["n"]).alias("n"))
    return F.when(goes_on, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(
        F.concat(done, F.array(block)))


def stream_sessions(messages: DataFrame) -> DataFrame:
    """Conversations (as `sessionize`) of each user's local day, once that day is over: when a message of
    the day after the next has come. Until then a late message counts.

    No two messages of a block as long as the idle time are further apart than that, so a day is kept as
    the first, last and count of its few blocks, summed before the shuffle."""
    day = local_day(F.col("ts"))
    ends = F.convert_timezone(F.lit(vocab.SITE_TIMEZONE), F.lit("UTC"), F.date_add(day, 1).cast("timestamp_ntz"))
    rows = messages.select(
        "user_id", day.alias("day"), utc_to_instant(ends).alias("_ends"), F.unix_micros(utc_to_instant(F.col("ts"))).alias("us"))
    own = [F.pmod(F.floor(F.col("us") / _IDLE_US), F.lit(_BLOCKS)) == b for b in range(_BLOCKS)]
    kept = rows.withWatermark("_ends", _DAY_LATE).groupBy("user_id", "day", "_ends").agg(*(
        how(F.when(mine, F.col("us"))).alias(f"_{name}{b}")
        for b, mine in enumerate(own) for name, how in (("first", F.min), ("last", F.max), ("n", F.count))))
    blocks = F.array(*(
        F.when(F.col(f"_n{b}") > 0, F.struct(*(F.col(f"_{c}{b}").alias(c) for c in ("first", "last", "n")))) for b in range(_BLOCKS)))
    none = F.array().cast("array<struct<first:bigint,last:bigint,n:bigint>>")
    cut = F.aggregate(F.array_sort(F.array_compact(blocks)), none, _join_blocks)
    at = lambda us: instant_to_utc(F.timestamp_micros(us))
    return kept.select("user_id", "day", F.posexplode(cut).alias("session", "s")).select(
        "user_id", "day", F.col("session").cast("long").alias("session"), at(F.col("s.first")).alias("started_at"),
        at(F.col("s.last")).alias("last_turn_at"), F.col("s.n").alias("turns"))


# --- versioned tables ----------------------------------------------------------------------------


def table_at(spark: SparkSession, path: str, batch: int, schema, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """The table as batch `batch` found it: empty for the first."""
    return BucketedTable(spark, path, schema, keys, buckets).at(batch)


def merging(
    path: str, schema, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], dict[str, DataFrame]],
    *, buckets: int = BUCKETS, keep: int = 2,
):
    """A `foreachBatch` function: `merge(table, batch)` gives the new `table` and any side tables,
    written under the batch's number. The table lies in hash buckets of `keys`, and `merge` is given
    the buckets that the batch's keys fall in; a row may depend on rows of its own key alone."""

    def apply(batch: DataFrame, number: int) -> None:
        table = BucketedTable(batch.sparkSession, path, schema, keys, buckets)
        if number + 1 in table.versions():
            return  # this batch was merged before it was run again
        batch = batch.persist()
        touched = table.touched(batch)
        results = merge(table.at(number, touched), batch)
        for name, df in results.items():
            if name != "table":
                df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        table.rewrite(number, touched, results["table"])
        table.vacuum(keep)
        batch.unpersist()

    return apply


def page_merge(table: DataFrame, batch: DataFrame, homes: DataFrame, keys: Sequence[str] = ("url",)) -> dict[str, DataFrame]:
    """Crawled pages (with fetched_at) into the page table; what changed goes to `changes`. Each page
    keeps the time of its own newest fetch that got an answer, and an older fetch that comes late
    changes nothing: the table does not depend on how fetches are cut into batches. A page is its URL, or
    its `keys` where two pages may have one address."""
    held = table.select(*keys, F.col("fetched_at").alias("_held"))
    newest = last_per_key(batch.filter("status <> 'unavailable'"), list(keys), ["fetched_at"]).join(held, list(keys), "left")
    fresh = newest.filter("_held IS NULL OR fetched_at > _held").drop("_held")
    pages = crawl.page_changes(table, fresh, homes, keys)
    merged = crawl.merge_pages(table, pages, None, keys)
    return {"table": merged, "changes": pages.select("url", "venue_id", "status", "change", "broken")}


def fetched_pages(pages: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """A stream of fetches without repeats of one fetch of a page."""
    timed = pages.withColumn("_at", utc_to_instant(F.col("fetched_at"))).withWatermark("_at", LATE)
    return timed.dropDuplicatesWithinWatermark([*keys, "_at"]).drop("_at")


def event_merge(table: DataFrame, batch: DataFrame, venues: DataFrame) -> dict[str, DataFrame]:
    """Feed rows (with fetched_at) into the event table: first and last seen. Each post is stamped with
    its own fetches, and values come from its newest one, whatever batch that was in."""
    rows, _ = sync.event_rows(batch.withColumn("ord", F.struct("fetched_at", "ord")), venues)
    seen = batch.groupBy("source_event_id").agg(F.min("fetched_at").alias("first_seen_at"), F.max("fetched_at").alias("last_seen_at"))
    return {"table": sync.merge_sightings(table, rows.join(seen, "source_event_id"))}


def remember_merge(table: DataFrame, batch: DataFrame) -> dict[str, DataFrame]:
    """Remember events into the profile table; refused ones go to `refused`."""
    facts, refused = interactions.remember_more(table, batch)
    return {"table": facts, "refused": refused}


def append_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything available now appended to the table at `path`, each row exactly once."""
    (stream.writeStream.format("parquet").outputMode("append").option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_to_end(stream: DataFrame, apply, checkpoint: str, mode: str = "append") -> int:
    """Everything available now through `apply`; returns how many batches have run so far."""
    query = (
        stream.writeStream.foreachBatch(apply).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    progress = query.lastProgress
    return -1 if progress is None else progress["batchId"] + 1
