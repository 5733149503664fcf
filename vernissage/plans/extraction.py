"""Extracted items merged into exhibitions and events, over all pages of a run at once.

The merge folds sightings in page order: each column takes its newest value that is not empty, and
the longest summary stays. That fold is associative, so one aggregation per key is exact."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.dates import local_day
from vernissage.functions.text import is_passage, title_key
from vernissage.functions.urls import url_key

_SCALARS = ("title", "start_date", "end_date", "at_venue", "detail_url", "confidence", "source_url",
            "content_hash", "model", "extract_version")
_ARRAYS = ("artists", "themes", "media")


def extract_plan(pages: DataFrame, version: int, model: str) -> DataFrame:
    """(id, venue_id, url, kind, plan, fetched_on, previous_items): unchanged, expired or
    to_extract for every ok page with a hash."""
    same = (
        F.col("extracted_hash").eqNullSafe(F.col("content_hash"))
        & F.col("extract_version").eqNullSafe(F.lit(version))
        & F.col("extract_model").eqNullSafe(F.lit(model))
    )
    plan = F.when(same, "unchanged").when(F.col("raw_text").isNull(), "expired").otherwise("to_extract")
    return pages.filter("status = 'ok' AND content_hash IS NOT NULL").select(
        "id", "venue_id", "url", "kind", plan.alias("plan"), local_day(F.col("fetched_at")).alias("fetched_on"),
        F.when(F.col("extract_status") == "ok", F.col("extracted_items")).alias("previous_items"))


def _newest(c: str, filled: Column) -> Column:
    return F.max_by(c, F.when(filled, F.col("ord"))).alias(c)


def merge_items(stored: DataFrame, extracted: DataFrame, run_ts: datetime, *,
                dated: bool = False) -> DataFrame:
    """Stored items and a run's sightings folded to one row per (venue_id, title_key), or with
    `dated` per (venue_id, title_key, start_date), a missing date being a value like any other.
    `extracted` holds venue_id, the item's columns, page_ord and item_ord."""
    keys = ["venue_id", "title_key", *(["start_date"] if dated else [])]
    extra = ("kind", "start_time", "exhibition_id") if dated else ()
    columns = [c for c in (*_SCALARS, *extra) if c not in keys]
    stamp = F.lit(run_ts).cast("timestamp_ntz")
    before = F.struct(F.lit(-1).cast("long").alias("page"), F.lit(0).cast("long").alias("item"))
    now = F.struct(F.col("page_ord").cast("long").alias("page"), F.col("item_ord").cast("long").alias("item"))
    values = [*columns, *_ARRAYS, "summary_en"]
    old = stored.select(*keys, *values, "id", "first_seen_at", "last_seen_at", before.alias("ord"))
    new = extracted.withColumn("title_key", title_key(F.col("title"))).select(
        *keys, *values, F.lit(None).cast("long").alias("id"), stamp.alias("first_seen_at"),
        stamp.alias("last_seen_at"), now.alias("ord"))
    length = F.length("summary_en")
    # Ties keep the earlier summary.
    best = F.struct(length.alias("n"), (-F.col("ord.page")).alias("p"), (-F.col("ord.item")).alias("i"))
    merged = old.unionByName(new).groupBy(*keys).agg(
        F.max("id").alias("id"),
        *(_newest(c, F.col(c).isNotNull()) for c in columns),
        *(F.coalesce(F.max_by(c, F.when(F.size(c) > 0, F.col("ord"))), F.array().cast("array<string>")).alias(c)
          for c in _ARRAYS),
        F.max_by("summary_en", F.when(length > 0, best)).alias("summary_en"),
        F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
        F.min("ord.page").alias("first_page_ord"),
    )
    number = F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys))
    return merged.withColumn("id", F.coalesce("id", number))


def link_events(events: DataFrame, exhibitions: DataFrame) -> DataFrame:
    """A run's event sightings (venue_id, exhibition_title, page_ord, ...) with `exhibition_id`: the
    show of that title at the venue, stored or written by this page or an earlier one."""
    shows = exhibitions.select(
        "venue_id", F.col("title_key").alias("_show"), F.col("id").alias("_show_id"), "first_page_ord")
    named = events.withColumn("_show", title_key(F.col("exhibition_title")))
    met = F.when(F.col("first_page_ord") <= F.col("page_ord"), F.col("_show_id"))
    return named.join(shows, ["venue_id", "_show"], "left").withColumn("exhibition_id", met).drop(
        "_show", "_show_id", "first_page_ord")


def mark_pages(pages: DataFrame, results: DataFrame, version: int, model: str,
               run_ts: datetime) -> DataFrame:
    """Pages with the extraction marks of a run. `results` holds page_id, ok, items."""
    done = results.select(F.col("page_id").alias("id"), "ok", "items")
    ran = F.col("ok").isNotNull()
    marks = {
        "extract_status": F.when(F.col("ok"), "ok").otherwise("failed"),
        "extracted_hash": F.col("content_hash"),
        "extract_version": F.lit(version),
        "extract_model": F.lit(model),
        "extracted_items": F.when(F.col("ok"), F.col("items")),
        "extracted_at": F.lit(run_ts).cast("timestamp_ntz"),
    }
    return pages.join(done, "id", "left").withColumns(
        {c: F.when(ran, v).otherwise(F.col(c)) for c, v in marks.items()}).drop("ok", "items")


def extract_flags(results: DataFrame, items: DataFrame) -> DataFrame:
    """(page_id, broken, capped_with_nothing_current) per page of a run. `results` holds page_id,
    listing, ok, capped, previous_items, fetched_on; `items` page_id, start_date, end_date."""
    last = F.coalesce("end_date", "start_date")
    seen = items.groupBy("page_id").agg(
        F.count("*").alias("n"), F.max(last).alias("latest"), F.count(last).alias("dated"))
    n = F.coalesce("n", F.lit(0))
    over = (n == F.coalesce("dated", F.lit(0))) & ((n == 0) | (F.col("latest") < F.col("fetched_on")))
    return results.join(seen, "page_id", "left").select(
        "page_id",
        (F.col("listing") & F.col("ok") & (n == 0) & (F.coalesce("previous_items", F.lit(0)) > 0)).alias("broken"),
        (F.col("ok") & F.col("capped") & over).alias("capped_with_nothing_current"),
    )


def verdict_problems(verdicts: DataFrame, summaries: DataFrame) -> DataFrame:
    """(page_id, number, reason): what keeps a judge's answer from being used. `verdicts` holds
    page_id, number, verdict, claims; `summaries` page_id, number, text."""
    numbered = verdicts.join(
        summaries.withColumnRenamed("text", "_text"), ["page_id", "number"], "left")
    foreign = (
        numbered.select("page_id", "number", "_text", F.explode("claims").alias("claim"))
        .filter(~F.coalesce(is_passage(F.col("claim"), F.col("_text")), F.lit(False)))
        .select("page_id", "number", F.lit(True).alias("_foreign")).distinct()
    )
    numbered = numbered.join(foreign, ["page_id", "number"], "left")
    none = F.size("claims") == 0
    reason = (
        F.when(F.col("_text").isNull(), "number out of range")
        .when((F.col("verdict") == "unsupported") & none, "unsupported without claims")
        .when((F.col("verdict") == "supported") & ~none, "supported with claims")
        .when(F.col("_foreign"), "claim is not a passage")
    )
    wrong = numbered.select("page_id", "number", reason.alias("reason")).filter("reason IS NOT NULL")
    twice = verdicts.groupBy("page_id", "number").agg(F.count("*").alias("n")).filter("n > 1").select(
        "page_id", "number", F.lit("judged twice").alias("reason"))
    missing = summaries.join(verdicts.select("page_id", "number"), ["page_id", "number"], "left_anti").select(
        "page_id", "number", F.lit("not judged").alias("reason"))
    return wrong.unionByName(twice).unionByName(missing).distinct()


def draft_labels(pages: DataFrame, items: DataFrame, gold: DataFrame, *, most: int | None = None,
                 most_listed: int | None = None) -> DataFrame:
    """Unconfirmed labels for pages (id, url, venue, kind, content_hash, raw_text) that hold text and
    are not labelled: page columns, confirmed, partial, and `items`. All items, unless `most` of a kind
    are asked for on any page, or `most_listed` on a listing; a page that lost some is `partial`. `items` holds page_id, kind, ord, title, artists, start_date,
    end_date, at_venue."""
    open_pages = (
        pages.filter("raw_text IS NOT NULL").withColumn("key", url_key(F.col("url")))
        .join(gold.select(url_key(F.col("url")).alias("key")), "key", "left_anti")
        .select(F.col("id").alias("page_id"), "url", "venue", F.col("kind").alias("page_kind"), "content_hash")
    )
    order = Window.partitionBy("page_id", "kind").orderBy("ord")
    first = items.join(open_pages, "page_id")
    cut = F.lit(False)
    if most is not None or most_listed is not None:
        first = first.withColumn("n", F.row_number().over(order))
        if most is not None:
            cut = cut | (F.col("n") > most)
        if most_listed is not None:
            cut = cut | ((F.col("page_kind") == "listing") & (F.col("n") > most_listed))
    kept = first.filter(~cut)
    label = F.struct(
        (F.col("kind") != "exhibition").alias("later"), "ord", "kind", "title", "artists",
        F.col("start_date").alias("start"), F.col("end_date").alias("end"), "at_venue")
    listed = kept.groupBy("page_id").agg(F.array_sort(F.collect_list(label)).alias("items"))
    more = first.filter(cut).select(
        "page_id", F.lit(True).alias("_more")).distinct()
    fields = ("kind", "title", "artists", "start", "end", "at_venue")
    return open_pages.join(listed, "page_id", "left").join(more, "page_id", "left").select(
        "page_id", "url", "venue", F.col("page_kind").alias("kind"), "content_hash",
        F.lit(False).alias("confirmed"), F.coalesce("_more", F.lit(False)).alias("partial"),
        F.transform(F.coalesce("items", F.array().cast(
            listed.schema["items"].dataType)), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("items"),
    )
