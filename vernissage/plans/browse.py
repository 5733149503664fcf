"""Read queries over the stored tables: venues, seeds, pages, items, feed events.

None of them returns a page's text or a link's text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.functions.dates import local_day
from vernissage.functions.text import contains_text, strip_space


def _take(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def venues(
    venues: DataFrame, pages: DataFrame, exhibitions: DataFrame, events: DataFrame, *,
    pilot_only: bool = True, name: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Venues by name with how many pages, exhibitions and events each has."""
    chosen = venues
    if pilot_only:
        chosen = chosen.filter("is_pilot")
    if name:
        chosen = chosen.filter(contains_text(F.col("name"), name))
    for table, label in ((pages, "pages"), (exhibitions, "exhibitions"), (events, "events")):
        counted = table.groupBy(F.col("venue_id").alias("id")).agg(F.count("*").alias(label))
        chosen = chosen.join(counted, "id", "left")
    rows = chosen.select(
        "id", "name", "city", "website_url", "instagram_url", "crawl_enabled", "is_pilot",
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("pages", "exhibitions", "events")),
    )
    return _take(rows, [F.col("name"), F.col("id")], limit)


def _named(df: DataFrame, venues: DataFrame, how: str = "inner") -> DataFrame:
    return df.join(
        venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name")), "venue_id", how)


def seeds(seeds: DataFrame, venues: DataFrame, *, venue_id: int | None = None,
          limit: int | None = None) -> DataFrame:
    chosen = seeds if venue_id is None else seeds.filter(F.col("venue_id") == venue_id)
    rows = _named(chosen, venues).select(
        "venue_id", "venue_name", "url", "page_type", "confidence", "dated_items", "language",
        "status", "model", "discovered_at")
    return _take(rows, [F.col("venue_name"), F.col("url")], limit)


def pages(pages: DataFrame, venues: DataFrame, *, venue_id: int | None = None,
          limit: int | None = None) -> DataFrame:
    """Every crawled page by its metadata, listings first within each venue."""
    chosen = pages if venue_id is None else pages.filter(F.col("venue_id") == venue_id)
    counted = F.size(F.split(strip_space(F.col("raw_text")), r"(?U)\s+")).cast("long")
    rows = _named(chosen, venues).select(
        "id", "venue_id", "venue_name", "url", "kind", "status", "http_status", "content_hash",
        "fetched_at",
        F.col("raw_text").isNotNull().alias("text_held"),
        F.when(F.col("raw_text").isNotNull(), counted).alias("words"),
        F.when(F.col("links").isNotNull(), F.size("links").cast("long")).alias("link_count"),
        "extract_status", "extract_version", "extract_model", "extracted_items", "extracted_at",
        F.coalesce(F.col("extracted_hash") == F.col("content_hash"), F.lit(False)).alias("text_extracted"),
    )
    return _take(rows, [F.col("venue_name"), F.col("kind") != "listing", F.col("url")], limit)


_ITEM = (
    "id", "venue_id", "venue_name", "title", "artists", "start_date", "end_date", "at_venue",
    "detail_url", "summary_en", "themes", "media", "confidence", "source_url", "content_hash",
    "model", "extract_version", "first_seen_at", "last_seen_at",
)


def _items(df: DataFrame, venue_id: int | None, source_url: str | None, title: str | None) -> DataFrame:
    if venue_id is not None:
        df = df.filter(F.col("venue_id") == venue_id)
    if source_url is not None:
        df = df.filter(F.col("source_url") == source_url)
    if title:
        df = df.filter(contains_text(F.col("title"), title))
    return df


def exhibitions(
    exhibitions: DataFrame, venues: DataFrame, *, venue_id: int | None = None,
    source_url: str | None = None, title: str | None = None, not_over_on: date | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Stored exhibitions, earliest start first within each venue; one with no end is not over."""
    chosen = _items(exhibitions, venue_id, source_url, title)
    if not_over_on is not None:
        chosen = chosen.filter(F.col("end_date").isNull() | (F.col("end_date") >= F.lit(not_over_on)))
    rows = _named(chosen, venues).select(*_ITEM)
    return _take(rows, [F.col("venue_name"), F.col("start_date").asc_nulls_last(), F.col("id")], limit)


def art_events(
    events: DataFrame, venues: DataFrame, *, venue_id: int | None = None,
    source_url: str | None = None, title: str | None = None, kind: str | None = None,
    not_over_on: date | None = None, limit: int | None = None,
) -> DataFrame:
    """Stored events; one with no end is over after its start day, one with no date is kept."""
    chosen = _items(events, venue_id, source_url, title)
    if kind is not None:
        chosen = chosen.filter(F.col("kind") == kind)
    if not_over_on is not None:
        day = F.lit(not_over_on)
        chosen = chosen.filter(F.coalesce("end_date", "start_date", day) >= day)
    rows = _named(chosen, venues).select(*_ITEM, "kind", "start_time", "exhibition_id")
    return _take(
        rows,
        [F.col("venue_name"), F.col("start_date").asc_nulls_last(),
         F.col("start_time").asc_nulls_last(), F.col("id")],
        limit,
    )


def feed_events(
    snapshots: DataFrame, occurrences: DataFrame, venues: DataFrame, *,
    venue_id: int | None = None, not_over_on: date | None = None, limit: int | None = None,
) -> DataFrame:
    """The feed's events, one row per occurrence ever stored, earliest start first."""
    kept = occurrences.select(
        F.col("id").alias("occurrence_id"), "event_id", "starts_at", "ends_at")
    if not_over_on is not None:
        kept = kept.filter(local_day(F.coalesce("ends_at", "starts_at")) >= F.lit(not_over_on))
    chosen = snapshots if venue_id is None else snapshots.filter(F.col("venue_id") == venue_id)
    chosen = chosen.withColumnRenamed("id", "event_id")
    rows = _named(chosen.join(kept, "event_id"), venues, "left").select(
        "event_id", "source_event_id", "venue_id", "venue_name", "title", "title_en", "starts_at",
        "ends_at", "is_free", "price_min", "price_max", "is_online", "source_url", "web_url_ca",
        "web_url_es", "web_url_en", "last_seen_at", "occurrence_id")
    order = [F.col("starts_at"), F.col("event_id"), F.col("occurrence_id")]
    return _take(rows, order, limit).drop("occurrence_id")
