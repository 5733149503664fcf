"""A feed fetch applied to the stored tables: plan, merge, diff, report.

Every merge is one full outer join on a unique key. `run_ts` stamps all rows one run touches; it is
given, never read from a clock, so a replayed run writes the same table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.functions.urls import classify
from vernissage.operators.keyed import any_distinct, last_per_key, side_by_side
from vernissage.operators.matching import match_names, match_profiles, match_rounds

VENUE_VALUES = (
    "name", "slug", "address", "city", "province", "postcode", "lat", "lon", "source_profile_id",
    "website_url", "instagram_url", "crawl_enabled", "is_pilot",
)
EVENT_VALUES = (
    "venue_id", "title", "title_en", "source_category_id", "is_free", "price_min", "price_max",
    "is_online", "source_url", "web_url_ca", "web_url_es", "web_url_en", "source_modified_at",
)


class RefusedMerge(ValueError):
    """The incoming table cannot be right, so nothing is published."""


def _stamp(run_ts: datetime) -> Column:
    return F.lit(run_ts).cast("timestamp_ntz")


def require_rows(df: DataFrame, at_least: int = 1) -> None:
    """An empty or short fetch is a failed fetch. Reads no more than `at_least` rows."""
    found = df.limit(at_least).count()
    if found < at_least:
        raise RefusedMerge(f"{found} rows, expected at least {at_least}")


def plan_venues(terms: DataFrame, profiles: DataFrame, pilots: DataFrame) -> DataFrame:
    """The wanted state of each venue: one row per term (id, ..., ord), the later duplicate winning,
    with its profile's URLs. `pilots` names the pilot venues."""
    distinct = last_per_key(terms, ["id"], ["ord"])
    owners = last_per_key(profiles, ["id"], ["ord"])
    matches, _ = match_profiles(distinct, profiles)
    urls = owners.select(F.col("id").alias("source_profile_id"), classify(F.col("url")).alias("u"))
    flagged = (
        match_names(distinct, pilots).filter("term_id IS NOT NULL")
        .select(F.col("term_id").alias("source_venue_id"), F.lit(True).alias("is_pilot")).distinct()
    )
    joined = matches.select(
        F.col("term_id").alias("source_venue_id"), F.col("profile_id").alias("source_profile_id"))
    return (
        distinct.withColumnRenamed("id", "source_venue_id")
        .join(joined, "source_venue_id", "left")
        .join(urls, "source_profile_id", "left")
        .join(flagged, "source_venue_id", "left")
        .select(
            "source_venue_id", "name", "slug", "address", "city", "province", "postcode", "lat",
            "lon", "source_profile_id", "u.website_url", "u.instagram_url",
            F.coalesce("u.crawl_enabled", F.lit(False)).alias("crawl_enabled"),
            F.coalesce("is_pilot", F.lit(False)).alias("is_pilot"),
        )
    )


def merge_venues(current: DataFrame, planned: DataFrame, run_ts: datetime, at_least: int = 1) -> DataFrame:
    """`current` (id, source_venue_id, values, updated_at) after the plan, with `change`: inserted,
    changed, unjoined, kept. A row moves its `updated_at` only when a value differs; a venue the
    fetch no longer returns keeps its facts and loses its join and flags. A plan of fewer than
    `at_least` rows is a failed fetch and refused, since it would unjoin every venue."""
    require_rows(planned, at_least)
    both = side_by_side(current, planned, ["source_venue_id"])
    known, fetched = F.col("cur").isNotNull(), F.col("new").isNotNull()
    held = F.col("cur.crawl_enabled") | F.col("cur.is_pilot")
    for c in ("source_profile_id", "website_url", "instagram_url"):
        held = held | F.col(f"cur.{c}").isNotNull()
    change = (
        F.when(~known, "inserted")
        .when(fetched & any_distinct(VENUE_VALUES), "changed")
        .when(~fetched & held, "unjoined")
        .otherwise("kept")
    )
    reset = {"source_profile_id": F.lit(None), "website_url": F.lit(None),
             "instagram_url": F.lit(None), "crawl_enabled": F.lit(False), "is_pilot": F.lit(False)}
    value = lambda c: F.when(fetched, F.col(f"new.{c}")).otherwise(
        reset.get(c, F.col(f"cur.{c}")))
    return both.withColumn("change", change).select(
        F.coalesce("cur.id", F.xxhash64(F.lit("venue"), "source_venue_id")).alias("id"),
        "source_venue_id",
        *(value(c).alias(c) for c in VENUE_VALUES),
        F.when(F.col("change") == "kept", F.col("cur.updated_at")).otherwise(_stamp(run_ts)).alias("updated_at"),
        "change",
    )


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("change").agg(F.count("*").alias("rows"))


def event_rows(events: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, unknown): one row per post (source_event_id, source_venue_id, ..., ord), the later
    one winning, with the venue's id; and the posts that name a term no venue has."""
    places = venues.select("source_venue_id", F.col("id").alias("venue_id"))
    # Only the winning row names the venue; any row of a post can name an unknown one.
    rows = last_per_key(events, ["source_event_id"], ["ord"]).join(places, "source_venue_id", "left")
    unknown = (
        events.filter("source_venue_id IS NOT NULL")
        .select("source_event_id", "source_venue_id").distinct()
        .join(places, "source_venue_id", "left_anti")
        .select("source_event_id").distinct()
    )
    return rows.select("source_event_id", *EVENT_VALUES), unknown


def merge_events(current: DataFrame, fetched: DataFrame, run_ts: datetime) -> DataFrame:
    """`current` (id, source_event_id, values, first_seen_at, last_seen_at) after one run: posts in
    `fetched` take its values and move `last_seen_at`; the others are not touched."""
    both = side_by_side(current, fetched, ["source_event_id"])
    seen = F.col("new").isNotNull()
    return both.select(
        F.coalesce("cur.id", F.xxhash64(F.lit("event"), "source_event_id")).alias("id"),
        "source_event_id",
        *(F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"cur.{c}")).alias(c) for c in EVENT_VALUES),
        F.coalesce("cur.first_seen_at", _stamp(run_ts)).alias("first_seen_at"),
        F.when(seen, _stamp(run_ts)).otherwise(F.col("cur.last_seen_at")).alias("last_seen_at"),
    )


def merge_sightings(current: DataFrame, seen: DataFrame) -> DataFrame:
    """As `merge_events`, for rows that bring their own first_seen_at and last_seen_at: the side seen
    last gives the values, so rows may come in any order and more than once."""
    both = side_by_side(current, seen, ["source_event_id"])
    newer = F.col("cur").isNull() | (F.col("new.last_seen_at") >= F.col("cur.last_seen_at"))
    return both.select(
        F.coalesce("cur.id", F.xxhash64(F.lit("event"), "source_event_id")).alias("id"), "source_event_id",
        *(F.when(newer, F.col(f"new.{c}")).otherwise(F.col(f"cur.{c}")).alias(c) for c in EVENT_VALUES),
        F.least("cur.first_seen_at", "new.first_seen_at").alias("first_seen_at"),
        F.greatest("cur.last_seen_at", "new.last_seen_at").alias("last_seen_at"),
    )


def merge_occurrences(
    current: DataFrame, fetched: DataFrame, events: DataFrame, run_ts: datetime
) -> DataFrame:
    """By occurrence id, re-parented and re-dated by the run that sees it. `fetched` holds
    source_occurrence_id, source_event_id, starts_at, ends_at, ord; null occurrences are skipped."""
    latest = last_per_key(
        fetched.filter("source_occurrence_id IS NOT NULL AND starts_at IS NOT NULL"),
        ["source_occurrence_id"], ["ord"])
    owned = latest.join(events.select("source_event_id", F.col("id").alias("event_id")), "source_event_id")
    both = side_by_side(
        current, owned.select("source_occurrence_id", "event_id", "starts_at", "ends_at"),
        ["source_occurrence_id"])
    seen = F.col("new").isNotNull()
    return both.select(
        F.coalesce("cur.id", F.xxhash64(F.lit("occurrence"), "source_occurrence_id")).alias("id"),
        *(F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"cur.{c}")).alias(c)
          for c in ("event_id", "starts_at", "ends_at")),
        "source_occurrence_id",
        F.when(seen, _stamp(run_ts)).otherwise(F.col("cur.last_seen_at")).alias("last_seen_at"),
    )


def overlay_occurrences(listed: DataFrame, detailed: DataFrame) -> DataFrame:
    """Feed rows (source_event_id, source_occurrence_id, starts_at, ends_at, ..., ord) with every
    occurrence the per-event answers (source_event_id, source_occurrence_id, starts_at, ends_at)
    know: the per-event dates win, everything else comes from the event's last list row."""
    dates = ("starts_at", "ends_at")
    others = [c for c in listed.columns if c not in ("source_event_id", "source_occurrence_id", *dates)]
    posts = last_per_key(listed, ["source_event_id"], ["ord"]).select("source_event_id", *others)
    # A list row stands only where its event's own answer does not have that occurrence.
    own = detailed.dropDuplicates(["source_event_id", "source_occurrence_id"])
    kept = last_per_key(listed, ["source_event_id", "source_occurrence_id"], ["ord"]).join(
        own.select("source_event_id", "source_occurrence_id"),
        ["source_event_id", "source_occurrence_id"], "left_anti")
    columns = ["source_event_id", "source_occurrence_id", *dates, *others]
    return kept.select(*columns).unionByName(own.join(posts, "source_event_id").select(*columns))


def join_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_venue_id, change, was, now) of terms that gained, lost or moved their profile."""
    keep = lambda df: df.filter("source_profile_id IS NOT NULL").select(
        "source_venue_id", "source_profile_id")
    both = side_by_side(keep(before), keep(after), ["source_venue_id"])
    was, now = F.col("cur.source_profile_id"), F.col("new.source_profile_id")
    change = F.when(was.isNull(), "gained").when(now.isNull(), "lost").when(was != now, "moved")
    return both.select("source_venue_id", change.alias("change"), was.alias("was"), now.alias("now")).filter(
        "change IS NOT NULL")


def sync_summary(planned: DataFrame, terms: DataFrame, profiles: DataFrame) -> DataFrame:
    """(metric, value): what a sync reports about its plan, as one long table."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    joined = F.col("source_profile_id").isNotNull()
    site, social = F.col("website_url").isNotNull(), F.col("instagram_url").isNotNull()
    pilot = F.col("is_pilot")
    figures = {
        "venues": F.count("*"),
        "with_point": count(F.col("lat").isNotNull()),
        "without_point": count(F.col("lat").isNull()),
        "joined": count(joined),
        "website": count(joined & site),
        "instagram": count(joined & social),
        "blank_url": count(joined & ~site & ~social),
        "pilots": count(pilot),
        "pilots_crawlable": count(pilot & F.col("crawl_enabled")),
        "pilots_no_profile": count(pilot & ~joined),
        "pilots_instagram_only": count(pilot & joined & social),
        "pilots_blank_url": count(pilot & joined & ~site & ~social),
    }
    wide = planned.agg(*(c.alias(n) for n, c in figures.items()))
    plan = wide.select(F.explode(F.array(*(
        F.struct(F.lit(n).alias("metric"), F.coalesce(n, F.lit(0).cast("long")).alias("value")) for n in figures
    ))).alias("m")).select("m.*")
    distinct = last_per_key(terms, ["id"], ["ord"])
    matches, ambiguous = match_profiles(distinct, profiles)
    rounds = match_rounds(matches).select(
        F.concat(F.lit("round_"), "round").alias("metric"), F.col("matches").alias("value"))
    unsettled = ambiguous.agg(F.count("*").alias("value")).select(F.lit("ambiguous").alias("metric"), "value")
    return plan.unionByName(rounds).unionByName(unsettled)
