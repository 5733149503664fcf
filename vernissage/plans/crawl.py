"""Pages: what a fetch means, what changed, what to fetch next, what to forget."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.text import strip_space
from vernissage.functions.urls import site_key, url_key
from vernissage.operators.keyed import first_per_key, last_per_key, side_by_side

CRAWLED = ("venue_id", "kind", "status", "http_status", "content_hash", "raw_text", "links")
MARKS = ("extract_status", "extracted_hash", "extract_version", "extract_model", "extracted_items",
         "extracted_at")


def word_count(text: Column) -> Column:
    bare = strip_space(F.coalesce(text, F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+")))


def page_status(robots: Column, answered: Column, http_status: Column, challenged: Column,
                is_html: Column, text: Column) -> Column:
    """What a fetch leaves: unavailable, robots, blocked, error, thin or ok. `robots` is true, false
    or null (no answer from robots.txt); `answered` is false when the page gave none."""
    return (
        F.when(robots.isNull(), "unavailable")
        .when(~robots, "robots")
        .when(~answered, "unavailable")
        .when(http_status.isin(*vocab.BLOCKED_STATUSES) | challenged, "blocked")
        .when(~http_status.between(200, 299) | ~is_html, "error")
        .when(word_count(text) < vocab.THIN_WORDS, "thin")
        .otherwise("ok")
    )


def fetched(crawled: DataFrame) -> DataFrame:
    """Crawled pages with content_hash; it and the text are kept on ok pages only."""
    ok = F.col("status") == "ok"
    return crawled.withColumn("content_hash", F.when(ok, F.sha2(F.col("raw_text"), 256))).withColumn(
        "raw_text", F.when(ok, F.col("raw_text")))


def page_changes(stored: DataFrame, crawled: DataFrame, homes: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Crawled pages (url, venue_id, kind, status, http_status, raw_text, final_url) with words,
    content_hash, change (new, changed, unchanged; ok pages only) and broken (gone, homepage;
    listings only). `homes` gives each venue's website_url."""
    ok = F.col("status") == "ok"
    held = stored.select(*keys, F.col("content_hash").alias("_stored"))
    sites = homes.select(F.col("id").alias("venue_id"), url_key(F.col("website_url")).alias("_home"))
    change = F.when(ok, F.when(F.col("_stored").isNull(), "new")
                    .when(F.col("_stored") == F.col("content_hash"), "unchanged").otherwise("changed"))
    gone = (F.col("status") == "error") & F.col("http_status").isin(*vocab.GONE_STATUSES)
    home = (url_key(F.col("final_url")) == F.col("_home")) & (F.col("_home") != url_key(F.col("url")))
    broken = F.when(F.col("kind") == "listing", F.when(gone, "gone").when(home, "homepage"))
    return (
        fetched(crawled.withColumn("words", word_count(F.col("raw_text")).cast("long")))
        .join(held, list(keys), "left").join(sites, "venue_id", "left")
        .withColumn("change", change).withColumn("broken", broken)
        .drop("_stored", "_home")
    )


def merge_pages(stored: DataFrame, crawled: DataFrame, run_ts: datetime | None, keys: Sequence[str] = ("url",)) -> DataFrame:
    """By URL, or by `keys` where pages are told apart by another column. A page that gave no answer is left as it was; any other takes the fetch's status,
    hash, text and links (none unless ok) and keeps its extraction marks. It is stamped `run_ts`, or
    without one its own fetched_at."""
    ok = F.col("status") == "ok"
    named = ["url", *(k for k in keys if k != "url")]
    answered = crawled.filter("status <> 'unavailable'").select(
        *named, "venue_id", "kind", "status", "http_status", (F.col("fetched_at") if run_ts is None else F.lit(run_ts).cast("timestamp_ntz")).alias("_at"),
        *(F.when(ok, F.col(c)).alias(c) for c in ("content_hash", "raw_text")),
        F.when(ok & (F.size("links") > 0), F.col("links")).alias("links"))
    both = side_by_side(stored, answered, list(keys))
    seen = F.col("new").isNotNull()
    url = F.coalesce("new.url", "cur.url")
    own = F.col("id") if "id" in keys else F.coalesce("cur.id", F.xxhash64(F.lit("page"), url))
    return both.select(
        own.alias("id"), url.alias("url"),
        *(F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"cur.{c}")).alias(c) for c in CRAWLED),
        F.when(seen, F.col("new._at")).otherwise(F.col("cur.fetched_at")).alias("fetched_at"),
        *(F.col(f"cur.{c}").alias(c) for c in MARKS),
    )


def purge(pages: DataFrame, as_of: datetime, days: int = vocab.PAGE_TTL_DAYS) -> DataFrame:
    """Text and links forgotten on pages fetched more than `days` ago; row and hash stay. The
    `purged` column marks the rows this run emptied."""
    old = F.col("fetched_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    due = F.col("raw_text").isNotNull() & old
    return pages.withColumn("purged", due).withColumns({
        "raw_text": F.when(~F.col("purged"), F.col("raw_text")),
        "links": F.when(~F.col("purged"), F.col("links")),
    })


def dedupe_urls(df: DataFrame, group: str, stored: DataFrame) -> DataFrame:
    """(group, url, ord): one row per page of a group, in its first place, under the spelling that
    is already stored when there is one, else the first."""
    spelled = first_per_key(
        stored.select(group, url_key(F.col("url")).alias("key"), F.col("url").alias("known")),
        [group, "key"], ["known"])
    firsts = first_per_key(
        df.select(group, url_key(F.col("url")).alias("key"), "url", "ord"), [group, "key"], ["ord"])
    return firsts.join(spelled, [group, "key"], "left").select(
        group, F.coalesce("known", "url").alias("url"), "ord", "key")


# --- sites and targets ---------------------------------------------------------------------------


def sites(venues: DataFrame) -> DataFrame:
    """(venue_id, name, url): one per website among pilot venues that may be crawled, the lowest
    id standing for those that share it."""
    usable = venues.filter("is_pilot AND crawl_enabled AND website_url IS NOT NULL")
    return usable.groupBy(F.col("website_url").alias("url")).agg(
        F.min_by(F.struct(F.col("id").alias("venue_id"), "name"), "id").alias("v")
    ).select("v.venue_id", "v.name", "url")


def _distinct_values(df: DataFrame, kind: str, value: str, key: str, most: int | None) -> DataFrame:
    """The distinct values of each site in event order; the first `most` where a number is given."""
    firsts = df.filter(F.col(key).isNotNull()).groupBy("url", key).agg(
        F.min_by(F.struct("ord", F.col(value).alias("value")), "ord").alias("f"))
    order = Window.partitionBy("url").orderBy("f.ord", "f.value")
    return (
        firsts.withColumn("position", F.row_number().over(order))
        .filter(F.lit(True) if most is None else F.col("position") <= most)
        .select("url", F.lit(kind).alias("kind"), "position", F.col("f.value").alias("value"))
    )


def site_hints(sites: DataFrame, venues: DataFrame, snapshots: DataFrame, occurrences: DataFrame,
               as_of: datetime, *, most: int | None = None, title_chars: int | None = None) -> DataFrame:
    """(url, kind, position, value): titles and on-site links of the site's current events, over
    every crawlable venue that shares its website; the first `most` of each, and titles cut to
    `title_chars` once they are told apart, where those are given."""
    now = F.lit(as_of).cast("timestamp_ntz")
    current = occurrences.filter(F.coalesce("ends_at", "starts_at") >= now).select(
        F.col("event_id").alias("id"))
    siblings = venues.filter("crawl_enabled AND website_url IS NOT NULL").select(
        F.col("id").alias("venue_id"), F.col("website_url").alias("url")
    ).join(sites.select("url"), "url", "left_semi")
    events = snapshots.join(current, "id", "left_semi").join(siblings, "venue_id")
    spaced = F.trim(F.regexp_replace(F.col("title"), r"(?U)\s+", " "))
    title = F.when(spaced != "", spaced)
    titles = events.select("url", F.struct("id", F.lit(0).alias("n")).alias("ord"), title.alias("value"))
    links = (
        events.select("url", "id", F.posexplode(F.array(
            "web_url_ca", "web_url_es", "web_url_en")).alias("n", "value"))
        .filter(F.col("value").rlike("^https?://") & (site_key(F.col("value")) == site_key(F.col("url"))))
        .select("url", F.struct("id", "n").alias("ord"), "value", url_key(F.col("value")).alias("key"))
    )
    shown = _distinct_values(titles.withColumn("key", F.col("value")), "title", "value", "key", most)
    if title_chars is not None:
        shown = shown.withColumn("value", F.substring("value", 1, title_chars))
    return shown.unionByName(_distinct_values(links, "url", "value", "key", most))


def seeds_in_use(sites: DataFrame, seeds: DataFrame, overrides: DataFrame) -> DataFrame:
    """(venue_id, url, ord): accepted seeds of each site, less those a person rejected.
    `overrides` holds venue_id, url, action (pin or reject), ord."""
    accepted = seeds.filter("status = 'accepted'").join(sites.select("venue_id"), "venue_id", "left_semi")
    rejected = overrides.filter("action = 'reject'").select("venue_id", url_key(F.col("url")).alias("key"))
    return (
        accepted.select("venue_id", "url", F.col("id").alias("ord"), url_key(F.col("url")).alias("key"))
        .join(rejected, ["venue_id", "key"], "left_anti").select("venue_id", "url", "ord")
    )


def crawl_targets(sites: DataFrame, in_use: DataFrame, overrides: DataFrame, pages: DataFrame,
                  exhibitions: DataFrame, today: date, *, most: int | None = None) -> DataFrame:
    """(venue_id, position, kind, url): what to fetch for each site, the first `most` where a number
    is given. Pins
    replace seeds; then the own pages of shows at the venue that are not over, soonest first,
    unless they were ever fetched."""
    stored = pages.join(sites.select("venue_id"), "venue_id", "left_semi").select("venue_id", "url")
    pins = overrides.filter("action = 'pin'").join(sites.select("venue_id"), "venue_id", "left_semi").select(
        "venue_id", "url", "ord")
    unpinned = in_use.join(pins.select("venue_id").distinct(), "venue_id", "left_anti")
    listings = dedupe_urls(pins.unionByName(unpinned.select("venue_id", "url", "ord")), "venue_id", stored)
    day = F.lit(today)
    shows = (
        exhibitions.filter(F.col("detail_url").isNotNull() & F.col("at_venue")
                           & (F.col("end_date").isNull() | (F.col("end_date") >= day)))
        .join(sites.select("venue_id"), "venue_id", "left_semi")
        .select("venue_id", F.col("detail_url").alias("url"), url_key(F.col("detail_url")).alias("key"),
                F.struct(F.coalesce("start_date", F.to_date(F.lit("9999-12-31"))).alias("start"), "id").alias("ord"))
    )
    known = (
        stored.select("venue_id", url_key(F.col("url")).alias("key"))
        .unionByName(listings.select("venue_id", "key"))
        .unionByName(sites.select("venue_id", url_key(F.col("url")).alias("key")))
    )
    fresh = first_per_key(shows.join(known, ["venue_id", "key"], "left_anti"), ["venue_id", "key"], ["ord"])
    numbered = listings.select("venue_id", F.lit(0).alias("rank"), F.col("ord").cast("long").alias("a"),
                               F.lit(0).cast("long").alias("b"), "url").unionByName(
        fresh.select("venue_id", F.lit(1).alias("rank"), F.unix_date("ord.start").cast("long").alias("a"),
                     F.col("ord.id").alias("b"), "url"))
    order = Window.partitionBy("venue_id").orderBy("rank", "a", "b", "url")
    return (
        numbered.withColumn("position", F.row_number().over(order))
        .filter(F.lit(True) if most is None else F.col("position") <= most)
        .select("venue_id", F.col("position").cast("long").alias("position"),
                F.when(F.col("rank") == 0, "listing").otherwise("detail").alias("kind"), "url")
    )


# --- candidate listing pages ---------------------------------------------------------------------


def route(verdicts: DataFrame, in_use: DataFrame) -> DataFrame:
    """Verdicts (venue_id, url, page_type, confidence, ...) with `status` and `reason`. The machine
    may confirm a seed in use, never swap one."""
    single = F.col("page_type") == "single_show"
    sure = F.col("confidence") == "high"
    listing = F.col("page_type").isin(*vocab.LISTING_TYPES)
    mine = in_use.select("venue_id", url_key(F.col("url")).alias("_key"), F.lit(True).alias("_used")).distinct()
    having = in_use.select("venue_id", F.lit(True).alias("_any")).distinct()
    judged = (
        verdicts.withColumn("_key", url_key(F.col("url")))
        .join(mine, ["venue_id", "_key"], "left").join(having, "venue_id", "left")
    )
    swapped = F.col("_any").isNotNull() & F.col("_used").isNull()
    reason = (
        F.when(single, "single show").when(~sure, "unsure")
        .when(~listing, "not a listing").when(swapped, "not the seed in use").otherwise("listing")
    )
    status = F.when(F.col("reason") == "listing", "accepted").when(
        F.col("reason") == "not a listing", "rejected").otherwise("ambiguous")
    return judged.withColumn("reason", reason).withColumn("status", status).drop("_key", "_used", "_any")


def site_status(routed: DataFrame) -> DataFrame:
    """(venue_id, status): accepted when any candidate is; a site is never rejected."""
    accepted = F.bool_or(F.col("status") == "accepted")
    return routed.groupBy("venue_id").agg(F.when(accepted, "accepted").otherwise("ambiguous").alias("status"))


SEED_VALUES = ("page_type", "confidence", "dated_items", "language", "status", "model")


def merge_seeds(stored: DataFrame, routed: DataFrame, run_ts: datetime) -> DataFrame:
    """By venue and page, under the spelling already stored. `routed` holds venue_id, url, the
    verdict, status, model and ord."""
    spelled = first_per_key(
        stored.select("venue_id", url_key(F.col("url")).alias("key"), F.col("url").alias("known")),
        ["venue_id", "key"], ["known"])
    renamed = routed.withColumn("key", url_key(F.col("url"))).join(
        spelled, ["venue_id", "key"], "left").withColumn("url", F.coalesce("known", "url"))
    fresh = last_per_key(renamed.select("venue_id", "url", *SEED_VALUES, "ord"), ["venue_id", "url"], ["ord"])
    both = side_by_side(stored, fresh, ["venue_id", "url"])
    seen = F.col("new").isNotNull()
    return both.select(
        F.coalesce("cur.id", F.xxhash64(F.lit("seed"), "venue_id", "url")).alias("id"), "venue_id", "url",
        *(F.when(seen, F.col(f"new.{c}")).otherwise(F.col(f"cur.{c}")).alias(c) for c in SEED_VALUES),
        F.when(seen, F.lit(run_ts).cast("timestamp_ntz")).otherwise(F.col("cur.discovered_at")).alias("discovered_at"),
    )


# --- report --------------------------------------------------------------------------------------


def crawl_summary(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(metric, value): sites, sites without a page, pages by status and by change."""
    by = lambda prefix, c: pages.filter(F.col(c).isNotNull()).groupBy(
        F.concat(F.lit(prefix), F.col(c)).alias("metric")).agg(F.count("*").alias("value"))
    bare = sites.join(pages.select("venue_id"), "venue_id", "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    return (
        one(sites, "sites").unionByName(one(bare, "sites_without_a_page"))
        .unionByName(by("status_", "status")).unionByName(by("change_", "change"))
    )
