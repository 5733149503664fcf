"""Extraction and discovery scored against hand-made labels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.text import normalize_name, title_key
from vernissage.functions.urls import netloc, scheme, url_key


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def label_status(gold: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, status): ready, unconfirmed, stale or unreadable for each labelled page (url, confirmed,
    content_hash) against the stored pages (url, content_hash, raw_text)."""
    held = stored.select(
        url_key(F.col("url")).alias("key"), F.col("content_hash").alias("_hash"),
        F.col("raw_text").isNotNull().alias("_held")
    ).groupBy("key").agg(F.max(F.struct("_held", "_hash")).alias("p"))
    status = (
        F.when(~F.col("confirmed"), "unconfirmed")
        .when(F.col("p._held") & (F.col("p._hash") == F.col("content_hash")), "ready")
        .when(~F.coalesce("p._held", F.lit(False)), "unreadable")
        .otherwise("stale")
    )
    return gold.withColumn("key", url_key(F.col("url"))).join(held, "key", "left").select("url", status.alias("status"))


# --- matching labels to found items --------------------------------------------------------------


def oversized(items: DataFrame, most: int = vocab.MAX_ITEMS) -> DataFrame:
    """(page_id): pages with more than `most` items of a kind. Nothing is left out of them here."""
    counts = items.groupBy("page_id", "kind").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > most).select("page_id").distinct()


def _assign(labels: Column, found: Column, used: Column, agree) -> Column:
    """Each label in turn takes its best free item: same kind, then same start, then page order.
    Returns struct(used, pairs)."""
    start = F.struct(
        used.cast("array<bigint>").alias("used"),
        F.array().cast("array<struct<label:bigint,found:bigint>>").alias("pairs"))

    def take(state: Column, label: Column) -> Column:
        free = F.filter(found, lambda f: agree(label, f) & ~F.array_contains(state["used"], f["ord"]))
        best = F.array_min(F.transform(free, lambda f: F.struct(
            (~f["kind"].eqNullSafe(label["kind"])).alias("kind"),
            (~f["start"].eqNullSafe(label["start"])).alias("start"), f["ord"].alias("ord"))))["ord"]
        pair = F.struct(label["ord"].alias("label"), best.alias("found"))
        return F.when(best.isNull(), state).otherwise(F.struct(
            F.concat(state["used"], F.array(best)).alias("used"),
            F.concat(state["pairs"], F.array(pair)).alias("pairs")))

    return F.aggregate(labels, start, take)


def _contained(a: Column, b: Column) -> Column:
    """The shorter title is a whole-word run of the longer one."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    pad = F.lit(" ")
    return (F.length(shorter) >= vocab.MIN_CONTAINED_CHARS) & F.contains(
        F.concat(pad, longer, pad), F.concat(pad, shorter, pad))


def match_items(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, label_ord, found_ord): labels paired with found items, exact titles first over the
    whole page, then titles contained in one another. Both tables hold page_id, ord, kind, title,
    start.

    Who gets an item depends on the labels before, so what can compete is decided in one fold: the
    items of one page, whatever their number, and of those only the ones with a possible partner."""
    keyed = lambda df: df.withColumn("key", title_key(F.col("title")))
    labels, found = keyed(labels), keyed(found)

    def gathered(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(F.col("ord").cast("long").alias("ord"), "kind", "key", "start")
        kept = df.select("page_id", row.alias("i"))
        return kept.groupBy("page_id").agg(F.array_sort(F.collect_list("i")).alias(name))

    pages = gathered(labels, "labels").join(gathered(found, "found"), "page_id")
    none = F.array().cast("array<bigint>")
    exact = pages.withColumn("exact", _assign(
        F.col("labels"), F.col("found"), none, lambda a, b: a["key"] == b["key"]))
    taken = F.transform("exact.pairs", lambda p: p["label"])
    rest = exact.withColumn("left", F.filter("labels", lambda x: ~F.array_contains(taken, x["ord"])))
    loose = rest.withColumn("loose", _assign(
        F.col("left"), F.col("found"), F.col("exact.used"), lambda a, b: _contained(a["key"], b["key"])))
    return loose.select("page_id", F.explode(F.concat("exact.pairs", "loose.pairs")).alias("p")).select(
        "page_id", F.col("p.label").alias("label_ord"), F.col("p.found").alias("found_ord"))


def unmatched(items: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """Labels missed (side `label_ord`) or found items that are extra (side `found_ord`)."""
    used = matches.select("page_id", F.col(side).alias("ord"))
    return items.join(used, ["page_id", "ord"], "left_anti")


def with_artist_keys(items: DataFrame) -> DataFrame:
    """Items with `artist_keys`: their artists as a sorted set of normalised names."""
    names = items.select("page_id", "ord", F.explode("artists").alias("artist")).select(
        "page_id", "ord", normalize_name(F.col("artist")).alias("name")).filter("name <> ''")
    sets = names.groupBy("page_id", "ord").agg(F.array_sort(F.collect_set("name")).alias("artist_keys"))
    return items.join(sets, ["page_id", "ord"], "left").withColumn(
        "artist_keys", F.coalesce("artist_keys", F.array().cast("array<string>")))


def score(pages: DataFrame, labels: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """(metric, hits, total, share) over scored pages (page_id, partial, failed). A partial page
    counts for recall and fields, not for precision; a failed page found nothing."""
    found = found.join(pages.filter("NOT failed").select("page_id"), "page_id", "left_semi")
    per_label = labels.groupBy("page_id").agg(F.count("*").alias("labels"))
    per_found = found.groupBy("page_id").agg(F.count("*").alias("found"))
    per_match = matches.groupBy("page_id").agg(F.count("*").alias("matched"))
    counted = pages
    for df in (per_label, per_found, per_match):
        counted = counted.join(df, "page_id", "left")
    n = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("labels", "found", "matched")}
    whole = ~F.col("partial")
    empty = n["labels"] == 0
    figures = counted.agg(
        F.sum(n["matched"]).alias("matched"), F.sum(n["labels"]).alias("labels"),
        F.coalesce(F.sum(F.when(whole, n["matched"])), F.lit(0)).alias("whole_matched"),
        F.coalesce(F.sum(F.when(whole, n["found"])), F.lit(0)).alias("whole_found"),
        _count(empty).alias("empty_pages"),
        F.coalesce(F.sum(F.when(empty, n["found"])), F.lit(0)).alias("invented"),
        _count(F.col("failed")).alias("failed"), F.count("*").alias("pages"),
    )
    side = lambda df, ord_, p: with_artist_keys(df).select(
        "page_id", F.col("ord").alias(ord_),
        *(F.col(c).alias(f"{p}_{c}") for c in ("kind", "start", "end", "at_venue", "artist_keys")))
    pairs = matches.join(side(labels, "label_ord", "l"), ["page_id", "label_ord"]).join(
        side(found, "found_ord", "f"), ["page_id", "found_ord"])
    same = lambda c: F.col(f"l_{c}").eqNullSafe(F.col(f"f_{c}"))
    agreed = pairs.agg(
        _count(same("start") & same("end")).alias("dates"), _count(same("artist_keys")).alias("artists"),
        _count(same("at_venue")).alias("at_venue"), _count(same("kind")).alias("kind"),
        F.count("*").alias("pairs"))
    row = lambda name, hits, total: F.struct(
        F.lit(name).alias("metric"), F.col(hits).cast("long").alias("hits"), F.col(total).cast("long").alias("total"))
    long = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("m")).select("m.*")
    listed = long(
        figures, row("recall", "matched", "labels"), row("precision", "whole_matched", "whole_found"),
        row("invented", "invented", "empty_pages"), row("failed", "failed", "pages"),
    ).unionByName(long(agreed, *(row(c, c, "pairs") for c in ("dates", "artists", "at_venue", "kind"))))
    share = F.when((F.col("total") > 0) & (F.col("metric") != "invented"), F.round(F.col("hits") / F.col("total"), 4))
    return listed.withColumn("share", share)


def current(items: DataFrame, day: date) -> DataFrame:
    """Items (kind, start, end, at_venue, ...) at the venue and not over on `day`: an exhibition with
    no end may still be on, an event with no end is over after its start."""
    last = F.coalesce("end", F.when(F.col("kind") == "event", F.col("start")))
    return items.filter(F.col("at_venue") & (last.isNull() | (last >= F.lit(day))))


def without_current(pages: DataFrame, items: DataFrame, day: date) -> DataFrame:
    return pages.join(current(items, day).select("page_id"), "page_id", "left_anti")


# --- discovery -----------------------------------------------------------------------------------


def _labelled(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts of labelled venues with `listed`: whether the URL is one of the venue's listings."""
    listed = listings.select(
        normalize_name(F.col("venue")).alias("name_key"), F.explode("urls").alias("u")
    ).select("name_key", url_key(F.col("u")).alias("key"), F.lit(True).alias("_listed")).distinct()
    venues = listings.select(normalize_name(F.col("venue")).alias("name_key")).distinct()
    return (
        verdicts.withColumn("name_key", normalize_name(F.col("venue_name")))
        .withColumn("key", url_key(F.col("url")))
        .join(venues, "name_key", "left_semi")
        .join(listed, ["name_key", "key"], "left")
        .withColumn("listed", F.coalesce("_listed", F.lit(False)))
    )


def discovery_outcomes(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(venue, outcome, wrong) per labelled venue (venue, urls): undiscovered, accepted-but-wrong,
    correct or ambiguous, and how many accepted URLs are no listing of it."""
    accepted = F.col("status") == "accepted"
    seen = _labelled(listings, verdicts).groupBy("name_key").agg(
        _count(accepted).alias("accepted"), _count(accepted & ~F.col("listed")).alias("wrong"))
    outcome = (
        F.when(F.col("accepted").isNull(), "undiscovered").when(F.col("wrong") > 0, "accepted-but-wrong")
        .when(F.col("accepted") > 0, "correct").otherwise("ambiguous")
    )
    return listings.withColumn("name_key", normalize_name(F.col("venue"))).join(seen, "name_key", "left").select(
        "venue", outcome.alias("outcome"), F.coalesce("wrong", F.lit(0).cast("long")).alias("wrong"))


def wrong_urls(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    return _labelled(listings, verdicts).filter("status = 'accepted' AND NOT listed").select("venue_name", "url")


def outcome_shares(outcomes: DataFrame) -> DataFrame:
    """(outcome, venues, decided): counts over the venues discovery has a verdict for."""
    decided = outcomes.filter("outcome <> 'undiscovered'")
    total = decided.agg(F.count("*")).scalar()
    return decided.groupBy("outcome").agg(F.count("*").alias("venues")).withColumn("decided", total)


def unlabelled(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(venue_name): venues with verdicts and no labelled listing, one spelling each."""
    known = listings.select(normalize_name(F.col("venue")).alias("name_key"))
    return (
        verdicts.withColumn("name_key", normalize_name(F.col("venue_name")))
        .join(known, "name_key", "left_anti").groupBy("name_key").agg(F.min("venue_name").alias("venue_name"))
        .select("venue_name")
    )


def calibration(listings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(rank, page_type, confidence, candidates, listings), in the fixed order of the vocabularies."""
    place = lambda c, values: F.array_position(F.array(*map(F.lit, values)), F.col(c))
    counted = _labelled(listings, verdicts).groupBy("page_type", "confidence").agg(
        F.count("*").alias("candidates"), _count(F.col("listed")).alias("listings"))
    rank = place("page_type", vocab.PAGE_TYPES) * 10 + place("confidence", vocab.CONFIDENCES)
    return counted.select(rank.cast("long").alias("rank"), "page_type", "confidence", "candidates", "listings")


# --- judgements and labels -----------------------------------------------------------------------


def supported_share(judgements: DataFrame) -> DataFrame:
    """(supported, judged, share) of judgements (supported, failed); failed pages judge nothing."""
    judged = ~F.col("failed")
    hits, total = _count(judged & F.col("supported")), _count(judged)
    return judgements.agg(hits.alias("supported"), total.alias("judged")).withColumn(
        "share", F.when(F.col("judged") > 0, F.round(F.col("supported") / F.col("judged"), 4)))


def gold_problems(pages: DataFrame, items: DataFrame, listings: DataFrame) -> DataFrame:
    """(subject, problem): why a set of labels cannot be used. Pages hold page_id, url, kind,
    content_hash, partial; items page_id, kind, title, start, end; listings venue, urls."""
    found = lambda df, subject, problem: df.select(
        F.col(subject).cast("string").alias("subject"), F.lit(problem).alias("problem"))
    web = lambda c: scheme(c).isin("http", "https") & (netloc(c) != "")
    counts = items.groupBy("page_id", "kind").agg(F.count("*").alias("n"))
    crowded = counts.filter(F.col("n") > vocab.MAX_ITEMS).join(
        pages.filter("kind = 'listing'").select("page_id", "url"), "page_id").select("url").distinct()
    repeated = lambda df, key: df.groupBy(key.alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    urls = listings.select(F.explode("urls").alias("url"))
    parts = [
        found(items.filter(F.col("end") < F.col("start")), "title", "ends before it starts"),
        found(crowded, "url", "too many items of a kind"),
        found(pages.filter("partial AND kind <> 'listing'"), "url", "partial but no listing"),
        found(pages.filter("partial").join(items.select("page_id"), "page_id", "left_anti"), "url", "partial and empty"),
        found(pages.filter(~web(F.col("url"))), "url", "not a web address"),
        found(urls.filter(~web(F.col("url"))), "url", "not a web address"),
        found(pages.filter(~F.col("content_hash").rlike("^[0-9a-f]{64}$")), "url", "not a content hash"),
        found(repeated(pages, url_key(F.col("url"))), "k", "labelled twice"),
        found(repeated(listings, normalize_name(F.col("venue"))), "k", "listed twice"),
    ]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    return everything
