"""Raw extraction answers to typed items: every rule of the answer's shape as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.dates import resolve_dates
from vernissage.functions.text import strip_space

_RAW = "map<string,string>"
_DATE = ("day", "month", "year")
_FACTS = ("title", "artists", "start", "end", "at_venue", "link", "confidence")
_PROSE = ("summary_en", "themes", "media")
_EVENT = ("kind", "start_time", "exhibition_title")
_ITEM = (
    "title string, artists array<string>, `start` struct<day:int,month:int,year:int>, "
    "`end` struct<day:int,month:int,year:int>, at_venue boolean, link int, confidence string, "
    "summary_en string, themes array<string>, media array<string>, kind string, "
    "start_time string, exhibition_title string"
)


def _lists(inputs: Column, key: str) -> tuple[Column, Column]:
    """(items, malformed) of one list over every call of an answer: the lists joined, a list sent
    as its JSON text read as meant, a list left out taken as empty."""
    texts = F.filter(
        F.transform(inputs, lambda m: F.struct(F.map_contains_key(m, key).alias("given"), m[key].alias("text"))),
        lambda x: x["given"],
    )
    parsed = F.transform(texts, lambda x: F.from_json(x["text"], "array<string>"))
    bad = F.exists(texts, lambda x: x["text"].isNull() | ~F.ltrim(x["text"]).startswith("[")) | F.exists(
        parsed, lambda p: p.isNull())
    return F.flatten(F.filter(parsed, lambda p: p.isNotNull())), bad


def read_answers(answers: DataFrame, most: int | None = None) -> DataFrame:
    """One row per page: page_id, listing, link_count, fetched_on, links, exhibitions and events as
    arrays of JSON texts, `capped`, and `reason` where the whole answer cannot be used. All items are
    taken, or up to `most` of a kind where a number is given: a listing is then cut to its first items
    before anything in it is judged, and any other page with more is refused."""
    calls = F.transform("tool_inputs", lambda s: F.from_json(s, _RAW))
    read = answers.withColumn("_calls", calls)
    shows, bad_shows = _lists(F.col("_calls"), "exhibitions")
    events, bad_events = _lists(F.col("_calls"), "events")
    unknown = F.exists("_calls", lambda m: F.size(F.array_except(
        F.map_keys(m), F.array(F.lit("exhibitions"), F.lit("events")))) > 0)
    read = read.withColumns({
        "_shows": shows, "_events": events,
        "reason": F.when((F.size("_calls") == 0) | F.exists("_calls", lambda m: m.isNull()), "not an answer")
        .when(unknown, "unknown key").when(bad_shows | bad_events, "not a list"),
    })
    none = most is None
    cut = lambda c: F.col(c) if none else F.when(F.col("listing"), F.slice(c, 1, most)).otherwise(F.col(c))
    longest = F.greatest(F.size("_shows"), F.size("_events"))
    over = F.lit(False) if none else ~F.col("listing") & (longest > most)
    full = F.lit(False) if none else longest >= most
    return read.select(
        "page_id", "listing", "link_count", "fetched_on", "links",
        cut("_shows").alias("exhibitions"), cut("_events").alias("events"),
        (F.col("listing") & full).alias("capped"),
        F.coalesce("reason", F.when(over, "too many items")).alias("reason"),
    )


def _text_ok(c: Column, longest: int) -> Column:
    return F.length(strip_space(c)).between(1, longest)


def _date_problem(raw: Column, date: Column) -> Column:
    parts = F.from_json(raw, _RAW)
    given = raw.isNotNull() & parts["month"].isNotNull()
    shape = F.size(F.array_except(F.map_keys(parts), F.array(*map(F.lit, _DATE)))) > 0
    ranges = (
        date["month"].between(1, 12)
        & (date["day"].isNull() | date["day"].between(1, 31))
        & (date["year"].isNull() | date["year"].between(1900, 2100))
    )
    lost = F.lit(False)
    for part in _DATE:
        lost = lost | (parts[part].isNotNull() & date[part].isNull()) | ~F.map_contains_key(parts, F.lit(part))
    # A year alone (no month) is read as no date.
    return F.when(raw.isNotNull() & parts.isNull(), True).when(
        given, shape | lost | ~F.coalesce(ranges, F.lit(False))).otherwise(False)


def judge_items(read: DataFrame) -> DataFrame:
    """Every item with its typed fields (`item`), and `reason` for the first rule it breaks."""
    usable = read.filter("reason IS NULL")
    numbered = lambda kind, column: F.transform(column, lambda text, ord: F.struct(
        F.lit(kind).alias("list"), ord.alias("ord"), text.alias("text")))
    items = usable.select("page_id", "listing", "link_count", "fetched_on", "links", F.explode(F.concat(
        numbered("exhibition", "exhibitions"), numbered("event", "events"))).alias("_i")).select("*", "_i.*").drop("_i")
    items = items.withColumns({"raw": F.from_json("text", _RAW), "item": F.from_json("text", _ITEM)})
    raw, item = F.col("raw"), F.col("item")
    described, event = ~F.col("listing"), F.col("list") == "event"
    names = lambda *n: F.array(*map(F.lit, n))
    allowed = F.concat(
        names(*_FACTS), F.when(described, names(*_PROSE)).otherwise(F.array().cast("array<string>")),
        F.when(event, names(*_EVENT)).otherwise(F.array().cast("array<string>")))

    def one_of(c: Column, values: tuple[str, ...]) -> Column:
        return c.isin(*values)

    each = lambda c, rule: F.forall(c, lambda x: F.coalesce(rule(x), F.lit(False)))
    mistyped = F.lit(False)
    for name in (*_FACTS, *_PROSE, *_EVENT):
        if name not in ("start", "end"):
            mistyped = mistyped | (raw[name].isNotNull() & item[name].isNull())
    link, count = item["link"], F.col("link_count")
    required = F.lit(True)
    for name in ("title", "artists", "at_venue", "confidence"):
        required = required & raw[name].isNotNull()
    required = required & (~described | (raw["themes"].isNotNull() & raw["media"].isNotNull()))
    required = required & (~event | raw["kind"].isNotNull())
    reason = (
        F.when(raw.isNull(), "not an item")
        .when(F.size(F.array_except(F.map_keys(raw), allowed)) > 0, "unknown key")
        .when((F.size(F.array_except(allowed, F.map_keys(raw))) > 0) | ~required, "missing field")
        .when(mistyped, "wrong type")
        .when(~_text_ok(item["title"], vocab.TITLE_CHARS), "title length")
        .when((F.size(item["artists"]) > vocab.MAX_ARTISTS)
              | ~each(item["artists"], lambda x: _text_ok(x, vocab.NAME_CHARS)), "artists")
        .when(_date_problem(raw["start"], item["start"]) | _date_problem(raw["end"], item["end"]), "date")
        .when(link.isNotNull() & ~link.between(1, count), "link")
        .when(~one_of(item["confidence"], vocab.CONFIDENCES), "confidence")
        .when(described & (F.length(strip_space(item["summary_en"])) > vocab.SUMMARY_CHARS), "summary length")
        .when(described & ((F.size(item["themes"]) > vocab.MAX_THEMES)
                           | ~each(item["themes"], lambda x: _text_ok(x, vocab.THEME_CHARS))), "themes")
        .when(described & ((F.size(item["media"]) > vocab.MAX_MEDIA)
                           | ~each(item["media"], lambda x: one_of(x, vocab.MEDIA))), "media")
        .when(event & ~one_of(item["kind"], vocab.EVENT_KINDS), "kind")
        .when(event & item["start_time"].isNotNull()
              & ~strip_space(item["start_time"]).rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "start time")
        .when(event & item["exhibition_title"].isNotNull()
              & ~_text_ok(item["exhibition_title"], vocab.TITLE_CHARS), "exhibition title")
    )
    return items.withColumn("reason", reason)


def validate_answers(answers: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exhibitions, events, pages). One bad item refuses its page, so `pages` says per page whether
    it was refused and why, what it yielded, and whether it was cut at the cap."""
    read = read_answers(answers, most)
    judged = judge_items(read)
    verdict = judged.groupBy("page_id").agg(
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.struct("list", "ord"))).alias("_item_reason"),
        F.count("*").alias("items"))
    counted = read.join(verdict, "page_id", "left").select(
        "page_id", "listing", "fetched_on", "capped", "items",
        F.coalesce("reason", "_item_reason").alias("reason"),
    ).withColumn("ok", F.col("reason").isNull()).withColumn(
        "items", F.when(F.col("ok"), F.coalesce("items", F.lit(0).cast("long"))))

    item = F.col("item")
    written = lambda c: F.when(c["month"].isNotNull(), c)
    bare = lambda c: F.transform(c, strip_space)
    described = ~F.col("listing")
    none = F.array().cast("array<string>")
    target = F.try_element_at(
        F.filter("links", lambda x: x["number"] == F.col("item.link")), F.lit(1))["url"]
    # The window holds the items of one answer.
    good = judged.withColumn("_bad", F.count("reason").over(Window.partitionBy("page_id"))).filter("_bad = 0").withColumn(
        "_run", resolve_dates(written(item["start"]), written(item["end"]), F.col("fetched_on")))
    summary = strip_space(item["summary_en"])
    typed = good.select(
        "page_id", "list", "ord", strip_space(item["title"]).alias("title"),
        bare(item["artists"]).alias("artists"), "_run.start_date", "_run.end_date",
        item["at_venue"].alias("at_venue"), target.alias("detail_url"),
        item["confidence"].alias("confidence"),
        F.when(described & (summary != ""), summary).alias("summary_en"),
        F.when(described, F.array_distinct(F.transform(bare(item["themes"]), F.lower))).otherwise(none).alias("themes"),
        F.when(described, F.array_distinct(item["media"])).otherwise(none).alias("media"),
        item["kind"].alias("kind"), strip_space(item["start_time"]).alias("start_time"),
        strip_space(item["exhibition_title"]).alias("exhibition_title"),
    )
    shows = typed.filter("list = 'exhibition'").drop("list", "kind", "start_time", "exhibition_title")
    return shows, typed.filter("list = 'event'").drop("list"), counted
