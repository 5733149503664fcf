"""Scripted conversations: what each turn asked for, what it used, what its reply names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.dates import resolve_day
from vernissage.functions.geo import distance_m
from vernissage.functions.text import title_key, tokens
from vernissage.operators.ordered import percentiles, running
from vernissage.session import materialize

CARRIED = ("dates", "area", "free", "kinds")


def carry_constraints(turns: DataFrame) -> DataFrame:
    """Turns (scenario_id, turn, has_<c>, <c> for dates, area, free, kinds) with each constraint as
    last stated. Stating null drops it: a stated value travels inside a struct, so that null is
    something to carry."""
    stated = {
        f"_{c}": ("last", F.when(F.col(f"has_{c}"), F.struct(F.col(c).alias("value")))) for c in CARRIED}
    carried = running(turns, ["scenario_id"], "turn", stated)
    return carried.select(
        "scenario_id", "turn", *(F.col(f"_{c}.value").alias(c) for c in CARRIED))


def resolve_constraints(carried: DataFrame, today: Column) -> DataFrame:
    """Carried constraints with days: date_from, date_to, near, km, free, kinds. A weekday of the
    last day is counted from the first."""
    first = resolve_day(F.col("dates")[0], today)
    last = resolve_day(F.col("dates")[1], today, on_or_after=first)
    return carried.select(
        "scenario_id", "turn", first.alias("date_from"), last.alias("date_to"),
        F.col("area.near").alias("near"), F.col("area.km").alias("km"),
        F.coalesce("free", F.lit(False)).alias("free"), "kinds")


# --- what a turn did -----------------------------------------------------------------------------

_BLOCK = (
    "array<struct<type:string,id:string,name:string,input:string,tool_use_id:string,"
    "content:string,is_error:boolean,text:string>>"
)


def tool_uses(messages: DataFrame) -> DataFrame:
    """(conversation_id, call_id, ord, name, input, result, is_error): every tool call with the
    result that answered it. Of a repeated id the last block counts, in the first one's place; a
    call with no result is left out. Messages hold conversation_id, position, content (JSON)."""
    blocks = messages.select(
        "conversation_id", "position", F.posexplode(F.from_json("content", _BLOCK)).alias("n", "b")
    ).select("conversation_id", F.struct("position", "n").alias("ord"), "b.*")
    calls = blocks.filter("type = 'tool_use'").groupBy("conversation_id", F.col("id").alias("call_id")).agg(
        F.min("ord").alias("ord"), F.max_by(F.struct("name", "input"), "ord").alias("call"))
    results = blocks.filter("type = 'tool_result'").groupBy(
        "conversation_id", F.col("tool_use_id").alias("call_id")).agg(
        F.max_by(F.struct("content", "is_error"), "ord").alias("answer"))
    return calls.join(results, ["conversation_id", "call_id"]).select(
        "conversation_id", "call_id", "ord", "call.name", "call.input",
        F.col("answer.content").alias("result"), F.coalesce("answer.is_error", F.lit(False)).alias("is_error"))


_EVENTS = "events array<struct<id:string,title:string,title_en:string,distance_km:double>>, total long, truncated boolean"


def seen_rows(uses: DataFrame) -> DataFrame:
    """(conversation_id, ord, id, title, distance_km): each title a tool gave an item, in order."""
    rows = (
        uses.filter("name IN ('search_events', 'get_events') AND NOT is_error")
        .select("conversation_id", "ord", F.posexplode(F.from_json("result", _EVENTS)["events"]).alias("n", "e"))
        .select("conversation_id", "ord", "n", "e.*")
    )
    titles = F.array_compact(F.array("title", F.when(F.col("title_en") != "", F.col("title_en"))))
    return rows.select(
        "conversation_id", "id", "distance_km", "ord", "n", F.posexplode(titles).alias("t", "title")
    ).select("conversation_id", F.struct("ord", "n", "t").alias("ord"), "id", "title", "distance_km")


def seen_items(uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, titles) of each conversation: id with its latest known distance and first place; and
    each id's distinct titles with the place each was first given."""
    rows = seen_rows(uses)
    items = rows.groupBy("conversation_id", "id").agg(
        F.min("ord").alias("ord"),
        F.max_by("distance_km", F.when(F.col("distance_km").isNotNull(), F.col("ord"))).alias("distance_km"))
    titles = rows.groupBy("conversation_id", "id", "title").agg(F.min("ord").alias("ord"))
    return items, titles


_KEY = ("conversation_id", "n", "h1", "h2")


def _hashed(key: Column) -> Column:
    """The words of a key as hashes. Words travel so, and a run of them as two independent ones: no text is shuffled."""
    return F.transform(tokens(key), lambda w: F.xxhash64(w))


def mentions(replies: DataFrame, keys: DataFrame) -> DataFrame:
    """(reply_id, conversation_id, n, h1, h2, start, stop): where each title key stands in a reply as whole
    words, by token. Replies hold reply_id, conversation_id, text; keys conversation_id and the number and
    hashes of their words. A reply is cut only into runs as long as some title of its conversation."""
    lengths = keys.groupBy("conversation_id").agg(F.collect_set("n").alias("lengths"))
    spoken = replies.select("reply_id", "conversation_id", _hashed(title_key(F.col("text"))).alias("words"))
    by_length = spoken.join(lengths, "conversation_id").select(
        "reply_id", "conversation_id", "words", F.explode("lengths").alias("n")
    ).filter(F.size("words") >= F.col("n"))

    def run(i: Column) -> Column:
        part = F.slice(F.col("words"), i, F.col("n"))
        return F.struct(i.alias("start"), F.xxhash64(part).alias("h1"), F.hash(part).alias("h2"))

    runs = by_length.select("reply_id", "conversation_id", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), run)).alias("r"))
    return runs.select("reply_id", "conversation_id", "n", "r.*").join(keys, list(_KEY), "left_semi").select(
        "reply_id", *_KEY, "start", (F.col("start") + F.col("n")).alias("stop"))


def _outermost(replies: DataFrame, keys: DataFrame) -> DataFrame:
    """(reply_id, conversation_id, n, h1, h2, first_start) of the title keys that a reply names, not only
    inside longer named ones."""
    said = mentions(replies, keys)
    # A mention lies inside a longer one iff a mention that starts earlier, or as early and ends
    # later, reaches its end. The window holds one reply's mentions.
    line = Window.partitionBy("reply_id").orderBy("start", F.col("stop").desc())
    reached = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    outside = said.withColumn("_inside", F.coalesce(reached >= F.col("stop"), F.lit(False)))
    return outside.groupBy("reply_id", *_KEY).agg(
        F.min("start").alias("first_start"), F.bool_and("_inside").alias("_hidden")
    ).filter("NOT _hidden").drop("_hidden")


def named_items(replies: DataFrame, uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(named, ids): the titles each reply names, in order of first mention, with the nearest
    distance of the items seen under each; and the item ids behind each title. A title counts only
    if some mention of it is not inside a longer named one.

    What a conversation was shown is written once; replies meet it by hashes of words, and texts are picked
    up last, so rows that are sorted and shuffled hold numbers alone."""
    items, titles = seen_items(uses)
    words = _hashed(F.col("key"))
    keyed = materialize(titles.withColumn("key", title_key(F.col("title"))).filter(
        F.length("key") >= vocab.MIN_CONTAINED_CHARS).withColumns({
            "n": F.size(words), "h1": F.xxhash64(words), "h2": F.hash(words)}))
    under = keyed.join(items.select(
        "conversation_id", "id", "distance_km", F.col("ord").alias("item_ord")), ["conversation_id", "id"])
    seen = F.struct("item_ord", "ord")
    shown = materialize(under.groupBy(*_KEY, "key").agg(
        F.min_by("title", seen).alias("title"), F.min("distance_km").alias("distance_km"), F.min(seen).alias("_seen")))
    first = _outermost(replies, shown.select(*_KEY))
    # Two titles first named at one place keep the order they were seen in.
    order = Window.partitionBy("reply_id").orderBy("first_start", "_seen")
    named = first.join(shown, list(_KEY)).select(
        "reply_id", "conversation_id", "key", "title",
        F.row_number().over(order).cast("long").alias("rank"), "distance_km")
    ids = first.join(materialize(keyed.select(*_KEY, "key", "id").distinct()), list(_KEY)).select("reply_id", "key", "id")
    return named, ids


def in_distance_order(named: DataFrame) -> DataFrame:
    """(reply_id, in_order): whether the named items with a distance come nearest first; only
    replies with two or more of them have a row."""
    line = Window.partitionBy("reply_id").orderBy("rank")
    steps = named.filter("distance_km IS NOT NULL").withColumn("_before", F.lag("distance_km").over(line))
    return steps.groupBy("reply_id").agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("distance_km") >= F.col("_before"), F.lit(True))).alias("in_order")
    ).filter("n >= 2").drop("n")


# --- checks --------------------------------------------------------------------------------------


def off_constraint(named_ids: DataFrame, constraints: DataFrame, found: DataFrame, venues: DataFrame) -> DataFrame:
    """(reply_id, key, constraint): named titles none of whose items meets a constraint of its turn.
    Constraints hold reply_id, date_from, date_to, lat, lon, km, free, kinds.

    An item meets a constraint iff the search for that constraint alone would return it, so only
    the named items are looked up, by id; nothing is searched."""
    points = venues.select(F.col("id").alias("place_venue_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    facts = found.select("id", "kind", "is_free", "first_day", "last_day", "place_venue_id").join(
        points, "place_venue_id", "left")
    held = F.col("kind").isNotNull()
    on = (F.col("first_day").isNull() | (F.col("first_day") <= F.col("date_to"))) & (
        F.col("last_day").isNull() | (F.col("last_day") >= F.col("date_from")))
    metres = distance_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    rule = lambda name, asked, met: F.struct(
        F.lit(name).alias("constraint"), asked.alias("asked"), (held & F.coalesce(met, F.lit(False))).alias("met"))
    rules = F.array(
        rule("dates", F.col("date_from").isNotNull(), on),
        rule("area", F.col("km").isNotNull(), metres <= F.col("km") * 1000),
        rule("price", F.col("free"), F.coalesce("is_free", F.lit(True))),
        rule("kinds", F.col("kinds").isNotNull(), F.array_contains("kinds", F.col("kind"))),
    )
    judged = named_ids.join(constraints, "reply_id").join(facts, "id", "left").select(
        "reply_id", "key", F.explode(rules).alias("r")).filter("r.asked")
    return judged.groupBy("reply_id", "key", F.col("r.constraint").alias("constraint")).agg(
        F.bool_or("r.met").alias("met")).filter("NOT met").drop("met")


def check_failures(turns: DataFrame, uses: DataFrame) -> DataFrame:
    """(turn_id, failure): turns (turn_id, searches, remembers) against their tool uses (turn_id,
    name, topic, is_error)."""
    did = uses.groupBy("turn_id").agg(
        F.bool_or(F.col("name") == "search_events").alias("searched"),
        # At most one entry per topic of the vocabulary.
        F.collect_set(F.when((F.col("name") == "remember") & ~F.col("is_error"), F.col("topic"))).alias("topics"))
    searched = F.coalesce("searched", F.lit(False))
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    lone = F.array(
        F.when(F.col("searches") & ~searched, "did not search"),
        F.when(~F.col("searches") & searched, "searched again"),
        F.when((F.size("remembers") == 0) & (F.size(topics) > 0), F.concat(
            F.lit("remembered "), F.array_join(F.array_sort(topics), ", "), F.lit(", which it should not have"))),
    )
    missed = F.transform(F.filter("remembers", lambda x: ~F.array_contains(topics, x)),
                         lambda x: F.concat(F.lit("did not remember "), x))
    every = F.concat(F.array_compact(lone), F.coalesce(missed, F.array().cast("array<string>")))
    return turns.join(did, "turn_id", "left").select("turn_id", F.explode(every).alias("failure"))


def checks_made(turns: DataFrame) -> DataFrame:
    """(turn_id, made): one for `searches`, one per topic to remember or for "remember nothing"."""
    made = F.when(F.col("searches").isNotNull(), 1).otherwise(0) + F.when(
        F.col("remembers").isNotNull(), F.greatest(F.size("remembers"), F.lit(1))).otherwise(0)
    return turns.select("turn_id", made.cast("long").alias("made"))


def run_summary(exchanges: DataFrame) -> DataFrame:
    """(metric, value) over exchanges (named, off, in_order, made, failed, rounds, searches,
    truncated, cost_usd, calls, seconds, stop_reason, tool_errors)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    figures = {
        "exchanges": F.count("*").cast("double"),
        "named": total("named"), "named_max": F.max("named").cast("double"),
        "off": total("off"),
        "ordered": total(F.col("in_order").cast("int")), "orderable": F.count("in_order").cast("double"),
        "checks": total("made"), "checks_met": total(F.col("made") - F.col("failed")),
        "searches": total("searches"), "truncated": total("truncated"),
        "cost_usd": total("cost_usd"), "cost_usd_max": F.max("cost_usd").cast("double"),
        "model_calls": total("calls"), "seconds_max": F.max("seconds").cast("double"),
        "tool_errors": total("tool_errors"),
    }
    wide = exchanges.agg(*(c.alias(n) for n, c in figures.items()))
    sums = wide.select(F.explode(F.array(*(
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in figures))).alias("m")).select("m.*")
    by = lambda prefix, c: exchanges.groupBy(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("metric")).agg(
        F.count("*").cast("double").alias("value"))
    ranked = percentiles(exchanges, [], "seconds", [0.5, 0.95]).select(
        F.concat(F.lit("seconds_p"), (F.col("share") * 100).cast("int").cast("string")).alias("metric"),
        F.col("seconds").cast("double").alias("value"))
    stops = by("stop_", "stop_reason").filter("metric <> 'stop_end_turn'")
    return sums.unionByName(by("rounds_", "rounds")).unionByName(stops).unionByName(ranked)


def exchange_cost(calls: DataFrame) -> DataFrame:
    """(trace_id, calls, cost_usd, latency_ms) of each exchange."""
    return calls.groupBy("trace_id").agg(
        F.count("*").alias("calls"), F.sum("cost_usd").alias("cost_usd"),
        F.sum("latency_ms").cast("long").alias("latency_ms"))


def truncated_share(totals: DataFrame, run: str) -> DataFrame:
    """(run, searches, truncated): how many searches of each run were cut."""
    return totals.groupBy(run).agg(
        F.count("*").alias("searches"), F.sum(F.col("truncated").cast("int")).cast("long").alias("truncated"))
