"""Scripted conversations: constraints, tools used, titles named, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.catalog.read import CANDIDATES, candidates, lambert
from vernissage.catalog.registry import query
from vernissage.functions.dates import resolve_day
from vernissage.plans import dialogue, search
from vernissage.session import materialize

# --- constraints ---------------------------------------------------------------------------------

_DAYS = "[" + ", ".join(f"'{d}'" for d in ("today", "tomorrow", *vocab.WEEKDAYS)) + "]"
_TURNS = """
  select conv_id as scenario_id, turn, turn % 3 = 0 as has_dates, case when turn % 6 = 0 then {days} end as dates,
    turn % 2 = 1 as has_area, case when conv_id % 4 <> 3 then {area} end as area,
    (conv_id + turn) % 4 = 0 as has_free, case when turn % 8 <> 4 then turn % 5 = 0 end as free,
    turn % 5 = 2 as has_kinds, case when conv_id % 3 = 0 then {kinds} end as kinds
  from conversations"""
_SPARK_TURNS = _TURNS.format(
    days="array(element_at(array({0}), cast(1 + (conv_id + turn) % 9 as int)), concat(element_at(array({0}), cast(1 + (conv_id * 2 + turn) % 9 as int)), case when turn % 4 = 0 then '+2' else '' end))".format(_DAYS[1:-1]),
    area="named_struct('near', concat('place ', conv_id % 10), 'km', cast(1 + turn as double))", kinds="array('talk', 'opening')")
_DUCK_TURNS = _TURNS.format(
    days="[{0}[1 + (conv_id + turn) % 9], {0}[1 + (conv_id * 2 + turn) % 9] || case when turn % 4 = 0 then '+2' else '' end]".format(_DAYS),
    area="{'near': 'place ' || (conv_id % 10), 'km': cast(1 + turn as double)}", kinds="['talk', 'opening']")
_CARRY = ", ".join(f"last_value(case when has_{c} then {{'v': {c}}} end ignore nulls) over w as {c}" for c in dialogue.CARRIED)
_CARRIED = f"""
  turns as ({_DUCK_TURNS}),
  s as (select scenario_id, turn, {_CARRY} from turns window w as (partition by scenario_id order by turn)),
  carried as (select scenario_id, turn, {", ".join(f"{c}.v as {c}" for c in dialogue.CARRIED)} from s)"""


@query("carry_constraints", f"""with {_CARRIED}
    select scenario_id, turn, array_to_string(dates, '|') as dates, area.near as near, area.km as km, free, array_to_string(kinds, '|') as kinds from carried""")
def carry_constraints(t):
    carried = dialogue.carry_constraints(t.sql(_SPARK_TURNS))
    joined = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, "|")).alias(c)
    return carried.select("scenario_id", "turn", joined("dates"), "area.near", "area.km", "free", joined("kinds"))


def _day(spec: str, start: str) -> str:
    word, plus = f"split_part({spec}, '+', 1)", f"coalesce(try_cast(nullif(split_part({spec}, '+', 2), '') as int), 0)"
    wanted = f"list_position([{', '.join(repr(d) for d in vocab.WEEKDAYS)}], {word}) - 1"
    weekday = f"(isodow({start}) - 1)"
    return (f"(case {word} when 'today' then date '2026-11-05' when 'tomorrow' then date '2026-11-06' "
            f"else {start} + cast(((({wanted}) - {weekday}) % 7 + 7) % 7 as int) end + {plus})")


@query("resolve_constraints", f"""with {_CARRIED},
    f as (select *, {_day("dates[1]", "date '2026-11-05'")} as date_from from carried)
    select scenario_id, turn, date_from, case when dates is not null then {_day("dates[2]", "date_from")} end as date_to,
      area.near as near, area.km as km, coalesce(free, false) as free, array_to_string(kinds, '|') as kinds from f""")
def resolve_constraints(t):
    carried = dialogue.carry_constraints(t.sql(_SPARK_TURNS))
    resolved = dialogue.resolve_constraints(carried, F.to_date(F.lit("2026-11-05")))
    return resolved.withColumn("kinds", F.when(F.col("kinds").isNotNull(), F.array_join("kinds", "|")))


@query("resolve_days", f"""
    with s as (select event_id, cast(ts as date) as today, {_DAYS}[1 + event_id % 9] || case when event_id % 4 = 0 then '+' || (event_id % 20) else '' end as spec from events)
    select event_id, {_day("spec", "today").replace("date '2026-11-05'", "today").replace("date '2026-11-06'", "(today + 1)")} as day from s""")
def resolve_days(t):
    names = F.array(*map(F.lit, ("today", "tomorrow", *vocab.WEEKDAYS)))
    k = F.col("event_id")
    spec = F.concat(F.element_at(names, (k % 9 + 1).cast("int")),
                    F.when(k % 4 == 0, F.concat(F.lit("+"), (k % 20).cast("string"))).otherwise(""))
    return t["events"].select("event_id", resolve_day(spec, F.to_date("ts")).alias("day"))


# --- tools and titles ----------------------------------------------------------------------------

_ROWS = """
  select o_custkey % 500 as conversation_id, o_orderkey, 'c' || o_orderkey % 7000 as call_id, 'x:' || o_orderkey % 900 as item_id,
    case when o_orderkey % 3 = 0 then p_name || ' ' || p_brand else p_name end as title,
    case when o_orderkey % 5 = 0 then 'the ' || p_name end as title_en, case when o_orderkey % 4 <> 0 then cast(o_orderkey % 97 as double) / 4 end as km,
    o_orderkey % 10 = 9 as bad, case when o_orderkey % 6 = 5 then 'remember' when o_orderkey % 2 = 0 then 'search_events' else 'get_events' end as tool
  from v_keyed join part on part_key = p_partkey"""


def _messages(t):
    """Messages whose content is the JSON of a call and its answer; some calls are never answered."""
    event = F.struct(F.col("item_id").alias("id"), "title", "title_en", F.col("km").alias("distance_km"))
    result = F.to_json(F.struct(F.array(event).alias("events"), F.lit(1).alias("total")))
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.col("call_id").alias("id"), F.col("tool").alias("name"),
                             F.lit("{}").alias("input")))
    answer = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.col("call_id").alias("tool_use_id"),
                                result.alias("content"), F.when(F.col("bad"), True).alias("is_error")))
    answered = F.when(F.col("o_orderkey") % 8 == 7, F.array(use)).otherwise(F.array(use, answer))
    content = F.concat(F.lit("["), F.array_join(answered, ","), F.lit("]"))
    return t.sql(_ROWS).select("conversation_id", F.col("o_orderkey").alias("position"), content.alias("content"))


_USES = f"""
  r as ({_ROWS}),
  answered as (select conversation_id, call_id, arg_max(r, o_orderkey) as a from r where o_orderkey % 8 <> 7 group by 1, 2),
  called as (select conversation_id, call_id, min(o_orderkey) as first, arg_max(tool, o_orderkey) as name from r group by 1, 2),
  uses as (
    select c.conversation_id, c.call_id, c.first, c.name, a.a.bad as is_error, a.a.item_id as id, a.a.title as title, a.a.title_en as title_en, a.a.km as km
    from called c join answered a on a.conversation_id = c.conversation_id and a.call_id = c.call_id),
  seen as (select * from uses where name in ('search_events', 'get_events') and not is_error),
  titles as (
    select conversation_id, id, title, min((first, t)) as o from (
      select conversation_id, id, title, first, 0 as t from seen union all select conversation_id, id, title_en, first, 1 from seen where title_en is not null)
    group by 1, 2, 3),
  items as (select conversation_id, id, arg_max(km, first) filter (km is not null) as distance_km, min(first) as item_first from seen group by 1, 2)"""


@query("tool_uses", f"with {_USES} select conversation_id, call_id, first, name, id as item_id, is_error from uses")
def tool_uses(t):
    uses = dialogue.tool_uses(_messages(t))
    return uses.select("conversation_id", "call_id", F.col("ord.position").alias("first"), "name",
                       F.get_json_object("result", "$.events[0].id").alias("item_id"), "is_error")


@query("seen_items", f"with {_USES} select * exclude (item_first) from items")
def seen_items(t):
    items, _ = dialogue.seen_items(dialogue.tool_uses(_messages(t)))
    return items.select("conversation_id", "id", "distance_km")


@query("seen_titles", f"with {_USES} select conversation_id, id, title from titles")
def seen_titles(t):
    _, titles = dialogue.seen_items(dialogue.tool_uses(_messages(t)))
    return titles.select("conversation_id", "id", "title")


_REPLIES = """
  select o_orderkey as reply_id, o_custkey % 500 as conversation_id,
    'See ' || a.p_name || ', then the ' || b.p_name || ' ' || b.p_brand || '; or ' || a.p_name || ' ' || b.p_name || '.' as text
  from v_keyed join part a on a.p_partkey = part_key
  join part b on b.p_partkey = (part_key * 7 + 3) % {n}"""


def _replies(t):
    total = t["part"].count()
    return t.sql(_REPLIES.format(n=total))


_KEYED = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_NAMED = f"""{_USES},
  replies as ({_REPLIES.format(n="(select count(*) from part)")}),
  keyed as (select *, {_KEYED.format("title")} as key from titles where length({_KEYED.format("title")}) >= 4),
  keys as (select distinct conversation_id, key from keyed),
  said as (
    select reply_id, conversation_id, key, unnest(list_filter(range(1, length(txt) + 1), lambda p: substr(txt, p, length(key) + 2) = ' ' || key || ' ')) as start
    from (select r.reply_id, r.conversation_id, ' ' || {_KEYED.format("text")} || ' ' as txt, key from replies r join keys k using (conversation_id))),
  spans as (select *, start + length(key) + 2 as stop from said),
  kept as (
    select reply_id, conversation_id, key, min(start) as first from spans s group by 1, 2, 3
    having bool_or(not exists (select 1 from spans o where o.reply_id = s.reply_id and length(o.key) > length(s.key) and o.start <= s.start and o.stop >= s.stop))),
  shown as (
    select conversation_id, key, arg_min(title, (item_first, o)) as title, min(distance_km) as distance_km, min((item_first, o)) as seen_at
    from keyed join items using (conversation_id, id) group by 1, 2)"""


@query("named_items", f"""with {_NAMED}
    select reply_id, conversation_id, key, title, row_number() over (partition by reply_id order by first, seen_at) as rank, distance_km
    from kept join shown using (conversation_id, key)""")
def named_items(t):
    return dialogue.named_items(_replies(t), materialize(dialogue.tool_uses(_messages(t))))[0]


@query("named_item_ids", f"""with {_NAMED}
    select distinct reply_id, key, id from kept join keyed using (conversation_id, key)""")
def named_item_ids(t):
    return dialogue.named_items(_replies(t), materialize(dialogue.tool_uses(_messages(t))))[1]


@query("in_distance_order", f"""with {_NAMED},
    d as (select reply_id, distance_km, lag(distance_km) over (partition by reply_id order by first, seen_at) as before
          from kept join shown using (conversation_id, key) where distance_km is not null)
    select reply_id, bool_and(before is null or before <= distance_km) as in_order from d group by 1 having count(*) >= 2""")
def in_distance_order(t):
    return dialogue.in_distance_order(
        dialogue.named_items(_replies(t), materialize(dialogue.tool_uses(_messages(t))))[0])


# --- checks --------------------------------------------------------------------------------------

_ASKED = """
  select o_orderkey as reply_id, 'k' || o_custkey % 3 as key,
    case o_orderkey % 3 when 0 then 'x:' || o_orderkey when 1 then 'a:' || o_orderkey else 'g:' || (o_orderkey * 10 + 1) end as id,
    case when o_orderkey % 2 = 0 then {from_} end as date_from, case when o_orderkey % 2 = 0 then {to_} end as date_to,
    case when o_orderkey % 5 < 3 then cast(41.38 as double) end as lat, case when o_orderkey % 5 < 3 then cast(2.17 as double) end as lon,
    case when o_orderkey % 5 < 3 then cast(6.5 as double) end as km, o_orderkey % 4 = 1 as free,
    case when o_orderkey % 7 = 0 then {kinds} end as kinds
  from v_keyed"""


@query("off_constraint", f"""with {CANDIDATES},
    asked as ({_ASKED.format(from_="cast(o_orderdate as date) + cast(o_custkey % 50 as int)", to_="cast(o_orderdate as date) + cast(o_custkey % 50 + 2 as int)", kinds="['talk', 'exhibition']")}),
    j as (
      select a.*, c.id is not null as held, c.kind, c.is_free, c.first_day, c.last_day, {lambert("v.lat", "v.lon", "a.lat", "a.lon")} as metres
      from asked a left join candidates c on c.id = a.id left join v_venues v on v.id = c.place_venue_id),
    r as (
      select reply_id, key, 'dates' as "constraint", held and (first_day is null or first_day <= date_to) and (last_day is null or last_day >= date_from) as met from j where date_from is not null
      union all select reply_id, key, 'area', held and coalesce(metres <= km * 1000, false) from j where km is not null
      union all select reply_id, key, 'price', held and is_free is distinct from false from j where free
      union all select reply_id, key, 'kinds', held and list_contains(kinds, kind) from j where kinds is not null)
    select reply_id, key, "constraint" from r group by all having not bool_or(met)""")
def off_constraint(t):
    rows = t.sql(_ASKED.format(
        from_="date_add(cast(o_orderdate as date), cast(o_custkey % 50 as int))",
        to_="date_add(cast(o_orderdate as date), cast(o_custkey % 50 + 2 as int))", kinds="array('talk', 'exhibition')"))
    return dialogue.off_constraint(
        rows.select("reply_id", "key", "id"), rows.drop("key", "id"), candidates(t), t["v_venues"])


_ASKS = """
  select conv_id * 1000 + turn as turn_id, case when turn % 3 = 0 then true when turn % 3 = 1 then false end as searches,
    case when turn % 4 = 0 then {none} when turn % 4 = 1 then {one} when turn % 4 = 2 then {two} end as remembers from conversations"""
_DID = """
  select conv_id * 1000 + turn as turn_id, case when conv_id % 2 = 0 then 'search_events' else 'remember' end as name,
    case when conv_id % 2 = 1 then case when turn % 2 = 0 then 'area' else 'media' end end as topic, conv_id % 5 = 1 as is_error
  from conversations where (conv_id + turn) % 3 <> 0"""


@query("check_failures", f"""
    with turns as ({_ASKS.format(none="[]::varchar[]", one="['media']", two="['media', 'area']")}), did as ({_DID}),
    d as (select turn_id, bool_or(name = 'search_events') as searched,
            coalesce(list_sort(list(distinct topic) filter (name = 'remember' and not is_error)), []) as topics from did group by 1),
    j as (select t.*, coalesce(searched, false) as searched, coalesce(topics, []) as topics from turns t left join d using (turn_id))
    select turn_id, 'did not search' as failure from j where searches and not searched
    union all select turn_id, 'searched again' from j where not searches and searched
    union all select turn_id, 'did not remember ' || r from (select turn_id, unnest(remembers) as r, topics from j) where not list_contains(topics, r)
    union all select turn_id, 'remembered ' || array_to_string(topics, ', ') || ', which it should not have' from j where len(remembers) = 0 and len(topics) > 0""")
def check_failures(t):
    turns = t.sql(_ASKS.format(none="cast(array() as array<string>)", one="array('media')", two="array('media', 'area')"))
    return dialogue.check_failures(turns, t.sql(_DID))


@query("checks_made", f"""
    select turn_id, cast(case when searches is not null then 1 else 0 end + case when remembers is not null then greatest(len(remembers), 1) else 0 end as bigint) as made
    from ({_ASKS.format(none="[]::varchar[]", one="['media']", two="['media', 'area']")})""")
def checks_made(t):
    return dialogue.checks_made(t.sql(_ASKS.format(
        none="cast(array() as array<string>)", one="array('media')", two="array('media', 'area')")))


_EXCHANGES = """
  select event_id, event_id % 6 as named, event_id % 3 as off, case when event_id % 4 <> 0 then event_id % 5 <> 0 end as in_order,
    event_id % 4 as made, event_id % 2 as failed, event_id % 7 as rounds, event_id % 3 as searches, event_id % 2 as truncated,
    cast(user_id as decimal(12,4)) as cost_usd, user_id % 5 as calls, event_id * 37 % 1000 as seconds,
    case when event_id % 9 = 0 then 'max_tokens' else 'end_turn' end as stop_reason, event_id % 50 as tool_errors from events"""
_TOTALS = {
    "exchanges": "count(*)", "named": "sum(named)", "named_max": "max(named)", "off": "sum(off)",
    "ordered": "sum(cast(in_order as int))", "orderable": "count(in_order)", "checks": "sum(made)",
    "checks_met": "sum(made - failed)", "searches": "sum(searches)", "truncated": "sum(truncated)", "cost_usd": "sum(cost_usd)",
    "cost_usd_max": "max(cost_usd)", "model_calls": "sum(calls)", "seconds_max": "max(seconds)", "tool_errors": "sum(tool_errors)",
}


@query("run_summary", f"with x as ({_EXCHANGES}), n as (select seconds, row_number() over (order by seconds) as n, count(*) over () as total from x) " + " union all ".join(
    [f"select '{m}' as metric, cast({e} as double) as value from x" for m, e in _TOTALS.items()]
    + ["select 'rounds_' || rounds, cast(count(*) as double) from x group by rounds",
       "select 'stop_' || stop_reason, cast(count(*) as double) from x where stop_reason <> 'end_turn' group by stop_reason",
       "select 'seconds_p50', cast(min(seconds) as double) from n where n >= ceil(0.5 * total)",
       "select 'seconds_p95', cast(min(seconds) as double) from n where n >= ceil(0.95 * total)"]))
def run_summary(t):
    return dialogue.run_summary(t.sql(_EXCHANGES))
