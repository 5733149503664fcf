"""Entity resolution and feed merges."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vernissage.catalog.registry import query
from vernissage.operators import keyed, matching
from vernissage.plans import sync

RUN = datetime(2002, 1, 1)
_RUN = "timestamp '2002-01-01 00:00:00'"

NORM = lambda c: (f"trim(regexp_replace(replace(lower(strip_accents(replace({c}, '&amp;', '&'))), '&', ' and '), "  # noqa: E731
                  "'[^a-z0-9]+', ' ', 'g'))")
_BASE = lambda c: f"regexp_replace(lower({c}), '-[0-9]+$', '')"

DECIDED = f"""
  t as (select id, lower(slug) as s, {_BASE("slug")} as b, {NORM("name")} as n from v_terms),
  p as (select id, lower(slug) as s, {_BASE("slug")} as b, {NORM("name")} as n from v_profiles),
  hits as (
    select t.id as term_id, 0 as r, p.id as profile_id from t join p on t.s = p.s and t.s <> ''
    union all select t.id, 1, p.id from t join p on t.b = p.b and t.b <> ''
    union all select t.id, 2, p.id from t join p on t.n = p.n and t.n <> ''
    union all select t.id, 3, p.id from t join p on length(p.n) >= 4 and contains(' ' || t.n || ' ', ' ' || p.n || ' ')),
  decided as (
    select term_id, r, count(*) as candidates, min(profile_id) as first_id from hits
    where r = (select min(r) from hits h where h.term_id = hits.term_id) group by term_id, r)"""
_ROUND = "(case r when 0 then 'slug' when 1 then 'base-slug' when 2 then 'name' else 'contains' end)"


@query("match_profiles", f"""with {DECIDED}
    select term_id, first_id as profile_id, {_ROUND} as round from decided where candidates = 1""")
def match_profiles(t):
    return matching.match_profiles(t["v_terms"], t["v_profiles"])[0]


@query("match_ambiguous", f"with {DECIDED} select term_id, {_ROUND} as round, candidates from decided where candidates > 1")
def match_ambiguous(t):
    return matching.match_profiles(t["v_terms"], t["v_profiles"])[1]


@query("match_ambiguous_claims", f"""with {DECIDED},
  keyed as (
    select h.term_id, h.r, h.profile_id, case h.r when 0 then p.s when 1 then p.b else p.n end as key
    from hits h join decided d on d.term_id = h.term_id and d.r = h.r and d.candidates > 1 join p on p.id = h.profile_id)
  select {_ROUND} as round, key, profile_id, count(*) as terms from keyed group by all""")
def match_ambiguous_claims(t):
    return matching.ambiguous_claims(t["v_terms"], t["v_profiles"])


@query("match_ambiguous_keys", f"""with {DECIDED}
  select distinct h.term_id, {_ROUND.replace("case r ", "case h.r ")} as round, case h.r when 0 then p.s when 1 then p.b else p.n end as key
  from hits h join decided d on d.term_id = h.term_id and d.r = h.r and d.candidates > 1 join p on p.id = h.profile_id""")
def match_ambiguous_keys(t):
    return matching.ambiguous_keys(t["v_terms"], t["v_profiles"])


@query("match_rounds", f"""with {DECIDED}
    select ord, round, count(term_id) as matches from (values (0, 'slug'), (1, 'base-slug'), (2, 'name'), (3, 'contains')) v(ord, round)
    left join decided on r = ord and candidates = 1 group by all""")
def match_rounds(t):
    return matching.match_rounds(matching.match_profiles(t["v_terms"], t["v_profiles"])[0])


@query("match_names", f"""
    with k as (select {NORM("name")} as key, count(*) as n, min(id) as term_id from v_terms group by 1)
    select name, case when n = 1 then term_id end as term_id
    from (select upper(p_name) || ', ' || p_brand as name, {NORM("p_name || ' ' || p_brand")} as akey from part) a
    left join k on key = akey""")
def match_names(t):
    asked = t["part"].select(
        F.concat(F.upper("p_name"), F.lit(", "), "p_brand").alias("name"))
    return matching.match_names(t["v_terms"], asked)


# --- merges --------------------------------------------------------------------------------------

_HOST = "regexp_replace(lower(regexp_extract(u, '^https?://(?:[^@/]*@)?([^/:?#]+)', 1)), '^www\\.', '')"
PLANNED = f"""{DECIDED},
  urls as (select id, case when trim(url) = '' then null else trim(url) end as u from v_profiles),
  sorted as (select id, u, u is not null and regexp_matches(u, '^https?://[^/?#]') as web, {_HOST} as h from urls),
  classed as (
    select id, web and (h in ('instagram.com', 'instagr.am') or h like '%.instagram.com' or h like '%.instagr.am') as social, web, u from sorted),
  pilot as (
    select min(id) as id from (select id, {NORM("name")} as key from v_terms)
    where key in (select {NORM("name")} from v_terms where id % 11 = 3) group by key having count(*) = 1),
  planned as (
    select t.id as source_venue_id, name, slug, address, city, province, postcode, lat, lon,
      d.first_id as source_profile_id, case when web and not social then u end as website_url,
      case when social then u end as instagram_url, coalesce(web and not social, false) as crawl_enabled,
      t.id in (select id from pilot) as is_pilot
    from v_terms t left join decided d on d.term_id = t.id and d.candidates = 1 left join classed c on c.id = d.first_id)"""


def planned(t):
    terms = t["v_terms"]
    # Every term is served twice, the first time under another name: the later one wins.
    stale = terms.withColumns({"name": F.concat(F.lit("old "), "name"), "ord": F.col("ord") - 1_000_000_000})
    pilots = terms.filter("id % 11 = 3").select("name")
    return sync.plan_venues(stale.unionByName(terms), t["v_profiles"], pilots)


@query("plan_venues", f"with {PLANNED} select * from planned")
def plan_venues(t):
    return planned(t)


_VALUES = sync.VENUE_VALUES
_DIFF = " or ".join(f"p.{c} is distinct from c.{c}" for c in _VALUES)
_RESET = {"source_profile_id": "null", "website_url": "null", "instagram_url": "null", "crawl_enabled": "false", "is_pilot": "false"}
_MERGED = f"""{PLANNED},
  merged as (
    select coalesce(c.source_venue_id, p.source_venue_id) as source_venue_id,
      case when c.id is null then 'inserted' when p.source_venue_id is not null and ({_DIFF}) then 'changed'
        when p.source_venue_id is null and (c.source_profile_id is not null or c.website_url is not null or c.instagram_url is not null
          or c.crawl_enabled or c.is_pilot) then 'unjoined' else 'kept' end as change,
      {", ".join(f"case when p.source_venue_id is not null then p.{c} else {_RESET.get(c, f'c.{c}')} end as {c}" for c in _VALUES)},
      c.updated_at as was
    from v_now_venues c full outer join planned p on p.source_venue_id = c.source_venue_id)"""


@query("merge_venues", f"""with {_MERGED}
    select source_venue_id, {", ".join(_VALUES)}, change, case when change = 'kept' then was else {_RUN} end as updated_at from merged""")
def merge_venues(t):
    return sync.merge_venues(t["v_now_venues"], planned(t), RUN).drop("id")


@query("merge_venues_counts", f"with {_MERGED} select change, count(*) as rows from merged group by change")
def merge_venues_counts(t):
    return sync.change_counts(sync.merge_venues(t["v_now_venues"], planned(t), RUN))


@query("join_changes", f"""with {PLANNED}
    select coalesce(b.source_venue_id, a.source_venue_id) as source_venue_id,
      case when b.source_profile_id is null then 'gained' when a.source_profile_id is null then 'lost' else 'moved' end as change,
      b.source_profile_id as was, a.source_profile_id as now
    from (select * from v_now_venues where source_profile_id is not null) b
    full outer join (select * from planned where source_profile_id is not null) a on a.source_venue_id = b.source_venue_id
    where a.source_profile_id is distinct from b.source_profile_id""")
def join_changes(t):
    return sync.join_changes(t["v_now_venues"], planned(t))


_N = "cast(count(*) filter ({}) as bigint)"
_JOINED = "source_profile_id is not null"
_METRICS = {
    "venues": "true", "with_point": "lat is not null", "without_point": "lat is null", "joined": _JOINED,
    "website": f"{_JOINED} and website_url is not null", "instagram": f"{_JOINED} and instagram_url is not null",
    "blank_url": f"{_JOINED} and website_url is null and instagram_url is null", "pilots": "is_pilot",
    "pilots_crawlable": "is_pilot and crawl_enabled", "pilots_no_profile": f"is_pilot and not ({_JOINED})",
    "pilots_instagram_only": f"is_pilot and {_JOINED} and instagram_url is not null",
    "pilots_blank_url": f"is_pilot and {_JOINED} and website_url is null and instagram_url is null",
}


@query("sync_summary", f"with {PLANNED} " + " union all ".join(
    f"select '{m}' as metric, {_N.format(c)} as value from planned" for m, c in _METRICS.items()) + f"""
    union all select 'ambiguous', count(*) from decided where candidates > 1
    union all select 'round_' || round, count(term_id) from (values (0, 'slug'), (1, 'base-slug'), (2, 'name'), (3, 'contains')) v(ord, round)
      left join decided on r = ord and candidates = 1 group by round""")
def sync_summary(t):
    return sync.sync_summary(planned(t), t["v_terms"], t["v_profiles"])


_EVENTS = "title, title_en, source_category_id, is_free, price_min, price_max, is_online, source_url, web_url_ca, web_url_es, web_url_en"


def _fetched(t):
    """Two rows a post; every seventh post is not served; some name a venue nobody knows."""
    posts = t["v_snapshots"].filter("id % 7 <> 0").select(
        "source_event_id", F.when(F.col("id") % 19 == 0, F.col("venue_id") + 5_000_000).otherwise(F.col("venue_id")).alias("source_venue_id"),
        *(c.strip() for c in _EVENTS.split(",")), F.lit(None).cast("timestamp_ntz").alias("source_modified_at"),
        F.lit(1).alias("ord"))
    return posts.withColumns({"title": F.concat("title", F.lit(" (old)")), "ord": F.lit(0)}).unionByName(posts)


_FETCHED = f"""
  fetched as (
    select source_event_id, v.id as venue_id, {_EVENTS}
    from v_snapshots s left join v_venues v on s.id % 19 <> 0 and v.id = s.venue_id where s.id % 7 <> 0),
  stored as (select * from v_snapshots where id % 5 <> 0)"""


def _stored(t):
    return t["v_snapshots"].filter("id % 5 <> 0").withColumn("source_modified_at", F.lit(None).cast("timestamp_ntz"))


@query("merge_events", f"""with {_FETCHED}
    select coalesce(f.source_event_id, s.source_event_id) as source_event_id,
      {", ".join(f"case when f.source_event_id is not null then f.{c.strip()} else s.{c.strip()} end as {c.strip()}" for c in ("venue_id, " + _EVENTS).split(","))},
      coalesce(s.first_seen_at, {_RUN}) as first_seen_at,
      case when f.source_event_id is not null then {_RUN} else s.last_seen_at end as last_seen_at
    from stored s full outer join fetched f on f.source_event_id = s.source_event_id""")
def merge_events(t):
    rows, _ = sync.event_rows(_fetched(t), t["v_venues"])
    return sync.merge_events(_stored(t), rows, RUN).drop("id", "source_modified_at")


@query("unknown_venue_events", "select source_event_id from v_snapshots where id % 7 <> 0 and id % 19 = 0 and venue_id is not null")
def unknown_venue_events(t):
    return sync.event_rows(_fetched(t), t["v_venues"])[1]


@query("merge_occurrences", f"""
    with f as (
      select source_occurrence_id, s.id as event_id, o.starts_at + interval 1 hour as starts_at, o.ends_at
      from v_occurrences o join v_snapshots s on s.id = o.event_id where o.id % 3 <> 0),
    c as (select * from v_occurrences where id % 4 <> 0)
    select coalesce(f.source_occurrence_id, c.source_occurrence_id) as source_occurrence_id,
      case when f.event_id is not null then f.event_id else c.event_id end as event_id,
      case when f.event_id is not null then f.starts_at else c.starts_at end as starts_at,
      case when f.event_id is not null then f.ends_at else c.ends_at end as ends_at,
      case when f.event_id is not null then {_RUN} else c.last_seen_at end as last_seen_at
    from c full outer join f on f.source_occurrence_id = c.source_occurrence_id""")
def merge_occurrences(t):
    held = t["v_occurrences"]
    posts = t["v_snapshots"].select(F.col("id").alias("event_id"), "source_event_id")
    served = held.filter("id % 3 <> 0").join(posts, "event_id")
    first = served.select("source_occurrence_id", "source_event_id", "starts_at", "ends_at", F.lit(0).alias("ord"))
    later = served.select("source_occurrence_id", "source_event_id",
                          F.expr("starts_at + INTERVAL 1 HOUR").alias("starts_at"), "ends_at", F.lit(1).alias("ord"))
    none = first.withColumn("source_occurrence_id", F.lit(None).cast("long"))
    fetched = first.unionByName(later).unionByName(none)
    return sync.merge_occurrences(held.filter("id % 4 <> 0"), fetched, t["v_snapshots"], RUN).drop("id")


@query("overlay_occurrences", """
    with listed as (select event_id, id, starts_at, ends_at from v_occurrences where id % 2 = 0),
    own as (select event_id, id, starts_at + interval 2 hour as starts_at, ends_at from v_occurrences
            where id % 3 = 0 and event_id in (select event_id from listed)),
    posts as (select event_id, max(id) as served from listed group by 1)
    select event_id as source_event_id, id as source_occurrence_id, starts_at, ends_at, id as served from listed
      where id not in (select id from own)
    union all select event_id, id, starts_at, ends_at, served from own join posts using (event_id)""")
def overlay_occurrences(t):
    o = t["v_occurrences"].select(F.col("event_id").alias("source_event_id"), F.col("id").alias("source_occurrence_id"),
                                  "starts_at", "ends_at")
    listed = o.filter("source_occurrence_id % 2 = 0").withColumns(
        {"served": F.col("source_occurrence_id"), "ord": F.col("source_occurrence_id")})
    own = o.filter("source_occurrence_id % 3 = 0").withColumn("starts_at", F.expr("starts_at + INTERVAL 2 HOURS"))
    return sync.overlay_occurrences(listed, own).drop("ord")


# --- keyed tables --------------------------------------------------------------------------------


@query("append_absent_users", """
    select 'web' as client, cast(user_id as varchar) as external_id from events where user_id % 2 = 0 group by 1, 2
    union select 'web', cast(user_id as varchar) from events where user_id % 3 = 0""")
def append_absent_users(t):
    from vernissage.plans.interactions import add_users

    seen = t["events"].select(F.lit("web").alias("client"), F.col("user_id").cast("string").alias("external_id"), "user_id")
    held = seen.filter("user_id % 2 = 0").select("client", "external_id").distinct()
    return add_users(held, seen.filter("user_id % 3 = 0"))


@query("last_per_key", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey from (
      select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc) as n
      from lineitem) where n = 1""")
def last_per_key(t):
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return keyed.last_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).drop("l_shipdate")
