"""Read surface: browse, search, hydrate, places."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.catalog.registry import query
from vernissage.operators import matching, nearby, places
from vernissage.plans import browse, search
from vernissage.session import materialize

NOT_OVER = date(1998, 3, 5)


@query("browse_venues", """
    select v.id, v.name, v.city, v.website_url, v.instagram_url, v.crawl_enabled, v.is_pilot,
      v.lat as latitude, v.lon as longitude, coalesce(p.n, 0) as pages, coalesce(x.n, 0) as exhibitions,
      coalesce(a.n, 0) as events
    from v_venues v
    left join (select venue_id, count(*) n from v_pages group by 1) p on p.venue_id = v.id
    left join (select venue_id, count(*) n from v_exhibitions group by 1) x on x.venue_id = v.id
    left join (select venue_id, count(*) n from v_art_events group by 1) a on a.venue_id = v.id
    where v.is_pilot order by name, id limit 100""")
def browse_venues(t):
    return browse.venues(t["v_venues"], t["v_pages"], t["v_exhibitions"], t["v_art_events"], limit=100)


@query("browse_seeds", """
    select venue_id, v.name as venue_name, url, page_type, confidence, dated_items, language, status,
      model, discovered_at
    from v_seeds s join v_venues v on v.id = s.venue_id order by venue_name, url""")
def browse_seeds(t):
    return browse.seeds(t["v_seeds"], t["v_venues"], limit=None)


@query("browse_pages", r"""
    select p.id, venue_id, v.name as venue_name, url, kind, status, http_status, content_hash, fetched_at,
      raw_text is not null as text_held,
      cast(len(string_split_regex(trim(raw_text, e' \n\r\t'), '\s+')) as bigint) as words,
      cast(len(links) as bigint) as link_count, extract_status, extract_version, extract_model,
      extracted_items, extracted_at, coalesce(extracted_hash = content_hash, false) as text_extracted
    from v_pages p join v_venues v on v.id = p.venue_id""")
def browse_pages(t):
    return browse.pages(t["v_pages"], t["v_venues"], limit=None)


_ITEM = """i.id, venue_id, v.name as venue_name, title, array_to_string(artists, '|') as artists, start_date,
    end_date, at_venue, detail_url, summary_en, array_to_string(themes, '|') as themes,
    array_to_string(media, '|') as media, confidence, source_url, content_hash, model, extract_version,
    first_seen_at, last_seen_at"""


def _flat(df):
    """Arrays as text, for a comparison that sorts and hashes values."""
    return df.withColumns({c: F.concat_ws("|", c) for c in ("artists", "themes", "media")})


@query("browse_exhibitions", f"""
    select {_ITEM} from v_exhibitions i join v_venues v on v.id = venue_id
    where coalesce(end_date, date '1998-03-05') >= date '1998-03-05'""")
def browse_exhibitions(t):
    return _flat(browse.exhibitions(t["v_exhibitions"], t["v_venues"], not_over_on=NOT_OVER, limit=None))


@query("browse_exhibitions_titled", f"""
    select {_ITEM} from v_exhibitions i join v_venues v on v.id = venue_id
    where contains(lower(title), 'ring') order by v.name, start_date nulls last, i.id limit 100""")
def browse_exhibitions_titled(t):
    return _flat(browse.exhibitions(t["v_exhibitions"], t["v_venues"], title="RING", limit=100))


@query("browse_art_events", f"""
    select {_ITEM}, kind, start_time, exhibition_id from v_art_events i join v_venues v on v.id = venue_id
    where coalesce(end_date, start_date, date '1998-03-05') >= date '1998-03-05'""")
def browse_art_events(t):
    return _flat(browse.art_events(t["v_art_events"], t["v_venues"], not_over_on=NOT_OVER, limit=None))


_LOCAL = "cast(({}) at time zone 'UTC' at time zone 'Europe/Madrid' as date)"


@query("browse_feed_events", f"""
    select s.id as event_id, source_event_id, s.venue_id, v.name as venue_name, title, title_en, starts_at,
      ends_at, is_free, price_min, price_max, is_online, source_url, web_url_ca, web_url_es, web_url_en,
      s.last_seen_at
    from v_snapshots s join v_occurrences o on o.event_id = s.id left join v_venues v on v.id = s.venue_id
    where {_LOCAL.format("coalesce(ends_at, starts_at)")} >= date '1998-03-05'""")
def browse_feed_events(t):
    return browse.feed_events(t["v_snapshots"], t["v_occurrences"], t["v_venues"],
                              not_over_on=NOT_OVER, limit=None)


# --- search --------------------------------------------------------------------------------------

_KIND = "case source_category_id " + " ".join(
    f"when {k} then '{kind}'" for k, (_, kind) in vocab.CATEGORIES.items()) + " else 'other' end"
_SLUG = "case source_category_id " + " ".join(
    f"when {k} then '{slug}'" for k, (slug, _) in vocab.CATEGORIES.items()) + " end"


def _key(c: str) -> str:
    return (f"trim(regexp_replace(replace(strip_accents(lower({c})), '&', ' and '), "
            r"'[^\p{L}\p{N}]+', ' ', 'g'))")


CANDIDATES = f"""
  extracted as (
    select 'x:' || id as id, 'exhibition' as kind, title, venue_id, start_date as first_day, end_date as last_day,
      at_venue, artists, media, themes from v_exhibitions
    union all
    select 'a:' || id, kind, title, venue_id, start_date, coalesce(end_date, start_date), at_venue, artists, media,
      themes from v_art_events where start_date is not null or end_date is not null),
  runs as (
    select e.*, v.source_profile_id as profile, {_key("title")} as key
    from extracted e join v_venues v on v.id = e.venue_id),
  live as (
    select o.id as occurrence_id, s.title, s.title_en, s.venue_id, v.name as venue, v.source_profile_id as profile,
      s.is_free, coalesce(s.is_online, false) = false as at_venue, {_KIND} as kind, {_SLUG} as category,
      {_LOCAL.format("o.starts_at")} as first_day, {_LOCAL.format("coalesce(o.ends_at, o.starts_at)")} as last_day,
      {_key("s.title")} as k1, {_key("s.title_en")} as k2
    from v_occurrences o join v_snapshots s on s.id = o.event_id left join v_venues v on v.id = s.venue_id
    where o.last_seen_at = s.last_seen_at and s.last_seen_at = (select max(last_seen_at) from v_snapshots)),
  twins as (
    select distinct occurrence_id from (
      select l.* from live l join runs r on r.venue_id = l.venue_id and r.key = l.k1
        and coalesce(r.first_day, date '1000-01-01') <= l.last_day and coalesce(r.last_day, date '9000-01-01') >= l.first_day
      union all
      select l.* from live l join runs r on r.venue_id = l.venue_id and r.key = l.k2
        and coalesce(r.first_day, date '1000-01-01') <= l.last_day and coalesce(r.last_day, date '9000-01-01') >= l.first_day
      union all
      select l.* from live l join runs r on r.profile = l.profile and r.key = l.k1
        and coalesce(r.first_day, date '1000-01-01') <= l.last_day and coalesce(r.last_day, date '9000-01-01') >= l.first_day
      union all
      select l.* from live l join runs r on r.profile = l.profile and r.key = l.k2
        and coalesce(r.first_day, date '1000-01-01') <= l.last_day and coalesce(r.last_day, date '9000-01-01') >= l.first_day)),
  candidates as (
    select e.id, e.kind, cast(null as varchar) as category, e.title, e.venue_id, v.name as venue, e.first_day, e.last_day,
      e.at_venue, cast(null as boolean) as is_free, artists, media, themes, case when e.at_venue then e.venue_id end as place_venue_id
    from extracted e join v_venues v on v.id = e.venue_id
    union all
    select 'g:' || occurrence_id, kind, category, title, venue_id, venue, first_day, last_day, at_venue, is_free,
      [], [], [], case when at_venue then venue_id end
    from live where occurrence_id not in (select occurrence_id from twins))"""


def candidates(t):
    return search.candidates(
        t["v_venues"], t["v_exhibitions"], t["v_art_events"], t["v_snapshots"], t["v_occurrences"])


@query("feed_twins", f"with {CANDIDATES} select occurrence_id from twins")
def feed_twins(t):
    feed = search.live_feed(t["v_snapshots"], t["v_occurrences"])
    extracted = search._extracted(t["v_exhibitions"], t["v_art_events"])
    return search.feed_twins(feed, extracted, t["v_venues"]).distinct()


_FLAT = """array_to_string(artists, '|') as artists, array_to_string(media, '|') as media,
    array_to_string(themes, '|') as themes"""


@query("search_candidates", f"""with {CANDIDATES}
    select id, kind, category, title, venue_id, venue, first_day, last_day, at_venue, is_free, {_FLAT}, place_venue_id
    from candidates""")
def search_candidates(t):
    return _flat(candidates(t))


def lambert(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The distance in metres as SQL text, for the oracle only."""
    b = lambda lat: f"atan((1 - 1 / 298.257223563::double) * tan(radians({lat})))"
    b1, b2 = b(lat1), b(lat2)
    half = (f"(pow(sin(({b2} - {b1}) / 2), 2) + cos({b1}) * cos({b2}) * "
            f"pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    s = f"(2 * asin(least(sqrt({half}), 1.0::double)))"
    p, q = f"(({b1} + {b2}) / 2)", f"(({b2} - {b1}) / 2)"
    x = f"({s} - sin({s})) * pow(sin({p}) * cos({q}), 2) / pow(cos({s} / 2), 2)"
    y = f"({s} + sin({s})) * pow(cos({p}) * sin({q}), 2) / pow(sin({s} / 2), 2)"
    return (f"(case when {half} = 0 then 0.0::double when {half} > 0 then 6378137.0::double * "
            f"({s} - (1 / 298.257223563::double / 2) * ({x} + {y})) end)")


_KM = "cast(round(cast(metres / 1000 as decimal(20,10)), 1) as double)"

MATCHED = f"""{CANDIDATES},
  asked as (
    select r.* exclude (lat, lon), coalesce(r.lat, p.lat) as lat, coalesce(r.lon, p.lon) as lon
    from v_requests r left join v_places p on lower(replace(p.name, '_', ' ')) = r.near),
  placed as (
    select r.request_id, r.rows, r.date_from, r.radius_km, c.*,
      case when r.lat is not null then {lambert("v.lat", "v.lon", "r.lat", "r.lon")} end as metres
    from asked r join candidates c
      on (c.first_day is null or c.first_day <= r.date_to) and (c.last_day is null or c.last_day >= r.date_from)
      and (r.kinds is null or list_contains(r.kinds, c.kind)) and (not r.free_only or c.is_free is distinct from false)
    left join v_venues v on v.id = c.place_venue_id),
  matched as (
    select *, {_KM} as distance_km from placed where radius_km is null or metres <= radius_km * 1000)"""


def requests(t):
    names = places.place_names(t["v_places"], t["v_venues"])
    return materialize(search.check_requests(t["v_requests"], names)[0])


@query("search", f"""with {MATCHED},
  ranked as (
    select *, count(*) over (partition by request_id) as total, row_number() over (partition by request_id
      order by distance_km nulls last, last_day nulls last, first_day nulls first, id) as position from matched)
  select request_id, position, total, id, kind, category, title, venue, first_day as start, last_day as end,
    cast(last_day - date_from as bigint) as ends_in_days, distance_km, at_venue, is_free, {_FLAT}
  from ranked where position <= rows""")
def search_many(t):
    return _flat(search.search(requests(t), materialize(candidates(t)), t["v_venues"]))


@query("search_totals", f"""with {MATCHED}
  select r.request_id, count(m.id) as total, least(count(m.id), 40) as returned, count(m.id) > 40 as truncated
  from v_requests r left join matched m on m.request_id = r.request_id group by 1""")
def search_totals(t):
    counted = search.search_totals(requests(t), materialize(candidates(t)), t["v_venues"])
    return counted.withColumn("returned", F.col("returned").cast("long"))


_BAD = """
  select request_id, case request_id % 7
      when 0 then 'dates reversed' when 1 then 'lat and lon come together' when 2 then 'near or lat and lon, not both'
      when 3 then 'radius without a point' when 4 then 'unknown kind' when 5 then 'several places' else 'unknown place' end
    as reason from v_requests"""


@query("search_refusals", _BAD)
def search_refusals(t):
    r = t["v_requests"]
    case = F.col("request_id") % 7
    none = F.lit(None)
    text, number = none.cast("string"), none.cast("double")
    bad = r.select(
        "request_id",
        F.when(case == 0, F.date_add("date_to", 1)).otherwise(F.col("date_from")).alias("date_from"),
        "date_to",
        F.when(case == 2, "nation 1").when(case == 5, "nation").when(case == 6, "nowhere at all")
        .otherwise(text).alias("near"),
        F.when(case.isin(1, 2), F.lit(41.3)).otherwise(number).alias("lat"),
        F.when(case == 2, F.lit(2.1)).otherwise(number).alias("lon"),
        F.when(case == 3, F.lit(5.0)).otherwise(number).alias("radius_km"),
        F.when(case == 4, F.array(F.lit("party"))).alias("kinds"),
        "free_only", "rows",
    )
    return search.check_requests(bad, places.place_names(t["v_places"], t["v_venues"]), vocab.MAX_SEARCH_ROWS)[1]


# --- hydrate -------------------------------------------------------------------------------------

_PRICE = "cast(null as decimal(8,2))"
DETAILS = f"""
  details as (
    select 'x:' || i.id as id, 'exhibition' as kind, cast(null as varchar) as category, title, cast(null as varchar) as title_en,
      {_FLAT}, summary_en, start_date as start, end_date as end, cast(null as varchar) as start_time, at_venue,
      cast(null as boolean) as is_free, {_PRICE} as price_min, {_PRICE} as price_max, detail_url as url, source_url,
      cast(null as varchar) as exhibition_id, v.id as venue_id, v.name as venue, address, city, website_url as website
    from v_exhibitions i join v_venues v on v.id = i.venue_id
    union all
    select 'a:' || i.id, kind, null, title, null, {_FLAT}, summary_en, start_date, coalesce(end_date, start_date), start_time,
      at_venue, null, null, null, detail_url, source_url, 'x:' || exhibition_id, v.id, v.name, address, city, website_url
    from v_art_events i join v_venues v on v.id = i.venue_id
    union all
    select 'g:' || o.id, {_KIND}, {_SLUG}, title, title_en, '', '', '', null, {_LOCAL.format("o.starts_at")},
      {_LOCAL.format("coalesce(o.ends_at, o.starts_at)")},
      strftime(o.starts_at at time zone 'UTC' at time zone 'Europe/Madrid', '%H:%M:%S'), coalesce(is_online, false) = false,
      is_free, price_min, price_max, coalesce(web_url_en, web_url_es, web_url_ca), source_url, null, v.id, v.name, address,
      city, website_url
    from v_occurrences o join v_snapshots s on s.id = o.event_id left join v_venues v on v.id = s.venue_id)"""

_ASKED = """
  asked as (
    select s_suppkey as request_id, unnest([0, 1, 2, 3]) as position,
      unnest(['x:' || (s_suppkey * 3), 'a:' || (s_suppkey * 3 + 1), 'g:' || ((s_suppkey * 3 + 2) * 10 + 1),
              'x:' || (s_suppkey * 3 + 1)]) as id from supplier)"""


def _hydrate_requests(t):
    k = F.col("s_suppkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    return t["supplier"].select(k.alias("request_id"), F.array(
        text("x:00", k * 3), text("a:", k * 3 + 1), text("x:", k * 3), text("g:0", (k * 3 + 2) * 10 + 1),
        text("x:", k * 3 + 1)).alias("ids"))


def _details(t):
    return search.details(
        t["v_venues"], t["v_exhibitions"], t["v_art_events"], t["v_snapshots"], t["v_occurrences"])


@query("hydrate", f"""with {DETAILS}, {_ASKED}
    select request_id, cast(position as bigint) as position, d.* from asked join details d using (id)""")
def hydrate(t):
    return _flat(search.hydrate(_hydrate_requests(t), _details(t), vocab.MAX_HYDRATE))


@query("hydrate_not_found", f"""with {DETAILS}, {_ASKED}
    select request_id, cast(position as bigint) as position, id from asked where id not in (select id from details)""")
def hydrate_not_found(t):
    return search.not_found(_hydrate_requests(t), _details(t), vocab.MAX_HYDRATE)


# --- places and distance -------------------------------------------------------------------------

_NAMES = f"""
  labels_ as (
    select kind, id, name, within, lat, lon, unnest(list_prepend(name, aliases)) as label, false as whole_only from v_places
    union all select kind, id, name, within, lat, lon, name || ', ' || within, true from v_places
    union all select 'venue', id, name, city, lat, lon, name, false from v_venues where lat is not null
    union all select 'venue', id, name, city, lat, lon, name || ', ' || city, true from v_venues where lat is not null),
  names as (select *, {_key("label")} as key from labels_)"""

_ASK_PLACES = """
  select s_name as asked from supplier union select s_name || ', ' || n_name from supplier, nation where s_nationkey = n_nationkey
  union select lower(n_name) from nation union select 'N ' || n_name from nation union select r_name from region
  union select substr(s_name, 10) from supplier union select substr(lower(n_name), 1, 6) from nation union select c_name from customer
  union select n_name || ' NATION' from nation union select p_name from part union select substr('##' || r_name, 1, 2) from region"""


@query("resolve_places", f"""with {_NAMES}, asked_ as ({_ASK_PLACES}),
  asked as (select asked, {_key("asked")} as akey from asked_),
  hits as (
    select a.asked, n.kind, n.id, n.name, n.within, n.lat, n.lon, min(case when n.key = a.akey then 0 else 1 end) as tier
    from asked a join names n on a.akey <> '' and (n.key = a.akey or (not n.whole_only and length(a.akey) >= 4
      and list_has_all(string_split(n.key, ' '), string_split(a.akey, ' '))))
    group by all),
  ranked as (
    select *, min(tier) over (partition by asked) as best, row_number() over w as position,
      first_value(lat) over w as lat0, first_value(lon) over w as lon0 from hits
    window w as (partition by asked order by tier, case kind when 'barri' then 0 when 'district' then 1
      when 'municipality' then 2 else 3 end, length(name), name, kind, id)),
  near as (
    select *, bool_and({lambert("lat", "lon", "lat0", "lon0")} <= 1500) over (partition by asked) as one_spot
    from ranked where tier = best)
  select a.asked, case when position is null then 'unknown' when one_spot then 'place' else 'candidates' end as status,
    position, name, kind, within, case when within is not null then name || ', ' || within else name end as qualified, lat, lon
  from asked a left join (select * from near where position <= 10 and (not one_spot or position = 1)) n using (asked)""")
def resolve_places(t):
    asked = t.sql(_ASK_PLACES)
    return places.resolve_places(asked, places.place_names(t["v_places"], t["v_venues"]), most=vocab.MAX_PLACE_CANDIDATES)


@query("within_radius", f"""
    select r.request_id, v.id as venue_id, cast(round(cast({lambert("v.lat", "v.lon", "r.lat", "r.lon")} as decimal(20,6)), 1) as double) as metres
    from v_requests r join v_venues v on r.lat is not null and r.radius_km is not null
      and {lambert("v.lat", "v.lon", "r.lat", "r.lon")} <= r.radius_km * 1000""")
def within_radius(t):
    return nearby.within_radius(_centers(t), _points(t), shown=_tenths).select("request_id", "venue_id", "metres")


@query("nearest_first", f"""
    select request_id, venue_id, metres, position from (
      select *, row_number() over (partition by request_id order by full_m, venue_id) as position from (
        select r.request_id, v.id as venue_id, {lambert("v.lat", "v.lon", "r.lat", "r.lon")} as full_m,
          cast(round(cast(full_m as decimal(20,6)), 1) as double) as metres
        from v_requests r join v_venues v on r.lat is not null and r.radius_km is not null
        where full_m <= r.radius_km * 1000))
    where position <= 5""")
def nearest_first(t):
    found = nearby.nearest_first(_centers(t), _points(t), "request_id", "venue_id", 5)
    return _metres(found, "position")


def _centers(t):
    return t["v_requests"].filter("lat IS NOT NULL AND radius_km IS NOT NULL").select(
        "request_id", "lat", "lon", (F.col("radius_km") * 1000).alias("radius_m"))


def _points(t):
    return t["v_venues"].select(F.col("id").alias("venue_id"), "lat", "lon")


def _tenths(metres):
    return F.round(metres.cast("decimal(20,6)"), 1).cast("double")


def _metres(df, *more):
    return df.select("request_id", "venue_id", _tenths(F.col("metres")).alias("metres"),
                     *(F.col(c).cast("long").alias(c) for c in more))


@query("merge_spots", f"""
    select city, first_id, one_spot from (
      select city, min(id0) as first_id, bool_and({lambert("lat", "lon", "lat0", "lon0")} <= 5000) as one_spot from (
        select *, first_value(id) over w as id0, first_value(lat) over w as lat0, first_value(lon) over w as lon0
        from v_venues where lat is not null window w as (partition by city order by name, id)) group by city)""")
def merge_spots(t):
    return nearby.one_spot(t["v_venues"].filter("lat IS NOT NULL"), "city", ["name", "id"], 5000.0)
