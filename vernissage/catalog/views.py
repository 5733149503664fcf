"""The package's tables derived from the generic test tables, by one formula for both engines.

Each view is SQL text rendered once for Spark and once for DuckDB; the two differ only in the few
functions of `Dialect`. Views read whole tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)




class Dialect:
    def __init__(self, name: str) -> None:
        self.duck = name == "duckdb"

    def add_days(self, day: str, n: str) -> str:
        return f"({day} + cast({n} as int))" if self.duck else f"date_add({day}, cast({n} as int))"

    def add_hours(self, ts: str, n: str) -> str:
        if self.duck:
            return f"({ts} + to_hours(cast({n} as int)))"
        return f"({ts} + make_dt_interval(0, cast({n} as int)))"

    def add_minutes(self, ts: str, n: str) -> str:
        if self.duck:
            return f"({ts} + to_minutes(cast({n} as int)))"
        return f"({ts} + make_dt_interval(0, 0, cast({n} as int)))"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))" if self.duck else f"(({a}) div ({b}))"

    def strings(self, *items: str) -> str:
        inner = ", ".join(items)
        if self.duck:
            return f"[{inner}]::varchar[]"
        return f"cast(array({inner}) as array<string>)"

    def links(self, url: str) -> str:
        if self.duck:
            return f"[{{'number': 1, 'url': {url}, 'text': 'a link'}}]"
        return f"array(named_struct('number', 1, 'url', {url}, 'text', 'a link'))"

    def sha256(self, c: str) -> str:
        return f"sha256({c})" if self.duck else f"sha2({c}, 256)"

    def ts(self, text: str) -> str:
        return f"timestamp '{text}'" if self.duck else f"timestamp_ntz '{text}'"

    @property
    def no_text(self) -> str:
        return "cast(null as varchar)" if self.duck else "cast(null as string)"


def _pick(key: str, *values: str) -> str:
    whens = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"(case ({key}) % {len(values)} {whens} end)"


def _quoted(*values: str) -> list[str]:
    return [f"'{v}'" for v in values]


def views(d: Dialect) -> dict[str, str]:
    """View name -> SELECT, each reading base tables or views named before it."""
    from vernissage import vocab

    event_kind = _pick("o_orderkey", *_quoted(*vocab.EVENT_KINDS))
    category = _pick("o_orderkey", *map(str, [*vocab.CATEGORIES, 999]))
    media = lambda key: d.strings(_pick(key, *_quoted(*vocab.MEDIA)))
    end, first = ('"end"', 1) if d.duck else ("`end`", 0)
    no_price = "cast(null as decimal(8,2))"
    extracted = f"""
        venue_id, title, lower(title) as title_key, {d.strings("brand")} as artists,
        start_date, end_date, at_venue,
        case when id % 5 <> 0 then 'https://www.site' || (venue_id % 30) || '.example/show/' || (id % 50) end as detail_url,
        'Shown by ' || brand as summary_en,
        {d.strings("lower(brand)")} as themes, {media("id")} as media,
        {_pick("id", "'high'", "'medium'", "'low'")} as confidence,
        'https://www.site' || (venue_id % 30) || '.example/list' as source_url,
        {d.sha256("title")} as content_hash, 'm1' as model, 3 as extract_version,
        {d.ts("2001-01-01 00:00:00")} as first_seen_at, {d.ts("2001-08-02 00:00:00")} as last_seen_at"""
    return {
        "v_venues": f"""
            select s_suppkey as id, s_suppkey as source_venue_id,
              case when s_suppkey % 5 <> 0 then s_suppkey % 40 end as source_profile_id,
              s_name as name, lower(s_name) as slug, 'Street ' || s_suppkey as address, n_name as city,
              case when s_suppkey % 25 <> 0 then cast(41.30 as double) + ((s_suppkey * 37) % 200) / cast(1000 as double) end as lat,
              case when s_suppkey % 25 <> 0 then cast(2.05 as double) + ((s_suppkey * 53) % 200) / cast(1000 as double) end as lon,
              case when s_suppkey % 9 <> 0 then 'https://www.site' || (s_suppkey % 30) || '.example/' end as website_url,
              case when s_suppkey % 18 = 9 then 'https://instagram.com/v' || s_suppkey end as instagram_url,
              s_suppkey % 9 <> 0 as crawl_enabled, s_suppkey % 5 = 1 as is_pilot
            from supplier join nation on s_nationkey = n_nationkey""",
        "v_places": f"""
            select 'municipality' as kind, cast(n_nationkey as bigint) as id, cast(n_nationkey as {"varchar" if d.duck else "string"}) as code,
              n_name as name, {d.strings("'N ' || n_name")} as aliases, r_name as within,
              cast(41.30 as double) + (n_nationkey * 7 % 25) / cast(100 as double) as lat,
              cast(2.05 as double) + (n_nationkey * 11 % 25) / cast(100 as double) as lon
            from nation join region on n_regionkey = r_regionkey
            union all
            select 'district', cast(r_regionkey as bigint), cast(r_regionkey as {"varchar" if d.duck else "string"}),
              r_name, {d.strings("'Nation of ' || r_name")}, 'World',
              cast(41.35 as double) + r_regionkey / cast(1000 as double), cast(2.15 as double) from region""",
        "v_keyed": f"""
            select o_orderkey, o_custkey, o_orderdate, o_orderstatus,
              o_orderkey % (select count(*) from part) as part_key,
              o_custkey % (select count(*) from supplier) as venue_id from orders""",
        "v_items": f"""
            select o_orderkey, o_orderkey as id, o_orderstatus, o_custkey, venue_id, p_name as title, p_brand as brand,
              case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end as start_date,
              case when o_orderkey % 7 <> 0 then {d.add_days("cast(o_orderdate as date)", "o_custkey % 60")} end as end_date,
              o_orderkey % 10 <> 0 as at_venue
            from v_keyed join part on part_key = p_partkey""",
        "v_exhibitions": f"select id, {extracted} from v_items where o_orderkey % 3 = 0",
        "v_art_events": f"""
            select id, {extracted}, {event_kind} as kind,
              case when id % 4 <> 0 then {_pick("id", "'10:00'", "'18:30'", "'19:00'")} end as start_time,
              case when id % 2 = 0 then id - 1 end as exhibition_id
            from v_items where o_orderkey % 3 = 1""",
        "v_snapshots": f"""
            select id, id + 90000 as source_event_id, case when id % 17 <> 0 then venue_id end as venue_id,
              case when id % 4 = 0 then 'El ' || title else title end as title,
              case when id % 4 = 0 then upper(title) || '!' end as title_en,
              {category} as source_category_id,
              case {d.idiv("o_orderkey", "3")} % 3 when 1 then true when 2 then false end as is_free,
              case when id % 6 = 5 then cast(id % 40 as decimal(8,2)) else {no_price} end as price_min,
              case when id % 6 = 5 then cast(id % 40 + 5 as decimal(8,2)) else {no_price} end as price_max,
              case when id % 13 = 0 then true when id % 2 = 0 then false end as is_online,
              'https://feed.example/e/' || id as source_url,
              case when id % 3 = 2 then 'https://www.site' || (venue_id % 30) || '.example/ca/' || (id % 40) end as web_url_ca,
              case when id % 4 = 1 then 'https://site' || (venue_id % 30) || '.example/es/' || (id % 40) end as web_url_es,
              case when id % 5 = 1 then 'https://other.example/en/' || id end as web_url_en,
              {d.ts("2001-01-01 00:00:00")} as first_seen_at,
              case when o_orderstatus <> 'P' then {d.ts("2001-08-02 00:00:00")} else {d.ts("2001-07-01 00:00:00")} end as last_seen_at
            from v_items where o_orderkey % 3 = 2""",
        "v_line_keys": f"""
            select l_orderkey, l_linenumber, min(l_shipdate) as shipped, max(l_returnflag) as flag
            from lineitem where l_orderkey % 3 = 2 group by l_orderkey, l_linenumber""",
        "v_timed": f"""
            select l_orderkey, l_linenumber, flag,
              {d.add_hours("shipped", "18 + (l_linenumber % 3) * 2")} as starts_at from v_line_keys""",
        "v_occurrences": f"""
            select l_orderkey * 10 + l_linenumber as id, l_orderkey as event_id,
              l_orderkey * 10 + l_linenumber as source_occurrence_id, starts_at,
              case when flag <> 'N' then {d.add_hours("starts_at", "l_linenumber * 120")} end as ends_at,
              case when l_linenumber = 7 then {d.ts("2001-07-01 00:00:00")} else s.last_seen_at end as last_seen_at
            from v_timed join v_snapshots s on l_orderkey = s.id""",
        "v_seeds": f"""
            select page_id as id, page_id % (select count(*) from supplier) as venue_id, url,
              {_pick("page_id", *_quoted(*vocab.PAGE_TYPES))} as page_type,
              {_pick("page_id", *_quoted(*vocab.CONFIDENCES))} as confidence,
              page_id % 20 as dated_items, {_pick("page_id", *_quoted(*vocab.LANGUAGES))} as language,
              {_pick("page_id", *_quoted(*vocab.SEED_STATUSES))} as status, 'm1' as model,
              {d.ts("2024-01-01 00:00:00")} as discovered_at
            from pages""",
        "v_pages": f"""
            select page_id as id, page_id % (select count(*) from supplier) as venue_id, url,
              case when page_id % 3 = 0 then 'listing' else 'detail' end as kind,
              case when page_id % 10 = 9 then 'thin' else 'ok' end as status, 200 as http_status,
              case when page_id % 10 <> 9 then {d.sha256("html")} end as content_hash,
              case when page_id % 10 <> 9 and page_id % 5 <> 0 then html end as raw_text,
              case when page_id % 3 = 0 and page_id % 10 <> 9 and page_id % 5 <> 0 then {d.links("url")} end as links,
              {d.add_hours(d.ts("2024-01-01 00:00:00"), "page_id")} as fetched_at,
              case when page_id % 4 <> 3 then case when page_id % 8 = 1 then 'failed' else 'ok' end end as extract_status,
              case when page_id % 4 <> 3 then case when page_id % 4 = 2 then {d.sha256("url")} else {d.sha256("html")} end end as extracted_hash,
              case when page_id % 4 <> 3 then case when page_id % 16 = 0 then 2 else 3 end end as extract_version,
              case when page_id % 4 <> 3 then 'm1' end as extract_model,
              case when page_id % 4 <> 3 and page_id % 8 <> 1 then page_id % 6 end as extracted_items,
              case when page_id % 4 <> 3 then {d.ts("2024-02-01 00:00:00")} end as extracted_at
            from pages""",
        "v_calls": f"""
            select event_id as id, ts as created_at, 'p' as provider, 'm' || (user_id % 4) as model, event_type as purpose,
              cast(floor(value * 100) as bigint) as input_tokens, cast(floor(value) as bigint) as output_tokens,
              (event_id * 7) % 300 as cache_creation_input_tokens, (event_id * 13) % 6000 as cache_read_input_tokens,
              cast(cast(floor(value * 100) as bigint) as decimal(12,6)) / 1000 as cost_usd,
              (event_id * 31) % 9000 as latency_ms,
              case when event_type = 'error' then 'E' end as error_type,
              user_id * 1000 + event_id % 50 as trace_id, user_id
            from events""",
        "v_requests": f"""
            select s_suppkey as request_id,
              {d.add_days("date '1998-01-01'", "(s_suppkey * 37) % 900")} as date_from,
              {d.add_days("date '1998-01-01'", "(s_suppkey * 37) % 900 + s_suppkey % 4")} as date_to,
              case when s_suppkey % 4 = 3 then 'nation ' || (s_suppkey % 25) end as near,
              case when s_suppkey % 4 in (1, 2) then cast(41.30 as double) + ((s_suppkey * 17) % 200) / cast(1000 as double) end as lat,
              case when s_suppkey % 4 in (1, 2) then cast(2.05 as double) + ((s_suppkey * 29) % 200) / cast(1000 as double) end as lon,
              case when s_suppkey % 4 in (1, 3) then cast(1.5 as double) * (1 + s_suppkey % 6) end as radius_km,
              case when s_suppkey % 5 = 0 then {d.strings("'exhibition'", "'talk'")} end as kinds,
              s_suppkey % 7 = 0 as free_only, 40 as rows
            from supplier""",
        "v_terms": f"""
            select p_partkey as id, case when p_partkey % 4 = 0 then p_name || ' &amp; ' || p_brand else p_name || ' ' || p_brand end as name,
              case p_partkey % 3 when 0 then 'p' || (p_partkey % 150) || 'x' when 1 then 'P' || (p_partkey % 150) || 'x-2'
                else 'q' || p_partkey end as slug, 'Street ' || p_size as address, 'City ' || (p_partkey % 7) as city,
              {d.no_text} as province, {d.no_text} as postcode,
              case when p_partkey % 6 <> 0 then cast(41 as double) + (p_partkey % 100) / cast(100 as double) end as lat,
              case when p_partkey % 6 <> 0 then cast(2 as double) + (p_partkey % 90) / cast(100 as double) end as lon, p_partkey as ord
            from part""",
        "v_profiles": f"""
            select s_suppkey as id, case s_suppkey % 4 when 0 then p_brand when 1 then p_name || ' ' || p_brand when 2 then p_name
                else 'zz' || s_suppkey end as name,
              'p' || (case when s_suppkey % 10 = 0 then s_suppkey + 1 else s_suppkey end) || 'x' as slug,
              case s_suppkey % 7 when 0 then 'https://www.site' || s_suppkey || '.example/' when 1 then 'http://u:p@Site' || s_suppkey || '.example:80/a'
                when 2 then 'https://INSTAGRAM.com/x' || s_suppkey when 3 then 'https://m.instagr.am/x' when 4 then '  '
                when 5 then 'ftp://site.example' end as url, s_suppkey as ord
            from supplier join part on p_partkey = s_suppkey""",
        "v_now_venues": """
            select id, id as source_venue_id, name, slug, address, city, province, postcode, lat, lon,
              case when id % 5 = 0 then id % 50 end as source_profile_id,
              case when id % 5 = 0 then 'https://was.example/' || id end as website_url, """ + d.no_text + """ as instagram_url,
              id % 5 = 0 as crawl_enabled, false as is_pilot, """ + d.ts("2001-01-01 00:00:00") + """ as updated_at
            from v_terms where id % 8 <> 1 union all
            select id + 1000000, id + 1000000, name, slug, address, city, province, postcode, lat, lon,
              case when id % 2 = 0 then id % 50 end, """ + d.no_text + ", " + d.no_text + """, false, id % 4 = 0, """ + d.ts("2001-01-01 00:00:00") + """
            from v_terms where id % 16 = 0""",
        "v_stored_shows": """
            select e.* from v_exhibitions e join (
              select max(id) as top from v_exhibitions where id % 2 = 0 group by venue_id, title_key) k on k.top = e.id""",
        "v_stored_events": """
            select e.* from v_art_events e join (
              select max(id) as top from v_art_events where id % 2 = 0 group by venue_id, title_key, start_date) k on k.top = e.id""",
        "v_labels": f"""
            select {d.idiv("o_orderkey", "20")} as page_id, o_orderkey % 20 as ord, o_orderkey as k,
              case when o_orderkey % 3 = 0 then 'event' else 'exhibition' end as kind, p_name || ' ' || o_orderkey as title,
              {d.strings("p_brand", "'Ann & Bob'")} as artists, cast(o_orderdate as date) as start,
              case when o_orderkey % 7 <> 0 then {d.add_days("cast(o_orderdate as date)", "o_custkey % 60")} end as {end},
              o_orderkey % 10 <> 0 as at_venue
            from v_keyed join part on part_key = p_partkey""",
        "v_found": f"""
            select page_id, ord, k, case when k % 11 = 0 then 'event' else kind end as kind,
              case when k % 7 = 0 then title || ' retitled' when k % 5 = 0 then upper(title) || '!' else title end as title,
              case when k % 4 = 0 then {d.strings("'Nobody'")} else {d.strings("'ann &amp; bob'", f"lower(artists[{first}])")} end as artists,
              case when k % 6 = 0 then {d.add_days("start", "1")} else start end as start, {end}, k % 8 <> 0 as at_venue
            from v_labels where k % 9 <> 0 union all
            select page_id + (case when k % 2 = 0 then 1000000 else 0 end), ord + 20, k, kind, 'zz ' || k, artists, start, {end}, at_venue
            from v_labels where k % 13 = 0""",
        "v_scored_pages": """
            select page_id, page_id % 5 = 0 as partial, page_id % 17 = 0 as failed from v_labels group by page_id union all
            select page_id, false, page_id % 17 = 0 from v_found where page_id >= 1000000 group by page_id""",
        "v_listings": f"""
            select upper(s_name) as venue, case when s_suppkey % 4 <> 0 then {d.strings("url")} else {d.strings()} end as urls
            from supplier join pages on page_id = s_suppkey where s_suppkey % 3 <> 0""",
        "v_crawled": f"""
            select page_id as id, page_id % (select count(*) from supplier) as venue_id, url,
              case when page_id % 2 = 0 then 'listing' else 'detail' end as kind,
              case when page_id % 11 = 0 then 'error' when page_id % 13 = 0 then 'unavailable' when page_id % 17 = 0 then 'thin' else 'ok' end as status,
              case when page_id % 22 = 0 then 404 when page_id % 11 = 0 then 500 else 200 end as http_status,
              case when page_id % 3 = 0 then html else html || ' more' end as raw_text,
              {d.links("url")} as links,
              case when page_id % 5 = 0 then 'http://site' || (page_id % (select count(*) from supplier) % 30) || '.example' else url end as final_url
            from pages where page_id % 6 <> 5""",
        "v_overrides": """
            select s_suppkey as venue_id, 'https://www.site' || (s_suppkey % 30) || '.example/pin/' as url, 'pin' as action, s_suppkey as ord
            from supplier where s_suppkey % 10 = 1 union all
            select page_id % (select count(*) from supplier), url, 'reject', page_id from pages where page_id % 4 = 0""",
        "v_show_rows": f"""
            select o_orderkey, venue_id, case when o_orderkey % 5 = 0 then p_name || '.' when o_orderkey % 7 = 0 then upper(p_name) else p_name end as title,
              case when o_orderkey % 4 <> 0 then p_brand end as brand,
              case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end as start_date,
              case when o_orderkey % 7 <> 0 then {d.add_days("cast(o_orderdate as date)", "o_custkey % 60")} end as end_date,
              o_orderkey % 10 <> 0 as at_venue,
              case when o_orderkey % 3 = 0 then 'https://www.site' || (venue_id % 30) || '.example/show/' || o_orderkey end as detail_url,
              case when o_orderkey % 3 = 1 then substr(p_name || ' shown with ' || p_brand || ' and more', 1, cast(8 + o_orderkey % 25 as int)) end as summary_en,
              {d.idiv("o_orderkey", "20")} as page_ord, o_orderkey % 20 as item_ord
            from v_keyed join part on part_key = p_partkey""",
    }


_NAME = re.compile(r"\bv_[a-z0-9_]+\b")


def closure(sql: str, defined: dict[str, str]) -> list[str]:
    """The views `sql` needs, each after the ones it reads."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in defined and name not in ordered:
                visit(defined[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


def duckdb_sql(body: str) -> str:
    """`body` with the definitions of the views it names in front."""
    defined = views(Dialect("duckdb"))
    parts = [f"{name} as ({defined[name]})" for name in closure(body, defined)]
    text = body.strip()
    if not parts:
        return text
    if text.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + text[5:]
    return "with " + ",\n".join(parts) + "\n" + text


class Tables:
    """The base tables and the derived views of one data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    @cached_property
    def _defined(self) -> dict[str, str]:
        return views(Dialect("spark"))

    def sql(self, body: str) -> DataFrame:
        names = closure(body, self._defined)
        text = body + " ".join(self._defined[n] for n in names)
        base = [t for t in BASE if re.search(rf"\b{t}\b", text)]
        parts = [f"{t} as (select * from parquet.`{self.folder}/{t}.parquet`)" for t in base]
        parts += [f"{n} as ({self._defined[n]})" for n in names]
        if body.strip().lower().startswith("with "):
            return self.spark.sql("with " + ",\n".join(parts) + ",\n" + body.strip()[5:])
        return self.spark.sql("with " + ",\n".join(parts) + "\n" + body)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.sql(f"select * from {name}")
        return self._read[name]
