"""Pages, sites, seeds and what to extract."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.catalog.registry import query
from vernissage.functions import urls
from vernissage.plans import crawl, extraction
from vernissage.sources import html

RUN = datetime(2024, 3, 1)
_RUN = "timestamp '2024-03-01 00:00:00'"
PURGE_AT = datetime(2024, 1, 10)
AS_OF = datetime(2000, 6, 1)
TODAY = date(2000, 6, 1)


def key(u: str) -> str:
    return (f"(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]*)', 1)), '^www\\.', '')"
            f" || regexp_replace(regexp_extract({u}, '^[^:/]+://[^/?#]*([^?#]*)', 1), '/+$', '') || '?' || regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1))")


def site(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]*)', 1)), '^www\\.', '')"


@query("url_keys", f"select page_id, {site('url')} as site_key, {key('url')} as url_key from pages")
def url_keys(t):
    u = F.col("url")
    return t["pages"].select("page_id", urls.site_key(u).alias("site_key"), urls.url_key(u).alias("url_key"))


_WORDS = "cast(len(string_split_regex(trim({0}, e' \\n\\r\\t'), '\\s+')) as bigint)"
_CHANGES = f"""
  changes as (
    select c.id, c.venue_id, c.url, c.kind, c.status, c.http_status, {_WORDS.format("c.raw_text")} as words,
      case when c.status = 'ok' then sha256(c.raw_text) end as content_hash,
      case when c.status = 'ok' then case when p.content_hash is null then 'new' when p.content_hash = sha256(c.raw_text) then 'unchanged'
        else 'changed' end end as change,
      case when c.kind = 'listing' then case when c.status = 'error' and c.http_status = 404 then 'gone'
        when {key("c.final_url")} = {key("v.website_url")} and {key("v.website_url")} <> {key("c.url")} then 'homepage' end end as broken
    from v_crawled c left join v_pages p on p.url = c.url left join v_venues v on v.id = c.venue_id)"""


@query("page_changes", f"with {_CHANGES} select * from changes")
def page_changes(t):
    return crawl.page_changes(t["v_pages"], t["v_crawled"], t["v_venues"]).drop("raw_text", "links", "final_url")


@query("crawl_summary", f"""with {_CHANGES},
    s as (select min(id) as venue_id from v_venues where is_pilot and crawl_enabled and website_url is not null group by website_url)
    select 'status_' || status as metric, count(*) as value from changes group by 1
    union all select 'change_' || change, count(*) from changes where change is not null group by 1
    union all select 'sites', count(*) from s
    union all select 'sites_without_a_page', count(*) from s where venue_id not in (select venue_id from v_crawled)""")
def crawl_summary(t):
    changes = crawl.page_changes(t["v_pages"], t["v_crawled"], t["v_venues"])
    return crawl.crawl_summary(changes, crawl.sites(t["v_venues"]))


_PAGE = ("venue_id", "kind", "status", "http_status", "content_hash", "raw_text")


@query("merge_pages", f"""
    with f as (
      select url, venue_id, kind, status, http_status, case when status = 'ok' then sha256(raw_text) end as content_hash,
        case when status = 'ok' then raw_text end as raw_text, case when status = 'ok' then 1 end as links
      from v_crawled where status <> 'unavailable'),
    s as (select * exclude (links), len(links) as links from v_pages where id % 7 <> 0)
    select coalesce(f.url, s.url) as url,
      {", ".join(f"case when f.url is not null then f.{c} else s.{c} end as {c}" for c in _PAGE if c != "raw_text")},
      md5(case when f.url is not null then f.raw_text else s.raw_text end) as text_md5,
      cast(case when f.url is not null then f.links else s.links end as bigint) as links,
      case when f.url is not null then {_RUN} else s.fetched_at end as fetched_at, {", ".join("s." + c for c in crawl.MARKS)}
    from s full outer join f on f.url = s.url""")
def merge_pages(t):
    merged = crawl.merge_pages(t["v_pages"].filter("id % 7 <> 0"), crawl.fetched(t["v_crawled"]), RUN)
    return merged.withColumns({
        "text_md5": F.md5("raw_text"), "links": F.when(F.col("links").isNotNull(), F.size("links").cast("long"))
    }).drop("id", "raw_text")


@query("purge_pages", """
    select id, url, raw_text is not null and fetched_at < timestamp '2024-01-03 00:00:00' as purged,
      raw_text is not null and not (fetched_at < timestamp '2024-01-03 00:00:00') as text_held,
      links is not null and not (raw_text is not null and fetched_at < timestamp '2024-01-03 00:00:00') as links_held
    from v_pages""")
def purge_pages(t):
    return crawl.purge(t["v_pages"], PURGE_AT).select(
        "id", "url", "purged", F.col("raw_text").isNotNull().alias("text_held"), F.col("links").isNotNull().alias("links_held"))


_SEEN_URLS = "select venue_id, url, id as ord from v_seeds union all select venue_id, url || '/', id + 1000000 from v_seeds"


@query("dedupe_urls", f"""
    with u as (select venue_id, url, ord, {key("url")} as key from (
      select venue_id, url, id as ord from v_seeds union all select venue_id, replace(url, 'https://', 'http://www.'), id + 1000000 from v_seeds)),
    k as (select venue_id, {key("url")} as key, min(url) as known from (
      select venue_id, url || '#a' as url from v_seeds where id % 3 = 0) group by all),
    f as (select * from (select *, row_number() over (partition by venue_id, key order by ord) as n from u) where n = 1)
    select f.venue_id, coalesce(known, url) as url, ord, f.key from f left join k on k.venue_id = f.venue_id and k.key = f.key""")
def dedupe_urls(t):
    s = t["v_seeds"]
    seen = s.select("venue_id", "url", F.col("id").alias("ord")).unionByName(s.select(
        "venue_id", F.replace("url", F.lit("https://"), F.lit("http://www.")).alias("url"), (F.col("id") + 1_000_000).alias("ord")))
    stored = s.filter("id % 3 = 0").select("venue_id", F.concat("url", F.lit("#a")).alias("url"))
    return crawl.dedupe_urls(seen, "venue_id", stored)


_SITES = """
  sites as (
    select min(id) as venue_id, min_by(name, id) as name, website_url as url from v_venues
    where is_pilot and crawl_enabled and website_url is not null group by website_url)"""


@query("sites", f"with {_SITES} select * from sites")
def sites(t):
    return crawl.sites(t["v_venues"])


@query("site_hints", f"""with {_SITES},
  cur as (select distinct event_id from v_occurrences where coalesce(ends_at, starts_at) >= timestamp '2000-06-01 00:00:00'),
  ev as (
    select v.website_url as url, s.* exclude (venue_id) from v_snapshots s join cur on cur.event_id = s.id
    join v_venues v on v.id = s.venue_id and v.crawl_enabled and v.website_url in (select url from sites)),
  titles as (select url, substr(title, 1, 120) as value, min(id) as ord from ev group by 1, 2),
  links as (
    select url, unnest([web_url_ca, web_url_es, web_url_en]) as value, unnest([0, 1, 2]) as n, id from ev),
  onsite as (
    select url, {key("value")} as k, min_by(value, (id, n)) as value, min((id, n)) as ord from links
    where value is not null and {site("value")} = {site("url")} group by 1, 2)
  select * from (select url, 'title' as kind, row_number() over (partition by url order by ord) as position, value from titles) where position <= 10
  union all
  select * from (select url, 'url', row_number() over (partition by url order by ord) as position, value from onsite) where position <= 10""")
def site_hints(t):
    hints = crawl.site_hints(crawl.sites(t["v_venues"]), t["v_venues"], t["v_snapshots"], t["v_occurrences"], AS_OF,
                             most=vocab.MAX_HINTS, title_chars=vocab.HINT_TITLE_CHARS)
    return hints.withColumn("position", F.col("position").cast("long"))


_IN_USE = f"""{_SITES},
  in_use as (
    select s.venue_id, s.url, s.id as ord, {key("s.url")} as key from v_seeds s join sites using (venue_id)
    where s.status = 'accepted' and not exists (
      select 1 from v_overrides o where o.action = 'reject' and o.venue_id = s.venue_id and {key("o.url")} = {key("s.url")}))"""


@query("seeds_in_use", f"with {_IN_USE} select venue_id, url, ord from in_use")
def seeds_in_use(t):
    return crawl.seeds_in_use(crawl.sites(t["v_venues"]), t["v_seeds"], t["v_overrides"])


@query("crawl_targets", f"""with {_IN_USE},
  pins as (select o.venue_id, o.url, o.ord, {key("o.url")} as key from v_overrides o join sites using (venue_id) where action = 'pin'),
  listed as (select * from pins union all select * from in_use where venue_id not in (select venue_id from pins)),
  spelled as (select venue_id, {key("url")} as key, min(url) as known from v_pages group by all),
  listings as (
    select l.venue_id, coalesce(known, url) as url, ord, l.key
    from (select venue_id, key, min_by(url, ord) as url, min(ord) as ord from listed group by 1, 2) l
    left join spelled s on s.venue_id = l.venue_id and s.key = l.key),
  known as (select venue_id, key from spelled union select venue_id, key from listings union select venue_id, {key("url")} from sites),
  shows as (
    select e.venue_id, detail_url as url, {key("detail_url")} as key, coalesce(start_date, date '9999-12-31') as s, e.id
    from v_exhibitions e join sites using (venue_id)
    where detail_url is not null and at_venue and coalesce(end_date, date '2000-06-01') >= date '2000-06-01'),
  fresh as (
    select venue_id, key, min_by(url, (s, id)) as url, min((s, id)) as o from shows
    where (venue_id, key) not in (select (venue_id, key) from known) group by 1, 2),
  everything as (
    select venue_id, 0 as r, ord as a, null as o, url, 'listing' as kind from listings
    union all select venue_id, 1, null, o, url, 'detail' from fresh)
  select venue_id, position, kind, url from (
    select *, row_number() over (partition by venue_id order by r, a, o, url) as position from everything) where position <= 8""")
def crawl_targets(t):
    s = crawl.sites(t["v_venues"])
    in_use = crawl.seeds_in_use(s, t["v_seeds"], t["v_overrides"])
    return crawl.crawl_targets(s, in_use, t["v_overrides"], t["v_pages"], t["v_exhibitions"], TODAY, most=vocab.MAX_PAGES_PER_SITE)


_ROUTED = f"""{_IN_USE},
  routed as (
    select v.*, case when page_type = 'single_show' then 'single show' when confidence <> 'high' then 'unsure'
        when page_type not in ('current_listing', 'agenda') then 'not a listing'
        when venue_id in (select venue_id from in_use) and (venue_id, {key("url")}) not in (select (venue_id, key) from in_use)
          then 'not the seed in use' else 'listing' end as reason
    from (select id as ord, venue_id, url, page_type, confidence, dated_items, language, model from v_seeds
          union all select id + 1000000, venue_id, url || '?new=1', 'agenda', 'high', 3, 'ca', 'm2' from v_seeds) v),
  statused as (
    select *, case reason when 'listing' then 'accepted' when 'not a listing' then 'rejected' else 'ambiguous' end as status from routed)"""


def _verdicts(t):
    s = t["v_seeds"].select(F.col("id").alias("ord"), "venue_id", "url", "page_type", "confidence", "dated_items", "language", "model")
    new = s.withColumns({
        "ord": F.col("ord") + 1_000_000, "url": F.concat("url", F.lit("?new=1")), "page_type": F.lit("agenda"),
        "confidence": F.lit("high"), "dated_items": F.lit(3).cast("long"), "language": F.lit("ca"), "model": F.lit("m2")})
    return s.unionByName(new)


def _routed(t):
    in_use = crawl.seeds_in_use(crawl.sites(t["v_venues"]), t["v_seeds"], t["v_overrides"])
    return crawl.route(_verdicts(t), in_use)


@query("route_seeds", f"with {_ROUTED} select * from statused")
def route_seeds(t):
    return _routed(t)


@query("route_sites", f"""with {_ROUTED}
    select venue_id, case when bool_or(status = 'accepted') then 'accepted' else 'ambiguous' end as status from statused group by 1""")
def route_sites(t):
    return crawl.site_status(_routed(t))


@query("merge_seeds", f"""with {_ROUTED},
  held as (select venue_id, url || '#old' as url, page_type, confidence, dated_items, language, status, model, discovered_at from v_seeds where id % 2 = 0),
  f0 as (
    select r.ord, r.venue_id, coalesce(h.url, r.url) as url, r.page_type, r.confidence, r.dated_items, r.language, r.status, r.model
    from statused r left join held h on h.venue_id = r.venue_id and {key("h.url")} = {key("r.url")}),
  f as (select * from (select *, row_number() over (partition by venue_id, url order by ord desc) as n from f0) where n = 1)
  select coalesce(f.venue_id, h.venue_id) as venue_id, coalesce(f.url, h.url) as url,
    {", ".join(f"case when f.url is not null then f.{c} else h.{c} end as {c}" for c in crawl.SEED_VALUES)},
    case when f.url is not null then {_RUN} else h.discovered_at end as discovered_at
  from held h full outer join f on f.venue_id = h.venue_id and f.url = h.url""")
def merge_seeds(t):
    held = t["v_seeds"].filter("id % 2 = 0").withColumn("url", F.concat("url", F.lit("#old")))
    return crawl.merge_seeds(held, _routed(t), RUN).drop("id")


@query("extract_plan", f"""
    select id, venue_id, url, kind, case when extracted_hash = content_hash and extract_version = 3 and extract_model = 'm1' then 'unchanged'
        when raw_text is null then 'expired' else 'to_extract' end as plan,
      cast(fetched_at at time zone 'UTC' at time zone 'Europe/Madrid' as date) as fetched_on,
      case when extract_status = 'ok' then extracted_items end as previous_items
    from v_pages where status = 'ok' and content_hash is not null""")
def extract_plan(t):
    return extraction.extract_plan(t["v_pages"], vocab.EXTRACT_VERSION, "m1")


@query("mark_pages", f"""
    select id, case when id % 3 = 0 then 'failed' when id % 3 = 1 then 'ok' else extract_status end as extract_status,
      case when id % 3 <> 2 then content_hash else extracted_hash end as extracted_hash,
      case when id % 3 <> 2 then 3 else extract_version end as extract_version,
      case when id % 3 <> 2 then 'm9' else extract_model end as extract_model,
      case when id % 3 = 1 then id % 9 when id % 3 = 2 then extracted_items end as extracted_items,
      case when id % 3 <> 2 then {_RUN} else extracted_at end as extracted_at
    from v_pages""")
def mark_pages(t):
    results = t["v_pages"].filter("id % 3 <> 2").select(
        F.col("id").alias("page_id"), (F.col("id") % 3 == 1).alias("ok"), (F.col("id") % 9).alias("items"))
    return extraction.mark_pages(t["v_pages"], results, 3, "m9", RUN).select("id", *crawl.MARKS)


# --- markup --------------------------------------------------------------------------------------


# What a reader sees of the tables' markup, by regular expressions: no head, comments or tags; references decoded.
_SEEN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(html, '(?s)<head>.*?</head>|<!--.*?-->|<[^>]*(>|$)', '', 'g'),
    '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))"""


@query("page_text", f"select page_id, {_SEEN} as text from pages")
def page_text(t):
    return t["pages"].select("page_id", html.page_text(F.col("html")).alias("text"))


@query("ingest_pages", f"""
    with p as (select page_id, url, {_SEEN} as seen from pages),
    w as (select *, case when seen = '' then 0 else len(string_split(seen, ' ')) end as n from p)
    select page_id, url, case when n >= 50 then seen end as text, cast(n as bigint) as words,
      case when n >= 50 then 'ok' else 'thin' end as status, case when n >= 50 then sha256(seen) end as content_hash from w""")
def ingest_pages(t):
    return html.ingest_pages(t["pages"])


@query("page_links", f"""
    with a as (
      select page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) as tag, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) as n
      from pages),
    l as (
      select page_id, n, regexp_extract(url, '^[^:]+://[^/?#]+') || regexp_extract(tag, 'href="([^"]*)"', 1) as url, regexp_extract(tag, '>([^<]*)<', 1) as text from a),
    f as (select page_id, {key("url")} as k, min(n) as n, min_by(url, n) as url, min_by(text, n) as text from l
          where not regexp_matches(lower({key("url")}), '\\.(pdf|jpg|jpeg|png|gif|webp|svg|zip|mp3|mp4|doc|docx|xls|xlsx|ics|xml|rss|css|js)\\?') group by 1, 2)
    select page_id, row_number() over (partition by page_id order by n) as number, url, text, 'nav' as region from f""")
def page_links(t):
    return html.page_links(t["pages"])
