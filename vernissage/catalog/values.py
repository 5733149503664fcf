"""Normalisation and parsing rules, over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.catalog.registry import query
from vernissage.catalog.sync import NORM
from vernissage.functions import text, urls
from vernissage.functions.dates import local_day, local_time, parse_instant, resolve_dates
from vernissage.plans import answers, search, vectors
from vernissage.sources import feed, opendata

_KEY = lambda c: (f"trim(regexp_replace(replace(strip_accents(lower({c})), '&', ' and '), "  # noqa: E731
                  r"'[^\p{L}\p{N}]+', ' ', 'g'))")


@query("normalize_documents", f"""
    select doc_id, md5({NORM("text")}) as name_md5, md5({_KEY("text")}) as key_md5 from documents""")
def normalize_documents(t):
    c = F.col("text")
    return t["documents"].select(
        "doc_id", F.md5(text.normalize_name(c)).alias("name_md5"), F.md5(text.match_key(c)).alias("key_md5"))


@query("title_keys", f"""
    select p_partkey, {NORM("x")} as name_key, case when {NORM("x")} = '' then lower(trim(x)) else {NORM("x")} end as title_key,
      regexp_replace(lower(trim(slug)), '-[0-9]+$', '') as base
    from (select p_partkey, case when p_partkey % 7 = 0 then ' ¿? ' else ' ' || upper(p_name) || ' &amp; ' || p_brand || ' É!' end as x,
      p_name || '-' || p_size as slug from part)""")
def title_keys(t):
    k = F.col("p_partkey")
    x = F.when(k % 7 == 0, " ¿? ").otherwise(F.concat(
        F.lit(" "), F.upper("p_name"), F.lit(" &amp; "), F.col("p_brand"), F.lit(" É!")))
    slug = F.concat("p_name", F.lit("-"), F.col("p_size").cast("string"))
    return t["part"].select(
        k, text.normalize_name(x).alias("name_key"), text.title_key(x).alias("title_key"), text.base_slug(slug).alias("base"))


@query("classify_urls", """
    with s as (select id, case when trim(url) <> '' then trim(url) end as u from v_profiles),
    h as (select id, u, coalesce(regexp_matches(u, '^https?://[^/?#]'), false) as web,
      regexp_replace(lower(regexp_extract(u, '^https?://(?:[^@/]*@)?([^/:?#]+)', 1)), '^www\\.', '') as host from s),
    c as (select *, web and (host in ('instagram.com', 'instagr.am') or host like '%.instagram.com' or host like '%.instagr.am') as social from h)
    select id, case when web and not social then u end as website_url, case when social then u end as instagram_url, web and not social as crawl_enabled from c""")
def classify_urls(t):
    return t["v_profiles"].select("id", urls.classify(F.col("url")).alias("u")).select("id", "u.*")


_KIND = "case id % 12 " + " ".join(f"when {i} then '{kind}'" for i, (_, kind) in enumerate(vocab.CATEGORIES.values())) + " else 'other' end"
_SLUG = "case id % 12 " + " ".join(f"when {i} then '{slug}'" for i, (slug, _) in enumerate(vocab.CATEGORIES.values())) + " end"


@query("categories", f"select id, {_KIND} as kind, {_SLUG} as slug from v_snapshots")
def categories(t):
    ids = F.element_at(F.array(*map(F.lit, (*vocab.CATEGORIES, 999, None))), (F.col("id") % 12 + 1).cast("int"))
    return t["v_snapshots"].select(
        "id", search.category_kind(ids).alias("kind"), search.category_slug(ids).alias("slug"))


@query("local_days", """
    select event_id, cast(ts at time zone 'UTC' at time zone 'Europe/Madrid' as date) as day,
      strftime(ts at time zone 'UTC' at time zone 'Europe/Madrid', '%H:%M:%S') as time from events""")
def local_days(t):
    return t["events"].select("event_id", local_day(F.col("ts")).alias("day"), local_time(F.col("ts")).alias("time"))


@query("parse_instants", """
    select event_id, case event_id % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) - interval 2 hour end as strict,
      case event_id % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) - interval 2 hour when 2 then date_trunc('second', ts) end as lenient from events""")
def parse_instants(t):
    k = F.col("event_id")
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(k % 4 == 0, F.concat(plain, F.lit("Z"))).when(k % 4 == 1, F.concat(plain, F.lit("+0200"))).when(
        k % 4 == 2, plain).otherwise("soon")
    return t["events"].select(
        k, parse_instant(written).alias("strict"), parse_instant(written, assume_utc=True).alias("lenient"))


@query("parse_numbers", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 5 = 0 then null when l_partkey % 5 = 1 then null
        else try_cast(round(l_extendedprice, 2) as decimal(8,2)) end as price,
      case when l_partkey % 3 = 0 then l_suppkey end as number,
      case when l_suppkey % 4 <> 0 then cast(l_suppkey % 90 as double) + 0.5 end as lat, case when l_suppkey % 4 <> 0 then cast(l_suppkey % 180 as double) end as lon
    from lineitem""")
def parse_numbers(t):
    lines = t["lineitem"]
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    price = F.when(p % 5 == 0, "").when(p % 5 == 1, "free").otherwise(
        F.concat(F.lit(" "), F.replace(F.round("l_extendedprice", 2).cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(","))))
    number = F.when(p % 3 == 0, F.concat(F.lit(" "), s.cast("string"))).otherwise("n/a")
    lat = F.when(s % 4 == 0, F.when(s % 8 == 0, "0.000000").otherwise("95")).otherwise(
        F.concat((s % 90).cast("string"), F.lit(".5")))
    lon = F.when(s % 8 == 0, "0").otherwise((s % 180).cast("string"))
    return lines.select(
        "l_orderkey", "l_linenumber", p, s, feed.parse_decimal(price).alias("price"), feed.parse_int(number).alias("number"),
        feed.parse_point(lat, lon).alias("p")).select("*", "p.lat", "p.lon").drop("p")


# --- written dates -------------------------------------------------------------------------------

_WRITTEN = """
  select o_orderkey as id, cast(o_orderdate as date) as fetched_on, o_custkey % 11 = 0 as no_start, o_custkey % 7 = 0 as no_end,
    case when o_orderkey % 5 <> 0 then cast(1 + o_orderkey % 31 as int) end as d1, cast(1 + o_custkey % 12 as int) as m1,
    case when o_orderkey % 3 = 0 then cast(1995 + o_custkey % 7 as int) end as y1,
    case when o_orderkey % 4 <> 0 then cast(1 + o_custkey % 31 as int) end as d2, cast(1 + o_orderkey % 12 as int) as m2,
    case when o_orderkey % 2 = 0 then cast(1996 + o_orderkey % 6 as int) end as y2
  from orders"""
_DAY = lambda y, m, d, last: (f"case when {d} is null then {'last_day(make_date(' + y + ', ' + m + ', 1))' if last else 'make_date(' + y + ', ' + m + ', 1)'} "  # noqa: E731
                              f"when {d} <= day(last_day(make_date({y}, {m}, 1))) then make_date({y}, {m}, {d}) end")


@query("resolve_dates", f"""
    with w as ({_WRITTEN}),
    lone1 as (select id, arg_min(d, (abs(d - fetched_on), -(d - date '1970-01-01'))) as d from (
      select id, fetched_on, {_DAY('y', 'm1', 'd1', False)} as d from (select *, unnest(case when y1 is not null then [y1] else [year(fetched_on) - 1, year(fetched_on), year(fetched_on) + 1] end) as y from w where not no_start)) where d is not null group by id),
    lone2 as (select id, arg_min(d, (abs(d - fetched_on), -(d - date '1970-01-01'))) as d from (
      select id, fetched_on, {_DAY('y', 'm2', 'd2', True)} as d from (select *, unnest(case when y2 is not null then [y2] else [year(fetched_on) - 1, year(fetched_on), year(fetched_on) + 1] end) as y from w where not no_end)) where d is not null group by id),
    starts as (select *, unnest(ys) as y, generate_subscripts(ys, 1) as yo from (
      select *, case when y1 is not null then [y1] when y2 is not null then [y2, y2 - 1] else [year(fetched_on) - 1, year(fetched_on), year(fetched_on) + 1] end as ys from w where not no_start and not no_end)),
    ends as (select *, unnest(es) as e, generate_subscripts(es, 1) as eo from (select *, case when y2 is not null then [y2] else [y, y + 1] end as es from starts)),
    runs as (
      select id, fetched_on, y1, y2, yo, a, arg_min(b, eo) as b from (
        select *, {_DAY('y', 'm1', 'd1', False)} as a, {_DAY('e', 'm2', 'd2', True)} as b from ends) where b >= a group by all),
    best as (
      select id, arg_min((a, b), case when y1 is null and y2 is null then (greatest(a - fetched_on, fetched_on - b, 0), -(a - date '1970-01-01')) else (yo, 0) end) as r from runs group by id)
    select w.id, case when no_start then null when no_end then l1.d else r[1] end as start_date,
      case when no_end then null when no_start then l2.d else r[2] end as end_date
    from w left join lone1 l1 using (id) left join lone2 l2 using (id) left join best using (id)""")
def resolve_dates_query(t):
    w = t.sql(f"with w as ({_WRITTEN}) select * from w")
    part = lambda n: F.struct(F.col(f"d{n}").alias("day"), F.col(f"m{n}").alias("month"), F.col(f"y{n}").alias("year"))
    run = resolve_dates(F.when(~F.col("no_start"), part(1)), F.when(~F.col("no_end"), part(2)), F.col("fetched_on"))
    return w.select("id", run.alias("r")).select("id", "r.*")


# --- answers -------------------------------------------------------------------------------------


def raw_answers(t):
    """One answer per order page, as JSON written from the item rows; every seventh page breaks a rule."""
    rows = t["v_labels"]
    k = F.col("k")
    date_of = lambda c: F.when(F.col(c).isNotNull(), F.struct(
        F.dayofmonth(c).alias("day"), F.month(c).alias("month"), F.year(c).alias("year")))
    item = lambda kind: F.to_json(F.struct(
        F.col("title"), F.array("title").alias("artists"), date_of("start").alias("start"), date_of("end").alias("end"),
        F.col("at_venue"), F.when(k % 2 == 0, F.lit(1) + (k % 3).cast("int")).alias("link"),
        F.when((F.col("page_id") % 7 == 0) & (F.col("ord") == 3), "sure").otherwise("high").alias("confidence"),
        F.col("title").alias("summary_en"), F.array(F.lit("Paper"), F.lit("paper")).alias("themes"),
        F.array(F.lit("video")).alias("media"), *kind), {"ignoreNullFields": "false"})
    show = item([])
    event = item([F.lit("talk").alias("kind"), F.when(k % 4 == 0, "19:30").alias("start_time"),
                  F.lit(None).cast("string").alias("exhibition_title")])
    texts = rows.select("page_id", "ord", "kind", F.when(F.col("kind") == "event", event).otherwise(show).alias("j"),
                        F.col("start").alias("day"))
    listed = texts.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "kind", "j"))).alias("all"), F.max("day").alias("fetched_on"))
    of = lambda kind: F.array_join(F.transform(F.filter("all", lambda x: x["kind"] == kind), lambda x: x["j"]), ",")
    shows, events = of("exhibition"), of("event")
    brackets = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    first = F.concat(F.lit('{"exhibitions":'), brackets(shows), F.lit("}"))
    second = F.concat(F.lit('{"events":'), brackets(events), F.lit("}"))
    return listed.select(
        "page_id", F.lit(False).alias("listing"), F.lit(3).alias("link_count"), "fetched_on",
        F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.struct(
            n.alias("number"), F.concat(F.lit("https://x.example/"), n.cast("string")).alias("url"))).alias("links"),
        F.array(first, second).alias("tool_inputs"))


_ODD = "(page_id % 7 = 0 and page_id in (select page_id from v_labels where ord = 3))"


@query("validate_answers_items", f"""
    select page_id, kind, row_number() over (partition by page_id, kind order by ord) - 1 as ord, title, start as start_date, "end" as end_date, at_venue,
      case when k % 2 = 0 then 'https://x.example/' || (1 + k % 3) end as detail_url, 'paper' as themes,
      case when kind = 'event' and k % 4 = 0 then '19:30' end as start_time
    from v_labels where not {_ODD}""")
def validate_answers_items(t):
    shows, events, _ = answers.validate_answers(raw_answers(t))
    none = F.lit(None).cast("string")
    rows = shows.select("*", F.lit("exhibition").alias("list"), none.alias("start_time")).unionByName(
        events.drop("kind", "exhibition_title").withColumn("list", F.lit("event")))
    return rows.select("page_id", F.col("list").alias("kind"), F.col("ord").cast("long").alias("ord"), "title", "start_date",
                       "end_date", "at_venue", "detail_url", F.array_join("themes", "|").alias("themes"), "start_time")


@query("validate_answers_pages", f"""
    select page_id, case when {_ODD} then 'confidence' end as reason, case when not {_ODD} then count(*) end as items from v_labels group by page_id""")
def validate_answers_pages(t):
    return answers.validate_answers(raw_answers(t))[2].select("page_id", "reason", "items")


# --- payloads ------------------------------------------------------------------------------------


def _payloads(t):
    inner = F.struct(F.col("title").alias("rendered"), F.repeat(F.lit("x"), (F.col("id") % 500).cast("int")).alias("note"))
    return t["v_snapshots"].select("id", F.to_json(F.struct(
        "id", inner.alias("title"), F.when(F.col("id") % 2 == 0, F.col("title")).alias("description"),
        F.array(F.struct(F.when(F.col("id") % 5 == 0, F.lit("long text")).alias("desc_ca"), F.lit(1).alias("n"))).alias("parts"),
    )).alias("payload"))


@query("scrub_payloads", """
    select id, title as rendered, cast(id % 500 as bigint) as note_chars, false as described, 1 as n from v_snapshots""")
def scrub_payloads(t):
    clean = feed.scrub_payloads(_payloads(t))
    at = lambda p: F.get_json_object("payload", p)
    return clean.select(
        "id", at("$.title.rendered").alias("rendered"), F.length(F.coalesce(at("$.title.note"), F.lit(""))).cast("long").alias("note_chars"),
        (F.contains("payload", F.lit("description")) | F.contains("payload", F.lit("desc_"))).alias("described"),
        at("$.parts[0].n").cast("int").alias("n"))


@query("banned_keys", """
    select id, 'description' as banned from v_snapshots where id % 2 = 0
    union all select id, 'desc_ca' from v_snapshots where id % 5 = 0
    union all select id, 'long:note' from v_snapshots where id % 500 > 400""")
def banned_keys(t):
    return feed.banned_keys(_payloads(t), "id")


@query("feed_events_typed", """
    select id as source_event_id, case when id % 3 <> 2 then null else venue_id end as source_venue_id, title || ' &' as title, is_free, price_min,
      source_category_id, starts_at
    from (select s.*, case when id % 4 <> 3 then timestamp '2026-01-01 00:00:00' end as starts_at from v_snapshots s)""")
def feed_events_typed(t):
    """Captured payloads written from the snapshots and read back through the feed's parsers."""
    s = t["v_snapshots"]
    venues = F.when(F.col("id") % 3 == 2, F.when(F.col("venue_id").isNotNull(), F.array(F.lit("x"), F.col("venue_id").cast("string"))))
    acf = F.to_json(F.struct(
        F.col("source_category_id").cast("string").alias("event_category"), F.col("is_free").alias("_event_free"),
        F.coalesce(F.replace(F.col("price_min").cast("string"), F.lit("."), F.lit(",")), F.lit("")).alias("_event_price-min")))
    payload = s.select(
        "id", F.lit("2026-01-01T00:00:00").alias("modified_gmt"), F.col("source_url").alias("link"),
        F.struct(F.concat(F.lit(" "), "title", F.lit(" &amp;")).alias("rendered")).alias("title"), venues.alias("event-venues"),
        F.col("id").cast("string").alias("occurrence_id"),
        F.when(F.col("id") % 4 == 3, "2026-01-01T01:00:00").otherwise("2026-01-01T01:00:00+01:00").alias("start"),
        F.lit(None).cast("string").alias("end"), acf.alias("acf"), F.col("id").alias("ord"))
    return feed.events(payload).select(
        "source_event_id", "source_venue_id", "title", "is_free", "price_min",
        F.col("source_category_id").cast("int").alias("source_category_id"), "starts_at")


# --- gazetteers ----------------------------------------------------------------------------------

_GAZETTEER = """
  select p_partkey as id, case p_partkey % 4 when 0 then p_name || ', la' when 1 then p_name || ', l''' when 2 then 'El ' || p_name else p_name end as nom,
    1 + p_partkey % 3 as side, 2.0 + (p_partkey % 100) / 100.0 as x, 41.0 + (p_partkey % 90) / 100.0 as y from part"""


@query("place_aliases", f"""
    select id, case id % 4 when 0 then 'la ' || p when 1 then 'l''' || p else nom end as name, case when id % 4 = 3 then '' else p end as aliases
    from (select g.*, replace(replace(replace(nom, ', la', ''), ', l''', ''), 'El ', '') as p from ({_GAZETTEER}) g)""")
def place_aliases(t):
    rows = t.sql(_GAZETTEER.replace("l'''", "l\\''"))
    name = opendata.article_first(F.col("nom"))
    none = F.array().cast("array<string>")
    return rows.select("id", name.alias("name"), F.array_join(opendata.aliases(name, none), "|").alias("aliases"))


@query("area_points", f"""
    select id, round(cast(y as double) + side * case when id % 2 = 0 then 0.5 else (0.5 - 0.25 * 0.25) / 0.75 end, 9) as lat,
      round(cast(x as double) + side * case when id % 2 = 0 then 0.5 else (0.5 - 0.25 * 0.25) / 0.75 end, 9) as lon from ({_GAZETTEER})""")
def area_points(t):
    """Squares, every other one without its lower left quarter."""
    rows = t.sql(_GAZETTEER.replace("l'''", "l\\''"))
    n = lambda c: c.cast("double")
    x, y, s = n(F.col("x")), n(F.col("y")), n(F.col("side"))
    at = lambda a, b: F.concat((x + s * a).cast("string"), F.lit(" "), (y + s * b).cast("string"))
    ring = lambda *corners: F.concat(F.lit("("), F.array_join(F.array(*(at(a, b) for a, b in corners)), ", "), F.lit(")"))
    outer = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    hole = ring((0, 0), (0, 0.5), (0.5, 0.5), (0.5, 0), (0, 0))
    wkt = F.when(F.col("id") % 2 == 0, F.concat(F.lit("POLYGON("), outer, F.lit(")"))).otherwise(
        F.concat(F.lit("MULTIPOLYGON(("), outer, F.lit(", "), hole, F.lit("))")))
    return rows.select("id", opendata.area_point(wkt).alias("p")).select(
        "id", F.round("p.lat", 9).alias("lat"), F.round("p.lon", 9).alias("lon"))


@query("place_problems", """
    select 'too few' as problem, k as subject, n as rows from (
      select k, least, (select count(*) from (select * from v_places union all select * from v_places where id % 2 = 0) where kind = k) as n from (values ('barri', 3), ('district', 1), ('municipality', 10000000)) v(k, least)) where n < least
    union all select 'code twice', kind || ' ' || code, count(*) from (
      select * from v_places union all select * from v_places where id % 2 = 0) group by kind, code having count(*) > 1
    union all select 'alias of no barri', 'el Mar', 0""")
def place_problems(t):
    p = t["v_places"]
    return opendata.place_problems(
        p.unionByName(p.filter("id % 2 = 0")), {"barri": 3, "district": 1, "municipality": 10_000_000}, ("el Mar",))


# --- vectors -------------------------------------------------------------------------------------


@query("rerank_vectors", """
    with n as (select count(*) as n from embeddings),
    m as (select vec_id as request_id, (vec_id * 7 + k * k) % ((select n from n) + 5) as id from embeddings, (select unnest(range(1, 16)) as k) group by all),
    p as (select m.request_id, m.id, list_transform(a.embedding, lambda x: cast(x as double)) as x, list_transform(b.embedding, lambda x: cast(x as double)) as y
      from m join embeddings a on a.vec_id = m.request_id left join embeddings b on b.vec_id = m.id),
    s as (select request_id, id, round(list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))), 6) as likeness from p)
    select * from (select *, row_number() over (partition by request_id order by likeness desc nulls last, id) as position from s) where position <= 10""")
def rerank_vectors(t):
    e = t["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    total = t["embeddings"].agg(F.count("*")).scalar()
    steps = F.explode(F.sequence(F.lit(1), F.lit(15)))
    matched = e.select(F.col("id").alias("request_id"), steps.alias("k")).select(
        "request_id", ((F.col("request_id") * 7 + F.col("k") * F.col("k")) % (total + 5)).alias("id")).distinct()
    found = vectors.rerank(matched, e.withColumnRenamed("id", "request_id"), e, 10)
    return found.withColumn("position", F.col("position").cast("long"))
