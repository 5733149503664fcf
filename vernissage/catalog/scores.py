"""Extraction and discovery against labels."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.catalog.crawl import key
from vernissage.catalog.registry import query
from vernissage.plans import extraction, scoring
from vernissage.session import _work_folder
from vernissage.sources import labels

DAY = date(1998, 3, 5)


@query("match_items", """
    select l.page_id, l.ord as label_ord, f.ord as found_ord from v_labels l join v_found f on f.page_id = l.page_id and f.k = l.k and f.ord < 20""")
def match_items(t):
    return _matches(t)


def _matches(t):
    return scoring.match_items(t["v_labels"], t["v_found"])


@query("match_items_repeated_titles")
def match_items_repeated_titles(t):
    """Many items of a page share a title, so who takes which depends on the order."""
    bare = F.regexp_extract("title", r"^\S+ (\S+)", 1)
    return scoring.match_items(t["v_labels"].withColumn("title", bare), t["v_found"].withColumn("title", bare))


@query("missed_items", "select page_id, ord, title from v_labels where k % 9 = 0")
def missed_items(t):
    return scoring.unmatched(t["v_labels"], _matches(t), "label_ord").select("page_id", "ord", "title")


@query("extra_items", "select page_id, ord, title from v_found where ord >= 20")
def extra_items(t):
    return scoring.unmatched(t["v_found"], _matches(t), "found_ord").select("page_id", "ord", "title")


_PAIR = "v_labels l join v_found f on f.page_id = l.page_id and f.k = l.k and f.ord < 20 join v_scored_pages p on p.page_id = l.page_id and not p.failed"
_SHARE = "case when total > 0 and metric <> 'invented' then round(hits / total, 4) end as share"


@query("score_extraction", f"""
    with pairs as (
      select l.start is not distinct from f.start and l."end" is not distinct from f."end" as dates, l.k % 4 <> 0 as artists,
        l.at_venue = f.at_venue as at_venue, l.kind = f.kind as kind, p.partial from {_PAIR}),
    found as (select f.*, p.partial from v_found f join v_scored_pages p on p.page_id = f.page_id and not p.failed),
    m as (
      select 'recall' as metric, (select count(*) from pairs) as hits, (select count(*) from v_labels) as total
      union all select 'precision', (select count(*) from pairs where not partial), (select count(*) from found where not partial)
      union all select 'invented', (select count(*) from found where page_id >= 1000000), (select count(*) from v_scored_pages where page_id >= 1000000)
      union all select 'failed', (select count(*) from v_scored_pages where failed), (select count(*) from v_scored_pages)
      union all select 'dates', count(*) filter (dates), count(*) from pairs
      union all select 'artists', count(*) filter (artists), count(*) from pairs
      union all select 'at_venue', count(*) filter (at_venue), count(*) from pairs
      union all select 'kind', count(*) filter (kind), count(*) from pairs)
    select *, {_SHARE} from m""")
def score_extraction(t):
    pages = t["v_scored_pages"]
    labels, found = t["v_labels"], t["v_found"]
    running = found.join(pages.filter("NOT failed").select("page_id"), "page_id", "left_semi")
    return scoring.score(pages, labels, found, scoring.match_items(labels, running))


@query("current_items", """
    select page_id, ord, title from v_labels where at_venue and (coalesce("end", case when kind = 'event' then start end) is null
      or coalesce("end", case when kind = 'event' then start end) >= date '1998-03-05')""")
def current_items(t):
    return scoring.current(t["v_labels"], DAY).select("page_id", "ord", "title")


@query("pages_without_current", """
    select page_id from v_scored_pages where page_id not in (
      select page_id from v_labels where at_venue and (coalesce("end", case when kind = 'event' then start end) is null
      or coalesce("end", case when kind = 'event' then start end) >= date '1999-12-05'))""")
def pages_without_current(t):
    return scoring.without_current(t["v_scored_pages"].select("page_id"), t["v_labels"], date(1999, 12, 5))


_SLASHED = key("url || '/'")


@query("label_status", f"""
    with s as (
      select {_SLASHED} as k, bool_or(raw_text is not null) as held, arg_max(content_hash, (raw_text is not null, coalesce(content_hash, ''))) as hash
      from v_pages where id % 3 <> 2 group by 1)
    select p.url || '/' as url, case when p.page_id % 6 = 0 then 'unconfirmed' when not coalesce(s.held, false) then 'unreadable'
      when p.page_id % 4 <> 1 and s.hash = sha256(p.html) then 'ready' else 'stale' end as status
    from pages p left join s on s.k = {_SLASHED.replace("url", "p.url")}""")
def label_status(t):
    k = F.col("page_id")
    gold = t["pages"].select(
        F.concat("url", F.lit("/")).alias("url"), (k % 6 != 0).alias("confirmed"),
        F.when(k % 4 == 1, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("content_hash"))
    slashed = t["v_pages"].filter("id % 3 <> 2").withColumn("url", F.concat("url", F.lit("/")))
    return scoring.label_status(gold, slashed)


@query("draft_labels", f"""
    with k as (select {key("url")} as key from pages where page_id % 4 = 0),
    p as (select id as page_id, url, kind from v_pages where raw_text is not null and {key("url")} not in (select key from k)),
    i as (
      select l.*, p.kind as page_kind, row_number() over (partition by l.page_id, l.kind order by ord) as n from v_labels l join p using (page_id))
    select p.page_id, p.url, p.kind, coalesce(bool_or(page_kind = 'listing' and n > 10), false) as partial,
      coalesce(string_agg(i.kind || ':' || title, ',' order by i.kind <> 'exhibition', ord) filter (page_kind <> 'listing' or n <= 10), '') as items
    from p left join i on i.page_id = p.page_id group by all""")
def draft_labels(t):
    pages = t["v_pages"].withColumn("venue", F.col("venue_id").cast("string"))
    items = t["v_labels"].select(
        "page_id", "kind", "ord", "title", "artists", F.col("start").alias("start_date"), F.col("end").alias("end_date"), "at_venue")
    drafted = extraction.draft_labels(pages, items, t["pages"].filter("page_id % 4 = 0"),
                                     most=vocab.MAX_ITEMS, most_listed=vocab.DRAFTED_ITEMS)
    shown = F.transform("items", lambda i: F.concat(i["kind"], F.lit(":"), i["title"]))
    return drafted.select("page_id", "url", "kind", "partial", F.array_join(shown, ",").alias("items"))


# --- discovery -----------------------------------------------------------------------------------

_JUDGED = f"""
  verdicts as (select v.name as venue_name, s.url || '/#x' as url, page_type, confidence, status, s.id from v_seeds s join v_venues v on v.id = s.venue_id where s.id % 11 <> 3),
  judged as (
    select lower(l.venue) as nk, l.venue, v.*, coalesce({key("v.url")} = {key("l.urls[1]")}, false) as listed
    from v_listings l left join verdicts v on lower(v.venue_name) = lower(l.venue)),
  outcomes as (
    select venue, case when count(url) = 0 then 'undiscovered' when count(*) filter (status = 'accepted' and not listed) > 0 then 'accepted-but-wrong'
      when count(*) filter (status = 'accepted') > 0 then 'correct' else 'ambiguous' end as outcome,
      count(*) filter (status = 'accepted' and not listed) as wrong
    from judged group by venue)"""


def _verdicts(t):
    seeds = t["v_seeds"].filter("id % 11 <> 3")
    names = t["v_venues"].select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"))
    return seeds.join(names, "venue_id").withColumn("url", F.concat("url", F.lit("/#x")))


@query("discovery_outcomes", f"with {_JUDGED} select * from outcomes")
def discovery_outcomes(t):
    return scoring.discovery_outcomes(t["v_listings"], _verdicts(t))


@query("discovery_shares", f"""with {_JUDGED}, d as (select * from outcomes where outcome <> 'undiscovered')
    select outcome, count(*) as venues, (select count(*) from d) as decided from d group by 1""")
def discovery_shares(t):
    return scoring.outcome_shares(scoring.discovery_outcomes(t["v_listings"], _verdicts(t)))


@query("discovery_wrong_urls", f"with {_JUDGED} select venue_name, url from judged where status = 'accepted' and not listed")
def discovery_wrong_urls(t):
    return scoring.wrong_urls(t["v_listings"], _verdicts(t))


@query("discovery_unlabelled", f"with {_JUDGED} select distinct venue_name from verdicts where lower(venue_name) not in (select lower(venue) from v_listings)")
def discovery_unlabelled(t):
    return scoring.unlabelled(t["v_listings"], _verdicts(t))


_TYPES = "[" + ", ".join(f"'{x}'" for x in vocab.PAGE_TYPES) + "]"
_SURE = "[" + ", ".join(f"'{x}'" for x in vocab.CONFIDENCES) + "]"


@query("discovery_calibration", f"""with {_JUDGED}
    select cast(list_position({_TYPES}, page_type) * 10 + list_position({_SURE}, confidence) as bigint) as rank, page_type, confidence,
      count(*) as candidates, count(*) filter (listed) as listings from judged where url is not null group by all""")
def discovery_calibration(t):
    return scoring.calibration(t["v_listings"], _verdicts(t))


@query("supported_share", """
    select count(*) filter (quality = 1 and lang <> 'fr') as supported, count(*) filter (lang <> 'fr') as judged,
      round(count(*) filter (quality = 1 and lang <> 'fr') / count(*) filter (lang <> 'fr'), 4) as share
    from labels join documents using (doc_id)""")
def supported_share(t):
    judged = t["labels"].join(t["documents"].select("doc_id", "lang"), "doc_id").select(
        (F.col("quality") == 1).alias("supported"), (F.col("lang") == "fr").alias("failed"))
    return scoring.supported_share(judged)


_GOLD = f"""
  g as (
    select page_id, case when page_id % 23 = 0 then 'ftp://x.example/y' when page_id % 2 = 1 and page_id % 5 = 0 then (select url from pages q where q.page_id = p.page_id - 1) || '/' else url end as url,
      case when page_id % 3 = 0 then 'listing' else 'detail' end as kind,
      case when page_id % 9 = 0 then 'nothash' else sha256(html) end as content_hash, page_id % 8 = 0 as partial from pages p),
  i as (
    select page_id, kind, title, start, case when k % 29 = 0 then start - 1 else "end" end as "end" from v_labels
    union all select page_id * 2 // 3 * 3, 'event', title, start, null from v_labels where page_id % 10 < 4)"""


def _gold(t):
    k = F.col("page_id")
    pages = t["pages"]
    before = pages.select((k + 1).alias("page_id"), F.concat("url", F.lit("/")).alias("_before"))
    gold = pages.join(before, "page_id", "left").select(
        "page_id",
        F.when(k % 23 == 0, "ftp://x.example/y").when((k % 2 == 1) & (k % 5 == 0), F.col("_before")).otherwise(F.col("url")).alias("url"),
        F.when(k % 3 == 0, "listing").otherwise("detail").alias("kind"),
        F.when(k % 9 == 0, "nothash").otherwise(F.sha2("html", 256)).alias("content_hash"), (k % 8 == 0).alias("partial"))
    labels = t["v_labels"]
    items = labels.select("page_id", "kind", "title", "start", F.when(
        F.col("k") % 29 == 0, F.date_sub("start", 1)).otherwise(F.col("end")).alias("end"))
    more = labels.filter("page_id % 10 < 4").select(
        F.expr("page_id * 2 div 3 * 3").alias("page_id"), F.lit("event").alias("kind"), "title", "start",
        F.lit(None).cast("date").alias("end"))
    again = t["v_listings"].filter("venue LIKE '%7'").withColumn("venue", F.concat(F.lit(" "), F.lower("venue")))
    return gold, items.unionByName(more), t["v_listings"].unionByName(again)


@query("gold_problems", f"""with {_GOLD}
    select title as subject, 'ends before it starts' as problem from i where "end" < start
    union all select distinct g.url, 'too many items of a kind' from (select page_id, kind from i group by 1, 2 having count(*) > 40) c join g on g.page_id = c.page_id and g.kind = 'listing'
    union all select url, 'partial but no listing' from g where partial and kind <> 'listing'
    union all select url, 'partial and empty' from g where partial and page_id not in (select page_id from i)
    union all select url, 'not a web address' from g where url like 'ftp%'
    union all select url, 'not a content hash' from g where content_hash = 'nothash'
    union all select {key("url")}, 'labelled twice' from g group by 1 having count(*) > 1
    union all select replace(lower(venue), '#', ' '), 'listed twice' from v_listings where venue like '%7'""")
def gold_problems(t):
    return scoring.gold_problems(*_gold(t))


# --- labels in files ------------------------------------------------------------------------------


def _gold_files(t):
    """Labelled pages as one JSON document a line, optional keys left out where they hold the default."""
    item = F.struct(
        F.when(F.col("kind") != "exhibition", F.col("kind")).alias("kind"), F.concat(F.lit("  "), F.col("title"), F.lit(" ")).alias("title"),
        F.when(F.col("k") % 3 > 0, F.col("artists")).alias("artists"), "start", "end", F.when(~F.col("at_venue"), F.col("at_venue")).alias("at_venue"))
    # The labels of one page, a bounded list by the model.
    listed = t["v_labels"].groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("k", item.alias("i")))).alias("s"))
    pages = t["pages"].join(listed, "page_id", "left").select(
        "page_id", "url", F.when(F.col("page_id") % 4 > 0, F.lit("v")).alias("venue"), F.lit("listing").alias("kind"),
        F.when(F.col("page_id") % 5 == 0, F.lit(True)).alias("confirmed"), F.when(F.col("page_id") % 7 == 0, F.lit(True)).alias("partial"),
        F.col("s.i").alias("items"))
    path = f"{_work_folder(t.spark)}/gold-{uuid.uuid4().hex}"
    pages.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return labels.read_gold(t.spark, path)


@query("read_gold_pages", """
    select page_id, url, case when page_id % 4 > 0 then 'v' end as venue, 'listing' as kind, cast(null as varchar) as content_hash,
      page_id % 5 = 0 as confirmed, page_id % 7 = 0 as partial from pages""")
def read_gold_pages(t):
    return _gold_files(t)[0]


@query("read_gold_items", """
    select page_id, row_number() over (partition by page_id order by k) - 1 as ord, kind, trim(title) as title,
      case when k % 3 > 0 then array_to_string(artists, '|') else '' end as artists, start, "end", at_venue
    from v_labels join pages using (page_id)""")
def read_gold_items(t):
    return _gold_files(t)[1].withColumn("artists", F.array_join("artists", "|"))
