"""Merges: a second run changes nothing but last seen, versions publish whole, plans stay joinable."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vernissage.catalog.views import Tables
from vernissage.plans import extraction, search, sync
from vernissage.plans.quality import violations
from vernissage.sources import labels, snapshots
from vernissage.streaming import jobs

SF = "/root/testdata/sf0.001"
FIRST, SECOND = datetime(2002, 1, 1), datetime(2002, 1, 2)


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def test_venue_merge_is_idempotent(t):
    from vernissage.catalog.sync import planned

    plan = planned(t)
    once = sync.merge_venues(t["v_now_venues"], plan, FIRST).drop("change")
    twice = sync.merge_venues(once, plan, SECOND)
    assert twice.filter("change <> 'kept'").count() == 0
    assert twice.filter(F.col("updated_at") == F.lit(SECOND).cast("timestamp_ntz")).count() == 0
    moved = plan.withColumn("lat", F.col("lat") + 1e-9)
    changed = sync.merge_venues(once, moved, SECOND).filter("change = 'changed'").count()
    assert changed == plan.filter("lat IS NOT NULL").count()
    with pytest.raises(sync.RefusedMerge):
        sync.require_rows(plan.limit(0))


def test_item_merge_is_idempotent(t):
    from vernissage.catalog.items import _new, _stored

    new = _new(t, 0)
    once = extraction.merge_items(_stored(t["v_stored_shows"]), new, FIRST)
    twice = extraction.merge_items(once, new, SECOND)
    same = ["id", "venue_id", "title_key", "title", "start_date", "end_date", "artists", "media", "summary_en", "first_seen_at"]
    assert once.select(*same).exceptAll(twice.select(*same)).count() == 0


def test_summaries_keep_the_longest_and_false_is_a_value(spark, t):
    rows = _shows = [("A", "long one", True, ["x"]), ("a!", "short", False, []), ("A", None, None, ["y"])]
    columns = extraction._SCALARS
    df = spark.createDataFrame([(1, n, s, h, a) for n, (_, s, h, a) in enumerate(rows)], "venue_id long, item_ord long, summary_en string, at_venue boolean, artists array<string>")
    titles = spark.createDataFrame([(n, x[0]) for n, x in enumerate(_shows)], "item_ord long, title string")
    df = df.join(titles, "item_ord").withColumn("page_ord", F.lit(0))
    for c in (*columns, "themes", "media"):
        if c not in df.columns:
            kind = dict(t["v_stored_shows"].dtypes)[c]
            df = df.withColumn(c, F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind))
    row = extraction.merge_items(t["v_stored_shows"].limit(0), df, FIRST).collect()
    assert [(r.title, r.summary_en, r.at_venue, r.artists) for r in row] == [("A", "long one", False, ["y"])]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(10).withColumn("v", F.lit(1))
    assert snapshots.write_snapshot(df, path, ["id"]) == 1
    assert snapshots.write_snapshot(df.limit(3), path, ["id"], dry_run=True) == 1
    assert snapshots.read_snapshot(spark, path).count() == 10
    with pytest.raises(ValueError, match="repeats"):
        snapshots.write_snapshot(df.unionByName(df), path, ["id"])
    assert snapshots.write_snapshot(df.limit(4), path, ["id"]) == 2
    assert snapshots.read_snapshot(spark, path).count() == 4


def test_labels_and_scenarios(spark, tmp_path):
    (tmp_path / "gold.json").write_text('{"page_id": 1, "url": "https://x/a", "venue": "V", "kind": "listing", "content_hash": "h", '
                                        '"items": [{"title": " A "}, {"kind": "event", "title": "B", "at_venue": false, "start": "2026-01-02"}]}\n')
    pages, items = labels.read_gold(spark, str(tmp_path / "gold.json"))
    assert (pages.first().confirmed, pages.first().partial) == (False, False)
    assert [(r.ord, r.kind, r.title, r.artists, r.at_venue) for r in items.collect()] == [(0, "exhibition", "A", [], True), (1, "event", "B", [], False)]
    (tmp_path / "s.json").write_text('{"id": "s", "persona": "p", "profile": [{"topic": "area", "fact": "f"}], "turns": ['
                                     '{"user": "a", "expect": {"dates": ["saturday", "sunday"], "free": true}}, {"user": "b", "expect": {"free": null, "area": {"near": "X", "km": 2}}}, {"user": "c"}]}\n')
    _, turns, facts = labels.read_scenarios(spark, str(tmp_path / "s.json"))
    from vernissage.plans.dialogue import carry_constraints

    carried = carry_constraints(turns).orderBy("turn").collect()
    assert [(r.dates, r.free, r.area and r.area.near) for r in carried] == [
        (["saturday", "sunday"], True, None), (["saturday", "sunday"], None, "X"), (["saturday", "sunday"], None, "X")]
    assert facts.count() == 1


def test_clean_tables_break_no_rule(t):
    venues = t["v_venues"]
    assert violations({"venues": venues, "snapshots": t["v_snapshots"], "seeds": t["v_seeds"]}).count() == 0


@pytest.mark.parametrize("name", ["search_candidates", "feed_twins", "match_profiles", "merge_venues", "merge_events", "shared_runs",
                                  "resolve_places", "crawl_targets", "off_constraint", "named_items", "sessionize", "search"])
def test_no_plan_compares_all_pairs(spark, name):
    from vernissage.catalog import load
    from vernissage.catalog.registry import QUERIES

    load()
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_search_reads_only_what_it_orders_by(spark, t):
    from vernissage.catalog.read import candidates, requests
    from vernissage.session import materialize

    found = materialize(candidates(t))
    plan = search.matches(requests(t), found, t["v_venues"])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "place_venue_id" in line]
    assert scans and all("title" not in line and "artists" not in line for line in scans)


def test_empty_plan_is_refused(spark):
    from vernissage.catalog.sync import planned

    t = Tables(spark, SF)
    with pytest.raises(sync.RefusedMerge):
        sync.merge_venues(t["v_now_venues"], planned(t).limit(0), FIRST)


def test_streamed_merges_do_not_depend_on_batches(spark):
    """One batch, two, reversed and repeated: a post is stamped with its own fetches, and an older
    fetch never beats a newer one."""
    columns = ("source_event_id string, source_venue_id string, title string, title_en string, source_category_id int, is_free boolean, "
               "price_min decimal(8,2), price_max decimal(8,2), is_online boolean, source_url string, web_url_ca string, web_url_es string, "
               "web_url_en string, source_modified_at timestamp_ntz, ord long, fetched_at timestamp_ntz")
    row = lambda post, day: (post, None, f"{post} {day}", *[None] * 11, 1, datetime(2024, 1, day))
    one, two = [row("a", 1), row("b", 1)], [row("a", 2), row("c", 2)]
    venues = spark.createDataFrame([], "id long, source_venue_id string")
    empty = spark.createDataFrame([], "id long, source_event_id string, venue_id long, " + columns.split(", ", 2)[2].replace(
        ", ord long, fetched_at timestamp_ntz", "") + ", first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    results = []
    for batches in ([one + two], [one, two], [two, one], [one, two, one]):
        table = empty
        for b in batches:
            table = jobs.event_merge(table, spark.createDataFrame(b, columns), venues)["table"]
        results.append({(r.source_event_id, r.title, r.first_seen_at.day, r.last_seen_at.day) for r in table.collect()})
    assert results == [{("a", "a 2", 1, 2), ("b", "b 1", 1, 1), ("c", "c 2", 2, 2)}] * 4


def test_second_writer_is_refused_and_harms_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first, second = spark.range(5), spark.range(9)
    snapshots.write_snapshot(first, path, ["id"])
    # A writer that still sees version 0 tries to publish version 1 again.
    real = snapshots.current_version
    stale = [0]
    monkeypatch.setattr(snapshots, "current_version", lambda *a: stale.pop() if stale else real(*a))
    try:
        snapshots.write_snapshot(second, path, ["id"])
    except ValueError as refused:
        assert "another writer" in str(refused)
        assert snapshots.read_snapshot(spark, path).count() == 5
    else:
        assert snapshots.read_snapshot(spark, path).count() == 9
    monkeypatch.undo()
    assert real(spark, path) == 1


def test_text_after_an_unclosed_element_and_payload_that_is_no_json(spark):
    from vernissage.sources import feed, html

    page = spark.createDataFrame([("<p>a</p><div><svg><path></div><p>rest of page</p>",)], "h string")
    assert page.select(html.page_text(F.col("h")).alias("t")).first().t == "arest of page"
    raw = spark.createDataFrame([(1, '{"a": 1'), (2, '{"a": 1, "excerpt": 2}'), (3, None)], "id long, payload string")
    assert [r.payload for r in feed.scrub_payloads(raw).orderBy("id").collect()] == [None, '{"a": 1}', None]
    assert [(r.id, r.reason) for r in feed.malformed(raw, "id").collect()] == [(1, "not JSON")]
