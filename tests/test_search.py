"""Search, hydrate and browse over the invented corpus: exact ids, order, totals."""

from datetime import date, datetime
from decimal import Decimal

import corpus
import pytest
from test_rings import _plain

from vernissage.operators.places import place_names, resolve_places
from vernissage.plans import browse, costs, search
from vernissage.plans.quality import leaked
from vernissage.session import materialize

WEEKEND = (date(2026, 11, 5), date(2026, 11, 8))
REQUESTS = {
    # name: (from, to, near, lat, lon, km, kinds, free, rows), (ids, total)
    "weekend": ((*WEEKEND, None, None, None, None, None, False, 40), ("a:2 g:4 x:4 g:7 x:1 x:3", 6)),
    "later": ((date(2027, 3, 1), date(2027, 3, 2), None, None, None, None, None, False, 40), ("x:3", 1)),
    "before": ((date(2025, 1, 1), date(2025, 1, 2), None, None, None, None, None, False, 40), ("", 0)),
    "twins": ((date(2026, 10, 20), date(2026, 10, 25), None, None, None, None, None, False, 40), ("x:1 x:3", 2)),
    "one day": ((date(2026, 11, 6), date(2026, 11, 6), None, None, None, None, None, False, 40), ("x:4 g:7 x:1 x:3", 4)),
    "1 km": ((*WEEKEND, None, 41.38, 2.17, 1.0, None, False, 40), ("a:2 g:7 x:1 x:3", 4)),
    "5 km": ((*WEEKEND, None, 41.38, 2.17, 5.0, None, False, 40), ("a:2 g:7 x:1 x:3 g:4", 5)),
    "no radius": ((*WEEKEND, None, 41.38, 2.17, None, None, False, 40), ("a:2 g:7 x:1 x:3 g:4 x:4", 6)),
    "near": ((*WEEKEND, "poblenou", None, None, 1.0, None, False, 40), ("g:4", 1)),
    "shows": ((*WEEKEND, None, None, None, None, ["exhibition"], False, 40), ("x:4 g:7 x:1 x:3", 4)),
    "openings": ((*WEEKEND, None, None, None, None, ["opening"], False, 40), ("g:4", 1)),
    "free": ((*WEEKEND, None, None, None, None, None, True, 40), ("a:2 g:4 x:4 x:1 x:3", 5)),
    "cut": ((*WEEKEND, None, None, None, None, None, False, 2), ("a:2 g:4", 6)),
}
SCHEMA = ("request_id string, date_from date, date_to date, near string, lat double, lon double, radius_km double, "
          "kinds array<string>, free_only boolean, rows int")


@pytest.fixture(scope="module")
def tables(spark):
    return {name: getattr(corpus, name)(spark) for name in
            ("venues", "exhibitions", "events", "snapshots", "occurrences")}


@pytest.fixture(scope="module")
def answers(spark, tables):
    asked = spark.createDataFrame([(name, *r) for name, (r, _) in REQUESTS.items()], SCHEMA)
    accepted, refused = search.check_requests(asked, place_names(corpus.places(spark), tables["venues"]))
    assert refused.count() == 0
    found = materialize(search.candidates(**tables))
    rows = search.search(accepted, found, tables["venues"]).orderBy("position").collect()
    totals = search.search_totals(accepted, found, tables["venues"]).collect()
    plain = _plain(accepted, found, tables["venues"]).filter("radius_km IS NULL OR metres <= radius_km * 1000").groupBy("request_id").count()
    counted = {r.request_id: r["count"] for r in plain.collect()}
    assert {r.request_id: r.total for r in totals} == {name: counted.get(name, 0) for name in REQUESTS}
    return rows, {r.request_id: r for r in totals}


@pytest.mark.parametrize("name", REQUESTS)
def test_ids_order_and_total(answers, name):
    rows, totals = answers
    ids, total = REQUESTS[name][1]
    mine = [r for r in rows if r.request_id == name]
    assert " ".join(r.id for r in mine) == ids
    assert totals[name].total == total
    assert totals[name].truncated == (total > len(mine))
    assert all(r.total == total for r in mine)


def test_days_and_distances(answers):
    rows, _ = answers
    of = lambda name: {r.id: r for r in rows if r.request_id == name}
    assert [r.ends_in_days for r in of("weekend").values()] == [0, 2, 3, 15, 25, None]
    assert {r.distance_km for r in of("1 km").values()} == {0.0}
    assert of("5 km")["g:4"].distance_km == 3.4 and of("near")["g:4"].distance_km == 0.2
    assert of("no radius")["x:4"].distance_km is None


def test_refusals(spark, tables):
    day = date(2026, 11, 5)
    bad = {
        "dates reversed": (date(2026, 11, 6), day, None, None, None, None, None, False, 40),
        "lat and lon come together": (day, day, None, 41.0, None, None, None, False, 40),
        "near or lat and lon, not both": (day, day, "Poblenou", 41.0, 2.0, None, None, False, 40),
        "radius without a point": (day, day, None, None, None, 2.0, None, False, 40),
        "unknown kind": (day, day, None, None, None, None, ["party"], False, 40),
        "unknown place": (day, day, "Atlantis", None, None, None, None, False, 40),
        "several places": (day, day, "exemple", None, None, None, None, False, 40),
    }
    asked = spark.createDataFrame([(n, *r) for n, r in bad.items()], SCHEMA)
    accepted, refused = search.check_requests(asked, place_names(corpus.places(spark), tables["venues"]))
    assert accepted.count() == 0
    assert {(r.request_id, r.reason) for r in refused.collect()} == {(n, n) for n in bad}


def test_places_by_name_alias_and_qualified_name(spark, tables):
    asked = ["el poblenou", "POBLENOU", "el Poblenou, Sant Marti", "Annex Exemple, Barcelona", "22", "exemple", "Sala 100% Lluny", "??"]
    names = place_names(corpus.places(spark), tables["venues"])
    found = resolve_places(spark.createDataFrame([(a,) for a in asked], "asked string"), names).collect()
    status = {r.asked: (r.status, r.name) for r in found if r.position in (None, 1)}
    assert status["el poblenou"] == status["POBLENOU"] == status["el Poblenou, Sant Marti"] == ("place", "el Poblenou")
    assert status["Annex Exemple, Barcelona"] == ("place", "Annex Exemple")
    assert status["22"] == status["??"] == status["Sala 100% Lluny"] == ("unknown", None)
    assert [r.name for r in sorted(found, key=lambda r: r.position or 0) if r.asked == "exemple"] == ["Annex Exemple", "Galeria Exemple"]


def test_hydrate(spark, tables):
    asked = spark.createDataFrame([(1, ["g:3", "x:01", "x:1", "a:2", "x:99"]), (2, ["x:1", "y:2"]), (3, [f"x:{n}" for n in range(11)])],
                                  "request_id long, ids array<string>")
    facts = search.details(**tables)
    rows = search.hydrate(asked, facts, 10).orderBy("request_id", "position").collect()
    assert [r.id for r in rows] == ["g:3", "x:1", "a:2"]  # a hidden twin is still found by id
    assert rows[0].title_en == "PROVA Ú." and rows[1].url == corpus.DETAIL
    assert (rows[2].exhibition_id, rows[2].start_time, rows[2].end) == ("x:1", "19:00", date(2026, 11, 5))
    assert [(r.request_id, r.id) for r in search.not_found(asked, facts, 10).collect()] == [(1, "x:99")]
    assert {(r.request_id, r.reason) for r in search.asked_ids(asked, 10)[1].collect()} == {(2, "not an id"), (3, "too many ids")}


def test_browse(spark, tables):
    v, pages = tables["venues"], corpus.pages(spark)
    rows = browse.venues(v, pages, tables["exhibitions"], tables["events"]).collect()
    assert [(r.name, r.pages, r.exhibitions, r.events) for r in rows] == [("Galeria Exemple", 4, 4, 3)]
    every = lambda name: [r.name for r in browse.venues(v, pages, tables["exhibitions"], tables["events"], pilot_only=False, name=name).collect()]
    assert every("EXEMPLE") == ["Annex Exemple", "Galeria Exemple"]
    assert every("100%") == ["Sala 100% Lluny"] and every("_") == []
    shows = browse.exhibitions(tables["exhibitions"], v, not_over_on=date(2026, 10, 31)).collect()
    assert [r.id for r in shows] == [3, 1, 4]
    assert [r.id for r in browse.art_events(tables["events"], v, not_over_on=date(2026, 10, 31)).collect()] == [2, 3]
    feed = browse.feed_events(tables["snapshots"], tables["occurrences"], v, not_over_on=date(2026, 11, 1)).collect()
    assert [r.event_id for r in feed] == [1, 3, 5, 6, 4, 4]  # 23:30 UTC on 31 October is 1 November there


def test_page_listing_holds_no_text(spark, tables):
    listed = browse.pages(corpus.pages(spark), tables["venues"])
    rows = {r.id: r for r in listed.collect()}
    assert [r.kind for r in listed.collect()] == ["listing", "listing", "listing", "detail"]
    assert (rows[1].text_held, rows[1].words, rows[1].link_count, rows[1].text_extracted) == (True, 4, 1, True)
    assert (rows[2].text_held, rows[2].words, rows[2].link_count) == (False, None, None)
    assert rows[3].text_extracted is False and rows[4].text_extracted is False
    assert leaked(listed, corpus.MARKER).count() == 0
    assert leaked(corpus.pages(spark), corpus.MARKER).count() == 1


def test_costs(spark):
    calls = spark.createDataFrame([
        (datetime(2026, 10, 7, 10), "haiku", "discover", 5000, 200, 0, 0, Decimal("0.006"), None),
        (datetime(2026, 10, 30, 10), "haiku", "extract", 9000, 3000, 0, 0, Decimal("0.024"), None),
        (datetime(2026, 10, 30, 10, 5), "haiku", "extract", 100, 0, 0, 0, Decimal("0.0001"), "ClientError"),
    ], "created_at timestamp_ntz, model string, purpose string, input_tokens long, output_tokens long, cache_creation_input_tokens long, "
       "cache_read_input_tokens long, cost_usd decimal(12,6), error_type string")
    rows = costs.call_costs(calls).collect()
    assert [(r.purpose, r.calls, r.errors, r.input_tokens, r.output_tokens, r.cost_usd) for r in rows] == [
        ("extract", 2, 1, 9100, 3000, Decimal("0.024100")), ("discover", 1, 0, 5000, 200, Decimal("0.006000"))]
    assert [r.purpose for r in costs.call_costs(calls, since=date(2026, 10, 30)).collect()] == ["extract"]
