"""Table-driven rules: names, URLs, dates, distances, markup, gazetteers."""

import random
from calendar import monthrange
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vernissage.functions import dates, geo, text, urls
from vernissage.sources import feed, html, opendata


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


NAMES = {
    "Órgano  Vivo": "organo vivo", "Nord & Süd": "nord and sud", "Nord &amp; Süd": "nord and sud", " Sala 9 -  Çelik Ömer ": "sala 9 celik omer",
    "B*C/D": "b c d", "": "", "¡!": "", "ﬂow Ĳ": "flow ij",
}


def test_normalize_name(spark):
    rows = spark.createDataFrame([(k,) for k in NAMES], "n string")
    found = {r.n: r.x for r in rows.select("n", text.normalize_name(F.col("n")).alias("x")).collect()}
    assert found == NAMES
    assert one(spark, text.title_key(F.col("n")), n=" ¡! ") == "¡!"
    assert one(spark, text.match_key(F.col("n")), n="Строка & L’Été 2") == "строка and l ete 2"


def test_base_slug(spark):
    for slug, base in (("chiquita-room-2", "chiquita-room"), ("espai-13", "espai"), ("Piramidon-2", "piramidon"), ("macba", "macba"), ("", "")):
        assert one(spark, text.base_slug(F.col("s")), s=slug) == base


@pytest.mark.parametrize(("url", "site", "social", "crawl"), [
    (None, None, None, False), ("", None, None, False), ("\t ", None, None, False), ("file:///etc", None, None, False),
    ("tel:+34000000000", None, None, False), ("museum.test/agenda", None, None, False),
    ("HTTPS://museum.test/agenda", "HTTPS://museum.test/agenda", None, True),
    ("http://instagram.com/p/1", None, "http://instagram.com/p/1", False), ("https://help.Instagram.com", None, "https://help.Instagram.com", False),
    ("https://instagr.am/a", None, "https://instagr.am/a", False),
    ("https://myinstagram.com/", "https://myinstagram.com/", None, True),
    ("https://instagram.com.test/", "https://instagram.com.test/", None, True),
])
def test_classify(spark, url, site, social, crawl):
    found = spark.createDataFrame([(url,)], "u string").select(urls.classify(F.col("u")).alias("c")).select("c.*").first()
    assert tuple(found) == (site, social, crawl)


def test_url_key(spark):
    same = ["https://www.x.cat/a/", "http://x.cat/a", "http://u:p@X.CAT:80/a#top"]
    keys = {one(spark, urls.url_key(F.col("u")), u=u) for u in same}
    assert keys == {"x.cat/a?"}
    assert one(spark, urls.url_key(F.col("u")), u="https://x.cat/a?p=2#z") == "x.cat/a?p=2"
    assert one(spark, urls.site_key(F.col("u")), u="www.x.cat:8080") == "x.cat"


def meant(start, end, fetched):
    """The run that is meant, by looking at every calendar day around."""
    days = [date(fetched.year - 4, 1, 1) + timedelta(n) for n in range(8 * 366)]

    def fits(day, written, last):
        wanted = written[0] or (monthrange(day.year, day.month)[1] if last else 1)
        return (day.day, day.month) == (wanted, written[1]) and written[2] in (None, day.year)

    if start is None or end is None:
        known = [d for d in days if (start or end) and fits(d, start or end, start is None)]
        if (start or end or (0, 0, 1))[2] is None:
            known = [d for d in known if abs(d.year - fetched.year) <= 1]
        day = min(known, key=lambda d: (abs((d - fetched).days), -d.toordinal()), default=None)
        return (day if start else None, day if end else None)
    runs = []
    for first in (d for d in days if fits(d, start, False)):
        lasts = [d for d in days if d >= first and fits(d, end, True) and (start[2] and end[2] or d.year - first.year <= 1)]
        runs += [(first, lasts[0])] if lasts else []
    if start[2] is None and end[2] is None:
        runs = [r for r in runs if abs(r[0].year - fetched.year) <= 1]
        return min(runs, key=lambda r: (max((r[0] - fetched).days, (fetched - r[1]).days, 0), -r[0].toordinal()), default=(None, None))
    return max(runs, default=(None, None))


def written_dates():
    rng = random.Random(11)
    pick = lambda: rng.choice([None, (rng.choice([None, 1, 15, 28, 29, 30, 31]), rng.randint(1, 12), None), (rng.choice([None, 3, 29, 31]), rng.randint(1, 12), rng.randint(2023, 2026))])
    cases = [(pick(), pick(), date(2024, 1, 1) + timedelta(rng.randrange(700))) for _ in range(400)]
    return cases + [((d, m, None), (e, n, None), date(2024, k, 14)) for d, m, e, n in ((29, 2, 29, 2), (20, 12, 10, 1), (1, 2, 29, 2), (31, 6, 1, 7)) for k in (1, 3, 7, 12)]


def test_resolve_dates(spark):
    cases = written_dates()
    rows = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)],
                                 "n int, s struct<day:int,month:int,year:int>, e struct<day:int,month:int,year:int>, f date")
    found = rows.select("n", dates.resolve_dates(F.col("s"), F.col("e"), F.col("f")).alias("r")).orderBy("n").collect()
    assert [(c, (r.r.start_date, r.r.end_date)) for c, r in zip(cases, found, strict=True)] == [(c, meant(*c)) for c in cases]


def test_local_day_and_instants(spark):
    assert one(spark, dates.local_day(F.col("t").cast("timestamp_ntz")), t="2026-10-31 23:30:00") == date(2026, 11, 1)
    assert one(spark, dates.local_time(F.col("t").cast("timestamp_ntz")), t="2026-11-07 18:00:00") == "19:00:00"
    assert one(spark, dates.parse_instant(F.col("t")), t="2026-10-30T18:00:00+01:00") == datetime(2026, 10, 30, 17)
    assert one(spark, dates.parse_instant(F.col("t")), t="2026-10-30T18:00:00") is None
    assert one(spark, dates.parse_instant(F.col("t"), assume_utc=True), t="2026-10-30T18:00:00") == datetime(2026, 10, 30, 18)


def test_resolve_day(spark):
    day = date(2026, 11, 5)  # a Thursday
    for spec, found in (("today", "2026-11-05"), ("tomorrow", "2026-11-06"), ("thursday", "2026-11-05"), ("wednesday", "2026-11-11"),
                        ("saturday+7", "2026-11-14"), ("today+13", "2026-11-18"), ("someday", None)):
        got = one(spark, dates.resolve_day(F.col("s"), F.lit(day)), s=spec)
        assert (got and got.isoformat()) == found


def test_distance(spark):
    metres = lambda *p: one(spark, geo.distance_m(*map(F.lit, p)))
    assert round(metres(41.3833, 2.1668, 41.3685, 2.1600)) == pytest.approx(1739, abs=5)
    assert metres(41.38, 2.17, 41.38, 2.17) == 0
    assert round(metres(41.38, 2.17, 41.40, 2.20)) == 3351
    assert metres(None, 2.17, 41.4, 2.2) is None
    assert one(spark, geo.distance_km(F.lit(250.0))) == 0.3


PAGE = """<html><head><title>T</title><base href="/ca/"></head><body><header><a href="menu">Menu <b>one</b></a><a href="#x">x</a></header>
<script>var a = "</p>";</script><main>Sala <noscript>off</noscript><p>u</p><a href="https://www.site.test/show/?p=1#a" aria-label="Show"> </a>
<a href="/doc.PDF">pdf</a><a href="menu/">again</a><a href="https://other.test/">out</a><a href="mailto:x@y">m</a>
<nav><a href="../deep"><img alt=" Deep  page "></a></nav><template>gone</template>tail</main><footer><a href="/end">End</a></footer></body></html>"""


def test_page_text_and_links(spark):
    assert one(spark, html.page_text(F.col("h")), h=PAGE) == "Menu onex Sala u pdfagainoutm tailEnd"
    assert one(spark, html.page_text(F.col("h"), 4), h=PAGE) == "Menu"
    pages = spark.createDataFrame([(1, "https://site.test/", PAGE, ["http://www.site.test/end/"])], "page_id long, url string, html string, no array<string>")
    links = html.page_links(pages).collect()
    assert [(r.number, r.url, r.text, r.region) for r in links] == [
        (1, "https://site.test/ca/menu", "Menu one", "nav"), (2, "https://www.site.test/show/?p=1", "Show", "main"),
        (3, "https://site.test/deep", "Deep page", "nav"), (4, "https://site.test/end", "End", "footer")]
    assert [r.number for r in html.page_links(pages, exclude="no").collect()] == [1, 2, 3]
    assert [r.number for r in html.page_links(pages, limit=2).collect()] == [1, 2]


def test_place_names_and_points(spark):
    for name, found in (("Garriga, la", "la Garriga"), ("Hospitalet de Llobregat, l'", "l'Hospitalet de Llobregat"), ("Girona", "Girona")):
        assert one(spark, opendata.article_first(F.col("n")), n=name) == found
    assert one(spark, opendata.aliases(F.col("n"), F.array(F.lit("el Born"))), n="la Ribera") == ["Ribera", "el Born", "Born"]
    point = spark.range(1).select(opendata.area_point(F.lit("POLYGON((2 41, 3 41, 3 42, 2 42, 2 41))")).alias("p")).first().p
    assert (point.lat, point.lon) == (41.5, 2.5)


def test_gazetteer_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿Codi,NOM,nom_comarca,latitud,longitud\n1,\"Garriga, la\",Vallès,41.68,2.28\n2,No consta,,0,0\n3,Lluny,,10,2\n4,Res,,x,2\n")
    good, bad = opendata.places(opendata.read_csv(spark, str(tmp_path / "m.csv"), "municipality"), "municipality")
    assert [(r.code, r.name, r.within, r.aliases, r.lat) for r in good.collect()] == [("1", "la Garriga", "Vallès", ["Garriga"], 41.68)]
    assert [(r.code, r.reason) for r in bad.collect()] == [("3", "point outside the box"), ("4", "no usable point")]
    ring = "POLYGON((2.1 41.3, 2.2 41.3, 2.2 41.4, 2.1 41.4, 2.1 41.3))"
    (tmp_path / "b.csv").write_text(
        f"codi_barri,nom_barri,nom_districte,geometria_etrs89,geometria_wgs84\n1,el Barri Gòtic,Ciutat Vella,POLYGON((9 9)),\"{ring}\"\n"
        "2,Altre,X,,\"POLYGON((430000 4580000, 1 1))\"\n3,Punt,X,,POINT(2 41)\n")
    good, bad = opendata.places(opendata.read_csv(spark, str(tmp_path / "b.csv"), "barri"), "barri")
    row = good.collect()[0]
    assert (row.name, row.within, row.aliases, round(row.lat, 6), round(row.lon, 6)) == (
        "el Barri Gòtic", "Ciutat Vella", ["Barri Gòtic", "Gòtic"], 41.35, 2.15)
    assert [(r.code, r.reason) for r in bad.collect()] == [("2", "polygon outside the box"), ("3", "not a polygon")]
    with pytest.raises(ValueError, match="missing"):
        opendata.read_csv(spark, str(tmp_path / "b.csv"), "district")
    with pytest.raises(ValueError, match="too few"):
        opendata.replace_places(good, str(tmp_path / "places"))


def test_feed_files(spark, tmp_path):
    (tmp_path / "venues.json").write_text(
        '[{"id": 7, "name": "L&amp;B", "slug": "lb", "address": " ", "state": "Barcelona", "latitude": "41.4", "longtitude": "2.1", "longitude": "9", "acf": []},'
        '{"id": 8, "name": "Zero", "slug": "zero", "latitude": "0.000000", "longtitude": "0.000000", "count": 3}, {"name": "no id"}]')
    raw = feed.read_payloads(spark, str(tmp_path / "venues.json"), feed.TERM_PAYLOAD)
    rows = feed.terms(raw).orderBy("id").collect()
    assert [(r.id, r.name, r.address, r.province, r.lat, r.lon, r.event_count) for r in rows] == [
        (7, "L&B", None, "Barcelona", 41.4, 2.1, 0), (8, "Zero", None, None, None, None, 3)]
    assert [r.reason for r in feed.rejects(raw, ("id", "slug")).collect()] == ["missing id, slug"]
    clean = spark.createDataFrame([('{"a": {"desc_x": "no", "b": [{"excerpt": 1, "c": 2}]}}',)], "payload string")
    with pytest.raises(ValueError, match="desc_x"):
        feed.write_capture(clean, str(tmp_path / "out"))
    scrubbed = feed.scrub_payloads(clean)
    assert scrubbed.first().payload == '{"a": {"b": [{"c": 2}]}}'
    feed.write_capture(scrubbed, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
