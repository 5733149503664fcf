"""A small invented corpus with one of everything the read queries use."""

from datetime import date, datetime
from decimal import Decimal

LISTING = "https://galeria-exemple.test/ca/exposicions/"
DETAIL = "https://galeria-exemple.test/ca/exposicions/prova-u"
AGENDA = "https://galeria-exemple.test/ca/agenda"
MARKER = "frase-plantada-7781"
SYNC, EARLIER = datetime(2026, 10, 30, 3), datetime(2026, 10, 20, 3)
HOME = "https://galeria-exemple.test/"


def venues(spark):
    return spark.createDataFrame([
        (1, 101, 501, "Galeria Exemple", "galeria-exemple", "Carrer Inventat 1", "Barcelona", 41.38, 2.17, HOME, None, True, True),
        (2, 102, None, "Sala 100% Lluny", "sala-lluny", None, "Girona", None, None, None, None, False, False),
        (3, 103, 501, "Annex Exemple", "annex-exemple", None, "Barcelona", 41.40, 2.20, HOME, None, False, False),
    ], "id long, source_venue_id long, source_profile_id long, name string, slug string, address string, city string, lat double, "
       "lon double, website_url string, instagram_url string, crawl_enabled boolean, is_pilot boolean")


def places(spark):
    return spark.createDataFrame(
        [("barri", 1, "el Poblenou", ["Poblenou"], "Sant Martí", 41.40, 2.2024)],
        "kind string, id long, name string, aliases array<string>, within string, lat double, lon double")


_ITEM = ("id long, venue_id long, title string, title_key string, artists array<string>, start_date date, end_date date, at_venue boolean, "
         "detail_url string, summary_en string, themes array<string>, media array<string>, confidence string, source_url string, "
         "content_hash string, model string, extract_version int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")


def _item(id_, title, key, start, end, here=True, url=None, summary=None, artists=()):
    return (id_, 1, title, key, list(artists), start, end, here, url, summary, [], [], "high", LISTING, "a" * 64, "m", 3, SYNC, SYNC)


def exhibitions(spark):
    return spark.createDataFrame([
        _item(1, "Prova U", "prova u", date(2026, 9, 12), date(2026, 11, 30), url=DETAIL, summary="Drawings on paper.", artists=["Artista Inventada"]),
        _item(2, "Arxiu", "arxiu", date(2026, 6, 1), date(2026, 9, 1)),
        _item(3, "Col·lecció", "colleccio", date(2026, 1, 1), None),
        _item(4, "Stand a la fira", "stand a la fira", date(2026, 11, 6), date(2026, 11, 8), here=False),
    ], _ITEM)


def events(spark):
    return spark.createDataFrame([
        (*_item(1, "Xerrada", "xerrada", date(2026, 9, 10), None), "talk", None, None),
        (*_item(2, "Visita", "visita", date(2026, 11, 5), None), "guided_tour", "19:00", 1),
        (*_item(3, "Taller", "taller", None, None), "workshop", None, None),
    ], _ITEM + ", kind string, start_time string, exhibition_id long")


def snapshots(spark):
    def row(id_, venue, title, en, category, free, price=None, web=None, seen=SYNC):
        return (id_, 9000 + id_, venue, title, en, category, free, price, None, None, f"https://feed.test/e/{id_}", web, None, None, seen)

    return spark.createDataFrame([
        row(1, 1, "Prova U", None, 103, True), row(2, None, "Fira", None, None, False, Decimal("12.50")),
        row(3, 3, "Assaig U", "PROVA Ú.", 103, None),
        row(4, 3, "Nit Oberta", None, 189, True, web="https://annex-exemple.test/nit"),
        row(5, 1, "Retirat", None, 103, None, seen=EARLIER), row(6, 1, "Arxiu", None, 103, False),
    ], "id long, source_event_id long, venue_id long, title string, title_en string, source_category_id int, is_free boolean, "
       "price_min decimal(8,2), price_max decimal(8,2), is_online boolean, source_url string, web_url_ca string, web_url_es string, "
       "web_url_en string, last_seen_at timestamp_ntz")


def occurrences(spark):
    at = datetime
    return spark.createDataFrame([
        (1, 1, 1, at(2026, 9, 12, 10), at(2026, 10, 31, 23, 30), SYNC), (2, 2, 2, at(2026, 10, 1, 10), None, SYNC),
        (3, 3, 3, at(2026, 10, 15, 9), at(2026, 11, 30, 18), SYNC), (4, 4, 4, at(2026, 11, 7, 18), at(2026, 11, 7, 21), SYNC),
        (5, 4, 5, at(2026, 11, 6, 18), at(2026, 11, 6, 21), EARLIER), (6, 5, 6, at(2026, 11, 1, 10), at(2026, 11, 30, 18), EARLIER),
        (7, 6, 7, at(2026, 11, 3, 10), at(2026, 11, 20, 18), SYNC),
    ], "id long, event_id long, source_occurrence_id long, starts_at timestamp_ntz, ends_at timestamp_ntz, last_seen_at timestamp_ntz")


def pages(spark):
    seen, marks = datetime(2026, 10, 30, 9), datetime(2026, 10, 30, 10)
    a, b, c, d = ("a" * 64, "b" * 64, "c" * 64, "d" * 64)
    link = [(1, DETAIL, MARKER)]
    return spark.createDataFrame([
        (1, 1, LISTING, "listing", "ok", 200, a, f"Exposicions {MARKER} Prova U", link, seen, "ok", a, 3, "m", 2, marks),
        (2, 1, DETAIL, "detail", "ok", 200, b, None, None, datetime(2026, 10, 1, 9), "ok", b, 3, "m", 1, marks),
        (3, 1, AGENDA, "listing", "ok", 200, c, "agenda nova", None, seen, "ok", d, 3, "m", 0, marks),
        (4, 1, "https://galeria-exemple.test/ca/", "listing", "thin", 200, None, None, None, seen, None, None, None, None, None, None),
    ], "id long, venue_id long, url string, kind string, status string, http_status int, content_hash string, raw_text string, "
       "links array<struct<number:int,url:string,text:string>>, fetched_at timestamp_ntz, extract_status string, extracted_hash string, "
       "extract_version int, extract_model string, extracted_items long, extracted_at timestamp_ntz")
