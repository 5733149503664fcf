"""Requests with a point and no radius: the same rows as all pairs would give, from few pairs."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from vernissage.functions.geo import distance_km, distance_m
from vernissage.plans import search

REQUEST = ("request_id long, date_from date, date_to date, near string, lat double, lon double, radius_km double, kinds array<string>, "
           "free_only boolean, rows int")
ITEM = "id string, kind string, is_free boolean, first_day date, last_day date, place_venue_id long"


def _tables(spark, n, seed=1):
    rng = random.Random(seed)
    venues = [(i, rng.choice([41.4, 41.4 + rng.random(), rng.uniform(-80, 80)]), rng.choice([2.1, 2.1 + rng.random(), rng.uniform(-180, 180)])) for i in range(400)]
    venues += [(900, None, None)]
    day = date(2024, 1, 1)
    items = []
    for i in range(n):
        first = day + timedelta(rng.randrange(200))
        items.append((f"x:{i}", rng.choice(["talk", "exhibition"]), rng.choice([True, False, None]), rng.choice([first, first, None]),
                      rng.choice([first + timedelta(rng.randrange(40)), None]), rng.choice([rng.randrange(400), 900, None, 7])))
    requests = []
    for i in range(60):
        at = day + timedelta(rng.randrange(200))
        requests.append((i, at, at + timedelta(rng.randrange(10)), None, rng.choice([41.4, rng.uniform(-89, 89)]), rng.choice([2.1, 179.99, rng.uniform(-180, 180)]),
                         None, rng.choice([None, ["talk"]]), rng.choice([True, False]), rng.choice([1, 5, 20])))
    requests.append((99, date(1900, 1, 1), date(1900, 1, 2), None, 0.0, 0.0, None, ["talk"], False, 3))
    return (spark.createDataFrame(requests, REQUEST), spark.createDataFrame(items, ITEM), spark.createDataFrame(venues, "id long, lat double, lon double"))


def _plain(requests, items, venues):
    meets = (F.coalesce(F.col("first_day") <= F.col("date_to"), F.lit(True)) & F.coalesce(F.col("last_day") >= F.col("date_from"), F.lit(True)))
    placed = items.join(venues.select(F.col("id").alias("place_venue_id"), F.col("lat").alias("vlat"), F.col("lon").alias("vlon")), "place_venue_id", "left")
    return requests.join(placed, meets & search._wanted()).withColumn(
        "metres", distance_m(F.col("vlat"), F.col("vlon"), F.col("lat"), F.col("lon"))).withColumn("distance_km", distance_km(F.col("metres")))


def _first(pairs):
    by = {}
    for r in pairs.collect():
        by.setdefault((r.request_id, r.rows), []).append((r.distance_km is None, r.distance_km or 0, r.last_day is None, r.last_day or date.min,
                                                          r.first_day is not None, r.first_day or date.min, r.id))
    return {k: sorted(v)[: k[1]] for k, v in by.items()}


def test_nearest_equals_all_pairs(spark):
    requests, items, venues = _tables(spark, 1500)
    total = search.by_day(requests, items)[0]
    pairs = search.nearest(requests, items, venues, total)
    plain = _plain(requests, items, venues)
    assert _first(pairs) == _first(plain)
    assert {(r.request_id, r.total) for r in total.collect()} == {(r.request_id, r["count"]) for r in plain.groupBy("request_id").count().collect()}


def test_pairs_do_not_grow_with_the_items(spark):
    """Venues spread over a country: eight times the items, about as many pairs."""
    pairs = []
    for n in (1500, 12_000):
        rng = random.Random(n)
        requests, items, _ = _tables(spark, n)
        venues = spark.createDataFrame([(i, rng.uniform(40, 43), rng.uniform(0, 4)) for i in range(n)], "id long, lat double, lon double")
        items = items.withColumn("place_venue_id", F.substring("id", 3, 9).cast("long"))
        requests = requests.filter("request_id < 60 AND rows = 5").withColumns({"lat": 40 + F.col("request_id") % 4, "lon": (F.col("request_id") % 5).cast("double")})
        requests = requests.withColumn("lat", F.col("lat").cast("double"))
        pairs.append(search.nearest(requests, items, venues, search.by_day(requests, items)[0]).count())
    assert pairs[1] < 2 * pairs[0]
