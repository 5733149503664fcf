"""Radius joins against all pairs: crowded spots, the date line, poles, and how much is compared."""

import random

import pytest
from pyspark.sql import functions as F

from vernissage.functions.geo import distance_m
from vernissage.operators import nearby

CENTER, POINT = "cid long, lat double, lon double, radius_m double", "pid long, lat double, lon double"


def _tables(spark, seed=5, n=1500):
    rng = random.Random(seed)
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(n // 3)]
    points += [(n + i, 41.38 + rng.uniform(-1e-4, 1e-4), 2.17 + rng.uniform(-1e-4, 1e-4)) for i in range(n // 3)]
    points += [(2 * n + i, rng.uniform(-3, 3), rng.choice([-1, 1]) * rng.uniform(179, 180)) for i in range(n // 6)]
    points += [(3 * n + i, 41.5, 2.0) for i in range(n // 6)] + [(4 * n, 90.0, 10.0), (4 * n + 1, -90.0, 0.0), (4 * n + 2, None, 1.0), (4 * n + 3, 10.0, 180.0)]
    centers = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice([1e3, 1e5, 2e6, 1.2e7, 3e7])) for i in range(40)]
    centers += [(100, 41.38, 2.17, 50.0), (101, 0.0, 179.9, 2e5), (102, 0.5, -179.95, 3e5), (103, 89.9, 0.0, 5e5), (104, -90.0, 0.0, 1e6),
                (105, 41.5, 2.0, 0.0), (106, 10.0, -180.0, 5.0), (107, None, 1.0, 9.0), (108, 1.0, 1.0, None), (109, 0.0, 541.0, 1e5), (110, 41.4, 2.1, 2.1e7)]
    return spark.createDataFrame(centers, CENTER), spark.createDataFrame(points, POINT)


@pytest.mark.parametrize("small", [8, 512])
def test_within_radius_equals_all_pairs(spark, small):
    centers, points = _tables(spark)
    got = {(r.cid, r.pid) for r in nearby.within_radius(centers, points, small=small).collect()}
    every = centers.withColumnsRenamed({"lat": "a", "lon": "b"}).join(points, how="cross").withColumn(
        "m", distance_m(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))).filter("m <= radius_m")
    assert got == {(r.cid, r.pid) for r in every.collect()} and len(got) > 3000


def test_leaves_are_small_and_hold_every_point_once(spark):
    _, points = _tables(spark)
    leaves = nearby.quadtree(points.filter("lat IS NOT NULL"), 32).collect()
    assert sum(r.n for r in leaves) == points.filter("lat IS NOT NULL").count()
    assert all(r.n <= 32 or r.level == nearby.DEEPEST for r in leaves)
    # 250 points of one spot are one leaf, which is dealt to blocks.
    assert sum(r.n > 32 for r in leaves) >= 1


def test_a_crowded_cell_is_not_compared_whole(spark):
    """A third of all points within a kilometre: a small circle beside them meets few of their leaves."""
    rng = random.Random(2)
    points = spark.createDataFrame([(i, 41.0 + rng.random() / 100, 2.0 + rng.random() / 100) for i in range(6000)], POINT)
    centers = spark.createDataFrame([(1, 41.0, 2.0, 30.0), (2, 41.01, 2.01, 30.0)], CENTER)
    leaves = nearby.quadtree(points, 64)
    met = nearby._leaves_near(centers.withColumnsRenamed({"lat": "_clat", "lon": "_clon"}), leaves)
    assert met.agg(F.sum("_n")).first()[0] < 600


def test_nothing(spark):
    centers, points = _tables(spark)
    assert nearby.within_radius(centers.limit(0), points).count() == nearby.within_radius(centers, points.limit(0)).count() == 0
