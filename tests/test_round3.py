"""What the third review found, each on small rows of its own."""

from __future__ import annotations

import os

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from vernissage.operators import matching
from vernissage.sources import opendata

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twice(tmp_path_factory):
    """The smallest tables, with every third page at the address of the page before it."""
    folder = tmp_path_factory.mktemp("twice")
    for table in oracle.BASE:
        if table != "pages":
            os.symlink(f"{SF}/{table}.parquet", folder / f"{table}.parquet")
    duckdb.execute(f"""copy (
        select a.page_id, case when a.page_id % 3 = 1 then b.url else a.url end as url, a.html
        from '{SF}/pages.parquet' a left join '{SF}/pages.parquet' b on b.page_id = a.page_id - 1) to '{folder}/pages.parquet'""")
    return str(folder)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_term_keys_are_not_gathered_on_the_driver(spark):
    """A term has many keys, which Spark counts as one row: no join may broadcast them."""
    rows = [(1, "a b c d e f", "a"), (2, "c d", "b"), (3, "x c d y", "b-2")]
    terms = spark.createDataFrame(rows, "id long, name string, slug string")
    profiles = spark.createDataFrame([(7, "c d e", "q"), (8, "c d", "r"), (9, "zz", "b")], "id long, name string, slug string")
    decided = matching.decide(terms, profiles)
    assert "SortMergeJoin [round" in _plan(decided)
    assert {tuple(r) for r in decided.collect()} == {(1, "contains", 1, 7), (2, "slug", 1, 9), (3, "base-slug", 1, 9)}
    claims = matching.ambiguous_claims(terms, profiles)
    assert "SortMergeJoin [term_id" in _plan(claims)


@pytest.mark.parametrize("name", ["merge_pages", "rules_pages", "rules_page_urls", "rules_feed", "stream_pages", "page_changes"])
def test_pages_at_one_address(spark, twice, name):
    import __spark_entry__ as entry

    problem = oracle.compare(spark, oracle.connect(twice), name, entry.queries()[name], entry.oracle_sql()[name], twice)
    assert problem == ""


def test_rings_are_read_once(spark):
    """A ring is split into vertices once, however many edges refer to them."""
    wkt = "MULTIPOLYGON(((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 0 2, 2 2, 2 0, 0 0)))"
    df = spark.createDataFrame([(wkt,), (None,)], "wkt string").select(opendata.area_point(F.col("wkt")).alias("p"))
    assert df._jdf.queryExecution().analyzed().toString().count("split(") <= 3  # vertices, and x and y of one
    p = df.filter("p.lat IS NOT NULL").first().p
    assert round(p.lat, 9) == round(p.lon, 9) == round((16 * 2 - 4 * 1) / 12, 9)


def test_shared_runs_fold_as_asked(spark):
    """The query's SQL lowers letters; the operator casefolds them, and then a sharp s is two."""
    from vernissage.operators.shared_text import shared_runs

    text = " ".join(f"w{n}" for n in range(24))
    a = spark.createDataFrame([(1, text.replace("w12", "straße")), (2, text.replace("w12", "STRAßE"))], "id long, text string")
    b = spark.createDataFrame([(9, text.replace("w12", "strasse"))], "id long, text string")
    assert {tuple(r) for r in shared_runs(a, b).collect()} == {(1, 9, 24), (2, 9, 24)}
    assert shared_runs(a, b, fold=F.lower).count() == 0
    assert {tuple(r) for r in shared_runs(a, a.filter("id = 1"), fold=F.lower).collect()} == {(1, 1, 24), (2, 1, 24)}


def test_sessions_count_late_messages_of_an_open_day(spark, tmp_path):
    """A day's sessions are cut where more than six hours pass, over the night the clocks change too; a
    message that comes hours late is one of its day as long as that day is open."""
    from datetime import datetime

    from vernissage.streaming import jobs

    def deliver(*times):
        rows = [(u, datetime.fromisoformat(t)) for u, t in times]
        spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.stream_sessions(spark.readStream.schema("user_id long, ts timestamp_ntz").parquet(f"{tmp_path}/in"))
        jobs.append_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/state")

    deliver((1, "2024-10-26T22:00:00"), (1, "2024-10-27T04:00:00"), (1, "2024-10-27T10:00:00.000001"), (1, "2024-10-27T22:59:59"),
            (2, "2024-10-27T20:00:00"))
    deliver((1, "2024-10-28T03:00:00"))
    deliver((2, "2024-10-27T21:00:00"))
    deliver((-1, "2024-12-01T00:00:00"))
    out = spark.read.schema(jobs._SESSIONS).parquet(f"{tmp_path}/out").collect()
    assert {(r.user_id, str(r.day), r.session, r.started_at.isoformat()[11:], r.last_turn_at.isoformat()[11:], r.turns) for r in out} == {
        (1, "2024-10-27", 0, "22:00:00", "04:00:00", 2), (1, "2024-10-27", 1, "10:00:00.000001", "10:00:00.000001", 1),
        (1, "2024-10-27", 2, "22:59:59", "22:59:59", 1), (1, "2024-10-28", 0, "03:00:00", "03:00:00", 1),
        (2, "2024-10-27", 0, "20:00:00", "21:00:00", 2)}


def test_nearest_first_equals_all_pairs(spark):
    """Also for crowded spots, the poles and the date line; crowded spots and centres are met once."""
    from pyspark.sql import Window
    from test_nearby import _tables
    from vernissage.functions.geo import distance_m
    from vernissage.operators import nearby

    centers, points = _tables(spark, n=600)
    centers = centers.unionByName(centers.withColumn("cid", F.col("cid") + 1000))
    every = centers.withColumnsRenamed({"lat": "a", "lon": "b"}).join(points, how="cross").withColumn(
        "m", distance_m(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))).filter("m <= radius_m").withColumn(
        "position", F.row_number().over(Window.partitionBy("cid").orderBy("m", "pid")))
    for k in (1, 5, 40):
        got = {(r.cid, r.pid, r.position) for r in nearby.nearest_first(centers, points, "cid", "pid", k).collect()}
        assert got == {(r.cid, r.pid, r.position) for r in every.filter(F.col("position") <= k).collect()} and len(got) > 80 * k / 8
    # 400 points in a hundred metres: the circle of 1000 km around one of them need not hold the whole table.
    crowd = points.limit(0).unionByName(spark.range(4000).selectExpr("id AS pid", "41.0 + id / 100000 AS lat", "2.0D + id * 0.01 AS lon"))
    place = spark.createDataFrame([(41.0, 2.0, 1e6)], "lat double, lon double, radius_m double")
    assert nearby._reach(place, crowd, 5).first().radius_m < 1e5


def test_matches_follow_one_rule(monkeypatch):
    """How many matches fit in memory at once says nothing about which are kept."""
    import numpy as np
    import pyarrow as pa
    from vernissage.llm import chaining

    rng = np.random.default_rng(4)
    for _ in range(20):
        x, y = rng.integers(0, 9, 60), rng.integers(0, 9, 80)
        y[10:40] = x[20:50]
        both = sorted(set(x.tolist()) & set(y.tolist()))
        xs, ys = (pa.array([np.flatnonzero(v == b).tolist() for b in both], pa.list_(pa.int32())) for v in (x, y))
        got = []
        for most in (1, 50, 1 << 18):
            monkeypatch.setattr(chaining, "MOST_MATCHES", most)
            got.append(list(zip(*(c.tolist() for c in chaining.matches(xs, ys, 6)), strict=True)))
        assert got[0] == got[1] == got[2]
        assert {b - a for a, b in got[0]} >= {-10}
