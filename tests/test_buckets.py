"""Bucketed versions: what a batch rewrites, what stays, and streams that do not depend on their batches."""

from datetime import datetime
from functools import partial

import pytest
from pyspark.sql import functions as F

from vernissage.sources.buckets import BucketedTable
from vernissage.streaming import jobs

ROWS = "key string, value long"


def _table(spark, path, buckets=16):
    return BucketedTable(spark, str(path), ROWS, ["key"], buckets)


def _put(table, version, rows):
    df = table.spark.createDataFrame(rows, ROWS)
    touched = table.touched(df)
    held = table.at(version, touched).join(df.select("key"), "key", "left_anti")
    return touched, table.rewrite(version, touched, held.unionByName(df))


def test_one_key_touches_one_bucket(spark, tmp_path):
    table = _table(spark, tmp_path)
    first = [(f"k{i}", i) for i in range(200)] + [(None, -1)]
    _, before = _put(table, 0, first)
    touched, after = _put(table, 1, [("k7", 700)])
    assert len(touched) == 1 and len(before) > 10
    assert {b for b in before if before[b] != after[b]} == set(touched)
    # The files of the others are the same files; the new version has one folder.
    assert [p.name for p in (tmp_path / "data/v=2").glob("bucket=*")] == [f"bucket={touched[0]}"]
    got = {r.key: r.value for r in table.at(2).collect()}
    assert got == {**dict(first), "k7": 700} and {r.key: r.value for r in table.at(1).collect()} == dict(first)
    # Only that bucket is opened for the next batch on the key.
    assert {f.split("/bucket=")[1].split("/")[0] for f in table.at(2, touched).inputFiles()} == {str(touched[0])}


def test_empty_buckets_leave_and_strangers_are_refused(spark, tmp_path):
    table = _table(spark, tmp_path, 4)
    _, live = _put(table, 0, [(f"k{i}", i) for i in range(40)])
    touched = table.touched(spark.createDataFrame([("k1", 0)], ROWS))
    assert table.rewrite(1, touched, table.at(1, touched).limit(0)).keys() == live.keys() - set(touched)
    with pytest.raises(ValueError, match="does not touch"):
        table.rewrite(2, touched, table.at(1))
    with pytest.raises(ValueError, match="opened with 8"):
        _table(spark, tmp_path, 8).at(2)
    assert _table(spark, tmp_path / "none").at(0).count() == 0 and _table(spark, tmp_path / "none").versions() == []
    assert table.rewrite(2, [], table.at(2)) == table.manifest(2)


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    table = _table(spark, tmp_path, 8)
    want = {}
    for v in range(5):
        rows = [(f"k{i}", v) for i in range(v, 40, v + 1)]
        want |= dict(rows)
        _put(table, v, rows)
    assert table.vacuum(2) > 0 and table.versions() == [4, 5]
    assert {r.key: r.value for r in table.at(5).collect()} == want and table.at(4).count() == len(want)
    assert table.vacuum(2) == 0


EVENT = ("source_event_id string, source_venue_id string, title string, title_en string, source_category_id int, is_free boolean, "
         "price_min decimal(8,2), price_max decimal(8,2), is_online boolean, source_url string, web_url_ca string, web_url_es string, "
         "web_url_en string, source_modified_at timestamp_ntz, ord long, fetched_at timestamp_ntz")


def test_merges_in_buckets_do_not_depend_on_batches(spark, tmp_path):
    """One batch, two, reversed, and one that is run again after it was merged."""
    row = lambda post, day: (post, None, f"{post} {day}", *[None] * 11, 1, datetime(2024, 1, day))
    one = [row(f"p{i}", 1) for i in range(30)]
    two = [row(f"p{i}", 2) for i in range(20, 40)]
    venues = spark.createDataFrame([], "id long, source_venue_id string")
    schema = "id long, source_event_id string, venue_id long, " + EVENT.split(", ", 2)[2].replace(
        ", ord long, fetched_at timestamp_ntz", "") + ", first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
    want = {(f"p{i}", f"p{i} {2 if i >= 20 else 1}", 2 if i >= 30 else 1, 2 if i >= 20 else 1) for i in range(40)}
    for k, batches in enumerate(([(0, one + two)], [(0, one), (1, two)], [(0, two), (1, one)], [(0, one), (1, two), (1, two)])):
        path = str(tmp_path / str(k))
        apply = jobs.merging(path, schema, ["source_event_id"], partial(jobs.event_merge, venues=venues), buckets=8)
        for number, rows in batches:
            apply(spark.createDataFrame(rows, EVENT), number)
        table = jobs.table_at(spark, path, batches[-1][0] + 1, schema, ["source_event_id"], 8)
        assert {(r.source_event_id, r.title, r.first_seen_at.day, r.last_seen_at.day) for r in table.collect()} == want


CALL = ("id long, created_at timestamp_ntz, purpose string, model string, error_type string, cost_usd decimal(17,11), input_tokens long, "
        "output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, latency_ms long")


def test_windows_close_once_and_take_no_later_call(spark, tmp_path):
    """Early, late within two hours, and too late: the last is left out and its window not written again."""
    call = lambda i, hour, minute=0: (i, datetime(2024, 1, 1, hour, minute), "chat", "m", None, None, 1, 1, 0, 0, 1)
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([call(1, 8), call(2, 10)], [call(3, 9), call(4, 8, 30)], [call(5, 13)], [call(6, 8, 10)], [call(7, 23)]):
        spark.createDataFrame(rows, CALL).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.cost_rollup(spark.readStream.schema(CALL).parquet(source))
        jobs.append_to_end(stream, out, state)
    got = spark.read.schema(stream.schema).parquet(out)
    assert sorted((r.window_start.hour, r.calls) for r in got.collect()) == [(8, 2), (9, 1), (10, 1), (13, 1)]
    assert got.groupBy("window_start").agg(F.count("*").alias("n")).filter("n > 1").count() == 0
