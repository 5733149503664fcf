"""The streamed log is derived once, not once a delivery."""

from vernissage.catalog import load, streams
from vernissage.catalog.registry import QUERIES


def test_log_is_written_once_before_its_deliveries(spark, monkeypatch):
    load()
    written = []
    real = streams.materialize
    monkeypatch.setattr(streams, "materialize", lambda df: written.append(df.columns) or real(df))
    rows = QUERIES["stream_profile"](spark, "/root/testdata/sf0.001")
    assert written == [["user_id", "seq", "topic", "fact", "replaces"]] and rows.count() > 0
