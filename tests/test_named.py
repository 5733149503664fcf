"""Titles named in replies: what is sorted and shuffled for each mention holds no text."""

from pyspark.sql import functions as F

from vernissage.functions.text import title_key
from vernissage.plans import dialogue
from vernissage.session import materialize


def test_mentions_hold_numbers_alone(spark):
    replies = spark.createDataFrame([(1, 5, "See Red Ring, then the red ring show."), (2, 5, "Nothing."), (3, 6, "Red ring")],
                                    "reply_id long, conversation_id long, text string")
    words = dialogue._hashed(title_key(F.col("title")))
    keys = materialize(spark.createDataFrame([(5, "Red Ring"), (5, "Red Ring Show"), (6, "Blue")], "conversation_id long, title string").select(
        "conversation_id", F.size(words).alias("n"), F.xxhash64(words).alias("h1"), F.hash(words).alias("h2")))
    said = dialogue.mentions(replies, keys)
    assert "string" not in dict(said.dtypes).values()
    assert sorted((r.reply_id, r.n, r.start, r.stop) for r in said.collect()) == [(1, 2, 2, 4), (1, 2, 6, 8), (1, 3, 6, 9)]
    first = {(r.reply_id, r.n): r.first_start for r in dialogue._outermost(replies, keys).collect()}
    assert first == {(1, 2): 2, (1, 3): 6}
