"""What the fourth review found in the operators on texts, each on small rows of its own."""

from __future__ import annotations

import re

import corpus_pipeline
from vernissage.llm import mixing


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_slots_are_not_gathered_on_the_driver(corpus):
    """The slots grow with the words, but Spark counts them as their shards: no join may broadcast them."""
    docs = corpus([(i, "w " * (i % 90), None, "ab"[i % 2]) for i in range(60)])
    _, pieces = mixing.mix(docs, block_words=4)
    assert "BroadcastHashJoin" not in _plan(pieces) and "SortMergeJoin [source_no" in _plan(pieces)
    taken = {r.source: 0 for r in docs.collect()}
    for r in mixing.mixed_counts(docs, block_words=4).collect():
        taken[r.source] += r.taken
    sizes = [sum(i % 90 for i in range(60) if i % 2 == s) for s in (0, 1)]
    assert [taken["a"], taken["b"]] == [round(t) for t in mixing.targets(sizes, (3, 1), 1.5, 2)]


def test_the_pipeline_ends_without_a_broadcast_of_slots(spark, corpus):
    docs = corpus([(i, "w " * (i % 90), None, "ab"[i % 2]) for i in range(60)])
    plan = _plan(corpus_pipeline.mixing(spark, docs, ""))
    assert re.search(r"SortMergeJoin \[source_no#\d+, block#", plan) and not re.search(r"BroadcastHashJoin \[source_no#\d+, block#", plan)
