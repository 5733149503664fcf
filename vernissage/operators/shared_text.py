"""Verbatim reuse: the longest run of words two texts share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.text import casefold, words


def _words(df: DataFrame, id_column: str, fold: Callable[[Column], Column]) -> DataFrame:
    """(id, words): each text as the hashes of its words."""
    hashed = F.transform(words(F.col("text"), fold), lambda w: F.xxhash64(w))
    return df.select(F.col(id_column).alias("_id"), hashed.alias("_words"))


def _grams(listed: DataFrame, n: int, step: int = 1) -> DataFrame:
    """(_id, position, h1, h2) for runs of `n` words, one every `step`. A run is two independent
    hashes, so a shuffle carries 20 bytes a word instead of the words."""

    def at(i: Column) -> Column:
        run = F.slice(F.col("_words"), i, n)
        return F.struct(i.alias("position"), F.xxhash64(run).alias("h1"), F.hash(run).alias("h2"))

    starts = F.sequence(F.lit(1), F.size("_words") - (n - 1), F.lit(step))
    return (
        listed.filter(F.size("_words") >= n)
        .select("_id", F.explode(F.transform(starts, at)).alias("g"))
        .select("_id", "g.position", "g.h1", "g.h2")
    )


def shared_runs(
    ours: DataFrame,
    source: DataFrame,
    *,
    id_ours: str = "id",
    id_source: str = "id",
    pairs: DataFrame | None = None,
    min_words: int = vocab.MAX_SHARED_WORDS + 1,
    fold: Callable[[Column], Column] = casefold,
) -> DataFrame:
    """(ours_id, source_id, run): the longest run of words each pair shares, for pairs that share
    at least `min_words`. Whole texts on both sides; case and punctuation do not count.

    Wherever a run of `min_words` words starts, one of every few positions falls in its first part
    and a shorter run from there lies wholly inside it: so a text none of whose sampled short runs
    meets anything shares nothing, and is dropped early. In the texts that are left, runs of `min_words` words meet
    by equality; along one diagonal (the difference of positions) consecutive meetings belong to one
    longer run. `pairs` limits the work to given pairs; `fold` says which letters are one (casefolded ones,
    where `ss` is the sharp s, unless another is given)."""
    a, b = _words(ours, id_ours, fold), _words(source, id_source, fold)
    if pairs is None:
        step = max(min_words // 3, 1)
        short = min_words - step + 1
        known = _grams(b, short).select("h1", "h2").distinct()
        held = _grams(a, short, step).join(known, ["h1", "h2"], "left_semi").select("_id").distinct()
        a = a.join(held, "_id", "left_semi")
    named = lambda df, side: _grams(df, min_words).withColumnsRenamed(
        {"_id": f"{side}_id", "position": f"{side}_position"})
    left, right = named(a, "ours"), named(b, "source")
    if pairs is not None:
        left = left.join(pairs.select("ours_id", "source_id"), "ours_id")
        met = left.join(right, ["source_id", "h1", "h2"])
    else:
        met = left.join(right, ["h1", "h2"])
    # Islands of consecutive positions on a diagonal. The window key is the whole diagonal, so one
    # text met by a third of the corpus is still split by partner and by offset.
    diagonal = F.col("ours_position") - F.col("source_position")
    line = Window.partitionBy("ours_id", "source_id", "diagonal").orderBy("ours_position")
    island = (
        met.select("ours_id", "source_id", "ours_position", diagonal.alias("diagonal"))
        .withColumn("island", F.col("ours_position") - F.row_number().over(line))
        .groupBy("ours_id", "source_id", "diagonal", "island")
        .agg(F.count("*").alias("n"))
    )
    return island.groupBy("ours_id", "source_id").agg(
        (F.max("n") + (min_words - 1)).alias("run"))


def guard_summaries(items: DataFrame, texts: DataFrame) -> DataFrame:
    """`items` (id, page_id, summary_en, ...) with the summary nulled, and `summary_dropped` set,
    where it repeats more than the allowed run of words of its page (page_id, text)."""
    ours = items.filter("summary_en IS NOT NULL").select("id", "page_id", F.col("summary_en").alias("text"))
    copied = shared_runs(
        ours.select("id", "text"), texts, id_source="page_id",
        pairs=ours.select(F.col("id").alias("ours_id"), F.col("page_id").alias("source_id")),
    ).select(F.col("ours_id").alias("id"), F.lit(True).alias("_copied"))
    marked = items.join(copied, "id", "left")
    dropped = F.coalesce("_copied", F.lit(False))
    return marked.select(
        *(F.when(~dropped, F.col(c)).alias(c) if c == "summary_en" else F.col(c) for c in items.columns),
        dropped.alias("summary_dropped"),
    )
