"""Documents to a training mix: each stage works on what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vernissage.llm.decontaminate import contaminated
from vernissage.llm.jaccard import jaccard_components
from vernissage.llm.langid import predict, train
from vernissage.llm.mixing import mixed_counts
from vernissage.llm.store import Store, read
from vernissage.llm.suffix_dedup import removed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents go whose language the model rejects (no text, no letter, or a score below the calibrated
    threshold); `lang` is the prediction for those that stay. Learns from all labelled documents."""
    model = train(docs)
    found = predict(docs, model, keep=("text", "source")).filter("NOT rejected")
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", F.char_length("text").cast("long").alias("n_chars"))


def _row_key() -> Column:
    """One number for all rows that are equal, null or repeated ids included."""
    columns = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the one
    with the smallest id, null last; of equal ids the least hash of the text; of equal rows one. Texts without
    a word are in no group: all their rows stay."""
    store = Store(spark)
    keyed = docs.withColumn("key", _row_key())
    rows = jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"))
    keys = rows.groupBy(F.col("doc_id").alias("key")).agg(
        F.first("n_shingles").alias("n_shingles"), F.first("component_id").alias("component"), F.count("*").alias("copies"))
    named = keys.join(keyed.select("key", "doc_id", F.xxhash64("text").alias("hash")).distinct(), "key")
    best = named.filter("n_shingles > 0").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "key", "copies")).alias("best"))
    kept = best.select("best.key", "best.copies").union(named.filter("n_shingles = 0").select("key", F.lit(1).cast("long")))
    kept = store.put(kept, "kept")
    out = keyed.join(kept.filter("copies = 1"), "key", "left_semi")
    once = keyed.join(kept.filter("copies > 1"), "key", "left_semi").dropDuplicates(["key"])
    return out.union(once).select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Byte ranges covered by a 400-byte string that also starts elsewhere are cut out of the texts.
    A document stays even if nothing is left of it."""
    left = removed(docs, carry=("lang", "source"))
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents go that hold half or more of a benchmark item's words."""
    keyed = docs.withColumn("key", _row_key())
    bad = contaminated(keyed.select(F.col("key").alias("doc_id"), "text"), read(spark, folder, "benchmark"))
    return keyed.join(bad.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The words of each document that the mix of sources takes."""
    return mixed_counts(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_substrings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages in order over `documents`, each written to the shared folder and read again."""
    store = Store(spark)
    docs = read(spark, folder, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if k < len(STAGES) - 1:
            docs = store.put(docs, f"{k}-{name}")
    return docs
