"""Importance resampling towards a target: hashed n-gram features, gains per bucket, Gumbel top-k.

An untrained regular-expression split gives the words of a text, ASCII letters lower-cased, with their
offsets; windows over the offset pairs are the n-grams, their words joined by one space. A feature's
bucket is its CRC-32 modulo the number of buckets. How often documents and target fill each bucket gives
the bucket's gain, the logarithm of the smoothed ratio in thousandths; a document weighs the mean of its
features' gains. Adding Gumbel noise to the weights and taking the highest draws without replacement in
proportion to the weights' exponentials. The noise is a function of the id and the seed.

Texts are split once; their buckets stay in a table in the shared folder. One row a bucket is all that
reaches the driver. Ranks are positions in an order that is range-partitioned over score, id and row.

Defined cases: null and blank texts have no features, weight 0, and are never drawn; a null id has the
noise of an empty one and comes after others of its score; rows that repeat an id are ranked each; an
empty target leaves every bucket to the documents; extra columns are ignored."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm.store import Store

# Fixed value: what a word is made of (digits, lower-case ASCII letters, everything beyond ASCII).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 2
BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower(text: str) -> str:
    return text.encode().translate(LOWER).decode()


class Splitter:
    """Buckets of the n-grams of a text."""

    def __init__(self, longest: int, buckets: int, pattern: str = WORD) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
        self.longest, self.buckets = longest, buckets
        self.known: dict[str, tuple[int, bytes]] = {}

    def features(self, text: str | None) -> tuple[int, list[int]]:
        """(number of words, bucket of every n-gram)."""
        if not text:
            return 0, []
        low = lower(text)
        offsets = [at for _, at in self.split.pre_tokenize_str(low)]
        crc, known = zlib.crc32, self.known
        if len(known) > 1 << 17:
            known.clear()
        words = []
        for a, b in offsets:
            word = low[a:b]
            have = known.get(word)
            if have is None:
                raw = word.encode()
                have = known[word] = (crc(raw), b" " + raw)
            words.append(have)
        found = [value for value, _ in words]
        sums = found
        for n in range(1, self.longest):
            # A window of one word more: its sum goes on from the window that ends a word earlier.
            sums = [crc(raw, value) for value, (_, raw) in zip(sums, words[n:])]
            found = found + sums
        return len(words), [value % self.buckets for value in found]


def featured(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of every row of `texts` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(longest, buckets)
        for batch in batches:
            column = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                made = [splitter.features(t.as_py()) for t in column[at : at + 256]]
                lengths = np.array([len(f) for _, f in made])
                values = np.concatenate([np.array(f, dtype=np.int32) for _, f in made])
                offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 256], pa.array([n for n, _ in made], pa.int64()), pa.array(lengths, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=["doc_id", "n_words", "n_features", "buckets"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, buckets array<int>")


def histogram(made: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows. A task sends a row a bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    got = made.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket in whole thousandths, rounded down."""
    n, S, T = len(documents), float(documents.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (S + n) / ((s + 1.0) * (T + n))))
        for s, t in zip(documents.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in whole thousandths, a function of seed and id."""
    head = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8]
    return math.floor(-1000 * math.log(-math.log((int(head, 16) + 0.5) / 4294967296)))


def _ranked(scored: DataFrame, least_words: int, percent: int, store: Store) -> DataFrame:
    """`scored` with `rank`: positions 1, 2, 3... of the rows drawn, highest score first, then least id."""
    able = F.col("n_words") >= least_words
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    rows = store.put(scored.select("*", able.alias("able"), F.monotonically_increasing_id().alias("row")), "scored")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = store.put(placed, "placed")
    part, step = F.shiftright("at", 33), (1 << 33) - 1
    # One row a partition, in their order.
    sizes = sorted(placed.groupBy(part.alias("part")).agg(F.sum(F.col("able").cast("long")).alias("n")).collect())
    before, starts = 0, []
    for r in sizes:
        starts.append((r.part, before))
        before += r.n
    drawn = percent * before // 100
    known = store.spark.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit(step)) + 1
    return placed.withColumn("part", part).join(F.broadcast(known), "part", "left").withColumn(
        "rank", F.when(F.col("able") & (rank <= drawn), rank))


def resample(
    docs: DataFrame, target: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, store: Store | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of `docs` (doc_id, text).
    `percent` of the rows with `least_words` words are drawn; `target` holds the texts to look like."""
    store = store or Store(docs.sparkSession)
    made = store.put(featured(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), longest, buckets), "features")
    wanted = featured(target.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), longest, buckets)
    sent = store.spark.sparkContext.broadcast(gains(histogram(made, buckets), histogram(wanted, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            rows, lists = batch.num_rows, batch.column(3)
            text = np.repeat(np.arange(rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            total = np.zeros(rows, dtype=np.int64)
            np.add.at(total, text, gain[lists.flatten().to_numpy(zero_copy_only=False)])
            weight = total // np.maximum(batch.column(2).to_numpy(), 1)
            score = weight + np.array([noise(i, seed) for i in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight), pa.array(score)],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    scored = made.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")
    return _ranked(scored, least_words, percent, store).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
