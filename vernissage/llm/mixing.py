"""Mixing sources to target weights.

The words of a source's documents, one after another, are packed into blocks of a fixed number of
words. How many slots of each output shard a source gets is drawn from a multinomial of the targets, one
seeded draw a shard. The slots of a source are numbered over the shards; slot j takes block P(j) of the
source, P being a pseudorandom permutation of its whole blocks, another one on every pass over them, with
what is left over, the last and shorter block, at its end. So no block comes k+1 times before all have
come k times. Draws beyond a source's target go to the sources that fell short, in a last shard, and a
source's last slot takes a part of its block: each source takes its target to the word, however small.

Everything is a function of the rows and the seed: reruns agree. Nothing about documents reaches the
driver; per source (a closed list, as it has weights) one row of totals does.

Defined cases: null and blank texts have size 0 and nothing is taken of them; a null source is a source
of its own, the last; rows without an id or with equal ids are separate documents; without any words nothing is taken and
targets are 0; extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vernissage.llm import tokens as T
from vernissage.llm.store import Store

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_REPEATS = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MOST_SHARDS = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, size): the words of every whole text, and a key of id and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch.column(3)):
                start, _ = T.word_spans(part.data, part.bounds)
                counts = np.diff(np.searchsorted(start, part.bounds))
                own = slice(part.at, part.at + len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[own], batch.column(1)[own], batch.column(2)[own], pa.array(counts, pa.int64())],
                    names=["doc_id", "source", "row", "size"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("text").cast("string").alias("text"))
    kept = kept.withColumn("row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    return kept.select("doc_id", "source", "row", "text").mapInArrow(run, "doc_id long, source string, row long, size long")


def targets(totals: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Shares of `share` times all words by weight; a source stops at `most` times its own words and
    the others share what is over, until none is above."""
    want = share * sum(totals)
    given = [0.0] * len(totals)
    free = set(range(len(totals)))
    while free:
        rate = max(want, 0.0) / sum(weights[i] for i in free)
        full = {i for i in free if rate * weights[i] > most * totals[i]}
        if not full:
            for i in free:
                given[i] = rate * weights[i]
            break
        for i in full:
            given[i] = float(most * totals[i])
            want -= given[i]
        free -= full
    return given


def slots_of(target: float, total: int, most: int, block_words: int) -> tuple[int, int]:
    """(slots, words of the last one) that take `target` of a source's `total` words: whole passes over
    its blocks, then whole blocks, then a part of one."""
    want = min(round(target), most * total)
    if want <= 0:
        return 0, 0
    passes, rest = divmod(want, total)
    more = -(-rest // block_words)
    return passes * -(-total // block_words) + more, rest - (more - 1) * block_words if more else block_words


def permuted(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 (a Feistel network on pairs, walked until inside)."""
    side = np.uint64(int(np.ceil(np.sqrt(n))))
    value = slot.astype(T.U)
    todo = np.arange(len(value))
    while len(todo):
        left, right = value[todo] // side, value[todo] % side
        for turn in range(4):
            salt = T.U((key * 8 + turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            left, right = right, (left + T.mix(right ^ salt) % side) % side
        value[todo] = left * side + right
        todo = todo[value[todo] >= T.U(n)]
    return value.astype(np.int64)


def mix(
    docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS, seed: int = 1, store: Store | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). documents: (row_start, source_no, doc_id, source, size, source_size,
    target), one per row of `docs`. pieces, the mix itself: (shard, slot, source_no, block, row_start,
    doc_id, first_word, n_words), the words of each document that each slot of the output takes.
    Sources by code point, null last, weigh `weights` in turn."""
    store = store or Store(docs.sparkSession)
    spark = store.spark
    sized = store.put(sizes(docs), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    totals = [r["size"] for r in found]
    given = targets(totals, [weights[i % len(weights)] for i in range(len(found))], share, most)
    blocks = [-(-n // block_words) for n in totals]
    whole = [n // block_words for n in totals]
    dealt_out = [slots_of(t, n, most, block_words) for t, n in zip(given, totals, strict=True)]
    slots, last_words = [n for n, _ in dealt_out], [n for _, n in dealt_out]
    # Small tables are made from Arrow: from Python rows Spark would start a second set of workers.
    source_rows = spark.createDataFrame(pa.table({
        "source": pa.array([r.source for r in found], pa.string()), "source_no": pa.array(range(len(found)), pa.int32()),
        "source_size": pa.array(totals, pa.int64()), "target": pa.array(given, pa.float64())}))

    # Where each document begins among its source's words: sums inside chunks, then over chunks.
    # As many chunks as a chunk has rows, so neither window grows faster than the root of the input.
    chunks = max(1, round(sum(r["rows"] for r in found) ** 0.5))
    rows = sized.join(F.broadcast(source_rows) if len(found) <= 10_000 else source_rows,
                      sized["source"].eqNullSafe(source_rows["source"]))
    rows = rows.select(source_rows["source_no"], "doc_id", sized["source"], "size", "source_size", "target",
                       "row", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(chunks)).alias("chunk"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = store.put(rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))), "placed")
    over = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("n")).select(
        "source_no", "chunk", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    placed = store.put(rows.join(starts, ["source_no", "chunk"]).select(
        (F.col("base") + F.col("before")).alias("row_start"), "source_no", "doc_id", "source", "size",
        "source_size", "target"), "documents")
    store.drop("sizes", "placed")

    # Counts per shard, where each shard begins among a source's slots, and what is to be made up.
    total = sum(slots)
    per_shard = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    shards = -(-total // per_shard)
    odds = np.array(slots, dtype=float) / max(total, 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(per_shard, total - shard * per_shard)
                got = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(n, odds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(got), shard), pa.int64()), pa.array(np.arange(len(got)), pa.int32()),
                     pa.array(got, pa.int64())], names=["shard", "source_no", "n"])

    drawn = store.put(spark.range(shards).mapInArrow(draw, "shard long, source_no int, n long"), "drawn")
    reached = {r.source_no: r.n for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect()}
    short = [(shards, i, n - reached.get(i, 0), reached.get(i, 0)) for i, n in enumerate(slots) if n > reached.get(i, 0)]
    by_shard = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    dealt = drawn.withColumn("first", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
    kinds = {"shard": pa.int64(), "source_no": pa.int32(), "n": pa.int64(), "first": pa.int64()}
    dealt = dealt.unionByName(spark.createDataFrame(pa.table(
        {c: pa.array([row[i] for row in short], kind) for i, (c, kind) in enumerate(kinds.items())})))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, no, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(first, min(first + n, slots[no]))
                turn, taken = slot // max(blocks[no], 1), slot % max(blocks[no], 1)
                for k in np.unique(turn):
                    at = (turn == k) & (taken < whole[no])  # the shorter block stays the last of its pass
                    if at.any():
                        taken[at] = permuted(taken[at], whole[no], (seed * 1_000_003 + no) * 64 + int(k))
                words = np.where(slot == slots[no] - 1, last_words[no], block_words)
                if len(slot):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(slot), shard), pa.int64()), pa.array(slot, pa.int64()),
                         pa.array(np.full(len(slot), no), pa.int32()), pa.array(taken, pa.int64()), pa.array(words, pa.int64())],
                        names=["shard", "slot", "source_no", "block", "slot_words"])

    parts = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    filled = dealt.select("shard", "source_no", "n", "first").repartition(parts, "shard", "source_no").mapInArrow(
        fill, "shard long, slot long, source_no int, block long, slot_words long")
    held = placed.filter("size > 0").withColumn("block", F.explode(F.expr(
        f"sequence(row_start div {block_words}, (row_start + size - 1) div {block_words})")))
    held = held.select(
        "source_no", "block", "row_start", "doc_id", F.expr(f"greatest(row_start - block * {block_words}, 0L)").alias("at"),
        F.expr(f"greatest(block * {block_words} - row_start, 0L)").alias("first_word"),
        F.expr(f"least((block + 1) * {block_words}, row_start + size) - greatest(block * {block_words}, row_start)").alias("n_words"))
    # Spark takes the slots for as few rows as their shards, so it would gather all of them on the driver.
    pieces = filled.hint("merge").join(held, ["source_no", "block"]).filter("at < slot_words").withColumn(
        "n_words", F.least("n_words", F.col("slot_words") - F.col("at"))).select(
        "shard", "slot", "source_no", "block", "row_start", "doc_id", "first_word", "n_words")
    return placed, pieces


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words of each document that the mix takes."""
    placed, pieces = mix(docs, **options)
    taken = pieces.groupBy("source_no", "row_start").agg(F.sum("n_words").alias("taken"))
    some = placed.filter("size > 0").join(taken, ["source_no", "row_start"], "left")
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")]
    return some.select(*columns).union(none.select(*columns))
