"""Benchmark decontamination: greedy string tiling of documents with test items.

Words are lower-cased runs of letters and digits. Runs of `min_match` words (Karp-Rabin hashes) are the
seeds: documents and items that share one meet by equality of the hash. For each pair that met, the
longest run of words that both hold and neither has marked is marked in both, again and again, until
none of `min_match` words is left; the marked words of the item over all its words is the coverage. Order
does not matter to it, so a reordered passage is caught. A pair's seeds give an upper bound of its
coverage, and pairs below the threshold are left out before tiling.

Items whose seeds fit `most_seeds` are broadcast (the size is counted first) and tiled where the
document is read; a larger benchmark is joined on the seeds by a shuffle instead, with equal results.

Defined cases: null and empty texts, and items of fewer than `min_match` words, match nothing; equal
items are items of their own; repeated document rows give repeated result rows; extra columns are ignored."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm import tokens as T
from vernissage.llm.store import Store

MIN_MATCH = 5
COVERAGE = 0.5
MOST_SEEDS = 2_000_000
SCHEMA = "doc_id long, item_id long, n_tiles int, n_covered int, n_words int, coverage double"


def tile(ours: np.ndarray, theirs: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in ours, start in theirs, length),
    longest first; of equals, the first in `theirs`, then in `ours`."""
    a, b = _runs(ours, min_match), _runs(theirs, min_match)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    count = hi - lo
    j = np.repeat(np.arange(len(b)), count)
    within = np.arange(len(j)) - np.repeat(np.cumsum(count) - count, count)
    i = order[np.repeat(lo, count) + within]
    if not len(i):
        return []
    # Matching seeds one after another on a diagonal are one longer match.
    by = np.lexsort((i, i - j))
    i, j = i[by], j[by]
    new = np.append(True, (np.diff(i) != 1) | (np.diff(i - j) != 0))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(i))) + min_match - 1
    heap = list(zip((-length).tolist(), j[first].tolist(), i[first].tolist(), strict=True))
    heapq.heapify(heap)
    free_a, free_b, tiles = np.ones(len(ours), bool), np.ones(len(theirs), bool), []
    while heap:
        n, at_b, at_a = heapq.heappop(heap)
        n = -n
        free = free_a[at_a : at_a + n] & free_b[at_b : at_b + n]
        if free.all():
            free_a[at_a : at_a + n] = free_b[at_b : at_b + n] = False
            tiles.append((at_a, at_b, n))
            if not free_b.any():
                break
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if y - x >= min_match:
                heapq.heappush(heap, (x - y, at_b + x, at_a + x))
    return tiles


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    return T.grams(T.Words(hashes, hashes, hashes, np.array([0, len(hashes)])), n)[0]


class Items:
    """Test items as word hashes, and their seeds with the places they come from."""

    def __init__(self, ids: np.ndarray, column: pa.Array, min_match: int) -> None:
        words, seeds, items, places = [], [], [], []
        for part in T.slices(column):
            w = T.words(part, alnum=True)
            value, text, at = T.grams(w, min_match)
            seeds.append(value)
            items.append(text + len(words))
            places.append(at - w.first[text])
            words += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (seeds, items, places)]
        order = np.argsort(flat[0].astype(T.U), kind="stable")
        self.ids, self.words, self.min_match = ids, words, min_match
        self.seed, self.item, self.place = flat[0].astype(T.U)[order], flat[1][order], flat[2][order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.seed >> T.U(44)).astype(np.int64)] = True

    def covered(self, values: np.ndarray, least: float) -> list[int]:
        """Items of which the seeds `values` can cover the share `least`."""
        values = np.unique(values)
        lo, hi = np.searchsorted(self.seed, values, "left"), np.searchsorted(self.seed, values, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        found = []
        for k in np.unique(self.item[at]):
            mark = np.zeros(len(self.words[k]) + 1, dtype=np.int64)
            place = self.place[at[self.item[at] == k]]
            np.add.at(mark, place, 1)
            np.add.at(mark, place + self.min_match, -1)
            if (np.cumsum(mark) > 0).sum() >= least * len(self.words[k]):
                found.append(int(k))
        return found


def _result(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["doc_id", "item_id", "n_tiles", "n_covered", "n_words", "coverage"])


def _judged(doc_id: int, item_id: int, ours: np.ndarray, theirs: np.ndarray, min_match: int, least: float) -> list[tuple]:
    tiles = tile(ours, theirs, min_match)
    covered = sum(n for _, _, n in tiles)
    if not tiles or covered < least * len(theirs):
        return []
    return [(doc_id, item_id, len(tiles), covered, len(theirs), covered / len(theirs))]


def contaminated(
    docs: DataFrame, items: DataFrame, *, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
    most_seeds: int = MOST_SEEDS, store: Store | None = None,
) -> DataFrame:
    """(doc_id, item_id, n_tiles, n_covered, n_words, coverage): pairs of a document and a test item of
    which the document's whole text holds the share `coverage` or more, in any order."""
    store = store or Store(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    # A word is two bytes at least, with what parts it from the next.
    bound = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    if bound <= most_seeds:
        return _broadcast(docs, items, min_match, coverage)
    return _shuffled(docs, items, min_match, coverage, store)


def _broadcast(docs: DataFrame, items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    got = items.toArrow()
    texts = got.column("text").combine_chunks()
    known = docs.sparkSession.sparkContext.broadcast(
        Items(np.array(got.column("item_id").to_pylist(), dtype=object), texts, min_match))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = known.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part in T.slices(batch.column(1)):
                w = T.words(part, alnum=True)
                value, text, _ = T.grams(w, min_match)
                hit = np.flatnonzero(items.maybe[(value >> T.U(44)).astype(np.int64)])
                hit = hit[np.isin(value[hit], items.seed)]
                rows: list[tuple] = []
                for t in np.unique(text[hit]):
                    ours = w.hash[w.first[t] : w.first[t + 1]]
                    for k in items.covered(value[hit[text[hit] == t]], coverage):
                        rows += _judged(ids[part.at + t], items.ids[k], ours, items.words[k], min_match, coverage)
                yield _result(rows)

    return docs.mapInArrow(run, SCHEMA)


def _shuffled(docs: DataFrame, items: DataFrame, min_match: int, coverage: float, store: Store) -> DataFrame:
    # Equal rows have one key, whatever their ids; each of them gets the rows of its key at the end.
    docs = docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))
    items = items.withColumn("item_key", F.xxhash64("item_id", "text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for part in T.slices(batch.column(1)):
                w = T.words(part, alnum=True)
                value, text, _ = T.grams(w, min_match)
                pair, places = np.unique(np.stack([text.astype(np.int64), T.longs(value)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(pair[0] + part.at)), pa.array(pair[1]), pa.array(places.astype(np.int64)),
                     pa.array(np.diff(w.first)[pair[0]].astype(np.int64))], names=["key", "seed", "places", "n_words"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts, item_ids, tests = batch.columns
            for i in range(batch.num_rows):
                one, two = (next(T.slices(c[i : i + 1])) for c in (texts, tests))
                yield _result(_judged(doc_ids[i].as_py(), item_ids[i].as_py(), T.words(one, alnum=True).hash,
                                      T.words(two, alnum=True).hash, min_match, coverage))

    kind = "key long, seed long, places long, n_words long"
    of_items = store.put(items.select("item_key", "text").distinct().mapInArrow(seeds, kind).withColumnRenamed("key", "item_key"), "item-seeds")
    known = of_items.select("seed").distinct()
    of_docs = docs.select("doc_key", "text").mapInArrow(seeds, kind).select(F.col("key").alias("doc_key"), "seed")
    of_docs = of_docs.join(known, "seed", "left_semi").distinct()
    # Each place of a shared seed covers at most min_match words of the item.
    enough = of_docs.join(of_items, "seed").groupBy("doc_key", "item_key").agg(
        F.sum("places").alias("places"), F.first("n_words").alias("n_words")).filter(
        f"places * {min_match} >= {coverage} * n_words").select("doc_key", "item_key")
    words = items.select("item_key", "item_id", F.col("text").alias("test"))
    return docs.join(enough, "doc_key").join(words, "item_key").select("doc_id", "text", "item_id", "test").mapInArrow(judge, SCHEMA)
