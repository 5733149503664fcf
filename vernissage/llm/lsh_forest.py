"""Near-duplicate documents by an LSH forest: sorted MinHash orders, neighbours by longest common prefix.

Every distinct shingle set has a signature of `VALUES` minimum hashes. Order t of the forest reads it
round from value 8t on; documents sorted by that sequence lie next to those with which they share the
longest prefix. A region is what shares a prefix. It starts at `DEPTHS[0]` values and is followed to the
next depth only where more than `CROWD` documents are in it, so crowded stretches of an order (families of
copies, boiler-plate) are told apart by many values and sparse ones by few.

Candidates are of two kinds: each document with the `NEAR` that follow it in each order, as long as they
share a region; and each document with the hub of every region it is in, the hub being the document
whose regions are the largest, so a family meets its common original however many there are. The orders
are range-partitioned with the document as the last key, so that no region is one task; rows at the
edges of partitions meet once more. Signatures rule out pairs that agree in too few values; all others
are confirmed on full sets, and only where they can still change a component: first each document with
the hub it meets most often, then pairs whose ends lie in different components.

Linked documents are missed only if no order brings them together. `tests/llm` and the README give the
measured recall against an exact join.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; a text of fewer
words than a shingle is one shingle; equal sets are one node; rows are nodes of their own, whatever
their ids: rows that share an id are not linked by it, and a null id links like others but is never the
least (a component without ids has a null one); extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vernissage.llm import tokens as T
from vernissage.llm.components import components
from vernissage.llm.jaccard import shingle_sets
from vernissage.llm.store import Store

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 85
VALUES = 128
ORDERS = 16
DEPTHS = (3, 5, 8, 12, 20, 32, 64, 128)
CROWD = 64
NEAR = 4
DEVIATIONS = 5
MOST_SENT = 1 << 20


def _factors() -> np.ndarray:
    return T.mix(np.arange(1, VALUES + 1, dtype=T.U) * T.U(0xD1342543DE82EF95)) | T.U(1)


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """VALUES minimum hashes (32 bits) of every non-empty set; sets follow one another in `values`."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), VALUES), dtype=np.uint32)
    for k, factor in enumerate(_factors()):
        out[:, k] = (T.mix(np.minimum.reduceat(values * factor, starts)) >> T.U(32)).astype(np.uint32)
    return out


def prefixes(signature: np.ndarray, orders: np.ndarray, depths: tuple[int, ...]) -> np.ndarray:
    """Hash of the first `depths` values in the order of each row: one row a row, one column a depth."""
    step = VALUES // ORDERS
    round_about = np.concatenate([signature, signature], axis=1).astype(T.U) + T.U(1)
    sums = np.zeros((len(signature), 2 * VALUES + 1), dtype=T.U)
    np.cumsum(round_about * T.powers(2 * VALUES), axis=1, dtype=T.U, out=sums[:, 1:])
    row, begin = np.arange(len(orders)), orders * step
    back = T.powers(2 * VALUES, T.INVERSE)[begin]
    salt = T.mix(orders.astype(T.U) * T.U(0x9FB21C651E98DF25) + T.U(7))
    return np.stack([T.mix((sums[row, begin + d] - sums[row, begin]) * back + salt * T.U(2 * d + 1)) for d in depths], axis=1)


def _signed(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, key, n, h1, h2, values): every row's set size, two words of its set, and its signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch.column(2), 1 << 20):
                values, first = shingle_sets(part, n_words)
                n = np.diff(first)
                words = []
                for x in (values, values * T.BASE):
                    sums = np.zeros(len(values) + 1, dtype=T.U)
                    np.cumsum(T.mix(x), dtype=T.U, out=sums[1:])
                    words.append(pa.array(T.longs(sums[first[1:]] - sums[first[:-1]])))
                made = iter(signatures(values, first)) if len(values) else iter(())
                own = slice(part.at, part.at + len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[own], batch.column(1)[own], pa.array(n, pa.int64()), *words,
                     pa.array([next(made).tobytes() if k else None for k in n.tolist()], pa.binary())],
                    names=["doc_id", "key", "n", "h1", "h2", "signature"])

    return docs.select("doc_id", "key", "text").mapInArrow(
        run, "doc_id long, key long, n long, h1 long, h2 long, signature binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, VALUES)


def _entries(classes: DataFrame) -> DataFrame:
    """(cls, turn, p): each set's place in every order, to the first depth."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for turn in range(ORDERS):
                turns = np.full(len(ids), turn)
                p = prefixes(got, turns, DEPTHS[:1])[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(turns.astype(np.int32)), pa.array(T.longs(p))], names=["cls", "turn", "p"])

    return classes.select("cls", "signature").mapInArrow(run, "cls long, turn int, p long")


def _paths(classes: DataFrame) -> DataFrame:
    """(cls, popular, turn, path, crowded): the whole way down of the listed orders of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            counts = lists.value_lengths().to_numpy()
            turn = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), counts)
            path = prefixes(_matrix(batch.column(1))[row], turn.astype(np.int64), DEPTHS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(turn, pa.int32()),
                 T.lists(T.longs(path).ravel(), np.full(len(row), len(DEPTHS))), batch.column(4).flatten()],
                names=["cls", "popular", "turn", "path", "crowded"])

    return classes.select("cls", "signature", "popular", "turns", "crowded").mapInArrow(
        run, "cls long, popular long, turn int, path array<long>, crowded boolean")


def _neighbours(paths: DataFrame, near: int, store: Store) -> DataFrame:
    """Pairs (a, b) of which b is among the `near` that follow a in one of the orders, with a shared region."""
    order = ["turn", "path", "cls"]
    kind = "a long, b long, turn int, path array<long>, cls long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts = np.empty(0, np.int64), np.empty(0, np.int64)
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if tail is None:
                yield edge(batch.slice(0, near))
            path = batch.column(1)
            begin = path.flatten().to_numpy()[:: len(DEPTHS)]  # a path's first depth tells its order and region
            tail = batch if tail is None or batch.num_rows >= near else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            ids, starts = np.append(ids, batch.column(2).to_numpy()), np.append(starts, begin)
            a, b = [], []
            for k in range(1, near + 1):
                same = np.flatnonzero(starts[:-k] == starts[k:]) if len(ids) > k else np.empty(0, np.int64)
                same = same[same + k >= len(ids) - batch.num_rows]
                a.append(ids[same])
                b.append(ids[same + k])
            a, b = np.concatenate(a), np.concatenate(b)
            none = pa.nulls(len(a))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b), none.cast(pa.int32()), none.cast(pa.list_(pa.int64())), none.cast(pa.int64())],
                names=["a", "b", *order])
            ids, starts = ids[-near:], starts[-near:]
        if tail is not None:
            yield edge(tail.slice(max(0, tail.num_rows - near)))

    def edge(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(rows.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, *rows.columns], names=["a", "b", *order])

    sorted_rows = paths.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    found = store.put(sorted_rows.mapInArrow(run, kind), "neighbours")
    # A few rows of each partition.
    across = Window.partitionBy("turn").orderBy("path", "cls")
    edges = found.filter("a IS NULL").select(*order).distinct()
    for k in range(1, near + 1):
        edges = edges.withColumn(f"b{k}", F.when(F.get(F.lead("path", k).over(across), F.lit(0)) == F.get("path", F.lit(0)), F.lead("cls", k).over(across)))
    met = edges.select(F.col("cls").alias("a"), F.explode(F.array(*(f"b{k}" for k in range(1, near + 1)))).alias("b"))
    return found.filter("a IS NOT NULL").select("a", "b").union(met.filter("b IS NOT NULL"))


def _hubs(paths: DataFrame, store: Store) -> DataFrame:
    """(a, b, times): each set b with the hub a of every region it shares, from depth to depth while the first
    region is crowded. Who is alone in a region is alone in all below it and is not followed further."""
    paths = paths.select("cls", "popular", "path", "crowded")
    for k in range(len(DEPTHS)):
        every = paths.withColumn("p", F.get("path", F.lit(k)))
        hubs = every.groupBy("p").agg(F.max(F.struct("popular", "cls")).alias("hub"), F.count("*").alias("size")).filter("size > 1")
        shared = store.put(every.join(hubs.select("p", F.col("hub.cls").alias("hub")), "p").drop("p"), f"regions/depth={k}")
        paths = shared.filter("crowded").drop("hub")
    every = store.get("regions", "cls long, hub long").filter("cls <> hub")
    star = store.put(every.groupBy(F.col("hub").alias("a"), F.col("cls").alias("b")).agg(F.count("*").alias("times")), "star")
    store.drop("regions")
    return star


def _likely(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures agree in as many values as linked sets do, less DEVIATIONS standard
    deviations (some three linked pairs in a million have fewer)."""
    share = percent / 100
    least = VALUES * share - DEVIATIONS * (VALUES * share * (1 - share)) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1)
                yield batch.filter(pa.array(same >= least)).select(["a", "b"])

    left = members.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    right = members.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").filter(f"least(na, nb) * 100 >= {percent} * greatest(na, nb)")
    return near.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, members: DataFrame, n_words: int, percent: int, store: Store, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch.column(1), 1 << 20):
                values, first = shingle_sets(part, n_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.at : part.at + len(part)], T.lists(T.longs(values), np.diff(first))], names=["cls", "items"])

    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = store.put(members.select("cls", "key").join(ends, "cls", "left_semi"), f"{name}-ends")
    # Two numbers a set: sent to the tasks while they are few, so that other texts need not move.
    few = wanted.count() <= MOST_SENT
    texts = docs.select("key", "text").join(F.broadcast(wanted) if few else wanted, "key").select("cls", "text")
    sets = store.put(texts.mapInArrow(run, "cls long, items array<long>").dropDuplicates(["cls"]), f"{name}-sets")
    # Documents bring their sets to the hub, not the hub's to each of them.
    both = pairs.join(sets.select(F.col("cls").alias("b"), F.col("items").alias("ib")), "b").join(
        sets.select(F.col("cls").alias("a"), F.col("items").alias("ia")), "a")
    common = F.size(F.array_intersect("ia", "ib")).cast("long")
    links = both.select("a", "b", common.alias("common"), (F.size("ia") + F.size("ib")).cast("long").alias("total"))
    links = store.put(links.filter(f"common * 100 >= {percent} * (total - common)").select("a", "b"), f"{name}-links")
    store.drop(f"{name}-sets", f"{name}-ends")
    return links


def near_duplicates(
    docs: DataFrame, *, n_words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, crowd: int = CROWD,
    near: int = NEAR, store: Store | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs` (doc_id, text)."""
    store = store or Store(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    rows = store.put(_signed(docs, n_words).withColumn("cls", F.xxhash64("h1", "h2")), "rows")
    classes = store.put(rows.filter("n > 0").groupBy("cls").agg(
        F.min("key").alias("key"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature")), "classes")

    # Regions of the first depth, and in which orders a set shares one.
    entries = _entries(classes)
    shared = entries.groupBy("p").agg(F.count("*").alias("size")).filter("size > 1")
    met = store.put(entries.join(shared, "p").select("cls", "turn", "size"), "met")
    in_orders = met.groupBy("cls").agg(
        F.sum("size").alias("popular"), F.sort_array(F.collect_list(F.struct("turn", F.expr(f"size > {crowd}").alias("crowded")))).alias("met"))
    # From here on only sets that share a region move.
    members = store.put(classes.join(in_orders, "cls").select(
        "cls", "key", "n", "signature", "popular", F.col("met.turn").alias("turns"), F.col("met.crowded").alias("crowded")), "members")
    paths = store.put(_paths(members), "paths")
    store.drop("met")

    star = _hubs(paths, store)
    beside = _neighbours(paths, near, store)

    best = store.put(_likely(star.groupBy("b").agg(F.max(F.struct("times", "a")).alias("best")).select("best.a", "b"), members, percent), "best")
    links = _confirmed(best, docs, members, n_words, percent, store, "first")
    labels = components(links, store, "first")

    def told(pairs: DataFrame, column: str) -> DataFrame:
        own = labels.select(F.col("node").alias(column), F.col("component").alias(f"c_{column}"))
        return pairs.join(own, column, "left").withColumn(f"c_{column}", F.coalesce(f"c_{column}", column))

    rest = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(
        beside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    apart = told(told(rest, "a"), "b").filter("c_a <> c_b").select("a", "b")
    apart = store.put(_likely(apart, members, percent), "apart")
    links = links.union(_confirmed(apart, docs, members, n_words, percent, store, "second"))
    labels = store.put(components(links, store, "second"), "labels")
    store.drop("members", "paths", "star", "neighbours", "best", "apart")

    named = classes.select("cls", "least").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cls", "component_id")
    some = rows.filter("n > 0").join(named, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.union(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
