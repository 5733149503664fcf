"""Near-duplicate documents: an exact Jaccard join over word shingles by universe partition and pigeonhole.

The universe of shingles is cut into segments by hash. Two sets whose symmetric difference is at most H
cannot differ in every one of H+1 segments, so they agree on at least one; a segment looked up with its
one-deletion neighbourhood (the segment, and the segment without each one element) tolerates one
difference and so counts twice. Sets of similar size share a band, and H and the number of segments
follow from the band. A few segments of each band (`Bands.room`) are indexed with their neighbourhood,
the others as they are, and there are more segments than H+1 where the smallest sets of the band leave
some empty (`Bands.spare`): so a set may do without as many units. A key is costly when more than `COSTLY`
sets hold it - an empty segment, or shared boiler-plate. Each set leaves out its costly keys, those that
most sets hold first, up to what it may do without (one for a segment, two for one with a neighbourhood).
That loses no pair: all sets take keys in one order, so of the keys that a pair shares, which are worth
more than either may do without, neither leaves out the last.

Candidates are verified on the whole sets, which are made once. Only links that can change a component
are verified: equal sets are one class from the start; in each list of classes with an equal segment, all
are compared with the list's hub (the class that shares most segments with others), the hub shared most
first. Lists whose members then still lie in different components are compared pair by pair if they are
no longer than a key that is not costly, which is linear in their rows; members of longer ones are
compared by prefixes: with shingles in one order for all, the rarest first, two linked sets share one among the first few of the
smaller and the first few of the larger set, so what a whole list has in common makes no pairs. So a group
of near copies costs about its size, and no link between different components is lost.

Defined cases: a null, empty or blank text has an empty set, size 0, and is linked with nothing; a text
of fewer words than a shingle is one shingle of all its words; repeated ids are kept as they are, each
row with its own text; a row without an id is linked like any other, and a component is named by its
smallest id, null if it has none; extra columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vernissage.llm import tokens as T
from vernissage.llm.components import components
from vernissage.llm.store import Store

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
COSTLY = 8
BAND_RATIO = 1.4
BITMAP_WORDS = 16
PASSES = 4


def shingle_sets(texts: T.Texts, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, where each text's begin)."""
    w = T.words(texts)
    value, text, _ = T.grams(w, n_words)
    counts = np.diff(w.first)
    for i in np.flatnonzero((counts > 0) & (counts < n_words)):
        h = np.zeros(1, dtype=T.U)
        for x in w.hash[w.first[i] : w.first[i + 1]]:
            h = h * T.U(0xC2B2AE3D27D4EB4F) + x
        value, text = np.append(value, T.mix(h + T.U(counts[i]))), np.append(text, i)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    if len(value):
        keep = np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]))
        value, text = value[keep], text[keep]
    return value, np.searchsorted(text, np.arange(len(texts) + 1))


class Bands:
    """Bands of set sizes whose upper bounds grow by BAND_RATIO, and for each tag (a band that a pair
    is looked for in) the most elements a linked pair can differ in."""

    def __init__(self, percent: int, largest: int = 1 << 40) -> None:
        self.percent = percent
        uppers = [1]
        while uppers[-1] < largest:
            uppers.append(max(uppers[-1] + 1, int(uppers[-1] * BAND_RATIO)))
        self.uppers = np.array(uppers, dtype=np.int64)
        every = range(len(uppers))
        self.differs = np.array([self.differ(b) for b in every], dtype=np.int64)
        self.rooms = np.array([self.room(b) for b in every], dtype=np.int64)
        self.spares = np.array([self.spare(b) for b in every], dtype=np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.uppers, sizes)

    def differ(self, band: int) -> int:
        """Of two sets of at most u elements with |A & B| * 100 >= percent * |A | B|: at most
        2u (100-p) / (100+p) elements lie in one of them only."""
        p = self.percent
        return int(2 * int(self.uppers[band]) * (100 - p) // (100 + p))

    def room(self, band: int) -> int:
        """How many segments of the band are indexed with their neighbourhood."""
        return 1 + (self.differ(band) + 1) // 40

    def spare(self, band: int) -> int:
        """How many segments the band has beyond differ(band) + 1: as many as the smallest sets looked up in
        it are expected to leave empty, and one and a half standard deviations more; at most half as many again."""
        least = max(1, int(self.uppers[band - 1]) * self.percent // 100) if band else 1
        spare = 0
        for _ in range(20):
            segments = self.differ(band) + 1 + spare
            empty = segments * math.exp(-least / segments)
            spare = min((self.differ(band) + 1) // 2, max(0, math.ceil(empty + 1.5 * math.sqrt(empty)) - self.room(band)))
        return spare


def signatures(values: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, code) of all sets, which follow one another in `values` (distinct uint64 each). A set is
    looked up in its own band and the next ones in which a linked larger set can lie. A code is twice
    the tag, plus one for keys of a segment with its neighbourhood."""
    n = np.diff(first)
    own, last = bands.of(n), bands.of(n * 100 // bands.percent)
    found = [(np.empty(0, np.int64), np.empty(0, T.U), np.empty(0, np.int16))]
    for step in range(int((last - own).max(initial=-1)) + 1):
        # Where nothing can differ, sets are linked only if equal.
        tried = (n > 0) & (own + step <= last) & (bands.differs[np.minimum(own + step, last)] > 0)
        rows = np.flatnonzero(tried)
        if not len(rows):
            continue
        tag = own[rows] + step
        m, room = bands.differs[tag] + 1 + bands.spares[tag], bands.rooms[tag]
        salt = T.U(0x632BE59BD9B4E019) * (tag + 1).astype(T.U)
        begin = np.cumsum(m) - m
        of = np.repeat(np.arange(len(rows)), n[rows])
        element = T.mix(values[np.repeat(tried, n)] ^ salt[of])
        segment = (element % m.astype(T.U)[of]).astype(np.int64)
        place, element = begin[of] + segment, T.mix(element)
        sums = np.zeros(int(m.sum()), dtype=T.U)
        np.add.at(sums, place, element)
        part = np.repeat(np.arange(len(rows)), m)
        number = np.arange(len(sums)) - begin[part]
        where = T.mix(number.astype(T.U) * T.U(0x2545F4914F6CDD1D) ^ salt[part])
        found.append((rows[part], T.mix(sums ^ where), (2 * tag[part] + (number < room[part])).astype(np.int16)))
        near = segment < room[of]
        place, of = place[near], of[near]
        found.append((rows[of], T.mix((sums[place] - element[near]) ^ where[place]), (2 * tag[of] + 1).astype(np.int16)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _set_table(keyed: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, row, n_shingles, h1, h2): two sets are one class when both hash words agree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch.column(2), 1 << 20):
                values, first = shingle_sets(part, n_words)
                mixed = np.zeros(len(values) + 1, dtype=T.U)
                np.cumsum(T.mix(values), dtype=T.U, out=mixed[1:])
                again = np.zeros(len(values) + 1, dtype=T.U)
                np.cumsum(T.mix(values * T.BASE), dtype=T.U, out=again[1:])
                n, own = np.diff(first), slice(part.at, part.at + len(part))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[own], batch.column(1)[own], pa.array(n, pa.int64()),
                    pa.array(T.longs(mixed[first[1:]] - mixed[first[:-1]])),
                    pa.array(T.longs(again[first[1:]] - again[first[:-1]])),
                ], names=["doc_id", "row", "n_shingles", "h1", "h2"])

    return keyed.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, n_shingles long, h1 long, h2 long")


def _parity(values: np.ndarray) -> np.ndarray:
    """A set's parity bitmap: each element flips one bit, so two bitmaps differ in at most as many bits as
    the sets in elements. Of at least 0.7 bits an element, a power of two in size, so that of unrelated
    sets differs in more bits than linked sets can differ in elements."""
    size = 64 * BITMAP_WORDS
    while size < 0.7 * len(values):
        size *= 2
    place = (T.mix(values ^ T.U(0xA0761D6478BD642F)) % T.U(size)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=size) & 1).astype(np.uint8)).view(np.int64)


def _whole_sets(keyed: DataFrame, n_words: int) -> DataFrame:
    """(cls, n, items, bits): each text's set and its parity bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch.column(1), 1 << 20):
                values, first = shingle_sets(part, n_words)
                bits = [_parity(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part.at : part.at + len(part)], pa.array(np.diff(first), pa.int64()),
                    T.lists(T.longs(values), np.diff(first)),
                    T.lists(np.concatenate(bits), np.array([len(x) for x in bits])),
                ], names=["cls", "n", "items", "bits"])

    return keyed.select("row", "text").mapInArrow(run, "cls long, n long, items array<long>, bits array<long>")


def _signature_rows(whole: DataFrame, percent: int, turn: int, turns: int) -> DataFrame:
    """(cls, key, code): the signatures of each set whose keys are of this turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            values, first = lists.values.to_numpy(zero_copy_only=False).view(T.U), lists.offsets.to_numpy()
            at = 0
            while at < len(ids):  # sets of about 2**17 elements in all, or one larger set
                to = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 17), side="right")) - 1)
                cls, keys, codes = signatures(values[first[at] : first[to]], first[at : to + 1] - first[at], bands)
                own = keys % T.U(turns) == T.U(turn)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at:to][cls[own]]), pa.array(T.longs(keys[own])), pa.array(codes[own])], names=["cls", "key", "code"])
                at = to

    return whole.select("cls", "items").mapInArrow(run, "cls long, key long, code short")


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity bitmaps, a lower bound of what two sets differ in, do not rule them out."""
    left = bits.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = bits.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    # Sizes of a pair are within percent of each other, so one bitmap is at most a few halvings longer:
    # the two halves of a bitmap, one over the other, are the bitmap of half the size.
    near = pairs.join(left, "a").join(right, "b").filter(f"least(na, nb) * 100 >= {percent} * greatest(na, nb)")
    for _ in range(1 + 100 // percent):
        for own, other in (("ba", "bb"), ("bb", "ba")):
            near = near.withColumn(own, F.expr(
                f"CASE WHEN size({own}) > size({other}) THEN zip_with(slice({own}, 1, size({own}) div 2), "
                f"slice({own}, size({own}) div 2 + 1, size({own}) div 2), (x, y) -> x ^ y) ELSE {own} END"))
    off = "aggregate(zip_with(ba, bb, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return near.filter(f"size(ba) <> size(bb) OR {off} * {100 + percent} <= {100 - percent} * (na + nb)").select("a", "b")


def _verify(pairs: DataFrame, whole: DataFrame, percent: int, store: Store, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = store.put(pairs, f"{name}-pairs")
    left = whole.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = whole.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    near = F.expr(f"least(na, nb) * 100 >= {percent} * greatest(na, nb)")
    # Members bring their sets to the hub, not the hub's to each member.
    left = left.join(pairs.select("a").distinct(), "a", "left_semi")
    both = pairs.join(right, "b").join(left, "a").filter(near)
    common = F.size(F.array_intersect("ia", "ib")).cast("long")
    linked = both.withColumn("common", common).filter(
        f"common * 100 >= {percent} * (na + nb - common)").select("a", "b")
    linked = store.put(linked, f"{name}-links")
    store.drop(f"{name}-pairs")
    return linked


def _lists(met: DataFrame, percent: int, costly: int) -> DataFrame:
    """(cls, key, pop): the keys that each class is looked up by, and how often they are shared in all.
    All of it is decided per class, after one shuffle."""
    bands = Bands(percent)
    room = F.array(*(F.lit(x) for x in (bands.rooms + bands.spares).tolist()))
    dealt = met.repartition("cls").withColumn("tag", F.expr("code div 2").cast("int"))
    heavy = F.col("freq") > costly
    before = Window.partitionBy("cls", "tag").orderBy(F.desc("freq"), "key")
    worth = F.sum(F.when(heavy, 1 + F.col("code") % 2)).over(before)
    marked = dealt.withColumn("left_out", heavy & (worth <= F.get(room, F.col("tag"))))
    once = marked.groupBy("cls", "key").agg(F.max("freq").alias("freq"), F.max("left_out").alias("left_out")).filter("NOT left_out")
    return once.withColumn("pop", F.sum("freq").over(Window.partitionBy("cls"))).select("cls", "key", "pop")


def _prefix_pairs(members: DataFrame, whole: DataFrame, percent: int, store: Store) -> DataFrame:
    """Pairs of `members` (cls, c, n) of different components c that a link is possible for. With the items
    of all sets in one order, rarest first, let a linked pair's first common item stand at place i of the
    larger and j of the smaller set, n and m items long: n - i and m - j are at least what they share."""
    held = whole.join(members.select("cls"), "cls", "left_semi").select("cls", F.explode("items").alias("item"))
    for k in range(PASSES):
        part = held.filter(F.pmod("item", F.lit(PASSES)) == k).repartition("item")
        often = part.groupBy("item").agg(F.count("*").alias("freq")).filter("freq > 1")
        store.put(part.join(often, "item"), f"often/pass={k}")
    often = store.get("often", "item long, cls long, freq long").join(members, "cls")
    # Items of one set come first and are not listed. Equal rows of `whole` tie.
    by_set = Window.partitionBy("cls")
    placed = often.withColumn("rank", F.dense_rank().over(by_set.orderBy("freq", "item"))).withColumn(
        "place", F.col("n") - F.max("rank").over(by_set) + F.col("rank") - 1)
    # As many places as leave what a pair must share: with any smaller set, and with one at least as large.
    placed = store.put(placed.filter(f"(n - place) * 100 >= {percent} * n").select("item", "cls", "c", "n", "place"), "placed")
    store.drop("often")
    short = placed.filter(f"(n - place) * {100 + percent} >= 2 * {percent} * n")
    return placed.alias("p").join(short.alias("q"), F.expr(
        f"p.item = q.item AND p.c <> q.c AND (p.n > q.n OR (p.n = q.n AND p.cls > q.cls)) "
        f"AND least(p.n - p.place, q.n - q.place) * {100 + percent} >= {percent} * (p.n + q.n)")).select(
        F.col("q.cls").alias("a"), F.col("p.cls").alias("b")).distinct()


def jaccard_components(
    docs: DataFrame, *, n_words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, costly: int = COSTLY,
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for every row of `docs` (doc_id, text). class_id:
    the smallest document with the same set; component_id: the smallest document that links lead to."""
    store = Store(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Inside, rows go by a key of their own: ids can be null or repeat with another text.
    keyed = keyed.withColumn("row", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))
    sets = store.put(_set_table(keyed, n_words), "sets")
    firsts = store.put(sets.filter("n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("row").alias("cls"), F.min("doc_id").alias("class_id")), "classes")
    whole = store.put(_whole_sets(keyed.join(firsts.select(F.col("cls").alias("row")), "row", "left_semi"), n_words), "whole")
    for k in range(PASSES):
        # The count and the join read one table; the signatures of one pass lie there at a time.
        own = store.put(_signature_rows(whole, percent, k, PASSES), "turn")
        shared = own.groupBy("key").agg(F.count("*").alias("freq")).filter("freq > 1")
        store.put(own.join(shared, "key"), f"met/pass={k}")
    store.drop("turn")
    lists = store.put(_lists(store.get("met", "cls long, key long, code short, freq long"), percent, costly), "lists")
    store.drop("met")
    bits = whole.select("cls", "n", "bits")
    hubs = lists.groupBy("key").agg(
        F.max_by("cls", F.struct("pop", -F.col("cls"))).alias("hub"), F.count("*").alias("n")).filter("n > 1")
    star = store.put(lists.join(hubs, "key").filter("cls <> hub").groupBy(F.col("hub").alias("a"), F.col("cls").alias("b")).agg(
        F.count("*").alias("keys")), "star")
    # First the hub that a class shares most with, then the others that could still join components.
    best = star.groupBy("b").agg(F.max_by("a", F.struct("keys", -F.col("a"))).alias("a")).select("a", "b")
    verify = lambda pairs, name: _verify(_possible(pairs, bits, percent), whole, percent, store, name)
    links = verify(best, "best")
    labels = components(links, store, "first")

    def told(df: DataFrame, column: str) -> DataFrame:
        own = labels.select(F.col("node").alias(column), F.col("component").alias(f"c_{column}"))
        return df.join(own, column, "left").withColumn(f"c_{column}", F.coalesce(f"c_{column}", column))

    others = told(told(star.select("a", "b"), "a"), "b").filter("c_a <> c_b").select("a", "b")
    done = store.put(others.join(best, ["a", "b"], "left_anti"), "others")
    links = store.put(links.union(verify(done, "more")), "links")
    labels = components(links, store, "second")
    # What is left: lists whose members lie in different components.
    marked = told(lists.select("key", F.col("cls").alias("a")), "a")
    open_keys = marked.groupBy("key").agg(
        F.min("c_a").alias("lo"), F.max("c_a").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    left = store.put(marked.join(open_keys.select("key", "n"), "key"), "open")
    short = left.filter(F.col("n") <= costly)
    pairs = short.join(short.select("key", F.col("a").alias("b"), F.col("c_a").alias("c_b")), "key").filter(
        "a < b AND c_a <> c_b").select("a", "b").distinct()
    members = left.filter(F.col("n") > costly).select(F.col("a").alias("cls"), F.col("c_a").alias("c")).distinct()
    members = store.put(members.join(whole.select("cls", "n").distinct(), "cls"), "members")
    store.drop("lists")
    across = store.put(pairs.union(_prefix_pairs(members, whole, percent, store)).distinct(), "across")
    store.drop("open", "placed")
    for tried in (best, done):
        across = across.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(
            tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    labels = components(links.union(verify(across, "rest")), store, "last")
    store.drop("whole", "star", "members", "others", "across")
    named = firsts.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    ids = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    named = named.join(ids, "component").select("h1", "h2", "class_id", "component_id")
    return sets.join(named, ["h1", "h2"], "left").select(
        "doc_id", "n_shingles", *(F.when(F.col("n_shingles") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
                                  for c in ("class_id", "component_id")))
