"""Exact repeated substrings of the whole corpus, by interval expansion on Burrows-Wheeler transforms.

A string of `length` bytes that starts at two places is to be found, wherever it lies. Every such string
holds an anchor: the least hash among its runs of `ANCHOR` bytes, chosen by content alone, so both places
choose the same one at the same offset. Anchors that occur once are done. For the others:

* equal neighbourhoods (all strings whose anchor it is, together) are counted, not gathered: a
  neighbourhood that occurs twice is repeated as a whole, so exact copies never meet in one task;
* the distinct neighbourhoods of an anchor - less blocks of starts whose common part occurs once, which
  hold no repeat - go together into a Burrows-Wheeler transform. Breadth-first,
  the interval of every string is extended backwards by one byte; an interval whose right end has no
  common-prefix value yet gets the present depth, and is extended further. Values so appear in increasing
  order, and at depth `length` the search stops: ends without a value are common prefixes of `length` or
  more. Only intervals that still set a value are kept, at most one for each position;
* an anchor with more than `HOT` distinct neighbourhoods (a passage in very many documents) is not
  gathered: its strings are counted by hash over the cluster, first in ranges of `RANGE` start offsets -
  a range whose union is repeated is done, one whose common part is not has nothing -, then one by one.

Places are compared by document and offset, so a place seen from two anchors is one place.

Defined cases: null and empty texts, and texts shorter than `length`, lose nothing; overlapping repeats
count, also inside one text; rows with the same id are documents of their own, equal rows are copies of
each other; extra columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm import tokens as T
from vernissage.llm.store import Store

LENGTH = 400
ANCHOR = 128
HOT = 500
RANGE = 16
BATCH_BYTES = 1 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring values, by running values inside blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(T.U).max, dtype=T.U)
    grid[:n] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: T.Texts, length: int, anchor: int) -> dict[str, np.ndarray]:
    """A row for each anchor: `text`; `pos`, its offset there; `gram`, its hash; `low` and `top`, the
    least and greatest distance before it at which strings start whose anchor it is; `around`, the hash
    of all these strings together."""
    data, width = texts.data, length - anchor + 1
    if len(data) < length:
        return {k: np.empty(0, np.int64) for k in ("text", "pos", "gram", "low", "top", "around")}
    sums = T.prefix_sums(data)
    at = np.arange(len(data) - anchor + 1)
    value = T.span_hashes(sums, at, at + anchor)
    # The hash and, among equal ones, the first place.
    own = _least((value & T.U(0xFFFFFFFF00000000)) | at.astype(T.U), width)
    place = (own & T.U(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(place), dtype=bool)
    for a, b in zip(texts.bounds[:-1], texts.bounds[1:], strict=True):
        if b - a >= length:
            inside[a : b - length + 1] = True
    begins = np.flatnonzero(inside)  # where strings start that lie inside one text
    place = place[begins]
    new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (np.diff(begins) != 1)) if len(begins) else [])
    first, last = begins[new], begins[np.append(new[1:], len(begins)) - 1] if len(new) else begins[new]
    place = place[new]
    text = np.searchsorted(texts.bounds, place, side="right") - 1
    around = T.span_hashes(sums, first, last + length) ^ T.mix((place - first).astype(T.U))
    return {"text": text, "pos": place - texts.bounds[text], "gram": T.longs(value[place]),
            "low": place - last, "top": place - first, "around": T.longs(around)}


def rotations(x: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of `x` (bytes) sorted by their first `depth` bytes or more, by prefix doubling."""
    n = len(x)
    wrapped = np.concatenate([x, x[: 8] if n >= 8 else np.resize(x, 8)]).astype(T.U)
    key = np.zeros(n, dtype=T.U)
    for k in range(8):
        key = (key << T.U(8)) | wrapped[k : k + n]
    known, order = 8, np.argsort(key)
    while True:
        sorted_key = key[order]
        rank = np.empty(n, dtype=T.U)
        rank[order] = np.cumsum(np.append(False, sorted_key[1:] != sorted_key[:-1]), dtype=T.U)
        if known >= depth or int(rank[order[-1]]) == n - 1:
            return order
        key = rank * T.U(n) + np.roll(rank, -(known % n))
        order, known = np.argsort(key), known * 2


def common_prefix_groups(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the sorted rotations, and numbers that neighbours share whose common prefix has
    `length` bytes or more. Breadth-first backward extension of intervals, stopped at `length`."""
    n = len(x)
    order = rotations(x, length)
    bwt = x[order - 1].astype(np.int64)
    by_byte = np.argsort(x[order - 1], kind="stable")  # place in the first column -> place in the last
    first = np.empty(n, dtype=np.int64)
    first[by_byte] = np.arange(n)
    keys = bwt[by_byte] * n + by_byte
    following = np.full(n, n, dtype=np.int64)  # the next place with the same byte
    same = bwt[by_byte[1:]] == bwt[by_byte[:-1]]
    following[by_byte[:-1][same]] = by_byte[1:][same]
    known = np.zeros(n + 1, dtype=bool)
    known[0] = known[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        size = hi - lo
        place = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        last = following[place] >= np.repeat(hi, size)
        start = np.repeat(lo, size)[last]
        place = place[last]
        ends = first[place] + 1
        fresh = ~known[ends]
        place, ends, start = place[fresh], ends[fresh], start[fresh]
        known[ends] = True
        lo, hi = np.searchsorted(keys, bwt[place] * n + start), ends
    return order, np.cumsum(known[:n]) - 1


def repeated_starts(contexts: list[np.ndarray], places: np.ndarray, twice: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, the offsets at which a string of `length` bytes starts that also starts at
    another place. `places`: a number for the first byte of each context, the same for the same place
    of the corpus, growing by one with each byte; `twice`: contexts known to occur at two places."""
    lengths = np.array([len(c) for c in contexts])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    x = np.zeros(int((lengths + 1).sum()), dtype=np.uint8)
    own = np.repeat(np.arange(len(contexts)), lengths + 1)
    for s, c in zip(starts, contexts, strict=True):
        x[s : s + len(c)] = c
    # Bytes 0 and 255 never occur in UTF-8 text next to each other; 0 is the gap, a real 0 becomes 255.
    gap = np.zeros(len(x), dtype=bool)
    gap[starts + lengths] = True
    x[(x == 0) & ~gap] = 255
    order, group = common_prefix_groups(x, length)
    at = np.arange(len(x)) - starts[own]
    whole = (at + length <= lengths[own])[order]
    name = T.mix(places[own] + at.astype(T.U))[order]
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    low = np.minimum.reduceat(np.where(whole, name, np.iinfo(T.U).max), heads)
    high = np.maximum.reduceat(np.where(whole, name, T.U(0)), heads)
    known = np.maximum.reduceat(whole & twice[own][order], heads)
    hit = order[whole & ((low < high) | known)[group]]
    hit.sort()
    edges = np.searchsorted(hit, np.append(starts, len(x)))
    return [hit[a:b] - s for a, b, s in zip(edges[:-1], edges[1:], starts, strict=True)]


def spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of [s, s + length) for sorted starts, as maximal runs."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + length


def _keyed(docs: DataFrame, *carry: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("named"), text.alias("text"), *carry)
    return rows.select("named", F.coalesce("named", F.lit(0)).alias("doc_id"), "text",
                       F.xxhash64("text", F.col("named").isNull()).alias("th"), *carry)


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, store: Store) -> DataFrame:
    """(doc_id, th, lo, hi): for each document that has any, byte ranges, not yet united, covered by
    strings of `length` bytes that also start elsewhere. th: the hash of the text."""
    keyed = _keyed(docs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch.column(2)):
                got = anchors(part, length, anchor)
                pick = pa.array(got["text"] + part.at)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).take(pick), batch.column(3).take(pick), pa.array(got["pos"].astype(np.int32)),
                    pa.array(got["gram"]), pa.array(got["around"]), pa.array(got["low"].astype(np.int16)),
                    pa.array(got["top"].astype(np.int16)),
                ], names=["doc_id", "th", "pos", "gram", "around", "low", "top"])

    found = store.put(keyed.filter(F.octet_length("text") >= length).mapInArrow(
        find, "doc_id long, th long, pos int, gram long, around long, low short, top short"), "anchors")
    # Written before it is joined, so that AQE can send it whole or split a gram that many places have.
    shared = store.put(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "shared")
    met = store.put(found.join(shared, "gram", "left_semi"), "met")
    store.drop("anchors", "shared")
    kinds = met.groupBy("gram", "around").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos", "low", "top")).alias("at"))
    kinds = store.put(kinds.select("gram", "around", "n", "at.*"), "kinds")
    many = store.put(kinds.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "many")
    open_ = store.put(kinds.join(many, "gram"), "open")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(3)
            rows = want.flatten()
            doc = np.repeat(np.arange(batch.num_rows), want.value_lengths().to_numpy())
            column = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            raw = column.buffers()[2]
            at = offsets[doc] + rows.field("pos").to_numpy()
            lo, hi = at - rows.field("top").to_numpy(), at - rows.field("low").to_numpy() + length
            view = memoryview(raw) if raw is not None else b""
            for a in range(0, len(doc), 4096):
                own = slice(a, a + 4096)
                pick = pa.array(doc[own])
                part = rows[own]
                yield pa.RecordBatch.from_arrays([
                    *(part.field(c) for c in ("gram", "around", "n")), batch.column(0).take(pick), batch.column(1).take(pick),
                    *(part.field(c) for c in ("pos", "low", "top")),
                    pa.array([bytes(view[x:y]) for x, y in zip(lo[own], hi[own], strict=True)], pa.binary()),
                ], names=["gram", "around", "n", "doc_id", "th", "pos", "low", "top", "context"])

    def contexts(which: str) -> DataFrame:
        want = F.struct("gram", "around", "n", "pos", "low", "top")
        wanted = open_.filter(which).groupBy("doc_id", "th").agg(F.collect_list(want).alias("want"))
        return keyed.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "want").mapInArrow(
            cut, "gram long, around long, n long, doc_id long, th long, pos int, low short, top short, context binary")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "around", "n", "doc_id", "th", "pos", "low", "top", "context")), strict=True):
                # Rows come sorted by anchor: a batch ends between anchors.
                if size >= BATCH_BYTES and row[0] != rows[-1][0]:
                    yield expand(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[8])
        if rows:
            yield expand(rows)

    def expand(rows: list[tuple]) -> pa.RecordBatch:
        gram, around, n, doc_id, th, pos, low, top, text = zip(*rows, strict=True)
        gram, n, doc_id, th, pos, low, top = (np.array(v, dtype=np.int64) for v in (gram, n, doc_id, th, pos, low, top))
        base = T.mix(T.mix(doc_id.view(T.U)) ^ th.view(T.U)) + (pos - top).astype(T.U)
        row, first, last = _shared_blocks(gram, n, low, top, text, length)
        texts = [np.frombuffer(text[r], np.uint8)[a : b + length] for r, a, b in zip(row, first, last, strict=True)]
        starts = repeated_starts(texts, base[row] + first.astype(T.U), n[row] > 1, length)
        out = [(gram[r], around[r], *spans(s + a - top[r], length)) for r, a, s in zip(row, first, starts, strict=True) if len(s)]
        lengths = np.array([len(o[2]) for o in out])
        flat = lambda k: np.concatenate([o[k] for o in out]).astype(np.int32) if out else np.empty(0, np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
            T.lists(flat(2), lengths), T.lists(flat(3), lengths)], names=["gram", "around", "lo", "hi"])

    ranges = "gram long, around long, lo array<int>, hi array<int>"
    few = contexts(f"kinds <= {hot}").repartition("gram").sortWithinPartitions("gram").mapInArrow(transform, ranges)
    few = store.put(few, "few")
    whole = kinds.filter("n > 1").select(
        "gram", "around", F.array((-F.col("top")).cast("int")).alias("lo"), F.array((length - F.col("low")).cast("int")).alias("hi"))
    covered = whole.unionByName(few)
    if not many.filter(f"kinds > {hot}").isEmpty():
        often = store.put(contexts(f"kinds > {hot}"), "often")
        covered = covered.unionByName(_counted(often, length, store))
    covered = store.put(covered, "covered")
    store.drop("few", "often", "open", "kinds", "hot-ranges", "hot-strings")
    return met.join(covered, ["gram", "around"]).select(
        "doc_id", "th", F.transform("lo", lambda x: x + F.col("pos")).alias("lo"), F.transform("hi", lambda x: x + F.col("pos")).alias("hi"))


def _blocks(low: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, block): the blocks of RANGE start distances, counted from the anchor, that each row touches."""
    count = top // RANGE - low // RANGE + 1
    row = np.repeat(np.arange(len(low)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (low // RANGE)[row]


def _block_hashes(gram, low, top, text: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(row, block, hash of what all strings of the block have in common, hash of their union, or 0 if the
    block is not full). What they have in common lies inside the context even of a block that is not full."""
    row, block = _blocks(low, top)
    sizes = np.array([len(t) for t in text])
    begin = (np.cumsum(sizes) - sizes)[row] + top[row]  # the anchor
    sums = T.prefix_sums(np.frombuffer(b"".join(text), np.uint8))
    near, far = block * RANGE, block * RANGE + RANGE - 1
    salt = T.mix(gram.view(T.U)[row] ^ (block * 2).astype(T.U))
    common = T.mix(T.span_hashes(sums, begin - near, begin - far + length) ^ salt)
    full = (near >= low[row]) & (far <= top[row])
    union = np.zeros(len(row), dtype=T.U)
    union[full] = T.mix(T.span_hashes(sums, (begin - far)[full], (begin - near)[full] + length) ^ (salt[full] + T.U(1)))
    return row, block, common, union


def _shared_blocks(gram, n, low, top, text: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last): the runs of starts, as offsets in the context, that can be repeated - those of
    blocks whose common part occurs twice. The rest need not be sorted."""
    row, block, common, _ = _block_hashes(gram, low, top, text, length)
    _, which = np.unique(common, return_inverse=True)
    live = np.bincount(which, weights=n[row])[which] > 1
    row, block = row[live], block[live]
    new = np.append(True, (np.diff(row) != 0) | (np.diff(block) != 1))[: len(row)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1
    own = row[head]
    first = top[own] - np.minimum(block[tail] * RANGE + RANGE - 1, top[own]) if len(head) else head
    last = top[own] - np.maximum(block[head] * RANGE, low[own]) if len(head) else head
    return own, first, last


def _counted(often: DataFrame, length: int, store: Store) -> DataFrame:
    """The same for anchors with very many neighbourhoods: strings counted by hash, none gathered."""
    def columns(batch: pa.RecordBatch) -> tuple:
        return (*(batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "around", "n", "low", "top")),
                batch.column("context").to_pylist())

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                gram, around, n, low, top, text = columns(big.slice(at, 2048))
                row, block, common, union = _block_hashes(gram, low, top, text, length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram[row]), pa.array(around[row]), pa.array(n[row]),
                    pa.array(np.maximum(block * RANGE, low[row]).astype(np.int32)),
                    pa.array(np.minimum(block * RANGE + RANGE - 1, top[row]).astype(np.int32)),
                    pa.array(T.longs(common)), pa.array(T.longs(union), mask=union == 0),
                ], names=["gram", "around", "n", "low", "top", "common", "whole"])

    spread = often.repartition("gram", "around")
    first = store.put(spread.mapInArrow(
        ranges, "gram long, around long, n long, low int, top int, common long, whole long"), "hot-ranges")
    twice = lambda c: first.groupBy(c).agg(F.sum("n").alias("s")).filter(f"s > 1 AND {c} IS NOT NULL").select(c)
    some = first.join(twice("common"), "common", "left_semi")
    done = some.join(twice("whole"), "whole", "left_semi").select(
        "gram", "around", (-F.col("top")).alias("lo"), (length - F.col("low")).alias("hi"))
    blocks = F.collect_list(F.struct("low", "top", "asks")).alias("blocks")
    # Strings of a block that is done count for the others, but need no answer of their own.
    give = some.join(twice("whole").withColumn("done", F.lit(True)), "whole", "left").withColumn(
        "asks", F.col("done").isNull()).groupBy("gram", "around").agg(blocks)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                batch = big.slice(at, 2048)
                gram, around, n, _, top, text = columns(batch)
                asked = batch.column("blocks")
                own = np.repeat(np.arange(batch.num_rows), asked.value_lengths().to_numpy())
                near, far = (asked.flatten().field(c).to_numpy().astype(np.int64) for c in ("low", "top"))
                count = far - near + 1
                row = np.repeat(own, count)
                away = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(near, count)
                sizes = np.array([len(t) for t in text])
                begin = (np.cumsum(sizes) - sizes)[row] + top[row] - away
                sums = T.prefix_sums(np.frombuffer(b"".join(text), np.uint8))
                key = T.mix(T.span_hashes(sums, begin, begin + length) ^ T.mix(gram.view(T.U)[row] ^ (away * 2).astype(T.U)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram[row]), pa.array(around[row]), pa.array(n[row]), pa.array(away.astype(np.int32)),
                    pa.array(T.longs(key)), pa.array(np.repeat(asked.flatten().field("asks").to_numpy(zero_copy_only=False), count)),
                ], names=["gram", "around", "n", "top", "key", "asks"])

    each = store.put(often.join(give, ["gram", "around"]).mapInArrow(
        singles, "gram long, around long, n long, top int, key long, asks boolean"), "hot-strings")
    counted = each.groupBy("key").agg(F.sum("n").alias("s")).filter("s > 1").select("key")
    asked = each.filter("asks").join(counted, "key", "left_semi")
    single = asked.select("gram", "around", (-F.col("top")).alias("lo"), (length - F.col("top")).alias("hi"))
    return done.unionByName(single).groupBy("gram", "around").agg(
        F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))


def removed(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, carry: tuple[str, ...] = (), store: Store | None = None) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans, kept_sha256, span_lo, span_hi) for every row: the text
    that is left, and the byte ranges of the input that went; with the columns `carry` of the row. A character cut in half is dropped from
    `text`, not from the hash, which is of the remaining bytes."""
    store = store or Store(docs.sparkSession)
    found = store.put(repeated_spans(docs, length=length, anchor=anchor, hot=hot, store=store), "spans")
    store.drop("met")
    per_doc = found.groupBy("doc_id", "th").agg(
        F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    keyed = _keyed(docs, *carry)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            at = 0
            for doc_id, text, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("named", "text", "lo", "hi")), strict=True):
                raw = text.encode()
                lo, hi = np.array(lo or [], np.int64), np.array(hi or [], np.int64)
                if len(lo):
                    by = np.argsort(lo, kind="stable")
                    lo, hi = lo[by], np.maximum.accumulate(hi[by])
                    new = np.append(True, lo[1:] > hi[:-1])
                    lo, hi = lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]
                kept = b"".join(raw[a:b] for a, b in zip(np.append(0, hi), np.append(lo, len(raw)), strict=True))
                out.append((doc_id, kept.decode(errors="ignore"), len(raw), len(raw) - len(kept), len(lo),
                            hashlib.sha256(kept).hexdigest(), lo.tolist(), hi.tolist()))
                if len(out) == 512:
                    yield _stripped(out, batch, at, carry)
                    out, at = [], at + 512
            if out:
                yield _stripped(out, batch, at, carry)

    return keyed.join(per_doc, ["doc_id", "th"], "left").select("named", "text", "lo", "hi", *carry).mapInArrow(strip, _STRIPPED + kinds)


_STRIPPED = ("doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
             "span_lo array<long>, span_hi array<long>")


def _stripped(rows: list[tuple], batch: pa.RecordBatch, at: int, carry: tuple[str, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = [x.split()[0] for x in _STRIPPED.split(", ")]
    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    kept = [batch.column(c)[at : at + len(rows)] for c in carry]
    return pa.RecordBatch.from_arrays(made + kept, names=names + list(carry))
