"""Language-model score of whole texts: the marginal likelihood of all subword segmentations.

Pieces come from an existing public vocabulary with byte pieces, so every text has a probability. Their
scores there are ranks, read as a Zipf law; two expectation steps over the training words, counted over
all training documents, re-weight them. A word, behind the vocabulary's word mark, is a lattice whose
edges are the pieces found in it; a forward recursion in logarithms sums all paths. Pieces do not cross
words, so a text is the sum over its words, and the end of the text has a probability of its own; all
of it sums to one over texts.

Each distinct word of the corpus is counted and scored once. Words of at least `tau` occurrences, tau
being the least for which no more than `MOST_FREQUENT` words remain, are sent to the tasks; the others
are joined by hash. Both give the same sums.

Defined cases: a null text is empty and has the end as its only token; a null id is not held out; with
nothing to learn from, counts are zero and the Zipf law stands; repeated rows are scored each; extra
columns are ignored. Words are told apart by a hash of 64 bits of their lower-cased bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm import tokens as T
from vernissage.llm.langid import held_out
from vernissage.llm.store import Store

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
MOST_FREQUENT = 1 << 19
SMOOTHING = 500.0
FLAT = 1e-7


class Pieces:
    """Piece strings with their log10 probabilities, found by hash and length."""

    def __init__(self, strings: list[bytes], weights: np.ndarray) -> None:
        lengths = np.array([len(s) for s in strings])
        data = np.frombuffer(b"".join(strings), np.uint8)
        start = np.cumsum(lengths) - lengths
        hashes = T.span_hashes(T.prefix_sums(data), start, start + lengths)
        self.hash, where = np.unique(hashes, return_inverse=True)
        self.weight = np.bincount(where, weights=weights)
        self.lengths = np.unique(lengths)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.hash >> T.U(42)).astype(np.int64)] = True

    def weigh(self, weight: np.ndarray, end: float) -> None:
        total = weight.sum() + end
        self.weight = weight
        self.log = np.log10(np.maximum(weight / total, 1e-300))
        self.log_end = float(np.log10(end / total))

    def edges(self, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, start, piece) of all pieces found inside the words of `data`."""
        sums = T.prefix_sums(data)
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
        for n in self.lengths.tolist():
            at = np.flatnonzero(left >= n)
            value = T.span_hashes(sums, at, at + n)
            hit = self.maybe[(value >> T.U(42)).astype(np.int64)]
            at, value = at[hit], value[hit]
            piece = np.searchsorted(self.hash, value)
            piece[piece == len(self.hash)] = 0
            right = self.hash[piece] == value
            yield n, at[right], piece[right]

    def lattice(self, data: np.ndarray, bounds: np.ndarray, times: np.ndarray | None = None):
        """The log10 marginal of each word; with `times`, also how often each piece is expected, each
        word taken so often."""
        found = list(self.edges(data, bounds))
        length = np.concatenate([np.full(len(a), n) for n, a, _ in found])
        start, piece = (np.concatenate([f[k] for f in found]) for k in (1, 2))
        word = np.searchsorted(bounds, start, side="right") - 1
        begin = start - bounds[word]
        finish = begin + length
        ahead = np.full(len(data) + len(bounds), -np.inf)  # one state more than bytes, for each word
        base = bounds[:-1] + np.arange(len(bounds) - 1)
        ahead[base] = 0.0
        source, target, log = base[word] + begin, base[word] + finish, self.log[piece] * np.log(10)
        order = np.lexsort((length, finish))
        steps = _runs(finish[order], length[order])
        for a, b in steps:
            e = order[a:b]
            ahead[target[e]] = np.logaddexp(ahead[target[e]], ahead[source[e]] + log[e])
        last = base + np.diff(bounds)
        total = ahead[last]
        if times is None:
            return total / np.log(10)
        behind = np.full(len(ahead), -np.inf)
        behind[last] = 0.0
        order = np.lexsort((length, -begin))
        for a, b in _runs(begin[order], length[order]):
            e = order[a:b]
            behind[source[e]] = np.logaddexp(behind[source[e]], behind[target[e]] + log[e])
        share = np.exp(ahead[source] + log + behind[target] - total[word]) * times[word]
        return total / np.log(10), np.bincount(piece, weights=share, minlength=len(self.hash))


def _runs(first: np.ndarray, second: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal pairs: edges of one length into one place, no two of which share a state."""
    if not len(first):
        return []
    cut = np.flatnonzero((np.diff(first) != 0) | (np.diff(second) != 0)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(first)], strict=True))


def vocabulary(path: str = VOCABULARY) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    strings, weights = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i):
            continue
        text = model.id_to_piece(i)
        if model.is_byte(i):
            strings.append(bytes([int(text[3:-1], 16)]))
            weights.append(FLAT)
        else:
            strings.append(text.encode())
            weights.append(1 / (10 - min(model.get_score(i), 0)))
    have = set(strings)
    missing = [bytes([b]) for b in range(256) if bytes([b]) not in have]
    return Pieces(strings + missing, np.array(weights + [FLAT] * len(missing)))


def _marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) + len(MARK) for w in words])
    data = np.frombuffer(b"".join(MARK + w for w in words), np.uint8)
    return data, np.append(0, np.cumsum(lengths))


def _chunks(words: list[bytes], most: int = 1 << 19) -> Iterator[np.ndarray]:
    """Indices of words of about equal length, so that a chunk takes few steps."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    total = np.cumsum(lengths[order] + 4)
    for part in np.split(order, np.flatnonzero(np.diff(total // most)) + 1):
        if len(part):
            yield part


def _counts(docs: DataFrame) -> DataFrame:
    """(word, n): every distinct word, lower-cased, and how often the documents to learn from hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for part in T.slices(batch.column(0), 8 << 20):
                w = T.words(part)
                text = np.repeat(np.arange(len(part)), np.diff(w.first))
                _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
                n = np.bincount(which, weights=learn[part.at + text], minlength=len(first)).astype(np.int64)
                raw = T.lower_ascii(part.data).tobytes()
                words = [raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
                for a in range(0, len(words), 1 << 16):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(words[a : a + (1 << 16)], pa.binary()), pa.array(n[a : a + (1 << 16)])], names=["word", "n"])

    return docs.select("text", "held_out").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scores(
    docs: DataFrame, *, parts: int = 5, part: int = 1, path: str = VOCABULARY, rounds: int = 2,
    most_frequent: int = MOST_FREQUENT, store: Store | None = None,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    store = store or Store(docs.sparkSession)
    spark = store.spark
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       held_out(parts, part).alias("held_out"))
    ends = rows.filter("NOT held_out").count()
    words = store.put(_counts(rows), "words")
    known, tokens = words.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tokens, distinct = tokens + ends, known + (ends > 0)
    floor = np.log10(tokens + 0.5 * (distinct + 1))
    base_end = float(np.log10(ends + 0.5) - floor)
    pieces = vocabulary(path)
    prior = pieces.weight / pieces.weight.sum()
    pieces.weigh(prior, 0.15)
    for _ in range(rounds if ends else 0):
        used = spark.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], used=used) -> Iterator[pa.RecordBatch]:
            model, total = used.value, None
            for batch in batches:
                word, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for chunk in _chunks(word):
                    _, share = model.lattice(*_marked([word[i] for i in chunk]), n[chunk].astype(float))
                    total = share if total is None else total + share
            if total is not None:
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["piece", "share"])

        got = words.filter("n > 0").mapInArrow(expect, "piece int, share double").groupBy("piece").agg(F.sum("share").alias("share")).toArrow()
        weight = prior * SMOOTHING
        np.add.at(weight, got.column("piece").to_numpy(), got.column("share").to_numpy())
        pieces.weigh(weight, float(ends))
    used = spark.sparkContext.broadcast(pieces)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            log, key = np.zeros(len(word)), np.zeros(len(word), dtype=T.U)
            for chunk in _chunks(word):
                own = [word[i] for i in chunk]
                log[chunk] = used.value.lattice(*_marked(own))
                size = np.array([len(w) for w in own])
                start = np.cumsum(size) - size
                key[chunk] = T.span_hashes(T.prefix_sums(np.frombuffer(b"".join(own), np.uint8)), start, start + size)
            yield pa.RecordBatch.from_arrays([pa.array(T.longs(key)), pa.array(n), pa.array(log)], names=["key", "n", "log"])

    rated = store.put(words.mapInArrow(rate, "key long, n long, log double"), "rated")
    store.drop("words")
    by_count = sorted(((r.n, r.k) for r in rated.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    tau, held = by_count[0][0] + 1 if by_count else 1, 0
    for n, k in by_count:
        held += k
        if held > most_frequent:
            break
        tau = n
    often = rated.filter(F.col("n") >= tau).toArrow()
    key = often.column("key").to_numpy().view(T.U)
    order = np.argsort(key)
    frequent = spark.sparkContext.broadcast((
        key[order], often.column("n").to_numpy()[order], often.column("log").to_numpy()[order]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, logs = frequent.value
        base = np.log10(counts + 0.5) - floor
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in T.slices(batch.column(2)):
                own = slice(part.at, part.at + len(part))
                w = T.words(part)
                text = np.repeat(np.arange(len(part)), np.diff(w.first))
                at = np.searchsorted(keys, w.hash)
                at[at == len(keys)] = 0
                there = keys[at] == w.hash if len(keys) else np.zeros(len(at), bool)
                sums = [np.bincount(text[there], weights=v[at[there]], minlength=len(part)) for v in (base, logs, counts > 0)]
                rest, n = np.unique(np.stack([text[~there], T.longs(w.hash[~there])]), axis=1, return_counts=True) if not there.all() else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
                tail = np.bincount(rest[0], minlength=len(part))
                rows = row + np.arange(len(part))
                row += len(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows), batch.column(0)[own], batch.column(1)[own], pa.array(np.diff(w.first)),
                    pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64)),
                    T.lists(rest[1], tail), T.lists(n.astype(np.int64), tail),
                ], names=["row", "doc_id", "held_out", "words", "base", "log", "known", "keys", "times"])

    partial = store.put(rows.select("doc_id", "held_out", "text").mapInArrow(
        apply, "row long, doc_id long, held_out boolean, words long, base double, log double, known long, keys array<long>, times array<long>"), "partial")
    tail = partial.filter(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "times")).alias("t")).select(
        "row", F.col("t.keys").alias("key"), F.col("t.times").alias("times"))
    rare = rated.filter(F.col("n") < tau)
    more = tail.join(rare, "key").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.lit(float(floor)))).alias("b"),
        F.sum(F.col("times") * F.col("log")).alias("l"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("k"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return partial.join(more, "row", "left").select(
        "doc_id", "held_out", (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + zero("k") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") + F.lit(base_end)).alias("base_score"),
        (F.col("log") + zero("l") + F.lit(pieces.log_end)).alias("score"))
