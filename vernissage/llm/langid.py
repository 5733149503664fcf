"""Language of whole texts: averaged embeddings of hashed subwords and a linear softmax.

A text is the average of the embeddings of its byte 3- and 4-grams (letters lower-cased, everything that
is no letter read as a space), each hashed to one of `BUCKETS` rows. Embeddings and softmax are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows (`per_language`
of each language, by hash; their whole texts). A fifth of the sample is held back: it sets the
temperature, and the score below which a prediction is rejected - the `REJECT_SHARE` quantile of the
scores of right predictions, and nothing else. With one language every score is 1, so none of its texts is
rejected. Since averaging and softmax weights are both linear,
scoring needs one table of language scores per bucket and no multiplication per subword.

Defined cases: a null text, and one without a letter, is `und` with score 0 and rejected; without any
labelled row every text is; a null id is not held out; repeated rows get equal predictions; extra
columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.llm import tokens as T
from vernissage.llm.store import ship

BUCKETS = 1 << 14
DIMENSIONS = 16
PER_LANGUAGE = 1000
EPOCHS = 8
RATE = 3.0
REJECT_SHARE = 0.001
FEW = 100
UNKNOWN = "und"
_CLASS = np.full(256, 32, dtype=np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def subwords(texts: T.Texts) -> Iterator[np.ndarray]:
    """For each subword length, the bucket of the subword at every byte; BUCKETS where there is none."""
    data = _CLASS[texts.data].astype(np.uint32)
    n = len(data)
    blank = data == 32
    for length in (3, 4):
        bucket = np.full(n, BUCKETS, dtype=np.int32)
        if n >= length:
            code = np.zeros(n - length + 1, dtype=np.uint32)
            empty = np.ones(n - length + 1, dtype=bool)
            for k in range(length):
                code = (code << np.uint32(8)) | data[k : n - length + 1 + k]
                empty &= blank[k : n - length + 1 + k]
            code = code * np.uint32(0x9E3779B1) ^ np.uint32(length * 0x7F4A7C15 & 0xFFFFFFFF)
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77)
            found = (code >> np.uint32(32 - 14)).astype(np.int32)
            found[empty] = BUCKETS
            bucket[: n - length + 1] = found
        for edge in range(1, length):  # not across the end of a text
            at = texts.bounds[1:] - edge
            bucket[at[(at >= texts.bounds[:-1]) & (at < n)]] = BUCKETS
        yield bucket


def _row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, bounds[some], dtype=np.float64)
    return out


def _has_letter(texts: T.Texts) -> np.ndarray:
    kind = _CLASS[texts.data]
    letter = _row_sums(((kind >= 97) & (kind < 123)).astype(np.uint8), texts.bounds) > 0
    for i in np.flatnonzero(~letter & (_row_sums((kind >= 128).astype(np.uint8), texts.bounds) > 0)):
        raw = texts.data[texts.bounds[i] : texts.bounds[i + 1]].tobytes().decode("utf-8", "replace")
        letter[i] = any(c.isalpha() for c in raw)
    return letter


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (languages, BUCKETS + 1): what a subword adds to each language
    bias: np.ndarray
    temperature: float
    threshold: float

    def score(self, texts: T.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, calibrated probability, rejected) of each text."""
        logits = np.zeros((len(self.languages), len(texts)))
        count = np.zeros(len(texts))
        for bucket in subwords(texts):
            count += _row_sums((bucket < BUCKETS).astype(np.uint8), texts.bounds)
            for i, row in enumerate(self.table):
                logits[i] += _row_sums(row[bucket], texts.bounds)
        logits = (logits / np.maximum(count, 1) + self.bias[:, None]) / self.temperature
        odds = np.exp(logits - logits.max(axis=0))
        odds /= odds.sum(axis=0)
        best, letter = odds.argmax(axis=0), _has_letter(texts)
        score = np.where(letter, np.clip(odds.max(axis=0), 0, 1), 0.0)
        return np.where(letter, best, -1), score, ~letter | (score < self.threshold)


def held_out(parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def _features(docs: DataFrame) -> DataFrame:
    """(lang, buckets, shares): each text's subword shares, sparse."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch.column(1)):
                found = [np.array([], np.int64)] * len(part)
                for bucket in subwords(part):
                    found = [np.concatenate([f, bucket[a:b]]) for f, a, b in zip(found, part.bounds[:-1], part.bounds[1:], strict=True)]
                made = [np.unique(f[f < BUCKETS], return_counts=True) for f in found]
                n = np.array([len(b) for b, _ in made])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part.at : part.at + len(part)],
                    T.lists(np.concatenate([b for b, _ in made]).astype(np.int32), n),
                    T.lists(np.concatenate([c / max(c.sum(), 1) for _, c in made]).astype(np.float32), n),
                ], names=["lang", "buckets", "shares"])

    return docs.mapInArrow(run, "lang string, buckets array<int>, shares array<float>")


def rejection_threshold(right: np.ndarray) -> float:
    """The score below which REJECT_SHARE of right predictions lie. The least of fewer than FEW scores would
    reject more than one in a hundred, so there it is carried on by their log-odds' mean and deviation."""
    if not len(right):
        return 0.0
    found = float(np.quantile(right, REJECT_SHARE))
    if len(right) < FEW:
        sure = np.clip(right, 1e-9, 1 - 1e-9)
        odds = np.log(sure / (1 - sure))
        low = odds.mean() + NormalDist().inv_cdf(REJECT_SHARE) * odds.std()
        found = min(found, float(1 / (1 + np.exp(-low))))
    return found


def train(labelled: DataFrame, *, per_language: int = PER_LANGUAGE, seed: int = 1) -> Model | None:
    """Learn from (doc_id, text, lang); rows without a language or a text are passed over."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("hash", F.xxhash64(F.lit(seed), "text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.01).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return None
    # About per_language different texts of each, whatever their ids: those whose hash lies below the cut.
    cuts = F.create_map(*(F.lit(v) for x, n in counts.items() for v in (x, min(1 << 30, -(-(per_language << 30) // max(n, 1))))))
    picked = rows.filter(F.pmod("hash", F.lit(1 << 30)) < F.try_element_at(cuts, F.col("lang"))).dropDuplicates(["lang", "hash"])
    got = _features(picked.select("lang", "text")).toArrow()
    y = np.array([languages.index(x) for x in got.column("lang").to_pylist()])
    buckets = got.column("buckets").combine_chunks()
    bounds, flat = buckets.offsets.to_numpy(), buckets.values.to_numpy()
    shares = got.column("shares").combine_chunks().values.to_numpy()
    order = np.lexsort((np.add.reduceat(np.append(flat, 0), bounds[:-1]), y))  # not the order of arrival
    rng = np.random.default_rng(seed)
    rng.shuffle(order)
    kept, aside = order[len(order) // 5 :], order[: len(order) // 5]

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for i, r in enumerate(rows):
            x[i, flat[bounds[r] : bounds[r + 1]]] = shares[bounds[r] : bounds[r + 1]]
        return x

    k = len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIMENSIONS, k)).astype(np.float32), np.zeros(k, dtype=np.float32)
    step, steps = 0, EPOCHS * -(-max(len(kept), 1) // 32)
    for _ in range(EPOCHS):
        rng.shuffle(kept)
        for at in range(0, len(kept), 32):
            batch = kept[at : at + 32]
            x, rate = dense(batch), RATE * (1 - step / steps)
            hidden = x @ embed
            odds = hidden @ soft + bias
            odds = np.exp(odds - odds.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            odds[np.arange(len(batch)), y[batch]] -= 1
            odds /= len(batch)
            back = odds @ soft.T
            soft -= rate * (hidden.T @ odds)
            bias -= 0.1 * rate * odds.sum(axis=0)
            embed -= rate * 20 * (x.T @ back)
            step += 1
    table = embed @ soft
    logits = np.concatenate([dense(aside[i : i + 256]) @ table for i in range(0, len(aside), 256)] or [np.zeros((0, k))]) + bias

    def calibrated(t: float) -> np.ndarray:
        z = logits / t
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    own = y[aside]
    loss = lambda t: -np.log(np.maximum(calibrated(t)[np.arange(len(own)), own], 1e-12)).mean()
    temperature = min(np.geomspace(0.1, 10, 41), key=loss) if len(own) else 1.0
    odds = calibrated(temperature) if len(own) else np.ones((1, 1))
    right = odds.max(axis=1)[odds.argmax(axis=1) == own] if len(own) else np.ones(1)
    threshold = rejection_threshold(right)
    padded = np.zeros((k, BUCKETS + 1), dtype=np.float32)
    padded[:, :-1] = table.T
    return Model(languages, padded, bias.astype(float), float(temperature), threshold)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every whole text, and the columns `keep` of its row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch.column(1)):
                if model is None:
                    best, score, out = np.full(len(part), -1), np.zeros(len(part)), np.ones(len(part), bool)
                else:
                    best, score, out = model.score(part)
                names = [UNKNOWN if b < 0 else model.languages[b] for b in best]
                own = slice(part.at, part.at + len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[own], pa.array(names, pa.string()), pa.array(score), pa.array(out),
                     *(c[own] for c in batch.columns[2:])],
                    names=["doc_id", "lang_pred", "score", "rejected", *keep])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *keep)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean" + kinds)


def identify(docs: DataFrame, *, parts: int = 4, part: int = 2, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned from the rows that are not held out."""
    ship(docs.sparkSession)
    model = train(docs.filter(~held_out(parts, part)), **options)
    return predict(docs, model).select("doc_id", held_out(parts, part).alias("held_out"), "lang_pred", "score", "rejected")
