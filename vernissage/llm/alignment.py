"""Alignment of two tokenizers' tokens over whole texts, and how the corpus links their ids.

Both tokenizers cut the same bytes, a space and the text. For each, a dictionary leads from the byte
offset where a token ends to its index; the offsets in both dictionaries, sorted, slice both id lists
into groups, the shortest stretches that both cut out of the text. Inside a slice no two ends are equal,
so each stretch between neighbouring ends of either side is the overlap of one token of each: a link.

How many documents hold a pair of ids linked is counted over the whole corpus: sums inside tasks first,
then one row a pair. Pairs of at least `tau` documents, tau being the least power of two for which no
more than `MOST_FREQUENT` pairs remain, are sent to the tasks, as is the highest count of each id (no
more than the vocabulary); rarer ones, by then in few documents each, are joined by pair. Both give the
same sums. Texts are encoded once; what later steps need of them is a table in the shared folder.

The byte-level vocabulary is applied by its ranks, which gives the ids its own library gives. Both
vocabulary files are read by the driver and sent to the tasks, so workers need no copy.

Defined cases: a null or empty text, and one whose bytes either tokenizer does not give back (such as
one that holds the other's word mark), has no tokens: zeros and an empty digest; strings of special
tokens are plain text; repeated rows and ids are counted and returned each; a null id is kept; extra
columns are ignored."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm.store import Store

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the pattern that parts text before the byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"
MOST_FREQUENT = 1 << 20
CHUNK = 1 << 20
HELD = 1 << 21


@dataclass(frozen=True)
class Vocabularies:
    """What a worker needs to build both tokenizers: token bytes by id, and the piece model's bytes."""

    ours: tuple[bytes, ...]
    theirs: tuple[bytes, ...]
    piece_model: bytes


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 bytes are their own
    letter, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabularies(byte_path: str = BYTE_VOCABULARY, piece_path: str = PIECE_VOCABULARY) -> Vocabularies:
    import sentencepiece

    with open(byte_path, encoding="utf-8") as file:
        stored = json.load(file)
    special = {t["content"] for t in stored.get("added_tokens", ()) if t.get("special")}
    letters = _byte_letters()
    ours = [b""] * (max(stored["model"]["vocab"].values()) + 1)
    for token, k in stored["model"]["vocab"].items():
        if token not in special:
            ours[k] = bytes(letters[c] for c in token)
    with open(piece_path, "rb") as file:
        proto = file.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    theirs = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        theirs.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(k) else
                      b"" if model.is_control(k) else piece.replace(MARK, " ").encode())
    return Vocabularies(tuple(ours), tuple(theirs), proto)


class Aligner:
    """Both tokenizers of a worker, and lookups by id."""

    def __init__(self, known: Vocabularies) -> None:
        import sentencepiece
        import tiktoken

        self.known = known
        self.byte = tiktoken.Encoding(
            "byte", pat_str=PATTERN, mergeable_ranks={t: k for k, t in enumerate(known.ours) if t}, special_tokens={})
        self.piece = sentencepiece.SentencePieceProcessor(model_proto=known.piece_model)
        self.our_length, self.their_length = (np.array([len(t) for t in side]) for side in (known.ours, known.theirs))
        most = max(len(known.ours), len(known.theirs))
        written = [str(k).encode() for k in range(most)]
        self.width = np.array([len(w) for w in written])
        self.digits = np.frombuffer(b"".join(w.ljust(len(written[-1]) + 1) for w in written), np.uint8).reshape(most, -1)

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """The ids of both sides; none unless both give back a space and the text."""
        if not text:
            return [], []
        ours, theirs = self.byte.encode_ordinary(" " + text), self.piece.encode(text)
        raw = (" " + text).encode()
        for ids, side in ((ours, self.known.ours), (theirs, self.known.theirs)):
            if b"".join(map(side.__getitem__, ids)) != raw:
                return [], []
        return ours, theirs

    def align(self, texts: list[str | None]) -> Aligned:
        """Groups and links of some texts at once; positions count on from text to text."""
        n_a, n_b, ids_a, ids_b, cut_a, cut_b, ends_a, ends_b = ([] for _ in range(8))
        at_a = at_b = at = 0
        n_groups = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            ours, theirs = self.encode(text)
            n_a.append(len(ours))
            n_b.append(len(theirs))
            if not ours:
                continue
            a, b = np.array(ours, dtype=np.int64), np.array(theirs, dtype=np.int64)
            end_a, end_b = np.cumsum(self.our_length[a]), np.cumsum(self.their_length[b])
            index_a = dict(zip(end_a.tolist(), range(1, len(a) + 1)))
            index_b = dict(zip(end_b.tolist(), range(1, len(b) + 1)))
            common = sorted(index_a.keys() & index_b.keys())
            n_groups[k] = len(common)
            cut_a.append(np.fromiter(map(index_a.__getitem__, common), np.int64, len(common)) + at_a)
            cut_b.append(np.fromiter(map(index_b.__getitem__, common), np.int64, len(common)) + at_b)
            ids_a.append(a)
            ids_b.append(b)
            ends_a.append(end_a + at)
            ends_b.append(end_b + at)
            at_a, at_b, at = at_a + len(a), at_b + len(b), at + int(end_a[-1])
        joined = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids_a, ids_b, cut_a, cut_b, ends_a, ends_b)]
        return Aligned(np.array(n_a), np.array(n_b), n_groups, *joined, at)


@dataclass
class Aligned:
    n_a: np.ndarray  # tokens of each text
    n_b: np.ndarray
    n_groups: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    cut_a: np.ndarray  # index behind each group's last token
    cut_b: np.ndarray
    ends_a: np.ndarray  # byte behind each token
    ends_b: np.ndarray
    n_bytes: int

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, A token, B token) of every link: one for each end of either side."""
        is_a, is_b = np.zeros(self.n_bytes + 1, np.uint8), np.zeros(self.n_bytes + 1, np.uint8)
        is_a[self.ends_a] = is_b[self.ends_b] = 1
        ends = np.flatnonzero(is_a | is_b)
        a, b = ((np.cumsum(x[ends], dtype=np.int64) - x[ends]) for x in (is_a, is_b))
        text = np.repeat(np.arange(len(self.n_a)), self.n_a)
        return text[a], a, b

    def written(self, aligner: Aligner) -> list[str]:
        """The digest of each text's groups, `a1,a2|b1;a3|b2,b3`."""
        size_a, size_b = np.diff(self.cut_a, prepend=0), np.diff(self.cut_b, prepend=0)
        place_a = np.arange(len(self.ids_a)) + np.repeat(self.cut_b - size_b, size_a)
        place_b = np.arange(len(self.ids_b)) + np.repeat(self.cut_a, size_b)
        ids = np.empty(len(self.ids_a) + len(self.ids_b), dtype=np.int64)
        sign = np.full(len(ids), ord(","), dtype=np.uint8)
        ids[place_a], ids[place_b] = self.ids_a, self.ids_b
        sign[place_a[self.cut_a - 1]] = ord("|")
        sign[place_b[self.cut_b - 1]] = ord(";")
        width = aligner.width[ids]
        cells = aligner.digits[ids]
        cells[np.arange(len(ids)), width] = sign
        flat = cells[np.arange(cells.shape[1]) <= width[:, None]].tobytes()
        till = np.append(0, np.cumsum(width + 1))[np.append(0, np.cumsum(self.n_a + self.n_b))]
        return [hashlib.sha256(flat[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(till[:-1].tolist(), till[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def _aligner(known: Vocabularies) -> Aligner:
    return Aligner(known)


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Rows of about CHUNK characters at a time, with the index of the first."""
    texts, at, size = [], 0, 0
    for k, text in enumerate(column.to_pylist()):
        texts.append(text)
        size += len(text or "")
        if size >= CHUNK:
            yield at, texts
            texts, at, size = [], k + 1, 0
    if texts:
        yield at, texts


def _lists(values: np.ndarray, text: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def alignments(docs: DataFrame, known: Vocabularies) -> DataFrame:
    """One row for each of `docs` (doc_id, text): its digest columns and, in `pairs` and `times`, the
    distinct pairs of linked ids (A id times the size of B, plus B id) and how often each is linked."""
    wide = pa.int32() if len(known.ours) * len(known.theirs) < 1 << 31 else pa.int64()
    sent = docs.sparkSession.sparkContext.broadcast(known)
    n_ours, n_theirs = len(known.ours), len(known.theirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(sent.value)
        for batch in batches:
            for at, texts in _chunks(batch.column(2)):
                n = len(texts)
                got = aligner.align(texts)
                text, a, b = got.links()
                # A chunk has few enough texts for text and pair to be one number.
                both = np.sort(text * (n_ours * n_theirs) + got.ids_a[a] * n_theirs + got.ids_b[b])
                first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
                text_of, pair = np.divmod(both[first], n_ours * n_theirs)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[at : at + n], batch.column(1)[at : at + n],
                    pa.array(got.n_a), pa.array(got.n_b), pa.array(got.n_groups),
                    pa.array(np.bincount(text, minlength=n).astype(np.int64)), pa.array(got.written(aligner)),
                    _lists(pair, text_of, n, wide), _lists(np.diff(np.append(first, len(both))), text_of, n, pa.int32()),
                ], names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = "int" if wide == pa.int32() else "long"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        f"pairs array<{kind}>, times array<int>")


def _pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n): in how many rows each pair is. A task sums what it has read before it sends rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            value, n = np.unique(flat, return_counts=True)
            together = np.concatenate([held, value])
            order = np.argsort(together, kind="stable")
            together, n = together[order], np.concatenate([counts, n])[order]
            first = np.flatnonzero(np.append(True, together[1:] != together[:-1])[: len(together)])
            held, counts = together[first], np.add.reduceat(n, first) if len(first) else n
            if len(held) > HELD:
                yield from sent(held, counts)
                held, counts = held[:0], counts[:0]
        yield from sent(held, counts)

    def sent(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(pairs), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[k : k + (1 << 16)], pa.int64()), pa.array(n[k : k + (1 << 16)], pa.int64())], names=["pair", "n"])

    return made.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most `most` pairs have that count or more."""
    bins = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bin")).count().collect())
    room, tau = most, 1 << 62
    for bin in sorted(bins, reverse=True):
        room -= bins[bin]
        if room < 0:
            break
        tau = 1 << bin
    return 1 if room >= 0 else tau


def linked_tokens(
    docs: DataFrame, *, byte_path: str = BYTE_VOCABULARY, piece_path: str = PIECE_VOCABULARY,
    most_frequent: int = MOST_FREQUENT, store: Store | None = None,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of `docs`."""
    store = store or Store(docs.sparkSession)
    context = store.spark.sparkContext
    known = vocabularies(byte_path, piece_path)
    n_theirs = len(known.theirs)
    made = store.put(alignments(docs, known), "aligned")
    counts = store.put(_pair_counts(made), "counts")
    highest = counts.groupBy(F.expr(f"pair div {n_theirs}").cast("int").alias("a")).agg(F.max("n").alias("most"))
    top = np.zeros(len(known.ours), dtype=np.int64)
    got = highest.toArrow()  # one row an A id at most
    top[got.column("a").to_numpy()] = got.column("most").to_numpy()
    tau = _least_count(counts, most_frequent)
    got = counts.filter(F.col("n") >= tau).sort("pair").toArrow()
    sent = context.broadcast((top, got.column("pair").to_numpy(), got.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, pairs, n = sent.value
        for batch in batches:
            lists, rows = batch.column(7), batch.num_rows
            pair = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            times = batch.column(8).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            at = np.searchsorted(pairs, pair)
            at[at == len(pairs)] = 0
            have = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            count = n[at[have]]
            add = lambda value: pa.array(np.bincount(text[have], weights=value, minlength=rows).astype(np.int64))
            best = np.where(count == top[pair[have] // n_theirs], times[have], 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], add(best), add(count * times[have]),
                 _lists(pair[~have], text[~have], rows, pa.int64()), _lists(times[~have], text[~have], rows, pa.int64())],
                names=[*batch.schema.names[:7], "n_best", "count_sum", "pairs", "times"])

    scored = made.mapInArrow(
        run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "n_best long, count_sum long, pairs array<long>, times array<long>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    if tau == 1:
        return scored.select(*columns, "n_best", "count_sum", "groups_sha256")
    scored = store.put(scored, "scored")
    rare = scored.filter("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    rare = rare.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    best = counts.withColumn("a", F.expr(f"pair div {n_theirs}").cast("int")).join(highest, "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    more = rare.join(best.filter(F.col("n") < tau), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    return scored.join(more, "row", "left").select(
        *columns, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
