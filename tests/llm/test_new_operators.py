"""Token alignment, importance resampling and the LSH forest against plain rules, with their defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from test_text_operators import lower, made, shingles

from vernissage.llm import alignment, jaccard, lsh_forest, resample
from vernissage.llm.queries import shingle_components


def odd_texts():
    rng = random.Random(11)
    bits = [" ", "  ", "\n", "\t", "the ", "The", "'ll", "12", "é", "ß", "中文", "😀", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\x00",
            " ", "　", "​", "é", "...", "__", "Zürich", "\r\n", "\x85", "ſ", "İ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(120)]


def plain_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(alignment.BYTE_VOCABULARY)
    byte.encode_special_tokens = True
    piece = SentencePieceProcessor(model_file=alignment.PIECE_VOCABULARY)
    known = alignment.vocabularies()
    found = []
    for _, text in rows:
        raw = (" " + (text or "")).encode()
        a = byte.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        if text and (b"".join(known.ours[i] for i in a) != raw or b"".join(known.theirs[i] for i in b) != raw):
            a, b = [], []
        ends = []
        for ids, side in ((a, known.ours), (b, known.theirs)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(side[i])))
                at += len(side[i])
            ends.append(own)
        links = [(x, y) for x, (i, j) in zip(a, ends[0]) for y, (k, m) in zip(b, ends[1]) if i < m and k < j]
        cuts = sorted({j for _, j in ends[0]} & {j for _, j in ends[1]})
        groups, last = [], 0
        for c in cuts:
            part = ["" .join(",".join(str(t) for t, (i, j) in zip(ids, own) if last <= i and j <= c)) for ids, own in ((a, ends[0]), (b, ends[1]))]
            groups.append("|".join(part))
            last = c
        found.append((a, b, links, groups))
    counts = collections.Counter(p for _, _, links, _ in found for p in set(links))
    top = collections.defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [(doc_id, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "") for (doc_id, _), (a, b, links, groups) in zip(rows, found)]


def text_key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize(("most", "chunk"), [(1 << 20, 1 << 20), (64, 500), (0, 1)])
def test_alignment(corpus, monkeypatch, most, chunk):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    rows = [(i, t) for i, t in enumerate(odd_texts())] + made(5, 12) + [(905, "Ab " * 2000), (906, "▁a b"), (907, "x" * 5000)]
    got = [tuple(r) for r in alignment.linked_tokens(corpus(rows), most_frequent=most).collect()]
    assert sorted(got, key=text_key) == sorted(plain_alignment(rows), key=text_key)
    assert sum(r[1] == 0 for r in got) >= 4 and any(r[3] < min(r[1], r[2]) for r in got)


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_resample(rows, target, least, percent):
    def buckets(text):
        w = WORD.findall(lower(text))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    made_rows = [(i, *buckets(t)) for i, t in rows]
    s, t = collections.Counter(b for _, _, f in made_rows for b in f), collections.Counter(b for x in target for b in buckets(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in made_rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0, k) for k, r in enumerate(out) if r[1] >= least)
    rank = {k: at + 1 for at, (*_, k) in enumerate(able[: percent * len(able) // 100])}
    return [(*r, rank.get(k)) for k, r in enumerate(out)]


@pytest.mark.parametrize("percent", [25, 100])
def test_resample(spark, corpus, percent):
    rows = [(i, t) for i, t in made(8, 160) if i is not None] + [(None, "a-b_C 7é " * 30), (950, "Q'x 1.5 n ﬁ " * 9)]
    target = [t for i, t in made(8, 6)][:6] + [None, ""]
    got = resample.resample(corpus(rows), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent).collect()
    want = plain_resample(rows, target, 20, percent)
    # Rows that are equal in id and score may take either's rank.
    assert sorted((tuple(r) for r in got), key=text_key) == sorted(want, key=text_key)
    assert any(r[5] for r in want)


def links(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) * 100 >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i)) if s else k, k == (least.get(find(i)) if s else k)) for i, ((k, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize(("crowd", "near"), [(64, 4), (2, 1)])
def test_lsh_forest(corpus, crowd, near):
    rows = made(3, 90) + [(7, "a b c"), (7, "d e f g h i j k"), (None, made(3)[0][1])]
    got = [tuple(r) for r in lsh_forest.near_duplicates(corpus(rows), crowd=crowd, near=near).collect()]
    assert sorted(got, key=text_key) == sorted(links(rows, 5, 85), key=text_key)
    assert sum(not r[3] for r in got) > 5


def test_lsh_forest_keeps_a_family_together(corpus):
    """Copies that are each near their original and not near each other, one of them with a null id."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(1000, " ".join(base))]
    for k in range(150):
        text = list(base)
        for at in rng.sample(range(0, 400, 6), 5):
            text[at] = f"x{k}y{at}"
        rows.append((None if k == 3 else k, " ".join(text)))
    got = lsh_forest.near_duplicates(corpus(rows), crowd=8).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


@pytest.mark.parametrize(("n", "percent", "costly"), [(3, 90, 8), (5, 80, 8), (2, 60, 1)])
def test_jaccard_join_with_null_and_repeated_ids(corpus, n, percent, costly):
    """Also a family of copies of which few are linked: they share segments and no rare shingle."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = made(3, 60) + [(7, "a b c"), (7, "d e f g h i j k"), (None, made(3)[0][1]), (None, "n o p q r s"), (None, "n o p q r s")]
    for k in range(60):
        text = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 8])):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append((None if k % 9 == 4 else 2000 + k, " ".join(text)))
    got = [tuple(r) for r in jaccard.jaccard_components(corpus(rows), n_words=n, percent=percent, costly=costly).select(
        "doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=text_key) == sorted((r[:3] for r in links(rows, n, percent)), key=text_key)
    if percent == 90:
        assert len({c for i, _, c in got if i is not None and i >= 2000}) > 5


def test_recall_against_the_exact_join(spark, corpus):
    """Pairs just above the threshold among much that is alike: at least 99 of 100 are found."""
    rng = random.Random(9)
    rows = []
    for k in range(300):
        line = [f"c{j}" for j in range(90)]
        own = [f"w{rng.randrange(10**6)}" for _ in range(210)]
        other = list(own)
        for at in rng.sample(range(0, 210, 7), 3):
            other[at] = f"y{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(line + own)), (2 * k + 1, " ".join(line + other))]
    docs = corpus(rows)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs).collect()}
    want = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, percent=85).collect()}
    linked = [k for k in want if want[k] != k]
    assert len(linked) > 100 and sum(got[k] == want[k] for k in linked) >= 0.99 * len(linked)


def test_nothing(spark, corpus):
    none = corpus([(1, "x")]).filter("doc_id < 0")
    assert alignment.linked_tokens(none).count() == resample.resample(none, none).count() == lsh_forest.near_duplicates(none).count() == 0


def test_components_in_sql(corpus):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, t) for i, t in {i: t for i, t in made(3, 60) if i is not None}.items()]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = con.execute(shingle_components(5, 85)).fetchall()
    assert sorted(got) == sorted((k, n, c) for k, n, c, _ in links(rows, 5, 85))


def test_regions_are_followed_while_shared(spark):
    rng = random.Random(4)
    rows, depths = [], len(lsh_forest.DEPTHS)
    for cls in range(300):
        steps = [rng.randrange(3) for _ in range(depths)]
        rows.append((cls, rng.randrange(50), [hash(tuple(steps[: k + 1])) for k in range(depths)], steps[0] > 0))
    members = collections.defaultdict(list)
    for cls, popular, path, crowded in rows:
        for p in path if crowded else path[:1]:
            members[p].append((popular, cls))
    want = collections.Counter((max(x)[1], cls) for x in members.values() if len(x) > 1 for _, cls in x if cls != max(x)[1])
    written = []

    class Spy(lsh_forest.Store):
        def put(self, df, name):
            out = super().put(df, name)
            written.append((name, out.count()))
            return out

    star = lsh_forest._hubs(spark.createDataFrame(rows, "cls long, popular long, path array<long>, crowded boolean"), Spy(spark))
    assert {(r.a, r.b): r.times for r in star.collect()} == want
    assert sum(n for name, n in written if name.startswith("regions")) == sum(len(x) for x in members.values() if len(x) > 1)
