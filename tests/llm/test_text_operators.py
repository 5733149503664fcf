"""Operators on documents against brute force on small tables, with their defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from vernissage.llm import chaining, decontaminate, jaccard, langid, lm, mixing, suffix_dedup
from vernissage.llm import tokens as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(900, None), (901, ""), (902, " \t\n "), (903, "x"), (None, None), (None, "one two three four five six seven"), (904, "a" * 3000), (904, "a" * 3000), (905, "Ab " * 2000)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def made(seed, n=70, vocabulary=40):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(20, 120))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            k = rng.randrange(len(text))
            text[k : k + rng.randint(0, 2)] = [rng.choice(vocab) for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.3:
            text = text[: rng.randint(1, len(text))] + [rng.choice(vocab) for _ in range(30)]
        rows.append((i, " ".join(text)))
    return rows + EDGE


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "percent", "costly"), [(3, 90, 64), (5, 80, 64), (2, 60, 1)])
def test_jaccard_components(corpus, n, percent, costly):
    rows = [(i, t) for i, t in made(3) if i is not None]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(corpus(rows), n_words=n, percent=percent, costly=costly).collect())
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and len(a & b) * 100 >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == sorted((i, len(s), find(i)) for i, s in sets)
    assert any(c != i for i, _, c in got)


def test_empty_table(spark, corpus):
    none = corpus([(1, "x")]).filter("doc_id < 0")
    assert jaccard.jaccard_components(none).count() == 0
    assert suffix_dedup.removed(none).count() == 0
    assert langid.identify(none).count() == 0
    assert lm.scores(none).count() == 0
    assert mixing.mixed_counts(none).count() == 0
    assert chaining.fuzzy_passages(none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


@pytest.mark.parametrize(("length", "anchor", "hot"), [(30, 8, 500), (30, 8, 2), (47, 16, 1)])
def test_removed(corpus, length, anchor, hot):
    rows = [(i, (t or "")[:400] if t is not None else None) for i, t in made(5, 50)] + [(7, "x\x00y" * 30), (8, "ab" * 100)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed(
        corpus(rows), length=length, anchor=anchor, hot=hot).collect()), key=str)
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                mark[k : k + length] = True
        mark = mark[: len(b)]
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = int((np.diff(np.append(False, mark).astype(int)) == 1).sum())
        want.append((i, len(b), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(w[2] for w in want) > 0


def test_common_prefix_groups_are_those_of_sorted_rotations():
    rng = random.Random(1)
    for _ in range(20):
        x = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 120))) + b"\x00", np.uint8)
        order, group = suffix_dedup.common_prefix_groups(x, 5)
        cut = [bytes(np.roll(x, -i)[:5]) for i in order] if len(x) >= 5 else None
        if cut:
            assert cut == sorted(cut)
            assert [a == b for a, b in zip(cut, cut[1:], strict=False)] == [a == b for a, b in zip(group, group[1:], strict=False)]


def greedy(a, b, least):
    """Greedy string tiling by trying every pair of places, longest first."""
    free_a, free_b, total = [True] * len(a), [True] * len(b), 0
    while True:
        best = (least - 1, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        for k in range(n):
            free_a[i + k] = free_b[j + k] = False
        total += n


@pytest.mark.parametrize("most_seeds", [10**6, 0])
def test_contaminated(spark, corpus, most_seeds):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(3, 25)))) for k in range(12)] + [(50, None), (51, "")]
    rows = list(EDGE)
    for i in range(40):
        own = (rng.choice(items[:12])[1]).split()
        cut = rng.randint(0, len(own))
        rows.append((i, " ".join(["pre"] * rng.randint(0, 3) + own[cut:] + ["Mid,"] + own[:cut])))
    tests = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    got = sorted(((r.doc_id, r.item_id, r.n_covered) for r in decontaminate.contaminated(corpus(rows), tests, min_match=4, most_seeds=most_seeds).collect()), key=str)
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))
    want = []
    for i, t in rows:
        for k, x in items:
            b = split(x)
            n = greedy(split(t)[:200], b, 4) if len(b) >= 4 else 0
            if n and n >= 0.5 * len(b):
                want.append((i, k, n))
    assert got == sorted(want, key=str)
    assert len(want) > 10


def test_language_is_learned_and_rejected(corpus):
    rng = random.Random(4)
    kinds = {"xx": ["salo", "mira", "tolo", "rani"], "yy": ["grunt", "strok", "blimp", "kraft"]}
    rows = [(i, " ".join(rng.choice(kinds[x]) for _ in range(rng.randint(3, 40))), x) for i, x in enumerate(["xx", "yy"] * 60)]
    rows += [(500, None, "xx"), (501, "", None), (502, "12 34 !!", "yy"), (503, "salo mira", None), (None, "blimp kraft", None)]
    got = {r.doc_id: r for r in langid.identify(corpus(rows)).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:120])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (500, 501, 502))
    assert got[503].lang_pred == "xx" and got[None].lang_pred == "yy" and not got[None].held_out
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in range(120))


def test_nothing_to_learn_from(corpus):
    assert [r.lang_pred for r in langid.identify(corpus([(1, "abc", None), (2, None, None)])).collect()] == ["und", "und"]


@pytest.mark.parametrize("most_frequent", [1 << 19, 3])
def test_base_scores(corpus, most_frequent):
    rows = [(i, t) for i, t in made(6) if t is None or len(t) < 2500]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.scores(
        corpus(rows), most_frequent=most_frequent).collect()), key=str)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter()
    for i, t in rows:
        if not held(i):
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        w = [*words(t), None]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(base, 6)))
    assert got == sorted(want, key=str)


def test_lattice_sums_all_segmentations():
    strings = [b"a", b"b", b"ab", b"ba", b"aba", b"bb", lm.MARK, lm.MARK + b"a", lm.MARK + b"ab"]
    pieces = lm.Pieces(strings, np.arange(1.0, len(strings) + 1))
    pieces.weigh(pieces.weight, 5.0)
    chance = {s: (k + 1) / (45 + 5) for k, s in enumerate(strings)}

    def paths(text):
        if not text:
            return [[]]
        return [[s, *rest] for s in strings if text.startswith(s) for rest in paths(text[len(s):])]

    own = [b"a", b"abab", b"bba", b"ababbaab"]
    log, share = pieces.lattice(*lm._marked(own), np.ones(len(own)))
    for w, value in zip(own, log, strict=True):
        assert math.isclose(10**value, sum(math.prod(chance[s] for s in p) for p in paths(lm.MARK + w)), rel_tol=1e-9)
    expected = collections.Counter()
    for w in own:
        ways = [(p, math.prod(chance[s] for s in p)) for p in paths(lm.MARK + w)]
        for p, c in ways:
            for s in p:
                expected[s] += c / sum(c for _, c in ways)
    assert math.isclose(sum(share), sum(expected.values()), rel_tol=1e-9)


def test_mixing_meets_its_targets(corpus):
    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([0, 1, 30, 400]), None, ["b", "a", None, "é", "z"][i % 5]) for i in range(300)] + [(1, None, None, "a"), (3, "w w", None, "a"), (3, "w w", None, "a")]
    got = mixing.mixed_counts(corpus(rows), block_words=16).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, mixing.targets([size[s] for s in order], [3, 1, 2, 3, 1], 1.5, 2), strict=True))
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mixed_counts(corpus(rows), block_words=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_of_small_sources(corpus):
    """Sources smaller than a block beside a hot one, rows without an id: all targets are met to the word."""
    rng = random.Random(2)
    small = {"a": 10, "b": 40, "c": 100, "d": 1, "e": 64, "f": 128, "g": 65, "h": 0}
    rows = [(i, "w " * n, None, s) for i, (s, n) in enumerate(small.items())]
    rows += [(None if i % 7 == 0 else i, "v " * rng.randint(1, 90), None, "z") for i in range(200)]
    got = mixing.mixed_counts(corpus(rows)).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    assert [mixing.slots_of(t, n, 2, 64) for t, n in ((20, 10), (80, 40), (150, 100), (0, 0), (64, 64), (70.4, 1000))] == [
        (2, 64), (2, 64), (3, 50), (0, 0), (1, 64), (2, 6)]


def test_targets_share_what_is_over():
    assert mixing.targets([100, 1000, 1000], [3, 1, 2], 1.5, 2) == [200, pytest.approx(2950 / 3), pytest.approx(5900 / 3)]
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0, 0], [1, 1], 1.5, 2) == [0, 0]


def test_permutation_is_one():
    for n in (1, 2, 7, 100, 1001):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))


def test_fuzzy_passages(corpus):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    passage = [rng.choice(vocab) for _ in range(80)]
    noise = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = [(i, " ".join(noise(100))) for i in range(20)] + list(EDGE)
    changed = [w if k % 12 else "changed" for k, w in enumerate(passage)]
    moved = passage[:40] + ["inserted", "words"] + passage[40:]
    for i, p in ((100, passage), (101, changed), (102, moved), (103, passage[:60])):
        rows.append((i, " ".join([*noise(50), *p, *noise(70)])))
    rows.append((104, " ".join([*noise(30), *passage[:30], *noise(30)])))
    got = {r.doc_id: r for r in chaining.fuzzy_passages(corpus(rows)).collect()}
    for i in (100, 101, 102, 103):
        assert got[i].class_id == 100 and got[i].n_spans == 1 and abs(got[i].spans[0].a - 50) <= 5
    assert got[104].n_spans == 0 and all(got[i].n_spans == 0 and got[i].class_id == i for i in range(20))
    assert got[901].n_words == 0 and got[900].class_id == 900


def test_chain_scores_are_the_best():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randint(1, 9)
        x, y = np.array([rng.randrange(12) for _ in range(n)]), np.array([rng.randrange(12) for _ in range(n)])

        def score(chain, x=x, y=y):
            total = 6.0
            for a, b in zip(chain, chain[1:], strict=False):
                total += 6 - 0.5 * (x[b] - x[a] + y[b] - y[a])
            return total

        best = {}

        def ending(i, x=x, y=y, best=best):
            if i not in best:
                best[i] = 6.0 + max([0.0, *(ending(j) - 0.5 * (x[i] - x[j] + y[i] - y[j]) for j in range(len(x)) if x[j] < x[i] and y[j] < y[i])])
            return best[i]

        first = chaining.chains(x, y, 6, 0.5)[0]
        assert math.isclose(score(first), max(ending(i) for i in range(n)))


def test_word_hashes_do_not_depend_on_where_words_lie():
    import pyarrow as pa

    one = next(T.slices(pa.array(["Alpha beta", None, "beta\nALPHA gamma"])))
    w = T.words(one)
    assert w.first.tolist() == [0, 2, 2, 5] and w.hash[0] == w.hash[3] and w.hash[1] == w.hash[2] and w.hash[4] not in w.hash[:4]


def test_passages_beyond_the_first_hubs(corpus):
    """The first two texts hold only part of what others share, or hold its lines apart."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    noise = lambda n: [word() for _ in range(n)]
    whole = noise(60)
    rows = [(i, " ".join([*noise(30), *whole[:40], *noise(30)])) for i in (1, 2, 3)]
    rows += [(i, " ".join([*noise(30), *whole, *noise(30)])) for i in (4, 5)]
    lines = [noise(12) for _ in range(5)]
    for i in (11, 12, 13):
        rows.append((i, " ".join(w for x in rng.sample(lines, 5) for w in [*x, *noise(40)])))
    rows += [(i, " ".join([*noise(30), *(w for x in lines for w in x), *noise(30)])) for i in (14, 15)]
    got = {r.doc_id: r for r in chaining.fuzzy_passages(corpus(rows).coalesce(1)).collect()}
    assert [got[i].n_spans for i in (1, 2, 3, 11, 12, 13)] == [0] * 6
    for a, b in ((4, 5), (14, 15)):
        assert got[a].class_id == got[b].class_id == a
        assert all([tuple(s) for s in got[i].spans] == [(30, 90)] for i in (a, b))


def test_changed_passages_share_seeds(corpus):
    """Short passages with one word in eight changed, at random places."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for i in range(0, 120, 2):
        passage = [word() for _ in range(60)]
        for k in (0, 1):
            own = [word() if k and 0 < j < 59 and rng.random() < 0.12 else w for j, w in enumerate(passage)]
            rows.append((i + k, " ".join([*(word() for _ in range(60)), *own, *(word() for _ in range(60))])))
    text = dict(rows)
    got = {r.doc_id: r for r in chaining.fuzzy_passages(corpus(rows)).collect()}
    found = 0
    for i in range(0, 120, 2):
        a, b = (words(text[j])[60:120] for j in (i, i + 1))
        if chaining.passages(np.array([x == y for x, y in zip(a, b, strict=True)]), 50, 0.8):
            assert got[i + 1].class_id == i and got[i].n_dup_words >= 50
            found += 1
    assert found > 20


def test_unlearned_language_and_junk_are_rejected(spark):
    rng = random.Random(14)
    kinds = {"aa": "salo mira tolo rani", "bb": "grunt strok blimp kraft", "cc": "hjem fjeld bygd skov", "dd": "pecu nixe duve quae"}
    text = lambda own: " ".join(rng.choice(own) for _ in range(rng.randint(5, 40)))
    rows = [(i, text(kinds[x].split()), x) for i, x in enumerate(list(kinds) * 100)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    junk = [(1000 + i, text(["wyzhek", "zhuwyk", "khezwu", "uzkhyw"])) for i in range(50)]
    junk += [(2000 + i, "".join(rng.choice("bcdfghjklmnpqrstvwxz 019") for _ in range(200))) for i in range(50)]
    got = {r.doc_id: r.rejected for r in langid.predict(spark.createDataFrame([r[:2] for r in rows] + junk, "doc_id long, text string"), model).collect()}
    assert sum(not got[i] for i, _, _ in rows) >= 0.98 * len(rows)
    assert sum(got[i] for i, _ in junk[:50]) >= 45 and sum(got[i] for i, _ in junk[50:]) >= 45


def test_both_ways_judge_items_that_repeat_themselves(spark, corpus):
    again, own = " ".join(["a b c d e"] * 20), " ".join(f"own{i}" for i in range(60))
    tests = spark.createDataFrame([(1, f"{again} {own}"), (1, "another item of the same id"), (None, "f g h i j k"), (2, "f g h i j k"), (2, "f g h i j k")],
                                  "item_id long, text string")
    rows = [(1, again), (None, again), (None, "f g h i j k"), (3, "f g h i j k"), (3, "f g h i j k"), (3, "nothing of the kind is here")]
    got = [sorted((tuple(r) for r in decontaminate.contaminated(corpus(rows), tests, most_seeds=m).collect()), key=str) for m in (10**6, 0)]
    assert got[0] == got[1]
    assert [r[:2] + r[3:4] for r in got[0]].count((None, 1, 100)) == 1 and len(got[0]) == 2 + 3 * 3


@pytest.mark.parametrize(("chunk", "bucket"), [(1 << 17, 1 << 20), (40, 50)])
def test_seeds_are_all_kmers_that_two_texts_hold(spark, corpus, monkeypatch, chunk, bucket):
    monkeypatch.setattr(chaining, "MOST_WORDS", chunk)
    monkeypatch.setattr(chaining, "BUCKET_WORDS", bucket)
    rows = made(17, 40)
    store = chaining.Store(spark)
    full = store.put(chaining._prepared(corpus(rows)), "prepared")
    table = store.put(chaining._chunked(full), "texts")
    met = chaining._met(table, 3, store).collect()
    texts = {r.row: list(r.words) for r in full.collect()}
    held = collections.defaultdict(lambda: collections.defaultdict(list))
    for row, w in texts.items():
        for i in range(len(w) - 2):
            held[tuple(w[i : i + 3])][row].append(i)
    want = {(row, tuple(places), min(of), tuple(of[min(of)])) for of in held.values() if len(of) > 1 for row, places in of.items()}
    assert {(r.row, tuple(sorted(r.places)), r.hub, tuple(sorted(r.x))) for r in met} == want
    assert len({r.seed for r in met}) == sum(len(of) > 1 for of in held.values()) > 100


def test_texts_that_repeat_themselves(corpus):
    rng = random.Random(21)
    noise = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    rows = [(1, "ab " * 1600), (2, " ".join([*noise(60), *["ab"] * 1200, *noise(60)])), (3, "to and fro " * 500),
            (4, " ".join([*noise(70), *("to and fro".split() * 420)])), (5, " ".join(noise(300)))]
    got = {r.doc_id: r for r in chaining.fuzzy_passages(corpus(rows)).collect()}
    assert [got[i].class_id for i in (1, 2, 3, 4, 5)] == [1, 1, 3, 3, 5]
    assert [tuple(s) for s in got[1].spans] == [(0, 1600)] and [tuple(s) for s in got[3].spans] == [(0, 1500)]
    assert [tuple(s) for s in got[2].spans] == [(60, 1260)] and got[5].n_spans == 0
    assert len(got[4].spans) == 1 and got[4].spans[0].b == 1330 and 68 <= got[4].spans[0].a <= 70


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_language_without_ids_is_sampled(corpus, seed):
    rng = random.Random(5)
    kinds = {"xx": ["salo", "mira", "tolo", "rani"], "yy": ["grunt", "strok", "blimp", "kraft"]}
    rows = [(i if x == "xx" else None, " ".join(rng.choice(kinds[x]) for _ in range(rng.randint(3, 40))), x) for i, x in enumerate(["xx", "yy"] * 200)]
    docs = corpus(rows)
    model = langid.train(docs, per_language=20, seed=seed)
    right = langid.predict(docs, model, keep=("lang",)).filter("lang = lang_pred").count()
    assert right >= 396


def test_few_scores_do_not_set_the_rejection():
    rng = np.random.default_rng(5)
    over = lambda n: np.mean([(rng.beta(20, 4, 2000) < langid.rejection_threshold(rng.beta(20, 4, n))).mean() for _ in range(200)])
    assert over(30) < 0.005 and 0.0005 < over(5000) < 0.002
    assert langid.rejection_threshold(np.empty(0)) == 0


def test_slices_are_small_and_change_nothing():
    import pyarrow as pa

    rows = [" ".join(f"w{i}é{j % 97}" for j in range(500)) for i in range(900)] + [None, "", "x" * (3 << 20)]
    column = pa.array(rows)
    parts = list(T.slices(column))
    assert [p.at for p in parts] == np.append(0, np.cumsum([len(p) for p in parts])[:-1]).tolist() and sum(len(p) for p in parts) == len(rows)
    assert all(len(p) == 1 or len(p.data) <= 1 << 20 for p in parts)
    whole = T.words(next(T.slices(column, 1 << 30)))
    assert (np.concatenate([T.words(p).hash for p in parts]) == whole.hash).all()


def test_mixing_starts_no_second_set_of_workers(spark, corpus):
    """Small tables are local ones; tables of Python rows would go through workers of their own."""
    from vernissage.llm.store import Store

    placed, pieces = mixing.mix(corpus([(i, "w " * i, None, "ab"[i % 2]) for i in range(40)]), block_words=4, store=Store(spark))
    for df in (placed, pieces):
        assert "ExistingRDD" not in df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_pairs_without_a_passage_are_left_out():
    """A line of ten words is not enough; whatever has a passage, changed or shifted, stays."""
    import pyarrow as pa

    rng = np.random.default_rng(17)
    a = rng.integers(0, 256, 300)
    pairs, must = [], []
    for case in range(400):
        b = rng.integers(0, 256, 300)
        n = 50 + case % 5
        b[100 : 100 + n] = a[40 : 40 + n]
        gone = rng.choice(n, case % 12, replace=False)
        b[100 + gone] = 256 + rng.integers(0, 256, len(gone))
        pairs.append(b)
        must.append(bool(chaining.passages(a[40 : 40 + n] == b[100 : 100 + n], 50, 0.8)))
    line = rng.integers(0, 256, 300)
    line[5:15] = a[70:80]
    codes = lambda v: np.asarray(v).astype(np.uint8).tobytes()
    texts = pa.array([codes(b) for b in (*pairs, line)], pa.binary())
    hubs = pa.array([codes(a)] * len(texts), pa.binary())
    kept = np.all([chaining.equal_runs(texts, hubs, q) >= chaining.fewest_runs(q, 50, 0.8) for q in chaining.RUNS], axis=0)
    assert sum(must) > 100 and kept[:-1][must].all() and not kept[-1]
    assert chaining.fewest_runs(5, 50, 0.8) == 0
    assert chaining.equal_runs(pa.array([b"", None], pa.binary()), pa.array([None, b"ab"], pa.binary()), 2).tolist() == [0, 0]
