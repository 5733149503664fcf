"""Operators against plain Python over small random tables."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from vernissage.operators import intervals, ordered, shared_text
from vernissage.plans import interactions, scoring
from vernissage.plans.dialogue import named_items

DAY0 = date(2026, 1, 1)


def _run(rng, span=400):
    a, b = sorted(rng.randint(0, span) for _ in range(2))
    first = None if rng.random() < 0.15 else DAY0 + timedelta(a)
    last = None if rng.random() < 0.15 else DAY0 + timedelta(b if rng.random() < 0.9 else max(a - 3, 0))
    return first, last


def _overlap(a, b):
    return (a[0] is None or b[1] is None or a[0] <= b[1]) and (a[1] is None or b[0] is None or a[1] >= b[0])


def test_overlaps(spark):
    rng = random.Random(1)
    probes = [(n, rng.choice("abc"), *_run(rng)) for n in range(300)]
    runs = [(n, rng.choice("abcd"), *_run(rng, 300)) for n in range(60)]
    schema = "id long, k string, first_day date, last_day date"
    p, r = spark.createDataFrame(probes, schema), spark.createDataFrame(runs, schema)
    met = {x.id for x in intervals.with_overlap(p, r.drop("id"), ["k"]).collect()}
    assert met == {a[0] for a in probes if any(a[1] == b[1] and _overlap(a[2:], b[2:]) for b in runs)}

    asked = p.filter("first_day IS NULL OR last_day IS NULL OR first_day <= last_day").select(
        F.col("id").alias("rid"), intervals.first_number(F.col("first_day")).alias("_from"), intervals.last_number(F.col("last_day")).alias("_to"))
    items = r.select(F.col("id").alias("iid"), intervals.first_number(F.col("first_day")).alias("_first"), intervals.last_number(F.col("last_day")).alias("_last"))
    pairs = [(x.rid, x.iid) for x in intervals.overlap_pairs(asked, items).collect()]
    forwards = [a for a in probes if a[2] is None or a[3] is None or a[2] <= a[3]]
    assert sorted(pairs) == sorted((a[0], b[0]) for a in forwards for b in runs if _overlap(a[2:], b[2:]))


def test_match_items(spark):
    rng = random.Random(2)
    words = ["obra", "obra nova", "nova", "prova", "prova u", "u", "gran obra nova"]

    def items(page, n):
        return [(page, o, rng.choice(["exhibition", "event"]), rng.choice(words), DAY0 + timedelta(rng.randint(0, 2))) for o in range(n)]

    labels = [i for page in range(40) for i in items(page, rng.randint(0, 12))] + items(99, 90)
    found = [i for page in range(40) for i in items(page, rng.randint(0, 12))] + items(99, 5)
    schema = "page_id long, ord long, kind string, title string, start date"
    got = {(r.page_id, r.label_ord, r.found_ord) for r in scoring.match_items(
        spark.createDataFrame(labels, schema), spark.createDataFrame(found, schema)).collect()}
    assert scoring.oversized(spark.createDataFrame(labels, schema)).count() == 1

    def contained(a, b):
        short, long = sorted((a, b), key=len)
        return len(short) >= 4 and f" {short} " in f" {long} "

    expected = set()
    for page in [*range(40), 99]:
        mine, left = [x for x in labels if x[0] == page], [x for x in found if x[0] == page]
        for agree in (lambda a, b: a == b, contained):
            rest = []
            for label in mine:
                options = [f for f in left if agree(label[3], f[3])]
                if options:
                    best = max(options, key=lambda f: (f[2] == label[2], f[4] == label[4], -f[1]))
                    left.remove(best)
                    expected.add((page, label[1], best[1]))
                else:
                    rest.append(label)
            mine = rest
    assert got == expected


def _longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def test_shared_runs(spark):
    rng = random.Random(3)
    text = lambda n, k: [rng.choice("abcdefgh"[:k]) * 2 for _ in range(n)]
    source = {n: text(rng.randint(1, 30), 8) for n in range(12)}
    ours = {n: text(rng.randint(1, 60), rng.choice([1, 2, 8])) for n in range(40)}
    for n in range(0, 40, 3):
        ours[n] = ours[n][:5] + source[n % 12] + ours[n][5:]
    frame = lambda d: spark.createDataFrame([(k, ", ".join(v).upper()) for k, v in d.items()], "id long, text string")
    for least in (1, 4, 9):
        got = {(r.ours_id, r.source_id): r.run for r in shared_text.shared_runs(frame(ours), frame(source), min_words=least).collect()}
        assert got == {(i, j): n for i, a in ours.items() for j, b in source.items() if (n := _longest(a, b)) >= least}


def test_sessions(spark):
    rng = random.Random(4)
    rows, moment = [], datetime(2026, 10, 20)
    for _ in range(400):
        moment += timedelta(minutes=rng.choice([1, 20, 359, 360, 361, 700]))
        rows.append((rng.randint(1, 2), moment))
    got = {(r.user_id, r.started_at): r.turns for r in interactions.sessionize(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")).collect()}
    from zoneinfo import ZoneInfo
    local = lambda t: t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo("Europe/Madrid")).date()
    expected, opened, last = {}, {}, {}
    for user, at in rows:
        if user not in last or at - last[user] > timedelta(hours=6) or local(at) != local(opened[user]):
            opened[user] = at
            expected[user, at] = 0
        expected[user, opened[user]] += 1
        last[user] = at
    assert got == expected


def test_remember(spark):
    rng = random.Random(5)
    log = [(rng.randint(1, 3), seq, "area", f"f{seq}", rng.choice([None, *range(max(seq - 6, 1), seq + 2)])) for seq in range(1, 200)]
    schema = "user_id long, seq long, topic string, fact string, replaces long"
    live, dead, refused = defaultdict(dict), {}, {}
    for user, seq, _, _, replaces in log:
        if replaces is None or replaces in live[user]:
            if replaces is not None:
                dead[replaces] = seq
                del live[user][replaces]
            live[user][seq] = True
        else:
            owner = {s: u for u, s, *_ in log}
            was = dead.get(replaces) if owner.get(replaces) == user and replaces not in refused else None
            refused[seq] = ("already replaced", was) if was else ("unknown", None)
    facts, out = interactions.apply_remember(spark.createDataFrame(log, schema))
    assert {r.seq: r.superseded_by for r in facts.collect()} == {
        seq: dead.get(seq) for _, seq, *_ in log if seq not in refused}
    assert {r.seq: (r.reason, r.successor) for r in out.collect()} == refused
    # In two deliveries, told only what the first left.
    first, _ = interactions.apply_remember(spark.createDataFrame(log[:90], schema))
    later, _ = interactions.remember_more(first, spark.createDataFrame(log[90:], schema))
    assert sorted(later.collect()) == sorted(facts.select(*later.columns).collect())


def test_running_and_percentiles(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), n, rng.choice([None, rng.randint(0, 50)])) for n in range(500)]
    df = spark.createDataFrame(rows, "k string, n long, v long")
    got = ordered.running(df, ["k"], "n", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, block=37, before_only=True)
    seen = defaultdict(list)
    expected = {}
    for k, n, v in rows:
        known = [x for x in seen[k] if x is not None]
        expected[n] = (sum(known), max(known, default=None), known[-1] if known else None)
        seen[k].append(v)
    assert {r.n: (r.s, r.m, r.l) for r in got.collect()} == expected
    values = sorted(v for *_, v in rows if v is not None)
    ranked = {r.share: r.v for r in ordered.percentiles(df, [], "v", [0.5, 0.95]).collect()}
    assert ranked == {s: values[max(-(-len(values) * int(s * 100) // 100) - 1, 0)] for s in (0.5, 0.95)}


def test_named_items(spark):
    uses = spark.createDataFrame([
        ("c", "1", (0, 0), "search_events", '{"events": [{"id": "x:1", "title": "Prova U", "distance_km": 2.0}, {"id": "x:2", "title": "Prova U: obra recent"}, {"id": "g:9", "title": "U"}]}', False),
        ("c", "2", (1, 0), "get_events", '{"events": [{"id": "g:3", "title": "Altre", "title_en": "PROVA U"}]}', False),
        ("c", "3", (2, 0), "search_events", "no", True),
    ], "conversation_id string, call_id string, ord struct<position:long,n:int>, name string, result string, is_error boolean")
    replies = spark.createDataFrame([(1, "c", "See prova u obra recent."), (2, "c", "Altre, then Prova U; and prova u obra recent"), (3, "c", "Prova Universal")],
                                    "reply_id long, conversation_id string, text string")
    named, ids = named_items(replies, uses)
    assert [(r.reply_id, r.key, r.distance_km) for r in named.orderBy("reply_id", "rank").collect()] == [
        (1, "prova u obra recent", None), (2, "altre", None), (2, "prova u", 2.0), (2, "prova u obra recent", None)]
    assert {(r.id) for r in ids.filter("key = 'prova u'").collect()} == {"x:1", "g:3"}
