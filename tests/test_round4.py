"""What the fourth review found, each on small rows of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage.operators import matching, nearby


def test_distances_are_found_once_a_spot(spark):
    """Many centres of one circle and many points of one spot, equal rows among them: they meet as a few rows,
    none of which holds many, and every pair is returned."""
    points = spark.createDataFrame(
        [(i % 300, 41.5, 2.0) for i in range(600)] + [(900, 41.5, 2.0)] * 200 + [(901, 41.6, 2.0), (902, None, 2.0)], "pid long, lat double, lon double")
    centers = spark.createDataFrame([(i, 41.5, 2.001, 500.0) for i in range(300)] + [(0, 41.5, 2.001, 500.0), (999, 41.5, 2.001, -1.0)],
                                    "cid long, lat double, lon double, radius_m double")
    leaves, spots = index = nearby.indexed(points, 128)
    held = [r.n for r in spots.select(F.size("_rows").alias("n")).collect()]
    assert sum(held) == 801 and len(held) <= 8 and max(held) <= 256
    for known in (None, index):
        found = nearby.within_radius(centers, points, small=128, index=known, shown=lambda m: F.round(m, 1))
        assert found.columns == ["cid", "radius_m", "pid", "metres"]
        per = {tuple(r) for r in found.groupBy("cid", "metres").count().collect()}
        assert per == {(i, 83.5, 800) for i in range(300)}
        assert found.filter("cid = 7 AND pid = 900").count() == 200


def test_every_candidate_of_an_undecided_term_is_found(spark):
    """The reference lists the candidates of an ambiguous term; keys and claims together say the same."""
    kind = "id long, name string, slug string"
    terms = [(1, "Casa Blava & Sala Nord", "t1"), (2, "Sala Nord", "t2"), (3, "Casa Blava", "both-2"), (4, "Sala Nord Casa Blava", "t4"), (5, "Alone", "x5"),
             (6, "Alone with Art", "x6"), (7, None, ""), (8, "the Alone space", None)]
    profiles = [(10, "Casa Blava", "p10"), (11, "Sala Nord", "p11"), (12, "SALA NÒRD", "p12"), (13, "Art", "both"), (14, "q", "both-1"), (15, "Alone", "x5"), (16, "", "")]
    term_rows, profile_rows = spark.createDataFrame(terms, kind), spark.createDataFrame(profiles, kind)
    matches, ambiguous = matching.match_profiles(term_rows, profile_rows)
    assert {tuple(r) for r in matches.collect()} == {(5, 15, "slug"), (6, 15, "contains"), (8, 15, "contains")}
    keys, claims = matching.ambiguous_keys(term_rows, profile_rows), matching.ambiguous_claims(term_rows, profile_rows)
    found = keys.join(claims, ["round", "key"]).groupBy("term_id", "round").agg(F.sort_array(F.collect_list("profile_id")).alias("ids"))
    lists = {(r.term_id, r.round): r.ids for r in found.collect()}
    assert lists == {(1, "contains"): [10, 11, 12], (2, "name"): [11, 12], (3, "base-slug"): [13, 14], (4, "contains"): [10, 11, 12]}
    assert {(r.term_id, r.round): r.candidates for r in ambiguous.collect()} == {k: len(v) for k, v in lists.items()}
