"""Place names to points: what "near" measures from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.geo import distance_m
from vernissage.functions.text import match_key, tokens


def place_names(places: DataFrame, venues: DataFrame) -> DataFrame:
    """One row per name a place (kind, id, name, aliases, within, lat, lon) or a venue (id, name,
    city, lat, lon) answers to. `whole_only` marks a name qualified by where it is. A venue without
    a point is nowhere to measure from."""
    entry = lambda label, whole: F.struct(
        label.alias("label"), F.lit(whole).alias("whole_only"))
    own = F.transform(
        F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))),
        lambda n: entry(n, False),
    )
    qualified = lambda within: F.array(
        entry(F.concat(F.col("name"), F.lit(", "), within), True))
    cols = ("kind", "id", "name", "within", "lat", "lon")
    of_places = places.select(
        *cols, F.explode(F.concat(own, qualified(F.col("within")))).alias("n"))
    of_venues = (
        venues.filter("lat IS NOT NULL AND lon IS NOT NULL")
        .select(F.lit("venue").alias("kind"), "id", "name", F.col("city").alias("within"), "lat", "lon")
        .select(*cols, F.explode(F.concat(
            F.array(entry(F.col("name"), False)), qualified(F.col("within")))).alias("n"))
    )
    return (
        of_places.unionByName(of_venues)
        .select(*cols, match_key(F.col("n.label")).alias("key"), "n.whole_only")
        .filter("key IS NOT NULL")
    )


_ENTITY = ("kind", "id", "name", "within", "lat", "lon")


def resolve_places(asked: DataFrame, names: DataFrame, most: int | None = None) -> DataFrame:
    """For each distinct `asked` name: its place, or the candidates when it could mean several far
    apart. Columns asked, status (place, candidates, unknown), position, name, kind, within,
    qualified, lat, lon; an unknown name is one row of nulls.

    Names equal to what was asked come first. Only when there is none, those that hold every word
    of it, found through its rarest word: the join reads one word's names, not all of them."""
    asked = asked.select("asked").distinct().withColumn("asked_key", match_key(F.col("asked")))
    keys = asked.filter("asked_key <> ''").select("asked_key").distinct()

    equal = keys.join(names, keys.asked_key == names.key).select(
        "asked_key", *_ENTITY, F.lit(0).alias("tier"))

    # Names by token, once per token.
    by_token = names.filter("NOT whole_only").select(
        *_ENTITY, tokens(F.col("key")).alias("name_tokens"),
        F.explode(F.array_distinct(tokens(F.col("key")))).alias("token"),
    )
    frequency = by_token.groupBy("token").agg(F.count("*").alias("names"))
    partial = (
        keys.filter(F.length("asked_key") >= vocab.MIN_CONTAINED_CHARS)
        .join(names.select(F.col("key").alias("asked_key")), "asked_key", "left_anti")
        .select("asked_key", tokens(F.col("asked_key")).alias("asked_tokens"))
    )
    rarest = (
        partial.select("asked_key", "asked_tokens", F.explode("asked_tokens").alias("token"))
        .join(frequency, "token", "left")
        .groupBy("asked_key", "asked_tokens")
        .agg(F.min_by("token", F.coalesce("names", F.lit(0))).alias("token"))
    )
    holding = (
        rarest.join(by_token, "token")
        .filter(F.size(F.array_except("asked_tokens", "name_tokens")) == 0)
        .select("asked_key", *_ENTITY, F.lit(1).alias("tier"))
    )

    # One row per place or venue at its best tier, then the best tier of each name asked.
    entities = (
        equal.unionByName(holding)
        .groupBy("asked_key", *_ENTITY).agg(F.min("tier").alias("tier"))
        .withColumn("rank", F.array_position(
            F.array(*map(F.lit, vocab.RESOLVE_KINDS)), F.col("kind")))
        .withColumn("chars", F.length("name"))
    )
    order = ("tier", "rank", "chars", "name", "kind", "id")
    # One order of the entities of a name gives the first, the best tier (its rows stand in front) and
    # the places; nothing is expanded twice.
    by_rank = Window.partitionBy("asked_key").orderBy(*order)
    ranked = entities.withColumn("position", F.row_number().over(by_rank)).withColumn(
        "first", F.first(F.struct("tier", "lat", "lon")).over(by_rank)).filter("tier = first.tier")
    apart = distance_m(F.col("lat"), F.col("lon"), F.col("first.lat"), F.col("first.lon"))
    listed = ranked.withColumn(
        "one_spot", F.bool_and(apart <= vocab.MERGE_RADIUS_M).over(Window.partitionBy("asked_key"))
    ).filter("NOT one_spot OR position = 1")
    if most is not None:
        listed = listed.filter(F.col("position") <= most)
    return asked.join(listed, "asked_key", "left").select(
        "asked",
        F.when(F.col("position").isNull(), "unknown").when(F.col("one_spot"), "place")
        .otherwise("candidates").alias("status"),
        F.col("position").cast("long").alias("position"),
        "name", "kind", "within",
        F.when(F.col("within").isNotNull(), F.concat("name", F.lit(", "), "within"))
        .otherwise(F.col("name")).alias("qualified"),
        "lat", "lon",
    )
