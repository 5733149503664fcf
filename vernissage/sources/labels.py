"""Hand-made labels and scripted conversations, flattened with their positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD_PAGE = (
    "page_id long, url string, venue string, kind string, content_hash string, confirmed boolean, partial boolean, "
    "items array<struct<kind:string,title:string,artists:array<string>,start:date,end:date,at_venue:boolean>>"
)
SCENARIO = (
    "id string, persona string, profile array<struct<topic:string,fact:string>>, "
    "turns array<struct<user:string,expect:map<string,string>>>"
)
CARRIED = ("dates", "area", "free", "kinds")


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, items) of labelled pages, one JSON document a line, defaults spelled out."""
    raw = spark.read.schema(GOLD_PAGE).json(path)
    return gold_pages(raw), gold_items(raw)


def gold_pages(raw: DataFrame) -> DataFrame:
    return raw.select(
        "page_id", "url", "venue", "kind", "content_hash",
        F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
        F.coalesce("partial", F.lit(False)).alias("partial"))


def gold_items(raw: DataFrame) -> DataFrame:
    return raw.select("page_id", F.posexplode("items").alias("ord", "i")).select(
        "page_id", F.col("ord").cast("long").alias("ord"),
        F.coalesce("i.kind", F.lit("exhibition")).alias("kind"), F.trim("i.title").alias("title"),
        F.coalesce("i.artists", F.array().cast("array<string>")).alias("artists"),
        "i.start", "i.end", F.coalesce("i.at_venue", F.lit(True)).alias("at_venue"))


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """(venue, urls); an entry with no URL is a venue with no usable listing."""
    raw = spark.read.schema("venue string, urls array<string>").json(path)
    return raw.select("venue", F.coalesce("urls", F.array().cast("array<string>")).alias("urls"))


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scenarios, turns, facts). A turn keeps, for each constraint, whether it was stated at all:
    an explicit null is not the same as nothing said."""
    raw = spark.read.schema(SCENARIO).json(path)
    return (
        raw.select("id", "persona"), scenario_turns(raw),
        raw.select(F.col("id").alias("scenario_id"), F.posexplode("profile").alias("ord", "f")).select(
            "scenario_id", "ord", "f.topic", "f.fact"),
    )


def _listed(text: Column) -> Column:
    """A JSON list, or one value standing for itself twice (one day is first and last)."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text, text))


def scenario_turns(raw: DataFrame) -> DataFrame:
    said = F.col("t.expect")
    value = {
        "dates": F.when(said["dates"].isNotNull(), _listed(said["dates"])),
        "area": F.from_json(said["area"], "near string, km double"),
        "free": said["free"].try_cast("boolean"),
        "kinds": F.from_json(said["kinds"], "array<string>"),
    }
    stated = lambda c: F.coalesce(F.map_contains_key(said, F.lit(c)), F.lit(False))
    return raw.select(F.col("id").alias("scenario_id"), F.posexplode("turns").alias("turn", "t")).select(
        "scenario_id", F.col("turn").cast("long").alias("turn"), "t.user",
        *(stated(c).alias(f"has_{c}") for c in CARRIED), *(v.alias(c) for c, v in value.items()),
        said["searches"].try_cast("boolean").alias("searches"),
        F.from_json(said["remembers"], "array<string>").alias("remembers"))
