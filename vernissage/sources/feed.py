"""The feed's captures: raw JSON payloads to typed terms, profiles and events."""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernissage import vocab
from vernissage.functions.dates import parse_instant
from vernissage.functions.text import clean_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERM_PAYLOAD = (
    "id long, count long, name string, slug string, address string, city string, state string, "
    "postcode string, latitude string, longtitude string"
)
PROFILE_PAYLOAD = "id long, name string, slug string, url string"
EVENT_PAYLOAD = (
    "id long, modified_gmt string, link string, title struct<rendered:string>, "
    "`event-venues` array<string>, occurrence_id string, `start` string, `end` string, acf string"
)
OCCURRENCE_PAYLOAD = "occurrence_id string, `start` string, `end` string"
_ACF = (
    "title_en string, event_category string, _event_free boolean, `_event_price-min` string, "
    "`_event_price-max` string, _event_web_ca string, _event_web_es string, _event_web_en string, "
    "is_online_event boolean"
)


def read_payloads(spark: SparkSession, path: str, schema: str, *, lines: bool = False) -> DataFrame:
    """Captured payloads with only the declared fields; a record that is not JSON keeps its text in
    `_corrupt_record`. `ord` is the order served. Captures are JSON arrays, one file per fetch
    page; `lines` reads one payload a line instead, which splits."""
    read = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE")
    rows = read.json(path) if lines else read.option("multiLine", True).json(path)
    # File, then place in the file: increasing within a file, and stable across attempts.
    return rows.withColumn("_file", F.col("_metadata.file_path")).withColumn(
        "ord", F.struct("_file", F.monotonically_increasing_id().alias("n"))).drop("_file")


# --- value rules ---------------------------------------------------------------------------------


def parse_int(c: Column) -> Column:
    return F.trim(c).try_cast("bigint")


def parse_decimal(c: Column) -> Column:
    """A price; blank and unreadable are absent, never zero."""
    text = F.replace(F.trim(c), F.lit(","), F.lit("."))
    return F.when(text != "", text.try_cast("decimal(8,2)"))


def parse_point(latitude: Column, longitude: Column) -> Column:
    """struct(lat, lon); both null when either is unreadable or out of range, or both are zero."""
    lat, lon = F.trim(latitude).try_cast("double"), F.trim(longitude).try_cast("double")
    usable = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.struct(F.when(usable, lat).alias("lat"), F.when(usable, lon).alias("lon"))


# --- typed tables --------------------------------------------------------------------------------


def terms(payloads: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(clean_text(F.col(c)), F.col(c))
    return payloads.withColumn("p", parse_point(F.col("latitude"), F.col("longtitude"))).select(
        "id", text("name").alias("name"), text("slug").alias("slug"),
        clean_text(F.col("address")).alias("address"), clean_text(F.col("city")).alias("city"),
        clean_text(F.col("state")).alias("province"), clean_text(F.col("postcode")).alias("postcode"),
        "p.lat", "p.lon", F.coalesce("count", F.lit(0)).alias("event_count"), "ord",
    ).filter("id IS NOT NULL AND name IS NOT NULL AND slug IS NOT NULL")


def profiles(payloads: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(clean_text(F.col(c)), F.col(c))
    return payloads.select(
        "id", text("name").alias("name"), text("slug").alias("slug"),
        clean_text(F.col("url")).alias("url"), "ord",
    ).filter("id IS NOT NULL AND name IS NOT NULL AND slug IS NOT NULL")


def events(payloads: DataFrame) -> DataFrame:
    """One row per payload, which is one per occurrence: a post can repeat. An `acf` that is no
    object (the feed sends an empty list) gives no facts."""
    acf = F.from_json(F.when(F.ltrim("acf").startswith("{"), F.col("acf")), _ACF)
    rows = payloads.withColumn("a", acf).withColumn(
        "venues", F.array_compact(F.transform("event-venues", parse_int)))
    return rows.select(
        F.col("id").alias("source_event_id"),
        F.try_element_at("venues", F.lit(1)).alias("source_venue_id"),
        clean_text(F.col("title.rendered")).alias("title"),
        clean_text(F.col("a.title_en")).alias("title_en"),
        parse_int(F.col("a.event_category")).alias("source_category_id"),
        F.col("a._event_free").alias("is_free"),
        parse_decimal(F.col("a.`_event_price-min`")).alias("price_min"),
        parse_decimal(F.col("a.`_event_price-max`")).alias("price_max"),
        F.col("a.is_online_event").alias("is_online"),
        F.col("link").alias("source_url"),
        *(clean_text(F.col(f"a._event_web_{x}")).alias(f"web_url_{x}") for x in ("ca", "es", "en")),
        parse_instant(F.col("modified_gmt"), assume_utc=True).alias("source_modified_at"),
        parse_int(F.col("occurrence_id")).alias("source_occurrence_id"),
        parse_instant(F.col("start")).alias("starts_at"), parse_instant(F.col("end")).alias("ends_at"),
        "ord",
    ).filter("source_event_id IS NOT NULL AND title IS NOT NULL AND source_url IS NOT NULL")


def rejects(payloads: DataFrame, required: tuple[str, ...] = ("id",)) -> DataFrame:
    """(ord, reason): payloads that are not JSON or lack a field a row cannot do without."""
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), F.lit(c)) for c in required))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "not JSON").when(
        missing != "", F.concat(F.lit("missing "), missing))
    return payloads.select("ord", reason.alias("reason")).filter("reason IS NOT NULL")


# --- prose ---------------------------------------------------------------------------------------


# Plain values, so that the functions below carry them to the workers.
_KEYS, _PREFIX, _LONGEST = vocab.PROSE_KEYS, vocab.PROSE_PREFIX, vocab.MAX_PAYLOAD_STRING


def _is_prose(key: str) -> bool:
    return key in _KEYS or key.startswith(_PREFIX)


def _without_prose(value):
    if isinstance(value, dict):
        return {k: _without_prose(v) for k, v in value.items() if not _is_prose(k)}
    return [_without_prose(v) for v in value] if isinstance(value, list) else value


def _audit(value, found: set[str]) -> set[str]:
    """Names of prose keys and of fields with over-long text, at any depth."""
    inside = value.items() if isinstance(value, dict) else enumerate(value)
    for key, item in inside:
        if isinstance(key, str) and _is_prose(key):
            found.add(key)
        if isinstance(item, str) and len(item) > _LONGEST:
            found.add(f"long:{key}")
        if isinstance(item, (dict, list)):
            _audit(item, found)
    return found


def _parsed(text: str | None):
    """The payload, or None if it is no JSON."""
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


@F.arrow_udf(T.StringType())
def _scrub(values: pa.Array) -> pa.Array:
    return pa.array([
        None if v is None else json.dumps(_without_prose(v), ensure_ascii=False)
        for v in map(_parsed, values.to_pylist())], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _banned(values: pa.Array) -> pa.Array:
    return pa.array([
        [] if v is None else sorted(_audit([v], set())) for v in map(_parsed, values.to_pylist())
    ], pa.list_(pa.string()))


def scrub_payloads(df: DataFrame, column: str = "payload") -> DataFrame:
    """Payload texts without third-party prose, whatever its place in the tree. A text that is no
    JSON becomes null; `malformed` lists those."""
    return df.withColumn(column, _scrub(F.col(column)))


def malformed(df: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """(key, reason): payloads that are no JSON, for the rejects."""
    return df.filter(F.col(column).isNotNull() & _scrub(F.col(column)).isNull()).select(
        key, F.lit("not JSON").alias("reason"))


def banned_keys(df: DataFrame, key: str, column: str = "payload") -> DataFrame:
    """(key, banned): what prose is left in each payload; no rows means clean."""
    return df.select(key, F.explode(_banned(F.col(column))).alias("banned"))


def write_capture(df: DataFrame, path: str, column: str = "payload") -> None:
    """Payloads as JSON lines; refuses while any prose key is left."""
    left = [r.banned for r in banned_keys(df.withColumn("_k", F.lit(1)), "_k", column)
            .select("banned").filter("banned NOT LIKE 'long:%'").distinct().limit(20).collect()]
    if left:
        raise ValueError(f"refusing to write third-party prose: {sorted(left)}")
    df.select(column).write.text(path)
