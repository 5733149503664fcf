"""Open-data gazetteers: CSV files to places, with what cannot be used set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vernissage import vocab
from vernissage.functions.text import blank_to_null

_ARTICLE = rf"(?i)^(?:{'|'.join(vocab.ARTICLES)})\s+|^l['’]"
_ARTICLE_AFTER = rf"(?i)^(.+), ({'|'.join(vocab.ARTICLES)}|l['’])$"
_FIRST_VERTEX = r"\(\(+\s*(-?[\d.]+)\s+(-?[\d.]+)"

# Source columns of each kind: code, name, within, and the geometry or the point.
COLUMNS = {
    "barri": ("codi_barri", "nom_barri", "nom_districte", "geometria_wgs84"),
    "district": ("codi_districte", "nom_districte", None, "geometria_wgs84"),
    "municipality": ("codi", "nom", "nom_comarca", ("longitud", "latitud")),
}
DISTRICT_WITHIN = "Barcelona"


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The file's rows as text with lower-case headers, trimmed; a missing column is an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*(c.strip("﻿ ").lower() for c in raw.columns))
    code, name, within, geometry = COLUMNS[kind]
    wanted = [c for c in (code, name, within) if c] + (
        [geometry] if isinstance(geometry, str) else list(geometry))
    missing = sorted(set(wanted) - set(raw.columns))
    if missing:
        raise ValueError(f"columns {missing} missing; found {raw.columns}")
    return raw.select(*(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in wanted))


def article_first(name: Column) -> Column:
    """`Garriga, la` -> `la Garriga`; an elided article is written without a space."""
    noun, article = F.regexp_extract(name, _ARTICLE_AFTER, 1), F.regexp_extract(name, _ARTICLE_AFTER, 2)
    glue = F.when(F.right(article, F.lit(1)).isin("'", "’"), "").otherwise(" ")
    return F.when(article != "", F.concat(article, glue, noun)).otherwise(name)


def aliases(name: Column, extras: Column) -> Column:
    """Each extra name, and it and the name without their article; never the name itself."""
    every = F.concat(F.array(name), extras)
    both = F.flatten(F.transform(every, lambda n: F.array(n, F.regexp_replace(n, _ARTICLE, ""))))
    return F.array_distinct(F.filter(both, lambda n: n != name))


def _in_box(lat: Column, lon: Column) -> Column:
    return lon.between(*vocab.LONGITUDES) & lat.between(*vocab.LATITUDES)


def _ring(text: Column) -> Column:
    """A ring's vertices as array<struct<x, y>>."""
    return F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda v: F.struct(
        F.try_element_at(F.split(v, r"\s+"), F.lit(1)).try_cast("double").alias("x"),
        F.try_element_at(F.split(v, r"\s+"), F.lit(2)).try_cast("double").alias("y")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` worked out once a row: Spark shares no steps inside higher-order functions."""
    return F.transform(F.array(value), use)[0]


def _moments(ring: Column) -> Column:
    """struct(a, x, y): twice the signed area and its first moments about the first vertex."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(total: Column, e: Column) -> Column:
        return _once(e["px"] * e["qy"] - e["qx"] * e["py"], lambda cross: F.struct(
            (total["a"] + cross).alias("a"), (total["x"] + (e["px"] + e["qx"]) * cross).alias("x"),
            (total["y"] + (e["py"] + e["qy"]) * cross).alias("y")))

    def of(ring: Column, origin: Column) -> Column:
        edges = F.zip_with(
            F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1),
            lambda p, q: F.struct(
                (p["x"] - origin["x"]).alias("px"), (p["y"] - origin["y"]).alias("py"),
                (q["x"] - origin["x"]).alias("qx"), (q["y"] - origin["y"]).alias("qy")))
        return _once(F.aggregate(edges, zero, add), lambda sums: F.struct(
            sums["a"].alias("a"), (sums["x"] / 3 + origin["x"] * sums["a"]).alias("x"),
            (sums["y"] / 3 + origin["y"] * sums["a"]).alias("y")))

    return _once(ring, lambda vertices: _once(vertices[0], lambda origin: of(vertices, origin)))


def area_point(wkt: Column) -> Column:
    """struct(lat, lon): the planar centroid of a polygon or multipolygon, holes taken out."""
    pattern = r"(\(*)\(([^()]+)\)"
    rings = F.zip_with(
        F.regexp_extract_all(wkt, F.lit(pattern), F.lit(1)), F.regexp_extract_all(wkt, F.lit(pattern), F.lit(2)),
        lambda outer, text: F.struct((outer != "").alias("outer"), _moments(_ring(text)).alias("m")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(total: Column, r: Column) -> Column:
        # A ring counts by its size, whichever way round it was drawn; a hole takes away.
        sign = F.signum(r["m"]["a"]) * F.when(r["outer"], 1.0).otherwise(-1.0)
        return F.struct(*((total[c] + sign * r["m"][c]).alias(c) for c in ("a", "x", "y")))

    return _once(F.aggregate(rings, zero, add), lambda total: F.struct(
        F.try_divide(total["y"], total["a"]).alias("lat"), F.try_divide(total["x"], total["a"]).alias("lon")))


def places(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(places, refused) of one file: kind, code, name, within, aliases, lat, lon; and kind, code,
    name, reason. The row that stands for "not recorded" (0, 0) is neither."""
    code, name, within, geometry = COLUMNS[kind]
    base = rows.select("*", F.col(code).alias("_code"), F.col(name).alias("_name"))
    if kind == "municipality":
        lon, lat = (F.col(c).try_cast("double") for c in geometry)
        base = base.withColumns({"_lat": lat, "_lon": lon}).filter("NOT coalesce(_lat = 0 AND _lon = 0, false)")
        reason = F.when(F.col("_lat").isNull() | F.col("_lon").isNull(), "no usable point").when(
            ~_in_box(F.col("_lat"), F.col("_lon")), "point outside the box")
        base = base.withColumn("_name", article_first(F.col("_name")))
    else:
        wkt = F.col(geometry)
        x = F.regexp_extract(wkt, _FIRST_VERTEX, 1).try_cast("double")
        y = F.regexp_extract(wkt, _FIRST_VERTEX, 2).try_cast("double")
        polygon = wkt.rlike("^(POLYGON|MULTIPOLYGON)") & x.isNotNull() & y.isNotNull()
        reason = F.when(~polygon, "not a polygon").when(~_in_box(y, x), "polygon outside the box")
        base = base.withColumn("_p", area_point(F.when(polygon, wkt))).withColumns(
            {"_lat": F.col("_p.lat"), "_lon": F.col("_p.lon")})
    judged = base.withColumn("reason", reason)
    extras = F.array().cast("array<string>")
    if kind == "barri":
        known = F.create_map(*(x for k, v in vocab.EXTRA_ALIASES.items()
                               for x in (F.lit(k), F.array(*map(F.lit, v)))))
        extras = F.coalesce(F.try_element_at(known, F.col("_name")), extras)
    inside = F.lit(DISTRICT_WITHIN) if within is None else blank_to_null(F.col(within))
    good = judged.filter("reason IS NULL").select(
        F.lit(kind).alias("kind"), F.col("_code").alias("code"), F.col("_name").alias("name"),
        inside.alias("within"), aliases(F.col("_name"), extras).alias("aliases"),
        F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    bad = judged.filter("reason IS NOT NULL").select(
        F.lit(kind).alias("kind"), F.col("_code").alias("code"), F.col("_name").alias("name"), "reason")
    return good, bad


def place_problems(places: DataFrame, minimum: dict[str, int] | None = None,
                   aliased: tuple[str, ...] | None = None) -> DataFrame:
    """(problem, subject, rows): why these places must not replace the table; empty when they can."""
    minimum = vocab.MIN_PLACES if minimum is None else minimum
    aliased = tuple(vocab.EXTRA_ALIASES) if aliased is None else aliased
    spark = places.sparkSession
    wanted = spark.createDataFrame(list(minimum.items()), "kind string, least long")
    counts = places.groupBy("kind").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    few = wanted.join(counts, "kind", "left").filter(n < F.col("least")).select(
        F.lit("too few").alias("problem"), F.col("kind").alias("subject"), n.alias("rows"))
    twice = places.groupBy("kind", "code").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.lit("code twice").alias("problem"), F.concat_ws(" ", "kind", "code").alias("subject"),
        F.col("n").alias("rows"))
    names = spark.createDataFrame([(a,) for a in aliased], "name string")
    lost = names.join(places.filter("kind = 'barri'").select("name"), "name", "left_anti").select(
        F.lit("alias of no barri").alias("problem"), F.col("name").alias("subject"),
        F.lit(0).cast("long").alias("rows"))
    return few.unionByName(twice).unionByName(lost)


def replace_places(places: DataFrame, path: str, **checks) -> None:
    """The whole table replaced, or nothing: refuses while `place_problems` has rows."""
    from vernissage.sources.snapshots import write_snapshot

    found = place_problems(places, **checks).limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.subject} ({r.rows})" for r in found))
    write_snapshot(places, path, ["kind", "code"])
