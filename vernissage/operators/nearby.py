"""Radius joins on a quadtree: points near centres, without comparing every point to every centre.

The world is one square of longitude and latitude, halved both ways from level to level. A cell that
holds more than `SMALL` points is split, so leaves are small wherever points lie, in a city or spread
over an ocean; points of one spot, which no level parts, are dealt to blocks by hash instead. A centre
is covered by at most 64 cells of the level that fits its reach, around the date line and over the poles
too, and meets the leaves inside those cells and the leaves those cells lie in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage.functions.geo import distance_m, lat_reach, lon_reach
from vernissage.session import materialize

DEEPEST = 16
SMALL = 512
_LONGEST_DEGREE = 112_000.0  # metres; a degree along a meridian is under 111.7 km, along a parallel less
_ACROSS = 6  # cells along a centre's reach


def _node(level: Column, x: Column, y: Column) -> Column:
    """A cell as one number."""
    return F.shiftleft(level.cast("long"), 40) + F.shiftleft(x.cast("long"), 20) + y.cast("long")


def _place(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Where a point lies in the square, both ways from 0 to below 1."""
    return F.pmod(lon + 180, F.lit(360.0)) / 360, F.least((lat + 90) / 180, F.lit(1 - 2.0**-40))


def _finest(lat: Column, lon: Column) -> tuple[Column, Column]:
    return tuple(F.floor(c * 2**DEEPEST).cast("long") for c in _place(lat, lon))


def _lineage(x: Column, y: Column, level: Column) -> Column:
    """The cell (level, x, y) and all above it, from the root."""
    return F.transform(F.sequence(F.lit(0), level.cast("int")), lambda k: _node(
        k, F.floor(x / F.pow(F.lit(2.0), level - k)), F.floor(y / F.pow(F.lit(2.0), level - k))))


def quadtree(points: DataFrame, small: int = SMALL) -> DataFrame:
    """(leaf, level, x, y, n): the cells that hold points and no more than `small` of them, or that are
    as fine as can be, whose parents hold more. Points are counted once, at the finest level."""
    x, y = _finest(F.col("lat"), F.col("lon"))
    fine = points.groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))
    levels = fine.select("n", F.posexplode(_lineage(F.col("x"), F.col("y"), F.lit(DEEPEST))).alias("level", "node"))
    cells = levels.groupBy("level", "node").agg(F.sum("n").alias("n"))
    crowded = cells.filter((F.col("n") > small) & (F.col("level") < DEEPEST)).select(F.col("node").alias("parent"))
    x, y = F.shiftright("node", 20).bitwiseAND(F.lit((1 << 20) - 1)), F.col("node").bitwiseAND(F.lit((1 << 20) - 1))
    calm = cells.filter((F.col("n") <= small) | (F.col("level") == DEEPEST)).withColumns({"x": x, "y": y})
    parent = F.when(F.col("level") == 0, F.lit(-1).cast("long")).otherwise(
        _node(F.col("level") - 1, F.shiftright("x", 1), F.shiftright("y", 1)))
    root = points.sparkSession.range(1).select(F.lit(-1).cast("long").alias("parent"))
    return calm.withColumn("parent", parent).join(crowded.union(root), "parent", "left_semi").select(
        F.col("node").alias("leaf"), "level", "x", "y", "n")


def _cover(lat: Column, lon: Column, up: Column, across: Column) -> tuple[Column, Column]:
    """(level, cells) that hold everything within `up` and `across` degrees: at most 64 cells."""
    x, y = _place(lat, lon)
    wide, high = F.least(across / 180, F.lit(1.0)), F.least(up / 90, F.lit(2.0))  # whole widths, as shares of the square
    level = F.least(F.floor(F.log2(_ACROSS / F.greatest(wide, high))), F.lit(DEEPEST)).cast("int")
    side = F.pow(F.lit(2.0), level)
    low = F.floor((x - wide / 2) * side)
    columns = F.sequence(low, F.least(F.floor((x + wide / 2) * side), low + side.cast("long") - 1))
    rows = F.sequence(F.floor(F.greatest(y - high / 2, F.lit(0.0)) * side), F.floor(F.least(y + high / 2, F.lit(1 - 2.0**-40)) * side))
    return level, F.flatten(F.transform(rows, lambda j: F.transform(
        columns, lambda i: F.struct(F.pmod(i, side.cast("long")).alias("x"), j.alias("y")))))


def _leaves_near(centers: DataFrame, leaves: DataFrame) -> DataFrame:
    """`centers` (_clat, _clon, radius_m, ...) with each leaf (as `_leaf`, `_n`, ...) that may hold a
    point within the radius."""
    leaves = leaves.withColumnsRenamed({c: f"_{c}" for c in leaves.columns})
    up, across = lat_reach(F.col("radius_m")), lon_reach(F.col("_clat"), F.col("radius_m"))
    level, cells = _cover(F.col("_clat"), F.col("_clon"), up, across)
    asked = centers.filter("radius_m >= 0").withColumns({"_deep": level, "_cell": F.explode(cells)})
    asked = asked.withColumn("_node", _node(F.col("_deep"), F.col("_cell.x"), F.col("_cell.y")))
    # Leaves in a cell, by all cells above each leaf; and the leaf a cell lies in, by all above the cell.
    below = leaves.withColumn("_node", F.explode(_lineage(F.col("_x"), F.col("_y"), F.col("_level"))))
    inside = asked.join(below, "_node")
    own = F.explode(_lineage(F.col("_cell.x"), F.col("_cell.y"), F.col("_deep"))).alias("_leaf")
    outside = asked.select("*", own).filter("_leaf <> _node").join(leaves, "_leaf")
    met = inside.drop("_node", "_cell", "_deep").unionByName(outside.drop("_node", "_cell", "_deep"))
    # Several cells of a centre can lie in one leaf, and corners reach beyond the circle.
    x, y = _place(F.col("_clat"), F.col("_clon"))
    size = F.pow(F.lit(2.0), -F.col("_level"))
    off = F.abs(x - (F.col("_x") + 0.5) * size)
    near = (F.least(off, 1 - off) <= size / 2 + across / 360) & (F.abs(y - (F.col("_y") + 0.5) * size) <= size / 2 + up / 180)
    return met.filter(near).drop("_level", "_x", "_y").distinct()


def indexed(points: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(leaves, points), both written once, for any number of joins. Points of one spot are `_rows` of one
    row, some `small` of them at most, with their `_leaf` and `_block`."""
    spots = points.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumnsRenamed({"lat": "_plat", "lon": "_plon"})
    leaves = materialize(quadtree(spots.select(F.col("_plat").alias("lat"), F.col("_plon").alias("lon")), small).withColumn(
        "blocks", F.ceil(F.col("n") / small)))
    # Each finest cell that holds points knows its leaf.
    spots = spots.withColumn("_fine", _node(F.lit(DEEPEST), *_finest(F.col("_plat"), F.col("_plon"))))
    last = F.lit((1 << 20) - 1)
    of = spots.select("_fine").distinct().select("_fine", F.explode(_lineage(
        F.shiftright("_fine", 20).bitwiseAND(last), F.col("_fine").bitwiseAND(last), F.lit(DEEPEST))).alias("_leaf"))
    of = of.join(leaves.select(F.col("leaf").alias("_leaf"), F.col("blocks").alias("_blocks")), "_leaf")
    rest = [c for c in points.columns if c not in ("lat", "lon")]
    # Equal rows are dealt to several blocks too, so the block is written down before rows are gathered by it.
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id(), *rest), "_blocks")
    dealt = materialize(spots.join(of, "_fine").withColumn("_block", block).drop("_fine", "_blocks"))
    return leaves, materialize(dealt.groupBy("_leaf", "_block", "_plat", "_plon").agg(F.collect_list(F.struct(*rest or [F.lit(True)])).alias("_rows")))


def within_radius(
    centers: DataFrame, points: DataFrame, *, small: int = SMALL, index: tuple[DataFrame, DataFrame] | None = None,
    shown: Callable[[Column], Column] = lambda metres: metres,
) -> DataFrame:
    """Every (centre, point) no further apart than the centre's `radius_m`, with `metres`; equal centres
    count once. `centers` holds lat, lon, radius_m and `points` holds lat, lon; other names must not
    clash. Centres and points without a place meet nothing; longitudes may go beyond 180. `index` is that
    of the points (see `indexed`) where several joins share it; `shown` makes `metres` of the distance.

    The pairs grow with the product of centres and points; what is computed follows their places. Centres of
    one place and radius are one row, points of one spot another (some `small` at most), and the distance of
    both, and whether it is inside, is found once; pairs are only written out from there."""
    leaves, spots = index or indexed(points, small)
    circle = ["_clat", "_clon", "radius_m"]
    own = [c for c in centers.columns if c not in ("lat", "lon", "radius_m")]
    rest = [c for c in points.columns if c not in ("lat", "lon")]
    asked = centers.filter("lat IS NOT NULL AND lon IS NOT NULL AND radius_m >= 0").withColumnsRenamed({"lat": "_clat", "lon": "_clon"}).distinct()
    circles = asked.groupBy(*circle).agg(F.ceil(F.count("*") / small).alias("_parts"))
    # Centres are distinct, so their hash deals them evenly and the same way in a task that runs again.
    asked = asked.join(circles, circle).groupBy(*circle, F.pmod(F.xxhash64(*circle, *own), "_parts").alias("_part")).agg(
        F.collect_list(F.struct(*own or [F.lit(True)])).alias("_centers"))
    near = _leaves_near(circles.drop("_parts"), leaves).join(asked, circle)
    near = near.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    # The join multiplies these few rows, so they are dealt evenly first.
    near = near.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_leaf", "_block", "_part", *circle)
    met = near.join(spots, ["_leaf", "_block"]).withColumn("metres", distance_m(
        F.col("_plat"), F.col("_plon"), F.col("_clat"), F.col("_clon"))).filter("metres <= radius_m")
    met = met.select("radius_m", shown(F.col("metres")).alias("metres"), "_rows", F.explode("_centers").alias("_center"))
    met = met.select("radius_m", "metres", "_center", F.explode("_rows").alias("_point"))
    return met.select(*("radius_m" if c == "radius_m" else F.col("_center")[c].alias(c) for c in centers.columns if c not in ("lat", "lon")),
                      *(F.col("_point")[c].alias(c) for c in rest), "metres")


def _reach(places: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """`places` (lat, lon, radius_m, ...) with the radius cut to what certainly holds `k` points: as far as
    one can go inside the smallest cell around the place that has so many."""
    line = lambda: F.posexplode(_lineage(*_finest(F.col("lat"), F.col("lon")), F.lit(DEEPEST))).alias("_level", "_node")
    full = points.groupBy(*(c.alias(n) for c, n in zip(_finest(F.col("lat"), F.col("lon")), ("x", "y"), strict=True))).agg(
        F.count("*").alias("n")).select("n", F.explode(_lineage(F.col("x"), F.col("y"), F.lit(DEEPEST))).alias("_node"))
    full = full.groupBy("_node").agg(F.sum("n").alias("n")).filter(F.col("n") >= k).select("_node")
    found = places.select(*places.columns, line()).join(full, "_node").groupBy(*places.columns).agg(F.max("_level").alias("_level"))
    # A cell is 360 by 180 degrees at the root, and no degree is longer than this.
    across = F.lit(_LONGEST_DEGREE * 540) / F.pow(F.lit(2.0), F.col("_level"))
    return places.join(found, places.columns, "left").withColumn(
        "radius_m", F.least("radius_m", across)).drop("_level")


def nearest_first(centers: DataFrame, points: DataFrame, center_id: str, point_id: str, k: int) -> DataFrame:
    """The `k` nearest points of each centre within its radius, ties by id: (.., metres, position).

    Points of one spot are equally far from anything, so its `k` lowest ids stand for it; centres of one
    place and radius have the same points, so these are found once; and a circle is no wider than it takes
    to hold `k` points. The pairs compared follow the places, not the product of centres and points."""
    here = Window.partitionBy("lat", "lon").orderBy(point_id)
    spots = points.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumn(
        "_n", F.row_number().over(here)).filter(F.col("_n") <= k).drop("_n")
    asked = centers.filter("lat IS NOT NULL AND lon IS NOT NULL AND radius_m >= 0").distinct()
    place = ["_alat", "_alon", "_ameters"]
    places = asked.select("lat", "lon", "radius_m", *(F.col(c).alias(n) for c, n in zip(("lat", "lon", "radius_m"), place, strict=True))).distinct()
    order = Window.partitionBy(*place).orderBy("metres", point_id)
    near = within_radius(_reach(places, spots, k), spots).withColumn(
        "_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n", "radius_m")
    met = asked.withColumnsRenamed({"lat": "_alat", "lon": "_alon"}).withColumn("_ameters", F.col("radius_m")).join(near, place).drop(*place)
    return met.withColumn("position", F.row_number().over(Window.partitionBy(center_id).orderBy("metres", point_id))).filter(
        F.col("position") <= k)


def one_spot(items: DataFrame, group: str, order: list[str], radius_m: float) -> DataFrame:
    """(group, first_id, one_spot): whether every item (id, lat, lon) of a group lies within
    `radius_m` of its first by `order`. Two aggregations, no list of the group anywhere."""
    first = items.groupBy(group).agg(
        F.min_by(F.struct("id", "lat", "lon"), F.struct(*order)).alias("_first"))
    apart = distance_m(F.col("lat"), F.col("lon"), F.col("_first.lat"), F.col("_first.lon"))
    return items.join(first, group).groupBy(group).agg(
        F.first("_first.id").alias("first_id"),
        F.bool_and(F.coalesce(apart <= radius_m, F.lit(False))).alias("one_spot"),
    )
