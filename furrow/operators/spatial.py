"""Spatial filters and joins without a geometry package.

Every join here is an equi join on a lattice bucket followed by the exact
test. No cross join, no all-pairs group: polygons are cut into the buckets
they cover, and the nearest join, bounded or not, walks an octree whose candidate
list per point stays short.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import geo
from furrow.operators.skew import salted_join
from furrow.session import scratch_dir, write_stage


# ---- filters --------------------------------------------------------------

def within_box(df: DataFrame, min_lon: float, min_lat: float, max_lon: float,
               max_lat: float, boundary: str = "include",
               lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows in a box; plain comparisons, so Parquet statistics prune."""
    return df.where(geo.in_box(F.col(lon), F.col(lat), min_lon, min_lat,
                               max_lon, max_lat, boundary))


def within_area(df: DataFrame, rings: list[list[tuple[float, float]]],
                boundary: str = "exclude", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows in a literal polygon or multipolygon.

    The envelope comparison comes first: it is pushed to the scan, and the
    exact test only sees what is left.
    """
    xs = [x for ring in rings for x, _ in ring]
    ys = [y for ring in rings for _, y in ring]
    area = F.array(*[F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in ring])
                     for ring in rings])
    near = within_box(df, min(xs), min(ys), max(xs), max(ys), "include", lon, lat)
    return near.where(geo.in_area(F.col(lon), F.col(lat), area, boundary))


# ---- regular axes ---------------------------------------------------------

def axis_index(value: Column, origin: float | Column, step: float | Column) -> Column:
    """Index of the nearest coordinate on a regular axis; halves go up."""
    return F.floor((value - origin) / step + 0.5).cast("int")


def axis_value(index: Column, origin: float | Column, step: float | Column) -> Column:
    return origin + index * step


def snap(value: Column, origin: float | Column, step: float | Column,
         tolerance: float | Column | None = None, size: int | None = None) -> Column:
    """Nearest axis index, null when farther than ``tolerance`` or off the axis."""
    idx = axis_index(value, origin, step)
    ok = F.lit(True)
    if tolerance is not None:
        ok = F.abs(value - axis_value(idx, origin, step)) <= tolerance
    if size is not None:
        ok = ok & idx.between(0, size - 1)
    return F.when(ok, idx)


def axis_origin(axis_min: float, wanted_min: float, step: float) -> float:
    """First coordinate at or below ``wanted_min`` that keeps the spacing."""
    return axis_min - math.ceil(abs((axis_min - wanted_min) / step)) * step


def make_axis(df: DataFrame, low: str, high: str, step: str, out: str) -> DataFrame:
    """Axis coordinates low, low + step, ... below high, one row each."""
    count = F.ceil((F.col(high) - F.col(low)) / F.col(step)).cast("int")
    return (df.where(count > 0)
            .withColumn("axis_idx", F.explode(F.sequence(F.lit(0), count - 1)))
            .withColumn(out, F.col(low) + F.col("axis_idx") * F.col(step)))


def cell_locations(cube: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """All (lat, lon) pairs of two axes.

    Axis enumeration: each latitude row explodes the longitude axis, which is
    one array of a few thousand numbers; no join of tables takes place.
    """
    lons = cube.select(lon).distinct().agg(F.array_sort(F.collect_list(lon)))
    return cube.select(lat).distinct().select(lat, F.explode(lons.scalar()).alias(lon))


def nearest_on_axis(points: DataFrame, axis: DataFrame, value: str, coord: str,
                    max_gap: float, key: list[str]) -> DataFrame:
    """Nearest coordinate of an irregular axis.

    The axis is cut into buckets no narrower than its largest gap, so the
    nearest coordinate is in the same or a neighbouring bucket. Values beyond
    the ends are clamped for the bucket only. Ties take the lower coordinate.
    A point meets the coordinates around it as one array, so its rows are not multiplied.
    """
    ends = axis.agg(F.struct(F.min(coord).alias("lo"), F.max(coord).alias("hi")))
    b = lambda c: F.floor(c / F.lit(float(max_gap))).cast("long")
    near = axis.select(coord).distinct().withColumn(
        "_b", F.explode(F.array(b(F.col(coord)) - 1, b(F.col(coord)), b(F.col(coord)) + 1)))
    p = (points.select("*", ends.scalar().alias("_ends"))
         .withColumn("_b", b(F.least(F.greatest(F.col(value), F.col("_ends.lo")), F.col("_ends.hi"))))
         .drop("_ends"))
    near = near.groupBy("_b").agg(F.array_sort(F.collect_set(coord)).alias("_coords"))
    hit = salted_join(p, near, ["_b"]).withColumn("_near", F.array_min(F.transform(
        "_coords", lambda c: F.struct(F.abs(c - F.col(value)).alias("gap"), c.alias("at")))))
    # one row per key, in two aggregations over plain numbers: those hash, a struct would be sorted
    rest = [c for c in points.columns if c not in key]
    kept = [F.first(c).alias(c) for c in rest]
    hit = hit.select(*points.columns, F.coalesce("_near.gap", F.lit(-1.0)).alias("_gap"), F.col("_near.at").alias(coord))
    hit = hit.groupBy(*key, "_gap").agg(*kept, F.min(coord).alias(coord))
    return hit.groupBy(*key).agg(*kept, F.min_by(coord, "_gap").alias(coord))


# ---- nearest cells --------------------------------------------------------

def nearest_cells(points: DataFrame, lon0: float, lat0: float, step: float,
                  lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds ``lat_idx``/``lon_idx`` of the nearest cell of a regular lattice."""
    return (points.withColumn("lat_idx", axis_index(F.col(lat), lat0, step))
            .withColumn("lon_idx", axis_index(F.col(lon), lon0, step)))


def cells_of_points(cube: DataFrame, points: DataFrame, lon0: float, lat0: float,
                    step: float) -> DataFrame:
    """Cube rows of the union of the points' nearest cells, each cell once."""
    wanted = nearest_cells(points, lon0, lat0, step).select("lat_idx", "lon_idx").distinct()
    return cube.join(wanted, ["lat_idx", "lon_idx"], "left_semi")


def fill_index_gaps(df: DataFrame, idx: str) -> DataFrame:
    """Missing axis indices between the first and last, flagged ``is_gap_filled``."""
    span = df.agg(F.min(idx).alias("_lo"), F.max(idx).alias("_hi")).where("_lo is not null")
    full = span.select(F.explode(F.sequence("_lo", "_hi")).alias(idx))
    have = df.select(idx).distinct().withColumn("_have", F.lit(True))
    return full.join(have, idx, "left").select(
        idx, F.col("_have").isNull().alias("is_gap_filled"))


def is_contiguous(df: DataFrame, idx: str) -> DataFrame:
    """One row: do the distinct indices run without a hole?

    For distinct integers max - min + 1 = count is the same as every step
    being one, and needs no ordering.
    """
    return df.agg(
        ((F.max(idx) - F.min(idx) + 1) == F.countDistinct(idx)).alias("contiguous"))


# ---- point in polygon -----------------------------------------------------

def _buckets(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def areas_by_bucket(areas: DataFrame, area: str, size: float) -> DataFrame:
    """Areas once per lattice bucket their envelope touches."""
    env = geo.envelope(F.col(area))
    return (areas.withColumn("_env", env)
            .withColumn("_bx", F.explode(_buckets(F.col("_env.min_lon"), F.col("_env.max_lon"), size)))
            .withColumn("_by", F.explode(_buckets(F.col("_env.min_lat"), F.col("_env.max_lat"), size))))


def _spread_join(points: DataFrame, cells: DataFrame, on: list[str], per_task: int) -> DataFrame:
    """Equi join in which a key of more than ``per_task`` points is spread over several tasks.

    Only the cells of such keys are copied. There is at most one of them for every
    ``per_task`` points, so their list is sent to both sides.
    """
    salts = F.ceil(F.col("_n") / per_task).cast("int").alias("_salts")
    crowded = F.broadcast(points.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > per_task).select(*on, salts))
    salts = F.coalesce("_salts", F.lit(1))
    hashed = F.xxhash64(*[F.col(c) for c in points.columns])
    left = points.join(crowded, on, "left").withColumn("_salt", F.pmod(hashed, salts).cast("int")).drop("_salts")
    right = cells.join(crowded, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def join_points_to_areas(points: DataFrame, areas: DataFrame, area: str = "area",
                         bucket_deg: float = 1.0, boundary: str = "include",
                         how: str = "inner", lon: str = "lon", lat: str = "lat",
                         per_task: int = 100_000) -> DataFrame:
    """Every (point, area) pair with the point in the area.

    ``bucket_deg`` near the size of an area keeps both the copies of an area
    and the candidates of a point small. The envelope is compared first, and for
    upright rectangles (grid cells) it is the whole test; other areas are tested
    exactly. A city that holds a third of the points is spread over several tasks, of
    ``per_task`` points each. With ``left`` the points without an
    area come back with nulls; ``points`` must then be unique rows.
    """
    cells = areas_by_bucket(areas.withColumn("_box", geo.is_rectangle(F.col(area))), area, bucket_deg)
    p = (points.withColumn("_bx", F.floor(F.col(lon) / bucket_deg).cast("long"))
         .withColumn("_by", F.floor(F.col(lat) / bucket_deg).cast("long")))
    env = [F.col(f"_env.{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    test = F.when(F.col("_box"), geo.in_box(F.col(lon), F.col(lat), *env, boundary)).otherwise(
        geo.in_box(F.col(lon), F.col(lat), *env) & geo.in_area(F.col(lon), F.col(lat), F.col(area), boundary))
    # the vertices of a rectangle have done their work and stay behind
    cells = cells.withColumn(area, F.when(~F.col("_box"), F.col(area)))
    hits = (_spread_join(p, cells, ["_bx", "_by"], per_task).where(test)
            .drop("_bx", "_by", "_env", "_box", area))
    if how == "inner":
        return hits
    return points.join(hits, points.columns, "left")


def first_area_per_point(points: DataFrame, areas: DataFrame, key: str, choose: str,
                         take: list[str], **kwargs) -> DataFrame:
    """At most one area per point: the first by ``choose`` (a country name)."""
    hits = join_points_to_areas(points, areas, **kwargs)
    best = hits.groupBy(key).agg(
        F.min_by(F.struct(*take), F.col(choose)).alias("_a")).select(key, "_a.*")
    return points.join(best, key, "left")


# ---- nearest within a radius ----------------------------------------------

def nearest_within(points: DataFrame, places: DataFrame, key: str, place_id: str,
                   radius_m: float, salts: int = 4) -> DataFrame:
    """Nearest place of each point within a radius; ties take the lower id.

    The nearest place at any distance (``nearest_place``), kept if it is in reach: a point
    meets a handful of places, however many lie within the radius. Rows: key, place_id,
    distance_m; points without a place in reach are absent.
    """
    spots = places.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(place_id, "lon", "lat")
    near = nearest_place(points.select(key, "lon", "lat"), spots, key, place_id, salts=salts)
    best = F.min_by(F.struct(place_id, "distance_m"), F.struct("distance_m", place_id))
    return (near.where(F.col("distance_m") <= radius_m)
            .groupBy(key).agg(best.alias("_b")).select(key, "_b.*"))


# ---- unbounded nearest ----------------------------------------------------

_FINEST = 17
_MILLIMETRE = 1e-3 / 6371008.8      # on the unit sphere


def _finest_cell(position: Column) -> Column:
    """Octree cell of a unit-sphere position at the finest level."""
    n = float(1 << _FINEST)
    f = lambda c: F.least(F.floor((c + 1) / 2 * n), F.lit(n - 1)).cast("long")
    return F.struct(*[f(position[a]).alias(a) for a in "xyz"])


def _cell_at(finest: Column, level: int) -> Column:
    return F.struct(*[F.shiftright(finest[a], _FINEST - level).alias(a) for a in "xyz"])


def _box_bounds(p: Column, cell: Column, level: int) -> tuple[Column, Column]:
    """Least and greatest squared distance from a position to a cell."""
    side = 2.0 / (1 << level)
    low = high = F.lit(0.0)
    for axis in "xyz":
        a = cell[axis] * side - 1.0
        b = a + side
        gap = F.greatest(a - p[axis], p[axis] - b, F.lit(0.0))
        far = F.greatest(F.abs(p[axis] - a), F.abs(p[axis] - b))
        low, high = low + gap * gap, high + far * far
    return low, high


def octree_depth(spots: DataFrame, leaf: int = 64,
                 levels: tuple[int, ...] = (2, 4, 7, 10, 13, 16)) -> list[int]:
    """Levels needed until no cell holds more than ``leaf`` distinct positions.

    One job over cell counts; the driver sees one row per level.
    """
    finest = levels[-1]
    counts = spots.groupBy(_cell_at(F.col("_c"), finest).alias("_c")).agg(F.count("*").alias("_n"))
    per_level = counts.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    cell = [F.expr(f"shiftright(_c.{a}, {finest} - level)").alias(a) for a in "xyz"]
    most = (per_level.groupBy("level", *cell).agg(F.sum("_n").alias("_n"))
            .groupBy("level").agg(F.max("_n").alias("m")))
    crowded = {r.level for r in most.where(F.col("m") > leaf).collect()}
    depth = next((i for i, x in enumerate(levels) if x not in crowded), len(levels) - 1)
    return list(levels[:depth + 1])


def nearest_place(points: DataFrame, places: DataFrame, key: str, place_id: str,
                  levels: list[int] | None = None, salts: int = 8) -> DataFrame:
    """Nearest place of every point, at any distance; ties take the lower id.

    Exact best-first search as a few equi joins. Positions go on the unit
    sphere inside an octree of occupied cells. Per level each point keeps the
    cells whose nearest corner could still beat the best farthest corner, then
    joins to their occupied children; the survivors are a handful per point
    however many places there are. Equal positions are reduced to one
    beforehand on both sides, so a pile of copies costs nothing.

    The distinct places are written once to the shared scratch folder: they
    are read per level, and what selects them (a semi join with a large
    measurement table, say) must not run again each time.
    Rows: key, place_id, distance_m.
    """
    position = geo.unit_xyz(F.col("lon"), F.col("lat"))
    spots = places.groupBy("lon", "lat").agg(F.min(place_id).alias(place_id)).withColumn(
        "_c", _finest_cell(position))
    spots = write_stage(spots, scratch_dir(points.sparkSession, "places"))
    levels = levels or octree_depth(spots)

    def bounds(cell: Column, level: int) -> Column:
        low, high = _box_bounds(F.col("_p"), cell, level)
        return F.struct(low.alias("low"), high.alias("high"), cell.alias("cell"))

    def survivors(df: DataFrame, level: int) -> DataFrame:
        """Cells of ``_cells`` that can hold the nearest place, one row each."""
        best = F.array_min(F.transform("_cells", lambda c: c["high"]))
        # distances are compared to the millimetre: a place that much farther may still tie
        best = F.pow(F.sqrt(best) + _MILLIMETRE, 2) * (1 + 1e-9) + 1e-15
        kept = df.withColumn("_best", best).withColumn("_cell", F.explode(F.filter(
            "_cells", lambda c: c["low"] <= F.col("_best"))))
        return kept.select("lon", "lat", position.alias("_p"), F.col("_cell.cell").alias("_at"))

    # first level: the occupied cells are one array of at most 8**level entries
    top = levels[0]
    cells = spots.select(_cell_at(F.col("_c"), top).alias("c")).distinct().agg(F.collect_list("c"))
    live = points.select("lon", "lat").distinct().select(
        "lon", "lat", position.alias("_p"), cells.scalar().alias("_all"))
    live = survivors(live.withColumn("_cells", F.transform("_all", lambda c: bounds(c, top))), top)
    parent = top
    for level in levels[1:]:
        children = spots.select(_cell_at(F.col("_c"), parent).alias("_at"),
                                _cell_at(F.col("_c"), level).alias("_child")).distinct()
        live = salted_join(live, children, ["_at"], "inner", salts)
        live = live.groupBy("lon", "lat").agg(
            F.first("_p").alias("_p"), F.collect_list(bounds(F.col("_child"), level)).alias("_cells"))
        live, parent = survivors(live, level), level
    leaf = spots.select(_cell_at(F.col("_c"), parent).alias("_at"), F.col("lon").alias("_lon"),
                        F.col("lat").alias("_lat"), place_id)
    pairs = salted_join(live.drop("_p"), leaf, ["_at"], "inner", salts).withColumn(
        "distance_m", F.round(geo.haversine_m(
            F.col("lon"), F.col("lat"), F.col("_lon"), F.col("_lat")), 3))
    best = pairs.groupBy("lon", "lat").agg(
        F.min_by(F.struct(place_id, "distance_m"), F.struct("distance_m", place_id)).alias("_b"))
    return (points.select(key, "lon", "lat").join(best, ["lon", "lat"])
            .select(key, F.col(f"_b.{place_id}").alias(place_id),
                    F.col("_b.distance_m").alias("distance_m")))


# ---- tiles ----------------------------------------------------------------

def tiles(areas: DataFrame, area: str, size_m: int) -> DataFrame:
    """Square Web Mercator tiles that overlap each area.

    Whole-metre envelope, tiles clipped at its far sides. Adds ``tile_x0`` ...
    ``tile_y1`` in metres and ``lon0`` ... ``lat1`` in degrees. Tiles that
    contain the whole area do not overlap it and are left out, as in the
    overlap/contains predicate pair of the usual geometry libraries.
    """
    merc = areas.withColumn("_m", geo.mercator_area(F.col(area)))
    merc = merc.withColumn("_e", geo.envelope(F.col("_m")))
    whole = {c: F.col(f"_e.{c}").cast("long") for c in ("min_lon", "min_lat", "max_lon", "max_lat")}
    for c, v in whole.items():
        merc = merc.withColumn(f"_{c}", v)
    start = lambda lo, hi: F.explode(F.sequence(F.col(lo), F.col(hi) - 1, F.lit(size_m).cast("long")))
    t = (merc.where("_max_lon > _min_lon and _max_lat > _min_lat")
         .withColumn("tile_x0", start("_min_lon", "_max_lon"))
         .withColumn("tile_y0", start("_min_lat", "_max_lat"))
         .withColumn("tile_x1", F.least(F.col("tile_x0") + size_m, "_max_lon"))
         .withColumn("tile_y1", F.least(F.col("tile_y0") + size_m, "_max_lat")))
    box = [F.col(c).cast("double") for c in ("tile_x0", "tile_y0", "tile_x1", "tile_y1")]
    e = F.col("_e")
    covers = ((box[0] <= e["min_lon"]) & (box[1] <= e["min_lat"])
              & (box[2] >= e["max_lon"]) & (box[3] >= e["max_lat"]))
    t = t.where(geo.area_meets_box(F.col("_m"), *box) & ~covers)
    return (t.withColumn("lon0", geo.lon_of_mercator(box[0])).withColumn("lat0", geo.lat_of_mercator(box[1]))
            .withColumn("lon1", geo.lon_of_mercator(box[2])).withColumn("lat1", geo.lat_of_mercator(box[3]))
            .drop("_m", "_e", "_min_lon", "_min_lat", "_max_lon", "_max_lat"))
