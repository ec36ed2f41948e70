"""Geometry as plain Spark expressions (EPSG:4326 degrees).

A point is ``struct<lon,lat>``, a ring is ``array<struct<lon,lat>>`` closed on
its first vertex, and an area is ``array<ring>``: outer rings and holes
together, decided by the even-odd rule, which also covers multipolygons.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
MERCATOR_RADIUS_M = 6378137.0
# fixed values: the geohash alphabet
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def rectangle(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Area of one closed rectangular ring."""
    corners = [(lon0, lat0), (lon1, lat0), (lon1, lat1), (lon0, lat1), (lon0, lat0)]
    return F.array(F.array(*[point(x, y) for x, y in corners]))


def is_rectangle(area: Column) -> Column:
    """Whether an area is one closed ring of four corners with upright sides."""
    ring = F.get(area, 0)
    at = lambda i, c: F.get(ring, i)[c]
    upright = F.forall(F.sequence(F.lit(0), F.lit(3)), lambda i:
                       (at(i, "lon") == at(i + 1, "lon")) != (at(i, "lat") == at(i + 1, "lat")))
    corners = F.size(F.array_distinct(F.slice(ring, 1, 4))) == 4
    return F.coalesce((F.size(area) == 1) & (F.size(ring) == 5) & (F.get(ring, 0) == F.get(ring, 4))
                      & corners & upright, F.lit(False))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres on the mean-radius sphere."""
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def unit_xyz(lon: Column, lat: Column) -> Column:
    """Position on the unit sphere; straight-line order equals arc order."""
    return F.struct(
        (F.cos(F.radians(lat)) * F.cos(F.radians(lon))).alias("x"),
        (F.cos(F.radians(lat)) * F.sin(F.radians(lon))).alias("y"),
        F.sin(F.radians(lat)).alias("z"))


def chord_of(metres: float) -> float:
    """Unit-sphere chord of an arc length."""
    return 2 * math.sin(metres / EARTH_RADIUS_M / 2)


def envelope(area: Column) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of all rings."""
    pts = F.flatten(area)
    lons = F.transform(pts, lambda p: p["lon"])
    lats = F.transform(pts, lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("min_lon"), F.array_min(lats).alias("min_lat"),
        F.array_max(lons).alias("max_lon"), F.array_max(lats).alias("max_lat"))


def in_box(lon: Column, lat: Column, min_lon, min_lat, max_lon, max_lat,
           boundary: str = "include") -> Column:
    """Bounding box test; ``exclude`` is 'within', ``include`` is 'intersects'."""
    if boundary == "exclude":
        return (lon > min_lon) & (lon < max_lon) & (lat > min_lat) & (lat < max_lat)
    return lon.between(min_lon, max_lon) & lat.between(min_lat, max_lat)


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _crosses(edge: Column, lon: Column, lat: Column) -> Column:
    """Does a ray to the east of the point cross this edge?"""
    a, b = edge["a"], edge["b"]
    turn = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
    upward = (a["lat"] <= lat) & (lat < b["lat"])
    downward = (b["lat"] <= lat) & (lat < a["lat"])
    return (upward & (turn > 0)) | (downward & (turn < 0))


def _touches(edge: Column, lon: Column, lat: Column) -> Column:
    a, b = edge["a"], edge["b"]
    turn = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
    return ((turn == 0)
            & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"]))
            & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])))


def in_area(lon: Column, lat: Column, area: Column, boundary: str = "exclude") -> Column:
    """Point in polygon or multipolygon with holes.

    ``boundary``: 'exclude' (within) or 'include' (intersects).
    """
    edges = F.flatten(F.transform(area, _edges))
    inside = F.size(F.filter(edges, lambda e: _crosses(e, lon, lat))) % 2 == 1
    on_edge = F.exists(edges, lambda e: _touches(e, lon, lat))
    return (inside & ~on_edge) if boundary == "exclude" else (inside | on_edge)


def centroid(ring: Column) -> Column:
    """Area-weighted centroid of a ring, relative to its first vertex."""
    o = F.get(ring, 0)

    def step(acc: Column, e: Column) -> Column:
        ax, ay = e["a"]["lon"] - o["lon"], e["a"]["lat"] - o["lat"]
        bx, by = e["b"]["lon"] - o["lon"], e["b"]["lat"] - o["lat"]
        w = ax * by - bx * ay
        return F.struct((acc["w"] + w).alias("w"),
                        (acc["x"] + (ax + bx) * w).alias("x"),
                        (acc["y"] + (ay + by) * w).alias("y"))

    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(_edges(ring), zero, step, lambda s: F.when(s["w"] != 0, F.struct(
        (o["lon"] + s["x"] / (3.0 * s["w"])).alias("lon"),
        (o["lat"] + s["y"] / (3.0 * s["w"])).alias("lat"))))


# ---- text forms -----------------------------------------------------------

def rings_from_wkt(wkt: Column) -> Column:
    """POLYGON / MULTIPOLYGON text → area (all rings)."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.transform(rings, _vertices)


def points_from_wkt(wkt: Column) -> Column:
    """POINT / MULTIPOINT text → array of points."""
    body = F.regexp_replace(F.regexp_replace(wkt, r"^[^(]*", ""), r"[()]", "")
    return _vertices(body)


def _vertices(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda pair: F.struct(
        F.get(F.split(F.trim(pair), r"\s+"), 0).cast("double").alias("lon"),
        F.get(F.split(F.trim(pair), r"\s+"), 1).cast("double").alias("lat")))


def wkt_kind(wkt: Column) -> Column:
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "),
                    lat.cast("string"), F.lit(")"))


# fixed values: degrees-minutes-seconds text
_DMS = r"""(\d+)°(\d+)'(\d+(?:\.\d+)?)"([NS]) (\d+)°(\d+)'(\d+(?:\.\d+)?)"([EW])"""
_PAIR = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"


def dms_to_decimal(degrees: Column, minutes: Column, seconds: Column,
                   direction: Column) -> Column:
    size = degrees + minutes / 60 + seconds / 3600
    return F.when(direction.isin("S", "W"), -size).otherwise(size)


def point_from_text(text: Column) -> Column:
    """``D°M'S"N D°M'S"E`` or ``lat,lon`` → point; null when neither."""
    def half(first: int) -> Column:
        part = [F.regexp_extract(text, _DMS, first + i) for i in range(4)]
        num = [F.try_to_number(p, F.lit("999")) for p in part[:2]]
        return dms_to_decimal(num[0].cast("double"), num[1].cast("double"),
                              part[2].try_cast("double"), part[3])
    pair = [F.regexp_extract(text, _PAIR, i).try_cast("double") for i in (1, 2)]
    return (F.when(text.rlike(_DMS), point(half(5), half(1)))
            .when(text.rlike(_PAIR), point(pair[1], pair[0])))


def decimal_to_dms(value: Column, positive: str, negative: str) -> Column:
    size = F.abs(value)
    degrees = F.floor(size)
    minutes_full = (size - degrees) * 60
    minutes = F.floor(minutes_full)
    seconds = F.round((minutes_full - minutes) * 60, 2)
    return F.concat(
        degrees.cast("string"), F.lit("°"), minutes.cast("string"), F.lit("'"),
        seconds.cast("string"), F.lit('"'),
        F.when(value >= 0, positive).otherwise(negative))


# ---- space-filling keys ---------------------------------------------------

def _spread(v: Column) -> Column:
    """Insert a zero bit after each of the low 32 bits."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF),
                        (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
                        (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _cell(value: Column, low: float, span: float, bits: int) -> Column:
    top = (1 << bits) - 1
    cell = F.floor((value - low) / span * (1 << bits)).cast("long")
    return F.least(F.greatest(cell, F.lit(0)), F.lit(top)).cast("long")


def z_key(lon: Column, lat: Column, bits: int = 16) -> Column:
    """Morton key: longitude bits in even, latitude bits in odd places."""
    return _spread(_cell(lon, -180.0, 360.0, bits)).bitwiseOR(
        F.shiftleft(_spread(_cell(lat, -90.0, 180.0, bits)), 1))


def geohash(lon: Column, lat: Column, precision: int = 8) -> Column:
    """Geohash text; an even precision keeps both axes at the same bits."""
    if precision % 2 or precision > 12:
        raise ValueError("precision must be even and at most 12")
    bits = precision * 5 // 2
    key = F.shiftleft(_spread(_cell(lon, -180.0, 360.0, bits)), 1).bitwiseOR(
        _spread(_cell(lat, -90.0, 180.0, bits)))
    letters = [
        F.substring(F.lit(GEOHASH_ALPHABET),
                    (F.shiftright(key, 5 * (precision - 1 - i)).bitwiseAND(F.lit(31))
                     + 1).cast("int"), F.lit(1))
        for i in range(precision)]
    return F.concat(*letters)


# ---- Web Mercator tiles ---------------------------------------------------

def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * MERCATOR_RADIUS_M


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS_M


def lon_of_mercator(x: Column) -> Column:
    return F.degrees(x / MERCATOR_RADIUS_M)


def lat_of_mercator(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR_RADIUS_M)) - math.pi / 2)


def mercator_area(area: Column) -> Column:
    return F.transform(area, lambda ring: F.transform(ring, lambda p: F.struct(
        mercator_x(p["lon"]).alias("lon"), mercator_y(p["lat"]).alias("lat"))))


def _segment_meets_box(edge: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Does the open interior of the box contain part of the segment?

    Slab clipping: the parameter interval of the segment inside each pair of
    parallel sides, intersected.
    """
    a, b = edge["a"], edge["b"]

    def slab(p: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        t0, t1 = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        outside = (d == 0) & ((p <= lo) | (p >= hi))
        near = F.when(outside, F.lit(2.0)).when(d == 0, F.lit(0.0)).otherwise(F.least(t0, t1))
        far = F.when(outside, F.lit(-1.0)).when(d == 0, F.lit(1.0)).otherwise(F.greatest(t0, t1))
        return near, far

    nx, fx = slab(a["lon"], b["lon"] - a["lon"], x0, x1)
    ny, fy = slab(a["lat"], b["lat"] - a["lat"], y0, y1)
    return F.greatest(nx, ny, F.lit(0.0)) < F.least(fx, fy, F.lit(1.0))


def area_meets_box(area: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Do area and box share interior: an edge runs through the box, or one
    lies inside the other."""
    edges = F.flatten(F.transform(area, _edges))
    return (F.exists(edges, lambda e: _segment_meets_box(e, x0, y0, x1, y1))
            | in_area((x0 + x1) / 2, (y0 + y1) / 2, area, "include"))
