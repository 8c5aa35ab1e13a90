"""Geometry as nested arrays, and the column expressions that work on it.

A geometry is ``array<array<array<struct<x,y>>>>``: polygons, rings, points; ring 0 is
the shell and every ring is closed. Everything here stays on the JVM side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_TYPE = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS_TYPE = T.ArrayType(T.ArrayType(POINT_TYPE))
GEOMETRY_TYPE = T.ArrayType(RINGS_TYPE)

# --- fixed values -----------------------------------------------------------
EARTH_RADIUS = 6378137.0
MERCATOR_LIMIT = 20037508.342789244
WGS84_FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0
PAD_MIN_DEGREES = 0.005
SEARCH_PAD_SHARE, SEARCH_PAD_MIN, SEARCH_PAD_TOTAL = 0.2, 0.01, 0.5
AOI_MIN_METRES = 500.0
DENSIFY_POINTS = 21
BIG_BODY_KM2 = 250.0
BIG_PART_MIN_M2, BIG_SIMPLIFY_M = 100000.0, 30.0
SMALL_PART_MIN_M2, SMALL_SIMPLIFY_M = 500.0, 2.0
OPEN_RADIUS_M, CLOSE_RADIUS_M = 5.0, 8.0
# ----------------------------------------------------------------------------


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_polygon(w: Column, s: Column, e: Column, n: Column) -> Column:
    ring = F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))
    return F.array(F.array(ring))


def is_empty(geom: Column) -> Column:
    return geom.isNull() | (F.size(F.flatten(F.flatten(geom))) <= 0)


def map_points(geom: Column, fn) -> Column:
    return F.transform(geom, lambda poly: F.transform(poly, lambda ring: F.transform(ring, fn)))


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(MERCATOR_LIMIT / 180.0)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.radians(lat / 2 + 45.0))) * F.lit(EARTH_RADIUS)


def mercator_lon(x: Column) -> Column:
    return x * F.lit(180.0 / MERCATOR_LIMIT)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.exp(y / F.lit(EARTH_RADIUS)))) * 2 - 90.0


def to_mercator(geom: Column) -> Column:
    return map_points(geom, lambda p: point(mercator_x(p["x"]), mercator_y(p["y"])))


def to_lonlat(geom: Column) -> Column:
    return map_points(geom, lambda p: point(mercator_lon(p["x"]), mercator_lat(p["y"])))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area, measured from the first vertex to keep the digits."""

    def sweep(r: Column) -> Column:
        origin = F.get(r, F.lit(0))
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def step(acc: Column, p: Column) -> Column:
            x, y = p["x"] - origin["x"], p["y"] - origin["y"]
            return F.struct(
                (acc["sum"] + acc["x"] * y - x * acc["y"]).alias("sum"), x.alias("x"), y.alias("y")
            )

        return F.aggregate(r, start, step, lambda acc: acc["sum"] / 2)

    return bind(ring, sweep)


def planar_area(geom: Column) -> Column:
    """Shell minus holes, summed over the polygons; zero for NULL or empty."""
    total = F.aggregate(
        geom,
        F.lit(0.0),
        lambda acc, poly: acc
        + F.aggregate(
            F.transform(poly, lambda ring, i: F.abs(ring_area(ring)) * F.when(i == 0, 1.0).otherwise(-1.0)),
            F.lit(0.0),
            lambda a, v: a + v,
        ),
    )
    return F.coalesce(total, F.lit(0.0))


def area_km2(geom: Column) -> Column:
    """Area in the mercator plane, in km2, as the data contract wants it."""
    return planar_area(to_mercator(geom)) / 1e6


def stable_area(area: Column) -> Column:
    """Area as a sort key: equal to the square metre means equal."""
    return F.round(area, 6)


def bounds(geom: Column) -> Column:
    pts = F.flatten(F.flatten(geom))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("xmin"),
        F.array_min(ys).alias("ymin"),
        F.array_max(xs).alias("xmax"),
        F.array_max(ys).alias("ymax"),
    )


def bbox_columns(geom: Column, prefix: str = "bbox_") -> dict[str, Column]:
    b = bounds(geom)
    return {
        f"{prefix}west": b["xmin"],
        f"{prefix}south": b["ymin"],
        f"{prefix}east": b["xmax"],
        f"{prefix}north": b["ymax"],
    }


def padded_bounds(w: Column, s: Column, e: Column, n: Column, share: float, least: float = PAD_MIN_DEGREES) -> Column:
    px = F.greatest((e - w) * share, F.lit(least))
    py = F.greatest((n - s) * share, F.lit(least))
    return F.struct((w - px).alias("xmin"), (s - py).alias("ymin"), (e + px).alias("xmax"), (n + py).alias("ymax"))


def search_bounds(w: Column, s: Column, e: Column, n: Column) -> Column:
    return padded_bounds(w, s, e, n, SEARCH_PAD_SHARE, SEARCH_PAD_MIN)


def mercator_bounds(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Each axis is monotone, so a box stays a box."""
    return F.struct(
        mercator_x(w).alias("xmin"), mercator_y(s).alias("ymin"), mercator_x(e).alias("xmax"), mercator_y(n).alias("ymax")
    )


def aoi_distance(w: Column, s: Column, e: Column, n: Column, padding: float | Column) -> Column:
    """Buffer distance of a body's area of interest, in mercator metres."""
    m = mercator_bounds(w, s, e, n)
    longest = F.greatest(m["xmax"] - m["xmin"], m["ymax"] - m["ymin"])
    pad = padding if isinstance(padding, Column) else F.lit(float(padding))
    return F.greatest(longest * pad, F.lit(AOI_MIN_METRES))


def aoi_bounds(w: Column, s: Column, e: Column, n: Column, padding: float | Column) -> Column:
    m, d = mercator_bounds(w, s, e, n), aoi_distance(w, s, e, n, padding)
    return F.struct(
        mercator_lon(m["xmin"] - d).alias("xmin"),
        mercator_lat(m["ymin"] - d).alias("ymin"),
        mercator_lon(m["xmax"] + d).alias("xmax"),
        mercator_lat(m["ymax"] + d).alias("ymax"),
    )


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Open-interval test: boxes that only touch do not overlap."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def boxes_touch(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Closed-interval test."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def xyz_bounds(z: Column, x: Column, y: Column) -> Column:
    size = F.lit(2 * MERCATOR_LIMIT) / F.pow(F.lit(2.0), z)
    left, top = x * size - MERCATOR_LIMIT, F.lit(MERCATOR_LIMIT) - y * size
    return F.struct(left.alias("left"), (top - size).alias("bottom"), (left + size).alias("right"), top.alias("top"))


def xyz_range(z: Column, w: Column, s: Column, e: Column, n: Column) -> Column:
    """Web-tile index range that a lon/lat box reaches at zoom z."""
    tiles = F.pow(F.lit(2.0), z)
    size = F.lit(2 * MERCATOR_LIMIT) / tiles
    m = mercator_bounds(w, s, e, n)

    def cell(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(F.round(v, 9)).cast("int"), (tiles - 1).cast("int")))

    return F.struct(
        cell((m["xmin"] + MERCATOR_LIMIT) / size).alias("x0"),
        cell((m["xmax"] + MERCATOR_LIMIT) / size).alias("x1"),
        cell((F.lit(MERCATOR_LIMIT) - m["ymax"]) / size).alias("y0"),
        cell((F.lit(MERCATOR_LIMIT) - m["ymin"]) / size).alias("y1"),
    )


def polygon_parts(geom: Column) -> Column:
    """Non-empty polygons of a multi-polygon, ready for ``explode``."""
    return F.filter(geom, lambda poly: F.size(poly) > 0)


def drop_small_parts(geom: Column, min_area: float) -> Column:
    """Drop polygons below an area, unless that would drop all of them."""
    kept = F.filter(geom, lambda poly: planar_area(F.array(poly)) >= min_area)
    return F.when(F.size(kept) > 0, kept).otherwise(geom)


def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn``; higher-order functions do not
    share common subexpressions, so a repeated operand would be computed again."""
    return F.transform(F.array(value), fn)[0]


def _cut_corners(ring: Column) -> Column:
    last = F.size(ring) - 1
    cut = F.flatten(
        F.zip_with(
            F.slice(ring, F.lit(1), last),
            F.slice(ring, F.lit(2), last),
            lambda p, q: F.array(
                point(p["x"] * 0.75 + q["x"] * 0.25, p["y"] * 0.75 + q["y"] * 0.25),
                point(p["x"] * 0.25 + q["x"] * 0.75, p["y"] * 0.25 + q["y"] * 0.75),
            ),
        )
    )
    return bind(cut, lambda c: F.concat(c, F.slice(c, 1, 1)))


def chaikin_ring(ring: Column, rounds: int = 2) -> Column:
    """Corner cutting on a closed ring; rings below four points stay as they are."""
    out = ring
    for _ in range(rounds):
        out = bind(out, _cut_corners)
    return F.when(F.size(ring) >= 4, out).otherwise(ring)


def chaikin(geom: Column, rounds: int = 2) -> Column:
    return F.transform(geom, lambda poly: F.transform(poly, lambda ring: chaikin_ring(ring, rounds)))


def geojson(geom: Column) -> Column:
    """GeoJSON text of a geometry; one polygon is a Polygon, several a MultiPolygon."""
    coords = F.transform(
        geom, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    )
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), coords[0].alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))
    return F.when(F.size(geom) == 1, single).when(F.size(geom) > 1, multi)


def from_coordinates(coords: Column) -> Column:
    """array<array<array<array<double>>>> to a 2-D geometry; a third ordinate is dropped."""
    return F.transform(
        coords, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: point(p[0], p[1])))
    )


def _krueger_constants() -> dict[str, list[float] | float]:
    n = WGS84_FLATTENING / (2 - WGS84_FLATTENING)
    a = EARTH_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    return {"n": n, "a": a, "alpha": alpha, "beta": beta, "delta": delta}


def utm_to_lonlat(easting: Column, northing: Column, zone: Column, south: Column | None = None) -> Column:
    """Inverse transverse mercator (Krueger series) as a struct<lon,lat>."""
    k = _krueger_constants()
    base = F.when(south, UTM_FALSE_NORTHING_SOUTH).otherwise(0.0) if south is not None else F.lit(0.0)
    xi = (northing - base) / F.lit(UTM_SCALE * k["a"])
    eta = (easting - UTM_FALSE_EASTING) / F.lit(UTM_SCALE * k["a"])

    # Each step is bound once: columns that name each other would be worked out anew at
    # every place, some hundred sines a point.
    def bent(p: Column) -> Column:
        xi1, eta1 = p["a"], p["b"]
        for j, b in enumerate(k["beta"], 1):
            xi1 = xi1 - F.sin(p["a"] * (2 * j)) * F.cosh(p["b"] * (2 * j)) * b
            eta1 = eta1 - F.cos(p["a"] * (2 * j)) * F.sinh(p["b"] * (2 * j)) * b
        return F.struct(xi1.alias("a"), eta1.alias("b"))

    def raised(p: Column) -> Column:
        chi = F.asin(F.sin(p["a"]) / F.cosh(p["b"]))
        return F.struct(chi.alias("chi"), F.atan2(F.sinh(p["b"]), F.cos(p["a"])).alias("lam"))

    def placed(p: Column) -> Column:
        lat = p["chi"]
        for j, d in enumerate(k["delta"], 1):
            lat = lat + F.sin(p["chi"] * (2 * j)) * d
        return F.struct((F.degrees(p["lam"]) + (zone * 6 - 183)).alias("lon"), F.degrees(lat).alias("lat"))

    steps = F.array(F.struct(xi.alias("a"), eta.alias("b")))
    for step in (bent, raised, placed):
        steps = F.transform(steps, step)
    return steps[0]


def lonlat_to_utm(lon: Column, lat: Column, zone: Column, south: Column | None = None) -> Column:
    """Transverse mercator (Krueger series) as a struct<easting,northing>."""
    k = _krueger_constants()
    ecc = 2 * math.sqrt(k["n"]) / (1 + k["n"])
    phi = F.radians(lat)
    lam = F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * ecc) * ecc)
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    xi1, eta1 = xi, eta
    for j, a in enumerate(k["alpha"], 1):
        xi1 = xi1 + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
        eta1 = eta1 + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
    base = F.when(south, UTM_FALSE_NORTHING_SOUTH).otherwise(0.0) if south is not None else F.lit(0.0)
    return F.struct(
        (eta1 * (UTM_SCALE * k["a"]) + UTM_FALSE_EASTING).alias("easting"),
        (xi1 * (UTM_SCALE * k["a"]) + base).alias("northing"),
    )


def utm_box_footprint(
    left: Column, bottom: Column, right: Column, top: Column, zone: Column, corners_only: bool = False
) -> Column:
    """Lon/lat box of a UTM box: from its corners, or from densified edges."""
    n = 1 if corners_only else DENSIFY_POINTS + 1
    # The end of an edge is the begin of the next one.
    steps = F.sequence(F.lit(0), F.lit(n - 1))

    def along(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.transform(
            steps, lambda i: utm_to_lonlat(x0 + (x1 - x0) * i / n, y0 + (y1 - y0) * i / n, zone)
        )

    pts = F.concat(
        along(left, bottom, right, bottom),
        along(right, bottom, right, top),
        along(right, top, left, top),
        along(left, top, left, bottom),
    )
    lons, lats = F.transform(pts, lambda p: p["lon"]), F.transform(pts, lambda p: p["lat"])
    return F.struct(
        F.array_min(lons).alias("west"),
        F.array_min(lats).alias("south"),
        F.array_max(lons).alias("east"),
        F.array_max(lats).alias("north"),
    )
