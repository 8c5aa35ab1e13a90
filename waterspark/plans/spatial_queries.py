"""Spatial joins, coverage, clipping, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waterspark.functions import geometry as G
from waterspark.operators import catalog, context
from waterspark.operators import spatial_join as S
from waterspark.plans.fixtures import HIT, OVERLAP, cte, fixture, m_table, with_boxes
from waterspark.plans.registry import query


def water(spark: SparkSession, sf: str) -> DataFrame:
    return with_boxes(fixture(spark, sf, "fx_water"))


def refs(spark: SparkSession, sf: str) -> DataFrame:
    return with_boxes(fixture(spark, sf, "fx_ref"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return with_boxes(fixture(spark, sf, "fx_tiles"))


M = {"a0": m_table("fx_water"), "b0": m_table("fx_ref"), "t0": m_table("fx_tiles")}


@query(
    "overlap_pairs",
    cte("fx_water", "fx_ref", more={"a0": M["a0"], "b0": M["b0"]})
    + f"SELECT a.k, b.hylak_id, round({OVERLAP}/1e6, 6) AS overlap_km2 FROM a0 a JOIN b0 b ON {HIT}",
)
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.overlap_pairs(water(spark, sf), refs(spark, sf), "k", "hylak_id")
    return pairs.select("k", "hylak_id", F.round(F.col("overlap_m2") / 1e6, 6).alias("overlap_km2"))


_TRI = """SELECT k, hylak_id, round((greatest(0e0, least(r, xd) - l)*(d-c)
      + CASE WHEN greatest(l, xd) < least(r, xc) THEN (least(r,xc)-greatest(l,xd))*((y0 + s*(ax1-greatest(l,xd)) - c) + (y0 + s*(ax1-least(r,xc)) - c))/2 ELSE 0e0 END)/1e6, 4) AS overlap_km2
    FROM (SELECT *, ax1 - (c-y0)/s AS xc, ax1 - (d-y0)/s AS xd FROM
      (SELECT a.k, b.hylak_id, a.y0, a.x1 AS ax1, (a.y1-a.y0)/(a.x1-a.x0) AS s, greatest(a.x0,b.x0) AS l, least(a.x1,b.x1) AS r,
       greatest(a.y0,b.y0) AS c, b.y1 AS d FROM a0 a JOIN b0 b ON {hit}))"""


@query(
    "overlap_triangles",
    cte("fx_water", "fx_ref", more={"a0": M["a0"], "b0": M["b0"], "tri": _TRI.format(hit=HIT)})
    + "SELECT * FROM tri WHERE overlap_km2 > 0",
)
def overlap_triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Right triangles against boxes: real outlines through clipping and the kernel."""
    p = G.point
    w, s, e, n = (F.col(c) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north"))
    tri = water(spark, sf).withColumn("geometry", F.array(F.array(F.array(p(w, s), p(e, s), p(w, n), p(w, s)))))
    pairs = S.overlap_pairs(tri, refs(spark, sf), "k", "hylak_id")
    out = pairs.select("k", "hylak_id", F.round(F.col("overlap_m2") / 1e6, 4).alias("overlap_km2"))
    return out.where("overlap_km2 > 0")


@query(
    "touching_pairs",
    cte("fx_water", "fx_ref", more={"a0": M["a0"], "b0": M["b0"]})
    + f"""SELECT a.k, b.hylak_id, {OVERLAP} > 0 AS overlaps FROM a0 a JOIN b0 b
    ON a.w100 <= b.w100+b.dx AND a.w100+a.dx >= b.w100 AND a.s100 <= b.s100+b.dy AND a.s100+a.dy >= b.s100""",
)
def touching_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.touching_pairs(water(spark, sf), refs(spark, sf), "k", "hylak_id")
    return pairs.select("k", "hylak_id", (F.col("overlap_m2") > 0).alias("overlaps"))


@query(
    "within_distance",
    cte("fx_water", "fx_ref", more={"a0": M["a0"], "b0": M["b0"]})
    + """SELECT * FROM (SELECT a.k, b.hylak_id, round(sqrt(pow(greatest(0e0, b.x0-a.x1, a.x0-b.x1), 2) + pow(greatest(0e0, b.y0-a.y1, a.y0-b.y1), 2)), 3) AS distance_m
    FROM a0 a JOIN b0 b ON b.x0 - a.x1 <= 3000 AND a.x0 - b.x1 <= 3000 AND b.y0 - a.y1 <= 3000 AND a.y0 - b.y1 <= 3000) WHERE distance_m <= 3000""",
)
def within_distance(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.near_pairs(water(spark, sf), refs(spark, sf), "k", "hylak_id", 3000.0)
    return pairs.select("k", "hylak_id", F.round("distance_m", 3).alias("distance_m"))


@query(
    "lake_tiles",
    cte("fx_water", "fx_tiles", more={"a0": M["a0"], "b0": M["t0"]})
    + f"""SELECT w.lake_uid, coalesce(p.tiles, '') AS sentinel_tiles FROM fx_water w LEFT JOIN
    (SELECT k, string_agg(tile, ',' ORDER BY ov DESC, tile) AS tiles FROM (SELECT a.k, b.tile, {OVERLAP} AS ov FROM a0 a JOIN b0 b ON {HIT}) WHERE ov > 0 GROUP BY k) p ON w.k = p.k""",
)
def lake_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.attach_tiles(water(spark, sf), grid(spark, sf)).select("lake_uid", "sentinel_tiles")


def required_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bodies, and every tile either in the grid or, in its holes, as a footprint."""
    bodies = water(spark, sf).withColumn(
        "sentinel_tiles", F.when(F.col("k") % 4 == 0, F.concat(F.lit("49RZZ, "), F.lit("49RY"), F.col("k") % 3)).otherwise("")
    )
    tiles = grid(spark, sf).withColumn("row", F.ascii(F.substring("tile", 5, 1)) - 65).withColumn(
        "col", F.ascii(F.substring("tile", 4, 1)) - 65
    )
    return bodies, tiles.where("(col + row) % 3 <> 0"), tiles.where("(col + row) % 3 = 0")


REQUIRED = {
    "a0": M["a0"],
    "tt": "SELECT *, ascii(substr(tile,4,1))-65 AS tcol, ascii(substr(tile,5,1))-65 AS trow FROM fx_tiles",
    "b0": m_table("(SELECT * FROM tt WHERE (tcol+trow) % 3 <> 0)"),
    "f0": m_table("(SELECT * FROM tt WHERE (tcol+trow) % 3 = 0)"),
    "opt": f"""SELECT lake_uid, 0 AS prio, tile, -coverage AS srt, coverage FROM (SELECT a.lake_uid, b.tile, {OVERLAP}/a.m2 AS coverage FROM a0 a JOIN b0 b ON {HIT} WHERE {OVERLAP} > 0)
    UNION ALL SELECT lake_uid, 1, '49RZZ', 0, 0 FROM a0 WHERE k % 4 = 0 UNION ALL SELECT lake_uid, 1, concat('49RY', k % 3), 1, 0 FROM a0 WHERE k % 4 = 0
    UNION ALL SELECT a.lake_uid, 2, b.tile, 0, 0 FROM a0 a JOIN f0 b ON a.w100 <= b.w100+b.dx AND a.w100+a.dx >= b.w100 AND a.s100 <= b.s100+b.dy AND a.s100+a.dy >= b.s100""",
    "req": """SELECT lake_uid, tile, coverage, row_number() OVER (PARTITION BY lake_uid ORDER BY srt, tile) AS seq
    FROM (SELECT *, min(prio) OVER (PARTITION BY lake_uid) AS best FROM opt) WHERE prio = best""",
}


@query(
    "required_tiles",
    cte("fx_water", "fx_tiles", more=REQUIRED)
    + "SELECT lake_uid, tile, round(coverage, 6) AS coverage, cast(seq AS INT) AS seq FROM req",
)
def required_tiles(spark: SparkSession, sf: str) -> DataFrame:
    req = context.required_tiles(*required_inputs(spark, sf))
    return req.withColumn("coverage", F.round("coverage", 6))


@query(
    "ref_match_best",
    cte("fx_water", "fx_ref", more={"a0": M["a0"], "b0": M["b0"]})
    + f"""SELECT k, hylak_id, round(ov/1e6, 6) AS overlap_km2 FROM (SELECT a.k, b.hylak_id, {OVERLAP} AS ov, row_number() OVER (PARTITION BY a.k ORDER BY {OVERLAP} DESC, b.hylak_id) AS rn
    FROM a0 a JOIN b0 b ON a.w100 <= b.w100+b.dx AND a.w100+a.dx >= b.w100 AND a.s100 <= b.s100+b.dy AND a.s100+a.dy >= b.s100) WHERE rn = 1""",
)
def ref_match_best(spark: SparkSession, sf: str) -> DataFrame:
    best = catalog.best_reference(water(spark, sf), refs(spark, sf), key="k")
    return best.select("k", "hylak_id", F.round(F.col("overlap_m2") / 1e6, 6).alias("overlap_km2"))


@query(
    "ref_match_overlap",
    cte("fx_water", "fx_ref", more={"a0": M["a0"], "b0": M["b0"]})
    + f"""SELECT k, hylak_id, round(ov/1e6, 6) AS overlap_km2 FROM (SELECT a.k, b.hylak_id, {OVERLAP} AS ov, row_number() OVER (PARTITION BY a.k ORDER BY {OVERLAP} DESC, b.hylak_id) AS rn
    FROM a0 a JOIN b0 b ON {HIT} WHERE {OVERLAP} > 0 AND a.lake_uid IN (SELECT lake_id FROM fx_products)) WHERE rn = 1""".replace("fx_products", "(SELECT concat('hunan_osm_', o_custkey) AS lake_id FROM orders WHERE o_orderkey % 4 = 0)"),
)
def ref_match_overlap(spark: SparkSession, sf: str) -> DataFrame:
    asked = fixture(spark, sf, "fx_products").where("lake_id <> ''").select(F.col("lake_id").alias("lake_uid"))
    bodies = water(spark, sf)
    best = catalog.reference_overlap(bodies, refs(spark, sf), asked)
    return best.join(bodies.select("lake_uid", "k"), "lake_uid").select(
        "k", "hylak_id", F.round(F.col("overlap_m2") / 1e6, 6).alias("overlap_km2")
    )


_IMG = """SELECT l_orderkey % 97 AS folder, l_orderkey*10 + l_linenumber AS image_id, concat('img_', l_orderkey, '_', l_linenumber,
    CASE WHEN l_linenumber % 3 = 0 THEN '_T49RBB_x.img' ELSE '.img' END) AS file,
    10850 + 15*(l_orderkey % 97 % 40) + cast(l_partkey % 5 AS int) AS w100, 2450 + 14*((l_orderkey % 97 * 7) % 41) + cast(l_suppkey % 4 AS int) AS s100,
    cast(3 + l_partkey % 3 AS int) AS dx, cast(3 + l_suppkey % 2 AS int) AS dy FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber)"""


@query(
    "image_union_area",
    cte(more={"img": "SELECT DISTINCT folder, w100, s100, dx, dy FROM (" + _IMG.format(lineitem="lineitem") + ")"})
    + """, px AS (SELECT DISTINCT folder, w100 + i AS cx, s100 + j AS cy FROM img, LATERAL (SELECT unnest(generate_series(0, dx-1)) AS i), LATERAL (SELECT unnest(generate_series(0, dy-1)) AS j))
    SELECT folder, round(sum((1/100e0*111319.49079327357)*(ln(tan(radians((cy+1)/100e0/2+45e0))) - ln(tan(radians(cy/100e0/2+45e0))))*6378137e0)/1e6, 5) AS area_km2 FROM px GROUP BY folder""".replace(
        "(cy+1)", "(cy+1)"
    ),
)
def image_union_area(spark: SparkSession, sf: str) -> DataFrame:
    img = with_boxes(spark.sql(_IMG, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet")))
    parts = catalog.union_boxes(img, "folder")
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / 1e6
    return parts.groupBy("folder").agg(F.round(area, 5).alias("area_km2"))


_PIXEL_M2 = "(1/100e0*111319.49079327357)*((ln(tan(radians(({y}+1)/100e0/2+45e0))) - ln(tan(radians({y}/100e0/2+45e0))))*6378137e0)"


@query(
    "image_water_match",
    cte(
        "fx_water",
        "fx_ref",
        more={
            "img": "SELECT DISTINCT folder, w100, s100, dx, dy FROM (" + _IMG.format(lineitem="lineitem") + ")",
            "px": """SELECT DISTINCT folder, w100 + i AS cx, s100 + j AS cy FROM img, LATERAL (SELECT unnest(generate_series(0, dx-1)) AS i), LATERAL (SELECT unnest(generate_series(0, dy-1)) AS j)""",
            "src": f"""SELECT 0 AS prio, k AS id, m2/1e6 AS area_km2, w100, s100, dx, dy FROM ({M['a0']}) UNION ALL
              SELECT 1, hylak_id, m2/1e6, w100, s100, dx, dy FROM ({M['b0']})""",
            "ov": f"""SELECT folder, prio, id, area_km2, round(sum({_PIXEL_M2.format(y='cy')}), 2) AS ov FROM px JOIN src
              ON cx >= w100 AND cx < w100+dx AND cy >= s100 AND cy < s100+dy GROUP BY folder, prio, id, area_km2""",
            "best": """SELECT *, row_number() OVER (PARTITION BY folder ORDER BY prio, ov DESC, area_km2 DESC, id) AS rn FROM ov WHERE ov/1e6 > CASE WHEN prio = 0 THEN 0 ELSE 10 END""",
            "own": f"SELECT folder, sum({_PIXEL_M2.format(y='cy')})/1e6 AS area FROM px GROUP BY folder",
        },
    )
    + """SELECT o.folder, CASE WHEN b.prio = 0 THEN 'osm' WHEN b.prio = 1 THEN 'hydrolakes' ELSE 'img_bounds' END AS source_primary, b.id AS match_id,
    round(coalesce(b.area_km2, o.area), 4) AS area_km2, round(b.ov/1e6, 4) AS overlap_km2 FROM own o LEFT JOIN best b ON o.folder = b.folder AND b.rn = 1""",
)
def image_water_match(spark: SparkSession, sf: str) -> DataFrame:
    img = with_boxes(spark.sql(_IMG, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet")))
    osm = water(spark, sf).select(F.col("k").alias("id"), "geometry")
    ref = refs(spark, sf).select(F.col("hylak_id").alias("id"), "geometry")
    sized = [d.withColumn("area_km2", G.area_km2(F.col("geometry"))) for d in (osm, ref)]
    out = catalog.match_image_areas(img, *sized, key="folder", min_area_km2=10.0)
    return out.withColumns({c: F.round(c, 4) for c in ("area_km2", "overlap_km2")})


@query(
    "image_tile",
    cte(
        "fx_tiles",
        more={
            "img": _IMG.format(lineitem="lineitem"),
            "a0": m_table("(SELECT * FROM img WHERE NOT contains(file, '_T49R'))"),
            "b0": M["t0"],
            "top": f"SELECT image_id, tile, row_number() OVER (PARTITION BY image_id ORDER BY {OVERLAP} DESC, tile) AS rn FROM a0 a JOIN b0 b ON {HIT} WHERE {OVERLAP} > 0",
        },
    )
    + """SELECT i.image_id, CASE WHEN contains(file, '_T49R') THEN '49RBB' ELSE coalesce(t.tile, '') END AS tile
    FROM img i LEFT JOIN top t ON i.image_id = t.image_id AND t.rn = 1""",
)
def image_tile(spark: SparkSession, sf: str) -> DataFrame:
    img = with_boxes(spark.sql(_IMG, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet")))
    return catalog.image_tiles(img, grid(spark, sf)).select("image_id", "tile")


_BIG = {"a0": M["a0"], "b0": M["b0"]}
_CTX_SQL = """, d0 AS (SELECT *, greatest(greatest(x1-x0, y1-y0)*0.83, 500) AS d FROM a0),
    p AS (SELECT a.k, b.{bk} AS other_id, b.{ba} AS area_km2, sqrt(pow(greatest(0e0, b.x0-a.x1, a.x0-b.x1), 2) + pow(greatest(0e0, b.y0-a.y1, a.y0-b.y1), 2)) AS dist, a.d,
      {ov} AS ov, a.m2 AS am2, b.m2 AS bm2, (greatest(0e0, least(b.x1, a.x1+a.d) - greatest(b.x0, a.x0-a.d))*greatest(0e0, least(b.y1, a.y1+a.d) - greatest(b.y0, a.y0-a.d)))/1e6 AS clipped_km2
      FROM d0 a JOIN {b} b ON b.x0 - a.x1 <= a.d AND a.x0 - b.x1 <= a.d AND b.y0 - a.y1 <= a.d AND a.y0 - b.y1 <= a.d WHERE {where})
    SELECT k, other_id, cast(rn AS INT) AS rank, round(clipped_km2, 4) AS clipped_km2 FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(area_km2, 6) DESC, other_id) AS rn FROM p WHERE dist <= d {more}) WHERE rn <= 5"""


@query(
    "context_osm",
    cte("fx_water", more={"a0": "SELECT *, m2/1e6 AS akm FROM (" + M["a0"] + ")"})
    + _CTX_SQL.format(
        bk="k", ba="akm", ov=OVERLAP, b="a0",
        where="(b.other_tags IS NULL OR (NOT contains(b.other_tags, '\"water\"=>\"river\"') AND NOT contains(b.other_tags, '\"water\"=>\"canal\"'))) AND b.akm >= 20 AND a.k <> b.k",
        more="AND NOT (ov > am2*0.9 AND ov > bm2*0.9)",
    ),
)
def context_osm(spark: SparkSession, sf: str) -> DataFrame:
    raw = water(spark, sf).withColumn("area_km2", G.area_km2(F.col("geometry")))
    plain = raw.withColumns({"osm_id": F.col("k").cast("string"), "osm_way_id": F.lit(None).cast("string")})
    bodies = plain.withColumns({"osm_id_text": F.col("osm_id"), "osm_way_id_text": F.col("osm_way_id")})
    others = plain.withColumn("other_id", F.col("k"))
    shown = context.context_water(bodies, others, key="k", padding=0.83, min_area_km2=20.0, limit=5, clip=True)
    return shown.select("k", "other_id", "rank", F.round(G.area_km2(F.col("geometry")), 4).alias("clipped_km2"))


@query(
    "context_ref",
    cte("fx_water", "fx_ref", more=_BIG)
    + _CTX_SQL.format(
        bk="hylak_id", ba="lake_area", ov=OVERLAP, b="b0", where="b.lake_area >= 1 AND b.hylak_id <> a.k % 50 + 1", more=""
    ),
)
def context_ref(spark: SparkSession, sf: str) -> DataFrame:
    bodies = water(spark, sf).withColumns(
        {"area_km2": G.area_km2(F.col("geometry")), "hylak_id": F.col("k") % 50 + 1}
    )
    others = refs(spark, sf).withColumns({"other_id": F.col("hylak_id"), "area_km2": F.col("lake_area")}).drop("hylak_id")
    shown = context.context_reference(bodies, others, key="k", padding=0.83, limit=5, clip=True)
    return shown.select("k", "other_id", "rank", F.round(G.area_km2(F.col("geometry")), 4).alias("clipped_km2"))


@query(
    "box_overlap",
    cte("fx_water", "fx_ref")
    + """SELECT a.k, b.hylak_id FROM fx_water a JOIN fx_ref b ON a.w100 < b.w100+b.dx AND a.w100+a.dx > b.w100 AND a.s100 < b.s100+b.dy AND a.s100+a.dy > b.s100""",
)
def box_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return S.box_pairs(water(spark, sf), refs(spark, sf), "k", "hylak_id", closed=False)


@query(
    "clip_to_aoi",
    cte("fx_water", "fx_tiles")
    + """SELECT a.k, b.tile, round(greatest(a.w100, b.w100)/100e0, 6) AS west, round(greatest(a.s100, b.s100)/100e0, 6) AS south,
    round(least(a.w100+a.dx, b.w100+b.dx)/100e0, 6) AS east, round(least(a.s100+a.dy, b.s100+b.dy)/100e0, 6) AS north, 1 AS parts
    FROM fx_water a JOIN fx_tiles b ON a.w100 < b.w100+b.dx AND a.w100+a.dx > b.w100 AND a.s100 < b.s100+b.dy AND a.s100+a.dy > b.s100""",
)
def clip_to_aoi(spark: SparkSession, sf: str) -> DataFrame:
    bodies, tiles = water(spark, sf), grid(spark, sf)
    pairs = S.box_pairs(bodies, tiles, "k", "tile", closed=False)
    box = tiles.select("tile", *[F.col(c).alias(f"t_{c[5:]}") for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north")])
    cut = pairs.join(bodies.select("k", "geometry"), "k").join(box, "tile").withColumn(
        "g", context.clip_to_box(F.col("geometry"), F.col("t_west"), F.col("t_south"), F.col("t_east"), F.col("t_north"))
    )
    b = G.bounds(F.col("g"))
    return cut.select(
        "k", "tile", *[F.round(b[c], 6).alias(n) for c, n in (("xmin", "west"), ("ymin", "south"), ("xmax", "east"), ("ymax", "north"))],
        F.size("g").alias("parts"),
    )


@query(
    "total_and_extent",
    cte("fx_water")
    + """SELECT count(*) AS total, min(w100)/100e0 - 0.5 AS t_west, min(s100)/100e0 - 0.5 AS t_south, max(w100+dx)/100e0 + 0.5 AS t_east, max(s100+dy)/100e0 + 0.5 AS t_north FROM fx_water""",
)
def total_and_extent(spark: SparkSession, sf: str) -> DataFrame:
    bodies = water(spark, sf)
    extent = catalog.total_extent(bodies, pad=0.5)
    return extent.withColumn("total", bodies.agg(F.count(F.lit(1))).scalar())
