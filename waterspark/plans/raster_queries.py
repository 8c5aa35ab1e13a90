"""Masks, mosaics, regions and layers over the pixel fixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterspark.functions import clean as C
from waterspark.functions import geometry as G
from waterspark.operators import blocks, raster, regions
from waterspark.plans.fixtures import cte, fixture, with_boxes, m_table
from waterspark.plans.registry import query
from waterspark.session import cut_lineage, new_shared_path


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_pixels")


@query("valid_ratio", cte("fx_pixels") + "SELECT raster_id, round(count(*) FILTER (WHERE band1 <> 0 OR occurrence > 90)/count(*), 6) AS valid_ratio FROM fx_pixels GROUP BY raster_id")
def valid_ratio(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).withColumn("band2", F.greatest(F.col("occurrence") - 90, F.lit(0)))
    return raster.valid_ratio(p, ["raster_id"], ["band1", "band2"]).withColumn("valid_ratio", F.round("valid_ratio", 6))


@query(
    "valid_ratio_decimated",
    cte("fx_pixels")
    + """SELECT raster_id, round(count(*) FILTER (WHERE band1 <> 0)/count(*), 6) AS valid_ratio FROM fx_pixels WHERE prow % 4 = 2 AND pcol % 4 = 2 GROUP BY raster_id""",
)
def valid_ratio_decimated(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).withColumns({"height": F.lit(128), "width": F.lit(128)})
    got = raster.valid_ratio(raster.decimate(p, max_dim=32), ["raster_id"], ["band1"])
    return got.withColumn("valid_ratio", F.round("valid_ratio", 6))


@query("class_mask", cte("fx_pixels") + "SELECT raster_id, prow, pcol, cast(landcover = 80 AS INT) AS water FROM fx_pixels")
def class_mask(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("raster_id", "prow", "pcol", raster.class_mask(F.col("landcover")).alias("water"))


@query(
    "threshold_mask",
    cte("fx_pixels")
    + "SELECT raster_id, threshold, count(*) AS n FROM fx_pixels JOIN (SELECT unnest([50, 75, 90]) AS threshold) ON occurrence BETWEEN threshold AND 100 GROUP BY raster_id, threshold",
)
def threshold_mask(spark: SparkSession, sf: str) -> DataFrame:
    masks = raster.threshold_masks(pixels(spark, sf), "occurrence", raster.PREGENERATED_THRESHOLDS)
    return masks.groupBy("raster_id", "threshold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mosaic_first",
    cte("fx_pixels")
    + """SELECT prow AS grow, g AS gcol, arg_min(occurrence, raster_id) AS occurrence FROM (SELECT *, pcol + 64*raster_id AS g FROM fx_pixels) WHERE prow BETWEEN 5 AND 120 AND g BETWEEN 10 AND 150 GROUP BY prow, g""",
)
def mosaic_first(spark: SparkSession, sf: str) -> DataFrame:
    packed = blocks.pack(pixels(spark, sf), ["raster_id"], ["occurrence"], 48)
    made = blocks.mosaic(packed, ["occurrence"], "raster_id", ["raster_id"], "first", F.lit(0), 64 * F.col("raster_id"), (5, 10, 120, 150), 64)
    return as_target(made, ["occurrence"])


def as_target(made: DataFrame, bands: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    return blocks.unpack(made, [], bands, kinds).withColumnsRenamed({"prow": "grow", "pcol": "gcol"})


def ranked_mosaic(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    """Mosaic of the images by their valid ratio, the smaller id first among equals."""
    packed = blocks.pack(spark.sql(_PRIO, p=pixels(spark, sf)), ["raster_id", "valid_ratio"], ["band1", "band2"], 48)
    return blocks.mosaic(packed, ["band1", "band2"], "raster_id", [F.desc("valid_ratio"), "raster_id"], rule, F.lit(0), F.lit(0), block=64)


_PRIO = "SELECT *, prow AS grow, pcol AS gcol, CASE raster_id WHEN 0 THEN 0.25e0 ELSE 0.75e0 END AS valid_ratio, CASE WHEN occurrence > 60 THEN occurrence ELSE 0 END AS band2 FROM {p}"


@query(
    "mosaic_priority",
    cte("fx_pixels", more={"q": _PRIO.format(p="fx_pixels")})
    + """SELECT grow, gcol, raster_id, band1, band2 FROM (SELECT *, row_number() OVER (PARTITION BY grow, gcol ORDER BY valid_ratio DESC, raster_id) AS rn FROM q WHERE band1 <> 0 OR band2 <> 0) WHERE rn = 1""",
)
def mosaic_priority(spark: SparkSession, sf: str) -> DataFrame:
    made = as_target(ranked_mosaic(spark, sf, "filled"), ["source", "band1", "band2"], {"source": "<i8"})
    return made.withColumn("raster_id", F.col("source").cast("int")).drop("source")


@query(
    "mosaic_per_band",
    cte("fx_pixels", more={"q": _PRIO.format(p="fx_pixels")})
    + """SELECT grow, gcol, coalesce(arg_max(band1, valid_ratio) FILTER (band1 <> 0), 0) AS band1, coalesce(arg_max(band2, valid_ratio) FILTER (band2 <> 0), 0) AS band2 FROM q GROUP BY grow, gcol""",
)
def mosaic_per_band(spark: SparkSession, sf: str) -> DataFrame:
    return as_target(ranked_mosaic(spark, sf, "band"), ["band1", "band2"])


@query(
    "stretch_percentiles",
    cte("fx_pixels", more={"lim": "SELECT raster_id, quantile_cont(occurrence, 0.02) AS lo, quantile_cont(occurrence, 0.98) AS hi FROM fx_pixels WHERE occurrence > 0 GROUP BY raster_id"})
    + """SELECT p.raster_id, prow, pcol, CASE WHEN occurrence > 0 THEN cast(trunc(greatest(0, least(255, (occurrence - lo)*255e0/(hi - lo)))) AS INT) ELSE 0 END AS shown,
    CASE WHEN p.raster_id = 0 THEN '3,2,1' ELSE '1,2,3' END AS bands FROM fx_pixels p JOIN lim USING (raster_id)""",
)
def stretch_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    shown = raster.stretch(pixels(spark, sf), "occurrence", ["raster_id"])
    source = F.when(F.col("raster_id") == 0, "local_img").otherwise("preloaded")
    bands = F.array_join(raster.band_choice(source, F.lit(3)), ",")
    return shown.select("raster_id", "prow", "pcol", "shown", bands.alias("bands"))


_TARGET = "SELECT DISTINCT raster_id, l_suppkey % 100 AS grow, l_partkey % 100 AS gcol FROM (SELECT l_linenumber % 2 AS raster_id, l_suppkey, l_partkey FROM {lineitem})"


@query(
    "warp_nearest",
    cte("fx_pixels", more={"t": _TARGET.format(lineitem="lineitem")})
    + """SELECT grow, gcol, t.raster_id, cast(p.occurrence AS DOUBLE) AS occurrence FROM t JOIN fx_pixels p ON p.raster_id = t.raster_id AND p.prow = floor((grow+0.5)*1.25) AND p.pcol = floor((gcol+0.5)*1.25)""",
)
def warp_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return warped(spark, sf, "nearest")


def warped(spark: SparkSession, sf: str, method: str) -> DataFrame:
    target = spark.sql(_TARGET, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet")).withColumnsRenamed({"grow": "prow", "gcol": "pcol"})
    grid, source = blocks.pack(target, ["raster_id"], [], 64), blocks.pack(pixels(spark, sf), ["raster_id"], ["occurrence"], 48)
    affine = F.struct(*[F.lit(v).alias(c) for c, v in (("xc", 1.25), ("xr", 0.0), ("x0", 0.0), ("yc", 0.0), ("yr", 1.25), ("y0", 0.0))])
    made = blocks.warp(grid, source, "occurrence", affine, method, block=48)
    return blocks.unpack(made, ["raster_id"], ["occurrence"], {"occurrence": "<f8"}).withColumnsRenamed({"prow": "grow", "pcol": "gcol"})


@query(
    "warp_bilinear",
    cte("fx_pixels", more={"t": _TARGET.format(lineitem="lineitem")})
    + """, c AS (SELECT *, (gcol+0.5)*1.25e0 - 0.5 AS x, (grow+0.5)*1.25e0 - 0.5 AS y FROM t),
    w AS (SELECT c.*, dx, dy, (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END)*(CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS wt FROM c CROSS JOIN (SELECT unnest([0,1]) AS dx) CROSS JOIN (SELECT unnest([0,1]) AS dy))
    SELECT grow, gcol, w.raster_id, round(sum(wt*p.occurrence)/sum(wt), 6) AS occurrence FROM w JOIN fx_pixels p ON p.raster_id = w.raster_id AND p.prow = floor(y) + dy AND p.pcol = floor(x) + dx WHERE wt > 0 GROUP BY grow, gcol, w.raster_id""",
)
def warp_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    return warped(spark, sf, "bilinear").withColumn("occurrence", F.round("occurrence", 6))


@query("block_table", cte("fx_pixels") + "SELECT raster_id, cast(floor(prow/32) AS BIGINT) AS brow, cast(floor(pcol/32) AS BIGINT) AS bcol, count(*) AS n, cast(sum(occurrence) AS BIGINT) AS total FROM fx_pixels GROUP BY 1, 2, 3")
def block_table(spark: SparkSession, sf: str) -> DataFrame:
    packed = blocks.pack(pixels(spark, sf), ["raster_id"], ["occurrence"], 32)
    back = blocks.unpack(packed, ["raster_id", "brow", "bcol"], ["occurrence"])
    return back.groupBy("raster_id", "brow", "bcol").agg(F.count(F.lit(1)).alias("n"), F.sum("occurrence").alias("total"))


_OPEN = """, m AS (SELECT raster_id, prow, pcol FROM fx_pixels WHERE occurrence >= 40), d AS (SELECT * FROM (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) v(i,j)),
    e AS (SELECT raster_id, prow, pcol FROM (SELECT a.raster_id, a.prow, a.pcol, count(*) AS n FROM m a CROSS JOIN d JOIN m b ON b.raster_id = a.raster_id AND b.prow = a.prow + i AND b.pcol = a.pcol + j GROUP BY 1, 2, 3) WHERE n = 5)
    SELECT DISTINCT raster_id, cast(prow + i AS BIGINT) AS prow, cast(pcol + j AS BIGINT) AS pcol FROM e CROSS JOIN d"""


@query("mask_open", cte("fx_pixels") + _OPEN)
def mask_open(spark: SparkSession, sf: str) -> DataFrame:
    return raster.morphology(pixels(spark, sf).where("occurrence >= 40"), ["raster_id"], 1.0, "open", block=32)


@query(
    "mask_close",
    cte("fx_pixels")
    + """, m AS (SELECT raster_id, prow, pcol FROM fx_pixels WHERE occurrence >= 75), d AS (SELECT * FROM (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) v(i,j)),
    g AS (SELECT DISTINCT raster_id, prow + i AS prow, pcol + j AS pcol FROM m CROSS JOIN d)
    SELECT raster_id, cast(prow AS BIGINT) AS prow, cast(pcol AS BIGINT) AS pcol FROM (SELECT a.raster_id, a.prow, a.pcol, count(*) AS n FROM g a CROSS JOIN d JOIN g b ON b.raster_id = a.raster_id AND b.prow = a.prow + i AND b.pcol = a.pcol + j GROUP BY 1, 2, 3) WHERE n = 5""",
)
def mask_close(spark: SparkSession, sf: str) -> DataFrame:
    return raster.morphology(pixels(spark, sf).where("occurrence >= 75"), ["raster_id"], 1.0, "close", block=32)


_CC = {
    "px": "SELECT raster_id, prow, pcol, prow*2147483648 + pcol AS id FROM fx_pixels WHERE occurrence >= 75",
    "walk": """SELECT raster_id, prow, pcol, id AS root FROM px UNION SELECT p.raster_id, p.prow, p.pcol, w.root FROM walk w JOIN px p ON p.raster_id = w.raster_id
      AND ((p.prow = w.prow AND (p.pcol = w.pcol + 1 OR p.pcol = w.pcol - 1)) OR (p.pcol = w.pcol AND (p.prow = w.prow + 1 OR p.prow = w.prow - 1))) WHERE w.root < p.id""",
    "comp": "SELECT raster_id, prow, pcol, cast(min(root) AS BIGINT) AS region FROM walk GROUP BY raster_id, prow, pcol",
}


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("mask_components", _recursive(cte("fx_pixels", more=_CC)) + "SELECT raster_id, prow, pcol, region FROM comp")
def mask_components(spark: SparkSession, sf: str) -> DataFrame:
    mask = pixels(spark, sf).where("occurrence >= 75").select("raster_id", "prow", "pcol")
    return regions.mask_regions(mask, ["raster_id"], block=32)


@query(
    "mask_polygons",
    _recursive(cte("fx_pixels", more=_CC))
    + """, e AS (SELECT c.raster_id, c.region, c.prow, c.pcol, i, j FROM comp c CROSS JOIN (SELECT * FROM (VALUES (1,0),(-1,0),(0,1),(0,-1)) v(i,j)))
    SELECT a.raster_id, a.region, cast(a.n AS DOUBLE) AS area, cast(b.n AS DOUBLE) AS perimeter FROM (SELECT raster_id, region, count(*) AS n FROM comp GROUP BY 1, 2) a
    JOIN (SELECT e.raster_id, e.region, count(*) AS n FROM e LEFT JOIN comp c ON c.raster_id = e.raster_id AND c.prow = e.prow + i AND c.pcol = e.pcol + j WHERE c.region IS NULL GROUP BY 1, 2) b ON a.raster_id = b.raster_id AND a.region = b.region""",
)
def mask_polygons(spark: SparkSession, sf: str) -> DataFrame:
    mask = pixels(spark, sf).where("occurrence >= 75").select("raster_id", "prow", "pcol")
    shapes = regions.region_outlines(mask, ["raster_id"], block=32)
    steps = F.flatten(
        F.transform(F.flatten("geometry"), lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda p, q: F.abs(p["x"] - q["x"]) + F.abs(p["y"] - q["y"])))
    )
    return shapes.select(
        "raster_id", "region", G.planar_area(F.col("geometry")).alias("area"), F.aggregate(steps, F.lit(0.0), lambda a, v: a + v).alias("perimeter")
    )


PX, PY, WEST, NORTH = 0.0234375, 0.046875, 108.5, 30.5


def placed_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).withColumns(
        {
            "value": F.col("occurrence"),
            "px": F.lit(WEST) + 3.0 * F.col("raster_id") + (F.col("pcol") + 0.5) * PX,
            "py": F.lit(NORTH) - (F.col("prow") + 0.5) * PY,
        }
    )


def layer_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return with_boxes(fixture(spark, sf, "fx_water")).withColumn("area_km2", G.area_km2(F.col("geometry")))


MASK = ["k", "threshold", "raster_id", "prow", "pcol", "touches"]


def layer_inputs(spark: SparkSession, sf: str, bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    clip = regions.pixels_near(bodies, placed_pixels(spark, sf), "k", 0.21, (PX / 2, PY / 2), 0.25)
    return clip, raster.threshold_masks(clip, "value", [50, 90]).select(*MASK)


def per_shape(spark: SparkSession, sf: str, build: Callable[[DataFrame], DataFrame], bodies: DataFrame | None = None) -> DataFrame:
    return regions.per_shape(layer_bodies(spark, sf) if bodies is None else bodies, "k", build)


_CLIP = f"""SELECT k, raster_id, prow, pcol, occurrence, landcover, px + {PX / 2} >= w AND px - {PX / 2} <= e AND py + {PY / 2} >= s AND py - {PY / 2} <= n AS touches FROM
    (SELECT *, {WEST}e0 + 3e0*raster_id + (pcol + 0.5e0)*{PX} AS px, {NORTH}e0 - (prow + 0.5e0)*{PY} AS py FROM fx_pixels) q JOIN
    (SELECT k, w100/100e0 AS w, s100/100e0 AS s, (w100+dx)/100e0 AS e, (s100+dy)/100e0 AS n, greatest(dx, dy)/100e0*0.21e0 AS d FROM fx_water) b
    ON px >= w - d AND px <= e + d AND py >= s - d AND py <= n + d WHERE sqrt(pow(greatest(0, w - px, px - e), 2) + pow(greatest(0, s - py, py - n), 2)) <= d"""


@query("layer_clip", cte("fx_pixels", "fx_water", more={"c": _CLIP}) + "SELECT k, raster_id, count(*) AS n, count(*) FILTER (WHERE touches) AS touching FROM c GROUP BY k, raster_id")
def layer_clip(spark: SparkSession, sf: str) -> DataFrame:
    def counts(bodies: DataFrame) -> DataFrame:
        clip, _ = layer_inputs(spark, sf, bodies)
        return clip.groupBy("k", "raster_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("touches").alias("touching"))

    return per_shape(spark, sf, counts)


def _regions_of(clip: str, wet: str) -> str:
    """SQL of each body's regions: ``wet`` picks thresholds and water of the clip."""
    walk = """SELECT k, threshold, raster_id, prow, pcol, id AS root FROM px UNION SELECT p.k, p.threshold, p.raster_id, p.prow, p.pcol, w.root FROM walk w JOIN px p ON p.k = w.k AND p.threshold = w.threshold AND p.raster_id = w.raster_id
        AND ((p.prow = w.prow AND (p.pcol = w.pcol + 1 OR p.pcol = w.pcol - 1)) OR (p.pcol = w.pcol AND (p.prow = w.prow + 1 OR p.prow = w.prow - 1))) WHERE w.root < p.id"""
    steps = {
        "c": clip,
        "px": f"SELECT k, threshold, raster_id, prow, pcol, touches, prow*2147483648 + pcol AS id FROM c JOIN {wet}",
        "walk": walk,
        "comp": "SELECT w.k, w.threshold, w.raster_id, w.prow, w.pcol, cast(min(root) AS BIGINT) AS region, bool_or(p.touches) AS touches FROM walk w JOIN px p USING (k, threshold, raster_id, prow, pcol) GROUP BY 1, 2, 3, 4, 5",
    }
    return _recursive(cte("fx_pixels", "fx_water", more=steps | {"a0": m_table("fx_water")}))


_REGIONS = _regions_of(_CLIP, "(SELECT unnest([50, 90]) AS threshold) ON occurrence BETWEEN threshold AND 100")


@query(
    "layer_regions",
    _REGIONS
    + """SELECT k, threshold, raster_id, region, count(*) AS n_pixels FROM comp GROUP BY k, threshold, raster_id, region HAVING bool_or(touches)""",
)
def layer_regions(spark: SparkSession, sf: str) -> DataFrame:
    return per_shape(spark, sf, lambda own: regions.regions_on_body(*regions.label_water(layer_inputs(spark, sf, own)[1], "k")))


@query(
    "layer_shapes",
    _REGIONS
    + f""", r AS (SELECT k, threshold, raster_id, region, count(*) AS n FROM comp GROUP BY k, threshold, raster_id, region HAVING bool_or(touches)), g AS (SELECT k, threshold, count(*) AS parts, sum(n) AS n FROM r GROUP BY k, threshold)
    SELECT b.k, t.threshold, CASE WHEN g.k IS NULL THEN 'empty' ELSE 'ok' END AS state, cast(coalesce(g.parts, 0) AS INT) AS parts, cast(coalesce(g.n, 0) AS BIGINT) AS n_pixels
    FROM fx_water b CROSS JOIN (SELECT unnest([50, 90]) AS threshold) t LEFT JOIN g ON g.k = b.k AND g.threshold = t.threshold""",
)
def layer_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The layers before smoothing: state, polygons and area in pixels."""
    return per_shape(spark, sf, lambda own: in_pixels(layers_of(spark, sf, own, smooth=False)))


def origin() -> Column:
    return F.struct((F.lit(WEST) + 3.0 * F.col("raster_id")).alias("x0"), F.lit(NORTH).alias("y0"), F.lit(PX).alias("dx"), F.lit(-PY).alias("dy"))


def layers_of(spark: SparkSession, sf: str, bodies: DataFrame, smooth: bool, metres: regions.Rounding | None = None) -> DataFrame:
    _, masks = layer_inputs(spark, sf, bodies)
    return regions.water_layers(bodies, masks, "k", [50, 90], origin(), smooth=smooth, metres=metres)


def in_pixels(layers: DataFrame) -> DataFrame:
    """State, polygons and area in pixels of unsmoothed layers."""
    area = F.round(G.planar_area(F.col("geometry")) / (PX * PY)).cast("long")
    return layers.select("k", "threshold", "state", F.coalesce(F.size("geometry"), F.lit(0)).alias("parts"), F.coalesce(area, F.lit(0).cast("long")).alias("n_pixels"))


#: Opening and closing at the scale of the fixture: by one pixel of a row, then by two and
#: by one of a column.
DX_M, DY_M, OPEN_M, CLOSE_M, SMALL_KM2 = 2600, 5200, 2700, 5300, 4000


def _disk_sql(radius: int) -> str:
    return f"(SELECT i, j FROM (SELECT unnest(range(-9, 10)) AS i) CROSS JOIN (SELECT unnest(range(-9, 10)) AS j) WHERE pow(j*{DX_M}, 2) + pow(i*{DY_M}, 2) <= pow({radius}, 2))"


def _grown(source: str, disk: str) -> str:
    return f"SELECT DISTINCT k, threshold, raster_id, prow + i AS prow, pcol + j AS pcol FROM {source} CROSS JOIN {disk}"


def _shrunk(source: str, disk: str) -> str:
    return f"""SELECT k, threshold, raster_id, prow, pcol FROM (SELECT a.k, a.threshold, a.raster_id, a.prow, a.pcol, count(*) AS n FROM {source} a CROSS JOIN {disk} d
        JOIN {source} b ON b.k = a.k AND b.threshold = a.threshold AND b.raster_id = a.raster_id AND b.prow = a.prow + i AND b.pcol = a.pcol + j GROUP BY 1, 2, 3, 4, 5) WHERE n = (SELECT count(*) FROM {disk})"""


@query(
    "layers_opened",
    _REGIONS
    + f""", r AS (SELECT k, threshold, raster_id, region FROM comp GROUP BY k, threshold, raster_id, region HAVING bool_or(touches)),
    wet AS (SELECT k, threshold, raster_id, prow, pcol FROM comp JOIN r USING (k, threshold, raster_id, region)),
    s AS (SELECT * FROM wet WHERE k IN (SELECT k FROM a0 WHERE m2/1e6 <= {SMALL_KM2})),
    e AS ({_shrunk("s", _disk_sql(OPEN_M))}), opened AS ({_grown("e", _disk_sql(OPEN_M))}),
    base AS (SELECT * FROM opened UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM opened o WHERE o.k = s.k AND o.threshold = s.threshold)),
    g AS ({_grown("base", _disk_sql(CLOSE_M))}), closed AS ({_shrunk("g", _disk_sql(CLOSE_M))}),
    whole AS (SELECT * FROM closed UNION ALL SELECT * FROM wet WHERE k IN (SELECT k FROM a0 WHERE m2/1e6 > {SMALL_KM2})),
    n AS (SELECT k, threshold, count(*) AS n FROM whole GROUP BY k, threshold)
    SELECT b.k, t.threshold, CASE WHEN n.k IS NULL THEN 'empty' ELSE 'ok' END AS state, cast(coalesce(n.n, 0) AS BIGINT) AS n_pixels
    FROM fx_water b CROSS JOIN (SELECT unnest([50, 90]) AS threshold) t LEFT JOIN n ON n.k = b.k AND n.threshold = t.threshold""",
)
def layers_opened(spark: SparkSession, sf: str) -> DataFrame:
    """Layers whose small bodies are opened and closed by metres before they are traced."""
    how = regions.Rounding((F.lit(DX_M), F.lit(DY_M)), OPEN_M, CLOSE_M, small_km2=SMALL_KM2)
    return per_shape(spark, sf, lambda own: in_pixels(layers_of(spark, sf, own, smooth=False, metres=how)).drop("parts"))


_STATES = """, r AS (SELECT k, threshold, raster_id, region, count(*) AS n FROM comp GROUP BY k, threshold, raster_id, region HAVING bool_or(touches)), g AS (SELECT k, threshold, count(*) AS parts, sum(n) AS n FROM r GROUP BY k, threshold)
    SELECT b.k, t.threshold, CASE WHEN g.k IS NULL THEN 'empty' ELSE 'ok' END AS state, cast(coalesce(g.parts, 0) AS INT) AS parts, cast(coalesce(g.n, 0) AS BIGINT) AS n_pixels
    FROM fx_water b CROSS JOIN (SELECT unnest({thresholds}) AS threshold) t LEFT JOIN g ON g.k = b.k AND g.threshold = t.threshold"""


@query(
    "landcover_layers",
    _regions_of(_CLIP.replace("0.21e0", "0.16e0"), f"(SELECT {raster.WATER_CLASS} AS threshold) ON landcover = threshold") + _STATES.format(thresholds=f"[{raster.WATER_CLASS}]"),
)
def landcover_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of the land-cover raster: its water class, in a narrower clip."""
    cover = placed_pixels(spark, sf).withColumn("value", F.col("landcover"))

    def build(own: DataFrame) -> DataFrame:
        # A centre exactly at the clip's edge would depend on rounding, so the share is odd.
        clip = regions.pixels_near(own, cover, "k", 0.16, (PX / 2, PY / 2), 0.25)
        return in_pixels(regions.landcover_layers(own, clip, "k", origin(), smooth=False))

    return per_shape(spark, sf, build)


@query("pregenerate_layers", _REGIONS + _STATES.format(thresholds="[50, 90]") .replace("SELECT b.k", "SELECT cast(0 AS BIGINT) AS again, b.k"))
def pregenerate_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The stored layers of all bodies after three jobs: one threshold, both in two
    batches, and both again, which has nothing to do."""
    bodies, path = layer_bodies(spark, sf), new_shared_path(spark, "layers")

    def build(own: DataFrame) -> DataFrame:
        return per_shape(spark, sf, lambda one: in_pixels(layers_of(spark, sf, one, smooth=False)), own)

    regions.pregenerate(bodies, build, path, "k", [50])
    regions.pregenerate(bodies, build, path, "k", [50, 90], batches=2)
    again = regions.pregenerate(bodies, build, path, "k", [50, 90])
    return regions.layer_sink(spark, path).withColumn("again", F.lit(again).cast("long"))


@query("water_layers")
def water_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed layers for every body and threshold (rows only: no closed form)."""
    def build(own: DataFrame) -> DataFrame:
        layers = layers_of(spark, sf, own, smooth=True)
        return layers.select("k", "threshold", "state", F.round(G.area_km2(F.col("geometry")), 4).alias("area_km2"), F.size("geometry").alias("parts"))

    return per_shape(spark, sf, build)


@query(
    "smooth_polygons",
    cte("fx_water")
    + """SELECT k, 17 AS points, round(area, 9) AS area FROM (SELECT k, (dx*dy)/1e4*(1 - 1/8e0 - 1/32e0) AS area FROM fx_water)""",
)
def smooth_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of corner cutting take 5/32 off a rectangle."""
    df = with_boxes(fixture(spark, sf, "fx_water")).withColumn("g", G.chaikin(F.col("geometry")))
    return df.select("k", F.size(F.col("g")[0][0]).alias("points"), F.round(G.planar_area(F.col("g")), 9).alias("area"))


@query(
    "simplify_polygons",
    cte("fx_water") + "SELECT k, 5 AS points, 1 AS parts FROM fx_water",
)
def simplify_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """A corner-to-corner outline with a nearly straight extra vertex and a speck."""
    w, s, e, n = (F.col(c) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north"))

    def p(x: Column, y: Column) -> Column:
        return G.point(G.mercator_x(x), G.mercator_y(y))

    shell = F.array(p(w, s), p((w + e) / 2, s + 1e-6), p(e, s), p(e, n), p(w, n), p(w, s))
    speck = F.array(p(w, s), p(w + 1e-5, s), p(w + 1e-5, s + 1e-5), p(w, s + 1e-5), p(w, s))
    metric = F.array(F.array(shell), F.array(speck))
    df = with_boxes(fixture(spark, sf, "fx_water")).withColumn("g", regions.simplify(metric, F.lit(G.SMALL_SIMPLIFY_M)))
    kept = df.withColumn("g", G.polygon_parts(G.drop_small_parts(F.col("g"), G.SMALL_PART_MIN_M2)))
    return kept.select("k", F.size(F.col("g")[0][0]).alias("points"), F.size("g").alias("parts"))


@query(
    "smooth_layers",
    cte("fx_water", more={"a0": m_table("fx_water")})
    + f"""SELECT k, CASE WHEN m2/1e6 > {G.BIG_BODY_KM2} THEN 5 ELSE 17 END AS points, 1 AS parts, round(m2/1e6*CASE WHEN m2/1e6 > {G.BIG_BODY_KM2} THEN 1 ELSE 27/32e0 END, 6) AS area FROM a0""",
)
def smooth_layers(spark: SparkSession, sf: str) -> DataFrame:
    """The smoothing of the layers on rectangles with a speck: large bodies keep their
    corners, small ones lose 5/32 with them, and the speck goes from both."""
    df = with_boxes(fixture(spark, sf, "fx_water"))
    w, s = F.col("bbox_west"), F.col("bbox_south")
    speck = G.box_polygon(w - 2e-5, s - 2e-5, w - 1e-5, s - 1e-5)
    ready = df.select("k", F.concat(F.col("geometry"), speck).alias("geometry"), G.area_km2(F.col("geometry")).alias("area_km2"))
    smooth = cut_lineage(cut_lineage(ready).select("k", regions.smooth_water(F.col("geometry"), F.col("area_km2")).alias("g")))
    return smooth.select(
        "k", F.size(F.col("g")[0][0]).alias("points"), F.size("g").alias("parts"), F.round(G.area_km2(F.col("g")), 6).alias("area")
    )


@query(
    "thresholds_available",
    """WITH s AS (SELECT DISTINCT p_size % 40 AS body, 5*(p_partkey % 19) + 5 AS t FROM part)
    SELECT body, string_agg(concat('', t), ',' ORDER BY t) AS available, cast(arg_min(t, abs(t - 52)*1000 + t) AS INT) AS nearest FROM s GROUP BY body""",
)
def thresholds_available(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_size % 40 AS body", "cast(5*(p_partkey % 19) + 5 AS int) AS t")
    listed = s.groupBy("body").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    return listed.select("body", F.array_join(F.col("ts").cast("array<string>"), ",").alias("available"), C.nearest_threshold(F.lit(52), F.col("ts")).alias("nearest"))
