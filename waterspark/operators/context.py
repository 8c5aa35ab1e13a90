"""Neighbouring water, clipping, and the tiles a body needs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterspark.functions import clean as C
from waterspark.functions import geometry as G
from waterspark.functions import kernels as K
from waterspark.operators import spatial_join as S
from waterspark.session import cut_lineage

CONTEXT_MIN_KM2 = 1.0
SAME_BODY_COVERAGE = 0.9
#: Rows of the first tier of neighbours, and how much larger the next ones are; any values
#: give the same rows.
FIRST_TIER, TIER_GROWTH = 16_384, 8
_BOX = ("bbox_west", "bbox_south", "bbox_east", "bbox_north")


@F.arrow_udf(G.GEOMETRY_TYPE)
def _clip(arg: pa.Array) -> pa.Array:
    boxes = [arg.field(c).to_numpy(zero_copy_only=False) for c in ("xmin", "ymin", "xmax", "ymax")]
    rows = []
    for i, polys in enumerate(S.geometry_polygons(arg.field("g"))):
        limits = tuple(float(b[i]) for b in boxes)
        out = []
        for poly in polys:
            piece = K.clip_rings(K.oriented(poly), *limits)
            if piece:
                out += K.rings_to_polygons(K.tidy_border(piece, *limits))
        rows.append(out)
    return S.geometry_array(rows)


def clip_to_box(geom: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Polygons inside a box, separate parts kept apart.

    Clipping to an area of interest uses its envelope; the rounded corners of a real
    buffer are not cut off.
    """
    return _clip(
        F.struct(geom.alias("g"), xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))
    )


def coverage_pairs(a: DataFrame, b: DataFrame, key_a: str, key_b: str, **kw) -> DataFrame:
    """Share of each body of ``a`` covered by shapes of ``b``: positive overlaps only."""
    area = a.select(key_a, (G.area_km2(F.col("geometry")) * 1e6).alias("_m2"))
    pairs = S.overlap_pairs(a, b, key_a, key_b, **kw).join(area, key_a)
    return pairs.where("_m2 > 0").withColumn("coverage", F.col("overlap_m2") / F.col("_m2")).drop("_m2")


def _digest(*columns: Column) -> Column:
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(7), *columns).alias("g"))


def _tier_ends(members: DataFrame) -> list[int | None]:
    """Largest orders of the tiers of rows, each some TIER_GROWTH times the one before; None
    for the last, which has all rows."""
    n, shares = members.count(), []
    while n and (FIRST_TIER * TIER_GROWTH ** len(shares)) < n:
        shares.append(FIRST_TIER * TIER_GROWTH ** len(shares) / n)
    ends = members.agg(F.percentile_approx("_order", F.array(*map(F.lit, shares)))).first()[0] if shares else []
    return [*sorted(set(ends)), None]


def _neighbours(
    bodies: DataFrame,
    others: DataFrame,
    key: str,
    other_key: str,
    own_ids: Column,
    other_ids: Column,
    same_shape: Column | None,
    padding: float,
    limit: int,
    clip: bool,
) -> DataFrame:
    """Rows of ``others`` that reach a body's area of interest, the largest first.

    ``own_ids`` and ``other_ids`` are arrays; a row that shares an id with the body is left
    out. The join runs over *distinct shapes* on both sides, so stacked copies do not
    multiply pairs, and over tiers of ``others``, the largest first: a shape that finds as
    many rows as its bodies can need looks no further, as all later ones are smaller. So
    pairs follow the limit, not the crowd. What is found is kept as one short list for each
    shape, which its bodies filter by their own ids.
    """
    box = [F.col(c) for c in _BOX]
    geom, area = F.col("geometry"), G.stable_area(F.col("area_km2"))
    mine = bodies.withColumns({"a_shape": _digest(geom, *box, "area_km2"), "_own": F.array_distinct(own_ids)})
    theirs = others.withColumns({"b_shape": _digest(geom, *box, *([area] if same_shape is not None else [])), "_ids": other_ids, "_order": (-F.round(area * 1e6)).cast("long")})
    left = cut_lineage(mine.select(key, "a_shape", "_own"))
    members = cut_lineage(theirs.select("b_shape", other_key, F.col("area_km2").alias("other_area"), "_ids", "_order"))
    # Rows that a body's ids can take away: an upper bound.
    listed = members.select(F.explode("_ids").alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_lost"))
    lost = left.select(key, "a_shape", F.explode("_own").alias("_id")).join(listed, "_id").groupBy(key, "a_shape").agg(F.sum("_lost").alias("_lost"))
    need = lost.groupBy("a_shape").agg((F.max("_lost") + limit).alias("_need"))
    shapes_a = mine.groupBy("a_shape").agg(*[F.first(c).alias(c) for c in ("geometry", *_BOX)], F.first("area_km2").alias("own_area"))
    shapes_a = cut_lineage(
        shapes_a.join(need, "a_shape", "left").withColumns(
            {"_need": F.coalesce("_need", F.lit(limit)), "_reach_m": G.aoi_distance(*box, padding), "aoi": G.aoi_bounds(*box, padding)}
        )
    )
    shapes_b = cut_lineage(
        theirs.groupBy("b_shape").agg(
            *[F.first(c).alias(c) for c in ("geometry", *_BOX)],
            F.first("area_km2").alias("other_area"), F.min(F.struct("_order", other_key)).alias("_top"),
        )
    )
    todo, found = shapes_a, []
    for end in _tier_ends(members):
        tier, rows = (shapes_b, members) if end is None else (shapes_b.where(F.col("_top._order") <= end), members.where(F.col("_order") <= end))
        asked = todo.select(F.col("a_shape").alias("id_a"), "geometry", *_BOX, "_reach_m")
        pairs = S.near_shapes(asked, tier.select(F.col("b_shape").alias("id_b"), "geometry", *_BOX), "_reach_m").withColumnsRenamed({"id_a": "a_shape", "id_b": "b_shape"})
        sized = pairs.join(todo.select("a_shape", "own_area", "_need"), "a_shape").join(tier.select("b_shape", "other_area", "_top"), "b_shape")
        if same_shape is not None:
            sized = sized.where(~F.coalesce(same_shape, F.lit(False)))
        # A shape beyond ``_need`` others with a larger first row has nothing to give.
        place = F.row_number().over(Window.partitionBy("a_shape").orderBy("_top"))
        near = sized.withColumn("_place", place).where("_place <= _need").select("a_shape", "b_shape", "overlap_m2", "distance_m", "_need")
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("b_shape").orderBy("_order", other_key)))
        opened = near.join(ranked, "b_shape").where("_r <= _need")
        order = Window.partitionBy("a_shape").orderBy("_order", other_key)
        top = cut_lineage(opened.withColumn("_rank", F.row_number().over(order)).where("_rank <= _need").drop("_r"))
        if end is None:
            found.append(top.drop("_need"))
            break
        # Rows are enough where their last rank is the need.
        full = top.where("_rank = _need").select("a_shape")
        found.append(top.join(full, "a_shape", "left_semi").drop("_need"))
        todo = cut_lineage(todo.join(full, "a_shape", "left_anti"))
        if todo.isEmpty():
            break
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    best = best.join(shapes_a.select("a_shape", "aoi"), "a_shape")
    shown = [F.col(other_key), F.col("other_area").alias("area_km2"), "overlap_m2", "distance_m", "aoi"]
    if clip:
        best = best.join(shapes_b.select("b_shape", "geometry"), "b_shape")
        best = best.withColumn("geometry", clip_to_box(F.col("geometry"), *[F.col(f"aoi.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]))
        shown.append("geometry")
    lists = best.groupBy("a_shape").agg(F.array_sort(F.collect_list(F.struct("_rank", "_ids", F.struct(*shown).alias("row")))).alias("_all"))
    others_only = F.filter("_all", lambda r: ~F.coalesce(F.arrays_overlap(F.col("_own"), r["_ids"]), F.lit(False)))
    kept = left.join(lists, "a_shape").select(key, F.posexplode(F.slice(others_only, 1, limit)).alias("_at", "_one"))
    return kept.select(key, f"_one.row.{other_key}", (F.col("_at") + 1).alias("rank"), *[f"_one.row.{c}" for c in ("area_km2", "overlap_m2", "distance_m", "aoi", *(["geometry"] if clip else []))])


def context_water(
    bodies: DataFrame,
    osm: DataFrame,
    limit: int,
    key: str = "lake_uid",
    other_key: str = "other_id",
    padding: float = 0.8,
    min_area_km2: float = CONTEXT_MIN_KM2,
    clip: bool = False,
) -> DataFrame:
    """Other still water around each body, without the body itself: at most ``limit`` rows
    each. With ``clip``, ``geometry`` is the neighbour's, clipped to the area of interest.

    A candidate is the body itself when it shares one of its source ids, or when the two
    cover each other by more than nine tenths.
    """
    others = osm.where(C.is_still_water(F.col("other_tags")) & (F.col("area_km2") >= min_area_km2))
    own = F.array_compact(F.array(C.clean_id(F.col("osm_id_text")), C.clean_id(F.col("osm_way_id_text"))))
    theirs = F.array_compact(F.array(C.clean_id(F.col("osm_id")), C.clean_id(F.col("osm_way_id"))))
    share = SAME_BODY_COVERAGE * 1e6
    same_shape = (F.col("overlap_m2") > F.col("own_area") * share) & (F.col("overlap_m2") > F.col("other_area") * share)
    return _neighbours(bodies, others, key, other_key, own, theirs, same_shape, padding, limit, clip)


def context_reference(
    bodies: DataFrame,
    refs: DataFrame,
    limit: int,
    key: str = "lake_uid",
    other_key: str = "other_id",
    padding: float = 0.8,
    min_area_km2: float = CONTEXT_MIN_KM2,
    clip: bool = False,
) -> DataFrame:
    """Reference bodies around each body, without the one it is matched to: at most
    ``limit`` rows each; ``clip`` as in ``context_water``."""
    others = refs.where(F.coalesce(F.col("area_km2"), F.lit(0.0)) >= min_area_km2)
    own, theirs = (F.array_compact(F.array(F.col(c).cast("string"))) for c in ("hylak_id", other_key))
    return _neighbours(bodies, others, key, other_key, own, theirs, None, padding, limit, clip)


def required_tiles(
    water: DataFrame, grid: DataFrame, footprints: DataFrame | None = None, key: str = "lake_uid"
) -> DataFrame:
    """Tiles each body needs: ``key, tile, coverage, seq``.

    Grid tiles by coverage, else the stored tile list, else imagery footprints that meet
    the body's box.
    """
    pairs = coverage_pairs(water, grid, key, "tile", balance=False)
    stored = water.select(key, F.posexplode(C.split_list(F.col("sentinel_tiles"))).alias("seq", "tile"))
    options = [
        pairs.select(key, F.lit(0).alias("prio"), "tile", (-F.col("coverage")).alias("sort"), "coverage"),
        stored.select(key, F.lit(1).alias("prio"), "tile", F.col("seq").cast("double").alias("sort"), F.lit(0.0).alias("coverage")),
    ]
    if footprints is not None:
        met = S.box_pairs(water, footprints, key, "tile")
        options.append(
            met.select(key, F.lit(2).alias("prio"), "tile", F.lit(0.0).alias("sort"), F.lit(0.0).alias("coverage"))
        )
    every = options[0]
    for extra in options[1:]:
        every = every.unionByName(extra)
    # One struct per body holds its handful of tiles; the best source is picked inside it.
    listed = every.groupBy(key).agg(
        F.min("prio").alias("best"), F.collect_list(F.struct("prio", "sort", "tile", "coverage")).alias("all")
    )
    chosen = F.sort_array(F.filter("all", lambda t: t["prio"] == F.col("best")))
    out = listed.select(key, F.posexplode(chosen).alias("seq", "t"))
    return out.select(key, F.col("t.tile").alias("tile"), F.col("t.coverage").alias("coverage"), (F.col("seq") + 1).alias("seq"))
