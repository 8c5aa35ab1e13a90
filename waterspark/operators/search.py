"""Search, filters, facets, paging and id lookup over the water table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterspark.functions import clean as C
from waterspark.functions import geometry as G
from waterspark.operators.spatial_join import box_pairs

FACETS = ["water_type", "province", "city", "county", "polygon_quality", "metadata_quality"]
SEARCHED = [
    "source_feature_id", "lake_uid", "name", "display_name", "name_zh", "name_en", "hylak_id", "osm_way_id",
    "osm_way_id_text",
]
ID_COLUMNS = ["lake_uid", "source_feature_id", "osm_id_text", "osm_way_id_text"]
PAGE_SIZE = 200


def text_search(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring over the id and name columns that exist."""
    needle = text.strip().lower()
    if not needle:
        return df
    hit: Column = F.lit(False)
    for name in SEARCHED:
        if name in df.columns:
            hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(needle), F.lit(False))
    return df.where(hit)


def _wanted(filters: Mapping[str, object], key: str) -> str | None:
    value = filters.get(key)
    text = "" if value is None else str(value).strip()
    return text if text and text.lower() != "nan" else None


def _number(filters: Mapping[str, object], key: str) -> float | None:
    try:
        return float(_wanted(filters, key) or "")
    except ValueError:
        return None


def apply_filters(df: DataFrame, filters: Mapping[str, object], footprints: DataFrame | None = None) -> DataFrame:
    """Exact, boolean, bucket and range filters; unknown or empty values switch one off.

    A table without ``has_tci`` answers that filter from ``footprints`` by a box test.
    """
    out = df
    for key in FACETS:
        value = _wanted(filters, key)
        if value and value != "all":
            out = out.where(C.clean_id(F.col(key)) == value)
    imagery = _wanted(filters, "has_tci")
    if imagery in ("true", "false"):
        if "has_tci" in df.columns:
            out = out.where(F.coalesce(F.col("has_tci") != 0, F.lit(False)) == F.lit(imagery == "true"))
        elif footprints is not None:
            met = box_pairs(out, footprints, "lake_uid", "tile").select("lake_uid").distinct()
            out = out.join(met, "lake_uid", "left_semi" if imagery == "true" else "left_anti")
    named = _wanted(filters, "has_name")
    if named in ("true", "false"):
        real = F.coalesce(*[C.clean_text(F.col(c)) for c in ("name", "name_zh", "name_en")]).isNotNull()
        out = out.where(real == F.lit(named == "true"))
    bucket = _wanted(filters, "area_bucket")
    if bucket in C.AREA_BUCKETS:
        out = out.where(C.area_bucket(F.col("area_km2")) == bucket)
    low, high = _number(filters, "min_area"), _number(filters, "max_area")
    if low is not None:
        out = out.where(F.col("area_km2") >= low)
    if high is not None:
        out = out.where(F.col("area_km2") <= high)
    return out


def facets(df: DataFrame, columns: list[str] = FACETS) -> DataFrame:
    """Value counts of several columns in one pass: ``facet, value, n``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), C.clean_id(F.col(c)).alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.facet", "p.value")
        .where("value IS NOT NULL")
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def by_area(df: DataFrame) -> DataFrame:
    return df.orderBy(G.stable_area(F.col("area_km2")).desc(), "lake_uid")


def page(df: DataFrame, offset: int = 0, limit: int = PAGE_SIZE) -> DataFrame:
    return by_area(df).offset(offset).limit(limit)


def page_after(df: DataFrame, area_km2: float, lake_uid: str, limit: int = PAGE_SIZE) -> DataFrame:
    """Keyset page behind a known row: deep pages do not re-sort what came before."""
    here, last = G.stable_area(F.col("area_km2")), G.stable_area(F.lit(area_km2))
    later = (here < last) | ((here == last) & (F.col("lake_uid") > lake_uid))
    return by_area(df.where(later)).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def summary(df: DataFrame) -> DataFrame:
    """List projection with the tile list and its best-tile fallback."""
    tiles = C.split_list(F.col("sentinel_tiles"))
    best = F.col("best_tci_tile")
    has_best = F.coalesce(best, F.lit("")) != ""
    return df.select(
        C.first_present(
            F.col("source_feature_id"), F.col("osm_id_text"), F.col("osm_way_id_text"), F.col("lake_uid")
        ).alias("lake_id"),
        F.col("lake_uid").alias("object_id"),
        C.first_present(F.col("display_name"), F.col("name")).alias("name"),
        F.col("source_primary").alias("source"),
        "water_type", "area_km2", "center_lon", "center_lat", "bbox_west", "bbox_south", "bbox_east", "bbox_north",
        "province", "city", "county", "hylak_id", "best_tci_tile", "best_tci_date", "best_tci_valid_ratio",
        "polygon_quality", "metadata_quality",
        F.when(F.size(tiles) > 0, tiles)
        .when(has_best, F.array(C.tile_code(best)))
        .otherwise(F.array().cast("array<string>"))
        .alias("tiles"),
        (F.coalesce(F.col("has_tci") != 0, F.lit(False)) | has_best).alias("has_tci"),
    )


def id_lookup(water: DataFrame) -> DataFrame:
    """Every spelling of every id: ``key, lake_uid``; the smaller body wins a key."""
    forms = [C.clean_id(F.col(c)) for c in ID_COLUMNS]
    forms += [F.concat(F.lit("osm_"), C.clean_id(F.col(c))) for c in ("osm_id_text", "osm_way_id_text")]
    keys = F.array_distinct(F.concat(F.array_compact(F.array(*forms)), C.id_aliases(F.col("lake_uid"))))
    later = F.struct((-G.stable_area(F.col("area_km2"))).alias("a"), F.col("lake_uid").alias("u"))
    return (
        water.select(F.explode(keys).alias("key"), "lake_uid", "area_km2")
        .groupBy("key")
        .agg(F.max_by("lake_uid", later).alias("lake_uid"))
    )


def find_bodies(water: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve requested keys; unknown ones come back with a NULL id."""
    return requests.join(id_lookup(water), "key", "left")
