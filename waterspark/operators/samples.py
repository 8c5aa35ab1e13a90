"""Training samples: creation, status, statistics, label layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waterspark.functions import clean as C
from waterspark.functions import geometry as G
from waterspark.operators import upsert
from waterspark.operators.hot_keys import join_spread
from waterspark.session import cut_lineage

EDITABLE = C.EDITABLE_SAMPLE_COLUMNS


def _packed(field: Column, sep: str = ",") -> Column:
    return F.array_join(field, sep, "")


def label_layers(osm: DataFrame, reference: DataFrame, landcover: DataFrame, occurrence: DataFrame) -> DataFrame:
    """The four label sources as one table ``lake_uid, label_source, threshold, geometry``.

    The own polygon counts only for bodies whose primary source it is and that carry the
    flag; the occurrence source comes per threshold.
    """
    none = F.lit(None).cast("int")
    own = osm.where((C.clean_text(F.col("source_primary")) == "osm") & C.truthy(F.col("has_osm_polygon"), True))
    layers = [(own, "osm", none), (reference, "hydrolakes", none), (landcover, "esa", none), (occurrence, "jrc", F.col("threshold").cast("int"))]
    parts = [
        df.where(F.col("geometry").isNotNull()).select("lake_uid", F.lit(name).alias("label_source"), level.alias("threshold"), "geometry")
        for df, name, level in layers
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def body_detail(summary: DataFrame, osm_layer: DataFrame, reference: DataFrame, key: str = "lake_uid") -> DataFrame:
    """Summary with the own polygon and the on-demand reference match."""
    own = osm_layer.select(key, F.col("geometry").alias("osm_geometry"))
    return summary.join(own, key, "left").join(reference, key, "left")


def create_samples(requests: DataFrame, ready: DataFrame, bodies: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sample rows for the requests of ready bodies with a label, and every other request
    with the reason: the two parts of ``asked_samples``."""
    every = asked_samples(requests, ready, bodies, labels)
    refused = every.where(~F.col("ok")).select(F.col("lake_id").alias("lake_uid"), "label_source", "reason")
    return every.where("ok").drop("ok", "reason"), refused


def asked_samples(requests: DataFrame, ready: DataFrame, bodies: DataFrame, labels: DataFrame) -> DataFrame:
    """The sample row of every request: ``ok`` for those of ready bodies with a label, else
    with the ``reason`` against it, and then the other columns may be NULL. ``ready`` is the
    readiness table, ``labels`` the label layers.

    Sources are known in any case; a threshold that is no number is the default, and
    numbers count as the nearest from 1 to 100.
    """
    # Kept: conditions of the joins below would work the cleaned texts out many times over, and
    # for a table of one file in one task.
    asked = cut_lineage(C.with_label_defaults(requests).withColumns(label_key("label_source", "label_threshold")))
    box = ["bbox_west", "bbox_south", "bbox_east", "bbox_north"]
    known = bodies.select("lake_uid", "lake_name", *box, F.lit(True).alias("_known"))
    joined = asked.join(known, "lake_uid", "left").join(ready, "lake_uid", "left")
    layer = labels.select("lake_uid", F.col("label_source").alias("_source"), F.coalesce("threshold", F.lit(-1)).alias("_level"), F.lit(True).alias("_label"))
    joined = joined.join(layer, ["lake_uid", "_source", "_level"], "left")
    p = F.col("products")

    def each(field: str, sep: str = ",") -> Column:
        return _packed(F.transform(p, lambda r: F.coalesce(r[field], F.lit(""))), sep)

    def asset(field: str) -> Column:
        return _packed(F.transform(p, lambda r: r["asset"][field]))

    def asset_label(r: Column) -> Column:
        kind = r["asset"]["asset_type"]
        out = F.when(kind == "lake_native", C.ASSET_LABELS["lake_native"]).when(kind == "preloaded_tile", C.ASSET_LABELS["preloaded_tile"])
        return out.otherwise(C.ASSET_LABELS["sentinel_tile"])

    is_ready = F.coalesce("ready", F.lit(False))
    ok = F.coalesce("_known", F.lit(False)) & is_ready & F.coalesce("_label", F.lit(False))
    aoi = G.aoi_bounds(*[F.col(c) for c in box], F.col("buffer_ratio"))
    names = each("product")
    rows = joined.withColumns({"_names": names, "_aoi": aoi, "_tiles": each("tile")})
    sid = C.sample_id(F.col("lake_uid"), F.col("_names"), *[F.col(c) for c in ("label_source", "label_threshold", "label_scope", "mask_policy")])
    reason = (
        F.when(F.col("_known").isNull(), "unknown body")
        .when(~is_ready, F.concat(F.lit("missing tiles: "), F.coalesce(F.array_join("missing_tiles", ", "), F.lit(""))))
        .when(~F.col("_source").isin(C.LABEL_SOURCES), F.concat(F.lit("unknown label source: "), F.col("label_source")))
        .otherwise("label source has no geometry")
    )
    return rows.select(
        sid.alias("sample_id"),
        F.col("lake_uid").alias("lake_id"),
        F.coalesce("lake_name", F.lit("")).alias("lake_name"),
        F.col("_tiles").alias("tile"),
        F.col("_tiles").alias("tiles"),
        each("product_id").alias("product_id"),
        F.col("_names").alias("product_name"),
        F.col("_names").alias("products"),
        each("source").alias("product_source"),
        *[asset("asset_type").alias(c) for c in ("imagery_asset_type", "imagery_asset_types")],
        *[asset("asset_scope").alias(c) for c in ("imagery_asset_scope", "imagery_asset_scopes")],
        *[_packed(F.transform(p, asset_label)).alias(c) for c in ("imagery_asset_label", "imagery_asset_labels")],
        each("date").alias("product_date"),
        each("safe_path", ";").alias("safe_path"),
        each("tci_path", ";").alias("tci_path"),
        "label_source", "label_threshold", "label_scope", "mask_policy", "context_sources", "ignore_sources",
        F.concat(C.safe_id(sid), F.lit(".geojson")).alias("label_path"),
        *[F.col(f"_aoi.{a}").alias(f"aoi_{n}") for a, n in (("xmin", "west"), ("ymin", "south"), ("xmax", "east"), ("ymax", "north"))],
        "buffer_ratio", "quality",
        (C.first_present(F.col("split"), default="") if "split" in requests.columns else F.lit("")).alias("split"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ").alias("created_at"),
        "notes",
        ok.alias("ok"),
        F.when(~ok, reason).alias("reason"),
    )


def label_key(source: str, threshold: str) -> dict[str, Column]:
    """Source and level under which a label layer is found; no level is -1."""
    name = F.lower(C.clean_text(F.col(source)))
    number = F.coalesce(C.clean_text(F.col(threshold)).try_cast("int"), F.lit(C.DEFAULT_LABEL_THRESHOLD))
    return {"_source": name, "_level": F.when(name == "jrc", F.greatest(F.lit(1), F.least(F.lit(100), number))).otherwise(-1)}


def label_rows(made: DataFrame, labels: DataFrame) -> DataFrame:
    """The label of each sample as a feature: path, properties and geometry.

    The layer's own properties come first, then the sample's scope and policies; see
    ``sinks.feature_line`` for the text of a row.
    """
    keyed = made.withColumns(label_key("label_source", "label_threshold"))
    layer = labels.select(
        F.col("lake_uid").alias("lake_id"), F.col("label_source").alias("_source"), F.coalesce("threshold", F.lit(-1)).alias("_level"), "threshold", "geometry"
    )
    settings = [F.col(c) for c in ("label_scope", "mask_policy", "context_sources", "ignore_sources")]
    joined = keyed.join(layer, ["lake_id", "_source", "_level"])
    return joined.select("sample_id", "label_path", F.struct(F.col("lake_id").alias("lake_uid"), F.col("_source").alias("source"), "threshold", *settings).alias("properties"), "geometry")


def store_samples(table: DataFrame, made: DataFrame) -> DataFrame:
    """Upsert by sample id; equal requests made twice leave one row."""
    return upsert.upsert(table, made, "sample_id", ["created_at", "lake_id"])


def sample_status(samples: DataFrame, inventory: DataFrame, bodies: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Samples with file status, list sizes, asset lists and the body's display name.

    ``lookup`` resolves other spellings of a body's id (``search.id_lookup``).

    ``inventory`` lists existing paths. Paths are exploded and met by an equi-join, so no
    task ever looks a path up on its own.
    """
    known = inventory.select("path", F.lit(True).alias("_there")).distinct()

    def missing(column: str, out: str) -> DataFrame:
        paths = samples.select("sample_id", F.posexplode(C.split_list(F.col(column), ";")).alias("pos", "path"))
        gone = paths.join(known, "path", "left_anti")
        listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "path"))), lambda p: p["path"])
        return gone.groupBy("sample_id").agg(listed.alias(out))

    empty = F.array().cast("array<string>")
    label = known.withColumnsRenamed({"path": "label_path", "_there": "_label"})
    out = (
        samples.join(missing("tci_path", "missing_tci"), "sample_id", "left")
        .join(missing("safe_path", "missing_safe"), "sample_id", "left")
        .join(label, "label_path", "left")
    )
    names = bodies.select("lake_uid", F.col("display_name").alias("_shown"))
    if lookup is None:
        names = names.withColumnRenamed("lake_uid", "lake_id")
    else:
        names = lookup.select(F.col("key").alias("lake_id"), "lake_uid").join(names, "lake_uid").drop("lake_uid")
    # Samples of no body share the empty id.
    out = join_spread(out, names, "lake_id", counted=samples.select("lake_id"))
    lists = {}
    for many, one in (("imagery_asset_labels", "imagery_asset_label"), ("imagery_asset_types", "imagery_asset_type")):
        there = [F.col(c) for c in (many, one) if c in samples.columns]
        lists[many] = C.split_list(C.first_present(*there)) if there else empty
    exists = F.coalesce("_label", F.lit(False))
    return out.withColumns(
        {
            "missing_tci": F.coalesce("missing_tci", empty),
            "missing_safe": F.coalesce("missing_safe", empty),
            "label_exists": exists,
            "status": F.when(F.col("missing_tci").isNotNull() | ~exists, "missing_files").otherwise("ok"),
            "tile_count": F.size(C.split_list(C.first_present(F.col("tiles"), F.col("tile")))),
            "product_count": F.size(C.split_list(C.first_present(F.col("products"), F.col("product_name")))),
            "lake_display_name": C.first_present(F.col("_shown"), F.col("lake_name"), F.col("lake_id")),
            **lists,
        }
    ).drop("_label", "_shown")


def sample_stats(samples: DataFrame) -> DataFrame:
    """Counts by quality and split next to the total: ``kind, value, n``."""
    parts = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("all").alias("value")),
        F.struct(F.lit("quality").alias("kind"), C.clean_id(F.col("quality")).alias("value")),
        F.struct(F.lit("split").alias("kind"), C.clean_id(F.col("split")).alias("value")),
    )
    return samples.select(F.explode(parts).alias("p")).where("p.value IS NOT NULL").groupBy("p.kind", "p.value").agg(F.count(F.lit(1)).alias("n"))


def newest_first(samples: DataFrame) -> DataFrame:
    return samples.orderBy(F.col("created_at").desc(), "sample_id")
