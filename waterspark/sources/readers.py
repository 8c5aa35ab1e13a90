"""Readers for the input formats: Parquet features, GeoJSON, KML, CSV, JSON, file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterspark.functions import clean as C
from waterspark.functions import geometry as G
from waterspark.operators.numbering import with_position

# --- fixed values -----------------------------------------------------------
TILE_PATTERN = r"^\d{2}[A-Z]{3}$"
LANDCOVER_FILE = "ESA_WorldCover_10m_2021_v200_%s_Map.tif"
OCCURRENCE_FILE = "%s_%sv1_4_2021.tif"
OCCURRENCE_LAYERS = ["occurrence", "seasonality"]
INDEX_SCHEMA = "tile string, date string, source string, valid_ratio double, product string, cloud_cover string, tci_path string"
PRODUCT_SCHEMA = (
    "lake_id string, product_id string, product_name string, tile string, date string, cloud_cover string, product_type string, "
    "source string, safe_path string, tci_path string, download_status string, downloaded_at string, valid_ratio string"
)
CATALOGUE_SCHEMA = (
    "Id string, Name string, Online boolean, ContentLength long, OriginDate string, "
    "Attributes array<struct<Name:string,Value:string>>, GeoFootprint struct<type:string,coordinates:string>"
)
# ----------------------------------------------------------------------------


def read_features(
    spark: SparkSession, path: str, columns: list[str], bbox: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Polygon features with chosen columns; the box test reaches the Parquet scan."""
    box = ["bbox_west", "bbox_south", "bbox_east", "bbox_north"]
    df = spark.read.parquet(path)
    if bbox is not None:
        w, s, e, n = bbox
        df = df.where(
            (F.col(box[0]) <= e) & (F.col(box[2]) >= w) & (F.col(box[1]) <= n) & (F.col(box[3]) >= s)
        )
    return df.where(~G.is_empty(F.col("geometry"))).select(*columns, *box, "geometry")


def _tile_name(c: Column) -> Column:
    return C.tile_code(C.strip(F.coalesce(c, F.lit(""))))


def coordinates(kind: Column, text: Column) -> Column:
    """GeoJSON coordinates text to a geometry; a third ordinate is dropped."""
    many = F.from_json(text, "array<array<array<array<double>>>>")
    one = F.from_json(text, "array<array<array<double>>>")
    return F.when(kind == "MultiPolygon", G.from_coordinates(many)).when(kind == "Polygon", G.from_coordinates(F.array(one)))


def read_grid_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Tile grid of a GeoJSON FeatureCollection: ``tile, geometry``."""
    schema = "features array<struct<properties:struct<Name:string,name_:string>,geometry:struct<type:string,coordinates:string>>>"
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r'"name"\s*:', '"name_":').alias("value"))
    found = text.select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    kind, coords = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    name = F.coalesce(F.nullif(F.col("f.properties.Name"), F.lit("")), F.col("f.properties.name_"))
    return (
        found.select(_tile_name(name).alias("tile"), coordinates(kind, coords).alias("geometry"))
        .where(F.col("tile").rlike(TILE_PATTERN) & F.col("geometry").isNotNull())
    )


def _kml_ring(text: Column) -> Column:
    points = F.filter(F.split(C.strip(text), r"\s+"), lambda s: F.size(F.split(s, ",")) >= 2)
    ring = F.transform(points, lambda s: G.point(F.split(s, ",")[0], F.split(s, ",")[1]))
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return F.when((F.size(ring) > 0) & (first != last), F.concat(ring, F.array(first))).otherwise(ring)


def read_grid_kml(spark: SparkSession, path: str) -> DataFrame:
    """Tile grid of KML placemarks: outer and inner rings, short rings dropped."""
    ring = "struct<LinearRing:struct<coordinates:string>>"
    polygon = f"array<struct<outerBoundaryIs:{ring},innerBoundaryIs:array<{ring}>>>"
    schema = f"name string, Polygon {polygon}, MultiGeometry struct<Polygon:{polygon}>"
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    polys = F.coalesce("Polygon", "MultiGeometry.Polygon")

    def rings(p: Column) -> Column:
        inner = F.coalesce(F.transform(p["innerBoundaryIs"], lambda r: _kml_ring(r["LinearRing"]["coordinates"])), F.array())
        every = F.concat(F.array(_kml_ring(p["outerBoundaryIs"]["LinearRing"]["coordinates"])), inner)
        return F.filter(every, lambda r: F.size(r) >= 4)

    with_shell = F.filter(polys, lambda p: p["outerBoundaryIs"]["LinearRing"]["coordinates"].isNotNull())
    geometry = F.filter(F.transform(with_shell, rings), lambda p: F.size(p) > 0)
    out = marks.select(_tile_name(F.col("name")).alias("tile"), geometry.alias("geometry"))
    return out.where(F.col("tile").rlike(TILE_PATTERN) & ~G.is_empty(F.col("geometry")))


def first_nonempty(candidates: list[DataFrame]) -> DataFrame:
    """Rows of the first candidate that has any, as one plan."""
    every = candidates[0].withColumn("_prio", F.lit(0))
    for i, df in enumerate(candidates[1:], 1):
        every = every.unionByName(df.withColumn("_prio", F.lit(i)))
    best = every.agg(F.min("_prio"))
    return every.where(F.col("_prio") == best.scalar()).drop("_prio")


def only_available(df: DataFrame, inventory: DataFrame, column: str = "tci_path") -> DataFrame:
    """Rows whose file exists according to the file inventory."""
    return df.join(inventory.select(F.col("path").alias(column)).distinct(), column, "left_semi")


def read_imagery_index(spark: SparkSession, path: str) -> DataFrame:
    """Imagery index CSV; rows keep a position so that the last one of a tile can win.

    Positions follow file names, then places in a file, however files are packed to tasks.
    """
    raw = spark.read.csv(path, header=True, schema=INDEX_SCHEMA)
    rows = raw.withColumns(
        {
            "tile": F.upper("tile"),
            "valid_ratio": F.coalesce("valid_ratio", F.lit(0.0)),
            "_file": F.col("_metadata.file_path"),
            "_block": F.col("_metadata.file_block_start"),
            "_line": F.monotonically_increasing_id(),
        }
    )
    return with_position(rows, [F.col("_file"), F.col("_block"), F.col("_line")], "pos").drop("_file", "_block", "_line")


def read_user_products(spark: SparkSession, path: str) -> DataFrame:
    """User product CSV with cleaned fields and defaults; rows without a tile drop out."""
    raw = spark.read.csv(path, header=True, schema=PRODUCT_SCHEMA)
    out = raw.select(
        C.tile_code(F.coalesce("tile", F.lit(""))).alias("tile"),
        C.first_present(C.clean_id(F.col("lake_id")), default="").alias("lake_id"),
        F.coalesce(C.clean_id(F.col("date")), C.product_date(F.col("product_name")), F.lit("")).alias("date"),
        C.first_present(F.col("source"), default="user_download").alias("source"),
        C.number_or(F.col("valid_ratio"), 1.0).alias("valid_ratio"),
        *[C.first_present(C.clean_id(F.col(a)), default="").alias(b) for a, b in (("product_name", "product"), ("product_id", "product_id"), ("cloud_cover", "cloud_cover"), ("safe_path", "safe_path"))],
        "tci_path",
    )
    return out.where("tile <> ''")


def read_active(spark: SparkSession, path: str) -> DataFrame:
    """Active-selection JSON as ``scope_key, product``; broken JSON is an empty table."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("scope_key", "product"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples CSV: every column text, blanks instead of NULL."""
    return spark.read.csv(path, header=True, inferSchema=False).na.fill("")


def parse_catalogue(df: DataFrame, column: str = "value") -> DataFrame:
    """Catalogue JSON to flat product rows with their footprint."""
    return df.withColumn("p", F.from_json(F.col(column), CATALOGUE_SCHEMA)).select(
        F.col("p.Id").alias("product_id"),
        F.coalesce("p.Name", F.lit("")).alias("name"),
        C.product_tile(F.col("p.Name")).alias("tile"),
        C.product_date(F.col("p.Name")).alias("date"),
        F.get(F.filter("p.Attributes", lambda a: a["Name"] == "cloudCover"), F.lit(0))["Value"].cast("double").alias("cloud_cover"),
        coordinates(F.col("p.GeoFootprint.type"), F.col("p.GeoFootprint.coordinates")).alias("geometry"),
        F.col("p.Online").alias("online"),
        F.col("p.ContentLength").alias("content_length"),
        F.col("p.OriginDate").alias("origin_date"),
    )


def image_folders(inventory: DataFrame) -> DataFrame:
    """Local images by folder: ``folder, file, path`` for ``*.img`` one level down."""
    parts = r"([^/]+)/([^/]+\.img)$"
    return inventory.where(F.col("path").rlike(parts)).select(
        F.regexp_extract("path", parts, 1).alias("folder"), F.regexp_extract("path", parts, 2).alias("file"), "path"
    ).distinct()


def local_labels(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """Label files in the image folders of each body, newest first per ``label_order``."""
    folders = products.where("source = 'local_img' AND lake_id <> '' AND safe_path <> ''").select("lake_id", F.col("safe_path").alias("folder")).distinct()
    files = inventory.where(F.col("path").endswith(".shp")).select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).distinct()
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.shp$", "")
    return folders.join(files, "folder").select(
        "lake_id", C.short_sha1(F.col("path")).alias("label_id"), name.alias("name"), stem.alias("stem"), C.label_date(stem).alias("date"), "path"
    ).dropDuplicates(["lake_id", "path"])


def label_order() -> list[Column]:
    return [F.col("date").desc(), F.col("name").desc()]


def label_features(labels: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of each label as GeoJSON text, and the feature count per label.

    ``features`` has ``path, props map<string,string>, geometry``."""
    joined = labels.join(features.where(~G.is_empty(F.col("geometry"))), "path")
    props = F.map_concat(
        F.map_filter("props", lambda k, v: ~k.isin("label_id", "label_name", "source")),
        F.create_map(F.lit("label_id"), F.col("label_id"), F.lit("label_name"), F.col("name"), F.lit("source"), F.lit("local_label")),
    )
    text = F.concat(F.lit('{"type":"Feature","geometry":'), G.geojson(F.col("geometry")), F.lit(',"properties":'), F.to_json(props), F.lit("}"))
    return joined.select("lake_id", "label_id", text.alias("feature")), joined.groupBy("lake_id", "label_id").agg(F.count(F.lit(1)).alias("feature_count"))


def raster_files(regions: DataFrame) -> DataFrame:
    """Raster tiles each region needs: land cover once, occurrence per layer."""
    land = regions.select("region", F.lit("landcover").alias("kind"), F.explode("esa_tiles").alias("tile"))
    layer = F.explode(F.array(*[F.lit(v) for v in OCCURRENCE_LAYERS]))
    water = regions.select("region", F.explode("jrc_tiles").alias("tile")).withColumn("kind", layer)
    return land.select("region", "kind", "tile", F.format_string(LANDCOVER_FILE, "tile").alias("file")).unionByName(
        water.select("region", "kind", "tile", F.format_string(OCCURRENCE_FILE, "kind", "tile").alias("file"))
    )
