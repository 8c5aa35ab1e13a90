"""Readers and sinks: tables are written out in a source's format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waterspark.functions import geometry as G
from waterspark.operators import imagery, upsert
from waterspark.plans.fixtures import cte, fixture
from waterspark.plans.registry import query
from waterspark.plans.spatial_queries import grid, water
from waterspark.session import new_shared_path
from waterspark.sources import readers, sinks

_GRID_SQL = "SELECT tile, round(w100/100e0, 6) AS west, round((s100+dy)/100e0, 6) AS north, 5 AS points FROM fx_tiles"


def _grid_view(df: DataFrame) -> DataFrame:
    b = G.bounds(F.col("geometry"))
    return df.select("tile", F.round(b["xmin"], 6).alias("west"), F.round(b["ymax"], 6).alias("north"), F.size(F.col("geometry")[0][0]).alias("points"))


def _collection(df: DataFrame, path: str) -> None:
    """A tile grid (bounded by the planet) as one FeatureCollection file."""
    ring = F.transform(F.col("geometry")[0][0], lambda p: F.array(p["x"], p["y"], F.lit(0.0)))
    name = F.when(F.ascii(F.substring("tile", 4, 1)) % 2 == 0, F.struct(F.concat(F.lit(" T"), F.lower("tile")).alias("Name"), F.lit(None).cast("string").alias("name"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("Name"), F.col("tile").alias("name"))
    )
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), name.alias("properties"), shape.alias("geometry"))
    junk = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("bad").alias("Name"), F.lit("x").alias("name")).alias("properties"), shape.alias("geometry"))
    df.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.concat(F.collect_list(feature), F.collect_list(junk)).alias("features")))).write.text(path)


@query("grid_from_geojson", cte("fx_tiles") + _GRID_SQL)
def grid_from_geojson(spark: SparkSession, sf: str) -> DataFrame:
    path = new_shared_path(spark, "geojson")
    _collection(grid(spark, sf), path)
    return _grid_view(readers.read_grid_geojson(spark, path))


@query("grid_from_kml", cte("fx_tiles") + _GRID_SQL)
def grid_from_kml(spark: SparkSession, sf: str) -> DataFrame:
    """Rings are left open in the file and closed by the reader."""
    path = new_shared_path(spark, "kml")
    pts = F.slice(F.col("geometry")[0][0], 1, 4)
    text = F.array_join(F.transform(pts, lambda p: F.concat(p["x"], F.lit(","), p["y"], F.lit(",0"))), " ")
    ring = F.concat(F.lit("<outerBoundaryIs><LinearRing><coordinates> "), text, F.lit(" </coordinates></LinearRing></outerBoundaryIs>"))
    short = F.lit("<innerBoundaryIs><LinearRing><coordinates>1,1 2,2</coordinates></LinearRing></innerBoundaryIs>")
    mark = F.concat(F.lit("<Placemark><name>T"), "tile", F.lit("</name><MultiGeometry><Polygon>"), ring, short, F.lit("</Polygon></MultiGeometry></Placemark>"))
    doc = F.concat(F.lit("<kml><Document><Placemark><name>x</name></Placemark>"), F.array_join(F.collect_list(mark), ""), F.lit("</Document></kml>"))
    grid(spark, sf).agg(doc).write.text(path)
    return _grid_view(readers.read_grid_kml(spark, path))


@query(
    "source_fallback",
    cte("fx_tiles", "fx_water")
    + "SELECT tile AS name, 'grid' AS src FROM fx_tiles UNION ALL SELECT lake_uid, 'features' FROM fx_water WHERE w100 <= 11200 AND w100+dx >= 11000 AND s100 <= 2700 AND s100+dy >= 2600",
)
def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """First non-empty grid source, and features read back with a pushed-down box."""
    tiles = grid(spark, sf)
    best = readers.first_nonempty([tiles.where("tile = 'none'"), tiles, tiles.where("tile LIKE '%A'")])
    home = new_shared_path(spark, "features")
    sinks.write_grid(best, f"{home}/grid")
    lines = spark.read.json(f"{home}/grid", schema="properties struct<Name:string>")
    water(spark, sf).select("lake_uid", "bbox_west", "bbox_south", "bbox_east", "bbox_north", "geometry").write.parquet(f"{home}/water")
    found = readers.read_features(spark, f"{home}/water", ["lake_uid"], (110.0, 26.0, 112.0, 27.0))
    return lines.select(F.col("properties.Name").alias("name"), F.lit("grid").alias("src")).unionAll(found.select("lake_uid", F.lit("features")))


@query(
    "ingest_indexes",
    cte("fx_user", "fx_active", "fx_products")
    + """, pre AS (SELECT * FROM fx_products WHERE source = 'preloaded' AND ord % 5 <> 0), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY ord DESC) AS rn FROM pre) WHERE rn = 1)
    SELECT 'base' AS kind, tile, product, '' AS lake_id, round(CASE WHEN ord % 2 = 0 THEN valid_ratio ELSE 0 END, 6) AS valid_ratio FROM b
    UNION ALL SELECT 'user', tile, product, lake_id, round(CASE WHEN ord % 2 = 0 THEN valid_ratio ELSE 1 END, 6) FROM fx_user WHERE ord % 5 <> 0 AND ord % 13 <> 0
    UNION ALL SELECT 'active', CASE WHEN contains(scope_key, ':') THEN split_part(scope_key, ':', 2) ELSE scope_key END, product, CASE WHEN contains(scope_key, ':') THEN split_part(scope_key, ':', 1) ELSE '' END, NULL FROM fx_active""",
)
def ingest_indexes(spark: SparkSession, sf: str) -> DataFrame:
    home = new_shared_path(spark, "indexes")
    p = fixture(spark, sf, "fx_products").withColumns(
        {"path": F.concat("tci_path", F.lit("#"), "ord"), "ratio": F.when(F.col("ord") % 2 == 0, F.col("valid_ratio"))}
    )
    p.where("source = 'preloaded'").repartitionByRange(5, "ord").sortWithinPartitions("ord").select(
        F.lower("tile").alias("tile"), F.col("day").alias("date"), "source", F.col("ratio").alias("valid_ratio"), "product", "cloud_cover", F.col("path").alias("tci_path")
    ).write.csv(f"{home}/index", header=True)
    blank = F.lit("")
    p.where("source <> 'preloaded'").select(
        F.when(F.col("lake_id") != "", F.col("lake_id")).otherwise("nan").alias("lake_id"), "product_id", F.col("product").alias("product_name"),
        F.when(F.col("ord") % 13 != 0, F.concat(F.lit("T"), "tile")).otherwise(blank).alias("tile"), blank.alias("date"), "cloud_cover", blank.alias("product_type"), "source", "safe_path",
        F.col("path").alias("tci_path"), blank.alias("download_status"), blank.alias("downloaded_at"), F.col("ratio").alias("valid_ratio"),
    ).write.csv(f"{home}/user", header=True)
    fixture(spark, sf, "fx_active").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("scope_key", "product"))))
    ).write.text(f"{home}/active")
    there = p.where("ord % 5 <> 0").select("path")
    base = imagery.base_imagery(readers.only_available(readers.read_imagery_index(spark, f"{home}/index"), there), "pos")
    user = readers.only_available(readers.read_user_products(spark, f"{home}/user"), there)
    active = imagery.active_table(readers.read_active(spark, f"{home}/active"))
    return (
        base.select(F.lit("base").alias("kind"), "tile", "product", F.lit("").alias("lake_id"), F.round("valid_ratio", 6).alias("valid_ratio"))
        .unionAll(user.select(F.lit("user"), "tile", "product", "lake_id", F.round("valid_ratio", 6)))
        .unionAll(active.select(F.lit("active"), "tile", "product", "scope", F.lit(None).cast("double")))
    )


@query(
    "samples_roundtrip",
    cte("fx_updates")
    + """SELECT sample_id, concat('', event_id) AS event_id, quality, split, '' AS extra FROM fx_updates WHERE event_id % 2 = 0 UNION ALL SELECT sample_id, concat('', event_id), '', '', quality FROM fx_updates WHERE event_id % 2 = 1""",
)
def samples_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with different columns are united, written as CSV and read back as text."""
    u = fixture(spark, sf, "fx_updates")
    first = u.where("event_id % 2 = 0").select("sample_id", "event_id", "quality", "split")
    second = u.where("event_id % 2 = 1").select("sample_id", "event_id", F.col("quality").alias("extra"))
    path = new_shared_path(spark, "samples")
    sinks.write_samples(upsert.union_columns(first, second), path)
    return readers.read_samples(spark, path)


@query(
    "catalogue_parse",
    cte("fx_products", "fx_tiles")
    + """SELECT p.product_id, p.product AS name, p.tile, p.day AS date, p.cloud_cover, ord % 2 = 0 AS online, ord*1000 AS content_length, round(t.w100/100e0, 6) AS west FROM fx_products p LEFT JOIN fx_tiles t ON t.tile = p.tile""",
)
def catalogue_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = fixture(spark, sf, "fx_products").join(grid(spark, sf), "tile", "left")
    ring = F.transform(F.col("geometry")[0][0], lambda q: F.array(q["x"], q["y"]))
    cloud = F.when(F.col("cloud_cover").isNotNull(), F.array(F.struct(F.lit("cloudCover").alias("Name"), F.col("cloud_cover").cast("string").alias("Value"))))
    attrs = F.concat(F.array(F.struct(F.lit("orbit").alias("Name"), F.lit("7").alias("Value"))), F.coalesce(cloud, F.array().cast("array<struct<Name:string,Value:string>>")))
    body = F.struct(
        F.col("product_id").alias("Id"), F.col("product").alias("Name"), (F.col("ord") % 2 == 0).alias("Online"), (F.col("ord") * 1000).alias("ContentLength"),
        attrs.alias("Attributes"), F.when(F.col("geometry").isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("GeoFootprint"),
    )
    got = readers.parse_catalogue(p.select(F.to_json(body).alias("value")))
    return got.select("product_id", "name", "tile", "date", "cloud_cover", "online", "content_length", F.round(G.bounds(F.col("geometry"))["xmin"], 6).alias("west"))


@query(
    "image_inventory",
    cte("fx_products") + """SELECT concat('', folder) AS folder, count(*) AS n, max(file) AS last_file FROM (SELECT DISTINCT split_part(tci_path, '/', 2) AS folder, split_part(tci_path, '/', 3) AS file FROM fx_products) GROUP BY folder""",
)
def image_inventory(spark: SparkSession, sf: str) -> DataFrame:
    p = fixture(spark, sf, "fx_products")
    paths = p.select(F.col("tci_path").alias("path")).unionAll(p.select("tci_path")).unionAll(p.select(F.concat("safe_path", F.lit("/readme.txt"))))
    return readers.image_folders(paths).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.max("file").alias("last_file"))


_LABELS = "SELECT concat(safe_path, '/lab_', replace(day, '-', CASE ord % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE '' END), '.shp') AS path, ord, safe_path FROM {p}"
_LABELS_SQL = {
    "inv": "SELECT DISTINCT path, safe_path FROM (" + _LABELS.format(p="fx_products") + ")",
    "own": "SELECT DISTINCT lake_id, safe_path FROM fx_products WHERE source = 'local_img' AND lake_id <> ''",
    "lab": "SELECT o.lake_id, substr(sha1(path), 1, 12) AS label_id, split_part(path, '/', 3) AS name, path FROM own o JOIN inv USING (safe_path)",
}


@query("local_labels", cte("fx_products", more=_LABELS_SQL) + "SELECT lake_id, label_id, name, regexp_replace(regexp_extract(name, 'lab_(.*)\\.shp', 1), '^(\\d{4})[-_]?(\\d{2})[-_]?(\\d{2})$', '\\1-\\2-\\3') AS date FROM lab")
def local_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = fixture(spark, sf, "fx_products")
    return readers.local_labels(p, spark.sql(_LABELS, p=p)).select("lake_id", "label_id", "name", "date")


@query("label_features", cte("fx_products", more=_LABELS_SQL) + "SELECT lake_id, label_id, count(*) AS n, true AS named FROM lab JOIN (SELECT concat(safe_path, '/lab_', replace(day, '-', CASE ord % 3 WHEN 0 THEN '-' WHEN 1 THEN '_' ELSE '' END), '.shp') AS path FROM fx_products) f USING (path) GROUP BY lake_id, label_id")
def label_features(spark: SparkSession, sf: str) -> DataFrame:
    p = fixture(spark, sf, "fx_products")
    files = spark.sql(_LABELS, p=p)
    box = G.box_polygon(F.col("ord") % 90, F.col("ord") % 40, F.col("ord") % 90 + 1, F.col("ord") % 40 + 1)
    feats = files.select("path", F.create_map(F.lit("source"), F.lit("x"), F.lit("ord"), F.col("ord").cast("string")).alias("props"), box.alias("geometry"))
    made, counts = readers.label_features(readers.local_labels(p, files), feats)
    ok = made.groupBy("lake_id", "label_id").agg(
        F.bool_and(F.get_json_object("feature", "$.properties.label_id") == F.col("label_id")).alias("named")
    )
    return counts.withColumnRenamed("feature_count", "n").join(ok, ["lake_id", "label_id"])


@query(
    "region_tiles",
    """WITH r AS (SELECT lower(r_name) AS region, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey)
    SELECT region, 'landcover' AS kind, printf('ESA_WorldCover_10m_2021_v200_N%02dE%03d_Map.tif', n_nationkey, 3*n_nationkey) AS file FROM r
    UNION ALL SELECT region, k, printf('%s_%dE_30Nv1_4_2021.tif', k, 10*n_nationkey) FROM r JOIN (SELECT unnest(['occurrence', 'seasonality']) AS k) ON true""",
)
def region_tiles(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.read.parquet(f"{sf}/region.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    dim = r.groupBy(F.lower("r_name").alias("region")).agg(
        F.collect_list(F.format_string("N%02dE%03d", "n_nationkey", F.col("n_nationkey") * 3)).alias("esa_tiles"),
        F.collect_list(F.format_string("%dE_30N", F.col("n_nationkey") * 10)).alias("jrc_tiles"),
    )
    return readers.raster_files(dim).select("region", "kind", "file")


@query(
    "layer_table",
    cte("fx_water") + """SELECT source, threshold, count(*) AS n, min(concat('hunan_osm_', k, '_x')) AS first_key FROM fx_water JOIN (SELECT unnest(['esa', 'jrc', 'jrc']) AS source, unnest([0, 50, 75]) AS threshold) ON true GROUP BY source, threshold""",
)
def layer_table(spark: SparkSession, sf: str) -> DataFrame:
    home = new_shared_path(spark, "layers")
    kinds = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("threshold")) for s, t in (("esa", 0), ("jrc", 50), ("jrc", 75))])
    rows = water(spark, sf).select(F.concat("lake_uid", F.lit("/ x")).alias("lake_uid"), "geometry", F.explode(kinds).alias("q")).select("lake_uid", "geometry", "q.*")
    sinks.write_layers(rows, home)
    return spark.read.parquet(home).groupBy("source", "threshold").agg(F.count(F.lit(1)).alias("n"), F.min("safe_key").alias("first_key"))


@query(
    "water_sink",
    cte("fx_water") + "SELECT region, count(*) AS n, min(lake_uid) AS first_uid FROM fx_water GROUP BY region",
)
def water_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The partitioned table and its CSV twin hold the same rows."""
    home = new_shared_path(spark, "water")
    sinks.write_water(water(spark, sf), home)
    table, text = spark.read.parquet(f"{home}/table"), spark.read.csv(f"{home}/csv", header=True)
    both = table.select("region", "lake_uid").join(text.select("region", "lake_uid"), ["region", "lake_uid"], "left_semi")
    return both.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("lake_uid").alias("first_uid"))
