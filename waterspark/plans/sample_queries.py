"""Training samples and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waterspark.operators import catalog, context, imagery, samples, search, upsert
from waterspark.plans.fixtures import HIT, OVERLAP, cte, fixture, m_table, spread
from waterspark.plans.imagery_queries import PAIRS, resolved, tables
from waterspark.plans.registry import query
from waterspark.plans.spatial_queries import refs, required_inputs, water
from waterspark.session import cut_lineage, new_shared_path
from waterspark.sources import sinks
from waterspark.streaming import upserts

_ASK = """SELECT c_custkey AS ord, concat('hunan_osm_', c_custkey) AS lake_uid, CASE c_custkey % 4 WHEN 0 THEN 'hydrolakes' WHEN 1 THEN 'JRC' WHEN 2 THEN 'esa' ELSE NULL END AS label_source,
    CASE WHEN c_custkey % 3 = 0 THEN '50' WHEN c_custkey % 11 = 0 THEN '300' ELSE ' ' END AS label_threshold, CASE WHEN c_custkey % 5 = 0 THEN 'aoi_water' END AS label_scope FROM {customer}"""


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """Label layers: own polygons, matched reference bodies, and box layers."""
    bodies = water(spark, sf).withColumns({"source_primary": F.when(F.col("k") % 7 != 0, "osm").otherwise("hydrolakes"), "has_osm_polygon": F.lit("1")})
    match = catalog.reference_overlap(bodies, refs(spark, sf)).join(refs(spark, sf).select("hylak_id", "geometry"), "hylak_id")
    land = bodies.select("lake_uid", F.when(F.col("k") % 3 != 0, F.col("geometry")).alias("geometry"))
    occ = bodies.select("lake_uid", "geometry", F.explode(F.array(F.lit(50), F.lit(75))).alias("threshold")).where("(threshold = 50) OR length(lake_uid) % 2 = 0")
    return samples.label_layers(bodies, match, land, occ)


_LAYERS = {
    "r0": m_table("fx_ref"),
    "rm": f"SELECT DISTINCT a.lake_uid FROM a0 a JOIN r0 b ON {HIT} WHERE {OVERLAP} > 0",
    "lay": """SELECT lake_uid, 'osm' AS label_source, -1 AS lv FROM a0 WHERE k % 7 <> 0 UNION ALL SELECT lake_uid, 'hydrolakes', -1 FROM rm
      UNION ALL SELECT lake_uid, 'esa', -1 FROM a0 WHERE k % 3 <> 0 UNION ALL SELECT lake_uid, 'jrc', 50 FROM a0 UNION ALL SELECT lake_uid, 'jrc', 75 FROM a0 WHERE length(lake_uid) % 2 = 0""",
}


@query("label_layers", cte("fx_water", "fx_ref", more={"a0": m_table("fx_water"), **_LAYERS}) + "SELECT lake_uid, label_source, nullif(lv, -1) AS threshold FROM lay")
def label_layers(spark: SparkSession, sf: str) -> DataFrame:
    return layers(spark, sf).select("lake_uid", "label_source", "threshold")


def asked(spark: SparkSession, sf: str, labels: DataFrame) -> tuple[DataFrame, ...]:
    """Requests, readiness, bodies and label layers."""
    bodies, grid, feet = required_inputs(spark, sf)
    # Selections of every tile, so that a good part of the bodies is ready.
    base, user, active = tables(spark, sf)
    tiles = context.required_tiles(bodies, grid, feet)
    ready = imagery.readiness(tiles, base, user, active, bodies)
    requests = spark.sql(_ASK, customer=spread(spark, sf, "customer"))
    return requests, ready, bodies.withColumn("lake_name", F.col("name")), labels


_MADE = {
    **PAIRS,
    **resolved("req"),
    **_LAYERS,
    "rdy": """SELECT q.lake_uid, count(*) FILTER (WHERE s.product IS NULL) = 0 AS ready, string_agg(s.product, ',' ORDER BY q.seq) AS products, string_agg(s.tile, ',' ORDER BY q.seq) AS tiles,
      string_agg(q.tile, ', ' ORDER BY q.seq) FILTER (s.product IS NULL) AS missing FROM req q LEFT JOIN res s ON q.lake_uid = s.lake_uid AND q.tile = s.tile GROUP BY q.lake_uid""",
    "ask": "SELECT ord, lake_uid, coalesce(label_source, 'osm') AS label_source, trim(label_threshold) AS label_threshold, coalesce(label_scope, 'target_only') AS label_scope FROM (" + _ASK.format(customer="customer") + ")",
    "full_ask": """SELECT a.*, w.lake_uid IS NOT NULL AS known, coalesce(r.ready, false) AS ready, r.products, r.tiles, r.missing, l.lake_uid IS NOT NULL AS has_label, w.x0, w.y1, greatest(greatest(w.x1-w.x0, w.y1-w.y0)*0.8, 500) AS d FROM ask a LEFT JOIN a0 w ON w.lake_uid = a.lake_uid
      LEFT JOIN rdy r ON r.lake_uid = a.lake_uid LEFT JOIN lay l ON l.lake_uid = a.lake_uid AND l.label_source = lower(a.label_source)
      AND l.lv = CASE WHEN lower(a.label_source) = 'jrc' THEN greatest(1, least(100, coalesce(try_cast(a.label_threshold AS INT), 75))) ELSE -1 END""",
}


@query(
    "sample_create",
    cte("fx_water", "fx_tiles", "fx_user", "fx_base", "fx_active", "fx_ref", more=_MADE)
    + """SELECT concat(lake_uid, '_', substr(sha1(concat(products, label_source, label_threshold, label_scope, 'other_water_ignore')), 1, 12)) AS sample_id, lake_uid AS lake_id, tiles, products,
    label_source, round((x0-d)/111319.49079327357, 6) AS aoi_west, 'made' AS state FROM full_ask WHERE ready AND has_label
    UNION ALL SELECT NULL, lake_uid, CASE WHEN known THEN coalesce(missing, '') ELSE '' END, NULL, label_source, NULL, CASE WHEN NOT known THEN 'unknown body' WHEN ready THEN 'no label' ELSE 'not ready' END FROM full_ask WHERE NOT (ready AND has_label)""",
)
def sample_create(spark: SparkSession, sf: str) -> DataFrame:
    ok, late = F.col("ok"), F.col("reason").startswith("missing tiles")
    state = F.when(ok, "made").when(late, "not ready").when(F.col("reason") == "unknown body", "unknown body").otherwise("no label")
    return samples.asked_samples(*asked(spark, sf, layers(spark, sf))).select(
        F.when(ok, F.col("sample_id")).alias("sample_id"), "lake_id",
        F.when(ok, F.col("tiles")).when(late, F.regexp_replace("reason", "^missing tiles: ", "")).otherwise("").alias("tiles"),
        F.when(ok, F.col("products")).alias("products"), "label_source", F.when(ok, F.round("aoi_west", 6)).alias("aoi_west"), state.alias("state"),
    )


@query(
    "sample_store",
    cte("fx_water", "fx_tiles", "fx_user", "fx_base", "fx_active", "fx_ref", more=_MADE)
    + """, one AS (SELECT DISTINCT concat(lake_uid, '_', substr(sha1(concat(products, label_source, label_threshold, label_scope, 'other_water_ignore')), 1, 12)) AS sample_id, lake_uid AS lake_id FROM full_ask WHERE ready AND has_label)
    SELECT sample_id, lake_id, 'made' AS state FROM one UNION ALL SELECT concat('old', s_suppkey), '', 'old' FROM supplier""",
)
def sample_store(spark: SparkSession, sf: str) -> DataFrame:
    """Samples stored into a table, and stored again: each stays once."""
    rows, _ = samples.create_samples(*asked(spark, sf, layers(spark, sf)))
    # Made once: storing twice looks at the rows four times.
    rows = cut_lineage(rows.select("sample_id", "lake_id", "created_at"))
    old = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("concat('old', s_suppkey) AS sample_id", "'' AS lake_id", "'x' AS created_at")
    twice = samples.store_samples(samples.store_samples(old, rows), rows)
    return twice.select("sample_id", "lake_id", F.when(F.col("created_at") == "x", "old").otherwise("made").alias("state"))


@query(
    "sample_labels",
    cte("fx_water", "fx_tiles", "fx_user", "fx_base", "fx_active", "fx_ref", more=_MADE)
    + """SELECT concat(lake_uid, '_', substr(sha1(concat(products, label_source, label_threshold, label_scope, 'other_water_ignore')), 1, 12), '.geojson') AS label_path, lake_uid, lower(label_source) AS source,
    CASE WHEN lower(label_source) = 'jrc' THEN greatest(1, least(100, coalesce(try_cast(label_threshold AS INT), 75))) END AS threshold, label_scope, 'other_water_ignore' AS mask_policy, true AS has_outline FROM full_ask WHERE ready AND has_label""",
)
def sample_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The label feature of every sample, written and read back."""
    found = layers(spark, sf)
    rows, _ = samples.create_samples(*asked(spark, sf, found))
    path = new_shared_path(spark, "labels")
    labels = samples.label_rows(rows, found)
    labels.select("label_path", sinks.feature_line(F.col("geometry"), F.col("properties")).alias("value")).write.parquet(path)
    shape = "properties struct<lake_uid:string,source:string,threshold:int,label_scope:string,mask_policy:string>, geometry struct<type:string>"
    back = spark.read.parquet(path).withColumn("f", F.from_json("value", shape))
    return back.select("label_path", "f.properties.*", F.col("f.geometry.type").isNotNull().alias("has_outline"))


def sample_table(spark: SparkSession, sf: str) -> DataFrame:
    """Sample rows from the update events: the last event of each sample."""
    return upsert.latest_per_key(fixture(spark, sf, "fx_updates"), "sample_id", ["ts", "event_id"])


_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ts DESC, event_id DESC) AS rn FROM fx_updates) WHERE rn = 1"


@query(
    "sample_update_delete",
    cte("fx_updates", more={"t": _LAST})
    + """, p AS (SELECT concat('S', 2*c_custkey) AS sample_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS quality FROM customer), d AS (SELECT concat('S', 3*s_suppkey) AS sample_id FROM supplier)
    SELECT t.sample_id, coalesce(p.quality, t.quality) AS quality, t.split, 'kept' AS state FROM t LEFT JOIN p ON t.sample_id = p.sample_id WHERE t.sample_id NOT IN (SELECT sample_id FROM d)
    UNION ALL SELECT sample_id, quality, NULL, 'unknown patch' FROM p WHERE sample_id NOT IN (SELECT sample_id FROM t) UNION ALL SELECT sample_id, NULL, NULL, 'unknown delete' FROM d WHERE sample_id NOT IN (SELECT sample_id FROM t)""",
)
def sample_update_delete(spark: SparkSession, sf: str) -> DataFrame:
    table = sample_table(spark, sf).select("sample_id", "quality", "split")
    asked = spark.read.parquet(f"{sf}/customer.parquet")
    patches = asked.selectExpr("concat('S', 2*c_custkey) AS sample_id", "1 AS step", "c_mktsegment AS quality").unionAll(
        # A second patch of the same sample blanks the value.
        asked.selectExpr("concat('S', 2*c_custkey)", "2", "CASE WHEN c_custkey % 3 = 0 THEN ' nan' END")
    )
    drops = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("concat('S', 3*s_suppkey) AS sample_id")
    patched, odd = upsert.patch_rows(table, patches, "sample_id", samples.EDITABLE, ["step"])
    kept, gone = upsert.delete_rows(patched, drops, "sample_id")
    null = F.lit(None).cast("string")
    return (
        kept.withColumn("state", F.lit("kept"))
        .unionAll(odd.select("sample_id", "quality", null, F.lit("unknown patch")))
        .unionAll(gone.select("sample_id", null, null, F.lit("unknown delete")))
    )


_SAMP = """SELECT ord, concat('S', ord) AS sample_id, CASE WHEN ord % 3 = 0 THEN replace(lake_id, 'hunan_', 'hn_') ELSE lake_id END AS lake_id, concat(product, '.geojson') AS label_path, concat(tci_path, ';', 'alt/', ord, '; ') AS tci_path, safe_path, '' AS lake_name,
    CASE WHEN ord % 2 = 0 THEN concat(tile, ',49RAA, ') ELSE '' END AS tiles, tile, product AS product_name, '' AS products FROM {p}"""
_INV = "SELECT tci_path AS path FROM {p} WHERE ord % 7 <> 0 UNION ALL SELECT concat('alt/', ord) FROM {p} WHERE ord % 5 <> 0 UNION ALL SELECT concat(product, '.geojson') FROM {p} WHERE ord % 11 <> 0 UNION ALL SELECT safe_path FROM {p} WHERE o2 = 0"


@query(
    "sample_status",
    cte("fx_products", "fx_water", more={"s": _SAMP.format(p="fx_products")})
    + """SELECT s.sample_id, CASE WHEN ord % 7 = 0 OR ord % 5 = 0 OR ord % 11 = 0 THEN 'missing_files' ELSE 'ok' END AS status, concat_ws(',', CASE WHEN ord % 7 = 0 THEN split_part(tci_path, ';', 1) END, CASE WHEN ord % 5 = 0 THEN concat('alt/', ord) END) AS missing_tci,
    ord % 11 <> 0 AS label_exists, CASE WHEN ord % 2 = 0 THEN 2 ELSE 1 END AS tile_count, 1 AS product_count, coalesce(w.name, nullif(s.lake_id, '')) AS lake_display_name FROM s LEFT JOIN fx_water w ON w.lake_uid = replace(s.lake_id, 'hn_', 'hunan_')""",
)
def sample_status(spark: SparkSession, sf: str) -> DataFrame:
    p = fixture(spark, sf, "fx_products")
    table = spark.sql(_SAMP, p=p)
    inv = spark.sql(_INV.replace("WHERE o2 = 0", ""), p=p)
    bodies = fixture(spark, sf, "fx_water").select("lake_uid", F.col("name").alias("display_name"))
    none = F.lit(None).cast("string")
    named = bodies.withColumns({"source_feature_id": none, "osm_id_text": none, "osm_way_id_text": none, "area_km2": F.lit(1.0)})
    got = samples.sample_status(table, inv, bodies, search.id_lookup(named))
    return got.select("sample_id", "status", F.array_join("missing_tci", ",").alias("missing_tci"), "label_exists", "tile_count", "product_count", "lake_display_name")


@query(
    "sample_stats",
    cte("fx_updates", more={"t": _LAST})
    + """SELECT 'total' AS kind, 'all' AS value, count(*) AS n FROM t UNION ALL SELECT 'quality', quality, count(*) FROM t GROUP BY quality UNION ALL SELECT 'split', split, count(*) FROM t WHERE split <> '' GROUP BY split""",
)
def sample_stats(spark: SparkSession, sf: str) -> DataFrame:
    return samples.sample_stats(sample_table(spark, sf))


@query("samples_newest", cte("fx_updates", more={"t": _LAST}) + "SELECT sample_id, ts AS created_at FROM t ORDER BY ts DESC, sample_id LIMIT 25")
def samples_newest(spark: SparkSession, sf: str) -> DataFrame:
    rows = sample_table(spark, sf).select("sample_id", F.col("ts").alias("created_at"))
    return samples.newest_first(rows).limit(25)


@query(
    "body_detail",
    cte("fx_water", "fx_ref", more={"a0": m_table("fx_water"), "r0": m_table("fx_ref"), "best": f"SELECT lake_uid, hylak_id, row_number() OVER (PARTITION BY lake_uid ORDER BY ov DESC, hylak_id) AS rn FROM (SELECT a.lake_uid, b.hylak_id, {OVERLAP} AS ov FROM a0 a JOIN r0 b ON {HIT}) WHERE ov > 0"})
    + """SELECT w.lake_uid, w.name, b.hylak_id, w.k % 7 <> 0 AS has_layer FROM fx_water w LEFT JOIN best b ON b.lake_uid = w.lake_uid AND b.rn = 1""",
)
def body_detail(spark: SparkSession, sf: str) -> DataFrame:
    bodies = water(spark, sf)
    own = bodies.where("k % 7 <> 0").select("lake_uid", "geometry")
    got = samples.body_detail(bodies.select("lake_uid", "name"), own, catalog.reference_overlap(bodies, refs(spark, sf)))
    return got.select("lake_uid", "name", "hylak_id", F.col("osm_geometry").isNotNull().alias("has_layer"))


@query("stream_upsert", cte("fx_updates", more={"t": _LAST}) + "SELECT sample_id, event_id, quality, nullif(split, '') AS split, value FROM t")
def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a stream into a keyed table; must equal the batch result."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = raw.selectExpr(
        "event_id", "ts", "concat('S', user_id) AS sample_id", "event_type AS quality",
        "CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('split', event_id % 3) END AS split", "value",
    )
    home = new_shared_path(spark, "stream")
    job = upserts.start_upserts(upserts.product_events(rows), "sample_id", ["ts", "event_id"], f"{home}/table", f"{home}/checkpoint")
    job.awaitTermination()
    return upserts.current_table(spark, f"{home}/table", "sample_id", ["ts", "event_id"]).select("sample_id", "event_id", "quality", "split", "value")
