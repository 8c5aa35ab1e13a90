"""Imagery products: active choice, selectable lists, readiness, inventory.

Tables: ``base`` (one row per tile), ``user`` (many per tile, ``lake_id`` '' or the body a
product belongs to), ``active`` (``scope`` '' or a body id, ``tile``, ``product``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterspark.functions import clean as C
from waterspark.functions import geometry as G
from waterspark.operators import context
from waterspark.operators import spatial_join as S
from waterspark.operators.hot_keys import join_spread
from waterspark.session import cut_lineage

PAYLOAD = ["product", "product_id", "date", "source", "lake_id", "cloud_cover", "valid_ratio", "safe_path", "tci_path"]
MISSING_CLOUD = 101.0


def base_imagery(index: DataFrame, position: str) -> DataFrame:
    """Last index row per tile, tile upper-case, missing ratio zero."""
    rows = index.withColumns({"tile": F.upper("tile"), "valid_ratio": F.coalesce("valid_ratio", F.lit(0.0))})
    return rows.groupBy("tile").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "tile"]), F.col(position)).alias("r")).select("tile", "r.*")


def active_table(selection: DataFrame) -> DataFrame:
    """Selection keys ``tile`` or ``body:tile`` split into scope and tile."""
    key = F.col("scope_key")
    scoped = key.contains(":")
    return selection.select(
        F.when(scoped, F.substring_index(key, ":", 1)).otherwise("").alias("scope"),
        C.tile_code(F.when(scoped, F.regexp_replace(key, "^[^:]*:", "")).otherwise(key)).alias("tile"),
        "product",
    )


def asset_meta(source: Column, row_lake: Column, lake: Column) -> Column:
    kind = C.first_present(source, default="preloaded")
    own, asked = C.first_present(row_lake, default=""), C.first_present(lake, default="")
    asset = F.when(kind == "local_img", "lake_native").when(kind == "preloaded", "preloaded_tile").otherwise("sentinel_tile")
    return F.struct(
        asset.alias("asset_type"),
        F.when(kind == "local_img", "lake").otherwise("tile").alias("asset_scope"),
        (kind == "local_img").alias("is_lake_native"),
        ((own == "") | (asked == "") | (own == asked)).alias("applies_to_lake"),
    )


def _rows(base: DataFrame, user: DataFrame) -> DataFrame:
    """Both sources as one table; base has priority 0."""
    cols = [F.col(c) for c in ("tile", *PAYLOAD)]
    b = base.withColumn("lake_id", F.lit("")) if "lake_id" not in base.columns else base
    return b.select(F.lit(0).alias("prio"), *cols).unionByName(user.select(F.lit(1).alias("prio"), *cols))


def _user_order() -> Column:
    """First row to be taken: base, then user rows by date and name, newest first."""
    return F.struct((-F.col("prio")).alias("p"), F.col("date").alias("d"), F.col("product").alias("n"), F.col("product_id").alias("i"))


def owned_pairs(user: DataFrame) -> DataFrame:
    return user.where("lake_id <> ''").select(F.col("lake_id").alias("scope"), "tile").distinct()


def with_scope(pairs: DataFrame, user: DataFrame, key: str = "lake_uid") -> DataFrame:
    """Selection scope per (body, tile): the body when it owns a product there, else ''."""
    owns = owned_pairs(user).withColumnRenamed("scope", key).withColumn("_own", F.lit(True))
    return pairs.join(owns, [key, "tile"], "left").withColumn("scope", F.when(F.col("_own"), F.col(key)).otherwise("")).drop("_own")


def active_rows(pairs: DataFrame, base: DataFrame, user: DataFrame, active: DataFrame, key: str = "lake_uid") -> DataFrame:
    """Active product of each (body, tile); pairs without one are left out.

    The choice depends on scope and tile alone: it is made once for each of those, and
    bodies meet only the row chosen.
    """
    chosen = with_scope(pairs.select(key, "tile"), user, key)
    asked = chosen.select("scope", "tile").distinct().join(active, ["scope", "tile"])
    found = asked.join(_rows(base, user), ["tile", "product"])
    fits = F.when(F.col("prio") == 0, F.col("scope") == "").otherwise(
        (F.col("scope") == "") | (F.col("lake_id") == "") | (F.col("lake_id") == F.col("scope"))
    )
    payload = F.struct(*PAYLOAD)
    best = found.where(fits).groupBy("scope", "tile").agg(F.max_by(payload, _user_order()).alias("r"))
    return chosen.select(key, "tile", "scope").distinct().join(best, ["scope", "tile"]).select(key, "tile", "r.*")


def effective_imagery(base: DataFrame, user: DataFrame, active: DataFrame) -> DataFrame:
    """Imagery in force per tile: the tile's active product, from base before user rows."""
    found = active.where("scope = ''").drop("scope").join(_rows(base, user), ["tile", "product"])
    return found.groupBy("tile").agg(F.max_by(F.struct("prio", *PAYLOAD), _user_order()).alias("r")).select("tile", "r.*")


def selectable_products(
    pairs: DataFrame, base: DataFrame, user: DataFrame, active: DataFrame, key: str = "lake_uid"
) -> DataFrame:
    """Products offered for each (body, tile).

    Base imagery only where the body owns nothing; user rows of the body itself meet it
    on (body, tile), and only rows free for all fan out by tile.
    """
    scoped = with_scope(pairs.select(key, "tile").distinct(), user, key).join(
        active.withColumnRenamed("product", "active_product"), ["scope", "tile"], "left"
    )
    rows = _rows(base, user)
    head = [key, "tile", "scope", "active_product"]
    own = scoped.join(rows.where("prio = 1 AND lake_id <> ''").withColumnRenamed("lake_id", key).withColumn("lake_id", F.col(key)), [key, "tile"])
    free = scoped.join(rows.where("prio = 1 AND lake_id = ''"), "tile")
    first = scoped.where("scope = ''").join(rows.where("prio = 0"), "tile")
    cols = head + ["prio"] + PAYLOAD
    every = own.select(cols).unionAll(free.select(cols)).unionAll(first.select(cols))
    return every.withColumns(
        {
            "preloaded": F.col("prio") == 0,
            "active": F.coalesce(F.col("active_product") == F.col("product"), F.lit(False)),
            "asset": asset_meta(F.col("source"), F.col("lake_id"), F.col(key)),
        }
    )


def selectable_counts(
    pairs: DataFrame, base: DataFrame, user: DataFrame, active: DataFrame, key: str = "lake_uid"
) -> DataFrame:
    """Numbers of ``selectable_products`` per (body, tile), and the last name, without
    listing them: ``n, n_base, n_native, n_active, last_product``.

    What a tile offers to all is counted once for the tile, not once for each body, so the
    work grows with the pairs and the products, not with their product.
    """
    scoped = with_scope(pairs.select(key, "tile").distinct(), user, key).join(
        active.withColumnRenamed("product", "active_product"), ["scope", "tile"], "left"
    )
    # A selection that is there twice offers everything twice.
    asked = scoped.groupBy(key, "tile").agg(F.first("scope").alias("scope"), F.count(F.lit(1)).alias("_times"))
    native = asset_meta(F.col("source"), F.col("lake_id"), F.lit(""))["is_lake_native"]
    rows = _rows(base, user).select("prio", "tile", "lake_id", "product", native.alias("_native"))

    def counted(name: str, kept: DataFrame, *by: str) -> DataFrame:
        return kept.groupBy(*by).agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if("_native").alias("native"), F.max("product").alias("last")).alias(name))

    own = counted("_own", rows.where("prio = 1 AND lake_id <> ''").withColumnRenamed("lake_id", key), key, "tile")
    free = counted("_free", rows.where("prio = 1 AND lake_id = ''"), "tile")
    first = counted("_first", rows.where("prio = 0"), "tile")
    named = rows.groupBy("tile", F.col("product").alias("active_product"), "prio", "lake_id").agg(F.count(F.lit(1)).alias("_n"))
    offered = F.when(F.col("prio") == 0, F.col("scope") == "").otherwise((F.col("lake_id") == "") | (F.col("lake_id") == F.col(key)))
    chosen = scoped.join(named, ["tile", "active_product"]).where(offered).groupBy(key, "tile").agg(F.sum("_n").alias("n_active"))
    joined = asked.join(own, [key, "tile"], "left").join(free, "tile", "left").join(first, "tile", "left").join(chosen, [key, "tile"], "left")
    parts = [F.col("_own"), F.col("_free"), F.when(F.col("scope") == "", F.col("_first"))]
    none = F.lit(0).cast("long")

    def total(field: str, *of: Column) -> Column:
        return F.col("_times") * sum((F.coalesce(p[field], none) for p in of[1:]), F.coalesce(of[0][field], none))

    return joined.select(
        key, "tile", total("n", *parts).alias("n"), total("n", parts[2]).alias("n_base"), total("native", *parts).alias("n_native"),
        F.coalesce("n_active", none).alias("n_active"), F.greatest(*[p["last"] for p in parts]).alias("last_product"),
    ).where("n > 0")


def product_lists(selectable: DataFrame, key: str = "lake_uid") -> DataFrame:
    """Selectable products as one ordered list per (body, tile)."""
    entry = F.struct((-F.col("prio")).alias("p"), "date", "product", "product_id", "active", "preloaded", "asset")
    listed = selectable.groupBy(key, "tile").agg(F.sort_array(F.collect_list(entry), asc=False).alias("products"))
    return listed.withColumn("products", F.transform("products", lambda p: p.dropFields("p")))


def tiles_report(
    tiles: DataFrame, base: DataFrame, user: DataFrame, active: DataFrame, key: str = "lake_uid"
) -> DataFrame:
    """Required tiles with coverage and the active product, where there is one."""
    act = active_rows(tiles, base, user, active, key).select(key, "tile", "product", "date", "valid_ratio", "tci_path")
    return tiles.select(key, "tile", "coverage").join(act, [key, "tile"], "left").withColumn("downloaded", F.col("product").isNotNull())


def imagery_rows(
    water: DataFrame,
    tiles: DataFrame,
    footprints: DataFrame,
    base: DataFrame,
    user: DataFrame,
    active: DataFrame,
    key: str = "lake_uid",
) -> DataFrame:
    """Rows to show per body: active rows of its tiles, else effective imagery meeting its
    box. Bodies without either do not appear."""
    act = active_rows(tiles, base, user, active, key).select(key, "tile", "product", "valid_ratio", F.lit(0).alias("prio"))
    eff = effective_imagery(base, user, active).select("tile", "product", "valid_ratio")
    open_ = water.join(act.select(key).distinct(), key, "left_anti")
    met = S.box_pairs(open_, footprints.join(eff.select("tile"), "tile", "left_semi"), key, "tile")
    fallback = met.join(eff, "tile").select(key, "tile", "product", "valid_ratio", F.lit(1).alias("prio"))
    return act.unionByName(fallback)


def readiness(
    tiles: DataFrame, base: DataFrame, user: DataFrame, active: DataFrame, bodies: DataFrame, key: str = "lake_uid"
) -> DataFrame:
    """Training readiness per body: required, missing and ready tiles with products."""
    act = active_rows(tiles, base, user, active, key)
    joined = tiles.select(key, "tile", "seq").join(act, [key, "tile"], "left")
    item = F.struct("seq", "tile", *PAYLOAD, asset_meta(F.col("source"), F.col("lake_id"), F.col(key)).alias("asset"))
    gone = F.col("product").isNull()
    grouped = joined.groupBy(key).agg(
        F.count(F.lit(1)).alias("required_count"),
        F.count_if(gone).alias("missing_count"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "tile"))), lambda t: t["tile"]).alias("required_tiles"),
        F.transform(F.sort_array(F.collect_list(F.when(gone, F.struct("seq", "tile")))), lambda t: t["tile"]).alias("missing_tiles"),
        F.sort_array(F.collect_list(F.when(~gone, item))).alias("products"),
    )
    empty = F.array().cast("array<string>")
    out = bodies.select(key).join(grouped, key, "left")
    return out.withColumns(
        {
            "required_count": F.coalesce("required_count", F.lit(0)),
            "missing_count": F.coalesce("missing_count", F.lit(0)),
            "ready_count": F.coalesce(F.col("required_count") - F.col("missing_count"), F.lit(0)),
            "required_tiles": F.coalesce("required_tiles", empty),
            "missing_tiles": F.coalesce("missing_tiles", empty),
            "ready": F.coalesce((F.col("required_count") > 0) & (F.col("missing_count") == 0), F.lit(False)),
        }
    )


def inventory(base: DataFrame, user: DataFrame, active: DataFrame, by: list[str]) -> DataFrame:
    """Product and selection counts per group; every table carries the group columns."""
    products = base.select(*by, "tile").unionAll(user.select(*by, "tile")).groupBy(*by).agg(
        F.count_distinct("tile").alias("tci_tile_count"), F.count(F.lit(1)).alias("product_count")
    )
    chosen = active.groupBy(*by).agg(
        F.count(F.lit(1)).alias("active_imagery_count"), F.count_distinct("tile").alias("active_tile_count")
    )
    counts = ["tci_tile_count", "product_count", "active_imagery_count", "active_tile_count"]
    return products.join(chosen, by, "full").na.fill(0, counts)


def region_overview(water: DataFrame, inventory_rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Every configured region with its body count and inventory."""
    bodies = water.groupBy("region").agg(F.count(F.lit(1)).alias("lake_count"))
    out = regions.join(bodies, "region", "left").join(inventory_rows, "region", "left").na.fill(0)
    return out.withColumn("ready", F.col("lake_count") > 0)


def download_status(catalogue: DataFrame, base: DataFrame, user: DataFrame, ratios: DataFrame | None = None) -> DataFrame:
    """Local copy of each catalogue row, by id or name among user rows, then by name
    among base rows. Two equi-joins instead of one OR join.

    With ``ratios`` (``tci_path, valid_ratio``, see ``raster.valid_ratio``) local copies
    also get their share of valid pixels and what it was measured on."""
    hit = F.struct("prio", "source", "tci_path")
    def side(df: DataFrame, on: str, prio: int, source: str) -> DataFrame:
        col = C.clean_id(F.col("product_id" if on == "id" else "product"))
        return df.select(col.alias("_k"), F.lit(prio).alias("prio"), F.lit(source).alias("source"), "tci_path").where("_k <> ''").groupBy("_k").agg(F.min(hit).alias("h"))

    asked = catalogue.withColumns({"_id": C.clean_id(F.col("product_id")), "_name": C.clean_id(F.col("name"))})
    by_id = side(user, "id", 0, "user_download").withColumnsRenamed({"_k": "_id", "h": "h0"})
    by_name = side(user, "name", 0, "user_download").withColumnsRenamed({"_k": "_name", "h": "h1"})
    by_base = side(base, "name", 1, "preloaded").withColumnsRenamed({"_k": "_name", "h": "h2"})
    joined = asked.join(by_id, "_id", "left").join(by_name, "_name", "left").join(by_base, "_name", "left")
    best = F.coalesce("h0", "h1", "h2")
    out = joined.select(
        *catalogue.columns, best.isNotNull().alias("downloaded"), best["source"].alias("local_source"), best["tci_path"].alias("tci_path")
    )
    if ratios is None:
        return out
    measured = ratios.groupBy("tci_path").agg(F.max("valid_ratio").alias("coverage_ratio"))
    return out.join(measured, "tci_path", "left").withColumn("coverage_basis", F.when(F.col("coverage_ratio").isNotNull(), "pixels"))


def catalogue_query(
    products: DataFrame, tile: str, start: str, end: str, cloud: float, product_type: str = "MSIL1C", limit: int = 50
) -> DataFrame:
    """Newest products of a tile within a date window and cloud limit."""
    code = tile.strip().upper().removeprefix("T")
    most = max(0.0, min(100.0, float(cloud)))
    top = max(1, int(limit))
    kind = (product_type or "MSIL1C").strip()
    name = F.col("name")
    found = products.where(
        name.contains(kind) & name.contains(f"_T{code}_") & (F.col("cloud_cover") <= most)
        & (F.col("date") >= start) & (F.col("date") <= end)
    )
    return found.orderBy(F.col("date").desc(), "name").limit(top)


def rank_for_bodies(
    bodies: DataFrame, products: DataFrame, footprints: DataFrame, limit: int, key: str = "lake_uid", padding: float = 0.8
) -> DataFrame:
    """Best catalogue products per body by body coverage, area-of-interest coverage,
    cloud and date; products without coverage come last.

    Products share footprints, and coverage depends on the footprint only: the best
    ``limit`` products of each footprint are enough for the best of a body, so bodies
    meet footprints, never all products.
    """
    tie = [F.coalesce("cloud_cover", F.lit(MISSING_CLOUD)), F.col("date"), F.col("name")]
    per_foot = Window.partitionBy("foot").orderBy(*tie)
    short = products.withColumn("_n", F.row_number().over(per_foot)).where(F.col("_n") <= limit).drop("_n")
    box = [F.col(c) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north")]
    aoi = G.aoi_bounds(*box, padding)
    areas = bodies.select(key, aoi.alias("a")).select(
        key, G.box_polygon(F.col("a.xmin"), F.col("a.ymin"), F.col("a.xmax"), F.col("a.ymax")).alias("geometry")
    )
    near = context.coverage_pairs(areas, footprints, key, "foot", balance=False).select(key, "foot", F.col("coverage").alias("aoi_coverage"))
    own = context.coverage_pairs(bodies, footprints, key, "foot", balance=False).select(key, "foot", F.col("coverage").alias("lake_coverage"))
    short = cut_lineage(short)
    met = cut_lineage(near.join(own, [key, "foot"], "left").na.fill(0.0, ["lake_coverage"]))
    order = Window.partitionBy(key).orderBy(F.round("lake_coverage", 9).desc(), F.round("aoi_coverage", 9).desc(), *tie)
    ranked = met.join(short, "foot").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    # Fewer than limit covered products lie on fewer than limit footprints, so the best
    # 2 x limit footprints hold every product that can follow them.
    first = short.groupBy("foot").agg(F.min(F.struct(*[t.alias(f"_t{i}") for i, t in enumerate(tie)])).alias("_best"))
    first = first.orderBy("_best", "foot").limit(2 * limit).select("foot")
    spare = short.join(first, "foot", "left_semi")
    counted = bodies.select(key).join(ranked.groupBy(key).agg(F.count(F.lit(1)).alias("_have")), key, "left")
    needy = counted.withColumn("_have", F.coalesce("_have", F.lit(0))).where(F.col("_have") < limit)
    # At most 2 x limit footprints, read as one value, each once for every such body.
    listed = first.agg(F.collect_list("foot").alias("_feet")).scalar()
    open_ = needy.withColumn("_feet", listed).select(key, "_have", F.explode("_feet").alias("foot")).join(met.select(key, "foot"), [key, "foot"], "left_anti")
    zero = F.lit(0.0)
    later = open_.join(spare, "foot").withColumns({"aoi_coverage": zero, "lake_coverage": zero})
    later = later.withColumn("rank", F.col("_have").cast("int") + F.row_number().over(Window.partitionBy(key).orderBy(*tie)))
    return ranked.unionByName(later.where(F.col("rank") <= limit).select(*ranked.columns))


def mosaic_meta(rows: DataFrame, boxes: DataFrame, key: str = "lake_uid") -> DataFrame:
    """Tiles in order, distinct dates, products and the union bounds of a body's rows."""
    full = rows.join(boxes, "tile", "left")
    ordered = F.sort_array(F.collect_list(F.struct("tile", "product")))
    return full.groupBy(key).agg(
        F.transform(ordered, lambda r: r["tile"]).alias("tiles"),
        F.transform(ordered, lambda r: r["product"]).alias("products"),
        F.sort_array(F.collect_set("date")).alias("dates"),
        F.min("bbox_west").alias("west"),
        F.min("bbox_south").alias("south"),
        F.max("bbox_east").alias("east"),
        F.max("bbox_north").alias("north"),
    )


def set_active(
    requests: DataFrame, base: DataFrame, user: DataFrame, active: DataFrame, order: str = "ts"
) -> tuple[DataFrame, DataFrame]:
    """Apply selection requests ``(lake_uid or '', tile, product, order)``.

    A request must name a product selectable for its tile and body; the last valid
    request per scope wins. Returns the new selection and the rejected requests.
    """
    req = with_scope(requests.withColumn("tile", C.tile_code(F.col("tile"))), user)
    rows = _rows(base, user).select("tile", "product", "lake_id", "prio").distinct()
    fits = F.when(F.col("prio") == 0, F.col("scope") == "").otherwise(
        (F.col("lake_uid") == "") | (F.col("lake_id") == "") | (F.col("lake_id") == F.col("lake_uid"))
    )
    valid_keys = req.join(rows, ["tile", "product"]).where(fits).select("lake_uid", "tile", "product").distinct()
    accepted = req.join(valid_keys, ["lake_uid", "tile", "product"], "left_semi")
    rejected = req.join(valid_keys, ["lake_uid", "tile", "product"], "left_anti").drop("scope")
    last = accepted.groupBy("scope", "tile").agg(F.max_by("product", F.struct(order, "product")).alias("product"))
    kept = active.join(last.select("scope", "tile"), ["scope", "tile"], "left_anti")
    return kept.select("scope", "tile", "product").unionByName(last.select("scope", "tile", "product")), rejected


def register_products(downloads: DataFrame, ratios: DataFrame) -> DataFrame:
    """Product rows of finished downloads: tile, date and type from the name or folder,
    valid ratio from pixels."""
    name, folder = F.coalesce("name", F.lit("")), F.col("folder")

    def either(fn) -> Column:
        return F.when(fn(name) != "", fn(name)).otherwise(fn(folder))

    # Downloads without pixels share one path.
    return join_spread(downloads, ratios, "tci_path").select(
        C.first_present(F.col("product_id"), default="").alias("product_id"),
        C.first_present(F.col("name"), F.col("folder")).alias("product_name"),
        either(C.product_tile).alias("tile"),
        either(C.product_date).alias("date"),
        C.first_present(F.col("cloud_cover"), default="").alias("cloud_cover"),
        C.product_type(name).alias("product_type"),
        F.lit("user_download").alias("source"),
        F.col("folder").alias("safe_path"),
        "tci_path",
        F.lit("downloaded").alias("download_status"),
        F.coalesce("valid_ratio", F.lit(0.0)).alias("valid_ratio"),
    )
