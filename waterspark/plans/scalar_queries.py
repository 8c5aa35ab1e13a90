"""Row-level rules: cleaning, names, dates, boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterspark.functions import clean as C
from waterspark.functions import geometry as G
from waterspark.operators import catalog
from waterspark.plans.fixtures import cte, fixture, m_table, spread, table, with_boxes
from waterspark.plans.registry import query

_RAW_TEXT = """CASE p_partkey % 6 WHEN 0 THEN concat('  ', p_name, ' ') WHEN 1 THEN 'NaN' WHEN 2 THEN ''
    WHEN 3 THEN concat(p_partkey, '.0') WHEN 4 THEN concat(p_brand, '.0') ELSE NULL END"""
_TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


@query(
    "clean_rules",
    f"""WITH t AS (SELECT p_partkey, p_name, {_RAW_TEXT} AS raw FROM part),
    u AS (SELECT *, CASE WHEN trim(raw) = '' OR lower(trim(raw)) = 'nan' THEN NULL ELSE trim(raw) END AS txt FROM t)
    SELECT p_partkey, txt AS clean_text, regexp_replace(txt, '^(\\d+)\\.0$', '\\1') AS clean_id,
    regexp_replace(txt, '^(.*)\\.0$', '\\1') AS batch_id, coalesce(txt, p_name) AS present,
    regexp_replace(raw, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe FROM u""",
)
def clean_rules(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").selectExpr("p_partkey", "p_name", f"{_RAW_TEXT} AS raw")
    raw = F.col("raw")
    return df.select(
        "p_partkey",
        C.clean_text(raw).alias("clean_text"),
        C.clean_id(raw).alias("clean_id"),
        C.clean_id(raw, any_text=True).alias("batch_id"),
        C.first_present(raw, F.col("p_name")).alias("present"),
        C.safe_id(raw).alias("safe"),
    )


_TAGS = """concat(coalesce(other_tags, ''), CASE WHEN k % 4 = 0 THEN ',"water"=>"bay","code"=>""' ELSE '' END)"""


@query(
    "tag_map_parse",
    cte("fx_water")
    + f"""SELECT k, coalesce(array_to_string(list_sort(list_transform(list_distinct(ks), lambda x: concat(x, '=', vs[len(ks) - list_position(list_reverse(ks), x) + 1]))), ';'), '') AS entries,
    CASE WHEN list_position(ks, 'water') > 0 THEN vs[len(ks) - list_position(list_reverse(ks), 'water') + 1] END AS water
    FROM (SELECT k, regexp_extract_all({_TAGS}, '"([^"]+)"=>"([^"]*)"', 1) AS ks,
    regexp_extract_all({_TAGS}, '"([^"]+)"=>"([^"]*)"', 2) AS vs FROM fx_water)""",
)
def tag_map_parse(spark: SparkSession, sf: str) -> DataFrame:
    df = fixture(spark, sf, "fx_water").selectExpr("k", f"{_TAGS} AS tags")
    entries = F.map_entries(C.tag_map(F.col("tags")))
    text = F.sort_array(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return df.select("k", F.array_join(text, ";").alias("entries"), C.tag_value(F.col("tags"), "water").alias("water"))


_TYPE_SQL = """CASE WHEN water = 'reservoir' OR landuse = 'reservoir' OR contains(nm, '水库') THEN 'reservoir'
    WHEN landuse = 'aquaculture' OR contains(nm, '鱼塘') OR contains(nm, '养殖') THEN 'aquaculture'
    WHEN nat = 'wetland' OR water = 'wetland' OR contains(nm, '湿地') THEN 'wetland'
    WHEN water = 'pond' OR contains(nm, '塘') THEN 'pond' WHEN water = 'lake' OR contains(nm, '湖') THEN 'lake'
    WHEN akm < 0.1 AND nm = '' THEN 'pond_candidate' ELSE 'unknown' END"""


@query(
    "water_type_rules",
    cte("fx_water")
    + f"""SELECT k, {_TYPE_SQL} AS water_type FROM (SELECT k, coalesce(landuse, '') AS landuse, nat, coalesce(name, '') AS nm,
    regexp_extract(coalesce(other_tags, ''), '"water"=>"([^"]*)"', 1) AS water, (k % 20)/100e0 AS akm FROM fx_water)""",
)
def water_type_rules(spark: SparkSession, sf: str) -> DataFrame:
    null = F.lit(None).cast("string")
    return fixture(spark, sf, "fx_water").select(
        "k",
        C.water_type(
            F.col("name"), null, null, C.tag_value(F.col("other_tags"), "water"), F.col("landuse"), F.col("nat"),
            (F.col("k") % 20) / F.lit(100.0),
        ).alias("water_type"),
    )


@query(
    "quality_flags",
    cte("fx_water")
    + """SELECT k, CASE WHEN k % 2 <> 0 AND k % 3 <> 0 THEN 'high' WHEN k % 3 <> 0 OR dx >= 10 THEN 'medium' ELSE 'low' END AS polygon_quality,
    CASE (CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN k % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 1 THEN 1 ELSE 0 END)
    WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS metadata_quality FROM fx_water""",
)
def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "fx_water").select(
        "k",
        C.polygon_quality(F.col("dx") / F.lit(10.0), F.col("k") % 2, F.col("k") % 3).alias("polygon_quality"),
        C.metadata_quality(
            F.col("name"), F.when(F.col("k") % 2 == 1, F.col("k")), F.when(F.col("k") % 3 == 1, "49RAA").otherwise("")
        ).alias("metadata_quality"),
    )


_FCLASS = "CASE p_size % 6 WHEN 0 THEN 'Water' WHEN 1 THEN 'reservoir' WHEN 2 THEN 'river' WHEN 3 THEN 'dock' WHEN 4 THEN 'forest' ELSE NULL END"


@query(
    "osm_water_filter",
    f"""WITH t AS (SELECT p_partkey AS osm_id, p_name AS name, {_FCLASS} AS fclass FROM part),
    c AS (SELECT *, coalesce(lower(fclass) IN ('water','reservoir','lake','pond','basin','wetland','riverbank','dock'), false) AS hit FROM t)
    SELECT osm_id, name, fclass AS type, 'water' AS "natural", CASE WHEN lower(fclass) = 'reservoir' THEN 'reservoir' END AS landuse,
    concat('"water"=>"', coalesce(fclass, ''), '"') AS other_tags FROM c WHERE hit OR NOT (SELECT bool_or(hit) FROM c)""",
)
def osm_water_filter(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").selectExpr("p_partkey AS osm_id", "p_name AS name", f"{_FCLASS} AS fclass")
    return C.normalise_water_schema(catalog.keep_water(raw)).select(
        "osm_id", "name", "type", "natural", "landuse", "other_tags"
    )


@query(
    "osm_water_filter_keep_all",
    """SELECT p_partkey AS osm_id, p_type AS type FROM part""",
)
def osm_water_filter_keep_all(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").selectExpr("p_partkey AS osm_id", "p_type AS type")
    return catalog.keep_water(raw)


_GEOM_TYPE = "CASE p_size % 4 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPolygon' WHEN 2 THEN 'LineString' ELSE 'Point' END"


@query("polygon_types", f"SELECT gtype, count(*) AS n FROM (SELECT {_GEOM_TYPE} AS gtype FROM part) WHERE gtype IN ('Polygon', 'MultiPolygon') GROUP BY gtype")
def polygon_types(spark: SparkSession, sf: str) -> DataFrame:
    typed = table(spark, sf, "part").selectExpr(f"{_GEOM_TYPE} AS gtype")
    return typed.where(F.col("gtype").isin("Polygon", "MultiPolygon")).groupBy("gtype").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bbox_area_km2",
    cte("fx_water", more={"m": m_table("fx_water")})
    + """SELECT k, round(m2/1e6, 6) AS area_km2, w100/100e0 AS bbox_west, s100/100e0 AS bbox_south, (w100+dx)/100e0 AS bbox_east,
    (s100+dy)/100e0 AS bbox_north, round((w100/100e0 + (w100+dx)/100e0)/2, 6) AS center_lon, round((s100/100e0 + (s100+dy)/100e0)/2, 6) AS center_lat FROM m""",
)
def bbox_area_km2(spark: SparkSession, sf: str) -> DataFrame:
    df = with_boxes(fixture(spark, sf, "fx_water")).select("k", "geometry")
    df = df.withColumns({**G.bbox_columns(F.col("geometry")), "area_km2": F.round(G.area_km2(F.col("geometry")), 6)})
    return df.withColumns(
        {
            "center_lon": F.round((F.col("bbox_west") + F.col("bbox_east")) / 2, 6),
            "center_lat": F.round((F.col("bbox_south") + F.col("bbox_north")) / 2, 6),
        }
    ).drop("geometry")


@query(
    "projection_roundtrip",
    cte("fx_water") + """SELECT k, round(w100/100e0, 6) AS lon, round((s100+dy)/100e0, 6) AS lat FROM fx_water""",
)
def projection_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    df = with_boxes(fixture(spark, sf, "fx_water"))
    back = G.to_lonlat(G.to_mercator(F.col("geometry")))
    return df.select("k", F.round(back[0][0][3]["x"], 6).alias("lon"), F.round(back[0][0][3]["y"], 6).alias("lat"))


def _round_box(c: Column, names: str = "xmin ymin xmax ymax") -> list[Column]:
    return [F.round(c[n], 6).alias(n) for n in names.split()]


@query(
    "padded_bounds",
    cte("fx_water")
    + """, b AS (SELECT k, w100/100e0 AS w, s100/100e0 AS s, (w100+dx)/100e0 AS e, (s100+dy)/100e0 AS n FROM fx_water)
    SELECT k, round(w - greatest((e-w)*0.05, 0.005), 6) AS xmin, round(s - greatest((n-s)*0.05, 0.005), 6) AS ymin,
    round(e + greatest((e-w)*0.05, 0.005), 6) AS xmax, round(n + greatest((n-s)*0.05, 0.005), 6) AS ymax,
    round(w - greatest((e-w)*0.2, 0.01), 6) AS search_west, round(n + greatest((n-s)*0.2, 0.01), 6) AS search_north FROM b""",
)
def padded_bounds(spark: SparkSession, sf: str) -> DataFrame:
    df = with_boxes(fixture(spark, sf, "fx_water"))
    box = [F.col(c) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north")]
    near = G.search_bounds(*box)
    return df.select(
        "k",
        *_round_box(G.padded_bounds(*box, 0.05)),
        F.round(near["xmin"], 6).alias("search_west"),
        F.round(near["ymax"], 6).alias("search_north"),
    )


@query(
    "aoi_bounds",
    cte("fx_water", more={"m": m_table("fx_water")})
    + """SELECT k, round(d, 3) AS distance_m, round((x0-d)/111319.49079327357, 6) AS xmin,
    round(degrees(atan(exp((y0-d)/6378137e0)))*2-90, 6) AS ymin, round((x1+d)/111319.49079327357, 6) AS xmax,
    round(degrees(atan(exp((y1+d)/6378137e0)))*2-90, 6) AS ymax
    FROM (SELECT *, greatest(greatest(x1-x0, y1-y0)*0.8, 500) AS d FROM m)""",
)
def aoi_bounds(spark: SparkSession, sf: str) -> DataFrame:
    df = with_boxes(fixture(spark, sf, "fx_water"))
    box = [F.col(c) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north")]
    return df.select(
        "k", F.round(G.aoi_distance(*box, 0.8), 3).alias("distance_m"), *_round_box(G.aoi_bounds(*box, 0.8))
    )


_XYZ = "p_size % 8 + 3 AS z, p_partkey % 8 AS x, (p_partkey*3) % 8 AS y"


@query(
    "xyz_bounds",
    f"""SELECT p_partkey, round(x*sz - 20037508.342789244, 3) AS "left", round(20037508.342789244 - y*sz - sz, 3) AS bottom,
    round(x*sz - 20037508.342789244 + sz, 3) AS "right", round(20037508.342789244 - y*sz, 3) AS top
    FROM (SELECT p_partkey, x, y, 2*20037508.342789244/pow(2, z) AS sz FROM (SELECT p_partkey, {_XYZ} FROM part))""",
)
def xyz_bounds(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").selectExpr("p_partkey", _XYZ.split(",")[0], *[p.strip() for p in _XYZ.split(", ", 1)[1].rsplit(", ", 1)])
    b = G.xyz_bounds(F.col("z"), F.col("x"), F.col("y"))
    return df.select("p_partkey", *[F.round(b[n], 3).alias(n) for n in ("left", "bottom", "right", "top")])


@query(
    "xyz_cover",
    cte("fx_water", more={"m": m_table("fx_water")})
    + """, r AS (SELECT k, cast(floor(round((x0+20037508.342789244)/sz, 9)) AS INT) AS xa, cast(floor(round((x1+20037508.342789244)/sz, 9)) AS INT) AS xb,
    cast(floor(round((20037508.342789244-y1)/sz, 9)) AS INT) AS ya, cast(floor(round((20037508.342789244-y0)/sz, 9)) AS INT) AS yb
    FROM (SELECT *, 2*20037508.342789244/1024e0 AS sz FROM m))
    SELECT k, cast(x AS INT) AS x, cast(y AS INT) AS y FROM (SELECT k, unnest(generate_series(xa, xb)) AS x, ya, yb FROM r) q, LATERAL (SELECT unnest(generate_series(ya, yb)) AS y)""",
)
def xyz_cover(spark: SparkSession, sf: str) -> DataFrame:
    df = with_boxes(fixture(spark, sf, "fx_water"))
    box = [F.col(c) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north")]
    r = df.select("k", G.xyz_range(F.lit(10), *box).alias("r"))
    return r.select("k", F.explode(F.sequence("r.x0", "r.x1")).alias("x"), "r").select(
        "k", "x", F.explode(F.sequence("r.y0", "r.y1")).alias("y")
    )


_NAME_VARIANT = """CASE ord % 5 WHEN 0 THEN replace(product, 'S2A_MSIL1C', 'X_MSIL2A') WHEN 1 THEN replace(product, 'T030541', '')
    WHEN 2 THEN replace(product, '_T49R', '_49R') WHEN 3 THEN replace(product, 'S2A_', '') ELSE product END"""


@query(
    "product_names",
    cte("fx_products")
    + f""", n AS (SELECT ord, {_NAME_VARIANT} AS p FROM fx_products),
    d AS (SELECT *, CASE WHEN regexp_extract(p, '_MSIL\\d[AC]?_(\\d{{8}})T\\d{{6}}', 1) <> '' THEN regexp_extract(p, '_MSIL\\d[AC]?_(\\d{{8}})T\\d{{6}}', 1)
      ELSE regexp_extract(p, 'MSIL1C_(\\d{{8}})T\\d{{6}}', 1) END AS a, regexp_extract(p, 'MSIL\\d[AC]?_(\\d{{8}})', 1) AS b,
      concat(ord, '_', substr(p, 12, 8)) AS stem FROM n)
    SELECT ord, regexp_extract(p, '_T([0-9A-Z]{{5}})_', 1) AS tile, CASE WHEN a = '' THEN '' ELSE concat_ws('-', substr(a,1,4), substr(a,5,2), substr(a,7,2)) END AS product_date,
    CASE WHEN b = '' THEN '' ELSE concat_ws('-', substr(b,1,4), substr(b,5,2), substr(b,7,2)) END AS image_date, regexp_extract(p, '_MSI(L[12][AC])_', 1) AS product_type,
    CASE WHEN regexp_extract(stem, '(20\\d{{2}}|19\\d{{2}})[-_]?([01]\\d)[-_]?([0-3]\\d)', 1) = '' THEN '' ELSE concat_ws('-',
      regexp_extract(stem, '(20\\d{{2}}|19\\d{{2}})[-_]?([01]\\d)[-_]?([0-3]\\d)', 1), regexp_extract(stem, '(20\\d{{2}}|19\\d{{2}})[-_]?([01]\\d)[-_]?([0-3]\\d)', 2),
      regexp_extract(stem, '(20\\d{{2}}|19\\d{{2}})[-_]?([01]\\d)[-_]?([0-3]\\d)', 3)) END AS label_date FROM d""",
)
def product_names(spark: SparkSession, sf: str) -> DataFrame:
    df = fixture(spark, sf, "fx_products").selectExpr("ord", f"{_NAME_VARIANT} AS p")
    p = F.col("p")
    return df.select(
        "ord",
        C.product_tile(p).alias("tile"),
        C.product_date(p).alias("product_date"),
        C.image_date(p).alias("image_date"),
        C.product_type(p).alias("product_type"),
        C.label_date(F.concat(F.col("ord"), F.lit("_"), F.substring(p, 12, 8))).alias("label_date"),
    )


@query(
    "default_window",
    """SELECT o_orderkey, strftime(CASE WHEN day(d) > day(last_day(m)) THEN last_day(m) ELSE make_date(year(m), month(m), day(d)) END, '%Y-%m-%d') AS "start",
    strftime(d, '%Y-%m-%d') AS "end" FROM (SELECT o_orderkey, cast(o_orderdate AS DATE) AS d, cast(date_trunc('month', o_orderdate) - INTERVAL 2 MONTH AS DATE) AS m FROM orders)""",
)
def default_window(spark: SparkSession, sf: str) -> DataFrame:
    w = C.default_window(F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", w["start"].alias("start"), w["end"].alias("end"))


_FLAG = "CASE p_size % 9 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes' WHEN 2 THEN 'n' WHEN 3 THEN '0' WHEN 4 THEN 'None' WHEN 5 THEN '' WHEN 6 THEN 'maybe' WHEN 7 THEN NULL ELSE '1' END"
_NUM = "CASE p_size % 5 WHEN 0 THEN concat(p_size, '.5') WHEN 1 THEN 'x1' WHEN 2 THEN ' 12 ' WHEN 3 THEN 'nan' ELSE NULL END"
_LIST = "CASE p_size % 3 WHEN 0 THEN concat(p_name, ', ,', p_brand, ' ') WHEN 1 THEN '' ELSE p_type END"


@query(
    "flags_numbers_lists",
    f"""SELECT p_partkey, CASE WHEN f IS NULL OR f IN ('', 'nan', 'none', 'null') THEN true WHEN f IN ('1','true','yes','y') THEN true WHEN f IN ('0','false','no','n') THEN false ELSE true END AS flag_on,
    CASE WHEN f IS NULL OR f IN ('', 'nan', 'none', 'null') THEN false WHEN f IN ('1','true','yes','y') THEN true WHEN f IN ('0','false','no','n') THEN false ELSE true END AS flag_off,
    CASE WHEN p_size % 5 = 3 THEN 101e0 ELSE coalesce(try_cast(trim(x) AS DOUBLE), 101e0) END AS num,
    array_to_string(list_filter(list_transform(string_split(l, ','), lambda s: trim(s)), lambda s: s <> ''), '|') AS items
    FROM (SELECT p_partkey, p_size, lower(trim({_FLAG})) AS f, {_NUM} AS x, {_LIST} AS l FROM part)""",
)
def flags_numbers_lists(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "part").selectExpr("p_partkey", f"{_FLAG} AS f", f"{_NUM} AS x", f"{_LIST} AS l")
    return df.select(
        "p_partkey",
        C.truthy(F.col("f"), True).alias("flag_on"),
        C.truthy(F.col("f"), False).alias("flag_off"),
        C.number_or(F.col("x"), 101.0).alias("num"),
        F.array_join(C.split_list(F.col("l")), "|").alias("items"),
    )


def _power(base: Column, times: Column) -> Column:
    """``base`` to the power 1 to 4: a product of whole numbers, rounded to a double once."""
    whole, out = base.try_cast("decimal(9,0)"), base.cast("double")
    for n in (2, 3, 4):
        product = reduce(lambda x, y: x * y, [whole] * n).cast("double")
        out = F.when(times == n, F.coalesce(product, F.pow(base, F.lit(n)))).otherwise(out)
    return out


@query(
    "text_helpers",
    cte("fx_products")
    + """SELECT ord, concat_ws(', ', concat(tile, '/', substr(product, 12, 8)), concat(tile, '/', substr(product, 12, 8))) AS products,
    CASE WHEN sz < 1024 THEN concat(printf('%.1f', sz), 'B') WHEN sz < pow(1024,2) THEN concat(printf('%.1f', sz/1024), 'KB')
    WHEN sz < pow(1024,3) THEN concat(printf('%.1f', sz/pow(1024,2)), 'MB') WHEN sz < pow(1024,4) THEN concat(printf('%.1f', sz/pow(1024,3)), 'GB')
    ELSE concat(printf('%.1f', sz/pow(1024,4)), 'TB') END AS size, 'osm' AS label_source, CASE WHEN ord % 2 = 0 THEN source ELSE 'good' END AS quality,
    CASE WHEN ord % 3 = 0 THEN valid_ratio ELSE 0.8 END AS buffer_ratio
    FROM (SELECT *, pow(ord + 1, 1 + ord % 4) * 1e0 AS sz FROM fx_products)""",
)
def text_helpers(spark: SparkSession, sf: str) -> DataFrame:
    df = fixture(spark, sf, "fx_products").withColumns(
        {
            "sz": _power(F.col("ord") + 1, 1 + F.col("ord") % 4),
            "quality": F.when(F.col("ord") % 2 == 0, F.col("source")).otherwise(" "),
            "buffer_ratio": F.when(F.col("ord") % 3 == 0, F.col("valid_ratio").cast("string")),
        }
    )
    full = C.with_label_defaults(df)
    return full.select(
        "ord",
        C.short_product_list(F.array("product", F.lit(""), "product")).alias("products"),
        C.human_size(F.col("sz")).alias("size"),
        "label_source",
        "quality",
        "buffer_ratio",
    )


@query(
    "clip_size",
    cte("fx_water", more={"m": m_table("fx_water")})
    + """, a AS (SELECT k, (x1-x0)/greatest(y1-y0, 1) AS r FROM m), h AS (SELECT *, greatest(240, least(1400, round(900/greatest(r, 0.1)))) AS h0 FROM a)
    SELECT k, cast(CASE WHEN h0 > 900 THEN greatest(240, least(1400, round(900*r))) ELSE 900 END AS INT) AS width,
    cast(least(h0, 900) AS INT) AS height FROM h""",
)
def clip_size(spark: SparkSession, sf: str) -> DataFrame:
    from waterspark.operators.raster import output_size

    df = with_boxes(fixture(spark, sf, "fx_water"))
    m = G.mercator_bounds(*[F.col(c) for c in ("bbox_west", "bbox_south", "bbox_east", "bbox_north")])
    size = output_size(m["xmax"] - m["xmin"], m["ymax"] - m["ymin"], F.lit(900))
    return df.select("k", size["width"].alias("width"), size["height"].alias("height"))


def _utm_sql() -> str:
    k = G._krueger_constants()
    a, s = 0.9996 * k["a"], []

    def lonlat(e: str, n: str) -> tuple[str, str]:
        xi, eta = f"(({n})/{a!r})", f"((({e})-500000e0)/{a!r})"
        xi1, eta1 = xi, eta
        for j, b in enumerate(k["beta"], 1):
            xi1 += f" - ({b!r})*sin({2 * j}*{xi})*cosh({2 * j}*{eta})"
            eta1 += f" - ({b!r})*cos({2 * j}*{xi})*sinh({2 * j}*{eta})"
        chi = f"asin(sin({xi1})/cosh({eta1}))"
        lat = chi + "".join(f" + ({d!r})*sin({2 * j}*{chi})" for j, d in enumerate(k["delta"], 1))
        return f"degrees(atan2(sinh({eta1}), cos({xi1}))) + (zone*6-183)", f"degrees({lat})"

    pts = [lonlat(e, n) for e, n in (("l", "b"), ("r", "b"), ("r", "t"), ("l", "t"))]
    for i, (name, fn) in enumerate((("west", "least"), ("south", "least"), ("east", "greatest"), ("north", "greatest"))):
        s.append(f"round({fn}({', '.join(p[i % 2] for p in pts)}), 6) AS {name}")
    return ", ".join(s)


_UTM = "300000 + 1000*(p_partkey % 300) AS l, 2700000 + 1000*(p_partkey % 500) AS b, 300000 + 1000*(p_partkey % 300) + 10980 AS r, 2700000 + 1000*(p_partkey % 500) + 10980 AS t, 47 + p_partkey % 3 AS zone"


@query("footprint_utm", f"SELECT p_partkey, {_utm_sql()} FROM (SELECT p_partkey, {_UTM} FROM part)")
def footprint_utm(spark: SparkSession, sf: str) -> DataFrame:
    df = spread(spark, sf, "part").selectExpr("p_partkey", *[p.strip() for p in _UTM.split(", ")])
    box = G.utm_box_footprint(*[F.col(c) for c in ("l", "b", "r", "t", "zone")], corners_only=True)
    return df.select("p_partkey", box.alias("f")).select(
        "p_partkey", *[F.round(F.col(f"f.{c}"), 6).alias(c) for c in ("west", "south", "east", "north")]
    )
