"""Inputs derived from the given tables, with one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waterspark.functions import geometry as G
from waterspark.session import real_sizes

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_TILE = "concat('49R', chr(cast(65 + o_custkey % 5 AS int)), chr(cast(65 + floor((o_custkey % 25)/5e0) AS int)))"
_DAY = "concat(year(o_orderdate), lpad(concat(month(o_orderdate), ''), 2, '0'), lpad(concat(day(o_orderdate), ''), 2, '0'))"

FIXTURES: dict[str, tuple[list[str], str]] = {
    "fx_water": (
        ["part"],
        """SELECT p_partkey AS k, concat('hunan_osm_', p_partkey) AS lake_uid,
       10850 + 15*(p_partkey % 40) AS w100, 2450 + 14*((p_partkey*7) % 41) AS s100,
       5 + p_partkey % 9 AS dx, 4 + p_size % 11 AS dy,
       CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN concat(p_name, '水库')
            WHEN p_partkey % 7 = 1 THEN concat(p_name, '塘') WHEN p_partkey % 7 = 2 THEN concat(p_name, '湖')
            WHEN p_partkey % 7 = 3 THEN concat(p_name, '湿地') ELSE p_name END AS name,
       CASE p_partkey % 6 WHEN 0 THEN '"water"=>"lake","wikidata"=>"Q1"'
            WHEN 1 THEN '"water"=>"reservoir","name:zh"=>"甲库"' WHEN 2 THEN '"water"=>"river"'
            WHEN 3 THEN '"water"=>"canal"' WHEN 4 THEN '"water"=>"pond","name:en"=>"P"' ELSE NULL END AS other_tags,
       CASE p_size % 7 WHEN 0 THEN 'reservoir' WHEN 1 THEN 'aquaculture' ELSE NULL END AS landuse,
       CASE p_size % 5 WHEN 0 THEN 'wetland' ELSE 'water' END AS nat,
       CASE WHEN p_partkey % 3 = 0 THEN concat(p_partkey, '.0') WHEN p_partkey % 3 = 1 THEN ' ' ELSE concat(' ', p_partkey) END AS osm_id,
       CASE WHEN p_partkey % 3 = 1 AND p_partkey % 4 <> 0 THEN concat(p_partkey, '') ELSE 'nan' END AS osm_way_id,
       CASE p_partkey % 2 WHEN 0 THEN 'hunan' ELSE 'gansu' END AS region
FROM {part}""",
    ),
    "fx_ref": (
        ["customer"],
        """SELECT c_custkey + 1 AS hylak_id, c_name AS lake_name, c_acctbal/100e0 AS lake_area,
       c_mktsegment AS country,
       10850 + 15*(c_custkey % 40) + c_custkey % 6 AS w100, 2450 + 14*((c_custkey*11) % 41) AS s100,
       6 + c_custkey % 8 AS dx, 5 + c_custkey % 7 AS dy
FROM {customer}""",
    ),
    "fx_tiles": (
        ["nation"],
        """SELECT concat('49R', chr(65 + n_nationkey % 5), chr(65 + cast(floor(n_nationkey/5e0) AS int))) AS tile,
       10850 + 125*(n_nationkey % 5) AS w100, 2450 + 118*cast(floor(n_nationkey/5e0) AS int) AS s100,
       130 AS dx, 122 AS dy
FROM {nation}""",
    ),
    "fx_products": (
        ["orders"],
        f"""SELECT o_orderkey AS ord,
       concat('S2A_MSIL1C_', {_DAY}, 'T030541_N0500_R075_T', {_TILE}, '_', o_orderkey, '.SAFE') AS product,
       {_TILE} AS tile,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('hunan_osm_', o_custkey) ELSE '' END AS lake_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'local_img' WHEN 1 THEN 'user_download' ELSE 'preloaded' END AS source,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 101)/1e0 END AS cloud_cover,
       (o_orderkey % 100)/100e0 AS valid_ratio,
       concat(year(o_orderdate), '-', lpad(concat(month(o_orderdate), ''), 2, '0'), '-', lpad(concat(day(o_orderdate), ''), 2, '0')) AS day,
       concat('P', o_orderkey) AS product_id,
       concat('img/', o_custkey, '/', o_orderkey, '.img') AS tci_path,
       concat('img/', o_custkey) AS safe_path
FROM {{orders}}""",
    ),
    "fx_pixels": (
        ["lineitem"],
        """SELECT l_linenumber % 2 AS raster_id, l_partkey % 128 AS prow, l_orderkey % 128 AS pcol,
       max(cast(l_quantity AS int))*2 AS occurrence,
       CASE WHEN max(l_linenumber) >= 5 THEN 80 ELSE 10 END AS landcover,
       max(cast(l_discount*100 AS int)) AS band1
FROM {lineitem} GROUP BY l_linenumber % 2, l_partkey % 128, l_orderkey % 128""",
    ),
    "fx_updates": (
        ["events"],
        """SELECT event_id, ts, concat('S', user_id) AS sample_id, event_type AS quality,
       CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('split', event_id % 3) END AS split, value
FROM {events}""",
    ),
}
# Built on the ones above.
FIXTURES["fx_base"] = (
    ["fx_products"],
    """SELECT * FROM {fx_products} WHERE source = 'preloaded' AND lake_id = ''""",
)
FIXTURES["fx_user"] = (["fx_products"], """SELECT * FROM {fx_products} WHERE source <> 'preloaded'""")
FIXTURES["fx_active"] = (
    ["fx_products"],
    # Every product selects; six of seven for a tile that nobody asks for.
    """SELECT scope_key, max(product) AS product FROM (
    SELECT concat(CASE WHEN lake_id = '' THEN tile ELSE concat(lake_id, ':', tile) END, CASE WHEN ord % 7 = 0 THEN '' ELSE 'OLD' END) AS scope_key, product FROM {fx_products}
) GROUP BY scope_key""",
)


SPREAD = {"part", "customer", "orders", "lineitem", "events"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    real_sizes(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; the one-file ones are spread, as one file is one task otherwise.

    Real inputs come as many files and need no such step."""
    df = table(spark, sf, name)
    return df.repartition(spark.sparkContext.defaultParallelism) if name in SPREAD else df


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    needs, sql = FIXTURES[name]
    frames = {n: fixture(spark, sf, n) if n in FIXTURES else spread(spark, sf, n) for n in needs}
    return spark.sql(sql, **frames)


def with_boxes(df: DataFrame) -> DataFrame:
    """Add the polygon and its box columns to a fixture of hundredth-degree boxes."""
    w, s = F.col("w100") / F.lit(100.0), F.col("s100") / F.lit(100.0)
    e, n = (F.col("w100") + F.col("dx")) / F.lit(100.0), (F.col("s100") + F.col("dy")) / F.lit(100.0)
    return df.withColumns(
        {
            "bbox_west": w,
            "bbox_south": s,
            "bbox_east": e,
            "bbox_north": n,
            "geometry": G.box_polygon(w, s, e, n),
        }
    ).drop("w100", "s100", "dx", "dy")


# ------------------------------------------------------------------ oracle SQL
def cte(*names: str, more: dict[str, str] | None = None) -> str:
    """WITH clause holding the named fixtures (and what they build on) plus own steps."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in FIXTURES[n][0]:
            if dep in FIXTURES:
                visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        needs, sql = FIXTURES[n]
        parts.append(f"{n} AS ({sql.format(**{d: d for d in needs})})")
    for n, sql in (more or {}).items():
        parts.append(f"{n} AS ({sql})")
    return "WITH " + ",\n".join(parts) + "\n"


_MX = "({v}/100e0*111319.49079327357)"
_MY = "(ln(tan(radians({v}/100e0/2 + 45e0)))*6378137e0)"


def mercator_box(alias: str) -> dict[str, str]:
    """SQL expressions of a fixture box in the mercator plane."""
    return {
        "x0": _MX.format(v=f"{alias}.w100"),
        "y0": _MY.format(v=f"{alias}.s100"),
        "x1": _MX.format(v=f"({alias}.w100+{alias}.dx)"),
        "y1": _MY.format(v=f"({alias}.s100+{alias}.dy)"),
    }


def m_table(name: str) -> str:
    """SELECT adding x0, y0, x1, y1 and m2 to a box fixture."""
    b = mercator_box("t")
    return (
        f"SELECT *, (x1-x0)*(y1-y0) AS m2 FROM (SELECT t.*, {b['x0']} AS x0, {b['y0']} AS y0, "
        f"{b['x1']} AS x1, {b['y1']} AS y1 FROM {name} t)"
    )


OVERLAP = "round(greatest(0e0, least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0e0, least(a.y1,b.y1)-greatest(a.y0,b.y0)), 2)"
HIT = "a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0"
TOUCH = "a.x0 <= b.x1 AND a.x1 >= b.x0 AND a.y0 <= b.y1 AND a.y1 >= b.y0"
