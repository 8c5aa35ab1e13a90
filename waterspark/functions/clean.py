"""Scalar cleaning rules as Column expressions (no Python UDFs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TAG_PATTERN = r'"([^"]+)"=>"([^"]*)"'
WATER_COLUMNS = ["fclass", "class", "type", "natural", "water", "landuse"]
WATER_VALUES = ["water", "reservoir", "lake", "pond", "basin", "wetland", "riverbank", "dock"]
WATER_TAG_SNIPPETS = ['"natural"=>"water"', '"water"=>"', '"landuse"=>"reservoir"']
FLOWING_SNIPPETS = ['"water"=>"river"', '"water"=>"canal"']
OSM_COLUMNS = ["osm_id", "osm_way_id", "name", "type", "natural", "landuse", "man_made", "other_tags"]
AREA_BUCKETS = ["gte100", "10_100", "1_10", "0_1_1", "lt0_1"]
ALIAS_PAIRS = [("hunan_", "hn_"), ("gansu_", "gs_")]
ALIAS_INFIX = ["gansu", "shaanxi"]
LABEL_DEFAULTS = {
    "label_source": "osm",
    "label_threshold": "",
    "label_scope": "target_only",
    "mask_policy": "other_water_ignore",
    "context_sources": "osm,hydrolakes",
    "ignore_sources": "osm,hydrolakes,esa,jrc",
    "quality": "good",
    "notes": "",
}
LABEL_SOURCES = ["osm", "hydrolakes", "esa", "jrc"]
DEFAULT_LABEL_THRESHOLD = 75
EDITABLE_SAMPLE_COLUMNS = ["quality", "split", "notes", "label_scope", "mask_policy", "context_sources", "ignore_sources"]
ASSET_LABELS = {"lake_native": "本体影像", "preloaded_tile": "预置 Sentinel tile", "sentinel_tile": "已下载 Sentinel tile"}
DEFAULT_BUFFER_RATIO = 0.8
DEFAULT_MIN_AREA_KM2 = 0.01
# ----------------------------------------------------------------------------


def strip(c: Column) -> Column:
    """Trim every Unicode blank, not only spaces."""
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    t = strip(c)
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def clean_id(c: Column, any_text: bool = False) -> Column:
    """Cleaned id without a trailing ``.0``; by default only behind digits."""
    pattern = r"^(.*)\.0$" if any_text else r"^(\d+)\.0$"
    return F.regexp_replace(clean_text(c), pattern, "$1")


def first_present(*cols: Column, default: str | None = None) -> Column:
    parts = [clean_text(c) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def tag_entries(c: Column) -> Column:
    """Tag text as array<struct<key,value>> in source order, duplicates kept."""
    found = F.regexp_extract_all(c, F.lit(TAG_PATTERN), F.lit(0))
    return F.transform(
        found,
        lambda m: F.struct(
            F.regexp_extract(m, TAG_PATTERN, 1).alias("key"),
            F.regexp_extract(m, TAG_PATTERN, 2).alias("value"),
        ),
    )


def tag_value(c: Column, key: str) -> Column:
    """Value of one key; the last duplicate wins.

    A greedy prefix finds the last occurrence with one regular expression instead of
    building the map, so reading five keys stays inside code generation.
    """
    pattern = rf'(?s)^.*"{key}"=>"([^"]*)"'
    return F.when(F.contains(c, F.lit(f'"{key}"=>"')), F.regexp_extract(c, pattern, 1))


def tag_map(c: Column) -> Column:
    """Tag text as map<string,string>; the last duplicate key wins."""
    entries = F.coalesce(tag_entries(c), F.array().cast("array<struct<key:string,value:string>>"))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(
        keys,
        F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]),
    )


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _iso(c: Column) -> Column:
    return F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))


def tile_code(c: Column) -> Column:
    """Upper-case tile code without the leading T."""
    return F.regexp_replace(F.upper(c), "^T", "")


def product_tile(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"_T([0-9A-Z]{5})_", 1), F.lit(""))


def product_date(c: Column) -> Column:
    first = _or_null(F.regexp_extract(c, r"_MSIL\d[AC]?_(\d{8})T\d{6}", 1))
    second = _or_null(F.regexp_extract(c, r"MSIL1C_(\d{8})T\d{6}", 1))
    found = F.coalesce(first, second)
    return F.when(found.isNotNull(), _iso(found)).otherwise("")


def image_date(c: Column) -> Column:
    found = F.regexp_extract(c, r"MSIL\d[AC]?_(\d{8})", 1)
    return F.when(found != "", _iso(found)).otherwise("")


def product_type(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"_MSI(L[12][AC])_", 1), F.lit(""))


def label_date(stem: Column) -> Column:
    pattern = r"(20\d{2}|19\d{2})[-_]?([01]\d)[-_]?([0-3]\d)"
    parts = [F.regexp_extract(stem, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("-", *parts)).otherwise("")


def water_uid(prefix: Column, osm_id: Column, way_id: Column, fallback: Column) -> Column:
    head = F.concat(prefix, F.lit("_osm_"))
    return F.coalesce(
        F.concat(head, clean_id(osm_id)),
        F.concat(head, F.lit("way_"), clean_id(way_id)),
        F.concat(head, F.coalesce(clean_id(fallback), F.lit("feature"))),
    )


def water_type(
    name: Column, name_zh: Column, name_en: Column, water: Column, landuse: Column, natural: Column, area_km2: Column
) -> Column:
    shown = first_present(name, name_zh, name_en)
    label = F.coalesce(shown, F.lit(""))
    tag, use, nat = (F.coalesce(clean_text(c), F.lit("")) for c in (water, landuse, natural))
    return (
        F.when((tag == "reservoir") | (use == "reservoir") | label.contains("水库"), "reservoir")
        .when((use == "aquaculture") | label.contains("鱼塘") | label.contains("养殖"), "aquaculture")
        .when((nat == "wetland") | (tag == "wetland") | label.contains("湿地"), "wetland")
        .when((tag == "pond") | label.contains("塘"), "pond")
        .when((tag == "lake") | label.contains("湖"), "lake")
        .when((area_km2 < 0.1) & shown.isNull(), "pond_candidate")
        .otherwise("unknown")
    )


def polygon_quality(area_km2: Column, has_reference: Column, has_imagery: Column) -> Column:
    return (
        F.when((has_reference != 0) & (has_imagery != 0), "high")
        .when((has_imagery != 0) | (area_km2 >= 1), "medium")
        .otherwise("low")
    )


def metadata_quality(display_name: Column, reference_id: Column, best_tile: Column) -> Column:
    def filled(c: Column) -> Column:
        return (F.coalesce(c.cast("string"), F.lit("")) != "").cast("int")

    score = filled(display_name) + reference_id.isNotNull().cast("int") + filled(best_tile)
    return F.element_at(F.array(*[F.lit(v) for v in ("low", "medium", "high", "high")]), score + 1)


def is_still_water(tags: Column) -> Column:
    text = F.coalesce(tags, F.lit(""))
    return ~text.contains(FLOWING_SNIPPETS[0]) & ~text.contains(FLOWING_SNIPPETS[1])


def looks_like_water(df: DataFrame) -> Column:
    """Classification over whichever of the known columns the input has."""
    hit = F.lit(False)
    for name in WATER_COLUMNS:
        if name in df.columns:
            hit = hit | F.coalesce(F.lower(F.col(name)).isin(WATER_VALUES), F.lit(False))
    if "other_tags" in df.columns:
        tags = F.lower(F.coalesce(F.col("other_tags"), F.lit("")))
        for snippet in WATER_TAG_SNIPPETS:
            hit = hit | tags.contains(snippet)
    return hit


def area_bucket(area_km2: Column) -> Column:
    return (
        F.when(area_km2 >= 100, "gte100")
        .when(area_km2 >= 10, "10_100")
        .when(area_km2 >= 1, "1_10")
        .when(area_km2 >= 0.1, "0_1_1")
        .otherwise("lt0_1")
    )


def truthy(c: Column, default: bool = False) -> Column:
    """Flag text to boolean; other non-blank text counts as true."""
    t = F.lower(strip(c))
    return (
        F.when(t.isNull() | t.isin("", "nan", "none", "null"), F.lit(default))
        .when(t.isin("1", "true", "yes", "y"), F.lit(True))
        .when(t.isin("0", "false", "no", "n"), F.lit(False))
        .otherwise(F.lit(True))
    )


def number_or(c: Column, default: float | None) -> Column:
    parsed = clean_text(c).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def split_list(c: Column, sep: str = ",") -> Column:
    parts = F.split(clean_text(c), sep)
    kept = F.filter(F.transform(parts, strip), lambda s: s != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def safe_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]+", "_")


def short_sha1(*cols: Column) -> Column:
    return F.substring(F.sha1(F.concat(*cols)), 1, 12)


def sample_id(lake: Column, products: Column, source: Column, threshold: Column, scope: Column, policy: Column) -> Column:
    return F.concat_ws("_", lake, short_sha1(products, source, threshold, scope, policy))


def id_aliases(c: Column) -> Column:
    """Legacy spellings of a water-body id, as array<string>."""
    t = clean_id(c)

    def swap(old: str, new: str) -> Column:
        return F.concat(F.lit(new), F.substr(t, F.lit(len(old) + 1)))

    found: list[Column] = []
    for now, old in ALIAS_PAIRS:
        found.append(F.when(t.startswith(now), swap(now, old)).when(t.startswith(old), swap(old, now)))
    for prefix in ALIAS_INFIX:
        now, old = f"{prefix}_", f"{prefix}_mu_"
        found.append(F.when(t.startswith(old), swap(old, now)).when(t.startswith(now), swap(now, old)))
    return F.array_compact(F.array(*found))


def nearest_threshold(value: Column, thresholds: Column) -> Column:
    """Closest element of an array; the earlier one wins a tie."""
    ranked = F.transform(
        thresholds, lambda t, i: F.struct(F.abs(t - value).alias("gap"), i.alias("pos"), t.alias("t"))
    )
    return F.array_min(ranked)["t"]


def short_product_list(products: Column) -> Column:
    """``tile/date`` shorthand of an array of product names."""

    def short(p: Column) -> Column:
        tile = _or_null(F.regexp_extract(p, r"_T([0-9A-Z]{5})_", 1))
        day = _or_null(F.regexp_extract(p, r"MSIL\d[AC]?_(\d{8})T", 1))
        return F.concat_ws("/", tile, day)

    return F.array_join(F.filter(F.transform(products, short), lambda s: s != ""), ", ")


def one_decimal(v: Column) -> Column:
    """A number with one decimal, rounded by its exact binary value, halves to even.

    ``format_string`` rounds the shortest decimal text instead, halves upwards. The part
    behind the point is cut in two, so that every product below is exact.
    """
    size = F.abs(v)
    whole = F.floor(size).cast("double")
    part = size - whole
    head = F.floor(part * 2.0**26) / 2.0**26
    digit = F.floor(head * 10.0).cast("double")
    rest = (head * 10.0 - digit - 0.5) + (part - head) * 10.0
    # Ten times the tail may hold another tenth.
    digit, rest = F.when(rest >= 0.5, digit + 1).otherwise(digit), F.when(rest >= 0.5, rest - 1).otherwise(rest)
    tenth = digit + ((rest > 0) | ((rest == 0) & (digit % 2 == 1))).cast("double")
    carried = F.when(tenth >= 10, whole + 1).otherwise(whole)
    text = F.concat(carried.try_cast("long").cast("string"), F.lit("."), F.when(tenth >= 10, tenth - 10).otherwise(tenth).cast("int").cast("string"))
    signed = F.concat(F.when(v < 0, "-").otherwise(""), text)
    return F.when(size < 2.0**53, signed).otherwise(F.format_string("%.1f", v))


def human_size(c: Column) -> Column:
    v = c.cast("double")
    out = None
    for power, unit in enumerate(("B", "KB", "MB", "GB")):
        text = F.concat(one_decimal(v / 1024.0**power), F.lit(unit))
        out = F.when(v < 1024.0 ** (power + 1), text) if out is None else out.when(v < 1024.0 ** (power + 1), text)
    return out.otherwise(F.concat(one_decimal(v / 1024.0**4), F.lit("TB")))


def default_window(today: Column) -> Column:
    """Date window of the last two months, month ends clamped."""
    return F.struct(
        F.add_months(today, -2).cast("string").alias("start"), today.cast("date").cast("string").alias("end")
    )


def with_label_defaults(df: DataFrame) -> DataFrame:
    """Fill missing label parameters of a request table."""
    cols = {}
    for name, default in LABEL_DEFAULTS.items():
        cols[name] = first_present(F.col(name), default=default) if name in df.columns else F.lit(default)
    ratio = number_or(F.col("buffer_ratio"), DEFAULT_BUFFER_RATIO) if "buffer_ratio" in df.columns else F.lit(
        DEFAULT_BUFFER_RATIO
    )
    return df.withColumns({**cols, "buffer_ratio": ratio})


def normalise_water_schema(df: DataFrame) -> DataFrame:
    """Bring a raw extract to the eight known attributes, deriving gaps from ``fclass``."""
    has = set(df.columns)
    fclass = F.col("fclass") if "fclass" in has else None
    null = F.lit(None).cast("string")
    defaults: dict[str, Column] = {
        "osm_way_id": null,
        "type": fclass if fclass is not None else null,
        "natural": F.lit("water"),
        "landuse": F.when(F.lower(fclass) == "reservoir", "reservoir") if fclass is not None else null,
        "man_made": null,
        "other_tags": F.concat(F.lit('"water"=>"'), F.coalesce(fclass, F.lit("")), F.lit('"'))
        if fclass is not None
        else F.lit(""),
        "osm_id": null,
        "name": null,
    }
    out = df.withColumns({k: v for k, v in defaults.items() if k not in has})
    tail: Sequence[str] = [c for c in df.columns if c not in set(OSM_COLUMNS) | {"fclass", "class", "water"}]
    return out.select(*OSM_COLUMNS, *tail)
