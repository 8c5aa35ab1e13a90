import pytest
from pyspark.sql import functions as F

from waterspark.functions import clean as C
from waterspark.plans.scalar_queries import _power


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw,text,ident",
    [("  a ", "a", "a"), ("NaN", None, None), (" ", None, None), ("123.0", "123.0", "123"), ("x.0", "x.0", "x.0"), ("　水\t", "水", "水")],
)
def test_clean(spark, raw, text, ident):
    assert one(spark, C.clean_text(F.col("a")), a=raw) == text
    assert one(spark, C.clean_id(F.col("a")), a=raw) == ident


def test_batch_id_rule(spark):
    assert one(spark, C.clean_id(F.col("a"), any_text=True), a="x.0") == "x"


def test_tags(spark):
    text = '"water"=>"lake","name:zh"=>"湖","water"=>"pond","e"=>""'
    assert one(spark, C.tag_map(F.col("a")), a=text) == {"water": "pond", "name:zh": "湖", "e": ""}
    assert one(spark, C.tag_value(F.col("a"), "water"), a=text) == "pond"
    assert one(spark, C.tag_value(F.col("a"), "missing"), a=text) is None


@pytest.mark.parametrize(
    "name,water,landuse,natural,area,want",
    [
        ("某水库湿地", None, None, None, 1, "reservoir"),
        ("大鱼塘", None, None, None, 1, "aquaculture"),
        ("湖边湿地", None, None, None, 1, "wetland"),
        (None, "pond", None, "water", 1, "pond"),
        ("东湖", None, None, None, 1, "lake"),
        (None, None, None, None, 0.05, "pond_candidate"),
        (" nan", None, None, None, 0.05, "pond_candidate"),
        ("x", None, None, None, 0.05, "unknown"),
    ],
)
def test_water_type(spark, name, water, landuse, natural, area, want):
    df = spark.createDataFrame([(name, water, landuse, natural, float(area))], "n string, w string, l string, t string, a double")
    null = F.lit(None).cast("string")
    rule = C.water_type(F.col("n"), null, null, F.col("w"), F.col("l"), F.col("t"), F.col("a"))
    assert df.select(rule.alias("v")).first().v == want


@pytest.mark.parametrize("area,want", [(100.0, "gte100"), (99.9, "10_100"), (10.0, "10_100"), (1.0, "1_10"), (0.1, "0_1_1"), (0.09, "lt0_1")])
def test_buckets(spark, area, want):
    assert spark.range(1).select(C.area_bucket(F.lit(area)).alias("v")).first().v == want


def test_names(spark):
    name = "S2A_MSIL1C_20240305T030541_N0500_R075_T49RCP_20240305T050000.SAFE"
    assert one(spark, C.product_tile(F.col("a")), a=name) == "49RCP"
    assert one(spark, C.product_date(F.col("a")), a=name) == "2024-03-05"
    assert one(spark, C.product_type(F.col("a")), a=name) == "L1C"
    assert one(spark, C.product_date(F.col("a")), a="none") == ""
    assert one(spark, C.image_date(F.col("a")), a="x_MSIL2A_20230101.img") == "2023-01-01"
    assert one(spark, C.label_date(F.col("a")), a="lake-2021_0304") == "2021-03-04"


def test_aliases_and_defaults(spark):
    assert one(spark, C.id_aliases(F.col("a")), a="hunan_osm_1") == ["hn_osm_1"]
    assert sorted(one(spark, C.id_aliases(F.col("a")), a="gansu_mu_7")) == ["gansu_7", "gs_mu_7"]
    assert one(spark, C.id_aliases(F.col("a")), a="shaanxi_7") == ["shaanxi_mu_7"]
    assert one(spark, C.nearest_threshold(F.lit(60), F.array(F.lit(50), F.lit(70))), a="") == 50
    assert one(spark, C.human_size(F.col("a")), a="1536") == "1.5KB"
    assert one(spark, C.default_window(F.lit("2024-04-30").cast("date")), a="").asDict() == {"start": "2024-02-29", "end": "2024-04-30"}


@pytest.mark.parametrize("value", [1.25, 1.35, 0.25, 2.45, 0.95, 9.96, 1023.95, 0.05, 2.0**40 + 0.25, 2.0**40 + 0.75, 0.0, 7.0, 0.449999999999999956])
def test_sizes_round_as_printf(spark, value):
    for factor, unit in ((1.0, "B"), (1024.0**4, "TB")):
        if unit == "TB" or value < 1024:
            want = "%.1f%s" % (value, unit)
            if unit == "TB" and value < 1:
                continue
            assert one(spark, C.human_size(F.col("a")), a=repr(value * factor)) == want


def test_powers_are_rounded_once(spark):
    """The power function of the JVM is off by one place for these."""
    for n in (453540, 553528, 580492):
        assert one(spark, C.human_size(_power(F.col("a").cast("long"), F.lit(4))), a=str(n)) == "%.1fTB" % (n**4 / 1024**4)
