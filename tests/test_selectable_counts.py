"""Counts of offered products against the list of them."""

from pyspark.sql import functions as F

from waterspark.operators import imagery


def test_selectable_counts_are_those_of_the_list(spark):
    kind = "tile string, product string, product_id string, date string, source string, lake_id string, cloud_cover double, valid_ratio double, safe_path string, tci_path string"

    def row(tile, product, source, lake):
        return (tile, product, product, "2024-01-01", source, lake, 0.0, 1.0, "s", "t")

    base = spark.createDataFrame([row("T1", "b1", "preloaded", ""), row("T2", "b2", "preloaded", "")], kind)
    user = spark.createDataFrame(
        [row("T1", "u1", "local_img", "x"), row("T1", "u1", "user_download", ""), row("T1", "u2", "user_download", ""), row("T2", "u3", "local_img", "y"), row("T2", "u4", "user_download", None), row("T3", None, None, "")],
        kind,
    )
    active = spark.createDataFrame([("", "T1", "u1"), ("x", "T1", "u1"), ("", "T2", "b2"), ("", "T2", "b2"), ("y", "T2", "b2")], "scope string, tile string, product string")
    pairs = spark.createDataFrame([(k, t) for k in "xyz" for t in ("T1", "T2", "T3", "T4")] + [("x", "T1")], "lake_uid string, tile string")
    want = imagery.selectable_products(pairs, base, user, active).groupBy("lake_uid", "tile").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("preloaded").alias("n_base"), F.count_if("asset.is_lake_native").alias("n_native"),
        F.count_if("active").alias("n_active"), F.max("product").alias("last_product"),
    )
    got = imagery.selectable_counts(pairs, base, user, active)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
