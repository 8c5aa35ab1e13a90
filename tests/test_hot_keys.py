"""Left joins with hot keys against the plain join."""

from pyspark.sql import functions as F

from waterspark.operators.hot_keys import join_spread


def test_hot_keys_are_dealt_and_joined_alike(spark):
    left = spark.range(4000).selectExpr("id", "CASE WHEN id % 10 < 6 THEN 'none' WHEN id % 10 < 8 THEN NULL ELSE concat('k', id % 50) END AS key")
    right = spark.createDataFrame([("none", 1), ("none", 2), ("k8", 3), ("k9", 4), ("odd", 5)], "key string, v int")
    got = join_spread(left, right, "key", hot_rows=100)
    want = left.join(right, "key", "left")
    assert sorted(map(str, got.select("id", "key", "v").collect())) == sorted(map(str, want.select("id", "key", "v").collect()))
    # No task holds a hot key whole: its rows and those without a key lie in many parts.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = join_spread(left, right.where("v <> 2"), "key", hot_rows=100)
        sizes = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes < 2000
