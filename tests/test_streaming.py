import re

from pyspark.sql import functions as F

from waterspark.operators.numbering import with_position
from waterspark.operators.upsert import upsert
from waterspark.streaming import upserts


def test_replayed_batch_changes_nothing(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")]
    spark.createDataFrame(rows, "key string, ts int, v string").write.parquet(src)
    stream = spark.readStream.schema("key string, ts int, v string").parquet(src)
    for run in range(2):
        upserts.start_upserts(stream, "key", ["ts"], table, str(tmp_path / f"c{run}")).awaitTermination()
    spark.createDataFrame([("b", 1, "late"), ("c", 9, "new")], "key string, ts int, v string").write.mode("append").parquet(src)
    upserts.start_upserts(stream, "key", ["ts"], table, str(tmp_path / "c1")).awaitTermination()
    got = {r.key: r.v for r in upserts.current_table(spark, table, "key", ["ts"]).collect()}
    assert got == {"a": "y", "b": "z", "c": "new"}
    assert upserts.compact(spark, table, "key", ["ts"]) == upserts.compact(spark, table, "key", ["ts"]) == 1
    assert {r.key: r.v for r in upserts.current_table(spark, table, "key", ["ts"]).collect()} == got


def test_hundred_batches_read_few_files(spark, tmp_path):
    """One file a batch: the snapshot follows the log, and readers never list all batches."""
    src, table = tmp_path / "in", str(tmp_path / "table")
    src.mkdir()
    for b in range(100):
        lines = [f'{{"key": "k{(b * 7 + i) % 40}", "ts": {b}, "v": "{b}-{i}"}}' for i in range(3)]
        (src / f"{b:03d}.json").write_text("\n".join(lines))
    schema = "key string, ts int, v string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    job = upserts.start_upserts(stream, "key", ["ts", "v"], table, str(tmp_path / "c"), compact_every=8, buckets=4)
    job.awaitTermination()
    now = upserts.current_table(spark, table, "key", ["ts", "v"])
    rows = [tuple(r) for r in now.collect()]
    assert sorted(rows) == sorted(tuple(r) for r in upserts.latest_per_key(spark.read.schema(schema).json(str(src)), "key", ["ts", "v"]).collect())
    assert upserts.versions(spark, table) == [11, 12]
    assert len(upserts._batches(spark, table)) <= 2 * 8
    files = {f.split("/table/")[1] for f in now.inputFiles()}
    assert len([f for f in files if f.startswith("log")]) == 4
    assert len([f for f in files if f.startswith("snapshots/version=12")]) == len(files) - 4 <= 4
    one = upserts.lookup(spark, table, "key", ["ts", "v"], ["k3"], buckets=4)
    assert [tuple(r) for r in one.collect()] == [r for r in rows if r[0] == "k3"]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", one._jdf.queryExecution().executedPlan().toString())
    # A version without its mark, as a lost driver leaves it, is not read and is made anew.
    (tmp_path / "table/snapshots/version=13/rows").mkdir(parents=True)
    assert upserts.versions(spark, table) == [11, 12]
    assert upserts.compact(spark, table, "key", ["ts", "v"], 4) == 13
    assert sorted(tuple(r) for r in upserts.current_table(spark, table, "key", ["ts", "v"]).collect()) == sorted(rows)


def test_streams_of_two_checkpoints_share_a_table(spark, tmp_path):
    """Their batch ids begin at zero both, which must not overwrite one another."""
    table, schema = str(tmp_path / "table"), "key string, ts int, v string"
    for n, row in enumerate([("a", 1, "x"), ("b", 2, "y")]):
        src = str(tmp_path / f"in{n}")
        spark.createDataFrame([row], schema).write.parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        upserts.start_upserts(stream, "key", ["ts"], table, str(tmp_path / f"c{n}"), compact_every=1).awaitTermination()
    assert sorted(r.key for r in upserts.current_table(spark, table, "key", ["ts"]).collect()) == ["a", "b"]


def test_upsert_adds_columns(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, v string")
    new = spark.createDataFrame([("b", "3", "n")], "key string, v string, extra string")
    assert sorted(map(tuple, upsert(old, new, "key").collect())) == [("a", "1", ""), ("b", "3", "n")]


def test_positions_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = with_position(df, [F.col("v").desc()]).collect()
    assert all(r.position == 1000 - r.v for r in got)
