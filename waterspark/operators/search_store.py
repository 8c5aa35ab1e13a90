"""Search on a stored table: rows in page order, and postings of three-letter grams.

    rows/part=<n>      the table, sorted by area and id; part n follows part n - 1
    parts              rows and areas of each part
    columns            an empty table with the columns of rows, for a store without rows
    grams/bucket=<b>   gram, part, lake_uid: which rows hold a gram in a searched column

Pages of the whole table read the parts they lie in, whatever their depth. A search reads
the postings of its grams, then the parts with rows that hold all of them, where the text
itself is compared. Words shorter than a gram, which nearly all rows hold, scan the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waterspark.functions import geometry as G
from waterspark.operators.search import PAGE_SIZE, SEARCHED, by_area, text_search
from waterspark.session import cut_lineage

GRAM = 3
GRAM_BUCKETS = 64
PART_ROWS = 100_000
POSTING = "gram string, part int, lake_uid string, bucket int"


def grams_of(text: Column) -> Column:
    """All runs of three letters, lower-cased; none for shorter texts and NULL."""
    low = F.lower(text.cast("string"))
    starts = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - (GRAM - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.substring(low, i, F.lit(GRAM))), F.array().cast("array<string>"))


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_store(water: DataFrame, path: str, part_rows: int = PART_ROWS, buckets: int = GRAM_BUCKETS) -> None:
    """Write the three tables; the rows are computed once.

    Postings are cut into ranges of (bucket, gram, part), so that a gram that every row
    holds is written by several tasks.
    """
    spark = water.sparkSession
    rows = cut_lineage(water.withColumn("area_key", G.stable_area(F.col("area_km2"))))
    parts = max(1, -(-rows.count() // part_rows))
    order = [F.col("area_key").desc(), F.col("lake_uid")]
    placed = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    placed.sortWithinPartitions("part", *order).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/columns")
    kept = _rows(spark, path)
    kept.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("area_key").alias("n_areas"),
        F.min("area_key").alias("low"), F.max("area_key").alias("high"),
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    texts = [grams_of(F.col(c)) for c in SEARCHED if c in kept.columns]
    postings = kept.select(F.explode(F.array_distinct(F.flatten(F.array(*texts)))).alias("gram"), "part", "lake_uid")
    postings = postings.withColumn("bucket", bucket_of(F.col("gram"), buckets))
    spread = ["bucket", "gram", "part", "lake_uid"]
    postings.repartitionByRange(*spread).sortWithinPartitions(*spread).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def find(spark: SparkSession, path: str, text: str, buckets: int = GRAM_BUCKETS) -> DataFrame:
    """Rows that ``text_search`` would find; ``buckets`` is that of the writer."""
    needle = text.strip().lower()
    if len(needle) < GRAM:
        return text_search(_rows(spark, path), needle)
    grams = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
    places = [bucket_of(F.lit(g), buckets) for g in grams]
    hits = spark.read.schema(POSTING).parquet(f"{path}/grams").where(F.col("bucket").isin(places) & F.col("gram").isin(grams))
    # Rows with one id count together, which can only ask for more rows than needed.
    full = hits.groupBy("part", "lake_uid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= len(grams))
    return text_search(_rows(spark, path).join(full, ["part", "lake_uid"], "left_semi"), needle)


def _from_parts(spark: SparkSession, path: str, needed: DataFrame) -> DataFrame:
    return _rows(spark, path).join(F.broadcast(needed), "part")


def _running(spark: SparkSession, path: str, size: Column) -> DataFrame:
    """The parts with the sum of ``size`` before each: one short row per part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{path}/parts").withColumn("before", F.coalesce(F.sum(size).over(before), F.lit(0)))


def page_at(spark: SparkSession, path: str, offset: int = 0, limit: int = PAGE_SIZE) -> DataFrame:
    """A page of the whole table from the parts that it lies in."""
    parts = _running(spark, path, F.col("n_rows"))
    needed = parts.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n_rows") > offset)).select("part", "before")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("area_key").desc(), "lake_uid")) + F.col("before")
    found = _from_parts(spark, path, needed).withColumn("_place", place)
    return found.where(F.col("_place").between(offset + 1, offset + limit)).orderBy("_place").drop("_place", "before")


def page_after(spark: SparkSession, path: str, area_km2: float, lake_uid: str, limit: int = PAGE_SIZE) -> DataFrame:
    """The page behind a known row: the part of that row and those after it, until their
    rows fill a page."""
    last = G.stable_area(F.lit(area_km2))
    behind = F.when(F.col("high") < last, F.col("n_areas")).otherwise(0)
    needed = _running(spark, path, behind).where((F.col("before") < limit) & (F.col("low") <= last)).select("part")
    later = (F.col("area_key") < last) | ((F.col("area_key") == last) & (F.col("lake_uid") > lake_uid))
    return by_area(_from_parts(spark, path, needed).where(later)).limit(limit)


def total(spark: SparkSession, path: str) -> DataFrame:
    """The number of rows, from the parts alone."""
    return spark.read.parquet(f"{path}/parts").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total"))
