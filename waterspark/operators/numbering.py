"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterspark.session import cut_lineage


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position of every row in a total order.

    Rows are range-partitioned and sorted in place; a position is the row's place in its
    partition plus the sizes of the partitions before it. The sorted frame is
    checkpointed so that both passes see the same partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_seq", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_seq", 33)).withColumn(
        "_local", F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so this running sum is over a handful of rows.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_local") + 1)
        .drop("_part", "_local", "_seq", "_before")
    )
