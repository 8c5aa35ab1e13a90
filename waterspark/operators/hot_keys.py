"""Left joins whose keys may be carried by very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task takes.
HOT_ROWS = 100_000
NULL_PARTS = 1_024


def join_spread(left: DataFrame, right: DataFrame, key: str, counted: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``left.join(right, key, "left")`` without a large task for a key that is on very many
    rows of ``left``, such as '' or 'none', or for NULL.

    Rows of a hot key are dealt to parts by their content, and the rows of ``right`` with
    that key are copied to each part; NULL meets nothing and is only dealt. ``counted`` is a
    table with the same keys as ``left`` that is cheaper to count.
    """
    size = F.count(F.lit(1))
    counts = (left if counted is None else counted).where(F.col(key).isNotNull()).groupBy(key).agg(size.alias("_n")).where(F.col("_n") > hot_rows)
    # At most one short row for every hot_rows rows of the input.
    hot = F.broadcast(counts.select(key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts")))
    parts = F.when(F.col(key).isNull(), NULL_PARTS).otherwise(F.coalesce("_parts", F.lit(1)))
    place = F.pmod(F.xxhash64(*left.columns), parts).cast("int")
    dealt = left.join(hot, key, "left").withColumn("_place", place).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copied = right.join(hot, key, "left").withColumn("_place", copies).drop("_parts")
    return dealt.join(copied, [key, "_place"], "left").drop("_place")
