"""Exact duplicates by a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterspark.llm.shared import SPACE_CHARS, stored, text_of

#: Counters of the Misra-Gries sketch: a digest of more than about rows / TRACKED rows is found.
TRACKED = 1024
#: The winners of at most so many digests are broadcast (a few hundred bytes each).
HEAVY = 256
#: Sketches are merged in so many groups before the last merge.
SKETCH_GROUPS = 32


def normalised(text_col: str) -> Column:
    """The text without white space."""
    kept = text_of(text_col)
    for char in SPACE_CHARS:
        kept = F.replace(kept, F.lit(char), F.lit(""))
    return kept


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One slim row per document: digest of the normalised text, a second hash to verify
    it by, and what decides who stays."""
    return docs.select(
        F.col(id_col).alias("doc_id"), normalised(text_col).alias("_norm"), F.length(text_of(text_col)).cast("long").alias("_length")
    ).select(
        "doc_id",
        "_length",
        F.sha2("_norm", 256).alias("text_sha256"),
        F.xxhash64("_norm").alias("_check"),
        F.monotonically_increasing_id().alias("_row"),
    )


def frequent_digests(slim: DataFrame) -> DataFrame:
    """At most ``HEAVY`` candidates from Misra-Gries sketches.

    ``approx_top_k`` keeps ``TRACKED`` counters and lowers them all when they run out. It
    runs per task before anything is shuffled, then in ``SKETCH_GROUPS`` groups.
    """
    part = slim.groupBy((F.spark_partition_id() % SKETCH_GROUPS).alias("_g")).agg(
        F.expr(f"approx_top_k_accumulate(text_sha256, {TRACKED})").alias("_s")
    )
    # One group by key, as a sketch of an empty partition cannot be merged.
    top = part.groupBy(F.lit(0).alias("_g")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_s, {TRACKED}), {HEAVY})").alias("_top"))
    return top.select(F.explode("_top").alias("_t")).select(F.col("_t.item").alias("text_sha256")).filter("text_sha256 is not null")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row the row of its group that stays.

    Texts are equal when identical without white space; a null text counts as empty, and
    empty texts are one group. The row with the longest original text stays, then the one
    with the smallest id (null ids last); of rows that tie even there, one. Returns
    (doc_id, keep_id, group_size, kept, text_sha256), one row per input row; other input
    columns do not matter. An empty table gives an empty result.

    The text is read once, into a stored table of digests. Frequent digests are resolved
    by partial aggregates and their winners broadcast (``HEAVY`` rows at most), so a group
    with a third of all rows is never shuffled; the others meet in one shuffle by digest,
    in groups of about rows / ``TRACKED`` at most.
    """
    slim = stored(digests(docs, id_col, text_col), "digests")
    key = ["text_sha256", "_check"]
    found = F.broadcast(stored(frequent_digests(slim), "frequent"))
    # Exact winners and counts; two texts behind one digest would differ in the second hash.
    best = F.min(F.struct((-F.col("_length")).alias("l"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_row").alias("row")))
    winners = stored(
        slim.join(found, "text_sha256", "left_semi").groupBy(*key).agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size")), "winners"
    )
    heavy = slim.join(F.broadcast(winners), key).select(
        "doc_id", F.col("_best.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.row")).alias("kept"), "text_sha256"
    )
    group = Window.partitionBy(*key)
    order = group.orderBy(F.desc("_length"), F.col("doc_id").asc_nulls_last(), "_row")
    light = (
        slim.join(F.broadcast(winners.select(*key)), key, "left_anti")
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .withColumn("keep_id", F.first("doc_id").over(order))
        .withColumn("kept", F.row_number().over(order) == 1)
    )
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return heavy.select(*columns).unionByName(light.select(*columns))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, whole rows; of repeated rows one."""
    kept = (
        exact_duplicates(docs, id_col, text_col)
        .filter("kept")
        .select(F.concat_ws(":", "text_sha256", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("_key"))
    )
    # The key names the row, so the join and the choice among repeated rows share one
    # shuffle. The row travels as one struct, whatever its columns are called.
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    keyed = docs.select(
        F.concat_ws(":", F.sha2(normalised(text_col), 256), name).alias("_key"), F.length(text_of(text_col)).alias("_length"), F.struct("*").alias("_row")
    )
    once = Window.partitionBy("_key").orderBy(F.desc("_length"))
    return keyed.join(kept, "_key", "left_semi").withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_row.*")
