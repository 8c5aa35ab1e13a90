"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterspark.llm.shared import SPACE, stored, text_of
from waterspark.operators.numbering import with_position

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST_COPIES = 3
#: A group of equally long documents of one source is ranked in so many parts.
PARTS = 1024
#: Budget that the dynamic program fits exactly after a proportional start.
FIT = 1 << 16


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to ``budget``.

    Every size first gives its share. What whole documents leave of the budget is filled
    with single further documents down to about ``FIT``, and then by a bounded-knapsack
    program over reachable sums: bit s of ``reach`` says that sum s can be made, and a size
    with n documents left is tried in 1, 2, 4, ... of them. If no sum meets the budget the
    nearest is taken.
    """
    take = np.zeros(len(sizes), dtype=np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total <= 0:
        return take
    if budget >= total:
        return counts.copy()
    take = np.where(sizes > 0, [int(c) * budget // total for c in counts], 0).astype(np.int64)
    rest = budget - int((take * sizes).sum())
    order = np.array(sorted(range(len(sizes)), key=lambda i: zlib.crc32(f"{seed}:{sizes[i]}".encode())), dtype=np.int64)
    for i in order:
        if rest <= FIT:
            break
        if 0 < sizes[i] <= rest - FIT // 2 and take[i] < counts[i]:
            take[i] += 1
            rest -= int(sizes[i])
    room = rest + FIT // 16
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for i in order:
        size, left, n = int(sizes[i]), int(counts[i] - take[i]), 1
        if size <= 0:
            continue
        while left > 0 and size * min(n, left) <= room and not reach >> rest & 1:
            n = min(n, left)
            wider = (reach | reach << size * n) & mask
            if wider != reach:
                steps.append((i, n, reach))
                reach = wider
            left -= n
            n *= 2
        if reach >> rest & 1:
            break
    goal = rest
    if not reach >> rest & 1:
        below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
        over = reach >> (rest + 1)
        above = rest + 1 + (over & -over).bit_length() - 1 if over else None
        goal = above if above is not None and above - rest < rest - below else below
    for i, n, before in reversed(steps):
        if not before >> goal & 1:
            take[i] += n
            goal -= int(sizes[i]) * n
    return take


def source_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds ``target``: the weight's share of all sizes, at most ``most`` times the source's
    size; the excess goes to the others by weight until no target is above.

    A source is full where level x weight exceeds its limit; the level rises until the set
    of full sources stays. Only sums come to the driver.
    """
    placed = with_position(sources, [F.col("source").isNull(), F.col("source")], "_place")
    turn = (F.col("_place") - 1) % len(weights)
    placed = stored(placed.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))), "sources")
    limit = F.col("source_size").cast("double") * most
    level, full_before = 0.0, -1
    while True:
        full = F.col("_weight") * level > limit
        row = placed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size"))).alias("held"),
            F.sum(F.when(~full, F.col("_weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("full"),
        ).first()
        if row["full"] == full_before or not row["open"]:
            break
        full_before = row["full"]
        level = (float(row["all"]) - most * float(row["held"] or 0)) / row["open"]
    return placed.withColumn("target", F.least(F.col("_weight") * level, limit)).drop("_place", "_weight")


def words(text_col: str) -> Column:
    """Number of words of a text, null 0."""
    return F.regexp_count(text_of(text_col), F.lit(f"[^{SPACE}]+")).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 17,
) -> DataFrame:
    """How often each document goes into the mix: (doc_id, size, source_size, target,
    copies, taken), one row per input row.

    Size is the number of words, null text 0. Every document of a source is taken
    floor(target / source_size) times; the rest of the target is fitted by
    ``fit_budget`` over the source's distinct sizes and their counts, and as many documents
    of each size as it says are chosen by a seeded hash of their ids. A source of no words,
    and an empty text, is never taken more than that floor. A null source is a source of
    its own, the last. Repeated rows count as documents. Reruns agree.

    One pass over the text makes slim rows. The counts that a source's fit reads are
    bounded by its distinct sizes. Equally long documents are ranked in ``PARTS`` parts
    with a running count over the parts, so a size with a third of all rows is dealt out.
    """
    slim = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"))
        .withColumn("_hash", F.xxhash64(F.lit(seed), F.col("doc_id")))
        .withColumn("_key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))))
        .withColumn("_part", F.pmod(F.col("_hash"), F.lit(PARTS))),
        "mix",
    )
    counts = stored(slim.groupBy("_key", "size", "_part").agg(F.count(F.lit(1)).alias("_n")), "mix-counts")
    sums = slim.groupBy("source", "_key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights, most).drop("source")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("_whole", whole).withColumn(
        "_budget", F.when(F.col("_whole") >= most, F.lit(0)).otherwise(F.round("target").cast("long") - F.col("_whole") * F.col("source_size"))
    )

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        group["_more"] = fit_budget(group["size"].to_numpy(), group["_n"].to_numpy(), int(group["_budget"].iloc[0]), seed)
        return group[["_key", "size", "source_size", "target", "_whole", "_more"]]

    fitted = (
        counts.groupBy("_key", "size").agg(F.sum("_n").alias("_n")).join(targets, "_key").groupBy("_key")
        .applyInPandas(fit, "_key string, size long, source_size long, target double, _whole long, _more long")
    )
    before = Window.partitionBy("_key", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(fitted, ["_key", "size"])
        .withColumn("_quota", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_more") - F.col("_before"))))
        .drop("_n", "_before", "_more")
    )
    rank = Window.partitionBy("_key", "size", "_part").orderBy("_hash", "doc_id")
    chosen = slim.join(parts, ["_key", "size", "_part"]).withColumn("_rank", F.row_number().over(rank))
    copies = F.col("_whole") + (F.col("_rank") <= F.col("_quota")).cast("long")
    return chosen.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source"
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix itself: every document as often as ``mix`` says, whole rows.

    Rows that agree in id, source and size share their copies evenly.
    """

    def key(name: str, source: str, size: Column) -> Column:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (name, source)]
        return F.concat_ws("\n", *parts, size.cast("string")).alias("_key")

    made = mix(docs, id_col, text_col, source_col, **options)
    made = made.groupBy(key("doc_id", "source", F.col("size"))).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy("_key").orderBy("_hash")
    keyed = docs.select(key(id_col, source_col, words(text_col)), F.xxhash64(text_of(text_col)).alias("_hash"), F.struct("*").alias("_row"))
    share = F.floor(F.col("_copies") / F.col("_rows")) + (F.row_number().over(own) <= F.col("_copies") % F.col("_rows")).cast("long")
    taken = keyed.join(made.filter("_copies > 0"), "_key").withColumn("_take", share).filter("_take > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_take")))).select("_row.*")
