"""Raster operators over pixel tables ``(raster_id, prow, pcol, band columns)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waterspark.operators.grouped import map_groups

# --- fixed values -----------------------------------------------------------
WATER_CLASS = 80
OCCURRENCE_MAX = 100
PREGENERATED_THRESHOLDS = [50, 75, 90]
MAX_DECIMATED = 1024
STRETCH_LOW, STRETCH_HIGH = 0.02, 0.98
# ----------------------------------------------------------------------------


def class_mask(value: Column) -> Column:
    return (value == WATER_CLASS).cast("int")


def clamp_threshold(threshold: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), threshold.cast("int")))


def occurrence_mask(value: Column, threshold: Column) -> Column:
    return value.between(clamp_threshold(threshold), F.lit(OCCURRENCE_MAX)).cast("int")


def threshold_masks(pixels: DataFrame, value: str, thresholds: list[int]) -> DataFrame:
    """Water pixels for several thresholds at once: one row per pixel and threshold met."""
    levels = F.array(*[F.lit(int(t)) for t in thresholds])
    met = F.filter(levels, lambda t: occurrence_mask(F.col(value), t) == 1)
    return pixels.withColumn("threshold", F.explode(met))


def decimate(pixels: DataFrame, height: str = "height", width: str = "width", max_dim: int = MAX_DECIMATED) -> DataFrame:
    """Nearest-neighbour decimation to at most ``max_dim`` pixels on the longest side."""
    scale = F.greatest(F.col(height) / max_dim, F.col(width) / max_dim, F.lit(1.0))

    def kept(position: str, size: str) -> Column:
        out = F.greatest(F.lit(1), F.floor(F.col(size) / scale))
        step = F.col(size) / out
        i = F.floor(F.col(position) / step)
        return (i < out) & (F.floor((i + 0.5) * step) == F.col(position))

    return pixels.where(kept("prow", height) & kept("pcol", width))


def valid_ratio(pixels: DataFrame, by: list[str], bands: list[str]) -> DataFrame:
    """Share of pixels where any band is not zero."""
    hit = F.lit(False)
    for b in bands:
        hit = hit | (F.coalesce(F.col(b), F.lit(0)) != 0)
    return pixels.groupBy(*by).agg((F.count_if(hit) / F.count(F.lit(1))).alias("valid_ratio"))


def band_choice(source: Column, count: Column) -> Column:
    """Display bands: 3, 2, 1 for local images with three bands, else 1, 2, 3."""
    reverse = F.array(F.lit(3), F.lit(2), F.lit(1))
    return F.when((source == "local_img") & (count >= 3), reverse).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))


def stretch_limits(pixels: DataFrame, value: str, by: list[str]) -> DataFrame:
    """2nd and 98th percentile of the positive values of each band.

    Values are counted first, so the percentile holds distinct values, not pixels.
    """
    counts = pixels.where(F.col(value) > 0).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    p = F.percentile(F.col(value), F.array(F.lit(STRETCH_LOW), F.lit(STRETCH_HIGH)), F.col("_n"))
    out = counts.groupBy(*by).agg(p.alias("p"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("p")[1] <= F.col("p")[0]
    return out.select(
        *by,
        F.when(flat, F.col("_lo")).otherwise(F.col("p")[0]).cast("double").alias("low"),
        F.when(flat, F.col("_hi")).otherwise(F.col("p")[1]).cast("double").alias("high"),
    )


def stretch(pixels: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Display values 0-255; a constant band is only clipped."""
    v, lo, hi = F.col(value).cast("double"), F.col("low"), F.col("high")
    scaled = F.when(hi <= lo, v).otherwise((v - lo) * 255.0 / (hi - lo))
    shown = F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)).cast("int")
    limits = stretch_limits(pixels, value, by)
    return pixels.join(limits, by, "left").withColumn(
        "shown", F.when((v > 0) & lo.isNotNull(), shown).otherwise(F.lit(0))
    ).drop("low", "high")


def output_size(width: Column, height: Column, size: Column, most: int = 1400) -> Column:
    """Pixel size of a clip with the aspect of its bounds."""
    aspect = width / F.greatest(height, F.lit(1.0))

    def limit(v: Column) -> Column:
        return F.greatest(F.lit(240), F.least(F.lit(most), F.rint(v).cast("int")))

    tall = limit(size / F.greatest(aspect, F.lit(0.1)))
    return F.struct(
        F.when(tall > size, limit(size * aspect)).otherwise(size).alias("width"),
        F.least(tall, size).alias("height"),
    )


# ----------------------------------------------------------- binary morphology
def _disk(radius: float) -> list[tuple[int, int]]:
    n = int(np.floor(radius))
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= radius * radius]


def morphology(
    mask: DataFrame, by: list[str], radius: float, operation: str, supersample: int = 1, block: int = 256
) -> DataFrame:
    """Opening or closing of a water mask by a disk (radius in pixels).

    ``mask`` lists the water pixels. Every block also receives the pixels of its
    neighbours within reach, so blocks are processed alone and the result does not depend
    on the block size. ``supersample`` splits pixels for radii below one pixel; the
    result then is in split pixels.
    """
    fine = mask.select(*by, "prow", "pcol")
    if supersample > 1:
        parts = F.sequence(F.lit(0), F.lit(supersample - 1))
        fine = (
            fine.withColumn("_i", F.explode(parts))
            .withColumn("_j", F.explode(parts))
            .select(*by, (F.col("prow") * supersample + F.col("_i")).alias("prow"), (F.col("pcol") * supersample + F.col("_j")).alias("pcol"))
        )
    r = radius * supersample
    disk = _disk(r)
    halo = 2 * int(np.floor(r))

    def span(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block))

    spread = fine.withColumn("brow", F.explode(span("prow"))).withColumn("bcol", F.explode(span("pcol")))
    def shift(a: np.ndarray, i: int, j: int) -> np.ndarray:
        out = np.zeros_like(a)
        h, w = a.shape
        out[max(i, 0) : h + min(i, 0), max(j, 0) : w + min(j, 0)] = a[max(-i, 0) : h + min(-i, 0), max(-j, 0) : w + min(-j, 0)]
        return out

    def grow(a: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([shift(a, i, j) for i, j in disk])

    def shrink(a: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([shift(a, i, j) for i, j in disk])

    def work(head: dict, v: dict[str, np.ndarray]) -> list[np.ndarray]:
        r0, c0 = head["brow"] * block - halo, head["bcol"] * block - halo
        # The border beyond the halo is empty ground; it never reaches the inner block.
        pad = int(np.floor(r)) + 1
        size = block + 2 * halo
        grid = np.zeros((size + 2 * pad, size + 2 * pad), dtype=bool)
        grid[v["prow"] - r0 + pad, v["pcol"] - c0 + pad] = True
        out = grow(shrink(grid)) if operation == "open" else shrink(grow(grid))
        i, j = np.nonzero(out[pad + halo : pad + halo + block, pad + halo : pad + halo + block])
        return [i + r0 + halo, j + c0 + halo]

    fields = [T.StructField("prow", T.LongType()), T.StructField("pcol", T.LongType())]
    return map_groups(spread, [*by, "brow", "bcol"], ["prow", "pcol"], fields, work).drop("brow", "bcol")
