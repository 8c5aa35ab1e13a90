"""Opening and closing of masks by metres, from exact distances between pixel centres.

Distances come in two passes over a block and its halo: the nearest water of each column,
then the nearest column, so the work grows with the radius and not with its square. Pixels
need not be square; only the strips of a block that a neighbour can feel are copied to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waterspark.operators.grouped import map_groups
from waterspark.session import cut_lineage

FAR = 1 << 40


def squared_distance(feature: np.ndarray, dx: float, dy: float, reach: float) -> np.ndarray:
    """Squared distance of each cell to the nearest cell of the feature, exact up to
    ``reach``; whatever is farther has a larger number."""
    row = np.arange(feature.shape[0])[:, None]
    above = np.maximum.accumulate(np.where(feature, row, -FAR), axis=0)
    below = np.minimum.accumulate(np.where(feature, row, FAR)[::-1], axis=0)[::-1]
    column = (np.minimum(row - above, below - row) * dy) ** 2.0
    out = column.copy()
    for k in range(1, min(int(reach / dx + 1e-9), feature.shape[1] - 1) + 1):
        step = (k * dx) ** 2
        np.minimum(out[:, k:], column[:, :-k] + step, out=out[:, k:])
        np.minimum(out[:, :-k], column[:, k:] + step, out=out[:, :-k])
    return out


def within(feature: np.ndarray, dx: float, dy: float, radius: float) -> np.ndarray:
    return squared_distance(feature, dx, dy, radius) <= radius * radius * (1 + 1e-12)


def split_pixels(mask: DataFrame, split: int) -> DataFrame:
    """Each pixel as ``split`` x ``split`` finer ones; ``dx_m, dy_m`` shrink with them."""
    if split == 1:
        return mask
    parts = F.explode(F.sequence(F.lit(0), F.lit(split - 1)))
    fine = mask.withColumn("_i", parts).withColumn("_j", parts)
    moved = {"prow": F.col("prow") * split + F.col("_i"), "pcol": F.col("pcol") * split + F.col("_j")}
    return fine.withColumns(moved | {c: F.col(c) / split for c in ("dx_m", "dy_m")}).drop("_i", "_j")


def open_or_close(mask: DataFrame, by: list[str], radius: float, operation: str, split: int = 1, block: int = 256) -> DataFrame:
    """Opening or closing by a disk of ``radius`` metres of water pixels
    ``by, prow, pcol, dx_m, dy_m`` (the pixel's size in metres, one for each raster).

    A radius below the pixel size changes nothing unless ``split`` divides the pixels, which
    happens inside the tasks; the result then is in finer pixels.
    """

    def span(c: str, size: str) -> Column:
        halo = F.ceil(2 * radius / F.col(size))
        return F.explode(F.sequence(F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block)))

    spread = mask.select(*by, "prow", "pcol", "dx_m", "dy_m").withColumn("brow", span("prow", "dy_m")).withColumn("bcol", span("pcol", "dx_m"))

    def work(head: dict, v: dict[str, np.ndarray]) -> list[np.ndarray]:
        dx, dy = head["dx_m"], head["dy_m"]
        # The grid ends where nothing beyond can be felt: empty ground around the water.
        hr, hc = int(np.ceil(radius / dy)) + 1, int(np.ceil(radius / dx)) + 1
        r0, c0 = int(v["prow"].min()) - hr, int(v["pcol"].min()) - hc
        grid = np.zeros((int(v["prow"].max()) + hr + 1 - r0, int(v["pcol"].max()) + hc + 1 - c0), dtype=bool)
        grid[v["prow"] - r0, v["pcol"] - c0] = True
        if split > 1:
            grid = grid.repeat(split, axis=0).repeat(split, axis=1)
        size = dx / split, dy / split, radius
        out = within(~within(~grid, *size), *size) if operation == "open" else ~within(~within(grid, *size), *size)
        i, j = np.nonzero(out)
        i, j = i + r0 * split, j + c0 * split
        own = (i // (block * split) == head["brow"]) & (j // (block * split) == head["bcol"])
        return [i[own], j[own]]

    fields = [T.StructField("prow", T.LongType()), T.StructField("pcol", T.LongType())]
    made = map_groups(spread, [*by, "dx_m", "dy_m", "brow", "bcol"], ["prow", "pcol"], fields, work).drop("brow", "bcol")
    return made if split == 1 else made.withColumns({c: F.col(c) / split for c in ("dx_m", "dy_m")})


def opened_and_closed(
    mask: DataFrame, by: list[str], layer: list[str], open_m: float, close_m: float, split: int = 1, block: int = 256
) -> DataFrame:
    """Opening, then closing. A layer (of the keys ``layer``) that opening would remove as a
    whole is closed as it is."""
    opened = cut_lineage(open_or_close(mask, by, open_m, "open", split, block))
    left = opened.select(*layer).distinct()
    whole = split_pixels(mask.select(*by, "prow", "pcol", "dx_m", "dy_m").join(left, layer, "left_anti"), split)
    return open_or_close(opened.unionByName(whole), by, close_m, "close", block=block)
