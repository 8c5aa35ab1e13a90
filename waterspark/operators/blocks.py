"""Mosaics and resampling on packed blocks of pixels.

A block is one row: its keys, its top-left pixel ``r0, c0``, ``height, width``, a bitmap of
the pixels it has, and its bands as bytes. Blocks meet target blocks by an equi-join on the
target's block, so shuffles carry a few packed rows and no pixel is ever a key. A target
block is filled as its sources stream by: a task holds one target and one source at a time,
however many images lie over a place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from waterspark.operators.spatial_join import batch_column, list_offsets

BLOCK = 256
FRAME = ["r0", "c0", "height", "width", "present"]
FRAME_FIELDS = [
    *[T.StructField(c, T.LongType()) for c in ("r0", "c0")], *[T.StructField(c, T.IntegerType()) for c in ("height", "width")], T.StructField("present", T.BinaryType())
]


def band_fields(bands: list[str]) -> list[T.StructField]:
    return [T.StructField(b, T.BinaryType()) for b in bands]


def packed_bits(grid: np.ndarray) -> bytes:
    return np.packbits(grid.reshape(-1)).tobytes()


def bits(data: bytes, height: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=height * width).reshape(height, width).astype(bool)


def values(data: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<i4").reshape(height, width)


def emitted(fields: list[T.StructField], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), fields)], names=[f.name for f in fields])


def pack(pixels: DataFrame, by: list[str], bands: list[str], block: int = BLOCK) -> DataFrame:
    """Block table of pixel rows ``by, prow, pcol, bands`` (whole numbers, null as 0);
    blocks start at multiples of ``block`` and end with their last pixels."""
    entry = F.struct(F.col("prow").cast("long"), F.col("pcol").cast("long"), *[F.coalesce(F.col(b).cast("int"), F.lit(0)).alias(b) for b in bands])
    keyed = pixels.withColumns({"brow": F.floor(F.col("prow") / block), "bcol": F.floor(F.col("pcol") / block)})
    grouped = keyed.groupBy(*by, "brow", "bcol").agg(F.collect_list(entry).alias("_v"))
    heads = [*by, "brow", "bcol"]
    fields = [*[grouped.schema[c] for c in heads], *FRAME_FIELDS, *band_fields(bands)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch_column(batch, "_v")
            flat, off = column.flatten(), list_offsets(column)
            arrays = [flat.field(i).to_numpy() for i in range(2 + len(bands))]
            head, out = [batch_column(batch, c).to_pylist() for c in heads], []
            for i in range(batch.num_rows):
                row, col, *data = (a[off[i] : off[i + 1]] for a in arrays)
                r0, c0 = head[-2][i] * block, head[-1][i] * block
                shape = int(row.max()) - r0 + 1, int(col.max()) - c0 + 1
                grids = [np.zeros(shape, dtype=bool), *[np.zeros(shape, dtype="<i4") for _ in bands]]
                for grid, one in zip(grids, [True, *data]):
                    grid[row - r0, col - c0] = one
                out.append((*[h[i] for h in head], r0, c0, *shape, packed_bits(grids[0]), *[g.tobytes() for g in grids[1:]]))
            if out:
                yield emitted(fields, out)

    return grouped.mapInArrow(work, T.StructType(fields))


def unpack(blocks: DataFrame, by: list[str], bands: list[str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Pixel rows ``by, prow, pcol, bands`` of a block table; ``kinds`` names the numpy type
    of bands that are no 32-bit numbers."""
    kinds = {b: (kinds or {}).get(b, "<i4") for b in bands}
    spark_kind = {"<i4": T.IntegerType(), "<i8": T.LongType(), "<f8": T.DoubleType()}
    fields = [*[blocks.schema[c] for c in by], T.StructField("prow", T.LongType()), T.StructField("pcol", T.LongType())]
    fields += [T.StructField(b, spark_kind[kinds[b]]) for b in bands]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r0, c0, h, w, present = (batch.column(len(by) + n)[i].as_py() for n in range(5))
                row, col = np.nonzero(bits(present, h, w))
                data = [np.frombuffer(batch.column(len(by) + 5 + n)[i].as_py(), dtype=kinds[b]).reshape(h, w)[row, col] for n, b in enumerate(bands)]
                heads = [batch.column(n).take(pa.array(np.full(len(row), i))) for n in range(len(by))]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(row + r0), pa.array(col + c0), *map(pa.array, data)], names=[f.name for f in fields])

    return blocks.select(*by, *FRAME, *bands).mapInArrow(work, T.StructType(fields))


def streamed(rows: DataFrame, keys: list[str], order: list[Column | str], fields: list[T.StructField], start: Callable, add: Callable, end: Callable) -> DataFrame:
    """Each target block's rows in order through ``add(state, row)``: ``start(key, row)``
    makes the state, ``end(key, state)`` one output row."""
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(n)[i].as_py() for n, c in enumerate(names)}
                key = tuple(row[k] for k in keys)
                if key != now:
                    if now is not None:
                        yield emitted(fields, [end(now, state)])
                    now, state = key, start(key, row)
                add(state, row)
        if now is not None:
            yield emitted(fields, [end(now, state)])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, T.StructType(fields))


def over_target(blocks: DataFrame, down: Column, right: Column, block: int) -> DataFrame:
    """Blocks moved to the target's pixels, once for each target block (trow, tcol) they
    meet."""
    moved = blocks.withColumns({"r0": (F.col("r0") + down).cast("long"), "c0": (F.col("c0") + right).cast("long")})

    def span(at: str, size: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(at) / block), F.floor((F.col(at) + F.col(size) - 1) / block)))

    return moved.withColumn("trow", span("r0", "height")).withColumn("tcol", span("c0", "width"))


def mosaic(
    blocks: DataFrame, bands: list[str], source: str, order: list[Column | str], rule: str, down: Column, right: Column, bounds: tuple[int, int, int, int] | None = None, block: int = BLOCK
) -> DataFrame:
    """Target blocks ``trow, tcol, frame, bands, source`` of overlapping source blocks that
    move by ``down, right`` pixels; earlier ones in ``order`` win.

    ``rule``: ``first`` takes the first source that has the pixel; ``filled`` the first with
    any band that is not 0; ``band`` fills each band on its own, 0 where all are. ``bounds``
    are the first and last target row and column (r0, c0, r1, c1).
    """
    placed = over_target(blocks, down, right, block)
    if bounds is not None:
        a, b, c, d = bounds
        placed = placed.where(F.col("trow").between(a // block, c // block) & F.col("tcol").between(b // block, d // block))
    fields = [*[T.StructField(c, T.LongType()) for c in ("trow", "tcol")], *FRAME_FIELDS, *band_fields([*bands, "source"])]

    def start(key: tuple, row: dict) -> dict:
        shape = block, block
        allowed = np.ones(shape, dtype=bool)
        if bounds is not None:
            r, c = (np.arange(block) + k * block for k in key)
            allowed = ((r >= bounds[0]) & (r <= bounds[2]))[:, None] & ((c >= bounds[1]) & (c <= bounds[3]))
        state = {b: np.zeros(shape, dtype="<i4") for b in bands}
        return state | {"": allowed, "present": np.zeros(shape, dtype=bool), "source": np.zeros(shape, dtype="<i8")}

    def add(state: dict, row: dict) -> None:
        h, w = row["height"], row["width"]
        top, left = row["trow"] * block, row["tcol"] * block
        r, c = max(row["r0"], top), max(row["c0"], left)
        hi, wi = min(row["r0"] + h, top + block) - r, min(row["c0"] + w, left + block) - c
        own, there = np.s_[r - row["r0"] : r - row["r0"] + hi, c - row["c0"] : c - row["c0"] + wi], np.s_[r - top : r - top + hi, c - left : c - left + wi]
        have = bits(row["present"], h, w)[own] & state[""][there]
        data = {b: values(row[b], h, w)[own] for b in bands}
        present = state["present"][there]
        if rule == "band":
            present |= have
            for b in bands:
                take = have & (state[b][there] == 0) & (data[b] != 0)
                state[b][there][take] = data[b][take]
            return
        if rule == "filled":
            have &= np.logical_or.reduce([data[b] != 0 for b in bands])
        take = have & ~present
        present |= take
        for b in bands:
            state[b][there][take] = data[b][take]
        state["source"][there][take] = row[source]

    def end(key: tuple, state: dict) -> tuple:
        return (*key, key[0] * block, key[1] * block, block, block, packed_bits(state["present"]), *[state[b].tobytes() for b in [*bands, "source"]])

    return streamed(placed, ["trow", "tcol"], order, fields, start, add, end)


def warp(target: DataFrame, source: DataFrame, band: str, affine: Column, method: str = "nearest", key: str = "raster_id", block: int = BLOCK) -> DataFrame:
    """The pixels of ``target`` blocks resampled from the ``source`` blocks of the same key.

    ``affine`` is a struct (xc, xr, x0, yc, yr, y0) that takes a target pixel's centre to
    source pixels: x = xc * col + xr * row + x0. A target block meets the source blocks
    under its corners and sums what each adds: one pixel, or up to four with bilinear
    weights that count only pixels there are. ``source`` must be packed with ``block``.
    """
    corner = [(F.col("r0") + i * F.col("height"), F.col("c0") + j * F.col("width")) for i in (0, 1) for j in (0, 1)]
    asked = target.select(key, F.col("brow").alias("trow"), F.col("bcol").alias("tcol"), *FRAME, affine.alias("m"))
    x, y = ([F.col(f"m.{a}c") * c + F.col(f"m.{a}r") * r + F.col(f"m.{a}0") for r, c in corner] for a in "xy")

    def span(at: list[Column]) -> Column:
        return F.explode(F.sequence(F.floor((F.least(*at) - 1) / block), F.floor((F.greatest(*at) + 1) / block)))

    reached = asked.withColumn("brow", span(y)).withColumn("bcol", span(x))
    theirs = source.select(key, "brow", "bcol", *[F.col(c).alias(f"s_{c}") for c in FRAME], F.col(band).alias("s_band"))
    met = reached.join(theirs, [key, "brow", "bcol"]).drop("brow", "bcol")
    keys = [key, "trow", "tcol"]
    fields = [met.schema[key], *[T.StructField(c, T.LongType()) for c in ("trow", "tcol")], *FRAME_FIELDS, *band_fields([band])]

    def start(at: tuple, row: dict) -> dict:
        row_at, col_at = np.nonzero(bits(row["present"], row["height"], row["width"]))
        m, r, c = row["m"], row_at + row["r0"] + 0.5, col_at + row["c0"] + 0.5
        x, y = (m[f"{a}c"] * c + m[f"{a}r"] * r + m[f"{a}0"] for a in "xy")
        if method == "nearest":
            parts = [(np.floor(y), np.floor(x), np.ones(len(x)))]
        else:
            x, y = x - 0.5, y - 0.5
            fx, fy = x - np.floor(x), y - np.floor(y)
            parts = [(np.floor(y) + i, np.floor(x) + j, (fy if i else 1 - fy) * (fx if j else 1 - fx)) for i in (0, 1) for j in (0, 1)]
        parts = [(a.astype(np.int64), b.astype(np.int64), w) for a, b, w in parts]
        return {"frame": row, "at": (row_at, col_at), "parts": parts, "sum": np.zeros(len(x)), "weight": np.zeros(len(x))}

    def add(state: dict, row: dict) -> None:
        h, w = row["s_height"], row["s_width"]
        have, data = bits(row["s_present"], h, w), values(row["s_band"], h, w)
        for r, c, weight in state["parts"]:
            r, c = r - row["s_r0"], c - row["s_c0"]
            on = np.flatnonzero((r >= 0) & (r < h) & (c >= 0) & (c < w) & (weight > 0))
            on = on[have[r[on], c[on]]]
            state["sum"][on] += weight[on] * data[r[on], c[on]]
            state["weight"][on] += weight[on]

    def end(at: tuple, state: dict) -> tuple:
        frame, on = state["frame"], state["weight"] > 0
        shape = frame["height"], frame["width"]
        present, out = np.zeros(shape, dtype=bool), np.zeros(shape)
        where = tuple(a[on] for a in state["at"])
        present[where], out[where] = True, state["sum"][on] / state["weight"][on]
        return (*at, frame["r0"], frame["c0"], *shape, packed_bits(present), out.tobytes())

    return streamed(met, keys, [], fields, start, add, end)
