"""Mosaics and warps on packed blocks against pixel dictionaries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waterspark.operators import blocks

MOVES = {1: (0, 0), 2: (-7, 11), 3: (5, -13)}


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(4)
    out = {}
    for k in MOVES:
        out[k] = {(int(i), int(j)): (int(rng.integers(0, 3)), int(rng.integers(0, 3))) for i, j in np.argwhere(rng.random((30, 41)) < 0.7)}
    return out


@pytest.fixture(scope="module")
def pixels(spark, images):
    rows = [(k, i, j, a, b) for k, own in images.items() for (i, j), (a, b) in own.items()]
    return spark.createDataFrame(rows, "raster_id long, prow long, pcol long, a int, b int").repartition(4)


def test_pack_and_back(pixels, images):
    packed = blocks.pack(pixels, ["raster_id"], ["a", "b"], 8)
    got = {(r["raster_id"], r["prow"], r["pcol"], r["a"], r["b"]) for r in blocks.unpack(packed, ["raster_id"], ["a", "b"]).collect()}
    assert got == {(k, i, j, a, b) for k, own in images.items() for (i, j), (a, b) in own.items()}
    empty = blocks.pack(pixels.where("raster_id < 0"), ["raster_id"], ["a"], 8)
    assert empty.count() == 0 and blocks.unpack(empty, ["raster_id"], ["a"]).count() == 0


def brute(images, rule, bounds):
    out = {}
    for k in sorted(images, reverse=True):
        for (i, j), (a, b) in images[k].items():
            at = i + MOVES[k][0], j + MOVES[k][1]
            if bounds and not (bounds[0] <= at[0] <= bounds[2] and bounds[1] <= at[1] <= bounds[3]):
                continue
            if rule == "band":
                x, y = out.get(at, (0, 0))
                out[at] = (x or a, y or b)
            elif at not in out and (rule == "first" or a or b):
                out[at] = (a, b, k)
    return out


@pytest.mark.parametrize("rule", ["first", "filled", "band"])
@pytest.mark.parametrize("size, target, bounds", [(8, 16, None), (64, 5, (-3, -4, 20, 33))])
def test_mosaics(pixels, images, rule, size, target, bounds):
    packed = blocks.pack(pixels, ["raster_id"], ["a", "b"], size)
    move = F.create_map(*[F.lit(x) for k, m in MOVES.items() for x in (k, m[0])]), F.create_map(*[F.lit(x) for k, m in MOVES.items() for x in (k, m[1])])
    down, right = (m[F.col("raster_id")] for m in move)
    made = blocks.mosaic(packed, ["a", "b"], "raster_id", [F.desc("raster_id")], rule, down, right, bounds, target)
    rows = blocks.unpack(made, [], ["a", "b", "source"], {"source": "<i8"}).collect()
    got = {(r["prow"], r["pcol"]): (r["a"], r["b"]) + (() if rule == "band" else (r["source"],)) for r in rows}
    assert len(rows) == len(got) and got == brute(images, rule, bounds)


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
@pytest.mark.parametrize("m", [(1.25, 0.0, 0.0, 0.0, 1.25, 0.0), (0.6, -0.7, 9.3, 0.7, 0.6, -4.1), (3.0, 0.0, -8.0, 0.0, -2.0, 25.0)])
def test_warps(spark, pixels, images, method, m):
    wanted = [(k, i, j) for k in MOVES for i in range(-4, 22, 1 + k) for j in range(-3, 30)]
    grid = blocks.pack(spark.createDataFrame(wanted, "raster_id long, prow long, pcol long"), ["raster_id"], [], 16)
    affine = F.struct(*[F.lit(float(v)).alias(c) for c, v in zip(("xc", "xr", "x0", "yc", "yr", "y0"), m)])
    made = blocks.warp(grid, blocks.pack(pixels, ["raster_id"], ["a"], 8), "a", affine, method, block=8)
    got = {(r["raster_id"], r["prow"], r["pcol"]): r["a"] for r in blocks.unpack(made, ["raster_id"], ["a"], {"a": "<f8"}).collect()}
    want = {}
    for k, i, j in wanted:
        x, y = m[0] * (j + 0.5) + m[1] * (i + 0.5) + m[2], m[3] * (j + 0.5) + m[4] * (i + 0.5) + m[5]
        if method == "nearest":
            parts = [(np.floor(y), np.floor(x), 1.0)]
        else:
            fx, fy = (x - 0.5) % 1, (y - 0.5) % 1
            parts = [(np.floor(y - 0.5) + a, np.floor(x - 0.5) + b, (fy if a else 1 - fy) * (fx if b else 1 - fx)) for a in (0, 1) for b in (0, 1)]
        have = [(w, images[k][(int(r), int(c))][0]) for r, c, w in parts if w > 0 and (int(r), int(c)) in images[k]]
        if have:
            want[(k, i, j)] = sum(w * v for w, v in have) / sum(w for w, _ in have)
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
