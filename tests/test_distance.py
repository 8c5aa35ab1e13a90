"""Distances of masks, opening and closing by metres, and the layer job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waterspark.operators import distance, regions


def brute_within(grid, dx, dy, radius):
    on = np.argwhere(grid)
    out = np.zeros_like(grid)
    for i, j in np.ndindex(grid.shape):
        out[i, j] = len(on) and (((on[:, 0] - i) * dy) ** 2 + ((on[:, 1] - j) * dx) ** 2).min() <= radius * radius * (1 + 1e-12)
    return out


@pytest.mark.parametrize("dx, dy, radius", [(1, 1, 1), (1, 1, 2.5), (3, 2, 6), (10, 10, 5), (2.6, 5.2, 5.3), (1, 1, 40)])
def test_distances_are_exact(dx, dy, radius):
    rng = np.random.default_rng(1)
    for share in (0, 0.02, 0.3, 1):
        grid = rng.random((17, 23)) < share
        assert np.array_equal(distance.within(grid, dx, dy, radius), brute_within(grid, dx, dy, radius))


def brute(cells, dx, dy, radius, operation, split):
    fine = {(i * split + a, j * split + b) for i, j in cells for a in range(split) for b in range(split)}
    n, m = int(radius * split / dy) + 1, int(radius * split / dx) + 1
    disk = [(i, j) for i in range(-n, n + 1) for j in range(-m, m + 1) if (i * dy / split) ** 2 + (j * dx / split) ** 2 <= radius * radius * (1 + 1e-12)]

    def grown(s):
        return {(i + a, j + b) for i, j in s for a, b in disk}

    def shrunk(s):
        return {(i, j) for i, j in s if all((i + a, j + b) in s for a, b in disk)}

    return grown(shrunk(fine)) if operation == "open" else shrunk(grown(fine))


def mask_of(spark, cells, dx, dy):
    rows = [(k, i, j, float(dx), float(dy)) for k, own in cells.items() for i, j in own]
    return spark.createDataFrame(rows, "k long, prow long, pcol long, dx_m double, dy_m double").repartition(3)


@pytest.mark.parametrize("block", [4, 256])
@pytest.mark.parametrize("operation", ["open", "close"])
@pytest.mark.parametrize("dx, dy, radius, split", [(1, 1, 2, 1), (2, 3, 4.5, 1), (10, 10, 8, 4), (30, 20, 5, 1)])
def test_opening_and_closing(spark, block, operation, dx, dy, radius, split):
    rng = np.random.default_rng(2)
    grid = rng.random((20, 20)) < 0.6
    grid[5:14, 6:15] = True
    cells = {1: {(int(i) - 7, int(j)) for i, j in np.argwhere(grid)}, 2: {(0, 0)}, 3: {(i, 9) for i in range(12)}}
    made = distance.open_or_close(mask_of(spark, cells, dx, dy), ["k"], radius, operation, split, block)
    got = {(r["k"], r["prow"], r["pcol"]) for r in made.collect()}
    assert got == {(k, i, j) for k, own in cells.items() for i, j in brute(own, dx, dy, radius, operation, split)}
    assert made.count() == len(got) and {(r[0], r[1]) for r in made.select("dx_m", "dy_m").distinct().collect()} <= {(dx / split, dy / split)}


def test_a_layer_is_never_opened_away(spark):
    square = {(i, j) for i in range(5) for j in range(5)}
    cells = {1: square | {(2, 5), (2, 6)}, 2: {(0, 0), (9, 9)}}
    made = distance.opened_and_closed(mask_of(spark, cells, 1, 1), ["k"], ["k"], 1, 1)
    got = {(r["k"], r["prow"], r["pcol"]) for r in made.collect()}
    opened = brute(cells[1], 1, 1, 1, "open", 1)
    assert got == {(1, *c) for c in brute(opened, 1, 1, 1, "close", 1)} | {(2, *c) for c in brute(cells[2], 1, 1, 1, "close", 1)}
    assert not any(c == (2, 6) for _, *c in [(k, (i, j)) for k, i, j in got])


def test_rounded_layers_by_finer_pixels(spark):
    """Two squares of ten-metre pixels with a gap that closing fills, traced in fine pixels;
    a large body keeps its pixels."""
    cells = [(i, j) for i in range(6) for j in range(13) if j != 6]
    rows = [(k, 50, 0, i, j, True) for k in (1, 2) for i, j in cells]
    masks = spark.createDataFrame(rows, "k long, threshold int, raster_id long, prow long, pcol long, touches boolean")
    bodies = spark.createDataFrame([(1, 1.0), (2, 900.0), (3, 1.0)], "k long, area_km2 double")
    how = regions.Rounding((F.lit(10.0), F.lit(10.0)), split=4)
    origin = F.struct(*[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("dx", 10.0), ("dy", -10.0))])
    made = regions.water_layers(bodies, masks, "k", [50], origin, smooth=False, metres=how).collect()
    parts = {r["k"]: (r["state"], len(r["geometry"] or [])) for r in made}
    assert parts == {1: ("ok", 1), 2: ("ok", 2), 3: ("empty", 0)}
    width = {r["k"]: max(p["x"] for poly in r["geometry"] for ring in poly for p in ring) for r in made if r["geometry"]}
    assert width == {1: 130.0, 2: 130.0}


def test_layer_job_goes_on_where_it_stopped(spark, tmp_path):
    bodies = spark.range(40).withColumnRenamed("id", "k")
    path, asked = str(tmp_path / "layers"), []

    def build(own):
        ids = sorted(r["k"] for r in own.collect())
        asked.append(ids)
        if len(asked) == 2:
            raise RuntimeError("lost")
        return own.select("k", F.explode(F.array(F.lit(50), F.lit(75))).alias("threshold")).withColumn("state", F.lit("ok"))

    with pytest.raises(RuntimeError):
        regions.pregenerate(bodies, build, path, "k", [50, 75], batches=3)
    first = spark.read.parquet(path).count()
    assert 0 < first < 80 and first == 2 * len(asked[0])
    written = regions.pregenerate(bodies, build, path, "k", [50, 75], batches=3)
    assert first + written == 80 and not set(asked[0]) & set(asked[2]) and spark.read.parquet(path).distinct().count() == 80
    files = sorted(str(p) for p in (tmp_path / "layers").rglob("*.parquet"))
    assert regions.pregenerate(bodies, build, path, "k", [50, 75]) == 0
    assert sorted(str(p) for p in (tmp_path / "layers").rglob("*.parquet")) == files
    more = spark.range(41).withColumnRenamed("id", "k")
    assert regions.pregenerate(more, build, path, "k", [50, 75]) == 2 and asked[-1] == [40]
