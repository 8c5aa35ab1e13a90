import random

import pytest
from pyspark.sql import functions as F

from waterspark.functions import geometry as G
from waterspark.operators import raster, regions

BY = ["raster_id"]


def mask(spark, cells, raster_id=0):
    return spark.createDataFrame([(raster_id, r, c) for r, c in cells], "raster_id int, prow int, pcol int")


def found(df):
    return {(r.raster_id, r.prow, r.pcol): r.region for r in df.collect()}


def brute(cells):
    left, out = set(cells), {}
    while left:
        start = min(left)
        todo, seen = [start], {start}
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left and n not in seen:
                    seen.add(n)
                    todo.append(n)
        left -= seen
        out.update({p: start[0] * regions.LABEL_STRIDE + start[1] for p in seen})
    return out


RING = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]


def test_diagonal_pixels_are_two_regions(spark):
    m = mask(spark, [(0, 0), (1, 1)])
    assert len(set(found(regions.mask_regions(m, BY, block=4)).values())) == 2
    shapes = regions.region_outlines(m, BY, block=4).collect()
    assert len(shapes) == 2 and all(len(s.geometry) == 1 for s in shapes)


def test_ring_has_one_hole(spark):
    shape = regions.region_outlines(mask(spark, RING), BY, block=8).select("geometry", G.planar_area(F.col("geometry")).alias("a")).first()
    assert len(shape.geometry) == 1 and len(shape.geometry[0]) == 2 and shape.a == 8


def test_rasters_stay_apart(spark):
    both = mask(spark, [(0, 0)], 0).unionAll(mask(spark, [(0, 1)], 1))
    assert len({(k[0], v) for k, v in found(regions.mask_regions(both, BY, block=4)).items()}) == 2
    seamless = regions.mask_regions(both.withColumn("all", F.lit(1)), ["all"], block=4)
    assert seamless.select("region").distinct().count() == 1


@pytest.mark.parametrize("block", [3, 5, 64])
def test_random_masks_match_brute_force(spark, block):
    rnd = random.Random(7)
    cells = [(r, c) for r in range(24) for c in range(24) if rnd.random() < 0.6]
    got = found(regions.mask_regions(mask(spark, cells), BY, block=block))
    assert {(k[1], k[2]): v for k, v in got.items()} == brute(cells)
    area = regions.region_outlines(mask(spark, cells), BY, block=block).agg(F.sum(G.planar_area(F.col("geometry")))).first()[0]
    assert area == len(cells)


def test_long_chain_over_many_blocks(spark):
    snake = [(r, c) for r in range(0, 21, 2) for c in range(21)] + [(r, 20 if r % 4 == 1 else 0) for r in range(1, 20, 2)]
    assert set(found(regions.mask_regions(mask(spark, snake), BY, block=2)).values()) == {0}


def test_large_regions_stay_one_polygon(spark):
    """Many blocks, two holes, teeth: the outline is whole whatever its length."""
    cells = [(r, c) for r in range(60) for c in range(60) if (r < 20 or c % 2 == 0) and (r, c) not in {(5, 5), (2, 9)}]
    for block in (3, 256):
        whole = regions.region_outlines(mask(spark, cells), BY, block=block).select("region", "geometry", G.planar_area(F.col("geometry")).alias("a")).collect()
        assert len(whole) == 1 and whole[0].a == len(cells) and len(whole[0].geometry) == 1
        assert len(whole[0].geometry[0]) == 3


def unit_sides(cells):
    """Outline sides of a mask, one by one: the water pixel on the left."""
    wet = set(cells)
    for r, c in cells:
        for beyond, a, b in (((r + 1, c), (c, -r - 1), (c + 1, -r - 1)), ((r, c + 1), (c + 1, -r - 1), (c + 1, -r)), ((r - 1, c), (c + 1, -r), (c, -r)), ((r, c - 1), (c, -r), (c, -r - 1))):
            if beyond not in wet:
                yield (a, b)


def drawn_sides(geometry):
    for ring in (ring for part in geometry for ring in part):
        for p, q in zip(ring, ring[1:]):
            n = int(abs(p.x - q.x) + abs(p.y - q.y))
            dx, dy = (q.x - p.x) / n, (q.y - p.y) / n
            yield from (((p.x + i * dx, p.y + i * dy), (p.x + i * dx + dx, p.y + i * dy + dy)) for i in range(n))


@pytest.mark.parametrize("seed", [1])
def test_outlines_are_all_sides_once_and_do_not_depend_on_blocks(spark, seed):
    rnd = random.Random(seed)
    cells = [(r - 9, c - 7) for r in range(26) for c in range(26) if rnd.random() < 0.62]
    want = sorted(unit_sides(cells))
    seen = []
    for block in (2, 5, 64):
        rows = regions.region_outlines(mask(spark, cells), BY, block=block).collect()
        assert all(len(row.geometry) == 1 for row in rows)
        assert sorted(side for row in rows for side in drawn_sides(row.geometry)) == want
        seen.append(sorted(sorted(tuple((p.x, p.y) for p in ring) for part in row.geometry for ring in part) for row in rows))
    assert seen[1:] == seen[:-1]


def test_one_ring_over_very_many_blocks(spark):
    """A spiral of one region: its outline is one ring of several hundred chains."""
    cells, r, c, dr, dc, seen = [], 0, 0, 0, 1, set()
    n = 41
    while True:
        cells.append((r, c))
        seen.add((r, c))
        for _ in range(2):
            a, b = r + dr, c + dc
            if 0 <= a < n and 0 <= b < n and (a, b) not in seen and (a + dr, b + dc) not in seen:
                break
            dr, dc = dc, -dr
        else:
            break
        r, c = r + dr, c + dc
    got = regions.region_outlines(mask(spark, cells), BY, block=3).collect()
    assert len(got) == 1 and len(got[0].geometry) == 1 and len(got[0].geometry[0]) == 1
    assert sorted(drawn_sides(got[0].geometry)) == sorted(unit_sides(cells))


def test_chains_of_unlike_keys_and_regions_stay_apart(spark):
    cells = [(r, c) for r in range(9) for c in range(9) if (r + c) % 3]
    both = mask(spark, cells, 0).unionAll(mask(spark, [(c, r) for r, c in RING], 1))
    rows = regions.region_outlines(both, BY, block=2).collect()
    for raster_id, own in ((0, cells), (1, RING)):
        assert sorted(s for row in rows if row.raster_id == raster_id for s in drawn_sides(row.geometry)) == sorted(unit_sides(own))


def test_empty_mask(spark):
    assert regions.region_outlines(mask(spark, [(0, 0)]).where("prow > 5"), BY).count() == 0
    assert regions.mask_regions(mask(spark, [(0, 0)]).where("prow > 5"), BY).count() == 0


@pytest.mark.parametrize("operation", ["open", "close"])
def test_morphology_does_not_depend_on_blocks(spark, operation):
    rnd = random.Random(3)
    cells = [(r, c) for r in range(20) for c in range(20) if rnd.random() < 0.7]
    small = found_cells(raster.morphology(mask(spark, cells), BY, 2.0, operation, block=4))
    assert small == found_cells(raster.morphology(mask(spark, cells), BY, 2.0, operation, block=64))
    assert (small <= set(cells)) if operation == "open" else (small >= set(cells))


def found_cells(df):
    return {(r.prow, r.pcol) for r in df.collect()}


def test_supersampling_splits_pixels(spark):
    fine = raster.morphology(mask(spark, [(0, 0), (0, 1), (1, 0), (1, 1)]), BY, 0.5, "open", supersample=4, block=16)
    assert 0 < fine.count() <= 64


def test_constant_band_is_only_clipped(spark):
    df = spark.createDataFrame([(0, 7), (0, 7), (0, 0)], "raster_id int, v int")
    assert sorted(r.shown for r in raster.stretch(df, "v", BY).collect()) == [0, 7, 7]


def test_layers_are_built_once_per_shape(spark):
    """Copies of a shape share one build, and every body gets its rows."""
    rows = [(i, [[[{"x": x, "y": y} for x, y in ((w, 0.0), (w + 1, 0.0), (w + 1, 1.0), (w, 1.0), (w, 0.0))]]]) for i in range(12) for w in [float(i % 3)]]
    bodies = spark.createDataFrame(rows, "k long, geometry array<array<array<struct<x:double,y:double>>>>")
    seen = []

    def build(own):
        seen.append(sorted(r.k for r in own.collect()))
        return own.select("k", F.explode(F.sequence(F.lit(1), F.col("k") + 1)).alias("n"))

    got = sorted(tuple(r) for r in regions.per_shape(bodies, "k", build).select("k", "n").collect())
    assert seen == [[0, 1, 2]]
    assert got == [(k, n) for k in range(12) for n in range(1, k % 3 + 2)]
