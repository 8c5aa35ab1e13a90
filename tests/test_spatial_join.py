import pytest
from pyspark.sql import functions as F

from waterspark.functions import geometry as G
from waterspark.operators import catalog, context
from waterspark.operators import spatial_join as S

SCHEMA = "id int, geometry array<array<array<struct<x:double,y:double>>>>"


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in (*pts, pts[0])]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def frame(spark, rows, key):
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", key)


def metric(df):
    """Metre coordinates to lon/lat, so that shapes have known areas in the join."""
    return df.withColumn("geometry", G.to_lonlat(F.col("geometry"))).cache()


def pairs(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


@pytest.fixture(scope="module")
def shapes(spark):
    k = 1000.0
    a = [
        (1, [[box(0, 0, 4 * k, 4 * k), box(1 * k, 1 * k, 3 * k, 3 * k)]]),
        (2, [[ring((0, 0), (9 * k, 1 * k), (2 * k, 7 * k))]]),
        (3, [[box(0, 0, 1 * k, 1 * k)], [box(5 * k, 0, 6 * k, 1 * k)]]),
        (4, [[ring((0, 0), (2 * k, 2 * k), (2 * k, 0), (0, 2 * k))]]),
        (5, []),
    ]
    b = [
        (10, [[box(0, 0, 10 * k, 10 * k)]]),
        (11, [[box(1.5 * k, 1.5 * k, 2.5 * k, 2.5 * k)]]),
        (12, [[box(6 * k, 1 * k, 7 * k, 2 * k)]]),
    ]
    return metric(frame(spark, a, "a")), metric(frame(spark, b, "b"))


@pytest.mark.parametrize("cell", [700.0, 1500.0, 20_000.0])
def test_overlaps_do_not_depend_on_cells(shapes, cell):
    got = pairs(S.overlap_pairs(*shapes, "a", "b", cell_m=cell))
    assert got[(1, 10)] == pytest.approx(12e6, abs=1)
    assert (1, 11) not in got
    assert got[(2, 10)] == pytest.approx(30.5e6, abs=1)
    assert got[(3, 10)] == pytest.approx(2e6, abs=1)
    assert got[(4, 10)] == pytest.approx(2e6, abs=1)
    assert (3, 12) not in got


def test_touching_and_distance(shapes):
    a, b = shapes
    touch = pairs(S.touching_pairs(a, b, "a", "b").select("a", "b", "overlap_m2"))
    assert touch[(3, 12)] == 0
    assert (1, 12) not in touch and (1, 11) not in touch
    near = {(r.a, r.b): r.distance_m for r in S.near_pairs(a, b, "a", "b", 3000.0, cell_m=1500.0).collect()}
    assert near[(1, 12)] == pytest.approx(2000.0, abs=1e-3)
    assert near[(1, 11)] == pytest.approx(500.0, abs=1e-3)
    assert (1, 12) not in pairs(S.near_pairs(a, b, "a", "b", 1999.0, cell_m=1500.0).select("a", "b", "overlap_m2"))


def test_crowded_cells_give_the_same_pairs(spark, monkeypatch):
    rows = [(i, [[box(10 * (i % 7), 13 * (i % 11), 10 * (i % 7) + 30, 13 * (i % 11) + 20)]]) for i in range(120)]
    a, b = metric(frame(spark, rows, "a")), metric(frame(spark, rows, "b"))
    plain = pairs(S.overlap_pairs(a, b, "a", "b", cell_m=100.0, balance=False))
    far = pairs(S.near_pairs(a, b, "a", "b", 25.0, cell_m=100.0, balance=False).select("a", "b", "overlap_m2"))
    monkeypatch.setattr(S, "PAIR_BUDGET", 5)
    monkeypatch.setattr(S, "SALT_ROWS", 1)
    assert pairs(S.overlap_pairs(a, b, "a", "b", cell_m=100.0)) == plain
    assert pairs(S.near_pairs(a, b, "a", "b", 25.0, cell_m=100.0).select("a", "b", "overlap_m2")) == far


def test_one_sided_crowds_are_split(spark, monkeypatch):
    """Many rows against one are few pairs, but one task would hold them all."""
    rows = [(i, [[box(i % 40, i % 30, i % 40 + 8, i % 30 + 5)]]) for i in range(90)]
    a, b = metric(frame(spark, rows, "a")), metric(frame(spark, [(1, [[box(5, 5, 30, 20)]])], "b"))
    plain = pairs(S.overlap_pairs(a, b, "a", "b", cell_m=1000.0, balance=False))
    assert S.crowded_cells(a, b, "geometry", "geometry", 1000.0).isEmpty()
    monkeypatch.setattr(S, "SIDE_BUDGET", 50)
    monkeypatch.setattr(S, "SALT_ROWS", 1)
    [hot] = S.crowded_cells(a, b, "geometry", "geometry", 1000.0).collect()
    assert (hot.sa, hot.sb) == (6, 1)
    assert pairs(S.overlap_pairs(a, b, "a", "b", cell_m=1000.0)) == plain
    assert pairs(S.overlap_pairs(b, a, "b", "a", cell_m=1000.0).select("a", "b", "overlap_m2")) == plain


def test_tile_partition_sums_to_area(spark):
    k = 1000.0
    body = metric(frame(spark, [(1, [[ring((0.3 * k, 0.2 * k), (2.9 * k, 0.7 * k), (1.1 * k, 2.95 * k))]])], "a"))
    grid = metric(frame(spark, [(10 * i + j, [[box(i * k, j * k, (i + 1) * k, (j + 1) * k)]]) for i in range(3) for j in range(3)], "b"))
    total = sum(pairs(S.overlap_pairs(body, grid, "a", "b", cell_m=5000.0)).values())
    assert total == pytest.approx(3.375e6, abs=1)


def test_best_reference_prefers_overlap_then_id(spark):
    k = 1000.0
    water = metric(frame(spark, [(1, [[box(0, 0, 2 * k, 2 * k)]]), (2, [[box(8 * k, 8 * k, 9 * k, 9 * k)]])], "lake_uid"))
    same = [[box(1 * k, 0, 3 * k, 2 * k)]]
    refs = metric(frame(spark, [(7, same), (5, same), (9, [[box(1.5 * k, 0, 3 * k, 2 * k)]]), (4, [[box(9 * k, 8 * k, 10 * k, 9 * k)]])], "hylak_id"))
    best = {r.lake_uid: (r.hylak_id, r.overlap_m2) for r in catalog.best_reference(water, refs).collect()}
    assert best[1][0] == 5 and best[1][1] == pytest.approx(2e6, abs=1)
    assert best[2] == (4, 0.0)
    strict = {r.lake_uid: r.hylak_id for r in catalog.best_reference(water, refs, touching=False).collect()}
    assert strict == {1: 5}


def test_clip_to_box(spark):
    u = frame(spark, [(1, [[ring((0, 0), (5, 0), (5, 3), (4, 3), (4, 1), (1, 1), (1, 3), (0, 3))]])], "a")
    cut = context.clip_to_box(F.col("geometry"), F.lit(0.0), F.lit(2.0), F.lit(5.0), F.lit(2.5))
    row = u.select(cut.alias("g")).select(F.size("g").alias("n"), G.planar_area(F.col("g")).alias("area")).first()
    assert row.n == 2 and row.area == pytest.approx(1.0)


def test_projection_area_and_utm(spark):
    df = frame(spark, [(1, [[box(112, 28, 112.1, 28.1)]])], "a")
    got = df.select(
        G.area_km2(F.col("geometry")).alias("area"),
        G.lonlat_to_utm(F.lit(112.345), F.lit(28.765), F.lit(49)).alias("u"),
    ).select("area", "u", G.utm_to_lonlat(F.col("u.easting"), F.col("u.northing"), F.lit(49)).alias("back")).first()
    assert 138 < got.area < 142
    assert got.back.lon == pytest.approx(112.345, abs=1e-9) and got.back.lat == pytest.approx(28.765, abs=1e-9)
    assert 600_000 < got.u.easting < 650_000


def test_utm_steps_are_worked_out_once(spark):
    """The column grows with the series, not with its product."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    box = G.utm_box_footprint(*[F.col("id") + v for v in (300_000, 2_700_000, 310_980, 2_710_980)], F.lit(49), corners_only=True)
    row = spark.range(1).select(box.alias("f")).first().f
    corners = spark.range(1).select(*[G.utm_to_lonlat(F.lit(e), F.lit(n), F.lit(49)).alias(f"p{e}_{n}") for e in (300_000, 310_980) for n in (2_700_000, 2_710_980)]).first()
    lons, lats = [p.lon for p in corners], [p.lat for p in corners]
    assert (row.west, row.south, row.east, row.north) == pytest.approx((min(lons), min(lats), max(lons), max(lats)), abs=1e-12)
    plan = spark.range(1).select(G.utm_to_lonlat(F.col("id"), F.col("id"), F.lit(49)).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("sinh(") + plan.lower().count("cosh(") <= 12


def test_context_keeps_its_limit_with_copies_and_repeated_ids(spark):
    k = 1000.0
    own = [[box(0, 0, 2 * k, 2 * k)]]
    big, mid = [[box(2.2 * k, 0, 4.2 * k, 3 * k)]], [[box(0, 2.2 * k, 2 * k, 4.2 * k)]]
    rows = [(1, own), (2, own), *[(10 + i, big) for i in range(6)], *[(20 + i, mid) for i in range(6)]]
    df = metric(frame(spark, rows, "k")).withColumns(
        {
            "area_km2": G.area_km2(F.col("geometry")),
            **G.bbox_columns(F.col("geometry")),
            "other_tags": F.lit(""),
            # Four of the large copies carry the body's own id.
            "osm_id": F.when(F.col("k").between(10, 13), "1").otherwise(F.col("k").cast("string")),
            "osm_way_id": F.lit(None).cast("string"),
        }
    ).cache()
    body = df.where("k = 1").withColumns({"osm_id_text": F.lit("1"), "osm_way_id_text": F.lit(None).cast("string")})
    near = context.context_water(body, df.withColumn("other_id", F.col("k")), key="k", limit=5)
    assert [r.other_id for r in near.orderBy("rank").collect()] == [14, 15, 20, 21, 22]


def test_cells_that_rows_only_reach_are_split(spark, monkeypatch):
    """Two crowds in different cells that meet through their reach alone."""
    k = 1000.0
    left = [(i, [[box(k + i, k, k + i + 10, k + 10)]]) for i in range(30)]
    right = [(i, [[box(25 * k + i, k, 25 * k + i + 10, k + 10)]]) for i in range(30)]
    a, b = metric(frame(spark, left, "a")), metric(frame(spark, right, "b"))
    whole = {(r.a, r.b) for r in S.near_pairs(a, b, "a", "b", 24_000.0, balance=False).collect()}
    assert 0 < len(whole) < 900
    monkeypatch.setattr(S, "PAIR_BUDGET", 5)
    assert S.crowded_cells(a, b, "geometry", "geometry", S.CELL_M).count() == 0
    assert S.crowded_cells(a, b, "geometry", "geometry", S.CELL_M, F.lit(24_000.0)).count() > 0
    assert {(r.a, r.b) for r in S.near_pairs(a, b, "a", "b", 24_000.0).collect()} == whole


@pytest.mark.parametrize("case", ["placeholder", "stacked"])
def test_context_stays_exact_under_hot_ids_and_stacked_copies(spark, case):
    k = 1000.0
    own = [[box(0, 0, 2 * k, 2 * k)]]
    if case == "placeholder":  # one id on most rows, the body's own among them
        others = [(10 + i, [[box(2.2 * k + i, 0, 4.2 * k + i, 3 * k)]]) for i in range(60)]
        osm_id = F.when((F.col("k") == 1) | (F.col("k") % 10 != 0), "0").otherwise(F.col("k").cast("string"))
        want = [20, 10, 30]
    else:
        others = [(10 + i, [[box(2.2 * k, 0, 4.2 * k, 3 * k)]]) for i in range(1000)]
        osm_id = F.when(F.col("k") < 500, "0").otherwise(F.col("k").cast("string"))
        want = [500, 501, 502]
    df = metric(frame(spark, [(1, own), *others], "k")).withColumns(
        {"area_km2": G.area_km2(F.col("geometry")), **G.bbox_columns(F.col("geometry")), "other_tags": F.lit(""), "osm_id": osm_id, "osm_way_id": F.lit(None).cast("string")}
    ).cache()
    body = df.where("k = 1").withColumns({"osm_id_text": F.lit("0"), "osm_way_id_text": F.lit(None).cast("string")})
    near = context.context_water(body, df.withColumn("other_id", F.col("k")), key="k", limit=3)
    got = [r.other_id for r in near.orderBy("rank").collect()]
    assert got == want if case == "stacked" else len(got) == 3 and all(i % 10 == 0 for i in got)


def test_context_looks_no_further_than_the_largest_it_needs(spark, monkeypatch):
    """Tiers give the rows of one pass, and a crowd is not paired as a whole."""
    k = 1000.0
    bodies = [(i, [[box(30 * k * i, 0, 30 * k * i + 2 * k, 2 * k)]]) for i in range(3)]
    crowd = [(100 + i, [[box(30 * k * (i % 2) + 3 * k, 0, 30 * k * (i % 2) + 3 * k + (i // 4 + 1) * 10, 2 * k)]]) for i in range(400)]
    lone = [(900, [[box(62.2 * k, 0, 62.4 * k, 10)]])]

    def table(rows):
        sized = metric(frame(spark, rows, "other_id"))
        return sized.withColumns({"area_km2": G.area_km2(F.col("geometry")), **G.bbox_columns(F.col("geometry"))})

    body = table(bodies).withColumnRenamed("other_id", "k").withColumn("hylak_id", 498 + F.col("k"))
    others, found, pairs, near_shapes = table(crowd + lone).cache(), [], [], S.near_shapes

    def counted(*args, **kw):
        made = near_shapes(*args, **kw)
        pairs.append(made.count())
        return made

    monkeypatch.setattr(S, "near_shapes", counted)
    for first in (16, 10_000):
        monkeypatch.setattr(context, "FIRST_TIER", first)
        pairs.clear()
        got = context.context_reference(body, others, key="k", limit=3, min_area_km2=0.0, clip=True)
        found.append([(r.k, r.rank, r.other_id, round(r.a, 6)) for r in got.withColumn("a", G.area_km2(F.col("geometry"))).orderBy("k", "rank").collect()])
        assert (first, sum(pairs) < 100) in ((16, True), (10_000, False)), pairs
    assert found[0] == found[1]
    assert [f[2] for f in found[0]] == [496, 492, 494, 497, 493, 495, 900]


def test_small_files_of_many_rows_are_not_broadcast(spark):
    """A join is planned by the size of the rows, not of the compressed file."""
    from waterspark.plans.fixtures import table

    part = table(spark, "/root/testdata/sf0.01", "part")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        plan = part.join(part.select("p_partkey", "p_name"), "p_partkey")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan


def test_box_filter_and_columns_reach_the_scan(spark, tmp_path):
    from waterspark.sources.readers import read_features

    df = frame(spark, [(1, [[box(0, 0, 1, 1)]]), (2, [[box(5, 5, 6, 6)]])], "lake_uid").withColumns(G.bbox_columns(F.col("geometry")))
    df.withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "w"))
    found = read_features(spark, str(tmp_path / "w"), ["lake_uid"], (4.0, 4.0, 7.0, 7.0))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(bbox_east,4.0)" in plan and "extra" not in plan
    assert [r.lake_uid for r in found.collect()] == [2]


def test_equal_overlaps_of_boxes_are_equal_to_the_last_place(spark):
    """A body inside two references ties, in whatever cells they are cut."""
    rng = [(i, 108.5 + 0.15 * (i % 40) + 0.01 * (i % 7), 24.5 + 0.14 * (i * 7 % 41), 0.05 + 0.01 * (i % 9), 0.04 + 0.01 * (i % 11)) for i in range(400)]
    bodies = frame(spark, [(i, [[box(w, s, w + dx, s + dy)]]) for i, w, s, dx, dy in rng], "a")
    grown = [(2 * i + j, [[box(w - m, s - m, w + dx + m, s + dy + m)]]) for i, w, s, dx, dy in rng for j, m in ((0, 0.0), (1, 0.07))]
    found = S.measured_pairs(
        S.candidate_pairs(
            S.fragments(bodies, "a", cell_m=700.0, whole=True).withColumnRenamed("a", "id_a"),
            S.fragments(frame(spark, grown, "b"), "b", cell_m=700.0, whole=True).withColumnRenamed("b", "id_b"), 700.0,
        ), distance=False,
    ).where("id_a = id_b div 2")
    assert found.count() == 800
    assert found.groupBy("id_a").agg(F.count_distinct("overlap").alias("n")).where("n > 1").count() == 0


def test_copies_of_a_shape_are_compared_once(spark):
    k = 1000.0
    a = metric(frame(spark, [(i, [[box(0, 0, 2 * k, 2 * k)]]) for i in range(1500)] + [(1500, [[ring((0, 0), (k, 0), (0, k))]])], "a"))
    b = metric(frame(spark, [(i, [[box(k, k, 3 * k, 3 * k)]]) for i in range(3)], "b"))
    shapes, members = S.shape_groups(a, "a", "geometry", "id_a")
    assert shapes.count() == 2 and members.count() == 3
    got = S.overlap_pairs(a, b, "a", "b")
    assert got.count() == got.distinct().count() == 4500
    near = S.near_pairs(a, b, "a", "b", k)
    assert near.where("a = 1500 AND abs(distance_m - 707.107) < 0.01 AND overlap_m2 = 0").count() == 3
    assert near.count() == 4503


def test_pairs_of_boxes_need_no_kernel_and_no_second_shuffle(spark):
    boxes = spark.range(60).select(F.col("id"), G.box_polygon(*[F.col("id") * 0.05 + F.lit(v) for v in (110.0, 25.0, 110.2, 25.2)]).alias("geometry"))
    shapes, _ = S.shape_groups(boxes, "id", "geometry", "id_a")
    other = shapes.withColumnRenamed("id_a", "id_b")
    for made in (S.overlap_shapes(shapes, other), S.near_shapes(shapes, other, 500.0)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan and "Aggregate" not in plan
        assert made.count() == made.select("id_a", "id_b").distinct().count()
    # With one real outline its pairs go through the kernel, and none is met twice.
    w, s, e, n = (F.lit(v) for v in (110.0, 25.0, 112.0, 27.0))
    corner = spark.range(60, 61).select("id", F.array(F.array(F.array(G.point(w, s), G.point(e, s), G.point(w, n), G.point(w, s)))).alias("geometry"))
    mixed, _ = S.shape_groups(boxes.unionByName(corner), "id", "geometry", "id_a")
    pairs = S.overlap_shapes(mixed, other)
    assert pairs.count() == pairs.select("id_a", "id_b").distinct().count() > S.overlap_shapes(shapes, other).count()
