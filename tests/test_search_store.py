import random

import pytest

from waterspark.operators import search, search_store

SCHEMA = "lake_uid string, name string, osm_way_id_text string, area_km2 double"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["East Lake", "west LAKE", "洞庭湖", "Lak", None, "", "lakes of the long name", "aaaa"]
    rows = [(f"hunan_osm_{i}", rng.choice(words), rng.choice([None, str(i * 37)]), rng.choice([None, i % 50 + 0.5, 7.0])) for i in range(600)]
    rows += [("hunan_osm_5", "twice", "aaa", 7.0)] * 2
    water = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("store"))
    search_store.write_store(water, path, part_rows=100, buckets=8)
    return water, path


def rows_of(df):
    return [tuple(r) for r in df.select("lake_uid", "name", "osm_way_id_text", "area_km2").collect()]


@pytest.mark.parametrize("text", ["lake", "LAKE ", "洞庭湖", "osm_12", "aaaa", "aaa", "lak", "la", "1", "", "no such", "37", "_osm_599"])
def test_search_is_that_of_the_whole_table(spark, store, text):
    water, path = store
    found = search_store.find(spark, path, text, buckets=8)
    assert sorted(rows_of(found), key=repr) == sorted(rows_of(search.text_search(water, text)), key=repr)
    page = search.page(found, 3, 10)
    assert rows_of(page) == rows_of(search.page(search.text_search(water, text), 3, 10))


def test_pages_and_total(spark, store):
    water, path = store
    for offset, limit in ((0, 10), (95, 20), (250, 130), (590, 50), (700, 5)):
        assert rows_of(search_store.page_at(spark, path, offset, limit)) == rows_of(search.page(water, offset, limit))
    for area, uid, limit in ((7.0, "hunan_osm_3", 40), (50.5, "", 5), (0.5, "z", 9), (7.0, "hunan_osm_5", 500), (99.0, "", 1)):
        assert rows_of(search_store.page_after(spark, path, area, uid, limit)) == rows_of(search.page_after(water, area, uid, limit))
    assert search_store.total(spark, path).collect()[0].total == 602


def test_plans_read_matching_files_only(spark, store):
    _, path = store
    found = search_store.find(spark, path, "osm_12", buckets=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "PartitionFilters: [bucket" in plan
    page = search_store.page_at(spark, path, 0, 10)
    assert "dynamicpruning" in page._jdf.queryExecution().executedPlan().toString().lower()


def test_empty_table(spark, tmp_path):
    search_store.write_store(spark.createDataFrame([], SCHEMA), str(tmp_path), part_rows=10)
    path = str(tmp_path)
    assert rows_of(search_store.find(spark, path, "lake")) == rows_of(search_store.find(spark, path, "l")) == []
    assert rows_of(search_store.page_at(spark, path, 0, 5)) == rows_of(search_store.page_after(spark, path, 1.0, "a", 5)) == []
    assert search_store.total(spark, path).collect()[0].total == 0
