import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waterspark.llm import knn


def brute(rows, k, is_query):
    fine = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, q) in enumerate(fine):
        if is_query(i):
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(fine) if m != n)[:k]
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(found, 1))
    return out


def run(spark, rows, k=5, every=10):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("x")).withColumn("id", F.lit("y")).repartition(3)
    made = knn.top_k(vectors, F.col("id") % every == 0, k)
    return Counter(tuple(r) for r in made.select("query_id", "rank", "vec_id", "score").collect())


def rows_of(n, dims=6):
    random.seed(6)
    centres = [[random.gauss(0, 3) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [c + random.gauss(0, 0.3) for c in random.choice(centres)]) for i in range(n)]
    rows += [(i, [1.0] * dims) for i in range(n, n + n // 3)]  # one vector for a quarter of all
    return rows + [(n // 10 * 10, [0.5] * dims), (n // 10 * 10, [0.5] * dims), (9001, None), (9002, [None] + [1.0] * (dims - 1)), (9003, [float("nan")] * dims), (9004, [float("inf")] * dims), (None, [1.0] * dims)]


@pytest.mark.parametrize("block", [(512, 16_384), (8, 8)])
def test_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "BLOCK", block)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4 if block[0] == 8 else 65_536)
    rows = rows_of(150)
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 10 == 0)


def test_few_rows_large_values_and_other_lengths(spark):
    rows = [(0, [1.0, 2.0]), (10, [3.0]), (20, []), (3, [-1.0, 0.5])]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 10 == 0)
    huge = [(0, [2.0**20, 2.0**19]), (1, [2.0**20 + 1, -3.0]), (2, [5.0, 2.0**21])]
    assert run(spark, huge) == brute(huge, 5, lambda i: i % 10 == 0)
    assert run(spark, [(5, None)]) == Counter()
    assert run(spark, [(0, [1.0])]) == Counter()


def test_groups_out_of_reach_get_no_query(spark):
    far = knn.Geometry(np.array([[0.0, 0.0], [100.0, 0.0]]), 10_000.0)
    data, query = far.distances(np.array([[100.0, 0.0]]), False), far.distances(np.array([[100.0, 0.0]]), True)
    assert data[0, 1] == 0 and np.isclose(query[0, 1] ** 2, 10_000 + 10_000 - 2 * 10_000)
