import random
from collections import Counter

import numpy as np
import pytest

from waterspark.llm import vector_join


def brute(rows, cosine=0.9):
    units = [vector_join.unit(v) for _, v in rows]
    links, group = [0] * len(rows), list(range(len(rows)))
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i], links[j] = links[i] + 1, links[j] + 1
                if group[i] != group[j]:
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    out = Counter()
    for (i, _), n, g, u in zip(rows, links, group, units):
        known = [r[0] for r, h in zip(rows, group) if h == g and r[0] is not None]
        least = min(known, default=None) if u is not None else i
        out[(i, n, least, i is not None and i == least)] += 1
    return out


def run(spark, rows, **how):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS node", "'x' AS id", "2 AS grp", "3 AS n").repartition(3)
    return Counter(tuple(r) for r in vector_join.near_vectors(vectors, **how).collect())


def rows_of(seed, dims):
    """Vectors at random, chains of small steps, crowds, and copies."""
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=dims) for _ in range(150)]
    for _ in range(10):
        at = rng.normal(size=dims)
        for _ in range(12):
            at = at + rng.normal(size=dims) * rng.choice([0.1, 0.3, 0.45])
            out.append(at * rng.uniform(0.1, 9))
    centre = rng.normal(size=dims)
    out += [centre + rng.normal(size=dims) * 0.05 for _ in range(90)]
    out += [centre + rng.normal(size=dims) * 0.35 for _ in range(60)]
    out += [out[3]] * 7 + [-out[3], 2 * out[3]]
    return [(i, np.float32(v).tolist()) for i, v in enumerate(out)]


ODD = [(5000, None), (5001, []), (5002, [0.0] * 4), (5003, [None, 1.0, 0.0, 0.0]), (5004, [float("nan")] * 4), (5005, [float("inf"), 0.0, 0.0, 0.0]),
       (None, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.1]), (5006, [1.0, 2.0, 3.0]), (5007, [1.0, 2.0, 3.0]), (5006, [1.0, 2.0, 3.0]), (5008, [3e38, 1e38, 0.0, 0.0]), (5009, [1e-38, 3.4e-39, 0.0, 0.0]), (None, None)]


@pytest.mark.parametrize("dims", [2, 4, 24])
@pytest.mark.parametrize("block", [8192, 16])
def test_as_brute_force(spark, monkeypatch, dims, block):
    monkeypatch.setattr(vector_join, "ROWS_A_PIVOT", 20)
    rows = rows_of(dims, dims)
    assert run(spark, rows, block=block) == brute(rows)


@pytest.mark.parametrize("block", [8192, 3])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(vector_join, "ROWS_A_PIVOT", 4)
    rows = rows_of(1, 4)[:40] + ODD
    assert run(spark, rows, block=block) == brute(rows)


def test_nothing_to_join(spark):
    assert run(spark, [(1, None)]) == Counter([(1, 0, 1, True)])
    assert run(spark, [(1, [2.0])]) == Counter([(1, 0, 1, True)])
    assert vector_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_leave_out_what_is_far(spark):
    """Well-separated clusters are not copied to each other."""
    random.seed(2)
    axes = np.eye(16)
    rows = np.array([axes[i % 16] + np.random.default_rng(i).normal(size=16) * 0.02 for i in range(160)])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    cells = vector_join.Cells(axes, np.full(16, 128), 0.9)
    _, units, angle = cells.placed(rows, np.full(160, 128))
    found = [(int(u), int((units == u).sum()), 1, b"x", angle[units == u].min(), angle[units == u].max()) for u in np.unique(units)]
    cells.settle(found, 10)
    assert cells.groups == 16
    row, _ = cells.visits(rows, units, angle, cells.home(units, [b"0000"] * 160))
    assert len(row) == 0
