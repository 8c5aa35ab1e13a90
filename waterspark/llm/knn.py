"""Exact top-k by inner product: a Voronoi kNN join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waterspark.llm.shared import stored

SCALE = 256.0
#: Pivots grow with the square root of the rows up to this many, so that pivots and group
#: summaries stay small enough for the driver and every task.
MOST_PIVOTS = 512
#: Rows of a group that are solved together: rows / 64 within these bounds.
BLOCK = (512, 16_384)
#: Queries that meet a block of data at once.
QUERY_BLOCK = 65_536
#: Scores held at a time in a task.
TILE = 4_000_000
LONG = np.iinfo(np.int64)


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the range of a long they stick to its ends."""
    bound = (np.abs(queries).max(initial=0)) * (np.abs(data).max(initial=0)) * max(queries.shape[1], 1)
    if bound < 2.0**53:
        return (queries @ data.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in data]
    exact = [[sum(map(int.__mul__, [int(x) for x in q], row)) for row in whole] for q in queries]
    return np.array([[min(max(s, LONG.min), LONG.max) for s in row] for row in exact], dtype=np.int64).reshape(len(queries), len(data))


def best_of(queries: dict, data: dict, k: int) -> dict:
    """The k best data rows of each query that reach its floor, never its own row."""
    order = np.argsort(data["id"], kind="stable")
    rows, ids, vectors = data["row"][order], data["id"][order], data["v"][order]
    out = {"query": [], "query_id": [], "id": [], "score": []}
    step = max(1, TILE // max(1, len(ids)))
    own_row = np.argsort(rows)
    for at in range(0, len(queries["row"]), step):
        part = slice(at, at + step)
        found = scores(queries["v"][part], vectors)
        own = np.searchsorted(rows[own_row], queries["row"][part])
        own = own_row[np.minimum(own, len(rows) - 1)]
        here = rows[own] == queries["row"][part]
        allowed = found >= queries["floor"][part][:, None]
        allowed[here, own[here]] = False
        if found.shape[1] > k:
            masked = np.where(allowed, found, LONG.min)
            allowed &= found >= np.partition(masked, -k, axis=1)[:, -k][:, None]
        q, d = np.nonzero(allowed)
        score = found[q, d]
        order = np.lexsort((d, -score.astype(np.float64), q)) if np.abs(score).max(initial=0) < 2**53 else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(score[i]), d[i])), dtype=np.int64)
        q, d, score = q[order], d[order], score[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        q, d, score = q[keep], d[keep], score[keep]
        out["query"].append(queries["row"][part][q])
        out["query_id"].append(queries["id"][part][q])
        out["id"].append(ids[d])
        out["score"].append(score)
    return {c: np.concatenate(x) if x else np.empty(0, np.int64) for c, x in out.items()}


def unpacked(batch: pa.RecordBatch | pa.Table, name: str, width: int) -> np.ndarray:
    raw = b"".join(batch.column(name).to_pylist())
    return np.frombuffer(raw, dtype=np.float64).reshape(-1, width) if width else np.empty((batch.num_rows, 0))


class Geometry:
    """Pivots and group summaries in the space where a larger inner product is a smaller
    distance: data vectors get one more component that gives all of them the norm of the
    largest, queries get a zero there."""

    def __init__(self, pivots: np.ndarray, top: float) -> None:
        self.pivots, self.top = pivots, top  # top: largest squared norm
        norms = (pivots**2).sum(axis=1)
        self.extra = np.sqrt(np.maximum(top - norms, 0))

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        norm = (v**2).sum(axis=1)
        inner = v @ self.pivots.T
        if query:
            squared = norm[:, None] + self.top - 2 * inner
        else:
            extra = np.sqrt(np.maximum(self.top - norm, 0))
            squared = 2 * self.top - 2 * (inner + extra[:, None] * self.extra[None, :])
        return np.sqrt(np.maximum(squared, 0))


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, v): floor(256 x) as packed doubles, for vectors without null or
    non-finite components; shorter ones end in zeros."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull()).filter(fine)
    slim = kept.select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.floor(SCALE * np.array(x, dtype=np.float64)) for x in batch.column(1).to_pylist()]
            norms = [float(a @ a) for a in v]
            packed = pa.array([a.tobytes() for a in v], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(norms, pa.float64()), pa.array(list(map(len, v)), pa.int32())], names=["id", "v", "norm", "width"])

    return slim.mapInArrow(work, "id long, v binary, norm double, width int").withColumn("row", F.monotonically_increasing_id())


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k other rows of the highest
    inner product, ties to the smaller id; all if there are fewer.

    ``is_query`` is a condition on the column ``id``. Vectors that are null, or hold null or
    non-finite components, and rows without an id take no part; vectors of different length
    compare as if the shorter ended in zeros; rows that repeat an id are rows of their own.

    Queries and data go to their nearest pivots. Each group's summary (number, smallest and
    largest distance to its pivot) bounds what it can hold. A query is first solved in its
    own group, which gives a floor for its k-th score; by the triangle inequality only
    groups that can reach the floor get a copy of it, and only scores that reach it come
    back. A group is dealt out in blocks, so one that holds a third of all rows is many
    tasks; a block sees a bounded number of queries and of rows. Rows never meet as pairs
    outside a block.
    """
    data = stored(quantised(vectors, id_col, vector_col), "vectors")
    seen = data.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.max("width").alias("width"), F.count(F.when(is_query, 1)).alias("queries")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not seen["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    n, width = seen["n"], seen["width"]
    count = int(min(MOST_PIVOTS, max(4, math.isqrt(n) // 4)))
    chosen = data.orderBy(F.xxhash64("id"), "id", "row").limit(count).select("v").collect()  # at most MOST_PIVOTS rows
    pad = width * 8
    geometry = Geometry(np.stack([np.frombuffer(bytes(r["v"]).ljust(pad, b"\0"), dtype=np.float64) for r in chosen]), float(seen["top"]))
    block = int(min(BLOCK[1], max(BLOCK[0], n // 64)))

    def assign(query: bool):  # noqa: ANN202
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    packed = [v.ljust(pad, b"\0") for v in batch.column("v").to_pylist()]
                    v = np.frombuffer(b"".join(packed), dtype=np.float64).reshape(len(packed), width)
                    far = geometry.distances(v, query)
                    near = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row"), batch.column("id"), pa.array(packed, pa.binary()), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])],
                        names=["row", "id", "v", "grp", "dist"],
                    )

        return work

    shape = "row long, id long, v binary, grp int, dist double"
    placed = stored(data.select("row", "id", "v").mapInArrow(assign(False), shape), "vector-groups")
    queries = stored(data.filter(is_query).select("row", "id", "v").mapInArrow(assign(True), shape), "query-groups")
    # One row for each pivot.
    summary = {r["grp"]: r for r in placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()}
    blocks = {g: math.ceil(r["n"] / block) for g, r in summary.items()}
    chunks = math.ceil(max(1, seen["queries"]) / QUERY_BLOCK)
    block_of = F.create_map(*[F.lit(x) for g, b in sorted(blocks.items()) for x in (g, b)])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("row"), block_of[F.col("grp")]).cast("int"))

    def solve(asked: DataFrame) -> DataFrame:
        """``asked``: (row, id, v, floor, grp) with the groups that a query needs."""
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), block_of[F.col("grp")] - 1))
        )
        held = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

        def local(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "id", "score")})
            q = {"row": left.column("row").to_numpy(), "id": left.column("id").to_numpy(), "floor": left.column("floor").to_numpy(), "v": unpacked(left, "v", width)}
            d = {"row": right.column("row").to_numpy(), "id": right.column("id").to_numpy(), "v": unpacked(right, "v", width)}
            return pa.table(best_of(q, d, k))

        keys = ["grp", "block", "chunk"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(local, "query long, query_id long, id long, score long")

    first = stored(solve(queries.withColumn("floor", F.lit(LONG.min).cast("long"))), "own-group")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    floors = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
    low = np.array([summary[g]["low"] if g in summary else np.inf for g in range(len(chosen))])
    high = np.array([summary[g]["high"] if g in summary else np.inf for g in range(len(chosen))])
    there = np.array([g in summary for g in range(len(chosen))])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, floor = unpacked(batch, "v", width), batch.column("floor").to_numpy().astype(np.float64)
            far = geometry.distances(v, True)
            least = np.maximum(np.maximum(far - high, low - far), 0)
            # Not farther than the k-th of the own group; the slack covers rounding.
            reach = (v**2).sum(axis=1) + geometry.top - 2 * floor
            want = ~(least**2 > (reach + 1e-6 * (1 + np.abs(reach) + geometry.top))[:, None]) & there
            want[np.arange(len(v)), batch.column("grp").to_numpy()] = False
            at, group = np.nonzero(want)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("row", "id", "v", "floor")] + [pa.array(group.astype(np.int32))], names=["row", "id", "v", "floor", "grp"])

    asked = queries.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(LONG.min).cast("long")))
    others = solve(asked.select("row", "id", "v", "floor", "grp").mapInArrow(needed, "row long, id long, v binary, floor long, grp int"))
    both = first.unionByName(others).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return both.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
