"""Near-duplicate vectors by an exact metric range join.

Pivots cut the sphere in Voronoi cells. The angle is a metric there, so the triangle
inequality tells which cells can hold a partner of a vector; it is copied to those, and each
group of cells is joined alone. A group yields counts and a forest, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterspark.llm.components import components
from waterspark.llm.shared import stored

COSINE = 0.9
#: Pivots grow with the vectors, one for so many, up to a bound; they and one number for each
#: ``BLOCK`` vectors are all that the driver and the tasks hold of the whole.
ROWS_A_PIVOT, MAX_PIVOTS = 256, 4096
#: Home vectors of a group; cells beyond are cut, small cells share a group.
BLOCK = 8192
STRIP = 1024
#: Angles from arc cosines, and products in single precision, are trusted to these.
ANGLE_SLACK, SINGLE_SLACK = 1e-6, 1e-5
CORE, REST = 0, 1


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length one; None if it has no direction."""
    if not values or any(x is None for x in values):
        return None
    row = np.array(values, dtype=np.float64)
    top = np.abs(row).max() if np.isfinite(row).all() else 0.0
    if not top:
        return None
    row /= top
    return row / np.linalg.norm(row)


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(-1, width)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, dtype=np.float64)
    return out


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, vec): the digest and the bytes of each row's unit vector, null without one.
    The digest is that of the given values, so copies are one node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            units = [unit(v) for v in given]
            nodes = [None if u is None else hashlib.md5(np.array(v, dtype=np.float64).tobytes()).digest() for u, v in zip(units, given)]
            vecs = [None if u is None else u.tobytes() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())], names=["id", "node", "vec"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(work, f"id {kind}, node binary, vec binary")


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


class Cells:
    """The pivots, and what is known of each unit (the core or the rest of a cell)."""

    def __init__(self, pivots: np.ndarray, lengths: np.ndarray, cosine: float):
        self.pivots, self.lengths, self.cosine = pivots, lengths, cosine
        self.radius = float(np.arccos(cosine))
        self.chord = float(np.sqrt(2 - 2 * cosine)) + ANGLE_SLACK
        self.apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))

    @property
    def width(self) -> int:
        return self.pivots.shape[1]

    def placed(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, unit and angle to the pivot. The members of a core lie within half the
        radius of its pivot, so each links with each."""
        near = rows @ self.pivots.T
        cell = near.argmax(axis=1)
        angle = angles(near[np.arange(len(rows)), cell])
        core = (2 * angle <= self.radius - ANGLE_SLACK) & (lengths == self.lengths[cell])
        return cell, 2 * cell + np.where(core, CORE, REST), angle

    def settle(self, found: list, block: int) -> None:
        """``found``: (unit, members, weight, first node, least and largest angle) of the
        units in use; deals them out to groups of about ``block`` members."""
        found = sorted(found)
        self.unit = np.array([f[0] for f in found], dtype=np.int64)
        self.weight = dict(zip(self.unit.tolist(), (f[2] for f in found)))
        self.first = dict(zip(self.unit.tolist(), (bytes(f[3]) for f in found)))
        self.ring = np.array([[f[4] for f in found], [f[5] for f in found]]).reshape(2, -1)
        self.begin, self.parts, at, room = [], [], -1, 0
        for _, members, *_ in found:
            parts = -(-members // block)
            if parts > 1 or members > room:
                at, room = at + 1, block
            self.begin.append(at)
            self.parts.append(parts)
            room = 0 if parts > 1 else room - members
            at += parts - 1
        self.groups = at + 1
        self.begin, self.parts = np.array(self.begin, dtype=np.int64), np.array(self.parts, dtype=np.int64)

    def home(self, units: np.ndarray, nodes: list[bytes]) -> np.ndarray:
        """The group each member lives in."""
        at = np.searchsorted(self.unit, units)
        salt = np.array([int.from_bytes(n[:4], "little") for n in nodes], dtype=np.int64)
        return self.begin[at] + salt % self.parts[at]

    def visits(self, rows: np.ndarray, units: np.ndarray, angle: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of the copies: groups other than the row's own that may hold a
        partner. Of two groups one sends to the other."""
        cell, there = units // 2, self.unit // 2
        near = rows @ self.pivots.T
        to = angles(near)[:, there]
        own = near[np.arange(len(rows)), cell]
        reach = (to <= self.ring[1] + self.radius + ANGLE_SLACK) & (to >= self.ring[0] - self.radius - ANGLE_SLACK)
        # A partner in another cell lies on the far side of the plane between the pivots,
        # and its angle to the other pivot is no larger than to this one.
        reach &= to <= angle[:, None] + 2 * self.radius + ANGLE_SLACK
        reach &= own[:, None] - near[:, there] <= self.chord * self.apart[cell][:, there] + ANGLE_SLACK
        reach |= cell[:, None] == there
        # Cores are linked already.
        reach &= ~((units[:, None] == self.unit) & (units % 2 == CORE)[:, None])
        row, at = np.nonzero(reach)
        parts = self.parts[at]
        group = np.repeat(self.begin[at], parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        row = np.repeat(row, parts)
        ahead = (group - home[row]) % self.groups
        sent = (2 * ahead < self.groups) | ((2 * ahead == self.groups) & (home[row] < group))
        pairs = np.unique(row[sent & (ahead > 0)] * self.groups + group[sent & (ahead > 0)])
        return pairs // self.groups, pairs % self.groups


class Home:
    """The members of a group, their weights' sums and a forest over them."""

    def __init__(self, cells: Cells, rows: list[tuple]):
        self.cells = cells
        self.node, self.units, self.weight = [r[0] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        self.exact = matrix([r[1] for r in rows], cells.width)
        self.length = np.array([len(r[1]) for r in rows])
        self.single = self.exact.astype(np.float32)
        self.root = np.arange(len(rows))
        self.links = np.zeros(len(rows), dtype=np.int64)

    def linked(self, single: np.ndarray, exact: np.ndarray, length: np.ndarray, units: np.ndarray, start: int = 0) -> np.ndarray:
        """Which of the rows reach the cosine with which members from ``start`` on."""
        score = single @ self.single[start:].T
        hit = score >= self.cells.cosine + SINGLE_SLACK
        a, b = np.nonzero((score >= self.cells.cosine - SINGLE_SLACK) & ~hit)
        hit[a, b] = np.einsum("ij,ij->i", exact[a], self.exact[start + b]) >= self.cells.cosine
        if (length[0] != self.length).any() or (length != length[0]).any():
            hit &= length[:, None] == self.length[start:]
        core = (units[:, None] == self.units[start:]) & (units % 2 == CORE)[:, None]
        hit[core] = False
        return hit

    def join(self, hit: np.ndarray, own: np.ndarray | None = None, start: int = 0) -> np.ndarray:
        """Unites the members that a row links with (and the row's own place, if it is a
        member); returns one of them for each row, -1 without any."""
        some = np.flatnonzero(hit.any(axis=1))
        first = np.full(len(hit), -1)
        first[some] = start + hit[some].argmax(axis=1)
        anchor = first[some] if own is None else own[some]
        hit = hit[some]
        while len(some):
            roots = self.root[start:]
            apart = hit & (self.root[anchor][:, None] != roots)
            some = np.flatnonzero(apart.any(axis=1))
            a, b = self.root[anchor[some]], roots[apart[some].argmax(axis=1)]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while ((up := self.root[self.root]) != self.root).any():
                self.root = up
            hit, anchor = apart[some], anchor[some]
        return first

    def inside(self) -> None:
        for at in range(0, len(self.node), STRIP):
            cut = slice(at, at + STRIP)
            hit = self.linked(self.single[cut], self.exact[cut], self.length[cut], self.units[cut], at)
            n = len(hit)
            hit[:, :n] = np.triu(hit[:, :n], 1)
            self.links[cut] += hit @ self.weight[at:]
            self.links[at:] += self.weight[cut] @ hit
            self.join(hit, np.arange(at, at + n), at)

    def visited(self, rows: list[tuple]) -> Iterator[tuple]:
        """(node, other, links) of copies from elsewhere."""
        for at in range(0, len(rows), STRIP):
            cut = rows[at : at + STRIP]
            exact, length = matrix([r[1] for r in cut], self.cells.width), np.array([len(r[1]) for r in cut])
            hit = self.linked(exact.astype(np.float32), exact, length, np.array([r[2] for r in cut]))
            if not hit.any():
                continue
            self.links += np.array([r[3] for r in cut]) @ hit
            links, first = hit @ self.weight, self.join(hit)
            yield from ((cut[i][0], self.node[first[i]], int(links[i])) for i in np.flatnonzero(first >= 0))

    def result(self) -> Iterator[tuple]:
        for i in np.flatnonzero(self.links):
            yield self.node[i], self.node[self.root[i]], int(self.links[i])


def joined(cells: Cells):
    """Arrow function over rows (grp, away, node, vec, unit, weight) sorted by group with its
    members first."""
    kinds = [pa.binary(), pa.binary(), pa.int64()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["node", "other", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, home = None, [], None
        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if groups[lo] != now:
                    if now is not None and (rows := list(ended(members, home))):
                        yield packed(rows)
                    now, members, home = groups[lo], [], None
                part = batch.slice(lo, hi - lo)
                away = part.column(1).to_numpy()
                rows = list(zip(*(part.column(i).to_pylist() for i in range(2, 6))))
                near = int(np.searchsorted(away, 1))
                members += rows[:near]
                if near < len(rows) and members:
                    if home is None:
                        home = Home(cells, members)
                        home.inside()
                    if out := list(home.visited(rows[near:])):
                        yield packed(out)
        if now is not None and (rows := list(ended(members, home))):
            yield packed(rows)

    def ended(members: list[tuple], home: Home | None) -> Iterator[tuple]:
        if home is None and members:
            home = Home(cells, members)
            home.inside()
        return home.result() if home is not None else iter(())

    return work


def thinned(sample: list[bytes], cosine: float) -> list[bytes]:
    """Pivots no closer than half the radius, so that a crowd has few of them."""
    rows = matrix(sample, max(len(r) for r in sample) // 8)
    limit = float(np.cos(np.arccos(cosine) / 2))
    free, kept = np.ones(len(rows), dtype=bool), []
    for i in range(len(rows)):
        if free[i]:
            kept.append(i)
            free &= rows @ rows[i] < limit
    return [sample[i] for i in kept]


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK, max_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: with how many other rows it has at
    least this cosine, and the smallest id that such links lead to, its own included.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of unlike length; copies link with each other, a repeated row
    too. A row without an id links like any other; a component without any id has a null one,
    and only rows whose id is their component's are kept. Other columns do not matter; an
    empty table gives none.

    Copies are one node with a weight. Members of a core (within half the radius of their
    pivot) are counted, not compared. All else is compared in the groups that the bounds
    leave, each pair once; how many these are is a matter of the data: vectors all about
    equally far from one another go to half of the groups.
    """
    rows = stored(prepared(vectors, id_col, vector_col), "vectors")
    nodes = stored(
        rows.filter("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least")), "distinct-vectors"
    )
    wanted = min(max_pivots, 1 + nodes.count() // ROWS_A_PIVOT)
    sample = [bytes(r["vec"]) for r in nodes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("vec").collect()]
    if not sample:
        return finished(rows, None, None)
    # All lengths must fit, not only those of the sample.
    width = nodes.agg(F.max(F.length("vec"))).first()[0] // 8
    pivots = thinned(sample, cosine)
    cells = Cells(matrix(pivots, width), np.array([len(p) for p in pivots]), cosine)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                part = batch.slice(at, STRIP)
                vecs = part.column(1).to_pylist()
                _, units, angle = cells.placed(matrix(vecs, cells.width), np.array([len(v) for v in vecs]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(units), pa.array(angle)], names=["node", "vec", "weight", "unit", "angle"])

    placed = stored(nodes.select("node", "vec", "weight").mapInArrow(place, "node binary, vec binary, weight long, unit long, angle double"), "placed-vectors")
    summary = placed.groupBy("unit").agg(F.count(F.lit(1)), F.sum("weight"), F.min("node"), F.min("angle"), F.max("angle"))
    cells.settle([tuple(r) for r in summary.collect()], block)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip = max(1, min(STRIP, (1 << 22) // max(len(cells.unit), len(cells.pivots), cells.groups)))
        for batch in batches:
            for at in range(0, batch.num_rows, strip):
                part = batch.slice(at, strip)
                node, vec, weight, units, angle = part.columns
                units, angle = units.to_numpy(), angle.to_numpy()
                home = cells.home(units, node.to_pylist())
                row, group = cells.visits(matrix(vec.to_pylist(), cells.width), units, angle, home)
                take = np.concatenate([np.arange(part.num_rows), row])
                out = part.select(["node", "vec", "unit", "weight"]).take(pa.array(take))
                away = np.repeat(np.array([0, 1], dtype=np.int64), [part.num_rows, len(row)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([home, group])), pa.array(away), *out.columns], names=["grp", "away", "node", "vec", "unit", "weight"])

    sent = placed.mapInArrow(send, "grp long, away long, node binary, vec binary, unit long, weight long")
    dealt = sent.repartition("grp").sortWithinPartitions("grp", "away")
    found = stored(dealt.mapInArrow(joined(cells), "node binary, other binary, n long"), "vector-links")

    def crowd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What membership of a core tells: links with all others, and one to the first."""
        for batch in batches:
            units, weight = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            n = [cells.weight[u] - w for u, w in zip(units, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cells.first[u] for u in units], pa.binary()), pa.array(n, pa.int64())], names=["node", "other", "n"])

    cores = placed.filter(F.col("unit") % 2 == CORE).select("node", "unit", "weight").mapInArrow(crowd, "node binary, other binary, n long")
    return finished(rows, nodes, found.union(cores))


def finished(rows: DataFrame, nodes: DataFrame | None, found: DataFrame | None) -> DataFrame:
    if nodes is None:
        out = rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    else:
        links = found.groupBy("node").agg(F.sum("n").alias("n"))
        stars = components(found.filter("node != other"), "node", "other")
        # Copies link among themselves too.
        rooted = nodes.join(stars, "node", "left").join(links, "node", "left")
        rooted = stored(rooted.select("node", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "rooted-vectors")
        # Written, so that the join deals out a crowd's root anew and can split it.
        least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least-vectors")
        named = rooted.join(least, "root").select("node", "n_links", "component_id")
        alone = rows.filter("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        out = rows.filter("node is not null").join(named, "node").select("id", "n_links", "component_id").union(alone)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
