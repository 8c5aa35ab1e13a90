"""Numpy kernels that run inside Arrow batches.

Polygons arrive as lists of rings, a ring being an ``(n, 2)`` array whose last point
repeats the first. The area kernel works on *signed edges*: the region under an edge is
a trapezoid, a polygon is the signed sum of its edges' trapezoids, and the overlap of two
polygons is the signed sum over edge pairs of the area under the lower edge. That form
has no branches per polygon, so a whole batch of polygon pairs is one set of array
operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EDGE_PAIR_CHUNK = 2_000_000
SWEEP_FROM = 4_096
RUN = 64


# --------------------------------------------------------------------- rings
def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.dot(x[:-1], y[1:]) - np.dot(x[1:], y[:-1])) / 2


def oriented(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Shell counter-clockwise, holes clockwise."""
    out = []
    for i, ring in enumerate(rings):
        positive = signed_area(ring) >= 0
        out.append(ring if positive == (i == 0) else ring[::-1])
    return out


def ring_edges(rings: list[np.ndarray]) -> np.ndarray:
    """(n, 4) array of x1, y1, x2, y2."""
    parts = [np.hstack([r[:-1], r[1:]]) for r in rings if len(r) > 1]
    return np.concatenate(parts) if parts else np.empty((0, 4))


def _cross(ax, ay, bx, by):
    return ax * by - ay * bx


def crosses_itself(edges: np.ndarray) -> bool:
    """True when two edges cross in their interiors.

    Edges are sorted by their lower end; each meets only those that begin below its upper
    end, all edges side by side: the first follower, then the second, and so on.
    """
    n = len(edges)
    if n < 4:
        return False
    edges = edges[np.argsort(np.minimum(edges[:, 1], edges[:, 3]), kind="stable")]
    x1, y1, x2, y2 = edges.T
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    left, right = np.minimum(x1, x2), np.maximum(x1, x2)
    active, step = np.arange(n), 1
    while True:
        active = active[active < n - step]
        active = active[low[active + step] < high[active]]
        if not len(active):
            return False
        a = active[(left[active] < right[active + step]) & (left[active + step] < right[active])]
        b = a + step
        ax, ay, bx, by = x2[a] - x1[a], y2[a] - y1[a], x2[b] - x1[b], y2[b] - y1[b]
        d1 = _cross(ax, ay, x1[b] - x1[a], y1[b] - y1[a])
        d2 = _cross(ax, ay, x2[b] - x1[a], y2[b] - y1[a])
        d3 = _cross(bx, by, x1[a] - x1[b], y1[a] - y1[b])
        d4 = _cross(bx, by, x2[a] - x1[b], y2[a] - y1[b])
        if np.any((d1 * d2 < 0) & (d3 * d4 < 0)):
            return True
        step += 1


def range_pairs(a_lo: np.ndarray, a_hi: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all ranges [lo, hi) of ``a`` and ``b`` that overlap, in bounded chunks.

    Of two such ranges one begins inside the other, so begins are sorted and each range
    looks up those inside it: the work follows the pairs found, not all pairs.
    """
    for lo, hi, begins, side in ((a_lo, a_hi, b_lo, "left"), (b_lo, b_hi, a_lo, "right")):
        order = np.argsort(begins, kind="stable")
        first = np.searchsorted(begins[order], lo, side)
        count = np.maximum(np.searchsorted(begins[order], hi, "left") - first, 0)
        done = np.cumsum(count)
        at = 0
        while at < len(count):
            base = done[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(done, base + EDGE_PAIR_CHUNK, side="right")))
            n = count[at:end]
            if done[end - 1] > base:
                own = np.repeat(np.arange(at, end), n)
                met = order[first[own] + np.arange(done[end - 1] - base) - np.repeat(done[at:end] - n - base, n)]
                yield (own, met) if side == "left" else (met, own)
            at = end


def even_odd_trapezoids(edges: np.ndarray) -> list[np.ndarray]:
    """Cover the even-odd interior of arbitrary edges by disjoint trapezoids."""
    x1, y1, x2, y2 = edges.T
    keep = y1 != y2
    x1, y1, x2, y2 = (v[keep] for v in (x1, y1, x2, y2))
    if not len(x1):
        return []
    flip = y1 > y2
    x1, x2 = np.where(flip, x2, x1), np.where(flip, x1, x2)
    y1, y2 = np.where(flip, y2, y1), np.where(flip, y1, y2)
    dx, dy, levels = x2 - x1, y2 - y1, [y1, y2]
    for i, j in range_pairs(y1, y2, y1, y2):
        once = i < j
        i, j = i[once], j[once]
        meet = (np.minimum(x1[i], x2[i]) <= np.maximum(x1[j], x2[j])) & (np.minimum(x1[j], x2[j]) <= np.maximum(x1[i], x2[i]))
        i, j = i[meet], j[meet]
        den = _cross(dx[i], dy[i], dx[j], dy[j])
        with np.errstate(divide="ignore", invalid="ignore"):
            t = _cross(x1[j] - x1[i], y1[j] - y1[i], dx[j], dy[j]) / den
            u = _cross(x1[j] - x1[i], y1[j] - y1[i], dx[i], dy[i]) / den
        ok = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        levels.append(y1[i[ok]] + t[ok] * dy[i[ok]])
    ys = np.unique(np.concatenate(levels))
    # Every edge in every band it spans; inside a band edges do not cross, so those next
    # to each other bound the inside in turn.
    first = np.searchsorted(ys, y1)
    count = np.searchsorted(ys, y2) - first
    edge = np.repeat(np.arange(len(y1)), count)
    band = first[edge] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    slope = dx[edge] / dy[edge]
    xl, xh = x1[edge] + slope * (ys[band] - y1[edge]), x1[edge] + slope * (ys[band + 1] - y1[edge])
    order = np.lexsort((edge, xl + xh, band))
    band, xl, xh = band[order], xl[order], xh[order]
    starts = np.append(True, band[1:] != band[:-1])
    place = np.arange(len(band)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
    left = np.flatnonzero(place[:-1] % 2 == 0)
    left = left[(band[left] == band[left + 1]) & (xl[left + 1] + xh[left + 1] > xl[left] + xh[left])]
    right, lo, hi = left + 1, ys[band[left]], ys[band[left] + 1]
    corners = [(xl[left], lo), (xl[right], lo), (xh[right], hi), (xh[left], hi), (xl[left], lo)]
    return list(np.stack([np.column_stack(c) for c in corners], axis=1))


def is_box(rings: list[np.ndarray]) -> bool:
    """One ring of four axis-parallel sides."""
    if len(rings) != 1 or len(rings[0]) != 5:
        return False
    d = np.diff(rings[0], axis=0)
    horizontal, vertical = d[:, 1] == 0, d[:, 0] == 0
    return bool(
        np.all(horizontal ^ vertical) and horizontal[0] != horizontal[1] and horizontal[0] == horizontal[2]
        and horizontal[1] == horizontal[3]
    )


# ---------------------------------------------------------------- box clipping
def _clip_side(ring: np.ndarray, axis: int, limit: float, keep_below: bool) -> np.ndarray:
    """Clip a closed ring by one half plane."""
    v = ring[:, axis]
    inside = v <= limit if keep_below else v >= limit
    if inside.all():
        return ring
    if not inside.any():
        return ring[:0]
    p, q, a, b = ring[:-1], ring[1:], inside[:-1], inside[1:]
    cut = a != b
    delta = np.where(cut, q[:, axis] - p[:, axis], 1.0)
    t = np.where(cut, (limit - p[:, axis]) / delta, 0.0)
    hit = p + t[:, None] * (q - p)
    hit[:, axis] = np.where(cut, limit, hit[:, axis])
    both = np.empty((2 * len(p), 2))
    both[0::2], both[1::2] = hit, q
    use = np.empty(2 * len(p), dtype=bool)
    use[0::2], use[1::2] = cut, b
    out = both[use]
    if len(out) < 3:
        return ring[:0]
    return out if np.array_equal(out[0], out[-1]) else np.vstack([out, out[:1]])


def clip_rings(rings: list[np.ndarray], x0: float, y0: float, x1: float, y1: float) -> list[np.ndarray]:
    """Clip rings by a box. Signed areas are right, but separate parts may stay joined
    by border edges that run both ways; ``tidy_border`` takes those out."""
    out = []
    for ring in rings:
        for axis, limit, below in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
            ring = _clip_side(ring, axis, limit, below)
            if len(ring) < 4:
                break
        if len(ring) >= 4:
            out.append(ring)
    return out


def tidy_border(rings: list[np.ndarray], x0: float, y0: float, x1: float, y1: float) -> list[np.ndarray]:
    """Cancel border edges that run both ways and link the rest into proper rings."""
    edges = ring_edges(rings)
    if not len(edges):
        return []
    keep = np.ones(len(edges), dtype=bool)
    added = []
    for axis, limit in ((0, x0), (0, x1), (1, y0), (1, y1)):
        on = (edges[:, axis] == limit) & (edges[:, axis + 2] == limit) & keep
        if not on.any():
            continue
        keep &= ~on
        other = 1 - axis
        a, b = edges[on, other], edges[on, other + 2]
        cuts = np.unique(np.concatenate([a, b]))
        lo, hi = np.searchsorted(cuts, np.minimum(a, b)), np.searchsorted(cuts, np.maximum(a, b))
        net = np.zeros(len(cuts) + 1)
        np.add.at(net, lo, np.sign(b - a))
        np.add.at(net, hi, -np.sign(b - a))
        net = np.cumsum(net)[: len(cuts) - 1]
        for i in np.nonzero(net)[0]:
            p, q = (cuts[i], cuts[i + 1]) if net[i] > 0 else (cuts[i + 1], cuts[i])
            added.append([limit, p, limit, q] if axis == 0 else [p, limit, q, limit])
    rest = edges[keep]
    rest = rest[(rest[:, 0] != rest[:, 2]) | (rest[:, 1] != rest[:, 3])]
    if added:
        rest = np.concatenate([rest, np.array(added)])
    return link_rings(rest)


def link_rings(edges: np.ndarray) -> list[np.ndarray]:
    """Chain directed edges (interior on the left) into closed rings.

    Where several edges leave one vertex the sharpest left turn is taken, which keeps
    parts that meet only in a corner apart; collinear vertices are dropped.
    """
    n = len(edges)
    if not n:
        return []
    _, vertex = np.unique(np.concatenate([edges[:, :2], edges[:, 2:]]) + 0.0, axis=0, return_inverse=True)
    a, b = vertex.ravel()[:n], vertex.ravel()[n:]
    order = np.argsort(a, kind="stable")
    low, high = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    follow = np.where(high > low, order[np.minimum(low, n - 1)], -1)
    fork = np.flatnonzero(high - low > 1)
    if len(fork):
        count = (high - low)[fork]
        at = np.repeat(fork, count)
        option = order[np.repeat(low[fork], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        back = np.arctan2(edges[at, 1] - edges[at, 3], edges[at, 0] - edges[at, 2])
        turn = (np.arctan2(edges[option, 3] - edges[at, 3], edges[option, 2] - edges[at, 2]) - back) % (2 * np.pi)
        best = np.lexsort((option, -turn, at))
        first = np.append(True, np.diff(at[best]) > 0)
        follow[at[best][first]] = option[best][first]
    chained, used, rings = follow.tolist(), bytearray(n), []
    for begin in range(n):
        chain, i = [], begin
        while i >= 0 and not used[i]:
            used[i] = 1
            chain.append(i)
            i = chained[i]
        if chain:
            points = edges[chain, :2]
            ring = drop_collinear(np.concatenate([points, points[:1]]))
            if len(ring) >= 4:
                rings.append(ring)
    return rings


def drop_collinear(ring: np.ndarray) -> np.ndarray:
    pts = ring[:-1]
    if len(pts) < 3:
        return ring[:0]
    prev, nxt = np.roll(pts, 1, axis=0), np.roll(pts, -1, axis=0)
    bend = _cross(pts[:, 0] - prev[:, 0], pts[:, 1] - prev[:, 1], nxt[:, 0] - pts[:, 0], nxt[:, 1] - pts[:, 1])
    pts = pts[bend != 0]
    return np.vstack([pts, pts[:1]]) if len(pts) >= 3 else ring[:0]


def rings_to_polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Sort rings into shells (counter-clockwise) with their holes (clockwise)."""
    shells, holes = [], []
    for ring in rings:
        (shells if signed_area(ring) > 0 else holes).append(ring)
    polygons = [[s] for s in shells]
    if len(polygons) == 1:
        polygons[0].extend(holes)
        return polygons
    sizes = [signed_area(s) for s in shells]
    for hole in holes:
        probe = (hole[0] + hole[1]) / 2
        d = hole[1] - hole[0]
        size = np.hypot(*d) or 1.0
        probe = probe + np.array([-d[1], d[0]]) / size * 1e-6 * size
        owners = [i for i, s in enumerate(shells) if points_inside(probe[None, :], ring_edges([s]))[0]]
        if owners:
            polygons[min(owners, key=lambda i: sizes[i])].append(hole)
    return polygons


# ------------------------------------------------------------------- fragments
def cell_pieces(
    rings: list[np.ndarray], cell: float, even_odd: bool = False, tidy: bool = True
) -> list[tuple[int, int, list[np.ndarray] | None, tuple]]:
    """Split one oriented polygon along the grid.

    Gives (cx, cy, rings or None for a plain box, box). Columns are clipped first, then
    the rows of each column, so the work follows the length of the outline. An outline
    that crosses itself shows up as a crossing inside some piece; the polygon is then cut
    again by the even-odd rule, which box clipping does not disturb. Without ``tidy``
    pieces may keep border edges that cancel out: fine for areas, not for distances.
    """
    allpts = np.concatenate(rings)
    (xmin, ymin), (xmax, ymax) = allpts.min(axis=0), allpts.max(axis=0)
    cx0, cx1 = int(np.floor(xmin / cell)), int(np.floor(xmax / cell))
    box = is_box(rings)
    out = []
    for cx in range(cx0, cx1 + 1):
        bx0, bx1 = max(xmin, cx * cell), min(xmax, (cx + 1) * cell)
        if bx0 >= bx1:
            continue
        column = rings if box or cx0 == cx1 else clip_rings(rings, cx * cell, -np.inf, (cx + 1) * cell, np.inf)
        if not column:
            continue
        ys = np.concatenate(column)[:, 1]
        lo, hi = float(ys.min()), float(ys.max())
        cy0, cy1 = int(np.floor(lo / cell)), int(np.floor(hi / cell))
        for cy in range(cy0, cy1 + 1):
            by0, by1 = max(lo, cy * cell), min(hi, (cy + 1) * cell)
            if by0 >= by1:
                continue
            if box:
                out.append((cx, cy, None, (bx0, by0, bx1, by1)))
                continue
            limits = (cx * cell, cy * cell, (cx + 1) * cell, (cy + 1) * cell)
            whole = cx0 == cx1 and cy0 == cy1
            piece = column
            if not whole and cy0 != cy1:
                piece = clip_rings(column, -np.inf, limits[1], np.inf, limits[3])
                if not piece:
                    continue
            if even_odd:
                piece = even_odd_trapezoids(ring_edges(piece))
            if not whole:
                total = sum(signed_area(r) for r in piece)
                if abs(total - cell * cell) <= 1e-9 * cell * cell:
                    out.append((cx, cy, None, limits))
                    continue
                if tidy and not even_odd:
                    piece = tidy_border(piece, *limits)
            if not even_odd and crosses_itself(ring_edges(piece)):
                return cell_pieces(rings, cell, True, tidy)
            if not piece:
                continue
            if is_box(piece):
                p = piece[0]
                out.append((cx, cy, None, (*p.min(axis=0).tolist(), *p.max(axis=0).tolist())))
                continue
            pts = np.concatenate(piece)
            out.append((cx, cy, piece, (*pts.min(axis=0).tolist(), *pts.max(axis=0).tolist())))
    return out


# ------------------------------------------------------------------ pair kernel
def _pair_index(na: np.ndarray, nb: np.ndarray, a0: np.ndarray, b0: np.ndarray):
    """Indices of all edge pairs of many polygon pairs, plus the owning pair."""
    counts = na * nb
    owner = np.repeat(np.arange(len(na)), counts)
    local = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    width = nb[owner]
    return a0[owner] + local // width, b0[owner] + local % width, owner


def _overlap_terms(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Signed area under both edges of each edge pair, above y = 0."""
    ex1, ey1, ex2, ey2 = e.T
    fx1, fy1, fx2, fy2 = f.T
    left = np.maximum(np.minimum(ex1, ex2), np.minimum(fx1, fx2))
    right = np.minimum(np.maximum(ex1, ex2), np.maximum(fx1, fx2))
    width = right - left
    ok = width > 0
    edx, fdx = ex2 - ex1, fx2 - fx1
    sign = np.sign(edx) * np.sign(fdx)
    with np.errstate(divide="ignore", invalid="ignore"):
        es, fs = (ey2 - ey1) / edx, (fy2 - fy1) / fdx
        el, er = ey1 + es * (left - ex1), ey1 + es * (right - ex1)
        fl, fr = fy1 + fs * (left - fx1), fy1 + fs * (right - fx1)
        dl, dr = el - fl, er - fr
        al, ar = np.abs(dl), np.abs(dr)
        gap = np.where(dl * dr < 0, (al * al + ar * ar) / (2 * (al + ar)), (al + ar) / 2)
        area = sign * width * ((el + er + fl + fr) / 4 - gap / 2)
    return np.where(ok, area, 0.0)


def _point_segment_sq(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(length > 0, ((px - x1) * dx + (py - y1) * dy) / length, 0.0)
    t = np.clip(t, 0.0, 1.0)
    return (px - x1 - t * dx) ** 2 + (py - y1 - t * dy) ** 2


def segment_distance_sq(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    ax, ay, bx, by = e.T
    cx, cy, dx, dy = f.T
    best = np.minimum(
        np.minimum(_point_segment_sq(ax, ay, cx, cy, dx, dy), _point_segment_sq(bx, by, cx, cy, dx, dy)),
        np.minimum(_point_segment_sq(cx, cy, ax, ay, bx, by), _point_segment_sq(dx, dy, ax, ay, bx, by)),
    )
    d1 = _cross(bx - ax, by - ay, cx - ax, cy - ay)
    d2 = _cross(bx - ax, by - ay, dx - ax, dy - ay)
    d3 = _cross(dx - cx, dy - cy, ax - cx, ay - cy)
    d4 = _cross(dx - cx, dy - cy, bx - cx, by - cy)
    return np.where((d1 * d2 < 0) & (d3 * d4 < 0), 0.0, best)


def pair_measures(
    a_edges: np.ndarray, a_off: np.ndarray, b_edges: np.ndarray, b_off: np.ndarray, distance: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Overlap area and squared boundary distance of n polygon pairs.

    ``a_off``/``b_off`` hold n + 1 offsets into the edge arrays. Overlapping pairs have
    distance 0. Small pairs compare all edges, in chunks of a bounded number; larger ones
    are swept one by one.
    """
    n = len(a_off) - 1
    overlap, dist = np.zeros(n), np.full(n, np.inf)
    na, nb = np.diff(a_off), np.diff(b_off)
    swept = na * nb > SWEEP_FROM
    for k in np.flatnonzero(swept):
        overlap[k], dist[k] = _swept_pair(a_edges[a_off[k] : a_off[k + 1]], b_edges[b_off[k] : b_off[k + 1]], distance)
    na = np.where(swept, 0, na)
    cost = np.cumsum(na * nb)
    lo = 0
    while lo < n:
        base = cost[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cost, base + EDGE_PAIR_CHUNK, side="right")))
        rows = slice(lo, hi)
        i, j, owner = _pair_index(na[rows], nb[rows], a_off[lo:hi], b_off[lo:hi])
        e, f = a_edges[i], b_edges[j]
        if len(e):
            origin = _pair_origin(a_edges, a_off, b_edges, b_off, lo, hi)[owner]
            shift = np.hstack([origin, origin])
            overlap[rows] += np.bincount(owner, _overlap_terms(e - shift, f - shift), minlength=hi - lo)
            if distance:
                d = segment_distance_sq(e, f)
                np.minimum.at(dist, lo + owner, d)
        lo = hi
    overlap = np.maximum(overlap, 0.0)
    return overlap, dist


def _pair_origin(a_edges, a_off, b_edges, b_off, lo, hi) -> np.ndarray:
    """Lower-left corner of each pair's edges, so that heights are small and positive."""

    def low(edges, off):
        pts = np.minimum(edges[:, :2], edges[:, 2:])
        out = np.full((hi - lo, 2), np.inf)
        for k, (s, t) in enumerate(zip(off[lo:hi], off[lo + 1 : hi + 1])):
            if t > s:
                out[k] = pts[s:t].min(axis=0)
        return out

    if hi - lo > 64 and np.all(np.diff(a_off[lo : hi + 1]) > 0) and np.all(np.diff(b_off[lo : hi + 1]) > 0):
        def fast(edges, off):
            pts = np.minimum(edges[:, :2], edges[:, 2:])[: off[hi]]
            return np.minimum.reduceat(pts, off[lo:hi], axis=0)

        return np.minimum(fast(a_edges, a_off), fast(b_edges, b_off))
    both = np.minimum(low(a_edges, a_off), low(b_edges, b_off))
    return np.where(np.isfinite(both), both, 0.0)


def _swept_pair(a: np.ndarray, b: np.ndarray, distance: bool) -> tuple[float, float]:
    """Overlap and squared distance of two outlines of many edges.

    Only edges above a common stretch of the x axis have area under both of them. What is
    left by rounding where nothing overlaps counts as no overlap.
    """
    origin = np.minimum(a.reshape(-1, 2).min(axis=0), b.reshape(-1, 2).min(axis=0))
    shift = np.hstack([origin, origin])
    e, f = ((s - shift)[s[:, 0] != s[:, 2]] for s in (a, b))
    ends = [np.sort(s[:, [0, 2]], axis=1).T for s in (e, f)]
    area = size = 0.0
    for i, j in range_pairs(*ends[0], *ends[1]):
        terms = _overlap_terms(e[i], f[j])
        area, size = area + float(terms.sum()), size + float(np.abs(terms).sum())
    area = area if area > 1e-12 * size else 0.0
    if not distance:
        return area, np.inf
    return area, 0.0 if area > 0 else nearest_sq(a, b)


def nearest_sq(a: np.ndarray, b: np.ndarray) -> float:
    """Least squared distance of two sets of segments.

    Runs of following segments have boxes. A pair of boxes bounds its distances from both
    sides; pairs are opened from the nearest on until the next cannot be nearer.
    """
    boxes = []
    for s in (a, b):
        at = np.arange(0, len(s), RUN)
        boxes.append((np.minimum.reduceat(np.minimum(s[:, :2], s[:, 2:]), at), np.maximum.reduceat(np.maximum(s[:, :2], s[:, 2:]), at)))
    (a_lo, a_hi), (b_lo, b_hi) = boxes
    bound, kept = np.inf, []
    step = max(1, EDGE_PAIR_CHUNK // len(b_lo))
    for s in range(0, len(a_lo), step):
        over, under = b_lo - a_hi[s : s + step, None], a_lo[s : s + step, None] - b_hi
        bound = min(bound, float((np.maximum(-over, -under) ** 2).sum(axis=2).min()))
        gap = (np.maximum(np.maximum(over, under), 0.0) ** 2).sum(axis=2)
        i, j = np.nonzero(gap <= bound)
        kept.append((gap[i, j], s + i, j))
    gap, i, j = (np.concatenate(k) for k in zip(*kept))
    order = np.argsort(gap, kind="stable")
    best, at, size = np.inf, 0, 8
    reach = np.arange(RUN)
    while at < len(order) and gap[order[at]] < best:
        part = order[at : at + size]
        e = a[np.minimum(i[part][:, None] * RUN + reach, len(a) - 1)]
        f = b[np.minimum(j[part][:, None] * RUN + reach, len(b) - 1)]
        pairs = np.repeat(e, RUN, axis=1).reshape(-1, 4), np.tile(f, (1, RUN, 1)).reshape(-1, 4)
        best = min(best, float(segment_distance_sq(*pairs).min()))
        at, size = at + size, min(2 * size, EDGE_PAIR_CHUNK // (RUN * RUN))
    return best


def polygon_overlap(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Overlap of two single polygons (shell first); for tests and small helpers."""
    ea, eb = _clean_edges(a), _clean_edges(b)
    area, _ = pair_measures(ea, np.array([0, len(ea)]), eb, np.array([0, len(eb)]), False)
    return float(area[0])


def _clean_edges(rings: list[np.ndarray]) -> np.ndarray:
    edges = ring_edges(oriented(rings))
    if crosses_itself(edges):
        edges = ring_edges(even_odd_trapezoids(edges))
    return edges


# ------------------------------------------------------------- points and lines
def points_inside(pts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd test of many points against one set of edges."""
    if not len(edges):
        return np.zeros(len(pts), dtype=bool)
    x1, y1, x2, y2 = edges.T
    out = np.zeros(len(pts), dtype=bool)
    step = max(1, EDGE_PAIR_CHUNK // len(edges))
    for s in range(0, len(pts), step):
        px, py = pts[s : s + step, :1], pts[s : s + step, 1:]
        straddles = (y1 > py) != (y2 > py)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = x1 + (py - y1) * (x2 - x1) / (y2 - y1)
        out[s : s + step] = (np.sum(straddles & (px < at), axis=1) % 2).astype(bool)
    return out


def points_distance_sq(pts: np.ndarray, edges: np.ndarray) -> np.ndarray:
    out = np.full(len(pts), np.inf)
    if not len(edges):
        return out
    step = max(1, EDGE_PAIR_CHUNK // len(edges))
    for s in range(0, len(pts), step):
        px, py = pts[s : s + step, :1], pts[s : s + step, 1:]
        out[s : s + step] = _point_segment_sq(px, py, *edges.T).min(axis=1)
    return out


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring; a ring that would collapse stays as it is."""
    pts = ring[:-1]
    n = len(pts)
    if n < 4:
        return ring
    far = int(np.argmax(np.sum((pts - pts[0]) ** 2, axis=1)))
    line = np.vstack([pts, pts[:1]])
    keep = np.zeros(n + 1, dtype=bool)
    keep[[0, far, n]] = True
    stack = [(0, far), (far, n)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        mid = line[a + 1 : b]
        d = _point_segment_sq(mid[:, 0], mid[:, 1], *line[a], *line[b])
        k = int(np.argmax(d))
        if d[k] > tolerance * tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    out = line[keep]
    return out if len(out) >= 4 else ring


def squares_touched(centres: np.ndarray, hx: float, hy: float, edges: np.ndarray) -> np.ndarray:
    """Whether any edge meets each axis-parallel square (closed)."""
    out = np.zeros(len(centres), dtype=bool)
    if not len(edges):
        return out
    x1, y1, x2, y2 = edges.T
    step = max(1, EDGE_PAIR_CHUNK // len(edges))
    for s in range(0, len(centres), step):
        px, py = centres[s : s + step, :1], centres[s : s + step, 1:]
        enter, leave = np.zeros((len(px), len(edges))), np.ones((len(px), len(edges)))
        with np.errstate(divide="ignore", invalid="ignore"):
            for p, half, a, b in ((px, hx, x1, x2), (py, hy, y1, y2)):
                d = b - a
                t0, t1 = (p - half - a) / d, (p + half - a) / d
                within = (a >= p - half) & (a <= p + half)
                lo = np.where(d == 0, np.where(within, -np.inf, np.inf), np.minimum(t0, t1))
                hi = np.where(d == 0, np.where(within, np.inf, -np.inf), np.maximum(t0, t1))
                enter, leave = np.maximum(enter, lo), np.minimum(leave, hi)
        out[s : s + step] = (enter <= leave).any(axis=1)
    return out
