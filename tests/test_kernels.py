import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waterspark.functions import kernels as K


def square(x0, y0, x1, y1):
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], dtype=float)


HOLED = [square(0, 0, 4, 4), square(1, 1, 3, 3)]
L_SHAPE = [np.array([[0, 0], [3, 0], [3, 1], [1, 1], [1, 3], [0, 3], [0, 0]], dtype=float)]
U_SHAPE = [np.array([[0, 0], [5, 0], [5, 3], [4, 3], [4, 1], [1, 1], [1, 3], [0, 3], [0, 0]], dtype=float)]
R = np.sqrt(0.5)
DIAMOND = [np.array([[R, 0], [0, R], [-R, 0], [0, -R], [R, 0]])]
BOW_TIE = [np.array([[0, 0], [2, 2], [2, 0], [0, 2], [0, 0]], dtype=float)]


@pytest.mark.parametrize(
    "a,b,want",
    [
        ([square(0, 0, 1, 1)], [square(0.5, 0.5, 1.5, 1.5)], 0.25),
        ([square(0, 0, 1, 1)], [square(1, 0, 2, 1)], 0.0),
        ([square(0, 0, 1, 1)], [square(1, 1, 2, 2)], 0.0),
        (HOLED, [square(1.5, 1.5, 2.5, 2.5)], 0.0),
        (HOLED, [square(0, 0, 4, 4)], 12.0),
        (L_SHAPE, [square(0, 0, 3, 3)], 5.0),
        (U_SHAPE, [square(0, 2, 5, 2.5)], 1.0),
        (DIAMOND, [square(-0.5, -0.5, 0.5, 0.5)], 2 * (np.sqrt(2) - 1)),
        (BOW_TIE, [square(0, 0, 2, 2)], 2.0),
    ],
)
def test_overlap_cases(a, b, want):
    assert K.polygon_overlap(a, b) == pytest.approx(want, abs=1e-12)
    assert K.polygon_overlap(b, a) == pytest.approx(want, abs=1e-12)
    reverse = [r[::-1] for r in a]
    assert K.polygon_overlap(reverse, b) == pytest.approx(want, abs=1e-12)


def test_far_from_origin_keeps_digits():
    shift = np.array([1.2e7, 3.4e6])
    a, b = [square(0, 0, 1, 1) + shift], [square(0.5, 0.5, 1.5, 1.5) + shift]
    assert K.polygon_overlap(a, b) == pytest.approx(0.25, abs=1e-8)


def test_clip_keeps_parts_apart():
    clipped = K.tidy_border(K.clip_rings(K.oriented(U_SHAPE), 0, 2, 5, 2.5), 0, 2, 5, 2.5)
    parts = K.rings_to_polygons(clipped)
    assert len(parts) == 2
    assert sorted(K.signed_area(p[0]) for p in parts) == pytest.approx([0.5, 0.5])


coordinate = st.floats(-50, 50).map(lambda v: round(v, 3))


@st.composite
def star(draw):
    n = draw(st.integers(3, 9))
    cx, cy = draw(coordinate), draw(coordinate)
    radii = [draw(st.floats(1, 20)) for _ in range(n)]
    angles = np.linspace(0, 2 * np.pi, n, endpoint=False)
    pts = np.column_stack([cx + radii * np.cos(angles), cy + radii * np.sin(angles)])
    return [np.vstack([pts, pts[:1]])]


def slab_area(a, b, n=4000):
    """Overlap by fine horizontal slices, as a check that shares nothing with the kernel."""
    ea, eb = K.ring_edges(a), K.ring_edges(b)
    lo, hi = min(ea[:, 1].min(), eb[:, 1].min()), max(ea[:, 1].max(), eb[:, 1].max())
    ys = lo + (np.arange(n) + 0.5) * (hi - lo) / n

    def spans(e, y):
        on = (e[:, 1] > y) != (e[:, 3] > y)
        x = np.sort(e[on, 0] + (y - e[on, 1]) * (e[on, 2] - e[on, 0]) / (e[on, 3] - e[on, 1]))
        return list(zip(x[0::2], x[1::2]))

    total = 0.0
    for y in ys:
        for p in spans(ea, y):
            for q in spans(eb, y):
                total += max(0.0, min(p[1], q[1]) - max(p[0], q[0]))
    return total * (hi - lo) / n


@settings(max_examples=25, deadline=None)
@given(star(), star())
def test_overlap_properties(a, b):
    ab = K.polygon_overlap(a, b)
    size_a, size_b = abs(K.signed_area(a[0])), abs(K.signed_area(b[0]))
    assert ab == pytest.approx(K.polygon_overlap(b, a), abs=1e-7)
    assert -1e-9 <= ab <= min(size_a, size_b) + 1e-7
    assert K.polygon_overlap(a, a) == pytest.approx(size_a, rel=1e-9)
    assert ab == pytest.approx(slab_area(a, b), abs=0.02 * max(1.0, min(size_a, size_b)))


@settings(max_examples=25, deadline=None)
@given(star(), st.sampled_from([1.7, 5.0, 13.0, 200.0]))
def test_fragments_sum_to_the_polygon(a, cell):
    total = 0.0
    for cx, cy, rings, box in K.cell_pieces(K.oriented(a), cell):
        assert box[0] >= cx * cell - 1e-9 and box[2] <= (cx + 1) * cell + 1e-9
        total += sum(K.signed_area(r) for r in rings) if rings else (box[2] - box[0]) * (box[3] - box[1])
    assert total == pytest.approx(abs(K.signed_area(a[0])), rel=1e-9)


def test_distance_and_squares():
    e, f = np.array([[0.0, 0, 1, 0]]), np.array([[3.0, 4, 3, 9]])
    assert K.segment_distance_sq(e, f)[0] == pytest.approx(20.0)
    crossing = np.array([[0.5, -1, 0.5, 1.0]])
    assert K.segment_distance_sq(e, crossing)[0] == 0
    hits = K.squares_touched(np.array([[0.5, 0.5], [0.5, 0.6], [5, 5]]), 0.5, 0.5, e)
    assert hits.tolist() == [True, False, False]


def test_simplify_keeps_corners():
    ring = np.array([[0, 0], [5, 0.5], [10, 0], [10, 10], [0, 10], [0, 0]], dtype=float)
    assert len(K.simplify_ring(ring, 1.0)) == 5
    assert len(K.simplify_ring(ring, 0.1)) == 6


def test_crossing_test_as_all_pairs_and_fast_on_long_outlines():
    import time

    rng = np.random.default_rng(4)
    for _ in range(200):
        ring = rng.integers(0, 8, size=(int(rng.integers(3, 9)), 2)).astype(float)
        edges = K.ring_edges([np.vstack([ring, ring[:1]])])

        def cross(ox, oy, ax, ay, bx, by):
            return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)

        want = any(
            cross(*a, *b[:2]) * cross(*a, *b[2:]) < 0 and cross(*b, *a[:2]) * cross(*b, *a[2:]) < 0
            for i, a in enumerate(edges) for b in edges[:i]
        )
        assert K.crosses_itself(edges) == want
    turn = np.linspace(0, 2 * np.pi, 200_001)
    radius = 1000 + 5 * np.sin(turn * 5000)
    coast = np.column_stack([radius * np.cos(turn), radius * np.sin(turn)])
    coast[-1] = coast[0]
    began = time.time()
    assert not K.crosses_itself(K.ring_edges([coast]))
    assert time.time() - began < 20


def wheel(n, radius, x, y=0.0, waves=0):
    t = np.linspace(0, 2 * np.pi, n + 1)
    r = radius * (1 + 0.2 * np.sin(waves * t))
    ring = np.column_stack([x + r * np.cos(t), y + r * np.sin(t)])
    ring[-1] = ring[0]
    return ring


def all_pairs(a, b):
    origin = np.minimum(a.reshape(-1, 2).min(axis=0), b.reshape(-1, 2).min(axis=0))
    shift = np.hstack([origin, origin])
    e, f = np.repeat(a, len(b), axis=0), np.tile(b, (len(a), 1))
    return max(K._overlap_terms(e - shift, f - shift).sum(), 0.0), K.segment_distance_sq(e, f).min()


def measured(a, b):
    area, square = K.pair_measures(a, np.array([0, len(a)]), b, np.array([0, len(b)]), True)
    return area[0], square[0]


@settings(max_examples=40, deadline=None)
@given(st.integers(70, 300), st.integers(70, 300), st.floats(0, 4), st.floats(-3, 3), st.integers(0, 9))
def test_swept_pairs_are_those_of_all_edges(n, m, x, y, waves):
    a, b = K.ring_edges([wheel(n, 1, 0, waves=waves)]), K.ring_edges([wheel(m, 0.7, x, y, waves)])
    assert len(a) * len(b) > K.SWEEP_FROM
    area, square = measured(a, b)
    want, near = all_pairs(a, b)
    assert area == pytest.approx(want, abs=1e-11)
    assert square == (0.0 if area > 0 else pytest.approx(near, rel=1e-12))


def test_pairs_of_all_sizes_keep_their_rows():
    shapes = [K.ring_edges([wheel(n, 1, x)]) for n, x in ((5, 0), (200, 0.5), (8, 1), (300, 5))]
    others = [K.ring_edges([wheel(n, 1, x)]) for n, x in ((6, 0.2), (90, 0), (7, 9), (80, 1))]
    off = [np.concatenate([[0], np.cumsum([len(s) for s in side])]) for side in (shapes, others)]
    area, square = K.pair_measures(np.concatenate(shapes), off[0], np.concatenate(others), off[1], True)
    for k in range(4):
        want, near = all_pairs(shapes[k], others[k])
        assert area[k] == pytest.approx(want, abs=1e-12)
        if want == 0:
            assert square[k] == pytest.approx(near, rel=1e-12)


def test_long_outlines_in_one_cell_take_seconds():
    import time

    n = 100_000
    a, b, far = (K.ring_edges([wheel(n, 1000.0, x)]) for x in (0.0, 1000.0, 2500.0))
    begin = time.time()
    area, _ = measured(a, b)
    apart, square = measured(a, far)
    assert area == pytest.approx(1e6 * (2 * np.pi / 3 - np.sqrt(3) / 2), rel=1e-6)
    assert apart == 0.0 and np.sqrt(square) == pytest.approx(500.0, rel=1e-6)
    assert time.time() - begin < 20


def test_trapezoids_of_a_star_wound_twice():
    """A pentagram's middle is wound twice, so it is outside by the even-odd rule."""
    t = np.pi / 2 + np.arange(6) * 4 * np.pi / 5
    star = np.column_stack([np.cos(t), np.sin(t)])
    star[-1] = star[0]
    parts = K.even_odd_trapezoids(K.ring_edges([star]))
    dent = np.cos(2 * np.pi / 5) / np.cos(np.pi / 5)
    whole, middle = 5 * dent * np.sin(np.pi / 5), 2.5 * dent * dent * np.sin(2 * np.pi / 5)
    assert sum(K.signed_area(p) for p in parts) == pytest.approx(whole - middle, abs=1e-9)
    wide = K.even_odd_trapezoids(K.ring_edges([wheel(3000, 1, 0, waves=3)]))
    assert sum(K.signed_area(p) for p in wide) == pytest.approx(K.signed_area(wheel(3000, 1, 0, waves=3)), rel=1e-9)
