"""Hulls as facet rows, held against the hull of all points at once and against known bodies."""

from __future__ import annotations

import numpy as np
import pytest

from pointloom.operators import hulls, spatial


def cloud_of(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, p array<double>").repartition(parts)


def rows(facets):
    return {tuple(r.vertices): r for r in facets.collect()}


@pytest.mark.parametrize("dim", [2, 3, 4])
def test_facets_of_a_gaussian_cloud(spark, dim):
    x = np.random.default_rng(dim).normal(size=(800, dim)) * 3 + 100
    h = spatial.convex_hull(x)
    got = rows(hulls.hull_facets(cloud_of(spark, x), dim, leaf=30))
    assert set(got) == {tuple(f) for f in h.facets()}
    m = hulls.hull_measures(hulls.hull_facets(cloud_of(spark, x), dim, leaf=30), dim).first()
    assert (m.area, m.volume) == pytest.approx((h.area(), h.volume()), rel=1e-9) and m.gap < 1e-9


def test_every_point_of_a_ball_is_a_corner(spark):
    x = np.random.default_rng(1).normal(size=(3000, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = hulls.hull_facets(cloud_of(spark, x), 3, leaf=60)
    got = rows(f)
    assert sum(len(v) - 2 for v in got) == 2 * len(x) - 4  # Euler: triangles; two of these lie in one plane to within 1e-7
    assert {i for v in got for i in v} == set(range(len(x)))
    n, d = np.array([r.n for r in got.values()]), np.array([r.d for r in got.values()])
    assert (x @ n.T + d).max() < 1e-9


def test_a_lattice_with_copies_has_the_corners_of_its_box(spark):
    x = np.array(list(np.ndindex(9, 9, 9)), float)
    x = np.vstack([x, x, np.tile(x[:1], (500, 1))])
    got = rows(hulls.hull_facets(cloud_of(spark, x, 7), 3, leaf=20))
    assert len(got) == 6 and all(len(v) == 4 and r.area == pytest.approx(64) and r.height == pytest.approx(4, abs=2) for v, r in got.items())
    assert {i for v in got for i in v} == {a * 81 + b * 9 + c for a in (0, 8) for b in (0, 8) for c in (0, 8)}  # the least id of each corner


def test_many_corners_in_one_plane(spark):
    a = np.linspace(0, 2 * np.pi, 300, endpoint=False)
    ring = np.column_stack([np.cos(a), np.sin(a), np.zeros(300)])
    got = rows(hulls.hull_facets(cloud_of(spark, np.vstack([ring, [[0, 0, 1.0]]])), 3, leaf=25))
    assert len(got) == 301 and sorted(map(len, got))[-1] == 300


def test_flat_empty_and_missing(spark):
    flat = np.column_stack([np.random.default_rng(2).normal(size=(50, 2)), np.ones(50)])
    assert hulls.hull_facets(cloud_of(spark, flat), 3).count() == 0
    assert hulls.hull_facets(cloud_of(spark, flat[:1]), 3).count() == 0
    assert hulls.hull_facets(spark.createDataFrame([], "id long, p array<double>"), 3).count() == 0
    square = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [float("nan"), 9.0]), (6, [9.0, None])]
    got = rows(hulls.hull_facets(spark.createDataFrame(square, "id long, p array<double>"), 2))
    assert set(got) == {(0, 1), (0, 2), (1, 3), (2, 3)}
    h, ids = hulls.hull_of(cloud_of(spark, np.random.default_rng(3).random((500, 3))), 3)
    assert sorted(h.vertices) == list(range(len(ids)))


def test_a_long_cloud_is_thinned_like_a_cube(spark, monkeypatch):
    """A bar 60 times as long as wide, and its facets' areas in the bar's own measure: few rows are kept, in few rounds."""
    x = np.random.default_rng(5).random((3000, 3)) * [1, 1, 60]
    seen, cut = [], hulls.cut
    monkeypatch.setattr(hulls, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    f = hulls.hull_facets(cloud_of(spark, x), 3)
    h = spatial.convex_hull(x)
    assert set(rows(f)) == {tuple(v) for v in h.facets()}
    m = hulls.hull_measures(f, 3).first()
    assert (m.area, m.volume) == pytest.approx((h.area(), h.volume()), rel=1e-9) and m.gap < 1e-9
    assert seen[0].count() < 2 * len(x)
