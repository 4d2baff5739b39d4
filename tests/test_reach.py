"""Sums, links and pairs within a radius, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import graph, neighbors, normals, reach


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    p = rng.integers(0, 40, (600, 2)) / 40  # many equal points, and gaps equal to the radius but for rounding
    p[:40] = p[40]
    return p


def cloud_of(spark, p):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(p)], "id long, p array<double>")


def near_of(p, radius):
    d = p[:, None, :] - p[None, :, :]
    return d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] < radius * radius


@pytest.mark.parametrize("radius", [0.05, 0.3, 3.0])
def test_sums_are_those_of_all_pairs(spark, points, radius, monkeypatch):
    monkeypatch.setattr(reach, "LEAF_ROWS", 60)
    near, cloud = near_of(points, radius), cloud_of(spark, points)
    got = {r.q: r.m for r in reach.radius_sums(cloud, cloud, radius, 2).collect()}
    gap = points[None, :, :] - points[:, None, :]
    want = np.stack([near.sum(1), *((near * gap[..., i]).sum(1) for i in (0, 1)), *((near * gap[..., i] * gap[..., j]).sum(1) for i, j in ((0, 0), (0, 1), (1, 1)))], 1)
    np.testing.assert_allclose(np.array([got[i] for i in range(len(points))]), want, atol=1e-9)


def test_points_that_are_not_finite_are_near_none(spark):
    cloud = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, float("nan")]), (2, [float("inf"), 0.0]), (3, None), (4, [-0.0, 0.01])], "id long, p array<double>")
    assert sorted((r.q, r.degree) for r in reach.radius_degrees(cloud, 0.02, 2, without_self=True).collect()) == [(0, 1), (4, 1)]
    assert sorted((r.id, r.comp) for r in reach.radius_components(cloud, 0.02, 2).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 0)]


@pytest.mark.parametrize("radius", [0.026, 0.05])
def test_components_are_those_of_the_edges(spark, points, radius, monkeypatch):
    monkeypatch.setattr(reach, "LEAF_ROWS", 60)
    cloud = cloud_of(spark, points[::2])
    want = {r.id: r.comp for r in graph.components(neighbors.radius_join(cloud, cloud, radius), cloud).collect()}
    found = reach.radius_components(cloud, radius, 2)
    assert {r.id: r.comp for r in found.collect()} == want
    seeds = cloud.where("id % 50 = 0")
    of = {want[r.id] for r in seeds.collect()}
    assert {r.id for r in graph.seeded(found, seeds).collect()} == {i for i, c in want.items() if c in of}


def test_covariance_of_equal_points_is_zero(spark):
    cloud = cloud_of(spark, np.array([[0.1, 0.7]] * 5 + [[5.3, 0.2]]))
    row = normals.radius_covariance(cloud, 0.3, 2).where("q = 0").first()
    assert (row["count"], row.s00, row.s01, row.s11) == (5, 0.0, 0.0, 0.0)


def test_no_cloud_is_broadcast(spark, points):
    cloud = cloud_of(spark, points)
    plan = neighbors.radius_join(cloud, cloud, 0.05)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_pairs_a_radius_apart_but_for_rounding_are_found(spark):
    p = np.array([[k / 50, 0.0] for k in range(200)])
    cloud, near = cloud_of(spark, p), near_of(p, 0.02)
    got = {(r.q, r.r) for r in neighbors.radius_join(cloud, cloud, 0.02).collect()}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_nearest_in_radius_as_by_all_edges(spark, points):
    cloud = cloud_of(spark, points)
    want = neighbors.top_k(neighbors.radius_join(cloud, cloud, 0.06), 3)
    got = neighbors.neighbors(cloud, cloud, neighbors.KNNInRadius(3, 0.06))
    cols = ["q", "r", "value", "rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_a_shift_of_many_points_needs_no_pairs(spark, points):
    from pointloom.operators import cluster

    cloud, near = cloud_of(spark, points), near_of(points, 0.1)
    shifted = cluster.shift_once(cloud, cloud, 0.1, dim=2)
    assert "Generate" not in shifted._jdf.queryExecution().executedPlan().toString()  # copies of rows for the cells around
    got = {r.id: r.p for r in shifted.collect()}
    np.testing.assert_allclose(np.array([got[i] for i in range(len(points))]), near @ points / near.sum(1)[:, None], atol=1e-9)


@pytest.mark.parametrize("wide", [1.0, 9.0])
def test_signed_angles_by_cells_as_by_all_blocks(spark, wide, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 30)
    rng = np.random.default_rng(3)
    p = np.stack([rng.random(500), rng.integers(-60, 60, 500) / 60 * wide + rng.integers(0, 3, 500) * 3e-10], 1)
    cloud, cols = cloud_of(spark, p), ["q", "r", "value", "rank"]
    got = neighbors.so2_knn(cloud, cloud, 4, 9)
    assert "(cell" in got._jdf.queryExecution().analyzed().toString()  # not all pairs of blocks
    want = neighbors.block_knn(cloud, cloud, 4, "so2", 9)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def of_pairs(df):
    """The plan's lines from the top to the join."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return "\n".join(lines[: 1 + next(i for i, line in enumerate(lines) if "Join Inner" in line)])


def test_equal_points_are_joined_once_and_predicates_are_compiled(spark, points, monkeypatch):
    monkeypatch.setattr(neighbors, "PAIR_LIST", 7)
    cloud, near = cloud_of(spark, points).withColumn("w", F.col("id") * 2), near_of(points, 0.06)
    got = neighbors.radius_join(cloud, cloud.withColumn("v", -F.col("id")), 0.06, keep=(["w"], ["v"]), shown=lambda v: F.round(v, 3))
    rows = got.collect()
    assert sorted((r.q, r.r) for r in rows) == list(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    gap = ((points[:, None] - points[None]) ** 2).sum(2)
    assert all(r.w == 2 * r.q and r.v == -r.r and abs(r.value - gap[r.q, r.r]) <= 0.0005 + 1e-12 for r in rows)
    assert "lambda" not in of_pairs(got) and of_pairs(got).count("Generate inline") == 2


@pytest.mark.parametrize("name", ["pair_points", "pair_points_normals", "pair_normals_unsigned", "pair_points_colors", "pair_all", "radius_l2"])
def test_pair_queries_interpret_no_lambdas_for_each_pair(spark, name):
    from pointloom.plans import queries

    assert "lambda" not in of_pairs(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("limit", [0.0, 5e-4, 0.4, 1.57, 2.5, 3.5, -0.4, -1.57, -2.0])
def test_the_cosine_decides_as_the_angle(spark, limit):
    from pointloom.functions import evaluators

    dots = [*np.cos(np.linspace(0, np.pi, 300)), 1.5, -1.5, float("nan"), 0.0, *(s * np.cos(abs(limit)) + d for s in (1, -1) for d in (-1e-9, -1e-16, 0, 1e-16, 1e-9))]
    df = spark.createDataFrame([(float(d), [float(d)], [1.0]) for d in dots], "d double, n1 array<double>, n2 array<double>")
    a = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("d"))))
    a = F.least(a, F.pi() - a) if limit < 0 else a
    for strict in (True, False):
        wrong = df.where(evaluators._angle_ok(limit, "n1", "n2", strict) != evaluators._angle_ok(limit, ["d"], [F.lit(1.0)], strict))
        want = a < abs(limit) if strict else a <= abs(limit)
        assert wrong.count() == 0 and df.where(evaluators._angle_ok(limit, ["d"], [F.lit(1.0)], strict) != want).count() == 0
