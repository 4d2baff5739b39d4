"""Fixtures with known answers, invariants, and the SQL oracles on the smallest tables."""

import glob
import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from pointloom.operators import cloud, cluster, eigen, engines, graph, neighbors, normals, ranks, ransac, registration, spatial, stats, warp
from pointloom.plans.queries import ORACLES, QUERIES
from pointloom.operators import pointcloud, rgbd
from pointloom.sources import files, matrix, ply
from tests import plain_warp

SF = "/root/testdata/sf0.001"
CUBE = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 1, 1], [1, 0, 1], [1, 1, 0], [1, 1, 1]], float)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, p array<double>")


def test_cube_neighbors(spark):
    q = spark.createDataFrame([(0, [0.1, 0.1, 0.4])], "id long, p array<double>")
    for find in (neighbors.knn, neighbors.block_knn):
        got = find(q, frame(spark, CUBE), 2).orderBy("rank").collect()
        assert [(r.r, round(r.value, 6)) for r in got] == [(0, 0.18), (3, 0.38)]
    with pytest.raises(ValueError):
        neighbors.knn(q, q, 0)


def test_box_axes(spark):
    m = stats.pca(frame(spark, CUBE * [1, 100, 1000]), 3)
    assert np.allclose(m.mean, [0.5, 50, 500]) and np.allclose(m.values, [285714.2857142857, 2857.142857142857, 0.2857142857142857])
    assert np.linalg.det(m.vectors) == pytest.approx(1)


def test_cube_hull_and_regions():
    h = spatial.convex_hull(np.vstack([CUBE, [[0.5, 0.5, 0.5]]]))
    assert len(h.vertices) == 8 and h.area() == pytest.approx(6) and h.volume() == pytest.approx(1) and len(h.facets()) == 6
    a, b = (spatial.Polytope.around(np.array([[u, v] for u in e for v in e], float)) for e in ((100, 200), (150, 250)))
    xor = spatial.Region([a, b]).minus(spatial.Region([a]).intersect(spatial.Region([b])))
    assert xor.volume() == pytest.approx(15000)
    half = spatial.Region([spatial.Polytope(np.array([[-1.0, 1.0, -70.0]]))])
    assert xor.intersect(half).volume() == pytest.approx(14100)
    assert xor.transform([[0.6, -0.8], [0.8, 0.6]], [3, 4]).volume() == pytest.approx(15000)
    assert spatial.Polytope.empty(2).is_empty() and not half.is_bounded()


def test_registration_recovers_a_move(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    r, _ = registration._rotation(np.array([0.02, -0.03, 0.05]))
    dst = frame(spark, x @ r.T + [0.01, -0.02, 0.005])
    rr, tt, _, ok = registration.Registration(dst, frame(spark, x), max_distance=0.05, max_iter=20).run()
    assert np.allclose(rr, r, atol=1e-3) and np.allclose(tt, [0.01, -0.02, 0.005], atol=1e-3)


def test_combined_metrics_recover_a_small_move(spark):
    rng = np.random.default_rng(2)
    for dim in (2, 3):
        s = rng.random((200, dim))
        n = rng.standard_normal((200, dim))
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        r, _ = registration._rotation(np.array([0.1]) if dim == 2 else np.array([0.02, -0.03, 0.05]))
        d = s @ r.T + 0.1
        rows = [(i, i, *([float(v) for v in y] for y in (d[i], s[i], n[i], n[i] @ r))) for i in range(200)]
        pairs = spark.createDataFrame(rows, "first long, second long, p1 array<double>, p2 array<double>, n1 array<double>, n2 array<double>")
        for options in ({}, {"w_point": 1.0}, {"symmetric": True}, {"rigid": False}):
            got = registration.estimate_combined(pairs, dim, max_iter=10, **options)
            assert np.allclose(got[0], r, atol=1e-5) and np.allclose(got[1], 0.1, atol=1e-5), (dim, options)


def test_ransac(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    x[:240, 2] = 0.5 + rng.uniform(-0.005, 0.005, 240)
    fit = ransac.fit_plane(frame(spark, x), 3, 0.01)
    assert abs(fit.model[0][2]) > 0.99 and fit.inliers >= 230


@pytest.mark.parametrize(("at", "size"), [(0.0, 1.0), (4.5e6, 1.0), (-3e7, 50.0), (0.0, 1e-4), (10.0, 1e7)])
def test_polytopes_at_any_place_and_scale(at, size):
    square = np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]]) * size + [at, at / 3]
    p = spatial.Polytope.around(square)
    assert not p.is_empty() and p.is_bounded() and np.isclose(p.volume(), size**2, rtol=1e-6)
    near = lambda v, w: np.allclose((sorted(map(tuple, v)) - np.array([at, at / 3])) / size, (sorted(map(tuple, w)) - np.array([at, at / 3])) / size, atol=1e-6)
    assert near(p.vertices(), square) and near([p.interior_point()], [square.mean(0)])
    q = spatial.Polytope.around(square + size / 2)
    both = spatial.Region([p, q])
    assert np.isclose(both.volume(), 1.75 * size**2, rtol=1e-6)
    assert np.isclose(both.minus(spatial.Region([p]).intersect(spatial.Region([q]))).volume(), 1.5 * size**2, rtol=1e-5)
    assert spatial.Region([p]).intersect(spatial.Region([spatial.Polytope.around(square + 3 * size)])).is_empty()
    more = spatial.Polytope(np.vstack([p.halfspaces, [1.0, 0.0, -(at + 2 * size)], [-1.0, -1.0, at + at / 3 - size]]))
    assert more.redundant().tolist() == [False] * 4 + [True, True] or not more.redundant()[5]
    assert more.redundant()[4]


def test_flat_and_endless_polytopes():
    line = spatial.Polytope.around(np.array([[0, 0, 0], [1, 1, 0], [3, 3, 0.0]]))
    assert not line.is_empty() and line.is_bounded() and line.volume() == 0
    assert np.allclose(sorted(map(tuple, line.vertices())), [[0, 0, 0], [3, 3, 0]])
    point = spatial.Polytope.around(np.array([[2.0, 5.0]]))
    assert np.allclose(point.vertices(), [[2, 5]]) and not point.is_empty()
    flat = spatial.Polytope.around(np.array([[0, 0, 7], [1, 0, 7], [0, 1, 7], [1, 1, 7.0]]))
    assert len(flat.vertices()) == 4 and np.allclose(flat.vertices()[:, 2], 7)
    wedge = spatial.Polytope(np.array([[-1.0, 0, 5], [0, -1.0, 6]]))
    assert not wedge.is_bounded() and np.allclose(wedge.vertices(), [[5, 6]]) and wedge.volume() == float("inf")
    slab = spatial.Polytope(np.array([[1.0, 0, -2], [-1.0, 0, 1]]))
    assert not slab.is_bounded() and not slab.is_empty() and len(slab.vertices()) == 0
    assert spatial.Polytope(np.array([[1.0, 0, 2], [-1.0, 0, 1]])).is_empty()
    rng = np.random.default_rng(21)
    for d in (2, 3, 4):
        x = rng.standard_normal((14, d)) + 1e5
        h, p = spatial.convex_hull(x), spatial.Polytope.around(x)
        assert len(p.vertices()) == len(h.vertices) and np.isclose(p.volume(), h.volume(), rtol=1e-4)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(4)
    e = rng.integers(0, 60, (40, 2))
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in e:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in e], "q long, r long")
    got = {r.id: r.comp for r in graph.components(edges, frame(spark, np.zeros((60, 1)))).collect()}
    assert got == {i: root(i) for i in range(60)}


def test_components_in_rounds(spark, monkeypatch):
    """Long paths, a hub and a random graph, without the single task that ends small graphs."""
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    rng = np.random.default_rng(14)
    path = rng.permutation(200)
    e = [(int(a), int(b)) for a, b in zip(path[:-1], path[1:])] + [(300, int(i)) for i in range(301, 340)] + [(int(a), int(b)) for a, b in rng.integers(400, 600, (150, 2))]
    ids, root = graph.least_reached(*np.array(e).T)
    got = {r.id: r.comp for r in graph.linked_ids(spark.createDataFrame(e, "q long, r long").repartition(4)).collect()}
    linked = {i for a, b in e if a != b for i in (a, b)}
    assert got == {int(i): int(c) for i, c in zip(ids, root) if i in linked}
    assert {got[i] for i in range(200)} == {0} and {got[i] for i in range(300, 340)} == {300}
    assert graph.linked_ids(spark.createDataFrame([], "q long, r long")).count() == 0


def test_mean_shift_with_a_lonely_seed(spark):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0, 0.05, (60, 2)), rng.normal(1, 0.05, (60, 2))])
    cloud = frame(spark, x)
    got = {r.id: (r.cluster, r.mode) for r in cluster.mean_shift(cloud, cloud, 0.4, 0.2, dim=2).collect()}
    modes = np.array([next(m for c, m in got.values() if c == k) for k in range(2)])
    assert {c for c, _ in got.values()} == {0, 1} and np.allclose(sorted(modes[:, 0]), [0, 1], atol=0.05)
    far = frame(spark, np.concatenate([x, [[50.0, 50.0]]]))
    again = {r.id: (r.cluster, r.mode) for r in cluster.mean_shift(far, cloud, 0.4, 0.2, dim=2).collect()}
    assert again.pop(120) == (2, [50.0, 50.0]) and {k: v[0] for k, v in again.items()} == {k: v[0] for k, v in got.items()}
    # points beyond the kernel's reach have no weight
    near = cluster.mean_shift(cloud, cloud, 0.4, 0.2, dim=2, kernel=F.when(F.col("value") < 0.01, 1.0).otherwise(0.0)).select("cluster").distinct().count()
    assert near >= 2


@pytest.mark.parametrize("dim", [2, 4])
def test_modes_equal_the_loop_in_order(spark, dim):
    """Chains of seeds, many at one place, and ties of distance, against taking them one by one."""
    rng = np.random.default_rng(16)
    x = np.concatenate([np.arange(80)[:, None] * np.eye(dim)[:1] * 0.6, rng.random((300, dim)) * 4, np.full((200, dim), 2.5)])
    x = np.round(x[rng.permutation(len(x))], 2)
    modes, want = [], {}
    for i, p in enumerate(x):
        first = next((m for m in modes if ((x[m] - p) ** 2).sum() < 1.0), None)
        want[i] = i if first is None else first
        modes += [i] if first is None else []
    assert {r.id: r.first for r in cluster.greedy_modes(frame(spark, x), 1.0, dim).collect()} == want


def test_kmeans_repairs_two_empty_clusters(spark):
    x = np.array([[0.0, 0], [0, 1], [1, 0], [1, 1], [8, 8], [9, 9], [20, 20.0]])
    start = np.array([[0.5, 0.5], [500, 500], [600, 600.0]])
    centroids, labels, _ = cluster.kmeans(frame(spark, x), start, max_iter=1)
    # the largest cluster loses its farthest point twice, in turn
    assert np.allclose(centroids, [[2, 2], [20, 20], [9, 9]])
    assert labels.select("cluster").distinct().count() == 3


def test_colormaps(spark):
    v = [0.0, 0.1, 0.3, 0.5, 0.6, 0.7, 0.9, 1.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v double")
    color = lambda kind, **k: [(round(r.r, 6), round(r.g, 6), round(r.b, 6)) for r in cloud.colormap(df, "v", kind, **k).orderBy("id").collect()]
    assert color("jet")[4] == (0.9, 1.0, 0.1) and color("jet")[0] == (0.0, 0.0, 0.5) and color("jet")[7] == (0.5, 0.0, 0.0)
    assert color("blue2red") == [(0, 0, 1), (0.2, 0.2, 1), (0.6, 0.6, 1), (1, 1, 1), (1, 0.8, 0.8), (1, 0.6, 0.6), (1, 0.2, 0.2), (1, 0, 0)]
    assert color("gray", low=0.5, high=0.9)[3:6] == [(0, 0, 0), (0.25,) * 3, (0.5,) * 3] and color("gray", low=0.5, high=0.9)[7] == (1, 1, 1)
    df = df.union(spark.createDataFrame([(8, float("inf"))], "id long, v double"))
    assert set(color("jet")) == {(0, 0, 0)} and set(color("gray", low=0.0)) == {(0, 0, 0)} and color("gray", high=1.0)[4] == (0.6,) * 3


def test_nearest_rotations(spark):
    m = np.random.default_rng(16).standard_normal((5, 3, 3))
    df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(m)], "id long, r array<double>")
    for row in cloud.rigid_transforms(df, 3).collect():
        r = np.array(row.r).reshape(3, 3)
        assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) > 0 and np.allclose(r, cloud.nearest_rotation(m[row.id]))


def test_ring_scaling_and_gap(spark):
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    x = np.stack([np.cos(t), np.sin(t)], 1)
    d = ((x[:, None] - x) ** 2).sum(2)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(40) for j in range(40)], "i long, j long, d2 double")
    values, _ = cluster.scaling(pairs, 40, 3)
    assert np.allclose(values, [20, 20, 0], atol=1e-8)
    assert cluster.eigengap(np.array([0, 0, 0, 0.9, 1.0])) == 3


def surface(n, seed=17):
    """A wavy surface with its normals."""
    rng = np.random.default_rng(seed)
    u, v = rng.uniform(-1, 1, (2, n))
    p = np.column_stack([u, v, 3 + 0.2 * np.sin(3 * u) + 0.2 * np.cos(2 * v)])
    g = np.column_stack([-0.6 * np.cos(3 * u), 0.4 * np.sin(2 * v), np.ones(n)])
    return p, -g / np.linalg.norm(g, axis=1, keepdims=True)


def with_normals(spark, p, n):
    return spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(p, n))], "id long, p array<double>, n array<double>")


def test_registration_instances(spark):
    """Every ready-made instance recovers a small move, with engines of each kind."""
    p, n = surface(300)
    r, _ = registration._rotation(np.array([0.01, -0.008, 0.012]))
    t = np.array([0.01, -0.012, 0.008])
    dst, src = with_normals(spark, p, n).cache(), with_normals(spark, (p - t) @ r, n @ r).cache()
    near = engines.NearestEngine(0.02)
    given = engines.GivenEngine(spark.createDataFrame([(i, i, 0.0) for i in range(300)], "first long, second long, value double"))
    both = engines.NearestEngine(0.02, "both", reciprocal=True, one_to_one=True, search=engines.FeatureAdaptor(0.1), evaluate=engines.FeatureAdaptor())
    found = {
        "given": engines.point_icp(dst, src, given, max_iter=1).run(),
        "affine": engines.point_icp(dst, src, given, rigid=False, max_iter=1).run(),
        "both ways": engines.combined_icp(dst, src, both, max_iter=2, w_point=0.1).run(),
        "two engines": engines.combined_icp(dst, src, engines.CombinedMetric(given, near), max_iter=2, w_point=0.1).run(),
        "one engine": engines.combined_icp(dst, src, engines.CombinedMetric(given), max_iter=2, w_point=0.1).run(),
        "symmetric": engines.symmetric_icp(dst, src, given, max_iter=2).run(),
    }
    for name, (a, b, _, _) in found.items():
        assert np.allclose(a, r, atol=2e-3) and np.allclose(b, t, atol=3e-3), name
    # a fine grid of pixels: each point has its own
    k = np.array([[3000.0, 0, 1500], [0, 3000.0, 1500], [0, 0, 1]])
    coarse = np.array([[60.0, 0, 30], [0, 60.0, 30], [0, 0, 1]])
    for metric in ("combined", "symmetric"):
        a, b, _, _ = engines.projective_icp(dst, src, coarse, 61, 61, metric, limit=0.02, max_iter=3, w_point=0.05).run()
        assert np.allclose(a, r, atol=2e-2) and np.allclose(b, t, atol=2e-2), metric
    seen = engines.ProjectiveEngine(k, 3001, 3001, 1e-9).find(dst, dst, np.eye(3), np.zeros(3))
    assert seen.where("first <> second").count() == 0 and seen.count() > 280


def test_transform_ransac_and_protocol(spark):
    rng = np.random.default_rng(18)
    s = rng.uniform(-1, 1, (300, 3))
    r, _ = registration._rotation(np.array([0.3, -0.5, 0.2]))
    d = s @ r.T + [1, 2, 3]
    d[100:] = rng.uniform(-3, 3, (200, 3))
    pairs = spark.createDataFrame([(i, i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(d, s))], "first long, second long, p1 array<double>, p2 array<double>").cache()
    fit = ransac.fit_transform(pairs, 3, True, 0.01, 300, 95)
    assert np.allclose(fit.model[0], r, atol=1e-6) and np.allclose(fit.model[1], [1, 2, 3], atol=1e-6) and 100 <= fit.inliers <= 101
    fit = ransac.fit_transform(pairs.where("first < 130"), 3, False, 0.01, 100, 95)
    assert np.allclose(fit.model[0], r, atol=1e-6)

    class Level:
        """A height that most points have."""

        sample_size = 1

        def fit(self, rows):
            return (rows[0]["p1"][2],)

        def residual(self, m):
            from pyspark.sql import functions as F

            return F.abs(F.col("p1")[2] - m[0])

        def refit(self, inliers):
            from pyspark.sql import functions as F

            return (inliers.agg(F.avg(F.col("p1")[2])).first()[0],)

    flat = spark.createDataFrame([(i, [float(i), 0.0, 5.0 + (i % 3) * 0.001 if i % 4 else float(i)]) for i in range(200)], "id long, p1 array<double>")
    got = engines.ransac_fit(flat, Level(), ["p1"], 0.01, 20)
    assert abs(got.model[0] - 5.001) < 1e-3 and got.inliers >= 150


def test_samples_come_from_all_rows(spark):
    df = spark.range(20000)
    rows = [r[0] for seed in range(3) for r in ransac.draw(df, ["id"], 100, seed)]
    assert len(set(rows)) > 0.9 * len(rows) and 250 < len(rows) / 3 < 600 and min(rows) < 400 and max(rows) > 19600


def node_transforms(field):
    rows = field.transforms(field.run()[0]).orderBy("id").collect()
    return np.array([r.r for r in rows]).reshape(len(rows), field.dim, field.dim), np.array([r.t for r in rows])


@pytest.mark.parametrize("most", [50_000, 0])
def test_solvers_of_block_systems(spark, most):
    """Against a dense solver: some nodes without a block, several rows of one place."""
    rng = np.random.default_rng(19)
    a = rng.standard_normal((36, 36))
    a = a @ a.T + 5 * np.eye(36)
    v = rng.standard_normal((12, 3))
    rows = [(5 * i, 5 * j, (a[3 * i : 3 * i + 3, 3 * j : 3 * j + 3] / 2).ravel().tolist()) for i in range(12) for j in range(12)] * 2
    matrix = spark.createDataFrame(rows, "row long, col long, h array<double>")
    rhs = spark.createDataFrame([(5 * i, x.tolist()) for i, x in enumerate(v)] + [(999, [0.0] * 3)], "id long, v array<double>")
    got = {r.id: r.x for r in (warp.solve_at_once if most else warp.solve_blocks)(matrix, rhs, 3, tol=1e-9).collect()}
    want = np.linalg.solve(a, v.ravel()).reshape(12, 3)
    assert got.pop(999) == [0.0] * 3 and np.allclose([got[5 * i] for i in range(12)], want, atol=1e-7)


@pytest.mark.parametrize("solve", [warp.solve_at_once, warp.solve_blocks])
def test_few_steps_solve_fields_far_from_the_origin(spark, solve):
    """Where turns of a node are nearly its shifts: as many steps as elsewhere."""
    rng = np.random.default_rng(21)
    a = np.zeros((24, 24))
    for node in range(4):
        p = rng.random((30, 3)) + [0, 0, 200]
        _, slopes = warp.moved_and_slopes(np.zeros((30, 6)), p, "rigid")
        a[6 * node : 6 * node + 6, 6 * node : 6 * node + 6] = np.einsum("nds,ndt->st", slopes, slopes)
    tie = np.kron(np.array([[1, -1], [-1, 1]]), np.eye(6)) * 1e-4
    for node in range(3):
        a[6 * node : 6 * node + 12, 6 * node : 6 * node + 12] += tie
    want = rng.standard_normal(24)
    matrix = spark.createDataFrame([(i, j, a[6 * i : 6 * i + 6, 6 * j : 6 * j + 6].ravel().tolist()) for i in range(4) for j in range(4)], "row long, col long, h array<double>")
    rhs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate((a @ want).reshape(4, 6))], "id long, v array<double>")
    gap = np.concatenate([r.x for r in solve(matrix, rhs, 6, max_iter=6).orderBy("id").collect()]) - want
    assert gap @ a @ gap < 1e-9 * (want @ a @ want) and np.abs(gap).max() < 1  # 248 by the diagonal alone


def test_fields_beyond_one_solve(spark, monkeypatch):
    """More unknowns than one solve takes: the vectors stay in Spark, the field is the same."""
    p = np.random.default_rng(20).random((8, 2))
    dst, n = p + 0.02 * p**2, np.tile([0.6, 0.8], (8, 1))
    ties = spark.createDataFrame([(i, (i + 1) % 8, 1.0) for i in range(8)], "q long, r long, weight double")
    match = engines.GivenEngine(spark.createDataFrame([(i, i, 0.0) for i in range(8)], "first long, second long, value double"))
    field = engines.dense_warp_icp(with_normals(spark, dst, n), with_normals(spark, p, n), ties, match, dim=2, w_point=0.5, w_plane=1.0, max_iter=1, steps=1)
    r0, t0 = node_transforms(field)
    monkeypatch.setattr(warp, "ONE_SOLVE", 10)
    monkeypatch.setattr(warp, "solve_at_once", None)
    r1, t1 = node_transforms(field)
    assert np.allclose(r0, r1, atol=1e-4) and np.allclose(t0, t1, atol=1e-4) and np.abs(t1).max() > 1e-3


def test_warp_fields_on_frames(spark):
    p, n = surface(120)
    same = with_normals(spark, p, n)
    nodes = spark.createDataFrame([(j, p[i].tolist()) for j, i in enumerate(range(0, 120, 8))], "id long, p array<double>")
    edges, arcs = engines.control_edges(same, nodes, 4), engines.stiffness_arcs(nodes, 4)
    given = engines.GivenEngine(spark.createDataFrame([(i, i, 0.0) for i in range(120)], "first long, second long, value double"))
    field = engines.sparse_warp_icp(same, same, edges, arcs, given, w_point=1.0, max_iter=1, steps=1)
    x, _, done = field.run()
    assert done and np.allclose([r.x for r in x.collect()], 0, atol=1e-6)
    bend = p + np.column_stack([0 * p[:, 0], 0 * p[:, 0], 0.05 * p[:, 0] ** 2])
    field = engines.sparse_warp_icp(with_normals(spark, bend, n), same, edges, arcs, given, w_point=1.0, w_plane=0.0, stiffness=1e-4, max_iter=1, steps=3)
    got = {r.id: np.array(r.p) for r in field.moved(field.run()[0]).collect()}
    assert sum(((got[i] - bend[i]) ** 2).sum() for i in range(120)) < 0.2 * ((bend - p) ** 2).sum()
    # the same equations as the plain solver
    src, dst = p[:40], bend[:40]
    own = [([i], [1.0]) for i in range(40)]
    d = ((src[:, None] - src) ** 2).sum(2)
    pairs = [(i, int(j), 1.0) for i in range(40) for j in np.argsort(d[i])[1:4]]
    r0, t0 = plain_warp.estimate_warp(src, dst, n[:40], [(i, i) for i in range(40)], own, pairs, 40, w_point=0.5, w_plane=1.0, max_iter=1)
    ties = spark.createDataFrame(pairs, "q long, r long, weight double")
    a, b = with_normals(spark, dst, n[:40]), with_normals(spark, src, n[:40])
    field = engines.dense_warp_icp(a, b, ties, engines.GivenEngine(given.pairs.where("first < 40")), w_point=0.5, w_plane=1.0, max_iter=1, steps=1)
    r1, t1 = node_transforms(field)
    assert np.allclose(r0, r1, atol=1e-4) and np.allclose(t0, t1, atol=1e-4)
    # affine fields and the plane, one step each
    for kind, dim in (("affine", 3), ("rigid", 2), ("affine", 2)):
        s2, d2, n2 = src[:20, :dim], dst[:20, :dim] + 0.01, n[:20, :dim]
        few = [q for q in pairs if max(q[:2]) < 20]
        r0, t0 = plain_warp.estimate_warp(s2, d2, n2, [(i, i) for i in range(20)], own[:20], few, 20, kind, w_point=0.5, w_plane=1.0, max_iter=1)
        match = engines.GivenEngine(given.pairs.where("first < 20"))
        field = engines.dense_warp_icp(with_normals(spark, d2, n2), with_normals(spark, s2, n2), spark.createDataFrame(few, "q long, r long, weight double"), match, dim=dim, kind=kind, w_point=0.5, w_plane=1.0, max_iter=1, steps=1)
        r1, t1 = node_transforms(field)
        assert np.allclose(r0, r1, atol=1e-3) and np.allclose(t0, t1, atol=1e-3), (kind, dim)


def test_cloud_of_images_and_fusion(spark):
    k = np.array([[40.0, 0, 20], [0, 40.0, 15], [0, 0, 1]])
    pixels = spark.createDataFrame([(y, x, int(1000 + 3 * x + 2 * y), 10, 20, 30) for y in range(30) for x in range(40)], "y int, x int, depth int, r int, g int, b int")
    c = pointcloud.PointCloud.from_rgbd_images(pixels, k, with_normals=True)
    assert c.has("n") and c.has("c") and c.df.count() == 28 * 38
    assert pointcloud.PointCloud.from_depth_image(pixels, k).df.count() == 1200
    plain = pointcloud.PointCloud(c.df.select("id", "p"))
    n = {r.id: np.array(r.n) for r in plain.estimate_normals_knn(8).df.collect()}
    given = {r.id: np.array(r.n) for r in c.df.collect()}
    assert np.mean([abs(n[i] @ given[i]) > 0.99 for i in given]) > 0.95
    kept = {r.id: np.array(r.n) for r in c.estimate_normals_radius(0.1, use_current=True).df.collect()}
    assert all(kept[i] @ given[i] > 0 for i in kept if np.isfinite(kept[i]).all())
    model = pointcloud.Fusion(None, k, 40, 30, limit=1e-3)
    model.add(c.df)
    first = model.model.count()
    r, t = model.add(c.df, 2)
    assert np.allclose(r, np.eye(3), atol=1e-6) and np.allclose(t, 0, atol=1e-6)
    assert model.model.count() == first and model.model.where("confidence = 2").count() > 0.9 * first
    with pointcloud.Timer() as timer:
        pass
    assert timer.stop() >= 0 and pointcloud.random_ids(c.df, 5, 1).count() == 5


def test_robust_normals(spark):
    rng = np.random.default_rng(19)
    x = np.column_stack([rng.random((80, 2)), np.zeros(80)])
    x[:10, 2] = rng.uniform(0.05, 0.12, 10)
    df = frame(spark, x)
    plain = {r.id: r.n for r in normals.normals(df, neighbors.KNN(12), viewpoint=[0, 0, 5]).collect()}
    robust = {r.id: r.n for r in normals.normals(df, neighbors.KNN(12), viewpoint=[0, 0, 5], covariance={"trials": 6, "steps": 3, "chi2": 6.25}).collect()}
    good = lambda n: sum(abs(n[i][2]) > 0.999 for i in range(10, 80))
    assert good(robust) > good(plain) + 8 and good(robust) > 50


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.random((100, 2)), np.zeros(100)])
    got = normals.normals(frame(spark, x), neighbors.KNN(7), viewpoint=[0, 0, 5]).collect()
    assert all(np.allclose(r.n, [0, 0, 1], atol=1e-6) and r.curvature < 1e-9 for r in got)


def test_mcd_ignores_outliers():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 2)) * 0.1
    x[:6] += 50
    m, _, _ = stats.mcd(x, seed=1)
    assert np.abs(m).max() < 0.2


def test_warp_identity_and_bend():
    rng = np.random.default_rng(7)
    x = rng.random((30, 3))
    own = [([i], [1.0]) for i in range(30)]
    d = ((x[:, None] - x) ** 2).sum(2)
    arcs = [(i, j, 1.0) for i in range(30) for j in np.argsort(d[i])[1:5]]
    r, t = plain_warp.estimate_warp(x, x, None, [(i, i) for i in range(30)], own, arcs, 30, w_point=1.0, w_plane=0.0)
    assert np.allclose(r, np.eye(3), atol=1e-6) and np.allclose(t, 0, atol=1e-6)
    y = x + 0.05 * x[:, :1] ** 2
    r, t = plain_warp.estimate_warp(x, y, None, [(i, i) for i in range(30)], own, arcs, 30, w_point=1.0, w_plane=0.0, stiffness=1e-3)
    assert np.abs(np.einsum("nij,nj->ni", r, x) + t - y).max() < 0.01


def test_ply_round_trip(spark, tmp_path):
    df = frame(spark, CUBE).withColumn("n", cloud.F.array(*[cloud.F.lit(0.5)] * 3)).withColumn("c", cloud.F.array(*[cloud.F.lit(1.0).cast("float")] * 3))
    for i, options in enumerate(({"binary": False}, {}, {"big_endian": True})):
        path = str(tmp_path / f"{i}.ply")
        ply.write_cloud(df, path, **options)
        got = ply.read_cloud(spark, path).orderBy("id").collect()
        assert [r.p for r in got] == CUBE.tolist() and got[0].c == [1.0] * 3 and got[0].n == [0.5] * 3


def test_spectral_and_scaling_cover_all_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(12)
    centers = rng.standard_normal((3, 64)) * 20
    x = np.array([centers[i % 3] + 0.05 * rng.standard_normal(64) for i in range(270)])
    spark.createDataFrame([(i + 7, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for most in (96,):  # restarts: see test_eigenpairs_with_repeats
        monkeypatch.setattr(eigen, "MOST_VECTORS", most)
        got = {r.id: r.cluster for r in QUERIES["spectral"](spark, str(tmp_path)).collect()}
        assert sorted(got) == list(range(7, 277)) and len({(i % 3, got[i + 7]) for i in range(270)}) == len(set(got.values())) == 3
    got = {r.id: (r.x, r.y) for r in QUERIES["mds"](spark, str(tmp_path)).collect()}
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    j = np.eye(270) - 1 / 270
    values, vectors = np.linalg.eigh(-0.5 * j @ d2 @ j)
    want = vectors[:, -2:] * np.sqrt(values[-2:])
    mine = np.array([got[i + 7] for i in range(270)])
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-6 * values[-1])
    assert np.allclose(cluster.scaling_of_points(frame(spark, x), 64, 2)[0], values[:-3:-1])


def test_searches_and_modes_cover_all_parts(spark, tmp_path):
    rng = np.random.default_rng(14)
    size, price = rng.integers(1, 51, 70), 900 + rng.integers(0, 800, 70) / 8
    spark.createDataFrame([(i + 1, int(a), float(b)) for i, (a, b) in enumerate(zip(size, price))], "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    x = np.stack([size / 50, (price - 900) / 100], 1)
    gap = x[None] - x[:, None]
    for name, v, k in (("knn_so2_all", np.round(gap[:, :, 1], 9), 4), ("knn_grid_all", (gap**2).sum(2), 6)):
        got = {(r.q, r["rank"]): r.value for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert len(got) == 70 * k
        assert all(abs(got[i + 1, n] - w) < 1e-8 for i in range(70) for n, w in enumerate(np.sort(v[i])[:k]))
    got = {r.id: (r.m0, r.m1) for r in QUERIES["meanshift_modes"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(1, 71))


def test_icp_takes_all_orders(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(registration.Registration, "run", lambda self: seen.extend((self.dst.count(), self.src.count())) or (np.eye(3), np.zeros(3), 1, True))
    QUERIES["icp_point"](spark, SF)
    assert seen == [spark.read.parquet(f"{SF}/orders.parquet").count()] * 2


@pytest.mark.parametrize("most", [96, 20])
def test_eigenpairs_with_repeats(spark, most):
    """Against a dense solver: repeated values, a node without entries, any ids, with and without restarts."""
    a = np.diag([1.0, 1, 1, *np.linspace(-0.9, 0.7, 57)])
    u = np.linalg.qr(np.random.default_rng(13).standard_normal((60, 60)))[0]
    a = u @ a @ u.T
    entries = spark.createDataFrame([(7 * i, 7 * j, float(a[i, j])) for i in range(60) for j in range(60)], "row long, col long, value double")
    nodes = spark.createDataFrame([(7 * i,) for i in range(61)], "id long")
    values, vectors = eigen.largest_pairs(entries, nodes, 4, most=most)
    assert np.allclose(values, [1, 1, 1, 0.7], atol=1e-9)
    x = np.array([r.x for r in vectors.orderBy("id").collect()])
    assert np.allclose(x.T @ x, np.eye(4), atol=1e-9) and np.allclose(x[60], 0) and np.allclose(a @ x[:60], x[:60] * values, atol=1e-6)
    assert eigen.residuals(entries, vectors, values).where("residual > 1e-6").count() == 0


def test_eigenpairs_leave_no_history_on_disk(spark):
    """However many steps, the tables of vectors on disk are two, beside the entries, the nodes and the result."""
    a = np.linalg.qr(np.random.default_rng(13).standard_normal((60, 60)))[0]
    a = a @ np.diag(np.linspace(-0.9, 0.99, 60)) @ a.T
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(60) for j in range(60)], "row long, col long, value double")
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    under = lambda: {p for p in glob.glob(f"{folder.removeprefix('file:')}/**/*", recursive=True) if glob.glob(f"{p}/part-*")}
    before = under()
    values, _ = eigen.largest_pairs(entries, spark.createDataFrame([(i,) for i in range(60)], "id long"), 2, most=16)
    assert np.allclose(values, np.linspace(-0.9, 0.99, 60)[:-3:-1], atol=1e-9) and len(under() - before) <= 5


def test_a_laplacian_reads_its_graph_from_a_table(spark):
    edges = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0), (1, 2, 1.0), (2, 1, 1.0)], "row long, col long, value double")
    asked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    matrix, degree = cluster.laplacian(edges.mapInArrow(counted, edges.schema))
    for _ in range(2):
        got = {(r.row, r.col): r.value for r in matrix.collect()}
        assert degree.count() == 3
    assert got[0, 1] == got[1, 0] == pytest.approx(2 / 6**0.5) and asked.value == 4


@pytest.mark.parametrize("kind", ["unnormalized", "normalized_symmetric", "normalized_random_walk"])
def test_laplacian_embeddings(spark, kind):
    rng = np.random.default_rng(17)
    a = np.triu(rng.random((30, 30)) * (rng.random((30, 30)) < 0.3), 1)
    a = a + a.T
    deg = a.sum(0)
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(30) if a[i, j]], "row long, col long, value double")
    values, points = cluster.laplacian_embedding(entries, spark.range(30), 3, kind)
    s = np.diag(1 / np.sqrt(deg))
    want, vectors = np.linalg.eigh(np.diag(deg) - a if kind == "unnormalized" else np.eye(30) - s @ a @ s)
    assert np.allclose(values, want[:3], atol=1e-8)
    x = np.array([r.p for r in points.orderBy("id").collect()])
    if kind == "normalized_symmetric":
        assert np.allclose((x**2).sum(1), 1)
    else:
        v = vectors[:, :3] if kind == "unnormalized" else s @ vectors[:, :3]
        assert np.allclose(np.abs(x), np.abs(v), atol=1e-5)


def test_ranks_need_no_single_task(spark):
    """Places in the whole and within groups, of which one holds most rows; no exchange goes to one partition."""
    rows = [(int(g), int(v), i) for i, (g, v) in enumerate(zip([0] * 900 + list(range(100)), np.random.default_rng(18).integers(0, 20, 1000)))]
    df = spark.createDataFrame(rows, "g int, v int, id int").repartition(7)
    got = ranks.ranked(df, ["g", F.desc("v"), "id"], "at")
    want = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    assert [(r.g, r.v, r.id) for r in got.orderBy("at").collect()] == want and [r[0] for r in got.select("at").orderBy("at").collect()] == list(range(1000))
    inside = ranks.ranked(df, ["g", F.desc("v"), "id"], "at", groups=["g"]).collect()
    assert all(r.at == [w for w in want if w[0] == r.g].index((r.g, r.v, r.id)) for r in inside[::50])
    assert [r.id for r in ranks.first_rows(df, ["v", "id"], 10).orderBy("v", "id").collect()] == [r[2] for r in sorted(rows, key=lambda r: (r[1], r[2]))[:10]]
    assert ranks.ranked(df.where("false"), ["g"]).count() == 0
    labels = spark.createDataFrame([(i, i % 40) for i in range(300)], "id long, comp long")
    for found in (graph.segments(labels), cloud.rank_fraction(df, ["v", "id"], 0.3)):
        assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_file_helpers(tmp_path):
    path = str(tmp_path / "raw")
    assert not files.exists(path) and files.file_size(path) is None
    files.write_raw(path, b"one\ntwo\nthree")
    assert files.file_size(path) == 13 and files.read_raw(path, 4, 3) == b"two" and files.read_raw("file://" + path) == b"one\ntwo\nthree"
    assert list(files.lines(path)) == [b"one", b"two", b"three"]


def test_ply_by_ranges(spark, tmp_path, monkeypatch):
    """Many partitions written to one file; rows read by ranges; refusal to overwrite."""
    df = spark.range(1000).selectExpr("id", "array(cast(id as double), 2.0, 3.0) as p").repartition(5)
    path = "file://" + str(tmp_path / "big.ply")
    ply.write_cloud(df, path)
    monkeypatch.setattr(ply, "ROWS", 150)
    got = ply.read_cloud(spark, path).orderBy("id").collect()
    assert [r.p[0] for r in got] == [float(i) for i in range(1000)]
    assert sorted(os.listdir(tmp_path)) == ["big.ply"]
    with pytest.raises(Exception, match="big.ply"):
        df.selectExpr("p[0] as x").write.format("ply").mode("append").save(path)


def test_matrix_round_trip(spark, tmp_path):
    m = np.arange(1, 13, dtype=float).reshape(3, 4)
    for binary, read in ((True, matrix.read_binary), (False, matrix.read_ascii)):
        path = str(tmp_path / f"m{binary}")
        matrix.write(m, path, binary)
        got = {(r.row, r.col): r.value for r in read(spark, path).collect()}
        assert got == {(i, j): m[i, j] for i in range(3) for j in range(4)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    """Rows, column names and values of every query with SQL."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    mine, other = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    cols = sorted(mine.columns)
    text = lambda df: sorted(tuple(f"{v:.7g}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert text(mine) == text(other)
