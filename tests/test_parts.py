"""Parts that only other operators used so far: filters, transform sets, casts, labels, depth options, protocols."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import evaluators
from pointloom.operators import cloud, cluster, correspond, graph, grid, neighbors, registration, rgbd, spatial
from pointloom.streaming import voxels

NAN = float("nan")


def turned(a):
    return [[np.cos(a), -np.sin(a), 0.0], [np.sin(a), np.cos(a), 0.0], [0.0, 0.0, 1.0]]


@pytest.fixture(scope="module")
def full(spark):
    rows = [(0, [1.0, 2.0, 3.0], [0.0, 0.0, 1.0], [0.1, 0.2, 0.3]), (1, [NAN, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0] * 3), (2, [0.0] * 3, [NAN, 0.0, 0.0], [0.0] * 3), (3, [4.0, 0.0, 0.0], [0.0, 1.0, 0.0], [float("inf"), 0.0, 0.0])]
    return spark.createDataFrame(rows, "id long, p array<double>, n array<double>, c array<float>")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_invalid_attributes(full):
    assert ids(cloud.remove_invalid(full, ("p",))) == [0, 2, 3]
    assert ids(cloud.remove_invalid(full, ("n",))) == [0, 1, 3]
    assert ids(cloud.remove_invalid(full, ("c",))) == [0, 1, 2]
    assert ids(cloud.remove_invalid(full)) == [0]
    assert ids(cloud.remove_invalid(full.drop("n", "c"))) == [0, 2, 3]


def test_cast(full):
    out = cloud.cast_points(full, "float")
    assert out.schema["p"].dataType.simpleString() == "array<float>" and out.where("id = 0").first().p == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("rigid", [True, False])
def test_sets_move_points_and_normals(spark, full, rigid):
    some = full.where("id IN (0, 3)")
    mats = {0: np.array(turned(0.3)), 3: np.array(turned(-1.0)) if rigid else np.diag([2.0, 1.0, 0.5]) + 0.1}
    if not rigid:
        mats[0] = np.diag([1.0, 3.0, 2.0])
    t = {0: [1.0, 0.0, -1.0], 3: [0.0, 5.0, 0.0]}
    sets = spark.createDataFrame([(i, m.ravel().tolist(), t[i]) for i, m in mats.items()], "id long, r array<double>, t array<double>")
    got = {r.id: r for r in cloud.transform_set(some, sets, 3, rigid).collect()}
    feats = {r.id: r.p for r in correspond.moved_features_by_set(some.where("id = 0"), sets, 3, rigid, normal_weight=2.0, color_weight=3.0).collect()}
    for r in some.collect():
        m = mats[r.id]
        n = m @ r.n if rigid else np.linalg.inv(m).T @ r.n
        n = n if rigid else n / np.linalg.norm(n)
        assert np.allclose(got[r.id].p, m @ r.p + t[r.id]) and np.allclose(got[r.id].n, n)
        if r.id == 0:
            assert np.allclose(feats[0], [*(m @ r.p + t[0]), *(2 * n / np.linalg.norm(n)), *(3 * np.array(r.c))])


def test_identity_and_composed_sets(spark, full):
    some = full.where("id IN (0, 3)")
    one = cloud.identity_transforms(some, 3)
    assert {r.id: r.p for r in cloud.transform_set(some, one, 3).collect()} == {r.id: r.p for r in some.collect()}
    off = np.array(turned(0.4)) + 1e-3
    for before in (False, True):
        out = cloud.compose_transforms(one, off, [1.0, 2.0, 3.0], before, rigid=True).collect()
        r = np.reshape(out[0].r, (3, 3))
        assert np.allclose(r @ r.T, np.eye(3)) and np.linalg.det(r) > 0 and np.allclose(r, cloud.nearest_rotation(off)) and out[0].t == [1.0, 2.0, 3.0]


def test_labels_with_and_without_a_cluster(spark):
    labels = graph.segments(spark.createDataFrame([(i, 0 if i < 5 else i) for i in range(8)], "id long, comp long"), 2)
    assert ids(graph.labeled(labels)) == [0, 1, 2, 3, 4] and ids(graph.labeled(labels, False)) == [5, 6, 7]
    assert [list(r.ids) for r in graph.cluster_members(labels).collect()] == [[0, 1, 2, 3, 4]]


def test_random_starts_repeat(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(50)], "id long, p array<double>")
    a, b, c = (cluster.random_centroids(df.repartition(n), 4, seed) for n, seed in ((2, 1), (7, 1), (3, 2)))
    assert np.array_equal(a, b) and not np.array_equal(a, c) and len({tuple(x) for x in a}) == 4


def test_flat_hull_in_space():
    rng = np.random.default_rng(1)
    plane = np.linalg.qr(rng.standard_normal((3, 3)))[0][:, :2]
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 1], [0.5, 1.5]], float)
    hull, corners = spatial.flat_hull(square @ plane.T + [5, 6, 7])
    assert hull.area() == pytest.approx(8) or hull.volume() == pytest.approx(4)
    assert sorted(map(tuple, np.round((corners - [5, 6, 7]) @ plane, 9) + 0.0)) == sorted(map(tuple, square[:4]))


def test_bins_in_order(spark):
    df = spark.createDataFrame([(i, [i * 0.7, -i * 0.3]) for i in range(40)], "id long, p array<double>")
    bins = grid.accumulate(df, [1.0, 1.0], []).orderBy("g0", "g1").collect()
    assert [(r.g0, r.g1) for r in bins] == sorted({(int(np.floor(i * 0.7)), int(np.floor(-i * 0.3))) for i in range(40)})


K = [[50.0, 0, 2.0], [0, 50.0, 2.0], [0, 0, 1]]


def test_depth_options(spark):
    """Invalid pixels, extrinsics, limits and a converter of the user; two images in one table do not mix."""
    flat = [(y, x, 1000 + 10 * x) for y in range(5) for x in range(5)]
    px = spark.createDataFrame([(y, x, 0 if (y, x) == (2, 2) else d) for y, x, d in flat], "y int, x int, depth int")
    r, t = np.array(turned(0.5)), [1.0, 2.0, 3.0]
    plain = {(p.y, p.x): p.p for p in rgbd.depth_to_points(px, K).collect()}
    moved = {(p.y, p.x): p.p for p in rgbd.depth_to_points(px, K, keep_invalid=True, extrinsics=(r, t)).collect()}
    assert len(plain) == 24 and len(moved) == 25 and np.allclose(moved[2, 2], t) and all(np.allclose(moved[k], r @ v + t) for k, v in plain.items())
    assert rgbd.depth_to_points(px, K, most=1.025).count() == 15 - 1
    normals = {(p.y, p.x): p.n for p in rgbd.depth_to_normals(px, K).collect()}
    every = rgbd.depth_to_normals(px, K, keep_invalid=True, extrinsics=(r, t)).collect()
    assert len(every) == 25 and set(normals) == {(1, 1), (1, 3), (3, 1), (3, 3)}
    assert all(np.allclose(p.n, r @ normals[p.y, p.x]) for p in every if (p.y, p.x) in normals)
    assert all(np.isnan(p.n).all() for p in every if (p.y, p.x) not in normals)
    two = px.withColumn("image", F.lit("a")).union(px.select("y", "x", (F.col("depth") * 2).alias("depth"), F.lit("b")))
    both = {(p.image, p.y, p.x): p.n for p in rgbd.depth_to_normals(two, K, image="image").collect()}
    assert len(both) == 8 and all(np.allclose(both["a", *k], v) for k, v in normals.items())
    z = spark.createDataFrame([(1.234,), (5.0,)], "z double")
    assert [x[0] for x in z.select(rgbd.raw_depth("z", 1000.0, 2.0)).collect()] == [1234, 0]
    half = rgbd.ScaledDepth(500.0)
    assert [x[0] for x in z.select(half.raw(half.metric(half.raw(F.col("z"))))).collect()] == [617, 2500]


def test_pairs_near_in_normals_and_colors(spark):
    up, side = [0.0, 0.0, 1.0], [0.0, 1.0, 0.0]
    rows = [(up, up, [0.1] * 3, [0.1] * 3, True), (up, side, [0.1] * 3, [0.1] * 3, False), (up, up, [0.1] * 3, [0.9] * 3, False)]
    df = spark.createDataFrame(rows, "n1 array<double>, n2 array<double>, c1 array<double>, c2 array<double>, want boolean")
    assert all(r.got == r.want for r in df.select("want", evaluators.normals_colors_near(0.1, 0.1).alias("got")).collect())


def test_metrics_of_rotations(spark):
    """so3 and l2simple are squared distances of coordinates, below the squared radius."""
    q = spark.createDataFrame([(0, [0.0, 0.0, 0.0]), (1, [0.6, 0.0, 0.0]), (2, [3.0, 0.0, 0.0])], "id long, p array<double>")
    for metric in ("so3", "l2simple"):
        got = sorted((r.q, r.r, round(r.value, 9)) for r in neighbors.radius_join(q, q, 0.7, metric).collect())
        assert got == [(0, 0, 0.0), (0, 1, 0.36), (1, 0, 0.36), (1, 1, 0.0), (2, 2, 0.0)]


def test_icp_steps_one_by_one(spark):
    rng = np.random.default_rng(2)
    x = rng.random((200, 3))
    frame = lambda x: spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, p array<double>")
    icp = registration.Registration(frame(x + [0.01, 0, -0.01]), frame(x), max_distance=0.05)
    state = icp.initialise()
    after = icp.estimate(icp.correspondences(state), state)
    assert icp.change(state, after) > 1e-3 and icp.change(after, after) < 1e-12
    end, rounds, done = registration.closest_point_loop(icp, 10, 1e-9)
    assert done and np.allclose(end[1], [0.01, 0, -0.01], atol=1e-6) and np.allclose(end[0], np.eye(3), atol=1e-6)
    assert registration.closest_point_loop(registration.Registration(frame(x + 100), frame(x), max_distance=0.01), 3)[1:] == (1, False)


def test_streamed_voxels(spark, tmp_path):
    """Windows of a stream give the counts of the same rows at rest."""
    src = str(tmp_path / "in")
    rows = spark.sql("SELECT timestamp_seconds(1000 + id) AS ts, id, array(id * 0.1D, 0.5D) AS p FROM range(60)")
    rows.write.parquet(src)
    stream = voxels.windowed_voxels(spark.readStream.schema("ts timestamp, id long, p array<double>").parquet(src), [1.0, 1.0], window="20 seconds", late="1 second")
    q = stream.writeStream.format("memory").queryName("streamed_voxels").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(100)
    got = sorted((r.w.start.timestamp(), r.g0, r["count"], round(r.p0, 9)) for r in spark.table("streamed_voxels").collect())
    want = {}
    for i in range(60):
        want.setdefault(((1000 + i) // 20 * 20, int(np.floor(i * 0.1))), []).append(i * 0.1)
    assert got == sorted((float(w), g, len(v), round(float(np.mean(v)), 9)) for (w, g), v in want.items())


def test_rigid_pairs_come_with_the_search(spark, monkeypatch):
    """Points of both ends, without a join that fetches them; equal to the gathered ones."""
    x = np.random.default_rng(31).random((60, 3))
    frame = lambda y: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, p array<double>")
    r, t = np.array([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]), np.array([0.1, 0.2, 0.3])
    dst, src = x @ r.T + t + 0.001, x
    icp = registration.Registration(frame(dst), frame(src), max_distance=0.01)
    rows = lambda df: {p.second: (p.first, round(p.value, 9), np.round(p.p1, 9).tolist(), np.round(p.p2, 9).tolist()) for p in df.collect()}
    want = rows(registration.gather(registration.correspondences(icp.dst, registration.transform(icp.src, r, t), 0.01), icp.dst, icp.src))
    monkeypatch.setattr(registration, "gather", None)
    assert rows(icp.pairs(r, t)) == want and len(want) == 60


def test_no_points_match_nothing(spark):
    some = spark.createDataFrame([(1, [0.0, 1.0])], "id long, p array<double>")
    assert correspond.index_of(some.where("false")) is None
    assert correspond.matched_points(None, some, 1.0).count() == 0
