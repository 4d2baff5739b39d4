"""k nearest by cells against all distances: uneven clouds, hot points, ties, user metrics, and how many pairs leave a task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import cells, neighbors, normals


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in p]) for i, p in zip(ids, x)], "id long, p array<double>")


def plain(q, x, k, metric=cells.L2, ids=None):
    ids = np.arange(len(x)) if ids is None else np.asarray(ids)
    d = cells.pairwise(metric, np.asarray(q, float), np.asarray(x, float))
    return {a: [(float(d[a, b]), int(ids[b])) for b in np.lexsort((ids, d[a]))[:k]] for a in range(len(q))}


def lists(df):
    return {r.q: [(n.value, n.r) for n in r.nn] for r in df.collect()}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(cells, "LEAF_ROWS", 100)
    monkeypatch.setattr(cells, "PIVOT_ROWS", 60)


def test_cube_and_corridor_cost_the_same(spark, small):
    """6,000 points in a cube, and in a corridor a thousand times as long as wide: few hits leave a task for each point."""
    for scale in ([1, 1, 1], [1000, 1, 1]):
        x = np.random.default_rng(1).random((6000, 3)) * scale
        cloud = frame(spark, x).cache()
        found = cells.nearest_lists(cloud, cloud, 8)
        assert lists(found) == plain(x, x, 8)
        tree, kept = cells.fitted(cells.finite(cloud), cells.Tree(3), cells.L2, 8, cells.LEAF_ROWS)
        assert tree.cells > 30 and tree.count.max() < 4 * tree.count[tree.count > 0].mean()
        bound = np.array([v[-1][0] for v in plain(x, x, 8).values()])
        visits = len(tree.reach(x, bound, cells.L2)[0]) / len(x)
        assert 8 * visits < 40


def test_many_rows_at_one_place(spark, small):
    """A third of the rows share one point, as rows and as queries; others lie on a grid, with ties everywhere."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full((1000, 2), 0.5), rng.integers(0, 12, (2000, 2)) / 4.0])
    ids = rng.permutation(len(x))
    cloud = frame(spark, x, ids)
    want = {int(ids[a]): v for a, v in plain(x, x, 5, ids=ids).items()}
    assert lists(cells.nearest_lists(cloud, cloud, 5, dim=2)) == want
    tree, kept = cells.fitted(cells.finite(cloud), cells.Tree(2), cells.L2, 5, cells.LEAF_ROWS)
    assert tree.count.max() < 300 and kept.count() < 2200


def test_cells_are_split_again_where_the_sample_misses(spark, small, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE", 60)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random((200, 2)) * 1000, rng.random((4000, 2)) * 0.01])
    cloud = frame(spark, x)
    assert lists(cells.nearest_lists(cloud, cloud, 4, dim=2)) == plain(x, x, 4)
    tree, _ = cells.fitted(cells.finite(cloud), cells.Tree(2), cells.L2, 4, cells.LEAF_ROWS)
    assert tree.count.max() <= cells.HEAVY * 100


def test_other_queries_few_rows_and_odd_points(spark, small):
    rng = np.random.default_rng(4)
    x, q = rng.random((900, 3)), np.concatenate([rng.random((100, 3)) * 5 - 2, [[1e6, -1e6, 0.0]]])
    assert lists(cells.nearest_lists(frame(spark, q), frame(spark, x), 6)) == plain(q, x, 6)
    few = frame(spark, x[:4])
    assert lists(cells.nearest_lists(frame(spark, q), few, 6)) == plain(q, x[:4], 6)
    assert neighbors.knn(frame(spark, q), few.where("false"), 3).count() == 0
    assert neighbors.knn(few.where("false"), few, 3).count() == 0
    odd = few.union(spark.createDataFrame([(10, [float("nan"), 0.0, 0.0]), (11, None)], "id long, p array<double>"))
    assert lists(cells.nearest_lists(odd, odd, 2)) == plain(x[:4], x[:4], 2)


@pytest.mark.parametrize("metric", [cells.L2, cells.L1])
def test_pivots_equal_all_distances(spark, small, metric):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16)) * 6
    x = np.concatenate([centres[rng.integers(0, 12, 1500)] + 0.2 * rng.standard_normal((1500, 16)), np.repeat(centres[:1], 700, 0)])
    cloud = frame(spark, x)
    got, want = lists(cells.nearest_lists(cloud, cloud, 5, metric, 16, pivots=True)), plain(x, x, 5, metric)
    assert {q: [r for _, r in v] for q, v in got.items()} == {q: [r for _, r in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-9 for q in got for (a, _), (b, _) in zip(got[q], want[q]))


def test_pivots_meet_few_blocks_of_clustered_rows(spark, small):
    """Four times the rows: about four times the visits, where all pairs of blocks would be sixteen times as many."""

    def visits(n):
        rng = np.random.default_rng(6)
        centres = rng.standard_normal((n // 50, 16)) * 6
        x = centres[rng.integers(0, len(centres), n)] + 0.1 * rng.standard_normal((n, 16))
        p, _ = cells.fitted(frame(spark, x), cells.Pivots(16), cells.L2, 5, cells.PIVOT_ROWS)
        bound = np.array([v[-1][0] for v in plain(x, x, 5).values()])
        return len(p.reach(x, bound, cells.L2)[0])

    a, b = visits(1000), visits(4000)
    assert b < 7 * a


def test_a_metric_of_the_user(spark, small):
    """Weighted Chebyshev: rows, boxes and columns from one definition."""
    metric = cells.Metric(lambda a, b: F.array_max(F.transform(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda g, i: g * (i + 1))), lambda gaps: np.max([g * (i + 1) for i, g in enumerate(gaps)], axis=0))
    x = np.random.default_rng(7).random((1200, 2))
    cloud = frame(spark, x)
    assert lists(cells.nearest_lists(cloud, cloud, 4, metric, 2)) == plain(x, x, 4, metric)
    inside = neighbors.radius_join(cloud, cloud, 0.05, metric, 2)
    d = cells.pairwise(metric, x, x)
    assert inside.count() == int((d < 0.05).sum())
    wide = np.random.default_rng(8).random((600, 9))
    deep = frame(spark, wide)
    got = neighbors.knn(deep, deep, 3, metric).collect()
    assert sorted((r.q, r.rank, r.r) for r in got) == sorted((q, i, r) for q, v in plain(wide, wide, 3, metric).items() for i, (_, r) in enumerate(v))


def test_normals_equal_those_from_edges(spark, small):
    x = np.random.default_rng(9).random((700, 3))
    cloud = frame(spark, x)
    a = {r.id: (r.n, r.curvature) for r in normals.normals(cloud, neighbors.KNN(9)).collect()}
    b = {r.id: (r.n, r.curvature) for r in normals.normals(cloud, neighbors.KNN(9), covariance=lambda e, c, dim: normals.neighborhood_covariance(e, c, dim).select("q", "qp", F.array(*(F.col(f"s{min(i, k)}{max(i, k)}") for i in range(3) for k in range(3))).alias("c"), "count")).collect()}
    assert all(np.allclose(a[i][0], b[i][0], atol=1e-7) and abs(a[i][1] - b[i][1]) < 1e-9 for i in range(700))


@pytest.mark.parametrize("pivots", [False, True])
def test_lists_move_without_coordinates(spark, small, pivots):
    x = np.random.default_rng(9).random((700, 3))
    cloud = frame(spark, x)
    got = cells.nearest_lists(cloud, cloud, 4, pivots=pivots, points=False).collect()
    assert {r.q: [(n.value, n.r) for n in r.nn] for r in got} == plain(x, x, 4)
    assert all(not r.qp and not any(n.rp for n in r.nn) for r in got)


def test_sums_of_gaps_by_bytes():
    rng = np.random.default_rng(3)
    for dim, n, odd in ((64, 5000, 0.0), (7, 4097, 1e6), (8, 3, 0.0)):
        x = rng.normal(size=(n, dim)).round(1 if dim == 7 else 12)  # coarse ones tie
        x[0] += odd
        x[-1] = x[n // 2]
        q = np.concatenate([x[:20], rng.normal(size=(20, dim))])
        for k, bound in ((5, np.inf), (1, dim * 0.5)):
            i, j, v = cells.by_bytes(q, x, np.arange(n), k, np.full(len(q), bound))
            d = cells.pairwise(cells.L1, q, x)
            for row in range(len(q)):
                want = [c for c in np.argsort(d[row], kind="stable")[:k] if d[row, c] <= bound]
                assert list(j[i == row]) == want
                assert np.array_equal(v[i == row], d[row, want])


@pytest.mark.parametrize("metric", [cells.L1, cells.L2])
def test_visits_move_a_query_once_for_many_cells(spark, monkeypatch, metric):
    monkeypatch.setattr(cells, "PIVOT_ROWS", 40)
    x = np.random.default_rng(4).normal(size=(800, 12))
    x[400:420] = x[0]
    cloud, moved = frame(spark, x), []
    keep = cells.cut_bare
    monkeypatch.setattr(cells, "cut_bare", lambda df: moved.append(keep(df)) or moved[-1])
    got = lists(cells.nearest_lists(cloud, cloud, 4, metric, 12, pivots=True))
    assert got == plain(x, x, 4, metric)
    rows = moved[0].selectExpr("sum(size(visit)) AS groups", "sum(aggregate(visit, 0, (a, v) -> a + size(v.inside))) AS cells").first()
    assert rows.groups <= 800 < 5 * 800 < rows.cells  # one row a query, not one for each cell
    near = lists(cells.nearest_lists(cloud, cloud, 4, metric, 12, pivots=True, limit=3.0))
    assert {q: [h for h in hits if h[0] <= 3.0] for q, hits in got.items()} == near


@pytest.mark.parametrize("far", [0.0, 3.0, 1e4, 1e20])
def test_single_precision_preselects_and_no_more(far, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (3000, 12)) / 4 + rng.integers(0, 2, (3000, 12)) * 1e-9 + far  # many ties, and gaps that single precision does not see
    ids, q = rng.permutation(3000), x[:200] + 1e-9
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    bound = np.sort(d, 1)[:, rng.integers(0, 30, 200)].diagonal() if far < 1e19 else np.full(200, np.inf)
    asked = []
    monkeypatch.setattr(cells, "singles", lambda *a, of=cells.singles: asked.append(of(*a)) or asked[-1])
    i, j, v = cells.Pivots(12).search(q, x, ids, 6, bound, cells.L2)
    assert (asked[0] is not None) == (far <= 3.0)
    monkeypatch.setattr(cells, "singles", lambda *a: None)
    for got, want in zip((i, j, v), cells.Pivots(12).search(q, x, ids, 6, bound, cells.L2), strict=True):
        np.testing.assert_array_equal(got, want)
