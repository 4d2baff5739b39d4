"""Accumulators that merge, and robust covariances of large sets, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import grid, stats
from pointloom.plans.queries import MedianShade


def test_aligned_normals_of_any_direction(spark):
    """Lines about one axis per voxel, half of them turned: the sum is theirs, on the first member's side, in one aggregation."""
    rng = np.random.default_rng(1)
    axes = rng.standard_normal((8, 3))
    rows, want = [], {}
    for i in range(400):
        v = i % 8
        line = axes[v] / np.linalg.norm(axes[v]) + 0.05 * rng.standard_normal(3)
        turned = line if rng.random() < 0.5 else -line
        rows.append((i, [v + 0.5, 0.5, 0.5], turned.tolist()))
        s, first = want.setdefault(v, (np.zeros(3), turned))
        want[v] = (s + (line if line @ axes[v] > 0 else -line), first)
    df = spark.createDataFrame(rows, "id long, p array<double>, n array<double>").repartition(5)
    out = grid.downsample(df, [1.0, 1.0, 1.0])
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        s, first = want[r.g0]
        s = s if s @ first >= 0 else -s
        assert np.allclose(r.n, s / np.linalg.norm(s), atol=1e-9) and r["count"] == 50


def test_all_attributes_of_a_voxel(spark):
    """Points, normals and colors together, in two dimensions as well; a zero normal stays zero."""
    rows = [(0, [0.1, 0.1], [1.0, 0.0], [0.0, 0.5, 1.0]), (1, [0.3, 0.5], [-1.0, 0.0], [1.0, 0.5, 0.0]), (2, [1.5, 0.5], [0.0, 0.0], [0.25] * 3), (3, [-0.5, 0.5], [0.0, -2.0], [1.0] * 3)]
    out = {r.g0: r for r in grid.downsample(spark.createDataFrame(rows, "id long, p array<double>, n array<double>, c array<float>"), [1.0, 1.0]).collect()}
    assert np.allclose(out[0].p, [0.2, 0.3]) and out[0].n == [1, 0] and np.allclose(out[0].c, [0.5, 0.5, 0.5]) and out[0]["count"] == 2
    assert out[1].n == [0, 0] and out[-1].n == [0, -1] and out[-1].c == [1, 1, 1]


def test_a_users_accumulator(spark, monkeypatch):
    """States of many tasks, sent on early, merge to the same medians."""
    monkeypatch.setattr(grid, "MOST_STATES", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.random(2).tolist(), [0.0, round(float(v), 2), 0.0]) for i, v in enumerate(rng.random(900))]
    got = {(r.g0, r.g1): (r["count"], r.median) for r in grid.accumulate_with(spark.createDataFrame(rows, "id long, p array<double>, c array<double>").repartition(6), [0.3, 0.3], MedianShade()).collect()}
    cells = {}
    for _, p, c in rows:
        cells.setdefault(tuple(int(v // 0.3) for v in p), []).append(c[1])
    assert got == {k: (len(v), sorted(v)[(len(v) + 1) // 2 - 1]) for k, v in cells.items()}


def test_a_users_states_meet_without_a_call_for_each_voxel(spark, monkeypatch):
    """Voxels of negative and null places, states in many small batches: merged in the order of voxels, not in groups of their own."""
    monkeypatch.setattr(grid, "MOST_STATES", 3)
    rows = [(i, [(i % 37 - 18) / 10.0, None if i % 50 == 0 else 0.5], [0.0, (i % 101) / 100, 0.0]) for i in range(1500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = grid.accumulate_with(spark.createDataFrame(rows, "id long, p array<double>, c array<double>").repartition(5), [0.1, 1.0], MedianShade())
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.g0, -9 if r.g1 is None else r.g1, r["count"], r.median) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    cells = {}
    for _, p, c in rows:
        cells.setdefault((int(np.floor(p[0] * (1 / 0.1))), -9 if p[1] is None else 0), []).append(c[1])
    assert got == sorted((*k, len(v), sorted(v)[(len(v) + 1) // 2 - 1]) for k, v in cells.items())


@pytest.mark.parametrize("key", [None, "k"])
def test_large_sets_take_the_plain_concentration_steps(spark, key):
    """From the same starts the same subsets, determinants and estimates; far points are left out, whatever key holds most rows."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((700, 3)) * [1, 2, 0.5], rng.standard_normal((150, 3)) + 30])
    k = [0 if i % 10 else 1 for i in range(len(x))]
    df = spark.createDataFrame([(i, int(g), p.tolist()) for i, (g, p) in enumerate(zip(k, x))], "id long, k long, p array<double>")
    got = stats.fast_mcd(df, 3, key, chi2=16.0).collect()
    starts = stats._robust_start(df if key else df.withColumn("k", F.lit(0)), ["k"], 6, 2, 0).collect()
    assert len(got) == (2 if key else 1)
    for r in got:
        g = r.k if key else 0
        mine = [i for i in range(len(x)) if not key or k[i] == g]
        pts, h, best, every = x[mine], round(0.75 * len(mine)), None, []
        for t in range(6):
            m = np.array([s.p for s in starts if s.t == t and s.k == g])
            mean, c, dets = m.mean(0), np.cov(m.T), []
            for _ in range(3):
                far = np.einsum("ij,jk,ik->i", pts - mean, np.linalg.pinv(c), pts - mean)
                near = pts[np.lexsort((mine, far))[:h]]
                mean, c = near.mean(0), np.cov(near.T)
                dets.append(np.linalg.det(c))
            every.append(dets)
            if best is None or dets[-1] < best[0][-1]:
                best = (dets, mean, c)
        # trials that end in one subset tie but for rounding
        assert any(np.allclose(r.dets, d, rtol=1e-6) for d in every) and np.isclose(r.dets[-1], best[0][-1]) and np.allclose(r["mean"], best[1]) and np.allclose(np.reshape(r["cov"], (3, 3)), best[2])
        assert all(b <= a * (1 + 1e-9) for a, b in zip(r.dets, r.dets[1:])) and np.abs(r["mean"]).max() < 1
        first = pts[0] - best[1]
        assert r.valid == bool(first @ np.linalg.pinv(best[2]) @ first <= 16)


def test_small_sets_of_the_large_method(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 2.0]), (1, 0, [3.0, 2.0]), (2, 1, [0.0, 0.0])], "id long, k long, p array<double>")
    got = {r.k: r for r in stats.fast_mcd(df, 2, "k").collect()}
    assert sorted(got) == [0] and got[0]["mean"] == [2.0, 2.0]
    assert stats.fast_mcd(df.where("false"), 2).count() == 0


def test_the_nearest_rows_of_large_sets_meet_in_no_task(spark, monkeypatch):
    """Alike with lines broadcast and met in parts, with ties. What is ranked is near the h-th row."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(3000, 2)), np.tile(rng.normal(size=(300, 2)), (10, 1))])
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in p]) for i, p in enumerate(x)], "id long, k long, p array<double>")
    ranked, seen = stats.ranked, []
    monkeypatch.setattr(stats, "ranked", lambda rows, *a, **o: seen.append(rows.count()) or ranked(rows, *a, **o))
    want = {}
    for few in (2000, 0):
        monkeypatch.setattr(stats, "FEW_KEYS", few), monkeypatch.setattr(stats, "PART_ROWS", 500)
        got = {r.k: (np.array(r.mean), np.array(r.dets)) for r in stats.fast_mcd(df, 2, "k", trials=2, steps=1).collect()}
        want = want or got
        assert all(np.allclose(got[k][0], want[k][0], atol=1e-12) and np.allclose(got[k][1], want[k][1], rtol=1e-9) for k in (0, 1)) and len(got) == 2
    assert max(seen) < 2 * len(x) / 10
    for k in (0, 1):
        mine = x[k::2]
        d = want[k][1]
        assert d[-1] < np.linalg.det(np.cov(mine.T))
