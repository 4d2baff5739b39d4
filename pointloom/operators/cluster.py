"""k-means, mean shift and spectral methods: driver loops over one aggregation each."""

from __future__ import annotations

import functools
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import METRICS, unit
from pointloom.operators.eigen import largest_pairs
from pointloom.operators.neighbors import GRID_DIM, radius_join
from pointloom.operators.ranks import ranked
from pointloom.operators.reach import Around, distinct_points, finite, radius_sums
from pointloom.operators.session import cut, cut_bare
from pointloom.operators.stats import canonical_axes, covariance


def assign(df: DataFrame, centroids: np.ndarray, metric: str = "l2") -> DataFrame:
    """Adds cluster: the nearest centroid, the lowest of equals. Centroids are literals (their number is a parameter)."""
    rows = F.array(*(F.struct(METRICS[metric]("p", F.array(*(F.lit(float(v)) for v in c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centroids)))
    return df.withColumn("cluster", F.array_min(rows)["k"])


def centroids_of(assigned: DataFrame, dim: int) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("count"), *(F.avg(F.col("p")[i]).alias(f"m{i}") for i in range(dim)))


def random_centroids(df: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k points by a hash of id and seed."""
    return np.array([r[0] for r in df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("p").collect()])


def kmeans(df: DataFrame, centroids: np.ndarray, max_iter: int = 100, tol: float = 1e-9, metric: str = "l2") -> tuple[np.ndarray, DataFrame, int]:
    """(centroids, df with cluster, rounds). Each empty cluster, in order, takes the point that is farthest from the centroid of the then largest cluster, which loses it."""
    centroids = np.array(centroids, float)
    dim, before = centroids.shape[1], None
    for rounds in range(1, max_iter + 1):
        a = assign(df, centroids, metric)
        stat = {r["cluster"]: r for r in centroids_of(a, dim).collect()}
        count = np.array([stat[k]["count"] if k in stat else 0 for k in range(len(centroids))])
        new = np.array([[stat[k][f"m{i}"] for i in range(dim)] if k in stat else centroids[k] for k in range(len(centroids))])
        sizes = tuple(count)
        moved_ids: list = []
        for k in np.flatnonzero(count == 0):
            big = int(count.argmax())
            if count[big] < 2:
                break
            mine = a.where((F.col("cluster") == big) & ~F.col("id").isin(moved_ids))
            far = mine.withColumn("d", METRICS[metric]("p", F.array(*(F.lit(float(v)) for v in new[big])))).orderBy(F.desc("d"), "id").select("id", "p").first()
            moved_ids.append(far["id"])
            new[k] = far["p"]
            new[big] = (new[big] * count[big] - new[k]) / (count[big] - 1)
            count[big], count[k] = count[big] - 1, 1
        moved = ((new - centroids) ** 2).sum(1).max()
        centroids = new
        if moved < tol * tol or (moved == 0 and sizes == before):
            break
        before = sizes
    return centroids, assign(df, centroids, metric), rounds


def shift_once(seeds: DataFrame, cloud: DataFrame, radius: float, kernel: Column | None = None, dim: int = 3, around: Around | None = None) -> DataFrame:
    """Each seed at the weighted mean of the points within the radius; NaN where there are none. A column w of the cloud weighs its points; without a kernel no pair becomes a row. around: the cloud made ready for several steps."""
    if kernel is None:
        sums = around.sums(finite(seeds)).where(F.col("m")[0] > 0).select(F.col("id").alias("q"), F.col("p").alias("qp"), "m") if around else radius_sums(seeds.select("id", "p"), cloud, radius, dim, 1)
        means = sums.select("q", *((F.col("qp")[i] + F.col("m")[1 + i] / F.col("m")[0]).alias(f"m{i}") for i in range(dim)))
    else:
        weighed = cloud.select("id", "p", F.col("p").alias("rp"), (F.col("w") if "w" in cloud.columns else F.lit(1.0)).alias("rw"))
        hits = radius_join(seeds, weighed, radius, dim=dim, keep=([], ["rw", "rp"])).withColumn("w", kernel * F.col("rw"))
        means = hits.groupBy("q").agg(*((F.sum(F.col("w") * F.col("rp")[i]) / F.sum("w")).alias(f"m{i}") for i in range(dim)))
    return seeds.select("id").join(means.hint("merge"), F.col("id") == F.col("q"), "left").select("id", F.array(*(F.coalesce(F.col(f"m{i}"), F.lit(float("nan"))) for i in range(dim))).alias("p"))


def greedy_modes(seeds: DataFrame, merge: float, dim: int) -> DataFrame:
    """(id, first) of the seeds (id, p): in the order of ids a seed that is nearer than merge to no earlier mode becomes one; first is the earliest mode near it, itself for a mode.

    In rounds over cells as wide as merge: the least undecided seed of a cell is a mode if none of the cells around holds a lesser one, since whatever
    is near it and undecided comes later. Seeds near new modes are decided. A round sees one seed of each cell, however many lie there.
    """
    axes = min(dim, GRID_DIM)
    names = [f"c{i}" for i in range(axes)]
    cells = [F.floor(F.col("p")[i] / merge).cast("long").alias(c) for i, c in enumerate(names)]
    steps = F.explode(F.array(*(F.struct(*(F.lit(o).alias(f"o{i}") for i, o in enumerate(offs))) for offs in product((-1, 0, 1), repeat=axes)))).alias("o")
    around = lambda df: df.select("*", steps).select(*(c for c in df.columns if c not in names), *((F.col(c) + F.col(f"o.o{i}")).alias(c) for i, c in enumerate(names)))
    near = METRICS["l2"]("p", "mp") < merge * merge
    every = left = cut(seeds.select("id", "p", *cells))
    modes = None
    while True:
        firsts = left.groupBy(*names).agg(F.min(F.struct("id", "p")).alias("s")).select(*names, "s.*")
        least = around(firsts.select(*names, "id")).groupBy(*names).agg(F.min("id").alias("least"))
        new = cut(firsts.join(least, names).where("id = least").select(F.col("id").alias("first"), F.col("p").alias("mp"), *names))
        if new.limit(1).count() == 0:
            break
        beside = around(new.select("first", "mp", *names)).withColumnsRenamed({c: f"n{c}" for c in names})
        met = functools.reduce(Column.__and__, (F.col(c) == F.col(f"n{c}") for c in names))
        left = cut(left.join(beside, met & (near | (F.col("id") == F.col("first"))), "left_anti"))
        modes = new if modes is None else modes.union(new)
    if modes is None:
        return seeds.select("id", F.col("id").alias("first")).where("false")
    return every.join(around(modes), names).where(near | (F.col("id") == F.col("first"))).groupBy("id").agg(F.min("first").alias("first"))


def mean_shift(seeds: DataFrame, cloud: DataFrame, radius: float, merge: float, max_iter: int = 100, tol: float = 1e-7, dim: int = 3, kernel: Column | None = None) -> DataFrame:
    """(id, cluster, mode) of each seed: it moves until a step is shorter than tol, then joins the first cluster whose first member is nearer than merge; mode is the mean of a cluster's seeds.

    kernel: the weight of a neighbor, from the column value (the squared distance); all alike if None. A seed without neighbors stays where it is, as a
    mode of its own. Clusters are numbered in the order of their first seeds. Equal seeds go one way, so the first of them goes for all; equal points are weighed.
    """
    done: list[DataFrame] = []
    ordinary = F.coalesce(F.forall("p", lambda x: F.abs(x) < float("inf")), F.lit(False))
    alike = seeds.select("id", "p", F.when(ordinary, F.lit(0)).otherwise(F.col("id")).alias("own"))
    firsts = cut(alike.groupBy("p", "own").agg(F.min("id").alias("id"), F.count("*").alias("w")))
    now, cloud = firsts.select("id", "p"), cut(distinct_points(cloud))
    around = Around(cloud, radius, dim, 1) if kernel is None else None
    for _ in range(max_iter):
        step = shift_once(now, cloud, radius, kernel, dim, around).join(now.select("id", F.col("p").alias("old")).hint("merge"), "id")
        alone = F.isnan(F.col("p")[0])
        step = cut_bare(step.select("id", F.when(alone, F.col("old")).otherwise(F.col("p")).alias("p"), (alone | (METRICS["l2"]("p", "old") < tol * tol)).alias("rests")))
        done.append(step.where("rests").select("id", "p"))
        now = step.where("NOT rests").select("id", "p")
        if now.limit(1).count() == 0:
            break
    for d in done:
        now = now.union(d)
    ended = cut(now)
    label = cut(greedy_modes(ended, merge, dim))
    mean = lambda i: F.sum(F.col("p")[i] * F.col("w")) / F.sum("w")
    means = ended.join(label.hint("merge"), "id").join(firsts.select("id", "w").hint("merge"), "id").groupBy("first").agg(F.array(*(mean(i) for i in range(dim))).alias("mode"))
    numbered = ranked(means, ["first"], "cluster")
    found = label.join(numbered.hint("merge"), "first").select(F.col("id").alias("of"), F.col("cluster").cast("int").alias("cluster"), "mode")
    every = alike.join(firsts.select("p", "own", F.col("id").alias("of")).hint("merge"), (alike["p"].eqNullSafe(firsts["p"])) & (alike["own"] == firsts["own"])).select(alike["id"], "of")
    return every.join(found.hint("merge"), "of").select("id", "cluster", "mode")


def laplacian(entries: DataFrame, kind: str = "normalized_symmetric") -> tuple[DataFrame, DataFrame]:
    """(matrix, degrees): the matrix (row, col, value) whose largest eigenvalues t give the least of the Laplacian, as 1 - t, or as -t if unnormalized; degrees (id, degree) of the nodes that have entries. Entries and matrix are written, so that a graph behind them is made once."""
    entries = cut_bare(entries.select("row", "col", "value"))
    degree = cut(entries.groupBy(F.col("col").alias("id")).agg(F.sum("value").alias("degree")))
    if kind == "unnormalized":
        own = degree.select(F.col("id").alias("row"), F.col("id").alias("col"), (-F.col("degree")).alias("value"))
        return entries.select("row", "col", "value").union(own).groupBy("row", "col").agg(F.sum("value").alias("value")), degree
    root = degree.where("degree > 0").select("id", (1 / F.sqrt("degree")).alias("s"))
    a = entries.join(root.toDF("row", "sr"), "row").join(root.toDF("col", "sc"), "col")
    return cut_bare(a.select("row", "col", (F.col("value") * F.col("sr") * F.col("sc")).alias("value"))), degree


def laplacian_embedding(entries: DataFrame, nodes: DataFrame, k: int, kind: str = "normalized_symmetric", tol: float = 5e-7) -> tuple[np.ndarray, DataFrame]:
    """(eigenvalues ascending, (id, p)): the k least eigenpairs of the Laplacian of the graph with entries (row, col, value) over the nodes (id)."""
    matrix, degree = laplacian(entries, kind)
    values, vectors = largest_pairs(matrix, nodes, k, tol)
    values = np.maximum(-values if kind == "unnormalized" else 1 - values, 0)
    if kind == "normalized_symmetric":
        return values, vectors.select("id", unit("x").alias("p"))
    if kind == "normalized_random_walk":
        scale = F.when(F.col("degree") > 0, 1 / F.sqrt("degree")).otherwise(0.0)
        return values, vectors.join(degree, "id", "left").select("id", F.transform("x", lambda v: v * F.coalesce(scale, F.lit(0.0))).alias("p"))
    return values, vectors.select("id", F.col("x").alias("p"))


def eigengap(values: np.ndarray) -> int:
    """Number of clusters: where the gap between ascending eigenvalues is largest, the first compared with the least value itself."""
    gaps = np.diff(values)
    best, at = values[0], 0
    for i, g in enumerate(gaps):
        if g > best:
            best, at = g, i
    return at + 1


def spread_centroids(df: DataFrame, k: int) -> np.ndarray:
    """k points far apart: that of the least id, then each the one farthest from those before."""
    start = [np.array(df.orderBy("id").select("p").first()[0])]
    while len(start) < k:
        gaps = [METRICS["l2"]("p", F.array(*(F.lit(float(v)) for v in c))) for c in start]
        start.append(np.array(df.orderBy(F.desc(F.least(*gaps) if len(gaps) > 1 else gaps[0]), "id").select("p").first()[0]))
    return np.array(start)


def spectral_clusters(entries: DataFrame, nodes: DataFrame, k: int | None, most: int = 4, kind: str = "normalized_symmetric") -> DataFrame:
    """(id, cluster) of the nodes; k None: estimated, at most `most`. Nodes may have any ids; their vectors stay in Spark."""
    n = nodes.count()
    want = min(most + 1, n - 1) if k is None else (k if 0 < k <= n else 2)
    values, points = laplacian_embedding(entries, nodes, want, kind)
    if k is None:
        want = min(most, eigengap(values))
        points = points.select("id", F.slice("p", 1, want).alias("p"))
        if kind == "normalized_symmetric":
            points = points.select("id", unit("p").alias("p"))
    points = cut(points)
    _, out, _ = kmeans(points, spread_centroids(points, want))
    return out.select("id", "cluster")


def double_center(pairs: DataFrame) -> DataFrame:
    """(i, j, b) of squared distances (i, j, d2): b = -(d2 - row mean - column mean + mean) / 2."""
    rows = pairs.groupBy("i").agg(F.avg("d2").alias("_r"))
    cols = pairs.groupBy("j").agg(F.avg("d2").alias("_c"))
    whole = pairs.agg(F.avg("d2").alias("_m"))
    return pairs.join(rows, "i").join(cols, "j").crossJoin(F.broadcast(whole)).select("i", "j", (-0.5 * (F.col("d2") - F.col("_r") - F.col("_c") + F.col("_m"))).alias("b"))  # one row


def scaling(pairs: DataFrame, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Classical multidimensional scaling: (eigenvalues, n x k coordinates); eigenpairs of the largest magnitude, negative values as zero."""
    b = np.zeros((n, n))
    for i, j, v in double_center(pairs).toLocalIterator():
        b[i, j] = v
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:k]
    values = np.maximum(values[order], 0)
    return values, vectors[:, order] * np.sqrt(values)


def scaling_of_points(df: DataFrame, dim: int, k: int) -> tuple[np.ndarray, DataFrame]:
    """Classical multidimensional scaling of the l2 distances of the points (id, p): (eigenvalues, (id, x) with k coordinates).

    The double-centered matrix is that of the products of the centered points, so its eigenpairs follow from their
    covariance, and no distance is computed. Axes have the signs of canonical_axes.
    """
    mean, c, n = covariance(df, dim)
    values, vectors = canonical_axes(c)
    # the covariance divides by n - 1
    values, k = np.maximum(values[:k], 0) * (n - 1), min(k, dim)
    x = [sum(((F.col("p")[i] - float(mean[i])) * float(vectors[i, j]) for i in range(dim)), F.lit(0.0)) for j in range(k)]
    return values, df.select("id", F.array(*x).alias("x"))
