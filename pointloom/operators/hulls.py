"""Convex hulls of large clouds: facets as rows. The directions of facet normals are dealt into cells, and each cell needs only the points that can be outermost there."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import finite
from pointloom.operators.session import cut
from pointloom.operators.spatial import Hull, convex_hull
from pointloom.operators.stats import covariance

LEAF = 400  # points of a cell that one task turns into facets
FIRST_CELLS = 128  # most cells of the first pass, whose outermost points the driver holds
PLANE = 20  # leaves' worth of points that a task also takes where neither halving nor keeping corners makes a cell lighter
DEEPEST = 16  # halvings of a cell's sides; points of a cell this small are all but in one plane
THIN = 128  # a cloud is widened where it is thinner, up to so many times
SAME = 1e-9  # a distance that counts as none, in a cloud of size one
ROWS = "cell array<int>, id long, q array<double>, s double, was long, final boolean"
FACETS = "vertices array<long>, n array<double>, d double, area double, height double"


def _box(cell: list[int]) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(axis, sign, low, high) of a cell [side, level, k0, ...]: directions with `sign` at the axis and the other coordinates between low and high."""
    side, level, *k = cell
    width = 2.0 / (1 << level)
    low = np.array(k, float) * width - 1
    return side // 2, 1.0 - 2 * (side % 2), low, low + width


def _reach(q: np.ndarray, cell: list[int]) -> np.ndarray:
    """The most of u q over the directions u of a cell."""
    axis, sign, low, high = _box(cell)
    rest = np.delete(q, axis, axis=1)
    return sign * q[:, axis] + np.maximum(low * rest, high * rest).sum(1)


def _score(q: np.ndarray, cell: list[int]) -> np.ndarray:
    """u q of the direction in the middle of a cell."""
    axis, sign, low, high = _box(cell)
    return sign * q[:, axis] + (np.delete(q, axis, axis=1) * ((low + high) / 2)).sum(1)


def _children(cell: list[int]) -> list[list[int]]:
    side, level, *k = cell
    return [[side, level + 1, *(2 * a + b for a, b in zip(k, bits, strict=True))] for bits in product((0, 1), repeat=len(k))]


def _batch(cell: list[int], ids: np.ndarray, q: np.ndarray, was: int, final: bool) -> pa.RecordBatch:
    n = len(ids)
    lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), t))
    return pa.RecordBatch.from_arrays(
        [lists(np.tile(np.array(cell, np.int32), (n, 1)), pa.int32()), pa.array(ids, pa.int64()), lists(q, pa.float64()), pa.array(_score(q, cell), pa.float64()), pa.array(np.full(n, was), pa.int64()), pa.array(np.full(n, final))],
        names=["cell", "id", "q", "s", "was", "final"],
    )


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _corners(q: np.ndarray) -> np.ndarray:
    """Rows of q that no others span: the corners of its hull with the cloud's middle, in the space that they span if that is less."""
    h = convex_hull(np.vstack([q, np.zeros(q.shape[1])]))
    if h is not None:
        return np.array([v for v in h.vertices if v < len(q)], int)
    e = q - q.mean(0)
    _, w, vt = np.linalg.svd(e, full_matrices=False)
    rank = int((w > SAME * np.sqrt(len(q))).sum())
    if rank == 0:
        return np.array([0])
    y = e @ vt[:rank].T
    if rank == 1:
        return np.unique([y[:, 0].argmin(), y[:, 0].argmax()])
    h = convex_hull(y)
    return np.arange(len(q)) if h is None else np.array(h.vertices)


def _merged(h: Hull, back: np.ndarray) -> Iterator[tuple[set[int], np.ndarray, float, float]]:
    """(corners, normal, offset, area) of the facets of a hull: simplices in one plane together, with the plane of the largest. Areas are those of the points taken back to the space they come from."""
    d = h.points.shape[1]
    s = np.array(h.simplices)
    e = (h.points[s[:, 1:]] - h.points[s[:, :1]]) @ back.T
    area = np.sqrt(np.maximum(0.0, np.linalg.det(e @ e.transpose(0, 2, 1)))) / factorial(d - 1)
    left = np.argsort(-area, kind="stable")
    while len(left):
        top = left[0]
        same = (np.abs(h.normals[left] - h.normals[top]).max(1) <= 1e-7) & (np.abs(h.offsets[left] - h.offsets[top]) <= 1e-7)
        same[0] = True
        yield set(s[left[same]].ravel().tolist()), h.normals[top], h.offsets[top], float(area[left[same]].sum())
        left = left[~same]


def hull_facets(df: DataFrame, dim: int, leaf: int = LEAF) -> DataFrame:
    """(vertices, n, d, area, height): the facets of the convex hull of the points (id, p), two dimensions or more, n x + d = 0 on a facet and below zero inside.

    vertices: ids of its corners in order, of equal points the least. height: the distance of the facet from the middle of the cloud, so the volume is the sum
    of area * height / dim. Rows without finite coordinates take no part; a cloud in one plane, or none, has no facets.

    A facet belongs to the cell of directions that its normal falls in. A point is left out of a cell if another point, the outermost in the cell's middle, is
    farther out in all of the cell's directions; cells with more than `leaf` points are halved along all sides. Of heavy first cells, and of cells that
    halving does not make lighter since their points lie in one plane, parts of `leaf` points keep their own corners alone. So the driver holds the outermost points of the first cells and nothing else; what one
    task takes is a cell, or the corners of one facet where these are more.
    """
    spark = df.sparkSession
    x = df.where(F.col("p").isNotNull() & finite("p")).select("id", F.col("p").cast("array<double>").alias("p"))
    middle, spread, n = covariance(x, dim)
    if n < 2 or not np.isfinite(spread).all():
        return spark.createDataFrame([], FACETS)
    axes = np.linalg.eigh(spread)[1].T
    along = [sum((F.col("p")[j] - float(middle[j])) * float(a[j]) for j in range(dim)) for a in axes]
    ends = x.agg(*(f(c) for c in along for f in (F.min, F.max))).first()
    sides = np.array(ends[1::2]) - np.array(ends[::2])
    if not sides.max() > 0:
        return spark.createDataFrame([], FACETS)
    # a long cloud is made as wide as it is long: its corners stay the same, and the normals of its facets do not crowd into a few cells
    sides = np.maximum(sides, sides.max() / THIN)
    turn, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(dim, dim)))  # so that no cell's side is along the axes of the data
    turn = turn @ (axes / sides[:, None])
    back = np.linalg.inv(turn)

    def scaled(batch: pa.RecordBatch) -> np.ndarray:
        p = _matrix(batch.column("p"), dim) - middle
        return np.stack([sum(p[:, j] * turn[i, j] for j in range(dim)) for i in range(dim)], 1)  # by columns: equal points stay equal

    level = 0
    while 2 * dim << (level + 1) * (dim - 1) <= FIRST_CELLS:
        level += 1
    start = [[side, level, *k] for side in range(2 * dim) for k in product(range(1 << level), repeat=dim - 1)]

    looks = np.stack([_score(np.eye(dim), cell) for cell in start], 1)

    def outermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [None] * len(start)
        for b in batches:
            q = scaled(b)
            if not len(q):
                continue
            s = q @ looks
            for i, at in enumerate(s.argmax(0)):
                if best[i] is None or s[at, i] > best[i][0]:
                    best[i] = (float(s[at, i]), q[at])
        found = [(i, *b) for i, b in enumerate(best) if b is not None]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2].tolist() for f in found], pa.list_(pa.float64()))], names=["i", "s", "q"])

    far = x.mapInArrow(outermost, "i int, s double, q array<double>").groupBy("i").agg(F.max(F.struct("s", "q"))["q"].alias("q")).collect()  # one a first cell
    best = {r["i"]: np.array(r["q"]) for r in far}
    inner = convex_hull(np.unique(np.stack(list(best.values())), axis=0))  # what lies within it is no corner

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, ids = scaled(b), b.column("id").to_numpy(zero_copy_only=False)
            if inner is not None:
                out = (q @ inner.normals.T + inner.offsets).max(1, initial=-np.inf) >= -SAME
                q, ids = q[out], ids[out]
            for i, cell in enumerate(start):
                keep = _reach(q - best[i], cell) >= -SAME
                if keep.any():
                    yield _batch(cell, ids[keep], q[keep], 0, False)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            of = t.column("cell").combine_chunks()
            keys = _matrix(of.chunk(0) if isinstance(of, pa.ChunkedArray) else of, dim + 1)
            cells, where = np.unique(keys, axis=0, return_inverse=True)
            ids, q, top = b.column("id").to_numpy(zero_copy_only=False), _matrix(b.column("q"), dim), _matrix(b.column("top"), dim)
            n, before = (b.column(c).to_numpy(zero_copy_only=False) for c in ("count", "was"))
            for k, cell in enumerate(cells.tolist()):
                at = np.flatnonzero(where.ravel() == k)
                c = int(n[at[0]])
                light = c <= leaf or (c > 0.6 * before[at[0]] > 0 and c <= PLANE * leaf) or cell[1] >= DEEPEST
                for part in [cell] if light else _children(cell):
                    keep = at[_reach(q[at] - top[at], part) >= -SAME]
                    if len(keep):
                        yield _batch(part, ids[keep], q[keep], c, light)

    def thinned(t: pa.Table) -> pa.Table:
        q = _matrix(t.column("q").combine_chunks(), dim)
        return t.select(["cell", "id", "q", "s", "was", "final"]).take(pa.array(np.sort(_corners(q))))

    keys = ["cell", "q", "s", "was", "final"]
    state = cut(x.mapInArrow(first, ROWS).groupBy(*keys).agg(F.min("id").alias("id")).select("cell", "id", "q", "s", "was", "final"))
    leaves = []
    while True:
        cells = cut(state.groupBy("cell").agg(F.max(F.struct("s", "id", "q"))["q"].alias("top"), F.count("*").alias("count"), F.max("was").alias("before")))
        stuck = (F.col("count") > leaf) & (F.col("count") > 0.6 * F.col("before"))
        seen = cells.agg(F.count("*").alias("cells"), F.sum(stuck.cast("long")).alias("stuck")).first()
        if not seen["cells"]:
            break
        j = state.join(cells, "cell")
        if seen["stuck"]:
            parts = j.where(stuck).withColumn("_part", F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / leaf)))
            kept = parts.groupBy("cell", "_part").applyInArrow(thinned, ROWS)
            state = cut(state.join(cells.where(stuck).select("cell"), "cell", "left_anti").unionByName(kept))
            # what came out counts anew; a cell that parts did not make lighter either is halved on
            cells = cut(state.groupBy("cell").agg(F.max(F.struct("s", "id", "q"))["q"].alias("top"), F.count("*").alias("count")))
            j = state.join(cells, "cell")
        out = cut(j.select("cell", "id", "q", "was", "top", "count").mapInArrow(narrow, ROWS))
        leaves.append(out.where("final"))
        state = out.where("NOT final")
    ready = leaves[0]
    for more in leaves[1:]:
        ready = ready.unionByName(more)

    def solved(group: pa.Table) -> pa.Table:
        q, ids = _matrix(group.column("q").combine_chunks(), dim), group.column("id").to_numpy()
        axis, sign, low, high = _box(group.column("cell")[0].as_py())
        h = convex_hull(np.vstack([q, np.zeros(dim)]))  # with the middle, which is inside of every facet of the cloud
        rows = []
        for corners, n, b, area in _merged(h, back) if h is not None else ():
            if len(ids) in corners or sign * n[axis] <= 0:
                continue
            u = np.delete(n, axis) / abs(n[axis])
            if (u >= low - 1e-7).all() and (u <= high + 1e-7).all():  # a facet on the border is found on both sides
                m = turn.T @ n
                length = float(np.sqrt(m @ m))
                m = m / length
                rows.append((sorted(int(ids[i]) for i in corners), m.tolist(), float(b / length - m @ middle), area, -b / length))
        kinds = (pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["vertices", "n", "d", "area", "height"])

    found = ready.select("cell", "id", "q").groupBy("cell").applyInArrow(solved, FACETS)
    return found.groupBy("vertices").agg(F.min(F.struct("n", "d", "area", "height")).alias("f")).select("vertices", "f.*")


def hull_vertices(facets: DataFrame) -> DataFrame:
    """(id) of the corners."""
    return facets.select(F.explode("vertices").alias("id")).distinct()


def hull_measures(facets: DataFrame, dim: int) -> DataFrame:
    """One row: facets, area, volume, and gap, the length of the sum of area * n over the area, which is zero for a closed surface."""
    pull = F.sqrt(sum((F.pow(F.sum(F.col("area") * F.col("n")[i]), 2) for i in range(dim)), F.lit(0.0)))
    return facets.agg(F.count("*").alias("facets"), F.sum("area").alias("area"), (F.sum(F.col("area") * F.col("height")) / dim).alias("volume"), (pull / F.sum("area")).alias("gap"))


def hull_of(df: DataFrame, dim: int) -> tuple[Hull | None, list[int]]:
    """Hull on the driver, as polytopes and regions need it, and the ids of its points: only corners are collected. A hull with very many is better left as hull_facets."""
    corners = df.select("id", "p").join(hull_vertices(hull_facets(df, dim)), "id", "left_semi").orderBy("id").collect()
    return convex_hull(np.array([r["p"] for r in corners])) if corners else None, [r["id"] for r in corners]
