"""Warp fields: a transform for every source point (dense) or control node (sparse), with stiffness between neighbors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.cloud import rigid_transforms
from pointloom.operators.correspond import gather
from pointloom.operators.cells import points_of
from pointloom.operators.session import Rounds, cut, cut_bare


def resample_transforms(edges: DataFrame, transforms: DataFrame, dim: int, rigid: bool = True) -> DataFrame:
    """(id, r, t): weighted means of the transforms of each point's control nodes, edges (q, r, weight); the identity where the weights sum to zero."""
    j = edges.select("q", F.col("r").alias("node"), "weight").join(transforms.select(F.col("id").alias("node"), F.col("r").alias("tr"), "t"), "node")
    size = dim * dim
    sums = j.groupBy("q").agg(F.sum("weight").alias("w"), *(F.sum(F.col("weight") * F.col("tr")[i]).alias(f"r{i}") for i in range(size)), *(F.sum(F.col("weight") * F.col("t")[i]).alias(f"t{i}") for i in range(dim)))
    eye = np.eye(dim).ravel()
    ok = F.col("w") != 0
    out = sums.select(F.col("q").alias("id"), F.array(*(F.when(ok, F.col(f"r{i}") / F.col("w")).otherwise(float(eye[i])) for i in range(size))).alias("r"), F.array(*(F.when(ok, F.col(f"t{i}") / F.col("w")).otherwise(0.0) for i in range(dim))).alias("t"))
    return rigid_transforms(out, dim) if rigid else out


def sqrt_huber(x: np.ndarray, delta: float) -> np.ndarray:
    a = np.abs(x)
    return np.where(a <= delta, a / np.sqrt(2), np.sqrt(np.maximum(0, delta * (a - delta / 2))))


def sqrt_huber_slope(x: np.ndarray, delta: float) -> np.ndarray:
    s = sqrt_huber(x, delta)
    return np.where(np.abs(x) <= delta, np.sign(x) / np.sqrt(2), np.sign(x) * delta / (2 * np.maximum(s, 1e-300)))


def euler(a: np.ndarray, dim: int):
    """(rotations, their derivatives by each angle) of n x angles."""
    n = len(a)
    if dim == 2:
        c, s = np.cos(a[:, 0]), np.sin(a[:, 0])
        r = np.stack([np.stack([c, -s], 1), np.stack([s, c], 1)], 1)
        return r, [np.stack([np.stack([-s, -c], 1), np.stack([c, -s], 1)], 1)]
    c, s, z, o = np.cos(a), np.sin(a), np.zeros(n), np.ones(n)
    mat = lambda rows: np.array(rows).transpose(2, 0, 1)
    rx = lambda c, s, o: mat([[o, z, z], [z, c, -s], [z, s, c]])
    ry = lambda c, s, o: mat([[c, z, s], [z, o, z], [-s, z, c]])
    rz = lambda c, s, o: mat([[c, -s, z], [s, c, z], [z, z, o]])
    x, y, w = rx(c[:, 0], s[:, 0], o), ry(c[:, 1], s[:, 1], o), rz(c[:, 2], s[:, 2], o)
    dx, dy, dw = rx(-s[:, 0], c[:, 0], z), ry(-s[:, 1], c[:, 1], z), rz(-s[:, 2], c[:, 2], z)
    return w @ y @ x, [w @ y @ dx, w @ dy @ x, dw @ y @ x]


ONE_SOLVE, ONE_BLOCKS = 50_000, 400_000  # unknowns, and blocks of the matrix, up to which one solve takes them all; beyond, vectors stay DataFrames
BUCKET_ROWS, ENTRIES = 20_000, 200_000  # matches of a task's group; pairs of nodes summed at once


def moved_and_slopes(x: np.ndarray, p: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(n x dim, n x dim x unknowns): the points p warped by their blended unknowns x, and the derivative by each unknown."""
    n, dim = p.shape
    slopes = np.zeros((n, dim, x.shape[1]))
    shift = x.shape[1] - dim
    if kind == "affine":
        y = np.einsum("nij,nj->ni", x[:, :shift].reshape(n, dim, dim), p)
        for i in range(dim):
            slopes[:, i, i * dim : (i + 1) * dim] = p
    else:
        turned, by = euler(x[:, :shift], dim)
        y = np.einsum("nij,nj->ni", turned, p)
        for a, d in enumerate(by):
            slopes[:, :, a] = np.einsum("nij,nj->ni", d, p)
    for i in range(dim):
        slopes[:, i, shift + i] = 1
    return y + x[:, shift:], slopes


def added_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values


def _huber_columns(gap: Column, delta: float) -> tuple[Column, Column]:
    """sqrt_huber and its slope as expressions."""
    a = F.abs(gap)
    value = F.when(a <= delta, a / 2**0.5).otherwise(F.sqrt(F.greatest(F.lit(0.0), delta * (a - delta / 2))))
    return value, F.when(a <= delta, F.signum(gap) / 2**0.5).otherwise(F.signum(gap) * delta / (2 * F.greatest(value, F.lit(1e-300))))


def _dot(a: str, b: str, size: int) -> Column:
    return F.sum(sum((F.col(a)[i] * F.col(b)[i] for i in range(size)), F.lit(0.0)))


def inverse_blocks(blocks: np.ndarray, whole: bool = True) -> np.ndarray:
    """Inverses of the diagonal blocks of a system, to scale it by: far from the origin turns and shifts of a node are nearly the same, which their diagonal alone
    does not tell. Where a block as good as leaves a direction open, or without `whole`, the inverse of its diagonal.
    """
    size = blocks.shape[1]
    diagonal = np.einsum("nii->ni", blocks)
    root = np.where(diagonal > 0, 1 / np.sqrt(np.where(diagonal > 0, diagonal, 1)), 1)
    even = blocks * root[:, :, None] * root[:, None, :]
    values = np.linalg.eigvalsh((even + even.transpose(0, 2, 1)) / 2) if len(even) else np.ones((0, size))
    even[(values[:, 0] < 1e-9) | (not whole)] = np.eye(size)
    return np.linalg.inv(even) * root[:, :, None] * root[:, None, :]


def solve_blocks(matrix: DataFrame, rhs: DataFrame, size: int, max_iter: int = 1000, tol: float = 1e-5, whole: bool = True) -> DataFrame:
    """(id, x) with matrix x = rhs by conjugate gradients, scaled by inverse_blocks.

    matrix (row, col, h: size x size numbers) is symmetric and positive, rows of one place add up; rhs is (id, v) of every node. A step joins the matrix with the
    direction, adds up for each row, and sends four sums to the driver; vectors are columns of one table, written over the one before the last.
    """
    zero, many = F.array(*[F.lit(0.0)] * size), size * size

    @F.pandas_udf("array<double>")
    def inverted(h: pd.Series) -> pd.Series:
        return pd.Series(inverse_blocks(np.stack(h).reshape(-1, size, size), whole).reshape(-1, many).tolist()) if len(h) else h

    times = lambda v: F.array(*(sum((F.col("s")[i * size + j] * F.col(v)[j] for j in range(size)), F.lit(0.0)) for i in range(size)))
    own = matrix.where("row = col").groupBy(F.col("row").alias("id")).agg(F.array(*(F.sum(F.col("h")[i]) for i in range(many))).alias("h"))
    own = own.select("id", inverted("h").alias("s"))
    eye = F.array(*(F.lit(float(i % (size + 1) == 0)) for i in range(many)))
    state = rhs.join(own, "id", "left").select("id", zero.alias("x"), F.col("v").alias("r"), F.coalesce("s", eye).alias("s"))
    tables = Rounds(state, 2)
    state = tables.written(state.withColumn("z", times("r")).withColumn("p", F.col("z")))
    dealt, stop = matrix.repartition("col").persist(), None
    try:
        for _ in range(max_iter):
            images = dealt.join(state.select(F.col("id").alias("col"), "p").hint("merge"), "col").groupBy("row").agg(F.array(*(F.sum(sum((F.col("h")[i * size + j] * F.col("p")[j] for j in range(size)), F.lit(0.0))) for i in range(size))).alias("m"))
            state = state.join(images.withColumnRenamed("row", "_row"), F.col("id") == F.col("_row"), "left").drop("_row")
            state = tables.written(state.withColumn("m", F.coalesce("m", zero)).withColumn("sm", times("m")))
            rz, pm, rm, mm = (v or 0.0 for v in state.agg(_dot("r", "z", size), _dot("p", "m", size), _dot("z", "m", size), _dot("m", "sm", size)).first())
            stop = tol * tol * max(rz, 1e-300) if stop is None else stop
            if rz <= stop or pm <= 0:
                break
            a = rz / pm
            left = max(0.0, rz - 2 * a * rm + a * a * mm)  # of the next residual
            less = lambda u, v, a=a: [F.col(u)[i] - a * F.col(v)[i] for i in range(size)]
            z = less("z", "sm")
            state = state.select("id", F.array(*less("x", "p", -a)).alias("x"), F.array(*less("r", "m")).alias("r"), "s", F.array(*z).alias("z"), F.array(*(z[i] + left / rz * F.col("p")[i] for i in range(size))).alias("p"))
        return cut_bare(state.select("id", "x"))
    finally:
        dealt.unpersist()


def solve_at_once(matrix: DataFrame, rhs: DataFrame, size: int, max_iter: int = 1000, tol: float = 1e-5, whole: bool = True) -> DataFrame:
    """As solve_blocks, for a system of at most ONE_SOLVE unknowns and ONE_BLOCKS blocks, which one task takes."""

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        ids = np.sort(b.column("id").to_numpy())
        v = np.zeros((len(ids), size))
        v[np.searchsorted(ids, b.column("id").to_numpy())] = points_of(b.column("v")).reshape(-1, size)
        i, j = (np.searchsorted(ids, a.column(c).to_numpy()) for c in ("row", "col"))
        h = points_of(a.column("h")).reshape(-1, size, size)
        order = np.argsort(i, kind="stable")
        i, j, h = i[order], j[order], h[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))

        def mul(y: np.ndarray) -> np.ndarray:
            out = np.zeros_like(y)
            if len(i):
                out[i[first]] = np.add.reduceat(np.matmul(h, y[j][:, :, None])[:, :, 0], first, axis=0)
            return out

        own = np.zeros((len(ids), size, size))
        np.add.at(own, i[i == j], h[i == j])
        scale = inverse_blocks(own, whole)
        scaled = lambda y: np.matmul(scale, y[:, :, None])[:, :, 0]
        x, r = np.zeros_like(v), v
        p = z = scaled(r)
        rz = float((r * z).sum())
        stop = tol * tol * max(rz, 1e-300)
        for _ in range(max_iter):
            if rz <= stop:
                break
            m = mul(p)
            k = rz / max(float((p * m).sum()), 1e-300)
            x, r = x + k * p, r - k * m
            z = scaled(r)
            rz, old = float((r * z).sum()), rz
            p = z + rz / old * p
        return pa.table([pa.array(ids), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "x"])

    one = F.lit(0).alias("k")
    return cut_bare(matrix.select(one, "row", "col", "h").groupBy("k").cogroup(rhs.select(one, "id", "v").groupBy("k")).applyInArrow(run, "id long, x array<double>"))


@dataclass
class WarpRegistration:
    """Closest-point loop of a warp field: each node has a transform, source points blend those of their nodes.

    control (q: source id, r: node id, weight) and arcs (q, r: node ids, weight) are DataFrames; so are clouds, matches, and the unknowns (id, x) of the nodes,
    however many. Each Gauss-Newton step aggregates the matches to blocks between nodes, ties arcs by the Huber loss, and
    solves by conjugate gradients whose vectors stay DataFrames (small systems: in one task).
    """

    dst: DataFrame
    src: DataFrame
    control: DataFrame
    arcs: DataFrame
    engine: object
    dim: int = 3
    kind: str = "rigid"  # or affine
    w_point: float = 0.0
    w_plane: float = 1.0
    stiffness: float = 1.0
    huber: float = 1e-4
    max_iter: int = 15
    tol: float = 1e-5
    steps: int = 10
    step_tol: float = 1e-5
    cg_iter: int = 1000

    def __post_init__(self):
        control = cut_bare(self.control.select(F.col("q").cast("long").alias("q"), F.col("r").cast("long").alias("r"), F.col("weight").cast("double").alias("weight")))  # a search, done once
        ends = control.select(F.col("r").alias("id")).union(self.arcs.select(F.col("q").alias("id"))).union(self.arcs.select(F.col("r").alias("id")))
        self.nodes = cut(ends.select(F.col("id").cast("long").alias("id")).distinct())
        lists = control.where("weight > 0").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "weight"))).alias("n"), F.sum("weight").alias("total"))
        self.lists = cut_bare(lists.select("q", F.transform("n", lambda e: F.struct(e["r"].alias("r"), (e["weight"] / F.col("total")).alias("share"))).alias("n")))
        self.shares = self.lists.select("q", F.explode("n").alias("n")).select("q", "n.r", "n.share")
        self.ties = cut(self.arcs.where("q <> r").select("q", "r", F.col("weight").cast("double").alias("weight")))
        self.angles = 0 if self.kind == "affine" else 1 if self.dim == 2 else 3
        self.size = self.dim**2 + self.dim if self.kind == "affine" else self.angles + self.dim

    def start(self) -> DataFrame:
        """(id, x): the identity at every node."""
        x = [*np.eye(self.dim).ravel(), *[0.0] * self.dim] if self.kind == "affine" else [0.0] * self.size
        return self.nodes.select("id", F.array(*(F.lit(float(v)) for v in x)).alias("x"))

    def dealt(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows, halo): matches with the nodes of their source point, those of one nearest node in one bucket, and the nodes that each bucket sees. One table serves all steps of a round."""
        ends = pairs.select("second", "p1", "p2", *(["n1"] if self.w_plane > 0 else []))
        rows = ends.join(self.lists.withColumnRenamed("q", "second"), "second").drop("second")
        main = F.element_at(F.array_sort(F.transform("n", lambda e: F.struct((-e["share"]).alias("s"), e["r"].alias("r")))), 1)["r"]
        buckets = max(1, -(-pairs.count() // BUCKET_ROWS))
        rows = cut_bare(rows.select("p1", "p2", *ends.columns[3:], F.col("n.r").alias("r"), F.col("n.share").alias("share"), F.pmod(F.xxhash64(main), F.lit(buckets)).alias("bucket")))
        ways = [1] * buckets
        for b, n in rows.groupBy("bucket").count().collect():  # a line a bucket; that of a node with many is dealt to several tasks
            ways[b] = -(-n // (2 * BUCKET_ROWS))
        of = F.element_at(F.lit(ways).cast("array<bigint>"), (F.col("bucket") + 1).cast("int"))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("p1", "p2"), of))
        return rows, cut_bare(rows.select("bucket", "part", F.explode("r").alias("id")).distinct())

    def _matches(self, dealt: tuple[DataFrame, DataFrame], x: DataFrame) -> DataFrame:
        """(i, j, h, v): blocks with i <= j, their upper halves, and the right side where i = j. Each bucket adds up its own before they move."""
        size, kind, dim, w_point, w_plane = self.size, self.kind, self.dim, self.w_point, self.w_plane
        p, q = (np.array(c) for c in zip(*self._upper(), strict=True))

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            ids = right.column("id").to_numpy()
            order = np.argsort(ids)
            ids, field = ids[order], points_of(right.column("x"))[order]
            lists, keys, sums = left.column("r").combine_chunks(), [], []
            count = np.diff(lists.offsets.to_numpy()) if left.num_rows and len(ids) else np.zeros(0, int)
            node, share = np.searchsorted(ids, lists.flatten().to_numpy()), left.column("share").combine_chunks().flatten().to_numpy()
            start = np.cumsum(count) - count
            p1, p2 = (points_of(left.column(c)) for c in ("p1", "p2"))
            n1 = points_of(left.column("n1")) if w_plane > 0 else None
            for c in np.unique(count):
                every, few = np.flatnonzero(count == c), max(1, ENTRIES // (c * (c + 1) // 2))
                for at in range(0, len(every), few):
                    rows = every[at : at + few]
                    where = start[rows][:, None] + np.arange(c)
                    n, w = node[where], share[where]
                    y, slopes = moved_and_slopes(np.einsum("nc,ncs->ns", w, field[n]), p2[rows], kind)
                    gap = p1[rows] - y
                    h, v = np.zeros((len(rows), len(p))), np.zeros((len(rows), size))
                    if w_point > 0:
                        h += w_point * np.einsum("nds,ndt->nst", slopes, slopes)[:, p, q]
                        v += w_point * np.einsum("nds,nd->ns", slopes, gap)
                    if w_plane > 0:
                        g = np.einsum("nd,nds->ns", n1[rows], slopes)
                        h += w_plane * g[:, p] * g[:, q]
                        v += w_plane * g * (n1[rows] * gap).sum(1)[:, None]
                    a, b = np.triu_indices(c)
                    twice = np.where((a != b) & (n[:, a] == n[:, b]), 2.0, 1.0)  # a node that is listed twice
                    values = np.concatenate([h[:, None, :] * (twice * w[:, a] * w[:, b])[:, :, None], v[:, None, :] * np.where(a == b, w[:, a], 0.0)[:, :, None]], axis=2)
                    k, t = added_up((n[:, a] * len(ids) + n[:, b]).ravel(), values.reshape(-1, values.shape[2]))
                    keys.append(k), sums.append(t)
            k, t = added_up(np.concatenate([*keys, np.zeros(0, int)]), np.concatenate([*sums, np.zeros((0, len(p) + size))]))
            of = lambda y: pa.ListArray.from_arrays(pa.array((np.arange(len(y) + 1) * y.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(y).ravel()))
            return pa.table([pa.array(ids[k // max(1, len(ids))]), pa.array(ids[k % max(1, len(ids))]), of(t[:, : len(p)]), of(t[:, len(p) :])], names=["i", "j", "h", "v"])

        rows, halo = dealt
        seen = halo.join(x, "id")
        found = rows.groupBy("bucket", "part").cogroup(seen.groupBy("bucket", "part")).applyInArrow(run, "i long, j long, h array<double>, v array<double>")
        return found.groupBy("i", "j").agg(F.array(*(F.sum(F.col("h")[k]) for k in range(len(p)))).alias("h"), F.array(*(F.sum(F.col("v")[k]) for k in range(size))).alias("v"))

    def _upper(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.size) for j in range(i, self.size)]

    def system(self, dealt: tuple[DataFrame, DataFrame], x: DataFrame) -> tuple[DataFrame, DataFrame]:
        """matrix (row, col, h) and rhs (id, v) of a Gauss-Newton step from x."""
        size, at = self.size, {p: k for k, p in enumerate(self._upper())}
        blocks = cut_bare(self._matches(dealt, x))
        square = F.array(*(F.col("h")[at[min(p, q), max(p, q)]] for p in range(size) for q in range(size)))
        one = blocks.select(F.col("i").alias("row"), F.col("j").alias("col"), square.alias("h"))
        ends = self.ties.join(x.toDF("q", "xq"), "q").join(x.toDF("r", "xr"), "r")
        k = F.sqrt(self.stiffness * F.col("weight"))
        slopes, pulls = [], []
        for p in range(size):
            gap = F.col("xq")[p] - F.col("xr")[p]
            value, slope = _huber_columns(gap, self.huber)
            flat = F.abs(gap) < 1e-12  # where the loss has its kink the arc still ties both ends
            slope = F.when(flat, k / 2**0.5).otherwise(k * slope)
            slopes.append(slope * slope)
            pulls.append(F.when(flat, 0.0).otherwise(slope * k * value))
        arcs = cut_bare(ends.select("q", "r", F.array(*slopes).alias("d"), F.array(*pulls).alias("g")))
        diagonal = lambda sign: F.array(*(sign * F.col("d")[p] if p == q else F.lit(0.0) for p in range(size) for q in range(size)))
        tied = arcs.select(F.explode(F.array(*(F.struct(F.col(a).alias("row"), F.col(b).alias("col"), diagonal(1.0 if a == b else -1.0).alias("h")) for a in "qr" for b in "qr"))).alias("e")).select("e.*")
        matrix = one.union(one.where("row <> col").select("col", "row", "h")).union(tied)
        signed = lambda sign: F.transform("g", lambda v: sign * v)
        sides = blocks.where("i = j").select(F.col("i").alias("id"), "v").union(arcs.select("q", signed(-1.0))).union(arcs.select("r", signed(1.0)))
        sums = sides.groupBy("id").agg(F.array(*(F.sum(F.col("v")[p]) for p in range(size))).alias("v"))
        zero = F.array(*[F.lit(0.0)] * size)
        return cut_bare(matrix), self.nodes.join(sums, "id", "left").select("id", F.coalesce("v", zero).alias("v"))

    def step(self, dealt: tuple[DataFrame, DataFrame], x: DataFrame) -> tuple[DataFrame, float]:
        """(x after a Gauss-Newton step, the longest move of a node)."""
        matrix, rhs = self.system(dealt, x)
        few = self.nodes.count() * self.size <= ONE_SOLVE and matrix.count() <= ONE_BLOCKS
        moved = (solve_at_once if few else solve_blocks)(matrix, rhs, self.size, self.cg_iter, whole=self.kind == "rigid")
        longest = moved.agg(F.max(F.sqrt(sum((F.col("x")[p] * F.col("x")[p] for p in range(self.size)), F.lit(0.0))))).first()[0] or 0.0
        both = x.join(moved.withColumnRenamed("x", "dx"), "id")
        return cut_bare(both.select("id", F.array(*(F.col("x")[p] + F.col("dx")[p] for p in range(self.size))).alias("x"))), longest

    def transforms(self, x: DataFrame) -> DataFrame:
        """(id, r, t) of each node."""
        dim, angles = self.dim, self.angles
        if self.kind == "affine":
            r = F.slice("x", 1, dim * dim)
        else:
            @F.pandas_udf("array<double>")
            def turned(a: pd.Series) -> pd.Series:
                return pd.Series(euler(np.stack(a)[:, :angles], dim)[0].reshape(len(a), -1).tolist()) if len(a) else a

            r = turned("x")
        return x.select("id", r.alias("r"), F.slice("x", self.size - dim + 1, dim).alias("t"))

    def field(self, x: DataFrame) -> DataFrame:
        """(id, r, t) of each source point: the blend of its nodes' transforms."""
        return resample_transforms(self.shares.withColumnRenamed("share", "weight"), self.transforms(x), self.dim, self.kind == "rigid")

    def moved(self, x: DataFrame) -> DataFrame:
        """The source under the field; points without a node stay."""
        j = self.src.join(self.field(x).withColumnsRenamed({"r": "_r", "t": "_t"}), "id", "left")
        at = F.array(*(sum((F.col("_r")[i * self.dim + k] * F.col("p")[k] for k in range(self.dim)), F.col("_t")[i]) for i in range(self.dim)))
        return j.withColumn("p", F.when(F.col("_r").isNull(), F.col("p")).otherwise(at)).select(*self.src.columns)

    def _change(self, before: DataFrame, after: DataFrame) -> float:
        gap = lambda a, b, n: sum(((F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(n)), F.lit(0.0))
        both = self.transforms(before).join(self.transforms(after).toDF("id", "r2", "t2"), "id")
        return both.agg(F.max(F.sqrt(gap("r", "r2", self.dim**2)) + F.sqrt(gap("t", "t2", self.dim)))).first()[0] or 0.0

    def run(self) -> tuple[DataFrame, int, bool]:
        """((id, x): the unknowns of each node, rounds, converged)."""
        x = cut(self.start())
        eye, zero = np.eye(self.dim), np.zeros(self.dim)
        for rounds in range(1, self.max_iter + 1):
            moved = self.src if rounds == 1 else cut(self.moved(x))
            dealt = self.dealt(cut_bare(gather(self.engine.find(self.dst, moved, eye, zero), self.dst, self.src)))
            before = x
            for _ in range(self.steps):
                x, longest = self.step(dealt, x)
                if longest < self.step_tol:
                    break
            if self._change(before, x) < self.tol:
                return x, rounds, True
        return x, self.max_iter, False
