"""Transform estimation and iterative closest points. Sums over correspondences are one aggregation; small systems are solved on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import affine, cross3, l2sq, matvec, vadd, vdot, vsub
from pointloom.operators.cloud import nearest_rotation, transform
from pointloom.operators.correspond import correspondences, gather, index_of, matched_points


def fit_rigid(d: np.ndarray, s: np.ndarray):
    """(R, t) with d ~ R s + t, without scale; None below dim points."""
    if len(d) < d.shape[1]:
        return None
    return rigid_from_sums(d.mean(0), s.mean(0), (d - d.mean(0)).T @ (s - s.mean(0)) / len(d))


def rigid_from_sums(md: np.ndarray, ms: np.ndarray, sigma: np.ndarray):
    u, _, vt = np.linalg.svd(sigma)
    e = np.ones(len(md))
    e[-1] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    r = u @ np.diag(e) @ vt
    return r, md - r @ ms


def fit_affine(d: np.ndarray, s: np.ndarray):
    if len(d) < d.shape[1] + 1:
        return None
    theta, *_ = np.linalg.lstsq(np.column_stack([s, np.ones(len(s))]), d, rcond=None)
    return theta[:-1].T, theta[-1]


def point_sums(pairs: DataFrame, dim: int) -> DataFrame:
    """One row: n, means d_i and s_i, population cross-covariances x_ij of p1 and p2."""
    d, s = (lambda i: F.col("p1")[i]), (lambda i: F.col("p2")[i])
    return pairs.agg(F.count("*").alias("n"), *(F.avg(d(i)).alias(f"d{i}") for i in range(dim)), *(F.avg(s(i)).alias(f"s{i}") for i in range(dim)), *(F.covar_pop(d(i), s(j)).alias(f"x{i}{j}") for i in range(dim) for j in range(dim)), *(F.covar_pop(s(i), s(j)).alias(f"y{i}{j}") for i in range(dim) for j in range(dim)))


def estimate_point_to_point(pairs: DataFrame, dim: int, rigid: bool = True):
    """(R, t) of correspondences with p1 (destination) and p2 (source); None with too few."""
    row = point_sums(pairs, dim).first()
    if row["n"] < (dim if rigid else dim + 1):
        return None
    take = lambda c: np.array([row[f"{c}{i}"] for i in range(dim)])
    mat = lambda c: np.array([[row[f"{c}{i}{j}"] for j in range(dim)] for i in range(dim)])
    if rigid:
        return rigid_from_sums(take("d"), take("s"), mat("x"))
    if np.linalg.matrix_rank(mat("y")) < dim:
        return None
    a = mat("x") @ np.linalg.inv(mat("y"))
    return a, take("d") - a @ take("s")


def normal_equations(rows: list[tuple[list[Column], Column, Column]]) -> list[Column]:
    """Aggregates of A^T A (upper half) and A^T b of weighted rows (coefficients, right side, weight)."""
    k = len(rows[0][0])
    out = [F.sum(sum((w * a[i] * a[j] for a, _, w in rows), F.lit(0.0))).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    return out + [F.sum(sum((w * a[i] * b for a, b, w in rows), F.lit(0.0))).alias(f"b{i}") for i in range(k)]


def _solve(row, k: int) -> np.ndarray:
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    return np.linalg.lstsq(a, np.array([row[f"b{i}"] or 0.0 for i in range(k)]), rcond=None)[0]


def _used(w) -> bool:
    return isinstance(w, Column) or w > 0


def _weight(w) -> Column:
    return w if isinstance(w, Column) else F.lit(float(w))


def combined_rows_3d(d: Column, s: Column, n: Column, w_point, w_plane) -> list:
    """Point rows [(d + s) x, I], plane row [(d + s) x n, n], right side d - s."""
    b, c = vadd(d, s), vsub(d, s)
    z, one = F.lit(0.0), F.lit(1.0)
    skew = [[z, b[2], -b[1]], [-b[2], z, b[0]], [b[1], -b[0], z]]
    rows = []
    if _used(w_point):
        rows += [([*skew[i], *(one if i == j else z for j in range(3))], c[i], _weight(w_point)) for i in range(3)]
    if _used(w_plane):
        x = cross3(b, n)
        rows.append(([x[0], x[1], x[2], n[0], n[1], n[2]], vdot(n, c), _weight(w_plane)))
    return rows


def combined_rows_2d(d: Column, s: Column, n: Column, w_point, w_plane) -> list:
    b, c = vadd(d, s), vsub(d, s)
    z, one = F.lit(0.0), F.lit(1.0)
    rows = []
    if _used(w_point):
        rows += [([-b[1], one, z], c[0], _weight(w_point)), ([b[0], z, one], c[1], _weight(w_point))]
    if _used(w_plane):
        rows.append(([-b[1] * n[0] + b[0] * n[1], n[0], n[1]], vdot(n, c), _weight(w_plane)))
    return rows


def _rotation(a: np.ndarray) -> tuple[np.ndarray, float]:
    """Rotation by atan|a| about a, and that angle (a: vector in space, one number in the plane)."""
    if len(a) == 1:
        t = np.arctan(a[0])
        return np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]), abs(t)
    size = np.linalg.norm(a)
    t = np.arctan(size)
    if size < 1e-300:
        return np.eye(3), 0.0
    x, y, z = a / size
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k, t


def estimate_combined(pairs: DataFrame, dim: int = 3, w_point=0.0, w_plane=1.0, symmetric: bool = False, rigid: bool = True, max_iter: int = 1, tol: float = 1e-5, start=None):
    """(R, t) minimizing weighted point-to-point and point-to-plane terms of pairs (p1, n1, p2[, n2]); symmetric adds the source's turned normals. Weights are numbers or columns of the pairs."""
    r, t = start if start is not None else (np.eye(dim), np.zeros(dim))
    means = pairs.agg(*(F.avg(F.col(c)[i]) for c in ("p1", "p2") for i in range(dim))).first()
    if means[0] is None:
        return None
    md, ms = np.array(means[:dim]), np.array(means[dim:])
    if not rigid:
        d, s, n = affine(np.eye(dim), -md, "p1"), affine(np.eye(dim), -ms, "p2"), F.col("n1")
        z = F.lit(0.0)
        rows = [([n[i] * s[j] for i in range(dim) for j in range(dim)] + [n[i] for i in range(dim)], vdot(n, d), _weight(w_plane))] if _used(w_plane) else []
        if _used(w_point):
            rows += [([s[j] if i == k else z for k in range(dim) for j in range(dim)] + [F.lit(float(i == k)) for k in range(dim)], d[i], _weight(w_point)) for i in range(dim)]
        x = _solve(pairs.agg(*normal_equations(rows)).first(), dim * dim + dim)
        a = x[: dim * dim].reshape(dim, dim)
        return a, x[dim * dim :] + md - a @ ms
    for _ in range(max_iter):
        ms_now = r @ ms + t
        d, s = affine(np.eye(dim), -md, "p1"), affine(r, t - ms_now, "p2")
        n = vadd("n1", matvec(r, "n2")) if symmetric else F.col("n1")
        build = combined_rows_3d if dim == 3 else combined_rows_2d
        x = _solve(pairs.agg(*normal_equations(build(d, s, n, w_point, w_plane))).first(), 6 if dim == 3 else 3)
        a, shift = (x[:3], x[3:]) if dim == 3 else (x[:1], x[1:])
        half, angle = _rotation(a)
        ra, ta = half @ half, half @ (np.cos(angle) * shift)
        # about the means: d - md ~ Ra (s - ms_now) + ta
        r, t = ra @ r, ra @ (t - ms_now) + ta + md
        if np.linalg.norm(x) < tol:
            break
    return r, t


class IcpInstance(Protocol):
    """The steps of a closest-point loop over a state of the instance's own kind: where it starts, the pairs that it sees, what it makes of them (None: nothing), and how far that is from before."""

    def initialise(self, start=None): ...

    def correspondences(self, state) -> DataFrame: ...

    def estimate(self, pairs: DataFrame, state): ...

    def change(self, before, after) -> float: ...


def closest_point_loop(icp: IcpInstance, max_iter: int = 15, tol: float = 1e-5, start=None) -> tuple[object, int, bool]:
    """(state, rounds, converged): correspond, estimate, until a change is below tol."""
    state = icp.initialise(start)
    for rounds in range(1, max_iter + 1):
        new = icp.estimate(icp.correspondences(state), state)
        if new is None:
            return state, rounds, False
        delta, state = icp.change(state, new), new
        if delta < tol:
            return state, rounds, True
    return state, max_iter, False


@dataclass
class Registration:
    """Closest-point loop: correspond, estimate, compose, until the step is below tol."""

    dst: DataFrame
    src: DataFrame
    dim: int = 3
    metric: str = "point"  # point, combined, symmetric
    rigid: bool = True
    max_distance: float = 0.01  # squared
    max_iter: int = 15
    tol: float = 1e-5
    w_point: float = 0.0
    w_plane: float = 1.0
    direction: str = "second_to_first"
    fraction: float = 1.0
    one_to_one: bool = False
    engine: object = None  # see engines.Engine and engines.CombinedMetric; None: nearest neighbors by the settings above
    _index: tuple = field(default=(None, None), init=False, repr=False)  # the destination, and its cells

    def pairs(self, r, t) -> DataFrame:
        if hasattr(self.engine, "pairs") and not hasattr(self.engine, "find"):
            return self.engine.pairs(self.dst, self.src, r, t, self.w_point, self.w_plane)
        if self.engine is not None:
            return gather(self.engine.find(self.dst, self.src, r, t), self.dst, self.src)
        moved = transform(self.src.select("id", "p"), r, t)
        if self.rigid and self.metric == "point" and (self.direction, self.fraction, self.one_to_one) == ("second_to_first", 1.0, False):
            if self._index[0] is not self.dst:
                self._index = self.dst, index_of(self.dst)
            if self._index[1] is not None:
                found, turn = matched_points(self._index[1], moved, self.max_distance), np.asarray(r).T
                return found.withColumn("p2", affine(turn, -turn @ np.asarray(t), "p2"))
        c = correspondences(self.dst.select("id", "p"), moved, self.max_distance, self.direction, fraction=self.fraction, one_to_one=self.one_to_one)
        return gather(c, self.dst, self.src)

    def step(self, r, t):
        return self.estimate(self.pairs(r, t), (r, t))

    def initialise(self, start=None):
        return start if start is not None else (np.eye(self.dim), np.zeros(self.dim))

    def correspondences(self, state) -> DataFrame:
        return self.pairs(*state)

    def estimate(self, pairs: DataFrame, state):
        if self.metric == "point":
            new = estimate_point_to_point(pairs, self.dim, self.rigid)
        else:
            each = "wp" in pairs.columns
            new = estimate_combined(pairs, self.dim, F.col("wp") if each else self.w_point, F.col("wl") if each else self.w_plane, self.metric == "symmetric", self.rigid, 1, self.tol, state)
        return (nearest_rotation(new[0]), new[1]) if new is not None and self.rigid else new

    def change(self, before, after) -> float:
        dr = after[0] @ np.linalg.inv(before[0])
        return float(np.sqrt(((dr - np.eye(self.dim)) ** 2).sum() + ((after[1] - dr @ before[1]) ** 2).sum()))

    def run(self, start=None) -> tuple[np.ndarray, np.ndarray, int, bool]:
        """(R, t, rounds, converged)."""
        state, rounds, done = closest_point_loop(self, self.max_iter, self.tol, start)
        return *state, rounds, done

    def residuals(self, r, t) -> DataFrame:
        """(id, residual) of each source point at its nearest destination: squared distances, or weighted with the squared distance to its plane."""
        from pointloom.operators.neighbors import knn

        moved = transform(self.src, r, t)
        near = knn(moved.select("id", "p"), self.dst.select("id", "p"), 1).select(F.col("r").alias("first"), F.col("q").alias("second"), "value")
        if self.metric == "point":
            return near.select(F.col("second").alias("id"), F.col("value").alias("residual"))
        g = gather(near, self.dst, moved)
        n = vadd("n1", "n2") if self.metric == "symmetric" else F.col("n1")
        plane = vdot(n, vsub("p1", "p2"))
        return g.select(F.col("second").alias("id"), (self.w_point * l2sq("p1", "p2") + self.w_plane * plane * plane).alias("residual"))
