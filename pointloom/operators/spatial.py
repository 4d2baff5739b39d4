"""Convex hulls, polytopes and regions. Their facets are few and live on the driver; membership of points runs as expressions or a join."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9


@dataclass
class Hull:
    points: np.ndarray
    simplices: list[tuple[int, ...]]  # facets, split into simplices
    normals: np.ndarray  # of the simplices, outward
    offsets: np.ndarray

    @property
    def vertices(self) -> list[int]:
        return sorted({i for s in self.simplices for i in s})

    def halfspaces(self) -> np.ndarray:
        """Distinct [n, d] with n x + d <= 0 inside."""
        rows: list[np.ndarray] = []
        scale = np.abs(self.points - self.points.mean(0)).max() + 1e-8 * np.abs(self.points).max()
        for h in np.column_stack([self.normals, self.offsets]):
            if not any(np.abs(h[:-1] - r[:-1]).max() <= 1e-7 and abs(h[-1] - r[-1]) <= 1e-7 * scale for r in rows):
                rows.append(h)
        return np.array(rows)

    def facets(self) -> list[list[int]]:
        """Vertices of each facet, simplices in one plane together."""
        planes = self.halfspaces()
        out: list[set[int]] = [set() for _ in planes]
        for s, h in zip(self.simplices, np.column_stack([self.normals, self.offsets]), strict=True):
            out[int(np.abs(planes - h).sum(1).argmin())].update(s)
        return [sorted(f) for f in out]

    def neighbors(self) -> list[list[int]]:
        """For each facet those that share d - 1 vertices or more."""
        f, d = [set(x) for x in self.facets()], self.points.shape[1]
        return [[j for j, b in enumerate(f) if j != i and len(a & b) >= d - 1] for i, a in enumerate(f)]

    def area(self) -> float:
        d = self.points.shape[1]
        total = 0.0
        for s in self.simplices:
            e = self.points[list(s[1:])] - self.points[s[0]]
            total += np.sqrt(max(0.0, np.linalg.det(e @ e.T))) / factorial(d - 1)
        return float(total)

    def volume(self) -> float:
        d, c = self.points.shape[1], self.points[self.vertices].mean(0)
        return float(sum(abs(np.linalg.det(self.points[list(s)] - c)) for s in self.simplices) / factorial(d))


def _planes(p: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normals, offsets) of simplices [n, d, d], outward."""
    e = p[:, 1:] - p[:, :1]
    n = np.linalg.svd(e)[2][:, -1] if len(p) else np.empty((0, len(inside)))
    b = -(n * p[:, 0]).sum(1)
    out = np.where(n @ inside + b <= 0, 1.0, -1.0)
    return n * out[:, None], b * out


def _farthest(x: np.ndarray, among: np.ndarray, height: np.ndarray, scale: float) -> int:
    """The highest of the given rows; of equals the last by coordinates, which is a corner and not within an edge or a face."""
    top = among[height >= height.max() - 1e-12 * scale]
    return int(top[np.lexsort(x[top].T[::-1])[-1]]) if len(top) > 1 else int(top[0])


def convex_hull(points: np.ndarray) -> Hull | None:
    """Hull in any dimension; None for fewer than d + 1 points in general position.

    Each point outside is kept with one face that it lies above (its conflict). The highest point of a face's list replaces the faces that it sees, which are
    found from neighbor to neighbor, and only the points of their lists are compared with the faces that come in.
    """
    x = np.asarray(points, float)
    n, d = x.shape
    if n < d + 1:
        return None
    every = np.arange(n)
    first = [_farthest(x, every, -x[:, 0], 0.0)]
    scale = np.abs(x - x.mean(0)).max() or 1.0
    while len(first) < d + 1:  # the point farthest from the span of those so far
        e = x - x[first[0]]
        if len(first) > 1:
            q, _ = np.linalg.qr((x[first[1:]] - x[first[0]]).T)
            e = e - (e @ q) @ q.T
        far = np.linalg.norm(e, axis=1)
        if far.max() <= EPS * scale:
            return None
        first.append(_farthest(x, every, far, scale))
    inside, least = x[first].mean(0), EPS * scale
    faces: dict[int, tuple[tuple[int, ...], np.ndarray, float]] = {}
    above: dict[int, np.ndarray] = {}  # face: the points kept with it
    sides: dict[tuple, set[int]] = {}  # d - 1 corners: the two faces that share them
    named = 0

    def put(corners: list[tuple[int, ...]], loose: np.ndarray) -> None:
        nonlocal named
        normals, offsets = _planes(x[np.array(corners)], inside)
        height = x[loose] @ normals.T + offsets
        at = height.argmax(1) if len(loose) else np.empty(0, int)
        up = height[np.arange(len(loose)), at] > least
        for k, c in enumerate(corners):
            faces[named] = (c, normals[k], float(offsets[k]))
            mine = loose[up & (at == k)]
            if len(mine):
                above[named] = mine
            for r in combinations(c, d - 1):
                sides.setdefault(r, set()).add(named)
            named += 1

    put([tuple(sorted(s)) for s in combinations(first, d)], np.setdiff1d(every, first))
    while above:
        start = next(iter(above))
        _, normal, offset = faces[start]
        i = _farthest(x, above[start], x[above[start]] @ normal + offset, scale)
        seen, rim, queue = {start}, [], [start]
        while queue:
            f = queue.pop()
            for r in combinations(faces[f][0], d - 1):
                for g in sides[r] - {f}:
                    if g in seen:
                        continue
                    if faces[g][1] @ x[i] + faces[g][2] > least:
                        seen.add(g)
                        queue.append(g)
                    else:
                        rim.append(r)
        loose = np.concatenate([above.pop(f) for f in seen if f in above])
        for f in seen:
            for r in combinations(faces[f][0], d - 1):
                sides[r].discard(f)
            del faces[f]
        put([tuple(sorted((*r, i))) for r in rim], loose[loose != i])
    return Hull(x, [c for c, _, _ in faces.values()], np.array([a for _, a, _ in faces.values()]), np.array([b for _, _, b in faces.values()]))


def maximize(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """(x, bounded): the x that maximizes c x under a x <= b, where b >= 0 so that x = 0 is allowed. Simplex steps with the least index first, which cannot cycle."""
    m, d = a.shape
    t = np.zeros((m + 1, 2 * d + m + 1))  # x = x+ - x-, then slacks
    t[:m, :d], t[:m, d : 2 * d], t[:m, 2 * d : -1], t[:m, -1] = a, -a, np.eye(m), b
    t[m, :d], t[m, d : 2 * d] = -c, c
    basis = np.arange(2 * d, 2 * d + m)
    bounded = True
    while True:
        enter = np.flatnonzero(t[m, :-1] < -TINY)
        if not len(enter):
            break
        j = enter[0]
        rows = np.flatnonzero(t[:m, j] > TINY)
        if not len(rows):
            bounded = False
            break
        ratio = t[rows, -1] / t[rows, j]
        best = rows[ratio <= ratio.min() + TINY]
        i = best[basis[best].argmin()]
        t[i] /= t[i, j]
        others = np.arange(m + 1) != i
        t[others] -= np.outer(t[others, j], t[i])
        basis[i] = j
    full = np.zeros(2 * d + m)
    full[basis] = t[:m, -1]
    return full[:d] - full[d : 2 * d], bounded


TINY, THIN = 1e-12, 1e-9  # of numbers scaled to about one: zero in a simplex step; a distance that counts as none


class _Scaled:
    """Half-spaces with unit normals, moved to the point that is nearest to all planes and scaled so that these are within one of it."""

    def __init__(self, halfspaces: np.ndarray):
        h = np.asarray(halfspaces, float)
        h = h / np.linalg.norm(h[:, :-1], axis=1, keepdims=True)
        self.n = h[:, :-1]
        self.at = -np.linalg.lstsq(self.n, h[:, -1], rcond=None)[0]
        self.d = h[:, -1] + self.n @ self.at
        self.size = max(np.abs(self.d).max(initial=0.0), np.finfo(float).tiny)
        if self.size <= 1e-13 * np.abs(self.at).max(initial=0.0):  # planes through one point
            self.size = 1.0
        self.d = self.d / self.size
        self.dim = self.n.shape[1]

    def deepest(self) -> tuple[np.ndarray, float]:
        """(point, its least distance to the planes, one at most); a negative distance if no point is inside of all."""
        low = (-self.d).min(initial=1.0)
        a = np.column_stack([self.n, np.ones(len(self.n))])
        a = np.vstack([a, np.append(np.zeros(self.dim), 1.0)])
        x, _ = maximize(np.append(np.zeros(self.dim), 1.0), a, np.append(-self.d - low, 1.0 - low))
        return x[:-1], x[-1] + low

    def slack(self, i: int, p: np.ndarray, others: np.ndarray) -> float:
        """The farthest that a point of `others` lies beyond plane i (infinite: no end), p being inside of all of them."""
        far, bounded = maximize(self.n[i], self.n[others], np.maximum(0.0, -(self.n[others] @ p + self.d[others])))
        return float(self.n[i] @ (p + far) + self.d[i]) if bounded else np.inf


def corners(halfspaces: np.ndarray) -> tuple[np.ndarray, bool, np.ndarray | None]:
    """(corners, bounded, a point inside or None if the set is empty). At any scale and place.

    An inner point turns half-spaces into points of the polar set, whose facets are the corners; facets through
    the origin are directions without an end. Flat sets are solved in the span that their opposed planes leave.
    """
    s = _Scaled(halfspaces)
    p, depth = s.deepest()
    if depth < -THIN:
        return np.empty((0, s.dim)), True, None
    if depth <= THIN:  # planes that every inner point lies on
        tight = np.flatnonzero(np.abs(s.n @ p + s.d) <= 10 * THIN)
        every = np.arange(len(s.n))
        flat = []
        for i in tight:
            away, bounded = maximize(-s.n[i], s.n[every], np.maximum(0.0, -(s.n @ p + s.d)))
            if bounded and -(s.n[i] @ away) <= 100 * THIN:
                flat.append(i)
        _, w, vt = np.linalg.svd(s.n[flat])
        span = vt[int((w > 1e-9).sum()) :]
        if not len(span):
            inside = p * s.size + s.at
            return inside[None], True, inside
        rest = np.setdiff1d(every, flat)
        low = s.n[rest] @ span.T
        keep = np.linalg.norm(low, axis=1) > 1e-9
        if not keep.any():
            return np.empty((0, s.dim)), False, p * s.size + s.at
        v, bounded, inside = corners(np.column_stack([low[keep], (s.n[rest] @ p + s.d[rest])[keep]]))
        back = lambda y: (p + y @ span) * s.size + s.at
        return back(v), bounded, back(inside) if inside is not None else p * s.size + s.at
    inside = p * s.size + s.at
    polar = s.n / -(s.n @ p + s.d)[:, None]
    hull = convex_hull(np.vstack([polar, np.zeros(s.dim)])) if s.dim > 1 else None
    if s.dim == 1:
        ends = [f(polar[sign * polar[:, 0] > 0, 0]) for f, sign in ((max, 1), (min, -1)) if (sign * polar[:, 0] > 0).any()]
        return np.array([[1 / e + p[0]] for e in ends]) * s.size + s.at, len(ends) == 2, inside
    if hull is None:
        return np.empty((0, s.dim)), False, inside
    ends = hull.offsets < -THIN * np.abs(polar).max()
    v = (p - hull.normals[ends] / hull.offsets[ends, None]) * s.size + s.at
    kept: list[np.ndarray] = []
    reach = 1e-7 * np.abs(v - inside).max(initial=0.0)
    for x in v:
        if not any(np.abs(x - y).max() <= reach for y in kept):
            kept.append(x)
    return _settled(np.array(kept).reshape(-1, s.dim), np.asarray(halfspaces, float), reach), bool(ends.all()), inside


def _settled(v: np.ndarray, h: np.ndarray, reach: float) -> np.ndarray:
    """Corners, each solved again from the planes that meet in it, without the way there and back through the polar set."""
    h = h / np.linalg.norm(h[:, :-1], axis=1, keepdims=True)
    out = v.copy()
    for i, x in enumerate(v):
        meet = h[np.abs(h[:, :-1] @ x + h[:, -1]) <= reach]
        if len(meet) != v.shape[1] or np.linalg.cond(meet[:, :-1]) > 1e6:
            continue
        y = np.linalg.solve(meet[:, :-1], -meet[:, -1])
        if np.abs(y - x).max() <= reach:
            out[i] = y
    return out


@dataclass
class Polytope:
    """Intersection of half-spaces [n, d], n x + d <= 0; facets are closed."""

    halfspaces: np.ndarray

    @staticmethod
    def empty(dim: int) -> Polytope:
        e = np.zeros((2, dim + 1))
        e[0, 0], e[1, 0], e[:, -1] = 1, -1, 1
        return Polytope(e)

    @staticmethod
    def around(points: np.ndarray) -> Polytope:
        """Hull of points. Flat sets: planes of their own span and of the hull within it."""
        x = np.asarray(points, float)
        h = convex_hull(x)
        if h is not None:
            return Polytope(h.halfspaces())
        if not len(x):
            return Polytope.empty(x.shape[1] if x.ndim == 2 else 1)
        c = x.mean(0)
        _, s, vt = np.linalg.svd(x - c, full_matrices=True)
        rank = int((s > EPS * max(1.0, s.max(initial=0))).sum())
        rows = [np.append(sign * v, -sign * (v @ c)) for v in vt[rank:] for sign in (1, -1)]
        if rank == 1:
            y = (x - c) @ vt[0]
            rows += [np.append(vt[0], -(vt[0] @ c) - y.max()), np.append(-vt[0], vt[0] @ c + y.min())]
        elif rank > 1:
            low = convex_hull((x - c) @ vt[:rank].T)
            rows += [np.append(g[:-1] @ vt[:rank], g[-1] - g[:-1] @ vt[:rank] @ c) for g in low.halfspaces()]
        return Polytope(np.array(rows))

    @property
    def dim(self) -> int:
        return self.halfspaces.shape[1] - 1

    def vertices(self) -> np.ndarray:
        return corners(self.halfspaces)[0]

    def is_empty(self) -> bool:
        return corners(self.halfspaces)[2] is None

    def is_bounded(self) -> bool:
        return corners(self.halfspaces)[1]

    def hull(self) -> Hull | None:
        v, bounded, _ = corners(self.halfspaces)
        return convex_hull(v) if bounded else None

    def volume(self) -> float:
        v, bounded, _ = corners(self.halfspaces)
        h = convex_hull(v) if bounded else None
        return float("inf") if not bounded else h.volume() if h else 0.0

    def area(self) -> float:
        v, bounded, _ = corners(self.halfspaces)
        h = convex_hull(v) if bounded else None
        return float("inf") if not bounded else h.area() if h else 0.0

    def interior_point(self) -> np.ndarray:
        inside = corners(self.halfspaces)[2]
        return np.full(self.dim, np.nan) if inside is None else inside

    def redundant(self) -> np.ndarray:
        """Half-spaces that can go, each by itself, without changing the set: what the others allow does not go beyond them."""
        return np.array([self._can_go(i) for i in range(len(self.halfspaces))])

    def _can_go(self, i: int) -> bool:
        s = _Scaled(self.halfspaces)
        others = np.delete(np.arange(len(s.n)), i)
        if not len(others):
            return False
        rest = _Scaled(np.column_stack([s.n[others], s.d[others]]))
        p, depth = rest.deepest()
        return bool(depth < -THIN or s.slack(i, p * rest.size + rest.at, others) <= THIN)

    def is_solid(self) -> bool:
        """Whether it has inner points, away from all planes."""
        return _Scaled(self.halfspaces).deepest()[1] > THIN

    def without(self, other: Polytope) -> list[Polytope]:
        """The part outside of other in solid pieces that share no inner point: beyond its first facet, within that and beyond the second, and so on."""
        if not Polytope(np.vstack([self.halfspaces, other.halfspaces])).is_solid():
            return [self]
        out, kept = [], self.halfspaces
        for h in other.halfspaces:
            piece = Polytope(np.vstack([kept, -h]))
            if piece.is_solid():
                piece = Polytope(piece.halfspaces[~_repeated(piece)])
                out.append(piece)
                kept = np.vstack([kept, h])
        return out

    def intersect(self, other: Polytope) -> Polytope:
        out = Polytope(np.vstack([self.halfspaces, other.halfspaces]))
        return Polytope.empty(self.dim) if out.is_empty() else out

    def transform(self, r, t) -> Polytope:
        """Rigid or affine: n' = R^-T n, d' = d - t n', scaled to unit normals."""
        n = self.halfspaces[:, :-1] @ np.linalg.inv(np.asarray(r))
        d = self.halfspaces[:, -1] - n @ np.asarray(t)
        s = np.linalg.norm(n, axis=1, keepdims=True)
        return Polytope(np.column_stack([n / s, d / s[:, 0]]))

    def contains(self, p: str = "p", offset: float = 0.0) -> Column:
        """Facets are few: a conjunction of literal inequalities, all in one generated stage."""
        out = F.lit(True)
        for h in self.halfspaces.tolist():
            out = out & (sum((F.lit(v) * F.col(p)[i] for i, v in enumerate(h[:-1])), F.lit(0.0)) + h[-1] <= -offset)
        return out

    def signed_distances(self, df: DataFrame) -> DataFrame:
        """(id, facet_id, value) of every point and facet."""
        values = F.array(*(sum((F.lit(v) * F.col("p")[i] for i, v in enumerate(h[:-1])), F.lit(0.0)) + h[-1] for h in self.halfspaces.tolist()))
        return df.select("id", F.posexplode(values).alias("facet_id", "value"))


def _repeated(p: Polytope) -> np.ndarray:
    """Half-spaces to drop, one after the other, so that the set stays the same."""
    drop = np.zeros(len(p.halfspaces), bool)
    for i in range(len(drop)):
        left = np.flatnonzero(~drop)
        drop[i] = len(left) > 1 and Polytope(p.halfspaces[left])._can_go(int(np.searchsorted(left, i)))
    return drop


@dataclass
class Region:
    """Union of polytopes, which may overlap."""

    polytopes: list[Polytope]

    def union(self, other: Region) -> Region:
        return Region(self.polytopes + other.polytopes)

    def intersect(self, other: Region) -> Region:
        return Region([p for p in (a.intersect(b) for a in self.polytopes for b in other.polytopes) if not p.is_empty()])

    def complement(self) -> Region:
        """Every choice of one turned facet of each polytope, empty ones dropped."""
        if not self.polytopes:
            return self
        out = []
        for pick in product(*(p.halfspaces for p in self.polytopes)):
            p = Polytope(-np.array(pick))
            if not p.is_empty():
                out.append(p)
        return Region(out)

    def minus(self, other: Region) -> Region:
        return self.intersect(other.complement())

    def is_empty(self) -> bool:
        return all(p.is_empty() for p in self.polytopes)

    def is_bounded(self) -> bool:
        return all(p.is_bounded() for p in self.polytopes)

    def volume(self) -> float:
        """The sum over what each polytope has outside of those before it."""
        if not self.is_bounded():
            return float("inf")
        total = 0.0
        for i, p in enumerate(self.polytopes):
            parts = [p] if p.is_solid() else []
            for q in self.polytopes[:i]:
                parts = [r for x in parts for r in x.without(q)]
            total += sum(x.volume() for x in parts)
        return total

    def interior_point(self) -> np.ndarray:
        return next(p.interior_point() for p in self.polytopes if not p.is_empty())

    def transform(self, r, t) -> Region:
        return Region([p.transform(r, t) for p in self.polytopes])

    def contains(self, p: str = "p", offset: float = 0.0) -> Column:
        out = F.lit(False)
        for x in self.polytopes:
            out = out | x.contains(p, offset)
        return out

    def facets(self, spark) -> DataFrame:
        """Relational form (poly_id, facet_id, n, d)."""
        rows = [(i, j, h[:-1].tolist(), float(h[-1])) for i, p in enumerate(self.polytopes) for j, h in enumerate(p.halfspaces)]
        return spark.createDataFrame(pd.DataFrame(rows, columns=["poly_id", "facet_id", "n", "d"]), "poly_id long, facet_id long, n array<double>, d double")


def flat_hull(points: np.ndarray) -> tuple[Hull, np.ndarray]:
    """Hull of a flat set in space: (hull in its plane, its corners in space)."""
    x = np.asarray(points, float)
    c = x.mean(0)
    _, _, vt = np.linalg.svd(x - c, full_matrices=False)
    h = convex_hull((x - c) @ vt[:2].T)
    return h, h.points[h.vertices] @ vt[:2] + c
