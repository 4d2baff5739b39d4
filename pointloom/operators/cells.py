"""k nearest neighbors over cells that fit the data: a k-d split tree in few dimensions, metric pivots in many.

1. A bounded sample of the reference rows gives the cells; cells that turn out heavy are sampled by themselves and split
   again. Of equal points in a cell that cannot be split, the k rows with the least ids stay (the others can be in no list).
2. Every query meets the rows of its own cell, as one block of a task. The k-th distance found there bounds its ball.
3. Queries whose ball crosses other cells (by their boxes, or by the triangle inequality about their pivots) visit those, and no others.
   Lists of the visits are merged; all other lists are final where they were made.
Cells with many queries deal them to several tasks. What the driver holds is the sample and one line for each cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.vectors import l1, l2sq
from pointloom.operators.session import cut, cut_bare

SAMPLE = 100_000  # sampled rows, about
MAX_CELLS = 16_384  # cells of the first sample
LEAF_ROWS, PIVOT_ROWS = 8_192, 2_048  # of a cell, where MAX_CELLS allows
HEAVY = 8  # a cell of so many times its share is split again
INNER = 64  # rows of the boxes that a leaf is searched by
GROUP_ROWS = 32_768  # rows of the cells that a query beyond TREE_DIM dimensions visits in one task
BLOCK, NARROW = 1 << 21, 1 << 18  # distances computed at once, by a product and by gaps
BYTE_ROWS, BYTE_QUERIES, LEVELS = 4_096, 16, 127  # rows and queries met at once by their bytes; levels of a coordinate, so that two fit a byte
NEAREST = "q long, qp array<double>, nn array<struct<value:double,r:long,rp:array<double>>>"


@dataclass(frozen=True)
class Metric:
    """A value of two points that grows with the distance |a - b| of each coordinate.

    column(a, b) is the value as an expression. of_gaps takes the gaps of each coordinate, one array a coordinate, and gives values; box bounds come from it as
    well, so it must not fall where a gap grows. distance turns values into what obeys the triangle inequality. product: values are squared
    Euclidean, so that a matrix product preselects. sums: values are sums of the gaps, so that coordinates of a byte preselect.
    """

    column: Callable[[str, str], Column]
    of_gaps: Callable[[list[np.ndarray]], np.ndarray]
    distance: Callable[[np.ndarray], np.ndarray] = lambda v: v
    product: bool = False
    sums: bool = False


def _squares(gaps: list[np.ndarray]) -> np.ndarray:
    out = gaps[0] * gaps[0]
    for g in gaps[1:]:
        out += g * g
    return out


def _sums(gaps: list[np.ndarray]) -> np.ndarray:
    out = gaps[0].copy()
    for g in gaps[1:]:
        out += g
    return out


L2 = Metric(l2sq, _squares, np.sqrt, product=True)
L1 = Metric(l1, _sums, sums=True)


def points_of(column) -> np.ndarray:
    """Lists of equal length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def pairwise(metric: Metric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return metric.of_gaps([np.abs(a[:, i, None] - b[None, :, i]) for i in range(a.shape[1])])


def best(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, in order, ties by id; ids ascend."""
    n = values.shape[1]
    if n <= k:
        return np.argsort(values, axis=1, kind="stable")
    part = np.argpartition(values, k - 1, axis=1)[:, :k]
    part.sort(axis=1)
    got = np.take_along_axis(values, part, 1)
    last = got.max(1)
    tied = (values == last[:, None]).sum(1) > (got == last[:, None]).sum(1)
    out = np.take_along_axis(part, np.argsort(got, axis=1, kind="stable"), 1)
    if tied.any():
        out[tied] = np.argsort(values[tied], axis=1, kind="stable")[:, :k]
    return out


class Tree:
    """A k-d split tree. Inner node i sends x[axis] < at to `left`, else to `right`; children below zero are cells -1 - child."""

    def __init__(self, dim: int):
        self.axis, self.at, self.left, self.right = (np.zeros(0, t) for t in (int, float, int, int))
        self.root, self.cells, self.dim = -1, 1, dim

    def split(self, cell: int, x: np.ndarray, parts: int) -> None:
        """Cut a cell into about `parts`, at medians of the widest side of its sample x."""
        axis, at, left, right = ([*a] for a in (self.axis, self.at, self.left, self.right))
        cells = self.cells

        def grow(rows: np.ndarray, parts: int, me: int) -> int:
            nonlocal cells
            if parts > 1 and len(rows) > 1:
                mine = x[rows]
                for d in np.argsort(-(mine.max(0) - mine.min(0)), kind="stable"):
                    v = np.sort(mine[:, d])
                    mid = len(v) // 2
                    cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
                    if len(cuts):
                        c = cuts[np.abs(cuts - mid).argmin()]
                        node, value = len(axis), (v[c - 1] + v[c]) / 2
                        value = value if value > v[c - 1] else v[c]
                        axis.append(int(d)), at.append(value), left.append(0), right.append(0)
                        other, cells = cells, cells + 1
                        low = mine[:, d] < value
                        share = min(parts - 1, max(1, round(parts * low.mean())))
                        left[node] = grow(rows[low], share, me)
                        right[node] = grow(rows[~low], parts - share, other)
                        return node
            return -1 - me

        node = grow(np.arange(len(x)), parts, cell)
        for links in (left, right):
            for i in range(len(self.axis)):
                if links[i] == -1 - cell:
                    links[i] = node
        if self.root == -1 - cell:
            self.root = node
        self.axis, self.at, self.left, self.right, self.cells = np.array(axis, int), np.array(at, float), np.array(left, int), np.array(right, int), cells

    def assign(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        todo = np.flatnonzero(node >= 0)
        while len(todo):
            n = node[todo]
            node[todo] = np.where(x[todo, self.axis[n]] < self.at[n], self.left[n], self.right[n])
            todo = todo[node[todo] >= 0]
        return -1 - node

    def summary(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x, x

    def finish(self, count: np.ndarray, low: np.ndarray, high: np.ndarray, metric: Metric) -> None:
        self.count, self.low, self.high = count, np.where(count[:, None] > 0, low, np.inf), np.where(count[:, None] > 0, high, -np.inf)

    def to_boxes(self, x: np.ndarray, metric: Metric, which: np.ndarray) -> np.ndarray:
        """The least value that a row of each box can have from each x."""
        gaps = [np.maximum(0, np.maximum(self.low[which, i] - x[:, i, None], x[:, i, None] - self.high[which, i])) for i in range(x.shape[1])]
        return metric.of_gaps(gaps)

    def enough(self, x: np.ndarray, k: int, metric: Metric) -> np.ndarray:
        """For each x a value within which at least k rows lie, by whole boxes; infinite if there are fewer rows."""
        out = np.full(len(x), np.inf)
        some = np.flatnonzero(self.count)
        for i in range(len(x)):
            far = metric.of_gaps([np.maximum(np.abs(x[i, d] - self.low[some, d]), np.abs(x[i, d] - self.high[some, d])) for d in range(x.shape[1])])
            order = np.argsort(far, kind="stable")
            at = np.searchsorted(np.cumsum(self.count[some][order]), k)
            if at < len(order):
                out[i] = far[order[at]]
        return out

    def reach(self, x: np.ndarray, bound: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
        """(index of x, cell) of the cells that may hold a value up to the bound."""
        out = [(np.empty(0, int), np.empty(0, int))]
        order = np.argsort(self.assign(x), kind="stable")  # neighbors together
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            lo, hi = x[rows].min(0), x[rows].max(0)
            gaps = [np.maximum(0, np.maximum(self.low[:, i] - hi[i], lo[i] - self.high[:, i])) for i in range(x.shape[1])]
            which = np.flatnonzero((self.count > 0) & (metric.of_gaps(gaps) <= bound[rows].max()))
            for c in range(0, len(which), 1024):
                w = which[c : c + 1024]
                i, j = np.nonzero(self.to_boxes(x[rows], metric, w) <= bound[rows, None])
                out.append((rows[i], w[j]))
        i, j = (np.concatenate(c) for c in zip(*out, strict=True))
        return i, j

    def search(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray, metric: Metric):
        """(query index, row index, value) of the k best rows of each query, none above its bound."""
        inner = Tree(self.dim)
        inner.split(0, x, max(1, len(x) // max(INNER, 4 * k)))
        cell = inner.assign(x)
        order = np.lexsort((ids, cell))
        x, ids, cell = x[order], ids[order], cell[order]
        first = np.searchsorted(cell, np.arange(inner.cells + 1))
        some = np.flatnonzero(np.diff(first))
        inner.finish(np.diff(first), *(np.stack([f(x[lo:hi], 0) if hi > lo else np.zeros(self.dim) for lo, hi in zip(first[:-1], first[1:], strict=True)]) for f in (np.min, np.max)), metric)
        out = []
        home = inner.assign(q)
        group = np.argsort(home, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(home[group]) > 0)), len(q))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            for at in range(lo, hi, 256):
                rows = group[at : min(hi, at + 256)]
                limit, own = bound[rows], home[rows[0]]
                if first[own + 1] - first[own] >= k:
                    near = pairwise(metric, q[rows], x[first[own] : first[own + 1]])
                    limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1])
                low, high = q[rows].min(0), q[rows].max(0)
                gaps = [np.maximum(0, np.maximum(inner.low[some, i] - high[i], low[i] - inner.high[some, i])) for i in range(self.dim)]
                which = some[metric.of_gaps(gaps) <= limit.max()]
                if not len(which):
                    continue
                take = np.concatenate([np.arange(first[w], first[w + 1]) for w in which])
                take = take[np.argsort(ids[take], kind="stable")]
                out += blocks(q, x, ids, rows, take, k, limit, metric)
        i, j, v = concatenated(out)
        return i, order[j], v


def concatenated(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [(np.empty(0, int), np.empty(0, int), np.empty(0)), *parts]
    i, j, v = (np.concatenate(c) for c in zip(*parts, strict=True))
    return i, j, v


def blocks(q, x, ids, rows, take, k, limit, metric) -> list[tuple]:
    """Hits of the queries `rows` among the rows `take`, whose ids ascend: all distances, a block at a time."""
    out, tall = [], max(1, NARROW // len(take))
    for at in range(0, len(rows), tall):
        mine, most = rows[at : at + tall], limit[at : at + tall]
        d = pairwise(metric, q[mine], x[take])
        top = best(d, ids[take], k)
        v = np.take_along_axis(d, top, 1)
        i, j = np.nonzero(v <= most[:, None])
        out.append((mine[i], take[top[i, j]], v[i, j]))
    return out


def singles(q: np.ndarray, x: np.ndarray, norms: np.ndarray, k: int, bound: np.ndarray):
    """A function that gives (i, j) of the rows that can be among the k nearest of the queries from one place to another, by a product in single precision; None where bounds are not known, or its rounding is not small beside them.

    Only rows within the bounds are looked at further, where all distances would have to be ranked without one.
    """
    sq, most = (q * q).sum(1), norms.max()
    slack = (x.shape[1] + 8) * 1.2e-7 * (sq + most)  # twice what the rounding of operands, products and sums can come to
    if not (np.isfinite(bound).all() and np.isfinite(slack).all() and sq.max() + most < 1e30 and slack.max() <= 0.01 * np.median(bound)):
        return None
    rows = np.ascontiguousarray(np.column_stack([x, norms]).astype(np.float32).T)
    of = np.column_stack([-2 * q, np.ones(len(q))]).astype(np.float32)
    limit = np.nextafter((bound - sq + slack).astype(np.float32), np.float32(np.inf))

    def near(start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        d = of[start:end] @ rows
        at = np.flatnonzero(d <= limit[start:end, None])
        i, j = np.divmod(at, d.shape[1])
        v = d.ravel()[at].astype(float)
        order = np.lexsort((v, i))
        first = np.searchsorted(i, np.arange(len(d)))  # i ascends, before and after
        last = np.append(first[1:], len(i))
        kth = np.full(len(d), np.inf)
        enough = last - first >= k
        kth[enough] = v[order][first[enough] + k - 1]
        keep = v <= (kth + 2 * slack[start:end])[i]
        return i[keep], j[keep]

    return near


def by_bytes(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray):
    """(query index, row index, value) as Pivots.search, of sums of gaps; ids ascend.

    Coordinates become levels of a common step. The sum of |a - b| over levels is sum(a) + sum(b) - 2 sum(min(a, b)), which bytes give fast; times the step
    it is off by at most what the levels leave of both points. Rows that may lie within the bound by this are summed exactly, the likeliest first, as they narrow it.
    """
    dim, n = x.shape[1], len(x)
    low, high = np.quantile(x[:: max(1, n // 2048)], [0.001, 0.999], axis=0)
    step = float((high - low).max()) / LEVELS or 1.0

    def levels(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = np.clip(np.rint((y - low) / step), 0, LEVELS)
        return b.astype(np.uint8), b.sum(1), np.abs(y - low - b * step).sum(1) / step

    own, sums, rest = levels(x)
    width = dim + dim % 2
    padded = np.zeros((width, n + n % 2), np.uint8)  # zeros add nothing to a least sum
    padded[:dim, :n] = own.T
    room, parts = np.empty(width * BYTE_ROWS, np.uint8), []
    for at in range(0, padded.shape[1], BYTE_ROWS):
        part = np.ascontiguousarray(padded[:, at : at + BYTE_ROWS])
        a, b, one = room[: part.size].reshape(part.shape), np.empty((width // 2, part.shape[1]), np.uint8), np.empty((width // 2, part.shape[1] // 2), np.uint16)
        parts.append((part, a, b, b.view(np.uint16), one))
    least = np.zeros((BYTE_QUERIES, padded.shape[1]), np.uint16)
    exact = lambda i, j: np.cumsum(np.abs(x[j] - q[i]), axis=1)[:, -1]  # in the order of _sums
    half, out = width // 2, []
    base = np.floor((sums - rest) / 2).astype(np.int32)
    mine, q_sums, q_rest = levels(q)
    mine = np.pad(mine, ((0, 0), (0, width - dim)))[:, :, None]
    for i in range(len(q)):
        row = i % BYTE_QUERIES
        for c, (part, a, b, both, one) in enumerate(parts if row == 0 else ()):
            at, to = c * BYTE_ROWS, c * BYTE_ROWS + part.shape[1]
            for to_row, levels_of in zip(least, mine[i : i + BYTE_QUERIES]):  # noqa: B905
                np.minimum(part, levels_of, out=a)
                np.add(a[:half], a[half:], out=b)
                to_row[at:to:2] = np.add.reduce(np.bitwise_and(both, 255, out=one), axis=0, dtype=np.uint16)
                to_row[at + 1 : to : 2] = np.add.reduce(np.right_shift(both, 8, out=one), axis=0, dtype=np.uint16)
        over = least[row, :n] - base  # the more, the nearer a row may be
        needed = lambda limit: (q_sums[i] - q_rest[i] - limit / step) / 2 - 2 if np.isfinite(limit) else -np.inf  # noqa: B023, E731
        limit = bound[i]
        j = np.flatnonzero(over >= needed(limit))
        if len(j) > 4 * k:
            first = j[np.argpartition(over[j], len(j) - 2 * k)[len(j) - 2 * k :]]
            limit = min(limit, np.partition(exact(i, first), k - 1)[k - 1])
            j = j[over[j] >= needed(limit)]
        v = exact(i, j)
        j, v = j[v <= limit], v[v <= limit]
        top = np.argsort(v, kind="stable")[:k]
        out.append((np.full(len(top), i), j[top], v[top]))
    return concatenated(out)


class Pivots:
    """Cells of the nearest pivot, with the largest distance of their rows to it."""

    def __init__(self, dim: int):
        self.pivots, self.cells, self.dim = np.zeros((1, dim)), 1, dim
        self.metric = L2

    def split(self, cell: int, x: np.ndarray, parts: int) -> None:
        """Pivots from the sample, each the row farthest from those before among a few drawn ones, so that they spread."""
        rng = np.random.default_rng(len(self.pivots))
        rows = np.unique(x, axis=0)
        rows = rows[rng.permutation(len(rows))[: max(1, parts)]]
        self.pivots = rows if self.cells == 1 else np.unique(np.concatenate([self.pivots, rows]), axis=0)
        self.cells = len(self.pivots)

    def _to_pivots(self, x: np.ndarray) -> np.ndarray:
        return self.metric.distance(pairwise(self.metric, x, self.pivots))

    def assign(self, x: np.ndarray) -> np.ndarray:
        out, tall = np.zeros(len(x), int), max(1, BLOCK // self.cells)
        for at in range(0, len(x), tall):
            d = (self.pivots**2).sum(1) - 2 * x[at : at + tall] @ self.pivots.T if self.metric.product else self._to_pivots(x[at : at + tall])
            out[at : at + tall] = d.argmin(1)
        return out

    def summary(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = self.metric.distance(self.metric.of_gaps([np.abs(x[:, i] - self.pivots[cell, i]) for i in range(x.shape[1])]))[:, None]
        return far, far

    def finish(self, count: np.ndarray, low: np.ndarray, high: np.ndarray, metric: Metric) -> None:
        self.count, self.low, self.high = count, low[:, 0], high[:, 0]

    def enough(self, x: np.ndarray, k: int, metric: Metric) -> np.ndarray:
        out, some = np.full(len(x), np.inf), np.flatnonzero(self.count)
        far = self._to_pivots(x)[:, some] + self.high[some]
        order = np.argsort(far, axis=1, kind="stable")
        at = (np.cumsum(self.count[some][order], axis=1) < k).sum(1)
        ok = at < len(some)
        d = np.take_along_axis(far, order, 1)[ok, at[ok]] * (1 + 1e-9)
        out[ok] = d * d if metric.product else d
        return out

    def reach(self, x: np.ndarray, bound: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
        """Cells whose ring about the pivot the ball meets, and which the half-space between two pivots does not rule out."""
        out = [(np.empty(0, int), np.empty(0, int))]
        radius = metric.distance(bound)
        tall = max(1, BLOCK // self.cells)
        for at in range(0, len(x), tall):
            r = radius[at : at + tall, None]
            d = self._to_pivots(x[at : at + tall])
            slack = 1e-9 * (1 + d)
            ok = (self.count > 0) & (d - self.high <= r + slack) & (self.low - d <= r + slack)
            least = d.min(1)[:, None]
            ok &= (d - least) / 2 <= r + slack
            if metric.product:
                own = d.argmin(1)
                apart = np.sqrt(np.maximum(((self.pivots**2).sum(1)[own, None] + (self.pivots**2).sum(1) - 2 * self.pivots[own] @ self.pivots.T), 0))
                ok &= (d * d - least * least <= 2 * apart * np.minimum(r, 1e300) + slack * (1 + apart)) | np.isinf(r)
            i, j = np.nonzero(ok)
            out.append((at + i, j))
        i, j = (np.concatenate(c) for c in zip(*out, strict=True))
        return i, j

    def search(self, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray, metric: Metric):
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        if metric.sums and x.shape[1] <= 512 and len(x) and np.isfinite(x).all() and np.isfinite(q).all():
            i, j, v = by_bytes(q, x, ids, k, bound)
            return i, order[j], v
        if not metric.product:
            i, j, v = concatenated(blocks(q, x, ids, np.arange(len(q)), np.arange(len(x)), k, bound, metric) if len(x) else [])
            return i, order[j], v
        out, tall, norms = [], max(1, BLOCK // max(1, len(x))), (x * x).sum(1)
        short = singles(q, x, norms, k, bound) if len(x) > k and len(q) else None
        tall = tall if short is None else 4 * tall  # fewer, larger products
        for at in range(0, len(q), tall):
            if short is not None:
                i, j = short(at, at + tall)
                mine = q[at : at + tall]
                v = metric.of_gaps([np.abs(mine[i, d] - x[j, d]) for d in range(x.shape[1])])
                place = np.lexsort((j, v, i))
                i, j, v = i[place], j[place], v[place]
                keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (v <= bound[at + i])
                out.append((at + i[keep], j[keep], v[keep]))
                continue
            mine = q[at : at + tall]
            sq = (mine * mine).sum(1)
            near = sq[:, None] + norms - 2 * mine @ x.T  # one matrix product preselects
            slack = 1e-9 * (sq + norms.max(initial=0))
            limit = np.minimum(bound[at : at + tall], np.partition(near, k - 1, axis=1)[:, k - 1] + slack if len(x) >= k else np.inf) + slack
            i, j = np.nonzero(near <= limit[:, None])
            v = metric.of_gaps([np.abs(mine[i, d] - x[j, d]) for d in range(x.shape[1])])
            place = np.lexsort((j, v, i))
            i, j, v = i[place], j[place], v[place]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            keep = (rank < k) & (v <= bound[at + i])
            out.append((at + i[keep], j[keep], v[keep]))
        i, j, v = concatenated(out)
        return i, order[j], v


def finite(df: DataFrame) -> DataFrame:
    return df.select("id", "p").where(F.col("p").isNotNull() & F.forall("p", lambda x: x.isNotNull() & ~F.isnan(x)))


def sampled(df: DataFrame, n: int) -> np.ndarray:
    """The points of about SAMPLE of n rows, by the hash of the id."""
    share = min(1.0, SAMPLE / max(1, n))
    some = df if share == 1 else df.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return points_of(some.select("p").toArrow().column(0))


def in_cells(df: DataFrame, cells) -> DataFrame:
    """(cell, id, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(cells.assign(points_of(b.column("p")))), b.column("id"), b.column("p")], names=["cell", "id", "p"])

    return df.select(F.col("id").cast("long").alias("id"), F.col("p").cast("array<double>").alias("p")).mapInArrow(run, "cell long, id long, p array<double>")


def measured(df: DataFrame, cells) -> dict[int, tuple]:
    """cell: (rows, low, high) of the cells that hold rows; a line a cell comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = np.zeros(cells.cells, int), None, None
        for b in batches:
            x = points_of(b.column("p"))
            if not len(x):
                continue
            cell = cells.assign(x)
            a, z = cells.summary(x, cell)
            if low is None:
                low, high = np.full((cells.cells, a.shape[1]), np.inf), np.full((cells.cells, a.shape[1]), -np.inf)
            count += np.bincount(cell, minlength=cells.cells)
            np.minimum.at(low, cell, a)
            np.maximum.at(high, cell, z)
        if low is not None:
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(low[some].tolist()), pa.array(high[some].tolist())], names=["cell", "n", "low", "high"])

    found = df.select(F.col("p").cast("array<double>").alias("p")).mapInArrow(run, "cell long, n long, low array<double>, high array<double>")
    width = cells.dim if isinstance(cells, Tree) else 1
    ends = [f(F.col(c)[i]).alias(f"{c}{i}") for f, c in ((F.min, "low"), (F.max, "high")) for i in range(width)]
    return {r[0]: (r[1], r[2 : 2 + width], r[2 + width :]) for r in found.groupBy("cell").agg(F.sum("n").alias("n"), *ends).collect()}


def fitted(r: DataFrame, cells, metric: Metric, k: int, rows: int) -> tuple[object, DataFrame]:
    """Cells of the rows r, measured, and the rows that can be in lists."""
    n = r.count()
    share = max(rows, 4 * k, -(-n // MAX_CELLS))
    if n > share:
        cells.split(0, sampled(r, n), -(-n // share))
    while True:
        found = measured(r, cells)
        heavy = [c for c, f in found.items() if f[0] > HEAVY * share]
        before = cells.cells
        if heavy:
            inside = in_cells(r, cells).where(F.col("cell").isin(heavy))
            many = sum(found[c][0] for c in heavy)
            some = inside.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / many) * (1 << 30))).select("cell", "p").toArrow()
            of, x = some.column(0).to_numpy(), points_of(some.column(1))
            for c in heavy:
                cells.split(c, x[of == c], -(-found[c][0] // share))
        if cells.cells == before:
            break
    if heavy:  # equal points, or as good as equal: their first ids stand for them
        every = in_cells(r, cells)
        alike = Window.partitionBy("p").orderBy("id")
        firsts = every.where(F.col("cell").isin(heavy)).withColumn("_n", F.row_number().over(alike)).where(F.col("_n") <= k).select("id", "p")
        r = cut(every.where(~F.col("cell").isin(heavy)).select("id", "p").union(firsts))
        found = measured(r, cells)
    empty = ([0.0] * (cells.dim if isinstance(cells, Tree) else 1),) * 2
    lines = [found.get(c, (0, *empty)) for c in range(cells.cells)]
    cells.finish(np.array([f[0] for f in lines]), np.array([f[1] for f in lines], float), np.array([f[2] for f in lines], float), metric)
    return cells, r


class Index:
    """Cells of the rows r, for searches of up to k neighbors; several may use it."""

    def __init__(self, r: DataFrame, k: int, metric: Metric = L2, dim: int = 3, pivots: bool = False):
        self.rows, self.k, self.metric, self.pivots = finite(r), k, metric, pivots
        kind = Pivots(dim) if pivots else Tree(dim)
        kind.metric = metric
        self.cells, kept = fitted(self.rows, kind, metric, k, PIVOT_ROWS if pivots else LEAF_ROWS)
        self.refs = in_cells(kept, self.cells)


def nearest_lists(q: DataFrame, r: DataFrame, k: int, metric: Metric = L2, dim: int = 3, pivots: bool = False, points: bool = True, limit: float = np.inf, index: Index | None = None) -> DataFrame:
    """(q, qp, nn) of every query with a hit: nn the k nearest rows (value, r, rp) in order, ties by id. points: False leaves qp and rp empty, so that lists move without coordinates.

    limit: rows beyond this value are not looked for. index: the cells of r, if they are there.
    """
    index = index or Index(r, k, metric, dim, pivots)
    if k > index.k:
        raise ValueError("the index was made for fewer neighbors")
    cells, refs, metric, pivots, limit = index.cells, index.refs, index.metric, index.pivots, float(limit)
    total = int(cells.count.sum())
    queries = in_cells(index.rows if q is r else finite(q), cells)
    # cells that are visited together: in many dimensions a ball crosses most of them, and a row for each would be as many copies of the query
    group = np.cumsum(cells.count) // GROUP_ROWS if pivots else np.arange(cells.cells)

    def met(left: DataFrame, right: DataFrame, rows: int, body: Callable, schema: str) -> DataFrame:
        """Queries and rows of each cell; the queries of a cell with many are dealt to several tasks."""
        ways = left.groupBy("cell").count()
        ways = F.broadcast(ways.select("cell", F.ceil(F.col("count") / (2 * rows)).cast("int").alias("ways")).where("ways > 1"))  # a line a cell
        left = left.join(ways, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("ways", F.lit(1))).cast("int")).drop("ways")
        right = right.join(ways, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(body, schema)

    def lists(q_ids, q_x, r_ids, r_x, i, j, v, own=points) -> list[pa.Array]:
        """Columns q, qp, nn of the queries, hits grouped by query in order."""
        order = np.lexsort((r_ids[j], v, i))
        i, j, v = i[order], j[order], v[order]
        at = pa.array(np.searchsorted(i, np.arange(len(q_ids) + 1)).astype(np.int32))
        if not points:
            r_x = r_x[:, :0]
        if not own:
            q_x = q_x[:, :0]
        of = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        hits = pa.StructArray.from_arrays([pa.array(v, pa.float64()), pa.array(r_ids[j]), of(r_x[j])], names=["value", "r", "rp"])
        return [pa.array(q_ids), of(q_x), pa.ListArray.from_arrays(at, hits)]

    names = ["q", "qp", "nn"]

    def at_home(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q_x, r_ids, r_x = left.column("id").to_numpy(), points_of(left.column("p")), right.column("id").to_numpy(), points_of(right.column("p"))
        i, j, v = cells.search(q_x, r_x, r_ids, k, np.full(len(q_ids), limit), metric) if len(r_ids) else concatenated([])
        bound, found = np.full(len(q_ids), -np.inf), np.bincount(i, minlength=len(q_ids))
        np.maximum.at(bound, i, v)
        short = found < k
        if short.any():
            bound[short] = np.minimum(limit, cells.enough(q_x[short], k, metric) if total >= k > len(r_ids) else np.inf)
        a, c = cells.reach(q_x, bound, metric) if cells.cells > 1 and len(q_ids) else (np.empty(0, int), np.empty(0, int))
        away = c != left.column("cell")[0].as_py() if len(q_ids) else c > 0
        if pivots:  # groups hold the own cell as well, whose hits are then taken from there
            leaves = np.zeros(len(q_ids), bool)
            leaves[a[away]] = True
            away = leaves[a]
        a, c = a[away], c[away]
        order = np.lexsort((c, a))
        a, c = a[order], c[order]
        first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(group[c], prepend=-1) != 0))  # of each query and group
        inside = pa.ListArray.from_arrays(pa.array((np.append(first, len(c)) if pivots else np.zeros(len(first) + 1)).astype(np.int32)), pa.array((c if pivots else c[:0]).astype(np.int32)))
        at = pa.array(np.searchsorted(a[first], np.arange(len(q_ids) + 1)).astype(np.int32))
        visit = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(group[c[first]].astype(np.int64)), inside], names=["cell", "inside"]))
        return pa.table([*lists(q_ids, q_x, r_ids, r_x, i, j, v, True), visit, pa.array(bound)], names=[*names, "visit", "bound"])

    def visiting(left: pa.Table, right: pa.Table) -> pa.Table:
        q_ids, q_x, r_ids, r_x = left.column("id").to_numpy(), points_of(left.column("p")), right.column("id").to_numpy(), points_of(right.column("p"))
        bound, parts = left.column("bound").to_numpy(), []
        if len(r_ids) and len(q_ids):
            inside, own = left.column("inside").combine_chunks(), right.column("own").to_numpy()
            of, cell = np.repeat(np.arange(len(q_ids)), np.diff(inside.offsets.to_numpy())), inside.flatten().to_numpy()
            if pivots and cells.count[cell].sum() < len(q_ids) * len(r_ids) / 2:
                for c in np.unique(cell):
                    some, rows = of[cell == c], np.flatnonzero(own == c)
                    i, j, v = cells.search(q_x[some], r_x[rows], r_ids[rows], k, bound[some], metric) if len(rows) else concatenated([])
                    parts.append((some[i], rows[j], v))
            else:
                parts.append(cells.search(q_x, r_x, r_ids, k, bound, metric))
        i, j, v = concatenated(parts)
        order = np.lexsort((r_ids[j], v, i))
        i, j, v = i[order], j[order], v[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j, v = i[best], j[best], v[best]
        hit = np.unique(i)
        return pa.table(lists(q_ids[hit], q_x[hit], r_ids, r_x, np.searchsorted(hit, i), j, v), names=names)

    rows = PIVOT_ROWS if pivots else LEAF_ROWS
    home = met(queries, refs, rows, at_home, f"{NEAREST}, visit array<struct<cell:long,inside:array<int>>>, bound double")
    none = F.slice("qp", 1, 0)
    if cells.cells == 1:
        return home.select("q", (F.col("qp") if points else none).alias("qp"), "nn").where(F.size("nn") > 0)
    # a written table is computed once and packed, which a checkpoint is not
    home = cut_bare(home.select("q", (F.col("qp") if points else F.when(F.size("visit") > 0, F.col("qp")).otherwise(none)).alias("qp"), "nn", "visit", F.when(F.size("visit") > 0, F.col("bound")).alias("bound")))
    visits = home.where(F.size("visit") > 0).select(F.explode("visit").alias("v"), F.col("q").alias("id"), F.col("qp").alias("p"), "bound").select("v.cell", "id", "p", "bound", "v.inside")
    grouped = refs.withColumn("own", F.col("cell"))
    if pivots:
        grouped = grouped.withColumn("cell", F.element_at(F.lit(group.tolist()).cast("array<bigint>"), (F.col("cell") + 1).cast("int")))
    away = met(visits, grouped, GROUP_ROWS // 4 if pivots else rows, visiting, NEAREST)
    own = F.col("qp") if points else F.slice("qp", 1, 0)
    several = away if pivots else home.where(F.size("visit") > 0).select("q", own.alias("qp"), "nn").union(away)
    # as many lists as cells or groups were visited, of k hits each
    merged = several.groupBy("q").agg(F.first("qp").alias("qp"), F.slice(F.array_sort(F.flatten(F.collect_list("nn"))), 1, k).alias("nn"))
    return home.where(F.size("visit") == 0).select("q", own.alias("qp"), "nn").union(merged).where(F.size("nn") > 0)


def edges_of(lists: DataFrame) -> DataFrame:
    """(q, r, value, rank) of nearest_lists."""
    return lists.select("q", F.posexplode("nn").alias("rank", "n")).select("q", "n.r", "n.value", "rank")


def covariance_of(lists: DataFrame, dim: int) -> DataFrame:
    """(q, qp, c, count) of nearest_lists: the sample covariance of each list's points, summed about the query's own point, without an edge leaving its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nn = b.column("nn")
            count = np.diff(nn.offsets.to_numpy())
            x = points_of(nn.flatten().field("rp")) - np.repeat(points_of(b.column("qp")), count, axis=0)
            at = nn.offsets.to_numpy()[:-1] - nn.offsets.to_numpy()[0]
            t = np.add.reduceat(x, at, axis=0)
            u = np.add.reduceat((x[:, :, None] * x[:, None, :]).reshape(len(x), -1), at, axis=0)
            n = count[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                c = (u - (t[:, :, None] * t[:, None, :]).reshape(len(t), -1) / n) / (n - 1)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("qp"), pa.array(c.tolist(), pa.list_(pa.float64())), pa.array(count.astype(np.int64))], names=["q", "qp", "c", "count"])

    return lists.mapInArrow(run, "q long, qp array<double>, c array<double>, count long")
