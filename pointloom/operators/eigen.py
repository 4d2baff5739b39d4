"""Extreme eigenpairs of a large sparse symmetric matrix: block Lanczos steps with thick restarts, on vectors that stay DataFrames.

A node's row holds its components of all basis vectors. A step is one product (a join of the entries with the newest block, and a sum for each row),
then two passes over the rows that add up small matrices of inner products, by which the new block is made orthogonal to the basis and orthonormal, twice.
Only these matrices, of the size of the basis, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.session import Rounds, cut

MOST_VECTORS = 96  # of the basis; beyond, it is restarted from its best vectors
WIDTH = 8  # vectors of a block, at least
PART_ROWS = 50_000  # nodes whose entries lie in one partition, about
DROP = 1e-14  # of a block's size, squared: directions below are as good as in the basis


def _rows(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(x, float).ravel()))


def mapped(df: DataFrame, body) -> DataFrame:
    """(id, q, w) with the matrices of each batch's rows changed by body(q, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q, w = body(_rows(b.column("q")), _rows(b.column("w")))
                yield pa.RecordBatch.from_arrays([b.column("id"), _lists(q), _lists(w)], names=["id", "q", "w"])

    return df.select("id", "q", "w").mapInArrow(run, "id long, q array<double>, w array<double>")


def products(df: DataFrame, body, rows: int, columns: int) -> np.ndarray:
    """The sum over all rows (id, q, w) of the matrix that body(q, w) gives for a batch; tasks send one matrix each, which Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for b in batches:
            if b.num_rows:
                total += body(_rows(b.column("q")), _rows(b.column("w")))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    out = np.zeros(rows * columns)
    for at, v in df.select("id", "q", "w").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v")).collect():  # rows * columns numbers
        out[at] = v
    return out.reshape(rows, columns)


def inverse_root(g: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(t, b) with t.T @ g @ t = 1 and w = (w @ t) @ b for a block w of Gram matrix g; directions of a squared length up to `least` are left out."""
    values, vectors = np.linalg.eigh((g + g.T) / 2)
    keep = values > max(least, 1e-28)
    root = np.sqrt(values[keep])
    return vectors[:, keep] / root, root[:, None] * vectors[:, keep].T


def largest_pairs(entries: DataFrame, nodes: DataFrame, k: int, tol: float = 5e-7, seed: int = 0, most: int | None = None, max_steps: int = 400) -> tuple[np.ndarray, DataFrame]:
    """(values descending, (id, x)): the k largest eigenpairs of the symmetric matrix with entries (row, col, value) over the nodes (id), x the components.

    Each has a residual of norm below tol. An eigenvalue is found as often as it occurs, up to WIDTH times, or k + 2.
    """
    width, most = max(k + 2, WIDTH), max(most or MOST_VECTORS, 4 * (k + 2))
    entries, nodes = cut(entries.select("row", "col", "value")), cut(nodes.select(F.col("id").cast("long").alias("id")))
    # the entries stay where their columns are joined, in the order of the join; of the tables of vectors the disk holds two
    parts = 1 + max(nodes.count() // PART_ROWS, nodes.sparkSession.sparkContext.defaultParallelism)
    dealt, tables = entries.repartition(parts, "col").sortWithinPartitions("col").persist(), Rounds(nodes, 2)
    try:
        return _largest_pairs(dealt, nodes, k, tol, seed, width, most, max_steps, tables)
    finally:
        dealt.unpersist()


def _largest_pairs(entries: DataFrame, nodes: DataFrame, k: int, tol: float, seed: int, width: int, most: int, max_steps: int, tables: Rounds) -> tuple[np.ndarray, DataFrame]:
    # a start that every run draws alike
    draw = F.array(*((F.xxhash64("id", F.lit(seed * 1000 + j)) / F.lit(2.0**63)) for j in range(width)))
    state = tables.written(nodes.select("id", F.array().cast("array<double>").alias("q"), draw.alias("w")))
    m, h = 0, np.zeros((0, 0))
    for _ in range(max_steps):
        # first pass: products with the basis and within the block
        sums = products(state, lambda q, w: np.vstack([q.T @ w, w.T @ w]) if q.size else w.T @ w, m + width, width)
        c1 = sums[:m]
        t1, back1 = inverse_root(sums[m:] - c1.T @ c1, DROP * np.trace(sums[m:]))
        once = lambda q, w, c1=c1, t1=t1: ((w - q @ c1) if c1.size else w) @ t1
        r = t1.shape[1]
        # second pass: what rounding left of them
        again = products(state, lambda q, w, once=once: np.vstack([q.T @ once(q, w), once(q, w).T @ once(q, w)]) if q.size else once(q, w).T @ once(q, w), m + r, r)
        c2 = again[:m]
        t2, back2 = inverse_root(again[m:] - c2.T @ c2, DROP)
        if m:
            # the projected matrix: its last block of columns are the products of the newest vectors
            new = c1 + c2 @ back1
            h[:, m - width :] = new
            h[m - width :, :] = new.T
            values, y = np.linalg.eigh((h + h.T) / 2)
            values, y = values[::-1], y[:, ::-1]
            residual = np.linalg.norm(back2 @ back1 @ y[m - width :, :k], axis=0)
            if (len(values) >= k and residual.max(initial=0) < tol) or not t2.shape[1]:
                found = y[:, :k]
                x = mapped(state, lambda q, w: (q @ found, w[:, :0]))
                return values[:k], cut(x.select("id", F.col("q").alias("x")))
        r, found = t2.shape[1], None
        if m + r > most:
            # thick restart: the best vectors so far, and the block behind the basis
            kept = min(m, most // 2)
            found, h, m = y[:, :kept], np.diag(values[:kept]), kept

        def grown(q, w, once=once, c2=c2, t2=t2, found=found):
            block = ((once(q, w) - q @ c2) if c2.size else once(q, w)) @ t2
            return np.hstack([q if found is None else q @ found, block] if q.size else [block]), block

        longer = mapped(state, grown)
        h = np.pad(h, ((0, r), (0, r)))
        m, width = m + r, r
        block = longer.select(F.col("id").alias("col"), F.col("w").alias("x"))
        sums = entries.join(block.hint("merge"), "col").groupBy("row").agg(*(F.sum(F.col("value") * F.col("x")[j]).alias(f"s{j}") for j in range(r)))
        image = F.array(*(F.coalesce(f"s{j}", F.lit(0.0)) for j in range(r)))
        state = tables.written(longer.join(sums.withColumnRenamed("row", "_row").hint("merge"), F.col("id") == F.col("_row"), "left").select("id", "q", image.alias("w")))
    raise ArithmeticError(f"no convergence within {max_steps} steps")


def residuals(entries: DataFrame, vectors: DataFrame, values: np.ndarray) -> DataFrame:
    """(k, value, residual, length): the norms of A x - value x and of x of each pair, from the entries alone."""
    k = len(values)
    moved = entries.join(vectors.select(F.col("id").alias("col"), "x"), "col").groupBy("row").agg(*(F.sum(F.col("value") * F.col("x")[j]).alias(f"s{j}") for j in range(k)))
    both = vectors.join(moved, vectors["id"] == moved["row"], "left")
    gap = lambda j: F.coalesce(F.col(f"s{j}"), F.lit(0.0)) - float(values[j]) * F.col("x")[j]
    sums = both.agg(*(F.sqrt(F.sum(gap(j) * gap(j))).alias(f"r{j}") for j in range(k)), *(F.sqrt(F.sum(F.col("x")[j] * F.col("x")[j])).alias(f"n{j}") for j in range(k)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(j).alias("k"), F.lit(float(values[j])).alias("value"), F.col(f"r{j}").alias("residual"), F.col(f"n{j}").alias("length")) for j in range(k)))).alias("e")).select("e.*")
