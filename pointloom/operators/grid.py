"""Voxel grids: accumulators are aggregations by floor(p / bin), one exchange with partial sums before it."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pointloom.functions.vectors import vdot


def grid_keys(bins: list[float], p: str = "p") -> list[Column]:
    """g0, g1 ...: the product with the reciprocal decides, not the quotient."""
    return [F.floor(F.col(p)[i] * (1.0 / b)).cast("bigint").alias(f"g{i}") for i, b in enumerate(bins)]


def with_grid(df: DataFrame, bins: list[float]) -> DataFrame:
    return df.select("*", *grid_keys(bins))


def corners(df: DataFrame, bins: list[float]) -> DataFrame:
    return df.withColumn("corner", F.array(*(F.col(f"g{i}") * b for i, b in enumerate(bins))))


def accumulate(df: DataFrame, bins: list[float], aggs: list[Column], min_points: int = 1) -> DataFrame:
    """g0.., count and the given aggregates of each voxel that holds min_points."""
    keys = [f"g{i}" for i in range(len(bins))]
    return with_grid(df, bins).groupBy(*keys).agg(F.count("*").alias("count"), *aggs).where(F.col("count") >= min_points)


def index_lists(df: DataFrame, bins: list[float]) -> DataFrame:
    return accumulate(df, bins, [F.sort_array(F.collect_list("id")).alias("ids")])


def aligned_parts(d: int) -> list[Column]:
    """Aggregates of a fixed size, which merge: sums of the normals n in classes, and the first member by id.

    A normal and its opposite are one line, written with its first component that is not zero positive; a class is a pattern of the other signs, so
    the members of a class are on one side of each other.
    """
    x = [F.col("n")[i] for i in range(d)]
    negative = F.lit(False)
    for v in reversed(x):
        negative = (v < 0) | ((v == 0) & negative)
    line = [F.when(negative, -v).otherwise(v) for v in x]
    kind = sum((F.when(v < 0, 1 << i).otherwise(0) for i, v in enumerate(line[1:])), F.lit(0))
    sums = [F.sum(F.when(kind == c, line[i]).otherwise(0.0)).alias(f"_n{c}_{i}") for c in range(1 << (d - 1)) for i in range(d)]
    return sums + [F.min_by(x[i], "id").alias(f"_f{i}") for i in range(d)]


def aligned_sum(d: int) -> Column:
    """Of aligned_parts: the class sums, the longest first, each turned to the side of the sum so far; the whole turned to the side of the first member."""
    classes = F.array(*(F.array(*(F.coalesce(f"_n{c}_{i}", F.lit(0.0)) for i in range(d))) for c in range(1 << (d - 1))))
    longest = F.array_sort(F.transform(classes, lambda s: F.struct((-vdot(s, s)).alias("by"), s.alias("s"))))
    add = lambda s, e: F.when(vdot(s, e["s"]) < 0, F.zip_with(s, e["s"], lambda a, b: a - b)).otherwise(F.zip_with(s, e["s"], lambda a, b: a + b))
    total = F.aggregate(longest, F.array(*[F.lit(0.0)] * d), add)
    first = F.array(*(F.col(f"_f{i}") for i in range(d)))
    return F.when(vdot(total, first) < 0, F.transform(total, lambda v: -v)).otherwise(total)


def downsample(df: DataFrame, bins: list[float], min_points: int = 1) -> DataFrame:
    """Centroid p of each voxel; with normals the unit vector of their aligned sum, with colors their mean."""
    d = len(bins)
    aggs = [F.avg(F.col("p")[i]).alias(f"_p{i}") for i in range(d)]
    if "n" in df.columns:
        aggs += aligned_parts(d)
    if "c" in df.columns:
        aggs += [F.avg(F.col("c")[i].cast("double")).alias(f"_c{i}") for i in range(3)]
    out = accumulate(df, bins, aggs, min_points).withColumn("p", F.array(*(f"_p{i}" for i in range(d))))
    if "n" in df.columns:
        size = F.sqrt(vdot("n", "n"))
        out = out.withColumn("n", aligned_sum(d)).withColumn("n", F.when(size > 0, F.transform("n", lambda x: x / size)).otherwise(F.col("n")))
    if "c" in df.columns:
        out = out.withColumn("c", F.array("_c0", "_c1", "_c2"))
    return out.drop(*(c for c in out.columns if c.startswith("_")))


class Accumulator(Protocol):
    """What a user adds up for each voxel: a state as a list of numbers, which partial states merge into.

    columns: the columns of the points that it reads. schema: what finish returns, as a Spark schema.
    """

    columns: list[str]
    schema: str

    def build(self, points: dict[str, list]) -> list[float]: ...

    def merge(self, a: list[float], b: list[float]) -> list[float]: ...

    def finish(self, state: list[float]) -> tuple: ...


MOST_STATES = 50_000  # states that a task holds before it sends them on
HELD_BYTES = 64 << 20  # of points, which a task puts in the order of their voxels
SLICE_ROWS = 10_000  # of these that are lists at a time, about


def accumulate_with(df: DataFrame, bins: list[float], accumulator: Accumulator) -> DataFrame:
    """g0.., count and the accumulator's columns of each voxel. Tasks build and merge states before the exchange, so it moves a state for each voxel and task, not the points."""
    d, names = len(bins), accumulator.columns

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in held], pa.int64()) for i in range(d)), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.list_(pa.float64()))], names=[*(f"g{i}" for i in range(d)), "count", "state"])
            held.clear()
            return out

        def fold(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Rows of a voxel side by side, so that the accumulator is asked once for all of them."""
            voxels = np.stack([v for c in (rows.column(f"g{i}") for i in range(d)) for v in (c.fill_null(0).to_numpy(), c.is_valid().to_numpy().astype(int))], 1)
            order = np.lexsort(voxels.T[::-1])
            voxels, rows = voxels[order], rows.select(names).take(pa.array(order))
            starts = np.flatnonzero(np.concatenate([[True], (voxels[1:] != voxels[:-1]).any(1)]))
            ends = np.append(starts[1:], len(voxels))
            for some in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(starts // SLICE_ROWS)) + 1):
                low = int(starts[some[0]])
                points = {c: rows.column(c).slice(low, int(ends[some[-1]]) - low).to_pylist() for c in names}
                for k, at, end in zip(voxels[starts[some]].tolist(), (starts[some] - low).tolist(), (ends[some] - low).tolist(), strict=True):
                    key = tuple(v if there else None for v, there in zip(k[::2], k[1::2], strict=True))
                    state = accumulator.build({c: v[at:end] for c, v in points.items()})
                    old = held.get(key)
                    held[key] = [end - at, state] if old is None else [old[0] + end - at, accumulator.merge(old[1], state)]
                if len(held) > MOST_STATES:
                    yield sent()

        waiting, size = [], 0
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                size += b.nbytes
            if size > HELD_BYTES:
                yield from fold(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if waiting:
            yield from fold(pa.Table.from_batches(waiting))
        if held:
            yield sent()

    keys = ", ".join(f"g{i} long" for i in range(d))
    states = with_grid(df, bins).select(*(f"g{i}" for i in range(d)), *names).mapInArrow(partial, f"{keys}, count long, state array<double>")
    result = StructType.fromDDL(accumulator.schema)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition, which are sorted by voxel: states of a voxel lie one behind the other, whatever batches they come in."""
        kinds, key, now = to_arrow_schema(result), None, []

        def out(rows: list) -> pa.RecordBatch:
            values = [accumulator.finish(state) for _, _, state in rows]
            return pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(d)), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([v[i] for v in values], f.type) for i, f in enumerate(kinds))], names=[*(f"g{i}" for i in range(d)), "count", *kinds.names])

        for b in batches:
            done = []
            for *mine, count, state in zip(*(b.column(c).to_pylist() for c in (*(f"g{i}" for i in range(d)), "count", "state")), strict=True):
                if tuple(mine) == key:
                    now = [key, now[1] + count, accumulator.merge(now[2], state)]
                else:
                    if now:
                        done.append(now)
                    key = tuple(mine)
                    now = [key, count, state]
            if done:
                yield out(done)
        if now:
            yield out([now])

    names_of = [f"g{i}" for i in range(d)]
    return states.repartition(*names_of).sortWithinPartitions(*names_of).mapInArrow(ended, f"{keys}, count long, {accumulator.schema}")


def lookup(df: DataFrame, voxels: DataFrame, bins: list[float]) -> DataFrame:
    """Points with the voxel they fall into, those that have one."""
    return with_grid(df, bins).join(voxels, [f"g{i}" for i in range(len(bins))])
