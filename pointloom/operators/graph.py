"""Graphs of edges (q, r, value): matrices, degrees and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.ranks import ranked
from pointloom.operators.session import cut


def matrix(edges: DataFrame, weight, symmetric: str | None = None) -> DataFrame:
    """COO entries (row, col, value): entry (neighbor, query). symmetric: "dense" keeps one value of mutual entries, "sparse" adds them up."""
    e = edges.select(F.col("r").alias("row"), F.col("q").alias("col"), weight.alias("value"))
    if symmetric is None:
        return e
    both = e.select("row", "col", "value", F.col("col").alias("by")).union(e.select(F.col("col").alias("row"), F.col("row").alias("col"), "value", F.col("col").alias("by")))
    if symmetric == "sparse":
        return both.groupBy("row", "col").agg(F.sum("value").alias("value"))
    return both.groupBy("row", "col").agg(F.max_by("value", "by").alias("value"))


def degrees(edges: DataFrame, without_self: bool = False) -> DataFrame:
    return (edges.where("q <> r") if without_self else edges).groupBy("q").agg(F.count("*").alias("degree"))


ONE_TASK = 2_000_000  # edges, 32 MB; so few are joined up in a single task


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, least id that each reaches) of the edges a-b: roots hook onto lesser roots, then paths are halved until flat."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, x, y = np.arange(len(ids)), at[: len(a)], at[len(a) :]
    while len(x):
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return ids, ids[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition, a few million at a time, as (id, least id that it reaches there)."""
    held, size = [], 0

    def flush():
        t = pa.Table.from_batches(held)
        ids, root = least_reached(t.column("u").to_numpy(), t.column("v").to_numpy())
        keep = ids != root
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(root[keep])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= ONE_TASK:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _lowered(e: DataFrame, larger: bool) -> DataFrame:
    """Each edge moved to the least neighbor: of its lesser end (larger), or of its greater end, which keeps an edge to it as well. No component changes."""
    if larger:
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, comp) of every id of the edges (q, r), all in one partition of bounded size."""
    t = pa.Table.from_batches(batches, pa.schema([("q", pa.int64()), ("r", pa.int64())]))
    ids, root = least_reached(t.column("q").to_numpy(), t.column("r").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["id", "comp"])


def linked_ids(edges: DataFrame, save=cut, most: int | None = None) -> DataFrame:
    """(id, comp) of the ids that the edges (q, r: long) hold, both directions counting: comp is the least id reached. most: a bound of the number of edges, if known.

    Each round joins up the edges of every partition by themselves, then moves edges to least neighbors from either
    side, so that paths shrink to stars in a number of rounds that grows with the logarithm of the longest path.
    Once ONE_TASK edges or fewer are left, one task ends the work. `save` cuts the lineage.
    """
    if most is not None and most <= ONE_TASK:
        return save(edges.where("q <> r").coalesce(1).mapInArrow(_labels, "id long, comp long"))
    e = save(edges.where("q <> r").select(F.greatest("q", "r").alias("u"), F.least("q", "r").alias("v")).distinct())
    while True:
        n = e.count()
        if n <= ONE_TASK:
            done = save(e.coalesce(1).mapInArrow(_stars, "u long, v long"))
            break
        near = e.mapInArrow(_stars, "u long, v long").distinct()
        done = save(_lowered(save(_lowered(near, True)), False))
        if done.join(done.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0 and done.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            break
        e = done
    roots = done.select("v").distinct()
    found = done.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots.select(F.col("v").alias("id"), F.col("v").alias("comp")))
    return found if most is None else save(found)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, comp): comp the least id that id reaches over the edges (q, r) in either direction."""
    found = linked_ids(edges.select(F.col("q").cast("long").alias("q"), F.col("r").cast("long").alias("r")))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def reachable(edges: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, comp) of the nodes that seeds reach along edges; seeds that meet share a component."""
    found = cut(seeds.select("id").distinct())
    while True:
        more = edges.join(found, edges["q"] == found["id"]).select(F.col("r").alias("id")).distinct().join(found, "id", "left_anti")
        more = cut(more)
        if more.limit(1).count() == 0:
            break
        found = cut(found.union(more))
    inside = edges.join(found.withColumnRenamed("id", "q"), "q", "left_semi")
    return components(inside, nodes.join(found, "id", "left_semi"))


def seeded(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """The labels (id, comp) of the components that hold a seed (id): what seeds reach where edges go both ways."""
    found = labels.join(seeds.select("id").hint("merge"), "id", "left_semi").select("comp").distinct()
    return labels.join(found.hint("merge"), "comp", "left_semi").select("id", "comp")


def segments(labels: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(id, cluster): components of a size within bounds, numbered by size, the largest first, ties by the least id; others null."""
    sizes = labels.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    if most is not None:
        sizes = sizes.where(F.col("size") <= most)
    numbered = ranked(sizes, [F.desc("size"), "comp"], "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    return labels.join(numbered.select("comp", "cluster").hint("merge"), "comp", "left").select("id", "cluster")


def cluster_members(labels: DataFrame) -> DataFrame:
    return labels.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def labeled(labels: DataFrame, yes: bool = True) -> DataFrame:
    c = F.col("cluster")
    return labels.where(c.isNotNull() if yes else c.isNull())
