"""Correspondences (first, second, value) between two clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import l2sq, unit, vscale
from pointloom.operators.cloud import best_per, rank_fraction, transform, transform_set
from pointloom.operators.cells import L2, Index, nearest_lists
from pointloom.operators.neighbors import TREE_DIM, dimension, knn


def features(df: DataFrame, normal_weight: float | None = None, color_weight: float | None = None) -> DataFrame:
    """(id, p) with p the point, weighted normal and weighted color laid end to end."""
    parts = [F.col("p")]
    if normal_weight is not None:
        parts.append(vscale("n", normal_weight))
    if color_weight is not None:
        parts.append(vscale(F.col("c").cast("array<double>"), color_weight))
    return df.select("id", F.concat(*parts).alias("p"))


def moved_features(df: DataFrame, r, t, normal_weight: float | None = None, color_weight: float | None = None) -> DataFrame:
    out = transform(df, r, t)
    if normal_weight is not None:
        out = out.withColumn("n", unit("n"))
    return features(out, normal_weight, color_weight)


def moved_features_by_set(df: DataFrame, transforms: DataFrame, dim: int, rigid: bool = True, normal_weight: float | None = None, color_weight: float | None = None) -> DataFrame:
    """As moved_features, each point by its own transform (id, r, t)."""
    out = transform_set(df, transforms, dim, rigid)
    if normal_weight is not None:
        out = out.withColumn("n", unit("n"))
    return features(out, normal_weight, color_weight)


def _one_way(queries: DataFrame, refs: DataFrame, limit: float, query_is_first: bool) -> DataFrame:
    hits = knn(queries, refs, 1, limit=limit).where(F.col("value") < limit)
    a, b = ("q", "r") if query_is_first else ("r", "q")
    return hits.select(F.col(a).alias("first"), F.col(b).alias("second"), "value")


def index_of(df: DataFrame) -> Index | None:
    """Cells for the nearest point of df, which the rounds of a loop share; None without points."""
    dim = dimension(df)
    return Index(df, 1, L2, dim, dim > TREE_DIM) if dim else None


def matched_points(index: Index | None, second: DataFrame, limit: float) -> DataFrame:
    """(first, second, value, p1, p2): each point of `second` with the nearest one of the index, if below the limit. Points come with the search, so that no join brings them."""
    if index is None:
        return second.select(F.col("id").alias("first"), F.col("id").alias("second"), F.lit(0.0).alias("value"), F.col("p").alias("p1"), F.col("p").alias("p2")).where("false")
    near = nearest_lists(second, None, 1, limit=limit, index=index).select("q", "qp", F.col("nn")[0].alias("n"))
    return near.select(F.col("n.r").alias("first"), F.col("q").alias("second"), F.col("n.value").alias("value"), F.col("n.rp").alias("p1"), F.col("qp").alias("p2")).where(F.col("value") < limit)


def rescored(pairs: DataFrame, first: DataFrame, second: DataFrame, limit: float, score=None) -> DataFrame:
    """The pairs with their value in the given features, those below the limit."""
    j = pairs.select("first", "second").join(first.select(F.col("id").alias("first"), F.col("p").alias("a")), "first").join(second.select(F.col("id").alias("second"), F.col("p").alias("b")), "second")
    return j.select("first", "second", (score or l2sq)("a", "b").alias("value")).where(F.col("value") < limit)


def correspondences(first: DataFrame, second: DataFrame, limit: float, direction: str = "second_to_first", reciprocal: bool = False, fraction: float = 1.0, one_to_one: bool = False, evaluate: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Nearest-neighbor matches with value below limit. Both ways: the union, or with reciprocal the intersection, with the values of first to second."""
    forward = lambda: _one_way(first, second, limit, True)
    back = lambda: _one_way(second, first, limit, False)
    if direction == "first_to_second":
        out = forward()
    elif direction == "second_to_first":
        out = back()
    elif reciprocal:
        out = forward().join(back().select("first", "second"), ["first", "second"], "left_semi")
    else:
        f = forward()
        out = f.union(back().join(f.select("first", "second"), ["first", "second"], "left_anti"))
    if evaluate is not None:
        out = rescored(out, *evaluate, limit)
    out = keep_fraction(out, fraction)
    return one_to_one_matches(out, direction) if one_to_one else out


def keep_fraction(pairs: DataFrame, fraction: float) -> DataFrame:
    return rank_fraction(pairs, ["value", "first", "second"], fraction)


def one_to_one_matches(pairs: DataFrame, direction: str) -> DataFrame:
    """The best match of each second (first to second) or first (second to first); both ways: unchanged."""
    if direction == "first_to_second":
        return best_per(pairs, "second", ["value", "first"])
    return best_per(pairs, "first", ["value", "second"]) if direction == "second_to_first" else pairs


def gather(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The pairs with the attributes of both ends, ending in 1 and 2."""
    named = lambda df, key, k: df.select(F.col("id").alias(key), *(F.col(c).alias(f"{c}{k}") for c in df.columns if c != "id"))
    return pairs.join(named(first, "first", 1), "first").join(named(second, "second", 2), "second")


def projective(index_map: DataFrame, first: DataFrame, source: DataFrame, projected: DataFrame, limit: float) -> DataFrame:
    """Matches of source points with the point of `first` that the index map (y, x, id) holds at their pixel."""
    j = projected.select(F.col("id").alias("second"), "y", "x").join(index_map.select("y", "x", F.col("id").alias("first")), ["y", "x"])
    return rescored(j, first, source, limit)
