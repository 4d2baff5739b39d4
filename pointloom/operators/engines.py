"""Pluggable parts of registration and robust fitting: correspondence engines, their combination, and ready-made instances."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators import correspond, ransac, registration, rgbd
from pointloom.operators.cloud import transform
from pointloom.operators.neighbors import knn
from pointloom.operators.warp import WarpRegistration


class Engine(Protocol):
    """What finds matches (first, second, value) of the destination with the source under the transform (r, t)."""

    def find(self, dst: DataFrame, src: DataFrame, r: np.ndarray, t: np.ndarray) -> DataFrame: ...


@dataclass
class FeatureAdaptor:
    """Points with weighted normals and colors as search or evaluation features, and how they move: normals turn and are made unit again."""

    normal_weight: float | None = None
    color_weight: float | None = None

    def of(self, cloud: DataFrame) -> DataFrame:
        return correspond.features(cloud, self.normal_weight, self.color_weight)

    def moved(self, cloud: DataFrame, r, t) -> DataFrame:
        return correspond.moved_features(cloud, r, t, self.normal_weight, self.color_weight)


@dataclass
class NearestEngine:
    """Nearest neighbors below a limit in one direction or both, in the features of `search`, valued in those of `evaluate` (the same if None)."""

    limit: float = 0.01
    direction: str = "second_to_first"
    reciprocal: bool = False
    fraction: float = 1.0
    one_to_one: bool = False
    search: FeatureAdaptor = field(default_factory=FeatureAdaptor)
    evaluate: FeatureAdaptor | None = None

    def find(self, dst: DataFrame, src: DataFrame, r, t) -> DataFrame:
        scored = (self.evaluate.of(dst), self.evaluate.moved(src, r, t)) if self.evaluate else None
        return correspond.correspondences(self.search.of(dst), self.search.moved(src, r, t), self.limit, self.direction, self.reciprocal, self.fraction, self.one_to_one, scored)


@dataclass
class ProjectiveEngine:
    """The destination point that is seen at the pixel on which a source point falls."""

    k: np.ndarray
    width: int
    height: int
    limit: float = 0.01
    extrinsics: tuple | None = None
    fraction: float = 1.0
    one_to_one: bool = False
    evaluate: FeatureAdaptor = field(default_factory=FeatureAdaptor)

    def find(self, dst: DataFrame, src: DataFrame, r, t) -> DataFrame:
        seen = rgbd.index_map(dst, self.k, self.width, self.height, self.extrinsics)
        falls = rgbd.project_points(transform(src, r, t), self.k, self.width, self.height, self.extrinsics)
        out = correspond.projective(seen, self.evaluate.of(dst), self.evaluate.moved(src, r, t), falls, self.limit)
        out = correspond.keep_fraction(out, self.fraction)
        return correspond.one_to_one_matches(out, "second_to_first") if self.one_to_one else out


@dataclass
class GivenEngine:
    """Matches that are known beforehand, valued anew by distance if a limit is given."""

    pairs: DataFrame
    limit: float | None = None

    def find(self, dst: DataFrame, src: DataFrame, r, t) -> DataFrame:
        if self.limit is None:
            return self.pairs
        return correspond.rescored(self.pairs, dst.select("id", "p"), transform(src.select("id", "p"), r, t), self.limit)


@dataclass
class CombinedMetric:
    """Feeds the point and the plane terms of a combined metric: both from one engine, or each from its own."""

    point: Engine
    plane: Engine | None = None

    def pairs(self, dst: DataFrame, src: DataFrame, r, t, w_point: float, w_plane: float) -> DataFrame:
        """Matches with the attributes of both ends and the weights wp and wl of their point and plane terms."""
        weighted = lambda e, a, b: correspond.gather(e.find(dst, src, r, t), dst, src).withColumn("wp", F.lit(float(a))).withColumn("wl", F.lit(float(b)))
        if self.plane is None:
            return weighted(self.point, w_point, w_plane)
        return weighted(self.point, w_point, 0.0).unionByName(weighted(self.plane, 0.0, w_plane))


class RansacModel(Protocol):
    """What a robust fit needs: the least sample, a model of it, its residual as a column, and a refit to inliers."""

    sample_size: int

    def fit(self, sample: list) -> tuple | None: ...

    def residual(self, model: tuple) -> Column: ...

    def refit(self, inliers: DataFrame) -> tuple | None: ...


def ransac_fit(df: DataFrame, model: RansacModel, columns: list[str], limit: float, iterations: int = 100, target: int | None = None, refit: bool = True, seed: int = 0) -> ransac.Fit | None:
    """The model of a random sample that most rows agree with, refitted to those."""
    return ransac.fit_model(df, model.sample_size, columns, model.fit, model.residual, model.refit if refit else None, limit, iterations, target, seed)


def point_icp(dst: DataFrame, src: DataFrame, engine: Engine | None = None, rigid: bool = True, dim: int = 3, **options) -> registration.Registration:
    """Point to point, single transform."""
    return registration.Registration(dst, src, dim, "point", rigid, engine=engine or NearestEngine(), **options)


def combined_icp(dst: DataFrame, src: DataFrame, engine: Engine | CombinedMetric | None = None, rigid: bool = True, dim: int = 3, **options) -> registration.Registration:
    """Point to point and point to plane, single transform."""
    return registration.Registration(dst, src, dim, "combined", rigid, engine=engine or NearestEngine(), **options)


def symmetric_icp(dst: DataFrame, src: DataFrame, engine: Engine | CombinedMetric | None = None, dim: int = 3, **options) -> registration.Registration:
    """Combined metric with the normals of both ends, rigid."""
    return registration.Registration(dst, src, dim, "symmetric", True, engine=engine or NearestEngine(), **options)


def projective_icp(dst: DataFrame, src: DataFrame, k, width: int, height: int, metric: str = "combined", rigid: bool = True, limit: float = 0.01, extrinsics=None, **options) -> registration.Registration:
    """Single transform with matches by projection."""
    return registration.Registration(dst, src, 3, metric, rigid, engine=ProjectiveEngine(np.asarray(k, float), width, height, limit, extrinsics), **options)


def dense_warp_icp(dst: DataFrame, src: DataFrame, arcs: DataFrame, engine: Engine | None = None, **options) -> WarpRegistration:
    """A transform for each source point, tied along arcs (q, r, weight)."""
    control = src.select(F.col("id").alias("q"), F.col("id").alias("r"), F.lit(1.0).alias("weight"))
    return WarpRegistration(dst, src, control, arcs, engine or NearestEngine(), **options)


def sparse_warp_icp(dst: DataFrame, src: DataFrame, control: DataFrame, arcs: DataFrame, engine: Engine | None = None, **options) -> WarpRegistration:
    """A transform for each control node, blended by the edges (q: source point, r: node, weight), tied along arcs between nodes."""
    return WarpRegistration(dst, src, control, arcs, engine or NearestEngine(), **options)


def control_nodes(src: DataFrame, size: float, dim: int = 3) -> DataFrame:
    """(id, p) of control nodes: the centroids of voxels of the source."""
    from pointloom.operators.grid import downsample

    return downsample(src.select("id", "p"), [size] * dim).select(F.xxhash64(*(f"g{i}" for i in range(dim))).alias("id"), "p")


def control_edges(src: DataFrame, nodes: DataFrame, k: int = 4, weight: Callable[[], Column] | None = None) -> DataFrame:
    """(q, r, weight): the k nearest nodes of each source point; weights by distance, the nearer the more."""
    e = knn(src.select("id", "p"), nodes.select("id", "p"), k)
    return e.select("q", "r", (weight() if weight else 1.0 / (1e-9 + F.col("value"))).alias("weight"))


def stiffness_arcs(nodes: DataFrame, k: int = 8) -> DataFrame:
    """(q, r, weight) between each node and its nearest ones, each pair once."""
    e = knn(nodes.select("id", "p"), nodes.select("id", "p"), k + 1).where("q <> r")
    return e.select(F.least("q", "r").alias("q"), F.greatest("q", "r").alias("r")).distinct().withColumn("weight", F.lit(1.0))
