"""A cloud with its usual operations in one object, a model of fused frames, and small helpers."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.vectors import vdot
from pointloom.operators import cloud, grid, rgbd
from pointloom.operators.engines import ProjectiveEngine, symmetric_icp
from pointloom.operators.neighbors import KNN, Radius
from pointloom.operators.normals import normals
from pointloom.operators.session import cut
from pointloom.operators.spatial import Polytope, Region


@dataclass
class PointCloud:
    """df: (id, p[, n][, c]). Every operation gives a new cloud."""

    df: DataFrame

    @staticmethod
    def from_ply(spark: SparkSession, path: str) -> PointCloud:
        from pointloom.sources import ply

        return PointCloud(ply.read_cloud(spark, path))

    @staticmethod
    def from_depth_image(pixels: DataFrame, k, scale: float = 1000.0, most: float | None = None, with_normals: bool = False, keep_invalid: bool = False, extrinsics=None) -> PointCloud:
        """Of pixels (y, x, depth); the id is a number of y and x."""
        return PointCloud._of_image(pixels, k, scale, most, with_normals, keep_invalid, extrinsics, False)

    @staticmethod
    def from_rgbd_images(pixels: DataFrame, k, scale: float = 1000.0, most: float | None = None, with_normals: bool = False, keep_invalid: bool = False, extrinsics=None) -> PointCloud:
        """Of pixels (y, x, depth, r, g, b)."""
        return PointCloud._of_image(pixels, k, scale, most, with_normals, keep_invalid, extrinsics, True)

    @staticmethod
    def _of_image(pixels, k, scale, most, with_normals, keep_invalid, extrinsics, colors) -> PointCloud:
        make = rgbd.depth_to_normals if with_normals else rgbd.depth_to_points
        df = make(pixels, k, scale, most, keep_invalid, extrinsics, colors)
        return PointCloud(df.select((F.col("y").cast("long") * (1 << 32) + F.col("x")).alias("id"), *(c for c in df.columns if c not in "yx")))

    def has(self, column: str) -> bool:
        return column in self.df.columns

    def append(self, other: PointCloud) -> PointCloud:
        return PointCloud(cloud.append(self.df, other.df))

    def transform(self, r, t) -> PointCloud:
        return PointCloud(cloud.transform(self.df, r, t))

    def downsample(self, size: float, min_points: int = 1, dim: int = 3) -> PointCloud:
        v = grid.downsample(self.df, [size] * dim, min_points)
        return PointCloud(v.select(F.xxhash64(*(f"g{i}" for i in range(dim))).alias("id"), *(c for c in v.columns if c in ("p", "n", "c"))))

    def inside(self, region: Polytope | Region, offset: float = 0.0) -> PointCloud:
        return PointCloud(self.df.where(region.contains("p", offset)))

    def estimate_normals(self, spec, dim: int = 3, use_current: bool = False, robust: dict | None = None) -> PointCloud:
        """Normals turned to the origin, or to the side of the present ones if use_current. robust: options of the minimum covariance determinant."""
        if use_current and not self.has("n"):
            raise ValueError("there are no present normals")
        base = self.df.select("id", "p", *(["n"] if use_current else []))
        found = normals(base, spec, dim, None if use_current else [0.0] * dim, "n" if use_current else None, covariance=robust)
        rest = self.df.drop("n") if self.has("n") else self.df
        return PointCloud(rest.join(found.select("id", "n"), "id"))

    def estimate_normals_knn(self, k: int, **options) -> PointCloud:
        return self.estimate_normals(KNN(k), **options)

    def estimate_normals_radius(self, radius: float, **options) -> PointCloud:
        return self.estimate_normals(Radius(radius), **options)

    def valid(self) -> PointCloud:
        """Rows whose attributes are all finite."""
        return PointCloud(cloud.remove_invalid(self.df))

    def to_ply(self, path: str, **options) -> None:
        from pointloom.sources import ply

        ply.write_cloud(self.df, path, **options)


@dataclass
class Fusion:
    """A model (id, p, n[, c], confidence, seen) that frames are registered to by projection and merged into."""

    model: DataFrame | None
    k: np.ndarray
    width: int
    height: int
    limit: float = 0.01  # squared distance of matches
    sure: float = 3.0  # confidence from which a point stays
    keep: int = 10  # frames for which an unsure point stays
    frame: int = 0
    pose: tuple | None = None

    def add(self, frame: DataFrame, max_iter: int = 10) -> tuple[np.ndarray, np.ndarray]:
        """Find the pose of a frame (id, p, n[, c]) in the model, average matched points by confidence, insert the others, and drop old unsure ones."""
        r, t = self.pose or (np.eye(3), np.zeros(3))
        self.frame += 1
        if self.model is None:
            self.model = cut(frame.withColumns({"confidence": F.lit(1.0), "seen": F.lit(self.frame)}))
            self.pose = (r, t)
            return self.pose
        engine = ProjectiveEngine(self.k, self.width, self.height, self.limit, (r, t))
        attributes = [c for c in ("p", "n", "c") if c in frame.columns and c in self.model.columns]
        known = self.model.select("id", *attributes)
        r, t, _, _ = symmetric_icp(known, frame, engine, max_iter=max_iter).run((r, t))
        self.pose = (r, t)
        placed = cloud.transform(frame, r, t)
        pairs = cut(engine.find(known, frame, r, t))
        best = cloud.best_per(pairs, "first", ["value", "second"])
        new = placed.select(F.col("id").alias("second"), *(F.col(c).alias(f"new_{c}") for c in attributes))
        j = self.model.join(best.select(F.col("first").alias("id"), "second").join(new, "second"), "id", "left")
        hit = F.col("second").isNotNull()
        mean = lambda c: F.when(hit, F.zip_with(c, f"new_{c}", lambda a, b: (F.col("confidence") * a + b) / (F.col("confidence") + 1))).otherwise(F.col(c))
        updated = j.select("id", *(mean(c).alias(c) for c in attributes), (F.col("confidence") + hit.cast("double")).alias("confidence"), F.when(hit, self.frame).otherwise(F.col("seen")).alias("seen"))
        length = F.sqrt(vdot("n", "n"))
        updated = updated.withColumn("n", F.when(length > 0, F.transform("n", lambda x: x / length)).otherwise(F.col("n")))
        fresh = placed.join(pairs.select(F.col("second").alias("id")).distinct(), "id", "left_anti").select(F.xxhash64(F.lit(self.frame), "id").alias("id"), *attributes, F.lit(1.0).alias("confidence"), F.lit(self.frame).alias("seen"))
        stays = (F.col("confidence") >= self.sure) | (F.col("seen") > self.frame - self.keep)
        self.model = cut(updated.where(stays).unionByName(fresh))
        return self.pose


def random_ids(df: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """`count` rows, each equally likely, by a hash of id and seed."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(count)


class Timer:
    """Milliseconds between start and stop; also a context."""

    def __init__(self, start: bool = True):
        self.began = self.ended = time.perf_counter()
        self.running = start

    def start(self) -> None:
        self.began, self.running = time.perf_counter(), True

    def stop(self) -> float:
        self.ended, self.running = time.perf_counter(), False
        return self.elapsed()

    def elapsed(self) -> float:
        return 1000 * ((time.perf_counter() if self.running else self.ended) - self.began)

    def __enter__(self) -> Timer:
        self.start()
        return self

    def __exit__(self, *_) -> None:
        self.stop()
