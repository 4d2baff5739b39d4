"""Depth and color images as pixels (y, x, depth[, r, g, b]) and their conversions from and to clouds."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.vectors import affine, col, cross3, unit


def metric_depth(depth, scale: float = 1000.0, most: float | None = None) -> Column:
    """Raw depth over scale; values from `most` on become zero."""
    d = col(depth) / scale
    return d if most is None else F.when(d < most, d).otherwise(0.0)


def raw_depth(z, scale: float = 1000.0, most: float | None = None) -> Column:
    raw = F.floor(col(z) * scale).cast("bigint")
    return raw if most is None else F.when(col(z) < most, raw).otherwise(0)


class DepthConverter(Protocol):
    """From the depth of a pixel to meters (zero: not valid) and back, as columns."""

    def metric(self, depth: Column) -> Column: ...

    def raw(self, z: Column) -> Column: ...


@dataclass(frozen=True)
class ScaledDepth:
    """Raw depth in parts of a meter, none from `most` meters on."""

    scale: float = 1000.0
    most: float | None = None

    def metric(self, depth: Column) -> Column:
        return metric_depth(depth, self.scale, self.most)

    def raw(self, z: Column) -> Column:
        return raw_depth(z, self.scale, self.most)


def _point(k, z: Column, x: Column, y: Column) -> Column:
    (fx, _, cx), (_, fy, cy), _ = np.asarray(k).tolist()
    return F.array((x - cx) * z / fx, (y - cy) * z / fy, z)


def depth_to_points(pixels: DataFrame, k, scale: float = 1000.0, most: float | None = None, keep_invalid: bool = False, extrinsics=None, colors: bool = False, converter: DepthConverter | None = None) -> DataFrame:
    """(y, x, p[, c]): valid pixels only unless keep_invalid, which gives the camera's own place for the others. A converter goes before scale and most."""
    df = pixels.withColumn("_z", (converter or ScaledDepth(scale, most)).metric(F.col("depth")))
    if not keep_invalid:
        df = df.where("_z > 0")
    p = _point(k, F.col("_z"), F.col("x"), F.col("y"))
    out = df.withColumn("p", affine(*extrinsics, p) if extrinsics is not None else p)
    return out.select("y", "x", "p", *([_colors()] if colors else []))


def _colors() -> Column:
    return F.array(*((F.col(c) / 255.0).cast("float") for c in "rgb")).alias("c")


def depth_to_normals(pixels: DataFrame, k, scale: float = 1000.0, most: float | None = None, keep_invalid: bool = False, extrinsics=None, colors: bool = False, converter: DepthConverter | None = None, image: str | None = None) -> DataFrame:
    """([image, ]y, x, p, n[, c]): normals from the pixels above, below, left and right, where all five depths are valid. Without keep_invalid only pixels with normals stay.

    image: a column that tells images apart; rows and columns of pixels are then looked at within each.
    """
    of = [image] if image else []
    df = pixels.withColumn("_z", (converter or ScaledDepth(scale, most)).metric(F.col("depth"))).withColumn("p", _point(k, F.col("_z"), F.col("x"), F.col("y")))
    row, column = Window.partitionBy(*of, "y").orderBy("x"), Window.partitionBy(*of, "x").orderBy("y")
    near = {"_l": (F.lag, row), "_r": (F.lead, row), "_u": (F.lag, column), "_d": (F.lead, column)}
    for name, (f, w) in near.items():
        df = df.withColumn(name, f(F.struct("x", "y", "p")).over(w))
    adjacent = {"_l": ("x", -1), "_r": ("x", 1), "_u": ("y", -1), "_d": ("y", 1)}
    ok = F.col("_z") > 0
    for name, (axis, step) in adjacent.items():
        ok = ok & F.col(name).isNotNull() & (F.col(f"{name}.{axis}") == F.col(axis) + step) & (F.col(f"{name}.p")[2] > 0)
    diff = lambda a, b: F.zip_with(F.col(f"{a}.p"), F.col(f"{b}.p"), lambda x, y: x - y)
    df = df.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("n", F.when(F.col("_ok"), unit(cross3(diff("_d", "_u"), diff("_r", "_l")))).otherwise(F.array(*[F.lit(float("nan"))] * 3)))
    if not keep_invalid:
        df = df.where("_ok")
    if extrinsics is not None:
        r, t = extrinsics
        df = df.withColumn("p", affine(r, t, "p")).withColumn("n", affine(r, [0.0] * 3, "n"))
    return df.select(*of, "y", "x", "p", "n", *([_colors()] if colors else []))


def project_points(df: DataFrame, k, width: int, height: int, extrinsics=None) -> DataFrame:
    """Adds y, x, z of the pixel that each point in front of the camera falls on, inside the image."""
    if extrinsics is not None:
        r, t = np.linalg.inv(extrinsics[0]), -np.linalg.inv(extrinsics[0]) @ np.asarray(extrinsics[1])
        df = df.withColumn("_q", affine(r, t, "p"))
    else:
        df = df.withColumn("_q", F.col("p"))
    q, (fx, s, cx), (_, fy, cy) = F.col("_q"), np.asarray(k)[0].tolist(), np.asarray(k)[1].tolist()
    out = df.withColumn("z", q[2]).where("z > 0")
    out = out.withColumn("x", F.round((fx * q[0] + s * q[1] + cx * q[2]) / q[2]).cast("bigint")).withColumn("y", F.round((fy * q[1] + cy * q[2]) / q[2]).cast("bigint"))
    return out.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).drop("_q")


def points_to_depth(df: DataFrame, k, width: int, height: int, scale: float = 1000.0, extrinsics=None) -> DataFrame:
    """(y, x, depth): the least raw depth of the points on each pixel; pixels without one have no row."""
    return project_points(df, k, width, height, extrinsics).groupBy("y", "x").agg(F.min(raw_depth("z", scale)).alias("depth"))


def points_to_rgbd(df: DataFrame, k, width: int, height: int, scale: float = 1000.0, extrinsics=None) -> DataFrame:
    """(y, x, depth, r, g, b) of the nearest point on each pixel; colors are cut, not rounded."""
    near = project_points(df, k, width, height, extrinsics).groupBy("y", "x").agg(F.min(F.struct("z", "id", "c")).alias("_m"))
    return near.select("y", "x", raw_depth("_m.z", scale).alias("depth"), *(F.floor(F.col("_m.c")[i] * 255).cast("int").alias(n) for i, n in enumerate("rgb")))


def index_map(df: DataFrame, k, width: int, height: int, extrinsics=None) -> DataFrame:
    """(y, x, id) of the nearest point on each pixel."""
    return project_points(df, k, width, height, extrinsics).groupBy("y", "x").agg(F.min(F.struct("z", "id"))["id"].alias("id"))
