"""Robust fitting: samples and models on the driver, one pass of Spark scores all candidate models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.operators.registration import fit_affine, fit_rigid
from pointloom.operators.stats import canonical_axes, covariance

BLOCK = 50  # candidate models that one pass scores


@dataclass
class Fit:
    model: tuple
    inliers: int
    candidates: int


def plane_of(points: np.ndarray) -> tuple[np.ndarray, float]:
    """[n, d] of the plane through points by least squares."""
    c = points.mean(0)
    n = np.linalg.svd(points - c)[2][-1]
    return n, -float(n @ c)


def plane_residual(model) -> Column:
    n, d = model
    return F.abs(sum((F.lit(float(v)) * F.col("p")[i] for i, v in enumerate(n)), F.lit(0.0)) + float(d))


def transform_residual(model) -> Column:
    """Of correspondences with columns p1 (destination) and p2 (source)."""
    r, t = np.asarray(model[0]).tolist(), np.asarray(model[1]).tolist()
    at = [sum((v * F.col("p2")[j] for j, v in enumerate(row)), F.lit(float(b))) for row, b in zip(r, t, strict=True)]
    return F.sqrt(sum(((F.col("p1")[i] - y) * (F.col("p1")[i] - y) for i, y in enumerate(at)), F.lit(0.0)))


def score(df: DataFrame, residuals: list[Column], limit: float) -> list[int]:
    """Inliers of every model, counted in one pass."""
    return list(df.agg(*(F.coalesce(F.sum((r <= limit).cast("long")), F.lit(0)).alias(f"m{i}") for i, r in enumerate(residuals))).first())


def draw(df: DataFrame, columns: list[str], count: int, seed: int) -> list:
    """About four times `count` rows, and all of a small table: every row has the same chance, by a hash of its id and the seed. In the order of that hash."""
    keys = [c for c in ("id", "first", "second") if c in df.columns] or columns
    n = df.count()
    u = F.xxhash64(F.lit(seed), *keys)
    low = (2 * min(1.0, 4 * count / max(1, n)) - 1) * 2.0**63
    return df.select(u.alias("u"), *columns).where(F.col("u").cast("double") <= F.lit(low)).orderBy("u").limit(16 * count).drop("u").collect()


def fit_model(df: DataFrame, k: int, columns: list[str], fit, residual, refit, limit: float, iterations: int = 100, target: int | None = None, seed: int = 0) -> Fit | None:
    """The best of `iterations` models, each fit(sample of k rows), by the rows with residual(model) <= limit; it ends early at `target` rows (half of all if None). refit(inliers) gives the final model."""
    target = target if target is not None else -(-df.count() // 2)
    best, inliers, seen = None, 0, 0
    for at in range(0, iterations, BLOCK):
        some = min(BLOCK, iterations - at)
        rows = draw(df, columns, some * k, seed + at)
        if len(rows) < k:
            return None
        rng = np.random.default_rng(seed + at)
        models = [m for m in (fit([rows[i] for i in rng.permutation(len(rows))[:k]]) for _ in range(some)) if m is not None]
        if models:
            for m, n in zip(models, score(df, [residual(m) for m in models], limit), strict=True):
                if n > inliers:
                    best, inliers = m, n
        seen += some
        if inliers >= target:
            break
    if best is None:
        return None
    if refit is not None:
        best = refit(df.where(residual(best) <= limit)) or best
        inliers = score(df, [residual(best)], limit)[0]
    return Fit(best, inliers, seen)


def fit_plane(df: DataFrame, dim: int = 3, limit: float = 0.1, iterations: int = 100, target: int | None = None, refit: bool = True, seed: int = 0) -> Fit | None:
    """Plane with the most points within the limit; None if none has any."""

    def least_squares(inside: DataFrame):
        mean, c, _ = covariance(inside, dim)
        axis = canonical_axes(c)[1][:, -1]
        return axis, -float(axis @ mean)

    return fit_model(df, dim, ["p"], lambda rows: plane_of(np.array([r[0] for r in rows], float)), plane_residual, least_squares if refit else None, limit, iterations, target, seed)


def fit_transform(pairs: DataFrame, dim: int = 3, rigid: bool = True, limit: float = 0.01, iterations: int = 100, target: int | None = None, refit: bool = True, seed: int = 0) -> Fit | None:
    """Transform of source points p2 to p1 with the most correspondences within the limit."""
    from pointloom.operators.registration import estimate_point_to_point

    solve = fit_rigid if rigid else fit_affine
    of = lambda rows: solve(*(np.array([r[i] for r in rows], float) for i in (0, 1)))
    again = (lambda inside: estimate_point_to_point(inside, dim, rigid)) if refit else None
    return fit_model(pairs, dim if rigid else dim + 1, ["p1", "p2"], of, transform_residual, again, limit, iterations, target, seed)
