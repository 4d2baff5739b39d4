"""Means, covariances, principal components and robust covariances."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.vectors import matvec
from pointloom.operators.ranks import ranked
from pointloom.operators.session import cut


def centroid(df: DataFrame, dim: int) -> DataFrame:
    return df.agg(*(F.avg(F.col("p")[i]).alias(f"m{i}") for i in range(dim)))


def covariance_columns(dim: int, p: str = "p"):
    """Sample covariances s_ij, i <= j."""
    return [F.covar_samp(F.col(p)[i], F.col(p)[j]).alias(f"s{i}{j}") for i in range(dim) for j in range(i, dim)]


def covariance(df: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, rows) of a cloud; one aggregation. NaN below two rows."""
    row = df.agg(F.count("*"), *(F.avg(F.col("p")[i]) for i in range(dim)), *covariance_columns(dim)).first()
    n, rest = row[0], [np.nan if v is None else v for v in row[1:]]
    mean, c, k = np.array(rest[:dim]), np.full((dim, dim), np.nan), dim
    for i in range(dim):
        for j in range(i, dim):
            c[i, j] = c[j, i] = rest[k] if n > 1 else np.nan
            k += 1
    return mean, c, n


@dataclass(frozen=True)
class Pca:
    mean: np.ndarray
    values: np.ndarray  # descending
    vectors: np.ndarray  # one axis in each column


def canonical_axes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending and axes; each axis has its largest component positive, the last is turned to make a rotation."""
    values, vectors = np.linalg.eigh(c)
    values, vectors = values[::-1], vectors[:, ::-1]
    big = np.abs(vectors).argmax(0)
    vectors = vectors * np.sign(vectors[big, np.arange(len(big))])
    if np.linalg.det(vectors) < 0:
        vectors[:, -1] *= -1
    return values, vectors


def pca(df: DataFrame, dim: int) -> Pca:
    mean, c, _ = covariance(df, dim)
    values, vectors = canonical_axes(c)
    return Pca(mean, values, vectors)


def project(df: DataFrame, model: Pca, k: int) -> DataFrame:
    """Coordinates on the first k axes."""
    v = model.vectors[:, :k].T
    shift = v @ model.mean
    moved = matvec(v, "p")
    return df.withColumn("p", F.array(*(moved[i] - float(s) for i, s in enumerate(shift))))


def reconstruct(df: DataFrame, model: Pca, k: int) -> DataFrame:
    moved = matvec(model.vectors[:, :k], "p")
    return df.withColumn("p", F.array(*(moved[i] + float(s) for i, s in enumerate(model.mean))))


def mcd(points: np.ndarray, trials: int = 6, steps: int = 3, share: float = 0.75, least: int = 2, chi2: float = -1.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Minimum covariance determinant: (mean, covariance, whether the first point is within chi2)."""
    n, d = points.shape
    plain = lambda x: (x.mean(0), np.cov(x.T).reshape(d, d))
    if n < 2:
        return np.full(d, np.nan), np.full((d, d), np.nan), False
    if n <= least:
        m, c = plain(points)
        return m, c, True
    rng, h, best = np.random.default_rng(seed), min(max(least, round(share * n)), n), None
    far = lambda m, c: np.einsum("ij,jk,ik->i", points - m, np.linalg.pinv(c), points - m)
    for _ in range(trials):
        m, c = plain(points[rng.integers(0, n, max(least, 2))])
        for _ in range(steps):
            m, c = plain(points[np.argsort(far(m, c), kind="stable")[:h]])
        det = np.linalg.det(c)
        if np.isfinite(det) and (best is None or det < best[0]):
            best = (det, m, c)
    m, c = best[1:] if best else plain(points)
    return m, c, chi2 <= 0 or bool(far(m, c)[0] <= chi2)


def grouped_mcd(df: DataFrame, key: str, dim: int, **options) -> DataFrame:
    """(key, mean, cov, valid) of the points p of each key, in the order of id; groups are neighborhoods or voxels of bounded size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m, c, ok = mcd(np.array(pdf["p"].tolist()), seed=int(pdf[key].iloc[0]) & 0x7FFFFFFF, **options)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [m.tolist()], "cov": [c.ravel().tolist()], "valid": [ok]})

    return df.select(key, "id", "p").groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, mean array<double>, cov array<double>, valid boolean")


FEW_KEYS = 2_000  # whose lines are broadcast
PART_ROWS = 500_000  # rows of a key that one task meets
GRID = 200  # marks of a sketch between which the rows to be ranked lie


def _robust_start(df: DataFrame, groups: list[str], trials: int, least: int, seed: int, sizes: DataFrame | None = None) -> DataFrame:
    """(groups, t, id, p): for each trial the `least` rows of a group with the least hashes of id and trial. Of groups with many rows (sizes: n), those of small hashes are enough."""
    each = df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("_h", F.xxhash64("id", F.col("t") + 1000 * seed))
    order = Window.partitionBy(*groups, "t").orderBy("_h", "id")
    first = lambda rows: rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= least).select(*groups, "t", "id", "p")
    if sizes is None:
        return first(each)
    below = F.least(F.lit(1.0), (100 + 20 * least) / F.col("n")) * 2.0**64 - 2.0**63
    found = cut(first(each.join(sizes, [*groups, *(["_part"] if "_part" in sizes.columns else [])]).where(F.col("_h") <= below)))
    counts = found.groupBy(*groups, "t").agg(F.count("*").alias("c"))
    short = sizes.select(*groups, "n").distinct().join(counts, groups, "left").groupBy(*groups, "n").agg(F.sum("c").alias("c"))
    if short.where(F.coalesce("c", F.lit(0)) < trials * F.least(F.lit(least), F.col("n"))).limit(1).count():  # ids that repeat share a hash
        return first(each)
    return found


def _fits(rows: DataFrame, groups: list[str], dim: int) -> DataFrame:
    """(groups, t, m, c, inv, det): mean, sample covariance, its pseudo-inverse and determinant of each trial."""
    sums = rows.groupBy(*groups, "t").agg(F.array(*(F.avg(F.col("p")[i]) for i in range(dim))).alias("m"), F.array(*(F.covar_samp(F.col("p")[min(i, j)], F.col("p")[max(i, j)]) for i in range(dim) for j in range(dim))).alias("c"))

    @F.pandas_udf("inv array<double>, det double")
    def inverse(c: pd.Series) -> pd.DataFrame:
        m = np.array([x if x is not None and None not in x else np.full(dim * dim, np.nan) for x in c], float).reshape(-1, dim, dim)
        ok = np.isfinite(m).all((1, 2))
        inv = np.linalg.pinv(np.where(ok[:, None, None], m, 0))
        return pd.DataFrame({"inv": inv.reshape(len(m), -1).tolist(), "det": np.where(ok, np.linalg.det(np.where(ok[:, None, None], m, np.eye(dim))), np.nan)})

    return sums.withColumn("_i", inverse("c")).select(*groups, "t", "m", "c", F.col("_i.inv").alias("inv"), F.col("_i.det").alias("det"))


def _far(dim: int) -> Column:
    """Squared Mahalanobis distance of p from m by inv."""
    gap = [F.col("p")[i] - F.col("m")[i] for i in range(dim)]
    return sum((gap[i] * gap[j] * F.col("inv")[i * dim + j] for i in range(dim) for j in range(dim)), F.lit(0.0))


def _nearest(far: DataFrame, sizes: DataFrame, groups: list[str], lines) -> DataFrame:
    """The rows (groups, _part, t, id, p, far) with the h least far of each group and trial, ties by id.

    A sketch gives two values that the h-th lies between; rows below both are counted and taken, and only those between are ranked.
    """
    of = [*groups, "t"]
    # shares are the same for every group but for h's rounding, so a sketch is asked for a grid of them
    grid = [i / GRID for i in range(GRID + 1)]
    marks = far.groupBy(*of).agg(F.percentile_approx("far", grid, 10 * GRID).alias("marks")).join(sizes, groups)
    at = F.col("h") / F.col("n") * GRID
    low = F.when(at > 2, F.get("marks", F.floor(at).cast("int") - 2)).otherwise(F.lit(float("-inf")))
    high = F.when(at < GRID - 2, F.get("marks", F.ceil(at).cast("int") + 2)).otherwise(F.lit(float("inf")))
    marks = cut(marks.select(*of, "h", low.alias("low"), high.alias("high")))
    bounds = lines(marks.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("t", F.struct("low", "high")))).alias("b")))
    seen = far.join(bounds, [*groups, "_part"]).withColumn("b", F.col("b")[F.col("t")])
    inside = seen.where("far < b.low").select(*of, "id", "p")
    rest = cut(seen.where("far >= b.low AND far <= b.high OR isnan(far)").select(*of, "far", "id", "p"))
    below = cut(marks.join(inside.groupBy(*of).agg(F.count("*").alias("below")), of, "left").select(*of, (F.col("h") - F.coalesce("below", F.lit(0))).alias("wanted")))
    # a line for each group and trial, met by ranked rows of partitions, not of groups
    more = ranked(rest, [*of, "far", "id"], "_rank", groups=of, lines=below).where("_rank < wanted").select(*of, "id", "p")
    return inside.union(more)


def fast_mcd(df: DataFrame, dim: int, key: str | None = None, trials: int = 6, steps: int = 3, share: float = 0.75, least: int = 2, chi2: float = -1.0, seed: int = 0) -> DataFrame:
    """(key, mean, cov, valid, dets): the minimum covariance determinant of all points (id, p), or of those of each key, however many a key has.

    As mcd, of which each trial starts from max(least, 2) rows, here those of the least hashes. A concentration step gives every row its distance
    and fits the h nearest: their mean and covariance are one aggregation. Rows near the h-th are ranked within key and trial by ranges, so no group lies in one task. dets: the best trial's
    determinants after each step, which never rise. Keys with a single row are left out. Only a line for each key and trial is ever joined to the rows.
    """
    groups = [key] if key else ["_all"]
    base = (df if key else df.withColumn("_all", F.lit(0))).select(*groups, "id", "p")
    sizes = base.groupBy(*groups).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    h = F.least(F.greatest(F.lit(least), F.round(F.lit(share) * F.col("n")).cast("long")), F.col("n"))
    sizes = cut(sizes.withColumn("h", F.when(F.col("n") <= least, F.col("n")).otherwise(h)))
    # rows of a key that has many are dealt to parts, each of which meets a copy of the key's line
    ways = sizes.select(*groups, F.ceil(F.col("n") / PART_ROWS).cast("int").alias("_ways")).where("_ways > 1")  # a line for each PART_ROWS rows at most
    base = base.join(F.broadcast(ways), groups, "left")
    base = cut(base.withColumn("_part", F.pmod(F.xxhash64("id"), F.coalesce("_ways", F.lit(1))).cast("int")).drop("_ways"))
    every = lambda df: df.join(ways, groups, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways")
    few = sizes.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    lines = (lambda df: F.broadcast(every(df))) if few else every  # with few keys the rows stay where they are
    fit = cut(_fits(_robust_start(base, groups, trials, max(least, 2), seed, lines(sizes.select(*groups, "n"))), groups, dim).withColumn("dets", F.array().cast("array<double>")))
    for _ in range(steps):
        fits = lines(fit.groupBy(*groups).agg(F.collect_list(F.struct("t", "m", "inv")).alias("f")))
        far = base.join(fits, [*groups, "_part"]).select(*groups, "_part", "id", "p", F.explode("f").alias("f")).select(*groups, "_part", "id", "p", "f.*").select(*groups, "_part", "t", "id", "p", _far(dim).alias("far"))
        near = _nearest(far, sizes.select(*groups, "h", "n"), groups, lines)
        fit = cut(_fits(near, groups, dim).join(fit.select(*groups, "t", "dets"), [*groups, "t"]).withColumn("dets", F.concat("dets", F.array("det"))))
    best = fit.where(F.col("det").isNotNull() & ~F.isnan("det")).groupBy(*groups).agg(F.min_by(F.struct("m", "c", "inv", "dets"), F.struct("det", "t")).alias("b"))
    found = lines(best.join(sizes, groups)).join(base.select(*groups, "_part", F.col("id").alias("first"), "p"), [*groups, "_part", "first"])
    found = found.select(*groups, F.col("b.m").alias("m"), F.col("b.c").alias("cov"), F.col("b.inv").alias("inv"), F.col("b.dets").alias("dets"), "p")
    valid = F.lit(True) if chi2 <= 0 else _far(dim) <= chi2
    return found.select(*([key] if key else []), F.col("m").alias("mean"), "cov", valid.alias("valid"), "dets")
