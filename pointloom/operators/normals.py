"""Surface normals and curvature from neighborhoods: covariance sums in Spark, eigenvectors in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.vectors import vdot
from pointloom.operators.cells import L2, covariance_of, nearest_lists
from pointloom.operators.neighbors import KNN, TREE_DIM, Radius, neighbors
from pointloom.operators.reach import radius_sums
from pointloom.operators.stats import grouped_mcd


def neighborhood_covariance(edges: DataFrame, cloud: DataFrame, dim: int) -> DataFrame:
    """(q, count, m0.., s00..): mean and sample covariance of the points around each query, summed about the query's own point."""
    own = cloud.select(F.col("id").alias("q"), F.col("p").alias("qp"))
    other = cloud.select(F.col("id").alias("r"), F.col("p").alias("rp"))
    j = edges.select("q", "r").join(own, "q").join(other, "r")
    j = j.select("q", "qp", F.zip_with("rp", "qp", lambda a, b: a - b).alias("p"))
    x = [F.col("p")[i] for i in range(dim)]
    sums = j.groupBy("q").agg(F.count("*").alias("count"), *(F.sum(x[i]).alias(f"t{i}") for i in range(dim)), *(F.sum(x[i] * x[k]).alias(f"u{i}{k}") for i in range(dim) for k in range(i, dim)))
    return _of_sums(sums.join(own, "q"), dim)


def _of_sums(sums: DataFrame, dim: int) -> DataFrame:
    n = F.col("count")
    cov = [((F.col(f"u{i}{k}") - F.col(f"t{i}") * F.col(f"t{k}") / n) / (n - 1)).alias(f"s{i}{k}") for i in range(dim) for k in range(i, dim)]
    return sums.select("q", "qp", "count", *((F.col(f"t{i}") / n + F.col("qp")[i]).alias(f"m{i}") for i in range(dim)), *cov)


def radius_covariance(cloud: DataFrame, radius: float, dim: int) -> DataFrame:
    """neighborhood_covariance of the points within the radius, without edges."""
    pairs = [(i, k) for i in range(dim) for k in range(i, dim)]
    m = lambda i: F.col("m")[i]
    return _of_sums(radius_sums(cloud, cloud, radius, dim).select("q", "qp", m(0).cast("long").alias("count"), *(m(1 + i).alias(f"t{i}") for i in range(dim)), *(m(1 + dim + c).alias(f"u{i}{k}") for c, (i, k) in enumerate(pairs))), dim)


def robust_covariance(edges: DataFrame, cloud: DataFrame, dim: int, **options) -> DataFrame:
    """(q, qp, c, count): the minimum covariance determinant of the points around each query, nearest first; count 0 where the query's own point is an outlier."""
    points = cloud.select(F.col("id").alias("r"), "p")
    found = grouped_mcd(edges.join(points, "r").select("q", F.col("value").alias("id"), "p"), "q", dim, **options)
    size = edges.groupBy("q").agg(F.count("*").alias("size"))
    own = cloud.select(F.col("id").alias("q"), F.col("p").alias("qp"))
    return found.join(size, "q").join(own, "q").select("q", "qp", F.col("cov").alias("c"), F.when(F.col("valid"), F.col("size")).otherwise(0).alias("count"))


def normals(cloud: DataFrame, spec, dim: int = 3, viewpoint=None, reference: str | None = None, covariance=None) -> DataFrame:
    """(id, n, curvature). NaN with fewer than dim neighbors. Turned to the viewpoint, or to a reference normal column of the cloud, which goes first.

    covariance: None for the sample covariance, options of robust_covariance, or any function (edges, cloud, dim) that gives its columns.
    """
    if covariance is None and isinstance(spec, KNN) and dim <= TREE_DIM:
        points = cloud.select("id", "p")
        cov = covariance_of(nearest_lists(points, points, spec.k, L2, dim), dim)
    elif covariance is None:
        if isinstance(spec, Radius):
            sums = radius_covariance(cloud, spec.radius**0.5 if spec.squared else spec.radius, dim)
        else:
            sums = neighborhood_covariance(neighbors(cloud, cloud, spec), cloud, dim)
        cov = sums.select("q", "qp", F.array(*(F.col(f"s{min(i, k)}{max(i, k)}") for i in range(dim) for k in range(dim))).alias("c"), "count")
    else:
        edges = neighbors(cloud, cloud, spec)
        cov = covariance(edges, cloud, dim) if callable(covariance) else robust_covariance(edges, cloud, dim, **covariance)

    @F.pandas_udf("n array<double>, curvature double")
    def smallest(c: pd.Series, count: pd.Series) -> pd.DataFrame:
        ok = (count >= dim).to_numpy() & np.array([bool(np.isfinite(np.asarray(x, float)).all()) for x in c], bool)
        m = np.array([x if good else np.eye(dim).ravel() for x, good in zip(c, ok, strict=True)], float).reshape(-1, dim, dim)
        values, vectors = np.linalg.eigh(m)
        v = vectors[:, :, 0]
        v = v * np.sign(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1))
        v[~ok] = np.nan
        total = values.sum(1)
        return pd.DataFrame({"n": list(v.tolist()), "curvature": np.where(ok, values[:, 0] / np.where(total > 0, total, 1), np.nan)})

    out = cov.select(F.col("q").alias("id"), "qp", "c", "count").withColumn("_e", smallest("c", "count")).select("id", "qp", F.transform("_e.n", lambda x: F.coalesce(x, F.lit(float("nan")))).alias("n"), F.coalesce("_e.curvature", F.lit(float("nan"))).alias("curvature"))  # NaN is null on the way from Python
    flip = lambda cond: F.when(cond, F.transform("n", lambda x: -x)).otherwise(F.col("n"))
    if reference is not None:
        out = out.join(cloud.select("id", F.col(reference).alias("_ref")), "id").withColumn("n", flip(vdot("n", "_ref") < 0)).drop("_ref")
    elif viewpoint is not None:
        to = F.array(*(F.lit(float(v)) - F.col("qp")[i] for i, v in enumerate(viewpoint)))
        out = out.withColumn("n", flip(vdot("n", to) < 0))
    return out.drop("qp")
