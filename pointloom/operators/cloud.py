"""Point clouds: DataFrames (id, p array<double>, optionally n array<double> and c array<float>), with the operations on one cloud."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.vectors import affine, col, finite, matvec, rows_affine, unit
from pointloom.operators.ranks import first_rows

ATTRIBUTES = ("p", "n", "c")


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def remove_invalid(df: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """Rows whose named attributes, those present, are finite."""
    for a in attributes:
        if has(df, a):
            df = df.where(finite(a))
    return df


def select_ids(df: DataFrame, ids: DataFrame, negate: bool = False) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti" if negate else "left_semi")


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows, with the attributes that both clouds have and `part` telling their origin (ids may repeat between parts)."""
    shared = ["id", *(x for x in ATTRIBUTES if has(a, x) and has(b, x))]
    return a.select(*shared, F.lit(0).alias("part")).unionByName(b.select(*shared, F.lit(1).alias("part")))


def cast_points(df: DataFrame, kind: str) -> DataFrame:
    return df.withColumn("p", F.col("p").cast(f"array<{kind}>"))


def is_rotation(r) -> bool:
    return bool(np.allclose(np.linalg.inv(r).T, r))


def transform(df: DataFrame, r, t) -> DataFrame:
    """Points by R p + t; normals by R n for a rotation, else by the unit vector of R^-T n; colors stay."""
    out = df.withColumn("p", affine(r, t, "p"))
    if has(df, "n"):
        out = out.withColumn("n", matvec(r, "n") if is_rotation(r) else unit(matvec(np.linalg.inv(r).T, "n")))
    return out


def transform_set(df: DataFrame, transforms: DataFrame, dim: int, rigid: bool = True) -> DataFrame:
    """Each point by the transform (id, r row by row, t) with its id."""
    j = df.join(transforms, "id")
    out = j.withColumn("p", rows_affine("r", "t", "p", dim))
    if has(df, "n"):
        zero = F.array(*[F.lit(0.0)] * dim)
        out = out.withColumn("n", rows_affine("r", zero, "n", dim) if rigid else unit(rows_affine(inverse_transposed("r", dim), zero, "n", dim)))
    return out.drop("r", "t")


def inverse_transposed(r, dim: int):
    """R^-T by cofactors over the determinant; two and three dimensions."""
    r = col(r)
    e = lambda i, j: r[i * dim + j]
    if dim == 2:
        cof = [e(1, 1), -e(1, 0), -e(0, 1), e(0, 0)]
    else:
        cof = [e((i + 1) % 3, (j + 1) % 3) * e((i + 2) % 3, (j + 2) % 3) - e((i + 1) % 3, (j + 2) % 3) * e((i + 2) % 3, (j + 1) % 3) for i in range(3) for j in range(3)]
    det = sum((e(0, j) * cof[j] for j in range(dim)), F.lit(0.0))
    return F.array(*(c / det for c in cof))


def identity_transforms(ids: DataFrame, dim: int) -> DataFrame:
    return ids.select("id", F.array(*(F.lit(float(i == j)) for i in range(dim) for j in range(dim))).alias("r"), F.array(*[F.lit(0.0)] * dim).alias("t"))


def invert_transforms(transforms: DataFrame, dim: int) -> DataFrame:
    """p = R^-1 (q - t), by cofactors."""
    it = inverse_transposed("r", dim)
    inv = transforms.withColumn("_i", it).withColumn("_i", F.array(*(F.col("_i")[j * dim + i] for i in range(dim) for j in range(dim))))
    return inv.select("id", F.col("_i").alias("r"), F.array(*(-sum((F.col("_i")[i * dim + j] * F.col("t")[j] for j in range(dim)), F.lit(0.0)) for i in range(dim))).alias("t"))


def compose_transforms(transforms: DataFrame, r, t, before: bool = False, rigid: bool = False) -> DataFrame:
    """Each transform after the literal one (before=True: the literal one acts last); rigid: turned back to rotations, which products drift from."""
    dim = len(t)
    old = [[F.col("r")[i * dim + j] for j in range(dim)] for i in range(dim)]
    lit = [[F.lit(float(v)) for v in row] for row in np.asarray(r)]
    a, b = (lit, old) if before else (old, lit)
    ta, tb = ([F.lit(float(v)) for v in t], [F.col("t")[i] for i in range(dim)]) if before else ([F.col("t")[i] for i in range(dim)], [F.lit(float(v)) for v in t])
    rr = [sum((a[i][k] * b[k][j] for k in range(dim)), F.lit(0.0)) for i in range(dim) for j in range(dim)]
    tt = [sum((a[i][k] * tb[k] for k in range(dim)), ta[i]) for i in range(dim)]
    out = transforms.select("id", F.array(*rr).alias("r"), F.array(*tt).alias("t"))
    return rigid_transforms(out, dim) if rigid else out


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    """The rotation closest to m, or to each of a stack of matrices; a reflection is avoided in the least singular direction."""
    u, _, vt = np.linalg.svd(m)
    d = np.ones(m.shape[:-1])
    d[..., -1] = np.sign(np.linalg.det(u @ vt))
    return (u * d[..., None, :]) @ vt


def rigid_transforms(transforms: DataFrame, dim: int) -> DataFrame:
    """Transforms with their nearest rotations."""
    @F.pandas_udf("array<double>")
    def fix(r: pd.Series) -> pd.Series:
        return pd.Series(list(nearest_rotation(np.stack(r).reshape(-1, dim, dim)).reshape(-1, dim * dim))) if len(r) else r

    return transforms.withColumn("r", fix("r"))


def colormap(df: DataFrame, value: str, kind: str = "jet", low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds r, g, b of the value between two ends, low and high or else the least and the largest of all rows.

    kind: "jet", "gray" or "blue2red" (through white). Equal ends count as a range of one. Every color is zero where an end is not
    finite, so also where an end is missing and a value is NaN, infinite or null.
    """
    x = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    given = lambda v: v is not None and np.isfinite(v)
    ends = df.agg(*((F.lit(float(v)) if given(v) else f(x)).alias(n) for v, f, n in ((low, F.min, "_lo"), (high, F.max, "_hi"))))
    j = df.crossJoin(F.broadcast(ends))  # one row
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    ok = finite("_lo") & finite("_hi")
    v = (x - F.col("_lo")) / F.when(F.col("_hi") != F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    unit = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))
    if kind == "jet":
        # a tent of slope 4 for each color, one up to its turn and down after it: (turn, rise, fall)
        r, g, b = (unit(F.when(v < turn, 4 * v + rise).otherwise(fall - 4 * v)) for turn, rise, fall in ((0.7, -1.5, 4.5), (0.5, -0.5, 3.5), (0.3, 0.5, 2.5)))
    elif kind == "gray":
        r = g = b = unit(v)
    elif kind == "blue2red":
        r, g, b = unit(2 * v), unit(1 - F.abs(2 * v - 1)), unit(2 - 2 * v)
    else:
        raise ValueError(f"no colormap {kind!r}")
    return j.select(*(j[c] for c in df.columns), *(F.when(ok, c).otherwise(0.0).alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))))


def rank_fraction(df: DataFrame, order: list, fraction: float) -> DataFrame:
    """The first round(fraction * n) rows in the given order; all rows unless 0 < fraction < 1."""
    if not 0 < fraction < 1:
        return df
    return first_rows(df, order, int(np.floor(fraction * df.count() + 0.5)))


def best_per(df: DataFrame, key: str, order: list) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
