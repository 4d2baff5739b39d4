"""Weights and predicates of edges, as column expressions. Normals and colors are columns of arrays, or lists of the columns of their coordinates."""

from __future__ import annotations

from math import cos, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointloom.functions.vectors import col, l2sq, vdot


def distance(value="value") -> Column:
    return col(value)


def adjacency(value="value") -> Column:
    return F.lit(1.0)


def rbf(sigma: float, value="value", squared: bool = True) -> Column:
    v = col(value)
    return F.exp(-(v if squared else v * v) / (2 * sigma * sigma))


def angle(n1, n2) -> Column:
    d = vdot(n1, n2)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d)))


def points_near(limit: float, value="value") -> Column:
    return col(value) < limit


def _angle_ok(limit: float, n1, n2, strict: bool) -> Column:
    """A negative limit compares the angle regardless of the normals' sign."""
    a, near, most = angle(n1, n2), vdot(n1, n2), pi
    if limit < 0:
        a, near, most = F.least(a, F.pi() - a), F.abs(near), pi / 2
    ok = a < abs(limit) if strict else a <= abs(limit)
    if not 1e-3 < abs(limit) < most:
        return ok
    # the cosine decides; the angle is taken where rounding might. A NaN counts as an angle of zero, and is larger than any number here as well
    return (near > cos(limit) + 1e-9) | ((near > cos(limit) - 1e-9) & ok)


def normals_near(limit: float, n1="n1", n2="n2") -> Column:
    return _angle_ok(limit, n1, n2, strict=False)


def colors_near(limit: float, c1="c1", c2="c2") -> Column:
    return l2sq(c1, c2) < limit * limit


def points_normals_near(dist: float, limit: float, value="value", n1="n1", n2="n2") -> Column:
    return points_near(dist, value) & _angle_ok(limit, n1, n2, strict=True)


def points_colors_near(dist: float, color: float, value="value", c1="c1", c2="c2") -> Column:
    return points_near(dist, value) & colors_near(color, c1, c2)


def normals_colors_near(limit: float, color: float, n1="n1", n2="n2", c1="c1", c2="c2") -> Column:
    return _angle_ok(limit, n1, n2, strict=True) & colors_near(color, c1, c2)


def all_near(dist: float, limit: float, color: float, value="value", n1="n1", n2="n2", c1="c1", c2="c2") -> Column:
    return points_normals_near(dist, limit, value, n1, n2) & colors_near(color, c1, c2)
