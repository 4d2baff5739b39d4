"""Column expressions over coordinate arrays (array<double>).

vdot and l2sq also take vectors as lists of their coordinates' columns: such sums are compiled, while lambdas over arrays are interpreted, which tells on large joins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _plain(a, b, term) -> Column | None:
    """The sum of term over coordinates, in the order and from the zero that total has, if both vectors are lists of columns."""
    if not (isinstance(a, (list, tuple)) and isinstance(b, (list, tuple))):
        return None
    return sum((term(col(x), col(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def vdot(a, b) -> Column:
    plain = _plain(a, b, lambda x, y: x * y)
    if plain is not None:
        return plain
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def vsub(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def vadd(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def vscale(a, k) -> Column:
    return F.transform(col(a), lambda x: x * (F.lit(k) if not isinstance(k, Column) else k))


def vnorm(a) -> Column:
    return F.sqrt(vdot(a, a))


def l1(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


def l2sq(a, b) -> Column:
    """Squared Euclidean distance."""
    plain = _plain(a, b, lambda x, y: (x - y) * (x - y))
    if plain is not None:
        return plain
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def so2(a, b) -> Column:
    """Signed difference of the last coordinate, wrapped to [-pi, pi]."""
    d = F.element_at(col(b), -1) - F.element_at(col(a), -1)
    return F.when(d > F.pi(), d - 2 * F.pi()).when(d < -F.pi(), d + 2 * F.pi()).otherwise(d)


def cross3(a, b) -> Column:
    a, b = col(a), col(b)
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def unit(a) -> Column:
    """a by its length; a itself where that is zero."""
    n = vnorm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x / n)).otherwise(col(a))


def finite(a) -> Column:
    return F.forall(col(a), lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def matvec(m, a) -> Column:
    """Literal matrix times a vector column."""
    a = col(a)
    return F.array(*(sum((F.lit(float(v)) * a[j] for j, v in enumerate(row)), F.lit(0.0)) for row in m))


def affine(r, t, a) -> Column:
    """R a + t of a literal transform."""
    moved = matvec(r, a)
    return F.array(*(moved[i] + F.lit(float(v)) for i, v in enumerate(t)))


def rows_affine(r, t, a, dim: int) -> Column:
    """R a + t of transform columns: r row by row."""
    r, t, a = col(r), col(t), col(a)
    return F.array(*(sum((r[i * dim + j] * a[j] for j in range(dim)), t[i]) for i in range(dim)))


METRICS = {"l1": l1, "l2": l2sq, "l2simple": l2sq, "so3": l2sq, "so2": so2}
