"""Queries over the tables for every operator family, each with SQL where SQL expresses it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions import evaluators as ev
from pointloom.functions.vectors import cross3, so2, unit, vadd, vdot, vsub
from pointloom.operators.session import cut
from pointloom.operators import cells, cloud, cluster, correspond, eigen, engines, graph, grid, hulls, neighbors, normals, ransac, reach, registration, rgbd, spatial, stats, warp

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r9(c, digits: int = 9):
    """Rounded, no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def spread(p: str, dim: int, name: str = "x"):
    return [r9(F.col(p)[i]).alias(f"{name}{i}") for i in range(dim)]


# ---- clouds ----


def lineitem3(spark, d):
    return table(spark, d, "lineitem").select(F.array("l_quantity", "l_extendedprice", "l_discount").alias("p"))


def orders3(spark, d):
    o = table(spark, d, "orders")
    day = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    sign = F.when(F.col("o_orderkey") % 3 == 0, -1.0).otherwise(1.0)
    return o.select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice") / 500000, day / 2404, F.col("o_custkey") / 15000).alias("p"), F.array(sign * 0.6, sign * 0.8, F.lit(0.0)).alias("n"), F.array(*((F.col("o_orderkey") % m / (m - 1.0)).cast("float") for m in (2, 3, 5))).alias("c"))


def part2(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 50, (F.col("p_retailprice") - 900) / 100).alias("p"))


def embeddings64(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("p"))


def pixels100(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    return e.select(F.floor(k / 100).cast("bigint").alias("y"), (k % 100).alias("x"), F.floor(F.col("value") * 10).cast("int").alias("depth"), (k % 256).cast("int").alias("r"), (k % 7).cast("int").alias("g"), (k % 11).cast("int").alias("b"))


K = [[52.5, 0.0, 49.5], [0.0, 52.5, 49.5], [0.0, 0.0, 1.0]]
ORDERS = """o AS (SELECT o_orderkey AS id, o_totalprice / 500000 AS x0, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 2404 AS x1, o_custkey / 15000 AS x2,
  CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE 1.0 END AS s, CAST(o_orderkey % 2 / 1.0 AS FLOAT) AS c0, CAST(o_orderkey % 3 / 2.0 AS FLOAT) AS c1, CAST(o_orderkey % 5 / 4.0 AS FLOAT) AS c2 FROM orders)"""
PART = "p AS (SELECT p_partkey AS id, p_size / 50 AS x0, (p_retailprice - 900) / 100 AS x1 FROM part)"
EMB = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings)"
PIX = "x AS (SELECT event_id // 100 AS y, event_id % 100 AS x, CAST(floor(value * 10) AS INT) AS depth, event_id % 256 AS r, event_id % 7 AS g, event_id % 11 AS b FROM events)"
D2 = "list_sum(list_transform(list_zip(a.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

# ---- voxels ----

BINS = [5.0, 5000.0, 0.02]
VOX = "SELECT CAST(floor(l_quantity * (1.0::DOUBLE / 5)) AS BIGINT) AS g0, CAST(floor(l_extendedprice * (1.0::DOUBLE / 5000)) AS BIGINT) AS g1, CAST(floor(l_discount * (1.0::DOUBLE / 0.02::DOUBLE)) AS BIGINT) AS g2"
OBINS = [0.1, 0.1, 0.1]
OVOX = "CAST(floor(x0 * (1 / 0.1::DOUBLE)) AS BIGINT) AS g0, CAST(floor(x1 * (1 / 0.1::DOUBLE)) AS BIGINT) AS g1, CAST(floor(x2 * (1 / 0.1::DOUBLE)) AS BIGINT) AS g2"


@query(f"WITH v AS ({VOX}, * FROM lineitem) SELECT g0, g1, g2, count(*) AS count, round(avg(l_quantity), 9) AS x0, round(avg(l_extendedprice), 7) AS x1, round(avg(l_discount), 9) AS x2 FROM v GROUP BY ALL")
def voxel_centroid(spark, d):
    v = grid.downsample(lineitem3(spark, d), BINS)
    x = F.col("p")
    return v.select("g0", "g1", "g2", "count", r9(x[0]).alias("x0"), r9(x[1], 7).alias("x1"), r9(x[2]).alias("x2"))


@query(f"WITH v AS ({VOX}, * FROM lineitem) SELECT g0, g1, g2, count(*) AS count FROM v GROUP BY ALL HAVING count(*) >= 20")
def voxel_min_points(spark, d):
    return grid.accumulate(lineitem3(spark, d), BINS, [], 20)


@query(f"WITH {ORDERS} SELECT {OVOX}, count(*) AS count, array_to_string(list_sort(list(id)), ',') AS ids FROM o GROUP BY g0, g1, g2")
def voxel_index_lists(spark, d):
    return grid.index_lists(orders3(spark, d), OBINS).withColumn("ids", F.array_join("ids", ","))


class MedianShade:
    """A user's accumulator: the median of the second color channel, by counts of its levels of a hundredth."""

    columns, schema = ["c"], "median double"

    def build(self, points):
        state = [0.0] * 101
        for c in points["c"]:
            state[round(c[1] * 100)] += 1
        return state

    def merge(self, a, b):
        return [x + y for x, y in zip(a, b, strict=True)]

    def finish(self, state):
        wanted, seen = (sum(state) + 1) // 2, 0
        for level, n in enumerate(state):
            seen += n
            if seen >= wanted:
                return (level / 100,)


@query(f"WITH {ORDERS} SELECT {OVOX}, count(*) AS count, round(quantile_disc(CAST(c1 AS DOUBLE), 0.5), 2) AS median FROM o GROUP BY g0, g1, g2")
def voxel_user_accumulator(spark, d):
    return grid.accumulate_with(orders3(spark, d).select("id", "p", "c"), OBINS, MedianShade()).withColumn("median", r9("median", 2))


@query(f"WITH {ORDERS} SELECT {OVOX}, count(*) AS count, round(avg(CAST(c0 AS DOUBLE)), 9) AS c0, round(avg(CAST(c1 AS DOUBLE)), 9) AS c1, round(avg(CAST(c2 AS DOUBLE)), 9) AS c2 FROM o GROUP BY g0, g1, g2")
def voxel_color_mean(spark, d):
    v = grid.downsample(orders3(spark, d).select("id", "p", "c"), OBINS)
    return v.select("g0", "g1", "g2", "count", *spread("c", 3, "c"))


# All normals lie on one line, so the aligned sum points where the first member's does.
@query(f"WITH {ORDERS} SELECT {OVOX}, count(*) AS count, round(0.6 * arg_min(s, id), 9) AS n0, round(0.8 * arg_min(s, id), 9) AS n1, 0.0 AS n2 FROM o GROUP BY g0, g1, g2")
def voxel_normal_mean(spark, d):
    v = grid.downsample(orders3(spark, d).select("id", "p", "n"), OBINS)
    return v.select("g0", "g1", "g2", "count", *spread("n", 3, "n"))


@query(f"WITH {ORDERS}, v AS (SELECT *, {OVOX} FROM o), b AS (SELECT g0, g1, g2, count(*) AS count FROM v GROUP BY ALL HAVING count(*) >= 15) SELECT id, g0, g1, g2, count, round(g0 * 0.1::DOUBLE, 9) AS k0 FROM v JOIN b USING (g0, g1, g2)")
def voxel_bin_lookup(spark, d):
    o = orders3(spark, d).select("id", "p")
    bins = grid.accumulate(o, OBINS, [], 15)
    return grid.corners(grid.lookup(o, bins, OBINS), OBINS).select("id", "g0", "g1", "g2", "count", r9(F.col("corner")[0]).alias("k0"))


# ---- filters, sets, transforms ----


@query("SELECT p_partkey AS id FROM part WHERE p_size % 7 <> 0 AND p_size % 11 <> 0")
def finite_filter(spark, d):
    size = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size")
    bad = F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).when(F.col("p_size") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("p_size").cast("double"))
    return cloud.remove_invalid(size.select("id", F.array(bad, F.lit(1.0)).alias("p"))).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def subset_semi(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return cloud.select_ids(part2(spark, d), ids).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def subset_anti(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return cloud.select_ids(part2(spark, d), ids, negate=True).select("id")


@query(f"WITH {PART} SELECT 0 AS part, id, round(x0, 9) AS x0 FROM p UNION ALL SELECT 1, c_custkey, round(c_acctbal / 10000, 9) FROM customer")
def append_union(spark, d):
    other = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25).alias("p"))
    return cloud.append(part2(spark, d), other).select("part", "id", r9(F.col("p")[0]).alias("x0"))


ROT = [[0.8, -0.6, 0.0], [0.6, 0.8, 0.0], [0.0, 0.0, 1.0]]
AFF = [[2.0, 0.5, 0.0], [0.0, 1.0, 0.25], [0.0, 0.0, 0.5]]
SHIFT = [0.1, -0.2, 0.3]


@query(f"WITH {ORDERS} SELECT id, round(0.8 * x0 - 0.6 * x1 + 0.1, 9) AS x0, round(0.6 * x0 + 0.8 * x1 - 0.2, 9) AS x1, round(x2 + 0.3, 9) AS x2, 0.0 AS n0, round(s, 9) AS n1, 0.0 AS n2 FROM o")
def transform_rigid(spark, d):
    o = cloud.transform(orders3(spark, d), ROT, SHIFT)
    return o.select("id", *spread("p", 3), *spread("n", 3, "n"))


@query(f"WITH {ORDERS} SELECT id, round(2 * x0 + 0.5 * x1 + 0.1, 9) AS x0, round(x1 + 0.25 * x2 - 0.2, 9) AS x1, round(0.5 * x2 + 0.3, 9) AS x2 FROM o")
def transform_affine(spark, d):
    return cloud.transform(orders3(spark, d).drop("n"), AFF, SHIFT).select("id", *spread("p", 3))


# R^-T n of n = s (0.6, 0.8, 0): (0.3, 0.65, -0.325) s, then scaled
@query(f"WITH {ORDERS} SELECT id, round(s * 0.3 / sqrt(0.618125), 9) AS n0, round(s * 0.65 / sqrt(0.618125), 9) AS n1, round(-s * 0.325 / sqrt(0.618125), 9) AS n2 FROM o")
def normal_affine(spark, d):
    return cloud.transform(orders3(spark, d), AFF, SHIFT).select("id", *spread("n", 3, "n"))


@query(f"WITH {PART} SELECT id, round(0.8 * x0 - 0.6 * x1 + id % 5, 9) AS x0, round(0.6 * x0 + 0.8 * x1 - id % 3, 9) AS x1 FROM p")
def transform_set(spark, d):
    p = part2(spark, d)
    t = p.select("id", F.array(*(F.lit(v) for v in (0.8, -0.6, 0.6, 0.8))).alias("r"), F.array((F.col("id") % 5).cast("double"), (-(F.col("id") % 3)).cast("double")).alias("t"))
    return cloud.transform_set(p, t, 2).select("id", *spread("p", 2))


@query(f"WITH {PART} SELECT id, round(x0, 9) AS x0, round(x1, 9) AS x1 FROM p")
def transform_set_inverse(spark, d):
    p = part2(spark, d)
    t = p.select("id", F.array(*(F.lit(v) for v in (0.8, -0.6, 0.6, 0.8))).alias("r"), F.array((F.col("id") % 5).cast("double"), F.lit(1.5)).alias("t"))
    return cloud.transform_set(cloud.transform_set(p, t, 2), cloud.invert_transforms(t, 2), 2).select("id", *spread("p", 2))


@query(f"WITH {ORDERS} SELECT id, round(x0, 9) AS f0, round(0.5 * (s * 0.6), 9) AS f3, round(0.5 * (s * 0.8), 9) AS f4, round(2 * CAST(c0 AS DOUBLE), 9) AS f6, round(2 * CAST(c2 AS DOUBLE), 9) AS f8 FROM o")
def feature_concat(spark, d):
    return correspond.features(orders3(spark, d), 0.5, 2.0).select("id", *(r9(F.col("p")[i]).alias(f"f{i}") for i in (0, 3, 4, 6, 8)))


def colormap_sql(r: str, g: str, b: str) -> str:
    cols = ", ".join(f"round(greatest(least({c}, 1.0), 0.0), 9) + 0.0 AS {n}" for c, n in ((r, "r"), (g, "g"), (b, "b")))
    return f"WITH e AS (SELECT event_id, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS v FROM events) SELECT event_id, {cols} FROM e"


def _colored(spark, d, kind):
    c = cloud.colormap(table(spark, d, "events").select("event_id", "value"), "value", kind)
    return c.select("event_id", *((r9(x) + 0.0).alias(x) for x in "rgb"))


@query(colormap_sql("CASE WHEN v < 0.7 THEN 4 * v - 1.5 ELSE -4 * v + 4.5 END", "CASE WHEN v < 0.5 THEN 4 * v - 0.5 ELSE -4 * v + 3.5 END", "CASE WHEN v < 0.3 THEN 4 * v + 0.5 ELSE -4 * v + 2.5 END"))
def colormap_jet(spark, d):
    return _colored(spark, d, "jet")


@query(colormap_sql("CASE WHEN v < 0.5 THEN 2 * v ELSE 1 END", "CASE WHEN v < 0.5 THEN 2 * v ELSE 2 * (1 - v) END", "CASE WHEN v < 0.5 THEN 1 ELSE 2 * (1 - v) END"))
def colormap_blue2red(spark, d):
    return _colored(spark, d, "blue2red")


@query(colormap_sql("v", "v", "v"))
def colormap_gray(spark, d):
    return _colored(spark, d, "gray")


@query(f"WITH {PIX} SELECT y, x, round(CASE WHEN depth / 1000 < 1.8 THEN depth / 1000 ELSE 0 END, 9) AS z FROM x")
def depth_convert(spark, d):
    return pixels100(spark, d).select("y", "x", r9(rgbd.metric_depth("depth", 1000.0, 1.8)).alias("z"))


# ---- neighbors ----


def nearest_sql(metric: str, k: int, where: str = "true") -> str:
    return f"WITH {EMB}, c AS (SELECT a.id AS q, b.id AS r, {metric} AS v FROM e a, e b WHERE {where}), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v, r) - 1 AS rank FROM c) SELECT q, r, rank, round(v, 9) AS value FROM t WHERE rank < {k}"


def _hits(edges):
    return edges.select("q", "r", F.col("rank").cast("bigint").alias("rank"), r9("value").alias("value"))


@query(nearest_sql(D2, 1, "a.id <> b.id AND a.id % 2 = 0 AND b.id % 2 = 1"))
def nn1_l2(spark, d):
    e = embeddings64(spark, d)
    return _hits(neighbors.knn(e.where("id % 2 = 0"), e.where("id % 2 = 1"), 1))


@query(nearest_sql(D2, 8))
def knn_l2(spark, d):
    e = embeddings64(spark, d)
    return _hits(neighbors.neighbors(e, e, neighbors.KNN(8)))


@query(nearest_sql("list_sum(list_transform(list_zip(a.p, b.p), lambda z: abs(z[1] - z[2])))", 5))
def knn_l1(spark, d):
    e = embeddings64(spark, d)
    return _hits(neighbors.neighbors(e, e, neighbors.KNN(5), "l1"))


@query(f"WITH {PART}, c AS (SELECT a.id AS q, b.id AS r, CASE WHEN b.x1 - a.x1 > pi() THEN b.x1 - a.x1 - 2 * pi() WHEN b.x1 - a.x1 < -pi() THEN b.x1 - a.x1 + 2 * pi() ELSE b.x1 - a.x1 END AS v FROM p a JOIN p b ON a.id <= 50), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(v, 9), r) - 1 AS rank FROM c) SELECT q, r, rank, round(v, 9) + 0.0 AS value FROM t WHERE rank < 4")
def knn_so2(spark, d):
    p = part2(spark, d)
    a, b = p.where("id <= 50").select(F.col("id").alias("q"), F.col("p").alias("a")), p.select(F.col("id").alias("r"), F.col("p").alias("b"))
    # few queries of the signed metric against all rows
    edges = b.crossJoin(F.broadcast(a)).select("q", "r", F.round(so2("a", "b"), 9).alias("value"))
    return _hits(neighbors.top_k(edges, 4))


@query(f"WITH {PART}, c AS (SELECT a.id AS q, b.id AS r, (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) AS v FROM p a JOIN p b ON a.id % 10 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v, r) - 1 AS rank FROM c) SELECT q, r, rank, round(v, 9) AS value FROM t WHERE rank < 6")
def knn_grid(spark, d):
    p = part2(spark, d)
    return _hits(neighbors.neighbors(p.where("id % 10 = 0"), p, neighbors.KNN(6)))


# the larger of the gap in size and twice the gap in price
LARGER = cells.Metric(lambda a, b: F.greatest(F.abs(F.col(a)[0] - F.col(b)[0]), 2 * F.abs(F.col(a)[1] - F.col(b)[1])), lambda gaps: np.maximum(gaps[0], 2 * gaps[1]))


@query(f"WITH {PART}, c AS (SELECT a.id AS q, b.id AS r, greatest(abs(a.x0 - b.x0), 2 * abs(a.x1 - b.x1)) AS v FROM p a, p b), t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v, r) - 1 AS rank FROM c) SELECT q, r, rank, round(v, 9) AS value FROM t WHERE rank < 5")
def knn_user_metric(spark, d):
    p = part2(spark, d)
    return _hits(neighbors.knn(p, p, 5, LARGER))


@query()
def knn_so2_all(spark, d):
    p = part2(spark, d)
    return _hits(neighbors.so2_knn(p, p, 4, 9))


@query()
def knn_grid_all(spark, d):
    p = part2(spark, d)
    return _hits(neighbors.neighbors(p, p, neighbors.KNN(6)))


EDGES = f"WITH RECURSIVE {PART}, c AS (SELECT a.id AS q, b.id AS r, (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) AS v FROM p a JOIN p b ON abs(a.x0 - b.x0) <= 0.03 AND abs(a.x1 - b.x1) <= 0.03)"


@query(f"{EDGES} SELECT q, r, round(v, 9) AS value FROM c WHERE v < 0.02::DOUBLE * 0.02::DOUBLE")
def radius_l2(spark, d):
    p = part2(spark, d)
    return neighbors.radius_join(p, p, 0.02, shown=r9).select("q", "r", "value")


@query(f"{EDGES}, t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY v, r) - 1 AS rank FROM c WHERE v < 0.02::DOUBLE * 0.02::DOUBLE) SELECT q, r, rank, round(v, 9) AS value FROM t WHERE rank < 3")
def knn_in_radius(spark, d):
    p = part2(spark, d)
    return _hits(neighbors.neighbors(p, p, neighbors.KNNInRadius(3, 0.02)))


# ---- graphs ----

KNN3 = nearest_sql(D2, 4).replace("round(v, 9) AS value", "v")


def _graph(spark, d):
    e = embeddings64(spark, d)
    return neighbors.neighbors(e, e, neighbors.KNN(4))


@query(f"WITH g AS ({KNN3}) SELECT r AS row, q AS col, round(exp(-v / 2), 9) AS value FROM g")
def nn_graph_rbf(spark, d):
    return graph.matrix(_graph(spark, d), ev.rbf(1.0)).select("row", "col", r9("value").alias("value"))


@query(f"WITH g AS ({KNN3}), b AS (SELECT r AS row, q AS col FROM g UNION SELECT q, r FROM g) SELECT row, col, 1.0::DOUBLE AS value FROM b")
def nn_graph_adjacency_sym_dense(spark, d):
    return graph.matrix(_graph(spark, d), ev.adjacency(), "dense")


@query(f"WITH g AS ({KNN3}), b AS (SELECT r AS row, q AS col FROM g UNION ALL SELECT q, r FROM g) SELECT row, col, count(*)::DOUBLE AS value FROM b GROUP BY ALL")
def nn_graph_adjacency_sym_sparse(spark, d):
    return graph.matrix(_graph(spark, d), ev.adjacency(), "sparse")


@query(f"{EDGES} SELECT q, count(*) AS degree FROM c WHERE v < 0.02::DOUBLE * 0.02::DOUBLE AND q <> r GROUP BY q")
def nn_degree(spark, d):
    p = part2(spark, d)
    return reach.radius_degrees(p, 0.02, 2, without_self=True)


@query(f"{EDGES}, n AS (SELECT q, count(*) AS degree FROM c WHERE v < 0.02::DOUBLE * 0.02::DOUBLE GROUP BY q) SELECT max(degree) AS most, CAST(sum(degree) AS BIGINT) AS total FROM n")
def nn_degree_max(spark, d):
    p = part2(spark, d)
    return reach.radius_degrees(p, 0.02, 2).agg(F.max("degree").alias("most"), F.sum("degree").alias("total"))


REACH = f"{EDGES}, e AS (SELECT q, r FROM c WHERE v < 0.02::DOUBLE * 0.02::DOUBLE), t(a, b) AS (SELECT id, id FROM p UNION SELECT t.a, e.r FROM t JOIN e ON e.q = t.b), l AS (SELECT a AS id, min(b) AS comp FROM t GROUP BY a)"


def _parts(spark, d):
    return reach.radius_components(part2(spark, d), 0.02, 2)


@query(f"{REACH} SELECT id, comp FROM l")
def components_radius(spark, d):
    return _parts(spark, d)


@query(f"{REACH}, s AS (SELECT comp, count(*) AS size FROM l GROUP BY comp HAVING count(*) BETWEEN 3 AND 50), k AS (SELECT comp, row_number() OVER (ORDER BY size DESC, comp) - 1 AS cluster FROM s) SELECT id, CAST(coalesce(cluster, -1) AS INT) AS cluster FROM l LEFT JOIN k USING (comp)")
def components_size_filter(spark, d):
    return graph.segments(_parts(spark, d), 3, 50).fillna(-1, ["cluster"])


@query(f"{REACH}, s AS (SELECT DISTINCT comp FROM l WHERE id % 10 = 0) SELECT id, comp FROM l JOIN s USING (comp)")
def components_seeded(spark, d):
    return graph.seeded(_parts(spark, d), part2(spark, d).where("id % 10 = 0"))


@query(f"{REACH}, s AS (SELECT comp, count(*) AS size, array_to_string(list_sort(list(id)), ',') AS ids FROM l GROUP BY comp HAVING count(*) >= 3) SELECT CAST(row_number() OVER (ORDER BY size DESC, comp) - 1 AS INT) AS cluster, ids FROM s")
def cluster_members(spark, d):
    return graph.cluster_members(graph.segments(_parts(spark, d), 3)).withColumn("ids", F.array_join("ids", ","))


# ---- pair predicates ----


NORMALS, COLORS = ([[f"{c}{k}{i}" for i in range(n)] for k in (1, 2)] for c, n in (("n", 2), ("c", 3)))


def _pairs(spark, d):
    p = part2(spark, d)
    attributes = [F.cos("id"), F.sin("id"), *(F.col("id") % m / m for m in (3, 5, 7))]
    names = [NORMALS[k] + COLORS[k] for k in (0, 1)]
    side = lambda k: p.select("id", "p", *(a.alias(n) for a, n in zip(attributes, names[k], strict=True)))
    return neighbors.radius_join(side(0), side(1), 0.03, keep=names)


ANGLE = "acos(greatest(-1, least(1, cos(q) * cos(r) + sin(q) * sin(r))))"
COLOR = "((q % 3 / 3 - r % 3 / 3) ** 2 + (q % 5 / 5 - r % 5 / 5) ** 2 + (q % 7 / 7 - r % 7 / 7) ** 2)"


@query(f"{EDGES} SELECT q, r FROM c WHERE v < 0.0004")
def pair_points(spark, d):
    return _pairs(spark, d).where(ev.points_near(0.0004)).select("q", "r")


@query(f"{EDGES} SELECT q, r FROM c WHERE v < 0.03::DOUBLE * 0.03::DOUBLE AND v < 0.0004 AND {ANGLE} < 0.5")
def pair_points_normals(spark, d):
    return _pairs(spark, d).where(ev.points_normals_near(0.0004, 0.5, "value", *NORMALS)).select("q", "r")


@query(f"{EDGES} SELECT q, r FROM c WHERE v < 0.03::DOUBLE * 0.03::DOUBLE AND least({ANGLE}, pi() - {ANGLE}) <= 0.4")
def pair_normals_unsigned(spark, d):
    return _pairs(spark, d).where(ev.normals_near(-0.4, *NORMALS)).select("q", "r")


@query(f"{EDGES} SELECT q, r FROM c WHERE v < 0.03::DOUBLE * 0.03::DOUBLE AND v < 0.0004 AND {COLOR} < 0.25")
def pair_points_colors(spark, d):
    return _pairs(spark, d).where(ev.points_colors_near(0.0004, 0.5, "value", *COLORS)).select("q", "r")


@query(f"{EDGES} SELECT q, r FROM c WHERE v < 0.03::DOUBLE * 0.03::DOUBLE AND v < 0.0004 AND {ANGLE} < 0.9 AND {COLOR} < 0.36")
def pair_all(spark, d):
    return _pairs(spark, d).where(ev.all_near(0.0004, 0.9, 0.6, "value", *NORMALS, *COLORS)).select("q", "r")


# ---- correspondences: even ids first, odd ids second ----

LIMIT = 1.3
CORR = f"""WITH {EMB}, c AS (SELECT a.id AS f, b.id AS s, {D2} AS v FROM e a JOIN e b ON a.id % 2 = 0 AND b.id % 2 = 1),
fs AS (SELECT f, arg_min(s, (v, s)) AS s, min(v) AS v FROM c GROUP BY f HAVING min(v) < {LIMIT}), sf AS (SELECT arg_min(f, (v, f)) AS f, s, min(v) AS v FROM c GROUP BY s HAVING min(v) < {LIMIT}),
u AS (SELECT * FROM fs UNION SELECT f, s, v FROM sf WHERE (f, s) NOT IN (SELECT (f, s) FROM fs))"""
OUT = "SELECT f AS first, s AS second, round(v, 9) AS value FROM"


def _corr(spark, d, **options):
    e = embeddings64(spark, d)
    out = correspond.correspondences(e.where("id % 2 = 0"), e.where("id % 2 = 1"), LIMIT, **options)
    return out.select("first", "second", r9("value").alias("value"))


@query(f"{CORR} {OUT} fs")
def corr_first_to_second(spark, d):
    return _corr(spark, d, direction="first_to_second")


@query(f"{CORR} {OUT} sf")
def corr_second_to_first(spark, d):
    return _corr(spark, d)


@query(f"{CORR} {OUT} u")
def corr_union(spark, d):
    return _corr(spark, d, direction="both")


@query(f"{CORR} {OUT} fs WHERE (f, s) IN (SELECT (f, s) FROM sf)")
def corr_reciprocal(spark, d):
    return _corr(spark, d, direction="both", reciprocal=True)


@query(f"{CORR}, n AS (SELECT *, row_number() OVER (ORDER BY v, f, s) AS k, count(*) OVER () AS n FROM sf) {OUT} n WHERE k <= floor(0.3 * n + 0.5)")
def corr_fraction(spark, d):
    return _corr(spark, d, fraction=0.3)


@query(f"{CORR}, n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY v, s) AS k FROM sf) {OUT} n WHERE k = 1")
def corr_one_to_one(spark, d):
    return _corr(spark, d, one_to_one=True)


@query(f"WITH {EMB} SELECT a.id AS first, b.id AS second, round({D2}, 9) AS value FROM e a JOIN e b ON b.id = a.id + 1 AND a.id % 2 = 0 WHERE {D2} < 2")
def corr_oracle(spark, d):
    e = embeddings64(spark, d)
    pairs = e.where("id % 2 = 0").select(F.col("id").alias("first"), (F.col("id") + 1).alias("second"))
    return correspond.rescored(pairs, e, e, 2.0).select("first", "second", r9("value").alias("value"))


@query(f"{CORR}, m AS (SELECT f, s, (a.p[1] - b.p[1]) * (a.p[1] - b.p[1]) AS v FROM sf JOIN e a ON a.id = f JOIN e b ON b.id = s) {OUT} m WHERE v < {LIMIT}")
def corr_eval_features(spark, d):
    e = embeddings64(spark, d)
    one = e.select("id", F.slice("p", 1, 1).alias("p"))
    return _corr(spark, d, evaluate=(one, one))


# ---- statistics ----


@query("SELECT " + ", ".join(f"round(covar_samp({a}, {b}), 4) AS s{i}{j}" for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount")) for j, b in enumerate(("l_quantity", "l_extendedprice", "l_discount")) if i <= j) + " FROM lineitem")
def cov_matrix(spark, d):
    out = lineitem3(spark, d).agg(*stats.covariance_columns(3))
    return out.select(*(r9(c, 4).alias(c) for c in out.columns))


@query("SELECT round(avg(l_quantity), 5) AS m0, round(avg(l_extendedprice), 5) AS m1, round(avg(l_discount), 5) AS m2 FROM lineitem")
def centroid(spark, d):
    out = stats.centroid(lineitem3(spark, d), 3)
    return out.select(*(r9(c, 5).alias(c) for c in out.columns))


@query(f"{EDGES}, j AS (SELECT q, x0, x1 FROM c JOIN p ON p.id = r WHERE v < 0.02::DOUBLE * 0.02::DOUBLE) SELECT q, count(*) AS count, round(avg(x0), 9) AS m0, round(avg(x1), 9) AS m1, round(covar_samp(x0, x0), 9) + 0.0 AS s00, round(covar_samp(x0, x1), 9) + 0.0 AS s01, round(covar_samp(x1, x1), 9) + 0.0 AS s11 FROM j GROUP BY q HAVING count(*) > 1")
def neighborhood_cov(spark, d):
    out = normals.radius_covariance(part2(spark, d), 0.02, 2).where("count > 1")
    return out.select("q", "count", *(r9(c).alias(c) for c in ("m0", "m1", "s00", "s01", "s11")))


@query(f"WITH {ORDERS} SELECT id, round(0.6 * (x0 - 0.5) + 0.8 * (x1 - 0.25), 9) AS y0, round(x2 - 0.1, 9) AS y1 FROM o")
def pca_project_fixed_axes(spark, d):
    model = stats.Pca(np.array([0.5, 0.25, 0.1]), np.ones(3), np.array([[0.6, 0.0, 0.8], [0.8, 0.0, -0.6], [0.0, 1.0, 0.0]]))
    return stats.project(orders3(spark, d), model, 2).select("id", *spread("p", 2, "y"))


@query(f"WITH {ORDERS} SELECT id, round(x0, 9) AS x0, round(x1, 9) AS x1, round(x2, 9) AS x2 FROM o")
def pca_reconstruct(spark, d):
    o = orders3(spark, d)
    model = stats.pca(o, 3)
    return stats.reconstruct(stats.project(o, model, 3), model, 3).select("id", *spread("p", 3))


@query()
def pca_eigen(spark, d):
    m = stats.pca(orders3(spark, d), 3)
    return spark.createDataFrame([(i, float(v), *map(float, m.vectors[:, i])) for i, v in enumerate(m.values)], "axis int, value double, v0 double, v1 double, v2 double")


@query()
def mcd(spark, d):
    o = grid.with_grid(orders3(spark, d).select("id", "p"), [0.25] * 3).withColumn("voxel", F.expr("g0 * 10000 + g1 * 100 + g2"))
    return stats.grouped_mcd(o, "voxel", 3, trials=2, steps=1).select("voxel", "mean", "valid")


@query(f"WITH {ORDERS} SELECT id % 3 AS k, true AS never_rises, true AS inside, CAST(round(0.75 * count(*)) AS BIGINT) AS h FROM o GROUP BY 1")
def mcd_keyed(spark, d):
    """With the defaults, 6 trials and 3 steps, over three large sets: the determinant never rises, and lies below that of all rows; h rows are nearer to the mean than any other."""
    o = orders3(spark, d).select((F.col("id") % 3).alias("k"), "id", "p").withColumn("k", F.col("k").cast("bigint"))
    found = stats.fast_mcd(o, 3, "k")
    plain = o.groupBy("k").agg(*stats.covariance_columns(3), F.count("*").alias("n"))
    s = lambda i, j: F.col(f"s{min(i, j)}{max(i, j)}")
    det = s(0, 0) * (s(1, 1) * s(2, 2) - s(1, 2) * s(1, 2)) - s(0, 1) * (s(0, 1) * s(2, 2) - s(1, 2) * s(0, 2)) + s(0, 2) * (s(0, 1) * s(1, 2) - s(1, 1) * s(0, 2))
    e = found.join(plain.select("k", det.alias("all"), "n"), "k")
    falls = F.forall(F.sequence(F.lit(1), F.size("dets") - 1), lambda i: F.get("dets", i) <= F.get("dets", i - 1) * (1 + 1e-9))
    return e.select("k", falls.alias("never_rises"), (F.element_at("dets", -1) < F.col("all")).alias("inside"), F.round(0.75 * F.col("n")).cast("long").alias("h"))


@query(f"WITH {ORDERS} SELECT true AS never_rises, true AS valid, 3 AS steps, count(*) > 0 AS any FROM o")
def mcd_whole(spark, d):
    found = stats.fast_mcd(orders3(spark, d).select("id", "p"), 3, chi2=1e9)
    falls = F.forall(F.sequence(F.lit(1), F.size("dets") - 1), lambda i: F.get("dets", i) <= F.get("dets", i - 1) * (1 + 1e-9))
    return found.select(falls.alias("never_rises"), "valid", F.size("dets").alias("steps"), F.lit(True).alias("any"))


@query()
def normals_knn(spark, d):
    o = orders3(spark, d)
    return normals.normals(o.select("id", "p"), neighbors.KNN(7), viewpoint=[0.0, 0.0, 0.0])


@query()
def curvature_radius(spark, d):
    return normals.normals(orders3(spark, d).select("id", "p"), neighbors.Radius(0.05)).select("id", "curvature")


# ---- clustering ----

START = "(SELECT p FROM e WHERE id = {})"
ASSIGN = lambda t, cs: "SELECT id, p, list_position(ds, list_min(ds)) - 1 AS cluster FROM (SELECT id, p, [" + ", ".join(f"list_sum(list_transform(list_zip(p, {c}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))" for c in cs) + f"] AS ds FROM {t})"
MEAN = "(SELECT list(m ORDER BY i) FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(p) AS v, unnest(range(64)) AS i FROM {} WHERE cluster = {}) GROUP BY i))"


def _start(spark, d):
    return np.array([r[0] for r in embeddings64(spark, d).where("id IN (0, 1, 2)").orderBy("id").select("p").collect()])


@query(f"WITH {EMB}, s AS MATERIALIZED ({ASSIGN('e', [START.format(i) for i in range(3)])}) SELECT id, CAST(cluster AS INT) AS cluster FROM s")
def kmeans_assign(spark, d):
    return cluster.assign(embeddings64(spark, d), _start(spark, d)).select("id", "cluster")


@query(f"WITH {EMB}, s1 AS MATERIALIZED ({ASSIGN('e', [START.format(i) for i in range(3)])}), s2 AS MATERIALIZED ({ASSIGN('e', [MEAN.format('s1', i) for i in range(3)])}), s3 AS MATERIALIZED ({ASSIGN('e', [MEAN.format('s2', i) for i in range(3)])}), s4 AS MATERIALIZED ({ASSIGN('e', [MEAN.format('s3', i) for i in range(3)])}) SELECT id, CAST(cluster AS INT) AS cluster FROM s4")
def kmeans_3_iters(spark, d):
    return cluster.kmeans(embeddings64(spark, d), _start(spark, d), max_iter=3)[1].select("id", "cluster")


@query(f"{EDGES} SELECT q AS id, round(avg(x0), 9) AS x0, round(avg(x1), 9) AS x1 FROM c JOIN p ON p.id = r WHERE v < 0.03::DOUBLE * 0.03::DOUBLE GROUP BY q")
def meanshift_1_step(spark, d):
    p = part2(spark, d)
    return cluster.shift_once(p, p, 0.03, dim=2).select("id", *spread("p", 2))


SHIFTED = f"""WITH RECURSIVE {PART},
s(step, id, x0, x1, rests) AS (
  SELECT 0, id, x0, x1, false FROM p
  UNION ALL
  SELECT step + 1, id, n0, n1, (n0 - x0) * (n0 - x0) + (n1 - x1) * (n1 - x1) < 1e-4::DOUBLE * 1e-4::DOUBLE FROM (
    SELECT s.step, s.id, s.x0, s.x1, avg(p.x0) AS n0, avg(p.x1) AS n1 FROM s JOIN p ON (s.x0 - p.x0) * (s.x0 - p.x0) + (s.x1 - p.x1) * (s.x1 - p.x1) < 0.2::DOUBLE * 0.2::DOUBLE
    WHERE NOT s.rests AND s.step < 20 GROUP BY s.step, s.id, s.x0, s.x1)
),
e AS MATERIALIZED (SELECT id, arg_max(x0, step) AS x0, arg_max(x1, step) AS x1, row_number() OVER (ORDER BY id) AS i FROM s GROUP BY id),
m(i, ms) AS (
  SELECT 0::BIGINT, CAST([] AS STRUCT(id BIGINT, x0 DOUBLE, x1 DOUBLE)[])
  UNION ALL
  SELECT e.i, CASE WHEN len(list_filter(ms, lambda z: (z.x0 - e.x0) * (z.x0 - e.x0) + (z.x1 - e.x1) * (z.x1 - e.x1) < 0.1::DOUBLE * 0.1::DOUBLE)) > 0 THEN ms ELSE list_append(ms, {{'id': CAST(e.id AS BIGINT), 'x0': e.x0, 'x1': e.x1}}) END
  FROM m JOIN e ON e.i = m.i + 1
),
f AS (SELECT unnest(arg_max(ms, i), recursive := true) FROM m),
l AS (SELECT e.id, e.x0, e.x1, min(f.id) AS first FROM e JOIN f ON (f.x0 - e.x0) * (f.x0 - e.x0) + (f.x1 - e.x1) * (f.x1 - e.x1) < 0.1::DOUBLE * 0.1::DOUBLE GROUP BY ALL)
SELECT id, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS cluster, round(avg(x0) OVER (PARTITION BY first), 6) AS m0, round(avg(x1) OVER (PARTITION BY first), 6) AS m1 FROM l"""


@query(SHIFTED)
def meanshift_modes(spark, d):
    p = part2(spark, d)
    found = cluster.mean_shift(p, p, 0.2, 0.1, max_iter=20, tol=1e-4, dim=2)
    return found.select("id", "cluster", *spread("mode", 2, "m")).withColumns({"m0": r9("m0", 6), "m1": r9("m1", 6)})


def _similar(spark, d):
    """The nodes, and their ten nearest as a weighted graph."""
    e = embeddings64(spark, d)
    return e.select("id"), graph.matrix(neighbors.neighbors(e, e, neighbors.KNN(10)), ev.rbf(1.0), "dense")


@query()
def spectral(spark, d):
    nodes, edges = _similar(spark, d)
    return cluster.spectral_clusters(edges, nodes, 3)


@query(f"WITH {EMB}, n AS (SELECT count(*) AS n FROM e) SELECT CAST(k AS INTEGER) AS k, true AS exact, true AS unit, true AS within, CASE WHEN k = 0 THEN 1.0 END AS largest FROM range(3) t(k), n WHERE n > 3")
def spectral_pairs(spark, d):
    """Of each of the three pairs: the residual is below 1e-6 by the entries alone, the vector has length one, the value lies in [-1, 1], and the first is 1, as that of a graph is."""
    nodes, edges = _similar(spark, d)
    matrix, _ = cluster.laplacian(edges)
    values, vectors = eigen.largest_pairs(matrix, nodes, 3)
    e = eigen.residuals(matrix, vectors, values)
    return e.select("k", (F.col("residual") < 1e-6).alias("exact"), (F.abs(F.col("length") - 1) < 1e-9).alias("unit"), (F.abs("value") < 1 + 1e-9).alias("within"), F.when(F.col("k") == 0, r9("value", 6)).alias("largest"))


SMALL = f"WITH {EMB}, s AS (SELECT * FROM e WHERE id < 60), d AS (SELECT a.id AS i, b.id AS j, {D2} AS d2 FROM s a, s b)"


@query(f"{SMALL} SELECT i, j, round(-0.5 * (d2 - avg(d2) OVER (PARTITION BY i) - avg(d2) OVER (PARTITION BY j) + avg(d2) OVER ()), 9) + 0.0 AS b FROM d")
def mds_double_center(spark, d):
    e = embeddings64(spark, d).where("id < 60")
    pairs = neighbors.block_knn(e, e, 60).select(F.col("q").alias("i"), F.col("r").alias("j"), F.col("value").alias("d2"))
    return cluster.double_center(pairs).select("i", "j", r9("b").alias("b"))


@query()
def mds(spark, d):
    _, x = cluster.scaling_of_points(embeddings64(spark, d), 64, 2)
    return x.select("id", F.col("x")[0].alias("x"), F.col("x")[1].alias("y"))


@query(f"WITH g AS ({KNN3}), b AS (SELECT r AS row, q AS col FROM g UNION SELECT q, r FROM g) SELECT col, count(*)::DOUBLE AS degree FROM b GROUP BY col")
def laplacian_degree(spark, d):
    return graph.matrix(_graph(spark, d), ev.adjacency(), "dense").groupBy("col").agg(F.sum("value").alias("degree"))


# ---- depth images ----

PZ = f"WITH {PIX}, z AS (SELECT *, CASE WHEN depth / 1000 < 4 THEN depth / 1000 ELSE 0 END AS z FROM x), p AS (SELECT *, (x - 49.5) * z / 52.5 AS p0, (y - 49.5) * z / 52.5 AS p1 FROM z)"


@query(f"{PZ} SELECT y, x, round(p0, 9) + 0.0 AS x0, round(p1, 9) + 0.0 AS x1, round(z, 9) AS x2 FROM p WHERE z > 0")
def depth_to_points(spark, d):
    return rgbd.depth_to_points(pixels100(spark, d), K, most=4.0).select("y", "x", *spread("p", 3))


@query(f"""{PZ}, n AS (SELECT c.y, c.x, [b.p0 - t.p0, b.p1 - t.p1, b.z - t.z] AS u, [r.p0 - l.p0, r.p1 - l.p1, r.z - l.z] AS v FROM p c JOIN p l ON l.y = c.y AND l.x = c.x - 1 JOIN p r ON r.y = c.y AND r.x = c.x + 1 JOIN p t ON t.x = c.x AND t.y = c.y - 1 JOIN p b ON b.x = c.x AND b.y = c.y + 1 WHERE least(c.z, l.z, r.z, t.z, b.z) > 0),
k AS (SELECT y, x, u[2] * v[3] - u[3] * v[2] AS a, u[3] * v[1] - u[1] * v[3] AS b, u[1] * v[2] - u[2] * v[1] AS c FROM n)
SELECT y, x, round(a / sqrt(a * a + b * b + c * c), 9) + 0.0 AS n0, round(b / sqrt(a * a + b * b + c * c), 9) + 0.0 AS n1, round(c / sqrt(a * a + b * b + c * c), 9) + 0.0 AS n2 FROM k""")
def depth_to_normals(spark, d):
    return rgbd.depth_to_normals(pixels100(spark, d), K, most=4.0).select("y", "x", *spread("n", 3, "n"))


@query(f"{PZ} SELECT y, x, round(p0, 9) + 0.0 AS x0, round(CAST(CAST(r / 255 AS FLOAT) AS DOUBLE), 9) AS c0, round(CAST(CAST(b / 255 AS FLOAT) AS DOUBLE), 9) AS c2 FROM p WHERE z > 0")
def rgbd_to_points_colors(spark, d):
    out = rgbd.depth_to_points(pixels100(spark, d), K, most=4.0, colors=True)
    return out.select("y", "x", r9(F.col("p")[0]).alias("x0"), r9(F.col("c")[0].cast("double")).alias("c0"), r9(F.col("c")[2].cast("double")).alias("c2"))


CAM = [[40.0, 0.0, 20.3], [0.0, 40.0, 15.7], [0.0, 0.0, 1.0]]
SEEN = f"WITH {ORDERS}, q AS (SELECT *, x1 + 0.5 AS z FROM o), s AS (SELECT *, CAST(round((40.0 * x0 + 20.3 * z) / z) AS BIGINT) AS px, CAST(round((40.0 * x2 + 15.7 * z) / z) AS BIGINT) AS py FROM q WHERE z > 0), w AS (SELECT * FROM s WHERE px BETWEEN 0 AND 63 AND py BETWEEN 0 AND 47)"


def _seen(spark, d):
    return orders3(spark, d).withColumn("p", F.array(F.col("p")[0], F.col("p")[2], F.col("p")[1] + 0.5))


@query(f"{SEEN} SELECT py AS y, px AS x, CAST(floor(min(z) * 1000) AS BIGINT) AS depth FROM w GROUP BY ALL")
def points_to_depth(spark, d):
    return rgbd.points_to_depth(_seen(spark, d), CAM, 64, 48)


@query(f"{SEEN}, m AS (SELECT py AS y, px AS x, arg_min((z, c0, c1, c2), (z, id)) AS m FROM w GROUP BY ALL) SELECT y, x, CAST(floor(m[1] * 1000) AS BIGINT) AS depth, CAST(floor(m[2] * 255) AS INT) AS r, CAST(floor(m[3] * 255) AS INT) AS g, CAST(floor(m[4] * 255) AS INT) AS b FROM m")
def points_to_rgbd(spark, d):
    return rgbd.points_to_rgbd(_seen(spark, d), CAM, 64, 48)


@query(f"{SEEN} SELECT py AS y, px AS x, arg_min(id, (z, id)) AS id FROM w GROUP BY ALL")
def index_map(spark, d):
    return rgbd.index_map(_seen(spark, d), CAM, 64, 48)


@query(f"{SEEN}, m AS (SELECT py, px, arg_min(id, (z, id)) AS id FROM w GROUP BY ALL) SELECT m.id AS first, w.id AS second, round((a.x0 - w.x0) ** 2 + (a.x2 - w.x2) ** 2 + (a.z - w.z) ** 2, 9) AS value FROM w JOIN m USING (py, px) JOIN q a ON a.id = m.id WHERE (a.x0 - w.x0) ** 2 + (a.x2 - w.x2) ** 2 + (a.z - w.z) ** 2 < 0.01")
def corr_projective(spark, d):
    o = _seen(spark, d)
    found = correspond.projective(rgbd.index_map(o, CAM, 64, 48), o, o, rgbd.project_points(o, CAM, 64, 48), 0.01)
    return found.select("first", "second", r9("value").alias("value"))


# ---- polytopes and regions ----

BOX_A = spatial.Polytope(np.array([[1, 0, 0, -0.5], [-1, 0, 0, 0.1], [0, 1, 0, -0.6], [0, -1, 0, 0.2]], float))
BOX_B = spatial.Polytope(np.array([[1, 0, 0, -0.7], [-1, 0, 0, 0.3], [0, 1, 0, -0.9], [0, -1, 0, 0.4]], float))
IN_A = "x0 - 0.5 <= 0 AND 0.1 - x0 <= 0 AND x1 - 0.6 <= 0 AND 0.2 - x1 <= 0"
IN_B = "x0 - 0.7 <= 0 AND 0.3 - x0 <= 0 AND x1 - 0.9 <= 0 AND 0.4 - x1 <= 0"


@query(f"WITH {ORDERS} SELECT id FROM o WHERE {IN_A}")
def halfspace_inside(spark, d):
    return orders3(spark, d).where(BOX_A.contains()).select("id")


@query(f"WITH {ORDERS} SELECT id FROM o WHERE ({IN_A}) OR ({IN_B})")
def region_union(spark, d):
    return orders3(spark, d).where(spatial.Region([BOX_A]).union(spatial.Region([BOX_B])).contains()).select("id")


@query(f"WITH {ORDERS} SELECT id FROM o WHERE ({IN_A}) AND ({IN_B})")
def region_intersection(spark, d):
    return orders3(spark, d).where(spatial.Region([BOX_A]).intersect(spatial.Region([BOX_B])).contains()).select("id")


@query(f"WITH {ORDERS} SELECT id FROM o WHERE NOT (({IN_A}) OR ({IN_B}))")
def region_complement(spark, d):
    return orders3(spark, d).where(spatial.Region([BOX_A, BOX_B]).complement().contains()).select("id")


@query(f"WITH {ORDERS} SELECT id FROM o WHERE ({IN_A}) AND NOT ({IN_B})")
def region_minus(spark, d):
    return orders3(spark, d).where(spatial.Region([BOX_A]).minus(spatial.Region([BOX_B])).contains()).select("id")


@query(f"WITH {ORDERS} SELECT id, facet_id, round(v, 9) + 0.0 AS value FROM (SELECT id, unnest([0, 1, 2, 3]) AS facet_id, unnest([x0 - 0.5, 0.1 - x0, x1 - 0.6, 0.2 - x1]) AS v FROM o)")
def signed_distances(spark, d):
    return BOX_A.signed_distances(orders3(spark, d)).select("id", "facet_id", r9("value").alias("value"))


@query()
def convex_hull(spark, d):
    facets = hulls.hull_facets(orders3(spark, d), 3)
    whole = hulls.hull_measures(facets, 3).select("area", "volume")
    return hulls.hull_vertices(facets).crossJoin(F.broadcast(whole)).select("id", "area", "volume")  # one row


# A closed surface around all points whose corners are rows: outermost values in fixed directions are those of all rows.
LOOKS = [u for u in product((-1, 0, 1), repeat=3) if any(u)]


@query(f"WITH {ORDERS} SELECT true AS closed, true AS fits, " + ", ".join(f"round(max({a} * x0 + {b} * x1 + {c} * x2), 9) + 0.0 AS far{i}" for i, (a, b, c) in enumerate(LOOKS)) + " FROM o")
def hull_support(spark, d):
    o = orders3(spark, d)
    facets = cut(hulls.hull_facets(o, 3))
    whole = hulls.hull_measures(facets, 3)
    box = o.agg(*(f(F.col("p")[i]).alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max)))).select((F.col("hi0") - F.col("lo0")).alias("a"), (F.col("hi1") - F.col("lo1")).alias("b"), (F.col("hi2") - F.col("lo2")).alias("c"))
    p = F.col("p")
    far = o.join(hulls.hull_vertices(facets), "id").agg(*(r9(F.max(a * p[0] + b * p[1] + c * p[2])).alias(f"far{i}") for i, (a, b, c) in enumerate(LOOKS)))
    sides = F.expr("2 * (a * b + b * c + a * c)")
    one = whole.crossJoin(box).crossJoin(far)  # one row each
    return one.select((F.col("gap") < 1e-9).alias("closed"), ((F.col("volume") > 0) & (F.col("volume") <= F.expr("a * b * c")) & (F.col("area") <= sides)).alias("fits"), *(f"far{i}" for i in range(len(LOOKS))))


# In the plane SQL can say it all: a size's least and greatest prices can be corners, and two of them are an edge if all others lie on one side.
@query(f"""WITH {PART}, e AS (SELECT x0, x1, min(id) AS id FROM p GROUP BY x0, x1), c AS (SELECT * FROM (SELECT *, min(x1) OVER (PARTITION BY x0) AS lo, max(x1) OVER (PARTITION BY x0) AS hi FROM e) WHERE x1 = lo OR x1 = hi),
s AS (SELECT a.id AS a, b.id AS b, a.x0 AS ax1, a.x1 AS ay1, b.x0 AS bx1, b.x1 AS by1, min((b.x0 - a.x0) * (k.x1 - a.x1) - (b.x1 - a.x1) * (k.x0 - a.x0)) AS least FROM c a, c b, c k WHERE a.id <> b.id GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY (bx1 - ax1) * (bx1 - ax1) + (by1 - ay1) * (by1 - ay1) DESC) AS n1, row_number() OVER (PARTITION BY b ORDER BY (bx1 - ax1) * (bx1 - ax1) + (by1 - ay1) * (by1 - ay1) DESC) AS n2 FROM s WHERE least >= -1e-9)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(sqrt((bx1 - ax1) * (bx1 - ax1) + (by1 - ay1) * (by1 - ay1)), 9) AS length FROM t WHERE n1 = 1 AND n2 = 1""")
def hull_edges(spark, d):
    v = F.col("vertices")
    return hulls.hull_facets(part2(spark, d), 2).select(v[0].alias("a"), v[1].alias("b"), r9("area").alias("length"))


# ---- robust fits and registration ----

PLANES = [((0.6, 0.8, 0.0), -0.5), ((1.0, 0.0, 0.0), -0.3), ((0.0, 0.6, 0.8), -0.4)]


@query(f"WITH {ORDERS} SELECT count(*) FILTER (abs(0.6 * x0 + 0.8 * x1 - 0.5) <= 0.05) AS m0, count(*) FILTER (abs(x0 - 0.3) <= 0.05) AS m1, count(*) FILTER (abs(0.6 * x1 + 0.8 * x2 - 0.4) <= 0.05) AS m2 FROM o")
def ransac_plane_score(spark, d):
    o = orders3(spark, d)
    return o.agg(*(F.sum((ransac.plane_residual(m) <= 0.05).cast("long")).alias(f"m{i}") for i, m in enumerate(PLANES)))


@query()
def ransac_plane(spark, d):
    fit = ransac.fit_plane(orders3(spark, d), 3, 0.05, 50)
    return spark.createDataFrame([(*map(float, fit.model[0]), float(fit.model[1]), fit.inliers)], "n0 double, n1 double, n2 double, d double, inliers long")


MOVED = f"WITH {ORDERS}, m AS (SELECT *, 0.8 * x0 - 0.6 * x1 + 0.1 AS y0, 0.6 * x0 + 0.8 * x1 - 0.2 AS y1, x2 + 0.3 AS y2 FROM o)"


def _moved(spark, d):
    o = orders3(spark, d)
    src = cloud.transform(o, ROT, SHIFT)
    return o.select("id", F.col("p").alias("p1"), F.col("n").alias("n1")).join(src.select("id", F.col("p").alias("p2"), F.col("n").alias("n2")), "id")


@query(f"{MOVED} SELECT count(*) AS n, " + ", ".join(f"round(covar_pop(x{i}, y{j}), 9) AS x{i}{j}" for i in range(3) for j in range(3)) + " FROM m")
def kabsch_sums(spark, d):
    s = registration.point_sums(_moved(spark, d), 3)
    return s.select("n", *(r9(f"x{i}{j}").alias(f"x{i}{j}") for i in range(3) for j in range(3)))


# plane rows [(d + s) x n, n] with right side n (d - s); n = s (0.6, 0.8, 0)
ROWS = "[-0.8 * s * (x2 + y2), 0.6 * s * (x2 + y2), 0.8 * s * (x0 + y0) - 0.6 * s * (x1 + y1), 0.6 * s, 0.8 * s, 0.0]"


@query(f"{MOVED}, r AS (SELECT {ROWS} AS a, 0.6 * s * (x0 - y0) + 0.8 * s * (x1 - y1) AS b FROM m) SELECT " + ", ".join(f"round(sum(a[{i + 1}] * a[{j + 1}]), 4) + 0.0 AS a{i}_{j}" for i in range(6) for j in range(i, 6)) + ", " + ", ".join(f"round(sum(a[{i + 1}] * b), 4) + 0.0 AS b{i}" for i in range(6)) + " FROM r")
def icp_normal_equations(spark, d):
    rows = registration.combined_rows_3d(F.col("p1"), F.col("p2"), F.col("n1"), 0.0, 1.0)
    out = _moved(spark, d).agg(*registration.normal_equations(rows))
    return out.select(*((F.round(c, 4) + 0.0).alias(c) for c in out.columns))


@query(f"WITH {ORDERS} SELECT 0.8::DOUBLE AS r00, 0.6::DOUBLE AS r01, 0.0::DOUBLE AS r02, count(*) FILTER (id % 2 = 0) AS inliers FROM o")
def ransac_transform(spark, d):
    """Half of the matches are wrong, each by another shift."""
    m = _moved(spark, d)
    wrong = F.array(*(F.col("p1")[i] + 2 + F.pmod(F.col("id") * k, F.lit(1009)) / 100 for i, k in enumerate((7919, 104729, 1299709))))
    pairs = m.select(F.col("id").alias("first"), F.col("id").alias("second"), F.when(F.col("id") % 2 == 0, F.col("p1")).otherwise(wrong).alias("p1"), "p2")
    fit = ransac.fit_transform(pairs, 3, True, 0.001, 100)
    return spark.createDataFrame([(*(round(float(v), 6) + 0.0 for v in fit.model[0][0]), fit.inliers)], "r00 double, r01 double, r02 double, inliers long")


@query(f"WITH {ORDERS} SELECT count(*) AS n, count(*) AS unit, count(*) AS flat FROM o")
def normals_invariants(spark, d):
    """All normals have length one, and curvatures lie between zero and a third."""
    n = normals.normals(orders3(spark, d).select("id", "p"), neighbors.KNN(8))
    size = F.sqrt(sum(F.col("n")[i] * F.col("n")[i] for i in range(3)))
    return n.agg(F.count("*").alias("n"), F.sum((F.abs(size - 1) < 1e-9).cast("long")).alias("unit"), F.sum(F.col("curvature").between(-1e-9, 1 / 3 + 1e-9).cast("long")).alias("flat"))


@query(f"WITH {ORDERS} SELECT count(DISTINCT (floor(x0 * 4.0), floor(x1 * 4.0), floor(x2 * 4.0))) AS nodes, 0::BIGINT AS moved FROM o")
def warp_of_equal_clouds(spark, d):
    """A sparse field between a cloud and itself has the identity at every node."""
    o = orders3(spark, d)
    nodes = engines.control_nodes(o, 0.25).cache()
    same = engines.GivenEngine(o.select(F.col("id").alias("first"), F.col("id").alias("second"), F.lit(0.0).alias("value")))
    field = engines.sparse_warp_icp(o.select("id", "p", "n"), o.select("id", "p"), engines.control_edges(o, nodes, 4), engines.stiffness_arcs(nodes, 6), same, w_point=1.0, max_iter=1, steps=1)
    x, _, _ = field.run()
    return x.agg(F.count("*").alias("nodes"), F.sum(F.exists("x", lambda v: F.abs(v) > 1e-6).cast("long")).alias("moved"))


@query(f"WITH {ORDERS} SELECT count(*) AS n, count(DISTINCT (floor(x0 * 4.0), floor(x1 * 4.0), floor(x2 * 4.0))) AS nodes, true AS follows FROM o")
def warp_of_bent_cloud(spark, d):
    """A sparse field follows all orders bent along a parabola: what is left of their squared moves is below a fiftieth."""
    o = orders3(spark, d)
    bent = o.withColumn("p", F.array(F.col("p")[0], F.col("p")[1], F.col("p")[2] + 0.05 * F.col("p")[0] * F.col("p")[0]))
    nodes = cut(engines.control_nodes(o, 0.25))
    same = engines.GivenEngine(o.select(F.col("id").alias("first"), F.col("id").alias("second"), F.lit(0.0).alias("value")))
    field = engines.sparse_warp_icp(bent.select("id", "p", "n"), o.select("id", "p"), engines.control_edges(o, nodes, 4), engines.stiffness_arcs(nodes, 6), same, w_point=1.0, w_plane=0.0, stiffness=1e-4, max_iter=1, steps=2)
    x, _, _ = field.run()
    gap = lambda a, b: sum((F.col(a)[i] - F.col(b)[i]) * (F.col(a)[i] - F.col(b)[i]) for i in range(3))
    ends = field.moved(x).withColumnRenamed("p", "now").join(bent.select("id", F.col("p").alias("goal")), "id").join(o.select("id", "p"), "id")
    return ends.agg(F.count("*").alias("n"), F.sum(gap("now", "goal")).alias("left"), F.sum(gap("p", "goal")).alias("whole")).select("n", F.lit(x.count()).alias("nodes"), (F.col("left") < F.col("whole") / 50).alias("follows"))


@query("SELECT 0.8::DOUBLE AS r00, 0.6::DOUBLE AS r01, 0.0::DOUBLE AS r02")
def rigid_point_to_point(spark, d):
    r, _ = registration.estimate_point_to_point(_moved(spark, d), 3)
    return spark.createDataFrame([tuple(round(float(v), 9) + 0.0 for v in r[0])], "r00 double, r01 double, r02 double")


@query()
def icp_point(spark, d):
    o = orders3(spark, d).select("id", "p")
    src = cloud.transform(o, [[0.9998, -0.02, 0.0], [0.02, 0.9998, 0.0], [0.0, 0.0, 1.0]], [0.002, -0.003, 0.001])
    reg = registration.Registration(o, src, max_distance=0.01, max_iter=5)
    r, t, rounds, _ = reg.run()
    return spark.createDataFrame([(*map(float, r.ravel()), *map(float, t))], ", ".join(f"r{i} double" for i in range(9)) + ", t0 double, t1 double, t2 double")


@query(f"WITH {EMB}, c AS (SELECT a.id AS q, b.id AS r, {D2} AS v FROM e a JOIN e b ON b.id % 10 = 0), k AS (SELECT q, r, exp(-v / 2) AS w, row_number() OVER (PARTITION BY q ORDER BY v, r) AS n FROM c) SELECT q AS id, round(sum(w * (r % 5)) / sum(w), 9) + 0.0 AS t0 FROM k WHERE n <= 3 GROUP BY q")
def resample_transforms(spark, d):
    e = embeddings64(spark, d)
    nodes = e.where("id % 10 = 0")
    edges = neighbors.knn(e, nodes, 3).select("q", "r", ev.rbf(1.0, F.round("value", 9)).alias("weight"))
    t = nodes.select("id", F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 1.0))).alias("r"), F.array((F.col("id") % 5).cast("double"), F.lit(0.0)).alias("t"))
    return warp.resample_transforms(edges, t, 2, rigid=False).select("id", r9(F.col("t")[0]).alias("t0"))


@dataclass
class ShiftOnly:
    """A user's closest-point instance: the state is a translation, estimated from nearest neighbors below a squared limit."""

    dst: DataFrame
    src: DataFrame
    limit: float
    index: object = field(init=False)

    def initialise(self, start=None):
        self.index = correspond.index_of(self.dst)
        return np.zeros(3) if start is None else start

    def correspondences(self, state):
        return correspond.matched_points(self.index, cloud.transform(self.src, np.eye(3), state), self.limit)

    def estimate(self, pairs, state):
        m = pairs.agg(*(F.avg(F.col("p1")[i] - F.col("p2")[i]) for i in range(3))).first()
        return None if m[0] is None else state + np.array(m)

    def change(self, before, after):
        return float(np.linalg.norm(after - before))


@query(f"WITH {ORDERS} SELECT count(*) AS n, 0.00002::DOUBLE AS t0, -0.00003::DOUBLE AS t1, 0.00001::DOUBLE AS t2 FROM o")
def icp_user_instance(spark, d):
    """Undoes a small shift of all orders."""
    o = orders3(spark, d).select("id", "p")
    icp = ShiftOnly(o, cloud.transform(o, np.eye(3), [-0.00002, 0.00003, -0.00001]), 1e-4)
    t, _, _ = registration.closest_point_loop(icp, 6, 1e-9)
    return icp.correspondences(t).agg(F.count("*").alias("n"), *(F.lit(round(float(v), 6) + 0.0).alias(f"t{i}") for i, v in enumerate(t)))


@query(f"WITH {PIX}, z AS (SELECT *, 1000.0 / (depth + 1) AS z FROM x WHERE depth > 0) SELECT y, x, round((x - 49.5) * z / 52.5, 9) + 0.0 AS x0, round((y - 49.5) * z / 52.5, 9) + 0.0 AS x1, round(z, 9) AS x2 FROM z")
def depth_user_converter(spark, d):
    """Disparity instead of depth: the distance falls with the raw value."""
    return rgbd.depth_to_points(pixels100(spark, d), K, converter=Disparity()).select("y", "x", *spread("p", 3))


class Disparity:
    def metric(self, depth):
        return F.when(depth > 0, 1000.0 / (depth + 1)).otherwise(0.0)

    def raw(self, z):
        return F.floor(1000.0 / z).cast("bigint") - 1
