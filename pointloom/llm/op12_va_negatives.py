"""Hard negatives by a vector-approximation file, exactly.

Rows are (vec_id, label, x), x integers; a row's score for an anchor is their inner product. An anchor's positives are the
best rows of its label, by score, then id. A positive of score s opens the window low * s <= 100 * score <= 100 * s, and the best
rows of other labels within it are its negatives.

1. Approximation: each dimension is cut into at most CELLS cells of about equal counts, whose edges come from SAMPLE rows (the least
   hashes of id) and from the exact least and greatest value over all rows. The file keeps one byte a dimension for every row.
2. Bounds: two tables give the least and the greatest value of each cell. Looked up for a block of rows, and multiplied with the
   positive and the negative parts of a block of anchors, they bound all scores of the block from both sides.
3. A task keeps, for each anchor and window, the greatest lower bounds of rows that lie in the window for certain. A row is a candidate only if its
   upper bound reaches the last of them and its bounds meet the window. Candidates of all tasks are pruned in the same way once more.
4. Only candidates meet the exact vectors (joined by id) and are scored; what is returned is ranked by exact scores.
The first search has one open window over rows of the anchor's own label, the second one the windows of the positives over the others.

Of rows with equal label and vector all but those with the least `most + 1` ids are left out as candidates: these precede the others in each list (one
of them may be the anchor itself). Every row can be an anchor. So a vector that a third of all rows share costs no more than another.
Anchors are dealt to blocks of about ANCHORS; they are broadcast while they come to ANCHOR_BYTES at most, beyond that row
blocks (a byte a dimension) are exchanged by anchor block. Neither vectors nor candidates come to the driver, but for the sample.

Rows with a null id, a null label, a null vector, or a component that is null or not finite take no part. Repeated rows count once; of
rows that share an id the least by label, then vector, takes part. Vectors of unequal lengths: missing components are zero, an empty
vector scores 0. Ties go to the smaller id. A positive of negative score has an empty window, one of zero a window of zeros alone. Anchors
without positives, and positives without negatives, give no row. Empty tables give an empty result. Texts play no part; very long
vectors (thousands of components) shrink the blocks. Other columns are ignored, whatever their names. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import materialize, release, sent

CELLS = 256  # a byte a dimension
SAMPLE = 4096  # rows that cell edges come from
ROWS, ANCHORS = 32_768, 32_768  # of a packed block
TILE = 1 << 22  # scores bounded at once
ANCHOR_BYTES = 32 << 20  # of packed anchors that are broadcast
OPEN = 1 << 62  # end of a window that has none


def quantised(rows: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """vec_id, label, x of the rows that take part: floor(scale * component), each id once."""
    v = F.col(vector)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ok = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & whole)
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return ok.select("vec_id", "label", x.alias("x")).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("_r")).select("vec_id", F.col("_r.label").cast("long").alias("label"), F.col("_r.x").alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of dim numbers, zeros behind the end of a shorter one."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def ranges(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest value of each dimension over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(dim, OPEN), np.full(dim, -OPEN)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"), dim)
                lo, hi = np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(lo), pa.array(hi)], names=["d", "lo", "hi"])

    found = rows.select("x").mapInArrow(run, "d long, lo long, hi long").groupBy("d").agg(F.min("lo"), F.max("hi")).orderBy("d").collect()  # a row a dimension
    return np.array([r[1] for r in found], np.int64), np.array([r[2] for r in found], np.int64)


def cell_edges(rows: DataFrame, dim: int, cells: int) -> list[np.ndarray]:
    """For each dimension ascending edges e: cell c holds e[c] <= value < e[c + 1]. The outer ones hold every row."""
    lo, hi = ranges(rows, dim)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow().column(0).combine_chunks()
    values = np.sort(_matrix(drawn, dim), axis=0)
    at = np.linspace(0, len(values) - 1, cells + 1).astype(int)[1:-1]
    return [np.unique(np.concatenate([[lo[d]], values[at, d], [hi[d] + 1]])) for d in range(dim)]


def approximate(dim: int, edges: list[np.ndarray]):
    """Blocks of about ROWS rows: ids, labels and cells, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed():
            ids, labels, cells = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (ids, labels, cells)], names=["ids", "labels", "cells"])

        for b in batches:
            x = _matrix(b.column("x"), dim)
            cells = np.stack([np.searchsorted(e, x[:, d], "right") - 1 for d, e in enumerate(edges)], 1).astype(np.uint8) if dim else np.zeros((len(x), 0), np.uint8)
            held.append((b.column("vec_id").to_numpy(), b.column("label").to_numpy(), cells))
            if sum(len(h[0]) for h in held) >= ROWS:
                yield packed()
                held = []
        if held:
            yield packed()

    return run


def pack_anchors(dim: int, windows: int):
    """A block's anchors: ids, labels, vectors and the ends of their windows (OPEN above -OPEN where there is none), packed."""

    def run(group: pa.Table) -> pa.Table:
        ends = [_matrix(group.column(c).combine_chunks(), windows) for c in ("lows", "highs")]
        absent = np.arange(windows) >= np.array([len(v) for v in group.column("lows").to_pylist()])[:, None]
        ends[0][absent], ends[1][absent] = OPEN, -OPEN
        arrays = [group.column("anchor").to_numpy(), group.column("label").to_numpy(), _matrix(group.column("x").combine_chunks(), dim), *ends]
        return pa.table([pa.array([group.column("block")[0].as_py()]), *(pa.array([a.astype(np.int64).tobytes()], pa.binary()) for a in arrays)], names=["block", "a_ids", "a_labels", "a_x", "lows", "highs"])

    return run


def keep_best(best: np.ndarray, group: np.ndarray, value: np.ndarray) -> None:
    """best[g] holds the greatest values of group g, descending; new values are merged into it."""
    k = best.shape[1]
    rows = np.unique(group)
    group = np.concatenate([group, np.repeat(rows, k)])
    value = np.concatenate([value, best[rows].ravel()])
    order = np.lexsort((-value, group))
    group, value = group[order], value[order]
    first = np.searchsorted(group, rows)
    best[rows] = value[first[:, None] + np.arange(k)]


def search(dim: int, edges: list[np.ndarray], windows: int, most: int, same: bool):
    """Candidates (anchor, w, vec_id, lower, upper) of pairs of a row block and an anchor block; same: of rows of the anchor's label but itself, else of other labels."""
    low_of = np.zeros((dim, CELLS), np.int64)
    high_of = np.zeros((dim, CELLS), np.int64)
    for d, e in enumerate(edges):
        low_of[d, : len(e) - 1], high_of[d, : len(e) - 1] = e[:-1], e[1:] - 1
    largest = max([1, *(int(np.abs(e).max()) for e in edges)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}  # of an anchor block: the greatest certain lower bounds of each anchor and window
        for batch in batches:
            for r in batch.to_pylist():
                ids, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels"))
                cells = np.frombuffer(r["cells"], np.uint8).reshape(len(ids), dim)
                a_ids, a_labels = (np.frombuffer(r[c], np.int64) for c in ("a_ids", "a_labels"))
                a_x, lows, highs = (np.frombuffer(r[c], np.int64).reshape(len(a_ids), k) for c, k in (("a_x", dim), ("lows", windows), ("highs", windows)))
                # doubles hold the bounds exactly while they are small enough; else integers
                kind = np.float64 if largest * max(1, int(np.abs(a_x).max(initial=0))) * max(1, dim) < 1 << 52 else np.int64
                state = best.setdefault(r["block"], np.full((len(a_ids) * windows, most), -OPEN, kind))
                for anchors, rows in tiles(a_labels, labels, same):
                    found = bounded_pairs(a_x[anchors].astype(kind), cells[rows], lows[anchors], highs[anchors], a_labels[anchors], labels[rows], a_ids[anchors], ids[rows], anchors, state, kind)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], names=["anchor", "w", "vec_id", "lower", "upper", "sure"])

    def tiles(a_labels: np.ndarray, labels: np.ndarray, same: bool):
        """Index arrays of anchors and rows to bound together."""
        pairs = [(np.flatnonzero(a_labels == g), np.flatnonzero(labels == g)) for g in np.intersect1d(a_labels, labels)] if same else [(np.arange(len(a_labels)), np.arange(len(labels)))]
        for a, b in pairs:
            wide = max(1, min(len(b), 4096, TILE // max(64, dim)))
            tall = max(1, TILE // wide // 4)
            for i in range(0, len(a), tall):
                for j in range(0, len(b), wide):
                    yield a[i : i + tall], b[j : j + wide]

    def bounded_pairs(x, cells, lows, highs, a_labels, labels, a_ids, ids, anchors, state, kind):
        at = np.arange(dim)
        low, high = (t[at, cells].astype(kind) for t in (low_of, high_of))  # table lookup
        plus, minus = np.maximum(x, 0), np.minimum(x, 0)
        lower, upper = plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T
        slot = anchors[:, None] * windows + np.arange(windows)
        floor = np.maximum(lows, state[slot, -1])  # what an upper bound must reach, for each window
        maybe = (upper >= floor.min(1)[:, None]) & (lower <= highs.max(1)[:, None])
        i, j = np.nonzero(maybe)
        ok = (a_ids[i] != ids[j]) if same else (a_labels[i] != labels[j])
        i, j = i[ok], j[ok]
        lower, upper = lower[i, j], upper[i, j]
        out = []
        for w in range(windows):
            fits = (upper >= floor[i, w]) & (lower <= highs[i, w])
            sure = fits & (lower >= lows[i, w]) & (upper <= highs[i, w])
            if sure.any():
                keep_best(state, slot[i[sure], w], lower[sure])
                fits &= upper >= state[slot[i, w], -1]
            k = np.flatnonzero(fits)
            out.append((a_ids[i[k]], np.full(len(k), w), ids[j[k]], lower[k], upper[k], sure[k]))
        return [np.concatenate(c) for c in zip(*out, strict=True)]

    return run


FOUND = "anchor long, w long, vec_id long, lower long, upper long, sure long"


def candidates(blocks: DataFrame, anchors: DataFrame, dim: int, edges: list[np.ndarray], windows: int, most: int, same: bool) -> DataFrame:
    """(anchor, w, vec_id) that may be among the best `most` of a window; anchors are (anchor, label, x, lows, highs)."""
    count = anchors.count()
    n = max(1, -(-count // ANCHORS))
    packed = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n))).groupBy("block").applyInArrow(pack_anchors(dim, windows), "block long, a_ids binary, a_labels binary, a_x binary, lows binary, highs binary")
    packed = materialize(packed)
    small = count * 8 * (dim + 2 + 2 * windows) <= ANCHOR_BYTES
    met = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(F.broadcast(packed) if small else packed, "block")
    found = met.mapInArrow(search(dim, edges, windows, most, same), FOUND)
    mine = Window.partitionBy("anchor", "w")
    ranked = found.withColumn("k", F.row_number().over(mine.orderBy(F.desc("sure"), F.desc("lower"), "vec_id")))
    least = F.max(F.when((F.col("k") == most) & (F.col("sure") == 1), F.col("lower"))).over(mine)
    out = materialize(ranked.withColumn("least", least).where("least IS NULL OR upper >= least").select("anchor", "w", "vec_id"))
    release(packed)
    return out


def scored(found: DataFrame, rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """found with the exact score: vectors meet candidates where they lie while these are few."""
    pairs = rows.select("vec_id", "x").join(sent(found), "vec_id").join(anchors.select("anchor", F.col("x").alias("ax")), "anchor")
    product = F.aggregate(F.zip_with("x", "ax", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, c: s + c)
    return pairs.select("anchor", "w", "vec_id", product.alias("score"))


def hard_negatives(rows: DataFrame, anchor: str, most: int = 5, low: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows (vec_id, label, x) for which the SQL predicate `anchor` holds; ids are unique."""
    rows = materialize(rows)
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    alike = Window.partitionBy("label", F.xxhash64("x"), "x").orderBy("vec_id")
    firsts = materialize(rows.withColumn("k", F.row_number().over(alike)).where(F.col("k") <= most + 1).drop("k"))
    edges = cell_edges(rows, dim, CELLS)
    blocks = materialize(firsts.mapInArrow(approximate(dim, edges), "ids binary, labels binary, cells binary"))
    end = F.lit(OPEN).cast("long")
    anchors = materialize(rows.where(anchor).select(F.col("vec_id").alias("anchor"), "label", "x", F.array(-end).alias("lows"), F.array(end).alias("highs")))
    best = scored(candidates(blocks, anchors, dim, edges, 1, most, True), firsts, anchors)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    # the least integer whose hundredfold reaches low * score, without a product that could leave the range of a long
    reach = F.expr(f"(score - pmod(score, 100)) div 100 * {low} + ({low} * pmod(score, 100) + 99) div 100")
    positives = best.withColumn("w", F.row_number().over(first).cast("long") - 1).where(F.col("w") < most)
    positives = materialize(positives.select("anchor", "w", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), reach.alias("reach")))
    ends = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("w", "reach", "positive_score"))).alias("all"))  # at most `most`
    ends = ends.select("anchor", F.col("all.reach").alias("lows"), F.col("all.positive_score").alias("highs"))
    opened = materialize(anchors.select("anchor", "label", "x").join(ends, "anchor"))
    near = scored(candidates(blocks, opened, dim, edges, most, most, False), firsts, opened)
    inside = near.join(positives, ["anchor", "w"]).where("score BETWEEN reach AND positive_score")
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")).cast("int")
    out = inside.withColumn("rank", rank).where(F.col("rank") <= most)
    out = materialize(out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    release(rows, firsts, blocks, anchors, positives, opened)
    return out


def negatives_of_embeddings(embeddings: DataFrame) -> DataFrame:
    """The negatives of every anchor (vec_id divisible by 100); where vec_id is divisible by 7, the label is (label + 1) % 10."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select("vec_id", shifted.alias("label"), "embedding")
    return hard_negatives(quantised(rows, "embedding"), "vec_id % 100 = 0")


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""
