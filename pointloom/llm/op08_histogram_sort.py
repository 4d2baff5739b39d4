"""Shards of nearly equal bytes by histogram sort.

Candidate boundaries (probes) are set between the least and the largest key; one aggregation counts the exact
bytes and rows below every probe over all partitions; the probes around each wanted boundary are refined until
every splitter is within the tolerance. Then rows are exchanged once: to cells, which are parts of a shard that
one task can sort, and numbered there; a cell's first slot follows from the counts of the cells before it.

Null text: size 1. Empty text: size 1. Null key: sorted first. Rows with equal keys are not divided, so a key with more bytes than a
shard holds makes its shard larger. The law concerns bytes alone: equal texts under different keys may lie in different shards, since a
group of copies may be larger than a shard; they are told apart by key. Repeated rows keep a slot each, ties being ordered by the text's
checksum. Keys that are no integers are ordered by their hash. An empty table gives an empty result. Texts are only measured, however
long. Other columns of the documents are ignored by the query, and carried by shard_by_bytes(); a carried `shard` or `slot` comes back as
`shard_in` or `slot_in`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import materialize

SHARDS = 16
TOLERANCE = 0.001  # of a shard's bytes
CELL_ROWS = 50_000  # rows that one task sorts, about
PROBES = 64  # per boundary and round
LEAST = -(1 << 63)


def _below(key: str, bounds: np.ndarray):
    """Column: the number of boundaries that are at most the key."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), "right"))

    return place(F.col(key))


def _integer(rows: DataFrame, key: str):
    """The key as a long: itself, or its hash where it is no integer; the least one for null."""
    whole = rows.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(rows[key].cast("long"), F.lit(LEAST)) if whole else F.when(rows[key].isNull(), F.lit(LEAST)).otherwise(F.xxhash64(rows[key]))


def splitters(keys: DataFrame, key: str, measure: str, wanted: np.ndarray, tolerance: float) -> np.ndarray:
    """For each wanted sum of `measure`, a key below which lie about so much; keys ascend."""
    lo0, hi0 = keys.agg(F.min(key), F.max(key)).first()
    if lo0 is None or not len(wanted):
        return np.empty(0, np.int64)
    # of each boundary: a key with too little below it and one with too much, and the best so far
    lo, hi = [lo0] * len(wanted), [hi0 + 1] * len(wanted)
    best, miss = [lo0] * len(wanted), [float(w) for w in wanted]
    while True:
        open_ = [i for i in range(len(wanted)) if miss[i] > tolerance and hi[i] - lo[i] > 1]
        if not open_:
            return np.array(sorted(best), np.int64)
        probes = np.array(sorted({lo[i] + (hi[i] - lo[i]) * j // (PROBES + 1) for i in open_ for j in range(1, PROBES + 1)} | {lo[i] + 1 for i in open_}), np.int64)
        found = dict(keys.groupBy(_below(key, probes).alias("cell")).agg(F.sum(measure)).collect())
        below = np.cumsum([found.get(i, 0) for i in range(len(probes))])
        for i in open_:
            for p, b in zip(probes.tolist(), below.tolist(), strict=True):
                if lo[i] < p < hi[i]:
                    if abs(b - wanted[i]) < miss[i]:
                        best[i], miss[i] = p, abs(b - wanted[i])
            inside = [(p, b) for p, b in zip(probes.tolist(), below.tolist(), strict=True) if lo[i] < p < hi[i]]
            under, over = [p for p, b in inside if b <= wanted[i]], [p for p, b in inside if b > wanted[i]]
            lo[i], hi[i] = max([lo[i], *under]), min([hi[i], *over])


def shard_by_bytes(rows: DataFrame, key: str, size: str, shards: int = SHARDS, order: tuple[str, ...] = ()) -> DataFrame:
    """The rows with `shard` (0 to shards - 1, in the order of key) and `slot` (from 0 in each shard, by key, then order)."""
    carried = F.struct(*(rows[c].alias(f"{c}_in" if c in ("shard", "slot") else c) for c in rows.columns))
    keyed = rows.select(_integer(rows, key).alias("_key"), rows[size].alias("_size"), F.struct(*(rows[c] for c in order)).alias("_order") if order else F.lit(0).alias("_order"), carried.alias("row"))
    small = keyed.select("_key", "_size", F.lit(1).cast("long").alias("_one"))
    total, count = small.agg(F.sum("_size"), F.count("*")).first()
    total = total or 0
    bounds = splitters(small, "_key", "_size", np.arange(1, shards) * total / shards, TOLERANCE * total / shards)
    cells = splitters(small, "_key", "_one", np.arange(CELL_ROWS, max(count, 1), CELL_ROWS), CELL_ROWS / 4)
    every = np.unique(np.concatenate([bounds, cells]))
    placed = keyed.withColumn("shard", _below("_key", bounds)).withColumn("_cell", _below("_key", every))
    counts = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_from", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_cell", "shard", "_from")
    numbered = placed.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_key", "_order")))
    return numbered.join(before, ["shard", "_cell"]).select("row.*", "shard", (F.col("_from") + F.col("_row") - 1).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard_by_bytes(materialize(rows), "doc_id", "size", shards, ("text_crc32",))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
