"""Ranks over a whole table without a task that holds it: range partitions, counted, with the offsets of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.operators.session import cut


def ranked(df: DataFrame, order: list, name: str = "rank", groups: list[str] | None = None, lines: DataFrame | None = None) -> DataFrame:
    """df with each row's place from 0 in the given order (which should name every row, or rows that tie are placed anyhow).

    groups: columns that the order begins with; places then begin anew in each group. Rows are dealt to ranges of the order, so a group that holds most rows
    lies in many partitions. Rows meet a line for their partition, or for each group of it. lines: further columns for each of the groups, which come along.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_m", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_p", F.shiftright("_m", 33).cast("int")).withColumn("_m", F.col("_m").bitwiseAND((1 << 33) - 1))
    if not groups:
        counts = sorted((r[0], r[1]) for r in dealt.groupBy("_p").count().collect())
        before, starts = 0, []
        for p, n in counts:
            starts.append((p, before))
            before += n
        offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p int, _before long")
        return dealt.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_m") + F.col("_before")).select(*df.columns, name)  # a line for each partition
    # of each group in each partition: where it starts there, and its rows in the partitions before
    parts = dealt.groupBy("_p", *groups).agg(F.min("_m").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start")).drop("_start", "_n")
    further = [c for c in lines.columns if c not in groups] if lines is not None else []
    if lines is not None:
        parts = parts.join(lines, groups)
    parts = cut(parts.withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)} | {"_p": "_q"}))
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return dealt.join(parts, same).withColumn(name, F.col("_m") + F.col("_before")).select(*df.columns, *further, name)


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows in the given order, however many they are."""
    return ranked(df, order, "_rank").where(F.col("_rank") < n).drop("_rank")
