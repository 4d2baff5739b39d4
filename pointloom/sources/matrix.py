"""Matrix files: text rows, or binary with rows and columns (64-bit) before column-major scalars."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.sources import files


def read_ascii(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value) of white-space separated rows of one file, in order. Lines are split among tasks; a line's row is its place in its part of the file and the lines of the parts before."""
    part = F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    lines = spark.read.text(path).select(part.alias("k"), "value").where(F.trim("value") != "").select("k.part", "k.at", "value")
    sizes = lines.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("part").collect()  # one row for each block of the file
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).astype(int).tolist()
    start = spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=False)], "part long, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1
    rows = lines.withColumn("rank", rank).join(F.broadcast(start), "part").select((F.col("before") + F.col("rank")).alias("row"), "value")
    return rows.select("row", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "value")).select("row", "col", F.col("value").cast("double").alias("value"))


ENTRIES = 1 << 20  # of a binary file that one task reads


def read_binary(spark: SparkSession, path: str, scalar: str = "f8") -> DataFrame:
    """(row, col, value) of one file, which the tasks read by ranges of columns."""
    rows, cols = np.frombuffer(files.read_raw(path, 0, 16), "<i8").tolist()
    step, width = max(1, ENTRIES // max(1, rows)), np.dtype(scalar).itemsize

    def parse(batches):
        for pdf in batches:
            for lo in pdf["id"] * step:
                n = min(step, cols - lo)
                m = np.frombuffer(files.read_raw(path, 16 + lo * rows * width, n * rows * width), "<" + scalar).reshape(n, rows)
                j, i = np.indices(m.shape)
                yield pd.DataFrame({"row": i.ravel(), "col": j.ravel() + lo, "value": m.ravel().astype(float)})

    parts = -(-cols // step)
    return spark.range(0, parts, 1, max(1, parts)).mapInPandas(parse, "row long, col long, value double")


def write(m: np.ndarray, path: str, binary: bool = True) -> None:
    if binary:
        files.write_raw(path, np.array(m.shape, "<i8").tobytes() + np.asarray(m).astype("<f8").T.tobytes())
    else:
        files.write_raw(path, "".join(" ".join(map(repr, r)) + "\n" for r in np.asarray(m, float).tolist()).encode())


def points_of(entries: DataFrame) -> DataFrame:
    """A cloud (id, p) whose points are the matrix's columns."""
    return entries.groupBy(F.col("col").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda e: e["value"]).alias("p"))
