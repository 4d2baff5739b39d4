"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _set_folder(df: DataFrame) -> None:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pointloom-"))


def cut(df: DataFrame) -> DataFrame:
    """df computed, written to the session's checkpoint folder and read from there. In local mode alone a temporary folder is set where none is."""
    _set_folder(df)
    return df.checkpoint()


def cut_bare(df: DataFrame) -> DataFrame:
    """cut for loops that join a round with the one before: a checkpoint keeps the planner's estimate of its size, a product of those of joined sides, whose digits would multiply with every round. A written table has the size of its files."""
    _set_folder(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop in the checkpoint folder. Each is written over the one before the last `most`, so that the disk holds what the loop still reads, not its history."""

    def __init__(self, df: DataFrame, most: int):
        _set_folder(df)
        self.folder, self.most, self.count = f"{df.sparkSession.sparkContext.getCheckpointDir()}/loop-{uuid.uuid4().hex}", most, 0

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.count % self.most}"
        self.count += 1
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
