"""Inheritance: direct children and ancestor closures."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def children(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(parent, child) of the given types (type)."""
    return edges.join(types, F.col("parent") == F.col("type")).select("parent", "child")


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of every node and the length of its shortest way up.

    Paths are doubled until a step finds no new pair, so a hierarchy of any depth takes
    the logarithm of its depth in steps, and a cycle ends. Each step is checkpointed:
    a lost executor costs one step. Nulls are no types; repeated edges count once.
    """
    spark = edges.sparkSession
    checkpoints(spark)
    up = edges.select(F.col("child").cast("string").alias("node"), F.col("parent").cast("string").alias("ancestor")).filter("node is not null and ancestor is not null")
    up = up.distinct().withColumn("distance", F.lit(1)).checkpoint()
    known = state(up)
    while True:
        further = up.select(F.col("node").alias("middle"), F.col("ancestor").alias("top"), F.col("distance").alias("more"))
        longer = up.join(further, F.col("ancestor") == F.col("middle")).select("node", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        up = up.union(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")).checkpoint()
        if (now := state(up)) == known:
            return up
        known = now


def state(up: DataFrame) -> tuple:
    """What changes as long as a pair is new or a way becomes shorter."""
    return tuple(up.agg(F.count("*"), F.sum("distance")).first())


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names; to a temporary one only where that is unset and all runs on one machine."""
    if spark._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.gettempdir()}/mutagrid-checkpoints")
