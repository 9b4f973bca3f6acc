"""Connected components of an edge table by alternating large-star and small-star steps, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutagrid.llm.common import Workspace


def connected_components(spark: SparkSession, edges: DataFrame, work: Workspace, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    ``edges`` has columns a and b of any orderable type; loops, nulls, repeated
    and reversed edges do no harm. Every round is written to the shared folder,
    so a lost executor costs one round at most; nothing but two numbers a round
    reaches the driver. Neighbourhood minima are aggregated before they are
    shuffled, so a node with very many neighbours is no hot spot.
    """
    now = work.put(f"{name}-0", edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for k in range(1, rounds + 1):
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        new = work.put(f"{name}-{k}", small)
        work.drop(f"{name}-{k - 1}")
        sign = tuple(new.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        now = new
        if sign == before or not sign[0]:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
