"""Aggregates that are kept in parts and merged for any grouping, without the base rows.

A part is one row per key (a day, an operator, a target ...) with counts, a sum, and two sketches: of the
distinct values of a column and of the distribution of a measure. New days are appended or
replaced, one partition each; every coarser grouping merges parts. Sketches have a fixed size, so
merging any number of parts needs the memory of two.

Error, at 3 standard deviations: ``distinct_error`` of a count of distinct values, ``rank_error`` of a quantile's rank.
Nulls are in no sketch; a group without values has 0 distinct ones and a null quantile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sketches:
    """Two to the power ``bits`` are the registers of a distinct count; ``k`` is the size of a quantile sketch."""

    bits: int = 12
    k: int = 400

    @property
    def distinct_error(self) -> float:
        return 3 * 1.04 / 2 ** (self.bits / 2)

    @property
    def rank_error(self) -> float:
        return 2.3 * 2.0 / self.k**0.9


def parts(rows: DataFrame, keys: list[str], distinct: str, measure: str, rule: Sketches = Sketches()) -> DataFrame:
    """(keys, n, total, distinct, spread): a mergeable row per key."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(measure).alias("total"), F.hll_sketch_agg(distinct, F.lit(rule.bits)).alias("distinct"), F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(rule.k)).alias("spread")
    )


def stored_parts(rows: DataFrame, path: str, day: str, keys: list[str], distinct: str, measure: str, rule: Sketches = Sketches()) -> None:
    """Writes the parts of the days that the rows hold; a day that is there already is replaced, all others stay."""
    found = parts(rows, [day, *keys], distinct, measure, rule)
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def merged(found: DataFrame, sets: list[list[str]], rule: Sketches = Sketches()) -> DataFrame:
    """The parts merged for each grouping set: (keys, set_id, n, total, distinct, spread); a key that a set leaves out is null, and its bit in ``set_id`` is 1."""
    keys = list(dict.fromkeys(k for one in sets for k in one))
    grouped = found.groupingSets([[F.col(k) for k in one] for one in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id().alias("set_id"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("spread", F.lit(rule.k)).alias("spread"))


def distinct_count(sketch: Column) -> Column:
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0))


def quantile(sketch: Column, share: float) -> Column:
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
