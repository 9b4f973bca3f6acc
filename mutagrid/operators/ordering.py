"""Order-dependent operators: firsts, lasts, renames, running values, top-k, samples. Every tie-break is stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutagrid.operators import scans


def first_n_groups(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """All rows of the n groups that appear first; groups are ranked from one row each, not from all rows."""
    firsts = rows.groupBy(*keys).agg(F.min(order).alias("_first")).orderBy("_first", *keys).limit(n) if n else rows.select(*keys).distinct()
    return rows.join(firsts.drop("_first"), keys, "left_semi")


def first_passing(candidates: DataFrame, group: str, order: str, passed: Column) -> DataFrame:
    return candidates.filter(passed).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter("_r = 1").drop("_r")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as an aggregate: partial maxima are taken before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return one.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def renamed_duplicates(rows: DataFrame, scope: list[str], name: str, order: str, prefix: str = "dedul_") -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*scope, name).orderBy(order))
    return rows.withColumn("_r", r).withColumn(name, F.when(F.col("_r") > 1, F.concat(F.lit(prefix), F.col(name))).otherwise(F.col(name))).drop("_r")


def numbered(rows: DataFrame, scope: list[str], operator: str, order: list[str]) -> DataFrame:
    """Mutants named OP_n in each class and operator."""
    r = F.row_number().over(Window.partitionBy(*scope, operator).orderBy(*order))
    return rows.withColumn("mutant_name", F.concat_ws("_", F.col(operator), r.cast("string")))


def quota(rows: DataFrame, group: str, order: str, per_group: int, groups: int) -> DataFrame:
    """The first rows of each of the first groups."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_r") <= per_group).drop("_r")
    return ranked.join(rows.select(group).distinct().orderBy(group).limit(groups), group, "left_semi")


def quota_carried(rows: DataFrame, group: str, order: str, per_group: int, groups: int) -> DataFrame:
    """The quota whose counter a group hands on if it ends before the counter is full: the next group then gets fewer.

    The counter runs over one row for each of the ``groups`` first groups, so what one task folds is bounded.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).limit(groups)
    one = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col("n").cast("bigint").alias("n")))).alias("sizes"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("held"), F.slice(F.transform("sizes", lambda s: F.struct(s["g"].alias("g"), s["n"].alias("take"))), 1, 0).alias("takes"))
    left = lambda acc: F.lit(per_group) - acc["held"]
    step = lambda acc, s: F.struct(
        F.when(s["n"] >= left(acc), 0).otherwise(acc["held"] + s["n"]).cast("bigint").alias("held"),
        F.array_append(acc["takes"], F.struct(s["g"].alias("g"), F.least(s["n"], left(acc)).cast("bigint").alias("take"))).alias("takes"),
    )
    takes = one.select(F.inline(F.aggregate("sizes", nothing, step)["takes"]).alias(group, "_take"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.join(takes, group).filter("_r <= _take").drop("_r", "_take")


def accumulated(rows: DataFrame, group: str, order: str, item: str) -> DataFrame:
    """How many distinct items are known after each round: an item counts in the round of its first appearance."""
    firsts = rows.groupBy(group, item).agg(F.min(order).alias(order)).groupBy(group, order).agg(F.count("*").alias("_new"))
    rounds = rows.select(group, order).distinct().join(firsts, [group, order], "left")
    run = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rounds.select(group, order, F.sum(F.coalesce("_new", F.lit(0))).over(run).alias("known"))


def running(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """The running maximum, sum and number of rows of each group, of any size."""
    x = F.col(value)
    return scans.scanned(rows, [group], order, {"running_max": ("max", x), "running_sum": ("sum", x), "running_n": ("count", F.lit(1))})


def row_breaks(rows: DataFrame, group: str, order: list[str], top: str) -> DataFrame:
    """Table rows numbered from 0: a new one begins where ``top`` changes."""
    scan = scans.way(rows, [group])
    seen = scan(rows, [group], order, {"_first": ("count", F.lit(1)), "_before": ("before", F.col(top))})
    changed = ((F.col("_first") > 1) & ~F.col("_before").eqNullSafe(F.col(top))).cast("int")
    found = scan(seen.withColumn("_new", changed), [group], order, {"row_no": ("sum", F.col("_new"))})
    return found.withColumn("row_no", F.col("row_no").cast("int")).drop("_new", "_first", "_before")


def listed(rows: DataFrame, *by: str) -> DataFrame:
    """A sorted listing: files by name, targets before their summary."""
    return rows.orderBy(*by)


def top_k(rows: DataFrame, group: str, by: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*by))).filter(F.col("rank") <= k)


def limited(rows: DataFrame, n: int) -> DataFrame:
    """0 means all."""
    return rows.limit(n) if n else rows


def seeded_pick(rows: DataFrame, group: str, ident: str, seed: int, n: int = 1) -> DataFrame:
    """n rows of each group without replacement, in the order of a fixed scramble of the id: reruns pick the same."""
    # the id's rest first: the product of any other could overflow
    key = F.pmod(F.pmod(F.col(ident), F.lit(2147483647)) * 1103515245 + seed * 12345, F.lit(2147483647))
    return rows.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_k", ident))).filter(F.col("_r") <= n).drop("_k", "_r")


def moved(rows: DataFrame, group: str, order: str, ident: str, pick: str, where: str) -> DataFrame:
    """Rows renumbered with one moved to FIRST or LAST, or one place UP or DOWN."""
    shift = {"FIRST": F.lit(-1e18), "LAST": F.lit(1e18), "UP": F.col(order) - 1.5, "DOWN": F.col(order) + 1.5}[where]
    key = F.when(F.col(ident) == pick, shift).otherwise(F.col(order).cast("double"))
    return rows.withColumn(order, F.row_number().over(Window.partitionBy(group).orderBy(key, order)))


def top_values(values: Column, k: int) -> Column:
    """The k largest values of an array, the largest first."""
    return F.slice(F.sort_array(values, asc=False), 1, k)


def lower_position(values: Column, x: Column) -> Column:
    """Where x belongs in a sorted array: how many values are smaller."""
    return F.size(F.filter(values, lambda v: v < x))
