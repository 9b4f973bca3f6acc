"""Set operations over mutant and test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(all_mutants: DataFrame, killed: DataFrame, equivalent: DataFrame | None, keys: list[str]) -> DataFrame:
    rest = all_mutants.join(killed, keys, "left_anti")
    return rest if equivalent is None else rest.join(equivalent, keys, "left_anti")


def unused(live_mutants: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    return live_mutants.join(used, keys, "left_anti")


def suite_with(prior: DataFrame, new: DataFrame, passed: Column) -> DataFrame:
    """The suite and the passing new tests, each once."""
    return prior.unionByName(new.filter(passed).select(*prior.columns)).distinct()


def referenced(imports: Column, types: Column) -> Column:
    return F.array_union(imports, types)


def first_occurrences(values: Column) -> Column:
    return F.array_distinct(values)


def sorted_common(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b)
