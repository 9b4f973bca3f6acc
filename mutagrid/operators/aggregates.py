"""Aggregations of the workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def method_groups(manifest: DataFrame, keys: list[str], members: str) -> DataFrame:
    """One row a focal method: its mutant rows are counted and kept, none is dropped."""
    return manifest.groupBy(*keys).agg(F.count("*").alias("mutant_rows"), F.array_sort(F.collect_list(members)).alias("members"))


def physical(mutants: DataFrame, identity: list[str]) -> DataFrame:
    """Rows, and distinct physical mutants by the columns that identify one."""
    one = mutants.groupBy(*identity).agg(F.count("*").alias("n"))
    return one.agg(F.sum("n").alias("mutant_rows"), F.count("*").alias("physical_mutants"))


def micro_coverage(reports: DataFrame) -> DataFrame:
    """Sums over the available targets and their ratios; targets without report are counted only."""
    s = lambda c: F.coalesce(F.sum(F.when(F.col("available"), F.col(c))), F.lit(0)).cast("bigint")
    sums = reports.agg(
        F.count("*").alias("targets"),
        F.count_if("available").alias("coverage_available_count"),
        F.count_if(~F.col("available")).alias("coverage_missing_count"),
        *[s(c).alias(c) for c in ("covered_line_count", "missed_line_count", "covered_branch_count", "missed_branch_count")],
    )
    return sums.withColumns({
        "line_covered_ratio": ratio(F.col("covered_line_count"), F.col("covered_line_count") + F.col("missed_line_count")),
        "branch_covered_ratio": ratio(F.col("covered_branch_count"), F.col("covered_branch_count") + F.col("missed_branch_count")),
    })


def histogram(rows: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """Counts for every value of the dimension, zero where there is none."""
    counts = rows.groupBy(F.col(column).alias(key)).agg(F.count("*").alias("n"))
    return dimension.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def status_counts(rows: DataFrame, column: str, names: dict[str, list[str]]) -> DataFrame:
    """One row with a count for each name of the statuses that it covers; zeros appear."""
    return rows.agg(*[F.count_if(F.col(column).isin(*values)).alias(name) for name, values in names.items()])


def mutation_scores(kills: DataFrame, keys: list[str], identity: list[str], infrastructure: Column, exclude_equivalent: bool = False) -> DataFrame:
    """Executable and end-to-end scores.

    A physical mutant is killed if any test failed on it. The executable score
    counts admitted targets; the end-to-end score counts all but those that
    infrastructure ended, which are never live.
    """
    if exclude_equivalent:
        kills = kills.filter(~F.coalesce("equivalent", F.lit(False)))
    one = kills.groupBy(*keys, *identity).agg(F.max("failed").alias("killed"), F.bool_or(infrastructure).alias("infrastructure"), F.bool_or("admitted").alias("admitted"))
    scored = one.groupBy(*keys) if keys else one.groupBy()
    return scored.agg(
        F.count_if("killed").alias("killed"),
        F.count_if("admitted").alias("executable"),
        F.count_if(~F.col("infrastructure")).alias("end_to_end"),
    ).withColumns({"executable_score": ratio(F.col("killed"), F.col("executable")), "end_to_end_score": ratio(F.col("killed"), F.col("end_to_end"))})


def token_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of normalised usage, and the hit rate as a ratio of sums."""
    names = ["cache_read_input_tokens", "uncached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens", "total_tokens"]
    sums = usage.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names], F.count_if("api_request_performed").alias("api_requests"))
    return sums.withColumn("cache_hit_rate", ratio(F.col("cache_read_input_tokens"), F.col("cache_read_input_tokens") + F.col("uncached_input_tokens")))


def efficiency(tasks: DataFrame, target: str) -> DataFrame:
    """Times and repair rounds per distinct focal target; rounds count repair stages only."""
    n = F.count_distinct(target)
    return tasks.agg(
        n.alias("targets"),
        ratio(F.sum("prepare_millis"), n).alias("t_pre"),
        ratio(F.sum("generate_millis"), n).alias("t_gen"),
        ratio(F.count_if(F.endswith(F.col("stage"), F.lit("_repair"))), n).alias("r_avg"),
        F.sum(F.col("prepare_millis") + F.col("generate_millis")).alias("t_total"),
        ratio(F.sum(F.col("prepare_millis") + F.col("generate_millis")), n).alias("t_avg"),
    )


def published_totals(executions: DataFrame, latest: DataFrame) -> DataFrame:
    """Sums over published executions only, 0 where none is."""
    one = executions.join(latest, ["run_dir", "execution_id"], "left_semi")
    return one.agg(F.count("*").alias("invocations"), F.coalesce(F.sum("elapsed_millis"), F.lit(0)).alias("elapsed_millis"), F.coalesce(F.sum("mutants_executed"), F.lit(0)).alias("mutant_executions"))


def merged_text(lines: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Lines of one key joined in a stated order."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return lines.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias("merged"))


def pass_rate(results: DataFrame) -> DataFrame:
    """Passes over all but one file, which is no repair; timeouts count as neither passed nor failed."""
    return results.agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"), ratio(F.count_if(F.col("status") == "pass"), F.count("*") - 1).alias("pass_rate"))


def stage_times(tasks: DataFrame, keys: list[str], timing: str, fields: list[str]) -> DataFrame:
    return tasks.groupBy(*keys).agg(*[F.sum(F.col(timing)[f]).alias(f) for f in fields], F.count("*").alias("tasks"))


def dependency_sets(classes: DataFrame, key: str, names: str) -> DataFrame:
    """(class, depends_on) edges, distinct; a class without any still has one row with null."""
    return classes.select(key, F.explode_outer(F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))).alias("depends_on")).distinct()


def least_key(least: Column, keep: Column, key: str = "key", value: str = "value") -> Column:
    """An aggregate: the smallest key of positive weight below ``least`` among the samples that ``keep`` picks, else ``least``."""
    return F.least(least, F.min(F.when(keep & (F.col(value) > 0), F.col(key))))


def kill_index(kills: DataFrame, test: str, mutant: str) -> tuple[DataFrame, DataFrame]:
    """Test -> mutants and mutant -> tests of the killing rows, both sorted."""
    hit = kills.filter("failed").select(test, mutant).distinct()
    return hit.groupBy(test).agg(F.array_sort(F.collect_list(mutant)).alias("mutants")), hit.groupBy(mutant).agg(F.array_sort(F.collect_list(test)).alias("tests"))


def first_killer(kills: DataFrame, mutant: str, test: str, order: str) -> DataFrame:
    """Fail-fast: whether a mutant is killed, and by which test first."""
    return kills.groupBy(mutant).agg(F.bool_or("failed").alias("killed"), F.min_by(test, F.when(F.col("failed"), F.col(order))).alias("first_killer"))


def cost(usage: DataFrame, rates: Column) -> DataFrame:
    """Cost of usage at rates per million (input, cached, output); null where a rate is unknown, unless the usage names a cost."""
    per = lambda tokens, rate: F.col(tokens).cast("decimal(38,6)") * rate.cast("decimal(18,6)") / 1_000_000
    by_rate = per("uncached_input_tokens", rates["input"]) + per("cache_read_input_tokens", rates["cached"]) + per("output_tokens", rates["output"])
    return usage.withColumn("cost_usd", F.coalesce("explicit_cost_usd", by_rate.cast("decimal(38,6)")))


def extents(cells: DataFrame, key: str) -> DataFrame:
    return cells.groupBy(key).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def greedy_suites(kills: DataFrame, target: str, test: str, mutant: str) -> DataFrame:
    """(target, test, ordinal, gain): tests by kills, ties by name; one stays only if it kills something new.

    The order is fixed before the choice, and a test that isn't kept kills nothing that the tests
    before it leave. So a test stays exactly if it is some mutant's first killer in that order,
    and its gain is how many it is the first of: two aggregates, whatever the size of a suite.
    """
    hit = kills.filter("failed").select(F.col(target).cast("string").alias("target"), F.col(test).cast("string").alias("test"), F.col(mutant).cast("string").alias("mutant")).distinct()
    order = hit.groupBy("target", "test").agg((-F.count("*")).alias("n"))
    first = hit.join(order, ["target", "test"]).groupBy("target", "mutant").agg(F.min(F.struct("n", "test")).alias("first"))
    kept = first.groupBy("target", "first").agg(F.count("*").cast("int").alias("gain"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("first"))
    return kept.select("target", "first.test", (rank - 1).alias("ordinal"), "gain")
