"""Filters and classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and value sets that filters compare with.
BOOKKEEPING = ["method_list.txt", "mutation_log.txt"]
ARITHMETIC_TYPES = ["int", "double", "float", "long", "short", "char", "byte"]
ARITHMETIC_OPERATORS = ["*", "/", "%", "+", "-"]
STANDARD_TYPES = ["String", "Integer", "Boolean", "Long", "Double", "Float", "Short", "Byte", "Character"]
LANGUAGES = [1, 3]
RETRIED_STATUS = [408, 409, 425, 429]
ROUND_LIMITS = {"mutap_syntax_repair": 10, "mutgen_generation": 4, "hits_test_repair": 10, "aster_repair": 3, "aster_coverage": 1}
#: Stages and their temperature.
STAGES = {
    "chattester_intention": 0.0, "chattester_initial": 0.0, "chattester_compile_repair": 0.0, "chattester_runtime_repair": 0.0,
    "mutgen_summary": 0.0, "mutgen_generation": 0.0, "mutgen_compile_repair": 0.0, "mutgen_assert_repair": 0.0,
    "mutap_initial": 0.8, "mutap_syntax_repair": 0.8, "mutap_survivor_augmentation": 0.8,
    "hits_slicing": 0.0, "hits_slice_test": 0.0, "hits_test_repair": 0.0,
    "a3test_generation": 0.0, "aster_initial": 0.0, "aster_repair": 0.0, "aster_coverage": 0.0, "intut_generation": 0.2,
}


def chosen(manifest: DataFrame, project: str | None = None, class_name: str | None = None, method_signature: str | None = None) -> DataFrame:
    for column, value in (("project", project), ("class_name", class_name), ("method_signature", method_signature)):
        if value is not None:
            manifest = manifest.filter(F.col(column) == value)
    return manifest


def has_extension(name: Column, extension: str) -> Column:
    """A real extension after a name, and no $ anywhere."""
    return ~F.contains(name, F.lit("$")) & (F.instr(name, ".") > 1) & (F.substring_index(name, ".", -1) == extension)


def mutant_folder(name: Column) -> Column:
    return ~name.isin(BOOKKEEPING)


def folders(entries: DataFrame, kind: str = "is_directory") -> DataFrame:
    return entries.filter(kind)


def with_prefix(name: Column, prefix: str) -> Column:
    return F.startswith(name, F.lit(prefix))


def without_marker(name: Column, marker: str) -> Column:
    """Names that hold the marker nowhere."""
    return ~F.contains(name, F.lit(marker))


def usable_language(language: Column) -> Column:
    return language.isin(LANGUAGES)


def public_fields(fields: Column) -> Column:
    return F.filter(fields, lambda x: x.rlike(r"(?m)^\s*public\b"))


def other_signatures(signatures: Column, method: Column) -> Column:
    """Signatures that are not blank and don't mention the method as a call."""
    pattern = F.concat(F.lit(r"\b\Q"), method, F.lit(r"\E\s*\("))
    return F.filter(signatures, lambda x: (F.trim(x) != "") & ~F.regexp_like(x, pattern))


def assert_lines(rows: DataFrame, text: str, least: int = 10) -> DataFrame:
    """(…, line_no, line): the lines that assert something, left-trimmed, over ``least`` characters."""
    lines = rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", F.ltrim("line"))
    return lines.filter(F.startswith("line", F.lit("assert")) & (F.length("line") > least))


def foreign_type(name: Column) -> Column:
    return ~F.startswith(name, F.lit("java.")) & ~F.startswith(name, F.lit("javax.")) & ~name.isin(STANDARD_TYPES)


def failure_state(error_type: Column, message: Column, existing: Column) -> Column:
    """The terminal state of a failed pipeline; the first rule that fits decides."""
    return (
        F.when(error_type == "ModelOutputTruncatedError", "MODEL_OUTPUT_TRUNCATED")
        .when(error_type == "ModelOutputInvalidError", "MODEL_OUTPUT_INVALID")
        .when(existing == "ORIGINAL_PASSED", "MUTATION_INFRASTRUCTURE_FAILED")
        .when(provider_failure(message), "MODEL_PROVIDER_FAILED")
        .otherwise("PIPELINE_FAILED")
    )


def provider_failure(message: Column) -> Column:
    return F.startswith(message, F.lit("LLM API failed after "))


def without_old_runner(jars: Column) -> Column:
    """JUnit 3 jars go where a JUnit 4 jar is in the same list."""
    old, new = (lambda x: x.rlike(r"(^|/)junit-3[^/]*\.jar$")), (lambda x: x.rlike(r"(^|/)junit-4[^/]*\.jar$"))
    return F.when(F.exists(jars, new), F.filter(jars, lambda x: ~old(x))).otherwise(jars)


def validated(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): every required text must hold something."""
    good = F.lit(True)
    for name in required:
        good = good & (F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != "")
    return rows.filter(good), rows.filter(~good)


def arithmetic_type(kind: Column) -> Column:
    return kind.isin(ARITHMETIC_TYPES)


def arithmetic_operator(operator: Column) -> Column:
    return operator.isin(ARITHMETIC_OPERATORS)


def regression_tests(tests: DataFrame, kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """(formal, audit): error tests are for audit only."""
    return tests.filter(F.col(kind) == "RegressionTest"), tests.filter(F.col(kind) != "RegressionTest")


def passing_on_original(tests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return tests.join(results.filter("passed"), key, "left_semi")


def not_done(tasks: DataFrame, done: DataFrame, key: str, skip_existing: bool = True) -> DataFrame:
    return tasks.join(done, key, "left_anti") if skip_existing else tasks


def timed_out(duration: Column, limit_ms: int = 4000) -> Column:
    """The budget holds for each test method, not for its suite."""
    return duration > limit_ms


def retried(http_status: Column, transport_error: Column) -> Column:
    return transport_error | http_status.isin(RETRIED_STATUS) | http_status.between(500, 599)


def within_rounds(rows: DataFrame, stage: str, round_: str) -> DataFrame:
    limit = F.try_element_at(F.create_map(*[F.lit(v) for pair in ROUND_LIMITS.items() for v in pair]), F.col(stage))
    return rows.filter(F.col(round_) <= F.coalesce(limit, F.col(round_)))


def whole_batches(rows: DataFrame, batches: DataFrame, key: str, finished: str = "finished") -> DataFrame:
    """An interrupted batch is invalid as a whole and is not resumed: rows count only where their batch came to its end."""
    return rows.join(batches.filter(finished).select(key), key, "left_semi")


def finished_targets(mutants: DataFrame, target: str) -> DataFrame:
    """Targets where all are killed or no live mutant is left unused."""
    return mutants.groupBy(target).agg((F.count_if(~F.col("killed") & ~F.col("used")) == 0).alias("finished"))
