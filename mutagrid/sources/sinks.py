"""Sinks: all are Spark writers, so every task writes its part."""

from __future__ import annotations

import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutagrid.functions.text import null_to_empty
from mutagrid.operators import aggregates
from mutagrid.sources import ranges


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a path, of any size: a task holds a piece of a file at a time."""
    return ranges.digested(ranges.listed(spark, path))


def files_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row (files, sha256): the file's SHA-256, or for several that of their digests in order, one a line."""
    one = file_digests(spark, path).agg(F.count("*").alias("files"), F.array_sort(F.collect_list("sha256")).alias("all"))
    return one.select("files", F.when(F.col("files") == 1, F.get("all", F.lit(0))).otherwise(F.sha2(F.array_join("all", "\n"), 256)).alias("sha256"))


def manifest(rows: DataFrame, path: str, keys: list[str], source: str | None = None) -> DataFrame:
    """JSON lines, and beside them one summary row: rows, methods, a digest that no order changes, and the SHA-256 of the files written and read."""
    rows.write.mode("overwrite").json(path)
    digest = F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64(F.to_json(F.struct(*rows.columns))).cast("decimal(38,0)")).cast("string")), 256)
    summary = rows.agg(F.count("*").alias("mutant_rows"), F.count_distinct(*keys).alias("methods"), digest.alias("content_sha256"))
    spark = rows.sparkSession
    for name, place in (("output_sha256", path), ("input_sha256", source)):
        summary = summary.withColumn(name, F.lit(files_digest(spark, place).first().sha256 if place else None).cast("string"))
    summary.write.mode("overwrite").json(f"{path}.summary")
    return summary


def json_document(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def csv(rows: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """Append without a header, or write with one."""
    rows.write.mode(mode).option("header", header).csv(path)


def edges(rows: DataFrame, path: str) -> None:
    """Two columns with a header; values with commas are quoted."""
    rows.select(F.col("class").alias("Class"), F.col("depends_on").alias("DependsOn")).write.mode("overwrite").option("header", True).csv(path)


def code_lines(rows: DataFrame, path: str, parts: list[str]) -> None:
    """JSON lines of one text that joins four fields."""
    rows.select(F.concat_ws("\n", *[null_to_empty(p) for p in parts]).alias("text")).write.mode("overwrite").json(path)


def properties(rows: DataFrame, path: str) -> None:
    """key=value lines of a map column, null values left out."""
    pairs = rows.select(F.explode(F.map_filter("properties", lambda k, v: v.isNotNull())).alias("key", "value"))
    pairs.select(F.concat_ws("=", "key", "value").alias("value")).write.mode("overwrite").text(path)


def log(records: DataFrame, path: str, selected: DataFrame | None = None) -> None:
    """Log records appended; only those of selected methods, where some are."""
    kept = records if selected is None else records.join(selected, "method_signature", "left_semi")
    kept.select("value").write.mode("append").text(path)


def without_line(lines: DataFrame, target: str, path: str) -> None:
    """The lines but those equal to target, written to another place: a source is never overwritten while it is read."""
    lines.filter(F.col("value") != target).write.mode("overwrite").text(path)


def by_folder(rows: DataFrame, path: str, *columns: str) -> None:
    """A folder for each method signature, or operator, or prompt variant."""
    rows.write.mode("overwrite").partitionBy(*columns).parquet(path)


def texts(rows: DataFrame, path: str, column: str = "text") -> None:
    rows.select(null_to_empty(column).alias("value")).write.mode("overwrite").text(path)


def prompt_variants(rows: DataFrame, path: str, variants: dict[str, object]) -> None:
    """Every row once for each variant's text."""
    pairs = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("text")) for k, v in variants.items()])
    by_folder(rows.select("*", F.inline(pairs)) if "text" not in rows.columns else rows.drop("text").select("*", F.inline(pairs)), path, "variant")


def mutant_files(mutants: DataFrame, path: str, name: str = "mutant_name", text: str = "text") -> None:
    """A folder OP_n for each numbered mutant, with its source in it."""
    mutants.select(name, null_to_empty(text).alias("value")).repartition(name).write.mode("overwrite").partitionBy(name).text(path)


def merged_files(rows: DataFrame, path: str, group: str, text: str, order: str) -> None:
    """One merged test file for each group, its texts in order."""
    merged = aggregates.merged_text(rows, group, text, order)
    merged.select(group, F.col("merged").alias("value")).write.mode("overwrite").partitionBy(group).text(path)


def pickles(rows: DataFrame, path: str, key: str) -> None:
    """One pickle file for each record, named by its key, in a folder that all executors reach.

    A file appears whole, by a move, so a task that is run again leaves the same files.
    """

    def run(batches):
        import pickle

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names = [f"{root}/{quote(str(k), safe='')}.pkl" for k in batch.column(key).to_pylist()]
            for name, record in zip(names, batch.to_pylist()):
                part = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(pickle.dumps([record]))
                store.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    rows.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
