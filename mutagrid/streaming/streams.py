"""Streaming forms of the workload's incremental rules, on Structured Streaming."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from mutagrid.streaming import published


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """The events with a watermark; times without zone are read in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and key; rows later than the watermark are left out, state is dropped behind it."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return timed(events, time, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return timed(events, time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first row, once: state is kept as long as the watermark lets a repetition come."""
    return timed(events, time, late).dropDuplicatesWithinWatermark(keys)


def publish_latest(rows: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, layout: published.Layout = published.Layout()):
    """A writer that keeps the last row of each key in a table: a later run supersedes. Read it by ``published.read_latest``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        published.publish(batch, batch_id, path, keys, order, layout)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


KNOWN = "target string, round long, new_kills long, known_kills long"


class KilledSoFar(StatefulProcessor):
    """A target's killed mutants, one entry each; a row for each batch that has some of its kills."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "mutant string", "round long")
        self.total = handle.getValueState("total", "round long, kills long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        round_, before = self.total.get() if self.total.exists() else (0, 0)
        new = 0
        for row in rows:
            if not self.known.containsKey((row.mutant,)):
                self.known.updateValue((row.mutant,), (round_ + 1,))
                new += 1
        self.total.update((round_ + 1, before + new))
        yield Row(target=key[0], round=round_ + 1, new_kills=new, known_kills=before + new)


def killed_so_far(kills: DataFrame) -> DataFrame:
    """Stream of (target, mutant) kills -> the accumulated killed set's size, round by round; ``rounds.round_loop`` has deadlines as well."""
    by_key_state(kills.sparkSession, sys.modules[__name__])
    return kills.select("target", F.col("mutant").cast("string").alias("mutant")).groupBy("target").transformWithState(KilledSoFar(), KNOWN, "append", "none")


def by_key_state(spark: SparkSession, module) -> None:
    """Keyed states need the RocksDB store; the process that prepares them has no path to this package, so processors go to it by value."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cloudpickle.register_pickle_by_value(module)


def append_log(lines: DataFrame, path: str, checkpoint: str):
    """An append-only log, text line by line."""
    return lines.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint)
