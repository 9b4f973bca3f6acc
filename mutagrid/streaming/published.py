"""A published table of each key's last row: batches add deltas, readers merge them, and one pointer says what counts.

A batch writes its own rows only, dealt to buckets by a hash of the key. A version is a list of
the folders that each bucket consists of; it is written first and then named by the pointer, which is swapped in
one step. So a reader sees one whole version, a batch that died before the swap left nothing that counts,
and one that is run again after it changes nothing. Where a bucket has more than ``most`` folders, its newest ones are merged
into one, together with older ones as long as these are no more than twice as large: so a row is written again
as often as the logarithm of its bucket's size says, and other buckets aren't touched. Folders and versions that the last ``keep`` versions don't name are deleted.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Buckets of a table, folders that one may consist of, and versions that stay for readers who began before a swap."""

    buckets: int = 16
    most: int = 8
    keep: int = 2


class Files:
    """Small files of a folder on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> dict | None:
        if not self.fs.exists(self.path(name)):
            return None
        held = self.fs.open(self.path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
        finally:
            held.close()

    def write(self, name: str, value: dict) -> None:
        """The file is there whole or not at all: it is written beside and renamed over what was there."""
        out = self.fs.create(self.path(f"{name}.new"), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(self.path(f"{name}.new"), self.path(name), options)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def names(self, name: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.path(name))] if self.fs.exists(self.path(name)) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def publish(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: str, layout: Layout = Layout()) -> None:
    """Makes the rows of a batch part of the table; of rows that tie in ``order`` the later batch's stays."""
    spark, files = batch.sparkSession, Files(batch.sparkSession, path)
    latest = files.read("latest.json")
    if latest and latest["version"] >= batch_id:
        return
    held = files.read(f"versions/{latest['version']}.json")["buckets"] if latest else {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(layout.buckets)).cast("int")
    rows = last_of(batch.withColumn("_batch", F.lit(batch_id).cast("long")), keys, order)
    written(rows.withColumn("_bucket", bucket), f"{path}/data/{batch_id}")
    for name in files.names(f"data/{batch_id}"):
        if name.startswith("_bucket="):
            held.setdefault(name.split("=")[1], []).append(f"data/{batch_id}/{name}")
    full = {b: young(files, folders) for b, folders in held.items() if len(folders) > layout.most}
    if full:
        parts = spark.read.schema(rows.schema).parquet(*[f"{path}/{f}" for folders in full.values() for f in folders])
        written(last_of(parts, keys, order).withColumn("_bucket", bucket), f"{path}/data/{batch_id}-merged")
        held |= {b: [*held[b][: -len(folders)], f"data/{batch_id}-merged/_bucket={b}"] for b, folders in full.items()}
    files.write(f"versions/{batch_id}.json", {"version": batch_id, "buckets": held})
    files.write("latest.json", {"version": batch_id})
    forgotten(files, layout)


def young(files: Files, folders: list[str]) -> list[str]:
    """The newest folders, two at least: an older one is taken in as long as it isn't more than twice as large as all behind it."""
    sizes = [files.size(f) for f in folders]
    first = len(folders) - 2
    while first and sizes[first - 1] <= 2 * sum(sizes[first:]):
        first -= 1
    return folders[first:]


def written(rows: DataFrame, folder: str) -> None:
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)


def forgotten(files: Files, layout: Layout) -> None:
    """Deletes what only older versions name."""
    versions = sorted(int(n.removesuffix(".json")) for n in files.names("versions") if n.endswith(".json"))
    old, kept = versions[: -layout.keep], versions[-layout.keep :]
    named = {f for v in kept for folders in files.read(f"versions/{v}.json")["buckets"].values() for f in folders}
    for v in old:
        for folder in {f for folders in files.read(f"versions/{v}.json")["buckets"].values() for f in folders} - named:
            files.delete(folder)
        files.delete(f"versions/{v}.json")
    used = {f.split("/")[1] for f in named}
    for name in files.names("data"):
        if name not in used and int(name.split("-")[0]) < kept[-1]:
            files.delete(f"data/{name}")


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's row of the greatest order, then of the latest batch, then by its other values; null orders come first."""
    rest = [c for c in rows.columns if c not in keys]
    place: list[Column] = [F.col(order), F.col("_batch"), *[F.col(c) for c in rest if c not in (order, "_batch")]]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*place)).alias("_r"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def read_latest(spark: SparkSession, path: str, schema: str, keys: list[str], order: str) -> DataFrame:
    """The table's latest version, of the columns of ``schema``."""
    files = Files(spark, path)
    latest = files.read("latest.json")
    empty = spark.createDataFrame([], schema)
    if latest is None:
        return empty
    folders = [f"{path}/{f}" for found in files.read(f"versions/{latest['version']}.json")["buckets"].values() for f in found]
    if not folders:
        return empty
    rows = spark.read.schema(f"{schema}, _batch long").parquet(*folders)
    return last_of(rows, keys, order).drop("_batch")
