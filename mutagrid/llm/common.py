"""Helpers shared by the corpus operators: shared-folder tables and vectorised tokenising."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Regular expression of the six ASCII white-space characters that separate words.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one where that is unset and everything runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/mutagrid-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def unused(columns, *names: str) -> list[str]:
    """The names, with underscores before those that the columns have already, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


class Workspace:
    """Intermediate tables of one run, written as Parquet in the shared folder.

    A written table cuts the lineage and survives lost executors. ``drop`` frees
    a table as soon as no later step reads it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def put(self, name: str, df: DataFrame, incompressible: bool = False) -> DataFrame:
        path = f"{self.root}/{name}"
        self.paths[name] = path
        writer = df.write.mode("overwrite")
        if incompressible:
            writer = writer.option("parquet.enable.dictionary", "false").option("compression", "uncompressed")
        writer.parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of what is written: it does so when the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            removed(self.spark, self.paths.pop(name))


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of one bitmap, as the bitmap aggregate makes it; bits of all bitmaps of a rule at most (4 MB), and bits of a marked row.
PAGE, MOST_BITS, ROW_BITS = 1 << 15, 1 << 25, 16


class Bitmaps:
    """Rows marked by a hash, in one column of bitmaps for each flag: a table of bounded size that any scan can be joined with in place."""

    def __init__(self, rows: DataFrame, mark: Column, flags: list[Column]):
        """``mark`` is a hash of the rows, ``flags`` are booleans of them."""
        n, self.bits = rows.count(), PAGE
        while self.bits < min(n * ROW_BITS, MOST_BITS):
            self.bits *= 2
        spot = F.pmod(mark, F.lit(self.bits))
        said = rows.select(F.floor(spot / PAGE).cast("int").alias("page"), F.pmod(spot, F.lit(PAGE)).alias("at"), *[f.alias(f"flag{i}") for i, f in enumerate(flags)])
        self.n, maps = len(flags), [F.bitmap_construct_agg(F.when(F.col(f"flag{i}"), F.col("at"))).alias(f"map{i}") for i in range(len(flags))]
        self.pages = said.groupBy("page").agg(*maps)

    def put(self, work: Workspace, name: str) -> Bitmaps:
        self.pages = work.put(name, self.pages)
        return self

    def flagged(self, rows: DataFrame, mark: Column, name: str) -> DataFrame:
        """The rows with an array of the flags of their mark, as ``name``."""
        page, at, there, *hidden = unused([*rows.columns, name], "_page", "_at", "_number", *[f"_map{i}" for i in range(self.n)])
        spot = F.pmod(mark, F.lit(self.bits))
        found = rows.withColumns({page: F.floor(spot / PAGE).cast("int"), at: F.pmod(spot, F.lit(PAGE)).cast("int")})
        # bits / PAGE rows at most, of PAGE bits for each flag: MOST_BITS bounds what is broadcast
        maps = self.pages.select(F.col("page").alias(there), *[F.col(f"map{i}").alias(h) for i, h in enumerate(hidden)])
        bit = lambda m: F.coalesce(F.expr(f"getbit(cast(conv(hex(substring(`{m}`, `{at}` div 8 + 1, 1)), 16, 10) as int), `{at}` % 8) = 1"), F.lit(False))
        joined = found.join(F.broadcast(maps), F.col(page) == F.col(there), "left")
        return joined.select(*rows.columns, F.array(*[bit(h) for h in hidden]).alias(name))


#: Arrays that one task adds up, when those of all tasks are added in a tree.
FAN_IN = 64


def packed(array: np.ndarray) -> bytes:
    return zlib.compress(array.tobytes(), 1)


def total(rows: DataFrame, column: str, kind: str, size: int, n: int, combine=np.add) -> np.ndarray:
    """The arrays of ``size`` numbers, packed in a binary column of about ``n`` rows, combined into one.

    Executors combine ``FAN_IN`` of them at a time until so many are left at most: neither
    a task nor the driver reads an amount that grows with the input.
    """

    def combined(raws) -> np.ndarray:
        out = np.zeros(size, kind)
        for raw in raws:
            combine(out, np.frombuffer(zlib.decompress(raw), kind), out=out)
        return out

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([packed(combined(x.as_py() for batch in batches for x in batch.column(column)))], pa.binary())], [column])

    rows = rows.select(column)
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        rows = rows.repartition(n).mapInArrow(run, f"{column} binary")
    return combined(bytes(r[0]) for r in rows.toLocalIterator())


def groups(batches, keys: list[str]):
    """(key, rows) of each run of equal whole-number keys in sorted batches, as one table a run."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
        edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(place[a].tolist())
            if key != now and held:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def extended(schema: StructType, **columns: str) -> StructType:
    """A schema with more columns, given by name and simple type."""
    more = StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items()))
    return StructType([*schema.fields, *more.fields])


def slices(batch: pa.RecordBatch, column: str, budget: int = 2 << 20):
    """Cut a batch so that each piece holds about ``budget`` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of every word, offsets of every text, distinct words); a code is an index of the distinct words.

    Words are maximal runs without ASCII white space; A-Z are lower-cased if asked. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        flat, offsets = flat.filter(pa.array(full)), kept[offsets]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), offsets.astype(np.int64), coded.dictionary.to_pylist()


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the offsets of every text."""
    from xxhash import xxh3_64_intdigest

    codes, offsets, words = word_codes(texts, lower)
    hashes = np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return hashes[codes] if len(words) else np.zeros(0, np.uint64), offsets


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text its distinct word shingles as sorted 64-bit hashes.

    A text of fewer words than ``width`` has its whole word sequence as one
    shingle; one without words (or null) has none.
    """
    hashes, offsets = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = hashes.copy()
        for k in range(1, width):
            rolled[: len(rolled) - k] = rolled[: len(rolled) - k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]
        mixed = mix64(rolled)
        out = []
        for start, end in zip(offsets[:-1], offsets[1:]):
            n = int(end - start)
            if n >= width:
                one = np.sort(mixed[start : end - width + 1])
                out.append(one[np.concatenate([[True], one[1:] != one[:-1]])])
            elif n:
                acc = np.uint64(n)
                for h in hashes[start:end]:
                    acc = acc * np.uint64(0x9E3779B97F4A7C15) + h
                out.append(mix64(np.array([acc ^ np.uint64(0xA5A5A5A5)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def hash_unit(*parts) -> "F.Column":
    """A uniform number in [0, 1) with 52 bits, from the MD5 of the parts joined by ':'. Equal in any SQL engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))
