"""Sharding by sampled splitters: range partitions of near equal bytes.

Records are ordered by the MD5 of their text, then by id, and cut into ranges at
quantiles of a size-weighted sample; a range that the exact counts show to be
overfull is sampled again and subdivided. Rows that repeat text and id have an
arbitrary number behind them, so that no range is too hot to be cut. The
ranges' exact totals then give every record its place in bytes among all
records. The sample only decides how the work is spread; it never changes the result.

The edges between shards are the exact quantiles of the bytes. As equal texts are
neighbours, an edge may fall into a group of them: it moves to the group's nearer
end, if that is no further than ``SLACK`` of a shard's mean bytes, else it stays and cuts
the group. So a shard's bytes differ from the mean by no more than twice that and a record.

Defined results: a null text has no bytes, and the checksum of none. Null ids
come first in their text's order. Rows repeated whole get places of their own, and
which of them gets which can't be told. Very long texts are records like others: a shard
that gets one may be larger by it. Extra columns are dropped, whatever their names. An empty
table has no rows to place.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.llm.common import Workspace, extended, table

#: Ranges per shard and rows of a range, about; sampled records per range: the driver holds ranges x samples places, about.
RANGES, RANGE_ROWS, SAMPLES, ROUNDS = 8, 2_000_000, 8, 8
#: Bytes that a record weighs besides its text.
OVERHEAD = 16
#: How far an edge may move to the end of a group of equal texts, as a part of a shard's mean bytes.
SLACK = 0.05


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key, no)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"), F.monotonically_increasing_id().alias("no")
    )


def places(rows: DataFrame) -> DataFrame:
    """The rows with their place in the order: a string of key, id (null first) and number, each of fixed length."""
    digits = lambda c: F.lpad(F.hex(c), 16, "0")
    # with its sign bit turned, a number orders as its digits do
    ident = F.coalesce(F.concat(F.lit("1"), digits(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))), F.lit("0" * 17))
    return rows.withColumn("place", F.concat("key", ident, digits("no")))


def ranged(rows: DataFrame, splitters: list[str]) -> DataFrame:
    """The rows with the number of splitters not above their place."""
    shared = rows.sparkSession.sparkContext.broadcast(splitters)

    def run(batches):
        cuts = np.array(shared.value, "S")
        for batch in batches:
            at = np.array(batch.column("place").to_pylist(), "S")
            spots = np.searchsorted(cuts, at, side="right") if len(cuts) else np.zeros(len(at), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spots, pa.int32())], [*batch.schema.names, "range"])

    return rows.mapInArrow(run, extended(rows.schema, range="int"))


def quantiles(sample: list[str], n: int) -> set[str]:
    """About n - 1 splitters between n equal parts of the sample."""
    sample = sorted(sample)
    return {sample[len(sample) * k // n] for k in range(1, n)} if sample else set()


def drawn(rows: DataFrame, rate: float, seed: int) -> list[str]:
    """A size-weighted sample: a record is drawn with the probability size x rate, by itself."""
    return [r.place for r in rows.filter(F.rand(seed) < F.col("size") * rate).select("place").collect()]


def splitters_for(rows: DataFrame, n: int, total: int) -> tuple[list[str], list]:
    """The splitters and, per range, its bytes and rows: overfull ranges are subdivided until none is."""
    cuts = sorted(quantiles(drawn(rows, n * SAMPLES / total, 1), n))
    most = 2 * total / n
    for k in range(2, ROUNDS + 2):
        at = ranged(rows, cuts)
        totals = at.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()
        over = {r.range: r.bytes for r in totals if r.bytes > most + r.largest and r.n > 1}
        if not over or k == ROUNDS + 1:
            break
        by_range: dict[int, list] = {}
        found = drawn(at.filter(F.col("range").isin(list(over))), n * SAMPLES * 4 / total, k)
        for x, r in zip(found, np.searchsorted(np.array(cuts, "S"), np.array(found, "S"), side="right").tolist() if cuts and found else [0] * len(found)):
            by_range.setdefault(r, []).append(x)
        new = set().union(*[quantiles(xs, max(2, round(2 * over[r] / most))) for r, xs in by_range.items() if r in over]) - set(cuts)
        if not new:
            break
        cuts = sorted({*cuts, *new})
    return cuts, totals


def edges_of(placed: DataFrame, n_shards: int, total: int) -> list[int]:
    """Where the shards 1, 2, ... begin, in bytes: n_shards - 1 numbers, from as many rows at most."""
    exact = [-(-total * k // n_shards) for k in range(1, n_shards)]
    # a quantile lies in one record; its group's extent decides
    holds = (F.col("at") < F.col("quantile")) & (F.col("quantile") <= F.col("at") + F.col("size"))
    first = F.floor(F.col("at") * n_shards / F.lit(total)).cast("long")
    near = placed.select("key", "at", "size", F.explode(F.sequence(first, F.floor((F.col("at") + F.col("size")) * n_shards / F.lit(total)).cast("long") + 1)).alias("k")).filter(f"k between 1 and {n_shards - 1}")
    hit = near.withColumn("quantile", F.expr(f"(k * {total}L + {n_shards - 1}) div {n_shards}")).filter(holds).select("k", "key").collect()
    keys = [r.key for r in hit]
    extent = {r.key: (r.low, r.high) for r in placed.filter(F.col("key").isin(keys)).groupBy("key").agg(F.min("at").alias("low"), F.max(F.col("at") + F.col("size")).alias("high")).collect()} if keys else {}
    of, out = {r.k: extent[r.key] for r in hit}, []
    for k, edge in enumerate(exact, 1):
        nearer = min(of[k], key=lambda e: (abs(e - edge), e)) if k in of else edge
        out.append(nearer if abs(nearer - edge) <= math.floor(SLACK * total / n_shards) else edge)
    return out


def shards(spark: SparkSession, docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    work = Workspace(spark, "shards")
    rows = work.put("rows", sized(docs))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    none = F.lit(None).cast("int").alias("grown_shard")
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), none)
    rows = places(rows)
    cuts, totals = splitters_for(rows, max(n_shards * RANGES, -(-n // RANGE_ROWS)), total)
    before, seen, so_far = [], 0, 0
    for r in sorted(totals, key=lambda r: r.range):
        before.append((r.range, so_far, seen))
        so_far, seen = so_far + r.bytes, seen + r.n
    # a row for each range: bounded by the parameters, RANGE_ROWS rows a range
    starts = F.broadcast(spark.createDataFrame(before, "range int, bytes_before long, rows_before long"))
    own = Window.partitionBy("range").orderBy("place")
    placed = ranged(rows, cuts).join(starts, "range").withColumn("at", F.col("bytes_before") + F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = work.put("placed", placed.withColumn("rank", F.col("rows_before") + F.row_number().over(own) - 1).select("doc_id", "size", "text_crc32", "key", "at", "rank"))
    edges = edges_of(placed, n_shards, total)
    # edges move by less than half a shard, so a place is at most one shard off its exact one
    guess = F.least(F.floor(F.col("at") * n_shards / F.lit(total)), F.lit(n_shards - 1)).cast("int")
    begins = F.array(*[F.lit(e).cast("long") for e in [0, *edges, so_far + 1]])
    shard = (guess - (F.col("at") < F.get(begins, guess)).cast("int") + (F.col("at") >= F.get(begins, guess + 1)).cast("int")).cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # n_shards rows at most
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), none)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark, table(spark, sf_dir, "documents"))


#: The checksum by its table of 256 entries, byte by byte; ids in the table are unique, so no order is left open.
SQL = f"""WITH RECURSIVE bits AS (SELECT i::BIGINT AS byte, i::BIGINT AS c, 0 AS k FROM range(256) AS t(i) UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS tab FROM bits WHERE k = 8),
s AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + {OVERHEAD})::BIGINT AS size, md5(coalesce(text, '')) AS key,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, crc),
p AS (SELECT *, (sum(size) OVER (ORDER BY key, doc_id NULLS FIRST) - size)::BIGINT AS pos, (SELECT sum(size) FROM s)::BIGINT AS total FROM s),
g AS (SELECT key, min(pos) AS low, max(pos + size) AS high FROM p GROUP BY key),
q AS (SELECT k, any_value(total) AS total, (any_value(total) * k + 39) // 40 AS e FROM p, range(1, 40) AS t(k) GROUP BY k),
m AS (SELECT q.k, q.e, q.total, CASE WHEN q.e - g.low <= g.high - q.e THEN g.low ELSE g.high END AS n FROM q JOIN p ON p.pos < q.e AND q.e <= p.pos + p.size JOIN g ON g.key = p.key),
edges AS (SELECT CASE WHEN abs(n - e) <= floor({SLACK}::DOUBLE * total / 40) THEN n ELSE e END AS edge FROM m),
d AS (SELECT p.*, (SELECT count(*) FROM edges WHERE edge <= pos)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, NULL::INTEGER AS grown_shard FROM d"""
