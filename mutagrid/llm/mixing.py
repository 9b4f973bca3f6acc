"""Mixing sources to target weights by Poisson replication.

Every document of a source is repeated a random number of times with a mean of
the source's target repetition rate: target weight x target rows / rows of the
source. The number is the inverse of the Poisson distribution at a uniform
number hashed from the seed, the document's id and its text, so a rerun, a lost executor
or another partitioning changes nothing. Copies are then put in one global random
order. All of it is DataFrame code: one row per source is joined in, each copy is
exploded, and the order comes from a hashed key, whose first digits name the
partition: nothing is sampled, and no key is hot but that of rows that repeat id and text.

Defined results: a null source is a source of its own; a null id or text is hashed as an empty
one. Rows of one id with different texts are drawn by themselves. Rows that repeat id and text
get equal numbers of copies, each with a place of its own; which of them gets which is
open where they differ in other columns; other rows don't tie. Empty and very long texts are rows like others; an empty table
has no copies. Extra columns stay, unless they clash with copy or position in whatever
case, which then are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.llm.common import Workspace, hash_unit, table, unused

SEED = 20
#: Copies in a bin of the global order, about; the bins' counts give every copy's position without one task that sorts all.
BIN_ROWS = 256
#: Bins at most: their counts are broadcast (16 MB at most).
MOST_BINS = 1 << 20
#: Target weight of a source as a power of its rows: 1 keeps the corpus's mixture, 0 makes all sources equal.
FLATTEN = 0.7


def rates(docs: DataFrame, weights: dict[str, float] | None = None, flatten: float = FLATTEN, total: float = 1.0) -> DataFrame:
    """(source, n_rows, rate): the mean number of copies that brings each source to its share of total x all rows.

    ``weights`` fixes target weights by source (others get none); without it a
    source weighs its rows to the power ``flatten``.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n_rows"))
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(flatten))
    else:
        table_ = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        weight = F.coalesce(F.try_element_at(table_, F.col("source")), F.lit(0.0)).cast("double")
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n_rows").alias("all_rows"))
    return weighed.crossJoin(F.broadcast(sums)).select("source", "n_rows", F.coalesce(F.try_divide(F.col("weight") * F.col("all_rows") * total, F.col("all_weight") * F.col("n_rows")), F.lit(0.0)).alias("rate"))


def known_rates(docs: DataFrame, **options) -> DataFrame:
    """The rates as a written table: its size is then known, and the join is a broadcast only where it is small."""
    return Workspace(docs.sparkSession, "mixing").put("rates", rates(docs, **options))


def poisson_steps(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, 2, ... until no number of 52 bits lies above it."""
    last = (rate + 12 * F.sqrt(rate) + 24).cast("int")
    add = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), (acc["c"] + acc["p"] * rate / k).alias("c"), F.array_append(acc["all"], acc["c"] + acc["p"] * rate / k).alias("all"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda acc: acc["all"])


def identity(id_column: str) -> Column:
    """What a document's draws are hashed from: its id and the digest of its text."""
    return F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit("")))


def copies(docs: DataFrame, rates_: DataFrame, key: str, id_column: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Every document once per copy, with copy (from 0) and, in the column ``key``, the hashed key of its place."""
    own = [c for c in docs.columns if c.lower() not in ("copy", "position")]
    source, parts, steps, ident, n = unused([*docs.columns, key], "_source", "_parts", "_steps", "_ident", "_n")
    # means above 500 are split into equal parts with numbers of their own: e^-rate would vanish
    known = rates_.filter("rate > 0").select(F.col("source").alias(source), F.ceil(F.greatest(F.col("rate"), F.lit(1.0)) / 500).cast("int").alias(parts), "rate")
    known = known.select(source, parts, poisson_steps(F.col("rate") / F.col(parts)).alias(steps))
    joined = docs.select(*own).withColumn(ident, identity(id_column)).join(known, F.col("source").eqNullSafe(F.col(source)))
    draw = lambda part: F.size(F.filter(steps, lambda c: c <= hash_unit(F.lit(seed), part, F.col(ident))))
    number = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, part: acc + draw(part))
    counted = joined.withColumn(n, number).filter(F.col(n) > 0)
    out = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    return out.select(*own, "copy", F.md5(F.concat_ws(":", F.lit("place"), F.lit(seed), F.col(ident), F.col("copy"))).alias(key))


def share_of(key: Column, n: int) -> Column:
    """The part, of n equal ones in the order of the keys, that a hashed key belongs to."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n / F.lit(1 << 32)).cast("int")


def mix(docs: DataFrame, id_column: str = "doc_id", seed: int = SEED, rates_: DataFrame | None = None) -> DataFrame:
    """The copies in a global random order: each partition is the next part of the order, sorted."""
    (key,) = unused([*docs.columns, "copy", "position"], "_key")
    out = copies(docs, known_rates(docs) if rates_ is None else rates_, key, id_column, seed)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionById(n, share_of(F.col(key), n)).sortWithinPartitions(key).drop(key)


def placed(docs: DataFrame, id_column: str = "doc_id", seed: int = SEED, rates_: DataFrame | None = None) -> DataFrame:
    """The copies with position, gapless from 0 in the global order."""
    rates_ = known_rates(docs) if rates_ is None else rates_
    expected = rates_.agg(F.coalesce(F.sum(F.col("n_rows") * F.col("rate")), F.lit(0.0))).first()[0]
    bins = min(MOST_BINS, max(1, math.ceil(expected / BIN_ROWS)))
    key, b, there, before, rank = unused([*docs.columns, "copy", "position"], "_key", "_bin", "_there", "_before", "_rank")
    binned = lambda df: copies(df, rates_, key, id_column, seed).withColumn(b, share_of(F.col(key), bins))
    out = binned(docs)
    sizes = binned(docs.select(id_column, "source", "text")).groupBy(b).agg(F.count("*").alias("n"))
    offsets = sizes.select(F.col(b).alias(there), (F.sum("n").over(Window.orderBy(b)) - F.col("n")).alias(before))
    order = F.row_number().over(Window.partitionBy(b).orderBy(key))
    found = out.withColumn(rank, order).join(F.broadcast(offsets), F.col(b) == F.col(there)).withColumn("position", F.col(before) + F.col(rank) - 1)
    return found.drop(key, b, there, before, rank)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "copy", "position")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents repeated to the target mixture, in a global random order."""
    own, hidden = [c for c in docs.columns if c.lower() in ("copy", "position")], {}
    for c in own:
        hidden[c] = unused([*docs.columns, *hidden.values()], f"_own_{c}")[0]
    return mix(docs.withColumnsRenamed(hidden)).select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


SQL = f"""WITH RECURSIVE n AS (SELECT source, count(*) AS n_rows, pow(count(*)::DOUBLE, {FLATTEN}) AS weight FROM documents GROUP BY source),
r AS (SELECT source, weight * (SELECT sum(n_rows) FROM n) / ((SELECT sum(weight) FROM n) * n_rows) AS rate FROM n),
s AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM s WHERE k < floor(rate + 12 * sqrt(rate) + 24)),
i AS (SELECT doc_id, source, text, coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '') AS ident FROM documents),
d AS (SELECT *, ('0x' || substr(md5('{SEED}:1:' || ident), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM i),
c AS (SELECT d.doc_id, d.source, d.text, d.ident, unnest(range(0, (SELECT count(*) FROM s WHERE s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u))) AS copy FROM d)
SELECT doc_id, source, text, copy::INTEGER AS copy, row_number() OVER (ORDER BY md5('place:{SEED}:' || ident || ':' || copy)) - 1 AS position FROM c"""
