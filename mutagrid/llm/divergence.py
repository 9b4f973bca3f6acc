"""Source divergence audit with deduplicated count columns.

How a source's use of terms differs from another's, and which terms mark it. Terms are
counted by language, source and term; what a language keeps (terms of enough documents)
is a column of counts for each term: the sparse vector of its sources' counts. Most terms
are rare, so many have the same vector. Terms are grouped by it, every pair of
sources is evaluated once per distinct vector and its value counts as often as the
vector has terms. The terms themselves come back for the ranking alone: of terms with one
vector only the first few can be among a source's best.

Counts are combined where they are made and then shuffled by source and term, so a hot
source or term is a few rows a task. A vector has one entry per source at most;
pairs are summed before they are shuffled. All numbers are exact 64-bit integers:
the share of a count is divided digit by digit, in base 1,000.

Defined results: null text, language and source are empty strings; each row is a document, repeated
ones too. A text without terms still names its source. A language without kept terms gives zero for
all pairs and no terms; one with a single source no pairs. Ties come by the item's bytes. Very long texts
are counted whole, extra columns are dropped, whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.llm.common import Workspace, slices, table, word_codes

#: Bytes of terms, A-Z lower-cased; all others separate them. Bytes of other than ASCII characters belong to terms.
TERM_BYTES = np.full(256, ord(" "), np.uint8)
TERM_BYTES[128:] = np.arange(128, 256)
for _first in b"aA":
    TERM_BYTES[_first : _first + 26] = np.arange(ord("a"), ord("z") + 1)


@dataclass(frozen=True)
class Audit:
    """Documents that a term needs in a language, what is added to each count, and the terms a source reports."""

    least_docs: int = 10
    prior: int = 2
    top: int = 10


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(code of every term, offsets of every text, distinct terms)."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(TERM_BYTES[raw]))
    return word_codes(clean, lower=False)


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs), summed slice by slice of the texts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                codes, offsets, words = terms_of(part.column("text"))
                if not len(codes):
                    continue
                group = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"])
                names = {}
                groups = np.array([names.setdefault((x["lang"], x["source"]), len(names)) for x in group.to_pylist()], np.int64)
                rows = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(offsets))
                once, times = np.unique(rows * len(words) + codes, return_counts=True)
                key, spot = np.unique(groups[once // len(words)] * len(words) + once % len(words), return_inverse=True)
                count, documents = np.bincount(spot, times).astype(np.int64), np.bincount(spot).astype(np.int64)
                keys, of = list(names), pa.array(key // len(words))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.string()).take(of), pa.array([k[1] for k in keys], pa.string()).take(of), pa.array(words, pa.string()).take(pa.array(key % len(words))), pa.array(count), pa.array(documents)],
                    ["lang", "source", "term", "count", "docs"],
                )

    found = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, n: Column, kept: Column, prior: int) -> Column:
    """1 + floor(10^9 (count + prior) / (n + prior * kept)), for denominators up to 9 * 10^15."""
    rest, whole, digits = count + prior, n + kept * prior, F.lit(1).cast("long")
    for scale in (1_000_000, 1_000, 1):
        digits, rest = digits + div(rest * 1000, whole) * scale, rest * 1000 % whole
    return digits


def distance(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), p + q)


def ranked(rows: DataFrame, part: str, top: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return out if top is None else out.filter(F.col("rank") <= top)


def audit(spark: SparkSession, docs: DataFrame, rule: Audit = Audit()) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has a source's distance from each other one of its language, part ``term`` its marked terms."""
    work = Workspace(spark, "divergence")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(said("text"), said("lang"), said("source"))
    kept = counted(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "count"))).alias("vector"))
    kept = work.put("terms", kept.filter(F.col("docs") >= rule.least_docs).drop("docs"))
    vectors = work.put("vectors", kept.groupBy("lang", "vector").agg(F.count("*").alias("terms")))
    sizes = vectors.select("lang", "terms", F.inline("vector")).groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    number = vectors.groupBy("lang").agg(F.sum("terms").alias("kept"))
    # a row of each language: its sources in order, with their sizes
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"), F.sum("n").alias("all"))
    langs = work.put("langs", langs.join(number, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0))))

    dense = F.transform("sources", lambda s: share(F.coalesce(F.element_at("counts", s["source"]), F.lit(0)), s["n"], F.col("kept"), rule.prior))
    shares = vectors.withColumn("counts", F.map_from_entries("vector")).join(langs, "lang").select("lang", "terms", dense.alias("shares"))
    one = shares.select("lang", "terms", "shares", F.posexplode("shares").alias("a", "p"))
    two = one.select("lang", "terms", "a", "p", F.posexplode(F.slice("shares", F.col("a") + 2, F.size("shares"))).alias("b", "q"))
    sums = two.groupBy("lang", "a", (F.col("a") + F.col("b") + 1).alias("b")).agg(F.sum(distance(F.col("p"), F.col("q")) * F.col("terms")).alias("value"))
    names = F.transform("sources", lambda s: s["source"])
    pairs = langs.select("lang", names.alias("names"), F.posexplode(names).alias("i", "source")).select("lang", "i", "source", F.posexplode("names").alias("j", "item")).filter("i <> j")
    pairs = pairs.withColumns({"a": F.least("i", "j"), "b": F.greatest("i", "j")}).join(sums, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))

    first = Window.partitionBy("lang", "vector").orderBy("term")
    # terms of one vector have one value: those behind the first few are in no report
    some = kept.withColumn("no", F.row_number().over(first)).filter(F.col("no") <= rule.top).join(langs.select("lang", "all", "kept"), "lang")
    whole = F.aggregate("vector", F.lit(0).cast("long"), lambda acc, x: acc + x["count"])
    some = some.select("lang", F.col("term").alias("item"), "kept", share(whole, F.col("all"), F.col("kept"), rule.prior).alias("q"), F.inline("vector"))
    own = some.join(groups.select("lang", "source", "n"), ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("kept"), rule.prior))
    marked = own.filter("p > q").withColumn("value", distance(F.col("p"), F.col("q")))
    return ranked(pairs, "pair", None).unionByName(ranked(marked, "term", rule.top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, table(spark, sf_dir, "documents"))


_SHARE = "1 + (1000000000::HUGEINT * ({0} + 2)) // ({1} + 2 * v)"

SQL = rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d), v AS (SELECT lang, count(k.term) AS v, coalesce(sum(c), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY 1),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT k.lang, k.term, s.source, coalesce(c.n, 0) AS n, {_SHARE.format('coalesce(c.n, 0)', 's.n')} AS p, {_SHARE.format('k.c', 'total')} AS q FROM k JOIN s USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r QUALIFY part = 'pair' OR rank <= 10"""
