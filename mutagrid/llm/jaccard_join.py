"""N-gram Jaccard self-join with adaptive multi-match prefixes, down to exact classes.

Documents are sets of word shingles, kept as 64-bit hashes. All tokens have one
global order: by their counter in a fixed-size sketch that counts the shingles
of all documents, then by hash, so that frequent shingles come last. Two sets
whose overlap must reach ``need`` share at least m tokens among their first
``n - need + m`` ones. A document takes the m (1 to ``MATCHES``) that costs least:
the tokens it adds to the index against the candidates it leaves, estimated from
the sketch; a pair is verified only if it shares as many prefix tokens as the
smaller m of the two. With m over 1 the pair is made at its m-th shared token and
nowhere else; always the positions must leave room for the needed overlap.

Sets that are equal are one representative from the start. A group of near
copies would still give pairs by the square of its size, so candidates come in
two rounds. First every document of a token's list is verified against one hub of
the list (the document with the fewest rarer tokens). Linked documents form
components; the second round only makes pairs across components, so no pair is
made whose link would tell nothing new, and none that could join two classes is
lost. The classes are those of the complete join. Before its sets are compared a
pair must pass a bound that is exact: the bits in which two parity sketches
differ are no more than the elements in which the sets differ. For the number of
links every pair within a class is compared, block by block, in products of token
matrices; only counts leave them.

Texts are never shuffled: which documents a step needs goes to the readers as a
bitmap of their ids' hashes (of bounded size; where it fills up, more documents are
read than needed), and the exact joins that follow carry hashes only.

Defined results: a null text, or one without words, has an empty set and is its
own class, without links; a document of fewer words than the shingle has its whole
sequence as one shingle; a very long text is taken whole, in one task's memory. Rows with a null
id keep their row, with a null class, and link with nothing. Rows that repeat an id
are judged by their own text each. Copies link to each other, and a row repeated
whole is a copy. There are no ties: a class is a set. An empty table has no classes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.llm.common import Bitmaps, Workspace, groups, mix64, packed, shingle_sets, slices, table, total, unused
from mutagrid.llm.components import connected_components

#: Counters of the token sketch: one array of so many 32-bit counts is merged and sent to the workers (16 MB).
COUNTERS = 1 << 22
#: Longest prefix extension that is considered.
MATCHES = 6
#: Bits of a parity sketch.
PARITY_BITS = 512
#: Rows of one block of a token's list, and documents of a block of a class whose links are counted.
BLOCK, LINK_BLOCK = 512, 1024
#: Parts that a token's postings are dealt to where the sketch doesn't bound how many they are.
SALTS = 32
#: Bits of the marks for an id, those that it sets, and bytes of all marks at most (they are broadcast).
MARK_BITS, HASHES, MOST_MARKS = 16, 4, 64 << 20


@dataclass(frozen=True)
class Jaccard:
    """Shingle width and the least similarity, num / den."""

    width: int = 3
    num: int = 90
    den: int = 100

    def need(self, n):
        """Least overlap of a set of n with any set it links to."""
        return (self.num * n + self.den - 1) // self.den


def fingerprints(docs: DataFrame, rule: Jaccard, id_column: str) -> DataFrame:
    """(doc_id, n, fp, counts): one row a document with its set's size and 128-bit digest; per task one row of sketch counts."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), rule.width)
                slots, times = np.unique((np.concatenate([*sets, np.zeros(0, np.uint64)]) & np.uint64(COUNTERS - 1)).astype(np.int64), return_counts=True)
                counts[slots] += times.astype(np.uint32)
                fps = [digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.nulls(len(sets), pa.binary())], ["doc_id", "n", "fp", "counts"]
                )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([packed(counts)], pa.binary())], ["doc_id", "n", "fp", "counts"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, fp binary, counts binary")


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def sketch(found: DataFrame) -> np.ndarray:
    """The tasks' counts added up. Its size is fixed; counts stop at 2^32 - 1."""
    tasks = max(1, len(found.inputFiles()))
    return total(found.filter("counts is not null"), "counts", "<u4", COUNTERS, tasks, combine=saturating)


def saturating(a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    most = np.iinfo(out.dtype).max
    np.add(np.minimum(a, most - b), b, out=out)


class Marks:
    """A set of ids, each as ``HASHES`` bits of a Bloom filter: ids that are not in it may be found, none that is is missed."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def hold(self, ids: pa.Array) -> np.ndarray:
        ids = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        found = np.ones(len(ids), bool)
        for at, bit in spots(ids, self.mask):
            found &= (self.bits[at] & bit) > 0
        return found


def spots(ids: np.ndarray, mask: np.uint64):
    """(byte, bit in it) of each of an id's bits."""
    one = mix64(ids.astype(np.int64).view(np.uint64))
    step = mix64(one) | np.uint64(1)
    for k in range(HASHES):
        at = (one + np.uint64(k) * step) & mask
        yield (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))


def marked(ids: DataFrame, column: str = "doc_id") -> Marks:
    """The marks of a written table's ids: ``MARK_BITS`` bits an id, ``MOST_MARKS`` bytes at most (then more are found that aren't in it)."""
    size, n = 1 << 13, ids.count()
    while size * 8 < n * MARK_BITS and size < MOST_MARKS:
        size *= 2
    mask = np.uint64(size * 8 - 1)

    def run(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            for at, bit in spots(batch.column(column).to_numpy(), mask):
                np.bitwise_or.at(bits, at, bit)
        yield pa.RecordBatch.from_arrays([pa.array([packed(bits)], pa.binary())], ["bits"])

    rows = ids.select(column).mapInArrow(run, "bits binary")
    return Marks(total(rows, "bits", "u1", size, max(1, len(ids.inputFiles())), combine=np.bitwise_or))


def matches_wanted(frequency: np.ndarray, n: int, need: int) -> int:
    """The m with the least estimated cost: prefix postings touched, and verifications left (postings / m at most)."""
    most = min(MATCHES, need, n)
    reach = n - need + np.arange(1, most + 1)
    touched = np.cumsum(frequency[: reach[-1]])[reach - 1]
    cost = touched + 8.0 * touched / np.arange(1, most + 1)
    return int(np.argmin(cost)) + 1


def prefixes(docs: DataFrame, rule: Jaccard, id_column: str, counts: np.ndarray, spare: Marks) -> DataFrame:
    """(doc_id, n, fp, m, parity, tokens, cold, suspect): a parity sketch and the first n - need + m tokens of every document's set in the global order.

    The first ``cold`` of them have lists of bounded length: no more documents than their counter says.
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts, spare))
    noise = float(counts.mean())
    most = max(BLOCK, 8 * noise)

    def run(batches):
        counts, spare = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                ns, fps, ms, tokens, parities, colds = [], [], [], [], [], []
                for s in shingle_sets(part.column("text"), rule.width):
                    n, m, first, cold = len(s), 0, s[:0], 0
                    if n:
                        need = rule.need(n)
                        seen = counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                        longest = min(n, n - need + MATCHES)
                        order = np.lexsort((s, seen)) if n <= 2 * longest else short_order(s, seen, longest)
                        order = order[:longest]
                        m = matches_wanted(np.maximum(seen[order] - noise, 0.0), n, need)
                        first = s[order[: n - need + m]]
                        cold = int((seen[order[: n - need + m]] <= most).sum())
                    ns.append(n), fps.append(digest(s)), ms.append(m), tokens.append(first.view(np.int64)), parities.append(parity_of(s)), colds.append(cold)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(ms, pa.int32()), lists_of(parities), lists_of(tokens), pa.array(colds, pa.int32()), pa.array(spare.hold(part.column("doc_id")))], ["doc_id", "n", "fp", "m", "parity", "tokens", "cold", "suspect"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, fp binary, m int, parity array<long>, tokens array<long>, cold int, suspect boolean")


def short_order(s: np.ndarray, seen: np.ndarray, k: int) -> np.ndarray:
    """The first k of the order by (seen, s), without sorting the rest."""
    limit = np.partition(seen, k - 1)[k - 1]
    some = np.flatnonzero(seen <= limit)
    return some[np.lexsort((s[some], seen[some]))]


def lists_of(xs: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate([*xs, np.zeros(0, np.int64)]).astype(np.int64)))


def parity_of(s: np.ndarray) -> np.ndarray:
    """A bit for each of PARITY_BITS bins: whether an odd number of the set's elements falls into it."""
    bins = np.bincount(((s >> np.uint64(20)) & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits(bins.astype(np.uint8) & 1).view("<i8")


def full_sets(texts: DataFrame, rule: Jaccard, wanted: Marks) -> DataFrame:
    """(doc_id, n, tokens) of the wanted documents of (doc_id, text), and of a few others; no text is shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        wanted = shared.value
        for batch in batches:
            hit = wanted.hold(batch.column("doc_id")) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for part in slices(batch.filter(pa.array(hit)), "text"):
                sets = shingle_sets(part.column("text"), rule.width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), lists_of([s.view(np.int64) for s in sets])], ["doc_id", "n", "tokens"])

    return texts.mapInArrow(run, "doc_id long, n long, tokens array<long>")


def may_reach(rule: Jaccard, overlap: Column, n: Column, m: Column) -> Column:
    """Whether an overlap of two sets of n and m elements means a link."""
    return overlap * (rule.num + rule.den) >= (n + m) * rule.num


def side(df: DataFrame, c: str) -> DataFrame:
    return df.select(*[F.col(k).alias(c if k == "doc_id" else f"{c}_{k}") for k in df.columns])


def near(pairs: DataFrame, light: DataFrame, rule: Jaccard) -> DataFrame:
    """The pairs (x, y) that may link by size and parity."""
    differ = sum((F.bit_count(F.get("x_parity", F.lit(i)).bitwiseXOR(F.get("y_parity", F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
    # |x| + |y| - 2 overlap = difference, so the overlap is at most (|x| + |y| - bits) / 2
    bound = F.least(F.floor((F.col("x_n") + F.col("y_n") - differ) / 2), F.col("x_n"), F.col("y_n"))
    # what grows with the documents is merged, however small it is
    return pairs.join(side(light, "x").hint("merge"), "x").join(side(light, "y").hint("merge"), "y").filter(may_reach(rule, bound, F.col("x_n"), F.col("y_n"))).select("x", "y")


def verified(pairs: DataFrame, texts: DataFrame, rule: Jaccard, work: Workspace, name: str, again: bool) -> DataFrame:
    """The pairs (x, y) whose sets really link, as (a, b); only their documents' texts are tokenised again. The sets stay as ``name``-sets.

    ``again`` says that rows may be repeated: then each document's set is taken once.
    """
    wanted = work.put(f"{name}-ids", pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct())
    sets = full_sets(texts, rule, marked(wanted))
    sets = work.put(f"{name}-sets", sets.dropDuplicates(["doc_id"]) if again else sets, incompressible=True)
    # a pair takes y's set to where x's is; the pairs of an x of many are dealt to parts, each with x's set. Written, the
    # pairs' size is known: while they are few, the sets meet them where they are read
    parts = work.put(f"{name}-parts", pairs.groupBy("x").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")))
    dealt = work.put(f"{name}-dealt", pairs.join(parts, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part")))
    own = work.put(f"{name}-own", dealt.select("x", "part").distinct())
    full = dealt.join(side(sets, "y"), "y").join(own.join(side(sets, "x"), "x").hint("merge"), ["x", "part"])
    common = F.size(F.array_intersect("x_tokens", "y_tokens"))
    links = work.put(name, full.filter(may_reach(rule, common, F.col("x_n"), F.col("y_n"))).select(F.col("x").alias("a"), F.col("y").alias("b")))
    work.drop(f"{name}-ids", f"{name}-parts", f"{name}-dealt", f"{name}-own")
    return links


def classes(spark: SparkSession, docs: DataFrame, rule: Jaccard = Jaccard(), id_column: str = "doc_id", links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id[, n_links]): every row's class is the smallest id reachable by links."""
    work = Workspace(spark, "jaccard")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members, counts = sketched(rows, rule, work, "members")
    if repeats(members).filter("low <> high").isEmpty():
        return classes_of(spark, rows, members, counts, rule, links, work)
    # an id with several sets: numbers in the order of the ids stand for id and text
    numbers = work.put("numbers", rows.filter("doc_id is not null").select("doc_id", F.md5("text").alias("same")).distinct().orderBy("doc_id", "same").withColumn("no", F.monotonically_increasing_id()))
    on = (F.col("r.doc_id") == F.col("k.doc_id")) & F.md5("r.text").eqNullSafe(F.col("k.same"))
    numbered = work.put("numbered", rows.alias("r").join(numbers.alias("k"), on, "left").select(F.col("no").alias("doc_id"), "text"))
    members, counts = sketched(numbered, rule, work, "numbered-members")
    out = classes_of(spark, numbered, members, counts, rule, links, work)
    ids = numbers.select(F.col("no"), F.col("doc_id").alias("id"))
    named = out.join(ids, F.col("doc_id") == F.col("no"), "left").drop("doc_id", "no").withColumnRenamed("id", "doc_id")
    named = named.join(ids.withColumnRenamed("id", "first_id"), F.col("component_id") == F.col("no"), "left")
    return named.select("doc_id", "n_shingles", F.col("first_id").alias("component_id"), *(["n_links"] if links else []))


def sketched(texts: DataFrame, rule: Jaccard, work: Workspace, name: str) -> tuple[DataFrame, np.ndarray]:
    """The written fingerprints (doc_id, n, fp) of the texts, and the sketch of their tokens; the tasks' own sketches go."""
    found = work.put("found", fingerprints(texts, rule, "doc_id"))
    counts = sketch(found)
    members = work.put(name, found.filter("counts is null").select("doc_id", "n", "fp"))
    work.drop("found")
    return members, counts


def classes_of(spark: SparkSession, texts: DataFrame, members: DataFrame, counts: np.ndarray, rule: Jaccard, links: bool, work: Workspace) -> DataFrame:
    """The classes of (doc_id, text), whose ids each have one set."""
    # only sets that occur more than once need a representative; written, their size is known and a join may broadcast them
    copies = work.put("copies", members.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"))
    spare = work.put("spare", members.join(copies, "fp").filter("doc_id <> rep").select("doc_id", "fp").distinct())

    twice = work.put("twice", repeats(members).select("doc_id"))
    again = not twice.isEmpty()
    leaving = work.put("leaving", spare.select("doc_id").union(twice))
    every = prefixes(texts, rule, "doc_id", counts, marked(leaving)).filter("n > 0 and doc_id is not null")
    every = work.put("every", every, incompressible=True)
    # copies and repeated rows leave by an exact join, but only those that may be such are shuffled for it
    held = every.filter("suspect").join(spare, ["doc_id", "fp"], "left_anti").dropDuplicates(["doc_id"])
    first = every.filter("not suspect").unionByName(held).drop("fp", "suspect")
    light = first.select("doc_id", "n", "parity")
    live = work.put("live", with_lists(first.select("doc_id", "n", "m", "tokens", "cold"), rule, work), incompressible=True)

    hub_n, hub_pos = F.col("hub.n"), F.col("hub.pos")
    room = F.col("m") + F.least(F.col("n") - F.col("pos"), hub_n - hub_pos) - 1
    to_hub = live.filter("doc_id <> hub.doc_id").filter(may_reach(rule, F.least(F.col("n"), hub_n, room), F.col("n"), hub_n))
    to_hub = to_hub.select(F.col("hub.doc_id").alias("x"), F.col("doc_id").alias("y")).distinct()
    hub_links = verified(work.put("near-hub", near(to_hub, light, rule)), texts, rule, work, "links", again)
    parts = work.put("parts", connected_components(spark, hub_links, work, "hubs"))

    across = work.put("near-across", near(second_round(live, parts, rule, work), light, rule))
    work.drop("live", "every", "hot", "part")
    more = verified(across, texts, rule, work, "more", again)
    joined = contracted(more, parts)
    whole = work.put("whole", connected_components(spark, joined, work, "all"))
    # parts name a document's first class, whole the class of that class
    final = parts.join(whole.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = whole.join(parts.select("node"), "node", "left_anti").select("node", "component")
    final = work.put("final", final.union(alone))
    work.drop("links", "more", "whole", "parts")
    named = members.join(copies, "fp", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(final.withColumnRenamed("node", "rep"), "rep", "left")
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")]
    if links:
        others = work.put("link-counts", link_counts(final, copies, rule, work))
        named = named.join(others.withColumnRenamed("doc_id", "rep"), "rep", "left")
        linked = F.col("fp").isNotNull() & F.col("doc_id").isNotNull()
        out.append(F.when(linked, F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    work.drop("links-sets", "more-sets")
    return named.select(*out)


def repeats(members: DataFrame) -> DataFrame:
    """(doc_id, low, high) of ids in several rows, with the least and the greatest digest of their sets."""
    return members.filter("fp is not null and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).filter("n > 1").drop("n")


def link_counts(final: DataFrame, copies: DataFrame, rule: Jaccard, work: Workspace) -> DataFrame:
    """(doc_id, links): how many documents each representative links to, besides its copies.

    A class of any size is cut in blocks of ``LINK_BLOCK`` documents, and every pair of blocks is
    one piece of work: overlaps are products of the blocks' token matrices, and only
    a document's count leaves it.
    """
    sets = [work.spark.read.parquet(work.paths[f"{name}-sets"]) for name in ("links", "more")]
    sets = sets[0].unionByName(sets[1].join(sets[0].select("doc_id"), "doc_id", "left_anti"))
    weight = copies.select(F.col("rep").alias("doc_id"), F.col("copies").alias("weight"))
    nodes = final.withColumnRenamed("node", "doc_id").join(weight, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("long"))
    size = nodes.groupBy("component").agg(F.count("*").alias("nodes"), F.sum("weight").alias("all"))
    # a class may hold any share of the documents: its size goes to the parts that they are dealt to
    size = size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(size, ["component", "salt"]).drop("salt")
    nodes = work.put("nodes", nodes.withColumn("blocks", F.ceil(F.col("nodes") / LINK_BLOCK).cast("int")))
    # two of one class link to each other, as nothing else can join them
    two = nodes.filter("nodes = 2").select("doc_id", (F.col("all") - F.col("weight")).alias("links"))
    rows = nodes.filter("nodes > 2").join(sets, "doc_id")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["component", "low", "high"]
    rows = rows.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id", "weight", "n", "tokens")

    def run(batches):
        for (_, low, high), group in groups(batches, keys):
            ids, weights, n, block = (group[c].to_numpy() for c in ("doc_id", "weight", "n", "block"))
            sets = group["tokens"].combine_chunks() if isinstance(group["tokens"], pa.ChunkedArray) else group["tokens"]
            a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
            common = overlaps(sets, a, b)
            linked = common * (rule.num + rule.den) >= (n[a][:, None] + n[b][None, :]) * rule.num
            if low == high:
                np.fill_diagonal(linked, False)
            out = [(ids[a], linked @ weights[b])] + ([(ids[b], weights[a] @ linked)] if low != high else [])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]).astype(np.int64))], ["doc_id", "links"])

    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "doc_id long, links long")
    return found.groupBy("doc_id").agg(F.sum("links").alias("links")).unionByName(two)


def overlaps(sets: pa.ListArray, a: np.ndarray, b: np.ndarray, width: int = 1024) -> np.ndarray:
    """How many tokens the sets of each of ``a`` and ``b`` share; tokens are taken ``width`` at a time, and those of one set only not at all."""
    offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
    row = np.repeat(np.arange(len(sets)), np.diff(offsets))
    flat = flat[offsets[0] : offsets[-1]]
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    same = flat[1:] == flat[:-1]
    several = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(flat) else np.zeros(0, bool)
    flat, row = flat[several], row[several]
    code = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    out = np.zeros((len(a), len(b)), np.float32 if len(code) and code[-1] < 1 << 24 else np.float64)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        i, j = np.searchsorted(code, [start, start + width])
        held = np.zeros((len(sets), width), np.float32)
        held[row[i:j], code[i:j] - start] = 1
        out += held[a] @ held[b].T
    return out


def with_lists(prefixes_: DataFrame, rule: Jaccard, work: Workspace) -> DataFrame:
    """The postings of the prefixes (doc_id, n, m, tokens, cold) whose token's list leaves them a link, with the list's length and hub.

    Two documents are checked as the pair that they are. In a longer list a token
    far behind in a prefix only leaves room for links to smaller sets, so the list
    must hold some.
    """
    names = ["token", "doc_id", "n", "m", "pos", "n_docs", "least_n", "most_n", "least_room", "hub"]
    postings = prefixes_.select("doc_id", "n", "m", "cold", F.posexplode("tokens").alias("pos", "token"))
    whole = Window.partitionBy("token")
    told = {"least_n": F.min("n"), "most_n": F.max("n"), "least_room": F.min(F.col("n") - F.col("pos")), "hub": F.min(F.struct("pos", "doc_id", "n"))}
    # a list that the sketch bounds is one group of one task; most are of one document, and end here (three numbers travel as one)
    sent = postings.filter("pos < cold").select("token", "doc_id", F.expr("shiftleft(n, 32) | shiftleft(cast(pos as bigint), 3) | m").alias("packed"))
    cold = sent.repartition("token").select("token", "doc_id", F.expr("shiftright(packed, 32)").alias("n"), F.expr("cast(packed & 7 as int)").alias("m"), F.expr("cast(shiftright(packed, 3) & 536870911 as int)").alias("pos")).withColumns({"n_docs": F.count("*").over(whole), **{k: v.over(whole) for k, v in told.items()}}).filter("n_docs > 1")
    # the lists of the others may be of any length: what they tell is aggregated before it is shuffled, and comes back to their salted parts
    hot = work.put("hot", postings.filter("pos >= cold").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).select("token", "salt", "doc_id", "n", "m", "pos"), incompressible=True)
    lists = hot.groupBy("token").agg(F.count("*").alias("n_docs"), *[v.alias(k) for k, v in told.items()]).filter("n_docs > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = cold.select(*names).unionByName(hot.join(lists, ["token", "salt"]).select(*names))
    pair = may_reach(rule, F.least("least_n", F.col("m") + F.col("least_room") - 1), F.col("least_n"), F.col("most_n"))
    smallest = F.greatest(F.col("least_n"), F.ceil(F.col("n") * rule.num / rule.den - 1e-9))
    room = may_reach(rule, F.col("m") + F.col("n") - F.col("pos") - 1, F.col("n"), smallest)
    return seen.filter(F.when(F.col("n_docs") == 2, pair).otherwise(room)).select("token", "doc_id", "n", "m", "pos", "n_docs", "hub")


def in_blocks() -> dict[str, Column]:
    """The number of blocks of a token's list, and the block of one of its documents."""
    blocks = F.ceil(F.col("n_docs") / BLOCK).cast("int")
    return {"blocks": blocks, "block": F.pmod(F.xxhash64("doc_id"), blocks).cast("int")}


def contracted(more: DataFrame, parts: DataFrame) -> DataFrame:
    """The second round's links between the first round's classes."""
    name = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_class"))
    both = more.join(name("a"), "a", "left").join(name("b"), "b", "left")
    return both.select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b"))


def second_round(live: DataFrame, parts: DataFrame, rule: Jaccard, work: Workspace) -> DataFrame:
    """Pairs (x, y) of different classes at their m-th shared prefix token, m being the smaller of the two.

    A list of two is no more than a document and its hub: that pair was checked in the first round.
    """
    part = live.filter("n_docs > 2").join(parts.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    # read three times below: joined once
    part = work.put("part", part.withColumns(in_blocks()).select("token", "doc_id", "n", "m", "pos", "blocks", "block", "part"), incompressible=True)
    mixed = part.groupBy("token", "blocks").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high")
    rows = part.join(mixed.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), ["token", "block"], "left_semi")
    # the tokens that come before in a document of several matches: as many as its prefix has at most
    own = live.filter("m > 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("own"))
    before = F.transform(F.filter("own", lambda x: x["pos"] < F.col("pos")), lambda x: x["token"])
    names = ["token", "doc_id", "n", "m", "pos", "part", "blocks", "block"]
    one = rows.filter("m = 1").select(*names, F.lit(None).cast("array<long>").alias("before"))
    rows = one.unionByName(rows.filter("m > 1").join(own, "doc_id").select(*names, before.alias("before")))
    # long lists are cut in blocks: one side keeps its block, the other is sent to each
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = lambda df, c: df.select("token", "block", *[F.col(k).alias(f"{c}_{k}") for k in ("doc_id", "n", "m", "pos", "part", "before")])
    x, y = named(rows, "x"), named(right, "y")
    wanted = F.least("x_m", "y_m")
    room = wanted + F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) - 1
    met = (
        (x.token == y.token)
        & (x.block == y.block)
        & (F.col("x_doc_id") < F.col("y_doc_id"))
        & (F.col("x_part") != F.col("y_part"))
        & may_reach(rule, F.least("x_n", "y_n", room), F.col("x_n"), F.col("y_n"))
        & ((wanted == 1) | (F.size(F.array_intersect("x_before", "y_before")) == wanted - 1))
    )
    return x.join(y, met).select(F.col("x_doc_id").alias("x"), F.col("y_doc_id").alias("y")).distinct()


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, table(spark, sf_dir, "documents"), links=True)


#: The pipeline's near duplicates: five words, similarity of 0.8 or more.
NEAR = Jaccard(5, 80, 100)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near duplicates the document of the smallest id stays; so do all without words.

    A document is an id and its text: of texts that repeat an id each is judged by itself, and of rows that
    repeat both one stays. Documents without an id come after all others. Null and empty texts, and extra
    columns, are kept as they are; an empty table stays empty.
    """
    work = Workspace(spark, "near")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        gone = work.put("gone", classes(spark, docs, NEAR).filter("component_id <> doc_id").select("doc_id"))
        # only texts that may go are shuffled
        (maybe,) = unused(docs.columns, "_maybe")
        marked_rows = Bitmaps(gone, F.xxhash64("doc_id"), [F.lit(True)]).put(work, "gone-marks").flagged(docs, F.xxhash64(F.col("doc_id").cast("long")), maybe)
        stay = marked_rows.filter(~F.get(maybe, F.lit(0))).select(*docs.columns)
        return stay.unionByName(marked_rows.filter(F.get(maybe, F.lit(0))).join(gone, "doc_id", "left_anti").select(*docs.columns))
    ident, same, no = unused(docs.columns, "_id", "_same", "_no")
    # numbers in the order of the ids, one for each id and text
    keyed = docs.withColumns({ident: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), same: F.coalesce(F.sha2("text", 256), F.lit(""))})
    order = keyed.select("doc_id", ident, same).distinct().orderBy(F.col("doc_id").asc_nulls_last(), same)
    numbers = work.put("numbers", order.select(ident, same, F.monotonically_increasing_id().alias(no)))
    single = work.put("single", keyed.join(numbers, [ident, same]).dropDuplicates([no]).select(no, *docs.columns))
    found = work.put("classes", classes(spark, single.select(no, "text"), NEAR, no))
    gone = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(no))
    return single.join(gone, no, "left_anti").select(*docs.columns)


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
r AS MATERIALIZED (SELECT min(doc_id) AS rep, count(*) AS copies, list_sort(s) AS k, any_value(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
t AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM r),
c AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
e AS MATERIALIZED (SELECT x, y FROM c WHERE 100 * o >= 90 * (n + m - o) UNION SELECT y, x FROM c WHERE 100 * o >= 90 * (n + m - o)),
reach AS (SELECT x AS node, y AS seen FROM e UNION SELECT r.node, e.y FROM reach r JOIN e ON r.seen = e.x),
top AS (SELECT node, least(node, min(seen)) AS c FROM reach GROUP BY node),
links AS (SELECT e.x, sum(r.copies) AS n FROM e JOIN r ON e.y = r.rep GROUP BY e.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(top.c, r.rep, s.doc_id) AS component_id, coalesce(r.copies - 1 + coalesce(links.n, 0), 0)::BIGINT AS n_links
FROM s LEFT JOIN r ON list_sort(s.s) = r.k LEFT JOIN top ON top.node = r.rep LEFT JOIN links ON links.x = r.rep"""
