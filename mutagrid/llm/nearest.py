"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``TABLES`` tables files a vector's direction under one bucket: the nearest
signed axes after several pseudo-rotations (three rounds of random signs and a
fast Hadamard transform), concatenated until there are about as many buckets as
vectors / ``OCCUPANCY``; the last one uses as many axes as are wanted. So a bucket
holds as many vectors in a large table as in a small one. A query probes the
buckets of every table in the order of the sum of its coordinates on their axes.

How many it probes is measured, not fixed: the exact neighbours of ``TRIALS``
queries, drawn by a hash of their ids, are found by one pass over all vectors, and
the probes are the fewest that find ``RECALL`` of them. If ``MOST_PROBES`` don't, all
queries are searched exactly. All candidates that a query meets are ranked by the
inner product, first in half precision where they are met, then ``SPARE`` times k
of them exactly, on the original vectors in double precision.

An axis only tells a vector's direction. Where norms differ, a long vector may be
an answer at any angle, so the longest part of the candidates (one of ``LONGEST``,
``POOL`` at most) is met by every query. Equal vectors are one candidate that stands
for its smallest ids: no more than k + 1 of them can ever be answers.

The work is dealt in slices: a table's buckets are dealt to so many slices that
one holds about ``SLICE`` vectors, and a query is sent to a slice once, with its
probes there. A slice that a hot bucket makes larger is cut in parts of vectors and
of queries, each pair of which meets once; a task holds one part of vectors.

Defined results: vectors that are null, zero, of another length than most (the
shorter, of two as frequent), or hold null or non-finite components take no part.
Ties go to the smaller id. Ids should be unique; rows with a null id take no part.
Extra columns are ignored. A query that has met fewer than k vectors, or than there
are, is searched again exactly, against all candidates. An empty table, or one of
a single vector, has no answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.llm.common import Workspace, mix64, table

TABLES, OCCUPANCY, SEED = 48, 8, 11
#: Queries whose exact neighbours are measured, part of these to be found, probes of a table that are tried at most.
TRIALS, RECALL, MOST_PROBES = 64, 0.96, 512
#: Vectors and queries of a part of a slice; rows of a task's working set are bounded by them.
SLICE, QUERY_PART = 1 << 14, 1 << 12
#: Candidates that are ranked exactly at first: so many times k; and how far a score of half-precision directions may be
#: off, as a part of both lengths: each direction's rounding, and room for the sums of up to 2,048 products.
SPARE, ROUNDING = 2, 2.0**-10 + 2.0**-13
#: So many open queries at most are searched in the whole table, more of them once more in what they met.
FEW = 4096
#: Answers that a task holds before it reduces them to its best of each query.
HELD = 1 << 20
#: One of so many candidates, the longest, is met by every query, so many at most.
LONGEST, POOL = 32, 4096
RADIX = 8


def hadamard(n: int) -> np.ndarray:
    out = np.ones((1, 1), np.float32)
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


def rotated(x: np.ndarray, t: int) -> np.ndarray:
    """The t-th pseudo-rotation of the rows of x, padded to a power of two: a fast transform in steps of ``RADIX``."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length()
    y = np.zeros((n, size), np.float32)
    y[:, :d] = x
    signs = np.random.default_rng([SEED, t, size]).choice(np.array([-1.0, 1.0], np.float32), (3, size))
    for s in signs:
        y *= s
        h = 1
        while h < size:
            r = min(RADIX, size // h)
            y = np.matmul(hadamard(r), y.reshape(n * (size // (r * h)), r, h)).reshape(n, size) if h > 1 else (y.reshape(-1, r) @ hadamard(r)).reshape(n, size)
            h *= r
        y /= np.float32(np.sqrt(size))
    return y


def polytopes(n: int, d: int) -> list[int]:
    """Axes of the concatenated cross-polytopes for n vectors of d dimensions."""
    size = 1 << max(0, d - 1).bit_length()
    bits, out = max(1, int(np.ceil(np.log2(max(2.0, n / OCCUPANCY))))), []
    while bits > 0:
        out.append(min(size, 1 << (bits - 1)))
        bits -= out[-1].bit_length()
    return out


def signed(x: np.ndarray, t: int, k: int, axes: int) -> np.ndarray:
    y = rotated(x, t * 64 + k)[:, :axes]
    return np.concatenate([y, -y], axis=1)


def bucket_of(x: np.ndarray, t: int, shape: list[int]) -> np.ndarray:
    """The bucket of each row in table t."""
    code = np.zeros(len(x), np.int64)
    for k, axes in enumerate(shape):
        code = code * (2 * axes) + signed(x, t, k, axes).argmax(1)
    return code


def probed(x: np.ndarray, t: int, shape: list[int], probes: int) -> np.ndarray:
    """For each row its ``probes`` nearest buckets of table t, the nearest first: the largest sums of coordinates."""
    out = []
    rows = max(1, (1 << 21) // (probes * min(probes, 2 * max(shape))))
    for start in range(0, len(x), rows):
        part = x[start : start + rows]
        total, code = np.zeros((len(part), 1), np.float32), np.zeros((len(part), 1), np.int64)
        for k, axes in enumerate(shape):
            both = signed(part, t, k, axes)
            near = largest(both, probes)
            total = (total[:, :, None] + np.take_along_axis(both, near, 1)[:, None, :]).reshape(len(part), -1)
            code = (code[:, :, None] * (2 * axes) + near[:, None, :]).reshape(len(part), -1)
            best = largest(total, probes)
            total, code = np.take_along_axis(total, best, 1), np.take_along_axis(code, best, 1)
        out.append(code)
    return np.concatenate(out) if out else np.zeros((0, 1), np.int64)


def largest(values: np.ndarray, n: int) -> np.ndarray:
    """Positions of each row's n largest values, the largest first."""
    n = min(n, values.shape[1])
    some = np.argpartition(-values, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(values, some, 1), axis=1, kind="stable"), 1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of doubles that can take part, of the most frequent length (the shorter, of two)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(fine)
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.filter(F.size("v") == (most.d if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


SENT = "cell long, side int, id long, buckets array<long>, direction binary, length double"
NAMES = [x.split()[0] for x in SENT.split(", ")]


def sent(cells: np.ndarray, side: int, ids: pa.Array, buckets: pa.Array, x: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """What is shipped of the given rows of x: directions in half precision, and lengths."""
    length = np.linalg.norm(x, axis=1)
    half = (x / length[:, None]).astype("<f2")
    shipped = pa.array([r.tobytes() for r in half], pa.binary())
    spots = pa.array(rows)
    return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(rows), side, np.int32)), ids.take(spots), buckets, shipped.take(spots), pa.array(length[rows])], NAMES)


def slice_of(buckets: np.ndarray, slices: int) -> np.ndarray:
    return (mix64(buckets.astype(np.uint64)) % np.uint64(slices)).astype(np.int64)


def filed(rows: DataFrame, shape: list[int], slices: int) -> DataFrame:
    """The candidates (id, v), a row for each table."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = matrix(part.column("v"))
                for t in range(TABLES):
                    buckets = bucket_of(x, t, shape)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1), pa.int32()), pa.array(buckets))
                    yield sent(t * slices + slice_of(buckets, slices), 0, part.column("id"), lists, x, np.arange(len(x)))

    return rows.mapInArrow(run, SENT)


def asking(rows: DataFrame, shape: list[int], slices: int, probes: int) -> DataFrame:
    """The queries (id, v), a row for each table and slice, with the probes there."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                x = matrix(part.column("v"))
                for t in range(TABLES):
                    codes = probed(x, t, shape, probes)
                    row, flat = np.repeat(np.arange(len(x)), codes.shape[1]), codes.ravel()
                    place = row * slices + slice_of(flat, slices)
                    order = np.argsort(place, kind="stable")
                    place, flat = place[order], flat[order]
                    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat))
                    yield sent(t * slices + place[starts] % slices, 1, part.column("id"), lists, x, place[starts] // slices)

    return rows.mapInArrow(run, SENT)


def everywhere(rows: DataFrame, side: int, slices: int, first: int) -> DataFrame:
    """The rows (id, v) in cells of their own, met whatever their direction: a candidate in one of them, a query in each."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v"))
            ids = batch.column("id").to_numpy()
            row = np.repeat(np.arange(len(x)), slices) if side else np.arange(len(x))
            cells = first + (np.tile(np.arange(slices), len(x)) if side else slice_of(ids, slices))
            yield sent(cells, side, batch.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1), pa.int32()), pa.array(np.full(len(row), -1))), x, row)

    return rows.mapInArrow(run, SENT)


class Cell:
    """The candidates of one part of a slice, in the order of their buckets."""

    def __init__(self, batches: list[pa.RecordBatch]):
        ids = np.concatenate([b.column("id").to_numpy() for b in batches])
        buckets = np.concatenate([b.column("buckets").flatten().to_numpy() for b in batches])
        order = np.argsort(buckets, kind="stable")
        self.ids, self.buckets = ids[order], buckets[order]
        self.x = np.concatenate([scaled(b) for b in batches])[order]
        self.off = np.concatenate([b.column("length").to_numpy() for b in batches]).astype(np.float32)[order] * np.float32(ROUNDING * max(1, self.x.shape[1] / 2048))

    def best(self, probes: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and greatest possible scores of the n best candidates in the probed buckets."""
        low, high = np.searchsorted(self.buckets, probes, "left"), np.searchsorted(self.buckets, probes, "right")
        spots = np.concatenate([np.arange(a, b) for a, b in zip(low, high) if b > a] or [np.zeros(0, np.int64)])
        scores = self.x[spots] @ q + self.off[spots] * np.linalg.norm(q)
        if len(spots) > n:
            kept = np.argpartition(-scores, n - 1)[:n]
            spots, scores = spots[kept], scores[kept]
        return self.ids[spots], scores


def scaled(batch: pa.RecordBatch) -> np.ndarray:
    flat = np.frombuffer(b"".join(batch.column("direction").to_pylist()), "<f2").astype(np.float32)
    return flat.reshape(batch.num_rows, -1) * batch.column("length").to_numpy()[:, None].astype(np.float32)


def kept_best(out: list[tuple], n: int) -> pa.RecordBatch:
    """Each query's n best of the (query ids, candidate ids, scores), each candidate once."""
    q, rep, score = (np.concatenate(c) for c in zip(*out))
    first = np.lexsort((-score, rep, q))
    q, rep, score = q[first], rep[first], score[first]
    one = np.concatenate([[True], (q[1:] != q[:-1]) | (rep[1:] != rep[:-1])])
    q, rep, score = q[one], rep[one], score[one]
    order = np.lexsort((rep, -score, q))
    q, rep, score = q[order], rep[order], score[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    kept = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < n
    return pa.RecordBatch.from_arrays([pa.array(q[kept]), pa.array(rep[kept]), pa.array(score[kept].astype(np.float64))], ["query_id", "rep", "score"])


def meeting(n: int):
    """Rows sorted by cell, part, query part and side: candidates are held, queries stream past them."""

    def run(batches):
        key, held, cell, out, size = None, [], None, [], 0
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("cell", "part", "query_part", "side")], axis=1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                some, now = batch.slice(a, b - a), tuple(place[a, :3])
                if now != key:
                    key, held, cell = now, [], None
                if place[a, 3] == 0:
                    held.append(some)
                    continue
                if not held:
                    continue
                cell = cell or Cell(held)
                x, lists = scaled(some), some.column("buckets")
                offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
                for i, q in enumerate(some.column("id").to_pylist()):
                    found, scores = cell.best(flat[offsets[i] : offsets[i + 1]], x[i], n)
                    if len(found):
                        out.append((np.full(len(found), q), found, scores))
                        size += len(found)
            if size > HELD:
                yield kept_best(out, n)
                out, size = [], 0
        if out:
            yield kept_best(out, n)

    return run


def met(candidates: DataFrame, queries: DataFrame, n: int, work: Workspace, name: str) -> DataFrame:
    """(query_id, rep, bound): the n best of what each query meets, by what their score is at most."""
    counts = candidates.select("cell", "side").union(queries.select("cell", "side")).groupBy("cell").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("asked"))
    # only slices that are too large are cut; written, their size is known and a join may broadcast them
    large = counts.select("cell", F.ceil(F.col("n") / SLICE / 2).cast("int").alias("parts"), F.ceil(F.col("asked") / QUERY_PART / 4).cast("int").alias("query_parts")).filter("parts > 1 or query_parts > 1")
    large = work.put(f"{name}-large", large)
    every, one = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1)), lambda c: F.pmod(F.xxhash64("id"), F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))).cast("int")
    dealt = lambda df: df.join(large, "cell", "left").withColumns({"parts": F.greatest("parts", F.lit(1)), "query_parts": F.greatest("query_parts", F.lit(1))})
    held = dealt(candidates).withColumn("part", one(F.col("parts"))).withColumn("query_part", every(F.col("query_parts")))
    asked = dealt(queries).withColumn("query_part", one(F.col("query_parts"))).withColumn("part", every(F.col("parts")))
    keys = ["cell", "part", "query_part"]
    both = held.select(*keys, *NAMES[1:]).unionByName(asked.select(*keys, *NAMES[1:])).repartition(*keys).sortWithinPartitions(*keys, "side")
    near = both.mapInArrow(meeting(n), "query_id long, rep long, score double")
    # the same pair may come from several tables: kept once
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    some = near.groupBy("query_id", "rep").agg(F.max("score").alias("score"))
    return some.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n).select("query_id", "rep", F.col("score").alias("bound"))


def probes_for(reps: DataFrame, queries: DataFrame, pool: DataFrame | None, shape: list[int], k: int) -> int | None:
    """The fewest probes that find ``RECALL`` of the exact neighbours of ``TRIALS`` queries; None if ``MOST_PROBES`` don't."""
    trial = queries.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(TRIALS).collect()
    if not trial:
        return 1
    shared = np.array([r.v for r in trial])
    ids = np.array([r.id for r in trial])

    def run(batches):
        found: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, shared.shape[1])))] * len(shared)
        for batch in batches:
            x, own = matrix(batch.column("v")), batch.column("id").to_numpy()
            scores = shared @ x.T
            scores[own[None, :] == ids[:, None]] = -np.inf
            for i, s in enumerate(scores):
                near = np.argpartition(-s, min(k, len(s)) - 1)[:k]
                s, o, v = np.concatenate([found[i][0], s[near]]), np.concatenate([found[i][1], own[near]]), np.concatenate([found[i][2], x[near]])
                best = np.argsort(-s, kind="stable")[:k]
                found[i] = (s[best], o[best], v[best])
        rows = [(i, float(s), int(o), v) for i, (ss, os, vs) in enumerate(found) for s, o, v in zip(ss, os, vs) if s > -np.inf]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3].tolist() for r in rows], pa.list_(pa.float64()))], ["trial", "score", "id", "v"])

    near = reps.mapInArrow(run, "trial int, score double, id long, v array<double>")
    rank = F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "id"))
    near = near.withColumn("r", rank).filter(F.col("r") <= k)
    if pool is not None:
        near = near.join(pool.select("id", F.lit(True).alias("pooled")), "id", "left")
    rows = near.collect()
    if not rows:
        return 1
    x, who = np.array([r.v for r in rows]), np.array([r.trial for r in rows])
    needed = np.where([pool is not None and bool(r.pooled) for r in rows], 0, MOST_PROBES)
    for t in range(TABLES):
        order = probed(shared, t, shape, MOST_PROBES)
        at = order[who] == bucket_of(x, t, shape)[:, None]
        needed = np.minimum(needed, np.where(at.any(1), at.argmax(1), MOST_PROBES))
    enough = np.sort(needed)[int(np.ceil(RECALL * len(needed))) - 1]
    return None if enough >= MOST_PROBES else int(enough) + 1


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` (a column of vec_id) picks."""
    work = Workspace(spark, "nearest")
    rows = work.put("rows", usable(vectors), incompressible=True)
    # equal vectors are one, by 128 bits of hash; all members stay, each with its rank by id
    same = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit("again"), "v").alias("b"))
    keyed = rows.select("vec_id", "v", same.alias("same"))
    reps = work.put("reps", keyed.groupBy("same").agg(F.min("vec_id").alias("id"), F.min_by("v", "vec_id").alias("v")), incompressible=True)
    firsts = smallest(keyed.select("vec_id", "same").join(reps.select("same", F.col("id").alias("rep")), "same").select("vec_id", "rep"), k + 1)
    reps = reps.select("id", "v")
    queries = rows.filter(is_query).select(F.col("vec_id").alias("id"), "v")

    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    size = reps.agg(F.count("*").alias("n"), F.percentile_approx(length, 1 - 1 / LONGEST).alias("long"), F.max(length).alias("most"), F.first(F.size("v")).alias("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if size.n is None or size.n == 0:
        return empty
    slices = -(-size.n // SLICE)
    shape = polytopes(size.n, size.d)
    pool = None
    if size.long * (1 + 1e-6) < size.most:
        # the part of the longest vectors, POOL at most
        pool = work.put("pool", reps.withColumn("length", length).filter(F.col("length") > size.long * (1 + 1e-6)).orderBy(F.desc("length"), "id").limit(POOL).select("id", "v"), incompressible=True)
    probes = probes_for(reps, queries, pool, shape, k)
    n = SPARE * k + 1

    def ranked(near: DataFrame) -> DataFrame:
        """Scored once more, in one fixed order of additions."""
        pairs = near.join(reps.select(F.col("id").alias("rep"), F.col("v").alias("c")), "rep").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        score = F.aggregate(F.zip_with("q", "c", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
        full = pairs.select("query_id", "rep", score.alias("score")).join(firsts, "rep").filter("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return full.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def settled(candidates: DataFrame, asked: DataFrame, name: str) -> DataFrame:
        """The answers to what is asked: where a candidate that was left out could be among a query's k, more of them are ranked."""
        done, wide = None, n
        while True:
            near = work.put(f"{name}-near-{wide}", met(candidates, asked, wide, work, f"{name}-{wide}"))
            answers = work.put(f"{name}-answers-{wide}", ranked(near))
            # all that was left out is below the last one's bound
            last = near.groupBy("query_id").agg(F.count("*").alias("met"), F.min("bound").alias("bound")).filter(F.col("met") >= wide)
            kth = answers.groupBy(F.col("query_id").alias("asker")).agg(F.count("*").alias("found"), F.min("score").alias("score"))
            open_ = work.put(f"{name}-open-{wide}", last.join(kth, F.col("query_id") == F.col("asker"), "left").filter((F.coalesce("found", F.lit(0)) < k) | (F.col("bound") >= F.col("score"))).select("query_id"))
            closed = answers.join(open_, "query_id", "left_anti")
            done = closed if done is None else done.unionByName(closed)
            left = open_.count()
            if not left:
                return done
            if left <= FEW:
                # each vector is shipped once for them, not to every table
                candidates, asked = everywhere(reps, 0, slices, 0), everywhere(queries.join(open_, F.col("id") == F.col("query_id"), "left_semi"), 1, slices, 0)
            else:
                asked = asked.join(open_, F.col("id") == F.col("query_id"), "left_semi")
            wide *= 4

    whole = lambda asked: settled(everywhere(reps, 0, slices, 0), everywhere(asked, 1, slices, 0), "exact")
    if probes is None:
        return whole(queries)
    candidates, asked = filed(reps, shape, slices), asking(queries, shape, slices, probes)
    if pool is not None:
        candidates, asked = candidates.union(everywhere(pool, 0, 1, TABLES * slices)), asked.union(everywhere(queries, 1, 1, TABLES * slices))
    answers = work.put("answers", settled(candidates, asked, "probed"))
    least = min(k, rows.count() - 1)
    done = answers.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("query_id")
    short = work.put("short", queries.join(done, F.col("id") == F.col("query_id"), "left_anti"), incompressible=True)
    if least < 1 or short.isEmpty():
        return answers
    return answers.join(done, "query_id", "left_semi").unionByName(whole(short))


def smallest(members: DataFrame, n: int) -> DataFrame:
    """(vec_id, rep) of the n smallest members of each rep: within salted parts first, so no task ranks a huge group."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")
    some = members.select("vec_id", "rep", part).withColumn("r", F.row_number().over(Window.partitionBy("rep", "part").orderBy("vec_id"))).filter(F.col("r") <= n).drop("r", "part")
    return some.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).filter(F.col("r") <= n).drop("r")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
