"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is a grade from 0 (worst) up. One vector of weights over hashed text
features is shared by all grades, and ordered thresholds cut its score:
P(grade >= k) = 1 / (1 + exp(threshold_k - score)). The expected grade is the sum
of these tail probabilities; the highest tail selects documents.

Features are the distinct lower-cased words of the whole text, hashed, and a few
hashed bins of what the words look like (length, share of distinct words, of
repeated neighbours, of words with symbols, of words in capitals). The model is
fitted here on a bounded sample of rated documents, ``MAX_FIT`` of them and
``FIT_BYTES`` of their features at most, drawn by a hash of their ids; every document is scored, in
Arrow batches, with the model of fixed size. The first threshold and the logarithms of
the gaps between them are what is fitted, so thresholds can't cross, and the fit
ends by a test of its gradient.

Defined results: a null text is an empty one; a very long one is read whole. Ratings that are null, or
whose document is missing, are not fitted; of several ratings of a document the lowest
counts. Without any rating the thresholds stay at their start and all scores are
0; an empty table has no rows. Repeated rows are scored alike, and texts of equal
features have equal scores (ties). Extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.llm.common import Workspace, hash_unit, slices, table

#: Hashed features; rated documents that are fitted at most, and bytes of their features; weight of the penalty.
BITS, MAX_FIT, FIT_BYTES, PENALTY = 17, 6000, 64 << 20, 1e-3
#: Steps of the optimiser at most, and the largest part of the gradient at its end.
PASSES, TOLERANCE = 2000, 1e-6
LOOKS = 5


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) of each score, for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of every feature of the texts, in row order."""
    from xxhash import xxh3_64_intdigest

    from mutagrid.llm.common import word_codes

    codes, offsets, words = word_codes(texts, lower=False)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    mask = (1 << BITS) - 1
    slot = np.fromiter((xxh3_64_intdigest(w.lower().strip(".,;:!?")) & mask for w in words), np.int64, len(words))
    pool = pa.array(words, pa.string())
    odd = pc.match_substring_regex(pool, r"[#*$%&|<>@{}\\^~=_]").to_numpy(zero_copy_only=False).astype(bool) if len(words) else np.zeros(0, bool)
    loud = pc.match_substring_regex(pool, r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$").to_numpy(zero_copy_only=False).astype(bool) if len(words) else np.zeros(0, bool)
    n, count = len(offsets) - 1, np.diff(offsets)
    one = np.unique(rows * (1 << BITS) + slot[codes]) if len(codes) else np.zeros(0, np.int64)
    distinct = np.bincount(one >> BITS, minlength=n)
    same = np.bincount(rows[1:][(codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])], minlength=n) if len(codes) else np.zeros(n)
    share = lambda x: np.ceil(10 * x / np.maximum(count, 1)).astype(np.int64)
    looks = [np.log2(count + 1).astype(np.int64), share(distinct), share(same), share(np.bincount(rows, odd[codes], n) if len(codes) else np.zeros(n)), share(np.bincount(rows, loud[codes], n) if len(codes) else np.zeros(n))]
    bins = np.stack([np.array([xxh3_64_intdigest(f"\n{k}:{v}") & mask for v in look.tolist()], np.int64) for k, look in enumerate(looks)], axis=1).reshape(n, LOOKS)
    all_rows = np.concatenate([one >> BITS, np.repeat(np.arange(n), LOOKS)])
    all_slots = np.concatenate([one & mask, bins.ravel()])
    order = np.argsort(all_rows, kind="stable")
    return all_rows[order], all_slots[order]


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """The first threshold, then each the one before plus a gap that is positive by construction."""
    return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def loss_and_gradient(params: np.ndarray, rows: np.ndarray, slots: np.ndarray, grades: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the penalty, and its gradient by weights, first threshold and logarithms of gaps."""
    n, w, free = len(grades), params[:size], params[size:]
    score = np.bincount(rows, w[slots], n)
    cuts = np.concatenate([[-np.inf], thresholds_of(free), [np.inf]])
    a, b = cuts[grades] - score, cuts[grades + 1] - score
    low, high = (1 / (1 + np.exp(-np.clip(c, -500, 500))) for c in (a, b))
    # the difference of the two, without cancellation far from the thresholds
    p = np.maximum(np.where(a > 0, 1 / (1 + np.exp(np.clip(a, -500, 500))) - 1 / (1 + np.exp(np.clip(b, -500, 500))), high - low), 1e-300)
    d_low, d_high = low * (1 - low) / p / n, high * (1 - high) / p / n
    by_cut = np.bincount(grades, d_low, len(cuts) - 1)[1:] - np.bincount(grades, d_high, len(cuts) - 1)[:-1]
    by_free = np.concatenate([[by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(free[1:])])
    by_weight = np.bincount(slots, (d_high - d_low)[rows], size) + PENALTY * w
    return float(-np.log(p).mean() + PENALTY / 2 * w @ w), np.concatenate([by_weight, by_free])


def fit(rows: np.ndarray, slots: np.ndarray, grades: np.ndarray, n_grades: int, size: int = 1 << BITS) -> Model:
    """Maximum likelihood with a quadratic penalty, by limited-memory BFGS until the gradient is below ``TOLERANCE``.

    The start has the thresholds that fit the grades' shares without features. No convergence is an error.
    """
    n = len(grades)
    if not n:
        return Model(np.zeros(size), np.linspace(-1.0, 1.0, n_grades - 1))
    above = np.array([(grades >= k).sum() for k in range(1, n_grades)])
    start = -np.log((above + 0.5) / (n - above + 0.5))
    gaps = np.maximum(np.diff(start), 1e-6)
    params = np.concatenate([np.zeros(size), start[:1], np.log(gaps)])
    loss, grad = loss_and_gradient(params, rows, slots, grades, size)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(PASSES):
        if np.abs(grad).max() < TOLERANCE:
            return Model(params[:size], thresholds_of(params[size:]))
        step, scales = grad.copy(), []
        for s, y in reversed(past):
            scales.append(s @ step / (s @ y))
            step -= scales[-1] * y
        if past:
            step *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), scale in zip(past, reversed(scales)):
            step += s * (scale - y @ step / (s @ y))
        slope, rate = grad @ step, 1.0 if past else min(1.0, 1.0 / np.abs(grad).sum())
        while True:
            new = params - rate * step
            new_loss, new_grad = loss_and_gradient(new, rows, slots, grades, size)
            if new_loss <= loss - 1e-4 * rate * slope or rate < 1e-12:
                break
            rate /= 2
        if rate < 1e-12:
            # no better loss can be told apart in double precision
            if np.abs(grad).max() < 100 * TOLERANCE:
                return Model(params[:size], thresholds_of(params[size:]))
            break
        s, y = new - params, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            past = [*past[-9:], (s, y)]
        params, loss, grad = new, new_loss, new_grad
    raise ArithmeticError(f"the fit has not converged: the gradient is {np.abs(grad).max():.1e}")


def fitted(docs: DataFrame, ratings: DataFrame, n_grades: int, seed: int = 1) -> Model:
    """The model of a bounded sample of ratings (doc_id, grade) of the docs (doc_id, text)."""
    draw = hash_unit(F.lit(seed), F.col("doc_id"))
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min(F.col("grade").cast("int")).alias("grade"))
    # MAX_FIT rows of two numbers at most, whatever the input: broadcast, so the texts are not shuffled
    sample = F.broadcast(rated.orderBy(draw, "doc_id").limit(MAX_FIT))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, slots = features(part.column("text"))
                ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
                lists = [slots[a:b].astype("<i4").tobytes() for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), pa.array(lists, pa.binary())], ["doc_id", "grade", "slots"])

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, slots binary")
    # an id may repeat in docs: again MAX_FIT rows at most, and of these, in the order of the draw, as many as FIT_BYTES hold
    found = Workspace(docs.sparkSession, "ordinal").put("found", found.withColumn("draw", draw).orderBy("draw", "doc_id", F.md5("slots")).limit(MAX_FIT))
    so_far = F.sum(F.octet_length("slots")).over(Window.orderBy("draw", "doc_id", F.md5("slots")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = found.select("grade", "slots", so_far.alias("so_far")).filter(F.col("so_far") <= FIT_BYTES).collect()
    lists = [np.frombuffer(r.slots, "<i4").astype(np.int64) for r in kept]
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists]) if lists else np.zeros(0, np.int64)
    return fit(rows, np.concatenate([*lists, np.zeros(0, np.int64)]), np.array([r.grade for r in kept], np.int64), n_grades)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, expected_grade, p_top): every document's score, expected grade and probability of the highest grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows, slots = features(part.column("text"))
                score = np.bincount(rows, model.weights[slots], part.num_rows)
                tails = model.tails(score)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(tails.sum(1)), pa.array(tails[:, -1])], ["doc_id", "score", "expected_grade", "p_top"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, expected_grade double, p_top double")


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 of low quality, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return scored(docs, fitted(docs, ratings, 3)).withColumn("kept", F.col("p_top") >= 0.5)
