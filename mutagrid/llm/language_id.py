"""Language identification by cross-parsing entropy.

Each language has a bounded sample of labelled text and its suffix automaton, which
knows every substring of the sample. A text is parsed against each automaton from
left to right: a phrase is the longest match from where the last one ended (or one byte, where
nothing matches). Text of the sample's language has long matches, so few phrases; their
number times the logarithm of the sample's size, by the text's length, estimates
the cross entropy. The language that needs least wins.

Samples are windows of distinct texts, chosen by hashes, at most ``pieces`` a language and ``total``
of all (more languages have smaller samples), so automata have a fixed size and are sent to the workers. They are
built on executors, one language a group. Texts are scored where they are read, never shuffled.

Text is parsed as UTF-8 bytes in lower case; runs of ASCII characters other than letters are
one space. A phrase also ends where ``SEGMENT`` bytes end, so that the segments of a batch are parsed
side by side, a byte a step, for all languages; whole texts count, of any length.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is all text where no
language was learned. The score is 1 - best / second best estimate: 0 where two tie (the first name wins), 1 with
a single language. A null id is an empty one for the split into folds. Repeated rows have equal
results; copies are in a sample once. Other columns are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.llm.common import Workspace, slices, table

#: Bytes of a text that are parsed as one piece.
SEGMENT = 1024
#: Of each language so many times the wanted distinct texts are looked at, so that enough are left.
SPARE = 4
#: Bytes that are letters in lower case or parts of other characters; all others are a space.
KEPT = np.full(256, ord(" "), np.uint8)
KEPT[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
KEPT[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class CrossParsing:
    """Bound of the sample: windows of ``chars`` code points, ``pieces`` of a language, ``total`` of all."""

    chars: int = 256
    pieces: int = 256
    total: int = 4096


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes as they are parsed, and the offsets of each text."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = KEPT[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    ends -= ends[0]
    blank = flat == ord(" ")
    keep = np.ones(len(flat), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[ends[:-1][ends[:-1] < len(flat)]] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """The transitions of every state; state 0 has read nothing."""
    moves, link, longest = [{}], [-1], [0]
    last = 0
    for byte in data:
        state = len(moves)
        moves.append({}), link.append(0), longest.append(longest[last] + 1)
        at = last
        while at >= 0 and byte not in moves[at]:
            moves[at][byte] = state
            at = link[at]
        if at >= 0:
            to = moves[at][byte]
            if longest[to] == longest[at] + 1:
                link[state] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to])), link.append(link[to]), longest.append(longest[at] + 1)
                while at >= 0 and moves[at].get(byte) == to:
                    moves[at][byte] = twin
                    at = link[at]
                link[to] = link[state] = twin
        last = state
    return moves


def edges_of(pieces: list[str]) -> dict[str, bytes | int]:
    """The automaton of the pieces as packed arrays: transitions in the order of state and byte. A byte that no text has keeps pieces apart."""
    flat, ends = normal(pa.array(pieces, pa.string()))
    moves = suffix_automaton(b"\0".join(flat[a:b].tobytes() for a, b in zip(ends, ends[1:])))
    rows = [(state, byte, to) for state, found in enumerate(moves) for byte, to in sorted(found.items())]
    state, byte, to = np.array(rows, np.int64).reshape(-1, 3).T
    pack = lambda x, kind: zlib.compress(x.astype(kind).tobytes(), 1)
    return {"size": int(ends[-1]), "states": len(moves), "state": pack(state, "<i4"), "byte": pack(byte, "u1"), "to": pack(to, "<i4")}


class Automata:
    """The languages' automata in one table: per state four words of 64 bits say which bytes go on, and where their targets are."""

    def __init__(self, found: list[dict]):
        self.langs = [x["lang"] for x in found]
        self.weight = np.log2(np.array([max(2, x["size"]) for x in found], float))
        states, bytes_, targets, roots, n = [], [], [], [], 0
        unpack = lambda raw, kind: np.frombuffer(zlib.decompress(raw), kind).astype(np.int64)
        for x in found:
            roots.append(n)
            states.append(unpack(x["state"], "<i4") + n), bytes_.append(unpack(x["byte"], "u1")), targets.append(unpack(x["to"], "<i4") + n)
            n += x["states"]
        state, byte, self.targets = (np.concatenate([*xs, np.zeros(1, np.int64)]) for xs in (states, bytes_, targets))
        word, bit = (state * 4 + (byte >> 6))[:-1], np.left_shift(np.uint64(1), (byte & 63).astype(np.uint64))[:-1]
        self.words = np.zeros(4 * n, np.uint64)
        np.bitwise_or.at(self.words, word, bit)
        self.base = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=4 * n))])[:-1].astype(np.int32)
        self.targets = self.targets.astype(np.int32)
        self.roots = np.array(roots, np.int32)
        # where a phrase goes after its first byte
        self.first = np.tile(self.roots, (256, 1))
        for i, root in enumerate(roots):
            own = state[:-1] == root
            self.first[byte[:-1][own], i] = self.targets[:-1][own]

    def phrases(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(text, language): the number of phrases."""
        sizes = np.diff(ends)
        parts = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = ends[:-1][text] + number * SEGMENT
        length = np.minimum(SEGMENT, ends[1:][text] - start)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.tile(self.roots, (len(start), 1))
        count = np.zeros(state.shape, np.int32)
        alive = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")
        one = np.uint64(1)
        for step, n in enumerate(alive.tolist()):
            if not n:
                break
            byte = flat[start[:n] + step]
            bit = np.left_shift(one, (byte & 63).astype(np.uint64))[:, None]
            now = state[:n]
            spot = now * 4 + (byte >> 6).astype(np.int32)[:, None]
            word = self.words[spot]
            hit = (word & bit) != 0
            to = self.targets[self.base[spot] + np.bitwise_count(word & (bit - one))]
            # a phrase begins where none is open, and where the open one can't go on
            count[:n] += (now == self.roots) | ~hit
            state[:n] = np.where(hit, to, self.first[byte])
        out = np.zeros((len(sizes), len(self.roots)), np.int64)
        np.add.at(out, text[order], count)
        return out

    def judged(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its score."""
        flat, ends = normal(texts)
        known = lettered(texts, flat, ends)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = self.phrases(flat, ends) * self.weight
        best = cost.argmin(1)
        low = cost.min(1)
        second = np.partition(cost, 1, axis=1)[:, 1] if cost.shape[1] > 1 else np.full(len(low), np.inf)
        score = np.where(known, 1 - low / np.where(known, np.maximum(second, 1e-300), 1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], score


def lettered(texts: pa.Array, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each text has a letter, of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum((flat >= ord("a")) & (flat <= ord("z")))])
    out = ascii_letters[ends[1:]] > ascii_letters[ends[:-1]]
    for i in np.flatnonzero(~out & (np.diff(ends) > 0)).tolist():
        out[i] = any(c.isalpha() for c in texts[i].as_py())
    return out


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def sample(labelled: DataFrame, rule: CrossParsing) -> DataFrame:
    """(lang, rank, piece): windows of the distinct texts with the least hashes of each language of (lang, text)."""
    rows = labelled.filter("lang is not null").filter(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("hash"))
    # written, its size is known, and the texts are joined where they are read
    known = Workspace(labelled.sparkSession, "languages").put("known", rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts")))
    number = known.count()
    pieces = max(1, min(rule.pieces, rule.total // max(1, number)))
    # what is ranked is some SPARE * pieces windows a language, however many texts there are; few texts have several each
    drawn = F.pmod("hash", F.lit(1 << 40)) < F.lit(float(SPARE * pieces << 40)) / F.col("texts")
    texts = rows.join(known, "lang").filter(drawn).dropDuplicates(["lang", "hash"])
    tiles = F.ceil(F.length("text") / rule.chars)
    several = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.ceil(pieces / F.col("texts")), tiles) - 1))
    windows = texts.withColumn("no", several).withColumn("tile", F.pmod(F.xxhash64("hash") + F.col("no"), tiles).cast("int"))
    first = Window.partitionBy("lang").orderBy("no", "hash")
    windows = windows.select("lang", "no", "hash", F.substr("text", F.col("tile") * rule.chars + 1, F.lit(rule.chars)).alias("piece"))
    return windows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= pieces).select("lang", "rank", "piece")


def learned(labelled: DataFrame, rule: CrossParsing = CrossParsing()) -> list[dict]:
    """The automaton of each language of (lang, text), in the order of their names. Their size is bounded by the sample's."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        return pa.Table.from_pylist([{"lang": group["lang"][0].as_py(), **edges_of(group["piece"].to_pylist())}], schema)

    schema = pa.schema([("lang", pa.string()), ("size", pa.int64()), ("states", pa.int64()), ("state", pa.binary()), ("byte", pa.binary()), ("to", pa.binary())])
    found = sample(labelled, rule).groupBy("lang").applyInArrow(build, "lang string, size long, states long, state binary, byte binary, to binary")
    return sorted(({k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.asDict().items()} for r in found.toLocalIterator()), key=lambda x: x["lang"].encode())


def identified(docs: DataFrame, automata: list[dict], text: str = "text") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(automata)

    def run(batches):
        known = Automata(shared.value)
        for batch in batches:
            for part in slices(batch, text):
                langs, score = known.judged(part.column(text))
                rest = [c for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], pa.array(langs, pa.string()), pa.array(score)], [*rest, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def languages(docs: DataFrame, rule: CrossParsing = CrossParsing()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; the automata know nothing of the fold that is held out."""
    text = F.col("text").cast("string").alias("text")
    labelled = docs.filter(fold(F.col("doc_id")) != 2).select(F.col("lang").cast("string").alias("lang"), text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 2).alias("held_out"), text)
    return identified(rows, learned(labelled, rule))
