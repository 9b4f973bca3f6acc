"""BPE encoding and decoding, with tree concatenation for long unsplit text.

Most texts are encoded whole. A long one is content-addressed and cut: where a
word ends before a single blank the pre-tokeniser always starts anew, so pieces
cut there are encoded apart and their ids simply follow each other. A stretch
without such a place is split by the pre-tokeniser's own pattern, and a piece of
it that is still long is halved again and again. The parts are rows of their own,
encoded in parallel wherever they land. Halves of one piece are then joined as a
tree: a window of tokens around the join is encoded again and grows until its
first token is the left side's and its last token the right side's. Byte pairs
merge by rank alone, so a sequence in which all neighbours are settled is the
encoding; both sides agreeing exactly makes all of them settled.

The vocabulary is the tokenizers library's JSON file, given by path. Stretches are
split by that library's own pre-tokeniser, and a part of characters on which the
pattern could be read in two ways (rare white space, scripts beyond Latin) is
encoded by the library itself: texts of any script are cut alike. A vocabulary that
isn't plain byte-level pairs is left to the library, whole texts at a time.

Defined results: a null text is an empty one, with no ids. Strings of special
tokens in a text become their ids, as the library does. Ids that are no token decode to
nothing; bytes that are no UTF-8 decode to U+FFFD. Of pairs that tie the first merges, as in the library. Repeated
rows and null ids keep their rows; an empty table has none. Extra columns stay, unless they
clash with ids, n_tokens or decoded in whatever case, which are replaced.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutagrid.llm.common import extended, slices, table, unused

#: Fixed value: the pattern of the byte-level pre-tokeniser.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes above which a text is cut, and about how long its parts are.
LONG, PART = 1 << 16, 1 << 14
#: Anything but these has its text encoded by the tokenizers library.
UNSURE = re.compile("[^\t\n\r\x20-\x7e¡-©«-ſ‐-‧€]")
#: A blank between characters that no engine takes for white space.
SOLID = "[^\\s\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\ufff0-\uffff]"
SAFE_CUT = re.compile(f"(?<={SOLID}) (?={SOLID})")


def byte_alphabet() -> dict[str, int]:
    """Byte of each character that the byte-level vocabulary writes bytes with."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encodes as the tokenizers library does with the vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, model = byte_alphabet(), spec["model"]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if all(c in alphabet for c in token)}
        self.path, self.special = path, {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content in self.special:
            ranks.pop(content.encode(), None)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        pre = spec["pre_tokenizer"]
        self.plain = (
            spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and ids == sorted(ids) and not model.get("ignore_merges") and len(ranks) == len(merges) + 256
            # a special token must neither hold a blank nor take those beside it
            and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec["added_tokens"])
        )
        self.core = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.plain else None
        self.breaks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*ranks.values(), *self.special.values()]) + 1
        of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self.token_bytes = pa.array([of.get(i, b"") for i in range(size)] + [b""], pa.large_binary())
        self.size = size

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation(), found.no_padding()
        return found

    def sure(self, text: str) -> bool:
        return self.plain and UNSURE.search(text) is None

    def encode(self, text: str) -> np.ndarray:
        if not self.sure(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        if self.breaks is None or not any(s in text for s in self.special):
            return self.core.encode_to_numpy(text, disallowed_special=())
        parts = [np.array([self.special[x]], "<u4") if x in self.special else self.core.encode_to_numpy(x, disallowed_special=()) for x in self.breaks.split(text) if x]
        return np.concatenate([*parts, np.zeros(0, "<u4")]).astype("<u4")

    def encode_bytes(self, piece: bytes) -> np.ndarray:
        """Of bytes that the pattern doesn't split."""
        return np.array(self.core._encode_single_piece(piece), "<u4")

    def bytes_of(self, ids: np.ndarray) -> pa.Array:
        ids = np.where(ids < self.size, ids, self.size)
        return pc.take(self.token_bytes, pa.array(ids.astype(np.int64)))

    def cut(self, text: str) -> list["Part"]:
        """The text's parts, in order."""
        out: list[Part] = []
        start = 0
        while start < len(text):
            at = SAFE_CUT.search(text, start + PART)
            end = at.start() if at else len(text)
            if end - start <= 2 * PART:
                out.append(Part(text[start:end].encode()))
            else:
                self.cut_stretch(text[start:end], out)
            start = end
        return out

    def cut_stretch(self, stretch: str, out: list["Part"]) -> None:
        """The parts of a long stretch without a safe cut: its pieces, many short ones together, a long one halved."""
        run: list[bytes] = []

        def flush():
            if run:
                out.append(Part(b"".join(run), [len(x) for x in run]))
                run.clear()

        for text in self.breaks.split(stretch) if self.breaks else [stretch]:
            if text in self.special:
                flush()
                out.append(Part(text.encode()))
                continue
            size = 0
            for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
                raw = text[a:b].encode()
                if len(raw) > PART:
                    flush()
                    halves(raw, out)
                    continue
                if size + len(raw) > PART:
                    flush()
                    size = 0
                run.append(raw)
                size += len(raw)
            flush()

    def encode_part(self, raw: bytes, lengths: list[int]) -> np.ndarray:
        if not lengths:
            return self.encode(raw.decode())
        ends = np.cumsum([0, *lengths]).tolist()
        return np.concatenate([self.encode_bytes(raw[a:b]) for a, b in zip(ends, ends[1:])])


@dataclass
class Part:
    """Bytes of whole text, or of pieces of the given lengths; ``follows`` continues the piece of the part before."""

    raw: bytes
    lengths: list[int] = field(default_factory=list)
    follows: bool = False


def halves(raw: bytes, out: list[Part]) -> None:
    """The piece halved until its parts are short; all but the first continue the one before."""
    n = 1
    while len(raw) / n > PART:
        n *= 2
    edges = [len(raw) * k // n for k in range(n + 1)]
    out += [Part(raw[a:b], [b - a], k > 0) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def join_halves(codec: Codec, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Encoding of two neighbouring parts of one piece from their encodings."""
    if not len(left) or not len(right):
        return np.concatenate([left, right])
    width = 4
    while True:
        a, b = left[-width:], right[:width]
        window = codec.encode_bytes(b"".join(codec.bytes_of(np.concatenate([a, b])).to_pylist()))
        whole_left, whole_right = width >= len(left), width >= len(right)
        if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]) and (len(window) > 1 or (whole_left and whole_right)):
            return np.concatenate([left[: len(left) - len(a)], window, right[len(b) :]])
        width *= 2


def join_tree(codec: Codec, parts: list[np.ndarray]) -> np.ndarray:
    while len(parts) > 1:
        parts = [join_halves(codec, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


@functools.lru_cache(maxsize=4)
def codec_of(path: str) -> Codec:
    return Codec(path)


def decoded(codec: Codec, ids: list[np.ndarray]) -> pa.Array:
    """The texts of the id sequences."""
    flat = codec.bytes_of(np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64))
    ends = np.cumsum([0, *map(len, ids)])
    offsets = (np.frombuffer(flat.buffers()[1], "<i8")[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64))[ends]
    data = flat.buffers()[2] or pa.py_buffer(b"")
    texts = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), data])
    try:
        return texts.cast(pa.string())
    except (pa.ArrowInvalid, UnicodeDecodeError):
        return pa.array([b.decode("utf-8", "replace") for b in texts.to_pylist()], pa.string())


def packed(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())


def encode_long(texts: DataFrame, path: str) -> DataFrame:
    """(key, ids) of (key, text), cut, encoded in parallel and joined; ids packed as little-endian 32-bit numbers."""

    def cut(batches):
        codec = codec_of(path)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                parts = codec.cut(text) if codec.plain else [Part(text.encode())]
                for start in range(0, len(parts), 256):
                    some = parts[start : start + 256]
                    columns = [pa.array([key] * len(some)), pa.array(range(start, start + len(some)), pa.int32()), pa.array([p.lengths for p in some], pa.list_(pa.int32())), pa.array([p.follows for p in some]), pa.array([p.raw for p in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "no", "lengths", "follows", "part"])

    def encode(batches):
        codec = codec_of(path)
        for batch in batches:
            ids = [codec.encode_part(raw, lengths) for raw, lengths in zip(batch.column("part").to_pylist(), batch.column("lengths").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), batch.column("follows"), packed(ids)], ["key", "no", "follows", "ids"])

    def join(group: pa.Table) -> pa.Table:
        codec, group = codec_of(path), group.sort_by("no")
        runs: list[list[np.ndarray]] = []
        for raw, follows in zip(group["ids"].to_pylist(), group["follows"].to_pylist()):
            one = np.frombuffer(raw, "<u4")
            runs[-1].append(one) if follows else runs.append([one])
        ids = np.concatenate([*[join_tree(codec, run) for run in runs], np.zeros(0, "<u4")])
        return pa.table({"key": group["key"][:1], "ids": packed([ids])})

    parts = texts.mapInArrow(cut, "key string, no int, lengths array<int>, follows boolean, part binary")
    encoded = parts.repartition("key", "no").mapInArrow(encode, "key string, no int, follows boolean, ids binary")
    return encoded.groupBy("key").applyInArrow(join, "key string, ids binary")


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows with ids (packed little-endian unsigned 32-bit numbers), n_tokens and decoded, the ids' text again."""
    kept = [c for c in df.columns if c.lower() not in ("ids", "n_tokens", "decoded")]
    whole, key = unused([*kept, "ids", "n_tokens", "decoded"], "_text", "_key")
    rows = df.select(*kept).withColumn(whole, F.coalesce(F.col(text).cast("string"), F.lit("")))
    is_long = F.octet_length(whole) > LONG
    others = [c for c in kept if c != text]
    schema = extended(rows.select(*others).schema, **{whole: "string"}, ids="binary", decoded="string")

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            for part in slices(batch, whole):
                ids = [codec.encode(t) for t in part.column(whole).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], part.column(whole), packed(ids), decoded(codec, ids)], [*others, whole, "ids", "decoded"])

    def decode(batches):
        codec = codec_of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ids"), decoded(codec, [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()])], ["key", "ids", "decoded"])

    short = rows.filter(~is_long).select(*others, whole).mapInArrow(run, schema)
    longs = rows.filter(is_long).withColumn(key, F.sha2(whole, 256))
    once = longs.groupBy(F.col(key).alias("key")).agg(F.first(whole).alias("text"))
    answers = encode_long(once, path).mapInArrow(decode, "key string, ids binary, decoded string").withColumnRenamed("key", key)
    both = short.unionByName(longs.join(answers, key).select(*others, whole, "ids", "decoded"))
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return both.select(*[F.col(whole).alias(c) if c == text else F.col(c) for c in kept], "ids", n_tokens, "decoded")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with decoded, the text of packed ids; null ids decode to an empty text."""

    def run(batches):
        codec = codec_of(path)
        for batch in batches:
            texts = decoded(codec, [np.frombuffer(x or b"", "<u4") for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    rows = df.select(*[c for c in df.columns if c.lower() != "decoded"])
    return rows.mapInArrow(run, extended(rows.schema, decoded="string"))


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()))


def bpe_unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters of fifty documents at a time as one piece that nothing splits, encoded and decoded: halves and joins on every row.

    The fixed number of documents bounds a row; ids are unique here, so the order is defined.
    """
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z]", "")
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 50).cast("long").alias("doc_id"))
    pieces = rows.agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("i"), letters.alias("t")))).alias("ts"))
    return encode(pieces.select("doc_id", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("text")), vocabulary()).select("doc_id", F.length("decoded").cast("long").alias("n_chars"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


UNSPLIT_SQL = """SELECT doc_id // 50 AS doc_id, sum(length(t))::BIGINT AS n_chars, sha256(string_agg(t, '' ORDER BY i)) AS decoded_sha256
FROM (SELECT doc_id, doc_id AS i, regexp_replace(coalesce(text, ''), '[^a-z]', '', 'g') AS t FROM documents) GROUP BY 1"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as token ids, with the digests of ids and decoded text.

    It needs the columns of documents and is the last stage: of them the id, lang and source stay, the text and all others go.
    """
    rows = encode(docs, vocabulary())
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
