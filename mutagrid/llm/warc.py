"""WARC: whole-file gzip archives normalised to one member per record, with a sidecar offset index.

``write_archives`` writes each partition's records as archives that are one gzip
stream each. ``normalise`` inflates such a stream once, from start to end, and
writes every record again as a gzip member of its own; a sidecar file beside the
archive lists each record's offset and length, and the same index comes back as
rows. ``read_records`` seeks to single members by that index.

Records whose payloads are equal (by SHA-1) are written once: that of the largest
page_id is the response, the others are revisits that refer to it. Files go to
the shared folder, under names of their own for every attempt; only the attempt
that ends well is named in the written manifest, so a lost executor leaves
nothing but an orphan. Archives are dealt to tasks one by one, for normalising
and for reading; the normaliser and the reader stream, and hold one chunk of a payload.
A stream that is cut off, a record that isn't closed and a payload that isn't
what its digest says are errors.

Defined results: null html is an empty payload. A null url is left out of the
record. Rows with a null page_id are records without a number. Rows that repeat
a page_id and its payload are all responses (ties). Very long payloads are records like
others. Extra columns are not archived, whatever their names. An empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mutagrid.llm.common import Workspace, slices, table

#: Uncompressed bytes after which a partition begins another archive; level of compression; bytes of a chunk.
ARCHIVE_BYTES, LEVEL, CHUNK = 32 << 20, 6, 1 << 18
#: Least payload bytes for which equal payloads are written once.
LEAST_BYTES = 0
CRLF = b"\r\n"
PAGE = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def files(uri: str):
    """The file system of a uri, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_of(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> tuple[bytes, bytes]:
    """(header, block) of a response, or of a revisit of another page's."""
    name = "" if page_id is None else str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PAGE}{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base32_of(sha1_hex)}")
    if refers_to is None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
        block = http + CRLF
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + CRLF + CRLF, block


def decided(pages: DataFrame, work: Workspace) -> DataFrame:
    """The pages (page_id, url, html) with sha1 and refers_to: null for a response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumn("sha1", F.sha1("html"))
    same = rows.filter(F.octet_length("html") >= LEAST_BYTES).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    same = work.put("same", same)  # its size is known then: broadcast only where small
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(same, "sha1", "left").select("page_id", "url", "html", "sha1", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """One row (path, n_records) for each archive that the decided pages are written to, each one gzip stream of about ``most`` bytes."""

    def run(batches):
        out = squeeze = None
        made, size, n = "", 0, 0

        def close():
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([made]), pa.array([n], pa.int64())], ["path", "n_records"])

        for part in (part for batch in batches for part in slices(batch, "html")):
            for page_id, url, html, sha1, refers_to in zip(*[part.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to")]):
                if out is None:
                    made, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    system, path = files(made)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out, squeeze = system.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                for piece in (*record(page_id, url, html, sha1, refers_to), CRLF + CRLF):
                    size += len(piece)
                    out.write(squeeze.compress(piece))
                n += 1
                if size >= most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return pages.mapInArrow(run, "path string, n_records long")


class Inflated:
    """A gzip file as one stream of its inflated bytes, whether of one member or many; a member that is cut off is an error."""

    def __init__(self, file):
        self.file, self.rest, self.held, self.engine, self.open = file, b"", bytearray(), zlib.decompressobj(31), False

    def fill(self) -> bool:
        while True:
            raw = self.rest or self.file.read(CHUNK)
            if not self.open:
                raw = raw.lstrip(b"\0")  # members may be padded
                if not raw:
                    if not self.file_ended():
                        continue
                    return False
                self.engine, self.open = zlib.decompressobj(31), True
            elif not raw and not self.engine.unconsumed_tail:
                raise ValueError("the archive is cut off")
            got = self.engine.decompress(raw, 4 * CHUNK)
            self.rest = self.engine.unconsumed_tail or self.engine.unused_data
            self.open = not self.engine.eof
            if got:
                self.held += got
                return True

    def file_ended(self) -> bool:
        self.rest = self.file.read(CHUNK)
        return not self.rest

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to and with the mark; None at the end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.fill():
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
        got = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return got

    def chunks(self, n: int):
        while n:
            if not self.held and not self.fill():
                raise ValueError("the archive ends within a record")
            got = bytes(self.held[:n])
            del self.held[: len(got)]
            n -= len(got)
            yield got


def fields(header: bytes) -> dict[str, str]:
    """Named fields of a header, in lower case."""
    lines = header.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def page_of(uri: str) -> int | None:
    number = uri.strip("<>").removeprefix(PAGE)
    return int(number) if re.fullmatch(r"-?\d+", number) else None


INDEX = "path string, no long, offset long, length long, page_id long, record_type string, payload_digest string, refers_to long"


def normalise(archives: DataFrame) -> DataFrame:
    """The offset index of the archives (path, ...) written again with one gzip member a record, sidecars beside them."""

    def run(batches):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                system, path = files(source)
                made = f"{source.removesuffix('.warc.gz')}-{uuid.uuid4().hex}.records.warc.gz"
                target = files(made)[1]
                rows: list[tuple] = []
                with system.open_input_stream(path, compression=None) as raw, system.open_output_stream(target, compression=None) as out:
                    stream, offset = Inflated(raw), 0
                    while (header := stream.until(CRLF + CRLF)) is not None:
                        named = fields(header.lstrip(CRLF))
                        squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        out.write(squeeze.compress(header.lstrip(CRLF)))
                        for part in stream.chunks(int(named["content-length"])):
                            out.write(squeeze.compress(part))
                        if b"".join(stream.chunks(4)) != CRLF + CRLF:
                            raise ValueError(f"{source}: record {len(rows)} isn't closed where its length says")
                        out.write(squeeze.compress(CRLF + CRLF) + squeeze.flush())
                        end = out.tell()
                        refers = page_of(named["warc-refers-to"]) if "warc-refers-to" in named else None
                        rows.append((made, len(rows), offset, end - offset, page_of(named.get("warc-record-id", "")), named.get("warc-type"), named.get("warc-payload-digest", "").removeprefix("sha1:"), refers))
                        offset = end
                with system.open_output_stream(target.removesuffix(".warc.gz") + ".idx", compression=None) as side:
                    side.write("".join(f"{r[1]} {r[2]} {r[3]} {'' if r[4] is None else r[4]}\n" for r in rows).encode())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 8, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], [x.split()[0] for x in INDEX.split(", ")])

    return dealt(archives.select("path")).mapInArrow(run, INDEX)


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt by path to as many tasks as there are archives: paths are short and archives long, so nothing may put many in one task."""
    n = max(1, rows.select("path").distinct().count())
    return rows.repartition(n, "path")


class Member:
    """Some bytes of an open file, read to their end and no further."""

    def __init__(self, file, offset: int, length: int):
        self.file, self.left = file, length
        file.seek(offset)

    def read(self, n: int) -> bytes:
        got = self.file.read(min(n, self.left))
        self.left -= len(got)
        return got


RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index lists, each read by a seek to its member; a response's payload must have its digest."""

    def run(batches):
        held, file = None, None
        for batch in batches:
            out: list[tuple] = []
            for path, offset, length in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length")]):
                if path != held:
                    if file is not None:
                        file.close()
                    system, inner = files(path)
                    held, file = path, system.open_input_file(inner)
                stream = Inflated(Member(file, offset, length))
                named = fields(stream.until(CRLF + CRLF))
                left = int(named["content-length"]) - len(stream.until(CRLF + CRLF)) if named["warc-type"] != "revisit" else 0
                sha1, kept = hashlib.sha1(), []
                for chunk in stream.chunks(left):
                    sha1.update(chunk)
                    if payloads:
                        kept.append(chunk)
                revisit, digest = named["warc-type"] == "revisit", named["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and base64.b32encode(sha1.digest()).decode() != digest:
                    raise ValueError(f"{path} at {offset}: the payload isn't what its digest says")
                refers = page_of(named["warc-refers-to"]) if revisit else None
                out.append((page_of(named["warc-record-id"]), named.get("warc-target-uri"), named["warc-type"], b"".join(kept) if payloads else None, None if revisit else left, digest, refers))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, kinds)], [x.split()[0] for x in RECORDS.split(", ")])

    return dealt(index.select("path", "offset", "length")).sortWithinPartitions("path", "offset").mapInArrow(run, RECORDS)


def archived(spark: SparkSession, pages: DataFrame, work: Workspace | None = None) -> DataFrame:
    """The pages written, normalised and read back, without the payloads; a revisit has the bytes of what it refers to."""
    work = work or Workspace(spark, "warc")
    written = work.put("written", write_archives(decided(pages, work), f"{work.root}/archives"))
    index = work.put("index", normalise(written))
    records = work.put("records", read_records(index, payloads=False))
    seen = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload_bytes").alias("bytes_there"))
    seen = seen.join(records.select("refers_to", "payload_digest").filter("refers_to is not null").distinct(), ["refers_to", "payload_digest"]).distinct()
    both = records.join(seen, ["refers_to", "payload_digest"], "left")
    return both.select("page_id", F.coalesce("payload_bytes", "bytes_there").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: Base32 of SHA-1: five hexadecimal digits are four letters.
SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
d AS (SELECT page_id, payload_bytes, x, list_transform(range(8), lambda i: ('0x' || substr(x, (5 * i + 1)::BIGINT, 5))::BIGINT) AS v, max(page_id) FILTER (payload_bytes >= {LEAST_BYTES}) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(flatten(list_transform(v, lambda n: [n >> 15, (n >> 10) & 31, (n >> 5) & 31, n & 31])), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k + 1, 1)), '') AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d"""
