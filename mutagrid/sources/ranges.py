"""Files of any size read in ranges: digests with bounded memory, and a record container that many tasks read.

A file is opened where its bytes are needed, by its address, in a task; nothing holds more of it than a piece of ``PIECE`` bytes,
or a block. Ranges have a fixed size, so results don't depend on how many tasks there are.

The container is a header (``MAGIC``, then a marker of 16 bytes, different from file to file) and blocks: the marker, the size and the
CRC-32 of the payload, the payload. A payload is whole records, each behind its length (unsigned LEB128). A task looks for the first marker in its
range and reads all blocks that begin in it; as blocks follow each other, damage is found where a block's checksum fails, or where
no marker stands behind a block, and the error names file and offset.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are held at a time; of a leaf of the tree digest; of a range that one task reads; and of a block, about.
PIECE, LEAF, RANGE, BLOCK = 1 << 20, 8 << 20, 32 << 20, 1 << 20
MOST_TASKS = 10_000
MAGIC = b"MGRC"


def at(address: str):
    """A file system and the path in it; ``file:`` with any number of slashes is this machine's."""
    from pyarrow import fs

    if address.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", address)
    return fs.FileSystem.from_uri(address)


def opened(address: str):
    system, path = at(address)
    return system.open_input_file(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file below a path that holds something; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(path).select("path", "length")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows over as many tasks, up to ``MOST_TASKS``: they are small, but not the work that they stand for."""
    return rows.repartition(max(1, min(rows.count(), MOST_TASKS)), *rows.columns)


def sha256_of(address: str, start: int = 0, size: int | None = None) -> str:
    """The digest of a file or a range of it, piece by piece."""
    made = hashlib.sha256()
    with opened(address) as file:
        file.seek(start)
        left = file.size() - start if size is None else size
        while left > 0 and (piece := file.read(min(PIECE, left))):
            made.update(piece)
            left -= len(piece)
    return made.hexdigest()


def digested(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of (path, length): each file is one stream."""

    def run(batches):
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array([sha256_of(p) for p in paths], pa.string())], ["path", "length", "sha256"])

    return dealt(files.select("path", "length")).mapInArrow(run, "path string, length long, sha256 string")


def tree_digest(files: DataFrame, leaf: int | None = None) -> DataFrame:
    """(path, length, leaves, sha256) of (path, length): the digest of the digests of ranges of ``leaf`` bytes, which any number of tasks may read."""
    leaf = leaf or LEAF
    ranges = files.select("path", "length", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(leaf))).alias("no", "start"))

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("path").to_pylist(), batch.column("start").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sha256_of(p, start, leaf) for p, start in rows], pa.string())], [*batch.schema.names, "digest"])

    found = dealt(ranges).mapInArrow(run, "path string, length long, no int, start long, digest string")
    leaves = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "digest"))), lambda x: x["digest"]), "")
    return found.groupBy("path", "length").agg(F.count("*").alias("leaves"), F.sha2(leaves, 256).alias("sha256"))


def prefixed(record: bytes) -> bytes:
    out, n = bytearray(), len(record)
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out) + record


def records_in(payload: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(payload):
        size = shift = 0
        while True:
            byte = payload[i]
            i += 1
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        out.append(payload[i : i + size])
        i += size
    return out


def write_records(rows: DataFrame, folder: str, block: int | None = None) -> list[str]:
    """Writes the ``record`` column (binary; null ones are left out), a file for each partition, and returns the files' addresses. A task that runs again writes its file again."""
    most = block or BLOCK

    def run(batches):
        system, path = at(f"{folder}/part-{TaskContext.get().partitionId():05d}.records")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        marker, held, n = None, bytearray(), 0
        with system.open_output_stream(path, compression=None) as out:

            def close(payload: bytes) -> None:
                nonlocal marker
                if marker is None:
                    marker = hashlib.md5(payload + path.encode()).digest()
                    out.write(MAGIC + marker)
                out.write(marker + struct.pack("<II", len(payload), zlib.crc32(payload)) + payload)

            for batch in batches:
                for record in batch.column("record").to_pylist():
                    if record is None:
                        continue
                    one = prefixed(record)
                    if held and len(held) + len(one) > most:
                        close(bytes(held))
                        held.clear()
                    held += one
                    n += 1
            if held:
                close(bytes(held))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path.rpartition('/')[2]}"]), pa.array([n], pa.int64())], ["path", "n"])

    return sorted(r.path for r in rows.select("record").mapInArrow(run, "path string, n long").collect())


def blocks_of(address: str, start: int, stop: int):
    """(offset, payload) of the blocks that begin in [start, stop)."""
    with opened(address) as file:
        size = file.size()
        if not size:
            return
        head = file.read(20)
        if head[:4] != MAGIC or len(head) < 20:
            raise ValueError(f"no record container: {address}")
        marker = head[4:]
        place = found = max(start, 20)
        if start > 20:
            # from the range's start to the first marker; one may begin before the end of a piece
            tail, found = b"", -1
            while place < min(stop + 15, size):
                file.seek(place)
                piece = file.read(min(PIECE, stop + 15 - place))
                spot = (tail + piece).find(marker)
                if spot >= 0:
                    found = place - len(tail) + spot
                    break
                tail, place = (tail + piece)[-15:], place + len(piece)
            if found < 0:
                return
        place = found
        while place < size:
            file.seek(place)
            said = file.read(24)
            if said[:16] != marker or len(said) < 24:
                raise ValueError(f"damaged block: {address} at {place}")
            if place >= stop:
                return
            n, crc = struct.unpack("<II", said[16:])
            payload = file.read(n)
            if len(payload) < n or zlib.crc32(payload) != crc:
                raise ValueError(f"damaged block: {address} at {place}")
            yield place, payload
            place += 24 + n


def read_records(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(path, block, no, record) of every record below a path: its block's offset and its number there. A file is dealt to tasks by ranges of ``size`` bytes."""
    size = size or RANGE
    ranges = listed(spark, path).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size))).alias("start"))

    def run(batches):
        for batch in batches:
            for address, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                for place, payload in blocks_of(address, start, start + size):
                    found = records_in(payload)
                    yield pa.RecordBatch.from_arrays([pa.array([address] * len(found)), pa.array([place] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.binary())], ["path", "block", "no", "record"])

    return dealt(ranges).mapInArrow(run, "path string, block long, no int, record binary")
