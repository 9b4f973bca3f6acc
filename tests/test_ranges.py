"""Digests of files of any size, and the record container, in ranges."""

import hashlib
import random
import resource

import pytest

from mutagrid.sources import ranges, sinks


def test_a_file_over_two_gigabytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    size = (2 << 30) + 12_345
    with open(tmp_path / "in" / "big", "wb") as file:
        file.truncate(size)
        file.seek(size - 5)
        file.write(b"tail!")
    want = hashlib.sha256()
    for _ in range(size // (1 << 20)):
        want.update(bytes(1 << 20))
    want.update(bytes(size % (1 << 20) - 5) + b"tail!")
    got = sinks.file_digests(spark, str(tmp_path / "in")).first()
    assert (got.length, got.sha256) == (size, want.hexdigest())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert ranges.sha256_of(f"file:{tmp_path}/in/big") == want.hexdigest()
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_the_tree_digest_does_not_depend_on_tasks(spark, tmp_path):
    rng = random.Random(1)
    folder, held = tmp_path / "files", {}
    folder.mkdir()
    for name, n in (("b", 1), ("c", 100), ("d", 200), ("e", 12_345)):
        held[name] = rng.randbytes(n)
        (folder / name).write_bytes(held[name])
    (folder / "empty").write_bytes(b"")
    want = {k: (len(v), hashlib.sha256("".join(hashlib.sha256(v[i : i + 100]).hexdigest() for i in range(0, max(len(v), 1), 100)).encode()).hexdigest()) for k, v in held.items()}
    for n in (1, 7):
        files = ranges.listed(spark, str(folder)).repartition(n)
        assert {r.path.rpartition("/")[2]: (r.length, r.sha256) for r in ranges.tree_digest(files, 100).collect()} == want


@pytest.mark.parametrize("size", [50, 333, 1 << 20])
def test_records_round_trip_in_ranges(spark, tmp_path, size):
    rng = random.Random(2)
    records = [rng.randbytes(rng.choice([0, 1, 30, 127, 128, 700])) for _ in range(300)] + [None, b"MGRC"]
    folder = f"file://{tmp_path}/records"
    paths = ranges.write_records(spark.createDataFrame([(r if r is None else bytearray(r),) for r in records], "record binary").repartition(3), folder, block=400)
    assert len(paths) == 3
    rows = ranges.read_records(spark, folder, size).collect()
    assert sorted(bytes(r.record) for r in rows) == sorted(r for r in records if r is not None)
    assert len({(r.path, r.block, r.no) for r in rows}) == len(rows)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    folder = f"file://{tmp_path}/one"
    ranges.write_records(spark.range(2000).selectExpr("cast(repeat(cast(id as string), 20) as binary) as record").coalesce(1), folder, block=500)
    ranges.write_records(spark.createDataFrame([], "record binary"), f"file://{tmp_path}/none")
    found = ranges.read_records(spark, folder, 4000)
    assert found.selectExpr("path").distinct().count() == 1 and found.selectExpr("spark_partition_id() as p").distinct().count() > 1
    assert ranges.read_records(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("size", [70, 1 << 20])
@pytest.mark.parametrize("where", ["payload", "marker", "cut"])
def test_a_damaged_block_is_named(spark, tmp_path, size, where):
    folder = f"file://{tmp_path}/r"
    ranges.write_records(spark.range(60).selectExpr("cast(repeat('x', 30) as binary) as record").coalesce(1), folder, block=100)
    path = next((tmp_path / "r").glob("*.records"))
    raw = bytearray(path.read_bytes())
    # 20 bytes of header, blocks of 24 + 93: the fourth, or the last one
    block = 20 + 3 * 117 if where != "cut" else 20 + 19 * 117
    if where == "cut":
        raw = raw[:-3]
    else:
        raw[block + (30 if where == "payload" else 2)] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception, match=f"damaged block: .* at {block}"):
        ranges.read_records(spark, folder, size).collect()
