"""The round loop as a stream: deadlines, late and repeated kills, restarts, and the size of its state."""

import datetime as dt
import random
import time

import pytest

from mutagrid.streaming import rounds, streams

LIMITS = rounds.Deadlines(target=60_000, test=4_000, keep=500_000, rounds=4)


def at(seconds):
    return None if seconds is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def event(target, opened, kind, second, mutant=None, test=None, since=None, round_=None):
    return (target, at(opened), kind, mutant, test, at(since), round_, at(second))


def put(spark, folder, rows):
    spark.createDataFrame(rows, rounds.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def ran(spark, folder, limits=LIMITS, late="0 seconds"):
    stream = streams.file_stream(spark, f"{folder}/in", spark.createDataFrame([], rounds.EVENTS).schema)
    query = rounds.round_loop(stream, limits, late).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def reports(spark, folder):
    rows = spark.read.schema(rounds.REPORTS).parquet(f"{folder}/out").collect()
    return sorted((tuple(r) for r in rows), key=str)


BATCHES = [
    [event("a", 0, "mutant", 0, "m1"), event("a", 0, "mutant", 0, "m2"), event("a", 0, "mutant", 1, "m3"), event("b", 1, "mutant", 1, "m1"), event("a", 0, "started", 2, test="t1"), event("a", 0, "killed", 3, "m1", "t1", 2, 1)],
    # t1 kills m1 again, t2 takes too long, and round 5 is beyond the last; b's test never ends
    [event("b", 1, "started", 5, test="t9"), event("a", 0, "killed", 8, "m1", "t1", 7, 2), event("a", 0, "killed", 9, "m2", "t2", 3, 2), event("a", 0, "killed", 10, "m3", "t3", 9, 5)],
    [event("a", 0, "killed", 12, "m2", "t4", 10, 3), event("c", 12, "mutant", 12, "x")],
    [event("a", 0, "finished", 20), event("a", 0, "killed", 21, "m3", "t5", 20, 3)],
    # b is too late, and so is what comes after
    [event("b", 1, "killed", 100, "m1", "t8", 99, 1), event("c", 12, "finished", 100)],
    [event("b", 1, "mutant", 130, "m7"), event("b", 1, "finished", 131), event("a", 0, "killed", 131, "m3", "t6", 131, 1)],
    [event("d", 300, "mutant", 300, "x")],
    [event("e", 400, "mutant", 400, "x")],
]
WANT = [
    ("a", "ROUND", None, None, 1, 1, 1), ("a", "ROUND", None, None, 3, 1, 2), ("a", "TEST_TIMED_OUT", None, "t2", None, None, None), ("a", "LIVE", "m3", None, None, None, None), ("a", "DONE", None, None, None, None, 2),
    ("b", "TEST_TIMED_OUT", None, "t9", None, None, None), ("b", "EXCLUDED", "m1", None, None, None, None), ("b", "TIMED_OUT", None, None, None, None, 0),
    ("c", "EXCLUDED", "x", None, None, None, None), ("c", "TIMED_OUT", None, None, None, None, 0), ("d", "EXCLUDED", "x", None, None, None, None), ("d", "TIMED_OUT", None, None, None, None, 0),
]


def fed(spark, folder, batches):
    for rows in batches:
        put(spark, folder, rows)
        time.sleep(0.02)


def test_deadlines_late_and_repeated_kills_and_a_restart(spark, tmp_path):
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    fed(spark, whole, BATCHES)
    held = ran(spark, whole)
    assert reports(spark, whole) == sorted(WANT, key=str)
    # settled targets hold one row each; the rest is the open one and its timers
    assert max(held) < 20 and held[-1] <= 12
    fed(spark, cut, BATCHES[:3])
    ran(spark, cut)
    fed(spark, cut, BATCHES[3:])
    ran(spark, cut)
    assert reports(spark, cut) == reports(spark, whole)


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_do_not_depend_on_batches(spark, tmp_path, seed):
    folder = str(tmp_path / "one")
    rows = [r for b in BATCHES for r in b]
    random.Random(seed).shuffle(rows)
    put(spark, folder, rows)
    ran(spark, folder)
    final = lambda found: [r for r in found if r[1] != "ROUND"]
    assert final(reports(spark, folder)) == final(sorted(WANT, key=str))


def test_state_follows_the_mutants_and_not_the_batches(spark, tmp_path):
    folder = str(tmp_path / "many")
    fed(spark, folder, [[event("a", 0, "mutant", 0, f"m{i}") for i in range(30)]] + [[event("a", 0, "killed", k, f"m{(k * j) % 30}", None, None, 1) for j in range(20)] for k in range(1, 8)])
    held = ran(spark, folder)
    assert max(held) - min(held) <= 1 and held[0] >= 30


def test_few_mutants_and_tests_are_one_value_and_one_timer(spark, tmp_path):
    folder = str(tmp_path / "few")
    put(spark, folder, [event("a", 0, "mutant", 0, f"m{i}") for i in range(12)] + [event("a", 0, "started", i, test=f"t{i}") for i in range(12)])
    assert max(ran(spark, folder)) <= 4


@pytest.mark.parametrize("few, held", [(0, 2), (1, 10_000), (2, 3)])
def test_many_mutants_and_tests_are_reported_alike(spark, tmp_path, monkeypatch, few, held):
    monkeypatch.setattr(rounds, "FEW", few)
    monkeypatch.setattr(rounds, "HELD", held)
    folder = str(tmp_path / "many")
    fed(spark, folder, BATCHES)
    ran(spark, folder)
    assert reports(spark, folder) == sorted(WANT, key=str)


def test_the_clock_ends_what_does_not_finish(spark, tmp_path):
    folder = str(tmp_path / "clock")
    put(spark, folder, [event("a", 0, "mutant", 0, "m"), event("a", 0, "started", 0, test="t"), event("b", 0, "mutant", 0, "m"), event("b", 0, "killed", 0, "m", "u", 0, 1), event("b", 0, "finished", 0)])
    stream = streams.file_stream(spark, f"{folder}/in", spark.createDataFrame([], rounds.EVENTS).schema)
    limits = rounds.Deadlines(target=6_000, test=500)
    query = rounds.round_loop(stream, limits, None).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="500 milliseconds").start()
    want = {("a", "TEST_TIMED_OUT"), ("a", "EXCLUDED"), ("a", "TIMED_OUT"), ("b", "ROUND"), ("b", "DONE")}
    stop = time.time() + 90
    while time.time() < stop and not (query.recentProgress and len(reports(spark, folder)) >= len(want)):
        time.sleep(1)
    time.sleep(2)
    query.stop()
    assert sorted(r[:2] for r in reports(spark, folder)) == sorted(want)
