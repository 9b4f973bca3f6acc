"""Running totals in blocks, and names bound to the innermost scope, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from mutagrid.operators import joins, ordering, scans, scopes

def columns():
    return {"s": ("sum", F.col("x")), "n": ("count", F.lit(1)), "m": ("max", F.col("x")), "l": ("last", F.col("x")), "b": ("before", F.col("x"))}


def some_rows(n=3000, seed=1):
    """A key with nine tenths of the rows, a null key, null values and orders, ties and repeated rows."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), rng.choice([None, *range(40), *range(200)]), rng.choice([None, *range(-5, 60)]), rng.choice("uvw")) for _ in range(n)]
    return rows + rows[:200] + [("alone", None, None, None)]


def brute(rows):
    out, state = [], {}
    for k, o, x, y in sorted(rows, key=lambda r: [(v is not None, v) for v in r]):
        s, n, m, last, before = state.get(k, (None, 0, None, None, None))
        said = (k, o, x, y)
        both = lambda f, a, b: b if a is None else a if b is None else f(a, b)
        new = (both(lambda a, b: a + b, s, x), n + 1, both(max, m, x), last if x is None else x, x)
        out.append((*said, new[0], new[1], new[2], new[3], before))
        state[k] = new
    return out


@pytest.mark.parametrize("way", [scans.blocked, scans.windowed])
def test_running_values(spark, way):
    rows = some_rows()
    df = spark.createDataFrame(rows, "k string, o int, x long, _block string").repartition(5)
    got = way(df, ["k"], ["o"], columns())
    assert got.columns == ["k", "o", "x", "_block", *columns()]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))
    assert way(df.limit(0), ["k"], ["o"], columns()).count() == 0


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    got = scans.scanned(df, ["k"], ["id"], {"n": ("count", F.lit(1))}, most=1000)
    blocks = df.repartitionByRange(4, "k", "id").filter("k = 0").select(F.spark_partition_id()).distinct().count()
    assert blocks > 1 and got.filter("k = 0").agg(F.max("n"), F.count("*")).first() == (36_001, 36_001)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in scans.scanned(df, ["k"], ["id"], {"n": ("count", F.lit(1))})._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [10, 1 << 20])
def test_rules_on_hot_keys(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "MOST", most)
    rng = random.Random(2)
    rows = [("t", i, rng.choice("aab")) for i in range(500)] + [("u", 1, None), ("u", 2, None), ("u", 3, "x")]
    numbers, now = {}, {}
    for k, i, top in rows:
        now[k] = now[k] + (top != numbers[k, i - 1][1]) if k in now else 0
        numbers[k, i] = (now[k], top)
    got = ordering.row_breaks(spark.createDataFrame(rows, "k string, i int, top string").repartition(4), "k", ["i"], "top").collect()
    assert {(r.k, r.i): (r.row_no, r.top) for r in got} == numbers
    starts = sorted(rng.sample(range(1000), 60))
    left = spark.createDataFrame([("f", rng.randrange(1000), i) for i in range(400)] + [("g", 5, -1), (None, 3, -2)], "file string, offset long, id long").repartition(3)
    right = spark.createDataFrame([("f", s, i) for i, s in enumerate(starts)], "file string, offset long, line long")
    found = joins.as_of(left, right, ["file"], "offset", "line").collect()
    assert all(r.line == (max((i for i, s in enumerate(starts) if s <= r.offset), default=None) if r.file == "f" else None) for r in found) and len(found) == 402


def nested(rng, depth, start, end, out):
    """Random scopes within [start, end]."""
    if depth == 0 or end - start < 4:
        return
    cuts = sorted(rng.sample(range(start, end + 1), min(6, end - start)))
    for a, b in zip(cuts[::2], cuts[1::2]):
        out.append((a, b))
        if rng.random() < 0.2:
            out.append((a, b))
        nested(rng, depth - 1, a, b, out)


@pytest.mark.parametrize("most", [20, 1 << 20])
def test_references_are_bound_to_the_innermost_scope(spark, most):
    rng = random.Random(7)
    declared = []
    for file in ("f", "f2"):
        extents = []
        nested(rng, 5, 0, 900, extents)
        declared += [(file, rng.choice(["i", "i", "i", "j", None]), a, b, k) for k, (a, b) in enumerate(extents)] + [(file, "i", 5, 2, 10_000)]
    refs = [(rng.choice(["f", "f2", "f3", None]), rng.choice(["i", "i", "j", "k", None]), rng.choice([None, *range(-5, 910)]), n) for n in range(2000)]
    want = {n: max(((a, -b, k) for f, x, a, b, k in declared if at is not None and f == file and x == name and name is not None and a <= at <= b), default=(0, 0, None))[2] for file, name, at, n in refs}
    got = scopes.bound(spark.createDataFrame(refs, "file string, name string, at long, n long").repartition(4), spark.createDataFrame(declared, "file string, name string, start long, end long, id long"), ["file", "name"], "at", "id", most).collect()
    assert {r.n: r.declared_by for r in got} == want and len(got) == len(refs) and len(set(want.values())) > 20


def test_fields_and_methods_out_of_reach(spark):
    field = "file string, name string, start long, end long, id long"
    fields = spark.createDataFrame([("f", "a", 0, 100, 1), ("f", "b", 0, 100, 2), ("f", "c", 0, 100, 3), ("f", "d", 0, 100, 4), ("g", "a", 0, 100, 1)], field)
    hidden = spark.createDataFrame([("f", "b", 10, 20, 1), ("f", "d", 30, 40, 2)], field)
    methods = spark.createDataFrame([("f", "run", 10, 20, 1), ("f", "main", 30, 60, 2), ("f", "inner", 50, 55, 3)], "file string, method string, start long, end long, id long")
    # a: in reach; b: a parameter hides it; c: within main only; d: hidden and also in a method of a class within main
    refs = spark.createDataFrame([("f", "a", 12), ("f", "b", 15), ("f", "c", 35), ("f", "d", 33), ("f", "d", 52), ("h", "a", 1)], "file string, name string, at long")
    assert sorted((r.file, r.name) for r in scopes.unreferenced_fields(fields, hidden, methods, refs).collect()) == [("f", "b"), ("f", "c"), ("g", "a")]
    own = spark.createDataFrame([("f", "m", "int", 0, 100, 1), ("f", "m", "int", 40, 60, 2), ("f", "m", "", 0, 100, 3), ("f", "n", "int", 0, 100, 4)], "file string, name string, arg_types string, start long, end long, id long")
    calls = spark.createDataFrame([("f", "m", "int", 50), ("f", "m", "", 50), ("f", "n", "long", 3)], "file string, name string, arg_types string, at long")
    assert sorted(r.id for r in scopes.uncalled_methods(own, calls).collect()) == [1, 4]
