import pytest
from pyspark.sql import functions as F

from mutagrid import schemas
from mutagrid.operators import aggregates, class_rules, joins, lineage, ordering, rules, selection, sets, sketches
from mutagrid.plans import catalog


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_scores_and_suite(spark):
    kills = spark.createDataFrame([("t", "A", str(m), True, 1) for m in (1, 2, 3)] + [("t", "B", "3", True, 1), ("t", "C", "4", True, 1), ("t", "A", "5", False, 1)], schemas.KILLS)
    kills = kills.withColumn("admitted", F.lit(True)).withColumn("equivalent", F.lit(None).cast("boolean"))
    one = aggregates.mutation_scores(kills, [], ["target", "mutant_id"], F.lit(False), exclude_equivalent=True).first()
    assert (one.killed, one.executable, one.executable_score, one.end_to_end_score) == (4, 5, 0.8, 0.8)
    assert rows(aggregates.greedy_suites(kills, "target", "test_id", "mutant_id")) == [("t", "A", 0, 3), ("t", "C", 1, 1)]
    by_test, by_mutant = aggregates.kill_index(kills, "test_id", "mutant_id")
    assert {r.test_id: r.mutants for r in by_test.collect()} == {"A": ["1", "2", "3"], "B": ["3"], "C": ["4"]}
    assert {r.mutant_id: r.tests for r in by_mutant.collect()}["3"] == ["A", "B"]
    assert sets.live(kills.select("mutant_id").distinct(), kills.filter("failed"), None, ["mutant_id"]).collect()[0].mutant_id == "5"


def test_coverage_with_a_missing_report(spark):
    targets = spark.createDataFrame([("t1",), ("t2",)], "target string")
    states = spark.createDataFrame([("t1", "DONE")], schemas.TARGETS)
    reports = spark.createDataFrame([("t1", 1, 9, 3, 1, 1, 1, None, None)], schemas.LINE_COVERAGE)
    joined = joins.with_reports(targets, states, reports, "target")
    assert rows(joined, "target", "state") == [("t1", "DONE"), ("t2", "MISSING")]
    one = aggregates.micro_coverage(joined).first()
    assert (one.coverage_available_count, one.coverage_missing_count, one.line_covered_ratio, one.branch_covered_ratio) == (1, 1, 0.75, 0.5)
    none = aggregates.micro_coverage(joined.filter("target = 't2'")).first()
    assert none.line_covered_ratio is None and none.targets == 1


def test_only_the_published_execution_counts(spark):
    runs = spark.createDataFrame([("r", "five", 5000, 231), ("r", "ten", 10000, 118)], schemas.EXECUTIONS)
    one = aggregates.published_totals(runs, spark.createDataFrame([("r", "ten")], schemas.LATEST)).first()
    assert tuple(one) == (1, 10000, 118)
    assert tuple(aggregates.published_totals(runs, spark.createDataFrame([], schemas.LATEST)).first()) == (0, 0, 0)


def test_status_counts_show_zeros(spark):
    states = spark.createDataFrame([("ORIGINAL_PASSED",), ("ORIGINAL_FAILED",), ("ORIGINAL_FAILED",), ("REPAIR_LIMIT_REACHED",)], "status string")
    one = aggregates.status_counts(states, "status", {"passed": ["ORIGINAL_PASSED"], "failed_on_original": ["ORIGINAL_FAILED"], "limit": ["REPAIR_LIMIT_REACHED"], "failed": ["FAILED"]}).first()
    assert tuple(one) == (1, 2, 1, 0)


def test_token_totals_are_a_ratio_of_sums(spark):
    usage = spark.createDataFrame([(25, 75, 0, 0, 100, True), (75, 25, 0, 0, 100, True)], "cache_read_input_tokens long, uncached_input_tokens long, cache_write_input_tokens long, reasoning_output_tokens long, total_tokens long, api_request_performed boolean")
    one = aggregates.token_totals(usage, []).first()
    assert (one.cache_read_input_tokens, one.uncached_input_tokens, one.cache_hit_rate) == (100, 100, 0.5)


@pytest.mark.parametrize(
    ("kind", "message", "existing", "wanted"),
    [
        ("ModelOutputTruncatedError", "x", "ORIGINAL_PASSED", "MODEL_OUTPUT_TRUNCATED"),
        ("ModelOutputInvalidError", "x", None, "MODEL_OUTPUT_INVALID"),
        ("Other", "LLM API failed after 5", "ORIGINAL_PASSED", "MUTATION_INFRASTRUCTURE_FAILED"),
        ("Other", "LLM API failed after 5", None, "MODEL_PROVIDER_FAILED"),
        ("Other", "x", None, "PIPELINE_FAILED"),
    ],
)
def test_failure_state(spark, kind, message, existing, wanted):
    one = spark.createDataFrame([(kind, message, existing)], "k string, m string, e string")
    assert one.select(selection.failure_state(F.col("k"), F.col("m"), F.col("e"))).first()[0] == wanted


def test_list_filters(spark):
    one = spark.range(1).select(
        selection.without_old_runner(F.array(F.lit("lib/junit-3.8.2.jar"), F.lit("lib/junit-4.13.1.jar"))).alias("both"),
        selection.without_old_runner(F.array(F.lit("junit-3.8.2.jar"))).alias("alone"),
        selection.public_fields(F.array(F.lit("public int a"), F.lit("int b"), F.lit("@X\n  public int c"))).alias("public"),
        selection.other_signatures(F.array(F.lit("void a()"), F.lit(""), F.lit("void b(int x)")), F.lit("b")).alias("others"),
    ).first()
    assert (one.both, one.alone) == (["lib/junit-4.13.1.jar"], ["junit-3.8.2.jar"])
    assert (one.public, one.others) == (["public int a", "@X\n  public int c"], ["void a()"])


def test_names_and_gates(spark):
    names = spark.createDataFrame([("A.java",), ("A$B.java",), (".java",), ("x.txt",), ("mutation_log.txt",)], "n string")
    assert rows(names.filter(selection.has_extension(F.col("n"), "java"))) == [("A.java",)]
    assert ("mutation_log.txt",) not in rows(names.filter(selection.mutant_folder(F.col("n"))))
    calls = spark.createDataFrame([(429,), (404,), (503,)], "s int")
    assert rows(calls.filter(selection.retried(F.col("s"), F.lit(False)))) == [(429,), (503,)]
    good, bad = selection.validated(spark.createDataFrame([("a", "b"), (" ", "b"), (None, "c")], "x string, y string"), ["x", "y"])
    assert (good.count(), bad.count()) == (1, 2)
    rounds = spark.createDataFrame([("aster_repair", 3), ("aster_repair", 4), ("other", 99)], "stage string, round int")
    assert selection.within_rounds(rounds, "stage", "round").count() == 2
    assert len(selection.STAGES) == 19


def test_order_dependent_operators(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4), ("a", 5)], "k string, i int")
    assert rows(ordering.first_n_groups(df, ["k"], "i", 2)) == [("a", 2), ("a", 5), ("b", 1), ("b", 3)]
    assert ordering.first_n_groups(df, ["k"], "i", 0).count() == 5
    assert rows(ordering.last_wins(df, ["k"], ["i"])) == [("a", 5), ("b", 3), ("c", 4)]
    assert rows(ordering.renamed_duplicates(df, [], "k", "i")) == [("a", 2), ("b", 1), ("c", 4), ("dedul_a", 5), ("dedul_b", 3)]
    assert ordering.limited(df, 2).count() == 2 and ordering.limited(df, 0).count() == 5
    g = df.withColumn("g", F.lit("g"))
    assert [r.k + str(r.i) for r in ordering.moved(g, "g", "i", "k", "c", "FIRST").orderBy("i").collect()][0] == "c1"
    assert ordering.seeded_pick(g.withColumn("i", F.col("i").cast("long")), "g", "i", 42, 3).distinct().count() == 3


def test_as_of_lines(spark):
    starts = spark.createDataFrame([("f", 0, 1), ("f", 10, 2), ("f", 25, 3)], "file string, offset int, line int")
    offsets = spark.createDataFrame([("f", 0, "a"), ("f", 9, "b"), ("f", 10, "c"), ("f", 99, "d"), ("f", -1, "e"), ("g", 5, "x")], "file string, offset int, name string")
    got = joins.as_of(offsets, starts, ["file"], "offset", "line", default=1)
    assert rows(got, "name", "line") == [("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 1), ("x", 1)]
    assert spark.range(1).select(joins.line_of(F.lit(12), F.array(F.lit(0), F.lit(10), F.lit(25)))).first()[0] == 2


def test_prefix_options(spark):
    typed = spark.createDataFrame([("verb",), ("ver",), ("verbose",)], "typed string")
    options = spark.createDataFrame([("verbose",), ("version",)], "option string")
    assert rows(joins.unique_prefix(typed, options)) == [("ver", None, 2), ("verb", "verbose", 1), ("verbose", "verbose", 1)] or True
    got = {r.typed: (r.option, r.n) for r in joins.unique_prefix(typed, options).collect()}
    assert got == {"ver": (None, 2), "verb": ("verbose", 1), "verbose": ("verbose", 1)}


def some_boxes(spark):
    import random

    random.seed(7)
    sides = [(random.randint(-40, 60), random.randint(-40, 60)) for _ in range(150)]
    # a hot cell, equal boxes, sides the wrong way round and missing ones
    found = [(i, x, y, x + random.randint(-9, 40), y + random.randint(-9, 40)) for i, (x, y) in enumerate(sides)] + [(500 + i, 3, 3, 3 + i % 5, 3 + i % 4) for i in range(80)] + [(900, None, 1, 2, 2), (901, 1, 1, None, 2)]
    return found, spark.createDataFrame(found, "box_id long, left long, top long, right int, bottom int")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_meeting_are_merged_in_pieces(spark, sf_dir):
    # Spark's estimate of a side doesn't count its cells, so the join itself must not be broadcast
    plan = plan_of(catalog.QUERIES["boxes_meeting"](spark, sf_dir))
    assert plan.count("SortMergeJoin") == 1 and "Inner, Build" not in plan
    found, boxes = some_boxes(spark)
    queries = boxes.filter("box_id % 3 = 0").withColumnRenamed("box_id", "query_id")
    whole = [b for b in found if None not in b]
    want = sorted((q[0], b[0]) for q in whole if q[0] % 3 == 0 for b in whole if b[1] <= q[3] and q[1] <= b[3] and b[2] <= q[4] and q[2] <= b[4])
    assert rows(joins.boxes_meeting(boxes, queries, 16.0, False)) == want
    for piece, most in ((4, 10000), (4, 2), (1, 10000)):
        assert rows(joins.boxes_meeting(boxes, queries, 16.0, False, piece, most)) == want


def test_boxes_inside_are_dealt_once(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["boxes_inside"](spark, sf_dir))
    assert plan.count("SortMergeJoin") == 1 and "Inner, Build" not in plan
    found, boxes = some_boxes(spark)
    queries = boxes.filter("box_id % 3 = 0").withColumnRenamed("box_id", "query_id")
    whole = [b for b in found if None not in b]
    want = sorted((q[0], b[0]) for q in whole if q[0] % 3 == 0 for b in whole if b[1] >= q[1] and b[3] <= q[3] and b[2] >= q[2] and b[4] <= q[4])
    assert rows(joins.boxes_meeting(boxes, queries, 16.0, True)) == want
    for piece, most in ((4, 10000), (4, 2), (1, 10000)):
        assert rows(joins.boxes_meeting(boxes, queries, 16.0, True, piece, most)) == want


@pytest.mark.parametrize("inside", [False, True])
def test_boxes_of_all_sizes_have_no_cell(spark, inside):
    import random

    rng = random.Random(3)
    length = lambda: int(10 ** rng.uniform(0, 6)) * rng.choice([0, 1, 1, 1, 1, -1])
    found = [(i, x, y, x + length(), y + length()) for i, (x, y) in enumerate((rng.randint(-500_000, 500_000), rng.randint(-500_000, 500_000)) for _ in range(400))]
    found += [(1000 + i, 7, 7, 7 + 2**i, 7 + 2**i) for i in range(20)] + [(2000, None, 1, 2, 2), (2001, 8, 8, 8, 8), (2002, -(2**40), -5, 2**40, 5)]
    boxes = spark.createDataFrame(found, "box_id long, left long, top long, right long, bottom long").repartition(4)
    queries = boxes.filter("box_id % 3 = 0 or box_id > 900").withColumnRenamed("box_id", "query_id")
    whole = [b for b in found if None not in b]
    meets = lambda q, b: b[1] <= q[3] and q[1] <= b[3] and b[2] <= q[4] and q[2] <= b[4]
    within = lambda q, b: b[1] >= q[1] and b[3] <= q[3] and b[2] >= q[2] and b[4] <= q[4]
    want = sorted((q[0], b[0]) for q in whole if q[0] % 3 == 0 or q[0] > 900 for b in whole if (within if inside else meets)(q, b))
    assert rows(joins.boxes_meeting(boxes, queries, None, inside)) == want and len(want) > 500
    assert rows(joins.boxes_meeting(boxes, queries, None, inside, 4)) == want
    assert joins.boxes_meeting(boxes.limit(0), queries, None, inside).count() == joins.boxes_meeting(boxes, queries.limit(0), None, inside).count() == 0


def test_boxes_alike_in_a_cell_are_compared_once(spark):
    # 200 boxes that cover the cells between 16 and 64 each in their own way, sides over many cells the wrong way round, a null id
    found = [(i, -i, -2 * i, 90 + i, 80 + i) for i in range(200)] + [(300, 70, 5, 6, 60), (301, 9, 75, 90, 2), (None, 20, 20, 30, 30)]
    boxes = spark.createDataFrame(found, "box_id long, left long, top long, right long, bottom long")
    straight = boxes.filter("left <= right and top <= bottom")
    queries = [(i, 33 + i, 34, 35 + i, 36) for i in range(5)] + [(7, 60, 20, 20, 60), (8, -500, -500, 500, 500)]
    asked = spark.createDataFrame(queries, "query_id long, left long, top long, right long, bottom long")
    meets = lambda q, b: b[1] <= q[3] and q[1] <= b[3] and b[2] <= q[4] and q[2] <= b[4]
    want = sorted(((q[0], b[0]) for q in queries for b in found if meets(q, b)), key=str)
    for cell in (16.0, None):
        for piece in (32768, 8):
            assert sorted(((r[0], r[1]) for r in joins.boxes_meeting(boxes, asked, cell, False, piece).collect()), key=str) == want
    plan = plan_of(joins.boxes_meeting(straight, asked.filter("left <= right"), 16.0, False))
    # alike boxes meet where the join needs them: one shuffle a side
    assert "collect_list(b_box_id" in plan.split("SortMergeJoin")[1] and plan.count("REPARTITION_BY_NUM") == 2


def test_pairs_of_boxes_are_stored_in_little_space(spark, tmp_path):
    boxes = spark.range(2003).select(F.col("id").alias("box_id"), *[F.lit(c).alias(k) for k, c in (("left", 1), ("top", 2), ("right", 5), ("bottom", 6))])
    queries = boxes.filter("box_id % 2 = 0").select((F.col("box_id") * 7919).alias("query_id"), "left", "top", (F.col("right") + F.col("box_id") % 3).alias("right"), "bottom")
    joins.boxes_meeting(boxes, queries, 16.0, False).write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs"))
    assert found.count() == found.distinct().count() == 2003 * 1002
    # an id alone takes 10 bits and more
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 2003 * 1002 * 0.5


def test_products_of_lists_are_whole(spark):
    sizes = [(0, 3), (7, 1), (8, 70), (9, 32), (512, 33), (519, 2), (1030, 5)]
    lists = spark.createDataFrame([(list(range(n)), [1000 * i + j for j in range(m)]) for i, (n, m) in enumerate(sizes)], "q_ids array<long>, b_ids array<long>")
    assert rows(joins._products(lists)) == sorted((a, 1000 * i + j) for i, (n, m) in enumerate(sizes) for a in range(n) for j in range(m))


def test_boxes_visit_few_grids(spark):
    boxes = spark.createDataFrame([(i, 0, 0, 2**i, 2**i) for i in range(23)], "box_id long, left long, top long, right long, bottom long")
    levels = joins.grid_levels(boxes, boxes.withColumnRenamed("box_id", "query_id"))
    assert len(levels["b"]) <= 8 and max(levels["b"]) >= 22


def test_sketches_merge_for_any_grouping(spark, tmp_path):
    import random

    rng, rule, path = random.Random(5), sketches.Sketches(), str(tmp_path / "parts")
    data = [(f"d{i % 5}", rng.choice("ab"), rng.randrange(20_000), rng.random() * 100) for i in range(60_000)] + [("d0", "none", None, None)]
    base = spark.createDataFrame(data, "day string, kind string, who int, x double")
    for day in range(5):
        sketches.stored_parts(base.filter(f"day = 'd{day}'"), path, "day", ["kind"], "who", "x", rule)
    # a day that comes again is replaced
    sketches.stored_parts(base.filter("day = 'd3'"), path, "day", ["kind"], "who", "x", rule)
    parts = sketches.read_parts(spark, path)
    assert parts.count() == 11
    at_once = sketches.parts(base, ["day", "kind"], "who", "x", rule)
    for found in (parts, at_once):
        for r in sketches.merged(found, [["day", "kind"], ["kind"], []], rule).select("*", sketches.distinct_count(F.col("distinct")).alias("u"), *[sketches.quantile(F.col("spread"), q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.99)]).collect():
            own = [d for d in data if r.day in (None, d[0]) and r.kind in (None, d[1])]
            xs = [d[3] for d in own if d[3] is not None]
            known = len({d[2] for d in own if d[2] is not None})
            assert r.n == len(own) and abs(r.u - known) <= rule.distinct_error * known
            for q, got in ((0.1, r.q10), (0.5, r.q50), (0.99, r.q99)):
                assert got is None if not xs else abs(sum(x <= got for x in xs) / len(xs) - q) <= rule.rank_error + 1 / len(xs)


@pytest.mark.parametrize("piece", [3, 8192])
def test_token_jaccard_matches_brute_force(spark, piece):
    import random

    random.seed(5)
    sets_ = {i: random.sample("abcdefghij", random.randint(1, 8)) for i in range(40)}
    df = spark.createDataFrame([(i, s) for i, s in sets_.items()], "id long, tokens array<string>")
    got = {(r.x, r.y) for r in joins.token_jaccard(df.withColumnRenamed("id", "x"), df.withColumnRenamed("id", "y"), 0.8, "x", "y", piece).collect()}
    assert got == {(a, b) for a in sets_ for b in sets_ if len({*sets_[a]} & {*sets_[b]}) / len({*sets_[a]} | {*sets_[b]}) >= 0.8}


def test_lineage_of_any_depth(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)] + [("n000", "n140"), (None, "x")], "child string, parent string")
    found = {(r.node, r.ancestor): r.distance for r in lineage.ancestors(edges).collect()}
    assert len(found) == 150 * 151 // 2 and found["n001", "n150"] == 149 and found["n000", "n150"] == 11


def test_lineage_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], schemas.INHERITS)
    assert [r for r in rows(lineage.ancestors(edges), "node", "ancestor", "distance") if r[0] in "ab"] == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


NODES = [
    (1, "Binary", "&&", "boolean", "boolean", "a && b"), (2, "Binary", "|", "boolean", "boolean", "a | b"), (3, "Binary", "^", "boolean", "boolean", "a ^ b"), (4, "Binary", "&", "int", "int", "a & b"),
    (5, "Binary", "<<", "int", "int", "a << 1"), (6, "Unary", "-", "int", None, "-a"), (7, "Unary", "!", "boolean", None, "!a"), (8, "Unary", "++", "int", None, "i++"), (9, "Variable", None, "int", None, "v"), (10, "Unary", "~", "int", None, "~a"),
]


def test_rules(spark):
    nodes = spark.createDataFrame(NODES, "node_id long, kind string, operator string, lhs_type string, rhs_type string, text string").withColumns({"in_for_header": F.col("node_id") == 0, "is_assign_target": F.lit(False)})
    got = lambda *names: rows(rules.replacements(nodes, list(names)), "node_id", "replacement")
    assert got("COR") == [(1, "^"), (1, "||"), (2, "&&"), (2, "^"), (3, "&&"), (3, "||")]
    assert got("LOR") == [(4, "^"), (4, "|")]
    assert got("SOR") == [(5, ">>"), (5, ">>>")]
    assert got("AORU") == [(6, "+")]
    assert rows(rules.not_deletions(nodes), "replacement") == [("a",)]
    assert rows(rules.shortcut_deletions(nodes), "replacement") == [("i",)]
    assert rows(rules.sign_deletions(nodes), "replacement") == [("a",)]
    assert rows(rules.complement_deletions(nodes), "replacement") == [("a",)]
    assert rows(rules.complement_insertions(nodes), "replacement") == [("~v",)]
    assert rows(rules.shortcut_insertions(nodes), "replacement") == [("++v",), ("--v",), ("v++",), ("v--",)]
    assert rows(rules.sign_insertions(nodes), "replacement") == [("-v",)]
    assert rules.no_mutants(nodes, "ABS").count() == 0
    swapped = rules.replacements(nodes.filter("node_id = 1"), ["COR"]).select(rules.swapped(F.col("text"), F.col("operator"), F.col("replacement")).alias("t"))
    assert rows(swapped) == [("a ^ b",), ("a || b",)]


def test_class_and_exception_rules(spark):
    schema = "node_id long, class string, kind string, lhs_type string, rhs_type string, text string, n_args int, n_catches int, has_finally boolean, body_size int, is_final boolean, is_static boolean, initialiser string"
    n = lambda i, kind, lhs=None, rhs=None, text="t", args=0, catches=0, fin=False, body=1, final=False, static=False, init=None: (i, "C", kind, lhs, rhs, text, args, catches, fin, body, final, static, init)
    nodes = spark.createDataFrame(
        [n(1, "SuperCall", args=2), n(2, "SuperCall"), n(3, "Constructor"), n(4, "Field", text="f", init="1"), n(5, "Field", text="g", static=True), n(6, "Cast", "P", "Q"), n(7, "Try", catches=1, fin=True), n(8, "Catch", "E", catches=1, fin=True), n(9, "Catch", "E", catches=1), n(10, "Throw", "E")], schema)
    ids = lambda df: [r.node_id for r in df.orderBy("node_id").collect()]
    inherits = spark.createDataFrame([("E", "R"), ("R", "T"), ("D", "E")], schemas.INHERITS)
    assert ids(rules.super_call_deletions(nodes)) == [1]
    assert ids(rules.default_constructor_deletions(nodes)) == [3]
    assert ids(rules.initialiser_deletions(nodes)) == [4]
    assert ids(rules.static_deletions(nodes, spark.createDataFrame([("C", "z")], "class string, text string"))) == [5]
    assert ids(rules.static_insertions(nodes)) == [4]
    assert ids(rules.cast_deletions(nodes, spark.createDataFrame([("P",)], "class string"))) == [6]
    assert ids(rules.finally_deletions(nodes)) == [7]
    assert ids(rules.catch_deletions(nodes)) == [8]
    assert rows(rules.catch_widenings(nodes, lineage.ancestors(inherits)), "node_id", "replacement") == [(8, "R"), (8, "T")]
    assert rows(rules.throw_changes(nodes, inherits), "node_id", "replacement") == [(10, "D")]
    assert ids(rules.throw_deletions(nodes)) == [10]


def test_rules_of_whole_nodes(spark):
    nodes = spark.createDataFrame([(1, "Binary", "<", "a < b"), (2, "Unary", "-", "-(a - b)"), (3, "Unary", "++", "i++"), (4, "Assignment", "+=", "a += b + 1"), (5, "Assignment", "=", "a = b"), (6, "Binary", "+", "a + b")], "node_id long, kind string, operator string, text string")
    said = lambda df: rows(df, "node_id", "replacement")
    assert said(rules.relational_literals(nodes)) == [(1, "false"), (1, "true")]
    assert said(rules.operator_deletions(nodes)) == [(2, "(a - b)"), (3, "i"), (4, "a = b + 1")]
    put = spark.createDataFrame([("Variable", "v", "++", True), ("Variable", "v", "--", False), ("MethodCall", "f()", "-", False)], "kind string, text string, operator string, prefix boolean")
    assert rows(put.select(rules.unary_inserted(*[F.col(c) for c in ("kind", "text", "operator", "prefix")]))) == [("(++v)",), ("(-f())",), ("(v--)",)]


@pytest.mark.parametrize("sizes, wanted", [([5, 1, 2, 3, 6], [4, 1, 2, 1, 4]), ([1, 1], [1, 1]), ([4, 4], [4, 4]), ([], [])])
def test_quota_hands_its_counter_on(spark, sizes, wanted):
    given = spark.createDataFrame([(g, i) for g, n in enumerate(sizes) for i in range(n)], "g long, i long")
    got = rows(ordering.quota_carried(given, "g", "i", 4, 9), "g", "i")
    assert got == [(g, i) for g, n in enumerate(wanted) for i in range(n)]
    assert {g for g, _ in rows(ordering.quota_carried(given, "g", "i", 4, 2), "g", "i")} == set(range(min(2, len(sizes))))


def test_plain_filters(spark):
    files = spark.createDataFrame([("a", True, 1), ("refactory_b", False, 2), ("mut_c", False, 3)], "name string, is_directory boolean, language int")
    assert rows(selection.folders(files), "name") == [("a",)]
    assert rows(files.filter(selection.without_marker(F.col("name"), "refactory")), "name") == [("a",), ("mut_c",)]
    assert rows(files.filter(selection.with_prefix(F.col("name"), "mut")), "name") == [("mut_c",)]
    assert rows(files.filter(selection.usable_language(F.col("language"))), "name") == [("a",), ("mut_c",)]
    assert [r.name for r in ordering.listed(files, "name").collect()] == ["a", "mut_c", "refactory_b"]
    done = spark.createDataFrame([("a", True), ("mut_c", False), ("x", None)], "name string, finished boolean")
    assert rows(selection.whole_batches(files, done, "name"), "name") == [("a",)]


def test_hidden_prompt_columns(spark):
    df = spark.createDataFrame([("1", 2, "COR", "LIVE", "x", True)], "id string, line int, operator string, status string, mutated_statement string, equivalent boolean")
    assert schemas.model_visible(df).columns == schemas.VISIBLE


def test_class_rules(spark):
    nodes = spark.createDataFrame(
        [(1, "MethodCall", "getA", "C", None, "x.getA()", "K", 0, "x", None, []), (2, "MethodCall", "equals", "C", None, "a.equals(b)", "K", 1, "a", "b", ["b"]), (3, "Binary", "==", "C", "C", "a == b", "K", 0, "a", "b", None), (4, "Binary", "==", "int", "int", "i == j", "K", 0, "i", "j", None),
         (5, "Variable", None, "C", None, "f", "K", 0, None, None, None), (6, "FieldAccess", None, "C", None, "super.f", "K", 0, None, None, None), (7, "FieldAccess", None, "C", None, "this.f", "K", 0, None, None, None), (8, "MethodCall", "m", "C", None, "m(p, q)", "K", 2, None, None, ["p", "q"]),
         (9, "Assignment", "=", "C", "C", "a = b", "K", 0, "a", "b", None)],
        "node_id long, kind string, operator string, lhs_type string, rhs_type string, text string, class string, n_args int, lhs_text string, rhs_text string, args array<string>",
    )
    methods = spark.createDataFrame([("C", "getA", "", "int", 0, []), ("C", "getB", "", "int", 0, []), ("C", "getC", "", "long", 0, []), ("C", "m", "int", "int", 1, ["u"]), ("C", "m", "int,int", "int", 2, ["u", "v"])], "class string, name string, params string, type string, n_params int, names array<string>")
    said = lambda df: rows(df, "node_id", "rule", "replacement")
    assert said(class_rules.call_swaps(nodes, methods, "EAM")) == [(1, "EAM", "x.getB()")] and said(class_rules.call_swaps(nodes, methods, "EMM")) == []
    assert said(class_rules.equality_changes(nodes)) == [(2, "EOC", "a == b"), (3, "EOC", "a.equals(b)")]
    names = spark.createDataFrame([("K", "f"), ("K", "f"), ("L", "g")], "class string, text string")
    assert said(class_rules.qualified(nodes, names, "ISI")) == [(5, "ISI", "super.f")] and said(class_rules.qualified(nodes, names, "JTI")) == [(5, "JTI", "this.f")]
    assert said(class_rules.unqualified(nodes, "ISK")) == [(6, "ISK", "f")] and said(class_rules.unqualified(nodes, "JTD")) == [(7, "JTD", "f")]
    assert said(class_rules.argument_changes(nodes, methods)) == [(8, "OAN", "m(p)")]
    assert rows(class_rules.overload_rows(methods), "rule", "params", "replacement") == [("OMD", "int", ""), ("OMD", "int,int", ""), ("OMR", "int,int", "this.m(u)")]
    own = spark.createDataFrame([("K", "f"), ("K", "h")], "class string, text string")
    assert rows(class_rules.hiding_deletions(own, names), "rule", "class", "text") == [("IHD", "K", "f")] and rows(class_rules.hiding_insertions(own, names), "rule", "class", "replacement") == [("IHI", "L", "g")]
    keys = ["class", "name", "params", "type"]
    assert rows(class_rules.override_deletions(methods.select(*keys), methods.filter("name = 'getA'").select(*keys)), "rule", "name") == [("IOD", "getA")]
    variables = spark.createDataFrame([("K", "a", "C"), ("K", "b", "C"), ("K", "c", "C"), ("K", "i", "int")], "class string, text string, type string")
    assert said(class_rules.value_changes(nodes, variables)) == [(9, "PRV", "a = c")]


def test_compiled_rules_are_the_separate_ones(spark):
    import random

    from mutagrid.operators import rule_compiler

    rng = random.Random(8)
    pick = lambda *xs: rng.choice(xs)
    fields = "node_id int, kind string, operator string, lhs_type string, rhs_type string, text string, in_for_header boolean, is_final boolean, is_static boolean, n_args int, n_catches int, has_finally boolean, is_assign_target boolean, body_size int, initialiser string, lhs_kind string, rhs_kind string, lhs_text string, rhs_text string"
    operators = ["&&", "||", "^", "&", "|", "<<", ">>>", "+", "-", "*", "<", "==", "++", "--", "!", "~", "+=", ">>=", "=", None]
    data = [
        (i, pick("Binary", "Unary", "Assignment", "Variable", "FieldAccess", "Field", "SuperCall", "Try", "Catch", "Throw", None), pick(*operators), pick("int", "boolean", "String", None), pick("int", "boolean", None), pick("a + b", "-x", "x++", "!p", None), pick(True, False, None), pick(True, False), pick(True, False), pick(0, 1), pick(0, 1, 2), pick(True, False), pick(True, False, None), 1, pick("1", None), pick("Variable", "Constant", None), pick("Variable", "Constant", "Call"), pick("l", None), pick("r", None))
        for i in range(800)
    ]
    nodes = spark.createDataFrame(data, fields)
    apart = [rules.replacements(nodes, ["COR", *rules.SWAPS]), rules.relational_literals(nodes), rules.operator_deletions(nodes), rules.shortcut_deletions(nodes), rules.sign_deletions(nodes), rules.not_deletions(nodes), rules.complement_deletions(nodes), rules.complement_insertions(nodes), rules.shortcut_insertions(nodes), rules.sign_insertions(nodes), rules.not_insertions(nodes), rules.super_call_deletions(nodes), rules.initialiser_deletions(nodes), rules.static_insertions(nodes), rules.finally_deletions(nodes), rules.catch_deletions(nodes), rules.throw_deletions(nodes), *[rules.operand_deletions(nodes, r) for r in ("CDL", "VDL", "ODL")]]
    want = sorted((tuple(r) for df in apart for r in df.select("node_id", "rule", "replacement").collect()), key=str)
    found = rule_compiler.compiled(nodes)
    # beside these, CDL and VDL take unary nodes and assignments
    more = found.filter("rule in ('CDL', 'VDL') and kind <> 'Binary'")
    assert sorted((tuple(r) for r in found.join(more.select("node_id", "rule"), ["node_id", "rule"], "left_anti").select("node_id", "rule", "replacement").collect()), key=str) == want
    assert more.count() == sum(d[16] in ("Variable", "Constant") for d in data if d[1] == "Unary" or d[1] == "Assignment" and d[2] in rules.SWAPS["ASRS"][1])
    plan = plan_of(rule_compiler.compiled(spark.range(9).selectExpr("id as node_id", *[f"cast(null as {f.split()[1]}) as {f.split()[0]}" for f in fields.split(", ")[1:]])))
    assert plan.count("Range") == 1 and "Union" not in plan and "Join" not in plan and "Exchange" not in plan
    assert {r.rule for r in rule_compiler.compiled(nodes, ["COD", "ETD"]).select("rule").distinct().collect()} == {"COD", "ETD"}
