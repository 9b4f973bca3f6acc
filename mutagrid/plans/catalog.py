"""All queries of the mutation-testing workload, with a DuckDB oracle each where SQL can express one.

The test tables play the workload's parts: line items are mutant rows (not unique,
identified by order and line number), orders focal methods, parts operators,
suppliers tests, return flags outcomes (R killed, A live, N excluded), conversations
rounds, events provider calls, documents sources, labels coverage reports.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.functions import convert, text
from mutagrid.operators import aggregates, class_rules, joins, lineage, ordering, rule_compiler, rules, scans, scopes, selection, sets, sketches
from mutagrid.sources import trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query of (t, spark), t loading a table by name, with its oracle."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register


RATIO = "CASE WHEN {1} = 0 THEN NULL ELSE {0}::DOUBLE / {1} END"


@query("""SELECT count(*) AS targets, count(l.doc_id) AS coverage_available_count, count(*) - count(l.doc_id) AS coverage_missing_count,
  coalesce(sum(quality), 0)::BIGINT AS covered_line_count, coalesce(sum(1 - quality), 0)::BIGINT AS missed_line_count, coalesce(sum(toxic), 0)::BIGINT AS covered_branch_count,
  coalesce(sum(1 - toxic), 0)::BIGINT AS missed_branch_count, sum(quality)::DOUBLE / count(quality) AS line_covered_ratio, sum(toxic)::DOUBLE / count(toxic) AS branch_covered_ratio
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def coverage_micro(t, spark):
    reports = t("labels").select("doc_id", F.col("quality").alias("covered_line_count"), (1 - F.col("quality")).alias("missed_line_count"), F.col("toxic").alias("covered_branch_count"), (1 - F.col("toxic")).alias("missed_branch_count"))
    states = t("labels").select("doc_id", F.lit("DONE").alias("state"))
    return aggregates.micro_coverage(joins.with_reports(t("documents").select("doc_id"), states, reports, "doc_id"))


@query("""SELECT coalesce(state, 'MISSING') AS state, count(*) AS n, count(q) AS reports FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'DONE' ELSE 'FAILED' END END AS state, quality AS q
  FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def target_states(t, spark):
    states = t("labels").select("doc_id", F.when(F.col("quality") == 1, "DONE").otherwise("FAILED").alias("state"))
    rows = joins.with_reports(t("documents").select("doc_id"), states, t("labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.count("quality").alias("reports"))


@query("SELECT l_orderkey, count(*) AS mutant_rows, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS members FROM lineitem GROUP BY l_orderkey")
def manifest_groups(t, spark):
    return aggregates.method_groups(t("lineitem"), ["l_orderkey"], "l_linenumber").withColumn("members", F.array_join("members", ","))


@query("SELECT count(*) AS mutant_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS physical_mutants FROM lineitem")
def physical_dedup(t, spark):
    return aggregates.physical(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY min(l_shipdate), l_orderkey LIMIT 5)""")
def first_n_methods(t, spark):
    return ordering.first_n_groups(t("lineitem"), ["l_orderkey"], "l_shipdate", 5).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_passing(t, spark):
    return ordering.first_passing(t("orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def last_wins(t, spark):
    return ordering.last_wins(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) > 1 THEN 'dedul_' || p_name ELSE p_name END AS p_name FROM part")
def dup_rename(t, spark):
    return ordering.renamed_duplicates(t("part"), ["p_brand"], "p_name", "p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type || '_' || row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS mutant_name FROM part")
def mutant_numbers(t, spark):
    return ordering.numbered(t("part"), ["p_brand"], "p_type", ["p_partkey"]).select("p_partkey", "mutant_name")


@query("""SELECT b AS p_brand, count(l_orderkey) AS n FROM (SELECT 'Brand#' || i AS b FROM range(0, 30) r(i)) LEFT JOIN (SELECT p_brand, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R') ON b = p_brand GROUP BY 1""")
def operator_histogram(t, spark):
    dimension = spark.range(30).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("p_brand"))
    rows = t("lineitem").filter("l_returnflag = 'R'").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return aggregates.histogram(rows, "p_brand", dimension, "p_brand")


@query("""SELECT count(*) FILTER (o_orderstatus = 'F') AS original_passed, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS original_failed, count(*) FILTER (o_orderstatus = 'X') AS repair_limit_reached FROM orders""")
def status_histogram(t, spark):
    return aggregates.status_counts(t("orders"), "o_orderstatus", {"original_passed": ["F"], "original_failed": ["O", "P"], "repair_limit_reached": ["X"]})


_KILLS = """SELECT l_orderkey AS target, l_linenumber AS mutant, p_brand, l_suppkey AS test, l_returnflag = 'R' AS failed, l_returnflag = 'N' AS infra, o_orderstatus <> 'P' AS admitted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""


def _kills(t):
    orders, part = t("orders").select("o_orderkey", "o_orderstatus"), t("part").select("p_partkey", "p_brand")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("mutant"), "p_brand", F.col("l_suppkey").alias("test"), (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_returnflag") == "N").alias("infra"), (F.col("o_orderstatus") != "P").alias("admitted"))


@query(f"""WITH k AS (SELECT p_brand, target, mutant, bool_or(failed) AS killed, bool_or(infra) AS infra, bool_or(admitted) AS admitted FROM ({_KILLS}) GROUP BY 1, 2, 3)
SELECT p_brand, count(*) FILTER (killed) AS killed, count(*) FILTER (admitted) AS executable, count(*) FILTER (NOT infra) AS end_to_end,
  {RATIO.format('count(*) FILTER (killed)', 'count(*) FILTER (admitted)')} AS executable_score, {RATIO.format('count(*) FILTER (killed)', 'count(*) FILTER (NOT infra)')} AS end_to_end_score FROM k GROUP BY 1""")
def mutation_score(t, spark):
    return aggregates.mutation_scores(_kills(t), ["p_brand"], ["target", "mutant"], F.col("infra"))


@query("""SELECT l_suppkey AS test, string_agg(DISTINCT l_partkey, ',' ORDER BY l_partkey) AS mutants FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def kill_index(t, spark):
    rows = t("lineitem").select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("mutant"), (F.col("l_returnflag") == "R").alias("failed"))
    return aggregates.kill_index(rows, "test", "mutant")[0].withColumn("mutants", F.array_join("mutants", ","))


@query("""SELECT l_partkey AS mutant, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS tests FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def killers_index(t, spark):
    rows = t("lineitem").select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("mutant"), (F.col("l_returnflag") == "R").alias("failed"))
    return aggregates.kill_index(rows, "test", "mutant")[1].withColumn("tests", F.array_join("tests", ","))


@query("""SELECT l_partkey AS mutant, bool_or(l_returnflag = 'R') AS killed, arg_min(l_suppkey, l_suppkey) FILTER (l_returnflag = 'R') AS first_killer FROM lineitem GROUP BY 1""")
def first_killer(t, spark):
    rows = t("lineitem").select(F.col("l_suppkey").alias("test"), F.col("l_partkey").alias("mutant"), (F.col("l_returnflag") == "R").alias("failed"))
    return aggregates.first_killer(rows, "mutant", "test", "test")


@query("""SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'""")
def live_unused(t, spark):
    keys = ["l_orderkey", "l_linenumber"]
    rows = t("lineitem")
    alive = sets.live(rows.select(*keys).distinct(), rows.filter("l_returnflag = 'R'"), None, keys)
    return sets.unused(alive, rows.filter("l_linestatus = 'F'"), keys)


@query("""SELECT event_type, sum(CASE WHEN local THEN 0 ELSE k END)::BIGINT AS cache_read_input_tokens, sum(CASE WHEN local THEN 0 ELSE 100 END)::BIGINT AS uncached_input_tokens, 0::BIGINT AS cache_write_input_tokens, 0::BIGINT AS reasoning_output_tokens,
  sum(CASE WHEN local THEN 0 ELSE 100 + k END)::BIGINT AS total_tokens, count(*) FILTER (NOT local) AS api_requests, CASE WHEN sum(CASE WHEN local THEN 0 ELSE k + 100 END) = 0 THEN NULL ELSE sum(CASE WHEN local THEN 0 ELSE k END)::DOUBLE / sum(CASE WHEN local THEN 0 ELSE k + 100 END)::DOUBLE END AS cache_hit_rate
  FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k, event_id % 7 = 0 AS local FROM events) GROUP BY 1""")
def token_hit_rate(t, spark):
    from mutagrid.schemas import USAGE

    k = F.get_json_object("props", "$.k").cast("bigint")
    usage = F.from_json(F.to_json(F.struct((k + 100).alias("prompt_tokens"), k.alias("prompt_cache_hit_tokens"), F.lit(100).alias("prompt_cache_miss_tokens"))), USAGE)
    rows = t("events").select("event_type", usage.alias("u"), (F.col("event_id") % 7 == 0).alias("local")).select("event_type", convert.usage_normal(F.col("u"), F.col("local")).alias("n")).select("event_type", "n.*")
    return aggregates.token_totals(rows, ["event_type"])


@query("""SELECT count(DISTINCT conv_id) AS targets, sum(length(text))::DOUBLE / count(DISTINCT conv_id) AS t_pre, sum(turn)::DOUBLE / count(DISTINCT conv_id) AS t_gen, count(*) FILTER (role = 'assistant')::DOUBLE / count(DISTINCT conv_id) AS r_avg,
  sum(length(text) + turn)::BIGINT AS t_total, sum(length(text) + turn)::DOUBLE / count(DISTINCT conv_id) AS t_avg FROM conversations""")
def efficiency_avg(t, spark):
    stage = F.when(F.col("role") == "assistant", "mutap_syntax_repair").otherwise("mutap_initial")
    rows = t("conversations").select("conv_id", F.length("text").cast("bigint").alias("prepare_millis"), F.col("turn").alias("generate_millis"), stage.alias("stage"))
    return aggregates.efficiency(rows, "conv_id")


@query("""SELECT count(*) AS invocations, coalesce(sum(e), 0)::BIGINT AS elapsed_millis, coalesce(sum(m), 0)::BIGINT AS mutant_executions FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS e, (o_orderkey % 400)::BIGINT AS m FROM orders) o
  WHERE EXISTS (SELECT 1 FROM (SELECT o_custkey AS c, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) p WHERE p.c = o.o_custkey AND p.k = o.o_orderkey)""")
def published_only(t, spark):
    runs = t("orders").select(F.col("o_custkey").alias("run_dir"), F.col("o_orderkey").alias("execution_id"), F.floor("o_totalprice").alias("elapsed_millis"), (F.col("o_orderkey") % 400).alias("mutants_executed"))
    latest = t("orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("run_dir")).agg(F.max("o_orderkey").alias("execution_id"))
    return aggregates.published_totals(runs, latest)


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'MODEL_OUTPUT_TRUNCATED' WHEN event_type = 'signup' THEN 'MODEL_OUTPUT_INVALID' WHEN user_id % 3 = 0 THEN 'MUTATION_INFRASTRUCTURE_FAILED' WHEN event_type = 'error' THEN 'MODEL_PROVIDER_FAILED' ELSE 'PIPELINE_FAILED' END AS state FROM events""")
def failure_class(t, spark):
    kind = F.when(F.col("event_type") == "view", "ModelOutputTruncatedError").when(F.col("event_type") == "signup", "ModelOutputInvalidError").otherwise("Other")
    message = F.when(F.col("event_type") == "error", "LLM API failed after 5").otherwise("x")
    existing = F.when(F.col("user_id") % 3 == 0, "ORIGINAL_PASSED")
    return t("events").select("event_id", selection.failure_state(kind, message, existing).alias("state"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c.cov IS NOT NULL AND NOT c.cov THEN 'NO_COVERAGE' ELSE 'LIVE' END AS status FROM lineitem LEFT JOIN (SELECT p_partkey, p_size > 25 AS cov FROM part WHERE p_size % 5 <> 0) c ON l_partkey = p_partkey WHERE l_returnflag = 'A'""")
def live_vs_nocov(t, spark):
    cover = t("part").filter("p_size % 5 <> 0").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 25).alias("covered"))
    return joins.covered_lines(t("lineitem").filter("l_returnflag = 'A'"), cover, ["l_partkey"], "covered").select("l_orderkey", "l_linenumber", "l_partkey", "status")


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z]+'), lambda x: x <> ''))"


@query(f"""WITH b AS (SELECT item_id, {_TOKENS.format('text')} AS x FROM benchmark), d AS (SELECT doc_id, {_TOKENS.format('text')} AS y FROM documents),
bt AS (SELECT item_id, len(x) AS n, unnest(x) AS w FROM b), dt AS (SELECT doc_id, len(y) AS m, unnest(y) AS w FROM d),
p AS (SELECT item_id, doc_id, count(*) AS c, any_value(n) AS n, any_value(m) AS m FROM bt JOIN dt USING (w) GROUP BY 1, 2), s AS (SELECT item_id, doc_id, c::DOUBLE / (n + m - c) AS similarity FROM p)
SELECT item_id, doc_id, similarity, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id)::INTEGER AS rank FROM s WHERE similarity >= 0.2 QUALIFY rank <= 3""")
def topk_similar(t, spark):
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != ""))
    left, right = t("benchmark").select("item_id", tokens("text").alias("tokens")), t("documents").select("doc_id", tokens("text").alias("tokens"))
    return ordering.top_k(joins.token_jaccard(left, right, 0.2, "item_id", "doc_id"), "item_id", [F.desc("similarity"), F.col("doc_id")], 3)


@query("""SELECT e.event_id, e.user_id, s.k AS line FROM events e ASOF LEFT JOIN (SELECT user_id, event_id AS start, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.event_id >= s.start""")
def asof_line(t, spark):
    starts = t("events").filter("event_type = 'signup'").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("line"))
    return joins.as_of(t("events").select("user_id", "event_id", "value"), starts, ["user_id"], "event_id", "line").select("event_id", "user_id", "line")


@query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
up AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM e UNION ALL SELECT up.node, e.parent, up.distance + 1 FROM up JOIN e ON up.ancestor = e.child) SELECT node, ancestor, min(distance)::INTEGER AS distance FROM up GROUP BY 1, 2""")
def lineage_closure(t, spark):
    c = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"))
    n = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")))
    return lineage.ancestors(c.union(n))


@query("SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (1, 3)")
def direct_children(t, spark):
    edges = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return lineage.children(edges, t("region").filter("r_regionkey in (1, 3)").select(F.col("r_name").alias("type")))


@query("""SELECT DISTINCT l_orderkey, l_partkey FROM lineitem c WHERE l_linestatus = 'O' AND EXISTS (SELECT 1 FROM lineitem p WHERE p.l_linestatus = 'F' AND p.l_partkey = c.l_partkey AND p.l_suppkey = c.l_suppkey)""")
def hidden_members(t, spark):
    rows = t("lineitem")
    return joins.hiding_members(rows.filter("l_linestatus = 'O'"), rows.filter("l_linestatus = 'F'"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey").distinct()


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'N' AND l_linestatus = 'O' AND l_quantity < 25)")
def unreferenced_fields(t, spark):
    refs = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") != "N").alias("shadowed"), F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 25), "run").otherwise("main").alias("method"))
    return joins.unreferenced(t("part"), refs, ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def call_trace(t, spark):
    calls = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return joins.fan_out(calls, t("orders").filter("o_orderstatus = 'P'"), ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT a.s_suppkey AS repair, b.s_suppkey AS test FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_acctbal >= 5000""")
def repairs_by_tests(t, spark):
    s = t("supplier")
    return joins.all_pairs(s.filter("s_acctbal >= 5000").select("s_nationkey", F.col("s_suppkey").alias("repair")), s.select("s_nationkey", F.col("s_suppkey").alias("test")), "s_nationkey").select("repair", "test")


@query("SELECT typed, CASE WHEN n = 1 THEN one WHEN exact THEN typed END AS option, n FROM (SELECT typed, count(*) AS n, min(p_name) AS one, bool_or(p_name = typed) AS exact FROM (SELECT DISTINCT left(p_name, 5) AS typed FROM part) JOIN (SELECT DISTINCT p_name FROM part) ON starts_with(p_name, typed) GROUP BY 1)")
def prefix_options(t, spark):
    return joins.unique_prefix(t("part").select(F.left("p_name", F.lit(5)).alias("typed")).distinct(), t("part").select(F.col("p_name").alias("option")).distinct())


@query("""WITH b AS (SELECT p_partkey AS box_id, p_partkey % 97 AS l, p_partkey % 89 AS t, p_partkey % 97 + p_size AS r, p_partkey % 89 + p_size AS b FROM part), q AS (SELECT b.* FROM b JOIN part ON box_id = p_partkey WHERE p_brand = 'Brand#7')
SELECT q.box_id AS query_id, b.box_id FROM q JOIN b ON b.l >= q.l AND b.r <= q.r AND b.t >= q.t AND b.b <= q.b""")
def boxes_inside(t, spark):
    x, y, s = F.col("p_partkey") % 97, F.col("p_partkey") % 89, F.col("p_size")
    boxes = t("part").select("p_brand", F.col("p_partkey").alias("box_id"), x.alias("left"), y.alias("top"), (x + s).alias("right"), (y + s).alias("bottom"))
    return joins.boxes_meeting(boxes.drop("p_brand"), boxes.filter("p_brand = 'Brand#7'").drop("p_brand").withColumnRenamed("box_id", "query_id"), 16.0, True)


@query("""WITH b AS (SELECT p_partkey AS box_id, p_partkey % 97 AS l, p_partkey % 89 AS t, p_partkey % 97 + p_size AS r, p_partkey % 89 + p_size AS b FROM part), q AS (SELECT b.* FROM b JOIN part ON box_id = p_partkey WHERE p_brand = 'Brand#9')
SELECT q.box_id AS query_id, b.box_id FROM q JOIN b ON b.l <= q.r AND q.l <= b.r AND b.t <= q.b AND q.t <= b.b""")
def boxes_meeting(t, spark):
    x, y, s = F.col("p_partkey") % 97, F.col("p_partkey") % 89, F.col("p_size")
    boxes = t("part").select("p_brand", F.col("p_partkey").alias("box_id"), x.alias("left"), y.alias("top"), (x + s).alias("right"), (y + s).alias("bottom"))
    return joins.boxes_meeting(boxes.drop("p_brand"), boxes.filter("p_brand = 'Brand#9'").drop("p_brand").withColumnRenamed("box_id", "query_id"), 16.0, False)


@query("""SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS known FROM (SELECT c.conv_id, c.turn, count(f.role) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) c
  LEFT JOIN (SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2) f ON c.conv_id = f.conv_id AND c.turn = f.turn GROUP BY 1, 2)""")
def accumulated_set(t, spark):
    return ordering.accumulated(t("conversations"), "conv_id", "turn", "role")


@query("""SELECT event_id, max(value) OVER w AS running_max, sum((value * 100)::BIGINT) OVER w::BIGINT AS running_sum, count(*) OVER w AS running_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_max_sum(t, spark):
    cents = t("events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    out = ordering.running(cents, "user_id", ["ts", "event_id"], "cents")
    return out.select("event_id", (F.col("running_max") / 100).alias("running_max"), "running_sum", "running_n")


@query("""SELECT event_id, (sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1)::INTEGER AS row_no FROM (SELECT event_id, user_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events)""")
def row_break(t, spark):
    return ordering.row_breaks(t("events"), "user_id", ["event_id"], "event_type").select("event_id", "row_no")


@query("SELECT l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_partkey * 1103515245 + 42 * 12345) % 2147483647, l_partkey) = 1")
def seeded_pick(t, spark):
    return ordering.seeded_pick(t("lineitem").filter("l_returnflag = 'A'").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey", 42)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 9) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4")
def quota(t, spark):
    return ordering.quota(t("orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 4, 9)


@query("SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY CASE WHEN n_name = (SELECT max(n_name) FROM nation) THEN -1 ELSE n_nationkey END)::INTEGER AS place FROM nation")
def moved_first(t, spark):
    last = t("nation").agg(F.max("n_name").alias("pick"))
    rows = t("nation").crossJoin(F.broadcast(last)).withColumn("place", F.col("n_nationkey")).withColumn("is", F.when(F.col("n_name") == F.col("pick"), "x").otherwise(""))
    return ordering.moved(rows, "n_regionkey", "place", "is", "x", "FIRST").select("n_regionkey", "n_nationkey", "place")


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, regexp_replace(source, '[^A-Za-z0-9_$]+', '_', 'g') AS ident, lang || '.' || source AS name, lang AS package FROM documents""")
def text_normalise(t, spark):
    name = F.concat_ws(".", "lang", "source")
    return t("documents").select("doc_id", text.one_line("text").alias("line"), text.safe_identifier("source").alias("ident"), name.alias("name"), text.package_name(name).alias("package"))


@query("""SELECT doc_id, (k - 1)::INTEGER AS line_no, ltrim(line, ' ') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT doc_id, replace(text, 'The', 'assert The') AS text FROM documents)) WHERE starts_with(ltrim(line, ' '), 'assert') AND length(ltrim(line, ' ')) > 10""")
def line_filter(t, spark):
    rows = t("documents").select("doc_id", F.replace("text", F.lit("The"), F.lit("assert The")).alias("text"))
    return selection.assert_lines(rows, "text")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links, length(html)::INTEGER AS size FROM pages")
def html_scrape(t, spark):
    from mutagrid.sources import readers

    return t("pages").select("page_id", readers.tag_text("html", "title").alias("title"), F.regexp_count("html", F.lit("<a href=")).cast("bigint").alias("links"), F.length("html").alias("size"))


@query(r"SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages")
def url_params(t, spark):
    m = convert.url_map("url")
    return t("pages").select("page_id", F.try_element_at(m, F.lit("page")).alias("page"), F.try_element_at(m, F.lit("ref")).alias("ref"))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem UNION SELECT p_partkey FROM part) UNION ALL SELECT 'except_all', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part)
  UNION ALL SELECT 'intersect_all', count(*) FROM (SELECT l_partkey FROM lineitem INTERSECT ALL SELECT l_suppkey FROM lineitem) UNION ALL SELECT 'intersect', count(*) FROM (SELECT l_partkey FROM lineitem INTERSECT SELECT p_partkey FROM part)""")
def set_ops(t, spark):
    a, b, s = t("lineitem").select("l_partkey"), t("part").select("p_partkey"), t("lineitem").select("l_suppkey")
    named = {"union": a.union(b).distinct(), "except_all": sets.except_all(a, b), "intersect_all": sets.intersect_all(a, s), "intersect": a.intersect(b)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, df in named.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_RULE_NODES = """(SELECT p_partkey AS node_id, ['&&', '||', '^', '<<', '>>', '>>>', '-', '+'][1 + p_size % 8] AS op, p_name AS text FROM part)"""


@query(f"""SELECT node_id, r.rule, r.new FROM {_RULE_NODES} n JOIN (SELECT * FROM (VALUES ('COR', '&&', '||'), ('COR', '&&', '^'), ('COR', '||', '&&'), ('COR', '||', '^'), ('COR', '^', '&&'), ('COR', '^', '||'),
  ('SOR', '<<', '>>'), ('SOR', '<<', '>>>'), ('SOR', '>>', '<<'), ('SOR', '>>', '>>>'), ('SOR', '>>>', '<<'), ('SOR', '>>>', '>>'), ('AORB', '-', '*'), ('AORB', '-', '/'), ('AORB', '-', '%'), ('AORB', '-', '+'), ('AORB', '+', '*'), ('AORB', '+', '/'), ('AORB', '+', '%'), ('AORB', '+', '-')) v(rule, op, new)) r ON n.op = r.op""")
def rule_fanout(t, spark):
    symbols = F.array(*[F.lit(s) for s in ("&&", "||", "^", "<<", ">>", ">>>", "-", "+")])
    op = F.get(symbols, F.col("p_size") % 8)
    kind = F.when(op.isin("&&", "||", "^"), "boolean").otherwise("int")
    nodes = t("part").select(F.col("p_partkey").alias("node_id"), F.lit("Binary").alias("kind"), op.alias("operator"), kind.alias("lhs_type"), kind.alias("rhs_type"), F.col("p_name").alias("text"))
    return rules.replacements(nodes, ["COR", "SOR", "AORB"]).select("node_id", "rule", F.col("replacement").alias("new"))


@query("""WITH c AS (SELECT n_name AS node, r_name AS ancestor FROM nation JOIN region ON n_regionkey = r_regionkey),
v AS (SELECT c_custkey AS node_id, n_name AS nation, r_name AS region, ['public', 'protected', 'private', ''][1 + c_custkey % 4] AS modifier FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT node_id, 'PNC' AS rule, node AS replacement FROM v JOIN c ON v.region = c.ancestor UNION ALL SELECT node_id, r, ancestor FROM v JOIN c ON v.nation = c.node, (VALUES ('PMD'), ('PPD'), ('PCC')) t(r)
UNION ALL SELECT node_id, 'PCI', '((' || ancestor || ')v' || node_id || ')' FROM v JOIN c ON v.nation = c.node UNION ALL SELECT node_id, 'AMC', m FROM v, (VALUES ('public'), ('protected'), ('private'), ('')) t(m) WHERE m <> modifier""")
def type_rules(t, spark):
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    closure = lineage.ancestors(places.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent")))
    access = F.get(F.array(*[F.lit(a) for a in class_rules.ACCESS]), F.col("c_custkey") % 4)
    rows = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("node_id"), "n_name", "r_name", access.alias("modifier"), F.concat(F.lit("v"), F.col("c_custkey")).alias("text"))
    of = lambda kind, name: rows.select("node_id", "modifier", "text", F.lit(kind).alias("kind"), F.col(name).alias("lhs_type"))
    found = [class_rules.type_changes(of(kind, "r_name" if way == "down" else "n_name"), closure, rule) for rule, (kind, way) in class_rules.TYPES.items()]
    found += [class_rules.cast_insertions(of("Variable", "n_name"), closure), class_rules.access_changes(of("Field", "n_name"))]
    return reduce(DataFrame.union, [x.select("node_id", "rule", "replacement") for x in found])


@query("""WITH RECURSIVE t AS (SELECT l_orderkey::VARCHAR AS target, l_suppkey::VARCHAR AS test, list(DISTINCT l_linenumber::VARCHAR) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY len(m) DESC, test) AS k FROM t),
f AS (SELECT target, test, k, m AS killed, 1 AS kept, len(m) AS gain FROM r WHERE k = 1 UNION ALL
  SELECT target, test, k, list_concat(killed, fresh), kept + CASE WHEN len(fresh) > 0 THEN 1 ELSE 0 END, len(fresh) FROM
  (SELECT r.target, r.test, r.k, f.killed, f.kept, list_filter(r.m, lambda x: NOT list_contains(f.killed, x)) AS fresh FROM f JOIN r ON r.target = f.target AND r.k = f.k + 1))
SELECT target, test, (kept - 1)::INTEGER AS ordinal, gain::INTEGER AS gain FROM f WHERE gain > 0""")
def greedy_minimise(t, spark):
    rows = t("lineitem").select(F.col("l_orderkey").alias("target"), F.col("l_suppkey").alias("test"), F.col("l_linenumber").alias("mutant"), (F.col("l_returnflag") == "R").alias("failed"))
    return aggregates.greedy_suites(rows, "target", "test", "mutant")


@query("""SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positives, list_max(embedding)::DOUBLE AS top, len(list_filter(embedding, lambda x: x < embedding[1])) AS below_first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2 FROM embeddings""")
def array_fns(t, spark):
    e = F.col("embedding")
    return t("embeddings").select(
        "vec_id", F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positives"), F.array_max(e).cast("double").alias("top"), ordering.lower_position(e, F.get(e, F.lit(0))).cast("bigint").alias("below_first"),
        F.round(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")), 6).alias("norm2"),
    )


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(t, spark):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS merged FROM conversations WHERE role = 'user' GROUP BY 1")
def merged_asserts(t, spark):
    return aggregates.merged_text(t("conversations").filter("role = 'user'"), "conv_id", "text", "turn")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / (count(*) - 1) AS pass_rate FROM orders")
def repair_pass_rate(t, spark):
    return aggregates.pass_rate(t("orders").select(F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "fail").alias("status")))


@query("SELECT DISTINCT n_name AS class, s_name AS depends_on FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 8000")
def dependency_edges(t, spark):
    names = t("supplier").filter("s_acctbal > 8000").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("names"))
    classes = t("nation").join(names, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("class"), "names")
    return aggregates.dependency_sets(classes, "class", "names")


@query("SELECT event_type, least(20.0, min(value) FILTER (event_id % 16 = 3 AND user_id > 10))::DOUBLE AS bound FROM events GROUP BY 1")
def support_bound(t, spark):
    rows = t("events").select("event_type", F.col("value").alias("key"), (F.col("user_id") - 10).alias("value"), (F.col("event_id") % 16).alias("bucket"))
    return rows.groupBy("event_type").agg(aggregates.least_key(F.lit(20.0), F.col("bucket") == 3).alias("bound"))


@query("SELECT n_name AS class, s_name AS depends_on FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE NOT starts_with(s_name, 'java.') AND NOT starts_with(s_name, 'javax.') AND s_name NOT IN ('String', 'Integer', 'Boolean', 'Long', 'Double', 'Float', 'Short', 'Byte', 'Character')")
def foreign_dependencies(t, spark):
    both = t("nation").join(t("supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    return both.filter(selection.foreign_type(F.col("s_name"))).select(F.col("n_name").alias("class"), F.col("s_name").alias("depends_on"))


@query("SELECT user_id, max(event_id % 11) + 1 AS rows, max(event_id % 7) + 1 AS cols FROM events GROUP BY 1")
def table_extents(t, spark):
    return aggregates.extents(t("events").select("user_id", (F.col("event_id") % 11).alias("row"), (F.col("event_id") % 7).alias("col")), "user_id")


@query("""SELECT conv_id, max(turn) AS last_turn, count(*) FILTER (role = 'user') AS asked, count(*) FILTER (role = 'user') = 0 AS finished FROM conversations GROUP BY 1""")
def round_limits(t, spark):
    rows = t("conversations").select("conv_id", "turn", (F.col("role") != "user").alias("killed"), F.lit(False).alias("used"))
    done = selection.finished_targets(rows, "conv_id")
    return rows.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count_if(~F.col("killed")).alias("asked")).join(done, "conv_id")


@query("SELECT event_id FROM events WHERE value > 90 OR (event_id % 600) IN (408, 409, 425, 429) OR (event_id % 600) BETWEEN 500 AND 599")
def retried_calls(t, spark):
    return t("events").filter(selection.retried((F.col("event_id") % 600).cast("int"), F.col("value") > 90)).select("event_id")


@query("SELECT p_partkey, lpad(md5(p_name), 32, '0') AS file, p_type || ' => ' || p_name AS change, p_type AS before, p_name AS after FROM part")
def change_text(t, spark):
    change = F.concat(F.col("p_type"), F.lit(" => "), F.col("p_name"))
    return t("part").select("p_partkey", F.md5(F.col("p_name").cast("binary")).alias("file"), change.alias("change"), text.change_parts(change).alias("x")).select("p_partkey", "file", "change", "x.before", "x.after")


@query("SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS done FROM orders GROUP BY CUBE (o_orderpriority)")
def cube_totals(t, spark):
    return t("orders").cube("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("done"))


@query("""WITH RECURSIVE g AS (SELECT l_orderkey AS k, count(*) AS n, row_number() OVER (ORDER BY l_orderkey) AS i FROM lineitem GROUP BY 1),
f AS (SELECT i, k, least(n, 4) AS take, CASE WHEN n >= 4 THEN 0 ELSE n END AS held FROM g WHERE i = 1 UNION ALL
  SELECT g.i, g.k, least(g.n, 4 - f.held), CASE WHEN g.n >= 4 - f.held THEN 0 ELSE f.held + g.n END FROM f JOIN g ON g.i = f.i + 1 WHERE g.i <= 9)
SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) JOIN f ON k = l_orderkey AND r <= take""")
def quota_carried(t, spark):
    return ordering.quota_carried(t("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 4, 9)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def whole_batches(t, spark):
    batches = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") == "F").alias("finished"))
    return selection.whole_batches(t("lineitem"), batches, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_partkey AS node_id, ['<', '==', '-', '+='][1 + p_size % 4] AS op, p_name AS a, p_type AS b FROM part)
SELECT node_id, 'ROR' AS rule, new FROM n, (VALUES ('true'), ('false')) v(new) WHERE op IN ('<', '==') UNION ALL
SELECT node_id, 'ODL', CASE WHEN op = '-' THEN a ELSE a || ' = ' || b END FROM n WHERE op IN ('-', '+=')""")
def rule_literals(t, spark):
    op = F.get(F.array(*[F.lit(s) for s in ("<", "==", "-", "+=")]), F.col("p_size") % 4)
    kind = F.when(op == "-", "Unary").when(op == "+=", "Assignment").otherwise("Binary")
    said = F.when(op == "-", F.concat(F.lit("-"), F.col("p_name"))).otherwise(F.concat_ws(" ", "p_name", op, "p_type"))
    nodes = t("part").select(F.col("p_partkey").alias("node_id"), kind.alias("kind"), op.alias("operator"), said.alias("text"))
    return rules.relational_literals(nodes).unionByName(rules.operator_deletions(nodes)).select("node_id", "rule", F.col("replacement").alias("new"))


@query("""SELECT c_custkey, 'public void test' || CASE WHEN c_custkey % 20 < 10 THEN 0 ELSE c_custkey % 20 END || '() throws Throwable {' || c_name || '} public void test5() { test6(); } public void test'
  || CASE WHEN c_custkey % 20 < 10 THEN 1 ELSE 0 END || '() throws Throwable {' AS text FROM customer""")
def numbered_tests(t, spark):
    one = F.concat(F.lit("public void test"), (F.col("c_custkey") % 20).cast("string"), F.lit("() throws Throwable {"), F.col("c_name"), F.lit("} public void test5() { test6(); } public void test9() throws Throwable {"))
    return t("customer").select("c_custkey", text.renumbered_tests(one).alias("text"))


@query("""SELECT n_nationkey, to_json({'extraction_method': 'lattice', 'page_number': n_regionkey, 'top': n_nationkey, 'left': 1, 'width': 2, 'height': 3, 'right': 4, 'bottom': 5, 'data': [[{'text': n_name}, {'text': ''}]]})::VARCHAR AS doc FROM nation""")
def table_documents(t, spark):
    cells = F.array(F.array(F.struct(F.col("n_name").alias("text")), F.struct(F.lit("").alias("text"))))
    fields = {"extraction_method": F.lit("lattice"), "page_number": F.col("n_regionkey"), "top": F.col("n_nationkey"), "left": F.lit(1), "width": F.lit(2), "height": F.lit(3), "right": F.lit(4), "bottom": F.lit(5)}
    return t("nation").withColumns(fields).select("n_nationkey", convert.table_json(cells).alias("doc"))


_DAY, _RUN = 86_400, {"target": 2000, "test": 30, "keep": 4000}


@query(f"""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, epoch(o_orderdate)::BIGINT + o_orderkey % 80000 AS ts FROM orders),
t AS (SELECT c, min(ts) AS opened, min(ts) + {_RUN["target"] * _DAY} AS due, CASE WHEN c % 3 <> 0 THEN max(ts) + {45 * _DAY} END AS finish FROM o GROUP BY 1),
w AS (SELECT greatest((SELECT max(finish) FROM t), (SELECT max(ts + CASE s WHEN 'F' THEN k % 40 WHEN 'O' THEN k % 20 ELSE 0 END * {_DAY}) FROM o)) AS wm),
u AS (SELECT *, CASE WHEN finish <= due THEN finish WHEN finish > due OR due < wm THEN due END AS settled, finish <= due AS ok FROM t, w),
e AS (SELECT o.*, u.due, settled, ok, wm, CASE s WHEN 'F' THEN ts + k % 40 * {_DAY} WHEN 'O' THEN ts + k % 20 * {_DAY} END AS ended FROM o JOIN u USING (c) WHERE ts <= u.due)
SELECT c::VARCHAR AS target, CASE WHEN ok THEN 'LIVE' ELSE 'EXCLUDED' END AS report, k::VARCHAR AS mutant, NULL::VARCHAR AS test, NULL::BIGINT AS known_kills FROM e WHERE settled IS NOT NULL AND NOT coalesce(s = 'F' AND k % 5 <= 3 AND ended - ts <= {_RUN["test"] * _DAY} AND ended <= settled, false)
UNION ALL SELECT c::VARCHAR, CASE WHEN ok THEN 'DONE' ELSE 'TIMED_OUT' END, NULL, NULL, (SELECT count(*) FROM e WHERE e.c = u.c AND s = 'F' AND k % 5 <= 3 AND ended - ts <= {_RUN["test"] * _DAY} AND ended <= u.settled) FROM u WHERE settled IS NOT NULL
UNION ALL SELECT c::VARCHAR, 'TEST_TIMED_OUT', NULL, 't' || k, NULL FROM e WHERE CASE WHEN ended <= due THEN ended - ts > {_RUN["test"] * _DAY} ELSE ts + {_RUN["test"] * _DAY} < coalesce(settled, wm) END""")
def round_loop(t, spark):
    """Customers are targets and orders their mutants, each with a test that kills it (F), ends (O) or never does; the stream's reports but those by round."""
    from mutagrid.shared import work_folder
    from mutagrid.streaming import rounds, streams

    orders = t("orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * _DAY + F.col("o_orderkey") % 80000).alias("sec"))
    opened = orders.groupBy("c").agg(F.min("sec").alias("opened"), F.max("sec").alias("last"))
    rows = orders.join(opened, "c").withColumn("test", F.concat(F.lit("t"), F.col("k")))
    said = lambda kind, at, **more: F.struct(F.lit(kind).alias("kind"), more.get("mutant", F.lit(None).cast("string")).alias("mutant"), more.get("test", F.lit(None).cast("string")).alias("test"), more.get("since", F.lit(None).cast("long")).alias("since"), at.alias("at"))
    mutant, test, sec = F.col("k").cast("string"), F.col("test"), F.col("sec")
    end = F.when(F.col("s") == "F", said("killed", sec + F.col("k") % 40 * _DAY, mutant=mutant, test=test, since=sec)).when(F.col("s") == "O", said("ended", sec + F.col("k") % 20 * _DAY, test=test, since=sec))
    one = rows.select("c", "opened", (F.col("k") % 5).alias("round"), F.explode(F.array_compact(F.array(said("mutant", sec, mutant=mutant), said("started", sec, test=test, since=sec), end))).alias("e"))
    done = opened.filter("c % 3 <> 0").select("c", "opened", F.lit(0).cast("long").alias("round"), said("finished", F.col("last") + 45 * _DAY).alias("e"))
    time = lambda c: F.timestamp_seconds(c)
    events = one.unionByName(done).select(F.col("c").cast("string").alias("target"), time("opened").alias("opened"), "e.kind", "e.mutant", "e.test", time("e.since").alias("since"), "round", time("e.at").alias("at"))
    root = work_folder(spark, "rounds")
    limits = rounds.Deadlines(_RUN["target"] * _DAY * 1000, _RUN["test"] * _DAY * 1000, _RUN["keep"] * _DAY * 1000, 3)
    # a batch of the stream is all files of one span of time; the query goes on from its checkpoint
    years = [None, 1997, 1999, None]
    for low, high in zip(years, years[1:]):
        part = events if low is None else events.filter(F.col("at") >= F.timestamp_seconds(F.unix_date(F.make_date(F.lit(low), F.lit(1), F.lit(1))) * _DAY))
        part = part if high is None else part.filter(F.col("at") < F.timestamp_seconds(F.unix_date(F.make_date(F.lit(high), F.lit(1), F.lit(1))) * _DAY))
        part.write.mode("append").parquet(f"{root}/in")
        reports = rounds.round_loop(streams.file_stream(spark, f"{root}/in", events.schema, 1 << 30), limits)
        reports.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rounds.REPORTS).parquet(f"{root}/out").filter(F.col("report") != rounds.ROUND).select("target", "report", "mutant", "test", "known_kills")


@query("""SELECT l_orderkey, l_linenumber, sum(l_partkey) OVER w::BIGINT AS parts, max(l_suppkey) OVER w AS most, count(*) OVER w AS n, last_value(CASE WHEN l_returnflag = 'R' THEN l_partkey END IGNORE NULLS) OVER w AS returned,
  lag(l_returnflag) OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS flag_before FROM lineitem WINDOW w AS (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)""")
def one_key_scan(t, spark):
    """All rows as one key, in blocks."""
    rows = t("lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.lit(0).alias("all"))
    values = {"parts": ("sum", F.col("l_partkey")), "most": ("max", F.col("l_suppkey")), "n": ("count", F.lit(1)), "returned": ("last", F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))), "flag_before": ("before", F.col("l_returnflag"))}
    found = scans.blocked(rows, ["all"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], values)
    return found.select("l_orderkey", "l_linenumber", *values)


# scopes within scopes: extents of 4^k orders, aligned to their size, with three names and files of 1,024 orders
_SCOPES = """s AS (SELECT o_orderkey AS id, o_orderkey // 1024 AS file, 'n' || o_custkey % 3 AS name, o_orderkey % 5 AS level, o_orderkey // (4 ** (o_orderkey % 5))::BIGINT * (4 ** (o_orderkey % 5))::BIGINT * 10 AS start,
  (o_orderkey // (4 ** (o_orderkey % 5))::BIGINT + 1) * (4 ** (o_orderkey % 5))::BIGINT * 10 - 1 AS stop, o_orderstatus AS kind FROM orders),
r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey // 1024 AS file, 'n' || l_partkey % 3 AS name, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)"""


def _scopes(t):
    k = F.col("o_orderkey")
    size = F.pow(F.lit(4), k % 5).cast("long")
    start = F.floor(k / size) * size * 10
    scopes = t("orders").select(k.alias("id"), F.floor(k / 1024).alias("file"), F.concat(F.lit("n"), F.col("o_custkey") % 3).alias("name"), start.alias("start"), (start + size * 10 - 1).alias("end"), F.col("o_orderstatus").alias("kind"))
    o = F.col("l_orderkey")
    refs = t("lineitem").select("l_orderkey", "l_linenumber", F.floor(o / 1024).alias("file"), F.concat(F.lit("n"), F.col("l_partkey") % 3).alias("name"), (o * 10 + F.col("l_linenumber")).alias("at")).distinct()
    return scopes, refs


@query(f"""WITH {_SCOPES} SELECT l_orderkey, l_linenumber, r.name, arg_max(s.id, (s.start, -s.stop, s.id)) AS declared_by FROM r LEFT JOIN s ON r.file = s.file AND r.name = s.name AND pos BETWEEN start AND stop GROUP BY 1, 2, 3""")
def scope_bindings(t, spark):
    scopes_, refs = _scopes(t)
    return scopes.bound(refs, scopes_, ["file", "name"], "at", "id").select("l_orderkey", "l_linenumber", "name", "declared_by")


@query(f"""WITH {_SCOPES}, m AS (SELECT r.*, arg_max(CASE WHEN s.id % 7 = 0 THEN 'main' ELSE 'run' END, (s.start, -s.stop, s.id)) AS method FROM r LEFT JOIN s ON r.file = s.file AND s.kind = 'P' AND pos BETWEEN start AND stop GROUP BY ALL),
b AS (SELECT m.*, arg_max(s.id * 2 + (s.kind <> 'F')::INTEGER, (s.start, -s.stop, s.id * 2 + (s.kind <> 'F')::INTEGER)) AS d FROM m JOIN s ON m.file = s.file AND m.name = s.name AND s.kind <> 'P' AND pos BETWEEN start AND stop WHERE method IS DISTINCT FROM 'main' GROUP BY ALL)
SELECT id, file, name FROM s WHERE kind = 'F' AND id * 2 NOT IN (SELECT d FROM b WHERE d % 2 = 0)""")
def fields_out_of_reach(t, spark):
    """Orders are fields (F), local variables (O) and methods (P, every seventh is main); line items refer to them."""
    found, refs = _scopes(t)
    methods = found.filter("kind = 'P'").select("file", F.when(F.col("id") % 7 == 0, "main").otherwise("run").alias("method"), "start", "end", "id")
    kinds = {k: found.filter(F.col("kind") == k).select("file", "name", "start", "end", "id") for k in "FO"}
    return scopes.unreferenced_fields(kinds["F"], kinds["O"], methods, refs.select("file", "name", "at")).select("id", "file", "name")


_TREE = """w AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
d AS (SELECT c, k, i, i + min(CASE WHEN i = 0 THEN 0 ELSE 1 + k % 5 - i END) OVER (PARTITION BY c ORDER BY i) AS depth FROM w)"""


def _trees(t):
    """A customer's orders as nodes: each as deep as its number asks for, but no more than one level below the order before it."""
    own = Window.partitionBy("c").orderBy("k")
    rows = t("orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")).withColumn("i", (F.row_number().over(own) - 1).cast("long"))
    depth = F.col("i") + F.min(F.when(F.col("i") == 0, 0).otherwise(1 + F.col("k") % 5 - F.col("i"))).over(Window.partitionBy("c").orderBy("i"))
    kind = F.when(F.col("s") == "F", "Block").otherwise("ExpressionStatement")
    return rows.select(F.col("c").cast("string").alias("file"), F.col("i").alias("node_id"), depth.cast("int").alias("depth"), kind.alias("kind"), F.concat(F.lit("it's "), "k").alias("label"), (F.col("k") * 2).cast("int").alias("pos"), F.lit(2).alias("len"), F.col("k").cast("int").alias("line"), F.col("k").cast("int").alias("line_end"))


@query(f"""WITH {_TREE}, p AS (SELECT a.c, a.i, a.k, a.depth, max(b.i) AS parent_id FROM d a LEFT JOIN d b ON a.c = b.c AND b.depth = a.depth - 1 AND b.i < a.i GROUP BY ALL),
n AS (SELECT c, count(*) AS n, sum(k) AS total FROM w GROUP BY 1),
e AS (SELECT a.c, a.i, coalesce(min(b.i), any_value(n)) - 1 AS last_id FROM d a JOIN n USING (c) LEFT JOIN d b ON a.c = b.c AND b.depth <= a.depth AND b.i > a.i GROUP BY a.c, a.i)
SELECT c::VARCHAR AS file, i AS node_id, parent_id, last_id, last_id - depth AS post_id, depth::INTEGER AS depth, 'it''s ' || k AS label FROM p JOIN e USING (c, i)""")
def tree_numbers(t, spark):
    """Trees written as indented text and as JSON, read again, and numbered: what both forms say alike."""
    columns = ["file", "node_id", "parent_id", "last_id", "post_id", "depth", "label"]
    nodes = _trees(t)
    lines = trees.from_indented(trees.to_indented(nodes)).select(*columns)
    return lines.intersectAll(trees.from_json(trees.to_json(nodes)).select(*columns))


@query(f"""WITH {_TREE}, s AS (SELECT d.*, CASE WHEN o_orderstatus = 'F' THEN 'Block' ELSE 'ExpressionStatement' END AS kind FROM d JOIN orders ON k = o_orderkey),
n AS (SELECT c, count(*) AS n, sum(k) AS total FROM w GROUP BY 1),
e AS (SELECT a.c, a.i, any_value(a.kind) AS kind, any_value(a.depth) AS depth, any_value(n) AS n, any_value(total) AS total, coalesce(min(b.i), any_value(n)) AS stop FROM s a JOIN n USING (c) LEFT JOIN s b ON a.c = b.c AND b.depth <= a.depth AND b.i > a.i GROUP BY a.c, a.i),
p AS (SELECT e.c, e.i, arg_max(p.kind, p.i) AS above FROM e JOIN s p ON p.c = e.c AND p.depth = e.depth - 1 AND p.i < e.i GROUP BY 1, 2),
g AS (SELECT e.c, e.i, sum(x.k) AS gone FROM e JOIN s x ON x.c = e.c AND x.i >= e.i AND x.i < e.stop GROUP BY 1, 2)
SELECT e.c::VARCHAR || '#SDL_' || e.i AS file, n - (stop - e.i) AS nodes, (total - gone)::BIGINT AS lines FROM e JOIN p USING (c, i) JOIN g USING (c, i) WHERE kind = 'ExpressionStatement' AND above = 'Block'""")
def statement_deletions(t, spark):
    """The trees that are left when a statement and all below it are deleted, one for each statement of a block."""
    tree = trees.numbered(_trees(t))
    left = trees.without_statement(tree, trees.statements(tree))
    return left.groupBy("file").agg(F.count("*").alias("nodes"), F.sum("line").alias("lines"))


_SIDES = "p_partkey * 7919 % 1000000 AS l, p_partkey * 104729 % 1000000 AS t, p_partkey * 7919 % 1000000 + p_size * (10 ** (p_partkey % 6))::BIGINT AS r, p_partkey * 104729 % 1000000 + (p_size + 3) * (10 ** (p_partkey // 7 % 5))::BIGINT AS b"


@query(f"""WITH x AS (SELECT p_partkey AS id, p_brand, {_SIDES} FROM part) SELECT q.id AS query_id, x.id AS box_id FROM x q JOIN x ON x.l <= q.r AND q.l <= x.r AND x.t <= q.b AND q.t <= x.b WHERE q.p_brand IN ('Brand#3', 'Brand#11')""")
def boxes_of_any_size(t, spark):
    """Boxes with sides from 1 to some millions in one table, without a cell to choose."""
    k, ten = F.col("p_partkey"), lambda e: F.pow(F.lit(10), e).cast("long")
    x, y = k * 7919 % 1000000, k * 104729 % 1000000
    boxes = t("part").select("p_brand", k.alias("box_id"), x.alias("left"), y.alias("top"), (x + F.col("p_size") * ten(k % 6)).alias("right"), (y + (F.col("p_size") + 3) * ten(F.floor(k / 7) % 5)).alias("bottom"))
    queries = boxes.filter("p_brand in ('Brand#3', 'Brand#11')").drop("p_brand").withColumnRenamed("box_id", "query_id")
    return joins.boxes_meeting(boxes.drop("p_brand"), queries, None, False)


@query("""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, grouping_id(event_type, strftime(ts, '%Y-%m-%d')) AS set_id, count(*) AS n, sum(event_id)::BIGINT AS total, true AS distinct_near, true AS median_near
  FROM events GROUP BY GROUPING SETS ((event_type, strftime(ts, '%Y-%m-%d')), (event_type), (strftime(ts, '%Y-%m-%d')), ())""")
def sketch_cube(t, spark):
    """Parts per day and type, stored, then merged for four grouping sets; both estimates are held against the exact answer."""
    from mutagrid.shared import work_folder

    rule, path = sketches.Sketches(), work_folder(spark, "parts")
    rows = t("events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id", "event_id")
    sketches.stored_parts(rows, path, "day", ["event_type"], "user_id", "event_id", rule)
    stored_ = sketches.read_parts(spark, path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    sets = [["event_type", "day"], ["event_type"], ["day"], []]
    found = sketches.merged(stored_, sets, rule).withColumns({"users": sketches.distinct_count(F.col("distinct")), "median": sketches.quantile(F.col("spread"), 0.5)})
    keys = {"event_type": "_type", "day": "_day", "set_id": "_set"}
    exact = rows.groupingSets([[F.col(k) for k in one] for one in sets], F.col("event_type"), F.col("day")).agg(F.grouping_id().alias("set_id"), F.count_distinct("user_id").alias("known")).withColumnsRenamed(keys)
    near = found.join(exact, (F.col("set_id") == F.col("_set")) & F.col("event_type").eqNullSafe(F.col("_type")) & F.col("day").eqNullSafe(F.col("_day")))
    below = rows.withColumns({"low": F.col("event_type"), "date": F.col("day")}).select("low", "date", "event_id")
    spread = found.select("event_type", "day", "set_id", "median")
    # what lies below each median, of the rows of its group
    met = (F.col("event_type").isNull() | (F.col("low") == F.col("event_type"))) & (F.col("day").isNull() | (F.col("date") == F.col("day")))
    ranks = below.join(F.broadcast(spread), met).groupBy("event_type", "day", "set_id").agg((F.count_if(F.col("event_id") < F.col("median")) / F.count("*")).alias("less"), (F.count_if(F.col("event_id") <= F.col("median")) / F.count("*")).alias("upto")).withColumnsRenamed(keys)
    near = near.drop("_type", "_day", "_set").join(ranks, (F.col("set_id") == F.col("_set")) & F.col("event_type").eqNullSafe(F.col("_type")) & F.col("day").eqNullSafe(F.col("_day")))
    return near.select(
        "event_type", "day", F.col("set_id").cast("long").alias("set_id"), "n", F.col("total").cast("long").alias("total"), (F.abs(F.col("users") - F.col("known")) <= rule.distinct_error * F.col("known")).alias("distinct_near"),
        ((F.col("less") <= 0.5 + rule.rank_error) & (F.col("upto") >= 0.5 - rule.rank_error)).alias("median_near"),
    )


@query("SELECT o_custkey, o_orderkey, o_orderstatus, epoch(o_orderdate)::BIGINT * 100000 + o_orderkey AS place FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def published_orders(t, spark):
    """Orders as a stream of four batches, out of order, that publishes each customer's last one."""
    from mutagrid.shared import work_folder
    from mutagrid.streaming import published, streams

    root = work_folder(spark, "published")
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400 * 100000 + F.col("o_orderkey")).alias("place"))
    for part in range(4):
        rows.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = streams.file_stream(spark, f"{root}/in", rows.schema)
    layout = published.Layout(buckets=4, most=2)
    streams.publish_latest(stream, f"{root}/table", ["o_custkey"], "place", f"{root}/checkpoint", layout).trigger(availableNow=True).start().awaitTermination()
    return published.read_latest(spark, f"{root}/table", "o_custkey long, o_orderkey long, o_orderstatus string, place long", ["o_custkey"], "place")


# a node of each shape: kind, operator, type of both operands, text, kinds and texts of the operands
_SHAPES = [
    ("Binary", "&&", "boolean", "a && b", "Variable", "Variable", "a", "b"), ("Binary", "<<", "int", "x << 2", "Variable", "Constant", "x", "2"), ("Binary", "+", "int", "x + y", "Variable", "Variable", "x", "y"), ("Binary", "<=", "int", "x <= 7", "Variable", "Constant", "x", "7"),
    ("Unary", "-", "int", "-z", None, "Variable", None, "z"), ("Unary", "++", "int", "i++", None, "Field", None, "i"), ("Unary", "!", "boolean", "!p", None, "Field", None, "p"), ("Unary", "~", "int", "~9", None, "Constant", None, "9"),
    ("Variable", None, "int", "v", None, None, None, None), ("Assignment", "+=", "int", "a += 5", "Variable", "Constant", "a", "5"), ("Throw", None, None, "throw e", None, None, None, None), ("Field", None, None, "int f = 1", None, None, None, None),
    ("SuperCall", None, None, "super(a)", None, None, None, None), ("Try", None, None, "try", None, None, None, None), ("Catch", None, None, "catch", None, None, None, None), ("Binary", "&", "int", "m & n", "Variable", "Variable", "m", "n"),
]
_MADE = [
    (0, "COR", "|| ^"), (0, "COI", "!(a&&b)"), (0, "ODL", "a b"), (0, "VDL", "a b"), (1, "SOR", ">> >>>"), (1, "ODL", "2 x"), (1, "CDL", "x"), (1, "VDL", "2"), (2, "AORB", "* / % -"), (2, "AOR", "* / % -"), (2, "ODL", "x y"), (2, "VDL", "x y"),
    (3, "ROR", "< > >= == != true false"), (3, "ODL", "7 x"), (3, "CDL", "x"), (3, "VDL", "7"), (4, "AORU", "+"), (4, "AODU", "z"), (4, "ODL", "z"), (4, "VDL", ""), (5, "AORS", "--"), (5, "AODS", "i"), (5, "ODL", "i"), (6, "COD", "p"), (6, "COI", "!!p"), (6, "ODL", "p"), (7, "LOD", "9"), (7, "ODL", "9"), (7, "CDL", ""),
    (8, "LOI", "~v"), (8, "AOIS", "v++ ++v v-- --v"), (8, "AOIU", "-v"), (9, "ASRS", "-= *= /= %= &= |= ^= <<= >>= >>>="), (9, "ODL", "a=5"), (9, "CDL", "a"), (10, "ETD", ""), (11, "JID", ""), (11, "JSI", "staticintf=1"), (12, "IPC", ""), (13, "EFD", ""), (14, "EHD", ""), (15, "LOR", "| ^"), (15, "ODL", "m n"), (15, "VDL", "m n"),
]


@query(f"""SELECT p_partkey AS node_id, rule, unnest(string_split(made, ' ')) AS new FROM part JOIN (VALUES {', '.join(f"({i}, '{r}', '{m}')" for i, r, m in _MADE)}) v(shape, rule, made) ON p_partkey % 16 = shape""")
def compiled_rules(t, spark):
    """26 rules on parts as nodes of sixteen shapes, in one pass; blanks are left out of what is made."""
    shape = "kind string, operator string, type string, text string, lhs_kind string, rhs_kind string, lhs_text string, rhs_text string"
    fields = [x.split()[0] for x in shape.split(", ")]
    shapes = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(fields, s)]) for s in _SHAPES])
    nodes = t("part").select(F.col("p_partkey").alias("node_id"), F.get(shapes, (F.col("p_partkey") % 16).cast("int")).alias("s")).select("node_id", "s.*")
    flags = {"lhs_type": F.col("type"), "rhs_type": F.col("type"), "is_assign_target": F.lit(False), "in_for_header": F.lit(False), "n_args": F.lit(1), "is_final": F.lit(False), "is_static": F.lit(False), "initialiser": F.lit("1"), "n_catches": F.lit(2), "has_finally": F.lit(True)}
    return rule_compiler.compiled(nodes.withColumns(flags)).select("node_id", "rule", F.replace("replacement", F.lit(" "), F.lit("")).alias("new"))
