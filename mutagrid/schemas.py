"""Explicit schemas of the workload's tables, as DDL texts; nothing is inferred, so drift fails at load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The manifest's frozen columns, in order, and the aliases that may follow.
MANIFEST = (
    "operator string, line int, method string, class string, class_f string, mutation_statement string, package string, project string, "
    "file_path string, original_graph_path string, mutant_graph_path string, equivalent boolean, class_name string, method_signature string"
)
GROUP_KEY = ["project", "class_name", "method_signature"]
#: What a model may see of a mutant; anything else of the manifest stays hidden from prompts.
VISIBLE = ["id", "line", "operator", "status", "mutated_statement"]
KILLS = ("target string, test_id string, mutant_id string, failed boolean, duration_ms bigint")
LINE_COVERAGE = (
    "target string, scope_start_line int, scope_end_line int, covered_line_count bigint, missed_line_count bigint, covered_branch_count bigint, missed_branch_count bigint, "
    "line_covered_ratio double, branch_covered_ratio double"
)
TARGETS = ("target string, state string")
EXECUTIONS = ("run_dir string, execution_id string, elapsed_millis bigint, mutants_executed bigint")
LATEST = ("run_dir string, execution_id string")
AST_NODES = (
    "node_id bigint, parent_id bigint, class string, method_sig string, kind string, operator string, lhs_type string, rhs_type string, text string, line int, "
    "in_for_header boolean, is_final boolean, is_static boolean, n_args int, n_catches int, has_finally boolean, is_assign_target boolean, body_size int, initialiser string"
)
INHERITS = ("child string, parent string")
DEPENDS = ("class string, depends_on string")
CHANGE_RANGE = ("kind string, on_src_side boolean, start_line int, end_line int, node_desc string")
TIMING = (
    "total_millis bigint, classpath_millis bigint, prompt_millis bigint, llm_millis bigint, compile_millis bigint, repair_millis bigint, run_millis bigint, llm_calls int, cache_hits int, repair_rounds int, success boolean"
)
LLM_CALL = ("response string, cache_hit boolean, attempts int, elapsed_millis bigint")
USAGE = (
    "prompt_tokens bigint, input_tokens bigint, completion_tokens bigint, output_tokens bigint, total_tokens bigint, prompt_cache_hit_tokens bigint, prompt_cache_miss_tokens bigint, "
    "prompt_tokens_details struct<cached_tokens:bigint, cache_write_tokens:bigint>, input_tokens_details struct<cached_tokens:bigint, cache_write_tokens:bigint>, completion_tokens_details struct<reasoning_tokens:bigint>, cache_creation_input_tokens bigint"
)
_LIST, _ONE = "struct<comment:string, items:array<string>>", "struct<comment:string, item:string>"
_CFG = f"struct<dominators:{_LIST}, predicates:{_LIST}, control_deps:{_LIST}>"
_DFG = (
    "struct<defs:array<struct<var:string,unit:string>>, uses:array<struct<var:string,unit:string,sink:string>>, kills:array<struct<var:string,unit:string,postdominated:boolean>>, "
    "heap:array<struct<base:string,index:string,kind:string>>, may_throw:array<string>, alias_groups:array<array<string>>>"
)
_SIDE = f"struct<id:string, content:{_ONE}, ir:{_ONE}, affected:array<string>, paths:array<string>, cpg:struct<comment:string, items:array<struct<path:string, cfg:{_CFG}, dfg:{_DFG}>>>>"
EVIDENCE = (f"operator string, diff {_LIST}, domain_assumptions {_LIST}, spec_observed {_LIST}, jimple_changes {_LIST}, origin {_SIDE}, mutant {_SIDE}")

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables of a data folder."""
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def model_visible(mutants: DataFrame) -> DataFrame:
    """Only the columns that a prompt may show; fails if one is missing."""
    return mutants.select(*VISIBLE)
