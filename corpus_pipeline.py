"""The corpus pipeline: quality rules, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. ``run`` applies them to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mutagrid.llm import bpe, jaccard_join, mixing, quality_rules, secret_scan
from mutagrid.llm.common import Workspace, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_duplicates", jaccard_join.stage),
    ("secrets", secret_scan.stage),
    ("mixture", mixing.stage),
    ("tokens", bpe.stage),
]

#: SQL can express neither the near duplicates on whole tables in time nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.put(name, stage(spark, docs, sf_dir))
    return docs
