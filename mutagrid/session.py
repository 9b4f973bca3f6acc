"""The Spark session that tests and benchmarks use; a cluster brings its own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", partitions: int = 8, **extra: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("MUTAGRID_DRIVER_MEMORY", "8g"),
    } | extra
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("mutagrid").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
