"""Registered queries over the given tables, each with the SQL that checks it where SQL can say it.

Every module holds ``QUERIES: dict[name, (callable(spark, sf_dir) -> DataFrame, sql or None)]``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
