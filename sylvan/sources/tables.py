"""Parquet tables of a data folder (S8: projected table scans).

Column pruning and filter pushdown are Catalyst's: a ``select`` or
``where`` on the returned DataFrame reaches the Parquet scan
(``ReadSchema`` / ``PushedFilters`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return df


def projected(spark: SparkSession, sf_dir: str, name: str, columns) -> DataFrame:
    """``SELECT c1..cn FROM name`` -- the reference's config-driven load."""
    return table(spark, sf_dir, name, list(columns))
