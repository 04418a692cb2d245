"""Sinks (K1-K7, K10).

Paths are below the shared folder (``session.scratch_path``) unless the
caller passes its own; nothing is written to a machine-local folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.sinks.versioned import VersionedTable


def ddl_of(schema: T.StructType) -> str:
    """K2: a column DDL string from a ``StructType``."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def write_csv(df: DataFrame, path: str, header: bool = False, compression: str | None = None,
              mode: str = "overwrite") -> None:
    """K1: CSV without header by default; null -> empty field."""
    w = df.write.mode(mode).option("header", header).option("nullValue", "")
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def replace_table(spark: SparkSession, df: DataFrame, name: str, path: str) -> DataFrame:
    """K2: the table afterwards holds exactly ``df``.

    The rows are written to a new folder below ``path`` first; a table that is
    there is then pointed at it in one step, so its readers see the old rows
    or the new ones. Only a table of another schema is dropped and created.
    """
    folder = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    have = spark.table(name).schema if spark.catalog.tableExists(name) else None
    if have is not None and ddl_of(have) == ddl_of(df.schema):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{folder}'")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({ddl_of(df.schema)}) USING parquet LOCATION '{folder}'")
    return spark.table(name)


def bulk_load_csv(spark: SparkSession, name: str, path_csv: str, schema: T.StructType, path: str,
                  header: bool = False) -> DataFrame:
    """K3: ``COPY name FROM csv``: typed CSV read, appended to the table."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl_of(schema)}) USING parquet LOCATION '{path}'")
    spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path_csv).write.insertInto(name)
    return spark.table(name)


def write_array_table(df: DataFrame, label: str, features, path: str, array_col: str = "row") -> None:
    """K4: label + one array column, written set-based (not row by row)."""
    arr = F.col(features) if isinstance(features, str) else F.array(*[F.col(c) for c in features])
    df.select(F.col(label), arr.alias(array_col)).write.mode("overwrite").parquet(path)


def write_predictions(scored: DataFrame, key: str, path: str, col: str = "prediction") -> None:
    """K5: (key, prediction) as Parquet."""
    scored.select(key, col).write.mode("overwrite").parquet(path)


def write_text_int(scored: DataFrame, path: str, col: str = "prediction", key: str | None = None) -> None:
    """K6: one ``int(x)`` per line (truncates toward zero, also for
    regression output).  With ``key`` a two-column CSV keeps the key."""
    as_int = F.col(col).cast("int")
    if key:
        scored.select(F.col(key), as_int.alias(col)).write.mode("overwrite").csv(path)
    else:
        scored.select(as_int.cast("string").alias("value")).write.mode("overwrite").text(path)


def append_runs(df: DataFrame, path: str, run_id: str | None = None) -> None:
    """Append one row per run to the ``runs`` table.

    With a ``run_id`` the table is versioned (:mod:`sylvan.sinks.versioned`): a
    retried append adds its rows once. Without one it is a plain Parquet append.
    """
    if run_id is None:
        df.write.mode("append").parquet(path)
    else:
        VersionedTable(df.sparkSession, path).commit(df, run_id, append=True)


def bulk_load_once(spark: SparkSession, path_csv: str, schema: T.StructType, path: str, run_id: str, header: bool = False) -> DataFrame:
    """K3 for loads that may be retried: a CSV's rows are in the table once, all or none of them."""
    table = VersionedTable(spark, path)
    table.commit(spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path_csv), run_id, append=True)
    return table.read()


def write_runs_csv(df: DataFrame, path: str) -> None:
    """K10 (CSV form): header on every file, appended."""
    df.write.mode("append").option("header", True).csv(path)


def write_parquet_observed(df: DataFrame, path: str, metrics) -> dict:
    """Write and count in the same pass (``observe``); returns the
    observed metrics once the write has finished."""
    from pyspark.sql import Observation
    obs = Observation("write_stats")
    df.observe(obs, *metrics).write.mode("overwrite").parquet(path)
    return obs.get

