"""Global row numbers, numbered splits and batches (:mod:`sylvan.operators.select` splits and caps without numbers).

A global ``row_number() OVER (ORDER BY key)`` puts every row through one
task (a ``SinglePartition`` exchange).  Here the rows are range-partitioned
on the order key and sorted inside each partition; each row's place inside
its partition plus the row count of all earlier partitions is its global
number.  The ranged rows are written once as a table in the shared folder,
so the count pass and the numbering pass see the very same partitions even
if an executor is lost in between.  Only one count per partition reaches
the driver; their running sum goes back as a small table that is joined.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.functions.columns import batch_of
from sylvan.operators.names import spare_name, spare_names
from sylvan.session import scratch_path, shared_dir

_LOW_33_BITS = (1 << 33) - 1


def global_row_number(df: DataFrame, order_cols, out: str = "row_no",
                      n_partitions: int | None = None) -> DataFrame:
    """``df`` plus a 0-based ``out`` following ``order_cols`` (ties: any order).

    Ties are broken by a row id, so rows sharing one order value -- even a
    value held by a third of the table -- are range-split over many tasks
    instead of landing in one.
    """
    if isinstance(order_cols, str):
        order_cols = [order_cols]
    spark = df.sparkSession
    shared_dir(spark)
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie, pid, local, start = spare_names([*df.columns, out], "tie", "pid", "local", "start")
    order = [*order_cols, tie]
    ranged = (df.withColumn(tie, F.monotonically_increasing_id())
              .repartitionByRange(n, *order)
              .sortWithinPartitions(*order)
              .withColumn(pid, F.spark_partition_id())
              .withColumn(local, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_33_BITS))))
    # materialise once in the shared folder: both passes below then see the
    # same partitions (range boundaries come from a sample and could differ
    # between two executions of the plan)
    path = scratch_path(spark, "ranged")
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    counts = ranged.groupBy(pid).agg(F.count(F.lit(1)).alias(start)).toPandas().sort_values(pid)  # one row per partition
    acc = int(counts[start].sum())
    starts = spark.createDataFrame(pd.DataFrame({pid: counts[pid], start: counts[start].cumsum() - counts[start]}), f"`{pid}` int, `{start}` long")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    return ranged.join(F.broadcast(starts), pid).select(*kept, (F.col(start) + F.col(local)).alias(out)).withMetadata(out, {"rows": acc})


def row_count_of(numbered: DataFrame, out: str = "row_no") -> int:
    """Total rows, remembered by ``global_row_number`` (no extra job)."""
    return int(numbered.schema[out].metadata["rows"])


def ordered_split(df: DataFrame, order_cols, train_fraction: float,
                  out: str = "split", row_col: str = "row_no") -> DataFrame:
    """First ``floor(n * train_fraction)`` rows in key order -> 'train', rest 'test'."""
    numbered = global_row_number(df, order_cols, row_col)
    n = row_count_of(numbered, row_col)
    n_train = int(n * train_fraction)
    return numbered.withColumn(
        out, F.when(F.col(row_col) < F.lit(n_train), F.lit("train")).otherwise(F.lit("test")))


def batch_counts(df: DataFrame, order_cols, q: int) -> DataFrame:
    """Query-sized slices ``rows[i*q:(i+1)*q]``: batch id, rows, remainder flag."""
    row = spare_name(df, "row")
    # only the order columns are numbered
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    numbered = global_row_number(df.select(*cols), cols, row)
    return (numbered.select(batch_of(row, q).alias("batch_id"))
            .groupBy("batch_id").agg(F.count(F.lit(1)).cast("long").alias("n"))
            .select("batch_id", "n", (F.col("n") < F.lit(q)).alias("is_remainder")))


def with_batches(df: DataFrame, order_cols, q: int, out: str = "batch_id",
                 row_col: str = "row_no") -> DataFrame:
    numbered = global_row_number(df, order_cols, row_col)
    return numbered.withColumn(out, batch_of(row_col, q))
