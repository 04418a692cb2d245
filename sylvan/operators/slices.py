"""Slices ``rows[i*q:(i+1)*q]`` that read only their own files.

Rows are numbered in key order once and laid out in files of at most
``rows_per_file`` consecutive numbers. A zone map (file, first, last) says which
numbers a file holds; a slice looks its files up there and reads those alone, so
what one batch costs depends on the batch, not on the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.operators.names import spare_name
from sylvan.operators.numbering import global_row_number, row_count_of

ROWS_PER_FILE = 1_000_000


class SliceIndex:
    """A numbered table below ``path`` and its zone map."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.zones = spark.read.parquet(f"{self.path}/zones")
        self.rows = spark.read.parquet(f"{self.path}/rows")
        head = self.zones.select("row_column", "n_rows").first()
        self.row_column, self.n_rows = (head.row_column, head.n_rows) if head else (None, 0)

    @classmethod
    def build(cls, df: DataFrame, order_cols, path: str, rows_per_file: int = ROWS_PER_FILE) -> "SliceIndex":
        """Number ``df`` by ``order_cols`` and lay it out; one pass writes, one reads back the numbers alone."""
        spark, row = df.sparkSession, spare_name(df, "row")
        numbered = global_row_number(df, order_cols, row)
        n = row_count_of(numbered, row)
        # ranges of consecutive numbers, one task and file after the other
        tasks = max(1, -(-n // rows_per_file))
        at = F.floor(F.col(row) / F.lit(rows_per_file)).cast("int")
        (numbered.repartitionByRange(tasks, at).sortWithinPartitions(row)
                 .write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows"))
        written = spark.read.parquet(f"{path}/rows")
        zones = (written.select(F.col("_metadata.file_path").alias("file"), F.col(row).alias("r")).groupBy("file")
                        .agg(F.min("r").alias("first"), F.max("r").alias("last")))
        zones.select("file", "first", "last", F.lit(row).alias("row_column"), F.lit(n).cast("long").alias("n_rows")) \
             .write.parquet(f"{path}/zones")
        return cls(spark, path)

    def n_slices(self, q: int) -> int:
        return -(-self.n_rows // q)

    def files(self, first: int, last: int) -> list[str]:
        """The files that hold numbers ``first`` to ``last``: as many as the range needs."""
        return [r.file for r in self.zones.where((F.col("first") <= last) & (F.col("last") >= first)).select("file").collect()]

    def slice(self, i: int, q: int) -> DataFrame:
        """Slice ``i`` of ``q`` rows (fewer at the end), in no particular order, without the number."""
        first, last = i * q, (i + 1) * q - 1
        files = self.files(first, last)
        columns = [c for c in self.rows.columns if c != self.row_column]
        if not files:
            return self.rows.where(F.lit(False)).select(*[F.col(f"`{c}`") for c in columns])
        rows = self.spark.read.schema(self.rows.schema).parquet(*files)
        return rows.where(F.col(self.row_column).between(first, last)).select(*[F.col(f"`{c}`") for c in columns])
