"""Text categories to integer codes.

Codes follow the sorted order of the distinct values (0, 1, ...); null and
values missing from the dictionary get -1.  The distinct values (a partial
aggregate before their shuffle, so a hot value costs nothing) are written
once to the shared folder; their number and bytes, read from that small
table, decide whether the dictionary is numbered in one task and broadcast,
or numbered with the distributed row numbering and joined with an ordinary
shuffle join (AQE splits skewed keys).  The fact table is read once for the
dictionary, whatever the number of columns, and once for the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.operators.names import spare_names
from sylvan.operators.numbering import global_row_number
from sylvan.session import scratch_path, shared_dir

# Dictionaries up to this many entries and bytes are numbered in one task and broadcast.
MAX_BROADCAST_DICTIONARY = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def _sizes():
    return F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("_value").cast("string"))), F.lit(0)).alias("bytes")


def _few(size, max_broadcast: int) -> bool:
    return size.n <= max_broadcast and size.bytes <= MAX_BROADCAST_BYTES


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    shared_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _numbered(values: DataFrame, small: bool) -> DataFrame:
    if small:
        w = Window.orderBy("_value")
        return values.coalesce(1).select("_value", (F.row_number().over(w) - 1).cast("int").alias("_code"))
    return global_row_number(values, "_value", "_code").withColumn("_code", F.col("_code").cast("int"))


def build_dictionary(df: DataFrame, column: str, max_broadcast: int = MAX_BROADCAST_DICTIONARY):
    """(value, code) for every distinct non-null value; returns (dict_df, small?)."""
    values = _written(df.select(F.col(column).alias("_value")).where(F.col("_value").isNotNull()).distinct(), "dictionary")
    small = _few(values.agg(*_sizes()).first(), max_broadcast)
    return _numbered(values, small), small


def _with_codes(df: DataFrame, column: str, dictionary: DataFrame, small: bool, target: str) -> DataFrame:
    value, number = spare_names(df, "value", "code")
    d = dictionary.select(F.col("_value").alias(value), F.col("_code").alias(number))
    joined = df.join(F.broadcast(d) if small else d, F.col(f"`{column}`") == F.col(value), "left")
    code = F.coalesce(F.col(number), F.lit(-1)).cast("int")
    cols = [code.alias(target) if c == target else F.col(f"`{c}`") for c in df.columns]
    if target not in df.columns:
        cols.append(code.alias(target))
    return joined.select(*cols)


def category_codes(df: DataFrame, column: str, out: str | None = None,
                   dictionary: DataFrame | None = None,
                   max_broadcast: int = MAX_BROADCAST_DICTIONARY) -> DataFrame:
    """Replace (or add as ``out``) the code of ``column``; -1 for null/unseen."""
    if dictionary is None:
        dictionary, small = build_dictionary(df, column, max_broadcast)
    else:
        small = _few(dictionary.agg(*_sizes()).first(), max_broadcast)
    return _with_codes(df, column, dictionary, small, out or column)


def encode_all_text(df: DataFrame, exclude=(), max_broadcast: int = MAX_BROADCAST_DICTIONARY) -> DataFrame:
    """Every string column to codes (the reference encodes all text columns): one pass finds all dictionaries."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in exclude]
    if not cols:
        return df
    cells = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in cols])
    values = _written(df.select(F.explode(cells).alias("p")).select("p.*").where(F.col("_value").isNotNull()).distinct(), "dictionaries")
    sizes = {r["_column"]: r for r in values.groupBy("_column").agg(*_sizes()).collect()}  # one row a column
    for c in cols:
        small = c not in sizes or _few(sizes[c], max_broadcast)
        df = _with_codes(df, c, _numbered(values.where(F.col("_column") == c).select("_value"), small), small, c)
    return df
