"""File sources: CSV variants, libsvm, chunk unions, JDBC, text logs.

Schemas are always supplied (never inferred).  gzip files are one split
each, so a large ``.gz`` input is repartitioned right after the scan; bz2
and plain text split natively.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.operators.names import spare_name


def read_csv_headerless(spark: SparkSession, path: str, schema: T.StructType | str,
                        repartition: int | None = None) -> DataFrame:
    """Typed CSV without a header (plain, gz or bz2)."""
    df = spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)
    return df.repartition(repartition) if repartition else df


def read_csv_named(spark: SparkSession, path: str, names: Sequence[str],
                   types: dict[str, str] | None = None, default_type: str = "string",
                   header: bool = False) -> DataFrame:
    """CSV with supplied column names; types per name (e.g. smallint)."""
    types = types or {}
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(types.get(n, default_type)))
                           for n in names])
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def read_csv_header(spark: SparkSession, path: str, schema: T.StructType | str,
                    drop: Sequence[str] = ()) -> DataFrame:
    """S3: CSV with a header line; drop e.g. an index column."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return df.drop(*drop) if drop else df


def union_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Bag union of chunks read separately (by column name)."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


def chunk_bounds(df: DataFrame, key: str, n_chunks: int, rel_error: float = 0.001) -> list[float]:
    """The n_chunks - 1 keys that begin a new chunk (none for a table without keys); reads the key column alone."""
    return df.approxQuantile(key, [i / n_chunks for i in range(1, n_chunks)], rel_error)


def write_key_chunks(df: DataFrame, key: str, n_chunks: int, path: str, rel_error: float = 0.001) -> list[DataFrame]:
    """Lay ``df`` out below ``path`` in ``n_chunks`` key ranges and return the chunks, in key order.

    One scan of the table writes all chunks (no shuffle: each task writes its
    rows of each chunk), and a chunk reads its own files only. Every row is in
    exactly one chunk, null keys in the first; chunks may be empty; columns keep
    their names, order and types.
    """
    spark, chunk = df.sparkSession, spare_name(df, "chunk")
    number = F.lit(0)
    for b in chunk_bounds(df, key, n_chunks, rel_error):
        number = number + F.coalesce((F.col(f"`{key}`") >= F.lit(b)).cast("int"), F.lit(0))
    df.withColumn(chunk, number).write.partitionBy(chunk).parquet(path)
    whole = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(chunk, T.IntegerType())])).parquet(path)
    return [whole.where(F.col(chunk) == i).drop(chunk) for i in range(n_chunks)]


def key_range_chunks(df: DataFrame, key: str, n_chunks: int, rel_error: float = 0.001):
    """Split one table into ``n_chunks`` key ranges by filters that reach the scan.

    Every row is in exactly one chunk; null keys are in the first. Each chunk scans
    the table, which pays where row groups are sorted by the key or few chunks are
    read; :func:`write_key_chunks` scans it once.
    """
    bounds = [None] + chunk_bounds(df, key, n_chunks, rel_error) + [None]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        cond = F.lit(True)
        if a is not None:
            cond = cond & (F.col(key) >= F.lit(a))
        if b is not None:
            cond = cond & (F.col(key) < F.lit(b))
        if a is None:
            cond = cond | F.col(key).isNull()
        out.append(df.where(cond))
    return out


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """Sparse svmlight file -> (label double, features vector)."""
    return spark.read.format("libsvm").option("numFeatures", num_features).load(path)


def read_libsvm_long(spark: SparkSession, path: str, one_based: bool = True) -> DataFrame:
    """S6, sparse-native: libsvm text straight into long entries
    ``(row, label, feature, value)`` -- never a dense or 1M-wide vector.

    ``row`` identifies the line (file, split, place in the task); features
    are 0-based in the output. A line without entries gives one row whose
    feature and value are null.
    """
    lines = read_text_lines(spark, path).where(F.trim(F.col("line")) != "")
    tok = F.split(F.trim(F.col("line")), r"\s+")
    rows = lines.select(F.struct("file_path", "line_major", "line_minor").alias("row"),
                        F.get(tok, F.lit(0)).cast("double").alias("label"),
                        F.slice(tok, 2, F.size(tok)).alias("pairs"))
    shift = 1 if one_based else 0
    pair = F.split(F.col("pair"), ":")
    return (rows.select("row", "label", F.explode_outer("pairs").alias("pair"))
            .select("row", "label", (F.get(pair, F.lit(0)).cast("int") - shift).alias("feature"),
                    F.get(pair, F.lit(1)).cast("double").alias("value")))


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, n_partitions: int | None = None,
              properties: dict | None = None) -> DataFrame:
    """Table or query over JDBC.

    A plain query read is a single partition (one connection); with a
    numeric ``partition_column`` and bounds the read is split into
    ``n_partitions`` range queries.
    """
    r = spark.read.format("jdbc").option("url", url)
    if table_or_query.lstrip().lower().startswith("select"):
        r = r.option("dbtable", f"({table_or_query}) q")
    else:
        r = r.option("dbtable", table_or_query)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", n_partitions or 8))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and their order.

    ``line_major`` = part number of the file, then split start in bytes (a log
    written by Spark as several part files is ordered by part number);
    ``line_minor`` = the row's place in its task.  Lines of one split are read
    by one task in file order, so (major, minor) orders the lines of a log even
    when a big file is split across tasks.  ``line_pos`` is both in one decimal
    (9 + 19 + 10 digits; a part number beyond fails the cast), so one hash
    aggregate finds a first or last line.  The file path is percent-decoded.
    """
    df = spark.read.text(path)
    path_col = F.url_decode(F.col("_metadata.file_path"))
    part = F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
                      .try_cast("long"), F.lit(0).cast("long"))
    major = (part.cast("decimal(9,0)") * F.lit(10 ** 9).cast("decimal(10,0)") * F.lit(10 ** 10).cast("decimal(11,0)")
             + F.col("_metadata.file_block_start").cast("decimal(19,0)")).cast("decimal(28,0)")
    minor = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = df.select(path_col.alias("file_path"), major.alias("line_major"), minor.alias("line_minor"),
                      F.col("value").alias("line"))
    pos = F.col("line_major") * F.lit(10 ** 10).cast("decimal(11,0)") + F.col("line_minor").cast("decimal(10,0)")
    return lines.withColumn("line_pos", pos.cast("decimal(38,0)"))


LINE_ORDER = ["line_pos"]
