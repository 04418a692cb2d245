"""Resource-sample logs and stage-timing logs.

Run attributes come from the log's file name (or its folder), split on '-'
then '_' the way the profiler names them:
  run_scoring.py_-d_<set>_-m_<model>_-f_<framework>_-t_<trees>_
  -batch_size_<n>_--query_size_<n>_{GPU,OUT}_LOG.txt (after a second "-")
Resource lines start with ``[0]``; whitespace tokens 5, 8 and 10 are the
busy %, used MB and total MB; a 14th token ``...(<n>M)`` is the process MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.sources.files import read_text_lines

# Stage keywords in the order they are tested (first wins).
STAGE_KEYWORDS = [("dataframe", "read"), ("predict", "infer"), ("write", "write"), ("load", "load")]


def run_name(path: Column) -> Column:
    """The profiler's run name: the ``run=<name>`` folder if present, else
    the file name."""
    folder = F.regexp_extract(path, r"run=([^/]+)", 1)
    file = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.when(folder != "", folder).otherwise(file)


def run_attributes(name: Column) -> list[Column]:
    parts = F.split(name, "-")

    def field(i, j):
        return F.get(F.split(F.get(parts, F.lit(i)), "_"), F.lit(j))
    return [field(1, 1).alias("dataset"), field(2, 1).alias("algo"), field(3, 1).alias("framework"),
            field(4, 1).cast("int").alias("trees"), field(6, 2).cast("int").alias("batch_size")]


def resource_samples(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``[0]`` sample: run attributes, line order and gauges."""
    lines = read_text_lines(spark, path).where(F.col("line").startswith("[0]"))
    tok = F.split(F.trim(F.col("line")), r"\s+")
    last = F.element_at(tok, -1)
    pyt = F.when(F.size(tok) == 14,
                 F.split(F.get(F.split(last, r"\("), F.size(F.split(last, r"\(")) - 1), "M")
                 .getItem(0).cast("int")).otherwise(F.lit(0))
    name = run_name(F.col("file_path"))
    return lines.select(F.col("file_path"), name.alias("run"), *run_attributes(name),
                        F.col("line_major"), F.col("line_minor"), F.col("line_pos"),
                        F.get(tok, F.lit(5)).cast("int").alias("gpu"),
                        F.get(tok, F.lit(8)).cast("int").alias("mem"),
                        F.get(tok, F.lit(10)).cast("int").alias("max_mem"),
                        pyt.alias("pyt"))


def stage_lines(spark: SparkSession, path: str) -> DataFrame:
    """Timing lines tagged with their stage (first keyword wins) and the
    last whitespace token as the value."""
    lines = read_text_lines(spark, path)
    stage = F.lit(None).cast("string")
    for kw, name in reversed(STAGE_KEYWORDS):
        stage = F.when(F.col("line").contains(kw), F.lit(name)).otherwise(stage)
    name = run_name(F.col("file_path"))
    return lines.select(name.alias("run"), *run_attributes(name), F.col("line_major"), F.col("line_minor"), F.col("line_pos"),
                        stage.alias("stage"),
                        F.element_at(F.split(F.col("line"), " "), -1).try_cast("double").alias("value")) \
        .where(F.col("stage").isNotNull())
