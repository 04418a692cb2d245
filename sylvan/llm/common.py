"""Shared pieces of the text operators."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sylvan.session import shared_dir, ship_package

#: The white space of every contract of this list: U+0020 and U+0009..U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Cuts the lineage with files every executor can reach, so a lost executor
    repeats a read and not the work before it, and values such as row ids
    cannot change between two uses.
    """
    path = f"{shared_dir(spark)}/sylvan-llm/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_crc32(key: str = "doc_id") -> Column:
    """crc32 of the id written as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def spare(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any case: ``__stem``, underscores added as needed."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


#: Rows of a lookup table below which it is sent to every executor.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a *written* lookup table for broadcast if its counted rows are few.

    The count reads Parquet footers only. Larger tables keep the shuffle join,
    where adaptive execution splits a hot key.
    """
    return F.broadcast(df) if df.count() <= rows else df


def workers_ready(spark: SparkSession) -> None:
    """Python closures below import ``sylvan`` on the executors."""
    ship_package(spark)


_HELD: dict = {}


def held(key, make):
    """What a worker process keeps between tasks: one thing at a time.

    Workers are reused by later stages; an operator that begins drops what the
    one before it remembered, so a worker's memory is that of one operator.
    """
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop what an earlier operator left in this worker process; called by tasks that hold nothing themselves."""
    if _HELD:
        _HELD.clear()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)
