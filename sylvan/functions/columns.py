"""Scalar column helpers for preparing feature tables.

All of them are built-in Spark expressions (JVM side, whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P2: down-casts -------------------------------------------------------

def as_float32(c) -> Column:
    return col_(c).cast("float")


def as_int8(c) -> Column:
    return col_(c).cast("tinyint")


def as_int16(c, strict: bool = True) -> Column:
    """Not ``strict``: null for a value that no smallint holds, where the cast would end the job."""
    return col_(c).cast("smallint") if strict else try_as(c, "smallint")


def as_int32(c) -> Column:
    return col_(c).cast("int")


def try_as(c, type_name: str) -> Column:
    """Cast that yields null for dirty input instead of failing (ANSI on)."""
    return col_(c).try_cast(type_name)


# --- P6 / P7: labels ------------------------------------------------------

def binarise(c, above: float = 0.0) -> Column:
    """``x > above`` -> 1, otherwise 0 (strict, like the reference)."""
    return (col_(c) > F.lit(above)).cast("int")


def shift_down(c, by: int = 1) -> Column:
    """Labels 1..k -> 0..k-1."""
    return col_(c) - F.lit(by)


# --- P8: digits only ------------------------------------------------------

def digits_to_long(c) -> Column:
    """Remove every non-digit and read the rest as a number; '' -> null."""
    d = F.regexp_replace(col_(c), "[^0-9]", "")
    return F.when(d == "", F.lit(None).cast("long")).otherwise(try_as(d, "long"))


def digits_to_float32(c) -> Column:
    """Float32 variant kept for parity with the reference (lossy)."""
    d = F.regexp_replace(col_(c), "[^0-9]", "")
    return F.when(d == "", F.lit(None).cast("float")).otherwise(try_as(d, "float"))


# --- P9: timestamp -> two numbers ----------------------------------------

ISO_MINUTE = "yyyy-MM-dd'T'HH:mm"


def parse_minute_text(c) -> Column:
    """Text like ``2024-01-31T07:05`` to a timestamp without zone."""
    return F.try_to_timestamp(col_(c), F.lit(ISO_MINUTE)).cast("timestamp_ntz")


def day_number(ts) -> Column:
    """``ddMMyyyy`` as a number (01022024 -> 1022024)."""
    return F.date_format(col_(ts), "ddMMyyyy").cast("long")


def minute_number(ts) -> Column:
    """``HHmm`` as a number (07:05 -> 705)."""
    return F.date_format(col_(ts), "HHmm").cast("int")


# --- P10 / P11: pack and unpack -------------------------------------------

def pack(cols: Sequence, element_type: str = "double") -> Column:
    return F.array(*[col_(c).cast(element_type) for c in cols])


def unpack(df: DataFrame, array_col: str, width: int, prefix: str = "f",
           element_type: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Array column -> ``width`` plain columns (null past the end)."""
    out = []
    for i in range(width):
        e = F.get(F.col(array_col), F.lit(i))
        if element_type:
            e = e.cast(element_type)
        out.append(e.alias(f"{prefix}{i}"))
    return df.select(*[F.col(k) for k in keep], *out)


def array_width(df: DataFrame, array_col: str) -> int:
    """Widest array in the column (one aggregate job, one value back)."""
    return int(df.agg(F.max(F.size(array_col))).first()[0] or 0)


# --- P15: batch arithmetic -----------------------------------------------

def n_batches(n: Column, q: int) -> Column:
    return F.call_function("div", n.cast("long") + F.lit(q - 1), F.lit(q)).cast("long")


def batch_of(row_no, q: int) -> Column:
    return F.call_function("div", col_(row_no).cast("long"), F.lit(q)).cast("long")


# --- P16: JSON fields -----------------------------------------------------

def json_field(c, path: str, type_name: str = "int") -> Column:
    return try_as(F.get_json_object(col_(c), path), type_name)


def json_struct(c, ddl: str) -> Column:
    return F.from_json(col_(c), ddl)
