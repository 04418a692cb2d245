"""Data sets by name: file schema, label, task, what to drop, how to read.

``DATASETS[name]`` describes the raw file; :func:`load_dataset` reads it,
drops what the set drops, casts the label and its shift, and leaves text
columns to ``operators.encode``.  Schemas are never inferred.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions.columns import binarise, shift_down
from sylvan.sources.files import read_csv_header, read_csv_headerless, read_libsvm


@dataclass(frozen=True)
class Dataset:
    label: str
    task: str                        # classification | regression
    columns: tuple[str, ...] = ()    # in file order, label included; empty: named by the file's header
    types: tuple[tuple[str, str], ...] = ()   # other than float
    header: bool = True
    drop: tuple[str, ...] = ()
    n_features: int = 0
    positive_above: float | None = None       # label = value > this
    label_from: int = 0              # least label in the file
    format: str = "csv"              # csv | array | libsvm


# Column names of the public data sets, in file order.
_HIGGS = """label leptonpT leptoneta leptonphi missingenergymagnitude missingenergyphi
    jet1pt jet1eta jet1phi jet1btag jet2pt jet2eta jet2phi jet2btag jet3pt jet3eta jet3phi jet3btag
    jet4pt jet4eta jet4phi jet4btag mjj mjjj mlv mjlv mbb mwbb mwwbb"""
_AIRLINE = """Year Month DayofMonth DayofWeek CRSDepTime CRSArrTime UniqueCarrier FlightNum
    ActualElapsedTime Origin Dest Distance Diverted ArrDelay"""
_AIRLINE_TEXT = ("UniqueCarrier", "Origin", "Dest")
_airline = tuple(_AIRLINE.split())
_airline_types = tuple((c, "string" if c in _AIRLINE_TEXT else "smallint") for c in _airline)
_numbered = lambda stem, n: tuple(f"{stem}{i}" for i in range(1, n + 1))

DATASETS = {
    "higgs": Dataset("label", "classification", tuple(_HIGGS.split()), header=False, n_features=28),
    "airline_classification": Dataset("ArrDelay", "classification", _airline, _airline_types, header=False, n_features=13,
                                      positive_above=0),
    "airline_regression": Dataset("ArrDelay", "regression", _airline, _airline_types, header=False, n_features=13),
    "fraud": Dataset("Class", "classification", ("Time", *_numbered("V", 28), "Amount", "Class"), drop=("Time", "Amount"), n_features=28),
    "year": Dataset("year", "regression", ("year", *_numbered("tAvg", 12), *_numbered("tCov", 78)), header=False, n_features=90),
    "epsilon": Dataset("label", "classification", n_features=2000, positive_above=0, format="array"),
    "bosch": Dataset("Response", "classification", drop=("Id",), n_features=968),
    "covtype": Dataset("Cover_Type", "classification", n_features=54, label_from=1),
    "tpcxai_fraud": Dataset("isFraud", "classification", n_features=8),
    "criteo": Dataset("label", "classification", n_features=1_000_000, format="libsvm"),
}


def dataset_schema(name: str, columns: Sequence[str] = ()) -> T.StructType:
    """The raw file's schema; ``columns`` names them (in file order) for sets whose header does."""
    d = DATASETS[name]
    if d.format == "array":
        return T.StructType([T.StructField(d.label, T.FloatType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    if d.format == "libsvm":
        raise ValueError(f"{name} is sparse text without columns")
    names = d.columns or tuple(columns)
    if not names:
        raise ValueError(f"{name} needs its column names, from the file's header")
    types = dict(d.types)
    return T.StructType([T.StructField(c, T._parse_datatype_string(types.get(c, "float"))) for c in names])


def load_dataset(spark: SparkSession, name: str, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """The set's rows: dropped columns gone, label binarised or shifted; a missing value stays null."""
    d = DATASETS[name]
    if d.format == "libsvm":
        return read_libsvm(spark, path, d.n_features)
    schema = dataset_schema(name, columns)
    if d.format == "array":
        df = spark.read.schema(schema).parquet(path)
    elif d.header:
        df = read_csv_header(spark, path, schema, d.drop)
    else:
        df = read_csv_headerless(spark, path, schema)
    label = F.col(d.label)
    if d.positive_above is not None:
        label = binarise(label, d.positive_above)
    elif d.label_from:
        label = shift_down(label, d.label_from)
    if d.task == "classification":
        label = label.cast("int")
    return df.withColumn(d.label, label)
