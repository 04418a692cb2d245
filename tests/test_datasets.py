"""Data sets by name, dictionaries in one pass, row-number offsets as a table."""

import pytest
from pyspark.sql import functions as F

from sylvan.operators.encode import category_codes, encode_all_text
from sylvan.operators.numbering import global_row_number
from sylvan.session import scratch_path
from sylvan.sources.datasets import DATASETS, dataset_schema, load_dataset


def test_column_counts_match_features():
    for name, d in DATASETS.items():
        if d.columns:
            assert len(d.columns) == d.n_features + 1 + len(d.drop), name
            assert len(set(d.columns)) == len(d.columns) and d.label in d.columns, name


def test_labels_drops_and_missing_values(spark):
    cov = scratch_path(spark, "cov")
    spark.createDataFrame([(1.5, 7), (None, 1)], "a double, Cover_Type int").coalesce(1).write.option("header", True).csv(cov)
    got = load_dataset(spark, "covtype", cov, ["a", "Cover_Type"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1.5, 6), (None, 0)]
    bosch = scratch_path(spark, "bosch")
    spark.createDataFrame([(9, None, 1), (8, 0.5, 0)], "Id int, L0 double, Response int").coalesce(1).write.option("header", True).csv(bosch)
    got = load_dataset(spark, "bosch", bosch, ["Id", "L0", "Response"])
    assert got.columns == ["L0", "Response"] and {r["Response"]: r["L0"] for r in got.collect()} == {1: None, 0: 0.5}
    air = scratch_path(spark, "air")
    spark.createDataFrame([(*range(6), "AA", 1, 2, "JFK", "SFO", 3, 0, -4), (*range(6), "AA", 1, 2, "JFK", "SFO", 3, 0, 4)]).write.csv(air)
    assert sorted(r["ArrDelay"] for r in load_dataset(spark, "airline_classification", air).collect()) == [0, 1]
    assert sorted(r["ArrDelay"] for r in load_dataset(spark, "airline_regression", air).collect()) == [-4, 4]
    eps = scratch_path(spark, "eps")
    spark.createDataFrame([(-1.0, [0.5]), (1.0, [0.25])], dataset_schema("epsilon")).write.parquet(eps)
    assert sorted(r["label"] for r in load_dataset(spark, "epsilon", eps).collect()) == [0, 1]


def test_a_set_named_by_its_header_needs_the_names():
    with pytest.raises(ValueError, match="header"):
        dataset_schema("bosch")


def test_all_text_in_one_pass_equals_column_by_column(spark):
    rows = [(i, None if i % 7 == 0 else f"k{i % 5}", "" if i % 3 else "x", None) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    one = df
    for c in "abc":
        one = category_codes(one, c)
    assert sorted(encode_all_text(df).collect()) == sorted(one.collect())
    assert sorted(encode_all_text(df, max_broadcast=1).collect()) == sorted(one.collect())
    plan = encode_all_text(df.where("i > 3"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("> 3") <= 1  # the dictionaries are read back, not found again
    assert encode_all_text(df.limit(0)).count() == 0


def test_large_given_dictionary_is_not_broadcast(spark):
    d = spark.range(50).select(F.col("id").cast("string").alias("_value"), F.col("id").cast("int").alias("_code"))
    df = spark.range(60).select(F.col("id").cast("string").alias("v"))
    out = category_codes(df, "v", "code", d, max_broadcast=10)
    assert {r["v"]: r["code"] for r in out.collect()} == {str(i): i if i < 50 else -1 for i in range(60)}
    assert "ResolvedHint" not in out._jdf.queryExecution().analyzed().toString()


def test_offsets_are_joined_not_literals(spark):
    df = global_row_number(spark.range(1000), "id", "rn", n_partitions=40)
    assert df.where("id = rn").count() == 1000
    assert "array(0" not in df._jdf.queryExecution().analyzed().toString()
    assert global_row_number(spark.range(0), "id", "rn").count() == 0
