"""Slices read only their own files."""

import pytest
from pyspark.sql import functions as F

from sylvan.operators.slices import SliceIndex


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_files_of_a_slice_do_not_grow_with_the_table(spark, tmp_path, n):
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.lit("x").alias("_row"), F.col("id").alias("v")).repartition(7)
    index = SliceIndex.build(df, "k", str(tmp_path / "s"), rows_per_file=500)
    assert index.n_rows == n and index.n_slices(700) == -(-n // 700)
    for i in (0, 1, index.n_slices(700) - 1):
        got = index.slice(i, 700)
        assert got.columns == ["k", "_row", "v"]
        assert sorted(r.k for r in got.collect()) == list(range(i * 700, min((i + 1) * 700, n)))
        assert len(got.inputFiles()) <= 3
    assert index.slice(index.n_slices(700), 700).count() == 0
    whole = [r.k for i in range(index.n_slices(1000)) for r in index.slice(i, 1000).select("k").collect()] if n == 2_000 else []
    assert sorted(whole) == (list(range(n)) if n == 2_000 else [])


def test_ties_and_an_empty_table(spark, tmp_path):
    index = SliceIndex.build(spark.createDataFrame([(1,)] * 30 + [(None,)] * 5, "k int"), "k", str(tmp_path / "a"), rows_per_file=4)
    assert [index.slice(i, 10).count() for i in range(5)] == [10, 10, 10, 5, 0]
    assert [r.k for r in index.slice(0, 5).collect()] == [None] * 5
    empty = SliceIndex.build(spark.createDataFrame([], "k int"), "k", str(tmp_path / "b"))
    assert empty.n_rows == 0 and empty.slice(0, 10).count() == 0
