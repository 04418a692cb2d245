"""The first n rows by order statistics: any key type, ties of any size, no exchange of rows."""

import datetime as dt
import decimal
import math

import pytest
from pyspark.sql import functions as F

from sylvan.operators import select as O
from sylvan.operators.numbering import global_row_number, with_batches
from sylvan.operators.encode import category_codes
from sylvan.operators.names import spare_name, spare_names
from sylvan.sources.tables import table

SF = "/root/testdata/sf0.001"
N = 300

KEYS = {
    "bigint": lambda i: (i * 7919) % 311 * 10 ** 15 - 10 ** 17,
    "int": lambda i: (i * 31) % 97 - 50,
    "double": lambda i: [float("nan"), -0.0, 0.0, math.inf, -math.inf, 1e-300, -1e300][i % 7] if i % 3 == 0 else math.sin(i) * 10 ** (i % 9),
    "float": lambda i: float(i % 17) / 4,
    "string": lambda i: ["", "a", "ab", "b", "é", "\U0001F600", "￮", "a\x00"][i % 8] + "x" * (i % 4),
    "date": lambda i: dt.date(1960, 1, 1) + dt.timedelta(days=(i * 37) % 20_000),
    "timestamp": lambda i: dt.datetime(2001, 1, 1) + dt.timedelta(microseconds=(i * 7919) % 10 ** 6 * 977),
    "boolean": lambda i: i % 5 == 0,
    "decimal(20,4)": lambda i: decimal.Decimal((i * 7919) % 1000) / 16,
}


def frame(spark, tmp_path, kind):
    f = KEYS[kind]
    rows = [(i, None if i % 13 == 0 else f(i)) for i in range(N)]
    spark.createDataFrame(rows, f"id long, k {kind}").repartition(4).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


@pytest.mark.parametrize("kind", sorted(KEYS))
def test_every_key_type(spark, tmp_path, kind):
    df = frame(spark, tmp_path, kind)
    want = [r.id for r in df.orderBy("k", "id").collect()]
    for n in (0, 1, 24, 150, 299, 300, 500):
        got = {r.id for r in O.take_first(df, ["k", "id"], n).collect()}
        assert got == set(want[:n]), (kind, n)


def test_tied_rows_are_cut_at_n(spark, tmp_path):
    rows = [(1, f"t{i % 3}") for i in range(200)] + [(2, "x")] * 200 + [(None, "n")] * 50
    spark.createDataFrame(rows, "k int, t string").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for n in (10, 50, 137, 250, 251, 333, 449):
        out = O.take_first(df, "k", n)
        assert out.count() == n and out.columns == ["k", "t"]
        counts = {r.k: r["count"] for r in out.groupBy("k").count().collect()}
        assert counts == {k: c for k, c in ((None, min(n, 50)), (1, min(max(n - 50, 0), 200)), (2, max(n - 250, 0))) if c}
        s = {r.split: r["count"] for r in O.split_at(df, "k", (n + .5) / 450).groupBy("split").count().collect()}
        assert s == {"train": n, "test": 450 - n}


def test_a_split_is_a_filter_over_one_scan(spark):
    o = table(spark, SF, "orders", ["o_orderkey", "o_totalprice"])
    cap = O.take_first(o, "o_orderkey", 100)
    plan = cap._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert "LessThan(o_orderkey," in plan  # it reaches the scan
    split = O.split_at(o, "o_orderkey", 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in split and "Window" not in split and split.count("FileScan") == 1


def test_wide_ranges(spark, tmp_path):
    rows = [(v,) for v in (-(1 << 63), -(1 << 63) + 1, -1, 0, 1, (1 << 63) - 2, (1 << 63) - 1)] * 3
    spark.createDataFrame(rows, "k long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    want = sorted(r[0] for r in rows)
    for n in range(len(rows) + 1):
        assert sorted(r.k for r in O.take_first(df, "k", n).collect()) == want[:n]


def test_empty_table_and_own_names(spark):
    empty = spark.createDataFrame([], "k int, _place string")
    assert O.take_first(empty, "k", 5).count() == 0 and O.split_at(empty, "k", 0.5).count() == 0
    df = spark.createDataFrame([(i % 2, f"p{i % 3}", i % 4) for i in range(40)], "k int, _place string, split int")
    out = O.split_at(df, "k", 0.5)
    assert out.columns == ["k", "_place", "split"] and {r._place for r in out.collect()} == {"p0", "p1", "p2"}
    assert spare_name(df, "place") == "_place_" and spare_names(["_A", "_a_"], "a", "a") == ["_a__", "_a___"]


def test_numbering_and_codes_keep_columns(spark):
    df = spark.createDataFrame([(i, 10 + i, 20 + i, 30 + i, 40 + i, f"c{i % 3}") for i in range(20)],
                               "k int, _tie int, _pid int, _local int, _start int, _code string")
    got = global_row_number(df, "k").orderBy("k").collect()
    assert [tuple(r) for r in got] == [(i, 10 + i, 20 + i, 30 + i, 40 + i, f"c{i % 3}", i) for i in range(20)]
    coded = category_codes(df.withColumn("_value", F.col("_code")), "_code", out="code").orderBy("k").collect()
    assert [(r._tie, r._code, r._value, r.code) for r in coded] == [(10 + i, f"c{i % 3}", f"c{i % 3}", i % 3) for i in range(20)]
    again = with_batches(df.withColumn("row_no", F.lit(-1)), "k", 7).orderBy("k").collect()
    assert [r.batch_id for r in again] == [i // 7 for i in range(20)]
