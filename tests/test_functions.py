"""Column helpers on dirty input: bad dates, empty digits, blank and unseen
categories (ANSI mode stays on: bad values become null, never errors)."""

import pytest
from pyspark.sql import functions as F

from sylvan.functions import columns as C
from sylvan.operators.encode import build_dictionary, category_codes


def test_dirty_text(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-31T07:05", "IBAN 0012-34", "a"),
         (2, "2024-13-45T99:99", "", ""),
         (3, "not a date", "no digits", None)],
        "k int, t string, acct string, cat string")
    out = {r["k"]: r for r in df.select(
        "k", C.minute_number(C.parse_minute_text("t")).alias("hhmm"),
        C.day_number(C.parse_minute_text("t")).alias("day"),
        C.digits_to_long("acct").alias("digits"),
        C.try_as(F.lit("x1"), "int").alias("bad_int")).collect()}
    assert out[1]["hhmm"] == 705 and out[1]["day"] == 31012024 and out[1]["digits"] == 1234
    assert out[2]["hhmm"] is None and out[2]["digits"] is None
    assert out[3]["hhmm"] is None and out[3]["digits"] is None
    assert all(r["bad_int"] is None for r in out.values())


def test_blank_category_is_a_value_null_and_unseen_are_minus_one(spark):
    train = spark.createDataFrame([("a",), ("",), ("b",), (None,)], "cat string")
    d, small = build_dictionary(train, "cat")
    assert small
    codes = dict(d.collect())
    assert codes == {"": 0, "a": 1, "b": 2}
    new = spark.createDataFrame([("b",), ("zz",), (None,), ("",)], "cat string")
    got = [r["cat"] for r in category_codes(new, "cat", dictionary=d).collect()]
    assert sorted(got) == [-1, -1, 0, 2]


def test_pack_unpack_round_trip(spark):
    df = spark.createDataFrame([(1, 1.5, 2.0, None)], "k int, a double, b double, c double")
    packed = df.select("k", C.pack(["a", "b", "c"]).alias("xs"))
    back = C.unpack(packed, "xs", 4, "f", "double", keep=["k"]).first()
    assert (back["f0"], back["f1"], back["f2"], back["f3"]) == (1.5, 2.0, None, None)
    assert C.array_width(packed, "xs") == 3


def test_batch_arithmetic(spark):
    df = spark.range(2501).select(F.count(F.lit(1)).alias("n"))
    r = df.select(C.n_batches(F.col("n"), 1000).alias("b")).first()
    assert r["b"] == 3
    rows = spark.range(2501).select(C.batch_of("id", 1000).alias("b")).groupBy("b").count().collect()
    assert sorted((r["b"], r["count"]) for r in rows) == [(0, 1000), (1, 1000), (2, 501)]


def test_encode_all_text_and_json_struct(spark):
    from sylvan.operators.encode import encode_all_text
    df = spark.createDataFrame([(1, "x", "p", '{"n_estimators": 10, "max_depth": 8}'),
                                (2, "y", "p", '{"n_estimators": 500}')],
                               "k int, a string, b string, params string")
    coded = encode_all_text(df, exclude=("params",))
    assert {f.name: f.dataType.simpleString() for f in coded.schema.fields}["a"] == "int"
    rows = {r["k"]: r for r in coded.select(
        "k", "a", "b", C.json_struct("params", "n_estimators int, max_depth int").alias("hp"),
        C.json_field("params", "$.max_depth").alias("depth")).collect()}
    assert (rows[1]["a"], rows[2]["a"], rows[1]["b"]) == (0, 1, 0)
    assert rows[1]["hp"]["n_estimators"] == 10 and rows[2]["hp"]["max_depth"] is None
    assert rows[1]["depth"] == 8 and rows[2]["depth"] is None


def test_runs_csv_append_keeps_every_row(spark):
    from sylvan.session import scratch_path
    from sylvan.sinks.writers import write_runs_csv
    path = scratch_path(spark, "runs_csv")
    for i in range(2):
        write_runs_csv(spark.createDataFrame([("events", i, 1.5 * i)], "dataset string, run int, total double"), path)
    back = spark.read.option("header", True).schema("dataset string, run int, total double").csv(path)
    assert sorted(r["run"] for r in back.collect()) == [0, 1]


def test_cluster_conf_sizes_partitions():
    from sylvan.session import cluster_conf
    c = cluster_conf(100 * 2 ** 40, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * 2 ** 40 // (256 << 20)
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(cluster_conf(10 ** 6, 16)["spark.sql.shuffle.partitions"]) == 32


def _events_of(spark, path, ids):
    rows = [(i, 0.1 * i, u, "purchase" if i % 2 else "view") for i, u in enumerate(ids)]
    spark.createDataFrame(rows, "event_id long, value double, user_id long, event_type string") \
         .write.parquet(f"{path}/events.parquet")
    return rows


def test_cast_features_keeps_events_whose_user_is_beyond_smallint(spark, tmp_path):
    import __spark_entry__ as E
    from tools.oracle_check import rows_of
    import duckdb
    fits, beyond = [0, 1499, 32767, -32768, None, 7, 7], [32768, -32769, 89999, 65536, 2147483647, -2147483648]
    rows = _events_of(spark, tmp_path, fits + beyond)
    df = E.queries()["cast_features"](spark, str(tmp_path))
    out = df.collect()
    assert dict(df.dtypes)["user_i16"] == "smallint"
    assert sorted(r["event_id"] for r in out) == [r[0] for r in rows]
    got = {r["event_id"]: r for r in out}
    assert [got[i]["user_i32"] for i in range(len(rows))] == fits + beyond
    assert [got[i]["user_i16"] for i in range(len(rows))] == fits + [None] * len(beyond)
    # as the SQL has it, for the rows that its CAST can take
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet') WHERE event_id < {len(fits)}")
    rel = con.sql(E.oracle_sql()["cast_features"])
    assert rows_of(df.columns, [tuple(r) for r in out if r["event_id"] < len(fits)]) == rows_of(rel.columns, rel.fetchall())


def test_cast_features_never_loses_a_user_without_an_error(spark, tmp_path):
    import __spark_entry__ as E
    _events_of(spark, tmp_path, [1, 2147483648])
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        E.queries()["cast_features"](spark, str(tmp_path)).collect()


def test_as_int16_is_strict_unless_told(spark):
    df = spark.createDataFrame([(32768,)], "x long")
    assert df.select(C.as_int16("x", strict=False).alias("y")).first()["y"] is None
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        df.select(C.as_int16("x")).collect()
