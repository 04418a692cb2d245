"""Sink queries: write, read back, compare (K1-K7)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions.sqlfuncs import register_forest_predict
from sylvan.operators import score as S
from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest, sql_score_events
from sylvan.plans.prep import CUSTOMER_DDL
from sylvan.plans.registry import query
from sylvan.session import scratch_path
from sylvan.sinks import writers as W
from sylvan.sinks.versioned import VersionedTable
from sylvan.sources.tables import table

_CUSTOMER_NULLS = ("SELECT c_custkey, c_name, c_nationkey, "
                   "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")


def _name(prefix):
    return f"{prefix}_{uuid.uuid4().hex[:8]}"


@query("sink_csv_roundtrip", _CUSTOMER_NULLS)
def sink_csv_roundtrip(spark, sf_dir):
    """K1: headerless CSV; a null becomes an empty field and reads back null."""
    c = table(spark, sf_dir, "customer")
    c = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).otherwise(F.col("c_acctbal")))
    path = scratch_path(spark, "customer_csv")
    W.write_csv(c, path)
    return spark.read.schema(CUSTOMER_DDL).csv(path)


@query("sink_table_replace", "SELECT * FROM customer")
def sink_table_replace(spark, sf_dir):
    """K2: the table holds only the second write."""
    c = table(spark, sf_dir, "customer")
    name, path = _name("customer_t"), scratch_path(spark, "customer_table")
    W.replace_table(spark, c.where(F.col("c_nationkey") < 5), name, path)
    return W.replace_table(spark, c, name, path)


@query("bulk_load_csv", "SELECT * FROM customer")
def bulk_load_csv(spark, sf_dir):
    """K3: COPY FROM a CSV file into a table created from DDL."""
    csv_path = scratch_path(spark, "customer_copy_csv")
    W.write_csv(table(spark, sf_dir, "customer"), csv_path)
    schema = T._parse_datatype_string(CUSTOMER_DDL)
    return W.bulk_load_csv(spark, _name("customer_copy"), csv_path, schema, scratch_path(spark, "customer_copy"))


@query("sink_array_table",
       "SELECT vec_id, label, CAST(p - 1 AS INTEGER) AS pos, CAST(embedding[p] AS DOUBLE) AS value "
       "FROM embeddings, range(1, 65) r(p)")
def sink_array_table(spark, sf_dir):
    """K4: (key, label, array) table written set-based, read back."""
    emb = table(spark, sf_dir, "embeddings")
    path = scratch_path(spark, "array_table")
    emb.select("vec_id", "label", F.col("embedding").alias("row")).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("vec_id", "label", F.posexplode("row").alias("pos", "value")) \
        .select("vec_id", "label", "pos", F.col("value").cast("double").alias("value"))


_SQL_FX33 = sql_score_events(3, 3)


@query("sink_predictions", f"SELECT event_id, prediction FROM ({_SQL_FX33})")
def sink_predictions(spark, sf_dir):
    """K5: (key, prediction) to Parquet and back."""
    scored = S.score(events_forest(spark, 3, 3), event_features(spark, sf_dir), "event_id", EVENT_FEATURES)
    path = scratch_path(spark, "predictions")
    W.write_predictions(scored, "event_id", path)
    return spark.read.parquet(path)


@query("sink_text_int",
       f"SELECT event_id, CAST(trunc(score * 10) AS INTEGER) AS prediction FROM ({_SQL_FX33})")
def sink_text_int(spark, sf_dir):
    """K6: int() of the score x 10 per line (toward zero), key kept in CSV."""
    scored = S.score(events_forest(spark, 3, 3), event_features(spark, sf_dir), "event_id", EVENT_FEATURES)
    path = scratch_path(spark, "text_int")
    W.write_text_int(scored.select("event_id", (F.col("score") * 10).alias("prediction")), path,
                     key="event_id")
    return spark.read.schema("event_id bigint, prediction int").csv(path)


@query("insert_select_predict", f"SELECT event_id, prediction FROM ({_SQL_FX33})")
def insert_select_predict(spark, sf_dir):
    """K7: CREATE TABLE pred; INSERT INTO pred SELECT forest_predict(...)."""
    register_forest_predict(spark, events_forest(spark, 3, 3), "forest_predict_33")
    view, name = _name("feats"), _name("pred")
    event_features(spark, sf_dir).createOrReplaceTempView(view)
    spark.sql(f"CREATE TABLE {name} (event_id BIGINT, prediction INT) USING parquet "
              f"LOCATION '{scratch_path(spark, 'pred_table')}'")
    spark.sql(f"INSERT INTO {name} SELECT event_id, CAST(forest_predict_33(array(f0, f1, f2, f3)) > 0 AS INT) "
              f"FROM {view}")
    return spark.table(name)


@query("observed_write_stats",
       "SELECT CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS sum_qty, "
       "CAST(count(DISTINCT l_returnflag) AS BIGINT) AS n_flags FROM lineitem")
def observed_write_stats(spark, sf_dir):
    """Row count and sums observed while the table is written (one pass);
    the metrics come back as one row next to the written table."""
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_returnflag"])
    path = scratch_path(spark, "lineitem_copy")
    got = W.write_parquet_observed(li, path, [F.count(F.lit(1)).alias("n"),
                                              F.sum("l_quantity").alias("sum_qty")])
    written = spark.read.parquet(path)
    return written.agg(F.countDistinct("l_returnflag").cast("long").alias("n_flags")).select(
        F.lit(int(got["n"])).cast("long").alias("n"), F.lit(float(got["sum_qty"])).alias("sum_qty"), "n_flags")


@query("versioned_load", "SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def versioned_load(spark, sf_dir):
    """Two loads, one of them retried, and one that died before its commit: each row is there once."""
    schema = T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("s_acctbal", T.DoubleType())])
    path = scratch_path(spark, "versioned")
    for name, table_name, cols in (("load-1", "supplier", ("s_suppkey", "s_acctbal")), ("load-2", "customer", ("c_custkey", "c_acctbal"))):
        rows = table(spark, sf_dir, table_name, list(cols))
        csv = scratch_path(spark, "load_csv")
        W.write_csv(rows.select(F.col(cols[0]).cast("long"), F.col(cols[1]).cast("double")), csv)
        for _ in range(2):
            W.bulk_load_once(spark, csv, schema, path, name)
    # what a writer leaves that was stopped before it could publish
    spark.range(10).select(F.col("id").alias("s_suppkey"), F.lit(0.0).alias("s_acctbal")).write.parquet(f"{path}/data-stopped")
    return VersionedTable(spark, path).read()
