"""Scan, prep and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvan.functions import columns as C
from sylvan.operators.encode import category_codes, encode_all_text
from sylvan.operators.numbering import batch_counts as _batch_counts
from sylvan.operators.numbering import global_row_number
from sylvan.operators.numbering import ordered_split as _ordered_split
from sylvan.operators.select import capped_halves as _capped_halves
from sylvan.operators.select import split_at, take_first
from sylvan.plans.registry import query
from sylvan.session import scratch_path
from sylvan.sources import files
from sylvan.sources.datasets import DATASETS, load_dataset
from sylvan.sources.tables import table

CUSTOMER_DDL = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
SUPPLIER_DDL = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
ORDERS_NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                "o_orderpriority", "o_year"]
ORDERS_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double",
                "o_orderdate": "timestamp_ntz", "o_year": "smallint"}

TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss"
TS_FMT_DUCK = "%Y-%m-%d %H:%M:%S"


# --- S1-S3: CSV scans of files written from the driver's tables --------------

@query("scan_csv_headerless", "SELECT * FROM customer")
def scan_csv_headerless(spark, sf_dir):
    path = scratch_path(spark, "customer_csv_gz")
    table(spark, sf_dir, "customer").write.option("compression", "gzip").csv(path)
    return files.read_csv_headerless(spark, path, CUSTOMER_DDL)


@query("scan_csv_typed",
       "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
       f"strftime(o_orderdate, '{TS_FMT_DUCK}') AS o_orderdate, o_orderpriority, "
       "CAST(year(o_orderdate) AS SMALLINT) AS o_year FROM orders")
def scan_csv_typed(spark, sf_dir):
    path = scratch_path(spark, "orders_csv_bz2")
    (table(spark, sf_dir, "orders")
     .withColumn("o_year", F.year("o_orderdate"))
     .write.option("compression", "bzip2").csv(path))
    df = files.read_csv_named(spark, path, ORDERS_NAMES, ORDERS_TYPES)
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", TS_FMT_SPARK))


@query("scan_csv_header", "SELECT * FROM supplier")
def scan_csv_header(spark, sf_dir):
    path = scratch_path(spark, "supplier_csv_header")
    sup = table(spark, sf_dir, "supplier")
    sup.select((F.col("s_suppkey") + 1000).alias("idx"), *sup.columns) \
        .write.option("header", True).csv(path)
    return files.read_csv_header(spark, path, "idx bigint, " + SUPPLIER_DDL, drop=["idx"])


# --- S4 / S5 / S8 / U1 ----------------------------------------------------------

@query("row_cap", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def row_cap(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    return take_first(orders, "o_orderkey", 100)


@query("chunk_union", "SELECT * FROM supplier")
def chunk_union(spark, sf_dir):
    """Key ranges laid out by one scan, read one by one and put together again."""
    sup = table(spark, sf_dir, "supplier")
    return files.union_chunks(files.write_key_chunks(sup, "s_suppkey", 3, scratch_path(spark, "chunks")))


@query("chunk_sizes", "SELECT 0 AS outside, CAST(4 AS BIGINT) AS chunks, true AS even, CAST(count(*) AS BIGINT) AS rows FROM orders")
def chunk_sizes(spark, sf_dir):
    """Four chunks of orders by price, null in every tenth row: rows, none outside its range, each near a quarter of the keys."""
    price = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice"))
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]).select("o_orderkey", price.alias("price"))
    chunks = files.write_key_chunks(orders, "price", 4, scratch_path(spark, "chunks"), 0.0)
    sizes = files.union_chunks([c.agg(F.lit(i).alias("i"), F.count("price").alias("keys"), F.count(F.lit(1)).alias("n"),
                                      F.min("price").alias("first"), F.max("price").alias("last")) for i, c in enumerate(chunks)])
    a, b = sizes.alias("a"), sizes.alias("b")  # four rows
    both = a.join(b, F.col("b.i") == F.col("a.i") + 1, "left")
    return both.agg(F.count_if(F.col("a.last") >= F.col("b.first")).cast("int").alias("outside"), F.count(F.lit(1)).alias("chunks"),
                    (F.max("a.keys") * 4 <= F.sum("a.keys") * 1.1 + 4).alias("even"), F.sum("a.n").alias("rows"))


@query("table_projection", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def table_projection(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


# --- P1 / P10: label and feature array ----------------------------------------

_PART_AGG_SQL = ("SELECT l_partkey AS key, CAST(count(*) AS BIGINT) AS label, "
                 "[CAST(sum(l_quantity) AS DOUBLE), max(l_extendedprice), min(l_discount), max(l_tax)] AS xs "
                 "FROM lineitem GROUP BY l_partkey")


@query("features_label",
       "SELECT key, label, CAST(p - 1 AS INTEGER) AS pos, xs[p] AS value "
       f"FROM ({_PART_AGG_SQL}) a, range(1, 5) r(p)")
def features_label(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    per_part = li.groupBy(F.col("l_partkey").alias("key")).agg(
        F.count(F.lit(1)).cast("long").alias("label"),
        F.sum("l_quantity").cast("double").alias("qty"),
        F.max("l_extendedprice").alias("price"),
        F.min("l_discount").alias("discount"),
        F.max("l_tax").alias("tax"))
    label = "label"
    feats = [c for c in per_part.columns if c not in ("key", label)]
    sep = per_part.select("key", label, C.pack(feats).alias("xs"))
    return sep.select("key", label, F.posexplode("xs").alias("pos", "value"))


@query("pack_features",
       "SELECT o_orderkey AS key, CAST(o_orderstatus = 'F' AS INTEGER) AS label, "
       "CAST(p - 1 AS INTEGER) AS pos, "
       "[CAST(o_custkey AS DOUBLE), o_totalprice, CAST(year(o_orderdate) AS DOUBLE)][p] AS value "
       "FROM orders, range(1, 4) r(p)")
def pack_features(spark, sf_dir):
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
                                        "o_orderstatus"])
    packed = o.select(F.col("o_orderkey").alias("key"),
                      (F.col("o_orderstatus") == "F").cast("int").alias("label"),
                      C.pack(["o_custkey", "o_totalprice", F.year("o_orderdate")]).alias("xs"))
    return packed.select("key", "label", F.posexplode("xs").alias("pos", "value"))


# --- P2 / P4 / P6 / P7 -------------------------------------------------------------

@query("cast_features",
       "SELECT event_id, CAST(value AS FLOAT) AS value_f32, CAST(user_id AS SMALLINT) AS user_i16, "
       "CAST(CAST(event_type = 'purchase' AS INTEGER) AS TINYINT) AS label_i8, "
       "CAST(user_id AS INTEGER) AS user_i32 FROM events")
def cast_features(spark, sf_dir):
    """Every event once; an id beyond smallint has no ``user_i16`` and stands in ``user_i32``, whose cast stays strict, so none is lost."""
    ev = table(spark, sf_dir, "events", ["event_id", "value", "user_id", "event_type"])
    return ev.select("event_id", C.as_float32("value").alias("value_f32"),
                     C.as_int16("user_id", strict=False).alias("user_i16"),
                     C.as_int8((F.col("event_type") == "purchase").cast("int")).alias("label_i8"),
                     C.as_int32("user_id").alias("user_i32"))


@query("label_last",
       "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority, o_totalprice AS label FROM orders")
def label_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    renamed = o.withColumnRenamed("o_totalprice", "label")
    return renamed.select(*[c for c in renamed.columns if c != "label"], "label")


@query("label_binarise",
       "SELECT event_id, CAST(value > 50 AS INTEGER) AS label FROM events")
def label_binarise(spark, sf_dir):
    ev = table(spark, sf_dir, "events", ["event_id", "value"])
    return ev.select("event_id", C.binarise("value", 50).alias("label"))


@query("label_shift", "SELECT vec_id, label - 1 AS label FROM embeddings")
def label_shift(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    return emb.select("vec_id", C.shift_down("label").alias("label"))


# --- P5: category codes --------------------------------------------------------------

@query("category_codes",
       "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS b FROM part), "
       "d AS (SELECT b, CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS code "
       "FROM (SELECT DISTINCT b FROM p WHERE b IS NOT NULL) x) "
       "SELECT p.p_partkey, CAST(coalesce(d.code, -1) AS INTEGER) AS code FROM p LEFT JOIN d ON p.b = d.b")
def category_codes_q(spark, sf_dir):
    part = table(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    part = part.withColumn("p_brand", F.when(F.col("p_partkey") % 11 == 0, F.lit(None))
                           .otherwise(F.col("p_brand")))
    return category_codes(part, "p_brand", out="code").select("p_partkey", "code")


def _sql_codes(column: str) -> str:
    return (f"CAST(coalesce((SELECT c FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS c FROM "
            f"(SELECT DISTINCT {column} AS v FROM part WHERE {column} IS NOT NULL) x) d WHERE d.v = part.{column}), -1) AS INTEGER) AS {column}")


@query("encode_text_columns", "SELECT p_partkey, p_size, p_retailprice, "
       + ", ".join(_sql_codes(c) for c in ("p_name", "p_brand", "p_type")) + " FROM part")
def encode_text_columns(spark, sf_dir):
    """P5 for every text column of a table, dictionaries found in one pass."""
    return encode_all_text(table(spark, sf_dir, "part"))


@query("scan_dataset", "SELECT CAST(label % 2 AS INTEGER) AS label, "
       + ", ".join(f"CAST(embedding[{i}] AS FLOAT) AS {c}" for i, c in enumerate(DATASETS["higgs"].columns) if i) + " FROM embeddings")
def scan_dataset(spark, sf_dir):
    """S1 / P1 by data-set name: a headerless gzip file in the set's layout, read by its schema."""
    path = scratch_path(spark, "higgs_csv_gz")
    emb = table(spark, sf_dir, "embeddings", ["label", "embedding"])
    emb.select((F.col("label") % 2).cast("float"), *[F.col("embedding")[i].alias(f"e{i}") for i in range(28)]) \
       .write.option("compression", "gzip").csv(path)
    return load_dataset(spark, "higgs", path)


# --- P8 / P9 / P11 / P16 ---------------------------------------------------------------

@query("digits_to_number",
       "SELECT c_custkey, CAST(nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '') AS BIGINT) AS digits, "
       "CAST(CAST(nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '') AS FLOAT) AS DOUBLE) AS digits_f32 "
       "FROM customer")
def digits_to_number(spark, sf_dir):
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    return c.select("c_custkey", C.digits_to_long("c_name").alias("digits"),
                    C.digits_to_float32("c_name").cast("double").alias("digits_f32"))


@query("datetime_split",
       "SELECT event_id, CAST(strftime(ts, '%d%m%Y') AS BIGINT) AS day_no, "
       "CAST(strftime(ts, '%H%M') AS INTEGER) AS minute_no, "
       "CAST(strftime(CAST(strptime(strftime(ts, '%Y-%m-%dT%H:%M'), '%Y-%m-%dT%H:%M') AS TIMESTAMP), "
       "'%H%M') AS INTEGER) AS minute_from_text FROM events")
def datetime_split(spark, sf_dir):
    ev = table(spark, sf_dir, "events", ["event_id", "ts"])
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    return ev.select("event_id", C.day_number("ts").alias("day_no"),
                     C.minute_number("ts").alias("minute_no"),
                     C.minute_number(C.parse_minute_text(text)).alias("minute_from_text"))


@query("unpack_array",
       "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64))
       + " FROM embeddings")
def unpack_array(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return C.unpack(emb, "embedding", 64, "f", "double", keep=["vec_id"])


@query("json_params",
       "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_params(spark, sf_dir):
    ev = table(spark, sf_dir, "events", ["event_id", "props"])
    return ev.select("event_id", C.json_field("props", "$.k", "int").alias("k"))


# --- L1-L3 / P15 ------------------------------------------------------------------------

@query("ordered_split",
       "SELECT o_orderkey, row_no, CASE WHEN row_no < n_train THEN 'train' ELSE 'test' END AS split FROM ("
       "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no, "
       "CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS n_train FROM orders)")
def ordered_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders", ["o_orderkey"])
    return _ordered_split(o, "o_orderkey", 0.8).select("o_orderkey", "row_no", "split")


_HOT = "CASE WHEN event_id % 3 = 0 THEN 77 ELSE user_id END"


@query("split_hot_key", f"SELECT event_id, CASE WHEN row_number() OVER (ORDER BY {_HOT}, event_type, event_id) <= floor(count(*) OVER () * 0.8) "
       "THEN 'train' ELSE 'test' END AS split FROM events")
def split_hot_key(spark, sf_dir):
    """L1 by the cut key, no row numbers: a third of the rows on the first key, a text as the second."""
    ev = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"])
    ev = ev.withColumn("k", F.when(F.col("event_id") % 3 == 0, F.lit(77)).otherwise(F.col("user_id")))
    return split_at(ev, ["k", "event_type", "event_id"], 0.8).select("event_id", "split")


@query("cap_by_value", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 333")
def cap_by_value(spark, sf_dir):
    """S4 ordered by a double: quantile rounds."""
    return take_first(table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"]), ["c_acctbal", "c_custkey"], 333)


@query("own_column_names", "SELECT o_orderkey, o_custkey AS _tie, o_custkey + 1 AS _pid, o_custkey + 2 AS _local, o_orderstatus AS _code, o_orderstatus AS _value, "
       "CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_no, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS code FROM orders")
def own_column_names(spark, sf_dir):
    """L1, P5: columns that are called like what operators add for a while keep their values."""
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    own = o.select("o_orderkey", F.col("o_custkey").alias("_tie"), (F.col("o_custkey") + 1).alias("_pid"), (F.col("o_custkey") + 2).alias("_local"),
                   F.col("o_orderstatus").alias("_code"), F.col("o_orderstatus").alias("_value"))
    return category_codes(global_row_number(own, "o_orderkey"), "_value", out="code")


@query("capped_halves",
       "(SELECT o_orderkey, o_totalprice, 'train' AS source FROM orders WHERE o_orderstatus = 'F' "
       "ORDER BY o_orderkey LIMIT 500) UNION ALL "
       "(SELECT o_orderkey, o_totalprice, 'test' AS source FROM orders WHERE o_orderstatus <> 'F' "
       "ORDER BY o_orderkey LIMIT 500)")
def capped_halves(spark, sf_dir):
    o = table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"])
    first = o.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    second = o.where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_totalprice")
    return _capped_halves(first, second, "o_orderkey", 1000)


@query("batch_counts",
       "SELECT batch_id, CAST(count(*) AS BIGINT) AS n, count(*) < 1000 AS is_remainder FROM ("
       "SELECT CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 1000) AS BIGINT) AS batch_id "
       "FROM orders) GROUP BY batch_id")
def batch_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders", ["o_orderkey"])
    return _batch_counts(o, "o_orderkey", 1000)


@query("batch_arithmetic",
       "SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) AS n_batches, "
       "CAST(count(*) % 1000 AS BIGINT) AS remainder, CAST(count(*) // 8 AS BIGINT) AS per_worker FROM orders")
def batch_arithmetic(spark, sf_dir):
    """``ceil(n/q)``, ``n % q``, ``n // p`` from one count."""
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "orders", ["o_orderkey"]).agg(
        C.n_batches(n, 1000).alias("n_batches"),
        (n % 1000).cast("long").alias("remainder"),
        F.floor(n / 8).cast("long").alias("per_worker"))


@query("doc_features",
       "WITH d AS (SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS code "
       "FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) x) "
       "SELECT l.doc_id, l.quality AS label, CAST(doc.n_chars AS DOUBLE) AS n_chars, "
       "CAST(coalesce(d.code, -1) AS INTEGER) AS lang_code, l.toxic "
       "FROM labels l JOIN documents doc ON doc.doc_id = l.doc_id LEFT JOIN d ON doc.lang = d.lang")
def doc_features(spark, sf_dir):
    """Labels joined to their documents for features: length and language
    code (P5 on ``lang``); the label first, then the features."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"])
    coded = category_codes(docs, "lang", out="lang_code")
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    j = labels.join(coded, "doc_id")
    return j.select("doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("n_chars"),
                    "lang_code", "toxic")
