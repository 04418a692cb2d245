"""Scoring queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.functions.sqlfuncs import (Project, in_pieces, predict_batch, register_forest_predict, register_forest_table,
                                       register_predict_batch)
from sylvan.operators import score as S
from sylvan.operators.bitvector import score_bitvector
from sylvan.operators.numbering import with_batches
from sylvan.operators.slices import SliceIndex
from sylvan.session import scratch_path
from sylvan.plans.features import (EMBEDDING_RANGES, EVENT_FEATURES, EVENT_RANGES,
                                   embeddings_forest, event_features, events_forest,
                                   sql_event_features, sql_score_events, sql_walk_sums)
from sylvan.plans.registry import query
from sylvan.operators.forest import grid_forest
from sylvan.sources.tables import table

T_, D_ = 10, 4
FEATS = EVENT_FEATURES
BATCH_Q = 1000

SQL_SCORE = sql_score_events(T_, D_)


def _scored(spark, sf_dir, strategy: str, missing: bool = False, **forest_kw):
    x = event_features(spark, sf_dir, missing=missing)
    forest = events_forest(spark, T_, D_, **forest_kw)
    return S.STRATEGIES[strategy](forest, x, "event_id", FEATS)


@query("score_relational", SQL_SCORE)
def score_relational(spark, sf_dir):
    return _scored(spark, sf_dir, "relational")


@query("score_vectorised", SQL_SCORE)
def score_vectorised(spark, sf_dir):
    return _scored(spark, sf_dir, "vectorised")


@query("score_expression", SQL_SCORE)
def score_expression(spark, sf_dir):
    return _scored(spark, sf_dir, "expression")


@query("sql_predict", SQL_SCORE)
def sql_predict(spark, sf_dir):
    """``forest_predict(array(...))`` called from SQL."""
    forest = events_forest(spark, T_, D_)
    register_forest_predict(spark, forest, "forest_predict")
    view = f"event_features_{uuid.uuid4().hex[:8]}"
    event_features(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(
        f"SELECT event_id, score, CAST(score > 0 AS INT) AS prediction FROM ("
        f"SELECT event_id, forest_predict(array(f0, f1, f2, f3)) AS score FROM {view})")


@query("score_pluggable", SQL_SCORE)
def score_pluggable(spark, sf_dir):
    """2.11: a user ``predict(batch)`` function applied per Arrow batch."""
    forest = events_forest(spark, T_, D_)
    arrays = forest.to_arrays()  # model-sized, shipped with the function

    def predict(X):
        swv, _ = S.walk_arrays(arrays, X, "sum")
        return swv

    out = S.score_with_function(event_features(spark, sf_dir), "event_id", FEATS, predict)
    return out.select("event_id", "score", (F.col("score") > 0).cast("int").alias("prediction"))


@query("score_pruned", SQL_SCORE)
def score_pruned(spark, sf_dir):
    """only the feature columns some split reads are scanned."""
    forest = events_forest(spark, T_, D_)
    used = {r[0] for r in forest.used_features().collect()}  # model-sized
    x = event_features(spark, sf_dir)
    feats = [F.col(c) if i in used else F.lit(None).cast("double") for i, c in enumerate(FEATS)]
    return S.score_vectorised(forest, x, "event_id", feats)


@query("score_pruned_features",
       sql_walk_sums(sql_event_features(), "event_id", "[x.f0, x.f1]", T_, D_, EVENT_RANGES[:2])
       + "SELECT k AS event_id, sum(value * tree_weight) AS score, CAST(sum(value * tree_weight) > 0 AS INTEGER) AS prediction FROM leaves GROUP BY k")
def score_pruned_features(spark, sf_dir):
    """of four features the forest reads two, so the columns of the others never leave the file."""
    forest = grid_forest(spark, T_, D_, EVENT_RANGES[:2])
    feats = [F.col("value").cast("float").cast("double"), F.hour("ts").cast("double"),
             (F.col("user_id") % 16).cast("double"), F.octet_length("props").cast("double")]
    used = {r[0] for r in forest.used_features().collect()}  # model-sized
    x = table(spark, sf_dir, "events", ["event_id", "value", "ts", "user_id", "props"])
    return S.score_vectorised(forest, x, "event_id", [c if i in used else F.lit(None).cast("double") for i, c in enumerate(feats)])


@query("score_missing", sql_score_events(T_, D_, missing=True))
def score_missing(spark, sf_dir):
    return _scored(spark, sf_dir, "relational", missing=True)


@query("score_regression", "SELECT event_id, score FROM (" + sql_score_events(T_, D_, combine="mean") + ")")
def score_regression(spark, sf_dir):
    out = _scored(spark, sf_dir, "vectorised", combine="mean", task="regression")
    return out.select("event_id", "score")


_SQL_BOOSTED = ("SELECT event_id, score AS margin, prediction FROM ("
                + sql_score_events(T_, D_) + ")")


@query("score_boosted", _SQL_BOOSTED)
def score_boosted(spark, sf_dir):
    """leaf sum -> logistic; class = margin > 0 (= probability > 0.5)."""
    out = _scored(spark, sf_dir, "expression", combine="logit")
    return out.select("event_id", "margin", "prediction")


# --- multi-class vote over embeddings ---------------------------------------

def _sql_multiclass(n_trees=T_, depth=D_, k=10):
    prefix = sql_walk_sums("SELECT vec_id, embedding FROM embeddings", "vec_id",
                           "CAST(x.embedding AS DOUBLE[])", n_trees, depth, EMBEDDING_RANGES, k)
    sums = ", ".join(f"sum(class_counts[{c + 1}] * tree_weight) AS c{c}" for c in range(k))
    arr = "[" + ", ".join(f"c{c}" for c in range(k)) + "]"
    return (prefix + f", s AS (SELECT k, {sums} FROM leaves GROUP BY k) "
            f"SELECT k AS vec_id, CAST(list_position({arr}, list_max({arr})) - 1 AS INTEGER) "
            f"AS prediction FROM s")


@query("score_multiclass", _sql_multiclass())
def score_multiclass(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    forest = embeddings_forest(spark, T_, D_, n_classes=10)
    return S.score_relational(forest, emb, "vec_id", "embedding").select("vec_id", "prediction")


# --- sparse rows in long form ------------------------------------------------

def _sql_sparse_fast():
    entries = ("SELECT vec_id, CAST(p - 1 AS INTEGER) AS feature, CAST(e AS DOUBLE) AS value "
               "FROM (SELECT vec_id, unnest(embedding) AS e, "
               "unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) WHERE e <> 0")
    dense = (f"SELECT v.vec_id, list_transform(range(1, 65), lambda j: coalesce("
             f"map_extract(m, CAST(j - 1 AS INTEGER))[1], 0.0)) AS xs FROM embeddings v LEFT JOIN "
             f"(SELECT vec_id, map(list(feature), list(value)) AS m FROM ({entries}) GROUP BY vec_id) s "
             f"ON s.vec_id = v.vec_id")
    prefix = sql_walk_sums(dense, "vec_id", "x.xs", T_, D_, EMBEDDING_RANGES)
    return prefix + "SELECT k AS vec_id, sum(value * tree_weight) AS score FROM leaves GROUP BY k"


def sparse_entries(spark, sf_dir):
    """embeddings as long (vec_id, feature, value) entries: all values but zeros, which an absent entry stands for."""
    emb = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return (emb.select("vec_id", F.posexplode("embedding").alias("feature", "value"))
            .where(F.col("value") != 0)
            .select("vec_id", F.col("feature").cast("int"), F.col("value").cast("double")))


@query("score_sparse_long", _sql_sparse_fast())
def score_sparse_long(spark, sf_dir):
    forest = grid_forest(spark, T_, D_, EMBEDDING_RANGES)
    keys = table(spark, sf_dir, "embeddings", ["vec_id"])
    out = S.score_sparse_long(forest, sparse_entries(spark, sf_dir), "vec_id", absent=0.0, keys=keys)
    return out.select("vec_id", "score")


@query("score_sparse_vectorised", _sql_sparse_fast())
def score_sparse_vectorised(spark, sf_dir):
    """F5 vectorised: features looked up in an Arrow batch's sorted entries, no densify."""
    forest = grid_forest(spark, T_, D_, EMBEDDING_RANGES)
    keys = table(spark, sf_dir, "embeddings", ["vec_id"])
    out = S.score_sparse_vectorised(forest, sparse_entries(spark, sf_dir), "vec_id", absent=0.0, keys=keys)
    return out.select("vec_id", "score")


# --- batches (F12 batch form, A9 / F11) ---------------------------------------

_SQL_BATCH_PREFIX_FEATS = sql_event_features(extra=", CAST(floor((row_number() OVER (ORDER BY e.event_id) - 1) / "
                                             f"{BATCH_Q}) AS BIGINT) AS batch_id")


def _sql_batches():
    prefix = sql_walk_sums(_SQL_BATCH_PREFIX_FEATS, "event_id", "[x.f0, x.f1, x.f2, x.f3]",
                           T_, D_, EVENT_RANGES)
    return (prefix + ", s AS (SELECT k, sum(value * tree_weight) AS score FROM leaves GROUP BY k) "
            "SELECT x.event_id, x.batch_id, CAST(s.score > 0 AS INTEGER) AS prediction "
            "FROM s JOIN x ON x.event_id = s.k")


@query("score_batches", _sql_batches())
def score_batches(spark, sf_dir):
    forest = events_forest(spark, T_, D_)
    x = with_batches(event_features(spark, sf_dir), "event_id", BATCH_Q)
    scored = S.score_vectorised(forest, x, "event_id", FEATS, carry=["batch_id"])
    return scored.select("event_id", "batch_id", "prediction")


@query("predict_batch", _sql_batches())
def predict_batch_q(spark, sf_dir):
    forest = events_forest(spark, T_, D_)
    x = with_batches(event_features(spark, sf_dir), "event_id", BATCH_Q)
    out = predict_batch(forest, x, "event_id", FEATS, "batch_id")
    return out.select("event_id", "batch_id", (F.col("score") > 0).cast("int").alias("prediction"))


@query("sql_predict_batch", _sql_batches())
def sql_predict_batch(spark, sf_dir):
    """A9 / F11 as SQL text: ``predict_batch`` over the array of an aggregate, a batch in pieces of at most 300 rows."""
    register_predict_batch(spark, events_forest(spark, T_, D_), "predict_batch")
    in_pieces(with_batches(event_features(spark, sf_dir), "event_id", BATCH_Q), "piece", 300).createOrReplaceTempView("event_batches")
    return spark.sql("""
        SELECT e.k AS event_id, batch_id, CAST(e.s > 0 AS INT) AS prediction
        FROM (SELECT batch_id, rows.k AS k, predict_batch(rows.x) AS s
              FROM (SELECT batch_id, array_agg(struct(event_id AS k, array(f0, f1, f2, f3) AS x)) AS rows
                    FROM event_batches GROUP BY batch_id, piece))
        LATERAL VIEW explode(arrays_zip(k, s)) AS e""")


@query("sql_forest_table", sql_score_events(T_, D_).replace("SELECT k AS event_id, ", "SELECT k AS event_id, x.event_type, ").replace(
    "FROM leaves GROUP BY k", "FROM leaves JOIN (SELECT event_id, event_type FROM events) x ON x.event_id = k GROUP BY k, x.event_type"))
def sql_forest_table(spark, sf_dir):
    """2.11 / F10: ``SELECT * FROM forest_score(TABLE(t), 'project')``, the schema taken from the table."""
    register_forest_table(spark, {"events": Project(events_forest(spark, T_, D_), FEATS)}, "forest_score")
    event_features(spark, sf_dir, keep=("event_type",)).createOrReplaceTempView("event_rows")
    return spark.sql("SELECT event_id, event_type, score, CAST(prediction AS INT) AS prediction FROM forest_score(TABLE(event_rows), 'events')")


@query("score_large_tree", sql_score_events(1, 8))
def score_large_tree(spark, sf_dir):
    """A tree of 511 nodes with a broadcast bound of 60: bands of levels, rows walk where their subtree lies."""
    return S.score_relational(events_forest(spark, 1, 8), event_features(spark, sf_dir), "event_id", FEATS, max_group_nodes=60) \
        .select("event_id", "score", "prediction")


def _sql_awkward_keys():
    inner = _sql_sparse_fast()
    return (f"WITH s AS ({inner}) SELECT nullif(vec_id, 3) AS vec_id, score FROM s UNION ALL SELECT nullif(vec_id, 3), score FROM s WHERE vec_id % 5 = 3")


@query("sparse_awkward_keys", _sql_awkward_keys())
def sparse_awkward_keys(spark, sf_dir):
    """A row whose key is null, and keys that stand twice among the rows to score."""
    forest = grid_forest(spark, T_, D_, EMBEDDING_RANGES)
    key = F.when(F.col("vec_id") != 3, F.col("vec_id")).alias("vec_id")
    ids = table(spark, sf_dir, "embeddings", ["vec_id"])
    keys = ids.union(ids.where("vec_id % 5 = 3")).select(key)
    entries = sparse_entries(spark, sf_dir).select(key, "feature", "value")
    long = S.score_sparse_long(forest, entries, "vec_id", absent=0.0, keys=keys.where("vec_id % 2 = 0 or vec_id is null"))
    vectorised = S.score_sparse_vectorised(forest, entries, "vec_id", absent=0.0, keys=keys.where("vec_id % 2 != 0"))
    return long.union(vectorised).select("vec_id", "score")


@query("score_bitvector", SQL_SCORE)
def score_bitvector_q(spark, sf_dir):
    """F4 by bit vectors: native bit functions over literal tables, no nested conditions."""
    return score_bitvector(events_forest(spark, T_, D_), event_features(spark, sf_dir), "event_id", FEATS)


_SLICES = (0, 3, 7)


@query("score_slices", f"SELECT * FROM ({_sql_batches()}) WHERE batch_id IN {_SLICES}")
def score_slices(spark, sf_dir):
    """Some batches of the table, each read from its own files by a zone map and scored."""
    index = SliceIndex.build(event_features(spark, sf_dir), "event_id", scratch_path(spark, "slices"), rows_per_file=500)
    forest = events_forest(spark, T_, D_)
    parts = [S.score_vectorised(forest, index.slice(i, BATCH_Q), "event_id", FEATS).select(
        "event_id", F.lit(i).cast("long").alias("batch_id"), "prediction") for i in _SLICES]
    return reduce(DataFrame.unionByName, parts)


# --- A13 -----------------------------------------------------------------------

def prediction_histogram_df(spark, sf_dir):
    scored = _scored(spark, sf_dir, "relational")
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("prediction_histogram",
       "SELECT prediction, CAST(count(*) AS BIGINT) AS n FROM (" + SQL_SCORE + ") GROUP BY prediction")
def prediction_histogram(spark, sf_dir):
    return prediction_histogram_df(spark, sf_dir)
