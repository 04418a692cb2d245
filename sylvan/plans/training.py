"""Training, model import/export, libsvm and stream queries.

Training results depend on MLlib's random choices, so those queries are
checked on rows only (plus unit tests of plan equality); imports of
forests whose trees are known are checked against SQL.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sylvan.operators import score as S
from sylvan.operators.forest import forest_stats, grid_forest
from sylvan.operators.select import split_at
from sylvan.operators.train import save_model, train_forest, train_from_table as _train_from_table
from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest, sql_score_events, sql_walk_sums
from sylvan.plans.registry import query
from sylvan.session import scratch_path, shared_dir
from sylvan.sinks.writers import append_runs
from sylvan.sources import forests as FS
from sylvan.sources.files import read_libsvm
from sylvan.sources.tables import table
from sylvan.streaming.score_stream import score_stream_to_end

T_, D_ = 10, 4
SQL_SCORE = sql_score_events(T_, D_)


def _train_test(spark, sf_dir, label="y"):
    x = event_features(spark, sf_dir, keep=("event_type", "value"))
    x = x.withColumn("y", (F.col("event_type") == "purchase").cast("double"))
    split = split_at(x, "event_id", 0.8)
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "test")


def _fit(spark, sf_dir, algorithm, task):
    train, test = _train_test(spark, sf_dir)
    label = "y" if task == "classification" else "value"
    model = train_forest(train, EVENT_FEATURES, label, algorithm, task, n_trees=10, max_depth=8,
                         key="event_id")
    path = save_model(model, scratch_path(spark, f"model_{algorithm}_{task}"))
    return model, path, test


#: Test rows and the class that the event type gives away: what a classifier that learned must say.
_SQL_TEST = ("SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS prediction FROM events "
             "QUALIFY row_number() OVER (ORDER BY event_id) > floor(count(*) OVER () * 0.8)")
_SQL_TREES = "SELECT CAST(t AS INTEGER) AS tree_id, true AS depth_ok, true AS binary_tree, true AS learned FROM range(10) r(t)"


def _tree_facts(spark, sf_dir, algorithm, task):
    """Per tree: at most 8 levels, every split with two children; and whether the forest beats the best constant on its training rows."""
    _, path, _ = _fit(spark, sf_dir, algorithm, task)
    forest = FS.forest_from_mllib_dir(spark, path)
    label = "y" if task == "classification" else "value"
    scored = S.score_vectorised(forest, _train_test(spark, sf_dir)[0], "event_id", EVENT_FEATURES, carry=[label])
    if task == "classification":
        learned = F.avg((F.col("prediction") == F.col(label)).cast("double")) > F.greatest(F.avg(label), 1 - F.avg(label))
    else:
        learned = F.avg((F.col("prediction") - F.col(label)) ** 2) < F.var_pop(label)
    one = scored.agg(learned.alias("learned"))  # one row
    return forest_stats(forest).join(F.broadcast(one), F.lit(True)).select(
        "tree_id", (F.col("depth") <= 8).alias("depth_ok"), (F.col("leaves") * 2 == F.col("nodes") + 1).alias("binary_tree"), "learned")


@query("train_rf_classify", _SQL_TREES)
def train_rf_classify(spark, sf_dir):
    """M1/M2: random forest classifier (10 trees, depth 8)."""
    return _tree_facts(spark, sf_dir, "randomforest", "classification")


@query("train_rf_regress", _SQL_TREES)
def train_rf_regress(spark, sf_dir):
    return _tree_facts(spark, sf_dir, "randomforest", "regression")


@query("train_gbt_classify", _SQL_TREES)
def train_gbt_classify(spark, sf_dir):
    """Boosted trees of MLlib (step 0.1)."""
    return _tree_facts(spark, sf_dir, "gbt", "classification")


@query("train_gbt_regress", _SQL_TREES)
def train_gbt_regress(spark, sf_dir):
    return _tree_facts(spark, sf_dir, "gbt", "regression")


_SQL_SAME = ("SELECT event_id, true AS same, true AS accurate FROM events QUALIFY row_number() OVER (ORDER BY event_id) > floor(count(*) OVER () * 0.8)")


def _same(test, one, other):
    """Per test row whether two ways of predicting agree, and whether at least 95 % of all rows get the class that the event type gives away."""
    y = test.select("event_id", "y")
    met = one.select("event_id", "prediction").join(other.select("event_id", F.col("prediction").alias("again")), "event_id").join(y, "event_id")
    share = met.agg((F.avg((F.col("prediction") == F.col("y")).cast("double")) >= 0.95).alias("accurate"))  # one row
    return met.select("event_id", (F.col("prediction") == F.col("again")).alias("same")).join(F.broadcast(share), F.lit(True))


@query("score_mllib", _SQL_SAME)
def score_mllib(spark, sf_dir):
    """the native ``transform`` on the test split, against the imported forest."""
    model, path, test = _fit(spark, sf_dir, "randomforest", "classification")
    return _same(test, S.score_mllib(model, test, "event_id", EVENT_FEATURES),
                 S.score_vectorised(FS.forest_from_mllib_dir(spark, path), test, "event_id", EVENT_FEATURES))


@query("forest_nodes_from_model", _SQL_SAME)
def forest_nodes_from_model(spark, sf_dir):
    """Saved model folder -> node relation -> relational scoring, against ``transform``."""
    model, path, test = _fit(spark, sf_dir, "randomforest", "classification")
    return _same(test, S.score_relational(FS.forest_from_mllib_dir(spark, path), test, "event_id", EVENT_FEATURES),
                 S.score_mllib(model, test, "event_id", EVENT_FEATURES))


@query("model_roundtrip", _SQL_SAME)
def model_roundtrip(spark, sf_dir):
    """K8: save, load, score: predictions of the reloaded model and of the fitted one."""
    from pyspark.ml.classification import RandomForestClassificationModel
    model, path, test = _fit(spark, sf_dir, "randomforest", "classification")
    again = RandomForestClassificationModel.load(path)
    return _same(test, S.score_mllib(again, test, "event_id", EVENT_FEATURES), S.score_mllib(model, test, "event_id", EVENT_FEATURES))


@query("train_from_table", "SELECT 'events_training' AS project, 'gbt' AS algorithm, 'classification' AS task, CAST(10 AS INTEGER) AS n_trees, "
       f"'deployed' AS status, p.event_id, p.prediction FROM ({_SQL_TEST}) p")
def train_from_table(spark, sf_dir):
    """M5: SQL-style train call over a registered relation -> one row, and what its deployed model says of the test rows."""
    train, test = _train_test(spark, sf_dir)
    row = _train_from_table(spark, "events_training", train, "y", EVENT_FEATURES, "gbt",
                            "classification", '{"n_estimators": 10, "max_depth": 8}',
                            scratch_path(spark, "project_model"), key="event_id")
    path = row.first().model_path
    said = S.score_vectorised(FS.load_forest(spark, path), test, "event_id", EVENT_FEATURES).select("event_id", "prediction")
    return said.join(F.broadcast(row.select("project", "algorithm", "task", "n_trees", "status")), F.lit(True))


# --- forest dumps (checked against SQL: the grid forest is known) ----------------

@query("forest_nodes_from_csv", SQL_SCORE)
def forest_nodes_from_csv(spark, sf_dir):
    """K9 + S10: export one CSV per tree, import, score events."""
    forest = events_forest(spark, T_, D_)
    path = scratch_path(spark, "tabular_dump")
    FS.export_tabular(forest, path)
    back = FS.forest_from_tabular(spark, path, forest.meta)
    return S.score_relational(back, event_features(spark, sf_dir), "event_id", EVENT_FEATURES)


@query("forest_nodes_from_json", SQL_SCORE)
def forest_nodes_from_json(spark, sf_dir):
    """Export nested JSON trees, import level by level, score events."""
    forest = events_forest(spark, T_, D_)
    path = scratch_path(spark, "json_dump")
    FS.export_json(forest, path)
    back = FS.forest_from_json(spark, path, forest.meta, op="le")
    return S.score_vectorised(back, event_features(spark, sf_dir), "event_id", EVENT_FEATURES)


def trained_events_forest(spark, sf_dir, trees, depth):
    train, _ = _train_test(spark, sf_dir)
    model = train_forest(train, EVENT_FEATURES, "value", "gbt", "regression", n_trees=trees, max_depth=depth, key="event_id")
    return FS.forest_from_mllib_dir(spark, save_model(model, scratch_path(spark, "model_events")))


@query("forest_export",
       "SELECT CAST(t AS INTEGER) AS tree_index, true AS same_nodes, true AS binary_tree FROM range(5) r(t)")
def forest_export(spark, sf_dir):
    """K9: one file per tree of a forest trained on events; read back, compared with the forest tree by tree."""
    forest = trained_events_forest(spark, sf_dir, 5, 4)
    path = scratch_path(spark, "export")
    FS.export_tabular(forest, path)
    back = spark.read.schema(FS.TABULAR_DDL).option("header", True).csv(path)
    n, leaves = F.count(F.lit(1)), F.count_if(F.col("split_feature").isNull())
    own = forest.nodes.groupBy(F.col("tree_id").alias("tree_index")).agg(F.count(F.lit(1)).alias("own"))
    return (back.groupBy("tree_index").agg(n.alias("n"), leaves.alias("leaves")).join(own, "tree_index")
                .select("tree_index", (F.col("n") == F.col("own")).alias("same_nodes"), (F.col("leaves") * 2 == F.col("n") + 1).alias("binary_tree")))


# --- libsvm ------------------------------------------------------------------------

SPARSE_WIDTH = 1000


def write_libsvm(spark, sf_dir) -> str:
    """libsvm lines ``label i:v ...`` of documents: label = doc_id, feature i = words of i characters
    (the last one: that many or more), value = their number. Texts without words give a label alone."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lens = F.transform(words, lambda w: F.least(F.length(w), F.lit(SPARSE_WIDTH)))
    entry = lambda ls: lambda k: F.concat(k.cast("string"), F.lit(":"), F.size(F.filter(ls, lambda x: x == k)).cast("string"))
    pairs = F.transform(F.array_sort(F.array_distinct("ls")), entry(F.col("ls")))
    path = scratch_path(spark, "libsvm")
    docs.select("doc_id", lens.alias("ls")).select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.array_join(pairs, " ")).alias("value")) \
        .write.text(path)
    return path


_SPARSE_SQL = ("WITH d AS (SELECT CAST(doc_id AS DOUBLE) AS label, list_transform(regexp_extract_all(coalesce(text, ''), "
               f"'[^\\x20\\x09-\\x0D]+'), lambda w: least(length(w), {SPARSE_WIDTH})) AS ls FROM documents) ")


@query("scan_libsvm", _SPARSE_SQL + "SELECT label, CAST(len(list_distinct(ls)) AS INTEGER) AS nnz, "
       "CAST(coalesce(list_sum(ls), 0) AS DOUBLE) AS weighted FROM d")
def scan_libsvm(spark, sf_dir):
    """Sparse file -> (label, vector): entries counted, and summed up as index times value."""
    df = read_libsvm(spark, write_libsvm(spark, sf_dir), SPARSE_WIDTH)
    dense = vector_to_array("features")
    weighted = F.aggregate(F.transform(dense, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return df.select("label", F.size(F.filter(dense, lambda v: v != 0)).cast("int").alias("nnz"), weighted.alias("weighted"))


@query("scan_libsvm_long", _SPARSE_SQL + "SELECT label, CAST(len(list_distinct(ls)) AS BIGINT) AS nnz, "
       "CAST(list_min(ls) - 1 AS INTEGER) AS first_feature, CAST(list_sum(ls) AS DOUBLE) AS weighted FROM d")
def scan_libsvm_long(spark, sf_dir):
    """S6 sparse-native: libsvm lines to long entries, counted per row; rows without entries stay."""
    from sylvan.sources.files import read_libsvm_long
    long = read_libsvm_long(spark, write_libsvm(spark, sf_dir))
    return long.groupBy("row").agg(F.first("label").alias("label"), F.count("feature").alias("nnz"),
                                   F.min("feature").alias("first_feature"),
                                   F.sum((F.col("feature") + 1) * F.col("value")).alias("weighted")).drop("row")


@query("sparse_to_dense", _SPARSE_SQL + f"SELECT label, {SPARSE_WIDTH} AS width, CAST(len(ls) AS DOUBLE) AS total, "
       "CAST(len(list_filter(ls, lambda k: k = 5)) AS DOUBLE) AS fives FROM d")
def sparse_to_dense(spark, sf_dir):
    """A sparse vector to its dense array: width, sum, and one position's value."""
    df = read_libsvm(spark, write_libsvm(spark, sf_dir), SPARSE_WIDTH)
    dense = vector_to_array("features")
    return df.select("label", F.size(dense).alias("width"), F.aggregate(dense, F.lit(0.0), lambda a, v: a + v).alias("total"),
                     F.get(dense, F.lit(4)).alias("fives"))


#: Features the forest of the sparse scoring reads (words of 1 to 24 characters) and their range.
SPARSE_RANGES = [(0.0, 64.0)] * 24

_SPARSE_SCORE_SQL = (sql_walk_sums(_SPARSE_SQL + "SELECT CAST(label AS BIGINT) AS doc_id, list_transform(range(1, 25), "
                                   "lambda j: CAST(len(list_filter(ls, lambda k: k = j)) AS DOUBLE)) AS xs FROM d",
                                   "doc_id", "x.xs", T_, D_, SPARSE_RANGES)
                     + "SELECT k AS doc_id, sum(value * tree_weight) AS score FROM leaves GROUP BY k")


def _score_libsvm(spark, sf_dir, score):
    from sylvan.sources.files import read_libsvm_long
    long = (read_libsvm_long(spark, write_libsvm(spark, sf_dir))
            .select(F.col("label").cast("long").alias("doc_id"), "feature", "value"))
    forest = grid_forest(spark, T_, D_, SPARSE_RANGES)
    out = score(forest, long.where(F.col("feature").isNotNull()), "doc_id", absent=0.0, keys=long.select("doc_id").distinct())
    return out.select("doc_id", "score")


@query("score_sparse_long_documents", _SPARSE_SCORE_SQL)
def score_sparse_long_documents(spark, sf_dir):
    """F5 from a sparse file: every entry of its lines, no value cut."""
    return _score_libsvm(spark, sf_dir, S.score_sparse_long)


@query("score_sparse_vectorised_documents", _SPARSE_SCORE_SQL)
def score_sparse_vectorised_documents(spark, sf_dir):
    return _score_libsvm(spark, sf_dir, S.score_sparse_vectorised)


# --- runs table ----------------------------------------------------------------------

@query("runs_append", " UNION ALL ".join(
    f"SELECT 'events' AS dataset, '{x}' AS strategy, {T_} AS trees, count(*) AS rows, sum(prediction) AS positives FROM ({SQL_SCORE}) s"
    for x in ("vectorised", "relational")))
def runs_append(spark, sf_dir):
    """One row per scoring run appended to the runs table."""
    path = scratch_path(spark, "runs")
    x = event_features(spark, sf_dir)
    forest = events_forest(spark, T_, D_)
    for strategy in ("vectorised", "relational"):
        scored = S.STRATEGIES[strategy](forest, x, "event_id", EVENT_FEATURES)
        row = scored.agg(F.lit("events").alias("dataset"), F.lit(strategy).alias("strategy"),
                         F.lit(T_).alias("trees"), F.count(F.lit(1)).alias("rows"),
                         F.sum("prediction").alias("positives"))
        append_runs(row, path)
    return spark.read.parquet(path)


# --- F12 stream form ------------------------------------------------------------------

@query("score_stream", SQL_SCORE)
def score_stream(spark, sf_dir):
    """feature files arrive as a stream; each micro-batch is scored."""
    shared_dir(spark)
    src = scratch_path(spark, "stream_src")
    feats = event_features(spark, sf_dir)
    feats.repartition(4).write.parquet(src)
    out = scratch_path(spark, "stream_out")
    ckpt = scratch_path(spark, "stream_ckpt")
    return score_stream_to_end(spark, events_forest(spark, T_, D_), src, feats.schema, "event_id",
                               EVENT_FEATURES, out, ckpt, strategy="vectorised", files_per_trigger=1) \
        .select("event_id", "score", "prediction")



_LINE = "CAST(1 AS DOUBLE) AS precision, CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1_score, CAST(count(*) AS BIGINT) AS support FROM t"


@query("train_metric", "WITH t AS (SELECT CAST(event_type = 'purchase' AS INTEGER) AS y FROM events QUALIFY row_number() OVER (ORDER BY event_id) "
       f"<= floor(count(*) OVER () * 0.8)) SELECT CAST(y AS VARCHAR) AS label, {_LINE} GROUP BY y "
       "UNION ALL SELECT 'accuracy', NULL, NULL, CAST(1 AS DOUBLE), count(*) FROM t "
       f"UNION ALL SELECT 'macro avg', {_LINE} UNION ALL SELECT 'weighted avg', {_LINE}")
def train_metric(spark, sf_dir):
    """M7: the classification report of the fitted forest on its own
    training rows (A2 on ``model.transform(train)``)."""
    from sylvan.operators.evaluate import classification_report
    train, _ = _train_test(spark, sf_dir)
    # the event type decides the label, so boosted trees know every training row
    model = train_forest(train, EVENT_FEATURES, "y", "gbt", "classification", n_trees=10,
                         max_depth=8, key="event_id")
    scored = S.score_mllib(model, train, "event_id", EVENT_FEATURES, carry=["y"])
    return classification_report(scored, "y", "prediction")
