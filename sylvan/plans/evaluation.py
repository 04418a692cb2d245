"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sylvan.operators import evaluate as E
from sylvan.operators import score as S
from sylvan.operators.forest import forest_stats as _forest_stats
from sylvan.plans.features import (EVENT_FEATURES, event_features, events_forest,
                                   sql_score_events)
from sylvan.plans.registry import query
from sylvan.session import scratch_path
from sylvan.sources.tables import table

T_, D_ = 10, 4


def labelled_scores(spark, sf_dir, combine="sum", task="classification"):
    """events scored by the grid forest, with y = (event_type = 'purchase')."""
    x = event_features(spark, sf_dir, keep=("event_type",))
    x = x.withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    forest = events_forest(spark, T_, D_, combine=combine, task=task)
    return S.score(forest, x, "event_id", EVENT_FEATURES, carry=["y"])


SQL_YP = ("SELECT s.event_id, CAST(e.event_type = 'purchase' AS INTEGER) AS y, s.prediction AS p, s.score "
          f"FROM ({sql_score_events(T_, D_)}) s JOIN events e ON e.event_id = s.event_id")


@query("confusion_matrix",
       f"SELECT y, p, CAST(count(*) AS BIGINT) AS n FROM ({SQL_YP}) GROUP BY y, p")
def confusion_matrix(spark, sf_dir):
    return E.confusion_counts(labelled_scores(spark, sf_dir), "y", "prediction")


@query("confusion_pivot",
       f"SELECT y, CAST(count(*) FILTER (WHERE p = 0) AS BIGINT) AS p_0, "
       f"CAST(count(*) FILTER (WHERE p = 1) AS BIGINT) AS p_1 FROM ({SQL_YP}) GROUP BY y")
def confusion_pivot(spark, sf_dir):
    return E.confusion_pivot(labelled_scores(spark, sf_dir), "y", "prediction", [0, 1])


def sql_report(yp_sql: str) -> str:
    return (
        f"WITH yp AS ({yp_sql}), classes AS (SELECT y AS c FROM yp UNION SELECT p FROM yp), "
        "per AS (SELECT c, (SELECT count(*) FROM yp WHERE y = c AND p = c) AS tp, "
        "(SELECT count(*) FROM yp WHERE y = c) AS sup, (SELECT count(*) FROM yp WHERE p = c) AS pr FROM classes), "
        "m AS (SELECT c, tp, sup, CASE WHEN pr = 0 THEN 0.0 ELSE tp / pr END AS prec, "
        "CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS rec FROM per), "
        "f AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM m), "
        "allrows AS ("
        "SELECT CAST(c AS VARCHAR) AS label, prec AS precision, rec AS recall, f1 AS f1_score, "
        "CAST(sup AS BIGINT) AS support FROM f "
        "UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN sum(sup) = 0 THEN 0.0 ELSE sum(tp) / sum(sup) END, "
        "CAST(sum(sup) AS BIGINT) FROM f "
        "UNION ALL SELECT 'macro avg', avg(prec), avg(rec), avg(f1), CAST(sum(sup) AS BIGINT) FROM f "
        "UNION ALL SELECT 'weighted avg', sum(prec * sup) / sum(sup), sum(rec * sup) / sum(sup), "
        "sum(f1 * sup) / sum(sup), CAST(sum(sup) AS BIGINT) FROM f) "
        "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, "
        "round(f1_score, 6) AS f1_score, support FROM allrows")


@query("classification_report", sql_report(SQL_YP.replace("s.event_id, ", "")))
def classification_report(spark, sf_dir):
    return E.classification_report(labelled_scores(spark, sf_dir), "y", "prediction")


@query("eval_from_sink",
       f"SELECT y, p, CAST(count(*) AS BIGINT) AS n FROM ({SQL_YP}) GROUP BY y, p")
def eval_from_sink(spark, sf_dir):
    """Predictions read back from their sink, joined to labels by key."""
    x = event_features(spark, sf_dir)
    scored = S.score(events_forest(spark, T_, D_), x, "event_id", EVENT_FEATURES)
    path = scratch_path(spark, "predictions")
    scored.select("event_id", "prediction").write.parquet(path)
    preds = spark.read.parquet(path)
    labels = table(spark, sf_dir, "events", ["event_id", "event_type"]).select(
        "event_id", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return E.confusion_counts(labels.join(preds, "event_id"), "y", "prediction")


@query("regression_mse",
       "SELECT round(avg(pow(e.value - s.score, 2)), 4) AS mse, round(sqrt(avg(pow(e.value - s.score, 2))), 4) AS rmse "
       f"FROM ({sql_score_events(T_, D_, combine='mean')}) s JOIN events e ON e.event_id = s.event_id")
def regression_mse(spark, sf_dir):
    x = event_features(spark, sf_dir, keep=("value",))
    forest = events_forest(spark, T_, D_, combine="mean", task="regression")
    scored = S.score(forest, x, "event_id", EVENT_FEATURES, carry=["value"])
    return E.regression_errors(scored, "value", "score")


@query("mllib_evaluators",
       f"WITH report AS ({sql_report(SQL_YP.replace('s.event_id, ', ''))}), yp AS ({SQL_YP}), v AS ("
       "SELECT 'accuracy' AS metric, f1_score AS value FROM report WHERE label = 'accuracy' "
       "UNION ALL SELECT 'f1', f1_score FROM report WHERE label = 'weighted avg' "
       "UNION ALL SELECT 'weightedPrecision', precision FROM report WHERE label = 'weighted avg' "
       "UNION ALL SELECT 'weightedRecall', recall FROM report WHERE label = 'weighted avg' "
       "UNION ALL SELECT 'mse', avg(pow(y - score, 2)) FROM yp UNION ALL SELECT 'rmse', sqrt(avg(pow(y - score, 2))) FROM yp "
       "UNION ALL SELECT 'mae', avg(abs(y - score)) FROM yp) "
       "SELECT metric, round(value, 5) AS value, 0 AS differs FROM v")
def mllib_evaluators(spark, sf_dir):
    """A5: MLlib's evaluators on the scored events, and whether the report and the errors of this library say otherwise."""
    path = scratch_path(spark, "scores")
    labelled_scores(spark, sf_dir).select("y", "prediction", "score").write.parquet(path)
    scored = spark.read.parquet(path)
    report = E.classification_report(scored, "y", "prediction", digits=12)
    share, average = F.col("label") == "accuracy", F.col("label") == "weighted avg"
    pick = lambda m, c, where: report.where(where).select(F.lit(m).alias("metric"), F.col(c).alias("own"))
    own = pick("accuracy", "f1_score", share)
    for m, c in (("f1", "f1_score"), ("weightedPrecision", "precision"), ("weightedRecall", "recall")):
        own = own.unionByName(pick(m, c, average))
    errors = E.regression_errors(scored, "y", "score", digits=12)
    for m in ("mse", "rmse"):
        own = own.unionByName(errors.select(F.lit(m).alias("metric"), F.col(m).alias("own")))
    both = E.mllib_metrics(scored, "y", "prediction", "score").join(own, "metric", "left")
    return both.select("metric", F.round("value", 5).alias("value"),
                       (F.abs(F.col("value") - F.coalesce("own", "value")) > 1e-9).cast("int").alias("differs"))


@query("class_weight",
       "SELECT CASE WHEN count(*) FILTER (WHERE quality <> 0) = 0 THEN 0.0 ELSE "
       "count(*) / count(*) FILTER (WHERE quality <> 0) END AS weight FROM labels")
def class_weight(spark, sf_dir):
    return E.positive_weight(table(spark, sf_dir, "labels"), "quality")


@query("null_profile",
       "SELECT CAST(count(*) FILTER (WHERE CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END IS NULL) AS BIGINT) AS value, "
       "CAST(count(*) FILTER (WHERE ts IS NULL) AS BIGINT) AS ts, "
       "CAST(count(*) FILTER (WHERE user_id IS NULL) AS BIGINT) AS user_id, "
       "CAST(count(*) FILTER (WHERE event_type IS NULL) AS BIGINT) AS event_type, "
       "CAST(count(*) FILTER (WHERE event_id IS NULL) AS BIGINT) AS event_id, "
       "CAST(count(*) FILTER (WHERE props IS NULL) AS BIGINT) AS props FROM events")
def null_profile(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ev = ev.withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value")))
    return E.null_profile(ev)


@query("table_stats",
       "SELECT CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS sum_qty, "
       "round(sum(l_extendedprice), 2) AS sum_price, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_orders "
       "FROM lineitem")
def table_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice"])
    return li.agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum("l_quantity").alias("sum_qty"),
                  F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
                  F.countDistinct("l_orderkey").cast("long").alias("n_orders"))


@query("forest_stats", "SELECT CAST(t AS INTEGER) AS tree_id, true AS depth_ok, true AS binary_tree FROM range(5) r(t)")
def forest_stats(spark, sf_dir):
    """A8 on a forest trained on events: every tree within its depth, every inner node with two children."""
    from sylvan.plans.training import trained_events_forest
    s = _forest_stats(trained_events_forest(spark, sf_dir, 5, 4))
    return s.select("tree_id", (F.col("depth") <= 4).alias("depth_ok"), (F.col("leaves") * 2 == F.col("nodes") + 1).alias("binary_tree"))
