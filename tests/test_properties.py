"""Properties: splits, numbering, codes, evaluation identities."""

import pytest
from pyspark.sql import functions as F

from sylvan.operators import evaluate as E
from sylvan.operators.encode import category_codes
from sylvan.operators.numbering import global_row_number, ordered_split
from sylvan.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("frac", [0.0, 0.8, 1.0])
def test_ordered_split_sizes(spark, frac):
    o = table(spark, SF, "orders", ["o_orderkey"])
    n = o.count()
    s = ordered_split(o, "o_orderkey", frac)
    counts = dict(s.groupBy("split").count().collect())
    assert counts.get("train", 0) == int(n * frac)
    assert counts.get("train", 0) + counts.get("test", 0) == n
    if 0 < frac < 1:
        mx = s.where("split = 'train'").agg(F.max("o_orderkey")).first()[0]
        mn = s.where("split = 'test'").agg(F.min("o_orderkey")).first()[0]
        assert mx < mn


def test_row_numbers_dense(spark):
    o = table(spark, SF, "orders", ["o_orderkey"])
    r = global_row_number(o, "o_orderkey", "rn", n_partitions=7)
    agg = r.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn"), F.count("*")).first()
    assert agg[0] == 0 and agg[1] == agg[3] - 1 and agg[2] == agg[3]


def test_codes_dense_from_zero_and_unseen(spark):
    part = table(spark, SF, "part", ["p_brand"])
    codes = category_codes(part, "p_brand", out="code").select("code").distinct().collect()
    got = sorted(r[0] for r in codes)
    assert got == list(range(len(got)))
    from sylvan.operators.encode import build_dictionary
    d, small = build_dictionary(part, "p_brand")
    assert small
    new = spark.createDataFrame([("Brand#999",), (None,)], "p_brand string")
    assert sorted(r[0] for r in category_codes(new, "p_brand", dictionary=d).collect()) == [-1, -1]


def test_report_identities(spark):
    from sylvan.plans.evaluation import labelled_scores
    df = labelled_scores(spark, SF)
    rep = {r["label"]: r for r in E.classification_report(df, "y", "prediction").collect()}
    cm = E.confusion_counts(df, "y", "prediction").collect()
    assert sum(r["n"] for r in cm) == df.count()
    assert abs(rep["weighted avg"]["recall"] - rep["accuracy"]["f1_score"]) < 1e-6


def test_mllib_evaluators_agree(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from sylvan.plans.evaluation import labelled_scores
    df = labelled_scores(spark, SF).select(F.col("y").cast("double").alias("label"),
                                           F.col("prediction").cast("double").alias("prediction"))
    rep = {r["label"]: r for r in E.classification_report(df, "label", "prediction", digits=12).collect()}
    acc = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df)
    f1 = MulticlassClassificationEvaluator(metricName="f1").evaluate(df)
    assert abs(acc - rep["accuracy"]["f1_score"]) < 1e-9
    assert abs(f1 - rep["weighted avg"]["f1_score"]) < 1e-9
    mse = RegressionEvaluator(metricName="mse").evaluate(df)
    ours = E.regression_errors(df, "label", "prediction", digits=12).first()["mse"]
    assert abs(mse - ours) < 1e-9


def test_running_flag_window_matches_join_form(spark):
    from sylvan.operators.runlogs import seen_flag, seen_flag_window
    ev = table(spark, SF, "events", ["event_id", "user_id", "ts", "event_type"])
    flag = F.col("event_type") == "error"
    a = {r[0]: r[1] for r in seen_flag(ev, "user_id", "ts", flag).select("event_id", "seen").collect()}
    b = {r[0]: r[1] for r in seen_flag_window(ev, "user_id", "ts", flag).select("event_id", "seen").collect()}
    assert a == b


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (0, 0)], "y int, p int")
    rep = {r["label"]: r for r in E.classification_report(df, "y", "p").collect()}
    assert set(rep) == {"0", "1", "2", "accuracy", "macro avg", "weighted avg"}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0 and rep["1"]["f1_score"] == 0.0
    assert rep["0"]["recall"] == 1.0 and rep["0"]["precision"] == 0.5
    assert rep["accuracy"]["f1_score"] == 0.5 and rep["accuracy"]["support"] == 4


def test_imported_random_forest_leaf_probabilities_sum_to_one(spark):
    from sylvan.operators.train import save_model, train_forest
    from sylvan.plans.features import EVENT_FEATURES, event_features
    from sylvan.session import scratch_path
    from sylvan.sources.forests import forest_from_mllib_dir
    x = event_features(spark, "/root/testdata/sf0.001", keep=("event_type",))
    x = x.withColumn("y", (F.col("event_type") == "purchase").cast("double"))
    model = train_forest(x, EVENT_FEATURES, "y", "randomforest", "classification", n_trees=3, max_depth=3)
    forest = forest_from_mllib_dir(spark, save_model(model, scratch_path(spark, "rf")))
    sums = forest.nodes.where(F.col("feature").isNull()).select(
        F.aggregate("class_counts", F.lit(0.0), lambda a, v: a + v).alias("s")).collect()
    assert sums and all(abs(r["s"] - 1.0) < 1e-12 for r in sums)
    assert forest.meta.combine == "vote" and forest.meta.n_trees == 3
