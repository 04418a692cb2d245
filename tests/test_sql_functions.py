"""predict_batch over aggregates and the forest table function, called from SQL."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sylvan.functions import sqlfuncs as Q
from sylvan.operators import score as S
from sylvan.operators.train import deployed, train
from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest

SF = "/root/testdata/sf0.001"


def want(spark, forest, x, *cols):
    return sorted(tuple(r) for r in S.score_vectorised(forest, x, "event_id", EVENT_FEATURES).select("event_id", *cols).collect())


@pytest.fixture(scope="module")
def x(spark):
    return event_features(spark, SF, missing=True, keep=("event_type",)).repartition(5).cache()


def test_a_batch_of_any_size_is_split(spark, x):
    forest = events_forest(spark, 5, 4)
    Q.register_predict_batch(spark, forest, "pb_test", max_nodes=40)  # several groups of trees too
    Q.in_pieces(x.withColumn("b", F.lit(1)), "piece", 37).createOrReplaceTempView("pb_rows")
    grouped = "SELECT b, array_agg(struct(event_id AS k, array(f0, f1, f2, f3) AS x)) AS rows FROM pb_rows GROUP BY b, piece"
    assert spark.sql(f"SELECT max(size(rows)) FROM ({grouped})").first()[0] <= 37
    out = spark.sql(f"SELECT e.k, e.s FROM (SELECT rows.k AS k, pb_test(rows.x) AS s FROM ({grouped})) LATERAL VIEW explode(arrays_zip(k, s)) AS e")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(tuple(r) for r in out.collect()) == want(spark, forest, x, "score")
    assert spark.sql("SELECT pb_test(NULL) AS a, pb_test(array()) AS b").first() == (None, [])


def test_table_function_follows_the_table(spark, x):
    forest = events_forest(spark, 5, 4)
    Q.register_forest_table(spark, {"p": Q.Project(forest, EVENT_FEATURES)}, "ft_test", max_nodes=40)
    x.withColumn("score", F.lit("mine")).createOrReplaceTempView("ft_rows")
    out = spark.sql("SELECT * FROM ft_test(TABLE(ft_rows), 'p')")
    assert out.columns == ["event_id", "event_type", *EVENT_FEATURES, "score", "score_", "prediction"]
    assert "Exchange" not in out._jdf.queryExecution().sparkPlan().toString().split("InMemoryTableScan")[0]
    got = out.select("event_id", "score_", F.col("prediction").cast("int")).collect()
    assert sorted(map(tuple, got)) == want(spark, forest, x, "score", "prediction")
    assert {r.score for r in out.collect()} == {"mine"}
    part = spark.sql("SELECT count(*) FROM ft_test(TABLE(SELECT * FROM ft_rows WHERE event_id < 0), 'p')").first()[0]
    assert part == 0


def test_table_function_refuses(spark, x):
    Q.register_forest_table(spark, {"p": Q.Project(events_forest(spark, 2, 2), EVENT_FEATURES)}, "fr_test")
    x.drop("f1").createOrReplaceTempView("fr_rows")
    for text, what in (("fr_test(TABLE(fr_rows), 'p')", "lacks the columns"), ("fr_test(TABLE(fr_rows), 'q')", "no project")):
        with pytest.raises(AnalysisException, match=what):
            spark.sql(f"SELECT * FROM {text}").collect()


def test_trained_projects_by_name(spark, x, tmp_path):
    x.fillna(0.0, ["f0"]).withColumn("y", (F.col("event_type") == "purchase").cast("double")).select("event_id", "y", *EVENT_FEATURES).createOrReplaceTempView("tp_rows")
    path = str(tmp_path / "projects")
    for name, algorithm in (("mine", "xgboost"), ("other", "gbt")):
        train(spark, name, algorithm, "classification", '{"n_estimators": 2, "max_depth": 2}', "tp_rows", "y", str(tmp_path / name), path, key="event_id")
    projects = deployed(spark, path)
    Q.register_forest_table(spark, projects, "tp_test")
    for name, p in projects.items():
        out = spark.sql(f"SELECT event_id, prediction FROM tp_test(TABLE(tp_rows), '{name}')")
        native = S.score_vectorised(p.forest, spark.table("tp_rows"), "event_id", p.features).select("event_id", F.col("prediction").cast("double"))
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, native.collect()))
