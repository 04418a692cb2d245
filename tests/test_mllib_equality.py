"""F1 = F2 = F3 = F4 on forests trained by MLlib and imported as relations."""

import pytest
from pyspark.sql import functions as F

from sylvan.operators import score as S
from sylvan.operators.train import save_model, train_forest
from sylvan.plans.features import EVENT_FEATURES, event_features
from sylvan.session import scratch_path
from sylvan.sources.forests import forest_from_mllib_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("algorithm,task", [("randomforest", "classification"),
                                            ("randomforest", "regression"),
                                            ("gbt", "classification"),
                                            ("gbt", "regression")])
def test_imported_forest_reproduces_transform(spark, algorithm, task):
    x = event_features(spark, SF, keep=("event_type", "value"))
    x = x.withColumn("y", (F.col("event_type") == "purchase").cast("double"))
    label = "y" if task == "classification" else "value"
    model = train_forest(x, EVENT_FEATURES, label, algorithm, task, n_trees=5, max_depth=4, key="event_id")
    path = save_model(model, scratch_path(spark, "m"))
    forest = forest_from_mllib_dir(spark, path)
    native = {r[0]: r[1] for r in S.score_mllib(model, x, "event_id", EVENT_FEATURES, task).collect()}
    for strategy in ("relational", "vectorised", "expression"):
        got = {r[0]: r[1] for r in S.STRATEGIES[strategy](forest, x, "event_id", EVENT_FEATURES)
               .select("event_id", "prediction").collect()}
        if task == "classification":
            assert got == native, strategy
        else:
            assert all(abs(got[k] - native[k]) < 1e-9 for k in native), strategy


def test_random_forest_rejects_missing(spark):
    x = event_features(spark, SF, missing=True).withColumn("y", F.lit(1.0))
    with pytest.raises(ValueError):
        train_forest(x, EVENT_FEATURES, "y", "randomforest", "classification", n_trees=2, max_depth=2)


def test_empty_training_table_is_a_clear_error(spark):
    from sylvan.operators.numbering import ordered_split
    x = event_features(spark, SF).withColumn("y", F.lit(1.0))
    train = ordered_split(x, "event_id", 0.0).where("split = 'train'")
    with pytest.raises(ValueError, match="empty"):
        train_forest(train, EVENT_FEATURES, "y", "gbt", "classification", n_trees=2, max_depth=2)
