"""The bit-vector plan gives the same bits as the vectorised one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.operators import score as S
from sylvan.operators.bitvector import score_bitvector
from sylvan.operators.forest import Forest
from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest
from test_large_trees import lopsided

SF = "/root/testdata/sf0.001"


def _forest(spark, trees, depth, **kw):
    f = events_forest(spark, trees, depth, **kw)
    nodes = f.nodes.withColumn("threshold", F.col("threshold") + F.col("node_id") % 13 / 8).withColumn("value", F.col("value") / 3) \
        .withColumn("op", F.when((F.col("node_id") + F.col("tree_id")) % 3 == 0, F.lit("lt")).otherwise(F.lit("le")))
    return Forest(nodes, f.meta)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("trees, depth, kw", [(3, 1, {}), (4, 7, {}), (5, 4, {"n_classes": 3}), (5, 4, {"combine": "logit"}), (6, 3, {"combine": "mean"})])
def test_same_bits(spark, trees, depth, kw):
    forest, x = _forest(spark, trees, depth, **kw), event_features(spark, SF, missing=True).withColumn("f1", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("f1")))
    want = rows(S.score_vectorised(forest, x, "event_id", EVENT_FEATURES, carry=["f1"]).drop("f1"))
    assert rows(score_bitvector(forest, x, "event_id", EVENT_FEATURES)) == want
    assert rows(score_bitvector(forest, x, "event_id", EVENT_FEATURES, group_nodes=40)) == want


def test_values_on_and_beside_the_cuts(spark):
    forest = _forest(spark, 3, 5)
    cuts = [float(r[0]) for r in forest.nodes.where("threshold is not null").select("threshold").distinct().collect()]
    vals = [v for c in cuts for v in (c, np.nextafter(c, -np.inf), np.nextafter(c, np.inf))] + [float("inf"), float("-inf"), 0.0, -0.0, None, float("nan"), 1e308]
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(vals)], "id int, v double").select("id", *[F.col("v").alias(c) for c in EVENT_FEATURES])
    assert rows(score_bitvector(forest, df, "id", EVENT_FEATURES)) == rows(S.score_vectorised(forest, df, "id", EVENT_FEATURES))


def test_plan_is_native_and_category_sets_are_refused(spark):
    plan = score_bitvector(_forest(spark, 3, 4), event_features(spark, SF), "event_id", EVENT_FEATURES)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "Exchange hash" not in plan and "event_id" in plan
    with pytest.raises(ValueError, match="category sets"):
        score_bitvector(lopsided(spark, 8), spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0)], "id int, a double, b double, c double, d double"), "id", ["a", "b", "c", "d"])
