"""Every plan and every grouping of trees gives the same bits, also for leaves
that are no binary fractions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.functions.sqlfuncs import predict_batch, register_forest_predict
from sylvan.operators import score as S
from sylvan.operators.forest import Forest, grid_unit, size_groups
from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest

SF = "/root/testdata/sf0.001"


def _thirds(spark, **kw):
    f = events_forest(spark, 30, 4, **kw)
    nodes = f.nodes.withColumn("value", F.col("value") / 3) \
        .withColumn("class_counts", F.transform("class_counts", lambda c: c / 3)) \
        .withColumn("tree_weight", F.lit(0.1) + F.col("tree_id") % 3)
    return Forest(nodes, f.meta)


def _by_key(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select("event_id", *cols).collect()}


@pytest.mark.parametrize("kw", [{"combine": "sum"}, {"combine": "mean"}, {"combine": "logit"}, {"n_classes": 3}])
def test_plans_and_groups_agree_to_the_bit(spark, kw):
    forest, x = _thirds(spark, **kw), event_features(spark, SF, missing=True)
    want = _by_key(S.score_vectorised(forest, x, "event_id", EVENT_FEATURES), "score", "prediction")
    assert len(want) == x.count()
    for got in (S.score_expression(forest, x, "event_id", EVENT_FEATURES),
                S.score_relational(forest, x, "event_id", EVENT_FEATURES),
                S.score_relational(forest, x, "event_id", EVENT_FEATURES, max_group_nodes=100)):
        assert _by_key(got, "score", "prediction") == want


def test_forest_above_the_shipping_bound(spark, monkeypatch):
    forest, x = _thirds(spark), event_features(spark, SF).withColumn("b", F.col("event_id") % 5)
    want = _by_key(S.score_vectorised(forest, x, "event_id", EVENT_FEATURES), "score")
    for plan, bound in (("vectorised", "MAX_SHIPPED_NODES"), ("expression", "MAX_EXPRESSION_NODES")):
        with monkeypatch.context() as m:
            m.setattr(S, bound, 100)
            assert _by_key(S.score(forest, x, "event_id", EVENT_FEATURES, plan), "score") == want
    assert _by_key(predict_batch(forest, x, "event_id", EVENT_FEATURES, "b", max_nodes=100), "score") == want
    register_forest_predict(spark, forest, "thirds_predict", max_nodes=100)
    x.createOrReplaceTempView("thirds_x")
    assert _by_key(spark.sql("SELECT event_id, thirds_predict(array(f0, f1, f2, f3)) AS score FROM thirds_x"), "score") == want


def test_many_groups_read_the_input_once(spark):
    x = event_features(spark, SF)
    plan = S.score_relational(_thirds(spark), x, "event_id", EVENT_FEATURES, max_group_nodes=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan and "user_id" not in plan


def test_grid_makes_any_order_exact():
    rng = np.random.default_rng(1)
    for n in (1, 7, 1600):
        v = rng.normal(size=n) * 10.0 ** rng.integers(-8, 8)
        unit = grid_unit(float(np.abs(v).max()), n)
        q = np.rint(v / unit) * unit
        assert len({float(np.sum(q[rng.permutation(n)])) for _ in range(20)} | {float(sum(q))}) == 1
        assert np.abs(q - v).max() <= np.abs(v).max() * n / 2 ** 51
    assert grid_unit(0.0, 5) == 0.0 and grid_unit(float("inf"), 5) == 0.0


def test_groups_follow_the_trees_own_sizes():
    assert size_groups([(0, 3), (1, 3), (2, 50), (3, 2), (4, 2)], 7) == [(0, 2), (2, 3), (3, 5)]
    assert size_groups([], 7) == []
