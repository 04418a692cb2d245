"""Split semantics: one rule in Spark columns, SQL text and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.functions.splits import goes_left, goes_left_lit, goes_left_np
from sylvan.operators import score as S
from sylvan.operators.forest import NODE_SCHEMA, Forest, ForestMeta


def _forest(spark, rows, depth, combine="sum", n_classes=2):
    nodes = spark.createDataFrame(rows, NODE_SCHEMA)
    meta = ForestMeta(n_trees=len({r[0] for r in rows}), max_depth=depth, n_nodes=len(rows),
                      n_features=2, combine=combine, n_classes=n_classes)
    return Forest(nodes, meta)


CASES = [  # x, threshold, op, default_left -> left?
    (1.0, 1.0, "le", False, True),
    (1.0, 1.0, "lt", True, False),
    (0.5, 1.0, "lt", False, True),
    (2.0, 1.0, "le", True, False),
    (None, 1.0, "le", True, True),
    (None, 1.0, "le", False, False),
    (float("nan"), 1.0, "lt", True, True),
]


@pytest.mark.parametrize("x,t,op,dl,want", CASES)
def test_rule_three_ways(spark, x, t, op, dl, want):
    df = spark.createDataFrame([(x,)], "x double")
    got_col = df.select(goes_left(F.col("x"), F.lit(t), F.lit(op), F.lit(dl))).first()[0]
    got_lit = df.select(goes_left_lit(F.col("x"), t, op, dl)).first()[0]
    xv = np.array([np.nan if x is None else x])
    got_np = bool(goes_left_np(xv, np.array([t]), np.array([op == "lt"]), np.array([dl]))[0])
    assert got_col == got_lit == got_np == want


def test_tiny_forests_all_plans(spark):
    rows = [
        # tree 0: a single leaf
        (0, 0, None, None, "le", None, None, True, 0.25, None, 1.0),
        # tree 1: one split on feature 0 at 1.0, 'lt', missing -> right
        (1, 0, 0, 1.0, "lt", 1, 2, False, None, None, 1.0),
        (1, 1, None, None, "le", None, None, True, 1.0, None, 1.0),
        (1, 2, None, None, "le", None, None, True, -1.0, None, 1.0),
    ]
    forest = _forest(spark, rows, 1)
    data = spark.createDataFrame([(1, 0.5, 0.0), (2, 1.0, 0.0), (3, None, 0.0), (4, 2.0, 0.0)],
                                 "k long, a double, b double")
    want = {1: 1.25, 2: -0.75, 3: -0.75, 4: -0.75}
    for strategy in ("relational", "vectorised", "expression"):
        got = {r["k"]: r["score"] for r in S.STRATEGIES[strategy](forest, data, "k", ["a", "b"]).collect()}
        assert got == want, strategy


def test_empty_input(spark):
    rows = [(0, 0, None, None, "le", None, None, True, 0.5, None, 1.0)]
    forest = _forest(spark, rows, 0)
    data = spark.createDataFrame([], "k long, a double, b double")
    for strategy in ("relational", "vectorised", "expression"):
        assert S.STRATEGIES[strategy](forest, data, "k", ["a", "b"]).count() == 0


def test_tree_groups_cover_all_trees():
    meta = ForestMeta(n_trees=1600, max_depth=8, n_nodes=1600 * 511, n_features=4)
    groups = S.tree_groups(meta, 200_000)
    assert groups[0][0] == 0 and groups[-1][1] == 1600
    assert all(a < b for a, b in groups)
    assert all(g1[1] == g2[0] for g1, g2 in zip(groups, groups[1:]))
    assert all((b - a) * 511 <= 200_000 for a, b in groups)


def test_grouped_relational_equals_single_group(spark):
    from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest
    forest = events_forest(spark, 6, 3)
    x = event_features(spark, "/root/testdata/sf0.001")
    one = {r[0]: r[1] for r in S.score_relational(forest, x, "event_id", EVENT_FEATURES).select("event_id", "score").collect()}
    many = {r[0]: r[1] for r in S.score_relational(forest, x, "event_id", EVENT_FEATURES, max_group_nodes=20)
            .select("event_id", "score").collect()}
    assert one == many
