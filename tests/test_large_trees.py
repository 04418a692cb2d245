"""A tree beyond the broadcast bound, walked band by band, against the vectorised plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.operators import large_trees as L
from sylvan.operators import score as S
from sylvan.operators.forest import CATEGORIES, NODE_SCHEMA, Forest, ForestMeta, grid_forest


def lopsided(spark, depth=14, seed=1):
    """One tree with leaves at all depths, missing branches both ways and a categorical split."""
    rng = np.random.default_rng(seed)
    rows, todo, n = [], [(0, 0)], 1
    while todo:
        i, d = todo.pop()
        if d == depth or (d > 2 and rng.random() < 0.25):
            rows.append((0, i, None, None, "le", None, None, True, float(rng.normal()), None, 1.0, None))
            continue
        left, right = n, n + 1
        n += 2
        if rng.random() < 0.2:
            rows.append((0, i, 3, None, "in", left, right, bool(rng.random() < .5), None, None, 1.0, [int(rng.integers(0, 255))]))
        else:
            rows.append((0, i, int(rng.integers(0, 3)), float(rng.normal()), "lt" if rng.random() < .5 else "le", left, right,
                         bool(rng.random() < .5), None, None, 1.0, None))
        todo += [(left, d + 1), (right, d + 1)]
    meta = ForestMeta(n_trees=1, max_depth=depth, n_nodes=len(rows), n_features=4)
    return Forest(spark.createDataFrame(rows, f"{NODE_SCHEMA}, {CATEGORIES} array<long>"), meta)


def table(spark, n=600, hot=200):
    rng = np.random.default_rng(5)
    rows = [(i, *[None if rng.random() < .1 else float(v) for v in rng.normal(size=3)], float(rng.integers(0, 9))) for i in range(n)]
    rows += [(None, 0.1, -0.2, 0.3, 2.0)] * hot  # a third of the rows walk one way
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(4)


FEATS = ["a", "b", "c", "d"]


def sums(df):
    return sorted((r.id if r.id is not None else -1, r.score, r.prediction) for r in df.collect())


@pytest.mark.parametrize("bound", [3, 20])
def test_one_large_tree(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "GROUP_ROWS", 50)  # hot subtrees are dealt to several groups
    forest, df = lopsided(spark), table(spark)
    assert forest.meta.n_nodes > 5 * bound
    want = sums(S.score_vectorised(forest, df, "id", FEATS))
    assert sums(S.score_relational(forest, df, "id", FEATS, max_group_nodes=bound)) == want


def test_large_and_small_trees_and_votes(spark):
    df = table(spark, 200, 50)
    forest = grid_forest(spark, 3, 6, [(-2.0, 2.0)] * 4, n_classes=3)  # 127 nodes a tree
    want = sums(S.score_vectorised(forest, df, "id", FEATS))
    assert sums(S.score_relational(forest, df, "id", FEATS, max_group_nodes=40)) == want


def test_sparse_rows_on_a_large_tree(spark):
    forest, df = lopsided(spark, 9), table(spark, 200, 0)
    cells = df.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(FEATS)])).alias("e"))
    entries = cells.select("id", "e.*").where("value is not null")
    want = sums(S.score_vectorised(forest, df, "id", FEATS))
    assert sums(S.score_sparse_long(forest, entries, "id", absent=None, keys=df.select("id"), max_group_nodes=10)) == want


def test_no_band_has_a_subtree_above_the_bound(spark):
    forest = lopsided(spark, 12)
    for bound in (3, 7, 30):
        parts = L.bands(forest.nodes.select("node_id", "feature", "left", "right"), L.band_levels(bound))
        sizes = [r["count"] for p in parts for r in p.groupBy("sub").count().collect()]
        assert max(sizes) <= bound and sum(sizes) == forest.meta.n_nodes
