"""Splits by sets of categories: one rule in every plan, dumps, bit sets."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sylvan.functions.splits import categories_of, category_words, goes_left, in_set_np
from sylvan.operators import score as S
from sylvan.operators.forest import CATEGORIES, NODE_SCHEMA, Forest, ForestMeta
from sylvan.sources import forests as FS


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 130)), st.integers(131, 150), st.booleans())
def test_words(cats, n, default_left):
    words = category_words(cats, n, default_left)
    assert all(-(1 << 63) <= w < 1 << 63 for w in words)
    beyond = set(range(n, 64 * len(words))) if default_left else set()
    assert set(categories_of(words)) == cats | beyond


def member(x, cats, n, default_left):
    if x is None or math.isnan(x) or not 0 <= x < n or x != math.floor(x):
        return default_left
    return int(x) in cats


VALUES = [None, float("nan"), -1.0, 0.0, 1.0, 2.5, 63.0, 64.0, 69.0, 70.0, 127.0, 128.0, 1e300, float("inf"), float("-inf")]


@pytest.mark.parametrize("default_left", [True, False])
def test_one_rule(spark, default_left):
    cats, n = {0, 63, 64, 69}, 70
    words = category_words(cats, n, default_left)
    want = [member(x, cats, n, default_left) for x in VALUES]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(VALUES)], "i int, x double")
    rule = goes_left(F.col("x"), F.lit(None).cast("double"), F.lit("in"), F.lit(default_left), F.array(*map(F.lit, words)))
    assert [r[0] for r in df.orderBy("i").select(rule).collect()] == want
    x = np.array([np.nan if v is None else v for v in VALUES])
    k = len(x)
    got = in_set_np(x, np.array(words), np.zeros(k, dtype=int), np.full(k, len(words)), np.full(k, default_left))
    assert got.tolist() == want


def mixed_forest(spark):
    rows, w = [], category_words
    for t, (left, default) in enumerate([({0, 2}, False), ({1, 70}, True), (set(), True)]):
        n = 80
        rows += [(t, 0, 0, None, "in", 1, 2, default, None, None, 1.0, w(left, n, default)), (t, 1, 1, 0.5, "le", 3, 4, t == 1, None, None, 1.0, None),
                 (t, 2, 0, None, "in", 5, 6, not default, None, None, 1.0, w({3, 70}, n, not default))]
        rows += [(t, i, None, None, "le", None, None, True, float(2 ** t * i), None, 1.0, None) for i in (3, 4, 5, 6)]
    meta = ForestMeta(n_trees=3, max_depth=2, n_nodes=21, n_features=2)
    return Forest(spark.createDataFrame(rows, f"{NODE_SCHEMA}, {CATEGORIES} array<long>"), meta)


def table(spark):
    rows = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in VALUES + [2.0, 3.0] for y in (0.25, 0.75, None))]
    return spark.createDataFrame(rows, "id int, x double, y double")


def test_plans_agree(spark, tmp_path):
    forest, df = mixed_forest(spark), table(spark)
    want = S.score_relational(forest, df, "id", ["x", "y"]).orderBy("id").collect()
    assert len({r.score for r in want}) > 5
    for plan in (S.score_vectorised, S.score_expression, lambda *a: S.score_relational(*a, max_group_nodes=7)):
        assert plan(forest, df, "id", ["x", "y"]).orderBy("id").collect() == want
    FS.export_json(forest, str(tmp_path / "json"))
    again = FS.forest_from_json(spark, str(tmp_path / "json"), forest.meta)
    assert again.has_categories and S.score_vectorised(again, df, "id", ["x", "y"]).orderBy("id").collect() == want
    saved = FS.load_forest(spark, FS.save_forest(forest, str(tmp_path / "saved")))
    assert S.score_vectorised(saved, df, "id", ["x", "y"]).orderBy("id").collect() == want
    with pytest.raises(ValueError, match="category sets"):
        FS.export_tabular(forest, str(tmp_path / "csv"))


def test_sparse_rows_with_categories(spark):
    forest, df = mixed_forest(spark), table(spark)
    cells = df.select("id", F.explode(F.array(F.struct(F.lit(0).alias("feature"), F.col("x").alias("value")),
                                              F.struct(F.lit(1).alias("feature"), F.col("y").alias("value")))).alias("e")).select("id", "e.*")
    entries = cells.where("value is not null and not isnan(value)")
    want = S.score_relational(forest, df, "id", ["x", "y"]).orderBy("id").collect()
    for form in (S.score_sparse_long, S.score_sparse_vectorised):
        assert form(forest, entries, "id", absent=None, keys=df.select("id")).orderBy("id").collect() == want
