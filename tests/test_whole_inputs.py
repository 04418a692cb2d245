"""Rows that fixtures rarely hold: null keys, empty sparse rows, deep dumps, weights, counts, malformed fields, replays."""

import json

import pytest
from pyspark.sql import functions as F

from sylvan.functions.sqlfuncs import predict_batch
from sylvan.operators import evaluate, score as S
from sylvan.operators.forest import NODE_SCHEMA, Forest, ForestMeta
from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest
from sylvan.session import scratch_path
from sylvan.sources import files, forests as FS

SF = "/root/testdata/sf0.001"


def test_libsvm_line_without_entries_stays(spark, tmp_path):
    (tmp_path / "x").write_text("1 2:0.5\n3\n0 1:1 4:2\n")
    got = files.read_libsvm_long(spark, str(tmp_path / "x")).collect()
    assert sorted((r.label, r.feature, r.value) for r in got if r.feature is not None) == [(0.0, 0, 1.0), (0.0, 3, 2.0), (1.0, 1, 0.5)]
    assert [r.label for r in got if r.feature is None] == [3.0]


@pytest.mark.parametrize("read", [lambda s, p: files.read_csv_named(s, p, ["a", "b"], {"a": "int", "b": "int"}),
                                  lambda s, p: files.read_csv_headerless(s, p, "a int, b int")])
def test_malformed_csv_field_fails(spark, tmp_path, read):
    (tmp_path / "x.csv").write_text("1,2\n1,abc\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read(spark, str(tmp_path / "x.csv")).collect()


def _chain(depth):
    node = {"nodeid": depth, "leaf": 1.0}
    for d in range(depth - 1, -1, -1):
        node = {"nodeid": d, "split": "f0", "split_condition": float(d), "yes": 1000 + d, "no": node["nodeid"], "missing": 1000 + d,
                "children": [{"nodeid": 1000 + d, "leaf": d / 64}, node]}
    return node


def test_plain_json_dump_of_any_depth(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "t.json").write_text("\n".join(json.dumps(t) for t in (_chain(6), {"nodeid": 0, "leaf": 2.0})))
    forest = FS.forest_from_json(spark, str(tmp_path / "d"), ForestMeta(n_trees=1, max_depth=1, n_nodes=1, n_features=1, combine="sum"))
    assert (forest.meta.n_trees, forest.meta.max_depth, forest.meta.n_nodes) == (2, 6, 14)
    rows = spark.createDataFrame([(0, -1.0), (1, 2.5), (2, 99.0)], "k int, a double")
    for f in S.STRATEGIES.values():
        assert {r.k: r.score for r in f(forest, rows, "k", ["a"]).collect()} == {0: 2.0, 1: 2 + 3 / 64, 2: 3.0}


def test_json_line_that_does_not_parse_fails(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"nodeid": 0, "leaf": 1.0}\n{"nodeid": 0, "leaf"\n')
    with pytest.raises(Exception, match="(?i)json|expecting"):
        FS.forest_from_json(spark, str(tmp_path / "t.json"), ForestMeta(n_trees=1, max_depth=1, n_nodes=1, n_features=1, combine="sum"))


def _voting(spark, weight=1.0):
    nodes = spark.createDataFrame([(0, 0, 0, 0.0, "lt", 1, 2, False, None, None, weight),
                                   (0, 1, None, None, "lt", None, None, True, 0.0, [0.75, 0.25], weight),
                                   (0, 2, None, None, "lt", None, None, True, 1.0, [0.25, 0.75], weight)], NODE_SCHEMA)
    return Forest(nodes, ForestMeta(n_trees=1, max_depth=1, n_nodes=3, n_features=1, task="classification", combine="vote", n_classes=2))


def test_json_keeps_weights_counts_and_rule(spark):
    path = scratch_path(spark, "t_json")
    FS.export_json(_voting(spark, 0.5), path)
    back = FS.forest_from_json(spark, path, _voting(spark).meta, op="le")
    cols = ("node_id", "feature", "threshold", "op", "default_left", "class_counts", "tree_weight")
    key = lambda n: sorted(tuple(map(str, r)) for r in n.where("feature is null").select("node_id", "class_counts", "tree_weight").collect())
    assert key(back.nodes) == key(_voting(spark, 0.5).nodes)
    assert back.nodes.where("node_id = 0").select(*cols).first()[:5] == (0, 0, 0.0, "lt", False)


def test_tabular_refuses_class_counts(spark):
    with pytest.raises(ValueError, match="class counts"):
        FS.export_tabular(_voting(spark), scratch_path(spark, "t_tab"))


def test_more_class_counts_than_classes_fail(spark):
    f = _voting(spark)
    wide = Forest(f.nodes, ForestMeta(**{**f.meta.__dict__, "n_classes": 1}))
    with pytest.raises(ValueError, match="class counts"):
        wide.to_arrays()


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, s string")
    assert evaluate.null_profile(df).first().asDict() == {"x": 2, "s": 1}


def test_report_counts_pairs_before_the_cube(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("y"), (F.col("id") % 2).alias("p"))
    plan = evaluate.classification_report(df, "y", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate [y")


def test_predict_batch_calls_the_forest_once(spark):
    x = event_features(spark, SF).withColumn("b", (F.col("event_id") % 7).cast("long"))
    plan = predict_batch(events_forest(spark, 3, 3), x, "event_id", EVENT_FEATURES, "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("strategy", ["vectorised", "relational"])
def test_stream_scores_a_forest_of_real_size(spark, strategy):
    from sylvan.streaming.score_stream import score_stream_to_end
    forest, feats = events_forest(spark, 40, 8), event_features(spark, SF)
    src, out = scratch_path(spark, "src"), scratch_path(spark, "out")
    feats.repartition(2).write.parquet(src)
    got = score_stream_to_end(spark, forest, src, feats.schema, "event_id", EVENT_FEATURES, out, scratch_path(spark, "ck"), strategy)
    assert got.count() == feats.count()
    if strategy == "relational":  # a replay of everything from the start replaces what is there
        again = score_stream_to_end(spark, forest, src, feats.schema, "event_id", EVENT_FEATURES, out, scratch_path(spark, "ck2"), strategy)
        assert again.count() == feats.count()
