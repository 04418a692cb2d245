"""Tree dumps written by hand in the public layouts import to the right
node relation and score as the layouts say."""

import json

from sylvan.operators import score as S
from sylvan.operators.forest import ForestMeta
from sylvan.sources.forests import forest_from_json, forest_from_tabular


def _rows(spark):
    return spark.createDataFrame([(1, 0.5, 5.0), (2, 1.0, 5.0), (3, None, 5.0), (4, 2.0, 1.0)],
                                 "k int, a double, b double")


def test_json_dump_strict_split_and_missing_child(spark, tmp_path):
    # tree 0: f0 < 1.0 -> yes (node 1), missing -> no (node 2); node 2 splits f1 < 3.0
    t0 = {"nodeid": 0, "split": "f0", "split_condition": 1.0, "yes": 1, "no": 2, "missing": 2,
          "children": [{"nodeid": 1, "leaf": 0.5},
                       {"nodeid": 2, "split": "f1", "split_condition": 3.0, "yes": 3, "no": 4, "missing": 3,
                        "children": [{"nodeid": 3, "leaf": -0.25}, {"nodeid": 4, "leaf": 0.125}]}]}
    t1 = {"nodeid": 0, "leaf": 0.0625}
    path = tmp_path / "dump"
    path.mkdir()
    (path / "trees.json").write_text("\n".join(json.dumps({"tree": i, "root": t}) for i, t in enumerate([t0, t1])))
    meta = ForestMeta(n_trees=2, max_depth=2, n_nodes=6, n_features=2, combine="sum")
    forest = forest_from_json(spark, str(path), meta, op="lt")
    got = {r["k"]: r["score"] for r in S.score_relational(forest, _rows(spark), "k", ["a", "b"]).collect()}
    # k1: 0.5 < 1 -> 0.5; k2: 1.0 not < 1 -> node 2, 5 >= 3 -> 0.125; k3: missing -> node 2 -> 0.125;
    # k4: 2 -> node 2, 1 < 3 -> -0.25; every row + 0.0625 from the one-leaf tree
    assert got == {1: 0.5625, 2: 0.1875, 3: 0.1875, 4: -0.1875}
    vec = {r["k"]: r["score"] for r in S.score_vectorised(forest, _rows(spark), "k", ["a", "b"]).collect()}
    assert vec == got


def test_tabular_dump_names_and_missing_direction(spark, tmp_path):
    header = ("tree_index,node_depth,node_index,left_child,right_child,parent_index,split_feature,"
              "split_gain,threshold,decision_type,missing_direction,missing_type,value,weight,count")
    lines = [header,
             "0,1,0-S0,0-L0,0-S1,,Column_0,1.0,1.0,<=,right,NaN,,1.0,",
             "0,2,0-L0,,,0-S0,,,,,,,0.5,1.0,",
             "0,2,0-S1,0-L1,0-L2,0-S0,Column_1,1.0,3.0,<=,left,NaN,,1.0,",
             "0,3,0-L1,,,0-S1,,,,,,,-0.25,1.0,",
             "0,3,0-L2,,,0-S1,,,,,,,0.125,1.0,"]
    path = tmp_path / "tab"
    path.mkdir()
    (path / "0.csv").write_text("\n".join(lines) + "\n")
    meta = ForestMeta(n_trees=1, max_depth=2, n_nodes=5, n_features=2, combine="sum")
    forest = forest_from_tabular(spark, str(path), meta)
    got = {r["k"]: r["score"] for r in S.score_relational(forest, _rows(spark), "k", ["a", "b"]).collect()}
    # k1: 0.5 <= 1 -> 0.5; k2: 1.0 <= 1 -> 0.5; k3: missing -> right -> 5 > 3 -> 0.125; k4: 2 > 1, 1 <= 3 -> -0.25
    assert got == {1: 0.5, 2: 0.5, 3: 0.125, 4: -0.25}
