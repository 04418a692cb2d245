"""Forest imports and exports as node relations.

* MLlib model folder: ``data/`` holds one row per node (``treeID``,
  ``nodeData{id, prediction, impurityStats, leftChild, rightChild,
  split{featureIndex, leftCategoriesOrThreshold}}``), ``treesMetadata/``
  the tree weights, ``metadata/`` the model class and parameters.
* Tabular dump, one CSV per tree, in the boosted-tree library's
  ``trees_to_dataframe`` layout (tree_index, node_index names like
  ``0-S1`` / ``0-L2``, left_child, right_child, parent_index,
  split_feature, threshold, decision_type, missing_direction, value, ...).
* Nested JSON dump, one tree per line: ``{"nodeid", "split": "f<i>",
  "split_condition", "yes", "no", "missing", "children": [..]}`` or
  ``{"nodeid", "leaf"}``; ``x < split_condition`` goes to ``yes``.

The node relation is model-sized; these plans never touch data rows.
"""

from __future__ import annotations

import json
from dataclasses import asdict, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions.splits import category_words
from sylvan.operators.forest import CATEGORIES, NODE_COLUMNS, Forest, ForestMeta
from sylvan.session import ship_package

# --- MLlib model folders ---------------------------------------------------------

_KINDS = {
    # class suffix: (task, combine, margin scale)
    "RandomForestClassificationModel": ("classification", "vote", 1.0),
    "RandomForestRegressionModel": ("regression", "mean", 1.0),
    "GBTClassificationModel": ("classification", "logit", 2.0),
    "GBTRegressionModel": ("regression", "sum", 1.0),
    "DecisionTreeClassificationModel": ("classification", "vote", 1.0),
    "DecisionTreeRegressionModel": ("regression", "mean", 1.0),
}


def _model_metadata(spark: SparkSession, path: str) -> dict:
    line = spark.read.text(f"{path}/metadata").first()[0]
    return json.loads(line)


def forest_from_mllib_dir(spark: SparkSession, path: str) -> Forest:
    """A saved MLlib tree-ensemble folder as a node relation."""
    md = _model_metadata(spark, path)
    cls = md["class"].rsplit(".", 1)[-1]
    task, combine, scale = _KINDS[cls]
    params = {**md.get("defaultParamMap", {}), **md.get("paramMap", {})}
    n_features = int(md.get("numFeatures", 0))
    n_classes = int(md.get("numClasses", 2)) if task == "classification" else 2
    data = spark.read.parquet(f"{path}/data")
    if "treeID" not in data.columns:  # a single tree
        data = data.select(F.lit(0).alias("treeID"), F.struct(*[F.col(c) for c in data.columns]).alias("nodeData"))
    if cls.startswith("DecisionTree"):
        weights = spark.range(1).select(F.lit(0).alias("tree_id"), F.lit(1.0).alias("tree_weight"))
    else:
        weights = spark.read.parquet(f"{path}/treesMetadata").select(
            F.col("_1").cast("int").alias("tree_id"), F.col("_3").cast("double").alias("tree_weight"))
    n = F.col("nodeData")
    leaf = n["leftChild"] < 0
    stats = n["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    if combine == "vote":
        counts = F.when(leaf, F.transform(stats, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))))
    else:
        counts = F.lit(None).cast("array<double>")
    nodes = data.select(
        F.col("treeID").cast("int").alias("tree_id"),
        n["id"].cast("int").alias("node_id"),
        F.when(~leaf, n["split"]["featureIndex"]).cast("int").alias("feature"),
        # leaves carry an empty threshold array: F.get gives null, not an error
        F.when(~leaf, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.lit("le").alias("op"),
        F.when(~leaf, n["leftChild"]).cast("int").alias("left"),
        F.when(~leaf, n["rightChild"]).cast("int").alias("right"),
        # MLlib asks x <= t, which NaN fails: missing values go right
        F.lit(False).alias("default_left"),
        F.when(leaf, n["prediction"]).alias("value"),
        counts.alias("class_counts"),
    ).join(weights, "tree_id").select(*NODE_COLUMNS)
    counts_row = data.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("treeID").alias("t"),
                          F.count_if(~leaf & (n["split"]["numCategories"] > 0)).alias("categorical")).first()
    if counts_row["categorical"]:
        nodes = _with_categories(nodes, data.where(~leaf & (n["split"]["numCategories"] > 0)).select(
            F.col("treeID").cast("int").alias("tree_id"), n["id"].cast("int").alias("node_id"),
            n["split"]["leftCategoriesOrThreshold"].alias("left"), n["split"]["numCategories"].alias("k")))
    meta = ForestMeta(n_trees=int(counts_row["t"]), max_depth=int(params.get("maxDepth", 5)),
                      n_nodes=int(counts_row["n"]), n_features=n_features, task=task,
                      combine=combine, n_classes=n_classes, margin_scale=scale)
    return Forest(nodes, meta).checkpointed()


def _with_categories(nodes: DataFrame, splits: DataFrame) -> DataFrame:
    """Categorical splits (tree_id, node_id, left categories, number of categories) as 'in' nodes.

    MLlib keeps the smaller side of the split and asks whether a value is on
    it, so a value it has never seen goes with the larger one.
    """
    ship_package(nodes.sparkSession)

    def to_words(batches):
        for pdf in batches:
            pdf["default_left"] = [2 * len(c) > k for c, k in zip(pdf["left"], pdf["k"])]
            pdf["words"] = [category_words(c, int(k), d) for c, k, d in zip(pdf["left"], pdf["k"], pdf["default_left"])]
            yield pdf[["tree_id", "node_id", "default_left", "words"]]

    sets = splits.mapInPandas(to_words, "tree_id int, node_id int, default_left boolean, words array<long>")
    sets = sets.withColumnRenamed("default_left", "_seen")
    is_set = F.col("words").isNotNull()
    out = nodes.join(sets, ["tree_id", "node_id"], "left")
    changed = {"threshold": F.when(~is_set, F.col("threshold")), "op": F.when(is_set, F.lit("in")).otherwise(F.col("op")),
               "default_left": F.coalesce("_seen", "default_left")}
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in NODE_COLUMNS], F.col("words").alias(CATEGORIES))


# --- forests as they are ------------------------------------------------------------

def save_forest(forest: Forest, path: str) -> str:
    """K8: the node relation as Parquet with its metadata beside it; an earlier model there is replaced."""
    spark = forest.nodes.sparkSession
    forest.nodes.select(*forest.node_columns()).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    meta = spark.range(1).select(F.lit(json.dumps(asdict(forest.meta))).alias("value"))
    meta.coalesce(1).write.mode("overwrite").text(f"{path}/forest")
    return path


def load_forest(spark: SparkSession, path: str) -> Forest:
    """A folder of :func:`save_forest` or an MLlib model folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/forest")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return forest_from_mllib_dir(spark, path)
    meta = ForestMeta(**json.loads(spark.read.text(f"{path}/forest").first()[0]))
    return Forest(spark.read.parquet(f"{path}/nodes"), meta)


# --- tabular dump (one CSV per tree) ----------------------------------------------

TABULAR_DDL = ("tree_index int, node_depth int, node_index string, left_child string, right_child string, "
               "parent_index string, split_feature string, split_gain double, threshold double, "
               "decision_type string, missing_direction string, missing_type string, value double, "
               "weight double, count long")


def _node_name(tree: str, node: str, is_leaf) -> F.Column:
    return F.concat(F.col(tree).cast("string"), F.when(is_leaf, F.lit("-L")).otherwise(F.lit("-S")),
                    F.col(node).cast("string"))


def export_tabular(forest: Forest, path: str, depths: DataFrame | None = None) -> None:
    """K9: one CSV per tree (``tree_index=<t>/``) in the tabular dump layout.

    The layout has no place for class counts, so a voting forest is refused.
    """
    if forest.meta.combine == "vote":
        raise ValueError("tabular dumps carry no class counts; export a voting forest as JSON")
    if forest.has_categories:
        raise ValueError("tabular dumps carry no category sets; export the forest as JSON")
    from sylvan.operators.forest import node_depths
    nd = forest.nodes
    d = depths if depths is not None else node_depths(nd, forest.meta.max_depth + 1)
    kids = nd.select("tree_id", F.explode(F.array("left", "right")).alias("node_id"),
                     F.col("node_id").alias("parent"))
    leaf_of = nd.select("tree_id", "node_id", F.col("feature").isNull().alias("is_leaf"))
    lchild = leaf_of.select("tree_id", F.col("node_id").alias("left"), F.col("is_leaf").alias("l_leaf"))
    rchild = leaf_of.select("tree_id", F.col("node_id").alias("right"), F.col("is_leaf").alias("r_leaf"))
    rows = (nd.join(d, ["tree_id", "node_id"], "left").join(kids, ["tree_id", "node_id"], "left")
            .join(lchild, ["tree_id", "left"], "left").join(rchild, ["tree_id", "right"], "left"))
    is_leaf = F.col("feature").isNull()
    out = rows.select(
        F.col("tree_id").alias("tree_index"), (F.col("depth") + 1).alias("node_depth"),
        _node_name("tree_id", "node_id", is_leaf).alias("node_index"),
        F.when(~is_leaf, _node_name("tree_id", "left", F.col("l_leaf"))).alias("left_child"),
        F.when(~is_leaf, _node_name("tree_id", "right", F.col("r_leaf"))).alias("right_child"),
        F.when(F.col("parent").isNotNull(), _node_name("tree_id", "parent", F.lit(False))).alias("parent_index"),
        F.when(~is_leaf, F.concat(F.lit("Column_"), F.col("feature").cast("string"))).alias("split_feature"),
        F.lit(None).cast("double").alias("split_gain"),
        F.col("threshold"),
        F.when(~is_leaf, F.when(F.col("op") == "lt", F.lit("<")).otherwise(F.lit("<="))).alias("decision_type"),
        F.when(~is_leaf, F.when(F.col("default_left"), F.lit("left")).otherwise(F.lit("right"))).alias("missing_direction"),
        F.when(~is_leaf, F.lit("NaN")).alias("missing_type"),
        F.col("value"), F.col("tree_weight").alias("weight"), F.lit(None).cast("long").alias("count"))
    out.write.partitionBy("tree_index").option("header", True).csv(path)


def forest_from_tabular(spark: SparkSession, path: str, meta: ForestMeta) -> Forest:
    """Read tabular dump CSVs back into the node relation.

    Node names become integers per tree: the root (no parent) is 0, the
    rest follow their name order (a window over one tree's nodes: model
    sized).
    """
    raw = spark.read.schema(TABULAR_DDL).option("header", True).option("mode", "FAILFAST").csv(path)
    if "tree_index" not in raw.columns or raw.schema["tree_index"].dataType != T.IntegerType():
        raw = raw.withColumn("tree_index", F.col("tree_index").cast("int"))
    w = Window.partitionBy("tree_index").orderBy(F.col("parent_index").isNotNull(), "node_index")
    ids = raw.select("tree_index", "node_index", (F.row_number().over(w) - 1).alias("nid"))
    left = ids.select("tree_index", F.col("node_index").alias("left_child"), F.col("nid").alias("lid"))
    right = ids.select("tree_index", F.col("node_index").alias("right_child"), F.col("nid").alias("rid"))
    j = (raw.join(ids, ["tree_index", "node_index"]).join(left, ["tree_index", "left_child"], "left")
         .join(right, ["tree_index", "right_child"], "left"))
    is_leaf = F.col("split_feature").isNull()
    nodes = j.select(
        F.col("tree_index").alias("tree_id"), F.col("nid").cast("int").alias("node_id"),
        F.when(~is_leaf, F.regexp_extract("split_feature", r"(\d+)$", 1).cast("int")).alias("feature"),
        F.when(~is_leaf, F.col("threshold")).alias("threshold"),
        F.when(F.col("decision_type") == "<", F.lit("lt")).otherwise(F.lit("le")).alias("op"),
        F.col("lid").cast("int").alias("left"), F.col("rid").cast("int").alias("right"),
        F.coalesce(F.col("missing_direction") == "left", F.lit(True)).alias("default_left"),
        F.when(is_leaf, F.col("value")).alias("value"),
        F.lit(None).cast("array<double>").alias("class_counts"),
        F.coalesce(F.col("weight"), F.lit(1.0)).alias("tree_weight"))
    # tree weight is per tree: take the root's
    tw = nodes.where(F.col("node_id") == 0).select("tree_id", F.col("tree_weight").alias("_tw"))
    nodes = nodes.join(tw, "tree_id").withColumn("tree_weight", F.col("_tw")).select(*NODE_COLUMNS)
    size = raw.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tree_index").alias("t"), F.max("node_depth").alias("d")).first()
    meta = replace(meta, n_trees=size["t"], n_nodes=size["n"], max_depth=max(size["d"] - 1, 0) if size["d"] else meta.max_depth)
    return Forest(nodes, meta).checkpointed()


# --- nested JSON dump ---------------------------------------------------------------

def export_json(forest: Forest, path: str) -> None:
    """K9 (JSON form): one nested JSON tree per line, built bottom-up with
    one small join per level."""
    nd = forest.nodes
    D = forest.meta.max_depth
    from sylvan.operators.forest import node_depths
    depths = node_depths(nd, D + 1)
    nodes = nd.join(depths, ["tree_id", "node_id"])
    # each level's subtrees as JSON text, deepest first
    sub = None
    for d in range(D, -1, -1):
        lvl = nodes.where(F.col("depth") == d)
        leaf_json = F.to_json(F.struct(F.col("node_id").alias("nodeid"), F.col("value").alias("leaf"), F.col("class_counts").alias("counts")))
        if sub is None:
            cur = lvl.select("tree_id", "node_id", leaf_json.alias("js"))
        else:
            # one equi-join per level: (node, side, child) rows meet the child's JSON
            sides = lvl.where(F.col("feature").isNotNull()).select(
                "tree_id", F.col("node_id").alias("parent"),
                F.posexplode(F.array("left", "right")).alias("side", "node_id"))
            kids = (sides.join(sub, ["tree_id", "node_id"])
                    .groupBy("tree_id", F.col("parent").alias("node_id"))
                    .agg(F.max(F.when(F.col("side") == 0, F.col("js"))).alias("ljs"),
                         F.max(F.when(F.col("side") == 1, F.col("js"))).alias("rjs")))
            j = lvl.join(kids, ["tree_id", "node_id"], "left")
            # XGBoost convention: x < t -> yes; our 'le' splits are exported as is
            split_json = F.concat(
                F.lit('{"nodeid":'), F.col("node_id").cast("string"),
                F.lit(',"split":"f'), F.col("feature").cast("string"), F.lit('"'),
                F.lit(',"split_condition":'), F.coalesce(F.col("threshold").cast("string"), F.lit("null")),
                F.coalesce(F.concat(F.lit(',"in":'), F.to_json(F.col(CATEGORIES))), F.lit("")) if forest.has_categories else F.lit(""),
                F.lit(',"yes":'), F.col("left").cast("string"), F.lit(',"no":'), F.col("right").cast("string"),
                F.lit(',"missing":'), F.when(F.col("default_left"), F.col("left")).otherwise(F.col("right")).cast("string"),
                F.lit(',"children":['), F.col("ljs"), F.lit(","), F.col("rjs"), F.lit("]}"))
            cur = j.select("tree_id", "node_id",
                           F.when(F.col("feature").isNull(), leaf_json).otherwise(split_json).alias("js"))
        sub = cur
    rule = F.when(F.col("op") != "in", F.col("op"))  # a category set is named at its node
    own = nd.groupBy("tree_id").agg(F.max("tree_weight").alias("w"), F.coalesce(F.max(rule), F.lit("le")).alias("op"),
                                    F.coalesce(F.min(rule), F.lit("le")).alias("op2"))
    if own.where("op != op2").count():
        raise ValueError("a tree with both split rules has no JSON form")
    (sub.where(F.col("node_id") == 0).join(own, "tree_id")
        .select(F.concat(F.lit('{"tree":'), F.col("tree_id").cast("string"), F.lit(',"weight":'), F.col("w").cast("string"),
                         F.lit(',"op":"'), F.col("op"), F.lit('","root":'), F.col("js"), F.lit("}")).alias("v")).write.text(path))


JSON_NODES = ("tree_id int, depth int, node_id int, feature int, threshold double, op string, left int, right int, "
              "default_left boolean, value double, class_counts array<double>, tree_weight double, left_categories array<long>")


def _tree_nodes(tree: int, text: str, op: str) -> list[tuple]:
    """One dumped tree, wrapped (``tree``, ``weight``, ``op``, ``root``) or a bare root node, as node rows of any depth."""
    top = json.loads(text)
    root, weight = top, 1.0
    if "root" in top:
        root, tree, weight, op = top["root"], top.get("tree", tree), top.get("weight", 1.0), top.get("op", op)
    out, todo = [], [(root, 0)]
    while todo:
        n, depth = todo.pop()
        if "leaf" in n:
            out.append((tree, depth, n["nodeid"], None, None, op, None, None, True, float(n["leaf"]), n.get("counts"), float(weight), None))
        else:
            feature = int(str(n["split"]).lstrip("f"))
            words = n.get("in")
            out.append((tree, depth, n["nodeid"], feature, float(n["split_condition"]) if words is None else None, op if words is None else "in",
                        n["yes"], n["no"], n.get("missing", n["yes"]) == n["yes"], None, None, float(weight), words))
            todo += [(c, depth + 1) for c in n["children"]]
    return out


def forest_from_json(spark: SparkSession, path: str, meta: ForestMeta, op: str = "lt") -> Forest:
    """Nested JSON trees -> node relation, one tree a line.

    Reads this library's own dumps and plain ones, whose lines are the bare
    root nodes (trees are then numbered by line). ``op`` is the split rule of
    a plain dump: 'lt' for boosted trees (``x < split_condition`` -> yes). The
    ``missing`` child decides ``default_left``. Depth, trees and nodes come
    from the dump, whatever ``meta`` says; a line that does not parse raises.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    # one row per tree, so the window is model-sized
    numbered = lines.select("value", (F.row_number().over(Window.orderBy("at")) - 1).alias("tree"))
    ship_package(spark)

    def parse(batches):
        for pdf in batches:
            rows = [r for t, v in zip(pdf["tree"], pdf["value"]) for r in _tree_nodes(int(t), v, op)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in JSON_NODES.split(", ")])
            for c in ("feature", "left", "right"):
                out[c] = out[c].astype("Int32")
            yield out

    parsed = Forest(numbered.mapInPandas(parse, JSON_NODES), meta).checkpointed().nodes
    size = parsed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tree_id").alias("t"), F.max("depth").alias("d"),
                      F.count(CATEGORIES).alias("sets")).first()
    columns = NODE_COLUMNS + [CATEGORIES] * (size["sets"] > 0)
    return Forest(parsed.select(*columns), replace(meta, n_trees=size["t"], n_nodes=size["n"], max_depth=size["d"] or 0))
