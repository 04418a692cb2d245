"""Training with MLlib (M1-M7) and the SQL-style ``train`` call (M5).

Row order is made explicit before fitting (sorted within partitions by the
key) and seeds are fixed, so a re-run on the same partitions fits the same
forest.  MLlib's forests take no missing values, so tables that have some are
refused (M6); 'xgboost' and 'lightgbm' learn where missing values go.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.operators.boost import Boosted, BoostParams, boost
from sylvan.functions.sqlfuncs import Project
from sylvan.operators.evaluate import positive_weight, require_no_nulls
from sylvan.sources.forests import load_forest, save_forest

DEFAULT_TREES = 10
DEFAULT_DEPTH = 8
BOOST_STEP = 0.1
#: Names under which the library's own boosting is asked for.
BOOSTED = ("xgboost", "lightgbm")


def assemble(df: DataFrame, features: Sequence[str] | str, out: str = "features") -> DataFrame:
    """Feature columns, or the name of one array or vector column, as an MLlib vector (missing: NaN)."""
    if isinstance(features, str):
        if not isinstance(df.schema[features].dataType, T.ArrayType):
            return df.withColumn(out, F.col(features))
        filled = F.transform(features, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
        return df.withColumn(out, array_to_vector(filled))
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def _ordered(df: DataFrame, key: str | None) -> DataFrame:
    return df.sortWithinPartitions(key) if key else df


def _require_whole(df: DataFrame, features: Sequence[str] | str) -> None:
    if not isinstance(features, str):
        require_no_nulls(df, features)
        return
    xs = F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)
    bad = df.where(F.col(features).isNull() | F.exists(xs, lambda x: x.isNull() | F.isnan(x))).count()
    if bad:
        raise ValueError(f"missing values in features: {bad} rows of {features}")


def train_forest(df: DataFrame, features: Sequence[str] | str, label: str, algorithm: str = "randomforest",
                 task: str = "classification", n_trees: int = DEFAULT_TREES, max_depth: int = DEFAULT_DEPTH,
                 max_bins: int = 32, seed: int = 42, key: str | None = None,
                 positive_weighting: bool = False):
    """M1-M4: fit an MLlib forest; returns the fitted model.

    ``algorithm``: 'randomforest' or 'gbt' fit MLlib models (boosted trees with
    step 0.1). 'xgboost' and 'lightgbm' fit :mod:`sylvan.operators.boost` with
    these libraries' usual settings -- 256 leaves, L2 of 1, step 0.1, positive
    rows always weighted by n / positives -- and return its :class:`Boosted`;
    they take feature columns, missing values included.
    ``positive_weighting``: weight positive rows by n / positives (A6).
    """
    if algorithm in BOOSTED:
        return _boosted(df, features, label, task, n_trees, max_depth)
    if df.isEmpty():
        # an all-test split (train fraction 0) leaves nothing to fit
        raise ValueError("the training table is empty (train fraction 0?)")
    if algorithm in ("randomforest", "gbt"):
        _require_whole(df, features)
    data = assemble(_ordered(df, key), features)
    kw = dict(featuresCol="features", labelCol=label, maxDepth=max_depth, maxBins=max_bins, seed=seed)
    if positive_weighting and task == "classification":
        w = positive_weight(df, label).first()[0]
        data = data.withColumn("_w", F.when(F.col(label) != 0, F.lit(float(w))).otherwise(F.lit(1.0)))
        kw["weightCol"] = "_w"
    if algorithm == "randomforest":
        est = (RandomForestClassifier if task == "classification" else RandomForestRegressor)(
            numTrees=n_trees, **kw)
    elif algorithm == "gbt":
        est = (GBTClassifier if task == "classification" else GBTRegressor)(
            maxIter=n_trees, stepSize=BOOST_STEP, **kw)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return est.fit(data)


def _boosted(df: DataFrame, features, label: str, task: str, n_trees: int, max_depth: int) -> Boosted:
    if isinstance(features, str):
        raise ValueError("boosting reads feature columns; unpack the array or use boost_sparse")
    if df.isEmpty():
        raise ValueError("the training table is empty (train fraction 0?)")
    params = BoostParams(n_trees=n_trees, max_depth=max_depth, step=BOOST_STEP, objective="squared")
    if task == "classification":
        params = replace(params, objective="logistic", positive_weight=float(positive_weight(df, label).first()[0] or 1.0))
    return boost(df, features, label, params)


def save_model(model, path: str) -> str:
    """K8: save / overwrite a fitted model folder."""
    if isinstance(model, Boosted):
        return save_forest(model.forest, path)
    model.write().overwrite().save(path)
    return path


def train(spark: SparkSession, project: str, algorithm: str, task: str, hyperparams_json: str, relation_name: str, y_column: str,
          model_path: str, projects_path: str, key: str | None = None) -> DataFrame:
    """M5 by table name: every column but the label and the key is a feature.

    The run's row is appended to the ``projects`` table below
    ``projects_path``; returns that row.
    """
    relation = spark.table(relation_name)
    features = [c for c in relation.columns if c not in (y_column, key)]
    row = train_from_table(spark, project, relation, y_column, features, algorithm, task, hyperparams_json, model_path, key)
    row = (row.withColumn("relation_name", F.lit(relation_name)).withColumn("y_column", F.lit(y_column))
              .withColumn("features", F.array(*map(F.lit, features))))
    row.write.mode("append").parquet(projects_path)
    return row


def deployed(spark: SparkSession, projects_path: str) -> dict[str, Project]:
    """The projects of the ``projects`` table, one row each, with their forests: for :func:`register_forest_table`."""
    rows = spark.read.parquet(projects_path).where("status = 'deployed'").select("project", "model_path", "features").collect()
    return {r.project: Project(load_forest(spark, r.model_path), r.features) for r in rows}


def train_from_table(spark: SparkSession, project: str, relation: DataFrame, y_column: str,
                     features: Sequence[str], algorithm: str, task: str, hyperparams_json: str,
                     model_path: str, key: str | None = None) -> DataFrame:
    """M5: ``train(project, algorithm, task, hyperparams, relation, y)``.

    Fits, saves the model under ``model_path`` and returns one row
    describing the run (the SQL call's result row).
    """
    params = json.loads(hyperparams_json or "{}")
    model = train_forest(relation, features, y_column, algorithm, task,
                         n_trees=int(params.get("n_estimators", DEFAULT_TREES)),
                         max_depth=int(params.get("max_depth", DEFAULT_DEPTH)), key=key)
    save_model(model, model_path)
    forest = load_forest(spark, model_path)
    return spark.range(1).select(
        F.lit(project).alias("project"), F.lit(algorithm).alias("algorithm"), F.lit(task).alias("task"),
        F.lit(forest.meta.n_trees).alias("n_trees"), F.lit(forest.meta.n_nodes).alias("n_nodes"),
        F.lit(model_path).alias("model_path"), F.lit("deployed").alias("status"))
