"""SQL-callable forest functions.

``forest_predict(array(...))``      row-level function, Arrow-batched pandas
                                     UDF; the forest ships once per executor
                                     as broadcasts of NumPy arrays, one per
                                     group of at most 2 M nodes.
``predict_batch(array_agg(...))``    one call per query-sized batch of rows: an
                                     aggregate's array of feature arrays in, an
                                     array of scores out. ``in_pieces`` splits a
                                     batch of any size into bounded groups.
``forest_score(TABLE(t), 'project')`` table function: the rows of any table with
                                     the project's feature columns, and their
                                     score and prediction.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.operators.forest import MAX_SHIPPED_NODES, Forest
from sylvan.operators.names import spare_name
from sylvan.operators.score import walk_arrays
from sylvan.session import ship_package


def _combined(groups: list, meta, X: np.ndarray) -> np.ndarray:
    """Combined score per row (the same rule as ``score.finalize``); ``groups``: broadcasts of tree groups."""
    if meta.combine == "vote":
        acc = sum(walk_arrays(g.value, X, "vote") for g in groups)
        return np.argmax(acc, axis=1).astype(np.float64)
    swv, sw = (sum(part) for part in zip(*[walk_arrays(g.value, X, meta.combine) for g in groups]))
    if meta.combine == "sum":
        return meta.base + swv
    if meta.combine == "mean":
        return swv / sw
    margin = meta.base + swv
    return 1.0 / (1.0 + np.exp(-meta.margin_scale * margin))


def _stack(series: pd.Series, width: int) -> np.ndarray:
    """Rows of feature arrays -> matrix; null arrays / elements -> NaN; an array shorter than the forest's features raises."""
    try:
        X = np.stack(series.to_numpy()).astype(np.float64)
        if X.ndim == 2 and X.shape[1] >= width:
            return X[:, :width]
    except (TypeError, ValueError):
        pass
    X = np.full((len(series), width), np.nan)
    for r, v in enumerate(series):
        if v is not None:
            if len(v) < width:
                raise ValueError(f"{len(v)} features given to a forest of {width}")
            row = np.asarray([np.nan if e is None else e for e in v], dtype=np.float64)
            X[r, :min(width, len(row))] = row[:width]
    return X


def register_forest_predict(spark: SparkSession, forest: Forest, name: str = "forest_predict", max_nodes: int = MAX_SHIPPED_NODES):
    """Register ``name(array<double>) -> double`` for SQL use.

    A scalar function holds its whole forest; one beyond a worker's memory
    needs the relational plan.
    """
    ship_package(spark)
    groups = [spark.sparkContext.broadcast(a) for a in forest.array_groups(max_nodes)]
    meta = forest.meta
    width = meta.n_features

    @F.pandas_udf(T.DoubleType())
    def forest_predict(xs: pd.Series) -> pd.Series:
        return pd.Series(_combined(groups, meta, _stack(xs, width)))

    spark.udf.register(name, forest_predict)
    return forest_predict


#: Rows of one array handed to ``predict_batch`` at most, where ``in_pieces`` splits the batch.
PIECE_ROWS = 10_000


def in_pieces(df: DataFrame, out: str = "piece", bound: int = PIECE_ROWS) -> DataFrame:
    """``df`` with a piece number: rows with one number lie in one partition and are at most ``bound``.

    Grouping by batch *and* piece keeps the arrays of an aggregate bounded
    however large the batch; the pieces' scores are exploded to rows anyway.
    """
    row = F.monotonically_increasing_id()
    return df.withColumn(out, row - F.pmod(row, F.lit(bound)))


def _batch_udf(spark: SparkSession, forest: Forest, max_nodes: int):
    ship_package(spark)
    groups = [spark.sparkContext.broadcast(a) for a in forest.array_groups(max_nodes)]
    meta = forest.meta
    width = meta.n_features

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def batch_scores(batches: pd.Series) -> pd.Series:
        out = []
        for xs in batches:
            if xs is None:
                out.append(None)
            else:
                X = _stack(pd.Series(list(xs)), width) if len(xs) else np.zeros((0, width))
                out.append(_combined(groups, meta, X))
        return pd.Series(out)

    # an explode of the result would otherwise call it again to skip empty arrays
    return batch_scores.asNondeterministic()


def register_predict_batch(spark: SparkSession, forest: Forest, name: str = "predict_batch", max_nodes: int = MAX_SHIPPED_NODES) -> None:
    """Register ``name(array<array<double>>) -> array<double>``: the scores of an aggregate's rows, in their order."""
    spark.udf.register(name, _batch_udf(spark, forest, max_nodes))


def predict_batch(forest: Forest, df: DataFrame, key: str, features, batch_col: str, max_nodes: int = MAX_SHIPPED_NODES) -> DataFrame:
    """Forest calls on arrays of a batch's rows; ``key, batch_col, score``.

    Keys and features go in as arrays, scores come back as one array and are
    zipped back to their keys.
    """
    scores = _batch_udf(df.sparkSession, forest, max_nodes)
    xs = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    rows = df.select(F.col(f"`{batch_col}`").alias("b"), F.struct(F.col(f"`{key}`").alias("k"), xs.alias("x")).alias("r"))
    grouped = in_pieces(rows, "piece").groupBy("b", "piece").agg(F.collect_list("r").alias("rows"))
    # keys and feature arrays leave the group in the same order
    zipped = grouped.select("b", F.arrays_zip(F.col("rows.k").alias("k"), scores(F.col("rows.x")).alias("s")).alias("z"))
    return zipped.select(F.explode("z").alias("e"), "b").select(F.col("e.k").alias(key), F.col("b").alias(batch_col), F.col("e.s").alias("score"))


@dataclass
class Project:
    """A deployed model: its forest and the columns it reads, in order."""

    forest: Forest
    features: Sequence[str]


#: Rows that the table function scores together.
TABLE_ROWS = 4096


def register_forest_table(spark: SparkSession, projects: Mapping[str, Project], name: str = "forest_score", max_nodes: int = MAX_SHIPPED_NODES) -> None:
    """Register the table function ``name(TABLE(t), 'project')``.

    Its schema follows the table: all columns of ``t``, then ``score`` and
    ``prediction`` (underscores behind them if ``t`` has such columns). Rows
    stay in their partitions; each task scores ``TABLE_ROWS`` of them at a time.
    A project that is not there, or a feature column the table lacks, is an
    error of the query's analysis.
    """
    ship_package(spark)
    features = {k: list(p.features) for k, p in projects.items()}
    metas = {k: p.forest.meta for k, p in projects.items()}
    shipped = {k: [spark.sparkContext.broadcast(a) for a in p.forest.array_groups(max_nodes)] for k, p in projects.items()}

    class ForestScore:
        @staticmethod
        def analyze(rows: F.AnalyzeArgument, project: F.AnalyzeArgument) -> F.AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a TABLE")
            if project.value not in features:
                raise ValueError(f"no project {project.value!r}")
            fields = list(rows.dataType.fields)
            lacking = [c for c in features[project.value] if c not in [f.name for f in fields]]
            if lacking:
                raise ValueError(f"the table lacks the columns {lacking}")
            # spare names begin with an underscore, these do not
            score, prediction = (spare_name([f"_{f.name}" for f in fields], n)[1:] for n in ("score", "prediction"))
            return F.AnalyzeResult(T.StructType([*fields, T.StructField(score, T.DoubleType()), T.StructField(prediction, T.DoubleType())]))

        def __init__(self):
            self.rows, self.project = [], None

        def eval(self, row, project):
            self.rows.append(row)
            self.project = project
            if len(self.rows) == TABLE_ROWS:
                yield from self.flush()

        def terminate(self):
            if self.rows:
                yield from self.flush()

        def flush(self):
            rows, self.rows = self.rows, []
            meta, names = metas[self.project], features[self.project]
            X = np.array([[np.nan if r[c] is None else float(r[c]) for c in names] for r in rows], dtype=np.float64).reshape(len(rows), len(names))
            score = _combined(shipped[self.project], meta, X)
            if meta.task != "classification" or meta.combine == "vote":
                predicted = score
            else:
                # a margin above 0 is a probability above one half
                predicted = (score > (0.5 if meta.combine == "logit" else meta.cut)).astype(np.float64)
            for r, s, p in zip(rows, score.tolist(), predicted.tolist()):
                yield (*r, s, p)

    spark.udtf.register(name, F.udtf(ForestScore))
