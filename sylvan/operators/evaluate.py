"""Evaluation of predictions against labels.

All metrics are aggregates over the scored table; only the (tiny) per-class
result comes out.  The classification report needs one pass: the counts of
(label, prediction) pairs, from which every other count follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """A4: (y, p, n)."""
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))


def confusion_pivot(df: DataFrame, y: str, p: str, classes: Sequence[int]) -> DataFrame:
    """A4 wide form: one row per true class, one count column per predicted
    class (``p_<c>``); the class list is given so no extra job runs."""
    wide = df.groupBy(F.col(y).alias("y")).pivot(p, list(classes)).agg(F.count(F.lit(1)))
    return wide.select("y", *[F.coalesce(F.col(str(c)), F.lit(0)).cast("long").alias(f"p_{c}")
                              for c in classes])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def classification_report(df: DataFrame, y: str, p: str, digits: int = 6) -> DataFrame:
    """A2: per class precision, recall, F1, support; accuracy; macro and
    support-weighted means.  Classes = every value seen as label or
    prediction; a zero denominator gives 0.

    Columns: label (string), precision, recall, f1_score (double), support (long).

    Plan: count (label, prediction) pairs, the only pass over the scored rows;
    a ``cube`` over these few counts; then per class, then per report line.
    """
    pairs = (df.select(F.col(y).cast("long").alias("y"), F.col(p).cast("long").alias("p"))
             .groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
             .coalesce(1))  # classes x classes counts: what follows needs no more exchange
    cube = pairs.cube("y", "p").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    # g: 0 = (y, p), 1 = (y), 2 = (p), 3 = ()
    g = F.col("g")
    per = (cube.where(g < 3)
           .select(F.when(g == 2, F.col("p")).otherwise(F.col("y")).alias("c"),
                   F.when((g == 0) & (F.col("y") == F.col("p")), F.col("n")).otherwise(0).alias("tp"),
                   F.when(g == 1, F.col("n")).otherwise(0).alias("sup"),
                   F.when(g == 2, F.col("n")).otherwise(0).alias("pred"))
           .groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("sup"), F.sum("pred").alias("pred")))
    per = per.select("c", "tp", "sup", _ratio(F.col("tp"), F.col("pred")).alias("pr"),
                     _ratio(F.col("tp"), F.col("sup")).alias("rc"))
    per = per.withColumn("f1", F.when(F.col("pr") + F.col("rc") == 0, F.lit(0.0))
                         .otherwise(2 * F.col("pr") * F.col("rc") / (F.col("pr") + F.col("rc"))))
    lines = per.select(F.explode(F.array(*[
        F.struct(lab.alias("label"), F.col("tp"), F.col("sup"), F.col("pr"), F.col("rc"), F.col("f1"))
        for lab in (F.col("c").cast("string"), F.lit("accuracy"), F.lit("macro avg"), F.lit("weighted avg"))
    ])).alias("r")).select("r.*")
    lab = F.col("label")
    n = F.sum("sup")

    def wmean(c):
        return _ratio(F.sum(F.col(c) * F.col("sup")), n)
    out = lines.groupBy("label").agg(
        F.when(lab == "accuracy", F.lit(None).cast("double"))
         .when(lab == "weighted avg", wmean("pr")).otherwise(F.avg("pr")).alias("precision"),
        F.when(lab == "accuracy", F.lit(None).cast("double"))
         .when(lab == "weighted avg", wmean("rc")).otherwise(F.avg("rc")).alias("recall"),
        F.when(lab == "accuracy", _ratio(F.sum("tp"), n))
         .when(lab == "weighted avg", wmean("f1")).otherwise(F.avg("f1")).alias("f1_score"),
        n.cast("long").alias("support"))
    return out.select("label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      "support")


def regression_errors(df: DataFrame, y: str, p: str, digits: int = 4) -> DataFrame:
    """A3: mean squared error and its root."""
    mse = F.avg(F.pow(F.col(y) - F.col(p), 2))
    return df.agg(mse.alias("mse")).select(F.round("mse", digits).alias("mse"),
                                           F.round(F.sqrt("mse"), digits).alias("rmse"))


def positive_weight(df: DataFrame, y: str) -> DataFrame:
    """``count(*) / count(y != 0)`` (the reference's weight, kept as is)."""
    return df.agg(_ratio(F.count(F.lit(1)), F.count_if(F.col(y) != 0)).alias("weight"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """M6: one pass, one count of missing values (null, or NaN in a float column) per column."""
    cols = list(cols or df.columns)
    floats = {c for c, t in df.dtypes if t in ("float", "double")}
    missing = lambda c: F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()
    return df.agg(*[F.count_if(missing(c)).cast("long").alias(c) for c in cols])


def require_no_nulls(df: DataFrame, cols: Sequence[str]) -> None:
    """M6: random forests reject tables with missing values."""
    row = null_profile(df, cols).first().asDict()
    bad = {k: v for k, v in row.items() if v}
    if bad:
        raise ValueError(f"missing values in features: {bad}")


def mllib_metrics(df: DataFrame, label: str, prediction: str, score: str | None = None) -> DataFrame:
    """A5: (metric, value) as MLlib's evaluators give them; with ``score`` also its errors against the label.

    ``df`` is read once a metric, so pass a written table.
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    d = df.select(F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction"))
    rows = [(m, MulticlassClassificationEvaluator(metricName=m).evaluate(d))
            for m in ("accuracy", "f1", "weightedPrecision", "weightedRecall")]
    if score is not None:
        s = df.select(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("prediction"))
        rows += [(m, RegressionEvaluator(metricName=m).evaluate(s)) for m in ("mse", "rmse", "mae")]
    return df.sparkSession.createDataFrame(rows, "metric string, value double")
