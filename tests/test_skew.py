"""A key holding a third of all rows must not land in one task or merge rows."""

from pyspark.sql import functions as F

from sylvan.operators import score as S
from sylvan.operators.numbering import global_row_number
from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest

SF = "/root/testdata/sf0.01"


def _hot(spark):
    x = event_features(spark, SF)
    # a third of the rows share one key value
    return x.withColumn("k", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("event_id")))


def test_row_numbering_spreads_a_hot_key(spark):
    hot = _hot(spark)
    n = hot.count()
    r = global_row_number(hot, "k", "rn", n_partitions=8)
    sizes = [row[1] for row in r.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n
    assert max(sizes) < n / 3  # the hot value is split over several tasks
    agg = r.agg(F.countDistinct("rn"), F.max("rn")).first()
    assert agg[0] == n and agg[1] == n - 1


def test_relational_scoring_keeps_rows_with_repeated_keys(spark):
    hot = _hot(spark)
    forest = events_forest(spark, 10, 4)
    by_id = S.score_relational(forest, hot, "event_id", EVENT_FEATURES)
    by_k = S.score_relational(forest, hot, "k", EVENT_FEATURES, carry=["event_id"])
    assert by_k.count() == hot.count()
    a = {r[0]: r[1] for r in by_id.select("event_id", "score").collect()}
    b = {r[0]: r[1] for r in by_k.select("event_id", "score").collect()}
    assert a == b
