"""the stream form equals the batch form (both stateless plans and the
relational plan inside foreachBatch)."""

import pytest

from sylvan.operators import score as S
from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest
from sylvan.session import scratch_path
from sylvan.streaming.score_stream import score_stream_to_end

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("strategy", ["vectorised", "expression", "relational"])
def test_stream_equals_batch(spark, strategy):
    forest = events_forest(spark, 5, 3)
    feats = event_features(spark, SF)
    src = scratch_path(spark, "src")
    feats.repartition(3).write.parquet(src)
    out = score_stream_to_end(spark, forest, src, feats.schema, "event_id", EVENT_FEATURES,
                              scratch_path(spark, "out"), scratch_path(spark, "ckpt"), strategy=strategy)
    batch = S.score_vectorised(forest, feats, "event_id", EVENT_FEATURES)
    a = sorted((r["event_id"], r["score"]) for r in out.collect())
    b = sorted((r["event_id"], r["score"]) for r in batch.collect())
    assert a == b
