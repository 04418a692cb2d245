"""Physical-plan properties that matter at scale."""

from sylvan.operators import score as S
from sylvan.operators.numbering import ordered_split
from sylvan.plans.features import EVENT_FEATURES, event_features, events_forest
from sylvan.sources.tables import table

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_relational_plan_has_one_fact_exchange_and_no_cartesian(spark):
    df = S.score_relational(events_forest(spark, 10, 4), event_features(spark, SF), "event_id", EVENT_FEATURES)
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the forest walk: broadcast joins only; one hash exchange for the per-row
    # sums, keyed by the internal row id (never by a data value)
    assert plan.count("hashpartitioning(_rid") == 1
    assert "hashpartitioning(event_id" not in plan
    assert "SortMergeJoin" not in plan


def test_vectorised_and_expression_do_not_shuffle_fact_rows(spark):
    x = event_features(spark, SF)
    f = events_forest(spark, 10, 4)
    for fn in (S.score_vectorised, S.score_expression):
        plan = _plan(fn(f, x, "event_id", EVENT_FEATURES))
        assert "hashpartitioning(event_id" not in plan


def test_ordered_split_has_no_single_partition_over_fact_rows(spark):
    o = table(spark, SF, "orders", ["o_orderkey"])
    plan = _plan(ordered_split(o, "o_orderkey", 0.8))
    assert "SinglePartition" not in plan


def test_projection_reaches_scan(spark):
    df = table(spark, SF, "orders").select("o_orderkey", "o_totalprice").where("o_totalprice > 1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan


def test_category_dictionary_is_broadcast(spark):
    from sylvan.operators.encode import category_codes
    part = table(spark, SF, "part", ["p_partkey", "p_brand"])
    plan = _plan(category_codes(part, "p_brand", out="code"))
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan


def test_relational_reuses_key_partitioning(spark):
    x = event_features(spark, SF).repartition(8, "event_id")
    f = events_forest(spark, 10, 4)
    df = S.score_relational(f, x, "event_id", EVENT_FEATURES, key_is_unique=True)
    plan = _plan(df)
    # the only hash exchange on the key is the caller's repartition
    assert plan.count("hashpartitioning(event_id") == 1
    assert "hashpartitioning(_rid" not in plan
    base = S.score_vectorised(f, event_features(spark, SF), "event_id", EVENT_FEATURES)
    a = {r[0]: r[1] for r in df.select("event_id", "score").collect()}
    b = {r[0]: r[1] for r in base.select("event_id", "score").collect()}
    assert a == b


def test_unread_features_are_not_scanned(spark):
    from sylvan.plans.scoring import score_pruned_features
    plan = _plan(score_pruned_features(spark, SF))
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "event_id" in x)
    read = scan.split("ReadSchema: struct<")[1]
    assert "value" in read and "ts:" in read and "user_id" not in read and "props" not in read


def test_a_written_chunk_reads_its_own_files(spark, tmp_path):
    from sylvan.sources.files import union_chunks, write_key_chunks
    rows = [(i, None if i % 9 == 0 else float(i % 500), f"x{i}") for i in range(3000)] + [(-1, float("nan"), "nan")]
    df = spark.createDataFrame(rows, "chunk long, `a key` double, text string").repartition(3)
    chunks = write_key_chunks(df, "a key", 4, str(tmp_path / "c"))
    assert all(c.columns == df.columns for c in chunks)
    for i, c in enumerate(chunks):
        pruned = next(x for x in _plan(c).splitlines() if "FileScan" in x).split("PartitionFilters: [")[1].split("]")[0]
        assert f"= {i})" in pruned and "_chunk" in pruned
    assert union_chunks(chunks).exceptAll(df).count() == 0 == df.exceptAll(union_chunks(chunks)).count()
    assert chunks[0].where("`a key` is null").count() == df.where("`a key` is null").count()
    assert chunks[3].where("chunk = -1").count() == 1
    hot = spark.createDataFrame([(1, 5.0)] * 900 + [(2, 6.0)] * 100, "id long, k double")
    assert sorted(c.count() for c in write_key_chunks(hot, "k", 3, str(tmp_path / "h"))) == [0, 0, 1000]
    none = write_key_chunks(hot.where("false"), "k", 3, str(tmp_path / "e"))
    assert [c.count() for c in none] == [0, 0, 0]
