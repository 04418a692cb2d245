"""Tables that change in one step."""

import threading

import pytest
from pyspark.sql import functions as F

from sylvan.sinks import writers as W
from sylvan.sinks.versioned import VersionedTable


def ids(df):
    return sorted(r.id for r in df.collect())


def test_replace_append_and_repeat(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="nothing"):
        t.read()
    assert t.commit(spark.range(3), "a") and t.commit(spark.range(5, 7), "b", append=True)
    assert ids(t.read()) == [0, 1, 2, 5, 6]
    assert not t.commit(spark.range(99), "a") and not t.commit(spark.range(5, 7), "b", append=True)  # repeated runs
    assert ids(t.read()) == [0, 1, 2, 5, 6]
    before = t.read()
    assert t.commit(spark.range(10, 11), "c")
    assert ids(before) == [0, 1, 2, 5, 6] and ids(t.read()) == [10]  # a reader of the old version keeps it
    with pytest.raises(ValueError, match="schema"):
        t.commit(spark.range(2).withColumn("x", F.lit(1)), "d", append=True)
    assert t.commit(spark.range(2).withColumn("x", F.lit(1)), "e") and t.read().columns == ["id", "x"]


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.range(3), "a")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_publish", lambda self, state: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            t.commit(spark.range(9), "b")
    with pytest.raises(Exception, match="boom|division|DIVIDE|raise_error|USER_RAISED"):
        t.commit(spark.range(9).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), "c")
    assert ids(t.read()) == [0, 1, 2]
    assert t.commit(spark.range(9), "b") and len(ids(t.read())) == 9  # the same run again


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    threads = [threading.Thread(target=lambda i=i: VersionedTable(spark, path).commit(spark.range(i, i + 1), f"run {i}", append=True)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = VersionedTable(spark, path)
    assert ids(table.read()) == list(range(6)) and table.state()["number"] == 6


def test_a_number_that_is_taken_is_not_written_over(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(spark.range(1), "a")
    assert not t._publish({"number": 1, "schema": "", "folders": [], "runs": []})
    assert t.state()["runs"] == ["a"]


def test_replaced_table_points_at_one_folder(spark, tmp_path):
    path = str(tmp_path / "r")
    for n in (3, 5, 2):
        assert W.replace_table(spark, spark.range(n), "replaced_t", path).count() == n
    assert W.replace_table(spark, spark.range(4).withColumn("x", F.lit("a")), "replaced_t", path).columns == ["id", "x"]
    assert spark.table("replaced_t").count() == 4
    spark.sql("DROP TABLE replaced_t")


def test_runs_are_appended_once(spark, tmp_path):
    row = spark.range(1).select(F.lit("q").alias("name"), F.lit(1.5).alias("s"))
    for run in ("r1", "r1", "r2"):
        W.append_runs(row, str(tmp_path / "runs"), run)
    assert VersionedTable(spark, str(tmp_path / "runs")).read().count() == 2
