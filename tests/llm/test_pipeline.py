"""The pipeline's stages, one by one on their own input, and the whole."""

from collections import Counter

import corpus_pipeline as P

import fixture


def test_stages(spark, tmp_path):
    docs = fixture.frame(spark, fixture.rows(repeat_ids=False))
    n = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] and n[4] > 0
    ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert max(ids.values()) <= 2
    pieces = P.STAGES[-1][1](spark, docs, str(tmp_path))
    assert set(ids) == {r.doc_id for r in pieces.select("doc_id").distinct().collect()}


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    seq = out.groupBy("sequence_id").sum("length").collect()
    assert sorted(r[0] for r in seq) == list(range(len(seq)))
    assert all(r[1] == 2048 for r in seq if r[0] < len(seq) - 1)


def test_empty(spark, tmp_path):
    docs = fixture.empty(spark)
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
