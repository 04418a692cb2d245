"""Sparse rows inside the vectorised walk: look-ups like a matrix, scores like the map form."""

import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from sylvan.operators import score as S
from sylvan.operators.forest import grid_forest


@settings(max_examples=80, deadline=None)
@given(st.lists(st.none() | st.dictionaries(st.integers(0, 6), st.floats(-5, 5), max_size=5), max_size=8),
       st.sampled_from([0.0, float("nan")]))
def test_reads_like_a_matrix(rows, absent):
    fs = pd.Series([None if r is None else np.array(list(r), dtype=np.int32) for r in rows], dtype=object)
    vs = pd.Series([None if r is None else np.array(list(r.values())) for r in rows], dtype=object)
    X = S.SparseRows(fs, vs, 7, absent)
    want = np.array([[(r or {}).get(f, absent) for f in range(7)] for r in rows]).reshape(len(rows), 7)
    assert X.shape == want.shape
    got = X[np.arange(len(rows))[:, None], np.broadcast_to(np.arange(7), want.shape)]
    assert np.array_equal(got, want, equal_nan=True)


def test_repeated_entry_raises():
    with pytest.raises(ValueError, match="two entries"):
        S.SparseRows(pd.Series([[1, 1]]), pd.Series([[0.5, 0.25]]), 3, 0.0)


@pytest.mark.parametrize("combine", ["sum", "vote"])
@pytest.mark.parametrize("absent", [0.0, None])
def test_same_scores_as_the_map_form(spark, combine, absent):
    forest = grid_forest(spark, 6, 4, [(0.0, 1.0)] * 5, combine=combine, n_classes=3)
    data = [(i, f, ((i * 37 + f * 11) % 16) / 16) for i in range(200) for f in range(5) if (i + f) % 3]
    data += [(3, 400, 0.5), (7, 4, None), (None, 2, 0.5)]
    entries = spark.createDataFrame([d for d in data if d[:2] != (7, 4) or d[2] is None], "k long, feature int, value double")
    keys = spark.range(210).withColumnRenamed("id", "k")
    a = S.score_sparse_vectorised(forest, entries, "k", absent=absent, keys=keys).collect()
    b = S.score_sparse_long(forest, entries, "k", absent=absent, keys=keys).collect()
    assert len(a) == 210 and sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("form", ["score_sparse_long", "score_sparse_vectorised"])
def test_every_entry_of_the_documents_is_scored(spark, monkeypatch, form):
    import __spark_entry__ as E
    from places import SF_SMALL
    given = []
    score = getattr(S, form)
    monkeypatch.setattr(S, form, lambda forest, entries, *a, **k: given.append(entries) or score(forest, entries, *a, **k))
    out = E.queries()[f"{form}_documents"](spark, SF_SMALL)
    texts = [r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    assert given[0].count() == sum(len({min(len(w), 1000) for w in re.findall(r"[^\x20\x09-\x0D]+", t)}) for t in texts)
    assert out.count() == len(texts)
