"""Whitening against an eigendecomposition of the covariance."""

import random

import numpy as np
import pytest

from sylvan.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, id string, v string, whitened int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else list(map(lambda x: None if x is None else float(x), e)), "x", "y", 1) for i, e in rows], SCHEMA).repartition(4)


def plain(rows, k=32):
    """x of the clean rows -> what the query returns, by a symmetric eigensolver."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in e] for _, e in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    a = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    e, v = np.linalg.eigh(a.T @ a / n)
    o = np.argsort(-e)[:k]
    return dev, a @ (v[:, o] / np.sqrt(np.maximum(e[o], 1e-300))), e[o] / e.sum()


def check(spark, rows, clean, k=32):
    out = W.whitened_components(W.whiten(spark, frame(spark, rows), components=k)).toPandas()
    dev, white, share = plain(clean, k)
    got = out.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in clean]].to_numpy()
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-8
    first = out[out.component == 1].set_index("vec_id").loc[[i for i, _ in clean]]
    assert first.deviation.tolist() == dev and set(out.n) == {len(clean)}
    got_share = out.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(got_share / share - 1).max() < 1e-9
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    assert len(out) == len(clean) * white.shape[1]


@pytest.mark.parametrize("d", [3, 40])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    mix = rng.normal(size=(d, d)) * np.geomspace(1, 300, d)
    clean = [(i, e) for i, e in enumerate((rng.normal(size=(300, d)) @ mix).tolist())]
    clean += [(1000 + i, clean[7][1]) for i in range(150)]  # one vector is a third of all rows
    bad = [(2000, None), (2001, []), (2002, [None] + [1.0] * (d - 1)), (2003, [float("nan")] * d), (2004, [float("inf")] * d), (2005, [1.0] * (d + 1))]
    rows = clean + bad
    random.Random(1).shuffle(rows)
    check(spark, rows, clean, k=min(d, 32))


def test_nearly_dependent_columns(spark):
    """A condition of 1e8, where a plain Gram matrix has lost half its digits."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 3)) * [1e6, 1e6, 1.0]
    rows = [(i, [x, x + z, y]) for i, (x, y, z) in enumerate(a.tolist())]
    out = W.whiten(spark, frame(spark, rows)).toPandas()
    w = np.stack(out.whitened)
    assert w.shape == (400, 3) and np.abs(w.T @ w / 400 - np.eye(3)).max() < 1e-6


def test_flat_directions_are_left_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [x, x, 5.0, y]) for i, (x, y) in enumerate(rng.normal(size=(80, 2)).tolist())]
    out = W.whiten(spark, frame(spark, rows)).toPandas()
    assert {len(w) for w in out.whitened} == {2} and out.identity_error[0] < 1e-9


def test_equal_rows_and_no_rows(spark):
    assert W.whitened_components(W.whiten(spark, frame(spark, [(i, [1.0, 2.0]) for i in range(5)]))).count() == 0
    empty = W.whitened_components(W.whiten(spark, frame(spark, [])))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_and_null_ids(spark):
    out = W.whiten(spark, frame(spark, [(1, [0.0, 1.0]), (1, [2.0, 0.0]), (None, [5.0, 5.0]), (None, [1.0, -3.0])])).collect()
    assert sorted(r.vec_id is None for r in out) == [False, False, True, True]


def test_numbers_beyond_a_long():
    x = np.array([[1 << 61, 0], [-(1 << 61), 5], [3, 4]], dtype=np.int64)
    sums = W._column_sums(x)
    assert sums == [3, 9]
    assert W.centred_exactly(x, 3, sums).tolist() == [[3 * int(a) - s for a, s in zip(r, sums)] for r in x]
    assert W.whole_numbers(np.array([1e300, -1e300, 0.5])).tolist() == [(1 << 63) - 1, -(1 << 63), 1_000_032]


def test_solve_rows():
    rng = np.random.default_rng(4)
    r1, r2 = (np.triu(rng.normal(size=(5, 5))) + 4 * np.eye(5) for _ in range(2))
    a = rng.normal(size=(9, 5))
    assert np.allclose(W.solve_rows(a, [r1, r2]) @ r2 @ r1, a)
