"""Histogram boosting against a plain NumPy trainer that tries every cut of every node."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan.operators import boost as B
from sylvan.operators import score as S
from sylvan.operators.forest import Forest
from sylvan.operators.train import save_model, train_forest
from sylvan.sources.forests import load_forest

FEATS = ["a", "b", "c", "d"]
CUTS = [[-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5]] * 4


def data(n=500, seed=1, missing=0.2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[rng.random((n, 4)) < missing] = np.nan
    return x, (np.nan_to_num(x[:, 0]) + 0.5 * np.isnan(x[:, 1]) - np.nan_to_num(x[:, 2]) * np.nan_to_num(x[:, 0]) > 0.3).astype(float)


def frame(spark, x, y):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double").repartition(3)


def plain(x, y, cuts, p, chosen):
    """(splits by path of every tree, final margins), best gain first; of cuts equally good to rounding, the one ``chosen``."""
    n, logistic = len(y), p.objective == "logistic"
    w = np.where(y != 0, p.positive_weight, 1.0) if logistic else np.ones(n)
    share = (w * (y != 0)).sum() / w.sum()
    m = np.full(n, p.base if p.base is not None else np.log(share / (1 - share)) if logistic else y.mean())
    score = lambda a, b: a * a / (b + p.l2) if b + p.l2 > 0 else 0.0
    trees = []
    for tree in range(p.n_trees):
        q = 1 / (1 + np.exp(-m))
        g, h = (w * (q - (y != 0)), w * q * (1 - q)) if logistic else (m - y, np.ones(n))

        def best(path, at):
            found = []
            for f in range(x.shape[1]):
                for t in [*cuts[f], np.inf]:
                    for d in (False, True):
                        left = np.where(np.isnan(x[at, f]), d, x[at, f] <= t)
                        a, b = at[left], at[~left]
                        if len(a) and len(b) and min(h[a].sum(), h[b].sum()) >= p.min_hessian:
                            gain = 0.5 * (score(g[a].sum(), h[a].sum()) + score(g[b].sum(), h[b].sum()) - score(g[at].sum(), h[at].sum()))
                            if gain > p.min_gain + 1e-12:
                                found.append((gain, f, t, d, a, b))
            top = max((c[0] for c in found), default=0.0)
            first = [c for c in found if c[0] > top - 1e-9]
            return next((c for c in first if c[1:4] == chosen.get((tree, path))), first[0]) if first else None

        nodes, heap, splits = {"": np.arange(n)}, [], {}

        def push(path):
            b = best(path, nodes[path]) if len(path) < p.max_depth else None
            if b:
                heapq.heappush(heap, (-b[0], path, b))

        push("")
        while heap and len(splits) < p.max_leaves - 1:
            _, path, b = heapq.heappop(heap)
            splits[path], nodes[path + "L"], nodes[path + "R"] = b[:4], b[4], b[5]
            push(path + "L"), push(path + "R")
        for path in set(nodes) - set(splits):
            at = nodes[path]
            m[at] -= p.step * g[at].sum() / (h[at].sum() + p.l2)
        trees.append(splits)
    return trees, m


@pytest.mark.parametrize("p", [
    B.BoostParams(n_trees=3, max_depth=4, max_leaves=6),
    B.BoostParams(n_trees=1, max_depth=3, l2=0.0, positive_weight=2.5, base=0.0),
    B.BoostParams(n_trees=2, max_depth=5, max_leaves=9, objective="squared", min_hessian=5.0, min_gain=0.1),
], ids=["leaf limit", "positive weight", "squared"])
def test_every_split_is_the_best_one(spark, p):
    x, y = data()
    if p.objective == "squared":
        y = np.nan_to_num(x[:, 0]) * 3 + np.isnan(x[:, 3])
    df = frame(spark, x, y)
    out = B.boost(df, FEATS, "y", p, CUTS)
    report = out.report.collect()
    chosen = {(r.tree_id, r.path): (r.feature, r.threshold if r.threshold < 1e308 else np.inf, r.default_left) for r in report if r.feature is not None}
    trees, margin = plain(x, y, CUTS, p, chosen)
    for i, want in enumerate(trees):
        got = {r.path: r for r in report if r.tree_id == i and r.feature is not None}
        assert set(got) == set(want) and len(got) < p.max_leaves
        for path, (gain, f, t, d) in want.items():
            r = got[path]
            assert (r.feature, r.default_left) == (f, d) and (r.threshold == t or t == np.inf and r.threshold > 1e308)
            assert r.gain == pytest.approx(gain, abs=1e-6)
    for plan in S.STRATEGIES:
        s = S.score(out.forest, df, "id", FEATS, plan).orderBy("id").toPandas()
        assert np.abs(s["margin" if p.objective == "logistic" else "score"].to_numpy() - margin).max() < 1e-9


def as_sparse(spark, x):
    rows = [(i, f, float(v)) for i, r in enumerate(x) for f, v in enumerate(r) if not np.isnan(v)]
    return spark.createDataFrame(rows, "id long, feature int, value double").repartition(4)


def test_sparse_rows_learn_what_dense_rows_learn(spark):
    x, y = data(seed=2)
    p = B.BoostParams(n_trees=3, max_depth=3, max_bins=16)
    labels = frame(spark, x, y).select("id", "y")
    zero_gone = np.where(x == 0, np.nan, x)
    dense = B.boost(frame(spark, zero_gone, y), FEATS, "y", p)
    sparse = B.boost_sparse(as_sparse(spark, x), labels, "id", "y", params=p)  # zeros written out count as missing
    rows = lambda o: sorted(tuple(r) for r in o.report.collect())
    assert rows(sparse) == rows(dense)
    assert {r[5] for r in rows(sparse)} >= {True, False}  # both branches were learned
    kept = B.boost_sparse(as_sparse(spark, x), labels, "id", "y", params=p, zero_as_missing=False)
    assert rows(kept) == rows(B.boost(frame(spark, x, y), FEATS, "y", p))


def test_wide_sparse_rows_and_rows_without_entries(spark):
    entries = spark.createDataFrame([(i, 900_000 + i % 7, 1.0 + i % 3) for i in range(200)], "id long, feature int, value double")
    labels = spark.range(300).select("id", ((F.col("id") % 7 == 3) & (F.col("id") < 200)).cast("double").alias("y"))
    out = B.boost_sparse(entries, labels, "id", "y", params=B.BoostParams(n_trees=1, max_depth=2, l2=0.0, step=1.0, base=0.0))
    root = out.report.where("path = ''").first()
    # present against missing on the one feature that decides; no 0.9 million wide row anywhere
    assert root.feature == 900_003 and root.n == 300 and not root.default_left
    s = S.score_sparse_long(out.forest, entries, "id", absent=None, keys=labels.select("id"))
    assert s.join(labels, "id").where((F.col("prediction") == 1) != (F.col("y") == 1)).count() == 0


def test_trees_do_not_depend_on_partitions(spark):
    x, y = data(seed=3)
    p = B.BoostParams(n_trees=2, max_depth=3, positive_weight=1 / 3)
    a, b = (B.boost(frame(spark, x, y).repartition(n), FEATS, "y", p, CUTS).report.collect() for n in (1, 7))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_margins_are_carried_over_copies(spark, monkeypatch):
    x, y = data(n=200, seed=4)
    p = B.BoostParams(n_trees=4, max_depth=2)
    want = sorted(map(tuple, B.boost(frame(spark, x, y), FEATS, "y", p, CUTS).report.collect()))
    monkeypatch.setattr(B, "TREES_A_COPY", 2)
    assert sorted(map(tuple, B.boost(frame(spark, x, y), FEATS, "y", p, CUTS).report.collect())) == want
    monkeypatch.setattr(B, "DENSE_CELLS", 1)  # cells kept as a list
    assert sorted(map(tuple, B.boost(frame(spark, x, y), FEATS, "y", p, CUTS).report.collect())) == want


def test_one_label_no_rows_no_labels(spark):
    x, _ = data(n=50)
    out = B.boost(frame(spark, x, np.zeros(50)), FEATS, "y", B.BoostParams(n_trees=2))
    assert out.forest.meta.n_nodes == 2  # nothing to split: a leaf a tree
    empty = frame(spark, x, np.zeros(50)).where("id < 0")
    with pytest.raises(ValueError, match="empty"):
        B.boost(empty, FEATS, "y")
    with pytest.raises(ValueError, match="no label"):
        B.boost(frame(spark, x, np.zeros(50)).withColumn("y", F.lit(None).cast("double")), FEATS, "y")
    gone = frame(spark, np.full((20, 4), np.nan), np.arange(20) % 2)
    assert B.boost(gone, FEATS, "y", B.BoostParams(n_trees=1)).forest.meta.n_nodes == 1


@pytest.mark.parametrize("name", ["xgboost", "lightgbm"])
def test_by_the_libraries_names(spark, tmp_path, name):
    x, y = data(n=300)
    df = frame(spark, x, y)
    model = train_forest(df, FEATS, "y", name, n_trees=2, max_depth=3)
    again = load_forest(spark, save_model(model, str(tmp_path / "m")))
    assert isinstance(again, Forest) and again.meta == model.forest.meta
    a, b = (S.score(f, df, "id", FEATS).orderBy("id").collect() for f in (model.forest, again))
    assert a == b
    with pytest.raises(ValueError, match="columns"):
        train_forest(df.select("y", F.array(*FEATS).alias("xs")), "xs", "y", name)
