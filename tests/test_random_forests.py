"""Random irregular forests (mixed 'le'/'lt', early leaves, thresholds equal
to data values, missing values): every plan agrees with a plain Python walk."""

import random

import pytest

from sylvan.operators import score as S
from sylvan.operators.forest import NODE_SCHEMA, Forest, ForestMeta


def _random_forest(rng, n_trees, max_depth, k, values):
    rows = []
    for t in range(n_trees):
        nid = [0]

        def grow(node, depth):
            if depth == max_depth or (depth > 0 and rng.random() < 0.3):
                rows.append((t, node, None, None, "le", None, None, True,
                             rng.randrange(-64, 64) / 64.0, None, 1.0))
                return
            left, right = nid[0] + 1, nid[0] + 2
            nid[0] += 2
            rows.append((t, node, rng.randrange(k), float(rng.choice(values)), rng.choice(["le", "lt"]),
                         left, right, rng.random() < 0.5, None, None, 1.0))
            grow(left, depth + 1)
            grow(right, depth + 1)
        grow(0, 0)
    return rows


def _walk(rows, x):
    nodes = {(r[0], r[1]): r for r in rows}
    total = 0.0
    for t in sorted({r[0] for r in rows}):
        n = nodes[(t, 0)]
        while n[2] is not None:
            v = x[n[2]]
            if v is None:
                go_left = n[7]
            else:
                go_left = v < n[3] if n[4] == "lt" else v <= n[3]
            n = nodes[(t, n[5] if go_left else n[6])]
        total += n[8] * n[10]
    return total


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plans_match_python_walk(spark, seed):
    rng = random.Random(seed)
    k, values = 3, [0.0, 0.5, 1.0, 1.5, 2.0]
    rows = _random_forest(rng, 6, 5, k, values)
    depth = 5
    forest = Forest(spark.createDataFrame(rows, NODE_SCHEMA),
                    ForestMeta(n_trees=6, max_depth=depth, n_nodes=len(rows), n_features=k))
    data = [(i, *[None if rng.random() < 0.15 else rng.choice(values) for _ in range(k)]) for i in range(200)]
    df = spark.createDataFrame(data, "k long, a double, b double, c double")
    want = {d[0]: _walk(rows, d[1:]) for d in data}
    for strategy in ("relational", "vectorised", "expression"):
        got = {r["k"]: r["score"] for r in S.STRATEGIES[strategy](forest, df, "k", ["a", "b", "c"]).collect()}
        assert got == want, strategy
