"""Scoring a forest over a table: several physical plans, one result.

Every plan returns ``key, score, prediction`` (plus ``margin`` for the
logistic combine).  Rows keep their key; predictions are never aligned by
position.  Leaf terms are rounded to one grid per forest on which sums are
exact (``forest.grid_unit``), so all plans give the same bits whatever the
order of trees, tasks or tree groups, and the plan is the caller's choice.

relational   rows x trees (``explode`` of the tree ids), one broadcast
             equi-join on (tree_id, node_id) per tree level, then a
             per-row aggregate.  Trees are taken in groups whose node count
             is below the broadcast bound, so a forest of any size is scored
             exactly: each group is broadcast, the group partial sums are
             added up by the same aggregate.  With several groups the input
             is written once and read by each.  The aggregate's partial step
             runs in the same stage as the walk, so only one narrow row per
             key and partition is shuffled.
vectorised   ``mapInPandas`` over Arrow batches; the forest ships once as a
             broadcast of NumPy arrays and every tree is walked for the whole
             batch in ``max_depth`` vector steps.  Forests beyond the
             shipping bound are walked in tree groups.
expression   each tree compiled into one nested ``CASE WHEN`` column; all
             of it runs inside whole-stage codegen.  Forests too large for
             one expression are compiled in tree groups.
mllib        the native ``transform`` of an MLlib model.
sparse_long  rows given as (row key, feature, value) entries; only the
             entries of features the forest reads are kept, grouped into
             one map per row, then walked relationally.

Several tree groups read one copy of the rows, written once with a row id, and
add up their sums by that id.  Inside a plan the caller's columns have names
by place (``_k0``, ``_k1``, ...), so none of their names can meet one of ours.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions.splits import categories_of, goes_left, goes_left_np, in_set_np
from sylvan.operators.forest import CATEGORIES, MAX_SHIPPED_NODES, Forest, ForestMeta, on_grid, size_groups
from sylvan.session import scratch_path, shared_dir, ship_package

# Largest forest turned into one compiled expression.
MAX_EXPRESSION_NODES = 20_000
# Broadcast bound for one tree group of the relational plan.
MAX_GROUP_NODES = 200_000
# Trees walked together by one vectorised step (bounds a batch's memory).
VECTOR_TREE_CHUNK = 128


# ---------------------------------------------------------------------------
# shared pieces
# ---------------------------------------------------------------------------

def _feature_cols(features) -> list[Column]:
    if isinstance(features, str):
        return [F.col(features)]
    return [F.col(c) if isinstance(c, str) else c for c in features]


def feature_array(features) -> Column:
    """One ``array<double>`` of the row's features (feature i at index i)."""
    if isinstance(features, str):
        return F.transform(F.col(features), lambda x: x.cast("double"))
    return F.array(*[c.cast("double") for c in _feature_cols(features)])


def _sum_columns(meta: ForestMeta) -> list[str]:
    if meta.combine == "vote":
        return [f"_c{c}" for c in range(meta.n_classes)]
    return ["_swv", "_sw"]


def _keys(names: Sequence[str]) -> list[Column]:
    """The caller's columns under names by place."""
    return [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(names)]


def finalize(sums: DataFrame, names: Sequence[str], meta: ForestMeta) -> DataFrame:
    """Per-row sums -> the caller's columns ``names``, ``score, prediction`` (the combine rule).

    Columns beyond the key (e.g. the label) ride along, so evaluating needs no
    join back to the input.
    """
    key_cols = [F.col(f"_k{i}").alias(c) for i, c in enumerate(names)]
    base = F.lit(float(meta.base))
    cls = meta.task == "classification"
    if meta.combine == "vote":
        arr = F.array(*[F.col(f"_c{c}") for c in range(meta.n_classes)])
        best = F.array_max(arr)
        pred = (F.array_position(arr, best) - 1).cast("int")
        total = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
        score = F.when(total > 0, best / total).otherwise(F.lit(0.0))
        return sums.select(*key_cols, score.alias("score"), pred.alias("prediction"))
    if meta.combine == "sum":
        score = base + F.col("_swv")
    elif meta.combine == "mean":
        score = F.col("_swv") / F.col("_sw")
    elif meta.combine == "logit":
        margin = base + F.col("_swv")
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(float(meta.margin_scale)) * margin))
        pred = (margin > 0).cast("int") if cls else prob
        return sums.select(*key_cols, margin.alias("margin"), prob.alias("score"),
                           pred.alias("prediction"))
    else:
        raise ValueError(f"unknown combine {meta.combine!r}")
    pred = (score > F.lit(float(meta.cut))).cast("int") if cls else score
    return sums.select(*key_cols, score.alias("score"), pred.alias("prediction"))


def _leaf_terms(forest: Forest) -> list[Column]:
    """A leaf's terms that the per-row aggregate sums, on the forest's grid."""
    unit, weight_unit = forest.units()
    w = F.col("tree_weight")
    if forest.meta.combine == "vote":
        return [on_grid(F.get(F.col("class_counts"), F.lit(c)) * w, unit).alias(f"_c{c}")
                for c in range(forest.meta.n_classes)]
    return [on_grid(F.col("value") * w, unit).alias("_swv"), on_grid(w, weight_unit).alias("_sw")]


def forest_groups(forest: Forest, max_group_nodes: int = MAX_GROUP_NODES) -> list[tuple[int, int]]:
    """Contiguous tree-id ranges by the trees' own node counts; one range,
    without looking, when the whole forest is within the bound."""
    if forest.meta.n_nodes <= max_group_nodes:
        return [(0, forest.meta.n_trees)]
    return size_groups(forest.tree_sizes(), max_group_nodes)


def tree_groups(meta: ForestMeta, max_group_nodes: int = MAX_GROUP_NODES) -> list[tuple[int, int]]:
    """Contiguous tree-id ranges for complete trees of ``max_depth`` levels,
    without looking at the nodes."""
    per_tree = min(2 ** (meta.max_depth + 1) - 1, meta.n_nodes)
    per_group = max(1, max_group_nodes // max(per_tree, 1))
    return [(a, min(a + per_group, meta.n_trees)) for a in range(0, meta.n_trees, per_group)]


# ---------------------------------------------------------------------------
# relation-centric plan
# ---------------------------------------------------------------------------

_TREE_SHIFT = 1 << 32


def _node_key(tree: Column, node: Column) -> Column:
    """One long per (tree, node): the broadcast side becomes a long-keyed
    hash map (the fast single-long-key path of the hash join)."""
    return tree.cast("long") * F.lit(_TREE_SHIFT) + node.cast("long")


def _walk(rows: DataFrame, nodes: DataFrame, forest: Forest, lookup, carry: Sequence[str]) -> DataFrame:
    """Walk every (row, tree) pair ``max_depth`` levels down.

    ``rows`` has ``carry``, ``tree_id, node_id`` and whatever ``lookup`` needs;
    ``lookup(feature_col)`` returns the row's value of that feature.  Each
    level is one broadcast equi-join on the (tree, node) long key; leaves
    map to themselves, so rows that finish early stay put.
    """
    t = F.col("tree_id")
    step_nodes = F.broadcast(nodes.select(
        _node_key(t, F.col("node_id")).alias("_k"), "feature", "threshold", "op", "default_left",
        _node_key(t, F.col("left")).alias("_lk"), _node_key(t, F.col("right")).alias("_rk"),
        *[CATEGORIES] * forest.has_categories))
    keep = [c for c in rows.columns if c not in ("tree_id", "node_id")]
    rows = rows.select(*keep, _node_key(F.col("tree_id"), F.col("node_id")).alias("_k"))
    for _ in range(forest.meta.max_depth):
        j = rows.join(step_nodes, "_k")
        nxt = F.when(goes_left(lookup(F.col("feature")), F.col("threshold"), F.col("op"),
                               F.col("default_left"), F.col(CATEGORIES) if forest.has_categories else None), F.col("_lk")).otherwise(F.col("_rk"))
        rows = j.select(*keep, F.when(F.col("feature").isNull(), F.col("_k")).otherwise(nxt).alias("_k"))
    leaf_nodes = F.broadcast(nodes.select(_node_key(t, F.col("node_id")).alias("_k"), *_leaf_terms(forest)))
    return rows.join(leaf_nodes, "_k").select(*carry, *_sum_columns(forest.meta))


def _carried(rows: DataFrame) -> list[str]:
    """The caller's columns of a plan's rows, and their row id."""
    return [c for c in rows.columns if c == "_rid" or c.startswith("_k") and c[2:].isdigit()]


def _aggregate_terms(terms: DataFrame, meta: ForestMeta) -> DataFrame:
    """The sums of a row's terms, by row id."""
    firsts = [c for c in _carried(terms) if c != "_rid"]
    return terms.groupBy("_rid").agg(*[F.first(c).alias(c) for c in firsts], *[F.sum(c).alias(c) for c in _sum_columns(meta)])


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    shared_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _walk_groups(rows0: DataFrame, forest: Forest, lookup, max_group_nodes: int, absent: float | None = None) -> DataFrame:
    """The terms of all trees, one walk per tree group.

    Several groups read one written copy of the rows, so the input is scanned
    once and a row id is the same in every group. A tree above the bound is
    walked in bands of levels (:mod:`sylvan.operators.large_trees`).
    """
    groups = forest_groups(forest, max_group_nodes)
    large = set()
    if len(groups) > 1 or forest.meta.n_nodes > max_group_nodes:
        rows0 = _written(rows0, "walk_rows")
        large = {t for t, n in forest.tree_sizes() if n > max_group_nodes}
    terms = None
    for a, b in groups:
        nodes = forest.nodes if len(groups) == 1 else forest.nodes.where(F.col("tree_id").between(a, b - 1))
        if b - a == 1 and a in large:
            from sylvan.operators.large_trees import walk_large_tree
            part = walk_large_tree(rows0, nodes, forest, max_group_nodes, absent)
        else:
            rows = rows0.select("*", F.explode(F.sequence(F.lit(a), F.lit(b - 1))).alias("tree_id"), F.lit(0).alias("node_id"))
            part = _walk(rows, nodes, forest, lookup, _carried(rows0))
        terms = part if terms is None else terms.unionByName(part)
    return terms


def score_relational(forest: Forest, df: DataFrame, key: str, features,
                     carry: Sequence[str] = (), max_group_nodes: int = MAX_GROUP_NODES,
                     key_is_unique: bool = False) -> DataFrame:
    """Relation-centric scoring.

    By default the per-row aggregate groups on an internal row id (unique
    by construction, fixed per input partition), not on ``key``: a key that
    repeats -- or one value holding a third of the table -- can neither
    merge rows nor skew the aggregate.  With ``key_is_unique=True`` it
    groups on ``key`` itself, so an input already partitioned on the key
    (bucketed table, earlier ``repartition(key)``) is aggregated with no
    exchange at all.
    """
    names = [key, *carry]
    rid = F.col(f"`{key}`") if key_is_unique else F.monotonically_increasing_id()
    x = df.select(*_keys(names), feature_array(features).alias("_x"), rid.alias("_rid"))
    terms = _walk_groups(x, forest, lambda f: F.get(F.col("_x"), f), max_group_nodes)
    return finalize(_aggregate_terms(terms, forest.meta), names, forest.meta)


# ---------------------------------------------------------------------------
# Sparse rows in long form
# ---------------------------------------------------------------------------

def _sparse_rows(forest: Forest, entries: DataFrame, key: str, feature_col: str, value_col: str, keys: DataFrame | None, lists) -> DataFrame:
    """One row per row of ``keys``: _k0, _rid and what ``lists`` (an aggregate of _f, _v) makes of the key's entries.

    Only entries of features the forest reads are kept. A null key meets the
    entries whose key is null; a key that stands twice in ``keys`` is two rows.
    """
    used = forest.used_features().withColumnRenamed("feature", "_f")
    cells = entries.select(F.col(f"`{key}`").alias("_e"), F.col(f"`{feature_col}`").cast("int").alias("_f"), F.col(f"`{value_col}`").cast("double").alias("_v"))
    kept = cells.join(used, "_f", "left_semi").groupBy("_e").agg(*lists)
    rows = entries.select(F.col(f"`{key}`").alias("_k0")).distinct() if keys is None else keys.select(F.col(f"`{key}`").alias("_k0"))
    rows = rows.withColumn("_rid", F.monotonically_increasing_id())
    return rows.join(kept, F.col("_k0").eqNullSafe(F.col("_e")), "left").drop("_e")


def score_sparse_long(forest: Forest, entries: DataFrame, key: str,
                      feature_col: str = "feature", value_col: str = "value",
                      absent: float | None = 0.0, keys: DataFrame | None = None,
                      max_group_nodes: int = MAX_GROUP_NODES) -> DataFrame:
    """Score rows stored as (key, feature, value) entries.

    An absent entry reads as ``absent`` (0 by default; ``None`` = missing,
    which follows the node's default branch).  Only features the forest
    reads are kept (semi join with the used-feature set), then each
    row's entries become one map (bounded by the number of used features).
    ``keys`` lists every row to score (rows with no entry at all); by
    default the keys present in ``entries``.
    """
    meta = forest.meta
    as_map = F.map_from_entries(F.collect_list(F.struct("_f", "_v"))).alias("_m")
    # written once: the row ids are the same in every tree group
    rows0 = _written(_sparse_rows(forest, entries, key, feature_col, value_col, keys, [as_map]), "sparse_rows")
    if absent is None:
        lookup = lambda f: F.element_at(F.col("_m"), f)  # noqa: E731 - null when absent
    else:
        lookup = lambda f: F.coalesce(F.element_at(F.col("_m"), f), F.lit(float(absent)))
    terms = _walk_groups(rows0, forest, lookup, max_group_nodes, absent)
    return finalize(_aggregate_terms(terms, meta), [key], meta)


def score_sparse_vectorised(forest: Forest, entries: DataFrame, key: str,
                            feature_col: str = "feature", value_col: str = "value",
                            absent: float | None = 0.0, keys: DataFrame | None = None) -> DataFrame:
    """F5 with the vectorised plan: sparse rows scored without densifying.

    Only entries of features the forest reads are kept (semi join, as in the
    map form); a row's entries are grouped by key and the vectorised walk looks
    features up in the Arrow batch's sorted entries, so memory follows the
    entries there are, not rows x features.  A repeated entry raises.
    """
    meta = forest.meta
    width = max(1, int(forest.used_features().agg(F.max("feature")).first()[0] or 0) + 1)
    lists = F.collect_list(F.when(F.col("_v").isNotNull(), F.struct(F.col("_f").alias("f"), F.col("_v").alias("v")))).alias("_s")
    rows = _sparse_rows(forest, entries, key, feature_col, value_col, keys, [lists])
    rows = rows.select("_k0", "_rid", F.col("_s.f").alias("_fs"), F.col("_s.v").alias("_vs"))
    fill = np.nan if absent is None else float(absent)
    sums = _vector_sums(forest, rows, lambda pdf: SparseRows(pdf["_fs"], pdf["_vs"], width, fill))
    return finalize(sums, [key], meta)


class SparseRows:
    """Rows of (features, values) lists, read like a matrix: ``X[rows, features]``
    gives an entry's value, ``absent`` where there is none."""

    def __init__(self, features, values, width: int, absent: float):
        sizes = [0 if f is None else len(f) for f in features]
        code = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * width
        value = np.empty(0)
        if len(code):
            code += np.concatenate([f for f in features if f is not None]).astype(np.int64)
            value = np.concatenate([v for v in values if v is not None]).astype(np.float64)
        o = np.argsort(code)
        code = code[o]
        if (code[1:] == code[:-1]).any():
            raise ValueError("a row has two entries for one feature")
        # the last code is above every one asked for
        self.codes = np.append(code, np.iinfo(np.int64).max)
        self.values = np.append(value[o], absent)
        self.shape, self.absent = (len(sizes), width), absent

    def __getitem__(self, at):
        rows, features = at
        code = rows * self.shape[1] + features
        i = np.searchsorted(self.codes, code)
        return np.where(self.codes[i] == code, self.values[i], self.absent)

    def any_missing(self) -> bool:
        return bool(np.isnan(self.values).any())


# ---------------------------------------------------------------------------
# UDF-centric plan (vectorised walk over Arrow batches)
# ---------------------------------------------------------------------------

def walk_arrays(a: dict, X: np.ndarray, combine: str, tree_chunk: int = VECTOR_TREE_CHUNK):
    """Walk all trees for a batch ``X`` (rows x features or :class:`SparseRows`, NaN = missing).

    Returns (sum of terms, sum of weights) or the per-class sums for 'vote';
    the terms lie on a grid on which any order of adding gives the same sum.
    Leaves are their own children, so every row simply takes
    ``max_depth`` steps; each step is four gathers (feature, value,
    threshold, child) over a rows x trees index matrix.
    """
    n = X.shape[0]
    roots = a["root"]
    vote = combine == "vote"
    sparse = isinstance(X, SparseRows)
    if not sparse and X.shape[1] == 0:
        X = np.full((n, 1), np.nan)
    feature = np.where(a["feature"] < 0, 0, a["feature"])
    threshold = a["threshold"]
    kids = np.stack([a["left"], a["right"]], axis=1).ravel()
    any_lt = bool(a["is_lt"].any())
    sets = a.get("is_in")
    any_missing = X.any_missing() if sparse else bool(np.isnan(X).any())
    if vote:
        acc = np.zeros((n, a["class_terms"].shape[1]))
    else:
        swv = np.zeros(n)
    rows = np.arange(n)[:, None]
    for s in range(0, len(roots), tree_chunk):
        node = np.broadcast_to(roots[s:s + tree_chunk], (n, len(roots[s:s + tree_chunk]))).copy()
        for _ in range(a["max_depth"]):
            x = X[rows, feature[node]]
            t = threshold[node]
            if any_missing or any_lt:
                left = goes_left_np(x, t, a["is_lt"][node], a["default_left"][node])
            else:
                left = x <= t
            if sets is not None:
                at = sets[node]
                if at.any():
                    member = in_set_np(x, a["set_words"], a["set_start"][node], a["set_size"][node], a["default_left"][node])
                    left = np.where(at, member, left)
            node = kids[2 * node + (~left)]
        if vote:
            acc += a["class_terms"][node].sum(axis=1)
        else:
            swv += a["term"][node].sum(axis=1)
    if vote:
        return acc
    return swv, np.full(n, a["weight"])


def _vector_sums(forest: Forest, rows: DataFrame, matrix) -> DataFrame:
    """The caller's columns and the sums of every row; ``matrix(batch)`` gives the features of an Arrow batch.

    One pass for a forest within the shipping bound. A larger one is walked in
    tree groups over one written copy of the rows, a broadcast each, and the
    sums are added up by row id; no worker holds more than one group.
    """
    meta, spark = forest.meta, rows.sparkSession
    ship_package(spark)
    groups = forest.array_groups(MAX_SHIPPED_NODES)
    names, sum_cols = _carried(rows), _sum_columns(meta)
    if len(groups) == 1:
        names = [c for c in names if c != "_rid"]
    elif len(groups) > 1:
        rows = _written(rows, "vector_rows")
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(c, T.DoubleType()) for c in sum_cols])
    combine = meta.combine

    def part(arrays: dict) -> DataFrame:
        bc = spark.sparkContext.broadcast(arrays)

        def run(batches):
            for pdf in batches:
                got = walk_arrays(bc.value, matrix(pdf), combine)
                yield pd.DataFrame({**{c: pdf[c] for c in names}, **dict(zip(sum_cols, got.T if combine == "vote" else got))})

        return rows.mapInPandas(run, schema)

    parts = [part(g) for g in groups]
    if len(parts) == 1:
        return parts[0]
    return _aggregate_terms(reduce(DataFrame.unionByName, parts), meta)


def _plain_features(df: DataFrame, names: Sequence[str], features, width: int) -> tuple[DataFrame, list[str]]:
    """The caller's columns and one double column a feature (an array column is unpacked JVM-side)."""
    if isinstance(features, str):
        fcols = [F.get(F.col(features), F.lit(i)).cast("double") for i in range(width)]
    else:
        fcols = [c.cast("double") for c in _feature_cols(features)]
    fnames = [f"_f{i}" for i in range(len(fcols))]
    return df.select(*_keys(names), *[c.alias(n) for c, n in zip(fcols, fnames)]), fnames


def score_vectorised(forest: Forest, df: DataFrame, key: str, features,
                     carry: Sequence[str] = ()) -> DataFrame:
    meta, names = forest.meta, [key, *carry]
    x, fnames = _plain_features(df, names, features, meta.n_features)
    if meta.n_nodes > MAX_SHIPPED_NODES:
        x = x.withColumn("_rid", F.monotonically_increasing_id())
    return finalize(_vector_sums(forest, x, lambda pdf: pdf[fnames].to_numpy(dtype=np.float64, na_value=np.nan)), names, meta)


def score_with_function(df: DataFrame, key: str, features: Sequence[str], predict_fn,
                        out: str = "score", carry: Sequence[str] = ()) -> DataFrame:
    """Pluggable ``predict(batch)``: any function from a float64 matrix
    (rows x features, NaN = missing) to one number per row, applied to each
    Arrow batch with ``mapInPandas``.  The function is shipped with the
    task closure, so it must be picklable and model-sized."""
    names = [key, *carry]
    ship_package(df.sparkSession)
    x, fnames = _plain_features(df, names, list(features), len(features))
    kept = _carried(x)
    schema = T.StructType([*[x.schema[c] for c in kept], T.StructField("_s", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            X = pdf[fnames].to_numpy(dtype=np.float64, na_value=np.nan)
            yield pd.DataFrame({**{c: pdf[c] for c in kept}, "_s": np.asarray(predict_fn(X), dtype=np.float64)})

    return x.mapInPandas(run, schema).select(*[F.col(k).alias(c) for k, c in zip(kept, names)], F.col("_s").alias(out))


# ---------------------------------------------------------------------------
# compiled-expression plan
# ---------------------------------------------------------------------------

def _sql_double(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _tree_sql(a: dict, g: int, xs: list[str], leaf_value) -> str:
    """One tree as nested ``CASE WHEN`` SQL text over feature columns ``xs``."""
    f = int(a["feature"][g])
    if f < 0:
        return leaf_value(g)
    x = xs[f]
    missing = f"({x} IS NULL OR isnan({x}))"
    if "is_in" in a and a["is_in"][g]:
        words = a["set_words"][a["set_start"][g]:][:a["set_size"][g]].tolist()
        listed = lambda cs: f"{x} IN ({', '.join(f'{c}D' for c in cs) or 'NULL'})"
        if a["default_left"][g]:
            # what is no category of the set goes left too, so the ones that go right are listed
            cmp = f"NOT coalesce({listed(sorted(set(range(64 * len(words))) - set(categories_of(words))))}, false)"
        else:
            cmp = f"coalesce({listed(categories_of(words))}, false)"
    else:
        cmp = f"{x} {'<' if a['is_lt'][g] else '<='} {_sql_double(a['threshold'][g])}"
    cond = f"({missing} OR {cmp})" if a["default_left"][g] else f"(NOT {missing} AND {cmp})"
    return (f"CASE WHEN {cond} THEN {_tree_sql(a, int(a['left'][g]), xs, leaf_value)} "
            f"ELSE {_tree_sql(a, int(a['right'][g]), xs, leaf_value)} END")


def forest_expressions(forest: Forest, names: list[str], arrays: dict | None = None) -> list[Column]:
    """What the trees give for a row, built as SQL text over the feature columns
    ``names`` and parsed once: ``_swv`` and ``_sw``, or for a vote ``_leaves``,
    one array of class terms per tree (each tree is compiled once, whatever
    the number of classes)."""
    a = forest.to_arrays() if arrays is None else arrays
    xs = [f"`{n}`" for n in names]
    if forest.meta.combine == "vote":
        def counts(g):
            return "array(" + ", ".join(_sql_double(v) for v in a["class_terms"][g]) + ")"
        return [F.array(*[F.expr(_tree_sql(a, int(r), xs, counts)) for r in a["root"]]).alias("_leaves")]
    terms = [f"({_tree_sql(a, int(r), xs, lambda g: _sql_double(a['term'][g]))})" for r in a["root"]]
    return [F.expr(" + ".join(terms)).alias("_swv"), F.lit(a["weight"]).alias("_sw")]


def score_expression(forest: Forest, df: DataFrame, key: str, features,
                     carry: Sequence[str] = ()) -> DataFrame:
    meta, names = forest.meta, [key, *carry]
    x, fnames = _plain_features(df, names, features, meta.n_features)
    groups = forest.array_groups(MAX_EXPRESSION_NODES)
    if len(groups) > 1:  # code for one group at a time, over one written copy of the rows
        x = _written(x.withColumn("_rid", F.monotonically_increasing_id()), "expression_rows")
    kept = _carried(x)

    def part(arrays: dict) -> DataFrame:
        sums = x.select(*kept, *forest_expressions(forest, fnames, arrays))
        if meta.combine != "vote":
            return sums

        def total(c):
            return F.aggregate("_leaves", F.lit(0.0), lambda s, leaf: s + F.get(leaf, F.lit(c)))
        return sums.select(*kept, *[total(c).alias(f"_c{c}") for c in range(meta.n_classes)])

    parts = [part(g) for g in groups]
    sums = parts[0] if len(parts) == 1 else _aggregate_terms(reduce(DataFrame.unionByName, parts), meta)
    return finalize(sums, names, meta)


# ---------------------------------------------------------------------------
# native MLlib transform
# ---------------------------------------------------------------------------

def score_mllib(model, df: DataFrame, key: str, features: Sequence[str] | str,
                task: str = "classification", carry: Sequence[str] = ()) -> DataFrame:
    """assemble the feature vector and run the model's ``transform``
    (the model is broadcast to the executors by MLlib)."""
    from sylvan.operators.train import assemble
    cols = list(dict.fromkeys([key, *carry, *([features] if isinstance(features, str) else features)]))
    m = model.copy().setFeaturesCol("_features").setPredictionCol("_prediction")
    out = m.transform(assemble(df.select(*[F.col(c) for c in cols]), features, "_features"))
    pred = F.col("_prediction").cast("int") if task == "classification" else F.col("_prediction")
    return out.select(key, *carry, pred.alias("prediction"))


# ---------------------------------------------------------------------------
# plans by name
# ---------------------------------------------------------------------------

STRATEGIES = {
    "relational": score_relational,
    "vectorised": score_vectorised,
    "expression": score_expression,
}


def in_groups(forest: Forest, strategy: str) -> bool:
    """Whether a plan takes the forest in several tree groups."""
    bound = {"relational": MAX_GROUP_NODES, "vectorised": MAX_SHIPPED_NODES, "expression": MAX_EXPRESSION_NODES}[strategy]
    return forest.meta.n_nodes > bound


def score(forest: Forest, df: DataFrame, key: str, features, strategy: str = "vectorised",
          carry: Sequence[str] = ()) -> DataFrame:
    """Score by the named plan; all plans give the same scores."""
    return STRATEGIES[strategy](forest, df, key, features, carry=carry)
