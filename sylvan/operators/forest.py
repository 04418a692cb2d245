"""A decision forest held as an ordinary relation of nodes.

nodes:  tree_id INT, node_id INT, feature INT (null on a leaf), threshold DOUBLE,
        op STRING ('le' | 'lt'), left INT, right INT, default_left BOOLEAN,
        value DOUBLE (leaf), class_counts ARRAY<DOUBLE> (leaf, optional),
        tree_weight DOUBLE
Every tree's root is node 0. A forest with categorical splits (op 'in') has one
more column, left_categories ARRAY<BIGINT>: the bit set of the categories that
go left (null on other nodes).

The metadata says how tree outputs combine into a score:
  sum    score = base + sum(w * value)            (boosted margin, regression)
  mean   score = sum(w * value) / sum(w)          (random-forest regression)
  logit  margin = base + sum(w * value), score = 1 / (1 + exp(-scale * margin))
  vote   per class sum(w * class_counts[c]), prediction = first argmax
Classification cuts: ``score > cut`` for sum / mean, ``margin > 0`` for logit.

A forest is a model: its size is bounded by ``n_nodes``, which every plan
that ships the forest to executors checks first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLUMNS = ["tree_id", "node_id", "feature", "threshold", "op", "left", "right",
                "default_left", "value", "class_counts", "tree_weight"]

NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, op string, "
               "left int, right int, default_left boolean, value double, "
               "class_counts array<double>, tree_weight double")

#: The bit sets of categorical splits; only forests that have such splits have the column.
CATEGORIES = "left_categories"

# Nodes in one set of arrays shipped to the executors, ~100 MB at 48 bytes a
# node (class counts add theirs).  Bigger forests go relationally, or as
# several sets where a function has to hold the whole forest.
MAX_SHIPPED_NODES = 2_000_000


@dataclass(frozen=True)
class ForestMeta:
    n_trees: int
    max_depth: int
    n_nodes: int
    n_features: int
    task: str = "classification"      # classification | regression
    combine: str = "sum"              # sum | mean | logit | vote
    n_classes: int = 2
    base: float = 0.0
    cut: float = 0.0
    margin_scale: float = 1.0


@dataclass
class Forest:
    nodes: DataFrame
    meta: ForestMeta
    #: (largest |weight * leaf|, largest weight), looked up when first asked for.
    bounds: tuple[float, float] | None = None

    def with_meta(self, **kw) -> "Forest":
        return Forest(self.nodes, replace(self.meta, **kw))

    @property
    def has_categories(self) -> bool:
        return CATEGORIES in self.nodes.columns

    def node_columns(self) -> list[str]:
        return NODE_COLUMNS + [CATEGORIES] * self.has_categories

    def units(self) -> tuple[float, float]:
        """The grids that leaf terms and tree weights are rounded to (see ``grid_unit``)."""
        if self.bounds is None:
            w = F.abs("tree_weight")
            term = F.abs("value")
            if self.meta.combine == "vote":
                term = F.array_max(F.transform("class_counts", lambda c: F.abs(c)))
            r = self.nodes.agg(F.max(w * term).alias("t"), F.max(w).alias("w")).first()
            self.bounds = (float(r.t or 0.0), float(r.w or 0.0))
        return tuple(grid_unit(b, self.meta.n_trees) for b in self.bounds)

    def checkpointed(self) -> "Forest":
        """Cut the node relation's lineage (imports join and window it; the
        scoring plans read it once per tree level).  Written to the shared
        checkpoint folder, so it survives executor loss."""
        from sylvan.session import shared_dir
        shared_dir(self.nodes.sparkSession)
        return Forest(self.nodes.coalesce(1).checkpoint(eager=True), self.meta, self.bounds)

    def used_features(self) -> DataFrame:
        """the feature indexes any split reads (a tiny relation)."""
        return self.nodes.where(F.col("feature").isNotNull()).select("feature").distinct()

    def tree_sizes(self) -> list[tuple[int, int]]:
        """(tree_id, nodes) of every tree, in order: one row a tree."""
        return sorted((int(r[0]), int(r[1])) for r in self.nodes.groupBy("tree_id").count().collect())

    def array_groups(self, max_nodes: int = MAX_SHIPPED_NODES) -> list[dict]:
        """The forest as sets of arrays of at most ``max_nodes`` nodes (or one tree) each."""
        if self.meta.n_nodes <= max_nodes:
            return [self.to_arrays()]
        units, out = self.units(), []
        for a, b in size_groups(self.tree_sizes(), max_nodes):
            rows = _sorted_rows(self.nodes.where(F.col("tree_id").between(a, b - 1)))
            out.append(arrays_from_pandas(rows, self.meta, units))
        return out

    def to_arrays(self, max_nodes: int = MAX_SHIPPED_NODES) -> dict:
        """Collect the (bounded) node relation into flat NumPy arrays.

        Global node index = row in the arrays; ``root[t]`` is the index of
        tree t's root; children are global indexes; ``feature`` is -1 on
        leaves.
        """
        if self.meta.n_nodes > max_nodes:
            raise ValueError(f"forest has {self.meta.n_nodes} nodes, above the "
                             f"shipping bound {max_nodes}")
        return arrays_from_pandas(_sorted_rows(self.nodes), self.meta, self.units())


def grid_unit(largest: float, n_terms: int) -> float:
    """A power of two so coarse that sums of ``n_terms`` multiples of it, none
    above ``largest``, are exact in a double.

    Leaf terms rounded to it add up to the same bits in any order, so every
    plan, task order and tree group gives the same score.  The rounding moves a
    term by at most ``largest * n_terms / 2**51``.
    """
    if not (0.0 < largest < math.inf):
        return 0.0
    return max(2.0 ** (math.ceil(math.log2(largest) + math.log2(max(n_terms, 1))) - 51), 2.0 ** -1000)


def on_grid(x, unit: float):
    """A column or an array rounded to multiples of ``unit``."""
    if unit == 0.0:
        return x
    return F.rint(x / F.lit(unit)) * F.lit(unit) if isinstance(x, Column) else np.rint(x / unit) * unit


def size_groups(sizes: list[tuple[int, int]], max_nodes: int) -> list[tuple[int, int]]:
    """Tree-id ranges [a, b) of at most ``max_nodes`` nodes, or a single tree."""
    out, start, held = [], None, 0
    for tree, n in sizes:
        if start is not None and held + n > max_nodes:
            out.append((start, tree))
            start, held = None, 0
        start = tree if start is None else start
        held += n
    return out + [(start, sizes[-1][0] + 1)] if sizes else []


def _sorted_rows(nodes: DataFrame):
    # the relation is model-sized and bounded by the caller: sort it where it lands
    return (nodes.select(*NODE_COLUMNS, *[CATEGORIES] * (CATEGORIES in nodes.columns)).toPandas()
            .sort_values(["tree_id", "node_id"], kind="stable").reset_index(drop=True))


def arrays_from_pandas(rows, meta: ForestMeta, units: tuple[float, float]) -> dict:
    """Flat NumPy arrays from node rows sorted by (tree_id, node_id).

    ``term`` (or ``class_terms``) is the leaf times its tree's weight on the
    grid of ``units``; ``weight`` is the sum of the weights on theirs.
    """
    n = len(rows)
    tree = rows["tree_id"].to_numpy(np.int64)
    node = rows["node_id"].to_numpy(np.int64)
    trees = np.unique(tree)
    keys = tree * (1 << 32) + node            # sorted, since rows are ordered
    if n and not np.all(keys[1:] > keys[:-1]):
        raise ValueError("node relation has duplicate (tree_id, node_id) pairs")

    def glob(col):
        child = rows[col].astype("float64").to_numpy()
        have = ~np.isnan(child)
        out = np.full(n, -1, np.int64)
        want = tree[have] * (1 << 32) + child[have].astype(np.int64)
        pos = np.searchsorted(keys, want)
        if np.any(pos >= n) or np.any(keys[np.minimum(pos, n - 1)] != want):
            raise ValueError(f"{col} points to a node that does not exist")
        out[have] = pos
        return out

    root_pos = np.searchsorted(keys, trees * (1 << 32))
    if np.any(node[root_pos] != 0):
        raise ValueError("every tree needs a root node 0")
    feature = rows["feature"].astype("float64").fillna(-1).to_numpy().astype(np.int64)
    left = glob("left")
    right = glob("right")
    # leaves point to themselves so a finished walk stays put
    leaf = feature < 0
    left[leaf] = np.arange(n)[leaf]
    right[leaf] = np.arange(n)[leaf]
    root = root_pos.astype(np.int64)
    weights = rows["tree_weight"].astype("float64").fillna(0.0).to_numpy()
    value = rows["value"].astype("float64").fillna(0.0).to_numpy()
    out = {
        "feature": feature,
        "threshold": rows["threshold"].astype("float64").fillna(0.0).to_numpy(),
        "is_lt": (rows["op"] == "lt").to_numpy(),
        "default_left": rows["default_left"].fillna(True).astype(bool).to_numpy(),
        "left": left,
        "right": right,
        "term": on_grid(value * weights, units[0]),
        "root": root,
        "weight": float(on_grid(weights[root], units[1]).sum()),
        "max_depth": int(meta.max_depth),
    }
    if CATEGORIES in rows:
        sets = [() if w is None else w for w in rows[CATEGORIES]]
        size = np.fromiter(map(len, sets), dtype=np.int64, count=n)
        out["is_in"], out["set_size"], out["set_start"] = (rows["op"] == "in").to_numpy() & ~leaf, size, np.cumsum(size) - size
        out["set_words"] = np.asarray([w for ws in sets for w in ws] or [0], dtype=np.int64)
    if meta.combine == "vote":
        k = meta.n_classes
        cc = np.zeros((n, k))
        for g, v in enumerate(rows["class_counts"].to_numpy()):
            if v is not None and len(v):
                if len(v) > k:
                    raise ValueError(f"{len(v)} class counts in a forest of {k} classes")
                cc[g, :len(v)] = np.asarray(v, dtype=np.float64)
        out["class_terms"] = on_grid(cc * weights[:, None], units[0])
    return out


# ---------------------------------------------------------------------------
# The grid forest: a complete forest defined by a formula, so Spark and SQL
# can build the very same trees without a trainer.
# ---------------------------------------------------------------------------

# Fixed values of the formula (shared with the SQL oracle text):
#   node i of tree t, heap layout: left = 2i+1, right = 2i+2
#   feature      = (7t + 3i) % k
#   threshold    = lo[f] + ((5t + 11i) % 16) * (hi[f] - lo[f]) / 16
#   default_left = (i % 2 = 0)
#   leaf value   = ((13t + 7i) % 64 - 32) / 64
#   class count c of a leaf = (3t + 5i + c) % 8
GRID_STEPS = 16


def grid_forest(spark: SparkSession, n_trees: int, depth: int,
                ranges: list[tuple[float, float]], n_classes: int = 0,
                combine: str | None = None, task: str = "classification",
                cut: float = 0.0, base: float = 0.0, margin_scale: float = 1.0,
                op: str = "le") -> Forest:
    """Complete trees of ``depth`` split levels with thresholds on a grid.

    ``ranges[f] = (lo, hi)``; with integer bounds every threshold is an exact
    binary fraction.  ``n_classes > 0`` adds class counts (multi-class vote).
    """
    k = len(ranges)
    n_per_tree = 2 ** (depth + 1) - 1
    n_internal = 2 ** depth - 1
    lo = F.array(*[F.lit(float(a)) for a, _ in ranges])
    span = F.array(*[F.lit(float(b) - float(a)) for a, b in ranges])
    t = (F.col("id") / n_per_tree).cast("int")
    i = (F.col("id") % n_per_tree).cast("int")
    base_df = spark.range(0, n_trees * n_per_tree, 1, 1).select(t.alias("tree_id"), i.alias("node_id"))
    internal = F.col("node_id") < n_internal
    feat = ((F.lit(7) * F.col("tree_id") + F.lit(3) * F.col("node_id")) % k).cast("int")
    step = ((F.lit(5) * F.col("tree_id") + F.lit(11) * F.col("node_id")) % GRID_STEPS).cast("double")
    cols = [
        F.col("tree_id"), F.col("node_id"),
        F.when(internal, feat).alias("feature"),
        F.when(internal, F.get(lo, feat) + step * F.get(span, feat) / F.lit(float(GRID_STEPS)))
        .alias("threshold"),
        F.lit(op).alias("op"),
        F.when(internal, F.col("node_id") * 2 + 1).cast("int").alias("left"),
        F.when(internal, F.col("node_id") * 2 + 2).cast("int").alias("right"),
        (F.col("node_id") % 2 == 0).alias("default_left"),
        F.when(~internal, ((F.lit(13) * F.col("tree_id") + F.lit(7) * F.col("node_id")) % 64 - 32)
               .cast("double") / F.lit(64.0)).alias("value"),
    ]
    if n_classes:
        cc = F.array(*[((F.lit(3) * F.col("tree_id") + F.lit(5) * F.col("node_id") + F.lit(c)) % 8)
                       .cast("double") for c in range(n_classes)])
        cols.append(F.when(~internal, cc).alias("class_counts"))
    else:
        cols.append(F.lit(None).cast("array<double>").alias("class_counts"))
    cols.append(F.lit(1.0).alias("tree_weight"))
    nodes = base_df.select(*cols)
    meta = ForestMeta(n_trees=n_trees, max_depth=depth, n_nodes=n_trees * n_per_tree,
                      n_features=k, task=task,
                      combine=combine or ("vote" if n_classes else "sum"),
                      n_classes=n_classes or 2, base=base, cut=cut, margin_scale=margin_scale)
    return Forest(nodes, meta, (7.0 if meta.combine == "vote" else 0.5, 1.0))


def fit_grid_ranges(df: DataFrame, features: list) -> list[tuple[float, float]]:
    """Integer ranges ``[floor(min), ceil(max)]`` per feature, from the data.

    One aggregate job; 2k numbers come back to the driver.
    """
    aggs = []
    for j, c in enumerate(features):
        x = F.col(c) if isinstance(c, str) else c
        aggs += [F.floor(F.min(x)).cast("double").alias(f"lo{j}"),
                 F.ceil(F.max(x)).cast("double").alias(f"hi{j}")]
    r = df.agg(*aggs).first()
    out = []
    for j in range(len(features)):
        lo = r[f"lo{j}"] if r[f"lo{j}"] is not None else 0.0
        hi = r[f"hi{j}"] if r[f"hi{j}"] is not None else lo + 1.0
        out.append((float(lo), float(hi if hi > lo else lo + 1.0)))
    return out


# ---------------------------------------------------------------------------
# Per-tree statistics
# ---------------------------------------------------------------------------

def node_depths(nodes: DataFrame, max_levels: int) -> DataFrame:
    """(tree_id, node_id, depth) by walking down from the roots.

    ``max_levels`` bounds the depth (the forest's ``max_depth`` + 1); each
    level is one small join on the model-sized node relation, no data rows.
    """
    level = nodes.where(F.col("node_id") == 0).select("tree_id", "node_id", F.lit(0).alias("depth"))
    parts = [level]
    edges = nodes.where(F.col("feature").isNotNull()).select("tree_id", "node_id", "left", "right")
    for d in range(1, max_levels):
        level = (level.join(edges, ["tree_id", "node_id"])
                 .select("tree_id", F.explode(F.array("left", "right")).alias("node_id"))
                 .select("tree_id", "node_id", F.lit(d).alias("depth")))
        parts.append(level)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forest_stats(forest: Forest) -> DataFrame:
    """tree_id, nodes, leaves, depth (edges on the longest root-leaf path)."""
    depths = node_depths(forest.nodes, forest.meta.max_depth + 1)
    per_tree = forest.nodes.groupBy("tree_id").agg(
        F.count(F.lit(1)).cast("long").alias("nodes"),
        F.count_if(F.col("feature").isNull()).cast("long").alias("leaves"))
    d = depths.groupBy("tree_id").agg(F.max("depth").cast("int").alias("depth"))
    return per_tree.join(d, "tree_id").select(
        F.col("tree_id").cast("int").alias("tree_id"), "nodes", "leaves", "depth")
