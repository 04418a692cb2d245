"""Boosted trees by second-order histograms (M3, M4): dense or sparse rows, L2, a leaf limit, learned missing branches.

Features are binned once: a bin is the place of a value among its feature's cut
points (approximate quantiles, or given ones). The binned rows are written as
bytes with label, weight and margin, the only copy of the data that training
reads. A tree grows a level at a time, one pass over the rows a level:

1. a task walks its rows down the tree so far and adds up gradient, hessian and
   rows per (node, feature, bin); one aggregate over these cells follows, so
   what is shuffled does not depend on the number of rows;
2. only the smaller child of a split is added up; its sibling is the parent less
   that child;
3. running sums over the bins of each (node, feature) give both sides of every
   cut; what a node has beyond its present values is missing, and each cut is
   tried with the missing on either side. One row per node, its best cut,
   reaches the driver.

Growth is best gain first up to ``max_leaves``: a node is split if its weakest
ancestor-or-self gain is among the ``max_leaves - 1`` greatest, and only nodes
that still can be are looked into, at most so many a level.

In sparse rows an entry that is not there (with ``zero_as_missing`` also a zero)
is missing; memory and shuffles follow the entries there are.

Gradients and hessians are rounded to a power-of-two grid on which sums of all
rows are exact, so the trees do not depend on the order of rows or tasks. Ties
go to the lower feature, then the lower cut, then missing to the right.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.operators.forest import NODE_SCHEMA, Forest, ForestMeta, on_grid
from sylvan.operators.score import SparseRows
from sylvan.session import scratch_path, shared_dir, ship_package

#: Bins of a feature at most: a bin is one byte, 255 stands for a missing value.
MAX_BINS = 255
_MISSING = 255
#: Cells a task adds up in dense arrays; beyond, only the cells there are are kept.
DENSE_CELLS = 1 << 22
#: Trees whose leaves are added to the margins in passing before the rows are written anew.
TREES_A_COPY = 16
#: Threshold of a split that parts present from missing values.
_ALL_PRESENT = 1.7976931348623157e308


@dataclass(frozen=True)
class BoostParams:
    """Defaults: the usual settings of the boosted-tree libraries."""

    n_trees: int = 10
    max_depth: int = 8
    max_leaves: int = 256
    step: float = 0.1
    l2: float = 1.0
    min_gain: float = 0.0
    #: Least sum of hessians on either side of a split.
    min_hessian: float = 1e-3
    max_bins: int = MAX_BINS
    objective: str = "logistic"      # logistic | squared
    #: Weight of rows with a label other than 0 (objective logistic).
    positive_weight: float = 1.0
    #: Margin before the first tree; None: the best constant.
    base: float | None = None


@dataclass
class Boosted:
    forest: Forest
    #: tree_id, node_id, path ('', 'L', 'LR', ...), feature, threshold, default_left, gain, grad, hess, n
    report: DataFrame


# --- binning -------------------------------------------------------------------

def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    shared_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _present(x):
    return x.isNotNull() & ~F.isnan(x)


def _probabilities(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> list[list[float]]:
    """Cut points per feature: distinct approximate quantiles of its present values (one aggregate)."""
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs.append(F.percentile_approx(F.when(_present(x), x), _probabilities(bins), max(10_000, 20 * bins)).alias(f"q{i}"))
    row = df.agg(*aggs).first()
    return [sorted(set(row[i] or [])) for i in range(len(features))]


def _dense_rows(df: DataFrame, features: Sequence[str], label: str, cuts: list[list[float]]) -> DataFrame:
    """y, f (null), b (a byte a feature)."""
    ship_package(df.sparkSession)
    edges = [np.asarray(c, dtype=np.float64) for c in cuts]
    names = [f"x{i}" for i in range(len(features))]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=np.float64, na_value=np.nan)
            b = np.full(x.shape, _MISSING, dtype=np.uint8)
            for i, e in enumerate(edges):
                # values up to and including a cut point lie left of it
                b[:, i] = np.where(np.isnan(x[:, i]), _MISSING, np.searchsorted(e, x[:, i], side="left"))
            yield pd.DataFrame({"y": pdf["y"], "f": None, "b": [r.tobytes() for r in b]})

    x = df.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])
    return x.mapInPandas(code, "y double, f binary, b binary")


def sparse_cuts(entries: DataFrame, bins: int = MAX_BINS) -> DataFrame:
    """Written: feature, cuts. One row a feature, never collected: features may be many."""
    q = F.percentile_approx("value", _probabilities(bins), max(10_000, 20 * bins))
    return _written(entries.groupBy("feature").agg(F.array_sort(F.array_distinct(q)).alias("cuts")), "boost-cuts")


def _sparse_rows(entries: DataFrame, labels: DataFrame, cuts: DataFrame) -> DataFrame:
    """y, f (int32 features in order), b (their bins): one row per label row, entries or not."""
    ship_package(entries.sparkSession)
    bin_ = F.size(F.filter("cuts", lambda c: c < F.col("value")))
    coded = entries.join(cuts, "feature").select("row", "feature", bin_.cast("int").alias("bin"))
    lists = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("feature", "bin"))).alias("e"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"],
                                "f": [b"" if f is None else np.asarray(f, dtype="<i4").tobytes() for f in pdf["fs"]],
                                "b": [b"" if b is None else np.asarray(b, dtype=np.uint8).tobytes() for b in pdf["bs"]]})

    # a null key is a row of its own kind: it meets the entries with a null key
    joined = labels.join(lists, labels["row"].eqNullSafe(lists["row"]), "left")
    return joined.select("y", F.col("e.feature").alias("fs"), F.col("e.bin").alias("bs")).mapInPandas(pack, "y double, f binary, b binary")


# --- rows inside a task ----------------------------------------------------------

class BinnedRows:
    """The binned rows of an Arrow batch, dense or sparse: bins by (row, feature) and all entries."""

    def __init__(self, f: pd.Series, b: pd.Series):
        self.n = len(b)
        flat = np.frombuffer(b"".join(b), dtype=np.uint8).astype(np.int64)
        if len(f) and f.iloc[0] is None:
            m = flat.reshape(self.n, -1)
            self.m = np.where(m == _MISSING, -1, m)
            at = np.nonzero(self.m >= 0)
            self.row, self.feature, self.bin = at[0], at[1], self.m[at]
        else:
            sizes = [len(x) for x in b]
            self.m = None
            self.feature = np.frombuffer(b"".join(f), dtype="<i4").astype(np.int64)
            self.row, self.bin = np.repeat(np.arange(self.n), sizes), flat
            width = int(self.feature.max(initial=0)) + 1
            self.look = SparseRows([np.frombuffer(x, dtype="<i4") for x in f], [np.frombuffer(x, dtype=np.uint8) for x in b], width, -1)

    def bins(self, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        if self.m is not None:
            return self.m[rows, features]
        known = features < self.look.shape[1]
        out = np.full(len(rows), -1, dtype=np.int64)
        out[known] = self.look[rows[known], features[known]].astype(np.int64)
        return out


class Tree:
    """A tree over bins; node 0 is the root, ``feature`` -1 marks a leaf."""

    def __init__(self):
        self.feature, self.bin, self.default_left = [-1], [0], [False]
        self.left, self.right, self.path = [-1], [-1], [""]
        self.value = [0.0]

    def split(self, node: int, feature: int, cut: int, default_left: bool) -> tuple[int, int]:
        kids = (len(self.feature), len(self.feature) + 1)
        for k, side in zip(kids, "LR"):
            self.feature.append(-1), self.bin.append(0), self.default_left.append(False)
            self.left.append(-1), self.right.append(-1), self.value.append(0.0), self.path.append(self.path[node] + side)
        self.feature[node], self.bin[node], self.default_left[node] = feature, cut, default_left
        self.left[node], self.right[node] = kids
        return kids

    def arrays(self) -> dict:
        return {k: np.asarray(getattr(self, k)) for k in ("feature", "bin", "default_left", "left", "right", "value")}


def walk(a: dict, rows: BinnedRows) -> np.ndarray:
    """The node at which every row is."""
    node = np.zeros(rows.n, dtype=np.int64)
    live = np.arange(rows.n)
    while True:
        live = live[a["feature"][node[live]] >= 0]
        if not len(live):
            return node
        at = node[live]
        b = rows.bins(live, a["feature"][at])
        left = np.where(b < 0, a["default_left"][at], b <= a["bin"][at])
        node[live] = np.where(left, a["left"][at], a["right"][at])


def gradients(y, margin, p: BoostParams) -> tuple[np.ndarray, np.ndarray]:
    if p.objective == "squared":
        return margin - y, np.ones_like(margin)
    share = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y != 0, p.positive_weight, 1.0)
    return w * (share - (y != 0)), w * share * (1.0 - share)


class _Cells:
    """Sums per cell: dense arrays while there are few cells, the cells there are otherwise."""

    def __init__(self, cells: int):
        self.cells, self.parts, self.held = cells, [], 0
        self.sums = np.zeros((3, cells)) if cells <= DENSE_CELLS else None

    def add(self, code: np.ndarray, weights: tuple) -> None:
        if self.sums is not None:
            for k, w in enumerate(weights):
                self.sums[k] += np.bincount(code, weights=w, minlength=self.cells)
        else:
            self.parts.append(_summed(code, weights))
            self.held += len(self.parts[-1][0])
            if self.held > DENSE_CELLS:
                self.parts = [self.merged()]
                self.held = len(self.parts[0][0])

    def merged(self):
        if self.sums is not None:
            at = np.flatnonzero(self.sums[2])
            return at, self.sums[:, at]
        if not self.parts:
            return np.empty(0, dtype=np.int64), np.empty((3, 0))
        return _summed(np.concatenate([c for c, _ in self.parts]), np.concatenate([s for _, s in self.parts], axis=1))


def _summed(code: np.ndarray, weights) -> tuple[np.ndarray, np.ndarray]:
    at, inverse = np.unique(code, return_inverse=True)
    return at, np.stack([np.bincount(inverse, weights=w, minlength=len(at)) for w in weights])


# --- one level ---------------------------------------------------------------------

_CELLS = "node int, feature int, bin int, g double, h double, n double"


def _histograms(rows: DataFrame, trees: list[dict], tree: dict, nodes: list[int], width: int, p: BoostParams, units) -> DataFrame:
    """Sums of ``nodes`` per (node, feature, bin); feature -1 holds a node's totals."""
    slot = np.full(len(tree["feature"]), -1, dtype=np.int64)
    slot[nodes] = np.arange(len(nodes))
    names = np.asarray(nodes)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, totals = _Cells(len(names) * width * MAX_BINS), np.zeros((3, len(names)))
        for pdf in batches:
            if not len(pdf):
                continue
            r = BinnedRows(pdf["f"], pdf["b"])
            margin = pdf["margin"].to_numpy(dtype=np.float64).copy()
            for t in trees:
                margin += t["value"][walk(t, r)]
            g, h = (on_grid(x, u) for x, u in zip(gradients(pdf["y"].to_numpy(dtype=np.float64), margin, p), units))
            at = slot[walk(tree, r)]
            here = at >= 0
            one = np.ones(r.n)
            for k, x in enumerate((g, h, one)):
                totals[k] += np.bincount(at[here], weights=x[here], minlength=len(names))
            e = here[r.row]
            row = r.row[e]
            cells.add((at[row] * width + r.feature[e]) * MAX_BINS + r.bin[e], (g[row], h[row], one[row]))
        code, sums = cells.merged()
        for lo in range(0, len(code), 100_000):
            c = code[lo:lo + 100_000]
            s = sums[:, lo:lo + 100_000]
            yield pd.DataFrame({"node": names[c // (width * MAX_BINS)], "feature": c // MAX_BINS % width, "bin": c % MAX_BINS,
                                "g": s[0], "h": s[1], "n": s[2]})
        yield pd.DataFrame({"node": names, "feature": -1, "bin": 0, "g": totals[0], "h": totals[1], "n": totals[2]})

    parts = rows.mapInPandas(add, _CELLS)
    return parts.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def _siblings(parents: DataFrame, small: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """The larger children's cells: the parent's less the smaller child's. pairs: (parent, small, large)."""
    spark = parents.sparkSession
    kin = F.broadcast(spark.createDataFrame(pairs, "parent int, small int, large int"))  # a row a split
    mine = small.select(F.col("node").alias("small"), "feature", "bin", *[F.col(c).alias(f"s{c}") for c in "ghn"])
    cells = parents.join(kin, parents["node"] == kin["parent"]).drop("node")
    out = cells.join(mine, ["small", "feature", "bin"], "left")
    left = [(F.col(c) - F.coalesce(f"s{c}", F.lit(0.0))).alias(c) for c in "ghn"]
    return out.select(F.col("large").alias("node"), "feature", "bin", *left).where("n > 0 or feature = -1")


def best_splits(cells: DataFrame, p: BoostParams) -> DataFrame:
    """The best cut of every node: node, gain, feature, bin, default_left, left sums (lg, lh, ln) and the node's (g, h, n)."""
    totals = cells.where("feature = -1").select("node", F.col("g").alias("tg"), F.col("h").alias("th"), F.col("n").alias("tn"))
    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("node", "feature")
    run = cells.where("feature >= 0").select("node", "feature", "bin", *[F.sum(c).over(upto).alias(c) for c in "ghn"],
                                             *[F.sum(c).over(whole).alias(f"p{c}") for c in "ghn"])
    run = run.join(F.broadcast(totals), "node")  # a row a node of one level
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("default_left"),
                                         *[(F.col(c) + (F.col(f"t{c}") - F.col(f"p{c}")) if d else F.col(c)).alias(f"l{c}") for c in "ghn"])
                                for d in (False, True)])).alias("s")
    cut = run.select("node", "feature", "bin", "tg", "th", "tn", sides).select("node", "feature", "bin", "tg", "th", "tn", "s.*")
    l2 = F.lit(p.l2)

    def score(g, h):
        return F.when(h + l2 > 0, g * g / (h + l2)).otherwise(F.lit(0.0))

    rg, rh, rn = (F.col(f"t{c}") - F.col(f"l{c}") for c in "ghn")
    gain = F.lit(0.5) * (score(F.col("lg"), F.col("lh")) + score(rg, rh) - score(F.col("tg"), F.col("th")))
    ok = cut.withColumn("gain", gain).where((F.col("ln") > 0) & (rn > 0) & (F.col("lh") >= p.min_hessian) & (rh >= p.min_hessian)
                                            & (F.col("gain") > p.min_gain))
    order = F.struct("gain", (-F.col("feature")).alias("a"), (-F.col("bin")).alias("b"), (~F.col("default_left")).alias("c"))
    return ok.groupBy("node").agg(F.max_by(F.struct("gain", "feature", "bin", "default_left", "lg", "lh", "ln", "tg", "th", "tn"), order).alias("s")).select("node", "s.*")


# --- a tree --------------------------------------------------------------------------

class _Growth:
    """The driver's side of one tree: what is known of its nodes, and which may still be split."""

    def __init__(self, p: BoostParams):
        self.p, self.tree = p, Tree()
        self.stats: dict[int, tuple] = {}   # node -> (g, h, n)
        self.best: dict[int, object] = {}   # node -> its best split
        self.rank: dict[int, float] = {}    # node -> weakest gain from the root down to it
        self.kids: dict[int, tuple[int, int]] = {}

    def learn(self, node: int, best, above: float) -> None:
        if best is not None:
            self.best[node] = best
            self.rank[node] = min(above, best.gain)

    def among_first(self) -> list[int]:
        """The nodes that best-gain-first growth splits, as far as is known."""
        return sorted(self.rank, key=lambda v: (-self.rank[v], v))[:self.p.max_leaves - 1]

    def open_up(self, level: list[int]) -> list[int]:
        """Split those nodes of a level that still are among the first; returns them."""
        first = set(self.among_first())
        out = []
        for v in level:
            if v in first:
                b = self.best[v]
                left, right = self.kids[v] = self.tree.split(v, b.feature, b.bin, b.default_left)
                self.stats[left] = (b.lg, b.lh, b.ln)
                self.stats[right] = (b.tg - b.lg, b.th - b.lh, b.tn - b.ln)
                out.append(v)
        return out

    def finished(self) -> Tree:
        """The tree with the splits that stayed among the first; values at the leaves."""
        first, out, p = set(self.among_first()), Tree(), self.p
        self.at = {0: 0}  # node of the finished tree -> node while growing
        todo = [(0, 0)]
        while todo:
            v, new = todo.pop()
            if v in first and v in self.kids:
                b = self.best[v]
                for kid, k in zip(self.kids[v], out.split(new, b.feature, b.bin, b.default_left)):
                    self.at[k] = kid
                    todo.append((kid, k))
            else:
                g, h, _ = self.stats[v]
                out.value[new] = -p.step * g / (h + p.l2) if h + p.l2 > 0 else 0.0
        return out


def grow_tree(rows: DataFrame, trees: list[dict], width: int, p: BoostParams, units) -> tuple[Tree, _Growth]:
    """One tree on the gradients after ``trees`` (those not yet in the rows' margins)."""
    s = _Growth(p)
    parents, pairs, level = None, [], [0]
    while level:
        a = s.tree.arrays()
        small = [0] if parents is None else [x for _, x, _ in pairs]
        cells = _histograms(rows, trees, a, small, width, p, units)
        if parents is not None:
            cells = _written(cells, "boost-small")
            cells = cells.unionByName(_siblings(parents, cells, pairs))
        cells = _written(cells, "boost-cells")
        if parents is None:
            root = cells.where("feature = -1").first()
            if root is None or not root.n:
                raise ValueError("no rows to learn from")
            s.stats[0] = (root.g, root.h, root.n)
        found = {r.node: r for r in best_splits(cells, p).collect()}  # one row a node of the level
        above = {k: s.rank[v] for v, kids in s.kids.items() for k in kids}
        for v in level:
            s.learn(v, found.get(v), above.get(v, math.inf))
        if len(s.tree.path[level[0]]) >= p.max_depth:
            break
        split = s.open_up(level)
        if len(s.tree.path[level[0]]) + 1 >= p.max_depth:
            break  # their children are leaves by depth
        pairs = []
        for v in split:
            x, y = s.kids[v]
            pairs.append((v, x, y) if s.stats[x][2] <= s.stats[y][2] else (v, y, x))
        level = [k for v in split for k in s.kids[v]]
        parents = cells
    return s.finished(), s


# --- the model -------------------------------------------------------------------------

def _grid(rows: DataFrame, p: BoostParams) -> tuple[int, tuple[float, float], float]:
    """(rows, units of gradients and hessians, base margin), by one aggregate over the labels."""
    y = F.col("y")
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.max(F.abs(y)).alias("top"), F.count_if(y.isNull() | F.isnan(y)).alias("bad"),
                 F.count_if(y != 0).alias("pos")).first()
    if not r.n:
        raise ValueError("the training table is empty (train fraction 0?)")
    if r.bad:
        raise ValueError(f"{r.bad} rows have no label")
    if p.objective == "squared":
        base, largest, curve = r.mean, 4.0 * (r.top or 1.0), 1.0
    else:
        w = p.positive_weight
        share = min(max(r.pos * w / (r.pos * w + r.n - r.pos), 1e-6), 1 - 1e-6)
        base, largest, curve = math.log(share / (1 - share)), max(w, 1.0), max(w, 1.0) / 4
    bits = math.ceil(math.log2(max(r.n, 2)))
    # sums of n terms below 2**k are exact if the terms are multiples of 2**(k + bits - 52)
    units = tuple(2.0 ** (math.ceil(math.log2(x)) + bits - 52) for x in (largest, curve))
    return int(r.n), units, float(base if p.base is None else p.base)


def _boost(rows: DataFrame, width: int, p: BoostParams, threshold_of) -> Boosted:
    spark = rows.sparkSession
    ship_package(spark)
    if p.objective not in ("logistic", "squared"):
        raise ValueError(f"unknown objective {p.objective!r}")
    rows = _written(rows, "boost-binned")
    _, units, base = _grid(rows, p)
    rows = rows.withColumn("margin", F.lit(base))
    grown, waiting = [], []
    for _ in range(p.n_trees):
        tree, s = grow_tree(rows, waiting, width, p, units)
        grown.append((tree, s))
        waiting.append(tree.arrays())
        if len(waiting) == TREES_A_COPY and len(grown) < p.n_trees:
            rows, waiting = _written(_moved(rows, waiting), "boost-rows"), []
    return _as_forest(spark, grown, width, p, base, threshold_of)


def _moved(rows: DataFrame, trees: list[dict]) -> DataFrame:
    def add(batches):
        for pdf in batches:
            r = BinnedRows(pdf["f"], pdf["b"])
            margin = pdf["margin"].to_numpy(dtype=np.float64).copy()
            for t in trees:
                margin += t["value"][walk(t, r)]
            yield pdf.assign(margin=margin)

    return rows.mapInPandas(add, rows.schema)


def _as_forest(spark: SparkSession, grown, width: int, p: BoostParams, base: float, threshold_of) -> Boosted:
    used = sorted({(f, b) for t, _ in grown for f, b in zip(t.feature, t.bin) if f >= 0})
    threshold = threshold_of(used)
    nodes, report = [], []
    for i, (t, s) in enumerate(grown):
        for v, f in enumerate(t.feature):
            inner = f >= 0
            cut = threshold[f, t.bin[v]] if inner else None
            nodes.append((i, v, f if inner else None, cut, "le", t.left[v] if inner else None, t.right[v] if inner else None,
                          bool(t.default_left[v]), None if inner else t.value[v], None, 1.0))
            g, h, n = s.stats[s.at[v]]
            report.append((i, v, t.path[v], f if inner else None, cut, bool(t.default_left[v]) if inner else None,
                           float(s.best[s.at[v]].gain) if inner else None, g, h, int(n)))
    logistic = p.objective == "logistic"
    meta = ForestMeta(n_trees=len(grown), max_depth=max([len(x) for t, _ in grown for x in t.path] + [1]), n_nodes=len(nodes), n_features=width,
                      task="classification" if logistic else "regression", combine="logit" if logistic else "sum", base=base)
    schema = "tree_id int, node_id int, path string, feature int, threshold double, default_left boolean, gain double, grad double, hess double, n long"
    return Boosted(Forest(spark.createDataFrame(nodes, NODE_SCHEMA), meta), spark.createDataFrame(report, schema))


def boost(df: DataFrame, features: Sequence[str], label: str, params: BoostParams = BoostParams(),
          cuts: list[list[float]] | None = None) -> Boosted:
    """M3: boosted trees on feature columns; null and NaN are missing.

    ``cuts``: cut points per feature instead of quantiles, at most ``MAX_BINS - 1`` each, ascending.
    """
    features = list(features)
    cuts = quantile_cuts(df, features, params.max_bins) if cuts is None else cuts
    if max(map(len, cuts), default=0) >= MAX_BINS:
        raise ValueError(f"more than {MAX_BINS - 1} cut points")
    cut = lambda f, b: cuts[f][b] if b < len(cuts[f]) else _ALL_PRESENT
    return _boost(_dense_rows(df, features, label, cuts), len(features), params, lambda used: {(f, b): cut(f, b) for f, b in used})


def boost_sparse(entries: DataFrame, labels: DataFrame, key: str, label: str, feature_col: str = "feature", value_col: str = "value",
                 params: BoostParams = BoostParams(), zero_as_missing: bool = True, cuts: DataFrame | None = None) -> Boosted:
    """M4: boosted trees on (key, feature, value) entries and one (key, label) row per example.

    What has no entry is missing, and so are nulls, NaN and, with
    ``zero_as_missing``, zeros. Keys must be unique among the labels; entries
    must not repeat a feature of a key. ``cuts``: (feature, ascending cut points)
    of every feature instead of quantiles; entries of other features are not read.
    """
    v = F.col(value_col).cast("double")
    kept = entries.where(_present(v)).select(F.col(key).alias("row"), F.col(feature_col).cast("int").alias("feature"), v.alias("value"))
    if zero_as_missing:
        kept = kept.where("value != 0")
    rows = labels.select(F.col(key).alias("row"), F.col(label).cast("double").alias("y"))
    cuts = sparse_cuts(kept, params.max_bins) if cuts is None else _written(cuts.select("feature", "cuts"), "boost-cuts")
    width = int((cuts.agg(F.max("feature")).first()[0] or 0) + 1)

    def thresholds(used):
        if not used:
            return {}
        spark = entries.sparkSession
        want = F.broadcast(spark.createDataFrame(used, "feature int, bin int"))  # the model's own splits
        got = cuts.join(want, "feature").select("feature", "bin", F.coalesce(F.get("cuts", F.col("bin")), F.lit(_ALL_PRESENT)).alias("t")).collect()
        return {(r.feature, r.bin): r.t for r in got}

    return _boost(_sparse_rows(kept, rows, cuts), width, params, thresholds)
