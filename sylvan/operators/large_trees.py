"""One tree of more nodes than may be broadcast.

The tree is cut into bands of levels so thin that no subtree within a band has
more nodes than the bound, whatever the tree's shape. The first band is one
subtree: it is broadcast and all rows walk it in place. Behind it each row
stands at the root of some subtree of the next band; rows are grouped by that
subtree together with its nodes, walk it there, and go on to the next band.
A subtree that many rows reach (a third of the table at one node) is dealt to
several groups, its nodes copied to each, so a group holds at most
``GROUP_ROWS`` rows and one subtree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions.splits import goes_left_np, in_set_np
from sylvan.operators import score as S
from sylvan.operators.forest import CATEGORIES, Forest
from sylvan.session import ship_package

#: Rows of one group at most.
GROUP_ROWS = 100_000


def band_levels(bound: int) -> int:
    """Levels whose complete binary tree has at most ``bound`` nodes."""
    return max(1, (bound + 1).bit_length() - 1)


def bands(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Written node tables, one a band: the nodes with ``sub``, the root of their subtree within the band."""
    edges = nodes.where("feature is not null").select("node_id", F.array("left", "right").alias("kids"))
    at, out = nodes.where("node_id = 0").select("node_id"), []
    while True:
        level = at.withColumn("sub", F.col("node_id"))
        parts = [level]
        for _ in range(levels - 1):
            level = level.join(edges, "node_id").select(F.explode("kids").alias("node_id"), "sub")
            parts.append(level)
        out.append(S._written(reduce(DataFrame.unionByName, parts).join(nodes, "node_id"), "tree_band"))
        at = S._written(level.join(edges, "node_id").select(F.explode("kids").alias("node_id")), "tree_roots")
        if at.isEmpty():
            return out


class Subtree:
    """A subtree of a band as arrays; children outside have no place of their own and end the walk."""

    def __init__(self, nodes: pd.DataFrame, sums: list[str]):
        nodes = nodes.sort_values("node_id")
        self.ids = nodes["node_id"].to_numpy(dtype=np.int64)
        self.feature = nodes["feature"].astype("float64").fillna(-1).to_numpy().astype(np.int64)
        self.threshold = nodes["threshold"].astype("float64").fillna(0.0).to_numpy()
        self.is_lt, self.is_in = (nodes["op"] == "lt").to_numpy(), (nodes["op"] == "in").to_numpy()
        self.default_left = nodes["default_left"].fillna(True).astype(bool).to_numpy()
        self.kids = np.stack([nodes[c].astype("float64").fillna(-1).to_numpy().astype(np.int64) for c in ("left", "right")])
        self.terms = {c: nodes[c].astype("float64").fillna(0.0).to_numpy() for c in sums}
        words = [() if w is None else list(w) for w in nodes[CATEGORIES]] if CATEGORIES in nodes else [()] * len(nodes)
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words = np.asarray([x for w in words for x in w] or [0], dtype=np.int64)

    def walk(self, at: np.ndarray, x) -> tuple[np.ndarray, np.ndarray]:
        """(node id, whether it is a leaf) after all levels of the band, from nodes ``at``."""
        at = at.copy()
        place = np.searchsorted(self.ids, at)
        live = np.flatnonzero(self.feature[place] >= 0)
        while len(live):
            p = place[live]
            v = x[live, self.feature[p]]
            left = goes_left_np(v, self.threshold[p], self.is_lt[p], self.default_left[p])
            sets = self.is_in[p]
            if sets.any():
                left = np.where(sets, in_set_np(v, self.words, self.start[p], self.size[p], self.default_left[p]), left)
            kid = np.where(left, self.kids[0][p], self.kids[1][p])
            at[live] = kid
            q = np.minimum(np.searchsorted(self.ids, kid), len(self.ids) - 1)
            here = self.ids[q] == kid
            place[live] = np.where(here, q, -1)
            live = live[here]
            live = live[self.feature[place[live]] >= 0]
        done = place >= 0
        return at, done & (self.feature[np.maximum(place, 0)] < 0)


def _matrix(pdf: pd.DataFrame, width: int, absent: float):
    if "_m" in pdf:
        maps = [{} if m is None else dict(m) for m in pdf["_m"]]
        maps = [{f: v for f, v in m.items() if v is not None} for m in maps]
        return S.SparseRows([list(m) for m in maps], [list(m.values()) for m in maps], width, absent)
    out = np.full((len(pdf), width), np.nan)
    for i, xs in enumerate(pdf["_x"]):
        if xs is not None:
            row = np.asarray(xs, dtype=np.float64)[:width]
            out[i, :len(row)] = row
    return out


def walk_large_tree(rows: DataFrame, nodes: DataFrame, forest: Forest, bound: int, absent: float | None = None) -> DataFrame:
    """The terms of one tree for written rows (_k*, _rid, features as _x or _m): _k*, _rid, sums."""
    ship_package(rows.sparkSession)
    spark, carried, sums = rows.sparkSession, S._carried(rows), S._sum_columns(forest.meta)
    width = max(forest.meta.n_features, int(nodes.agg(F.max("feature")).first()[0] or 0) + 1)
    fill = np.nan if absent is None else float(absent)
    plain = nodes.select("node_id", "feature", "threshold", "op", "default_left", "left", "right", *[CATEGORIES] * forest.has_categories,
                         *S._leaf_terms(forest))
    all_bands = bands(plain, band_levels(bound))
    schema = T.StructType([*rows.schema.fields, T.StructField("_at", T.LongType()), T.StructField("_done", T.BooleanType()),
                           *[T.StructField(c, T.DoubleType()) for c in sums]])

    given, produced = rows.columns, schema.names

    def walked(pdf: pd.DataFrame, tree: Subtree, at: np.ndarray) -> pd.DataFrame:
        node, done = tree.walk(at, _matrix(pdf, width, fill))
        place = np.minimum(np.searchsorted(tree.ids, node), len(tree.ids) - 1)
        new = {"_at": node, "_done": done, **{c: np.where(done, tree.terms[c][place], 0.0) for c in sums}}
        return pdf[given].assign(**new)

    # at most ``bound`` nodes, by the number of its levels
    first = spark.sparkContext.broadcast(Subtree(all_bands[0].toPandas(), sums))

    def top(batches):
        for pdf in batches:
            yield walked(pdf, first.value, np.zeros(len(pdf), dtype=np.int64))

    def below(key, pdf: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=produced).astype({"_done": bool})
        return walked(pdf, Subtree(tree, sums), pdf["_at"].to_numpy(dtype=np.int64))

    out = S._written(rows.mapInPandas(top, schema), "band_rows")
    finished = [out.where("_done")]
    for band in all_bands[1:]:
        on = out.where("not _done").drop("_done", *sums)
        deals = S._written(on.groupBy("_at").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP_ROWS)).cast("int").alias("_deals")), "band_deals")
        dealt = on.join(deals, "_at").withColumn("_salt", F.pmod(F.xxhash64("_rid"), F.col("_deals")).cast("int")).drop("_deals").withColumn("_sub", F.col("_at"))
        trees = band.join(deals, F.col("sub") == F.col("_at")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))) \
                    .withColumn("_sub", F.col("_at")).drop("_deals", "_at", "sub")
        groups = dealt.groupBy("_sub", "_salt").cogroup(trees.groupBy("_sub", "_salt"))
        out = S._written(groups.applyInPandas(below, schema), "band_rows")
        finished.append(out.where("_done"))
    return reduce(DataFrame.unionByName, [f.select(*carried, *sums) for f in finished])
