"""F4 by bit vectors: a forest as native bit functions, no nested conditions.

The leaves of a tree are numbered from left to right, one bit each. A node that
a row does not go left at rules out the leaves of its left subtree: its mask has
zeros there. The AND of the masks of all such nodes leaves the exit leaf as the
lowest set bit, in whatever order the nodes are looked at.

Which nodes these are depends on each feature alone: with the thresholds of a
feature sorted, they are those below the value. So the masks of every prefix are
ANDed beforehand, and a row needs, per feature, one binary search for its bin
and, per tree, one look-up a feature, the AND and the lowest bit. The tables are
literal arrays; trees are taken in groups of at most ``GROUP_NODES`` nodes, which
bounds a table's size (bins x trees), whatever the forest.

A threshold with ``x < t`` is one with ``x <= t'``, t' being the double before t.
A missing value has a bin of its own, in which the nodes that do not send it
left count.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.operators import score as S
from sylvan.operators.forest import Forest, arrays_from_pandas, size_groups, _sorted_rows

#: Nodes whose thresholds share one set of bins.
GROUP_NODES = 2_500
#: Leaves to a word: no word is negative, so its lowest bit is taken without overflow.
WORD = 63
_ONES = (1 << WORD) - 1
#: Stands behind the last cut in a binary search.
_TOP = 1.7976931348623157e308


def _table(values, kind: str) -> Column:
    """A constant array as one folded literal (an expression per element would take minutes to build)."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def _leaf_order(a: dict, root: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """(leaves from left to right, inner node -> the range of its left subtree's leaves)."""
    leaves, left_of = [], {}

    todo = [(root, "in")]
    while todo:
        g, state = todo.pop()
        if a["feature"][g] < 0:
            leaves.append(g)
        elif state == "in":
            left_of[g] = (len(leaves), 0)
            todo += [(int(a["right"][g]), "in"), (g, "left done"), (int(a["left"][g]), "in")]
        else:
            left_of[g] = (left_of[g][0], len(leaves))
    return leaves, left_of


class Group:
    """The tables of some trees: thresholds per feature, masks per bin, leaves."""

    def __init__(self, a: dict, width: int):
        if "is_in" in a and a["is_in"].any():
            raise ValueError("splits by category sets have no order of thresholds; use another plan")
        inner = np.flatnonzero(a["feature"] >= 0)
        at = np.where(a["is_lt"], np.nextafter(a["threshold"], -np.inf), a["threshold"])
        self.cuts = {f: np.unique(at[inner[a["feature"][inner] == f]]) for f in sorted(set(a["feature"][inner].tolist()))}
        self.leaves: list[list[int]] = []
        self.words: list[int] = []
        orders = [_leaf_order(a, int(r)) for r in a["root"]]
        for leaves, _ in orders:
            self.leaves.append(leaves)
            self.words.append(-(-len(leaves) // WORD))
        #: feature -> (trees, bins and the missing bin, words) prefix masks
        self.masks: dict[int, list[list[list[int]]]] = {}
        for f, cuts in self.cuts.items():
            per_tree = []
            for (leaves, left_of), n_words in zip(orders, self.words):
                nodes = [g for g in left_of if a["feature"][g] == f]
                full = (1 << WORD * n_words) - 1
                mask = {g: full & ~((1 << left_of[g][1]) - (1 << left_of[g][0])) for g in nodes}
                # bin k: k cuts lie below the value
                step = [full] * (len(cuts) + 1)
                for g in nodes:
                    step[int(np.searchsorted(cuts, at[g])) + 1] &= mask[g]
                rows, now = [], full
                for k in range(len(cuts) + 1):
                    now &= step[k]
                    rows.append(now)
                missing = full
                for g in nodes:
                    if not a["default_left"][g]:
                        missing &= mask[g]
                rows.append(missing)
                per_tree.append([[v >> WORD * w & _ONES for w in range(n_words)] for v in rows])
            self.masks[f] = per_tree

    def bin(self, x: Column, f: int) -> Column:
        """The bin of a value: cuts below it, by binary search; the last bin for a missing one."""
        cuts = self.cuts[f]
        n = 1
        while n < len(cuts) + 1:
            n *= 2
        known = _table([*cuts.tolist(), *[_TOP] * (n - 1 - len(cuts))], "double")
        steps = [n >> i for i in range(1, n.bit_length())]
        found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: p + F.when(F.get(known, p + s - 1) < x, s).otherwise(F.lit(0))) if steps else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), F.lit(len(cuts) + 1)).otherwise(F.least(found, F.lit(len(cuts)))).cast("int")

    def leaf(self, tree: int, bins: dict[int, Column]) -> Column:
        """The number of the exit leaf of one tree."""
        words = []
        for w in range(self.words[tree]):
            tables = {f: [row[w] for row in self.masks[f][tree]] for f in self.cuts}
            # a feature that rules out none of these leaves is not looked at
            parts = [F.get(_table(t, "bigint"), bins[f]) for f, t in tables.items() if min(t) != _ONES]
            words.append(reduce(lambda p, q: p.bitwiseAND(q), parts) if parts else F.lit(_ONES))
        low = lambda v: F.bit_count(v.bitwiseAND(-v) - 1)  # noqa: E731 - place of the lowest set bit
        out = F.lit(WORD * (len(words) - 1)) + low(words[-1])
        for w in range(len(words) - 2, -1, -1):
            out = F.when(words[w] != 0, F.lit(WORD * w) + low(words[w])).otherwise(out)
        return out.cast("int")


def score_bitvector(forest: Forest, df: DataFrame, key: str, features, carry: Sequence[str] = (), group_nodes: int = GROUP_NODES) -> DataFrame:
    """Scores by bit vectors: the same bits as every other plan, no Python, no shuffle."""
    meta, names = forest.meta, [key, *carry]
    x, fnames = S._plain_features(df, names, features, meta.n_features)
    units = forest.units()
    kept = S._carried(x)
    sums: list[list[Column]] = [[] for _ in S._sum_columns(meta)]
    weight, bins = 0.0, []
    for i, (a, b) in enumerate(size_groups(forest.tree_sizes(), group_nodes)):
        arrays = arrays_from_pandas(_sorted_rows(forest.nodes.where(F.col("tree_id").between(a, b - 1))), meta, units)
        group = Group(arrays, meta.n_features)
        mine = {f: F.col(f"_b{i}_{f}") for f in group.cuts}
        bins += [group.bin(F.col(fnames[f]), f).alias(f"_b{i}_{f}") for f in group.cuts]
        weight += arrays["weight"]
        for t, leaves in enumerate(group.leaves):
            at = group.leaf(t, mine)
            if meta.combine == "vote":
                for c in range(meta.n_classes):
                    sums[c].append(F.get(_table(arrays["class_terms"][leaves, c].tolist(), "double"), at))
            else:
                sums[0].append(F.get(_table(arrays["term"][leaves].tolist(), "double"), at))
    total = lambda terms: F.aggregate(F.array(*terms), F.lit(0.0), lambda p, v: p + v)
    binned = x.select(*kept, *bins)
    if meta.combine == "vote":
        out = binned.select(*kept, *[total(t).alias(f"_c{c}") for c, t in enumerate(sums)])
    else:
        out = binned.select(*kept, total(sums[0]).alias("_swv"), F.lit(weight).alias("_sw"))
    return S.finalize(out, names, meta)
