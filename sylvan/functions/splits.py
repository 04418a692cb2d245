"""The one split rule every scoring plan shares.

A node sends a row to its left child when the feature value compares true
against the threshold ('le': ``x <= t``, the MLlib / scikit convention;
'lt': ``x < t``, the boosted-tree convention).  A missing value (null or
NaN) follows the node's ``default_left`` flag.

A categorical node ('in') holds a bit set of category numbers, 64 to a word,
in place of a threshold: a row goes left if its category's bit is set. A value
that is missing, no whole number or beyond the words follows ``default_left``.

The column form is used by the relational and expression plans, the NumPy
form by the vectorised plan; tests check that they agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def goes_left(x: Column, threshold: Column, op: Column, default_left: Column, categories: Column | None = None) -> Column:
    """Column rule where the split parameters are themselves columns; ``categories``: the bit sets of 'in' nodes, if there are any."""
    cmp = F.when(op == F.lit("lt"), x < threshold).otherwise(x <= threshold)
    if categories is not None:
        cmp = F.when(op == F.lit("in"), F.coalesce(in_set(x, categories), default_left)).otherwise(cmp)
    return F.when(is_missing(x), default_left).otherwise(cmp)


def in_set(x: Column, words: Column) -> Column:
    """Whether category ``x`` is in a bit set of longs; null for what is no category of the set."""
    known = (x >= 0) & (x < F.size(words) * 64) & (x == F.floor(x))
    at = F.when(known, x).cast("long")  # null if not
    word = F.get(words, F.shiftright(at, 6).cast("int"))
    return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1


def category_words(categories, n_categories: int, default_left: bool) -> list[int]:
    """The bit set of ``categories`` as signed longs; numbers from ``n_categories`` on follow ``default_left``."""
    n_words = max(1, -(-n_categories // 64))
    bits = sum(1 << int(c) for c in set(categories))
    if default_left:
        bits |= (1 << 64 * n_words) - (1 << n_categories)
    words = [bits >> 64 * i & (1 << 64) - 1 for i in range(n_words)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


def categories_of(words: list[int]) -> list[int]:
    """The numbers in a bit set."""
    return [64 * i + j for i, w in enumerate(words) for j in range(64) if w >> j & 1]


def in_set_np(x: np.ndarray, words: np.ndarray, start: np.ndarray, size: np.ndarray, default_left: np.ndarray) -> np.ndarray:
    """NumPy twin of the 'in' rule: node i's words are ``words[start[i]:start[i] + size[i]]``."""
    with np.errstate(invalid="ignore"):
        known = (x >= 0) & (x < 64 * size) & (x == np.floor(x))
    at = np.where(known, x, 0).astype(np.int64)
    word = words[np.minimum(start + at // 64, max(len(words) - 1, 0))]
    return np.where(known, (word >> (at % 64)) & 1 == 1, default_left)


def goes_left_lit(x: Column, threshold: float, op: str, default_left: bool) -> Column:
    """Column rule for one known node (the compiled-expression plan)."""
    t = F.lit(float(threshold))
    cmp = (x < t) if op == "lt" else (x <= t)
    if default_left:
        return is_missing(x) | cmp
    return ~is_missing(x) & cmp


def goes_left_np(x: np.ndarray, threshold: np.ndarray, is_lt: np.ndarray,
                 default_left: np.ndarray) -> np.ndarray:
    """NumPy twin: ``x`` may hold NaN for missing values."""
    with np.errstate(invalid="ignore"):
        cmp = np.where(is_lt, x < threshold, x <= threshold)
    return np.where(np.isnan(x), default_left, cmp)


def split_sql(x: str, threshold: str, op: str, default_left: str) -> str:
    """Same rule as SQL text (used by the DuckDB oracles)."""
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN {default_left} "
            f"WHEN {op} = 'lt' THEN {x} < {threshold} ELSE {x} <= {threshold} END)")
