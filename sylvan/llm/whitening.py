"""Whitening of embeddings by shifted Cholesky QR.

Every entry c becomes the whole number floor(64 * c) + 1,000,000; whitening
makes the centred rows A (n x d) uncorrelated with variance one along their
principal components.

A is never multiplied out and decomposed at once: V = A'A / n squares the
condition of A. Instead A = QR is found by Cholesky factors of Gram matrices:

* pass 1: G = A'A is summed over all tasks, R1 = chol(G + sI). The shift s
  keeps the factor alive however near to singular G is;
* pass k: a task solves q R(k-1) ... R1 = a for its rows a, triangle by
  triangle, and adds up Q'Q; Rk = chol(Q'Q + s'I), unshifted as soon as Q is
  nearly orthogonal. Passes end when Q'Q is the identity to double precision.

R = Rk ... R1 then has the singular values and right vectors of A: with
R = U diag(w) W', the components are the columns of W and the variances
e = w**2 / n.

Only d x d matrices reach the driver, whatever the number of rows; a task
holds one slice of rows and one such matrix. Sums of the whole numbers are
exact (decimals), so centred entries n * x - S are exact too.

Defined results: rows whose vector is null, empty, or holds a null or
non-finite entry are left out; so are vectors of another length than the most
frequent one (the longest of equally frequent ones). Ids may repeat or be
null, each row is whitened. Entries beyond the range of a long are taken at its
end. Directions in which the rows do not differ (singular value below 1e-11 of
the largest) are no components; rows that are all equal, and an empty table,
give no rows. ``deviation`` is null where it does not fit a long. Other
columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm.common import materialise, workers_ready

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Entries a task turns into doubles at a time.
SLICE = 1 << 20
#: Cholesky passes at most; three are enough unless rows are nearly dependent.
PASSES = 10
#: Singular values below this share of the largest count as zero.
FLAT = 1e-11
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """float64 entries -> floor(64 c) + 1,000,000 as int64, taken at the ends of the range where beyond it."""
    with np.errstate(over="ignore"):
        y = np.floor(SCALE * v)
    far = np.abs(y) >= 2.0 ** 62
    x = np.where(far, 0.0, y).astype(np.int64) + OFFSET
    if far.any():
        x[far & (y > 0)] = _LONG[1]
        x[far & (y < 0)] = _LONG[0]
    return x


def clean_vectors(spark: SparkSession, rows: DataFrame, key="vec_id", vector="embedding") -> DataFrame:
    """Written: id, v (array<double>, finite, all of one length)."""
    v = F.col("v")
    src = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    whole = src.where(v.isNotNull() & (F.size(v) > 0)
                      & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf))))
    out = materialise(spark, whole, "whiten-rows")
    # one row a length: the lengths of embeddings are few, the first is all that is looked at
    most = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return out if most is None else out.where(F.size("v") == most["d"])


def _slices(batches: Iterator[pd.DataFrame], d: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    step = max(1, SLICE // d)
    for pdf in batches:
        for lo in range(0, len(pdf), step):
            p = pdf.iloc[lo:lo + step]
            yield p, whole_numbers(np.stack(p["v"].to_numpy()).astype(np.float64))


def _column_sums(x: np.ndarray) -> list[int]:
    if np.abs(x.astype(np.float64)).max() * len(x) < 2.0 ** 62:
        return [int(s) for s in x.sum(axis=0)]
    return [int(s) for s in x.astype(object).sum(axis=0)]


def column_sums(spark: SparkSession, vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, exact sum of every dimension)."""
    def add(batches):
        n, sums = 0, [0] * d
        for _, x in _slices(batches, d):
            n += len(x)
            sums = [a + b for a, b in zip(sums, _column_sums(x))]
        if n:
            yield pd.DataFrame({"i": range(d + 1), "s": [str(s) for s in (*sums, n)]})

    workers_ready(spark)
    parts = vectors.select("v").mapInPandas(add, "i int, s string")
    total = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return total.get(d, 0), [total.get(i, 0) for i in range(d)]


def centred_exactly(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S: int64 where every value fits, Python integers otherwise."""
    far = max(float(np.abs(x.astype(np.float64)).max(initial=0.0)) * n, max(abs(s) for s in sums))
    if far < 2.0 ** 62:
        return x * np.int64(n) - np.asarray(sums, dtype=np.int64)
    return x.astype(object) * n - np.asarray(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return centred_exactly(x, n, sums).astype(np.float64) / n


def solve_rows(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """q with q R(k) ... R(1) = a for every row of ``a``: one triangular solve a factor."""
    for r in factors:
        q = np.empty_like(a)
        for j in range(a.shape[1]):
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        a = q
    return a


def gram(spark: SparkSession, vectors: DataFrame, d: int, of_rows) -> np.ndarray:
    """Sum of m'm over all rows, ``m = of_rows(whole numbers)`` computed slice by slice in the tasks."""
    def add(batches):
        g = None
        for _, x in _slices(batches, d):
            m = of_rows(x)
            g = m.T @ m if g is None else g + m.T @ m
        if g is not None:
            yield pd.DataFrame({"i": range(len(g)), "row": list(g)})

    workers_ready(spark)
    parts = vectors.select("v").mapInPandas(add, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "c")).groupBy("i", "j").agg(F.sum("c").alias("c"))
    got = cells.toPandas()  # d x d numbers
    out = np.zeros((got["i"].max() + 1,) * 2)
    out[got["i"], got["j"]] = got["c"]
    return (out + out.T) / 2


def triangular_factors(gram_of, n: int, d: int) -> list[np.ndarray]:
    """R1, R2, ... with A = Q Rk ... R1 and Q orthogonal; ``gram_of(factors)`` is the Gram matrix of the rows solved by them."""
    factors: list[np.ndarray] = []
    for _ in range(PASSES):
        g = gram_of(factors)
        size = float(np.linalg.norm(g, 2))
        if not factors and size == 0.0:
            return []
        if factors and np.abs(g - np.eye(d)).max() < 1e-13 * d:
            break
        near = bool(factors) and np.abs(g - np.eye(d)).max() < 0.5
        shift = 0.0 if near else 11 * (n * d + d * (d + 1)) * 2.0 ** -53 * size
        # beyond some 1e13 entries the published shift passes the Gram matrix itself
        shift = min(shift, 1e-6 * size)
        factors.append(_factor(g, shift))
        if near:
            break
    return factors


def _factor(g: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of g + shift I; a shift that rounding defeats is made ten times larger."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, 2.0 ** -50 * float(np.trace(g)))


def components_of(factors: list[np.ndarray], n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit components as columns, their variances, shares of all variance), by falling variance."""
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    _, w, vt = np.linalg.svd(r)
    e = w ** 2 / n
    k = min(most, int((w > FLAT * w[0]).sum()))
    v = vt[:k].T
    # either sign would do; the largest entry is made positive so that runs agree
    v = v * np.where(v[np.abs(v).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    return v, e[:k], e[:k] / e.sum()


def whiten(spark: SparkSession, rows: DataFrame, key="vec_id", vector="embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector: id (as ``key``), n, deviation, whitened (array), and the model's explained (array), identity_error."""
    vectors = clean_vectors(spark, rows, key, vector)
    first = vectors.first()
    kind = rows.schema[key].dataType.simpleString()
    schema = "id string, deviation string, whitened array<double>"
    if first is None:
        return _shaped(spark.createDataFrame([], schema), key, kind, 0, [], 0.0)
    d = len(first["v"])
    n, sums = column_sums(spark, vectors, d)
    factors = triangular_factors(
        lambda found: gram(spark, vectors, d, lambda x: solve_rows(_centred(x, n, sums), found)), n, d)
    if not factors:
        return _shaped(spark.createDataFrame([], schema), key, kind, 0, [], 0.0)
    v, e, explained = components_of(factors, n, components)
    to_white = v / np.sqrt(e)

    # the whitened rows' own mean and covariance: a column of ones beside them carries the sums
    g = gram(spark, vectors, d, lambda x: np.column_stack([_centred(x, n, sums) @ to_white, np.ones(len(x))]))
    mean = g[:-1, -1] / n
    error = float(np.abs(g[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(e))).max())

    def project(batches):
        for p, x in _slices(batches, d):
            c = centred_exactly(x, n, sums)
            if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * d < 2.0 ** 62:
                dev = (c * c).sum(axis=1)
            else:
                dev = (c.astype(object) ** 2).sum(axis=1)
            yield pd.DataFrame({"id": p["id"], "deviation": [str(s) if s <= _LONG[1] else None for s in dev],
                                "whitened": list((c.astype(np.float64) / n) @ to_white)})

    out = vectors.select(F.col("id").cast("string").alias("id"), "v").mapInPandas(project, schema)
    return _shaped(out, key, kind, n, explained, error)


def _shaped(out: DataFrame, key: str, kind: str, n: int, explained, error: float) -> DataFrame:
    return out.select(F.col("id").cast(kind).alias(key), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
                      "whitened", F.lit(np.asarray(explained, dtype=np.float64).tolist()).cast("array<double>").alias("explained"),
                      F.lit(error).alias("identity_error"))


def whitened_components(table: DataFrame, key="vec_id") -> DataFrame:
    """The rows of :func:`whiten`, one per vector and component (numbered from 1)."""
    return (table.select(key, "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
                 .select(key, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                         F.get("explained", F.col("at")).alias("explained"), "identity_error"))
