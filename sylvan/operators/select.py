"""Order-statistic selection: the first n rows in key order without ordering rows.

The n-th smallest key is found by histograms: count the keys per cell of a
range, find the cell in which the running count passes n, and look into that
cell alone until it holds one value. What comes out is a plain condition on the
key, so taking the first n rows or labelling a split is a filter over one scan:
nothing is shuffled, written or numbered, and a condition on a file's column
reaches the scan.

Cells are equal parts of a range (whole numbers, dates, times), the stretches
between approximate quantiles and these themselves (doubles, decimals), or the
next character (texts). A round is one partially aggregated count over one
column, at most ``CELLS`` rows of which come back (characters that follow a
prefix, for texts). It divides a range by ``CELLS``, so a whole number takes six
rounds at most, a text one a character.

Several key columns are settled one after the other, each among the rows equal
in those before it. Rows equal in all of them follow a hash of their other
columns, then their place in the scan, so a tie of any size -- a third of the
rows on one key -- is cut at exactly n rows. Only rows equal in everything come
down to their place; it holds as long as the table is read the same way again
(files, not what comes out of a shuffle).

Nulls come first, as in Spark's ascending order, NaN last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.operators.names import spare_name

CELLS = 4096
#: Quantiles of a round over doubles and decimals.
QUANTILES = 64
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _rounds(key: Column, kind: T.DataType, df: DataFrame):
    """The rounds over a key's present values."""
    if isinstance(kind, T.StringType):
        return _Texts(key)
    if isinstance(kind, T.DateType):
        key = F.unix_date(key).cast("long")
    elif isinstance(kind, T.TimestampType):
        key = F.unix_micros(key)
    elif isinstance(kind, T.BooleanType):
        key = key.cast("int").cast("long")
    elif isinstance(kind, _WHOLE):
        key = key.cast("long")
    else:
        return _Values(key)
    r = df.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    return _Numbers(key, r["a"], r["b"])


class _Numbers:
    """Rounds over a key that is a whole number."""

    def __init__(self, key: Column, low: int, high: int):
        self.key, self.low, self.high = key, low, high

    @property
    def settled(self) -> bool:
        return self.low == self.high

    def inside(self) -> Column:
        return self.key.between(F.lit(self.low), F.lit(self.high))

    @property
    def width(self) -> int:
        return -(-(self.high - self.low + 1) // CELLS)

    def cell(self, df: DataFrame) -> Column:
        key, low, width = self.key, F.lit(self.low), F.lit(self.width)
        if self.high - self.low >= 1 << 63:  # the difference does not fit a long
            key, low, width = (c.cast("decimal(20,0)") for c in (key, low, width))
        return F.call_function("div", key - low, width).cast("long")

    def enter(self, cell: int) -> None:
        low, width = self.low + cell * self.width, self.width
        self.low, self.high = low, min(self.high, low + width - 1)

    def value(self) -> Column:
        return F.lit(self.low)


class _Texts:
    """Rounds over a text: one character each, the end of the text first."""

    def __init__(self, key: Column):
        self.key, self.prefix, self.settled = key, "", False

    def inside(self) -> Column:
        return self.key.startswith(F.lit(self.prefix)) if self.prefix else F.lit(True)

    def cell(self, df: DataFrame) -> Column:
        rest = F.substring(self.key, F.lit(len(self.prefix) + 1), F.lit(1))
        return F.when(rest == "", F.lit(-1)).otherwise(F.ascii(rest)).cast("long")

    def enter(self, cell: int) -> None:
        if cell < 0:
            self.settled = True
        else:
            self.prefix += chr(cell)

    def value(self) -> Column:
        return F.lit(self.prefix)


class _Values:
    """Rounds over values without whole numbers: quantiles of the open stretch, themselves cells of their own."""

    def __init__(self, key: Column):
        self.key, self.low, self.high, self.settled = key, None, None, False

    def inside(self) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (self.key > F.lit(self.low))
        return out if self.high is None else out & (self.key < F.lit(self.high))

    def cell(self, df: DataFrame) -> Column:
        q = F.percentile_approx(self.key, [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)
        self.values = sorted(set(df.agg(q).first()[0]))
        known = F.array(*map(F.lit, self.values))
        below = F.size(F.filter(known, lambda v: v < self.key))
        return (2 * below + F.coalesce(F.get(known, below) == self.key, F.lit(False)).cast("int")).cast("long")

    def enter(self, cell: int) -> None:
        at = cell // 2
        if cell % 2:
            self.settled, self.low = True, self.values[at]
        else:
            self.low = self.values[at - 1] if at else self.low
            self.high = self.values[at] if at < len(self.values) else self.high

    def value(self) -> Column:
        return F.lit(self.low)


def _settle(df: DataFrame, key: Column, kind: T.DataType, left: int) -> tuple[Column, Column, int]:
    """The key of row number ``left`` (from 0): (rows before it, rows equal to it, how many of these to take)."""
    nan = F.isnan(key) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(False)
    r = df.agg(F.count_if(key.isNull()).alias("nulls"), F.count_if(nan).alias("nans"), F.count(F.lit(1)).alias("n")).first()
    if left < r["nulls"]:
        return F.lit(False), key.isNull(), left
    if left >= r["n"] - r["nans"]:
        return key.isNull() | ~nan, key.isNotNull() & nan, left - (r["n"] - r["nans"])
    left -= r["nulls"]
    there = df.where(key.isNotNull() & ~nan)
    rounds = _rounds(key, kind, there)
    while not rounds.settled:
        open_ = there.where(rounds.inside())
        counts = open_.groupBy(rounds.cell(open_).alias("cell")).count().collect()
        for cell, n in sorted((int(c), int(n)) for c, n in counts):
            if left < n:
                rounds.enter(cell)
                break
            left -= n
    here = key.isNotNull() & ~nan
    return key.isNull() | (here & (rounds.key < rounds.value())), here & (rounds.key == rounds.value()), left


def _cut(df: DataFrame, order_cols: Sequence[str] | str, n: int, place: str) -> tuple[Column, bool]:
    """The condition that holds for exactly the first ``n`` rows of ``df``, and whether it reads ``place``, the column
    with the rows' place: it does if rows are equal in everything else."""
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    others = [c for c in df.columns if c not in cols and c != place]
    keys = [(F.col(f"`{c}`"), df.schema[c].dataType) for c in cols]
    if others:
        keys.append((F.xxhash64(*[F.col(f"`{c}`") for c in others]), T.LongType()))
    keys.append((F.col(place), T.LongType()))
    taken, equal, here, left = F.lit(False), F.lit(True), df, n
    for i, (key, kind) in enumerate(keys):
        before, same, left = _settle(here, key, kind, left)
        taken, equal = taken | (equal & before), equal & same
        if left == 0:
            break
        here = here.where(same)
    return taken, i == len(keys) - 1


def _placed(df: DataFrame) -> tuple[DataFrame, str]:
    place = spare_name(df, "place")
    return df.withColumn(place, F.monotonically_increasing_id()), place


def take_first(df: DataFrame, order_cols: Sequence[str] | str, n: int) -> DataFrame:
    """The first ``n`` rows in key order, by a filter."""
    total = df.count()
    if n >= total:
        return df
    if n <= 0:
        return df.where(F.lit(False))
    placed, place = _placed(df)
    condition, by_place = _cut(placed, order_cols, n, place)
    # without the place the filter reaches the scan
    return placed.where(condition).drop(place) if by_place else df.where(condition)


def split_at(df: DataFrame, order_cols: Sequence[str] | str, train_fraction: float, out: str = "split", names=("train", "test")) -> DataFrame:
    """L1: the first ``floor(n * train_fraction)`` rows in key order are labelled train, the rest test."""
    total = df.count()
    n = int(total * train_fraction)
    placed, place = _placed(df)
    condition, by_place = _cut(placed, order_cols, n, place) if 0 < n < total else (F.lit(n > 0), False)
    base = placed if by_place else df
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return base.select(*kept, F.when(condition, F.lit(names[0])).otherwise(F.lit(names[1])).alias(out))


def capped_halves(first: DataFrame, second: DataFrame, order_cols, nrows: int, names=("train", "test"), source_col: str = "source") -> DataFrame:
    """L2: pre-split input, each half capped at ``nrows // 2`` rows and tagged."""
    a, b = (take_first(t, order_cols, nrows // 2).withColumn(source_col, F.lit(name)) for t, name in zip((first, second), names))
    return a.unionByName(b)

