"""Run-log analytics.

Everything here is an aggregate or a join with a per-group aggregate, so a
group (one run, one user) that holds a third of all rows is still spread
over many tasks: no group is ever collected into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.operators.numbering import global_row_number


def _cols(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


def _null_safe(df: DataFrame, per_group: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on group columns in which null is a value of its own."""
    other = per_group.select(*[F.col(c).alias(f"__{c}" if c in on else c) for c in per_group.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return df.join(other, cond, how).drop(*[f"__{c}" for c in on])


def _lex_extreme(df: DataFrame, g: list[str], order: list[str], pick,
                 value: str | None = None) -> DataFrame:
    """Per group, the smallest (``F.min``) or largest (``F.max``) value of
    the order columns taken lexicographically -- and, with ``value``, that
    row's value.

    One hash aggregate per order column; the rows tied on the columns so
    far are found with a semi join against the (per-group) result.  No
    sort and no struct-typed aggregate buffer; ``len(order)`` passes over
    ``df``.
    """
    found = None
    cand = df
    for i, c in enumerate(order):
        aggs = [pick(F.col(c)).alias(c)]
        if value and i == len(order) - 1:
            by = F.max_by if pick is F.max else F.min_by
            aggs.append(by(F.col(value), F.col(c)).alias(value))
        best = cand.groupBy(*g).agg(*aggs)
        found = best if found is None else _null_safe(found, best, g)
        if i < len(order) - 1:
            cand = _null_safe(cand, best.select(*g, c), [*g, c], "left_semi")
    return found


def _after(order: list[str], firsts: list[str]) -> Column:
    """Lexicographic ``order >= firsts``."""
    expr = F.col(order[-1]) >= F.col(firsts[-1])
    for c, f in zip(reversed(order[:-1]), reversed(firsts[:-1])):
        expr = (F.col(c) > F.col(f)) | ((F.col(c) == F.col(f)) & expr)
    return expr


def first_flag_position(df: DataFrame, group, order, flag: Column) -> DataFrame:
    """Per group, the order value(s) of the first row where ``flag`` holds
    (only flagged rows reach the aggregates)."""
    g, o = _cols(group), _cols(order)
    first = _lex_extreme(df.where(flag), g, o, F.min)
    return first.select(*g, *[F.col(c).alias(f"_first_{i}") for i, c in enumerate(o)])


def seen_flag(df: DataFrame, group, order, flag: Column, out: str = "seen") -> DataFrame:
    """Running "seen the flag yet" marker in order, as a join with the
    per-group first position (no per-group window)."""
    g, o = _cols(group), _cols(order)
    first = first_flag_position(df, g, o, flag)
    firsts = [f"_first_{i}" for i in range(len(o))]
    return _null_safe(df, first, g, "left").withColumn(
        out, (F.col(firsts[0]).isNotNull() & _after(o, firsts)).cast("int")).drop(*firsts)


def seen_flag_window(df: DataFrame, group, order, flag: Column, out: str = "seen") -> DataFrame:
    """W1 as a running window (one task per group; for bounded groups)."""
    from pyspark.sql import Window
    w = (Window.partitionBy(*_cols(group)).orderBy(*_cols(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.coalesce(F.max(F.when(flag, 1)).over(w), F.lit(0)))


def running_flag_max(df: DataFrame, group, order, flag: Column, values: Sequence[str],
                     default: float = -1) -> DataFrame:
    """A10: per group the maximum of each value, counted only from the first
    flagged row on (inclusive); ``default`` when no row qualifies."""
    g = _cols(group)
    marked = seen_flag(df, g, order, flag, "_seen")
    aggs = [F.coalesce(F.max(F.when(F.col("_seen") == 1, F.col(v))), F.lit(default))
            .cast(df.schema[v].dataType).alias(f"max_{v}") for v in values]
    return marked.groupBy(*g).agg(*aggs)


def position_in_group(df: DataFrame, group, order, out: str = "pos") -> DataFrame:
    """0-based position of each row inside its group, in ``order``.

    Global numbering over (group, order) -- range partitioned, so a hot
    group spans many tasks -- minus each group's first number.
    """
    g = _cols(group)
    o = _cols(order)
    numbered = global_row_number(df, g + o, "_rn")
    first = numbered.groupBy(*g).agg(F.min("_rn").alias("_first"))
    return _null_safe(numbered, first, g).select(*df.columns, (F.col("_rn") - F.col("_first")).alias(out))


def last_value(df: DataFrame, group, order, value: str, out: str) -> DataFrame:
    """Value of the last row per group (order columns unique per row)."""
    g = _cols(group)
    last = _lex_extreme(df, g, _cols(order), F.max, value)
    return last.select(*g, F.col(value).alias(out))


def stage_table(stage_values: DataFrame, group, stage: str, value: str,
                stages: Sequence[str], missing: float = -1.0) -> DataFrame:
    """One column per stage (pivot on a known stage list) + total of
    read, write and infer."""
    g = _cols(group)
    wide = stage_values.groupBy(*g).pivot(stage, list(stages)).agg(F.first(value))
    cols = [F.coalesce(F.col(s), F.lit(missing)).alias(s) for s in stages]
    wide = wide.select(*g, *cols)
    return wide.withColumn("total", F.col("read") + F.col("write") + F.col("infer"))
