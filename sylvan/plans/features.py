"""Feature tables the catalogue scores, and their SQL twins.

``events`` gives four features per event (the reference's tabular sets are
stood in by the driver's tables, see FIXTURES.md):
  f0 = value as float32      f1 = hour of ts
  f2 = event_type code       f3 = user_id % 16
With ``missing=True`` the value is null for every seventh event id, so the
missing-value branch of each node is exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions.splits import split_sql
from sylvan.operators.encode import category_codes
from sylvan.operators.forest import GRID_STEPS, Forest, grid_forest
from sylvan.sources.tables import table

EVENT_FEATURES = ["f0", "f1", "f2", "f3"]
# The grid forest's feature ranges for the events features.
EVENT_RANGES = [(0.0, 512.0), (0.0, 24.0), (0.0, 5.0), (0.0, 16.0)]
# Embeddings features are 64 floats inside (-1, 1).
EMBEDDING_RANGES = [(-1.0, 1.0)] * 64


def event_features(spark: SparkSession, sf_dir: str, missing: bool = False,
                   keep=()) -> DataFrame:
    ev = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value",
                                         *[c for c in keep if c not in
                                           ("event_id", "ts", "user_id", "event_type", "value")]])
    coded = category_codes(ev, "event_type", out="event_code")
    value = F.col("value").cast("float").cast("double")
    if missing:
        value = F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(value)
    return coded.select(
        "event_id", *keep,
        value.alias("f0"),
        F.hour("ts").cast("double").alias("f1"),
        F.col("event_code").cast("double").alias("f2"),
        (F.col("user_id") % 16).cast("double").alias("f3"),
    )


def events_forest(spark: SparkSession, n_trees: int = 10, depth: int = 4, **kw) -> Forest:
    return grid_forest(spark, n_trees, depth, EVENT_RANGES, **kw)


def embeddings_forest(spark: SparkSession, n_trees: int = 10, depth: int = 4,
                      n_classes: int = 10) -> Forest:
    return grid_forest(spark, n_trees, depth, EMBEDDING_RANGES, n_classes=n_classes)


# ---------------------------------------------------------------------------
# SQL twins (DuckDB)
# ---------------------------------------------------------------------------

def sql_event_codes() -> str:
    return ("SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code "
            "FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL) d")


def sql_event_features(missing: bool = False, extra: str = "") -> str:
    value = "CAST(CAST(e.value AS FLOAT) AS DOUBLE)"
    if missing:
        value = f"CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE {value} END"
    return (f"SELECT e.event_id{extra}, {value} AS f0, CAST(hour(e.ts) AS DOUBLE) AS f1, "
            f"CAST(coalesce(c.code, -1) AS DOUBLE) AS f2, CAST(e.user_id % 16 AS DOUBLE) AS f3 "
            f"FROM events e LEFT JOIN ({sql_event_codes()}) c ON e.event_type = c.event_type")


def sql_grid_nodes(n_trees: int, depth: int, ranges, n_classes: int = 0, op: str = "le") -> str:
    """The grid forest's node relation as SQL (same formula as Spark)."""
    k = len(ranges)
    n_per_tree = 2 ** (depth + 1) - 1
    n_internal = 2 ** depth - 1
    lo = "[" + ", ".join(f"CAST({float(a)!r} AS DOUBLE)" for a, _ in ranges) + "]"
    span = "[" + ", ".join(f"CAST({float(b) - float(a)!r} AS DOUBLE)" for a, b in ranges) + "]"
    feat = f"CAST((7 * t + 3 * i) % {k} AS INTEGER)"
    step = f"CAST((5 * t + 11 * i) % {GRID_STEPS} AS DOUBLE)"
    cc = ""
    if n_classes:
        cc = (", CASE WHEN i >= {ni} THEN [" .format(ni=n_internal)
              + ", ".join(f"CAST((3 * t + 5 * i + {c}) % 8 AS DOUBLE)" for c in range(n_classes))
              + "] END AS class_counts")
    return (
        f"SELECT CAST(t AS INTEGER) AS tree_id, CAST(i AS INTEGER) AS node_id, "
        f"CASE WHEN i < {n_internal} THEN {feat} END AS feature, "
        f"CASE WHEN i < {n_internal} THEN {lo}[{feat} + 1] + {step} * {span}[{feat} + 1] / "
        f"{float(GRID_STEPS)!r} END AS threshold, "
        f"'{op}' AS op, "
        f"CASE WHEN i < {n_internal} THEN CAST(2 * i + 1 AS INTEGER) END AS left_id, "
        f"CASE WHEN i < {n_internal} THEN CAST(2 * i + 2 AS INTEGER) END AS right_id, "
        f"(i % 2 = 0) AS default_left, "
        f"CASE WHEN i >= {n_internal} THEN CAST(((13 * t + 7 * i) % 64) - 32 AS DOUBLE) / 64.0 END AS value"
        f"{cc}, 1.0 AS tree_weight "
        f"FROM (SELECT a.range AS t, b.range AS i FROM range({n_trees}) a, range({n_per_tree}) b) g"
    )


def sql_walk_sums(x_sql: str, key: str, xs: str, n_trees: int, depth: int, ranges,
                  n_classes: int = 0) -> str:
    """Recursive walk of every (row, tree) pair; returns the CTE prefix and
    a final SELECT body producing ``key`` and per-row sums.

    ``xs`` is the SQL list expression of the row's features, over alias x.
    """
    nodes = sql_grid_nodes(n_trees, depth, ranges, n_classes)
    rule = split_sql(f"{xs}[n.feature + 1]", "n.threshold", "n.op", "n.default_left")
    return (
        f"WITH RECURSIVE x AS ({x_sql}), nodes AS ({nodes}), "
        f"walk(k, tree_id, node_id) AS ("
        f"SELECT x.{key}, CAST(tr.range AS INTEGER), 0 FROM x, range({n_trees}) tr "
        f"UNION ALL "
        f"SELECT w.k, w.tree_id, CASE WHEN {rule} THEN n.left_id ELSE n.right_id END "
        f"FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id "
        f"JOIN x ON x.{key} = w.k WHERE n.feature IS NOT NULL), "
        f"leaves AS (SELECT w.k, n.value, n.tree_weight"
        + (", n.class_counts" if n_classes else "") +
        f" FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id "
        f"WHERE n.feature IS NULL) "
    )


def sql_score_events(n_trees: int = 10, depth: int = 4, missing: bool = False,
                     combine: str = "sum") -> str:
    """event_id, score, prediction with the sum / mean combine."""
    prefix = sql_walk_sums(sql_event_features(missing), "event_id", "[x.f0, x.f1, x.f2, x.f3]",
                           n_trees, depth, EVENT_RANGES)
    if combine == "sum":
        score = "sum(value * tree_weight)"
    else:
        score = "sum(value * tree_weight) / sum(tree_weight)"
    return (prefix + f"SELECT k AS event_id, {score} AS score, "
            f"CAST({score} > 0 AS INTEGER) AS prediction FROM leaves GROUP BY k")
