"""The query catalogue: every operator of the inventory as a named plan.

Each entry is a function ``(spark, sf_dir) -> DataFrame`` and, where the
result is expressible in SQL, the DuckDB oracle text that must return the
same rows (tables are the driver's views of the same Parquet files).
"""

from __future__ import annotations

from sylvan.plans.registry import REGISTRY, oracle_sql, queries  # noqa: F401
from sylvan.plans import evaluation, prep, runlogs, scoring, sinks, training, invariants, boosting  # noqa: F401,E402  (modules register on import)
