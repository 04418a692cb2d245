"""Names of columns that operators add for a while."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def spare_name(taken: DataFrame | Iterable[str], stem: str) -> str:
    """``_stem`` with as many underscores behind it as it takes to differ from every column, in any case."""
    have = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    name = f"_{stem}"
    while name.lower() in have:
        name += "_"
    return name


def spare_names(taken: DataFrame | Iterable[str], *stems: str) -> list[str]:
    have = list(taken.columns if isinstance(taken, DataFrame) else taken)
    out: list[str] = []
    for s in stems:
        out.append(spare_name([*have, *out], s))
    return out
