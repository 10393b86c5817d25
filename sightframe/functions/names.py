"""Names of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(rows: DataFrame, *wanted: str) -> list[str]:
    """For each name wanted one that no column of ``rows`` has, in any case of its letters."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
