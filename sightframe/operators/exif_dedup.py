"""The first of several fields of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(fields: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per combination of ``keys``: the one that comes first by ``order``. Pre-aggregated before the shuffle."""
    rest = [c for c in fields.columns if c not in keys and c not in order]
    first = fields.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return first.select(*keys, "_row.*").select(fields.columns)
