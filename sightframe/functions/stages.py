"""Borders inside a plan and inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with these columns, which replace those of the same name, each computed once.

    The optimiser merges projections, so that an expression is written out wherever its column is used, and so are the
    ones that it is made of. Here the columns come out of a generator of one row, which nothing is merged with: what
    follows refers to them by name. Neither rows nor their places change.
    """
    names = {n.lower() for n in columns}
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in names]
    return rows.select(*kept, F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, and not written out wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Bytes of a batch that goes to Python, unless the session sets its own bound; Spark's is 64 MB, and objects made of them take several times that.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(rows: DataFrame) -> DataFrame:
    """``rows``, in a session whose batches for Python are bounded by bytes: a row with long text or a long array is not one of ten thousand."""
    conf = rows.sparkSession.conf
    if _BATCHES not in conf.getAll:
        conf.set(_BATCHES, str(BATCH_BYTES))
    return rows
