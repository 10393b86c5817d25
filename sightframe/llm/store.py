"""Tables written between steps, in the shared folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset a temporary one, but only if driver and tasks are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sightframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Bytes of the batches that go to Python, unless the session sets its own bound; Spark's is 64 MB on either side.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bound_batches(spark: SparkSession) -> None:
    if _BATCHES not in spark.conf.getAll:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


_written: list[str] = []


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the steps that are written inside, once the results made of them are written too, or when that fails."""
    before = len(_written)
    try:
        yield
    finally:
        paths, _written[before:] = _written[before:], []
        _delete(spark, paths)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function like :func:`materialize` whose tables are deleted at the end; what is made of them is written before that."""
    mine: list[str] = []

    def temporary(df: DataFrame) -> DataFrame:
        out = materialize(df)
        mine.append(_written.pop())
        return out

    try:
        yield temporary
    finally:
        _delete(spark, mine)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    Cuts the lineage: a lost executor costs only the tasks that read the table, not those that made it.
    """
    _bound_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
