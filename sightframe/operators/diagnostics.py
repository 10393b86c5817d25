"""Checks of the installation and summaries of checks."""

from __future__ import annotations

import os
import platform
import socket
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import mounted
from ..sources.images import MAX_FILE_BYTES, MAX_PIXELS
from .ocr import TOOL, available


_CHECKS = "id string, status string, message string, host string"


def _here(host: str, tool: str) -> list[tuple[str, str, str, str]]:
    """What can be told of one process that runs Python."""
    import pyarrow

    found = available(tool)
    rows = [
        ("python", "ok" if sys.version_info >= (3, 10) else "warn", f"Python {platform.python_version()}"),
        ("arrow", "ok", f"Arrow {pyarrow.__version__}"),
        ("safety_limits", "ok" if MAX_FILE_BYTES > 0 and MAX_PIXELS > 0 else "fail", f"Safety limits active: {MAX_FILE_BYTES} bytes, {MAX_PIXELS} pixels."),
        ("text_recogniser", "ok" if found else "warn", "The text recogniser runs." if found else "The text recogniser does not run here; text recognition is optional."),
    ]
    return [(*row, host) for row in rows]


def executor_checks(spark: SparkSession, tasks: int | None = None, folder: str | None = None, tool: str = TOOL) -> DataFrame:
    """id, status, message and host of the checks on every host that runs tasks, the worst of a host's processes.

    One task per slot, all at once in a barrier stage, so that no host is left out for another that is quicker. With
    ``folder`` each task also looks for that folder, which all must share. Needs as many free slots as ``tasks``.
    """
    n = tasks or spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        BarrierTaskContext.get().barrier()
        host = socket.gethostname()
        rows = _here(host, tool)
        if folder:
            there = os.path.isdir(folder)
            rows.append(("shared_folder", "ok" if there else "fail", f"{folder} is there." if there else f"{folder} is missing: tasks don't share it.", host))
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["id", "status", "message", "host"])

    found = spark.range(0, n, 1, n).mapInArrow(run, _CHECKS, barrier=True)
    rank = F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0)
    worst = F.max_by(F.struct("status", "message"), F.struct(rank, "message")).alias("worst")
    return found.groupBy("id", "host").agg(worst).select("id", "worst.status", "worst.message", "host")


def doctor(spark: SparkSession, tasks: int | None = None, tool: str = TOOL) -> DataFrame:
    """id, status (ok, warn or fail), message and host of each check, on the driver and on every host that runs tasks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    rows = [
        ("spark", "ok" if spark.version.startswith("4") else "warn", f"Spark {spark.version}", "driver"),
        ("shared_folder", "ok" if where else "warn", "spark.checkpoint.dir names the folder that tasks share." if where else "spark.checkpoint.dir is not set; the training-data operators need it.", "driver"),
        *_here("driver", tool),
    ]
    folder = mounted(where) if where and where.startswith(("/", "file:")) else None
    if folder:
        os.makedirs(folder, exist_ok=True)
    return spark.createDataFrame(rows, _CHECKS).union(executor_checks(spark, tasks, folder, tool))


def overall(checks: DataFrame, *keys: str) -> DataFrame:
    """``unavailable`` if any check fails, else ``degraded`` if any warns, else ``ready``."""
    status = F.when(F.bool_or(F.col("status") == "fail"), "unavailable").when(F.bool_or(F.col("status") == "warn"), "degraded").otherwise("ready")
    return checks.groupBy(*keys).agg(status.alias("status"))


def gate_summary(checks: DataFrame, *keys: str) -> DataFrame:
    """Counts of all, passed and failed checks (column passed), and ``passed`` if none failed."""
    out = checks.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))
    return out.withColumn("status", F.when(F.col("n_failed") == 0, "passed").otherwise("failed"))
