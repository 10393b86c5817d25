"""Reading image files named by requests, whole folders, and requests as JSON; writing records as JSON."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import INVALID_PARAMS, INVALID_REQUEST, error

#: Default limits.
MAX_FILE_BYTES, MAX_PIXELS = 33_554_432, 67_108_864
REQUEST = "tool string, input string"
#: Bytes of file content that one batch holds, unless a single file is larger.
BATCH_BYTES = 1 << 26
#: Partitions of Spark's own reader that one task reads, where there are enough of them: each holds 32 files at most.
PARTITIONS = 64
#: Bytes of files that one task reads where tasks list them too, and what opening a file counts for.
TASK_BYTES, OPEN_BYTES = 128 << 20, 1 << 16
#: Files in a batch of a listing.
LISTED = 10_000


def too_large(size: int, most: int) -> str | None:
    return f"Image file exceeds maximum size of {most} bytes." if size > most else None


def _read(path: str | None, most: int | None) -> tuple[int | None, bytes | None, str | None]:
    """Size, content and message; the size is looked at before anything is read."""
    if path is None:
        return None, None, None
    most = MAX_FILE_BYTES if most is None else most
    try:
        found = os.stat(path)
    except (OSError, ValueError) as e:
        return None, None, f"Unable to access image at '{path}': {e}"
    if not stat.S_ISREG(found.st_mode):
        return None, None, f"Path '{path}' is not a regular file."
    if message := too_large(found.st_size, most):
        return found.st_size, None, message
    try:
        with open(path, "rb", buffering=0) as f:
            return found.st_size, f.read(), None
    except OSError as e:
        return found.st_size, None, f"Failed to read image bytes: {e}"


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, rows, size = 0, [], 0
        for i, (path, most) in enumerate(zip(batch.column("path").to_pylist(), batch.column("max_file_bytes").to_pylist())):
            rows.append(_read(path, most))
            size += len(rows[-1][1] or b"")
            if size >= BATCH_BYTES or i == len(batch) - 1:
                part = batch.slice(start, len(rows))
                sizes, contents, messages = zip(*rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(messages, pa.string())], names=[*part.schema.names, "length", "content", "_message"])
                start, rows, size = i + 1, [], 0


def read_requested(requests: DataFrame) -> DataFrame:
    """``requests`` with length, content and error of the file at ``path``.

    A missing, irregular, oversize or unreadable file is a row with an error, and so is a null path; empty and hidden
    files are read like others. Files are opened on the executors, so paths must be on storage that all of them mount.
    """
    if "max_file_bytes" not in requests.columns:
        requests = requests.withColumn("max_file_bytes", F.lit(MAX_FILE_BYTES).cast("long"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    rows = requests.mapInArrow(_read_rows, f"{columns}, length long, content binary, _message string")
    found = F.when(F.col("path").isNull(), error(INVALID_PARAMS, "path is required")).when(F.col("_message").isNotNull(), error(INVALID_REQUEST, F.col("_message")))
    return rows.withColumn("error", found).drop("_message")


def resolve_paths(requests: DataFrame) -> DataFrame:
    """``requests`` with ``path`` made absolute and free of links, as the legacy profile does; parts that don't exist stay."""

    def real(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else os.path.realpath(p))

    return requests.withColumn("path", F.pandas_udf(real, "string")(F.col("path")))


def _hidden(name: str) -> bool:
    """Names that Spark's own reader leaves out."""
    return name.startswith(".") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")) or name.endswith("._COPYING_")


def _folders(root: str, enough: int) -> list[tuple[str, bool]]:
    """Folders that together hold all files below ``root``: those that are looked through whole, and those whose folders below are named too."""
    done, level = [], [root]
    while level and len(level) < enough:
        below = []
        for at in level:
            done.append((at, False))
            with os.scandir(at) as found:
                below += [e.path for e in found if not _hidden(e.name) and e.is_dir()]
        level = below
    return done + [(at, True) for at in level]


def _listed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, name and length of the files in folders, and with ``whole`` of those in all folders below."""
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["path", "name", "length"])
    for given in batches:
        rows = []
        for at, whole in zip(*(given.column(i).to_pylist() for i in (0, 1))):
            folders = [at]
            while folders:
                with os.scandir(folders.pop()) as found:
                    for e in found:
                        if _hidden(e.name):
                            continue
                        if e.is_dir():
                            folders += [e.path] if whole else []
                        elif e.is_file() and (size := e.stat().st_size):
                            rows.append((e.path, e.name, size))
                            if len(rows) == LISTED:
                                yield batch(rows)
                                rows = []
        if rows:
            yield batch(rows)


def _listing(spark: SparkSession, folder: str, pattern: str | None) -> DataFrame:
    """path and length of the files below a mounted folder, listed by the tasks: the driver sees only as many folders as it takes to deal them."""
    enough = 4 * spark.sparkContext.defaultParallelism
    folders = _folders(folder, enough)
    dealt = spark.createDataFrame(folders, "path string, whole boolean").repartition(min(len(folders), 4 * enough))
    listed = dealt.mapInArrow(_listed_rows, "path string, name string, length long")
    if pattern:
        glob = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).toString()
        listed = listed.where(F.col("name").rlike(rf"(?s)\A(?:{glob})\z"))
    return listed.select("path", "length")


def read_folder(spark: SparkSession, path: str, pattern: str | None = None, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, length, content and error of the files below a folder.

    Files over the limit are rows with an error and are never opened. Empty files and names that begin with a dot or
    underscore are left out, as Spark's own reader does; :func:`read_requested` reads them. Folders on mounted storage are
    listed by the tasks, and each file is dealt once to a task that opens it, so neither the driver's memory nor its time
    grows with the files; a file that can't be read is a row with an error. Other storage is read by Spark's own reader.
    """
    folder = re.sub(r"^file:(//)?(?=/)", "", path)
    if not os.path.isdir(folder):
        return _read_by_spark(spark, path, pattern, max_file_bytes)
    listed = _listing(spark, os.path.abspath(folder), pattern)
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("length") <= max_file_bytes, F.col("length"))), F.lit(0))).first()
    tasks = max(4 * spark.sparkContext.defaultParallelism, (size + n * OPEN_BYTES) // TASK_BYTES)
    asked = listed.select("path", F.lit(max_file_bytes).cast("long").alias("max_file_bytes")).repartition(tasks, "path")
    return read_requested(asked).select(F.concat(F.lit("file:"), "path").alias("path"), "length", "content", "error")


def _read_by_spark(spark: SparkSession, path: str, pattern: str | None, max_file_bytes: int) -> DataFrame:
    """The same by Spark's own reader, which lists on the driver.

    A task reads several of Spark's partitions, which hold 32 files at most however small those are, so that small files
    don't become a task for every 32 of them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (files.option("pathGlobFilter", pattern) if pattern else files).load(path)
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // PARTITIONS))
    small = files.where(F.col("length") <= max_file_bytes).select("path", "length", "content", F.lit(None).cast("struct<code:string,message:string>").alias("error"))
    large = files.where(F.col("length") > max_file_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"), size_error(F.col("length"), F.lit(max_file_bytes)).alias("error"))
    return small.union(large)


def size_error(length: Column, most: Column) -> Column:
    """Null for a file of at most ``most`` bytes."""
    return F.when(length > most, error(INVALID_REQUEST, F.concat(F.lit("Image file exceeds maximum size of "), most.cast("string"), F.lit(" bytes."))))


def read_json_requests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``{"tool": ..., "input": {...}}`` as tool and input, the latter as JSON text."""
    lines = spark.read.text(path)
    return lines.select(F.get_json_object("value", "$.tool").alias("tool"), F.get_json_object("value", "$.input").alias("input"))


def write_json(records: DataFrame, path: str) -> None:
    """One line of JSON per row."""
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.text(path)
