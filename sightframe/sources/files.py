"""Files on storage that the driver and all tasks mount: a source that lists first and reads late, and sinks that leave whole files."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .images import BATCH_BYTES, MAX_FILE_BYTES, too_large

#: Bytes of files that one partition of :class:`ImageFiles` reads, unless a single file is larger, and what opening a file counts for.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 1 << 16


def mounted(path: str) -> str:
    """The local path of a ``file:`` URI or a plain path; files of other systems can't be opened by tasks."""
    if re.match(r"file:", path):
        return re.sub(r"^file:(//)?(?=/)", "", path)
    if "://" in path:
        raise ValueError(f"not on mounted storage: {path}")
    return path


def new_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset a temporary one, but only if driver and tasks are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="sightframe-")
    folder = f"{mounted(where).rstrip('/')}/files-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def write_files(rows: DataFrame, folder: str, name_col: str = "name", content_col: str = "content") -> int:
    """Write one file per row into ``folder``, and tell how many.

    A file is written under another name and then renamed, so that a task that is run again or twice leaves whole files
    and none beside them. Rows without name or content are left out; of rows with one name any one stays. Names may lie
    in folders below ``folder``, which are made: in one folder, files are written one at a time and listed by one thread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {folder}
        for batch in batches:
            n = 0
            for name, content in zip(batch.column(0), batch.column(1)):
                if name.is_valid and content.is_valid:
                    at = os.path.join(folder, name.as_py())
                    below = os.path.dirname(at)
                    if below not in made:
                        os.makedirs(below, exist_ok=True)
                        made.add(below)
                    part = os.path.join(below, f".{uuid.uuid4().hex}")
                    with open(part, "wb") as f:
                        f.write(content.as_py())
                    os.replace(part, at)
                    n += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.select(F.col(name_col).alias("name"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass
class _Files(InputPartition):
    """Paths with their sizes and times."""

    files: list[tuple[str, int, float]] = field(default_factory=list)
    size: int = 0


#: What each filter that is looked at before a file is opened asks of a value.
_ASKS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
    IsNotNull: lambda v, x: True, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
}


class ImageFiles(DataSource):
    """``spark.read.format("image_files").load(folder)``: path, length, modified, content and message of the files below a folder.

    Filters on path and length are looked at while the folder is listed, so that files they leave out are never opened,
    and neither are those of more than ``maxFileBytes`` bytes, which have a message in place of content. With ``content``
    ``false`` no file is opened. Files are dealt to partitions of about ``partitionBytes`` bytes, the largest ones first.
    Empty and hidden files are files like others; links to folders are not followed. The driver holds the list of paths, as
    for Spark's own file sources.
    """

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "path string, length long, modified double, content binary, message string"

    def reader(self, schema: object) -> DataSourceReader:
        return ImageFilesReader({k.lower(): v for k, v in self.options.items()})


class ImageFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = mounted(options["path"])
        self.most = int(options.get("maxfilebytes", MAX_FILE_BYTES))
        self.partition = int(options.get("partitionbytes", PARTITION_BYTES))
        self.opens = options.get("content", "true").lower() == "true"
        self.asked: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _ASKS and getattr(f, "attribute", None) in (("path",), ("length",)):
                self.asked.append(f)
            else:
                yield f

    def _wanted(self, path: str, size: int) -> bool:
        return all(_ASKS[type(f)](path if f.attribute == ("path",) else size, getattr(f, "value", None)) for f in self.asked)

    def listed(self) -> list[tuple[str, int, float]]:
        """Path, size and time of the files that no filter leaves out."""
        out, folders = [], [self.folder]
        while folders:
            with os.scandir(folders.pop()) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        folders.append(e.path)
                    elif e.is_file():
                        s = e.stat()
                        if self._wanted(e.path, s.st_size):
                            out.append((e.path, s.st_size, s.st_mtime))
        return out

    def partitions(self) -> list[InputPartition]:
        out = [_Files()]
        for path, size, at in sorted(self.listed(), key=lambda f: (-f[1], f[0])):
            cost = (size if self.opens and size <= self.most else 0) + OPEN_BYTES
            if out[-1].files and out[-1].size + cost > self.partition:
                out.append(_Files())
            out[-1].files.append((path, size, at))
            out[-1].size += cost
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        names = ["path", "length", "modified", "content", "message"]
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.string()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        rows, held = [], 0
        for path, size, at in partition.files:
            content, message = None, too_large(size, self.most)
            if message is None and self.opens:
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError as e:
                    message = f"Failed to read image bytes: {e}"
            rows.append((path, size, at, content, message))
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)


@dataclass
class _Attempt(WriterCommitMessage):
    """The file that a task wrote, and its lines."""

    path: str
    lines: int


class JsonRecords(DataSource):
    """``df.write.format("json_records").mode("append").save(folder)``: the column ``value`` as lines of JSON.

    A task writes to a file of its own below ``.attempts-...`` and tells its name. The driver renames the files of the tasks
    that count, one for each partition, and deletes the others, so a task that failed halfway, ran twice or was told too
    late leaves no line behind; after an abort nothing is there. Readers never see half a file.
    """

    @classmethod
    def name(cls) -> str:
        return "json_records"

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("json_records appends only")
        return JsonRecordsWriter(mounted(self.options["path"]))


class JsonRecordsWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder, uuid.uuid4().hex
        self.attempts = f"{folder}/.attempts-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Attempt:
        os.makedirs(self.attempts, exist_ok=True)
        path, n = f"{self.attempts}/{uuid.uuid4().hex}", 0
        with open(path, "w", encoding="utf-8") as f:
            for batch in iterator:
                for value in batch.column(0):
                    f.write(value.as_py() + "\n")
                    n += 1
        return _Attempt(path, n)

    def commit(self, messages: list[_Attempt | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        for i, m in enumerate(m for m in messages if m is not None and m.lines):
            os.replace(m.path, f"{self.folder}/part-{self.job}-{i:05d}.json")
        shutil.rmtree(self.attempts, ignore_errors=True)

    def abort(self, messages: list[_Attempt | None]) -> None:
        shutil.rmtree(self.attempts, ignore_errors=True)


def write_records(records: DataFrame, folder: str) -> None:
    """Append one line of JSON per row to ``folder``."""
    records.sparkSession.dataSource.register(JsonRecords)
    records.select(F.to_json(F.struct(*records.columns)).alias("value")).write.format("json_records").mode("append").save(folder)


def register(spark: SparkSession) -> None:
    """Make ``image_files`` known to a session, and let Spark push filters into Python sources (``spark.sql.python.filterPushdown.enabled``)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageFiles)
