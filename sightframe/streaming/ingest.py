"""New files of a folder as a stream of probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.probe import probe


def probe_stream(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, probe and error of every new file below ``path``; stateless, so any sink and output mode will do."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    files = (files.option("pathGlobFilter", pattern) if pattern else files).load(path)
    return probe(files.select("path", "content")).select("path", "probe", "error")
