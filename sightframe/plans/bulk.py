"""Many requests for few files: every file is listed, read, probed and decoded once, however often it is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import INVALID_PARAMS, INVALID_REQUEST, error, first_error
from ..functions.names import free_names
from ..functions.region import FIELDS, shrunk_size
from ..functions.stages import bounded, let, staged
from ..operators.crop import cut_wanted, cuts, evidence, region_checks
from ..operators.probe import probe
from ..sources.images import MAX_FILE_BYTES, MAX_PIXELS, read_requested, size_error

#: Different requests for one file that are worked on together; those of a file with more are divided, and each part reads it.
TOGETHER = 256
_OPTIONS = {"max_file_bytes": ("long", MAX_FILE_BYTES), "max_pixels": ("long", MAX_PIXELS), "max_region_dimension": ("long", None), "include_region_image": ("boolean", False)}
_REGION = "struct<" + ",".join(f"{f}:bigint" for f in FIELDS) + ">"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the files below a folder. No file is opened: the scan reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), "length")


def together(requests: DataFrame, most: int = TOGETHER) -> DataFrame:
    """path, part and asked: the different requests for each path, ``most`` or so in a part, each with its number of copies.

    Counts of requests and of paths are added up before they are shuffled, so a path that a third of all rows ask for is
    no more than its different requests, and those go to as many parts as they fill.
    """
    once = requests.groupBy(*requests.columns).agg(F.count("*").alias("copies"))
    of, parts = free_names(once, "of", "parts")
    large = once.where("path is not null").groupBy(F.col("path").alias(of)).agg(F.ceil(F.count("*") / most).alias(parts)).where(F.col(parts) > 1)
    asked = F.struct(*(F.col(c) for c in once.columns if c != "path"))
    part = F.when(F.col("path").isNull(), F.xxhash64(F.to_json(asked))).otherwise(F.pmod(F.xxhash64(F.to_json(asked)), F.coalesce(parts, F.lit(1))))
    return once.join(large, F.col("path") == F.col(of), "left").groupBy("path", part.alias("part")).agg(F.collect_list(asked).alias("asked"))


def crop_many(requests: DataFrame, files: DataFrame, most: int = TOGETHER) -> DataFrame:
    """``requests`` (path, region and options) with length, probe, region_evidence and error, from ``files`` (path, length).

    The listing is joined first, on the path, so a file that is missing from it is an error and is never looked for, one
    that nobody asks for is never opened, and one above the limit of all its requests neither. All regions of a part of
    a file's requests are cut out of one decoded image. Options are max_file_bytes, max_pixels, max_region_dimension and
    include_region_image, with the usual defaults where they are null or missing; a null region asks for the probe
    alone. Rows that repeat are answered as often as they are there; an empty table gives an empty result. Other columns
    of ``requests`` come back as they are and must be of types that can be grouped.
    """
    option = dict(zip([*_OPTIONS, "region"], free_names(requests, *(f"used_{n}" for n in [*_OPTIONS, "region"]))))
    rows = requests
    for name, (kind, default) in [*_OPTIONS.items(), ("region", (_REGION, None))]:
        given = F.col(name).cast(kind) if name in requests.columns else F.lit(None).cast(kind)
        rows = rows.withColumn(option[name], F.coalesce(given, F.lit(default).cast(kind)))
    groups = together(rows, most)
    known = files.select(F.col("path").alias("path"), F.col("length").alias("listed"))
    groups = groups.join(known, "path", "left")
    limit = F.array_max(F.transform("asked", lambda q: q[option["max_file_bytes"]]))
    found = first_error(
        F.when(F.col("path").isNull(), error(INVALID_PARAMS, "path is required")),
        F.when(F.col("listed").isNull(), error(INVALID_REQUEST, F.concat(F.lit("Unable to access image at '"), F.col("path"), F.lit("': not in the listing")))),
        size_error(F.col("listed"), limit),
    )
    groups = staged(groups, fault=found, max_file_bytes=limit)
    good = read_requested(bounded(groups.where("fault is null")))  # each row holds up to TOGETHER requests
    bad = groups.where("fault is not null").select("*", F.col("listed").alias("length"), F.lit(None).cast("binary").alias("content"), F.col("fault").alias("error"))
    probed = probe(good.unionByName(bad))
    return _answers(probed, option).select(*requests.columns, "length", "probe", "region_evidence", "error")


def _answers(probed: DataFrame, option: dict[str, str]) -> DataFrame:
    """One row per request of the parts in ``probed``; ``option`` names the fields of a request with its options."""
    w, h, shared = F.col("probe.width"), F.col("probe.height"), F.col("error")

    def judged(q: Column) -> Column:
        width, height, shrinks = shrunk_size(q[option["region"]]["width"], q[option["region"]]["height"], q[option["max_region_dimension"]])
        size = F.struct(width.alias("width"), height.alias("height"), shrinks.alias("shrinks"))
        return let(size, lambda s: with_error(q, s))

    def with_error(q: Column, s: Column) -> Column:
        own = F.when(q[option["region"]].isNotNull(), region_checks(q[option["region"]], w, h, s["width"], s["height"], q[option["max_pixels"]]))
        fault = first_error(size_error(F.coalesce("length", "listed"), q[option["max_file_bytes"]]), shared, own)
        return F.struct(q.alias("q"), s.alias("s"), fault.alias("fault"))

    rows = staged(probed, asked=F.transform("asked", judged))
    wanted = F.transform("asked", lambda a: cut_wanted(a["q"][option["region"]], a["s"]["width"], a["s"]["height"], a["s"]["shrinks"], a["q"][option["include_region_image"]], a["fault"].isNull() & a["q"][option["region"]].isNotNull()))
    rows = staged(rows, wanted=wanted)
    content = F.when(F.exists("wanted", lambda x: x.isNotNull()), F.col("content"))
    rows = rows.withColumn("cut", cuts(content, F.col("wanted"))).select("path", "length", "probe", F.inline(F.arrays_zip("asked", "cut")))
    failure = F.when(F.col("cut.failure").isNotNull(), error(INVALID_REQUEST, F.col("cut.failure")))
    q, s = F.col("asked.q"), F.col("asked.s")
    rows = rows.select("path", "length", q.alias("q"), F.coalesce("asked.fault", failure).alias("error"), F.col("probe").alias("found"), evidence(q[option["region"]], s["width"], s["height"], s["shrinks"], F.col("cut")).alias("region_evidence"))
    rows = rows.select("path", "length", F.when(F.col("error").isNull(), F.col("found")).alias("probe"), "region_evidence", "error", "q.*")
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
