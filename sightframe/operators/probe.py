"""The probe: what an image's bytes say about it, or why they say nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sniff
from ..functions.errors import INVALID_REQUEST, error, first_error
from ..functions.names import free_names
from ..functions.stages import staged

DECODE_ROUTE, CROP_ROUTE, READ_ROUTE = "spark.probe", "spark.crop", "spark.read"
PROBE = ("format", "mime", "width", "height", "pixel_count", "has_alpha", "color_type", "source_hash", "file_size", "route")


def probe(images: DataFrame) -> DataFrame:
    """``images`` (content, and where there is one error) with a probe struct, or an error in its place.

    Errors come in this order: one that is there already, unknown format, broken header, a side of nought.
    """
    content = F.col("content")
    before = F.col("error") if "error" in images.columns else F.lit(None).cast("struct<code:string,message:string>")
    fmt = sniff.image_format(content)
    was, name, size = free_names(images, "before", "sniffed", "size")
    rows = staged(images, **{was: before, name: fmt})
    rows = staged(rows, **{size: sniff.dimensions(content, F.col(name))})
    w, h = F.col(size)["width"], F.col(size)["height"]
    found = first_error(
        F.col(was),
        F.when(F.col(name).isNull(), error(INVALID_REQUEST, "Unable to determine image format: no known signature")),
        F.when(w.isNull() | h.isNull(), error(INVALID_REQUEST, "Invalid image dimensions: broken header")),
        F.when((w <= 0) | (h <= 0), error(INVALID_REQUEST, "Image dimensions must be positive.")),
    )
    values = (F.col(name), sniff.mime_of(F.col(name)), w, h, F.try_multiply(w, h), sniff.has_alpha(content, F.col(name)), sniff.color_type_of(F.col(name)), sniff.content_hash(content), F.length(content).cast("long"), F.lit(DECODE_ROUTE))
    rows = staged(rows, error=found)
    rows = rows.withColumn("probe", F.when(F.col("error").isNull(), F.struct(*(v.alias(n) for v, n in zip(values, PROBE)))))
    return rows.drop(was, name, size)
