"""Pixel regions as evidence: cut, shrink, encode and hash."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pixels
from ..functions.errors import INVALID_REQUEST, error, first_error
from ..functions.names import free_names
from ..functions.region import FIELDS, budget_error, region_error, shrunk_size
from ..functions.stages import staged
from ..sources.images import MAX_PIXELS
from .probe import CROP_ROUTE

_CUT = "region_hash string, pixel_hash string, image_base64 string, failure string"
_NO_CUT = (None, None, None, None)


def _piece(image: np.ndarray, x: int, y: int, width: int, height: int, to: tuple[int, int] | None, shown: bool) -> tuple:
    """Hashes and base64 of a region of decoded pixels, shrunk where ``to`` says so."""
    cut = image[y : y + height, x : x + width]
    cut = pixels.shrink(cut, *to) if to else cut
    png = pixels.encode_png(cut)
    return hashlib.sha256(png).hexdigest(), hashlib.sha256(cut.tobytes()).hexdigest(), base64.b64encode(png).decode() if shown else None, None


def _cut_all(data: bytes | None, wanted: list[dict | None]) -> list[tuple]:
    """What is cut out of one image for every region wanted; the image is decoded once, down to the last row that is needed.

    Null for regions that are null, and for all where there is no content. Regions that are wanted several times are cut once.
    """
    boxes = [w for w in wanted if w is not None]
    if data is None or not boxes:
        return [_NO_CUT] * len(wanted)
    try:
        image = pixels.decode(data, max(w["y"] + w["height"] for w in boxes))
        keys = [None if w is None else tuple(w.values()) for w in wanted]
        found = {k: _piece(image, w["x"], w["y"], w["width"], w["height"], (w["to_width"], w["to_height"]) if w["shrinks"] else None, bool(w["shown"])) for k, w in dict(zip(keys, wanted)).items() if w is not None}
        return [_NO_CUT if k is None else found[k] for k in keys]
    except (pixels.CannotDecode, ValueError, IndexError) as e:
        return [_NO_CUT if w is None else (None, None, None, f"Failed to decode image for crop: {e}") for w in wanted]


_CUTS = pa.list_(pa.struct([(c.split()[0], pa.string()) for c in _CUT.split(", ")]))


def _cut(content: pa.Array, wanted: pa.Array) -> pa.Array:
    names = [f.name for f in _CUTS.value_type]
    rows = (None if not w.is_valid else [dict(zip(names, row)) for row in _cut_all(c.as_py(), w.as_py())] for c, w in zip(content, wanted))
    return pa.array(rows, _CUTS)


def cuts(content: Column, wanted: Column) -> Column:
    """Array of struct<region_hash, pixel_hash, image_base64, failure>, one for each of an array of :func:`cut_wanted`."""
    return F.arrow_udf(_cut, f"array<struct<{_CUT.replace(' ', ':').replace(',:', ',')}>>")(content, wanted)


def cut_wanted(region: Column, width: Column, height: Column, shrinks: Column, shown: Column, go: Column) -> Column:
    """What :func:`cuts` asks of one region; null where ``go`` is not true."""
    box = F.struct(*(region[f].alias(f) for f in FIELDS), width.alias("to_width"), height.alias("to_height"), shrinks.alias("shrinks"), shown.alias("shown"))
    return F.when(go, box)


def region_checks(region: Column, image_width: Column, image_height: Column, width: Column, height: Column, most: Column) -> Column:
    """The first error of a region: its box, its own pixels, its pixels after shrinking."""
    return first_error(region_error(region, image_width, image_height), budget_error(region["width"], region["height"], most), budget_error(width, height, most, "Resized region"))


def evidence(region: Column, width: Column, height: Column, shrinks: Column, cut: Column) -> Column:
    found = F.struct(
        region.alias("bbox"), width.alias("width"), height.alias("height"), (width * height).alias("pixel_count"), cut["region_hash"].alias("region_hash"), cut["pixel_hash"].alias("pixel_hash"),
        F.lit("image/png").alias("mime"), F.lit(CROP_ROUTE).alias("route"), shrinks.alias("resized"), cut["image_base64"].alias("image_base64"),
    )
    return F.when(cut["region_hash"].isNotNull(), found)


def crop(probed: DataFrame) -> DataFrame:
    """``probed`` (content, probe, error, region, and options) with region_evidence where a region is asked for.

    Options are the columns max_pixels, max_region_dimension and include_region_image, with the usual defaults where
    they are null or missing. Geometry and budgets are checked in expressions, so only the content of rows that pass
    goes to Python, and none comes back; a broken image that is also over budget gets the budget's error.
    ``region_hash`` is of the PNG that this library writes, ``pixel_hash`` of the RGBA bytes alone.
    """
    have = lambda name, kind, value: (F.coalesce(F.col(name).cast(kind), value) if name in probed.columns else value)
    none = F.lit(None)
    rows = probed.withColumn("max_pixels", have("max_pixels", "long", F.lit(MAX_PIXELS).cast("long")))
    rows = rows.withColumn("max_region_dimension", have("max_region_dimension", "long", none.cast("long"))).withColumn("include_region_image", have("include_region_image", "boolean", F.lit(False)))
    (cut,) = free_names(rows, "cut")
    r, most = F.col("region"), F.col("max_pixels")
    width, height, shrinks = shrunk_size(r["width"], r["height"], F.col("max_region_dimension"))
    checks = region_checks(r, F.col("probe.width"), F.col("probe.height"), width, height, most)
    rows = staged(rows, error=F.coalesce(F.col("error"), F.when(r.isNotNull(), checks)))
    go = F.col("error").isNull() & r.isNotNull()
    rows = rows.withColumn(cut, F.get(cuts(F.when(go, F.col("content")), F.array(cut_wanted(r, width, height, shrinks, F.col("include_region_image"), go))), F.lit(0)))
    failure = F.col(cut)["failure"]
    rows = rows.withColumn("region_evidence", evidence(r, width, height, shrinks, F.col(cut)))
    return rows.withColumn("error", F.coalesce("error", F.when(failure.isNotNull(), error(INVALID_REQUEST, failure)))).drop(cut)
