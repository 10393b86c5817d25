"""Pixel regions: reading a box from JSON, checking it, and the size after shrinking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import INVALID_PARAMS, INVALID_REQUEST, error, first_error
from .stages import let

FIELDS = ("x", "y", "width", "height")
_WRAP = 1 << 32


def member(value: Column, name: str) -> Column:
    """A member of a parsed JSON object; null where it is missing or ``value`` is none."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def is_kind(value: Column, *kinds: str) -> Column:
    """Whether a parsed JSON value is of one of the kinds, as ``schema_of_variant`` names them; false for a missing one."""
    return F.coalesce(F.schema_of_variant(value).rlike("^(" + "|".join(kinds) + ")$"), F.lit(False))


def unsigned(value: Column) -> Column:
    """A parsed JSON whole number from nought to 2**64 - 1; null for all else."""
    number = F.when(is_kind(value, "BIGINT", r"DECIMAL\([0-9]+,0\)"), F.try_variant_get(value, "$", "decimal(38,0)"))
    return let(number, lambda n: F.when((n >= 0) & (n < F.lit(str(2**64)).cast("decimal(38,0)")), n))


def region_numbers(value: Column) -> dict[str, Column]:
    """The fields of a parsed JSON object as numbers that wrap at 2**32; null for bad ones."""
    return {f: (unsigned(member(value, f)) % F.lit(_WRAP).cast("decimal(38,0)")).cast("long") for f in FIELDS}


def parse_region(value: Column) -> tuple[Column, Column]:
    """struct<x,y,width,height> of a parsed JSON object, and the error of its first bad field in that order.

    Strings, negative and broken numbers, nulls and missing fields are bad. Values wrap at 2**32.
    """
    return region_of(region_numbers(value))


def region_of(values: dict[str, Column]) -> tuple[Column, Column]:
    """:func:`parse_region` of the numbers of :func:`region_numbers`."""
    found = first_error(*(F.when(values[f].isNull(), error(INVALID_PARAMS, f"region.{f} is required")) for f in FIELDS))
    return F.when(found.isNull(), F.struct(*(values[f].alias(f) for f in FIELDS))), found


def region_error(region: Column, width: Column, height: Column) -> Column:
    """Null for a box inside the image; a box that just fits is inside. Sums stop at 2**32 - 1."""
    top = F.lit(_WRAP - 1)
    right, bottom = F.least(region["x"] + region["width"], top), F.least(region["y"] + region["height"], top)
    text = F.format_string("Region (%d, %d, %d, %d) exceeds image bounds (%dx%d).", *(region[f] for f in FIELDS), width, height)
    return F.when((region["width"] == 0) | (region["height"] == 0), error(INVALID_PARAMS, "Region width and height must be positive.")).when((right > width) | (bottom > height), error(INVALID_PARAMS, text))


def shrunk_size(width: Column, height: Column, limit: Column) -> tuple[Column, Column, Column]:
    """Width, height and whether it was shrunk: the longer side comes down to ``limit``; halves go up, nothing under 1."""
    shrinks = F.coalesce((limit > 0) & (F.greatest(width, height) > limit), F.lit(False))
    scale = F.try_divide(limit.cast("double"), F.greatest(width, height).cast("double"))
    side = lambda x: F.when(shrinks, F.greatest(F.floor(x * scale + 0.5), F.lit(1))).otherwise(x).cast("long")
    return side(width), side(height), shrinks


def budget_error(width: Column, height: Column, most: Column, what: str = "Cropped region") -> Column:
    over = F.coalesce(F.try_multiply(width, height) > most, width.isNotNull() & height.isNotNull())
    return F.when(over, error(INVALID_REQUEST, F.concat(F.lit(f"{what} exceeds the "), most.cast("string"), F.lit(" pixel safety budget."))))
