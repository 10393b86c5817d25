"""Reading an image: probe, metadata, region, and the record and envelope made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as meta
from ..functions import packets
from ..functions.errors import INVALID_PARAMS, UNSUPPORTED_TOOL, error, first_error, tool_route
from ..functions.exif import exif_fields
from ..functions.region import FIELDS, budget_error, is_kind, member, region_numbers, region_of, unsigned
from ..functions.sniff import basename
from ..functions.names import free_names
from ..functions.stages import staged
from ..operators import ocr
from ..operators.crop import crop
from ..operators.probe import READ_ROUTE, probe
from ..sources.images import MAX_FILE_BYTES, MAX_PIXELS, read_requested, resolve_paths

CONTRACT, ENGINE, VERSION = "evidence.v1", "spark", "1"
NO_METADATA = {"shipped": "No EXIF metadata was found in this image (XMP and IPTC are not read).", "legacy": "No EXIF, XMP, or IPTC metadata was found in this image."}
NEXT_ACTIONS = ("Read the file again when it has changed: the source hash then differs.", "Ask for a region to cite pixels.")
HINTS = {"path": "Give path as text: where the image is.", "region": "Give region as an object of four whole numbers: x, y, width, height.", "image_probe": "Check that the file is an image that can be read and keeps to the limits.", "crop_region": "Check that the box lies inside the image and keeps to the limits."}


def parse_options(requests: DataFrame, input_col: str = "input") -> DataFrame:
    """Typed options, and an error where they can't be read, from JSON text.

    ``path`` must be a string. Other options of a wrong type take their defaults, silently. A region that is there but
    null or broken is an error, which comes before anything that the file could say.
    """
    names = ("path", "region", "include_metadata", "include_region_image", "include_ocr", "ocr_languages", "max_file_bytes", "max_pixels", "max_region_dimension")
    asked, *said = free_names(requests, "asked", *(f"said_{n}" for n in names))
    rows = staged(requests, **{asked: F.try_parse_json(F.col(input_col))})
    rows = staged(rows, **{at: member(F.col(asked), n) for at, n in zip(said, names)})
    value = {n: F.col(at) for at, n in zip(said, names)}
    flag = lambda name, default: F.coalesce(F.when(is_kind(value[name], "BOOLEAN"), F.try_variant_get(value[name], "$", "boolean")), F.lit(default))
    limits = ("max_file_bytes", "max_pixels", "max_region_dimension")
    most, box = free_names(rows, *(f"most_{n}" for n in limits)), free_names(rows, *(f"box_{f}" for f in FIELDS))
    rows = staged(rows, **{at: unsigned(value[n]) for at, n in zip(most, limits)}, **dict(zip(box, region_numbers(value["region"]).values())))
    number = {n: F.col(at) for at, n in zip(most, limits)}
    top = F.lit(2**63 - 1)
    limit = lambda name, default: F.when(number[name].isNull(), default).otherwise(F.least(number[name], top)).cast("long")
    region, region_fault = region_of({f: F.col(at) for at, f in zip(box, FIELDS)})
    has_region = value["region"].isNotNull()
    path = F.when(is_kind(value["path"], "STRING"), F.try_variant_get(value["path"], "$", "string"))
    fault = first_error(F.when(path.isNull(), error(INVALID_PARAMS, "path is required")), F.when(has_region, region_fault))
    languages = F.when(is_kind(value["ocr_languages"], "ARRAY<STRING>"), F.try_variant_get(value["ocr_languages"], "$", "array<string>"))
    return rows.select(
        *requests.columns, path.alias("path"), flag("include_metadata", True).alias("include_metadata"), flag("include_region_image", False).alias("include_region_image"),
        limit("max_file_bytes", MAX_FILE_BYTES).alias("max_file_bytes"), limit("max_pixels", MAX_PIXELS).alias("max_pixels"),
        (number["max_region_dimension"] % 2**32).cast("long").alias("max_region_dimension"), F.when(has_region, region).alias("region"),
        flag("include_ocr", False).alias("include_ocr"), F.coalesce(languages, F.array(F.lit("eng"))).alias("ocr_languages"), fault.alias("fault"),
    )


def strict_error(text: Column) -> Column:
    """The error of the legacy profile's strict reading of options: wrong types are told and not replaced."""
    asked = F.try_parse_json(text)
    value = lambda name: member(asked, name)
    has = lambda name: value(name).isNotNull()
    flags = [F.when(has(n) & ~is_kind(value(n), "BOOLEAN"), error(INVALID_PARAMS, f"{n} must be a boolean")) for n in ("include_metadata", "include_ocr", "include_region_image")]
    path, languages = F.try_variant_get(value("path"), "$", "string"), F.try_variant_get(value("ocr_languages"), "$", "array<string>")
    boxes = [F.when(has("region") & ~(F.coalesce(unsigned(member(value("region"), f)) >= (0 if f in "xy" else 1), F.lit(False))), error(INVALID_PARAMS, f"region.{f} must be a whole number")) for f in FIELDS]
    return first_error(
        F.when(~is_kind(value("path"), "STRING") | (path == ""), error(INVALID_PARAMS, "path must be a non-empty string")), *flags,
        F.when(has("ocr_languages") & ~(is_kind(value("ocr_languages"), "ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(languages, lambda x: x == ""), F.lit(False))), error(INVALID_PARAMS, "ocr_languages must be an array of non-empty strings")),
        *boxes, F.when(has("max_region_dimension") & ~F.coalesce(unsigned(value("max_region_dimension")) > 0, F.lit(False)), error(INVALID_PARAMS, "max_region_dimension must be a positive integer")),
    )


def read_image(images: DataFrame, profile: str = "shipped") -> DataFrame:
    """``images`` (path, content, options, error) with probe, twin and error; exactly one of twin and error is set.

    Metadata that can't be read is never an error; a region that can't be cut is. With the ``legacy`` profile an image
    over the pixel budget as a whole is one as well, the orientation is told, and so is recognised text where
    ``include_ocr`` asks for it; a recogniser that does not run is told in its place. Its metadata are EXIF fields, then XMP
    and IPTC ones of other names.
    """
    rows = probe(images)
    have = lambda name, value: F.coalesce(F.col(name), F.lit(value)) if name in images.columns else F.lit(value)
    if profile == "legacy":
        over = budget_error(F.col("probe.width"), F.col("probe.height"), have("max_pixels", MAX_PIXELS).cast("long"), "Image")
        rows = staged(rows, error=F.coalesce("error", over))
    if "region" in images.columns:
        rows = crop(rows)
    else:
        rows = rows.withColumn("region_evidence", F.lit(None).cast("struct<bbox:struct<x:bigint,y:bigint,width:bigint,height:bigint>,width:bigint,height:bigint,pixel_count:bigint,region_hash:string,pixel_hash:string,mime:string,route:string,resized:boolean,image_base64:string>"))
    fields, said, tsv, found = free_names(rows, "fields", "said", "tsv", "found")
    added = [fields]
    rows = staged(rows, error=F.col("error"), probe=F.col("probe"), region_evidence=F.col("region_evidence"))
    wanted = have("include_metadata", True) & F.col("error").isNull()
    content = F.when(wanted, F.col("content"))
    rows = rows.withColumn(fields, exif_fields(content))
    text = tree = None
    if profile == "legacy":
        rows = staged(rows, **{fields: packets.merged(F.col(fields), packets.xmp_fields(content), packets.iptc_fields(content))})
        (tree,) = free_names(rows, "tree")
        rows = rows.withColumn(tree, meta.redact_tree(F.when(F.size(fields) > 0, meta.metadata_json(F.col(fields)))))
        added += [tree]
        asked = have("include_ocr", False) & F.col("error").isNull()
        languages = F.col("ocr_languages") if "ocr_languages" in images.columns else F.array(F.lit("eng"))
        rows = rows.withColumn(said, ocr.recognised(F.when(asked, F.col("content")), languages)).withColumn(tsv, F.col(said)["tsv"])
        rows = ocr.with_lines(rows, tsv, found)
        none = F.array().cast(ocr.LINES)
        text = F.when(asked, F.struct(F.col(tsv).isNotNull().alias("available"), F.coalesce(ocr.shown(F.col(found)), none).alias("lines"), F.col(said)["skipped_reason"].alias("skipped_reason")))
        added += [said, tsv, found]
    return staged(rows, twin=F.when(F.col("error").isNull(), twin(profile, wanted, F.col(fields), text, F.col(tree) if tree else None))).drop(*added)


def twin(profile: str, wanted: Column, fields: Column, text: Column | None = None, tree: Column | None = None) -> Column:
    """The record from the columns path, probe and region_evidence, the metadata fields, and recognised text.

    ``tree`` is struct<json, had_gps> of fields that may hold objects, redacted; without it no value is an object.
    """
    p, region = F.col("probe"), F.col("region_evidence")
    present = F.size(fields) > 0
    clean, had_gps = meta.redact_flat(fields)
    shown_fields, had_gps = (meta.metadata_json(clean), had_gps) if tree is None else (tree["json"], tree["had_gps"])
    none = F.array().cast("array<string>")
    warnings = F.concat(
        F.array(F.concat(F.lit("Decode route: "), p["route"], F.lit(" (source hash "), F.substring(p["source_hash"], 1, 12), F.lit("…)."))),
        F.when(~wanted, none).when(present, meta.trust_warnings(fields, had_gps)).otherwise(F.array(F.lit(NO_METADATA[profile]))),
        F.when(region.isNull(), none).otherwise(F.array(F.concat(F.lit("Region evidence: "), region["route"], F.lit(" (hash "), F.substring(region["region_hash"], 1, 12), F.lit("…).")))),
    )
    shown = F.struct(region["bbox"].alias("bbox"), F.struct(region["width"].alias("width"), region["height"].alias("height")).alias("dimensions"), region["region_hash"].alias("region_hash"), region["pixel_hash"].alias("pixel_hash"), region["mime"].alias("mime"), region["route"].alias("route"), F.when(region["resized"], True).alias("resized"), region["image_base64"].alias("image_base64"))
    orientation = [F.element_at(fields, F.lit("Orientation")).try_cast("int").alias("orientation")] if profile == "legacy" else []
    return F.struct(
        basename(F.col("path")).alias("filename"), p["mime"].alias("mime"), F.struct(p["width"].alias("width"), p["height"].alias("height")).alias("dimensions"), *orientation, p["has_alpha"].alias("has_alpha"), p["color_type"].alias("color_space"),
        F.when(wanted & present, shown_fields).alias("metadata"), F.when(region.isNotNull(), shown).alias("region_evidence"), *([text.alias("ocr")] if text is not None else []), warnings.alias("trust_warnings"),
    )


def envelope(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`read_image` with an evidence envelope around the twin; null where there is an error."""
    p, t, path = F.col("probe"), F.col("twin"), F.col("path")
    stamp = F.concat(F.unix_timestamp().cast("string"), F.lit("Z"))
    body = F.struct(
        path.alias("subject"), path.alias("source"), p["source_hash"].alias("sourceHash"), F.struct(stamp.alias("indexedAt"), F.lit(False).alias("stale")).alias("freshness"),
        F.struct(path.alias("path"), p["mime"].alias("detectedFormat")).alias("locator"), F.struct(p["route"].alias("sniff"), F.lit("read_image").alias("delegation")).alias("route"),
        F.lit("deterministic").alias("confidence"), t["trust_warnings"].alias("warnings"), F.array(*map(F.lit, NEXT_ACTIONS)).alias("nextActions"),
        F.struct(F.lit(CONTRACT).alias("contract_version"), path.alias("source_path"), t["mime"].alias("detected_format"), F.lit("read_image").alias("delegated_tool"), F.lit("sightframe").alias("reader_package"), F.lit(VERSION).alias("reader_contract_version")).alias("delegation"),
        F.struct(F.lit(CONTRACT).alias("contract_version"), F.lit(READ_ROUTE).alias("extract_route"), p["route"].alias("decode_route"), F.lit("local").alias("launch_source"), F.lit("sightframe").alias("reader_package"), F.lit(ENGINE).alias("engine")).alias("routing"),
        t.alias("result"),
    )
    return rows.withColumn("envelope", F.when(t.isNotNull(), body))


def answer(requests: DataFrame, profile: str = "shipped") -> DataFrame:
    """One JSON answer per request (tool, input): ``{"status": "ok", ...}`` or an error with code and next action.

    The ``legacy`` profile reads options strictly and follows links in paths.
    """
    rows = parse_options(requests)
    if profile == "legacy":
        rows = resolve_paths(rows.withColumn("fault", F.coalesce(strict_error(F.col("input")), "fault")))
    rows = read_requested(rows).withColumn("error", F.coalesce("fault", "error"))
    unknown = F.when(tool_route(F.col("tool")).isNull(), error(UNSUPPORTED_TOOL, F.concat(F.lit("Unsupported tool: "), F.coalesce("tool", F.lit("null")))))
    missing = F.when((F.col("tool") == "crop_region") & F.col("region").isNull(), error(INVALID_PARAMS, "region is required"))
    rows = staged(rows, error=first_error(unknown, F.col("fault"), missing, F.col("error")), region=F.when(F.col("tool") != "image_probe", F.col("region")))
    rows = envelope(read_image(rows, profile))
    base = [F.lit("ok").alias("status"), F.lit(ENGINE).alias("engine"), F.lit(VERSION).alias("version")]
    good = (
        F.when(F.col("tool") == "image_probe", F.to_json(F.struct(*base, "probe")))
        .when(F.col("tool") == "crop_region", F.to_json(F.struct(*base, "region_evidence")))
        .otherwise(F.to_json(F.struct(*base, F.lit(READ_ROUTE).alias("route"), "twin", "envelope")))
    )
    hint = F.when(F.col("error.message") == "path is required", HINTS["path"]).when(F.col("error.message").startswith("region"), HINTS["region"]).when(F.col("tool") == "crop_region", HINTS["crop_region"]).otherwise(HINTS["image_probe"])
    bad = F.to_json(F.struct(F.lit("error").alias("status"), F.col("error.code").alias("code"), F.col("error.message").alias("message"), hint.alias("next_action")))
    return rows.withColumn("answer", F.when(F.col("error").isNull(), good).otherwise(bad)).select(*requests.columns, "answer")


__all__ = ["answer", "envelope", "parse_options", "read_image", "twin"]
