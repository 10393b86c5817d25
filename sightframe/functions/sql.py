"""The library's expressions as SQL functions, for queries that are written in SQL alone.

Their bodies are SQL, so Catalyst puts them in place of the call and optimises them with the query; none runs Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .metadata import PLACE_KEYS, PLACE_PREFIXES, REDACTED

_PLACE = "(?i)^(" + "|".join(PLACE_PREFIXES) + ")"
_HIDDEN = f"'\"{REDACTED}\"'"

#: Name, parameters, type of the result, body.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "image_format": (
        "content BINARY",
        "STRING",
        """CASE WHEN substring(content, 1, 8) = X'89504E470D0A1A0A' THEN 'png' WHEN substring(content, 1, 3) = X'FFD8FF' THEN 'jpeg'
        WHEN substring(content, 1, 6) IN (X'474946383761', X'474946383961') THEN 'gif' WHEN substring(content, 1, 4) = X'52494646' AND substring(content, 9, 4) = X'57454250' THEN 'webp'
        WHEN substring(content, 1, 4) IN (X'49492A00', X'4D4D002A') THEN 'tiff' WHEN substring(content, 1, 2) = X'424D' THEN 'bmp' END""",
    ),
    "image_mime": ("content BINARY", "STRING", "'image/' || image_format(content)"),
    "big_endian": ("content BINARY, start INT, n INT", "BIGINT", "CAST(conv(hex(substring(content, start + 1, n)), 16, 10) AS BIGINT)"),
    "png_size": ("content BINARY", "STRUCT<width BIGINT, height BIGINT>", "CASE WHEN image_format(content) = 'png' AND length(content) >= 24 THEN named_struct('width', big_endian(content, 16, 4), 'height', big_endian(content, 20, 4)) END"),
    "content_hash": ("content BINARY", "STRING", "sha2(content, 256)"),
    "is_place_key": ("name STRING", "BOOLEAN", f"rlike(name, '{_PLACE}') OR name IN ({', '.join(repr(k) for k in PLACE_KEYS)})"),
    "redact_fields": (
        "fields MAP<STRING, STRING>",
        "MAP<STRING, STRING>",
        f"""transform_values(fields, (k, v) -> CASE WHEN NOT (rlike(k, '{_PLACE}') OR k IN ({', '.join(repr(k) for k in PLACE_KEYS)})) THEN v
        WHEN startswith(v, '[') THEN '[' || array_join(array_repeat({_HIDDEN}, json_array_length(v)), ',') || ']' ELSE {_HIDDEN} END)""",
    ),
    "has_place": ("fields MAP<STRING, STRING>", "BOOLEAN", f"exists(map_keys(fields), k -> rlike(k, '{_PLACE}') OR k IN ({', '.join(repr(k) for k in PLACE_KEYS)}))"),
    "region_fault": (
        "x BIGINT, y BIGINT, width BIGINT, height BIGINT, image_width BIGINT, image_height BIGINT",
        "STRING",
        """CASE WHEN width = 0 OR height = 0 THEN 'Region width and height must be positive.' WHEN least(x + width, 4294967295) > image_width OR least(y + height, 4294967295) > image_height
        THEN format_string('Region (%d, %d, %d, %d) exceeds image bounds (%dx%d).', x, y, width, height, image_width, image_height) END""",
    ),
    "shrunk_side": (
        "side BIGINT, width BIGINT, height BIGINT, most BIGINT",
        "BIGINT",
        "CASE WHEN most > 0 AND greatest(width, height) > most THEN CAST(greatest(floor(side * (CAST(most AS DOUBLE) / CAST(greatest(width, height) AS DOUBLE)) + 0.5D), 1) AS BIGINT) ELSE side END",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Create all of FUNCTIONS as temporary functions of the session, and tell their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
