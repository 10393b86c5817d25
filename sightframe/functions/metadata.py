"""Redaction of places in image metadata, and warnings about where an image may come from.

Metadata is a map from tag to the JSON text of its value; :func:`redact_tree` takes whole JSON objects.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of keys that tell a place, in any case, and whole keys that do.
PLACE_PREFIXES = ("gps", "geo", "location", "latitude", "longitude", "altitude", "coordinates")
PLACE_KEYS = ("lat", "lon", "lng")
#: Parts of the software's name, and of the camera's, that raise a warning.
EDITORS = ("photoshop", "gimp", "ai", "generative", "midjourney", "stable diffusion")
ODD_CAMERAS = ("unknown", "fake", "synthetic")
REDACTED = "[redacted]"
#: Texts of the warnings; the software's name stands between the two parts of the second.
GPS_WARNING = "GPS coordinates were present in metadata and have been redacted from the response."
SOFTWARE_WARNING = ('EXIF Software field suggests possible editing or synthetic origin: "', '".')
CAMERA_WARNING = "Camera make/model metadata looks inconsistent or synthetic."

_PLACE = "^(?i)(" + "|".join(PLACE_PREFIXES) + ")"


def is_place_key(key: Column) -> Column:
    return key.rlike(_PLACE) | key.isin(*PLACE_KEYS)


def redact_flat(metadata: Column) -> tuple[Column, Column]:
    """The map with places redacted, and whether it had any. Arrays keep their length."""
    hidden = F.lit(json.dumps(REDACTED))
    many = lambda v: F.concat(F.lit("["), F.array_join(F.array_repeat(hidden, F.json_array_length(v)), ","), F.lit("]"))
    clean = F.transform_values(metadata, lambda k, v: F.when(~is_place_key(k), v).when(v.startswith("["), many(v)).otherwise(hidden))
    return clean, F.exists(F.map_keys(metadata), is_place_key)


def _is_place(key: str) -> bool:
    return key.lower().startswith(PLACE_PREFIXES) or key in PLACE_KEYS


def redact(tree: dict) -> tuple[dict, bool]:
    """A copy of a JSON object without places, and whether it had any.

    A value under a key that tells a place is redacted: arrays item by item, objects by these rules again, and an object
    under ``gps`` as a whole. Arrays under other keys are left as they are.
    """
    out, had = {}, False
    for key, value in tree.items():
        if _is_place(key):
            had = True
            out[key] = REDACTED if key.lower() == "gps" and isinstance(value, dict) else _hide(value)
        elif isinstance(value, dict):
            out[key], inner = redact(value)
            had |= inner
        else:
            out[key] = value
    return out, had


def _hide(value: object) -> object:
    if isinstance(value, list):
        return [_hide(x) for x in value]
    return redact(value)[0] if isinstance(value, dict) else REDACTED


def _redact_all(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        try:
            tree = json.loads(t) if t is not None else None
        except ValueError:
            tree = None
        rows.append((None, None) if not isinstance(tree, dict) else (lambda r: (json.dumps(r[0], sort_keys=True, separators=(",", ":"), ensure_ascii=False), r[1]))(redact(tree)))
    return pd.DataFrame(rows, columns=["json", "had_gps"])


def redact_tree(text: Column) -> Column:
    """struct<json, had_gps> for the JSON text of an object; keys come out sorted. Null where it isn't one."""
    return F.pandas_udf(_redact_all, "struct<json:string,had_gps:boolean>")(text)


def _string(metadata: Column, key: str) -> Column:
    """The string under ``key``, or under its lower case where the key is not there at all; null if it isn't a string."""
    raw = F.when(F.map_contains_key(metadata, key), F.element_at(metadata, F.lit(key))).otherwise(F.element_at(metadata, F.lit(key.lower())))
    return F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))


def trust_warnings(metadata: Column, had_gps: Column) -> Column:
    """Warnings from the metadata as it was, in order; an empty array if there are none."""
    software, make, model = (_string(metadata, k) for k in ("Software", "Make", "Model"))
    edited = F.when(software.rlike("(?i)" + "|".join(EDITORS)), F.concat(F.lit(SOFTWARE_WARNING[0]), software, F.lit(SOFTWARE_WARNING[1])))
    odd = F.when(F.concat(make, F.lit(" "), model).rlike("(?i)" + "|".join(ODD_CAMERAS)), F.lit(CAMERA_WARNING))
    return F.array_compact(F.array(F.when(had_gps, F.lit(GPS_WARNING)), edited, odd))


def metadata_json(metadata: Column) -> Column:
    """The map as one JSON object with sorted keys."""
    pairs = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(F.regexp_replace(F.to_json(F.array(e["key"])), r"^\[|\]$", ""), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
