"""EXIF fields of JPEG, PNG, WebP and TIFF images, by the public EXIF and TIFF specifications.

Values become JSON fragments: text as a string, numbers as they are, one number alone or several as an array.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag numbers and names of the EXIF specification, for the main, EXIF and GPS directories.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010E: "ImageDescription",
    0x010F: "Make", 0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts",
    0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration", 0x0128: "ResolutionUnit", 0x012D: "TransferFunction", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling",
    0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram",
    0x8824: "SpectralSensitivity", 0x8827: "PhotographicSensitivity", 0x8828: "OECF", 0x8830: "SensitivityType", 0x8831: "StandardOutputSensitivity",
    0x8832: "RecommendedExposureIndex", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime",
    0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue",
    0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode",
    0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea", 0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubSecTime",
    0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0xA000: "FlashpixVersion", 0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension",
    0xA004: "RelatedSoundFile", 0xA20B: "FlashEnergy", 0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit",
    0xA214: "SubjectLocation", 0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA302: "CFAPattern",
    0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType",
    0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID",
    0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
}
GPS_TAGS = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp",
    8: "GPSSatellites", 9: "GPSStatus", 10: "GPSMeasureMode", 11: "GPSDOP", 12: "GPSSpeedRef", 13: "GPSSpeed", 14: "GPSTrackRef", 15: "GPSTrack", 16: "GPSImgDirectionRef",
    17: "GPSImgDirection", 18: "GPSMapDatum", 19: "GPSDestLatitudeRef", 20: "GPSDestLatitude", 21: "GPSDestLongitudeRef", 22: "GPSDestLongitude", 23: "GPSDestBearingRef",
    24: "GPSDestBearing", 25: "GPSDestDistanceRef", 26: "GPSDestDistance", 27: "GPSProcessingMethod", 28: "GPSAreaInformation", 29: "GPSDateStamp", 30: "GPSDifferential",
    31: "GPSHPositioningError",
}
EXIF_DIRECTORY, GPS_DIRECTORY = 0x8769, 0x8825
#: Kinds of values: size of one, and how struct names it.
_KINDS = {1: (1, "B"), 2: (1, ""), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, ""), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I")}


def _number(x: float | None) -> object:
    return None if x is None or isinstance(x, float) and not math.isfinite(x) else x


def value_json(order: str, kind: int, count: int, raw: bytes, tag: int = 0) -> str:
    """The JSON fragment of a value's bytes."""
    if kind not in _KINDS:
        return json.dumps(f"unknown:tag={tag}:type={kind}:count={count}")
    size, code = _KINDS[kind]
    if kind == 2:
        parts = raw[: count * size].split(b"\0")
        return json.dumps("".join(p.decode("utf-8", "replace") for p in parts), ensure_ascii=False)
    if kind == 7:
        return json.dumps(f"undefined:{len(raw)}B")
    numbers: list = list(struct.unpack(order + code * count, raw[: size * count]))
    if len(code) == 2:
        numbers = [n / d if d else None for n, d in zip(numbers[::2], numbers[1::2])]
    numbers = [_number(x) for x in numbers]
    return json.dumps(numbers[0] if len(numbers) == 1 else numbers)


def _entries(data: bytes, order: str, start: int) -> Iterator[tuple[str, str]]:
    """Names and fragments of a directory's values, then of the directories that it names, each once."""
    open_: list[tuple[int, dict[int, str]]] = [(start, TAGS)]
    seen: set[int] = set()
    while open_:
        at, tags = open_.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        deeper: list[tuple[int, dict[int, str]]] = []
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            place = at + 10 + 12 * i
            size = _KINDS.get(kind, (0, ""))[0] * count
            if tag in (EXIF_DIRECTORY, GPS_DIRECTORY):
                deeper.append((struct.unpack_from(order + "I", data, place)[0], TAGS if tag == EXIF_DIRECTORY else GPS_TAGS))
                continue
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            raw = data[place : place + size]
            if tag in tags and len(raw) == size:
                yield tags[tag], value_json(order, kind, count, raw, tag)
        open_ += reversed(deeper)


def _block(data: bytes) -> bytes | None:
    """The TIFF block with the EXIF data of an image file."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            (size,) = struct.unpack_from(">H", data, at + 2)
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            (size,) = struct.unpack_from(">I", data, at)
            if data[at + 4 : at + 8] == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            (size,) = struct.unpack_from("<I", data, at + 4)
            if data[at : at + 4] == b"EXIF":
                return data[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0")
            at += 8 + size + size % 2
    return None


def exif_of(data: bytes | None) -> dict[str, str]:
    """Tag to JSON fragment; the first of several values of a tag counts; empty where nothing can be read."""
    out: dict[str, str] = {}
    try:
        block = _block(data or b"")
        if block and block[:4] in (b"II*\0", b"MM\0*"):
            order = "<" if block[:2] == b"II" else ">"
            for key, value in _entries(block, order, struct.unpack_from(order + "I", block, 4)[0]):
                out.setdefault(key, value)
    except struct.error:
        pass
    return out


def _exif_all(content: pd.Series) -> pd.Series:
    return content.map(exif_of)


def exif_fields(content: Column) -> Column:
    """EXIF fields of an image; an empty map where there are none."""
    return F.pandas_udf(_exif_all, "map<string,string>")(content)


def ratio(num: Column, den: Column) -> Column:
    """A rational number, null for a zero denominator."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def one_or_many(values: Column) -> Column:
    """JSON of an array of numbers: one alone as it is, none or several as an array."""
    return F.when(F.size(values) == 1, F.regexp_replace(F.to_json(values), r"^\[|\]$", "")).otherwise(F.to_json(values))


def undefined(length: Column) -> Column:
    return F.format_string('"undefined:%dB"', length)
