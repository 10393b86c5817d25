"""Format, size and labels of an image from its first bytes, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stages import let

FORMATS = ("png", "jpeg", "gif", "webp", "tiff", "bmp")


def _bytes(content: Column, start: int, n: int) -> Column:
    return F.substring(content, start + 1, n)


def big_endian(content: Column, start: int, n: int) -> Column:
    """The unsigned number in n bytes from ``start`` (from 0)."""
    return F.conv(F.hex(_bytes(content, start, n)), 16, 10).cast("long")


def little_endian(content: Column, start: int, n: int) -> Column:
    turned = lambda h: F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))))
    return F.conv(let(F.hex(_bytes(content, start, n)), turned), 16, 10).cast("long")


def image_format(content: Column) -> Column:
    """One of FORMATS by the magic bytes, or null."""
    starts = lambda magic: _bytes(content, 0, len(magic)) == F.lit(magic)
    return (
        F.when(starts(b"\x89PNG\r\n\x1a\n"), "png")
        .when(starts(b"\xff\xd8\xff"), "jpeg")
        .when(starts(b"GIF87a") | starts(b"GIF89a"), "gif")
        .when(starts(b"RIFF") & (_bytes(content, 8, 4) == F.lit(b"WEBP")), "webp")
        .when(starts(b"II*\0") | starts(b"MM\0*"), "tiff")
        .when(starts(b"BM"), "bmp")
    )


def mime_of(fmt: Column) -> Column:
    return F.concat(F.lit("image/"), fmt)


def mime_of_name(name: Column) -> Column:
    """MIME type of any format's name, as the legacy profile tells it; without a name it is a stream of bytes."""
    return F.coalesce(mime_of(F.when(name != "", name)), F.lit("application/octet-stream"))


def color_type_of(fmt: Column) -> Column:
    """A label by format, not by pixels."""
    return F.when(fmt.isin("png", "webp", "gif"), "rgba-capable").when(fmt == "jpeg", "rgb").when(fmt.isin("tiff", "bmp"), "palette-or-rgb").otherwise("unknown")


def has_alpha(content: Column, fmt: Column) -> Column:
    """For PNG by the colour type in its header; WebP and GIF always may; others never."""
    png = (F.length(content) > 25) & _bytes(content, 25, 1).isin(F.lit(b"\x04"), F.lit(b"\x06"))
    return F.when(fmt == "png", png).otherwise(fmt.isin("webp", "gif"))


def _hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


#: Segments that are looked at in the first two rounds of the walk over a JPEG image, and in each further one.
_ROUNDS, _ROUND = (16, 1024), 4096


def jpeg_size(content: Column) -> Column:
    """struct<width, height> from the first frame header of a JPEG image; null where a walk over its segments finds none.

    The walk is a fold that carries the place of the next marker, -1 where there is none, and -2 minus the place of a frame
    header. Most images are done in the first short round; an image that isn't gets as many rounds as it may have
    segments, and those that follow the last segment cost nothing.
    """

    def after(at: Column, head: Column) -> Column:
        kind = F.substring(head, 3, 2)
        size = F.when(kind.rlike("^(01|D[0-8])$"), 0).otherwise(_hex_number(F.substring(head, 5, 4)))
        return (
            F.when((F.length(head) < 18) | ~head.startswith("FF"), -1).when(kind == "FF", at + 1)
            .when(kind.rlike("^C[0-35-79-BD-F]$"), -2 - at).otherwise((at + 2 + size).cast("int"))
        )

    step = lambda at, _: F.when(at < 0, at).otherwise(let(F.hex(F.substring(content, at + 1, F.lit(9))), lambda head: after(at, head)))
    rounds = F.concat(F.array(*map(F.lit, _ROUNDS)), F.array_repeat(F.lit(_ROUND), (F.length(content) / _ROUND).cast("int") + 1))
    walk = F.aggregate(rounds, F.lit(2), lambda at, n: F.when(at < 0, at).otherwise(F.aggregate(F.sequence(F.lit(1), n), at, step)))
    sides = lambda h: F.struct(_hex_number(F.substring(h, 5, 4)).alias("width"), _hex_number(F.substring(h, 1, 4)).alias("height"))
    return let(walk, lambda at: F.when(at < -1, let(F.hex(F.substring(content, 4 - at, F.lit(4))), sides)))


def tiff_size(content: Column) -> Column:
    """struct<width, height> from the first directory of a TIFF image, the last of several values; null where it is broken."""
    digits = lambda start, n: F.hex(F.substring(content, (start + 1).cast("int"), F.lit(n)))
    turned = lambda x: F.concat(*(F.substring(x, k, 2) for k in (7, 5, 3, 1)))
    number = lambda x, little: _hex_number(let(x, lambda d: F.when(little, turned(d)).otherwise(d)))
    first = lambda little: F.struct(little.alias("little"), number(digits(F.lit(4), 4), little).alias("at"))
    directory = lambda v: F.struct(v["little"].alias("little"), v["at"].alias("at"), F.when(v["at"] + 2 <= F.length(content), number(digits(v["at"], 2), v["little"])).alias("n"))

    def size(v: Column) -> Column:
        entries = F.transform(F.sequence(F.lit(0), (v["n"] - 1).cast("int")), lambda i: digits(v["at"] + 2 + 12 * i, 12))
        tags = F.array(F.when(v["little"], "0001").otherwise("0100"), F.lit("0101"))  # 256 and 257
        found = lambda all_: F.transform(tags, lambda t: value(F.try_element_at(F.filter(all_, lambda e: e.startswith(t)), F.lit(-1))))
        length = lambda e: F.when(F.substring(e, 5, 4) == F.when(v["little"], "0300").otherwise("0003"), 4).otherwise(8)
        value = lambda e: F.when(F.length(e) >= 16 + length(e), number(F.substring(e, F.lit(17), length(e)), v["little"]))
        there = (v["n"] > 0) & (v["at"] + 12 * v["n"] - 2 <= F.length(content))
        pair = lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.struct(p[0].alias("width"), p[1].alias("height")))
        return F.when(there, let(let(entries, found), pair))

    return let(let(let(_bytes(content, 0, 2) == F.lit(b"II"), first), directory), size)


def dimensions(content: Column, fmt: Column) -> Column:
    """struct<width, height>, null where the header is too short or broken. EXIF orientation is not applied."""
    pair = lambda w, h: F.struct(w.cast("long").alias("width"), h.cast("long").alias("height"))
    long_enough = lambda n: F.length(content) >= n
    return (
        F.when((fmt == "png") & long_enough(24), pair(big_endian(content, 16, 4), big_endian(content, 20, 4)))
        .when((fmt == "gif") & long_enough(10), pair(little_endian(content, 6, 2), little_endian(content, 8, 2)))
        .when(fmt == "bmp", let(F.hex(_bytes(content, 0, 26)), _bmp_size))
        .when(fmt == "webp", let(F.hex(_bytes(content, 0, 30)), _webp_size))
        .when(fmt == "jpeg", jpeg_size(content))
        .when(fmt == "tiff", tiff_size(content))
    )


def _sides(values: Column) -> Column:
    return F.when(values.isNotNull(), F.struct(values[0].alias("width"), values[1].alias("height")))


def _little(head: Column, n: int, starts: tuple[int, int]) -> Column:
    """The little-endian numbers in n bytes from the two places in a head in hexadecimal digits."""
    return F.transform(F.array(*map(F.lit, starts)), lambda at: _hex_number(F.concat(*(F.substring(head, 2 * at + 2 * i + 1, F.lit(2)) for i in reversed(range(n))))))


def _bmp_size(head: Column) -> Column:
    """Sides of a BMP by its first 26 bytes; a negative one says that rows go down."""
    signed = F.transform(_little(head, 4, (18, 22)), lambda v: F.when(v >= 2**31, 2**32 - v).otherwise(v))
    old = F.substring(head, 29, 8) == "0C000000"
    return let(F.when(F.length(head) == 52, F.when(old, _little(head, 2, (18, 20))).otherwise(signed)), _sides)


def _webp_size(head: Column) -> Column:
    """Sides of a WebP by its first 30 bytes and the kind of its first chunk."""
    kind, full = F.substring(head, 25, 8), F.length(head) == 60
    packed = F.transform(_little(head, 4, (21, 21)), lambda v, i: F.when(i == 0, v).otherwise(F.shiftright(v, 14)) % 0x4000 + 1)
    values = (
        F.when((kind == _hex(b"VP8X")) & full, F.transform(_little(head, 3, (24, 27)), lambda v: v + 1))
        .when((kind == _hex(b"VP8L")) & (F.length(head) >= 50), packed)
        .when((kind == _hex(b"VP8 ")) & full, F.transform(_little(head, 2, (26, 28)), lambda v: v % 0x4000))
    )
    return let(values, _sides)


def _hex(magic: bytes) -> str:
    return magic.hex().upper()


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def plain_base64(content: Column) -> Column:
    """Standard base64 with padding and without line ends."""
    return F.regexp_replace(F.base64(content), "[\r\n]", "")


def basename(path: Column) -> Column:
    """The last part of a path, or ``image`` where there is none."""
    last = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    return F.when(path.isNull() | last.isin("", ".", ".."), "image").otherwise(last)
