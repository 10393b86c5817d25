"""Queries over the driver's tables, and the same in DuckDB's SQL.

The tables hold no images, so each query first writes columns into bytes, JSON or tables of words and then applies an
operator; the SQL computes the answer from the columns and never sees the bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import errors, exif, metadata, pixels, region, sniff, sql
from .operators import crop as crop_op
from .operators import diagnostics, exif_dedup, ocr
from .operators import probe as probe_op
from .plans import read
from .sources.images import read_requested, size_error

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` in four partitions for each core: a table of small rows is one file of a few splits, and much is done for each row."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _be(x: Column, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * n, "0"))


def _le(x: Column, n: int) -> Column:
    x = x.cast("long")
    return F.concat(*(_be(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255).cast("long")), 1) for i in range(n)))


def _raw(b: bytes) -> Column:
    return F.lit(b)


def _png_header(w: Column, h: Column, color: Column) -> Column:
    return F.concat(_raw(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"), _be(w, 4), _be(h, 4), _raw(b"\x08"), _be(color, 1), _raw(b"\0" * 7))


def _facts(images: DataFrame, key: str) -> DataFrame:
    p = probe_op.probe(images)
    return p.select(key, *(F.col(f"probe.{c}").alias(c) for c in ("format", "mime", "width", "height", "pixel_count", "has_alpha", "color_type", "file_size")), F.col("error.code").alias("error_code"))


def _facts_sql(key: str, table: str, fmt: str, w: str, h: str, alpha: str, label: str, size: str) -> str:
    return f"SELECT {key}, '{fmt}' AS format, 'image/{fmt}' AS mime, ({w})::BIGINT AS width, ({h})::BIGINT AS height, (({w}) * ({h}))::BIGINT AS pixel_count, {alpha} AS has_alpha, '{label}' AS color_type, ({size})::BIGINT AS file_size, NULL::VARCHAR AS error_code FROM {table}"


@_query(_facts_sql("p_partkey", "part", "png", "p_partkey + 1", "p_size", "p_partkey % 5 >= 3", "rgba-capable", "33"))
def probe_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    color = F.get(F.array(*map(F.lit, (0, 2, 3, 4, 6))), (F.col("p_partkey") % 5).cast("int"))
    return _facts(_table(spark, sf_dir, "part").select("p_partkey", _png_header(F.col("p_partkey") + 1, F.col("p_size"), color).alias("content")), "p_partkey")


@_query(_facts_sql("c_custkey", "customer", "gif", "c_custkey % 65535 + 1", "c_nationkey + 1", "true", "rgba-capable", "13"))
def probe_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(_raw(b"GIF89a"), _le(F.col("c_custkey") % 65535 + 1, 2), _le(F.col("c_nationkey") + 1, 2), _raw(b"\0\0\0"))
    return _facts(_table(spark, sf_dir, "customer").select("c_custkey", content.alias("content")), "c_custkey")


@_query(_facts_sql("s_suppkey", "supplier", "bmp", "s_suppkey + 1", "s_nationkey + 1", "false", "palette-or-rgb", "30"))
def probe_bmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    high = F.col("s_nationkey").cast("long") + 1
    content = F.concat(_raw(b"BM" + b"\0" * 12), _le(F.lit(40), 4), _le(F.col("s_suppkey") + 1, 4), _le(F.when(F.col("s_suppkey") % 2 == 1, 2**32 - high).otherwise(high), 4), _raw(b"\x01\0\x18\0"))
    return _facts(_table(spark, sf_dir, "supplier").select("s_suppkey", content.alias("content")), "s_suppkey")


@_query(_facts_sql("o_orderkey", "orders", "webp", "o_orderkey % 16000 + 1", "o_custkey % 16000 + 1", "true", "rgba-capable", "CASE o_orderkey % 3 WHEN 1 THEN 25 ELSE 30 END"))
def probe_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, head = F.col("o_orderkey") % 16000 + 1, F.col("o_custkey") % 16000 + 1, _raw(b"RIFF\0\0\0\0WEBP")
    big = F.concat(head, _raw(b"VP8X\x0a\0\0\0\0\0\0\0"), _le(w - 1, 3), _le(h - 1, 3))
    lossless = F.concat(head, _raw(b"VP8L\0\0\0\0\x2f"), _le((w - 1) + (h - 1) * 16384, 4))
    lossy = F.concat(head, _raw(b"VP8 \0\0\0\0\0\0\0\x9d\x01\x2a"), _le(w, 2), _le(h, 2))
    content = F.when(F.col("o_orderkey") % 3 == 0, big).when(F.col("o_orderkey") % 3 == 1, lossless).otherwise(lossy)
    return _facts(_table(spark, sf_dir, "orders").select("o_orderkey", content.alias("content")), "o_orderkey")


@_query(_facts_sql("p_partkey", "part", "jpeg", "p_partkey % 60000 + 1", "p_size", "false", "rgb", "29"))
def probe_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(_raw(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08"), _be(F.col("p_size"), 2), _be(F.col("p_partkey") % 60000 + 1, 2), _raw(b"\x03" + b"\0" * 11))
    return _facts(_table(spark, sf_dir, "part").select("p_partkey", content.alias("content")), "p_partkey")


@_query(_facts_sql("p_partkey", "part", "tiff", "p_partkey + 1", "p_size", "false", "palette-or-rgb", "38"))
def probe_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    def block(order: bytes, num: Callable[[Column, int], Column]) -> Column:
        n = lambda v, size: num(F.lit(v), size)
        return F.concat(_raw(order), n(42, 2), n(8, 4), n(2, 2), n(256, 2), n(4, 2), n(1, 4), num(F.col("p_partkey") + 1, 4), n(257, 2), n(4, 2), n(1, 4), num(F.col("p_size"), 4), n(0, 4))

    content = F.when(F.col("p_partkey") % 2 == 0, block(b"II", _le)).otherwise(block(b"MM", _be))
    return _facts(_table(spark, sf_dir, "part").select("p_partkey", content.alias("content")), "p_partkey")


@_query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'tiff' WHEN 5 THEN 'bmp' END AS format,
CASE WHEN o_orderkey % 7 IN (0, 2, 3) THEN 'rgba-capable' WHEN o_orderkey % 7 = 1 THEN 'rgb' WHEN o_orderkey % 7 IN (4, 5) THEN 'palette-or-rgb' ELSE 'unknown' END AS color_type FROM orders""")
def format_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"GIF87a", b"RIFF\x01\x02\x03\x04WEBP", b"MM\0*", b"BM", b"%PDF-1.7")
    fmt = sniff.image_format(F.col("content"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.get(F.array(*map(F.lit, heads)), (F.col("o_orderkey") % 7).cast("int")), F.col("o_orderpriority").cast("binary")).alias("content"))
    return rows.select("o_orderkey", fmt.alias("format"), sniff.color_type_of(F.coalesce(fmt, F.lit("-"))).alias("color_type"))


@_query("SELECT doc_id, sha256(text) AS source_hash FROM documents")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", sniff.content_hash(F.col("text").cast("binary")).alias("source_hash"))


@_query("SELECT doc_id, octet_length(encode(text))::BIGINT AS length, CASE WHEN octet_length(encode(text)) > 2000 THEN 'INVALID_REQUEST' END AS code, CASE WHEN octet_length(encode(text)) > 2000 THEN 'Image file exceeds maximum size of 2000 bytes.' END AS message FROM documents")
def byte_limit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("length"))
    found = size_error(F.col("length"), F.lit(2000))
    return rows.select("doc_id", "length", found["code"].alias("code"), found["message"].alias("message"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (l_partkey + 1) * (l_suppkey + 1) > 50000 THEN 'Image exceeds the 50000 pixel safety budget.' END AS message FROM lineitem")
def pixel_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = region.budget_error(F.col("l_partkey") + 1, F.col("l_suppkey") + 1, F.lit(50000), "Image")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found["message"].alias("message"))


@_query("""SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'region.x is required' WHEN 2 THEN 'region.y is required' WHEN 3 THEN 'region.width is required' WHEN 4 THEN 'region.height is required' WHEN 5 THEN 'region.x is required' END AS message,
CASE WHEN event_id % 8 IN (0, 6, 7) THEN CASE WHEN event_id % 8 = 6 THEN user_id ELSE event_id END END AS x, CASE WHEN event_id % 8 IN (0, 6, 7) THEN 7 END::BIGINT AS y, CASE WHEN event_id % 8 IN (0, 6, 7) THEN user_id END AS width, CASE WHEN event_id % 8 IN (0, 6, 7) THEN 9 END::BIGINT AS height FROM events""")
def bbox_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    big = (F.col("user_id").cast("decimal(20,0)") + F.lit(2**32).cast("decimal(20,0)")).cast("string")
    box = lambda x, y, w, h: F.concat(F.lit('{"x": '), x, F.lit(', "y": '), y, F.lit(', "width": '), w, F.lit(', "height": '), h, F.lit("}"))
    seven, nine = F.lit("7"), F.lit("9")
    k = F.col("event_id") % 8
    text = F.when(k == 1, box(F.concat(F.lit('"'), e, F.lit('"')), seven, u, nine)).when(k == 2, box(e, F.lit("-7"), u, nine)).when(k == 3, box(e, seven, F.concat(u, F.lit(".5")), nine)).when(k == 4, F.concat(F.lit('{"x": '), e, F.lit(', "y": 7, "width": '), u, F.lit("}"))).when(k == 5, F.lit("null")).when(k == 6, box(big, seven, u, nine)).otherwise(box(e, seven, u, nine))
    value, found = region.parse_region(F.try_parse_json("text"))
    return _table(spark, sf_dir, "events").select("event_id", "user_id", text.alias("text")).select("event_id", found["message"].alias("message"), *(value[f].alias(f) for f in region.FIELDS))


_BOX = "SELECT *, l_partkey % 120 AS x, l_suppkey % 90 AS y, (l_quantity::BIGINT) % 50 AS w, l_linenumber * 10 AS h FROM lineitem"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda x: x.cast("long")
    box = F.struct(c(F.col("l_partkey") % 120).alias("x"), c(F.col("l_suppkey") % 90).alias("y"), (c(F.col("l_quantity")) % 50).alias("width"), c(F.col("l_linenumber") * 10).alias("height"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box.alias("region"))


@_query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN w = 0 OR h = 0 OR x + w > 130 OR y + h > 100 THEN 'INVALID_PARAMS' END AS code,
CASE WHEN w = 0 OR h = 0 THEN 'Region width and height must be positive.' WHEN x + w > 130 OR y + h > 100 THEN 'Region (' || x || ', ' || y || ', ' || w || ', ' || h || ') exceeds image bounds (130x100).' END AS message FROM ({_BOX})""")
def bbox_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = region.region_error(F.col("region"), F.lit(130).cast("long"), F.lit(100).cast("long"))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found["code"].alias("code"), found["message"].alias("message"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s THEN greatest(floor(w * (m::DOUBLE / greatest(w, h)::DOUBLE) + 0.5), 1) ELSE w END::BIGINT AS width, CASE WHEN s THEN greatest(floor(h * (m::DOUBLE / greatest(w, h)::DOUBLE) + 0.5), 1) ELSE h END::BIGINT AS height, s AS resized
FROM (SELECT *, m > 0 AND greatest(w, h) > m AS s FROM (SELECT *, l_partkey % 400 + 1 AS w, l_suppkey % 300 + 1 AS h, l_linenumber * 20 - 20 AS m FROM lineitem))""")
def crop_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, s = region.shrunk_size((F.col("l_partkey") % 400 + 1).cast("long"), (F.col("l_suppkey") % 300 + 1).cast("long"), (F.col("l_linenumber") * 20 - 20).cast("long"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", w.alias("width"), h.alias("height"), s.alias("resized"))


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    y, x = np.mgrid[0:6, 0:8]
    for batch in batches:
        out = []
        for key in batch.column(0).to_pylist():
            one = ((key + 3 * x + 5 * y) % 256).astype(np.uint8)
            out.append(pixels.encode_png(np.stack([one, one // 2, 255 - one, np.full_like(one, 255)], 2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["p_partkey", "p_size", "content"])


def _sums(png: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pixels.decode(x)[:, :, :3].astype(int).sum((0, 1)) if x is not None else [None] * 3 for x in png], columns=["red", "green", "blue"]).astype("Int64")


@_query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS x, p_size % 4 AS y FROM part), px AS (SELECT p_partkey, x, y, (p_partkey + 3 * (x + i) + 5 * (y + j)) % 256 AS v FROM p, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(2)) AS j))
SELECT p_partkey, 3::BIGINT AS width, 2::BIGINT AS height, 6::BIGINT AS pixel_count, sum(v)::BIGINT AS red, sum(v // 2)::BIGINT AS green, sum(255 - v)::BIGINT AS blue FROM px GROUP BY p_partkey, x, y""")
def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size")).mapInArrow(_draw, "p_partkey long, p_size int, content binary")
    c = lambda x: x.cast("long")
    box = F.struct(c(F.col("p_partkey") % 5).alias("x"), c(F.col("p_size") % 4).alias("y"), F.lit(3).cast("long").alias("width"), F.lit(2).cast("long").alias("height"))
    e = F.col("region_evidence")
    done = crop_op.crop(probe_op.probe(rows.withColumn("region", box).withColumn("include_region_image", F.lit(True))))
    done = done.select("p_partkey", e["width"].alias("width"), e["height"].alias("height"), e["pixel_count"].alias("pixel_count"), F.pandas_udf(_sums, "struct<red:long,green:long,blue:long>")(F.unbase64(e["image_base64"])).alias("s"))
    return done.select("p_partkey", "width", "height", "pixel_count", "s.red", "s.green", "s.blue")


def _gray_jpeg(values: list[int], across: int, down: int) -> bytes:
    """A JPEG of flat 8 x 8 blocks with these values, row by row: a 4-bit code for each size of a difference, and 0 ends a block."""
    segment = lambda kind, body: bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body
    bits, before = [], 128
    for v in values:
        size = abs(v - before).bit_length()
        bits.append(f"{size:04b}" + (f"{v - before if v > before else v - before + (1 << size) - 1:0{size}b}" if size else "") + "0")
        before = v
    line = "".join(bits)
    line += "1" * (-len(line) % 8)
    data = int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\0")
    frame = struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + b"\x01\x11\0"
    codes = segment(0xC4, b"\0" + bytes((0, 0, 0, 9, *[0] * 12)) + bytes(range(9))) + segment(0xC4, b"\x10" + bytes((1, *[0] * 15)) + b"\0")
    return b"\xff\xd8" + segment(0xDB, b"\0" + bytes([8] * 64)) + segment(0xC0, frame) + codes + segment(0xDA, b"\x01\x01\0\0\x3f\0") + data + b"\xff\xd9"


def _drawn(made: Callable[[int], bytes]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([made(k) for k in batch.column(0).to_pylist()], pa.binary())], names=["p_partkey", "p_size", "content"])

    return run


def _cropped(spark: SparkSession, sf_dir: str, made: Callable[[int], bytes], box: Column, limit: int | None = None) -> DataFrame:
    rows = _spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size")).mapInArrow(_drawn(made), "p_partkey long, p_size int, content binary")
    rows = rows.withColumn("region", box).withColumn("include_region_image", F.lit(True)).withColumn("max_region_dimension", F.lit(limit).cast("long"))
    return crop_op.crop(probe_op.probe(rows))


def _box(x: Column, y: Column, width: int, height: int) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(width).cast("long").alias("width"), F.lit(height).cast("long").alias("height"))


@_query("""WITH p AS (SELECT p_partkey, p_partkey % 17 AS x, p_size % 9 AS y FROM part), px AS (SELECT p_partkey, (p_partkey + 40 * ((y + j) // 8 * 3 + (x + i) // 8)) % 200 + 20 AS v FROM p, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j))
SELECT p_partkey, 8::BIGINT AS width, 8::BIGINT AS height, sum(v)::BIGINT AS red, sum(v)::BIGINT AS green, sum(v)::BIGINT AS blue FROM px GROUP BY p_partkey""")
def crop_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda key: _gray_jpeg([(key + 40 * k) % 200 + 20 for k in range(6)], 3, 2)
    done, e = _cropped(spark, sf_dir, made, _box(F.col("p_partkey") % 17, F.col("p_size") % 9, 8, 8)), F.col("region_evidence")
    return done.select("p_partkey", e["width"].alias("width"), e["height"].alias("height"), F.pandas_udf(_sums, "struct<red:long,green:long,blue:long>")(F.unbase64(e["image_base64"])).alias("s")).select("p_partkey", "width", "height", "s.*")


def _ramp(key: int) -> bytes:
    x = np.broadcast_to(key % 50 + 8 * np.arange(16), (4, 16)).astype(np.uint8)
    return pixels.encode_png(np.stack([x, x, x, np.full_like(x, 255)], 2))


def _middle(png: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else int(pixels.decode(x)[:, 2:6, 0].astype(int).sum()) for x in png], dtype="Int64")


@_query("SELECT p_partkey, 8::BIGINT AS width, 2::BIGINT AS height, 16::BIGINT AS pixel_count, true AS resized, (8 * (p_partkey % 50) + 480)::BIGINT AS middle FROM part")
def crop_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, e = _cropped(spark, sf_dir, _ramp, _box(F.lit(0), F.lit(0), 16, 4), 8), F.col("region_evidence")
    return done.select("p_partkey", e["width"].alias("width"), e["height"].alias("height"), e["pixel_count"].alias("pixel_count"), e["resized"].alias("resized"), F.pandas_udf(_middle, "long")(F.unbase64(e["image_base64"])).alias("middle"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_size % 2 = 0 THEN 'INVALID_REQUEST' END AS code, CASE WHEN p_partkey % 3 = 0 OR p_size % 2 = 0 THEN 'Image dimensions must be positive.' END AS message,
CASE WHEN p_partkey % 3 > 0 AND p_size % 2 > 0 THEN (p_partkey % 3)::BIGINT END AS width FROM part""")
def zero_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = _png_header(F.col("p_partkey") % 3, F.col("p_size") % 2, F.lit(2))
    rows = probe_op.probe(_table(spark, sf_dir, "part").select("p_partkey", content.alias("content")))
    return rows.select("p_partkey", F.col("error.code").alias("code"), F.col("error.message").alias("message"), F.col("probe.width").alias("width"))


@_query("SELECT doc_id, to_base64(encode(text)) AS base64 FROM documents")
def base64_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", sniff.plain_base64(F.col("text").cast("binary")).alias("base64"))


_KEYS = ("GPSLatitude", "gpsFoo", "GeoTag", "LOCATION", "Latitude", "altitudeRef", "Coordinates", "lat", "Lat", "lon", "LON", "lng", "Make", "latency", "agps", "elevation")


@_query(f"""SELECT p_partkey, key, regexp_matches(key, '^(?i)(gps|geo|location|latitude|longitude|altitude|coordinates)') OR key IN ('lat', 'lon', 'lng') AS is_place
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN k || p_partkey % 10 ELSE k END AS key FROM (SELECT p_partkey, {list(_KEYS)}[(p_partkey % {len(_KEYS)} + 1)::BIGINT] AS k FROM part))""")
def place_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get(F.array(*map(F.lit, _KEYS)), (F.col("p_partkey") % len(_KEYS)).cast("int"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(k, (F.col("p_partkey") % 10).cast("string"))).otherwise(k).alias("key"))
    return rows.withColumn("is_place", metadata.is_place_key(F.col("key")))


@_query("""SELECT event_id, '{"GPSLatitude":' || CASE WHEN event_id % 2 = 0 THEN '["[redacted]","[redacted]","[redacted]"]' ELSE '"[redacted]"' END || ',"Lat":' || user_id || ',"Make":"' || event_type || '","lat":"[redacted]"}' AS json, true AS had_gps FROM events WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, '{"Lat":' || user_id || ',"Make":"' || event_type || '"}', false FROM events WHERE event_id % 5 = 0""")
def redact_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    make, user = F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), F.col("user_id").cast("string")
    gps = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), user, F.lit(",1.5,2]"))).otherwise("12.5")
    plain = F.create_map(F.lit("Make"), make, F.lit("Lat"), user)
    rows = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, plain).otherwise(F.map_concat(plain, F.create_map(F.lit("GPSLatitude"), gps, F.lit("lat"), F.lit("null")))).alias("m"))
    clean, had = metadata.redact_flat(F.col("m"))
    return rows.select("event_id", metadata.metadata_json(clean).alias("json"), had.alias("had_gps"))


@_query("""SELECT event_id, '{"a":{"keep":' || user_id || ',"longitude":"[redacted]"},"coordinates":[{"keep":' || props || '},"[redacted]"],"gps":' || CASE WHEN event_id % 2 = 0 THEN '"[redacted]"' ELSE '["[redacted]"]' END || ',"list":[{"lat":1}],"location":{"name":"' || event_type || '","x":{"geo":"[redacted]"}}}' AS json, true AS had_gps FROM events""")
def redact_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    gps = F.when(F.col("event_id") % 2 == 0, F.lit('{"any": 1}')).otherwise(F.lit('["any"]'))
    text = F.concat(F.lit('{"location": {"name": "'), F.col("event_type"), F.lit('", "x": {"geo": 4}}, "coordinates": [{"keep": '), F.col("props"), F.lit("}, 7], \"gps\": "), gps, F.lit(', "list": [{"lat": 1}], "a": {"longitude": null, "keep": '), F.col("user_id").cast("string"), F.lit("}}"))
    out = _table(spark, sf_dir, "events").select("event_id", metadata.redact_tree(text).alias("r"))
    squeeze = F.regexp_replace("r.json", r'\{"k":', '{"k": ')
    return out.select("event_id", squeeze.alias("json"), "r.had_gps")


@_query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Adobe Photoshop ' || p_name WHEN 1 THEN 'Paint' WHEN 2 THEN 'stable diffusion 2' WHEN 4 THEN 'darktable' WHEN 5 THEN 'gimp' END AS software, CASE WHEN p_partkey % 4 = 0 THEN 'Fake ' || p_brand ELSE p_brand END AS make, p_partkey % 10 = 0 AS gps FROM part)
SELECT p_partkey, concat_ws('|', CASE WHEN gps THEN 'GPS coordinates were present in metadata and have been redacted from the response.' END, CASE WHEN p_partkey % 6 IN (0, 1, 2) OR (p_partkey % 6 = 5 AND p_partkey % 7 <> 0) THEN 'EXIF Software field suggests possible editing or synthetic origin: "' || software || '".' END, CASE WHEN p_partkey % 4 = 0 THEN 'Camera make/model metadata looks inconsistent or synthetic.' END) AS warnings FROM p""")
def trust_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    software = F.when(k % 6 == 0, F.concat(F.lit("Adobe Photoshop "), F.col("p_name"))).when(k % 6 == 1, "Paint").when(k % 6 == 2, "stable diffusion 2").when(k % 6 == 4, "darktable")
    one = lambda name, value, when: F.when(when, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    m = F.map_concat(one("Software", quoted(software), software.isNotNull()), one("software", F.lit('"gimp"'), k % 6 == 5), one("Software", F.lit("null"), (k % 6 == 5) & (k % 7 == 0)), one("Make", quoted(F.when(k % 4 == 0, F.concat(F.lit("Fake "), F.col("p_brand"))).otherwise(F.col("p_brand"))), F.lit(True)), one("Model", quoted(F.col("p_type")), F.lit(True)))
    rows = _table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return rows.select("p_partkey", F.array_join(metadata.trust_warnings(F.col("m"), k % 10 == 0), "|").alias("warnings"))


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber > 1 THEN l_partkey::DOUBLE / (l_linenumber - 1)::DOUBLE END AS ratio, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END AS number,
CASE l_linenumber % 3 WHEN 0 THEN '[]' WHEN 1 THEN l_partkey::VARCHAR ELSE '[' || l_partkey || ',' || l_suppkey || ']' END AS whole, '"undefined:' || l_linenumber || 'B"' AS undefined FROM lineitem""")
def exif_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    many = F.slice(F.array(F.col("l_partkey"), F.col("l_suppkey")), F.lit(1), n % 3)
    number = F.when(n == 3, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", exif.ratio(F.col("l_partkey"), n - 1).alias("ratio"), exif.finite(number).alias("number"), exif.one_or_many(many).alias("whole"), exif.undefined(n).alias("undefined"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def exif_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return exif_dedup.first_wins(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


@_query("""SELECT p_partkey, p_brand AS make, p_type AS model, (p_size % 8 + 1)::VARCHAR AS orientation, p_size / 4.0::DOUBLE AS exposure, '"[redacted]"' AS gps FROM part""")
def exif_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("p_partkey"), lambda v, size: _le(F.lit(v), size)
    make, model = F.concat(F.col("p_brand").cast("binary"), _raw(b"\0\0\0\0\0")), F.concat(F.col("p_type").cast("binary"), _raw(b"\0\0\0\0\0"))
    entry = lambda tag, kind, count, value: F.concat(n(tag, 2), n(kind, 2), _le(count, 4), value)
    at = 8 + 2 + 5 * 12 + 4  # the values follow the directory of five entries
    a, b = F.length(make), F.length(model)
    gps = at + 8
    directory = F.concat(
        n(5, 2), entry(0x010F, 2, a, _le(F.lit(gps + 18) , 4)), entry(0x0110, 2, b, _le(F.lit(gps + 18) + a, 4)), entry(0x0112, 3, F.lit(1), F.concat(_le(F.col("p_size") % 8 + 1, 2), n(0, 2))),
        entry(0x829A, 5, F.lit(1), n(at, 4)), entry(0x8825, 4, F.lit(1), n(gps, 4)), n(0, 4),
    )
    block = F.concat(_raw(b"II*\0"), n(8, 4), directory, _le(F.col("p_size"), 4), n(4, 4), n(1, 2), entry(0x0001, 2, F.lit(2), _raw(b"N\0\0\0")), n(0, 4), make, model)
    content = F.when(k % 2 == 0, block).otherwise(F.concat(_raw(b"\xff\xd8\xff\xe1"), _be(F.length(block) + 8, 2), _raw(b"Exif\0\0"), block, _raw(b"\xff\xda")))
    rows = _spread(_table(spark, sf_dir, "part")).select("p_partkey", exif.exif_fields(content).alias("m"))
    clean, _ = metadata.redact_flat(F.col("m"))
    text = lambda name: F.get_json_object(F.concat(F.lit('{"v":'), clean[name], F.lit("}")), "$.v")
    return rows.select("p_partkey", text("Make").alias("make"), text("Model").alias("model"), clean["Orientation"].alias("orientation"), clean["ExposureTime"].cast("double").alias("exposure"), clean["GPSLatitudeRef"].alias("gps"))


def _word_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.when(F.col("l_suppkey") % 4 == 0, "-1").otherwise((F.col("l_partkey") % 100).cast("string"))
    s = lambda c: c.cast("string")
    cells = [F.lit("5"), F.lit("1"), (F.col("l_linenumber") % 2).cast("string"), F.lit("1"), s(F.col("l_linenumber")), F.lit("1"), s(F.col("l_partkey")), s(F.col("l_suppkey")), s(F.col("l_quantity").cast("long")), s(F.col("l_linenumber") + 5), sure, F.concat(F.lit(" "), F.col("l_returnflag"), s(F.col("l_partkey")), F.lit(" "))]
    row = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", F.concat_ws("\t", *cells).alias("text"))
    rows = F.sort_array(F.collect_list(row))["text"]
    noise = F.array(F.lit("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"), F.lit("1\t1\t0\t0\t0\t0\t0\t0\t9\t9\t-1\t"), F.lit(""))
    # Dealt by image as plain rows: lists made before that would be of one word each, and take longer to write than words.
    words = _table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    return words.groupBy(F.col("l_orderkey").alias("image_id")).agg(F.array_join(F.concat(noise, rows), "\r\n").alias("tsv"))


@_query("""WITH w AS (SELECT l_orderkey AS image_id, l_linenumber AS line, l_partkey AS l, l_suppkey AS t, (l_quantity::BIGINT) AS w, l_linenumber + 5 AS h, CASE WHEN l_suppkey % 4 = 0 THEN -1 ELSE l_partkey % 100 END AS sure, l_shipdate, l_extendedprice, l_returnflag || l_partkey AS text FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY l, t, l_extendedprice, l_shipdate) AS ord FROM w)
SELECT image_id, line::BIGINT AS line, string_agg(text, ' ' ORDER BY l, ord) AS text, min(l) AS x, min(t) AS y, (max(l + w) - min(l))::BIGINT AS width, (max(t + h) - min(t))::BIGINT AS height, avg(CASE WHEN sure >= 0 THEN sure END)::DOUBLE AS confidence FROM o GROUP BY image_id, line""")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.lines(_word_tables(spark, sf_dir)).drop("first")


@_query("""WITH w AS (SELECT l_orderkey AS image_id, l_linenumber AS line, l_partkey AS l, l_suppkey AS t, l_shipdate, l_extendedprice, l_returnflag || l_partkey AS text FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY l, t, l_extendedprice, l_shipdate) AS ord FROM w),
x AS (SELECT image_id, line, string_agg(text, ' ' ORDER BY l, ord) AS text, min(l) AS x, min(t) AS y, min(ord) AS first FROM o GROUP BY image_id, line)
SELECT image_id, string_agg(text, '|' ORDER BY y, x, first) AS lines FROM x GROUP BY image_id""")
def line_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ocr.line_lists(_word_tables(spark, sf_dir))
    return rows.select("image_id", F.array_join(F.transform("lines", lambda v: v["text"]), "|").alias("lines"))


@_query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'UNSUPPORTED_TOOL' END AS code, CASE event_id % 4 WHEN 3 THEN -32601 END AS rpc_code, CASE WHEN event_id % 4 < 3 THEN 'core' END AS route FROM events""")
def tool_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.get(F.array(*map(F.lit, ("read_image", "image_probe", "crop_region", "read_video"))), (F.col("event_id") % 4).cast("int"))
    route = errors.tool_route(F.col("tool"))
    code = F.when(route.isNull(), errors.UNSUPPORTED_TOOL)
    return _table(spark, sf_dir, "events").select("event_id", tool.alias("tool")).select("event_id", code.alias("code"), errors.rpc_code(code).alias("rpc_code"), route.alias("route"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'INVALID_REQUEST' END AS error_code, CASE WHEN p_partkey % 9 > 0 THEN 'f' || p_partkey || '.png' END AS filename, CASE WHEN p_partkey % 9 > 0 THEN 'image/png' END AS mime, CASE WHEN p_partkey % 9 > 0 THEN p_partkey + 1 END AS width, CASE WHEN p_partkey % 9 > 0 THEN p_size END::BIGINT AS height,
CASE WHEN p_partkey % 9 > 0 THEN 'No EXIF metadata was found in this image (XMP and IPTC are not read).' END AS warning, CASE WHEN p_partkey % 9 > 0 THEN '/in/f' || p_partkey || '.png' END AS subject, CASE WHEN p_partkey % 9 > 0 THEN 'deterministic' END AS confidence, CASE WHEN p_partkey % 9 > 0 THEN 2 END AS n_actions FROM part""")
def read_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    content = F.when(k % 9 == 0, F.lit(b"nothing")).otherwise(_png_header(k + 1, F.col("p_size"), F.lit(6)))
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/in/f"), k.cast("string"), F.lit(".png")).alias("path"), content.alias("content"))
    e, t = F.col("envelope"), F.col("twin")
    return read.envelope(read.read_image(rows)).select("p_partkey", F.col("error.code").alias("error_code"), t["filename"].alias("filename"), t["mime"].alias("mime"), t["dimensions"]["width"].alias("width"), t["dimensions"]["height"].alias("height"), F.get(t["trust_warnings"], F.lit(1)).alias("warning"), e["subject"].alias("subject"), e["confidence"].alias("confidence"), F.when(e.isNotNull(), F.size(e["nextActions"])).alias("n_actions"))


@_query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'unavailable' WHEN bool_or(event_type = 'click') THEN 'degraded' ELSE 'ready' END AS status FROM events GROUP BY user_id")
def doctor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "fail").when(F.col("event_type") == "click", "warn").otherwise("ok")
    return diagnostics.overall(_table(spark, sf_dir, "events").select("user_id", status.alias("status")), "user_id")


@_query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 1) AS n_passed, count(*) FILTER (WHERE NOT value > 1) AS n_failed, CASE WHEN count(*) FILTER (WHERE NOT value > 1) = 0 THEN 'passed' ELSE 'failed' END AS status FROM events GROUP BY event_type")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.gate_summary(_table(spark, sf_dir, "events").select("event_type", (F.col("value") > 1).alias("passed")), "event_type")


@_query("SELECT page_id, CASE WHEN regexp_extract(rtrim(url, '/'), '[^/]*$') IN ('', '.', '..') THEN 'image' ELSE regexp_extract(rtrim(url, '/'), '[^/]*$') END AS filename FROM pages")
def filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", sniff.basename(F.col("url")).alias("filename"))


@_query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'path is required' WHEN 1 THEN 'region.x is required' END AS message, CASE WHEN event_id % 4 > 0 THEN '/in/' || user_id END AS path, event_id % 4 <> 2 AS include_metadata, CASE WHEN event_id % 4 = 3 THEN 1000 ELSE 33554432 END::BIGINT AS max_file_bytes, CASE WHEN event_id % 4 = 3 THEN user_id END AS x FROM events""")
def request_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    text = (
        F.when(k == 0, '{"path": 7, "include_metadata": "no"}')
        .when(k == 1, F.concat(F.lit('{"path": "/in/'), user, F.lit('", "region": null, "max_file_bytes": "9"}')))
        .when(k == 2, F.concat(F.lit('{"path": "/in/'), user, F.lit('", "include_metadata": false}')))
        .otherwise(F.concat(F.lit('{"path": "/in/'), user, F.lit('", "max_file_bytes": 1000, "region": {"x": '), user, F.lit(', "y": 1, "width": 2, "height": 3}}')))
    )
    rows = read.parse_options(_table(spark, sf_dir, "events").select("event_id", text.alias("input")))
    return rows.select("event_id", F.col("fault.message").alias("message"), "path", "include_metadata", "max_file_bytes", F.col("region.x").alias("x"))


@_query("SELECT r_regionkey, 'INVALID_REQUEST' AS code, CASE WHEN r_regionkey % 2 = 0 THEN 'Unable to access image' ELSE 'is not a regular file.' END AS said FROM region")
def requested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("/no/such/place/"), F.col("r_name"))).otherwise("/")
    rows = read_requested(_table(spark, sf_dir, "region").select("r_regionkey", path.alias("path")))
    message = F.col("error.message")
    return rows.select("r_regionkey", F.col("error.code").alias("code"), F.when(message.startswith("Unable to access image"), "Unable to access image").otherwise(F.regexp_extract(message, "is not a regular file.$", 0)).alias("said"))


@_query("""SELECT p_partkey, p_brand AS make, (p_size % 8 + 1)::VARCHAR AS orientation, '"unknown:tag=305:type=99:count=3"' AS software FROM part""")
def exif_png_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda v, size: _le(F.lit(v), size)
    make = F.concat(F.col("p_brand").cast("binary"), _raw(b"\0\0\0\0\0"))
    entry = lambda tag, kind, count, value: F.concat(n(tag, 2), n(kind, 2), _le(count, 4), value)
    directory = F.concat(n(3, 2), entry(0x010F, 2, F.length(make), n(50, 4)), entry(0x0112, 3, F.lit(1), F.concat(_le(F.col("p_size") % 8 + 1, 2), n(0, 2))), entry(0x0131, 99, F.lit(3), n(1 << 30, 4)), n(0, 4))
    block = F.concat(_raw(b"II*\0"), n(8, 4), directory, make)
    png = F.concat(_raw(b"\x89PNG\r\n\x1a\n\0\0\0\0tEXt\0\0\0\0"), _be(F.length(block), 4), _raw(b"eXIf"), block, _raw(b"\0\0\0\0"))
    webp = F.concat(_raw(b"RIFF\0\0\0\0WEBPVP8 \x01\0\0\0\0\0EXIF"), _le(F.length(block), 4), block)
    rows = _spread(_table(spark, sf_dir, "part")).select("p_partkey", exif.exif_fields(F.when(F.col("p_partkey") % 2 == 0, png).otherwise(webp)).alias("m"))
    make = F.get_json_object(F.concat(F.lit('{"v":'), F.col("m")["Make"], F.lit("}")), "$.v")
    return rows.select("p_partkey", make.alias("make"), F.col("m")["Orientation"].alias("orientation"), F.col("m")["Software"].alias("software"))


@_query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'image/' || event_type ELSE 'image/' || upper(event_type) END AS mime FROM events")
def legacy_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    name = F.when(k == 1, F.col("event_type")).when(k == 2, F.upper("event_type")).when(F.col("event_id") % 2 == 0, "")
    return _table(spark, sf_dir, "events").select("event_id", sniff.mime_of_name(name).alias("mime"))


@_query("""SELECT event_id, 'error' AS status, CASE event_id % 6 WHEN 0 THEN 'UNSUPPORTED_TOOL' WHEN 4 THEN 'INVALID_REQUEST' WHEN 5 THEN 'INVALID_REQUEST' ELSE 'INVALID_PARAMS' END AS code,
CASE event_id % 6 WHEN 0 THEN 'Unsupported tool: read_video' WHEN 1 THEN 'path is required' WHEN 2 THEN 'region is required' WHEN 3 THEN 'region.x is required' ELSE 'Unable to access image' END AS message FROM events""")
def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, k = F.col("user_id").cast("string"), F.col("event_id") % 6
    at = F.concat(F.lit('"path": "/no/such/place/'), user, F.lit('"'))
    tool = F.get(F.array(*map(F.lit, ("read_video", "read_image", "crop_region", "read_image", "image_probe", "read_image"))), k.cast("int"))
    body = (
        F.when(k == 1, F.concat(F.lit('{"region": {"path": 1, "x": 1, "y": 2, "width": 3, "height": '), user, F.lit('}, "max_pixels": "9"}')))
        .when(k == 3, F.concat(F.lit('{"region": {"x": "1", "inner": {"x": 1}}, '), at, F.lit("}")))
        .when(k == 5, F.concat(F.lit(r'{"note": "\"path\": 7", "region": {"path": 1, "x": 1, "y": 1, "width": 1, "height": 1}, '), at, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), at, F.lit("}")))
    )
    rows = read.answer(_table(spark, sf_dir, "events").select("event_id", tool.alias("tool"), body.alias("input")))
    value = lambda name: F.get_json_object("answer", f"$.{name}")
    return rows.select("event_id", value("status").alias("status"), value("code").alias("code"), F.regexp_replace(value("message"), "^(Unable to access image).*$", "$1").alias("message"))


@_query("""SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'path must be a non-empty string' WHEN 2 THEN 'include_ocr must be a boolean' WHEN 3 THEN 'region.width must be a whole number' WHEN 4 THEN 'max_region_dimension must be a positive integer'
WHEN 5 THEN 'ocr_languages must be an array of non-empty strings' WHEN 7 THEN 'path must be a non-empty string' END AS message FROM events""")
def strict_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    texts = ["{}", '{"path": ""}', '{"path": "/a", "include_ocr": "yes"}', '{"path": "/a", "region": {"x": 0, "y": 0, "width": 0, "height": 1}}', '{"path": "/a", "max_region_dimension": 0}',
             '{"path": "/a", "ocr_languages": ["eng", ""]}', '{"path": "/a", "include_metadata": false, "region": {"x": 1, "y": 2, "width": 3, "height": 4}, "ocr_languages": []}', "not json"]
    text = F.get(F.array(F.concat(F.lit('{"path": "/in/'), user, F.lit('"}')), *map(F.lit, texts[1:])), (F.col("event_id") % 8).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", read.strict_error(text)["message"].alias("message"))


@_query("""SELECT p_partkey, 'png' AS format, 'image/png' AS mime, (p_partkey + 1)::BIGINT AS width, p_size::BIGINT AS height, CASE WHEN p_partkey % 4 = 0 OR p_size % 4 = 0 THEN 'Region width and height must be positive.'
WHEN 2 + p_partkey % 4 > p_partkey + 1 OR 1 + p_size % 4 > p_size THEN 'Region (2, 1, ' || p_partkey % 4 || ', ' || p_size % 4 || ') exceeds image bounds (' || p_partkey + 1 || 'x' || p_size || ').' END AS fault,
CASE WHEN greatest(p_partkey + 1, p_size) > 10 THEN greatest(floor((p_partkey + 1) * (10::DOUBLE / greatest(p_partkey + 1, p_size)::DOUBLE) + 0.5), 1) ELSE p_partkey + 1 END::BIGINT AS shrunk,
'["[redacted]","[redacted]"]' AS gps, '"' || p_brand || '"' AS make, true AS had_place FROM part""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query in SQL alone, by the functions of :mod:`.functions.sql`."""
    sql.register(spark)
    return spark.sql(
        """WITH images AS (SELECT p_partkey, p_size, p_brand, unhex(concat('89504E470D0A1A0A0000000D49484452', lpad(hex(p_partkey + 1), 8, '0'), lpad(hex(p_size), 8, '0'), '080600000000000000')) AS content FROM parquet.`{path}`),
        sized AS (SELECT *, png_size(content) AS size, map('gpsPlace', '[1,2]', 'Make', concat('"', p_brand, '"')) AS fields FROM images)
        SELECT p_partkey, image_format(content) AS format, image_mime(content) AS mime, size.width, size.height, region_fault(2, 1, p_partkey % 4, p_size % 4, size.width, size.height) AS fault,
        shrunk_side(size.width, size.width, size.height, 10) AS shrunk, redact_fields(fields)['gpsPlace'] AS gps, redact_fields(fields)['Make'] AS make, has_place(fields) AS had_place FROM sized""".replace("{path}", f"{sf_dir}/part.parquet")
    )
