"""Operators on small images made here."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightframe.functions import exif, metadata, pixels, region, sniff
from sightframe.operators import diagnostics, ocr
from sightframe.operators.crop import crop
from sightframe.operators.probe import probe
from sightframe.plans import read
from sightframe.sources import images
from sightframe.streaming.ingest import probe_stream


def png(width, height, color=6, value=200):
    if color == 6:
        return pixels.encode_png(np.full((height, width, 4), value, np.uint8))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    channels = {0: 1, 2: 3, 4: 2}[color]
    rows = (b"\0" + bytes([value]) * (width * channels)) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def rows_of(spark, contents):
    return spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)], "id int, content binary")


def test_probe(spark):
    got = {r["id"]: r for r in probe(rows_of(spark, [png(12, 8), png(3, 2, 2), b"junk", b"\x89PNG\r\n\x1a\n", None, png(3, 2)[:30].replace(b"\0\0\0\x03\0\0\0\x02", b"\0" * 8), b""])).collect()}
    assert (got[0]["probe"]["width"], got[0]["probe"]["height"], got[0]["probe"]["pixel_count"], got[0]["probe"]["format"], got[0]["probe"]["has_alpha"]) == (12, 8, 96, "png", True)
    assert got[1]["probe"]["has_alpha"] is False and got[1]["error"] is None
    for i in range(2, 7):
        assert got[i]["probe"] is None and got[i]["error"]["code"] == "INVALID_REQUEST"
    assert got[5]["error"]["message"] == "Image dimensions must be positive."


@pytest.mark.parametrize(("byte", "alpha"), [(0, False), (2, False), (3, False), (4, True), (6, True)])
def test_alpha(spark, byte, alpha):
    data = b"\x89PNG\r\n\x1a\n" + b"\0" * 17 + bytes([byte])
    assert rows_of(spark, [data]).select(sniff.has_alpha(F.col("content"), F.lit("png"))).first()[0] is alpha


def test_base64(spark):
    rows = spark.createDataFrame([("",), ("f",), ("fo",), ("foo",), ("foobar" * 40,)], "t string").select(sniff.plain_base64(F.col("t").cast("binary"))).collect()
    assert [r[0] for r in rows[:4]] == ["", "Zg==", "Zm8=", "Zm9v"] and "\n" not in rows[4][0]


def regions(spark, contents, boxes, **options):
    data = [(i, bytearray(c), b) for i, (c, b) in enumerate(zip(contents, boxes))]
    df = spark.createDataFrame(data, "id int, content binary, region struct<x:long,y:long,width:long,height:long>")
    for k, v in options.items():
        df = df.withColumn(k, F.lit(v))
    return {r["id"]: r for r in crop(probe(df)).collect()}


def test_crop(spark):
    boxes = [(4, 2, 8, 4), (0, 0, 20, 10), (10, 0, 11, 1), (0, 0, 0, 1), (2**32 - 2, 0, 8, 1), None]
    got = regions(spark, [png(20, 10)] * 6, boxes)
    assert (got[0]["region_evidence"]["width"], got[0]["region_evidence"]["height"], got[0]["region_evidence"]["pixel_count"], got[0]["region_evidence"]["image_base64"]) == (8, 4, 32, None)
    assert got[1]["error"] is None and not got[1]["region_evidence"]["resized"]
    assert {got[i]["error"]["code"] for i in (2, 3, 4)} == {"INVALID_PARAMS"}
    assert got[5]["error"] is None and got[5]["region_evidence"] is None and got[5]["content"] is not None


def test_crop_shrinks_and_budgets(spark):
    got = regions(spark, [png(40, 20)], [(0, 0, 40, 20)], max_region_dimension=10, include_region_image=True)[0]["region_evidence"]
    assert (got["width"], got["height"], got["resized"]) == (10, 5, True) and got["image_base64"]
    assert "pixel safety budget" in regions(spark, [png(40, 20)], [(0, 0, 40, 20)], max_pixels=10)[0]["error"]["message"]
    broken = png(40, 20)[:-30]
    assert regions(spark, [broken], [(0, 0, 4, 2)])[0]["error"]["message"].startswith("Failed to decode image for crop")
    assert regions(spark, [b"\xff\xd8\xff\xc0\0\x11\x08\0\x09\0\x09\x03" + b"\0" * 11], [(0, 0, 4, 2)])[0]["error"]["code"] == "INVALID_REQUEST"


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    x = np.random.default_rng(kind).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    lines, above = b"", np.zeros(21, int)
    for row in x.reshape(5, 21).astype(int):
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        lines += bytes([kind]) + bytes(((row - [0, left, above, (left + above) // 2, near][kind]) % 256).astype(np.uint8))
        above = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0" * 4
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    assert (pixels.decode(data)[:, :, :3] == x).all()


def test_bmp_and_shrink():
    body = bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    data = b"BM" + b"\0" * 8 + struct.pack("<IIiiHHI", 54, 40, 2, 2, 1, 24, 0) + b"\0" * 20 + body
    assert pixels.decode(data)[0, 0].tolist() == [9, 8, 7, 255] and pixels.decode(data)[1, 1].tolist() == [6, 5, 4, 255]
    assert (pixels.shrink(np.full((20, 40, 4), 77, np.uint8), 10, 5) == 77).all()


def test_region_json(spark):
    texts = ['{"x":1,"y":2,"width":3,"height":4}', '{"x":-1,"y":2,"width":3,"height":4}', '{"x":1,"y":"2","width":3,"height":4}', '{"x":1,"y":2}', f'{{"x":{2**32 + 5},"y":2,"width":3,"height":4}}', "null", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    value, found = region.parse_region(F.try_parse_json("t"))
    got = {r["id"]: r for r in df.select("id", value.alias("v"), found.alias("e")).collect()}
    assert tuple(got[0]["v"]) == (1, 2, 3, 4) and got[4]["v"]["x"] == 5
    assert [got[i]["e"]["message"] for i in (1, 2, 3, 5)] == ["region.x is required", "region.y is required", "region.width is required", "region.x is required"]


def test_redaction_rules():
    tree = {"coordinates": [{"lat": 1, "name": "a"}, 3], "list": [{"lat": 1}], "gps": {"a": 1}, "Lat": 5, "lat": None, "location": {"name": "x", "lon": 2}}
    out, had = metadata.redact(tree)
    hidden = metadata.REDACTED
    assert had and out == {"coordinates": [{"lat": hidden, "name": "a"}, hidden], "list": [{"lat": 1}], "gps": hidden, "Lat": 5, "lat": hidden, "location": {"name": "x", "lon": hidden}}


def test_trust_warnings(spark):
    maps = [{"Software": '"Darktable"'}, {"Software": '"MyAI Tool"'}, {"software": '"GIMP"'}, {"Software": "null", "software": '"GIMP"'}, {"Make": '"Fake"', "Model": '"One"'}, {"Make": '"Fake"'}, {}]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(maps)], "id int, m map<string,string>")
    got = [r["w"] for r in df.select("id", metadata.trust_warnings(F.col("m"), F.lit(False)).alias("w")).orderBy("id").collect()]
    assert [len(w) for w in got] == [0, 1, 1, 0, 1, 0, 0]


def test_exif_values():
    pack = lambda code, *x: struct.pack("<" + code, *x)
    assert exif.value_json("<", 5, 1, pack("II", 1, 2)) == "0.5" and exif.value_json("<", 5, 1, pack("II", 1, 0)) == "null"
    assert exif.value_json("<", 10, 1, pack("ii", -3, 2)) == "-1.5" and exif.value_json("<", 7, 3, b"abc") == '"undefined:3B"'
    assert exif.value_json("<", 3, 0, b"") == "[]" and exif.value_json("<", 11, 1, pack("f", float("nan"))) == "null"
    assert exif.value_json("<", 2, 4, b"ab\0c") == '"abc"' and exif.exif_of(b"\xff\xd8\xff\xe1\0\x08Exif") == {} and exif.exif_of(None) == {}


def test_ocr_lines(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    word = lambda block, line, left, top, conf, text: f"5\t1\t{block}\t1\t{line}\t1\t{left}\t{top}\t10\t5\t{conf}\t{text}"
    tsv = "\r\n".join([head, word(1, 1, 50, 20, 90, "b"), word(1, 1, 10, 20, 80, "a"), word(2, 1, 70, 21, -1, "c"), word(1, 2, 5, 2, "x", "top"), "5\tshort", word(1, 3, 1, 1, 5, "  "), ""])
    rows = spark.createDataFrame([(1, tsv), (2, None), (3, head)], "image_id int, tsv string")
    got = {r["image_id"]: r["lines"] for r in ocr.line_lists(rows).collect()}
    assert set(got) == {1} and [x["text"] for x in got[1]] == ["top", "a b c"] and got[1][1]["confidence"] == 85.0 and got[1][0]["confidence"] == 0.0
    assert (got[1][1]["x"], got[1][1]["y"], got[1][1]["width"], got[1][1]["height"]) == (10, 20, 70, 6)


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(png(32, 16))
    (tmp_path / ".hidden.png").write_bytes(png(4, 4))
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "big.bin").write_bytes(b"0" * 64)
    ask = lambda name, **more: json.dumps({"path": str(tmp_path / name)} | more)
    box = {"x": 2, "y": 1, "width": 8, "height": 4}
    cases = [
        ("read_image", ask("good.png"), "ok"), ("image_probe", ask(".hidden.png"), "ok"), ("image_probe", ask("empty"), "INVALID_REQUEST"), ("image_probe", ask("missing"), "INVALID_REQUEST"),
        ("image_probe", ask("big.bin", max_file_bytes=32), "INVALID_REQUEST"), ("crop_region", ask("good.png", region=box), "ok"), ("crop_region", ask("good.png"), "INVALID_PARAMS"),
        ("crop_region", ask("good.png", region={**box, "x": 90}), "INVALID_PARAMS"), ("fly", ask("good.png"), "UNSUPPORTED_TOOL"), ("image_probe", '{"path": 3}', "INVALID_PARAMS"), ("image_probe", ask(""), "INVALID_REQUEST"), ("read_image", None, "INVALID_PARAMS"),
    ]
    asked = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(cases)], "id int, tool string, input string")
    got = {r["id"]: json.loads(r["answer"]) for r in read.answer(asked).collect()}
    assert [got[i].get("code", got[i]["status"]) for i in range(len(cases))] == [c for _, _, c in cases]
    assert got[0]["twin"]["dimensions"] == {"width": 32, "height": 16} and got[0]["envelope"]["confidence"] == "deterministic" and got[5]["region_evidence"]["width"] == 8
    assert got[6]["message"] == "region is required" and got[6]["next_action"]
    requests = tmp_path / "asked"
    asked.select(F.to_json(F.struct("tool", F.from_json("input", "path string").alias("input"))).alias("value")).write.text(str(requests))
    assert images.read_json_requests(spark, str(requests)).count() == len(cases)


def test_folder_and_stream(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(5, 4))
    (tmp_path / "b.png").write_bytes(png(50, 40) * 3)
    rows = {r["path"][-5:]: r for r in images.read_folder(spark, str(tmp_path), "*.png", 200).collect()}
    assert rows["a.png"]["content"] is not None and rows["b.png"]["error"]["code"] == "INVALID_REQUEST"
    q = probe_stream(spark, str(tmp_path), "*.png").writeStream.format("memory").queryName("probes").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.sql("select probe.width from probes").collect()) == [5, 50]


def test_legacy_budget_and_diagnostics(spark):
    df = rows_of(spark, [b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 8200, 8200) + b"\x08\x06\0\0\0"]).withColumn("path", F.lit("/x/y.png"))
    assert read.read_image(df).first()["error"] is None
    assert "67108864 pixel" in read.read_image(df, "legacy").first()["error"]["message"]
    assert diagnostics.overall(diagnostics.doctor(spark)).first()[0] in ("ready", "degraded")


def test_legacy_options_paths_and_mime(spark, tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    df = spark.createDataFrame([(f"{tmp_path}/link/../link/x.png",), (None,)], "path string")
    assert [r[0] for r in images.resolve_paths(df).collect()] == [f"{tmp_path}/real/x.png", None]
    names = spark.createDataFrame([("avif",), ("PNG",), (None,)], "n string")
    assert [r[0] for r in names.select(sniff.mime_of_name(F.col("n"))).collect()] == ["image/avif", "image/PNG", "application/octet-stream"]
    texts = [(0, '{"path": "a", "max_region_dimension": 5, "include_metadata": true}'), (1, '{"path": ""}'), (2, '{"path": "a", "include_ocr": 1}'), (3, '{"path": "a", "max_region_dimension": 0}'), (4, None)]
    rows = spark.createDataFrame(texts, "id int, t string").select("id", read.strict_error(F.col("t")).alias("e")).orderBy("id").collect()
    assert [r["e"] is None for r in rows] == [True, False, False, False, False] and "boolean" in rows[2]["e"]["message"]


def test_interlaced_png_and_palette_bmp():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (11, 13, 3)).astype(np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    passes = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
    raw = b"".join(b"\0" + row.tobytes() for x0, y0, dx, dy in passes for row in x[y0::dy, x0::dx] if row.size)
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 13, 11, 8, 2, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (pixels.decode(data)[:, :, :3] == x).all()
    colors = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    for depth, index in ((4, rng.integers(0, 16, (3, 5))), (8, rng.integers(0, 16, (3, 5))), (1, rng.integers(0, 2, (3, 5)))):
        lines = b""
        for row in index[::-1]:
            bits = "".join(f"{v:0{depth}b}" for v in row)
            lines += int(bits.ljust(-(-len(bits) // 32) * 32, "0"), 2).to_bytes(-(-len(bits) // 32) * 4, "big")
        table = b"".join(bytes((b, g, r, 0)) for r, g, b in colors)
        head = struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, depth, 0, 0, 0, 0, 16, 0)
        bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 64) + head + table + lines
        assert (pixels.decode(bmp)[:, :, :3] == colors[index]).all()


def lzw(values, least, big, early):
    """Codes of LZW, without forgetting the table."""
    codes, table, width, now = [(1 << least, least + 1)], {(i,): i for i in range(1 << least)}, least + 1, ()
    size = (1 << least) + 2
    for v in values:
        if (*now, v) in table:
            now = (*now, v)
            continue
        codes.append((table[now], width))
        table[(*now, v)], size = size, size + 1
        if size + early > 1 << width:
            width += 1
        now = (v,)
    codes += [(table[now], width)]
    width += size + 1 + early > 1 << width
    codes += [((1 << least) + 1, width)]
    bits = "".join(f"{c:0{w}b}" if big else f"{c:0{w}b}"[::-1] for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8] if big else bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def test_gif_and_tiff():
    rng = np.random.default_rng(4)
    colors, index = rng.integers(0, 256, (8, 3)).astype(np.uint8), rng.integers(0, 8, (9, 14))
    for interlace in (0, 0x40):
        order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, 9, step)] if interlace else range(9)
        packed = lzw(np.concatenate([index[y] for y in order]).tolist(), 3, False, 0)
        blocks = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)) + b"\0"
        gif = b"GIF89a" + struct.pack("<HHBBB", 16, 10, 0x82, 0, 0) + colors.tobytes() + b"!\xf9\x04\x01\0\0\x05\0" + struct.pack("<BHHHHB", 0x2C, 1, 1, 14, 9, interlace) + b"\x03" + blocks + b";"
        got = pixels.decode(gif)
        assert got.shape == (10, 16, 4) and (got[0] == 0).all() and (got[1:, 1:15, 3] == np.where(index == 5, 0, 255)).all()
        assert (got[1:, 1:15, :3][index != 5] == colors[index[index != 5]]).all()
    x = rng.integers(0, 256, (7, 6, 3)).astype(np.uint8)
    x[2:5] = 7
    differences = np.diff(x.astype(np.uint8), axis=1, prepend=np.zeros((7, 1, 3), np.uint8)).astype(np.uint8)
    runs = lambda raw: b"".join(bytes([0, v]) for v in raw) + b"\x80"
    for order in "<>":
        for packing, pack, predictor in ((1, bytes, 1), (8, zlib.compress, 1), (5, lambda raw: lzw(list(raw), 8, True, 1), 2), (32773, runs, 1)):
            rows = differences if predictor == 2 else x
            strips = [pack(rows[k : k + 3].tobytes()) for k in (0, 3, 6)]
            tags = [(256, 3, [6]), (257, 3, [7]), (258, 3, [8, 8, 8]), (259, 3, [packing]), (262, 3, [2]), (273, 4, None), (277, 3, [3]), (278, 3, [3]), (279, 4, [len(s) for s in strips]), (317, 3, [predictor])]
            tail = 8 + 2 + 12 * len(tags) + 4
            places, extra = [tail + 100 + sum(map(len, strips[:k])) for k in range(3)], b""
            entries = b""
            for tag, kind, values in tags:
                raw = struct.pack(f"{order}{len(values or places)}{'H' if kind == 3 else 'I'}", *(values or places))
                entries += struct.pack(order + "HHI", tag, kind, len(values or places)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", tail + len(extra)))
                extra += raw if len(raw) > 4 else b""
            tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(tags)) + entries + b"\0" * 4 + extra.ljust(100, b"\0") + b"".join(strips)
            assert (pixels.decode(tiff)[:, :, :3] == x).all(), (order, packing)
    for broken in (b"GIF89a", b"II*\0\x08\0\0\0\x01", b"\xff\xd8\xff\xc0\0\x11\x08\0\x09\0\x09\x03" + b"\0" * 11, b"\xff\xd8\xff\xc2\0\x04\0\0"):
        with pytest.raises(pixels.CannotDecode):
            pixels.decode(broken)


def test_colour_jpeg():
    """Three components, the two of colour with a quarter of the samples, and an interval after which differences begin anew."""
    segment = lambda kind, body: bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body

    def bits(v, before):
        size = abs(v - before).bit_length()
        return f"{size:04b}" + (f"{v - before if v > before else v - before + (1 << size) - 1:0{size}b}" if size else "") + "0"

    macro = [([60, 70, 80, 90], 100, 140), ([150, 160, 170, 180], 128, 128)]
    parts = []
    for ys, cb, cr in macro:  # one macro block to an interval
        line = "".join(bits(y, b) for y, b in zip(ys, [128, *ys])) + bits(cb, 128) + bits(cr, 128)
        line += "1" * (-len(line) % 8)
        parts.append(int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\0"))
    frame = struct.pack(">BHHB", 8, 16, 32, 3) + b"\x01\x22\0\x02\x11\0\x03\x11\0"
    codes = segment(0xC4, b"\0" + bytes((0, 0, 0, 9, *[0] * 12)) + bytes(range(9))) + segment(0xC4, b"\x10" + bytes((1, *[0] * 15)) + b"\0")
    data = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([8] * 64)) + segment(0xC0, frame) + codes + segment(0xDD, b"\0\x01") + segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + parts[0] + b"\xff\xd0" + parts[1] + b"\xff\xd9"
    got = pixels.decode(data)
    assert got.shape == (16, 32, 4)
    for m, (ys, cb, cr) in enumerate(macro):
        for k, y in enumerate(ys):
            want = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
            part = got[8 * (k // 2) : 8 * (k // 2) + 8, 16 * m + 8 * (k % 2) : 16 * m + 8 * (k % 2) + 8, :3].reshape(-1, 3)
            assert (np.abs(part.astype(float) - np.clip(want, 0, 255)) <= 0.5).all()


def test_names_that_operators_use_inside(spark):
    """Columns of any name pass through probe, crop and the read plan."""
    names = ["before", "sniffed", "size", "cut", "fields", "said", "tsv", "found", "words", "_go", "_all", "failure", "_format", "_size"]
    df = spark.createDataFrame([(1, "/a/b.png", bytearray(png(8, 4)), (1, 1, 2, 2), *range(len(names)))], "id int, path string, content binary, region struct<x:long,y:long,width:long,height:long>, " + ", ".join(f"`{n}` int" for n in names))
    for profile in ("shipped", "legacy"):
        r = read.read_image(df, profile).first()
        assert r["error"] is None and r["twin"]["region_evidence"]["dimensions"]["width"] == 2 and [r[n] for n in names] == list(range(len(names)))


def test_recognised_text_in_legacy_read(spark, tmp_path, monkeypatch):
    tool = tmp_path / "tool"
    tool.write_text("#!/bin/sh\n[ \"$1\" = --version ] && exit 0\ncat > /dev/null\nprintf 'level\\tp\\tb\\tq\\tline\\tw\\tleft\\ttop\\twidth\\theight\\tconf\\ttext\\n5\\t1\\t1\\t1\\t1\\t1\\t9\\t8\\t7\\t6\\t90\\tword\\n'\n")
    tool.chmod(0o755)
    rows = spark.createDataFrame([(1, bytearray(png(8, 4))), (2, None)], "image_id int, content binary").withColumn("ocr_languages", F.array(F.lit("eng")))
    got = {r["image_id"]: r for r in ocr.recognise(rows, str(tool)).collect()}
    assert got[1]["tsv"].endswith("word\n") and got[1]["skipped_reason"] is None and got[2]["tsv"] is None
    assert [r["lines"][0]["text"] for r in ocr.line_lists(ocr.recognise(rows, str(tool))).collect()] == ["word"]
    gone = ocr.recognise(rows, "/no/such/tool").collect()[0]
    assert gone["tsv"] is None and "not installed" in gone["skipped_reason"]
    asked = spark.createDataFrame([("/x/a.png", bytearray(png(8, 4)), True), ("/x/b.png", bytearray(png(8, 4)), False)], "path string, content binary, include_ocr boolean")
    twins = {r["path"]: r["twin"] for r in read.read_image(asked, "legacy").collect()}
    assert twins["/x/a.png"]["ocr"]["lines"] == [] and twins["/x/a.png"]["ocr"]["available"] in (True, False) and twins["/x/b.png"]["ocr"] is None


def test_exif_chain_and_unknown_kinds():
    """A long chain of directories is walked to its end, and a value of an unknown kind is told whatever its size."""
    n, block = 3000, b"II*\0" + struct.pack("<I", 8)
    for i in range(n):
        block += struct.pack("<HHHII", 1, 0x8769, 4, 1, 8 + 18 * (i + 1)) + b"\0" * 4
    block += struct.pack("<HHHIIHHI4s", 2, 0x0131, 99, 1 << 30, 0, 0x010F, 2, 3, b"abc\0") + b"\0" * 4
    assert exif.exif_of(block) == {"Software": f'"unknown:tag=305:type=99:count={1 << 30}"', "Make": '"abc"'}


def test_metadata_keys_are_escaped(spark):
    m = F.create_map(F.lit('a"b\\c'), F.lit("1"))
    assert json.loads(spark.range(1).select(metadata.metadata_json(m)).first()[0]) == {'a"b\\c': 1}
