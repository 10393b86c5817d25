"""Files as sources and sinks, many requests for one file, sizes by folds, and XMP and IPTC, against plain versions."""

import os
import random
import socket
import struct
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not, StringEndsWith

from sightframe.functions import packets, pixels, sniff, sql
from sightframe.functions.stages import let, staged
from sightframe.operators import crop as crop_op
from sightframe.operators import diagnostics, ocr
from sightframe.plans import bulk, read
from sightframe.sources import files
from sightframe.sources.images import read_requested
from tests.test_images import png


def folder_of(tmp_path, sizes):
    for name, size in sizes.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    return str(tmp_path)


def test_filters_while_listing(tmp_path):
    """Path and length decide while the folder is listed; other filters are left to Spark."""
    at = folder_of(tmp_path, {"a.png": 10, "b.png": 500, "sub/c.png": 20, "sub/d.txt": 20, ".hidden.png": 0})
    reader = files.ImageFilesReader({"path": f"file://{at}"})
    other = Not(EqualTo(("path",), "x"))
    assert list(reader.pushFilters([IsNotNull(("path",)), StringEndsWith(("path",), ".png"), LessThanOrEqual(("length",), 20), other, EqualTo(("message",), "m")])) == [other, EqualTo(("message",), "m")]
    assert sorted(os.path.basename(p) for p, _, _ in reader.listed()) == [".hidden.png", "a.png", "c.png"]
    named = files.ImageFilesReader({"path": at})
    list(named.pushFilters([In(("path",), (f"{at}/a.png", f"{at}/b.png")), GreaterThan(("length",), 100)]))
    assert [p for p, _, _ in named.listed()] == [f"{at}/b.png"]


def test_partitions_by_size(tmp_path):
    """Large files first and alone where they fill a partition; files that are not opened weigh little."""
    at = folder_of(tmp_path, {f"f{i}": 1000 * (i + 1) for i in range(10)})
    size = files.OPEN_BYTES + 6000
    parts = files.ImageFilesReader({"path": at, "partitionbytes": str(2 * size)}).partitions()
    assert sorted(p for part in parts for p, _, _ in part.files) == sorted(f"{at}/f{i}" for i in range(10)) and parts[0].files[0][0] == f"{at}/f9" and len(parts) >= 5
    assert len(files.ImageFilesReader({"path": at, "partitionbytes": str(100 * size)}).partitions()) == 1


def test_source(spark, tmp_path):
    at = folder_of(tmp_path, {"a.png": 10, "b.png": 500, "sub/c.png": 20, "empty": 0})
    files.register(spark)
    load = lambda **options: spark.read.format("image_files").options(**options).load(at)
    got = {os.path.basename(r["path"]): (r["length"], r["content"], r["message"]) for r in load(maxFileBytes=100).collect()}
    assert got == {"a.png": (10, b"x" * 10, None), "b.png": (500, None, "Image file exceeds maximum size of 100 bytes."), "c.png": (20, b"x" * 20, None), "empty": (0, b"", None)}
    assert {r["content"] for r in load(content="false").collect()} == {None}
    few = load().where((F.col("length") > 15) & F.col("path").endswith(".png") & F.col("path").contains("sub"))
    assert [r["length"] for r in few.collect()] == [20]
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "endswith" not in plan.lower()
    with pytest.raises(ValueError):
        files.mounted("s3://bucket/x")


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1"), ("b", "22"), (None, "3"), ("c", None), ("b", "22")], "name string, content string")
    assert files.write_files(rows, str(tmp_path)) == 3 and files.write_files(rows.where("name = 'x'"), str(tmp_path)) == 0
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a": "1", "b": "22"}


REQUEST = "path string, region struct<x:bigint,y:bigint,width:bigint,height:bigint>, max_file_bytes long, max_pixels long, max_region_dimension long, include_region_image boolean, path_of string"


def test_many_regions(spark, tmp_path, monkeypatch):
    """Every request is answered as by itself; missing, oversize and null paths are errors; copies count."""
    (tmp_path / "a.png").write_bytes(png(20, 10))
    (tmp_path / "b.png").write_bytes(png(6, 4))
    (tmp_path / "bad.png").write_bytes(png(20, 10)[:-30])
    (tmp_path / "not.png").write_bytes(b"nothing")
    at = str(tmp_path)
    boxes = [(x, y, 1 + x % 3, 1) for x in range(18) for y in range(9)]
    rows = [(f"{at}/a.png", b, None, None, None, i % 2 == 0, "k") for i, b in enumerate(boxes)] + [(f"{at}/a.png", (0, 0, 20, 10), None, None, 5, None, "k"), (f"{at}/a.png", (0, 0, 20, 10), None, 9, None, None, "k"), (f"{at}/a.png", (19, 0, 5, 1), None, None, None, None, None)]
    rows += [(f"{at}/b.png", None, None, None, None, None, "k")] * 3 + [(f"{at}/b.png", (0, 0, 2, 2), 10, None, None, None, "k"), (f"{at}/bad.png", (0, 0, 2, 2), None, None, None, None, "k"), (f"{at}/bad.png", None, None, None, None, None, "k"), (f"{at}/not.png", (0, 0, 1, 1), None, None, None, None, "k"), (f"{at}/gone.png", None, None, None, None, None, "k"), (None, None, None, None, None, None, "k"), (None, (0, 0, 1, 1), None, None, None, None, None)]
    requests = spark.createDataFrame(rows, REQUEST)
    one = read.read_image(read_requested(requests))
    key = lambda r: repr((r["path"], r["region"], r["path_of"], r["region_evidence"], r["error"] and (r["error"]["code"], r["error"]["message"].split("':")[0])))
    want = sorted(key(r) for r in one.collect())
    for most in (10, 256):
        got = bulk.crop_many(requests, bulk.listing(spark, f"file://{at}"), most)
        assert sorted(key(r) for r in got.collect()) == want
    assert bulk.crop_many(requests.where("path = 'x'"), bulk.listing(spark, f"file://{at}")).collect() == []
    plain = bulk.crop_many(requests.select("path").where("path like '%b.png'"), bulk.listing(spark, f"file://{at}")).collect()
    assert [(r["probe"]["width"], r["error"]) for r in plain] == [(6, None)] * 4


def test_read_late(spark, tmp_path):
    """What the listing lacks is not looked for, and what nobody asks for is not opened."""
    (tmp_path / "a.png").write_bytes(png(6, 4))
    listed = spark.createDataFrame([(f"{tmp_path}/b.png", 9), (f"{tmp_path}/large.png", 1 << 40)], "path string, length long")
    requests = spark.createDataFrame([(f"{tmp_path}/a.png",), (f"{tmp_path}/large.png",)], "path string")
    got = {os.path.basename(r["path"]): r["error"]["message"] for r in bulk.crop_many(requests, listed).collect()}
    assert "not in the listing" in got["a.png"] and "exceeds maximum size" in got["large.png"]
    plan = bulk.listing(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_hot_file_is_split(spark):
    """A file's different requests are dealt to parts of about the size wanted; its copies are counted and not kept."""
    rows = [("hot", (i % 1000, 0, 1, 1)) for i in range(3000)] + [("cold", (0, 0, 1, 1))] * 500 + [(None, None)]
    requests = spark.createDataFrame(rows, "path string, region struct<x:bigint,y:bigint,width:bigint,height:bigint>")
    sizes = {}
    for r in bulk.together(requests, 100).collect():
        sizes.setdefault(r["path"], []).append((len(r["asked"]), sum(q["copies"] for q in r["asked"])))
    assert len(sizes["hot"]) == 10 and max(n for n, _ in sizes["hot"]) < 160 and sum(c for _, c in sizes["hot"]) == 3000
    assert sizes["cold"] == [(1, 500)] and sizes[None] == [(1, 1)]


def test_one_decode(monkeypatch):
    """However many regions are cut out of an image, it is decoded once, and only down to the last row that is needed."""
    calls, real = [], pixels.decode
    monkeypatch.setattr(pixels, "decode", lambda data, rows=None: calls.append(rows) or real(data, rows))
    box = lambda x, y: {"x": x, "y": y, "width": 2, "height": 1, "to_width": 2, "to_height": 1, "shrinks": False, "shown": True}
    got = crop_op._cut_all(png(20, 10), [box(0, 0), None, box(3, 4), box(0, 0)])
    assert calls == [5] and got[0] == got[3] and got[1] == (None,) * 4 and got[2][3] is None and crop_op._cut_all(None, [box(0, 0)]) == [(None,) * 4]


def plain_jpeg(data):
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return struct.unpack_from(">HH", data, at + 5)[::-1]
        else:
            at += 2 if kind == 0x01 or 0xD0 <= kind <= 0xD8 else 2 + struct.unpack_from(">H", data, at + 2)[0]
    return None


def plain_tiff(data):
    order = "<" if data[:2] == b"II" else ">"
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        (n,) = struct.unpack_from(order + "H", data, at)
        size = {}
        for i in range(n):
            tag, kind, _ = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if tag in (256, 257):
                size[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * i)[0]
        return size[256], size[257]
    except (struct.error, KeyError):
        return None


def made_jpegs(r):
    for n in [0, 1, 3, 20, 1500]:
        body = b"\xff\xd8"
        for _ in range(n):
            body += r.choice((b"\xff", b"\xff\x01", b"\xff\xd3", b"\xff\xe1" + struct.pack(">H", (k := r.randint(2, 40))) + bytes(r.choices(range(256), k=k - 2)), b"\xff\xc4\0\x02"))
        yield body + b"\xff" + bytes([r.choice((0xC0, 0xC2, 0xCF))]) + b"\0\x11\x08" + struct.pack(">HH", r.randint(0, 65535), r.randint(0, 65535)) + b"\x03" + b"\0" * r.randint(0, 9)
        yield body + b"\0" * r.randint(0, 20)
        yield body + b"\xff\xc0\0\x11\x08\0"
    yield b"\xff\xd8" + b"\xff" * 9000 + b"\xc0\0\x11\x08\0\x07\0\x09\x03" + b"\0" * 9


def made_tiffs(r):
    for _ in range(60):
        order, n = r.choice("<>"), r.randint(0, 5)
        entries = b"".join(struct.pack(order + "HHI", r.choice((256, 257, 257, 256, 300)), kind := r.choice((1, 3, 4)), 1) + (struct.pack(order + "HH", r.randint(0, 65535), 0) if kind == 3 else struct.pack(order + "I", r.randint(0, 2**32 - 1))) for _ in range(n))
        at = r.choice((8, 8, 8, 11, 60, 2**32 - 1))
        data = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at) + b"\0" * (at - 8 if at < 100 else 0) + struct.pack(order + "H", n) + entries + b"\0" * 4
        yield data[: len(data) - r.choice((0, 0, 0, 3, 4, 5, 8, 9, 12))]


def test_walks(spark):
    """Sizes of JPEG and TIFF images by folds are those of plain walks, for broken ones too."""
    r = random.Random(3)
    jpegs, tiffs = list(made_jpegs(r)), list(made_tiffs(r))
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(jpegs + tiffs)], "i int, content binary")
    size = F.when(F.col("i") < len(jpegs), sniff.jpeg_size(F.col("content"))).otherwise(sniff.tiff_size(F.col("content")))
    got = {row["i"]: row["size"] and tuple(row["size"]) for row in df.select("i", size.alias("size")).collect()}
    assert got == {i: plain_jpeg(x) if i < len(jpegs) else plain_tiff(x) for i, x in enumerate(jpegs + tiffs)}


XMP = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">{}</rdf:RDF></x:xmpmeta>'


def xmp(spark, *texts):
    df = spark.createDataFrame([(i, None if t is None else bytearray(t if isinstance(t, bytes) else t.encode())) for i, t in enumerate(texts)], "i int, content binary")
    return [r["m"] for r in df.select("i", packets.xmp_fields(F.col("content")).alias("m")).orderBy("i").collect()]


def test_xmp(spark):
    """Attributes, elements, lists, languages and nested properties; the first of several; broken and missing packets."""
    one = XMP.format('<rdf:Description rdf:about="" xmlns:a="n" a:Tool="A &amp; B" a:GPSLatitude="1,2N"><a:List><rdf:Bag><rdf:li>x</rdf:li><rdf:li>y "z"</rdf:li></rdf:Bag></a:List><a:Title><rdf:Alt><rdf:li xml:lang="x-default">T</rdf:li></rdf:Alt></a:Title><a:In><a:Lat>3</a:Lat></a:In></rdf:Description>')
    two = XMP.format('<rdf:Description xmlns:a="n" a:Rating="1"/><rdf:Description xmlns:b="m" b:Rating="2" b:Other="é"/>')
    got = xmp(spark, b"\xff\xd8\xff\0" + one.encode() + b"\xfe" * 9 + two.encode(), two, XMP.format("<rdf:Description>"), "<x:xmpmeta", "</x:xmpmeta>", XMP.format(""), "", None)
    assert got[0] == {"Tool": '"A & B"', "GPSLatitude": '"1,2N"', "List": '["x","y \\"z\\""]', "Title": '"T"', "In": '{"Lat":3}'}
    assert got[1] == {"Rating": "1", "Other": '"é"'} and got[2:] == [{}] * 6


def iptc(*records):
    body = b"".join(b"\x1c" + bytes((kind, number)) + struct.pack(">H", len(v)) + v for kind, number, v in records)
    return b"\xff\xd8..Photoshop 3.0\x008BIM\x04\x04\0\0" + struct.pack(">I", len(body)) + body


def test_iptc(spark):
    whole = iptc((1, 90, b"\x1b%G"), (2, 5, "Tïtle".encode()), (2, 25, b"one"), (2, 200, b"?"), (2, 25, b'two "q"'), (2, 90, b"Z\xfcrich"), *[(2, 25, b"k")] * 100)
    rows = [whole, iptc((2, 5, b"a"), (2, 90, b"cut off"))[:-3], b"8BIM\x04\x04", b"nothing", None, iptc()]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(rows)], "i int, content binary")
    got = [r["m"] for r in df.select("i", packets.iptc_fields(F.col("content")).alias("m")).orderBy("i").collect()]
    assert got[0]["ObjectName"] == '"Tïtle"' and got[0]["City"] == '"Zürich"' and got[0]["Keywords"].startswith('["one","two \\"q\\"","k"') and got[0]["Keywords"].count('"k"') == 100
    assert got[1] == {"ObjectName": '"a"'} and got[2:] == [{}] * 4
    merged = packets.merged(F.create_map(F.lit("City"), F.lit('"first"')), packets.iptc_fields(F.col("content")))
    assert df.where("i = 0").select(merged.alias("m")).first()["m"]["City"] == '"first"'


def test_legacy_metadata(spark):
    """In the legacy profile XMP and IPTC are read, and places in nested values are redacted as well."""
    text = XMP.format('<rdf:Description xmlns:a="n" a:Make="Fake"><a:Location><a:lat>3</a:lat><a:name>x</a:name></a:Location></rdf:Description>')
    image = png(8, 4) + text.encode() + iptc((2, 90, b"Here"))
    df = spark.createDataFrame([("/x/a.png", bytearray(image)), ("/x/b.png", bytearray(png(8, 4)))], "path string, content binary")
    old, new = ({r["path"]: r["twin"] for r in read.read_image(df, p).collect()} for p in ("legacy", "shipped"))
    assert old["/x/a.png"]["metadata"] == '{"City":"Here","Location":{"lat":"[redacted]","name":"x"},"Make":"Fake"}'
    assert any("GPS" in w for w in old["/x/a.png"]["trust_warnings"]) and old["/x/b.png"]["trust_warnings"][1].startswith("No EXIF, XMP, or IPTC") and new["/x/a.png"]["metadata"] is None


def test_stages(spark):
    """A staged column is computed once, whatever uses it, and an answer's plan stays small."""
    df = spark.createDataFrame([("a,b",), (None,)], "x string")
    rows = staged(df, y=F.split("x", ","), X=F.upper("x"))
    rows = rows.select("X", F.size("y").alias("n"), F.col("y")[0].alias("a"), F.col("y")[1].alias("b"))
    assert [tuple(r) for r in rows.orderBy("X").collect()] == [(None, None, None, None), ("A,B", 2, "a", "b")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert df.select(let(F.col("x"), lambda v: F.concat(v, v)).alias("v")).first()["v"] == "a,ba,b"
    requests = spark.createDataFrame([("read_image", "{}")], "tool string, input string")
    assert len(read.answer(requests)._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def lines_in(folder):
    return sorted(line for p in folder.glob("*.json") for line in p.read_text().splitlines())


def test_records(spark, tmp_path):
    """Only attempts that count leave lines: not one that failed halfway, nor a second one of the same rows; an abort leaves none."""
    at = tmp_path / "out"
    files.write_records(spark.range(10).repartition(3), str(at))
    files.write_records(spark.range(10, 12), f"file://{at}")
    assert lines_in(at) == sorted(f'{{"id":{i}}}' for i in range(12)) and not [p for p in at.iterdir() if p.name.startswith(".")]
    batch = lambda *v: pa.RecordBatch.from_pydict({"value": list(v)})

    def failing():
        yield batch("lost")
        raise RuntimeError

    writer = files.JsonRecordsWriter(str(tmp_path / "two"))
    with pytest.raises(RuntimeError):
        writer.write(failing())
    writer.write(iter([batch("a", "b")]))
    writer.commit([writer.write(iter([batch("a", "b")])), writer.write(iter([])), None])
    assert lines_in(tmp_path / "two") == ["a", "b"] and len(list((tmp_path / "two").iterdir())) == 1
    gone = files.JsonRecordsWriter(str(tmp_path / "two"))
    gone.abort([gone.write(iter([batch("c")])), None])
    assert lines_in(tmp_path / "two") == ["a", "b"] and len(list((tmp_path / "two").iterdir())) == 1


RETRIED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from sightframe.sources import files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
def run(batches):
    for batch in batches:
        yield batch
        if 7 in batch.column(0).to_pylist() and not os.path.exists({flag!r}):
            open({flag!r}, "w").close()
            raise RuntimeError("once")
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
files.write_records(spark.range(0, 20, 1, 4).mapInArrow(run, "id long"), {out!r})
"""


def test_task_that_fails_once(tmp_path):
    """A task that fails after some of its rows and runs again leaves each of them once."""
    root, out = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), tmp_path / "out"
    done = subprocess.run([sys.executable, "-c", RETRIED.format(root=root, flag=str(tmp_path / "flag"), out=str(out))], capture_output=True, timeout=300, env={**os.environ, "PYTHONPATH": root}, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "flag").exists() and lines_in(out) == sorted(f'{{"id":{i}}}' for i in range(20)) and not [p for p in out.iterdir() if p.name.startswith(".")]


def script(tmp_path, name, body):
    at = tmp_path / name
    at.write_text("#!/bin/sh\n" + body)
    at.chmod(0o700)
    return str(at)


def test_recogniser_is_bounded(tmp_path, monkeypatch):
    """Output is read up to the bound, and a run that does not end is ended."""
    endless = script(tmp_path, "endless", '[ "$1" = --version ] && exit 0\nexec yes\n')
    tsv, said = ocr._run(b"", ["eng"], endless)
    assert tsv is None and "bytes of output" in said
    monkeypatch.setattr(ocr, "RUN_SECONDS", 0.5)
    asleep = script(tmp_path, "asleep", '[ "$1" = --version ] && exit 0\nexec sleep 60\n')
    assert "no end after" in ocr._run(b"", [], asleep)[1]
    failing = script(tmp_path, "failing", '[ "$1" = --version ] && exit 0\necho "$4" >&2; exit 3\n')
    assert ocr._run(b"x" * 1_000_000, ["eng", "deu"], failing) == (None, "eng+deu")
    echo = script(tmp_path, "echo", '[ "$1" = --version ] && exit 0\nexec cat\n')
    assert ocr._run(b"y" * 1_000_000, [], echo) == ("y" * 1_000_000, None)


def test_doctor_where_tasks_run(spark, tmp_path):
    """Every slot is looked at at once, and a recogniser that one process lacks shows as a warning of its host."""
    once = script(tmp_path, "once", f"mkdir {tmp_path}/lock 2>/dev/null && exit 0\nexit 1\n")
    rows = diagnostics.executor_checks(spark, 2, str(tmp_path), once).collect()
    by = {r["id"]: r for r in rows}
    assert by["text_recogniser"]["status"] == "warn" and by["text_recogniser"]["host"] == socket.gethostname() and by["shared_folder"]["status"] == "ok" and len(rows) == 5
    gone = diagnostics.executor_checks(spark, 2, str(tmp_path / "no"), once)
    assert diagnostics.overall(gone).first()["status"] == "unavailable"
    whole = {(r["id"], r["host"]) for r in diagnostics.doctor(spark, 2).collect()}
    assert ("spark", "driver") in whole and ("python", socket.gethostname()) in whole


def test_sql_functions(spark):
    """Functions in SQL alone tell what the expressions tell, and Catalyst puts their bodies in place."""
    sql.register(spark)
    heads = [b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 70_000, 3), b"\xff\xd8\xff", b"GIF89a", b"RIFF....WEBP", b"MM\0*", b"BM", b"", None]
    df = spark.createDataFrame([(None if h is None else bytearray(h),) for h in heads], "content binary")
    df.createOrReplaceTempView("heads")
    rows = spark.sql("SELECT content, image_format(content) AS f, png_size(content) AS s, content_hash(content) AS h FROM heads")
    want = df.select(sniff.image_format(F.col("content")).alias("f"), F.when(sniff.image_format(F.col("content")) == "png", sniff.dimensions(F.col("content"), F.lit("png"))).alias("s"), sniff.content_hash(F.col("content")).alias("h"))
    assert rows.select("f", "s", "h").collect() == want.collect()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "SQLFunction" not in plan and "EvalPython" not in plan
    assert spark.sql("SELECT region_fault(4294967290, 0, 8, 1, 10, 10) AS a, shrunk_side(10, 20, 10, 5) AS b, is_place_key('Lat') AS c, has_place(map('lng', '1')) AS d").first()[1:] == (3, False, True)


def test_hints(spark):
    """An error says what to do next, by what was wrong and by the tool."""
    import json

    rows = [("read_image", "{}", "path"), ("crop_region", '{"path": "/no/such"}', "region"), ("image_probe", '{"path": "/no/such"}', "image_probe"), ("read_video", "{}", "image_probe"),
            ("crop_region", '{"path": "/no/such", "region": {"x": 0, "y": 0, "width": 1, "height": 1}}', "crop_region"), ("read_image", '{"path": "/", "region": {"x": -1}}', "region")]
    got = [json.loads(r["answer"]) for r in read.answer(spark.createDataFrame(rows, "tool string, input string, want string").coalesce(1)).collect()]
    assert [a["status"] for a in got] == ["error"] * 6
    assert [a["next_action"] for a in got] == [read.HINTS[w] for _, _, w in rows]
