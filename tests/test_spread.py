"""How work is dealt to tasks, and how much of it a task holds: small files, small tables, long rows."""

import os

import pytest
from pyspark.sql import functions as F

from sightframe import file_queries, queries
from sightframe.functions import pixels
from sightframe.functions.stages import BATCH_BYTES
from sightframe.operators import crop, ocr
from sightframe.plans import bulk
from sightframe.sources import files, images

SF = "/root/testdata/sf0.001"
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_small_files_are_read_together(spark, tmp_path):
    """not a task for every 32 files, and every file is there once."""
    cores = spark.sparkContext.defaultParallelism
    n = 32 * (4 * cores + 20)
    for k in range(n):
        (tmp_path / f"f{k}.png").write_bytes(b"x" * (1 + k % 2 * 9))
    rows = images.read_folder(spark, f"file://{tmp_path}", "*.png", 5)
    assert rows.rdd.getNumPartitions() <= 2 * 4 * cores
    assert rows.agg(F.count("*"), F.countDistinct("path"), F.count("content"), F.count("error")).first() == (n, n, n // 2, n // 2)


@pytest.mark.parametrize("pattern", [None, "*.png", "f[0-3].{png,gif}", "f^?.p*"])
def test_folder_listed_by_tasks(spark, tmp_path, monkeypatch, pattern):
    """the driver lists no files, each is read in one pass, and the rows are those of Spark's own reader."""
    names = ["a/b/c/f1.png", "a/b/f2.gif", "a/_x/f3.png", "a/.y/f3.png", "_k=1/f4.png", "f^5.png", "sp ace/f%20 6.png", "_f7.png", ".f8.png", "f9.txt", "f10.png._COPYING_", "_metadata/f2.png", "deep/" * 9 + "f3.png", "empty/f0.png", "new\nline/f2.png"]
    for k, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * (3 * k + 1) if "f0" not in name else b"")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    rows = images.read_folder(spark, f"file://{tmp_path}", pattern, 20)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and plan.count("MapInArrow _read_rows") == 1 and plan.count("MapInArrow _listed_rows") == 1
    want = images._read_by_spark(spark, f"file://{tmp_path}", pattern, 20)
    assert rows.schema.simpleString() == want.schema.simpleString()
    assert sorted(rows.collect(), key=str) == sorted(want.collect(), key=str) and want.count() >= 1
    monkeypatch.setattr(images, "LISTED", 2)
    monkeypatch.setattr(images, "_folders", lambda root, enough: [(root, True)])
    assert sorted(images.read_folder(spark, str(tmp_path), pattern, 20).collect(), key=str) == sorted(want.collect(), key=str)


def test_files_in_folders_below(spark, tmp_path):
    """F1, F8, F10: names may lie in folders below, which are made."""
    rows = spark.createDataFrame([("0/a", "1"), ("1/a", "22"), ("b", "3")], "name string, content string")
    assert files.write_files(rows, str(tmp_path)) == 3
    assert [open(tmp_path / n).read() for n in ("0/a", "1/a", "b")] == ["1", "22", "3"] and sorted(os.listdir(tmp_path / "0")) == ["a"]
    keys = spark.range(3).select(F.col("id").alias("p_partkey"))
    folder = file_queries._written(spark, keys)
    assert sorted(os.listdir(folder)) == ["0", "1", "2"] and os.listdir(f"{folder}/2") == ["f2.png"]


def test_opening_small_files_costs_little(tmp_path):
    """a partition holds more than 128 small files."""
    for k in range(300):
        (tmp_path / f"f{k}").write_bytes(b"x")
    assert len(files.ImageFilesReader({"path": str(tmp_path)}).partitions()) == 1


@pytest.mark.parametrize("name", ["crop_pixels", "crop_jpeg", "crop_resample", "exif_extract", "exif_png_webp", "packet_fields"])
def test_rows_of_small_tables_are_spread(spark, name):
    """all cores work on a table that is one split."""
    assert queries.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_equal_regions_are_cut_once(monkeypatch):
    """F3"""
    made = []
    piece = crop._piece
    monkeypatch.setattr(crop, "_piece", lambda *a: made.append(a[1:]) or piece(*a))
    box = {"x": 0, "y": 0, "width": 2, "height": 1, "to_width": 2, "to_height": 1, "shrinks": False, "shown": False}
    out = crop._cut_all(pixels.encode_png(file_queries._picture(1)), [box, None, dict(box), box | {"x": 1}])
    assert len(made) == 2 and out[0] == out[2] and out[0] != out[3] and out[1] == crop._NO_CUT


@pytest.mark.parametrize("what", ["crop_many", "recognise"])
def test_batches_are_bounded(spark, tmp_path, what):
    """unless the session has a bound of its own."""
    spark.conf.unset(BATCHES)
    for bound, want in ((None, str(BATCH_BYTES)), ("1000000", "1000000")):
        if bound:
            spark.conf.set(BATCHES, bound)
        if what == "crop_many":
            (tmp_path / "a").write_bytes(b"x")
            bulk.crop_many(spark.createDataFrame([("a",)], "path string"), bulk.listing(spark, f"file://{tmp_path}"))
        else:
            ocr.recognise(spark.createDataFrame([("a", b"x", ["eng"])], "image_id string, content binary, ocr_languages array<string>"))
        assert spark.conf.get(BATCHES) == want
    spark.conf.unset(BATCHES)


@pytest.mark.parametrize("name", ["ocr_lines", "line_lists"])
def test_word_tables_are_folded_in_batches(spark, name):
    """no interpreted lambdas for each word, and words are dealt to images as rows, not as lists of one word."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "regexp_extract" not in plan and "lambdafunction" not in plan.split("ArrowEvalPython")[1]
    below = plan.split("Exchange hashpartitioning")
    assert len(below) == 2 and "collect_list" not in below[1]


def test_boxes_at_the_ends_of_a_long(spark):
    """many tables are folded at once, and one with an odd box stops none of them."""
    most = (1 << 63) - 1
    tables = [(1, f"head\n5\t\t\t\t1\t\t{most}\t2\t3\t4\t90\ta"), (2, "head\r\n5\t\t\t\t1\t\t 1x\t2\t3\t\t.5e1\t\u3000a\ufeff"), (3, None), (4, "head")]
    got = {r["image_id"]: tuple(r)[1:] for r in ocr.lines(spark.createDataFrame(tables, "image_id int, tsv string")).collect()}
    assert got == {1: (1, "a", most, 2, 0, 4, 90.0, 0), 2: (1, "a", 1, 2, 3, 0, 5.0, 0)}
