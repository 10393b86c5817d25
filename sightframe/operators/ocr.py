"""Word tables of a text recogniser, folded into lines of text with boxes."""

from __future__ import annotations

import re
import signal
import subprocess
import tempfile
import threading
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stages import bounded, staged

#: Columns of the recogniser's table: level, line, left, top, width, height, confidence, text; and what a word's level is.
_LEVEL, _LINE, _LEFT, _TOP, _WIDTH, _HEIGHT, _SURE, _TEXT, WORD = 0, 4, 6, 7, 8, 9, 10, 11, 5
#: What counts as blank, in texts and before numbers.
_BLANKS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Seconds for the check and for a run, and bytes of output.
CHECK_SECONDS, RUN_SECONDS, MOST_OUTPUT = 2.5, 60, 10 << 20
TOOL = "tesseract"
LINES = "array<struct<text:string,x:long,y:long,width:long,height:long,confidence:double>>"
_CLOSED = "array<struct<y:bigint,x:bigint,first:int,line:bigint,text:string,width:bigint,height:bigint,confidence:double>>"
_FIELDS = ["y", "x", "first", "line", "text", "width", "height", "confidence"]


def _whole(text: str) -> int | None:
    """The whole number that a text begins with, after blanks; null if none, or if it is not a long."""
    found = re.match("[+-]?[0-9]+", text.lstrip(_BLANKS))
    digits = found and found[0].lstrip("+-").lstrip("0")
    value = None if found is None or len(digits) > 19 else int(digits or 0) * (-1 if found[0][0] == "-" else 1)
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def _real(text: str) -> float | None:
    """The number that a text begins with, after blanks; null if none."""
    found = re.match(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text.lstrip(_BLANKS))
    return found and float(found[0])


def _numbers(cells: pa.Array, plain: str, one: Callable[[str], float | None], kind: pa.DataType) -> pa.Array:
    """``one`` of each cell; those that match ``plain`` are cast all at once."""
    usual = pc.match_substring_regex(cells, plain)
    out = pc.cast(pc.if_else(usual, cells, None), kind)
    odd = pc.invert(usual)
    return pc.replace_with_mask(out, odd, pa.array([one(c) for c in cells.filter(odd).to_pylist()], kind)) if pc.any(odd).as_py() else out


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b, as near as a long comes to it."""
    s = a + b
    return np.where(((a ^ s) & (b ^ s)) < 0, np.where(a < 0, -1 << 63, (1 << 63) - 1), s)


def _folded(tsv: pa.Array) -> pa.Array:
    """:func:`line_array` of a batch of tables: all their cells are split and parsed at once, words sorted by table, line and place, and folded."""
    texts = pc.split_pattern(pc.replace_substring(tsv, "\r\n", "\n"), "\n")
    owner, rows = pc.list_parent_indices(texts).to_numpy(), texts.flatten()
    full = pc.greater(pc.binary_length(rows), 0)
    owner, rows = owner[full.to_numpy(zero_copy_only=False)], rows.filter(full)
    cells = pc.split_pattern(rows, "\t", max_splits=_TEXT + 1)
    start, flat = cells.offsets.to_numpy()[:-1], cells.values
    good = np.diff(cells.offsets.to_numpy()) > _TEXT
    good[:1] = False  # the first row of each table is its head
    good[1:] &= owner[1:] == owner[:-1]
    owner, start = owner[good], start[good]
    column = lambda k: flat.take(pa.array(start + k))
    whole = lambda k: _numbers(column(k), r"^-?[0-9]{1,18}\z", _whole, pa.int64())
    word = pc.fill_null(pc.equal(whole(_LEVEL), WORD), False).to_numpy(zero_copy_only=False)
    owner, start = owner[word], start[word]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    text, number = pc.utf8_trim(column(_TEXT), _BLANKS), [whole(k) for k in (_LINE, _LEFT, _TOP)]
    seen = pc.greater(pc.binary_length(text), 0)
    for n in number:
        seen = pc.and_(seen, n.is_valid())
    at = np.flatnonzero(seen.to_numpy(zero_copy_only=False))
    line, left, top = (n.take(pa.array(at)).to_numpy() for n in number)
    order = np.lexsort((left, line, owner[at]))
    at, line, left, top = at[order], line[order], left[order], top[order]
    owner, start, place, text = owner[at], start[at], place[at], text.take(pa.array(at))
    width, height = (pc.fill_null(whole(k), 0).to_numpy() for k in (_WIDTH, _HEIGHT))
    sure = pc.fill_null(_numbers(column(_SURE), r"^-?[0-9]{1,15}(\.[0-9]{1,15})?\z", _real, pa.float64()), 0.0).to_numpy()
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    of = lambda f, x: f.reduceat(x, first) if len(first) else x
    x, y, earliest = (of(np.minimum, v) for v in (left, top, place))
    wide, high = (np.maximum(_sum(of(np.maximum, _sum(a, b)), -np.maximum(c, 1 - (1 << 63))), 0) for a, b, c in ((left, width, x), (top, height, y)))
    known = np.bincount(group, sure >= 0, len(first))
    total = np.bincount(group, np.where(sure >= 0, sure, 0.0), len(first))
    mean = pa.array(total / np.maximum(known, 1), pa.float64(), mask=known == 0)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), text), " ")
    order = np.lexsort((earliest, x, y, owner[first]))
    columns = [y, x, earliest.astype(np.int32), line[first], joined, wide, high, mean]
    lines = pa.StructArray.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).take(pa.array(order)) for c in columns], _FIELDS)
    ends = np.append(0, np.cumsum(np.bincount(owner[first], minlength=len(tsv))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines, mask=tsv.is_null())


def line_array(tsv: Column) -> Column:
    """The lines of a word table, from top to bottom and then left to right; null for null.

    Words belong together by line number alone. They go from left to right; words at the same place keep the table's
    order, and so do lines. The confidence is the mean of those that are not negative, null if there are none. Many
    tables are folded at once, a batch of them at a time.
    """
    return F.arrow_udf(_folded, _CLOSED)(F.make_valid_utf8(tsv))


def with_lines(tables: DataFrame, tsv_col: str = "tsv", out: str = "lines") -> DataFrame:
    """``tables`` with :func:`line_array` of each word table. A table is one row and is worked on where it is."""
    return staged(bounded(tables), **{out: line_array(F.col(tsv_col))})


def lines(tables: DataFrame, id_col: str = "image_id", tsv_col: str = "tsv") -> DataFrame:
    """One row per line of an image: text, box, mean confidence, and the place of its first word in the table."""
    rows = bounded(tables).select(id_col, F.inline_outer(line_array(F.col(tsv_col)))).where("line is not null")
    return rows.select(id_col, "line", "text", "x", "y", "width", "height", "confidence", "first")


def line_lists(tables: DataFrame, id_col: str = "image_id", tsv_col: str = "tsv") -> DataFrame:
    """One row per image with its lines from top to bottom, then left to right; none for a table without words."""
    rows = with_lines(tables.select(id_col, tsv_col), tsv_col, "found").where(F.size("found") > 0)
    return rows.select(id_col, shown(F.col("found")).alias("lines"))


def shown(lines: Column) -> Column:
    return F.transform(lines, lambda v: F.struct(v["text"].alias("text"), v["x"].alias("x"), v["y"].alias("y"), v["width"].alias("width"), v["height"].alias("height"), v["confidence"].alias("confidence")))


@cache
def available(tool: str = TOOL) -> bool:
    """Whether the recogniser runs here and tells its version in time."""
    try:
        return subprocess.run([tool, "--version"], capture_output=True, timeout=CHECK_SECONDS, check=False).returncode == 0
    except (OSError, subprocess.TimeoutExpired):
        return False


def _run(content: bytes, languages: list[str], tool: str) -> tuple[str | None, str | None]:
    if not available(tool):
        return None, "The text recogniser is not installed or not on the path."
    with tempfile.TemporaryFile() as given, tempfile.TemporaryFile() as said:
        given.write(content)
        given.seek(0)
        try:
            run = subprocess.Popen([tool, "stdin", "stdout", "-l", "+".join(languages) or "eng", "tsv"], stdin=given, stdout=subprocess.PIPE, stderr=said)
        except OSError as e:
            return None, f"The text recogniser failed to start: {e}"
        late = threading.Timer(RUN_SECONDS, run.kill)
        late.start()
        try:
            out = run.stdout.read(MOST_OUTPUT + 1)  # no more is ever held; what is left is not read
            if len(out) > MOST_OUTPUT:
                run.kill()
            status = run.wait()
        finally:
            late.cancel()
            run.stdout.close()
        if len(out) > MOST_OUTPUT:
            return None, f"The text recogniser failed to start: more than {MOST_OUTPUT} bytes of output"
        if status == -signal.SIGKILL:
            return None, f"The text recogniser failed to start: no end after {RUN_SECONDS} seconds"
        said.seek(0)
        told = said.read(MOST_OUTPUT).decode("utf-8", "replace").strip()
    return (out.decode("utf-8", "replace"), None) if status == 0 else (None, told or f"The text recogniser exited with status {status}.")


def recognised(content: Column, languages: Column, tool: str = TOOL) -> Column:
    """struct<tsv, skipped_reason> of an image; never an error, and null where content is null."""

    def run(contents: pd.Series, langs: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if c is None else _run(c, [] if x is None else list(x), tool) for c, x in zip(contents, langs)]
        return pd.DataFrame(rows, columns=["tsv", "skipped_reason"])

    return F.pandas_udf(run, "tsv string, skipped_reason string")(content, languages)


def recognise(images: DataFrame, tool: str = TOOL) -> DataFrame:
    """image_id, tsv and skipped_reason of images (image_id, content, ocr_languages)."""
    return bounded(images).select("image_id", recognised(F.col("content"), F.col("ocr_languages"), tool).alias("r")).select("image_id", "r.*")
