"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three letters, with the blank at a word's ends),
most frequent first. A document goes to the language whose profile is nearest by the out-of-place distance: the sum,
over the document's n-grams, of how far each is from its place in the language's profile, or PROFILE if it is not there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a profile; characters that are worked on at once; distinct n-grams that a task holds before it passes them on.
PROFILE, CHUNK_CHARS, HELD = 300, 1 << 18, 1 << 21
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text the codes of all its n-grams, in any order: up to three code points of 21 bits."""
    lows = [t.lower() for t in texts]
    raw = np.frombuffer(("\0".join(["", *lows, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)
    wall = np.flatnonzero(raw == 0) if not any("\0" in t for t in lows) else np.cumsum([0, *(len(t) + 1 for t in lows)])
    letter = _letters()[raw]
    a = np.where(letter, raw, 0x20).astype(np.int64)
    first = a
    b, c = np.append(a[1:], 0x20), np.append(a[2:], [0x20, 0x20])
    one, two = letter, letter | np.append(letter[1:], False)
    three = np.append(letter[1:], False)
    codes = (first, first | b << 21, first | b << 21 | c << 42)
    for i, j in zip(wall, wall[1:]):
        # From the wall before the text on: the blank before the first word counts, the one after the last begins none.
        yield np.concatenate([code[i:j][keep[i:j]] for code, keep in zip(codes, (one, two, three))])


def top(codes: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent codes, most frequent first; ties to the smaller code."""
    values, counts = _counted(codes)
    if len(values) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.argsort(-counts, kind="stable")][:PROFILE]


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[new], np.diff(np.append(new, len(codes)))


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (values, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j in chunks(texts):
            by: dict[str, list[np.ndarray]] = {}
            for lang, codes in zip(langs[i:j], ngrams(texts[i:j])):
                by.setdefault(lang, []).append(codes)
            for lang, parts in by.items():
                values, counts = _counted(np.concatenate(parts))
                if lang in held:
                    both = np.concatenate([held[lang][0], values])
                    values, at = np.unique(both, return_inverse=True)
                    counts = np.bincount(at, np.concatenate([held[lang][1], counts]), len(values)).astype(np.int64)
                held[lang] = values, counts
            if sum(len(v) for v, _ in held.values()) > HELD:
                yield from out()
                held = {}
    yield from out()


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """The profile of every language in ``rows``: PROFILE codes a language come to the driver."""
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(_count_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in sorted(counts.withColumn("place", place).where(F.col("place") <= PROFILE).collect(), key=lambda r: (r["lang"], r["place"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def _predict_rows(profiles: dict[str, list[int]]):  # noqa: ANN202
    langs = sorted(profiles)
    known = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in langs])) if langs else np.zeros(0, np.int64)
    places = np.full((len(known) + 1, len(langs)), -PROFILE * 4, np.int64)
    for k, lang in enumerate(langs):
        places[np.searchsorted(known, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            said, score = [], []
            for i, j in chunks(texts):
                for codes in ngrams(texts[i:j]):
                    mine = top(codes)
                    if not len(mine) or not langs:
                        said.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                    at[known[at] != mine] = len(known)
                    far = np.minimum(np.abs(places[at] - np.arange(len(mine))[:, None]), PROFILE).sum(0)
                    best = int(far.argmin())
                    said.append(langs[best])
                    score.append(1 - float(far[best]) / (PROFILE * len(mine)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row of ``docs``.

    Texts that are null or have no letter get ``und`` and score 0, and so does everything when nothing was learned.
    Equal distances go to the language that comes first by name. A null doc_id is not held out. Rows that repeat give a
    row each; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predict_rows(profiles), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, and predict all rows."""
    return identify(docs, learn(docs.where(~held_out(F.col(id_col))), text_col, lang_col), id_col, text_col)
