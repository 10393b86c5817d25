"""Benchmark decontamination with the q-gram lemma: documents that hold a benchmark text, up to a few edits.

A text of n characters and a passage at edit distance e or less share at least n + 1 - q (e + 1) q-grams, and those
lie on diagonals (place in the document minus place in the text) at most e apart. Shared q-grams are counted in bands
of diagonals, each overlapping the next by half; bands that reach the count are verified by banded alignment. The
counting loses nothing, so the result is that of aligning every text with every document.

Characters are compared as letters and digits in lower case, with everything between them as one space. Texts that are
shorter than a q-gram are looked for as they are, as whole words in a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of the shared pieces, and edits allowed per character of a benchmark text.
Q, EDITS = 12, 0.05
#: Characters of benchmark texts that are sent to the tasks at once; more of them are searched for in further passes.
BLOCK_CHARS = 4_000_000
#: Characters of documents that are searched at once, unless a single one is longer.
CHUNK_CHARS = 1 << 18
_TABLE_BITS = 22
_BASE = 0x9E3779B97F4A7C15
LEAKS = "doc_id long, item_id long, start_char long, end_char long, edits int"


@cache
def _letters() -> np.ndarray:
    """For every code point its lower case, or a space where it is neither letter nor digit; 0 stays."""
    out = np.full(0x110000, 0x20, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    out[0] = 0
    return out


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The compared characters of a text, and the place in the text of each."""
    raw = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = raw == 0x20
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | (raw[:-1] == 0)))
    keep[:1] = ~blank[:1]
    at = np.flatnonzero(keep)
    return raw[at], at


def qgrams(chars: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each place on; Q is 12: 8 and 4."""
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        two = chars[:-1].astype(np.uint64) + chars[1:] * np.uint64(_BASE)
        four = two[:-2] + two[2:] * np.uint64(pow(_BASE, 2, 2**64))
        eight = four[:-4] + four[4:] * np.uint64(pow(_BASE, 4, 2**64))
        twelve = eight[: len(chars) - Q + 1] + four[8:] * np.uint64(pow(_BASE, 8, 2**64))
        return (twelve ^ (twelve >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Texts:
    """Benchmark texts, ready to be searched for."""

    ids: list[int]
    chars: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray  # sorted
    item: np.ndarray  # of each gram
    place: np.ndarray
    table: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: hashes, sorted, and the texts that they are of

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Texts | None:
        ids, chars, grams, item, place, edits, least = [], [], [], [], [], [], []
        brief: dict[int, list[tuple[int, int]]] = {}
        for key, text in rows:
            c, _ = normal(text)
            c = c[:-1] if len(c) and c[-1] == 0x20 else c
            if 0 < len(c) < Q:
                brief.setdefault(len(c), []).append((int(_hashed(c, np.zeros(1, np.int64), len(c))[0]), len(ids)))
            elif not len(c):
                continue
            e = max(0, min(int(len(c) * EDITS), len(c) // Q - 1))
            g = qgrams(c)
            grams.append(g)
            item.append(np.full(len(g), len(ids)))
            place.append(np.arange(len(g)))
            ids.append(key)
            chars.append(c)
            edits.append(e)
            least.append(len(c) + 1 - Q * (e + 1) if len(c) >= Q else 1 << 40)
        if not ids:
            return None
        g, i, p = np.concatenate(grams), np.concatenate(item), np.concatenate(place)
        order = np.argsort(g, kind="stable")
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[g >> np.uint64(64 - _TABLE_BITS)] = True
        short = {n: tuple(np.array(x) for x in zip(*sorted(rows))) for n, rows in brief.items()}
        return cls(ids, chars, np.array(edits), np.array(least), g[order], i[order], p[order], table, short)

    def find(self, chars: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Text, first and last-but-one place, and edits, of every band that verifies, and of short texts."""
        return self._brief(chars) + self._long(chars)

    def _brief(self, chars: np.ndarray) -> list[tuple[int, int, int, int]]:
        wall = np.concatenate([[True], (chars == 0) | (chars == 0x20), [True]])
        begins, found = np.flatnonzero(wall[:-2] & ~wall[1:-1]), []
        for n, (hashes, items) in self.short.items():
            at = begins[begins + n <= len(chars)]
            at = at[wall[at + n + 1]]
            h = _hashed(chars, at, n)
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(high > low).tolist():
                found += [(int(i), int(at[k]), int(at[k]) + n, 0) for i in items[low[k] : high[k]] if np.array_equal(chars[at[k] : at[k] + n], self.chars[i])]
        return found

    def _long(self, chars: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not len(self.grams):
            return []
        g = qgrams(chars)
        hit = np.flatnonzero(self.table[g >> np.uint64(64 - _TABLE_BITS)])
        span = max(len(c) for c in self.chars) + int(self.edits.max())
        few = int(self.least.min())
        # Of the places with a shared q-gram only those matter that have enough others within a text's length.
        if len(hit) < few:
            return []
        near = np.zeros(len(hit), bool)
        close = np.flatnonzero(hit[few - 1 :] - hit[: len(hit) - few + 1] <= span)
        step = np.zeros(len(hit) + 1, np.int64)
        np.add.at(step, close, 1)
        np.add.at(step, close + few, -1)
        near = np.cumsum(step[:-1]) > 0
        hit = hit[near]
        if not len(hit):
            return []
        lo, hi = np.searchsorted(self.grams, g[hit], "left"), np.searchsorted(self.grams, g[hit], "right")
        many = hi - lo
        at = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        owner, diagonal = self.item[at], np.repeat(hit, many) - self.place[at]
        width = self.edits[owner] + 1
        band = (diagonal + (1 << 40)) // width
        found = []
        keys = np.concatenate([(band << 20 | owner), ((band - 1) << 20 | owner)])
        keys, counts = np.unique(keys, return_counts=True)
        item, band = keys & 0xFFFFF, keys >> 20
        done: dict[int, list[int]] = {}
        for i, b in zip(item[good := counts >= self.least[item]].tolist(), band[good].tolist()):
            e = int(self.edits[i])
            low = b * (e + 1) - (1 << 40)
            if any(low - e <= f <= low + 3 * e + 2 for f in done.get(i, ())):
                continue
            mine = diagonal[(owner == i) & (diagonal >= low) & (diagonal < low + 2 * (e + 1))]
            likely = int(np.bincount(mine - low).argmax()) + low
            n = len(self.chars[i])
            if likely >= 0 and np.array_equal(chars[likely : likely + n], self.chars[i]):
                got = (likely, likely + n, 0)
            else:
                got = aligned(self.chars[i], chars, low - e, low + 2 * (e + 1) + e, e)
            if got:
                done.setdefault(i, []).append(got[0])
                found.append((i, *got))
        return found


def aligned(text: np.ndarray, chars: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """First and last-but-one place and edits of the best alignment of ``text`` on the diagonals low to high."""
    d = np.arange(low, high + 1)
    cost = np.zeros(len(d), np.int64)
    begin = d.copy()
    cost[(d < 0) | (d > len(chars))] = 1 << 30
    steps = np.arange(len(d))
    for i, c in enumerate(text):
        at = d + i
        inside = (at >= 0) & (at < len(chars))
        same = np.zeros(len(d), bool)
        same[inside] = chars[at[inside]] == c
        straight = np.where(inside, cost + ~same, 1 << 30)  # the document's character stands for c
        up = np.append(cost[1:], 1 << 30) + 1  # c is missing in the document
        new = np.minimum(straight, up)
        origin = np.where(straight <= up, begin, np.append(begin[1:], 0))
        # Extra characters of the document: from any diagonal on the left, one edit each.
        flat = new - steps
        best = np.minimum.accumulate(flat)
        first = np.maximum.accumulate(np.where(flat == best, steps, 0))
        cost, begin = best + steps, origin[first]
        if cost.min() > most:
            return None
    j = int(cost.argmin())
    end = int(d[j] + len(text))
    if cost[j] > most or end > len(chars):
        return None
    return int(begin[j]), end, int(cost[j])


def _hashed(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters from each place ``at`` on."""
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(_BASE) + chars[at + k].astype(np.uint64) + np.uint64(1)
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK_CHARS:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def leaks(known: Texts, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """Row, benchmark id, first character, end and edits, of every benchmark text in a column of texts."""
    texts = column.to_pylist()
    for a, b in _chunks(texts):
        part = [(t or "").replace("\0", " ") for t in texts[a:b]]
        chars, at = normal("\0".join(part))
        ends = np.cumsum([len(t) + 1 for t in part])
        for i, first, end, edits in known.find(chars):
            inner = chars[first:end]
            if (inner == 0).any():
                continue
            row = int(np.searchsorted(ends, at[first], "right"))
            base = int(ends[row]) - len(part[row]) - 1
            yield a + row, known.ids[i], int(at[first]) - base, int(at[end - 1]) + 1 - base, edits


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Texts]:
    """The benchmark texts, in blocks of bounded size."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    for k in range(n):
        known = Texts.of(sorted(tuple(r) for r in items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).distinct().collect()))
        if known:
            yield known


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per benchmark text in a document, with its characters there and the number of edits.

    Null and empty texts hold nothing; benchmark texts that are null or have no compared characters are not looked for,
    and those of fewer than Q must be there exactly, as whole words. Rows that repeat a doc_id or have none are searched like any other. With an empty table on either side
    the result is empty; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    out = spark.createDataFrame([], LEAKS)
    for known in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], *rest) for r, *rest in leaks(shared.value, batch.column(1))]
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in LEAKS.split(", ")])

        found = docs.mapInArrow(run, LEAKS)
        out = found if known is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark text, and with the same columns, whatever their names.

    Null and empty texts hold none and stay; texts are searched whole, however long. Rows that repeat stay or go each by
    its text; ids are not read. Null and empty items are held by nothing. An empty table gives an empty result, and an
    empty benchmark all rows.
    """
    spark = docs.sparkSession
    for known in _blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for row, *_ in leaks(shared.value, batch.column(batch.schema.get_field_index(text_col))):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
