"""Streaming over rows sorted by a key, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

#: Bits of the map of wanted documents; where more are wanted than it can tell apart it lets more through.
MAP_BITS = 1 << 22
#: Nodes whose links a task holds until it begins anew.
FOREST_NODES = 1 << 20


class KeyRuns:
    """Runs of equal keys in a sorted stream of batches, with memory for a few rows of the last run only.

    ``feed(key, *columns)`` returns ``(head, previous, index, n)``: for every fed row the row number of its run's
    first row, the row numbers of the ``window`` rows before it in its run (-1 if none), and its place in its run.
    Row numbers refer to ``self.rows``: the kept rows of the last run, then the fed ones, which start at ``n``.
    """

    def __init__(self, window: int) -> None:
        self.window, self.kept, self.seen = window, None, 0
        self.rows: tuple[np.ndarray, ...] = ()

    def feed(self, key: np.ndarray, *columns: np.ndarray, windows: bool = True) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, int]:
        old = self.kept
        n = len(old[0]) if old is not None else 0
        rows = tuple(np.concatenate([old[i], x]) if n else x for i, x in enumerate((key, *columns)))
        self.rows = rows
        k = rows[0]
        place = np.arange(len(k))
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        head = np.maximum.accumulate(np.where(new, place, 0))
        index = place - head
        if n:
            first_run = head == 0
            index[first_run & (place >= n)] += self.seen - n
        previous = []
        for w in range(1, self.window * windows + 1):
            p = np.where((place - head >= w), place - w, -1)
            previous.append(p[n:])
        h = head[-1]
        run = len(k) - h
        seen = (self.seen if h == 0 and n else 0) + (run if not (h == 0 and n) else len(k) - n)
        tail = np.arange(max(h + 1, len(k) - self.window), len(k))
        keep = np.concatenate([[h], tail]).astype(int)
        self.kept, self.seen = tuple(x[keep] for x in rows), seen
        return head[n:], previous, index[n:], n


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node that it reaches, for every node of an edge.

    Alternates large-star and small-star steps until every edge leads to a root. No node's neighbours are ever collected: minima
    are pre-aggregated and joined back from a written table, so that a hub's edges can be split over tasks.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        both = now.union(now.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(least.select("u", "m")).where("u <> v").distinct())


def _forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links of a task as many as connect what they connect, and no more."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        keep = np.zeros(len(batch), bool)
        for i, (a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1)))):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep[i] = True
        yield batch.filter(pa.array(keep))
        if len(parent) > FOREST_NODES:
            parent.clear()


def spanning_links(links: DataFrame) -> DataFrame:
    """Fewer of the ``links`` (a, b) with the same connected components: each task leaves out those that close a ring."""
    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest_rows, "a long, b long")


def mapped(rows: DataFrame, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose doc_id may be in ``wanted`` (doc_id), or with ``inside`` false those whose doc_id is not.

    Looks into a bit map of fixed size: rows outside it need no join at all, so few texts are shuffled for one. Where
    more are wanted than the map can tell apart, more rows are inside. A null doc_id is outside.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    words = wanted.select(place.alias("p")).groupBy((F.col("p") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    table = np.zeros(MAP_BITS // 64, np.int64)
    for r in words.collect():
        table[r["word"]] = r["bits"]
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            found = p >= 0
            found &= (shared.value[p // 64] >> (p % 64) & 1).astype(bool)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(found == inside))

    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place).cast("long")
    return rows.withColumn(free_name(rows), place).mapInArrow(run, rows.schema)


def in_share(column: str, share: float) -> Column:
    """Whether a row is in a sample of this share of all rows, by the whole 64-bit hash of a column: any share above nought draws some of many rows."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(F.xxhash64(column), 1) < F.lit(int(share * 2**63))


def free_name(rows: DataFrame, name: str = "place") -> str:
    """A name that no column of ``rows`` has, in any case of its letters."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name
