"""Near-duplicate embeddings with iterative quantisation and multi-index Hamming tables.

Rotations are learned so that the signs of the rotated unit vectors are balanced, faithful codes: iterative quantisation
from several random starts, each of which gives as many bits as the vectors have dimensions. A code is cut into
substrings, and every vector goes into one table per substring; vectors that share a substring meet. The bits of a
substring follow the number of vectors, so that a table's buckets don't grow with it, and the number of tables follows
the bits, so that a pair at the least similarity shares a substring with probability RECALL or more: two vectors at an
angle of w differ in each bit with probability w / pi or, after learning, less. A pair is looked at only in the first
table where it meets, and kept if the whole codes differ in few enough bits; the original vectors then decide.

Codes are of vectors around their mean, unless they are so near the mean that what is left of them says nothing: where
vectors lie in one narrow cluster, or embeddings share a strong direction. Those are coded a second time as they are.
Of a pair that is similar enough both vectors are near the mean, or both far from it, or both coded both ways.

Vectors of each length are a class of their own. Equal vectors are one row with a count, so copies never meet as pairs.
Buckets larger than BLOCK are cut into blocks by hash and every two blocks meet once, so no task holds a large bucket
and none of its pairs is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import connected_components, in_share, spanning_links
from .store import materialize

#: Vectors that the rotations are learned on, at most; turns of learning; bits of a substring at least.
SAMPLE, TURNS, LEAST_BITS = 20_000, 30, 12
#: Share of the pairs at the least similarity that meet, if bits are as good as random directions; rows of a bucket that meet at once.
RECALL, BLOCK = 0.98, 2048
#: Rows of a bucket up to which it is looked at together with others.
TOGETHER = 32
#: Vectors no farther than this from the mean are coded without it.
NEAR = 0.66
FAR_KIND, NEAR_KIND = 0, 1


def table_sizes(n: int, least: float) -> tuple[int, int, int]:
    """Bits of a substring, tables, and bits in which whole codes may differ, for n vectors."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 2))))
    apart = math.acos(max(-1.0, min(1.0, least))) / math.pi
    meet = (1 - apart) ** bits
    tables = max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1 - meet, 1e-300)))) if meet < 1 else 1
    whole = bits * tables
    return bits, tables, math.ceil(whole * apart + 4 * math.sqrt(whole * apart * (1 - apart)))


def quantised(v: np.ndarray, seed: int) -> np.ndarray:
    """A rotation of the columns of ``v`` that brings the rows near the corners of a cube."""
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(TURNS):
        u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (u @ w).T
    return turn


class Codes:
    """The learned mean and directions of vectors of one length, for ``bits`` bits."""

    def __init__(self, vectors: np.ndarray, dims: int, bits: int) -> None:
        self.mean = np.zeros(dims)
        starts = range(-(-bits // dims))
        if len(vectors) >= 2 * dims:
            x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            self.mean = x.mean(0)
            far = x - self.mean
            far = far[np.linalg.norm(far, axis=1) > NEAR]
            far = far if len(far) >= 2 * dims else x
            self.axes = np.hstack([quantised(far, 7 + i) for i in starts])[:, :bits]
        else:  # too few to learn from
            self.axes = np.hstack([np.linalg.qr(np.random.default_rng(7 + i).standard_normal((dims, dims)))[0] for i in starts])[:, :bits]
        self.plain = np.hstack([np.linalg.qr(np.random.default_rng(997 + i).standard_normal((dims, dims)))[0] for i in starts])[:, :bits]

    def of(self, x: np.ndarray, slack: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Kind, the rows coded so, and whether each of their bits is set; rows within ``slack`` of the bound have both kinds."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        rest = x - self.mean
        far = np.linalg.norm(rest, axis=1)
        rows = np.flatnonzero(far > NEAR)
        yield FAR_KIND, rows, rest[rows] @ self.axes > 0
        rows = np.flatnonzero(far <= NEAR + slack)
        yield NEAR_KIND, rows, x[rows] @ self.plain > 0


def _matrix(column: pa.Array, rows: np.ndarray, dims: int) -> np.ndarray:
    return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _code_rows(samples: dict[int, np.ndarray], bits: int, tables: int, least: float):  # noqa: ANN202
    """id, kind and code of each vector, for the kinds it has; a code has a word for each table."""
    slack = math.sqrt(max(0.0, 2 - 2 * least))

    @cache
    def codes(dims: int) -> Codes:
        return Codes(samples.get(dims, np.zeros((0, dims))), dims, bits * tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for dims in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dims)
                for kind, rows, on in codes(dims).of(_matrix(batch.column(1), mine, dims), slack):
                    if not len(rows):
                        continue
                    words = np.zeros((len(rows), tables), _kind(bits))
                    for j in range(bits):
                        words |= on[:, j::bits].astype(words.dtype) << words.dtype.type(j)
                    raw = pa.array([w.tobytes() for w in words], pa.binary())
                    ids = batch.column(0).take(pa.array(mine[rows]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(rows), dims << 1 | kind)), raw], names=["id", "kind", "code"])

    return run


def _kind(bits: int) -> type:
    return np.uint32 if bits <= 32 else np.uint64


def _words(column: pa.Array, bits: int, tables: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _kind(bits)).reshape(-1, tables)


def _bucket_rows(bits: int, tables: int):  # noqa: ANN202
    """One row per table: the key names the table, the kind, the length and the substring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, kind = _words(batch.column(2), bits, tables), batch.column(1).to_numpy()
            for t in range(tables):
                key = (kind * tables + t << bits) + words[:, t].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(2)], names=["key", "id", "code"])

    return run


def _meet_rows(bits: int, tables: int, most: int):  # noqa: ANN202
    """Pairs of the runs of equal (key, part) of sorted rows: within a part, or between its two sides."""

    def near(words: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether rows i and j differ in few bits and share no table before t; i, j and t are broadcast."""
        differ, first = 0, True
        for k in range(tables):
            x = words[i, k] ^ words[j, k]
            differ = differ + np.bitwise_count(x).astype(np.int32)
            first = first & ((x != 0) | (k >= t))
        return (differ <= most) & first

    def pairs(key: np.ndarray, part: np.ndarray, side: np.ndarray, ids: np.ndarray, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of whole runs: of short ones all at once, of each long one in blocks of rows."""
        edge = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [len(key)]])
        size = np.diff(edge)
        place, of = np.arange(len(key)) - np.repeat(edge[:-1], size), np.repeat(size, size)
        table, mixed = (key >> bits) % tables, part >> 31 != part & ((1 << 31) - 1)
        for w in range(1, int(min(TOGETHER, size.max()))):
            j = np.flatnonzero((place >= w) & (of <= TOGETHER))
            j = j[~mixed[j] | (side[j] != side[j - w])]
            j = j[near(words, j, j - w, table[j])]
            yield j, j - w
        for a, b in zip(edge[:-1][size > TOGETHER].tolist(), edge[1:][size > TOGETHER].tolist()):
            rows = np.arange(a, b)
            left, right = (rows[side[a:b] == k] if mixed[a] else rows for k in (0, 1))
            for at in range(0, len(left), 256):
                i = left[at : at + 256]
                x, y = np.nonzero(near(words, i[:, None], right[None, :], table[a]))
                x, y = i[x], right[y]
                yield (x, y) if mixed[a] else (x[x < y], y[x < y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for x, y in pairs(*rows):
                both = np.sort(np.stack([rows[3][x], rows[3][y]]), axis=0)
                if both.size:
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = [*(batch.column(i).to_numpy() for i in range(4)), _words(batch.column(4), bits, tables)]
            rows = [np.concatenate(x) for x in zip(held, rows)] if held else rows
            # The last run may go on in the next batch.
            last = int(np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1])).max(initial=-1)) + 1
            held = [x[last:] for x in rows]
            if last:
                yield from out([x[:last] for x in rows])
        if held:
            yield from out(held)

    return run


def _cosine_rows(least: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            lengths = batch.column(2).value_lengths().to_numpy()
            for dims in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dims)
                x, y = _matrix(batch.column(2), mine, dims), _matrix(batch.column(3), mine, dims)
                x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                good[mine] = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= least
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], names=["a", "b"])

    return run


def similar_pairs(classes: DataFrame, least: float) -> DataFrame:
    """a < b of the rows (id, vector) of ``classes`` that are found with cosine ``least`` or more."""
    spark = classes.sparkSession
    n = classes.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    # The bound on what comes to the driver: SAMPLE vectors, by a hash of the id.
    sample = classes.where(in_share("id", SAMPLE / n)).select("id", "vector").collect()
    sample.sort(key=lambda r: r["id"])
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["vector"]), []).append(r["vector"])
    bits, tables, most = table_sizes(n, least)
    shared = spark.sparkContext.broadcast({d: np.array(v, np.float64) for d, v in by_length.items()})

    def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _code_rows(shared.value, bits, tables, least)(batches)

    coded = materialize(classes.select("id", "vector").mapInArrow(code_rows, "id long, kind long, code binary"))
    rows = coded.mapInArrow(_bucket_rows(bits, tables), "key long, id long, code binary")
    large = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("other")
    if large.isEmpty():
        rows = rows.select("key", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("side"), "id", "code")
    else:
        rows = rows.join(large, "key", "left").select("key", "id", "code", F.coalesce(block, F.lit(0)).alias("block"), other)
        low, high = F.least("block", "other"), F.greatest("block", "other")
        rows = rows.select("key", (low.cast("long") * (1 << 31) + high).alias("part"), (F.col("block") > F.col("other")).cast("long").alias("side"), "id", "code")
    met = rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_meet_rows(bits, tables, most), "a long, b long")
    pairs = materialize(met.distinct())
    left = classes.select(F.col("id").alias("a"), F.col("vector").alias("x"))
    right = classes.select(F.col("id").alias("b"), F.col("vector").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return materialize(joined.mapInArrow(_cosine_rows(least), "a long, b long"))


def embedding_dedup(rows: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of
    different lengths don't link with each other. ``n_links`` counts the rows that a row is linked with directly, equal
    vectors included; ``component_id`` is the smallest vec_id reachable by links; ``kept`` says whether that is the
    row's own. A row with a null vec_id links with nothing and has a null component_id and kept false. Rows that share
    a vec_id should be equal; they count as copies of each other. An empty table gives an empty result; other columns
    are not read.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    key = F.when(usable, F.concat_ws(",", F.xxhash64("vector"), F.hash("vector"), F.size("vector")))
    keyed = materialize(rows.select("vec_id", key.alias("key"), F.when(usable, F.col("vector")).alias("vector")))
    classes = materialize(keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")))
    links = similar_pairs(classes, least)
    both = links.union(links.select("b", "a"))
    counts = both.join(classes.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    roots = connected_components(spanning_links(links))
    of = classes.select("key", "id", "n").join(counts, F.col("id") == F.col("a"), "left").join(roots, F.col("id") == F.col("node"), "left")
    of = materialize(of.select("key", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    lone = keyed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    all_rows = keyed.where("key is not null").select("vec_id", "key").join(of, "key").select("vec_id", "n_links", "component_id").union(lone)
    return all_rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
