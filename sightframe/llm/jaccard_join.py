"""N-gram Jaccard join with parity sketches: all pairs of documents whose word-shingle sets are similar, as components.

A document's sketch has one word per block. Each shingle belongs to one block, by its hash, and is XORed into that
block's word, so a word differs only if a shingle of the symmetric difference fell in its block: the number of
differing words (the Hamming distance over blocks) is at most the size of the symmetric difference. Sets with
Jaccard similarity t or more have a symmetric difference of at most k = (|A| + |B|) (1 - t) / (1 + t). Sizes are
therefore cut into bands whose ends are a factor 1 / t apart; each band has k + 1 + s blocks for the largest pair
in it, and by the pigeonhole principle a similar pair agrees in at least s + 1 words. A document takes part in its
own band and in the next one, which covers every pair of sizes that can be similar.

Words of few shingles say little and would bring unrelated documents together. A document with at most s blocks of
fewer than two shingles leaves these out: one of the s + 1 agreeing blocks has more then, and being equal it has more
in both. Otherwise a document with at most s empty blocks leaves those out, and only one with more keeps all. Whatever
the two documents of a similar pair do, a block in which they agree is kept by both.

Equal words are found by sorting on them. In a run of documents with the same word each one is paired with the first
and, in short runs, with all others. Longer runs are looked at again after the pairs have been verified: where they
reach into different components, rows of these are compared by sketch, block by block, and the pairs that remain are
verified in turn. So a group of n near copies costs n pairs, not n squared, and the result is exact up to
collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import KeyRuns, connected_components, mapped
from .store import materialize
from .text import mix, shingle_sets, words

#: A run of one row more is short.
WINDOW = 3
#: Rows of a block of a longer run; rows of it that are compared with another block's at once.
BLOCK, ROWS_AT_ONCE = 2048, 64
#: Bits of the smallest parity sketch that is compared before the sets.
LEAST_BITS = 1024
#: Pairs that are looked through for repeated ones at once, and whose sketches are compared at once.
PAIR_ROWS, PAIRS_AT_ONCE = 1 << 19, 1 << 12
#: Rows of one output batch.
OUT_ROWS = 1 << 16

_ROWS = "key long, doc long, copy boolean"
_FOUND = "kind int, a long, b long"
COPY, PAIR, OPEN = 0, 1, 2


def bands(threshold: tuple[int, int], largest: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each band of sizes its largest size, its number of blocks, and how many blocks may be left out."""
    num, den = threshold
    ends, low = [], 1
    while low < largest:
        ends.append(low * den // num)
        low = ends[-1] + 1
    ends.append(low * den // num)
    end = np.array(ends, np.int64)
    differ = 2 * end * (den - num) // (den + num)
    spare = np.where(differ > 0, -(-(differ + 1) // 10), 0)
    return end, differ + 1 + spare, spare


def _signatures(sets: np.ndarray, bounds: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the kept blocks of each set, and the set that each is of."""
    end, blocks, spare = bands(threshold)
    sizes = np.diff(bounds)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    value, place = mix(sets, 1), mix(sets, 2) >> np.uint64(33)
    keys, owners = [], []
    for step in (0, 1):
        band = np.searchsorted(end, np.maximum(sizes, 1)) + step
        many = np.where(sizes > 0, blocks[band], 0)
        first = np.concatenate([[0], np.cumsum(many)])
        where = first[rows] + (place % many[rows].astype(np.uint64)).astype(np.int64)
        word = np.zeros(first[-1], np.uint64)
        np.bitwise_xor.at(word, where, value)
        count = np.bincount(where, minlength=first[-1])
        owner = np.repeat(np.arange(len(sizes)), many)
        keep = np.ones(len(owner), bool)
        for most in (0, 1):
            light = count <= most
            drop = np.bincount(owner[light], minlength=len(sizes)) <= spare[band]
            keep &= ~(light & drop[owner])
        block = np.arange(first[-1]) - first[owner]
        label = (band[owner].astype(np.uint64) << np.uint64(40)) | block.astype(np.uint64)
        keys.append((mix(label, 3) ^ mix(word, 4))[keep])
        owners.append(owner[keep])
    return np.concatenate(keys), np.concatenate(owners)


def _batch(*columns: np.ndarray | pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
    n = len(columns[0])
    for i in range(0, n, OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + OUT_ROWS]) for x in columns], names=names)


def _block_rows(n_words: int, threshold: tuple[int, int]):  # noqa: ANN202
    names = ["key", "doc", "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for w in words(batch.column(1)):
                sets, bounds = shingle_sets(w, n_words)
                ids = docs[w.first : w.first + len(bounds) - 1]
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                total, odd = np.add.reduceat(sets, bounds[full]), np.bitwise_xor.reduceat(sets, bounds[full])
                fresh, copies = [], []
                for i, *mark in zip(full.tolist(), sizes[full].tolist(), total.tolist(), odd.tolist()):
                    first = seen.setdefault(tuple(mark), int(ids[i]))
                    if first == ids[i]:
                        fresh.append(i)
                    else:
                        copies.append((first, int(ids[i])))
                if copies:
                    c = np.array(copies, np.int64)
                    yield from _batch(c[:, 0], c[:, 1], np.ones(len(c), bool), names=names)
                keep = np.zeros(len(sizes), bool)
                keep[fresh] = True
                part = sets[np.repeat(keep, sizes)]
                keys, owner = _signatures(part, np.concatenate([[0], np.cumsum(sizes[keep])]), threshold)
                yield from _batch(keys.view(np.int64), ids[keep][owner], np.zeros(len(keys), bool), names=names)

    return run


class OpenRuns:
    """Rows of the runs that are longer than ``limit``; the first ones wait until their run gets there."""

    def __init__(self, limit: int) -> None:
        self.limit, self.waiting = limit, np.zeros((0, 2), np.int64)

    def feed(self, key: np.ndarray, doc: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row is in a run that is too long by now, and (key, doc) of those rows and of the ones that waited."""
        end = np.ones(len(key), bool)
        end[:-1] = key[1:] != key[:-1]
        stops = np.flatnonzero(end)
        long = index[stops[np.searchsorted(stops, np.arange(len(index)))]] >= self.limit
        rows = np.stack([key, doc], 1)
        same = len(self.waiting) > 0 and self.waiting[0, 0] == key[0]
        freed = self.waiting if same and long[0] else self.waiting[:0]
        tail = rows[key == key[-1]] if not long[-1] else rows[:0]
        whole_run = same and key[0] == key[-1] and not long[-1]
        self.waiting = np.concatenate([self.waiting, tail]) if whole_run else tail
        return long, np.concatenate([freed, rows[long]])


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies; all pairs of short runs; pairs with the first row of long runs, and the rows of these."""
    names = ["kind", "a", "b"]
    runs, opened, held = KeyRuns(WINDOW), OpenRuns(WINDOW + 1), []
    for batch in batches:
        key, doc = (batch.column(i).to_numpy() for i in (0, 1))
        copy = batch.column(2).to_numpy(zero_copy_only=False)
        yield from _out(COPY, key[copy], doc[copy], names)
        key, doc = key[~copy], doc[~copy]
        if not len(key):
            continue
        head, previous, index, _ = runs.feed(key, doc)
        all_doc = runs.rows[1]
        long, rows = opened.feed(key, doc, index)
        yield from _out(OPEN, rows[:, 0], rows[:, 1], names)
        pairs = [np.stack([all_doc[head], doc], 1)]
        pairs += [np.stack([all_doc[p[good]], doc[good]], 1) for p in previous for good in [(p >= 0) & ~long]]
        pair = np.concatenate(pairs)
        held.append(np.sort(pair[pair[:, 0] != pair[:, 1]], 1))
        if sum(map(len, held)) >= PAIR_ROWS:
            yield from _out(PAIR, *_distinct(held), names)
            held = []
    if held:
        yield from _out(PAIR, *_distinct(held), names)


def _block_pairs(threshold: tuple[int, int]):  # noqa: ANN202
    """Pairs of different components in the runs of equal (key, part) of sorted rows, where sizes and sketches leave them possible.

    A part is one block of a key's rows, or two, whose rows then meet those of the other one.
    """
    num, den = threshold

    def pairs(part: int, side: np.ndarray, doc: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: list[bytes]) -> Iterator[np.ndarray]:
        mixed = part >> 31 != part & ((1 << 31) - 1)
        left, right = (np.flatnonzero(side == k) if mixed else np.arange(len(doc)) for k in (0, 1))
        for at in range(0, len(left), ROWS_AT_ONCE):
            i = left[at : at + ROWS_AT_ONCE]
            m, n = size[i][:, None], size[right][None, :]
            good = (root[i][:, None] != root[right][None, :]) & (np.abs(m - n) <= (m + n) * (den - num) // (den + num))
            x, y = np.nonzero(good if mixed else good & (i[:, None] < right[None, :]))
            x, y = i[x], right[y]
            for k in range(0, len(x), PAIRS_AT_ONCE):
                u, v = x[k : k + PAIRS_AT_ONCE], y[k : k + PAIRS_AT_ONCE]
                near = _close([sketch[j] for j in u.tolist()], [sketch[j] for j in v.tolist()], (size[u] + size[v]) * (den - num) // (den + num))
                yield np.sort(np.stack([doc[u[near]], doc[v[near]]]), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None

        def out(rows: list) -> Iterator[pa.RecordBatch]:
            for both in pairs(int(rows[1][0]), *rows[2:]):
                yield from _batch(both[0], both[1], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = [*(batch.column(i).to_numpy() for i in range(6)), batch.column(6).to_pylist()]
            edge = [0, *(np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1).tolist(), len(rows[0])]
            for a, b in zip(edge, edge[1:]):
                now = [x[a:b] for x in rows]
                if held and (held[0][0], held[1][0]) == (now[0][0], now[1][0]):
                    held = [np.concatenate([x, y]) if isinstance(x, np.ndarray) else x + y for x, y in zip(held, now)]
                    continue
                if held:
                    yield from out(held)
                held = now
        if held:
            yield from out(held)

    return run


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(pairs)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[new].T


def _out(kind: int, a: np.ndarray, b: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    if len(a):
        yield from _batch(np.full(len(a), kind, np.int32), a, b, names=names)


def _outline_rows(n_words: int):  # noqa: ANN202
    """Size and parity sketch of each row: two bits per shingle and more, a power of two, so that sketches can be folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0)
            for w in words(batch.column(1)):
                sets, bounds = shingle_sets(w, n_words)
                sizes = np.diff(bounds)
                bits = np.maximum(LEAST_BITS, 2 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
                first = np.concatenate([[0], np.cumsum(bits)])
                at = np.repeat(first[:-1], sizes) + (sets & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
                raw = np.packbits((np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8)).tobytes()
                sketch = [raw[a // 8 : b // 8] for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([docs.slice(w.first, len(sizes)), pa.array(sizes), pa.array(sketch, pa.binary())], names=["doc", "size", "sketch"])

    return run


def _near(threshold: tuple[int, int]):  # noqa: ANN202
    """Pairs whose sizes and sketches leave it possible that they are similar."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(i).to_numpy() for i in (2, 3))
            most = (m + n) * (den - num) // (den + num)
            good = np.abs(m - n) <= most
            rows = np.flatnonzero(good)
            for at in range(0, len(rows), PAIRS_AT_ONCE):
                part = pa.array(rows[at : at + PAIRS_AT_ONCE])
                good[rows[at : at + PAIRS_AT_ONCE]] = _close(*(batch.column(i).take(part).to_pylist() for i in (4, 5)), most[rows[at : at + PAIRS_AT_ONCE]])
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _close(one: list[bytes], two: list[bytes], most: np.ndarray) -> np.ndarray:
    """Whether sketches differ in no more bits than ``most``, pair by pair; a longer one is folded to the other's length."""
    good = np.zeros(len(one), bool)
    lengths = np.array([[len(x) for x in one], [len(y) for y in two]]).reshape(2, -1)
    for p, q in np.unique(lengths, axis=1).T.tolist():
        rows = np.flatnonzero((lengths[0] == p) & (lengths[1] == q))
        x, y = (_folded([all_[j] for j in rows.tolist()], min(p, q)) for all_ in (one, two))
        good[rows] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most[rows]
    return good


def _folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of equal length as rows of 64-bit words, folded to ``size`` bytes."""
    x = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while x.shape[1] * 8 > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _set_rows(n_words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1)):
                sets, bounds = shingle_sets(w, n_words)
                raw = [sets[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(raw)), pa.array(raw, pa.binary())], names=["doc", "members"])

    return run


def _verify(threshold: tuple[int, int]):  # noqa: ANN202
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            sa, sb = batch.column(2), batch.column(3)
            for i in range(len(batch)):
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (sa, sb))
                if not len(x) or not len(y):
                    continue
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


def _with(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b) with columns of ``rows`` for both of them: x_a, x_b, y_a, y_b and so on."""
    for end in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("doc").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs.select("a", "b", *(f"{c}_{end}" for c in columns for end in ("a", "b")))


def _verified(docs: DataFrame, outlines: DataFrame, pairs: DataFrame, n_words: int, threshold: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose documents are similar: by their sketches, and then by their sets."""
    near = materialize(_with(pairs, outlines, "size", "sketch").mapInArrow(_near(threshold), "a long, b long").distinct())
    wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    kept = mapped(docs, wanted).join(wanted, "doc_id", "left_semi").select("doc_id", "text")
    sets = materialize(kept.mapInArrow(_set_rows(n_words), "doc long, members binary"))
    return materialize(_with(near, sets, "members").mapInArrow(_verify(threshold), "a long, b long").distinct())


def jaccard_join(docs: DataFrame, n_words: int = 5, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``.

    Two documents link when the Jaccard similarity of their sets of distinct ``n_words``-word shingles is at least
    ``threshold``, a fraction of whole numbers. With fewer words the whole sequence is the only shingle; without words
    or with null text the set is empty and links with nothing. ``component_id`` is the smallest doc_id reachable by
    links, the document itself included.

    Rows that share a doc_id are one node and each give a row. A null doc_id gets its n_shingles and a null
    component_id. An empty table gives an empty result. Columns other than the two named are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = docs.where("doc_id is not null")
    outlines = materialize(docs.mapInArrow(_outline_rows(n_words), "doc long, size long, sketch binary"))
    rows = known.mapInArrow(_block_rows(n_words, threshold), _ROWS)
    by_key = rows.repartition("key").sortWithinPartitions("key", "doc")
    found = materialize(by_key.mapInArrow(_pair_rows, _FOUND))
    of = lambda kind: found.where(F.col("kind") == kind).select("a", "b")
    links = of(COPY)
    pairs, open_rows = of(PAIR).distinct(), of(OPEN).select(F.col("a").alias("key"), F.col("b").alias("doc"))
    links = links.union(_verified(known, outlines, materialize(pairs), n_words, threshold))
    roots = materialize(connected_components(links))
    again = materialize(_apart(open_rows, roots))
    if not again.isEmpty():
        fresh = _verified(known, outlines, materialize(_later_pairs(again, outlines, threshold)), n_words, threshold)
        roots = materialize(connected_components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(fresh)))
    return outlines.join(roots, outlines.doc == roots.node, "left").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))


def _apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """key, doc and root of the open rows whose runs reach into different components."""
    mine = rows.join(roots, rows.doc == roots.node, "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    apart = mine.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return mine.join(apart, "key", "left_semi").select("key", "doc", "root").distinct()


def _later_pairs(rows: DataFrame, outlines: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs of the open runs that lie in different components and may be similar.

    A run is cut into blocks by hash, and every two blocks meet once, so no task holds more of a run than two of them.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    rows = rows.select("key", "doc", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    part = F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other")
    rows = rows.select("key", part.alias("part"), (F.col("block") > F.col("other")).cast("long").alias("side"), "doc", "root")
    rows = rows.join(outlines.select("doc", "size", "sketch"), "doc").select("key", "part", "side", "doc", "root", "size", "sketch")
    by_part = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return by_part.mapInArrow(_block_pairs(threshold), "a long, b long").distinct()
