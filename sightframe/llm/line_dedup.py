"""Line dedup with two Bloom filters: lines seen once, and lines seen again.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; a document counts once for
each of its keys.

1. Every task sends its keys through two Bloom filters: a key that the first one holds already goes into the second,
   and all go into the first. Tasks' filters are merged part by part: what two first filters share, bit by bit, belongs
   into the second. The filters have BITS_PER_LINE bits per line, and MOST_BITS at most: beyond that more keys are
   suspected, and nothing else changes.
2. Only keys that the second filter holds, the suspected repeats, are shuffled, added up before that, and counted exactly.
3. The lines of repeated keys are dropped. Repeated keys of up to MOST_KEYS bytes together are sent to all tasks; beyond
   that the documents that hold a suspected key are joined with theirs.

Results are exact, whatever the filters say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

BITS_PER_LINE, HASHES = 12, 2
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bytes of a part of a filter, and of all repeated keys that are sent to every task.
PART, MOST_KEYS = 1 << 14, 16 << 20
_BLANKS = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The keys of a text's lines, in order; a null or empty text has one empty line."""
    return [x.strip(_BLANKS).lower() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _key_lists(column: pa.Array) -> Iterator[set[bytes]]:
    """The distinct keys of each document that are not empty."""
    for text in column:
        keys = set(line_keys(text.as_py()))
        keys.discard(b"")
        yield keys


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """Positions in a filter, HASHES of them for each key, by double hashing."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)]).astype(np.int64)


def _holds(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(0)


def _put(filter_: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(filter_, places.ravel() >> 3, (1 << (places.ravel() & 7)).astype(np.uint8))


def _filter_rows(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            counts: dict[bytes, int] = {}
            for keys in _key_lists(batch.column(0)):
                for k in keys:
                    counts[k] = counts.get(k, 0) + 1
            places = _places(list(counts), bits)
            often = np.fromiter(counts.values(), np.int64, len(counts)) > 1
            _put(again, places[:, often | _holds(once, places)])
            _put(once, places)
        size = min(PART, bits // 8)
        parts = np.flatnonzero(once.reshape(-1, size).any(1))
        for i in range(0, len(parts), 64):
            some = parts[i : i + 64]
            blobs = [pa.array([f.reshape(-1, size)[p].tobytes() for p in some], pa.binary()) for f in (once, again)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *blobs], names=["part", "once", "again"])

    return run


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter's parts, from rows sorted by part."""
    part, once, again = None, None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([again.tobytes()], pa.binary())], names=["part", "again"])
    for batch in batches:
        for p, a, b in zip(*(batch.column(i) for i in range(3))):
            a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
            if p.as_py() != part:
                if part is not None:
                    yield done()
                part, once, again = p.as_py(), a.copy(), b.copy()
            else:
                again |= b | (once & a)
                once |= a
    if part is not None:
        yield done()


def repeat_filter(docs: DataFrame, text_col: str = "text", most_bits: int = MOST_BITS) -> np.ndarray:
    """The bytes of the Bloom filter of keys that two documents or more may hold: at most ``most_bits`` bits."""
    text = F.col(text_col)
    n = docs.select(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    bits = min(most_bits, max(LEAST_BITS, 1 << (BITS_PER_LINE * n).bit_length()))
    parts = docs.select(text.alias("text")).mapInArrow(_filter_rows(bits), "part int, once binary, again binary")
    merged = parts.repartition("part").sortWithinPartitions("part").mapInArrow(_merge_rows, "part int, again binary")
    out = np.zeros((max(1, bits // 8 // PART), min(PART, bits // 8)), np.uint8)
    for r in merged.collect():
        out[r["part"]] = np.frombuffer(r["again"], np.uint8)
    return out.ravel()


def repeated_keys(docs: DataFrame, least: int, text_col: str = "text", most_bits: int = MOST_BITS) -> tuple[DataFrame, Callable[[list[bytes]], np.ndarray]]:
    """key and n of the keys that ``least`` (2 or more) documents hold, and a function that tells which keys may be such."""
    shared = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, text_col, most_bits))

    def suspected(keys: list[bytes]) -> np.ndarray:
        return _holds(shared.value, _places(keys, shared.value.size * 8)) if keys else np.zeros(0, bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[bytes, int] = {}
            for keys in _key_lists(batch.column(0)):
                for k in keys:
                    counts[k] = counts.get(k, 0) + 1
            keys = list(counts)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "n": pa.array(counts.values(), pa.int64())}).filter(pa.array(suspected(keys)))

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return materialize(counts.where(F.col("n") >= least)), suspected


def _without(text: str | None, gone: set[bytes] | frozenset[bytes]) -> tuple[int, int, str]:
    """Lines, dropped lines and the rest of a text without the lines whose keys are in ``gone``."""
    lines = (text or "").split("\n")
    kept = [x for x, k in zip(lines, line_keys(text)) if k not in gone]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _cut_rows(gone_of: Callable[[pa.RecordBatch], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From doc_id, text and more to doc_id and what :func:`_without` says, with a set of keys for each row of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, kept = zip(*(_without(t.as_py(), g) for t, g in zip(batch.column(1), gone_of(batch)))) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def line_dedup(docs: DataFrame, least: int = 10, text_col: str = "text", id_col: str = "doc_id", most_keys: int = MOST_KEYS, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept: each text without the lines whose key ``least`` documents or more hold.

    All lines of such a key go, in every document. A null or empty text is one empty line; empty keys never go. Rows
    that repeat a doc_id or a whole row count as documents of their own, and so do null ids. Very long lines and texts
    are worked on whole. An empty table gives an empty result; columns besides the two are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    keys, suspected = repeated_keys(rows, least, "text", most_bits)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string"
    if (keys.select(F.sum(F.length("key") + 64).alias("s")).first()["s"] or 0) <= most_keys:
        gone = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r["key"]) for r in keys.select("key").collect()))
        return rows.mapInArrow(_cut_rows(lambda batch: (gone.value for _ in range(len(batch)))), schema)
    listed = lambda batch: (frozenset(x.as_py() or ()) for x in batch.column(2))
    return _joined(rows, keys, suspected).mapInArrow(_cut_rows(listed), schema)


def _joined(rows: DataFrame, keys: DataFrame, suspected: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """``rows`` with gone, their own repeated keys. Equal texts have equal keys, so distinct texts are joined, by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found, seen = [], [], set()
            for text in batch.column(0):
                value = (text.as_py() or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(value).digest()
                if digest not in seen:
                    seen.add(digest)
                    mine = sorted(set(line_keys(text.as_py())) - {b""})
                    mine = [k for k, s in zip(mine, suspected(mine)) if s]
                    digests += [digest] * len(mine)
                    found += mine
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "key": pa.array(found, pa.binary())})

    held = rows.select("text").mapInArrow(run, "digest binary, key binary").distinct().join(keys.select("key"), "key")
    gone = materialize(held.groupBy("digest").agg(F.collect_list("key").alias("gone")))
    marked = rows.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    return marked.join(gone, "digest", "left").select("doc_id", "text", "gone")


def first_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most_bits: int = MOST_BITS) -> DataFrame:
    """key, doc_id and line of the first occurrence (smallest doc_id, then line from 0) of every key that repeats.

    Only suspected repeats are shuffled; their first place and count are found before that in every task. Keys that
    one document alone repeats count too. Null ids come last.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, suspected = repeated_keys(rows, 2, "text", most_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, keys, counts = [], [], [], []
            for i, text in zip(batch.column(0), batch.column(1)):
                places: dict[bytes, list[int]] = {}
                for n, k in enumerate(line_keys(text.as_py())):
                    places.setdefault(k, []).append(n)
                places.pop(b"", None)
                for (k, at), s in zip(places.items(), suspected(list(places))):
                    if s or len(at) > 1:
                        ids.append(i.as_py())
                        lines.append(at[0])
                        keys.append(k)
                        counts.append(len(at))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "doc_id": pa.array(ids, pa.int64()), "line": pa.array(lines, pa.int64()), "n": pa.array(counts, pa.int64())})

    found = rows.mapInArrow(run, "key binary, doc_id long, line long, n long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line")).alias("first")
    return found.groupBy("key").agg(first, F.sum("n").alias("n")).where("n > 1").select("key", "first.doc_id", "first.line", "n")


#: The query's rows in DuckDB's SQL.
ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
keyed AS (SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
gone AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(g.key)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN gone g USING (key) JOIN docs USING (r) GROUP BY r, doc_id
"""


__all__ = ["first_lines", "line_dedup", "line_keys", "repeat_filter", "repeated_keys"]
