"""Conflict-constrained best-fit packing of documents into sequences of bounded length.

Documents are cut into pieces of at most ``capacity`` words, and pieces are put into bins. Pieces of the same source or
of the same duplicate cluster never share a bin. Within a group the pieces go in order of falling size, each into the
tightest bin that takes it: bins are kept by residual, the next residual in use is found by a bit search, and the search
goes on to larger residuals until a bin is compatible. Bins carry bitmaps of their sources and clusters; where a bit
is set, the exact sets decide.

Groups are of about GROUP pieces, dealt by a hash of the document, so a source or cluster that holds a third of the
rows is spread over all of them, and the work of a task does not grow with the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .text import mix, sequence_hash, words

CAPACITY, GROUP = 1024, 4096
_PIECES = "doc_id long, source string, cluster long, piece int, start_word long, n_words int, salt long"
PLACED = "doc_id long, piece int, start_word long, n_words int, source string, cluster long, bin_id long, place int, bin_words int"


def _piece_rows(capacity: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            ids, sources, given = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for w in words(batch.column(1)):
                out: list[tuple] = []
                for i in range(len(w.offsets) - 1):
                    r, h = w.first + i, w.hashes[w.offsets[i] : w.offsets[i + 1]]
                    same = sequence_hash(h) >> 1 if len(h) else 0
                    cluster = given[r] if given[r] is not None else same
                    name = (ids[r] if ids[r] is not None else -1, same)
                    seen[name] += 1
                    salt = int(mix(np.array([name[0] & (2**64 - 1)], np.uint64), 11)[0]) ^ (seen[name] * 0x9E3779B97F4A7C15 & (2**64 - 1))
                    for piece, start in enumerate(range(0, max(len(h), 1), capacity)):
                        out.append((ids[r], sources[r], cluster, piece, start, min(capacity, len(h) - start), (salt >> 1) + piece))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


def best_fit(sizes: list[int], sources: list, clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item and the fill of each bin; items are taken in the order given."""
    by_residual: dict[int, list[int]] = {}
    in_use, residual, source_bits, cluster_bits = 0, [], [], []
    sources_in: list[set] = []
    clusters_in: list[set] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s_bit = 0 if source is None else 1 << (hash(source) & 63)
        c_bit = 1 << (cluster & 63)
        found, rest = -1, in_use >> size << size
        while rest:
            r = (rest & -rest).bit_length() - 1
            for b in by_residual[r]:
                if source_bits[b] & s_bit and source in sources_in[b] or cluster_bits[b] & c_bit and cluster in clusters_in[b]:
                    continue
                found = b
                break
            if found >= 0:
                by_residual[r].remove(found)
                if not by_residual[r]:
                    in_use &= ~(1 << r)
                break
            rest &= rest - 1
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            source_bits.append(0)
            cluster_bits.append(0)
            sources_in.append(set())
            clusters_in.append(set())
        residual[found] -= size
        source_bits[found] |= s_bit
        cluster_bits[found] |= c_bit
        sources_in[found].add(source)
        clusters_in[found].add(cluster)
        if residual[found]:
            by_residual.setdefault(residual[found], []).append(found)
            in_use |= 1 << residual[found]
        placed.append(found)
    return placed, [capacity - r for r in residual]


def _pack_group(capacity: int):  # noqa: ANN202
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "piece", "salt"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, fill = best_fit(rows["n_words"].tolist(), [None if x is None or x != x else x for x in rows["source"]], rows["cluster"].tolist(), capacity)
        rows["bin_id"] = (int(key[0]) << 20) + np.array(bins, np.int64)
        rows["place"] = rows.groupby("bin_id").cumcount().astype(np.int32)
        rows["bin_words"] = np.array(fill, np.int32)[bins]
        return rows[[x.split()[0] for x in PLACED.split(", ")]]

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """One row per piece of a document: its words, its bin, its place there, and how many words the bin holds.

    ``cluster_col`` names a column of duplicate clusters; without one (or where it is null) documents with the same
    words are a cluster. Pieces of one document are of one cluster and so never share a bin. A null source conflicts
    with nothing. Documents without words (null or empty text) have one row with 0 words, a null bin and a null place.
    A null doc_id is packed like any other and rows that repeat are packed one by one. An empty table gives an empty
    result; other columns are not read.
    """
    given = F.col(cluster_col).cast("long") if cluster_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(source_col).cast("string"), given)
    pieces = materialize(rows.mapInArrow(_piece_rows(capacity), _PIECES))
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.where("n_words > 0").withColumn("bucket", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    packed = dealt.groupBy("bucket").applyInPandas(_pack_group(capacity), PLACED)
    none = [F.lit(None).cast(t) for t in ("long", "int", "int")]
    return packed.union(pieces.where("n_words <= 0").select("doc_id", "piece", "start_word", "n_words", "source", "cluster", *none))
