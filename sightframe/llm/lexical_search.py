"""Ranked lexical search with an index of two levels: byte impacts that are rounded up, and exact integers below them.

A term is a run of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`` with A-Z lower-cased. N counts the documents with terms, L
all terms of the corpus, n those of a document, df the documents that hold a term, tf its occurrences in one:

    w = floor(1000 ln((2 N + 2) / (2 df + 1))),  m = 10 + (90 n N) div L,  impact = (10^9 tf) div (1000 tf + 8 m)

and a document's score for a query is the sum of w * impact over the query's distinct terms.

1. The index holds n, the query terms (by number) and their tf for every document that has any; one scan makes it, and
   N, L and df are counted from it. Terms are compared by 64-bit hashes.
2. Each block of documents gets its impacts as bytes, rounded up: q = ceil(impact / STEP), so that
   (q - 1) * STEP < impact <= q * STEP. The sums of w * q and of w, times STEP, give every document's upper and lower
   bound for every query, in doubles that hold these whole numbers exactly: by a product of matrices for terms that many
   documents and queries hold, one by one for the others.
3. A document is scored exactly if its upper bound reaches the kth largest lower bound that its task has seen for the
   query so far. A task passes on the best k of each query, and the best k of those are the answer.

The queries come in blocks of at most BLOCK_TERMS terms, each a pass over the documents, so what is sent to the tasks and
what they hold is bounded. All documents are ranked; no bound is ever a guess.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize
from .text import PUNCTUATION, words

#: What a byte of impact stands for: the largest impact is below 10^6.
STEP = -(-(10**6) // 255)
#: Terms of a block of queries, with repeats; documents of a block, and cells of the matrix of its bounds.
BLOCK_TERMS, BLOCK_DOCS, BLOCK_CELLS = 1 << 18, 1024, 1 << 20
#: How many cells of a product of matrices take the time of one cell that is added by itself.
CHEAPER = 25


@dataclass
class Queries:
    """Some queries: their ids, and for each the numbers of its distinct terms; ``hashes`` are all terms, sorted."""

    ids: list
    terms: list[np.ndarray]
    hashes: np.ndarray


def term_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of each text's terms, in order."""
    for w in words(texts, space=PUNCTUATION):
        for i in range(len(w.offsets) - 1):
            yield w.hashes[w.offsets[i] : w.offsets[i + 1]]


def _query_block(rows: list) -> Queries:
    found = [np.unique(h) for h in term_hashes(pa.array([r["text"] for r in rows], pa.string()))]
    every = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
    return Queries([r["item_id"] for r in rows], [np.searchsorted(every, f) for f in found], every)


def query_blocks(items: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[Queries]:
    """The queries (item_id, text) in blocks of about ``block_terms`` terms, or of one longer query."""
    sized = items.select("item_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    parts = 1 + (sized.agg(F.sum("size")).first()[0] or 0) // (2 * block_terms)  # a term takes two characters with what ends it
    numbered = sized.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for part in range(parts):
        rows = numbered.where(F.col("part") == part).select("item_id", "text").collect()
        if rows:
            yield _query_block(rows)


_INDEX = "doc_id long, n long, terms array<int>, counts array<int>"


def _index_rows(hashes: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for w in words(batch.column(1), space=PUNCTUATION):
                sizes = np.diff(w.offsets)
                rows = np.repeat(np.arange(len(sizes)), sizes)
                at = np.minimum(np.searchsorted(hashes, w.hashes), max(len(hashes) - 1, 0))
                wanted = hashes[at] == w.hashes if len(hashes) else np.zeros(len(at), bool)
                pairs, tf = np.unique(rows[wanted] * len(hashes) + at[wanted], return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(len(sizes) + 1) * len(hashes)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v.astype(np.int32))) for v in (pairs % max(len(hashes), 1), tf)]
                ids = batch.column(0).slice(done, len(sizes))
                done += len(sizes)
                out = pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(sizes > 0))

    return run


def index_documents(docs: DataFrame, queries: Queries, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, terms and counts of every document with a term: its number of terms, and the query terms among them."""
    hashes = docs.sparkSession.sparkContext.broadcast(queries.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _index_rows(hashes.value)(batches)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _INDEX)


def corpus_counts(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L, and df of every query term."""
    row = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = np.zeros(n_terms, np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    return row["n"], row["l"], df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Search:
    """The best ``k`` documents of each query among the blocks of documents that it is given."""

    def __init__(self, queries: Queries, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> None:
        self.terms, self.weight, self.n_docs, self.n_terms, self.k = queries.terms, weight, n_docs, n_terms, k
        of_query = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])
        of_term = np.concatenate([*self.terms, np.zeros(0, np.int64)]).astype(np.int64)
        self.queries_of = of_query[np.argsort(of_term, kind="stable")]  # the queries of each term, term by term
        self.start = np.searchsorted(np.sort(of_term), np.arange(len(weight) + 1))
        self.floor = np.zeros((k, len(self.terms)))  # the k largest lower bounds of each query
        self.best = [np.zeros((3, 0), np.int64) for _ in self.terms]  # for each query -score, whether the id is null, id

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 10 + (90 * n * self.n_docs) // self.n_terms
        return (10**9 * tf) // (1000 * tf + 8 * m)

    def feed(self, ids: np.ndarray, none: np.ndarray, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        """A block of documents: ids, numbers of terms, and from ``bounds[i]`` to ``bounds[i + 1]`` the terms and tf of each."""
        if not len(terms):
            return
        rows = np.repeat(np.arange(len(ids)), np.diff(bounds))
        impact = self.impacts(n[rows], tf)
        level = (-(-impact // STEP)).astype(float)  # the bytes
        here, column, held = np.unique(terms, return_inverse=True, return_counts=True)
        asked = self.start[here + 1] - self.start[here]
        dense = held * asked * CHEAPER > len(ids) * len(self.terms)
        place = np.cumsum(dense) - 1
        matrix = np.zeros((2, len(ids), int(dense.sum())))
        often = dense[column]
        matrix[:, rows[often], place[column[often]]] = np.stack([level[often], np.ones(often.sum())])
        width = max(1, BLOCK_CELLS // len(ids))
        for first in range(0, len(self.terms), width):
            span = min(width, len(self.terms) - first)
            top, sure = self._sums(first, span, here[dense], matrix, rows[~often], terms[~often], level[~often])
            self._take(first, top * STEP, (top - sure) * STEP, ids, none, bounds, terms, impact)

    def _pairs(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place in ``terms`` and the query of every term and query that holds it."""
        n = self.start[terms + 1] - self.start[terms]
        at = np.repeat(np.arange(len(terms)), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        return at, self.queries_of[self.start[terms][at] + within]

    def _sums(self, first: int, span: int, dense: np.ndarray, matrix: np.ndarray, rows: np.ndarray, terms: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of w * q and of w, by document and query from ``first`` on."""
        w = np.zeros((len(dense), span))
        at, query = self._pairs(dense)
        mine = (query >= first) & (query < first + span)
        w[at[mine], query[mine] - first] = self.weight[dense[at[mine]]]
        at, query = self._pairs(terms)
        mine = (query >= first) & (query < first + span)
        at, query = at[mine], query[mine] - first
        cell, weight = rows[at] * span + query, self.weight[terms[at]]
        shape = matrix.shape[1], span
        add = lambda x: np.bincount(cell, weight * x, shape[0] * shape[1]).reshape(shape)
        return matrix[0] @ w + add(level[at]), matrix[1] @ w + add(1.0)

    def _take(self, first: int, top: np.ndarray, low: np.ndarray, ids: np.ndarray, none: np.ndarray, bounds: np.ndarray, terms: np.ndarray, impact: np.ndarray) -> None:
        """Score the documents whose upper bound reaches the kth largest lower bound, and keep the best."""
        here = slice(first, first + top.shape[1])
        both = np.concatenate([self.floor[:, here], low])
        self.floor[:, here] = np.partition(both, len(both) - self.k, axis=0)[-self.k :]
        wanted = (top >= self.floor[:, here].min(0)) & (top > 0)
        for q in np.flatnonzero(wanted.any(0)):
            docs = np.flatnonzero(wanted[:, q])
            sizes = bounds[docs + 1] - bounds[docs]
            of = np.repeat(np.arange(len(docs)), sizes)
            at = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[docs][of]
            held = np.isin(terms[at], self.terms[first + q])
            at, of = at[held], of[held]
            score = np.zeros(len(docs), np.int64)
            np.add.at(score, of, self.weight[terms[at]] * impact[at])
            rows = np.concatenate([self.best[first + q], np.stack([-score, none[docs], ids[docs]])[:, score > 0]], axis=1)
            self.best[first + q] = rows[:, np.lexsort(rows[::-1])[: self.k]]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """The documents of a batch in blocks for :meth:`Search.feed`."""
    none = np.asarray(batch.column(0).is_null()).astype(np.int64)
    ids, n = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
    offsets = batch.column(2).offsets.to_numpy()
    bounds = (offsets - offsets[0]).astype(np.int64)
    terms, tf = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
    for a in range(0, len(ids), BLOCK_DOCS):
        b = min(a + BLOCK_DOCS, len(ids))
        yield ids[a:b], none[a:b], n[a:b], bounds[a : b + 1] - bounds[a], terms[bounds[a] : bounds[b]], tf[bounds[a] : bounds[b]]


def _search_block(docs: DataFrame, queries: Queries, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    index = materialize(index_documents(docs, queries, id_col, text_col))
    n_docs, n_terms, df = corpus_counts(index, len(queries.hashes))
    shared = spark.sparkContext.broadcast((queries, weights(n_docs, df)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        search = Search(queries, weight, n_docs, n_terms, k)
        for batch in batches:
            for block in _blocks(batch):
                search.feed(*block)
        score, none, ids = np.concatenate([*search.best, np.zeros((3, 0), np.int64)], axis=1)
        q = np.repeat(np.arange(len(search.best), dtype=np.int32), [rows.shape[1] for rows in search.best])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=none > 0), pa.array(-score)], names=["q", "doc_id", "score"])

    found = index.where(F.size("terms") > 0).mapInArrow(run, "q int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(queries.ids)), "q int, item_id long")
    return best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents with a score above 0 of every item (item_id, text).

    Equal scores are ranked by doc_id, null last; rows that repeat a doc_id are documents of their own, and items that
    repeat an item_id queries of their own. Null and empty texts have no terms: such documents are not counted and such
    items find nothing. Very long texts are indexed whole. Without documents or items the result is empty. Columns
    besides ids and texts are not read.
    """
    out = None
    for queries in query_blocks(items, block_terms):
        found = _search_block(docs, queries, k, id_col, text_col)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The query's rows in DuckDB's SQL.
ORACLE_SQL = f"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term, n_docs),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), corpus GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


__all__ = ["Queries", "Search", "corpus_counts", "index_documents", "query_blocks", "search", "weights"]
