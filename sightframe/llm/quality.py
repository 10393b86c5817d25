"""Quality classifier from weak labels.

Labellers vote on every document: 1 rejects it, 0 keeps it, -1 says nothing. Most are rules; one is a lexicon learned
from documents that are annotated as toxic, and the annotations themselves are one as well. Expectation-maximisation
over how often each pattern of votes occurs estimates how accurate each of them is (a Dawid-Skene model with good
documents and several kinds of bad ones), the annotators no less than the others; what it needs from the corpus are the counts of at most 3 ** 7
patterns, whatever the number of documents. The model gives every document a probability of being bad, annotated or
not, and on these a linear scorer is fitted, over hashed words, hashed beginnings of words and the votes of all but the
annotators. The scorer alone decides, so it also judges documents on which the labellers are silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import in_share
from .store import materialize
from .text import PUNCTUATION, Words, mix, row_chunks, shingle_stream, words

LABELLERS = ("symbols", "shouting", "repetition", "tables", "lexicon", "word_length", "annotation")
#: Documents that the scorer is fitted on, at most: half of them annotated and half not, where there are so many.
SAMPLE = 8_000
#: Size of the hashed feature space, bytes of a word's beginning, score from which a document goes.
BUCKETS, BEGINNING, REJECT = 1 << 18, 5, 0.5
#: Buckets that get a weight at most, least log odds either way and least standard errors of those, and the penalty on weights.
COLUMNS, LEAST_ODDS, LEAST_CLEAR, PENALTY = 512, 1.5, 3.0, 0.3
#: Min-hashes by which copies in the sample are known; words of the lexicon at most; least log odds, standard errors and
#: toxic documents of each; and different ones that a document has when the lexicon rejects it.
MARKS, LEXICON, LOADED_ODDS, LOADED_CLEAR, LOADED_DOCS, LOADED_HITS = 4, 256, 3.0, 2.5, 4, 2

_LETTERS = np.array([chr(i).isalpha() or i >= 128 for i in range(256)])
_UPPER = np.array([ord("A") <= i <= ord("Z") for i in range(256)])
_LOWER = np.array([ord("a") <= i <= ord("z") for i in range(256)])
_SYMBOLS = np.array([chr(i) in "#$%&*@^~|<>{}[]=+_\\/" for i in range(256)])
_NO_VOTES = 3 ** (len(LABELLERS) - 1)


def _class_counts(column: pa.Array) -> np.ndarray:
    """Per row the bytes that are upper, lower, symbols and pipes, and all that are not white space."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    kinds = [_UPPER, _LOWER, _SYMBOLS, np.arange(256) == ord("|"), np.arange(256) > 0x20]
    out = np.zeros((len(kinds), len(column)), np.int64)
    for a, b in row_chunks(offsets):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        for k, kind in enumerate(kinds):
            total = np.concatenate([[0], np.cumsum(kind[part], dtype=np.int64)])
            out[k, a:b] = total[at[1:]] - total[at[:-1]]
    return out


def votes(column: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """Votes of all labellers but the annotation, one row per labeller, for a column of texts; the lexicon is of hashed words."""
    n = len(column)
    upper, lower, symbols, pipes, ink = _class_counts(column)
    out = np.full((len(LABELLERS) - 1, n), -1, np.int64)
    share = symbols / np.maximum(ink, 1)
    out[0][share > 0.04], out[0][(share < 0.01) & (ink > 0)] = 1, 0
    shout = upper / np.maximum(upper + lower, 1)
    out[1][(shout > 0.4) & (upper > 20)], out[1][(shout < 0.15) & (lower > 0)] = 1, 0
    loaded = np.zeros(BUCKETS, bool)
    loaded[lexicon] = True
    for w in words(column, PUNCTUATION):
        counts = np.diff(w.offsets)
        rows = np.arange(len(counts)) + w.first
        owner = np.repeat(np.arange(len(counts)), counts)
        again = np.zeros(len(w.hashes), np.int64)
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
        repeat = np.bincount(owner, again, len(counts)) / np.maximum(counts, 1)
        out[2][rows[(repeat > 0.2) & (counts >= 10)]], out[2][rows[(repeat < 0.05) & (counts > 0)]] = 1, 0
        row_pipes = pipes[rows] / np.maximum(counts, 1)
        out[3][rows[(row_pipes > 0.25) & (counts > 0)]], out[3][rows[(row_pipes < 0.02) & (counts > 0)]] = 1, 0
        bucket = (w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        hit = loaded[bucket]
        different = np.unique(owner[hit] * BUCKETS + bucket[hit])
        out[4][rows[np.bincount(different // BUCKETS, minlength=len(counts)) >= LOADED_HITS]] = 1
        length = np.bincount(owner, w.ends - w.starts, len(counts)) / np.maximum(counts, 1)
        out[5][rows[(length > 20) & (counts > 0)]], out[5][rows[(length > 2) & (length < 14)]] = 1, 0
    return out


def _pattern(v: np.ndarray) -> np.ndarray:
    """Votes as a number of base three, with no annotation yet."""
    return ((v + 1) * 3 ** np.arange(len(v))[:, None]).sum(0)


def _vote_rows(lexicon: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pattern(votes(batch.column(1), lexicon)).astype(np.int32))], names=["doc_id", "pattern"])

    return run


def fit_labellers(counts: dict[int, int]) -> dict[int, float]:
    """The probability of being bad for every pattern of votes, by expectation-maximisation.

    Documents are bad in one of several kinds, to begin with one for each labeller that rejects them, since labellers
    look for different faults and are independent only within a kind. How often each labeller says what about good
    documents and about each kind is estimated, the annotation included.
    """
    if not counts:
        return {}
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns], float)
    v = np.stack([patterns // 3**k % 3 for k in range(len(LABELLERS))])  # 0 silent, 1 keeps, 2 rejects
    rejects = (v == 2).astype(float)
    any_ = rejects.sum(0)
    kinds = np.where(any_ > 0, 0.95 * rejects / np.maximum(any_, 1), 0.02 / len(LABELLERS))
    share = np.vstack([1 - kinds.sum(0), kinds])
    for _ in range(300):
        likely = np.log((share @ n + 0.1) / (n.sum() + 0.1 * len(share)))[:, None] * np.ones(len(n))
        for k in range(len(LABELLERS)):
            rate = np.stack([(share * n)[:, v[k] == s].sum(1) + 0.1 for s in range(3)], 1)
            rate /= rate.sum(1, keepdims=True)
            if LABELLERS[k] == "annotation":  # whether a document is annotated says nothing about it
                silent = n[v[k] == 0].sum() / n.sum()
                rate[:, 1:] *= (1 - silent) / rate[:, 1:].sum(1, keepdims=True)
                rate[:, 0] = max(silent, 1e-12)
            likely += np.log(np.maximum(rate, 1e-12))[:, v[k]]
        new = np.exp(likely - likely.max(0))
        new /= new.sum(0)
        done, share = np.abs(new - share).max() < 1e-9, new
        if done:
            break
    return dict(zip(patterns.tolist(), (1 - share[0]).tolist()))


def _features(w: Words, v: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of each row: its distinct words and beginnings, and a bucket for each vote that rejects."""
    mask = np.uint64(BUCKETS - 1)
    for i in range(len(w.offsets) - 1):
        a, b = w.offsets[i], w.offsets[i + 1]
        hashed = np.sort(np.concatenate([w.hashes[a:b] & mask, w.prefixes[a:b] & mask, _vote_buckets(v[:, w.first + i])]))
        yield hashed[np.concatenate([[True], hashed[1:] != hashed[:-1]])].astype(np.int32) if len(hashed) else hashed.astype(np.int32)


def _vote_buckets(v: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(v == 1) * 7919 + 104729).astype(np.uint64) & np.uint64(BUCKETS - 1)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each text without votes, its words alone, and min-hashes of its five-word shingles, by which copies are known."""
    mask = np.uint64(BUCKETS - 1)
    for batch in batches:
        silent = np.zeros((len(LABELLERS) - 1, len(batch)), np.int64)
        for w in words(batch.column(1), PUNCTUATION, BEGINNING):
            raw = [x.tobytes() for x in _features(w, silent)]
            own = [np.unique(w.hashes[a:b] & mask).astype(np.int32).tobytes() for a, b in zip(w.offsets, w.offsets[1:])]
            marks = []
            for a, b in zip(w.offsets, w.offsets[1:]):
                s = shingle_stream(w.hashes[a:b], min(5, max(int(b - a), 1)))
                marks.append([int(mix(s, 80 + k).min() >> np.uint64(1)) for k in range(MARKS)] if len(s) else [])
            kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(raw)), *(pa.array(x, k) for x, k in zip((raw, own, marks), kinds))], names=["doc_id", "buckets", "words", "marks"])


def without_copies(sample: list) -> list:
    """The rows that share no mark with one before them: a fault that is copied is seen once."""
    seen: set[tuple[int, int]] = set()
    out = []
    for r in sample:
        marks = set(enumerate(r["marks"]))
        if not marks & seen:
            out.append(r)
        seen |= marks
    return out


def _odds(buckets: list[np.ndarray], bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each bucket the documents against and for, their log odds, and how many standard errors those are from nought."""
    sizes = np.array([len(x) for x in buckets])
    flat, owner = np.concatenate(buckets).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    p, n = np.bincount(flat, bad[owner], BUCKETS), np.bincount(flat, 1 - bad[owner], BUCKETS)
    odds = np.log((p + 0.5) / (bad.sum() + 1)) - np.log((n + 0.5) / ((1 - bad).sum() + 1))
    return p, n, odds, odds / np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))


def learn_lexicon(words_of: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Hashed words that are clearly more frequent in documents annotated as toxic."""
    if not len(words_of) or not 0 < toxic.sum() < len(toxic):
        return np.zeros(0, np.int64)
    p, _, odds, clear = _odds(words_of, toxic)
    chosen = np.flatnonzero((odds > LOADED_ODDS) & (clear > LOADED_CLEAR) & (p >= LOADED_DOCS))
    return np.sort(chosen[np.argsort(-clear[chosen], kind="stable")][:LEXICON])


def fit_scorer(buckets: list[np.ndarray], bad: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on the buckets that speak most clearly for or against a document.

    Buckets are ranked by how many standard errors their log odds are from nought; the best COLUMNS of those beyond the
    bounds, on either side, are fitted together by Newton's method with a quadratic penalty. All other weights are nought.
    """
    weights = np.zeros(BUCKETS, np.float32)
    if not len(buckets):
        return weights, -1.0
    sizes = np.array([len(x) for x in buckets])
    flat, owner = np.concatenate(buckets).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    p, n, odds, clear = _odds(buckets, bad)
    chosen = np.flatnonzero((np.abs(odds) > LEAST_ODDS) & (np.abs(clear) > LEAST_CLEAR) & (p + n >= 4))
    chosen = chosen[np.argsort(-np.abs(clear[chosen]), kind="stable")][:COLUMNS]
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sizes), len(chosen) + 1))
    at = column[flat]
    x[owner[at >= 0], at[at >= 0]] = 1
    x[:, -1] = 1
    beta, penalty = np.zeros(len(chosen) + 1), np.full(len(chosen) + 1, PENALTY)
    penalty[-1] = 1e-3
    for _ in range(20):
        said = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (said * (1 - said))[:, None]).T @ x + np.diag(penalty), x.T @ (bad - said) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights[chosen] = beta[:-1]
    return weights, float(beta[-1])


class Model:
    """What was learned: the lexicon, posteriors by pattern, and the scorer."""

    def __init__(self, lexicon: np.ndarray, posterior: dict[int, float], weights: np.ndarray, bias: float) -> None:
        self.lexicon, self.posterior, self.weights, self.bias = lexicon, posterior, weights, bias

    def scores(self, column: pa.Array) -> np.ndarray:
        out, v = np.zeros(len(column)), votes(column, self.lexicon)
        for w in words(column, PUNCTUATION, BEGINNING):
            for i, x in enumerate(_features(w, v)):
                out[w.first + i] = self.weights[x].sum(dtype=np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _annotated(labels: DataFrame) -> DataFrame:
    """doc_id, vote and toxic of the annotated documents; several annotations of one count as bad if any is."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    vote = F.when(bad, 2).when((F.col("toxic") == 0) | (F.col("quality") == 1), 1)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), vote.alias("vote"), (F.col("toxic") == 1).alias("toxic"))
    return rows.where("doc_id is not null and vote is not null").groupBy("doc_id").agg(F.max("vote").alias("vote"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from ``docs`` and, where given, the annotations in ``labels`` (doc_id, quality, toxic).

    Votes are counted over all documents. The lexicon and the scorer are fitted on a sample of at most about SAMPLE
    documents, by a hash of doc_id; of rows that repeat a doc_id the least text counts there, and of
    copies the one of the least doc_id. Rows without doc_id or
    text are voted on and are in no sample. Without annotations there is no lexicon.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    annotated = _annotated(labels)
    known = materialize(rows.where("doc_id is not null and text is not null").select("doc_id").distinct().join(annotated, "doc_id", "left"))
    size = known.agg(F.count("*").alias("n"), F.count("vote").alias("annotated")).first()
    shares = [SAMPLE / 2 / max(n, 1) for n in (size["annotated"], size["n"] - size["annotated"])]
    # At most about SAMPLE rows, by these shares.
    chosen = known.where(F.when(F.col("vote").isNotNull(), in_share("doc_id", shares[0])).otherwise(in_share("doc_id", shares[1])))
    texts = rows.where("text is not null").where(in_share("doc_id", max(shares))).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text")).mapInArrow(_feature_rows, "doc_id long, buckets binary, words binary, marks array<long>")
    sample = sorted(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "vote", "toxic", "buckets", "words", "marks").collect(), key=lambda r: r["doc_id"])
    sample = without_copies(sample)
    judged = [r for r in sample if r["toxic"] is not None]
    lexicon = learn_lexicon([np.frombuffer(r["words"], np.int32) for r in judged], np.array([float(r["toxic"]) for r in judged]))
    voted = rows.mapInArrow(_vote_rows(lexicon), "doc_id long, pattern int").join(annotated, "doc_id", "left")
    voted = materialize(voted.select("doc_id", (F.col("pattern") + F.coalesce("vote", F.lit(0)) * _NO_VOTES).alias("pattern")))
    posterior = fit_labellers({r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()})
    own = voted.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("pattern").alias("pattern"))
    patterns = {r["doc_id"]: r["pattern"] for r in own.collect()}
    buckets, bad = [], []
    for r in sample:
        v = np.array([patterns[r["doc_id"]] // 3**k % 3 - 1 for k in range(len(LABELLERS) - 1)])
        buckets.append(np.union1d(np.frombuffer(r["buckets"], np.int32), _vote_buckets(v).astype(np.int32)))
        bad.append(posterior[patterns[r["doc_id"]]])
    weights, bias = fit_scorer(buckets, np.array(bad))
    return Model(lexicon, posterior, weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bad_score (0 to 1) and kept of every row; null and empty texts have no words and score as the bias says."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s < REJECT)], names=["doc_id", "bad_score", "kept"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, bad_score double, kept boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, with the same columns, whatever their names.

    Null and empty texts have no words and are judged by the bias; texts are judged whole, however long. Rows that repeat
    are judged alike and each stay or go; null ids don't matter. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(batch.schema.get_field_index(text_col))) < REJECT))

    return docs.mapInArrow(run, docs.schema)
