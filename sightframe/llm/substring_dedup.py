"""Substring dedup with compact windows: near-duplicate passages that different documents share.

The tokens are hashed five-word shingles. For each of ``N_HASHES`` orders of them, every passage of at least
``min_words`` words has its min-hash at exactly one place, and the passages with the same place form a compact window
(l, c, r): all passages that begin in [l, c] and end in [c, r]. The windows are the nodes of the Cartesian tree over
the hashes that span enough tokens; a text of n tokens has about 2 n / t of them for a least length of t. A node that
spans t tokens is the minimum of some t tokens in a row, so a sliding minimum finds the few nodes that matter and the
tree is built over these alone.

Windows with the same min-hash are brought together by sorting. The first SHORT rows of a run are paired with one
another and every later one with the first, which is of the smallest doc_id, so a passage in n documents costs about n
pairs. Of pairs of documents that enough windows bring together the shingles themselves are aligned, and stretches of
enough words whose shingle sets are similar are the result.

Rows of runs longer than SHORT that no passage covers after that stay open and are looked at again in rounds. A round
intersects their windows with those of further hash functions: the places at which a passage of t tokens around the
min-hash may begin are divided by what the further minima are, and each part is a row of its own, whose key names all
minima. Texts that share no more than a line part company soon; passages that are equal never do, and similar ones
seldom. The parts are paired like the rows of the first round. After
round k 4 ** (k - 1) further functions have had their turn, so rows that are in one run after the last of the ROUNDS
agree in 65 min-hashes, and they have been compared with its first row. No round compares more pairs than SHORT times its rows, however large a run is.
Rows that are open even then are all compared with one another, run by run, which is quadratic in those rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import KeyRuns, free_name, mapped
from .store import materialize, scratch
from .text import mix, power_tables, shingle_stream, words

N_WORDS, N_HASHES, MIN_HASHES = 5, 6, 3
#: Rows at the beginning of a run that are all paired; rounds in which longer runs are divided.
SHORT, ROUNDS = 4, 4
#: Places in a chunk that fit beside a hash when minima are taken.
_PLACE_BITS = 28
OUT_ROWS = 1 << 16
#: Segments that are looked at together with all others of a pair.
AT_ONCE = 256
#: Least share of t tokens in a row that are shared, all along a stretch that may hold a passage, and somewhere in it.
SPARSE, NEARLY = 0.35, 0.75
#: Tokens of documents, and rows, that a task divides at once.
_TOKENS_AT_ONCE, _ROWS_AT_ONCE = 1 << 21, 1 << 12
#: ``place`` of a row: the token of its min-hash, and how far before it passages begin, at least and at most.
_WINDOWS = "key long, doc long, place long"
#: A pair of documents and the distance of the equal tokens, or an open row: key, document, none, place.
_PAIRS = "a long, b long, shift long, place long"
SPANS = "doc_id long, start_word long, end_word long, keep_doc_id long, keep_start_word long, keep_end_word long, similarity double"


def sliding_min(x: np.ndarray, t: int) -> np.ndarray:
    """The minimum of every t values in a row (van Herk and Gil-Werman)."""
    n = len(x)
    padded = np.full(-(-n // t) * t, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, t)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - t + 1], before[t - 1 : n])


def compact_windows(tokens: np.ndarray, t: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``l``, ``c`` and ``r`` of the windows of at least t tokens. Zeros in ``tokens`` are walls between texts."""
    n = len(tokens)
    if n < t:
        return (np.zeros(0, np.int64),) * 3
    rank = mix(tokens, 16 + seed) >> np.uint64(_PLACE_BITS)
    rank[tokens == 0] = 0
    order = (rank << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    least = sliding_min(order, t)
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    at = np.unique((least[new] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64))
    low, high, stack = [0] * len(at), [len(at)] * len(at), []
    values = order[at].tolist()
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            high[stack.pop()] = i
        low[i] = stack[-1] if stack else -1
        stack.append(i)
    ends = np.concatenate([[-1], at, [n]])
    left, right = ends[np.array(low, np.int64) + 1] + 1, ends[np.array(high, np.int64) + 1] - 1
    keep = (right - left + 1 >= t) & (tokens[at] != 0)
    return left[keep], at[keep], right[keep]


def _distinct_windows(tokens: np.ndarray, left: np.ndarray, at: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the windows inside the one before them that have the same token and end, as text that repeats itself has.

    A stretch longer than a window can be written keeps one window for every part of it.
    """
    keep = np.ones(len(at), bool)
    keep[1:] = (tokens[at[1:]] != tokens[at[:-1]]) | (right[1:] != right[:-1]) | (at[1:] >> 15 != at[:-1] >> 15)
    return left[keep], at[keep], right[keep]


def _window_rows(min_words: int):  # noqa: ANN202
    t = min_words - N_WORDS + 1
    names = ["key", "doc", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for w in words(batch.column(1)):
                counts = np.diff(w.offsets)
                long = np.flatnonzero(counts >= min_words)
                if not len(long):
                    continue
                parts, origin, at = [np.zeros(1, np.uint64)], [], 1
                for i in long:
                    s = shingle_stream(w.hashes[w.offsets[i] : w.offsets[i + 1]], N_WORDS)
                    s[s == 0] = 1
                    parts += [s, np.zeros(1, np.uint64)]
                    origin.append(at)
                    at += len(s) + 1
                tokens, origin, owner = np.concatenate(parts), np.array(origin), docs[w.first + long]
                for k in range(N_HASHES):
                    left, at_, right = _distinct_windows(tokens, *compact_windows(tokens, t, k))
                    doc = np.searchsorted(origin, at_, "right") - 1
                    # Passages of t tokens with this min-hash begin no farther before it than the window, and end in it.
                    least, most = np.maximum(t - 1 - (right - at_), 0), np.minimum(at_ - left, t - 1)
                    yield from _batches(mix(tokens[at_], 64 + k).view(np.int64), owner[doc], (at_ - origin[doc]) << 32 | least << 16 | most, names=names)

    return run


def _batches(*columns: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + OUT_ROWS]) for x in columns], names=names)


def _pair_rows(first_too: bool):  # noqa: ANN202
    """Pairs of the first SHORT rows of each run, and of the others with the first; and the rows of longer runs.

    The first row of a run is among these only with ``first_too``: where all pairs are verified it is done with.
    """
    names = ["a", "b", "shift", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = KeyRuns(SHORT - 1)
        for batch in batches:
            key, doc, place = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            head, previous, index, n = runs.feed(key, doc, place)
            all_key, all_doc, all_place = runs.rows
            for w, other in enumerate((head, *previous)):
                good = (index > 0 if w == 0 else (index < SHORT) & (index > w)) & (all_doc[other] != doc)
                a, b = other[good], n + np.flatnonzero(good)
                yield from _batches(all_doc[a], all_doc[b], (all_place[a] >> 32) - (all_place[b] >> 32), np.full(len(a), -1), names=names)
            grown = index == SHORT
            for at in (*(p[grown] for p in previous), *([head[grown]] if first_too else ()), n + np.flatnonzero(index >= SHORT)):
                yield from _batches(all_key[at], all_doc[at], np.zeros(len(at), np.int64), all_place[at], names=names)

    return run


def divided(tokens: np.ndarray, at: np.ndarray, key: np.ndarray, place: np.ndarray, t: int, seeds: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows (key, place), whose min-hash is at ``at`` in ``tokens``, divided by the minima of the functions ``seeds``.

    Returns the row that each part is of, its key, and its place. Rows have t - 1 tokens on both sides, if of nought.
    """
    around = tokens[at[:, None] + np.arange(1 - t, t)]
    keys = np.repeat(key.view(np.uint64)[:, None], t, 1)
    for seed in seeds:
        rank = mix(around, 256 + seed)
        # Of the passage that begins s before the min-hash and has t tokens: the minimum up to it, and from it on.
        before, after = np.minimum.accumulate(rank[:, t - 1 :: -1], axis=1), np.minimum.accumulate(rank[:, t - 1 :], axis=1)
        keys = mix(keys ^ np.minimum(before, after[:, ::-1]), 1024 + seed)
    s, least, most = np.arange(t), place[:, None] >> 16 & 0xFFFF, place[:, None] & 0xFFFF
    inside = (s >= least) & (s <= most)
    change = np.ones((len(at), t + 1), bool)
    change[:, 1:t] = keys[:, 1:] != keys[:, :-1]
    row, low = np.nonzero(inside & (change[:, :-1] | (s == least)))
    _, high = np.nonzero(inside & (change[:, 1:] | (s == most)))
    return row, keys[row, low].view(np.int64), place[row] >> 32 << 32 | low << 16 | high


def _divided_rows(t: int, number: int):  # noqa: ANN202
    """Open rows, given as lists by document with its tokens, divided by the functions of round ``number``."""
    names, seeds = ["key", "doc", "place"], range(4 ** (number - 2) if number > 1 else 0, 4 ** (number - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lists, raw = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            i = 0
            while i < len(docs):
                parts, base, owner, keys, places, at = [np.zeros(t, np.uint32)], [], [], [], [], t
                while i < len(docs) and at <= _TOKENS_AT_ONCE:
                    own = np.frombuffer(raw[i].as_buffer(), np.uint32)
                    key, place = (lists[i].values.field(j).to_numpy() for j in (0, 1))
                    fits = place >> 32 < len(own)  # not in another text of the same doc_id
                    owner.append(np.full(fits.sum(), docs[i]))
                    base.append(np.full(fits.sum(), at))
                    keys.append(key[fits])
                    places.append(place[fits])
                    parts += [own, np.zeros(t, np.uint32)]
                    at += len(own) + t
                    i += 1
                tokens, base, owner, key, place = (np.concatenate(x) for x in (parts, base, owner, keys, places))
                for a in range(0, len(key), _ROWS_AT_ONCE):
                    part = slice(a, a + _ROWS_AT_ONCE)
                    row, new, where = divided(tokens, base[part] + (place[part] >> 32), key[part], place[part], t, seeds)
                    yield from _batches(new, owner[part][row], where, names=names)

    return run


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each document, as the upper halves of their hashes: enough to align two documents."""
    for batch in batches:
        for w in words(batch.column(1)):
            raw = [(shingle_stream(w.hashes[a:b], N_WORDS) >> np.uint64(32)).astype(np.uint32).tobytes() for a, b in zip(w.offsets, w.offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(raw)), pa.array(raw, pa.binary())], names=["doc", "tokens"])


def _dense(hit: np.ndarray, t: int) -> np.ndarray:
    """Tokens that a passage may hold: those in stretches where t in a row are shared in part, and somewhere nearly all.

    A passage in which ``similarity`` of the tokens are shared has t in a row of which so many are.
    """
    total = np.concatenate([[0], np.cumsum(hit)])
    shared = total[t:] - total[:-t]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], shared >= SPARSE * t, [False]]).astype(np.int8)))
    inside = np.zeros(len(hit) + 1, np.int64)
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if shared[a:b].max() >= NEARLY * t:
            inside[a] += 1
            inside[b + t - 1] -= 1
    return np.cumsum(inside[:-1]) > 0


def _segments(x: np.ndarray, y: np.ndarray, diagonals: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of equal tokens, as rows (y0, x0, tokens): all on the diagonals given, and those that tokens lead to; and which tokens of y are in x."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    low, high = np.searchsorted(ranked, y), np.searchsorted(ranked, y, "right")
    dense = _dense(high > low, t)
    if not dense.any():
        return np.zeros((0, 3), np.int64), high > low
    once = np.flatnonzero((high - low == 1) & dense)
    hit = np.flatnonzero((high > low) & dense)
    more = np.unique(np.concatenate([diagonals, order[low[once]] - once]))
    # A token with several places in x also counts where it goes on from the diagonal of its neighbours. Text that repeats
    # itself may have others; what it holds that is equal is found by _equal.
    rows = []
    for d in more.tolist():
        at = hit[max(0, np.searchsorted(hit, -d)) : np.searchsorted(hit, len(x) - d)]
        at = at[x[at + d] == y[at]]
        if not len(at):
            continue
        cut = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
        rows.append(np.stack([first, first + d, last - first + 1], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64), high > low


def _in_a_row(x: np.ndarray, t: int) -> np.ndarray:
    """The hash of the t tokens that begin at each token."""
    up, down = power_tables(len(x) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(x) * up[: len(x)])])
    return (total[t:] - total[:-t]) * down[: len(x) - t + 1]


def _equal(x: np.ndarray, y: np.ndarray, hit: np.ndarray, taken: np.ndarray, t: int) -> Iterator[tuple[int, int, int]]:
    """Stretches (y0, x0, tokens) of at least t equal tokens, until every t tokens in a row that x holds anywhere are ``taken``.

    ``hit`` tells which tokens of y are in x.
    """
    total = np.concatenate([[0], np.cumsum(hit)])
    inside, free = total[t:] - total[:-t] == t, np.concatenate([[0], np.cumsum(~taken)])
    if not (inside & (free[t:] > free[:-t])).any():
        return
    of_x, of_y = _in_a_row(x, t), _in_a_row(y, t)
    order = np.argsort(of_x, kind="stable")
    place = order[np.minimum(np.searchsorted(of_x[order], of_y), len(of_x) - 1)]
    at = np.flatnonzero(of_x[place] == of_y)
    ends = np.zeros(len(y) + 1, np.int64)
    ends[at] += 1
    ends[at + t] -= 1
    held, done = np.flatnonzero((np.cumsum(ends[:-1]) > 0) & ~taken), 0
    while (i := int(np.searchsorted(held, done))) < len(held):
        y0 = int(at[np.searchsorted(at, held[i], "right") - 1])
        x0 = int(place[y0])
        n = min(len(x) - x0, len(y) - y0)
        other = np.flatnonzero(x[x0 : x0 + n] != y[y0 : y0 + n])
        n = int(other[0]) if len(other) else n
        yield y0, x0, n
        done = y0 + n


def _chains(seg: np.ndarray) -> Iterator[np.ndarray]:
    """Segments in order in both texts, the chains with most tokens first; no segment is in two."""
    seg = seg[np.lexsort((seg[:, 1], seg[:, 0]))]
    y0, x0, n = seg.T
    best, back = n.astype(float), np.full(len(seg), -1)
    for first in range(0, len(seg), AT_ONCE):
        # What a segment adds to a chain that ends with another one, for some segments and all others at once.
        j = np.arange(first, min(first + AT_ONCE, len(seg)))
        y_gap, x_gap = y0[j][:, None] - y0 - n, x0[j][:, None] - x0 - n
        over = np.maximum(0, -np.minimum(y_gap, x_gap))
        gain = n[j][:, None] - over - 0.05 * (np.maximum(y_gap, 0) + np.maximum(x_gap, 0))
        gain[(over >= n[j][:, None]) | (over >= n)] = -np.inf
        for k in range(max(first, 1), first + len(j)):
            score = best[:k] + gain[k - first, :k]
            i = int(score.argmax())
            if score[i] > best[k]:
                best[k], back[k] = score[i], i
    used = np.zeros(len(seg), bool)
    for j in np.argsort(-best, kind="stable").tolist():
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = int(back[j])
        if chain:
            yield seg[chain[::-1]]


def passages(x: np.ndarray, y: np.ndarray, shifts: np.ndarray, t: int, least: float) -> list[tuple[int, int, int, int, float]]:
    """Verified passages of y that are near duplicates of passages of x, as tokens [y0, y1], [x0, x1] and similarity.

    Stretches of equal tokens are chained, and the longest parts of a chain that are similar enough are the passages,
    however long the gaps and shifts inside them. What no passage holds whole but is equal for t tokens is one by itself,
    wherever x has it, so of text that repeats itself nothing is left over.
    """
    if len(x) < t or len(y) < t:
        return []
    seg, hit = _segments(x, y, np.unique(shifts), t)
    out, taken = [], np.zeros(len(y), bool)

    def take(y0: int, y1: int, x0: int, x1: int) -> bool:
        if y1 - y0 + 1 < t or y1 - y0 + 1 - np.count_nonzero(taken[y0 : y1 + 1]) < t:
            return False
        a, b = np.unique(x[x0 : x1 + 1]), np.unique(y[y0 : y1 + 1])
        both = len(np.intersect1d(a, b, assume_unique=True))
        similarity = both / (len(a) + len(b) - both)
        if similarity < least:
            return False
        taken[y0 : y1 + 1] = True
        out.append((y0, y1, x0, x1, similarity))
        return True

    for chain in _chains(seg) if seg[:, 2].sum() >= least * t else ():
        y0, x0, n = chain.T
        y1, x1 = y0 + n - 1, x0 + n - 1
        # Tokens that are equal up to each segment, without what two segments share.
        over = np.maximum(0, np.maximum(y1[:-1] - y0[1:], x1[:-1] - x0[1:]) + 1)
        equal = np.cumsum(n - np.concatenate([[0], over]))
        free = 0
        for first in range(0, len(chain), AT_ONCE):
            i = np.arange(first, min(first + AT_ONCE, len(chain)))
            both = equal - (equal[i] - n[i])[:, None]
            long, size = y1 - y0[i][:, None] + 1, (y1 - y0[i][:, None] + 1) + (x1 - x0[i][:, None] + 1)
            ends = (both * (1 + least) >= least * size) & (long >= t) & (np.arange(len(chain)) >= i[:, None])
            for k in np.flatnonzero(ends.any(1)).tolist():
                if i[k] >= free:
                    found = next((j for j in np.flatnonzero(ends[k])[::-1].tolist() if take(int(y0[i[k]]), int(y1[j]), int(x0[i[k]]), int(x1[j]))), None)
                    free = free if found is None else found + 1
    for y0, x0, n in seg[np.argsort(-seg[:, 2], kind="stable")].tolist():
        if n < t:
            break
        take(y0, y0 + n - 1, x0, x0 + n - 1)
    return out + [(y0, y0 + n - 1, x0, x0 + n - 1, 1.0) for y0, x0, n in _equal(x, y, hit, taken, t)]


def _verify(min_words: int, least: float):  # noqa: ANN202
    t = min_words - N_WORDS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            shifts, tx, ty = (batch.column(i) for i in (2, 3, 4))
            for i in range(len(batch)):
                x, y = (np.frombuffer(s[i].as_buffer(), np.uint32) for s in (tx, ty))
                for y0, y1, x0, x1, s in passages(x, y, shifts[i].values.to_numpy(), t, least):
                    rows.append((b[i], y0, y1 + N_WORDS, a[i], x0, x1 + N_WORDS, s))
            for i in range(0, len(rows), OUT_ROWS):
                part = list(zip(*rows[i : i + OUT_ROWS]))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in part[:6]), pa.array(part[6], pa.float64())], names=[c.split()[0] for c in SPANS.split(", ")])

    return run


def _tokens(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc and tokens of the documents in ``wanted`` (doc_id), and of a few more: joins on doc leave those out, so no text is shuffled."""
    return mapped(docs, wanted).select("doc_id", "text").mapInArrow(_token_rows, "doc long, tokens binary")


def _known(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of ``tokens`` (doc, tokens) whose documents are in ``wanted`` (doc_id)."""
    return mapped(tokens.withColumnRenamed("doc", "doc_id"), wanted).withColumnRenamed("doc_id", "doc")


def _verified(tokens: DataFrame, pairs: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """The passages of ``pairs`` (a, b, shifts), from the tokens of their documents."""
    by_doc = tokens.repartition("doc")  # both joins read what is dealt once
    left = by_doc.select(F.col("doc").alias("a"), F.col("tokens").alias("tokens_a"))
    right = by_doc.select(F.col("doc").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "shifts", "tokens_a", "tokens_b").mapInArrow(_verify(min_words, similarity), SPANS)


def _open(rows: DataFrame, found: DataFrame, temporary: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id and its rows (key, place) that are still open: no passage found in the document covers their min-hash.

    Runs of which rows of only one document are left are done.
    """
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    at = F.shiftright("place", 32)
    covered = F.exists("spans", lambda s: (at >= s["start_word"]) & (at <= s["end_word"] - N_WORDS))
    rows = rows.select(F.col("a").alias("key"), F.col("b").alias("doc_id"), "place").join(spans, "doc_id", "left")
    rows = temporary(rows.where(~F.coalesce(covered, F.lit(False))).select("key", "doc_id", "place"))
    several = rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
    return rows.join(several, "key", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("key", "place")).alias("rows"))


def _all_pairs(again: DataFrame) -> DataFrame:
    """a, b and shifts of all pairs of documents with open rows in one run."""
    rows = again.select("doc_id", F.inline("rows"))
    a = rows.select("key", F.col("doc_id").alias("a"), F.shiftright("place", 32).alias("at_a"))
    b = rows.select("key", F.col("doc_id").alias("b"), F.shiftright("place", 32).alias("at_b"))
    return a.join(b, "key").where("a < b").groupBy("a", "b").agg(F.collect_set(F.col("at_a") - F.col("at_b")).alias("shifts"))


def _copies(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, mark of the text, keep_doc_id and n_words of the documents whose text an earlier one has, byte by byte."""
    marks = docs.where("text is not null").select("doc_id", F.unhex(F.md5("text")).alias("mark"))
    firsts = marks.groupBy("mark").agg(F.min("doc_id").alias("keep_doc_id"), F.max("doc_id").alias("last")).where("last > keep_doc_id").drop("last")
    copies = materialize(marks.join(firsts, "mark").where("doc_id > keep_doc_id").distinct())
    if copies.isEmpty():
        return copies.withColumn("n_words", F.lit(0).cast("long"))
    count = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = mapped(docs, copies.select("doc_id")).select("doc_id", F.unhex(F.md5("text")).alias("mark"), count.alias("n_words"))
    return materialize(sizes.join(copies, ["doc_id", "mark"]).where(F.col("n_words") >= min_words).distinct())


def repeated_passages(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least ``min_words`` words that are near duplicates of a passage of another document.

    One row per passage and partner: the span of words in ``doc_id``, and in ``keep_doc_id``, whose copy stays. Within
    each group of windows the document with the smallest id keeps its copy, so of all copies of a passage one stays;
    documents whose version is not similar to that one are compared with one another.
    ``similarity`` is the Jaccard similarity of the sets of five-word shingles, of both passages as a whole.

    Null and empty texts, texts of fewer words, and rows without doc_id take no part. Rows with the same doc_id are
    taken to be the same document and are not compared. Of equal texts all but the one of the smallest doc_id are
    passages as a whole, kept in that one. An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    t = min_words - N_WORDS + 1
    copies = _copies(docs, min_words)
    single = docs
    if not copies.isEmpty():
        others = mapped(docs, copies.select("doc_id")).withColumn("mark", F.unhex(F.md5("text"))).join(copies, ["doc_id", "mark"], "left_anti")
        single = mapped(docs, copies.select("doc_id"), inside=False).union(others.select("doc_id", "text"))
    rows, found, known = single.mapInArrow(_window_rows(min_words), _WINDOWS), None, None
    for number in range(ROUNDS + 1):
        with scratch(docs.sparkSession) as temporary:
            by_key = rows.repartition("key").sortWithinPartitions("key", "doc", "place")
            hits = temporary(by_key.mapInArrow(_pair_rows(number == 0), _PAIRS))
            pairs = hits.where("place < 0").groupBy("a", "b").agg(F.count("*").alias("hits"), F.collect_set("shift").alias("shifts"))
            # A row of a later round names more min-hashes than are asked for here.
            pairs = temporary(pairs.where(F.col("hits") >= (1 if number else MIN_HASHES)).select("a", "b", "shifts"))
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
            tokens = _tokens(docs, wanted) if known is None else _known(known, wanted)
            fresh = materialize(_verified(tokens, pairs, min_words, similarity))
            found = fresh if found is None else found.union(fresh)
            again = materialize(_open(hits.where("place >= 0"), found, temporary))
        if again.isEmpty():
            break
        ids = again.select("doc_id")
        if number == ROUNDS:
            tokens = _tokens(docs, ids) if known is None else _known(known, ids)
            found = found.union(materialize(_verified(tokens, _all_pairs(again), min_words, similarity)))
            break
        if number == 1:  # few documents are left open, and those of later rounds are among them
            known = materialize(_tokens(docs, ids))
        tokens = _tokens(docs, ids) if known is None else _known(known, ids)
        rows = again.join(tokens, F.col("doc_id") == F.col("doc")).select("doc_id", "rows", "tokens").mapInArrow(_divided_rows(t, number + 1), _WINDOWS)
    n, zero = F.col("n_words"), F.lit(0).cast("long")
    whole = copies.select("doc_id", zero.alias("start_word"), n.alias("end_word"), "keep_doc_id", zero.alias("keep_start_word"), n.alias("keep_end_word"), F.lit(1.0).alias("similarity"))
    return found.union(whole).distinct()


def _cut(schema_names: list[str], text_col: str, chars_col: str | None):  # noqa: ANN202
    """Texts without the spans in the last column; rows of which nothing is left go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(batch.schema.get_field_index(text_col)), batch.column(batch.num_columns - 1)
            new = texts.to_pylist()
            for w in words(texts):
                for i in range(len(w.offsets) - 1):
                    cuts = spans[w.first + i].as_py()
                    if not cuts:
                        continue
                    raw, a, b = new[w.first + i].encode(), w.offsets[i], w.offsets[i + 1]
                    gone = np.zeros(b - a, bool)
                    for s in cuts:
                        gone[s["start_word"] : s["end_word"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    kept, at = [], 0
                    for s, e in zip(edge[::2], edge[1::2]):
                        kept.append(raw[at : w.starts[a + s]])
                        at = w.starts[a + e] if a + e < b else len(raw)
                    kept.append(raw[at:])
                    new[w.first + i] = b"".join(kept).decode() if not gone.all() else ""
            columns = []
            for name in schema_names:
                if name == text_col:
                    columns.append(pa.array(new, pa.string()))
                elif name == chars_col:
                    kind = batch.schema.field(name).type
                    columns.append(pa.array([len(t) if t is not None else None for t in new], kind))
                else:
                    columns.append(batch.column(batch.schema.get_field_index(name)))
            gone = pa.array([bool(s) and not t.strip() for s, t in zip(spans.to_pylist(), [t or "" for t in new])])
            out = pa.RecordBatch.from_arrays(columns, names=schema_names)
            yield out.filter(pa.compute.invert(gone))

    return run


def substring_dedup(docs: DataFrame, min_words: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` without the passages of :func:`repeated_passages`, and with the same columns.

    A document of which nothing is left goes. ``chars_col``, where given, is set to the new number of characters.
    Rows without repeated passages stay as they are, and so do null and empty texts, short ones, and rows without a
    doc_id. Rows that repeat a doc_id are one document and lose the same words. Texts are worked on whole, however long.
    An empty table gives an empty result; other columns come back as they are, whatever their names.
    """
    spans = repeated_passages(docs, min_words, similarity, id_col, text_col)
    by_doc = materialize(spans.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("cuts")))
    named = docs if id_col == "doc_id" else docs.withColumnRenamed(id_col, "doc_id")
    named = named if dict(named.dtypes)["doc_id"] == "bigint" else named.withColumn("doc_id", F.col("doc_id").cast("long"))
    cuts = by_doc.withColumnRenamed("cuts", free_name(named, "cuts"))
    touched = mapped(named, by_doc.select("doc_id")).join(cuts, "doc_id", "left").select(*named.columns, cuts.columns[-1])
    cut = touched.mapInArrow(_cut(named.columns, text_col, chars_col), named.schema)
    return mapped(named, by_doc.select("doc_id"), inside=False).union(cut).toDF(*docs.columns)
