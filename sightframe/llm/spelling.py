"""Spelling variants: words at edit distance one, by a self-join of a trie with sets of active nodes.

A word is a run of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased. Two words are near if one inserted, deleted or replaced
code point makes one of the other.

The vocabulary is a trie divided into parts. Near words of m and m or m + 1 code points agree in their first m // 2 code
points, or in all but those; so a word is in four parts: by its beginning and by its end, as the shorter and as the
longer word. In each part only a window of the word is open, and the windows make a trie of their own. A part of more
than MOST words is divided in the middle of its windows: what lies outside a window must agree, so words go to the two
halves by what is left. With a window of one code point a part has no more words than there are letters and pairs of
letters, so no task holds more than that, however many words begin alike.

In a part, the trie is walked from the root down with the set of active nodes, which are those at distance one from the
present one: its parent, its children, its siblings, and the children of its parent's active nodes by the same letter. Where
a word ends, the active nodes at which words end are its near ones. A pair is told in the one part whose window holds the
first place at which the two differ.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .text import give_back

#: Words of a part that is not divided any more.
MOST = 4096
#: Distinct words that a task holds before it passes their counts on.
HELD = 1 << 15
_RUN = re.compile("[a-zÀ-ÿ]+")


def _lowered(text: str) -> str:
    """``text`` with A-Z lower-cased, and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def _count_rows(shortest: int, every: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        batch_of = lambda: pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                doc_id = i.as_py()
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall(_lowered(text.as_py() or ""))).items():
                    if len(word) < shortest:
                        continue
                    if every and (h := zlib.crc32(word.encode(), begun)) % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < shortest:
                            continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield batch_of()
                    counts.clear()
        yield batch_of()
        counts.clear()
        give_back()

    return run


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n (occurrences) of the words of at least ``shortest`` code points that occur ``least`` times.

    With ``every``, a word loses its code point h % length before that, in the documents for which ``every`` divides h,
    the CRC-32 of ``doc_id:word``. Words are counted in every task before they are shuffled.
    """
    counts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_count_rows(shortest, every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _parts(vocab: DataFrame) -> DataFrame:
    """word, n, m (length of a pair's shorter word), a and b (the window in a word of m), of each of a word's parts."""
    size = F.length("word")
    window = lambda m: F.array(F.struct(m.alias("m"), F.floor(m / 2).cast("int").alias("a"), m.alias("b")), F.struct(m.alias("m"), F.lit(0).alias("a"), F.floor(m / 2).cast("int").alias("b")))
    return vocab.select("word", "n", F.inline(F.concat(window(size), window(size - 1))))


def _keyed(parts: DataFrame) -> DataFrame:
    """``parts`` with the key of the part: all of the word but its window, which is one longer in the longer words."""
    before = F.substring("word", F.lit(1), F.col("a"))
    after = F.substring("word", F.col("b") + F.length("word") - F.col("m") + 1, F.length("word"))
    key = F.concat_ws(" ", "m", "a", "b", before, after)
    return parts.withColumn("key", key)


def trie_parts(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, m, a, b and key: the words of every part of the vocabulary, none of which is left above ``most`` words.

    Parts whose window is one code point wide are not divided.
    """
    rows, done = materialize(_keyed(_parts(vocab))), None
    while True:
        large = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).where((F.col("size") > most)).select("key"))
        if large.isEmpty():
            return rows if done is None else done.union(rows)
        marked = rows.join(large.withColumn("large", F.lit(True)), "key", "left")
        divided = F.col("large").isNotNull() & (F.col("b") - F.col("a") > 1)
        kept = marked.where(~divided).select(rows.columns)
        done = kept if done is None else done.union(kept)
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("b").alias("hi")))
        halved = marked.where(divided).select("word", "n", "m", F.inline(halves)).select("word", "n", "m", F.col("lo").alias("a"), F.col("hi").alias("b"))
        rows = materialize(_keyed(halved))


class Trie:
    """A trie of short texts: for each node its children by letter, and what ends there."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]

    def add(self, text: str, value: int) -> None:
        at = 0
        for c in text:
            down = self.children[at]
            if c not in down:
                down[c] = len(self.children)
                self.children.append({})
                self.ends.append([])
            at = down[c]
        self.ends[at].append(value)

    def near(self) -> Iterator[tuple[int, int]]:
        """Values that end at nodes of distance one, each pair both ways round."""
        open_: list[tuple[int, frozenset[int]]] = [(0, frozenset(self.children[0].values()))]
        while open_:
            at, active = open_.pop()
            for here in self.ends[at]:
                for v in active:
                    yield from ((here, there) for there in self.ends[v])
            siblings = set(self.children[at].values())
            for c, child in self.children[at].items():
                moved = {self.children[v][c] for v in active if c in self.children[v]}
                now = (moved | siblings | {at} | set(self.children[child].values())) - {child}
                open_.append((child, frozenset(now)))


def _pairs_of(words: list[str], counts: list[int], m: int, a: int, b: int) -> Iterator[tuple[str, str, int]]:
    """word, near word and its count, of a part."""
    trie = Trie()
    for i, w in enumerate(words):
        trie.add(w[a : b + len(w) - m], i)
    for i, j in trie.near():
        w, u = words[i], words[j]
        if len(w) == m or len(u) == m:
            first = sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(w, u)))
            if a <= first < b or first == b == m:
                yield w, u, counts[j]


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every part, from rows sorted by key; a task holds one part at a time."""
    key, words, counts, window = None, [], [], (0, 0, 0)
    out: list[tuple[str, str, int]] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], names=["word", "near", "near_n"])

    for batch in batches:
        for k, w, n, *here in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "m", "a", "b"))):
            if k != key:
                if len(words) > 1:
                    out.extend(_pairs_of(words, counts, *window))
                key, words, counts, window = k, [], [], tuple(here)
            words.append(w)
            counts.append(n)
        yield flush()
    if len(words) > 1:
        out.extend(_pairs_of(words, counts, *window))
    yield flush()
    give_back()


def near_words(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """word, near and near_n of every pair of near words of a vocabulary (word, n), both ways round and once each."""
    parts = trie_parts(vocab, most).repartition("key").sortWithinPartitions("key")
    return parts.mapInArrow(_pair_rows, "word string, near string, near_n long")


def variants(vocab: DataFrame, times: int = 5, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of a vocabulary (word, n).

    ``form`` is the near word that occurs most, the smallest of several, if that is ``times`` as often as the word; else
    null. ``root`` follows forms to the last. Words of fewer than two code points have no near ones here.
    """
    vocab = materialize(vocab)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"))).alias("best")
    found = near_words(vocab.where(F.length("word") > 1), most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    much = -F.col("best.order") >= times * F.col("n")
    rows = vocab.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, F.col("best.form")).alias("form"), F.when(much, -F.col("best.order")).alias("form_n"))
    rows = materialize(rows)
    up = materialize(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each step up has `times` as many occurrences, and each round doubles the steps
        further = up.join(up.select(F.col("word").alias("root"), F.col("root").alias("top")), "root", "left")
        if further.where("top is not null").isEmpty():
            break
        up = materialize(further.select("word", F.coalesce("top", "root").alias("root")))
    return rows.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, shortest: int = 6, least: int = 5, times: int = 5, every: int | None = None, most: int = MOST) -> DataFrame:
    """:func:`variants` of the vocabulary of documents (doc_id, text).

    Null and empty texts have no words; a null doc_id counts as an empty one. Rows that repeat count as often as they are
    there. Very long texts and words are worked on whole. A table without words gives an empty result. Columns besides
    doc_id and text are not read.
    """
    return variants(vocabulary(docs, shortest, least, every), times, most)


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII or other UTF-8 text, with the table ``t`` of 256 values."""
    byte = f"('0x' || substr(hex(encode({text})), (2 * k - 1)::BIGINT, 2))::BIGINT"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode({text})) + 1), lambda k: {byte})), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"


#: The query's rows in DuckDB's SQL: words that are equal without one code point at the same place are near, and so is a word and what it becomes without one.
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT w, n, {_crc32_sql("doc_id || ':' || w")} AS h FROM counted, crc_table),
written AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS word, n FROM hashed),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, n, unnest(range(length(word))) AS i FROM vocab),
less AS (SELECT word, n, i, left(word, i::BIGINT) || substr(word, (i + 2)::BIGINT) AS rest FROM cut),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, v.word, v.n FROM less l JOIN vocab v ON l.rest = v.word
  UNION SELECT v.word, l.word, l.n FROM less l JOIN vocab v ON l.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM pairs GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM vocab v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT u.word, f.word, f.form FROM up u JOIN formed f ON u.next = f.word)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM formed f JOIN up u ON u.word = f.word AND u.next IS NULL
"""


__all__ = ["Trie", "near_words", "spelling_variants", "trie_parts", "variants", "vocabulary"]
