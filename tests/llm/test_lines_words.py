"""Line dedup, spelling variants and lexical search against plain versions of them."""

import math
import random
import re
from collections import Counter

import pytest

from sightframe.llm import lexical_search, line_dedup, spelling

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, least):
    key = lambda x: x.strip(BLANKS).translate(UPPER)
    held = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


ODD_LINES = [
    (1, "Same Line\nown one"), (2, "  same line \t\nown two\n"), (3, "SAME LINE\n\n\nÄrger\n"), (3, "SAME LINE\n\n\nÄrger\n"), (None, "same line\nÄrger"), (4, None), (5, ""), (6, "\n\n"), (7, " \t\n\x0b\r"),
    (8, "ärger\n" + "x" * 300_000), (9, "y\n" * 20_000 + "x" * 300_000), (10, "y\r\nz"), (11, " same line"),
]


@pytest.mark.parametrize("most_keys", [1 << 20, 0])
@pytest.mark.parametrize("least", [2, 4])
def test_lines(spark, docs, most_keys, least):
    """Both ways to drop lines give the plain result, for odd rows too; so does a filter that is far too small."""
    got = line_dedup.line_dedup(docs(ODD_LINES), least, most_keys=most_keys, most_bits=1 << 18)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_lines(ODD_LINES, least)
    crowded = [(i, f"line {i % 700}\nline {i % 300}\nown {i}") for i in range(1000)]
    tiny = line_dedup.line_dedup(docs(crowded), least, most_keys=most_keys, most_bits=1 << 10)
    assert sorted((tuple(r) for r in tiny.collect()), key=repr) == plain_lines(crowded, least)


def test_lines_of_nothing(spark, docs):
    none = docs([(1, "a")]).where("doc_id > 1")
    assert line_dedup.line_dedup(none).collect() == [] and line_dedup.line_dedup(none, most_keys=-1).collect() == []
    assert line_dedup.first_lines(none).collect() == []


def test_repeat_filter(spark, docs):
    """Every key of two documents is in the second filter, and few others are; the first line of each key is found."""
    rows = [(i, f"shared {i % 500}\nalone {i}") for i in range(1000)]
    found = line_dedup.repeat_filter(docs(rows).repartition(7))
    held = lambda keys: line_dedup._holds(found, line_dedup._places(keys, found.size * 8))
    assert held([f"shared {i}".encode() for i in range(500)]).all()
    assert held([f"alone {i}".encode() for i in range(1000)]).sum() < 20
    first = {bytes(r["key"]).decode(): (r["doc_id"], r["line"], r["n"]) for r in line_dedup.first_lines(docs([*rows, (5000, "x\nb\nx"), (None, "b")])).collect()}
    assert first == {f"shared {i}": (i, 0, 2) for i in range(500)} | {"x": (5000, 0, 2), "b": (5000, 1, 2)}


def distance_one(w, u):
    if abs(len(w) - len(u)) > 1 or w == u:
        return False
    if len(w) == len(u):
        return sum(a != b for a, b in zip(w, u)) == 1
    short, long = sorted((w, u), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(vocab, times):
    out = {}
    for w, n in vocab.items():
        near = [u for u in vocab if distance_one(w, u)]
        best = min(near, key=lambda u: (-vocab[u], u), default=None)
        form = best if best is not None and vocab[best] >= times * n else None
        out[w] = [n, len(near), form, vocab.get(form), w]
    for w in out:
        while out[out[w][4]][2] is not None:
            out[w][4] = out[out[w][4]][2]
    return {w: tuple(v) for w, v in out.items()}


def as_variants(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("most", [2, 20, 4096])
def test_variants(spark, most):
    """Dense vocabularies, in parts of any size: near words, forms and roots are those of comparing all pairs."""
    r = random.Random(most)
    vocab = {"".join(r.choices("abé", k=r.randint(2, 7))): r.choice((1, 2, 5, 30, 200, 1000)) for _ in range(400)}
    vocab |= {"b" * 40 + c + d: 5 for c in "xyz" for d in ("", "p", "q")} | {"prefix" + "".join(r.choices("ab", k=6)): 7 for _ in range(60)}
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    assert as_variants(spelling.variants(df, 5, most)) == plain_variants(vocab, 5)
    assert spelling.near_words(df, most).groupBy("word", "near").count().where("count > 1").isEmpty()


def test_roots(spark):
    """Forms are followed over many steps."""
    chain = {"a" * k: 5**k for k in range(2, 13)}
    got = as_variants(spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == plain_variants(chain, 5) and {v[4] for v in got.values()} == {"a" * 12}


def test_vocabulary(spark, docs):
    """Whole texts are counted, only A-Z are lower-cased, and one in so many words of a document loses a code point."""
    import zlib

    rows = [(1, "Straße ÉTUDES Ünder_ünder éTUDES x÷y×zab"), (None, "straße straße"), (2, None), (3, ""), (3, "straße"), (4, "wordie " * 50_000 + "q" * 100_000), (5, "élèves naïves ABCDEF"), (5, "élèves naïves abcdef")]
    for every in (None, 3):
        want = Counter()
        for i, text in rows:
            for run in spelling._RUN.findall((text or "").translate(UPPER)):
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                k = h % len(run)
                want[run[:k] + run[k + 1 :] if every and h % every == 0 else run] += 1
        got = {r["word"]: r["n"] for r in spelling.vocabulary(docs(rows), 5, 2, every).collect()}
        assert got == {w: n for w, n in want.items() if len(w) >= 5 and n >= 2}
    assert spelling.spelling_variants(docs(rows[2:4])).collect() == []


def plain_search(rows, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_terms = sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 10 + 90 * c.total() * len(docs) // n_terms
            scored.append((-sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & set(c)), i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(x for x in scored if x[0])[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_terms", [1 << 18, 8])
def test_search(spark, docs, monkeypatch, block_terms):
    """Ties, repeated rows, nulls, long texts and small blocks: the ranks and scores are those of scoring every document."""
    r = random.Random(5)
    word = lambda: f"w{min(int(r.expovariate(0.05)), 300)}"
    rows = [(i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(600)]
    rows += [(1000 + i, "w1 w2 w3 copy") for i in range(40)] + [(None, "w1 w2 w3 copy"), (1000, "w1 w2 w3 copy"), (1, None), (2, ""), (3, "... !"), (4, "ÄÖ_äö-Äö W1 " * 30_000), (5, "w250 " * 9 + "x" * 90_000)]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 12)))) for i in range(30)] + [(40, None), (41, "nothing known"), (42, "Copy copy COPY"), (43, "äÖ, Äö"), (42, "w1 w1")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, q string")
    monkeypatch.setattr(lexical_search, "BLOCK_CELLS", 1 << 12)
    got = lexical_search.search(docs(rows).repartition(3), table, 7, block_terms=block_terms)
    assert sorted(tuple(x) for x in got.collect()) == plain_search(rows, items, 7)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_nothing(spark, docs):
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical_search.search(docs([]), items).collect() == [] and lexical_search.search(docs([(1, None)]), items).collect() == []
    assert lexical_search.search(docs([(1, "a")]), items.where("item_id > 2")).collect() == []
    assert [tuple(r) for r in lexical_search.search(docs([(1, "a b")]), items).collect()] == plain_search([(1, "a b")], [(1, "a")], 10)
