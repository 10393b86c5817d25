"""Jaccard join, substring dedup and embeddings against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightframe.llm import embedding_dedup, groups, jaccard_join, substring_dedup, text

LOWER = {c: c + 32 for c in range(65, 91)}


def split(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOWER)) if w]


def shingles(t, n):
    w = split(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def components(sets, num, den):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def check(df, n, num, den):
    got = jaccard_join.jaccard_join(df, n, (num, den)).collect()
    sets = {r["doc_id"]: shingles(r["text"], n) for r in df.collect()}
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == components(sets, num, den)


def test_jaccard_table(documents):
    check(documents, 4, 85, 100)


def near_copies(count, size, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
    out = []
    for i in range(count):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append((i * 7 % 1009, " ".join(t)))
    return out


def test_jaccard_hot_group_and_chain(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    chain = [(2000 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 120))) for i in range(12)]
    line = "the same line is in every one of these short texts"
    short = [(3000 + i, f"{line} and then {i} {i * i} {i + 5} {i * 3}") for i in range(60)]
    check(docs(near_copies(150, 90, 1) + chain + short), 5, 4, 5)


def test_jaccard_odd_rows(docs):
    t = "a b c d e f g h"
    df = docs([(1, t), (1, t), (2, t.upper()), (3, None), (4, ""), (5, " \n"), (6, "one two"), (7, "ONE\ttwo"), (None, t), (8, "é É é É é É"), (9, "w " * 30_000)])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(df, 4, (85, 100)).collect() if True)
    assert got == [(-1, 5, None), (1, 5, 1), (1, 5, 1), (2, 5, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 2, 8), (9, 1, 9)]
    assert jaccard_join.jaccard_join(docs([])).count() == 0


def test_block_guarantee():
    """Any two sets within the bound share a kept block."""
    rng = np.random.default_rng(3)
    for threshold in ((85, 100), (4, 5)):
        num, den = threshold
        for size in (1, 2, 5, 9, 20, 60, 300):
            for _ in range(60):
                a = set(rng.integers(0, 2**63, size).tolist())
                b = set(a)
                for x in list(a)[: rng.integers(0, max(1, size // 6) + 1)]:
                    b.discard(x)
                for x in rng.integers(0, 2**63, rng.integers(0, max(1, size // 6) + 1)).tolist():
                    b.add(x)
                if not b or den * len(a & b) < num * len(a | b):
                    continue
                parts = [np.sort(np.array(sorted(s), np.uint64)) for s in (a, b)]
                keys, owner = jaccard_join._signatures(np.concatenate(parts), np.cumsum([0, *map(len, parts)]), threshold)
                assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 50)), max_size=60), st.integers(1, 7), st.integers(1, 4))
def test_key_runs(rows, batch, window):
    rows.sort()
    runs, seen = groups.KeyRuns(window), []
    for i in range(0, len(rows), batch):
        part = rows[i : i + batch]
        key, value = np.array([k for k, _ in part]), np.array([v for _, v in part])
        head, previous, index, n = runs.feed(key, value)
        for j in range(len(part)):
            run = [v for k, v in rows[: i + j] if k == part[j][0]] + [part[j][1]]
            assert index[j] == len(run) - 1 and runs.rows[1][head[j]] == run[0]
            for w in range(1, window + 1):
                assert (previous[w - 1][j] >= 0) == (len(run) > w)
                if len(run) > w:
                    assert runs.rows[1][previous[w - 1][j]] == run[-1 - w]
        seen += part


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    sets = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and sets[a] != sets[b]:
                sets[a] = sets[b] = min(sets[a], sets[b])
                changed = True
    assert {r["node"]: r["root"] for r in groups.connected_components(df).collect()} == sets
    assert groups.connected_components(df.limit(0)).count() == 0


def test_compact_windows():
    """The windows are those of the definition, and every passage of t tokens lies in exactly one."""
    rng = np.random.default_rng(0)
    for n in (3, 10, 40):
        tokens = rng.integers(1, 2**63, n, dtype=np.uint64)
        walled = np.concatenate([[0], tokens, [0], tokens[:5], [0]]).astype(np.uint64)
        left, at, right = substring_dedup.compact_windows(walled, 8, 1)
        rank = text.mix(walled, 17)
        for i in range(1, n + 1):
            for j in range(i + 7, n + 1):
                c = i + int(np.argmin(rank[i : j + 1]))
                assert [k for k in range(len(at)) if left[k] <= i <= at[k] <= j <= right[k]] == [k for k in range(len(at)) if at[k] == c]


def words_of(rng, n):
    return [f"v{rng.randrange(10**6)}" for _ in range(n)]


def test_passages(docs):
    rng = random.Random(2)
    passage = words_of(rng, 60)
    edited = list(passage)
    edited[30] = "changed"
    made = [(i, " ".join(words_of(rng, 80) + p + words_of(rng, 50))) for i, p in enumerate([passage, passage, edited, words_of(rng, 60), passage[:40]])]
    df = docs([*made, (10, made[3][1]), (11, None), (12, ""), (None, made[0][1])])
    got = {(r["doc_id"], r["keep_doc_id"]): (r["start_word"], r["end_word"]) for r in substring_dedup.repeated_passages(df).collect()}
    assert got[1, 0] == (80, 140) and got[2, 0] == (80, 140) and (10, 3) in got
    assert {d for d, _ in got} == {1, 2, 10}
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(df, chars_col="n_chars").collect()}
    assert set(out) == {0, 1, 2, 3, 4, 11, 12, None}
    for i in (0, 3, 4):
        assert out[i]["text"] == made[i][1]
    assert split(out[1]["text"]) == split(made[1][1])[:80] + split(made[1][1])[140:] and out[1]["n_chars"] == len(out[1]["text"])
    assert substring_dedup.substring_dedup(docs([])).count() == 0


def tokens_of(ws):
    h = np.array([hash(w) & (2**63 - 1) for w in ws], np.uint64)
    return (text.shingle_stream(h, 5) >> np.uint64(32)).astype(np.uint32)


def test_passage_whose_line_is_also_elsewhere():
    """An equal passage is found whole where its middle line comes earlier in the kept text too, and across a long insertion."""
    rng = random.Random(8)
    p = words_of(rng, 60)
    x = tokens_of(p[24:36] + words_of(rng, 40) + p + words_of(rng, 20))
    y = tokens_of(words_of(rng, 10) + p + words_of(rng, 10))
    line = int(np.flatnonzero(y == x[0])[0])
    # Windows that pair the line with its first place in x only, beside one on the passage's own diagonal.
    shifts = np.array([-line, -line, -line, 42])
    (found,) = substring_dedup.passages(x, y, shifts, 46, 0.8)
    assert found[:4] == (10, 65, 52, 107) and found[4] == 1
    (found,) = substring_dedup.passages(x, y, shifts[:3], 46, 0.8)
    assert found[:2] == (10, 65)
    q = words_of(rng, 300)
    (found,) = substring_dedup.passages(tokens_of(q), tokens_of(q[:150] + words_of(rng, 25) + q[150:]), shifts, 46, 0.8)
    assert found[:4] == (0, 320, 0, 295)


def test_two_versions_and_hot_line(docs):
    """Copies of a version that the first document does not hold are found, and a line in many texts costs no passage."""
    rng = random.Random(11)
    made, twos = [], set()
    for f in range(12):
        a, b = words_of(rng, 56), words_of(rng, 56)
        b[:34] = a[:34]
        made += [(100 * f + i, " ".join(words_of(rng, 30) + (a if i == 0 else b) + words_of(rng, 30))) for i in range(10)]
        twos |= {100 * f + i for i in range(2, 10)}
    line = words_of(rng, 30)
    made += [(5000 + i, " ".join(words_of(rng, 60) + line + words_of(rng, 60))) for i in range(150)]
    got = substring_dedup.repeated_passages(docs(made)).collect()
    assert {r["doc_id"] for r in got} == twos
    assert all(r["end_word"] - r["start_word"] >= 56 for r in got)


@pytest.mark.parametrize("group", [4, 9])
def test_groups_whose_first_is_edited(docs, group):
    """Of groups with an exact passage whose first document holds an edited version, every other copy but one goes."""
    rng = random.Random(group)
    made, want = [], set()
    for f in range(240 // group):
        p = words_of(rng, 60)
        edited = [w if k % 17 else f"z{k}" for k, w in enumerate(p)]
        made += [(1000 * f + i, " ".join(words_of(rng, 20) + (edited if i == 0 else p) + words_of(rng, 20))) for i in range(group)]
        want |= {1000 * f + i for i in range(2, group)}
    got = {r["doc_id"] for r in substring_dedup.repeated_passages(docs(made)).collect()}
    assert want <= got


def near_passages(rng, n, size):
    """Pairs of passages with a few changed words, and the Jaccard similarity of their shingles."""
    for _ in range(n):
        p = words_of(rng, size)
        q = list(p)
        for k in rng.sample(range(size), rng.randrange(1, max(2, size // 30) + 1)):
            q[k] = f"y{rng.randrange(10**6)}"
        a, b = (shingles(" ".join(x), 5) for x in (p, q))
        yield p, q, len(a & b) / len(a | b)


def test_recall_of_near_passages(docs):
    """Of brute-force near duplicates, 0.9 and more are found; and of their copies in large families too."""
    rng = random.Random(3)
    made, want = [], set()
    for f, (p, q, s) in enumerate(near_passages(rng, 220, 90)):
        if s >= 0.8:
            made += [(10 * f + i, " ".join(words_of(rng, 25) + x + words_of(rng, 25))) for i, x in enumerate((p, q))]
            want.add(10 * f + 1)
    for f, (p, q, s) in enumerate(near_passages(rng, 30, 90)):
        if s >= 0.8:
            made += [(10_000 + 100 * f + i, " ".join(words_of(rng, 25) + (q if i % 2 else p) + words_of(rng, 25))) for i in range(12)]
            want |= {10_000 + 100 * f + i for i in range(1, 12)}
    df = docs(made)
    got = {tuple(r) for r in substring_dedup.repeated_passages(df).collect()}
    assert len(want & {r[0] for r in got}) >= 0.9 * len(want) and {r[0] for r in got} <= {i for i, _ in made}
    assert got == {tuple(r) for r in substring_dedup.repeated_passages(df.repartition(7)).collect()}


def test_nothing_is_left_of_text_that_repeats_itself(docs):
    """what another document holds goes whole, though a text has it more often, or on other diagonals than windows tell."""
    rng = random.Random(41)
    line = words_of(rng, 20)
    made = [words_of(rng, 30) + x + words_of(rng, 30) for x in (["de"] * 70 + ["la"] * 60, ["de"] * 230, ["la"] * 150 + ["de"] * 60, line * 4, line[7:] + line * 9)]
    out = {r["doc_id"]: split(r["text"]) for r in substring_dedup.substring_dedup(docs([(i, " ".join(w)) for i, w in enumerate(made)])).collect()}
    assert out[0] == made[0] and out[3] == made[3]
    assert all(out[i] == made[i][:30] + made[i][-30:] for i in (1, 2, 4))
    x, y = tokens_of(["de"] * 70 + line), tokens_of(line + ["de"] * 300 + line)
    spans = [s[:2] for s in substring_dedup.passages(x, y, np.array([-20]), 46, 0.8)]
    assert {k for a, b in spans for k in range(a, b + 1)} >= set(range(20, 316)) and all(b - a >= 45 for a, b in spans)


def test_rows_open_after_the_last_round(docs, monkeypatch):
    """rows of long runs that no round has settled are compared with one another, not with the first alone."""
    rng = random.Random(12)
    made, want = [], set()
    for f in range(12):
        a, b, c = (words_of(rng, 56) for _ in range(3))
        b[:42], c[14:] = a[:42], a[14:]
        made += [(100 * f + i, " ".join(words_of(rng, 30) + (a if i == 0 else b if i % 2 else c) + words_of(rng, 30))) for i in range(12)]
        want |= {100 * f + i for i in range(3, 12)}
    monkeypatch.setattr(substring_dedup, "ROUNDS", 0)
    assert {r["doc_id"] for r in substring_dedup.repeated_passages(docs(made)).collect()} == want


def test_tokens_are_dealt_once_and_texts_not_at_all(spark, docs, monkeypatch):
    """op1's finding on disk: no text is shuffled to find its tokens, both sides of the verifying join read the same tokens, and more of them than wanted do no harm."""
    rng = random.Random(31)
    passage = " ".join(words_of(rng, 60))
    df = docs([(i, f"{' '.join(words_of(rng, 30))} {passage} {' '.join(words_of(rng, 30))}" if i % 3 else " ".join(words_of(rng, 80))) for i in range(24)])
    ids = df.select("doc_id").where("doc_id % 3 > 0")
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    tokens = substring_dedup._tokens(df, ids)
    assert "Exchange" not in plan(tokens) and "Join" not in plan(tokens)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = spark.createDataFrame([(1, b, [0]) for b in (2, 4, 5)], "a long, b long, shifts array<long>")
        found = substring_dedup._verified(tokens, pairs, 50, 0.8)
        assert {(r["keep_doc_id"], r["doc_id"]) for r in found.collect()} == {(1, 2), (1, 4), (1, 5)}
        final = plan(found).split("Initial Plan")[0]
        assert final.count("ReusedExchange") == 1 and final.count("Scan ") == 2  # the pairs and, once, the texts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {tuple(r) for r in substring_dedup.repeated_passages(df).collect()}
    monkeypatch.setattr(groups, "MAP_BITS", 64)
    assert got and got == {tuple(r) for r in substring_dedup.repeated_passages(df).collect()}


def test_divided_rows():
    """Parts of a row cover its beginnings, and have equal keys where their minima are equal."""
    rng = np.random.default_rng(1)
    t, tokens = 8, np.concatenate([np.zeros(8, np.uint32), rng.integers(1, 2**32, 60, dtype=np.uint32), np.zeros(8, np.uint32)])
    at, key, place = np.array([30, 8]), np.array([5, 5]), np.array([(22 << 32) | (1 << 16) | 6, 0])
    row, keys, where = substring_dedup.divided(tokens, at, key, place, t, range(2, 4))
    assert [(w >> 32, w >> 16 & 0xFFFF, w & 0xFFFF) for w in where[row == 1]] == [(0, 0, 0)]
    low, high = where[row == 0] >> 16 & 0xFFFF, where[row == 0] & 0xFFFF
    assert low[0] == 1 and high[-1] == 6 and (low[1:] == high[:-1] + 1).all()
    minima = lambda s: tuple(int(text.mix(tokens[30 - s : 30 - s + t], 256 + k).min()) for k in (2, 3))
    for a, b in zip(low, high):
        assert len({minima(s) for s in range(a, b + 1)}) == 1
    assert len(set(keys[row == 0].tolist())) == len({minima(s) for s in range(1, 7)})


def test_passages_of_table(documents):
    """Every exact repeat of 51 words is found, and none is left after cutting."""
    rows = {r["doc_id"]: split(r["text"]) for r in documents.collect()}

    def repeats(rows):
        seen = {}
        for i, w in rows.items():
            for k in range(len(w) - 50):
                seen.setdefault(tuple(w[k : k + 51]), set()).add(i)
        return {i for s in seen.values() if len(s) > 1 for i in s}

    found = substring_dedup.repeated_passages(documents).collect()
    assert repeats(rows) <= {r["doc_id"] for r in found} | {r["keep_doc_id"] for r in found}
    left = {r["doc_id"]: split(r["text"]) for r in substring_dedup.substring_dedup(documents).collect()}
    assert len(repeats(left)) <= 0.02 * len(repeats(rows))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 64))
    x = [*base, *(base[5] + 0.05 * rng.standard_normal((120, 64))), *(base[9] + 0.2 * rng.standard_normal((60, 64))), *([base[7]] * 40)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] * 64, [1.0, 2.0], [3.0]]
    rows = [(i, [float(z) for z in v] if v is not None and len(v) == 64 and not isinstance(v, list) else v) for i, v in enumerate([*x, *odd])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, key int")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df).collect()}
    unit = np.array(x, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    assert sum(got[i]["n_links"] for i in range(len(x))) >= 0.99 * (near.sum() - len(x))
    assert all(got[i]["n_links"] <= near[i].sum() - 1 for i in range(len(x)))
    for i in range(len(x), len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(got[i]["component_id"] == 7 and not got[i]["kept"] for i in range(480, 520))
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def links_of(spark, vectors):
    df = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    return {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_dedup(df).collect()}


@pytest.mark.parametrize(("noise", "others"), [(0.1, 0), (0.2, 40)])
def test_tight_cluster(spark, noise, others):
    """Vectors in one narrow cluster are found like any others."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(64) + noise * rng.standard_normal((300, 64)), rng.standard_normal((others, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    got = links_of(spark, x)
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.95 * want.sum() > 0


def test_recall_at_the_bound(spark):
    """Pairs with a cosine just above the bound, among vectors with a strong common direction."""
    rng = np.random.default_rng(6)
    for common in (0.0, 1.0):
        x = rng.standard_normal((1500, 48)) + common
        near = x[:500] / np.linalg.norm(x[:500], axis=1, keepdims=True)
        turn = rng.standard_normal((500, 48))
        turn -= (turn * near).sum(1, keepdims=True) * near
        turn /= np.linalg.norm(turn, axis=1, keepdims=True)
        every = np.concatenate([x, near * 0.952 + turn * np.sqrt(1 - 0.952**2)])
        unit = every / np.linalg.norm(every, axis=1, keepdims=True)
        want = (unit @ unit.T >= 0.95).sum(1) - 1
        got = links_of(spark, every)
        assert sum(got.values()) >= 0.95 * want.sum() >= 900


def test_lengths_are_classes(spark):
    got = links_of(spark, [*([[1.0, 2.0]] * 3), *([[1.0, 2.0, 3.0]] * 5), [1.0, 2.01], [5.0], [7.0]])
    assert got == {0: 3, 1: 3, 2: 3, 3: 4, 4: 4, 5: 4, 6: 4, 7: 4, 8: 3, 9: 1, 10: 1}


@pytest.mark.parametrize("block", [16])
def test_large_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal(64) + 0.02 * rng.standard_normal((100, 64)), rng.standard_normal((300, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {(r["vec_id"] < 100, r["n_links"]) for r in embedding_dedup.embedding_dedup(df).collect()} == {(True, 99), (False, 0)}
