"""The quality classifier against a plain version of it: loops over documents, labellers and words, no batches."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sightframe.llm import quality, queries
from sightframe.llm.text import mix, shingle_stream, words

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELLERS = 7


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


class Hashed:
    """Buckets of words, as the library hashes them; the hashes are its own, what is done with them is not."""

    def __init__(self):
        self.known = {}

    def __call__(self, word):
        if word not in self.known:
            w = next(words(pa.array([word]), space=quality.PUNCTUATION, prefix=quality.BEGINNING))
            self.known[word] = w.hashes[0], w.prefixes[0]
        return self.known[word]

    def word(self, word):
        return int(self(word)[0]) % quality.BUCKETS

    def beginning(self, word):
        return int(self(word)[1]) % quality.BUCKETS


def verdict(x, bad, good):
    return 1 if bad(x) else 0 if good(x) else -1


def plain_votes(text, lexicon, hashed):
    raw, said = (text or "").encode(), terms(text)
    ink = sum(b > 0x20 for b in raw)
    upper, lower = sum(0x41 <= b <= 0x5A for b in raw), sum(0x61 <= b <= 0x7A for b in raw)
    symbols = sum(chr(b) in "#$%&*@^~|<>{}[]=+_\\/" for b in raw)
    n = len(said)
    per = lambda x: x / max(n, 1)
    return [
        verdict(symbols / max(ink, 1), lambda s: s > 0.04, lambda s: s < 0.01 and ink > 0),
        verdict(upper / max(upper + lower, 1), lambda s: s > 0.4 and upper > 20, lambda s: s < 0.15 and lower > 0),
        verdict(per(sum(a == b for a, b in zip(said, said[1:]))), lambda s: s > 0.2 and n >= 10, lambda s: s < 0.05 and n > 0),
        verdict(per(raw.count(b"|")), lambda s: s > 0.25 and n > 0, lambda s: s < 0.02 and n > 0),
        1 if len({hashed.word(t) for t in said} & lexicon) >= quality.LOADED_HITS else -1,
        verdict(per(sum(len(t.encode()) for t in said)), lambda s: s > 20 and n > 0, lambda s: 2 < s < 14),
    ]


def odds(sets, bad):
    """For each bucket the documents against and for, log odds and standard errors from nought."""
    against, for_ = defaultdict(float), defaultdict(float)
    for s, b in zip(sets, bad):
        for x in s:
            against[x] += b
            for_[x] += 1 - b
    out = {}
    for x in against.keys() | for_.keys():
        p, n = against[x], for_[x]
        o = math.log((p + 0.5) / (sum(bad) + 1)) - math.log((n + 0.5) / (len(bad) - sum(bad) + 1))
        out[x] = p, n, o, o / math.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    return out


def plain_posterior(votes):
    """The probability of being bad for each tuple of votes (0 silent, 1 keeps, 2 rejects)."""
    counts = Counter(votes)
    kinds = range(LABELLERS + 1)  # 0 is good
    share = {}
    for v in counts:
        rejecting = [k for k in range(LABELLERS) if v[k] == 2]
        own = [0.95 / len(rejecting) * (k in rejecting) if rejecting else 0.02 / LABELLERS for k in range(LABELLERS)]
        share[v] = [1 - sum(own), *own]
    total = sum(counts.values())
    for _ in range(300):
        prior = [(sum(share[v][c] * n for v, n in counts.items()) + 0.1) / (total + 0.1 * len(kinds)) for c in kinds]
        rate = {}
        for k in range(LABELLERS):
            for c in kinds:
                r = [sum(share[v][c] * n for v, n in counts.items() if v[k] == s) + 0.1 for s in range(3)]
                r = [x / sum(r) for x in r]
                if k == LABELLERS - 1:
                    silent = sum(n for v, n in counts.items() if v[k] == 0) / total
                    r = [max(silent, 1e-12), *(x * (1 - silent) / (r[1] + r[2]) for x in r[1:])]
                rate[k, c] = r
        new = {}
        for v in counts:
            like = [math.log(prior[c]) + sum(math.log(max(rate[k, c][v[k]], 1e-12)) for k in range(LABELLERS)) for c in kinds]
            e = [math.exp(x - max(like)) for x in like]
            new[v] = [x / sum(e) for x in e]
        done = max(abs(a - b) for v in counts for a, b in zip(new[v], share[v])) < 1e-9
        share = new
        if done:
            break
    return {v: 1 - s[0] for v, s in share.items()}


def plain_scorer(sets, bad):
    """Weights by bucket and bias: the maximum of the likelihood with a quadratic penalty, by Newton's method."""
    ranked = [(-abs(c), x) for x, (p, n, o, c) in odds(sets, bad).items() if abs(o) > quality.LEAST_ODDS and abs(c) > quality.LEAST_CLEAR and p + n >= 4]
    chosen = [x for _, x in sorted(ranked)[: quality.COLUMNS]]
    x = np.array([[float(c in s) for c in chosen] + [1.0] for s in sets])
    penalty = np.array([quality.PENALTY] * len(chosen) + [1e-3])
    beta = np.zeros(len(penalty))
    for _ in range(60):
        said = 1 / (1 + np.exp(-(x @ beta)))
        slope = x.T @ (np.array(bad) - said) - penalty * beta
        beta = beta + np.linalg.solve(x.T @ np.diag(said * (1 - said)) @ x + np.diag(penalty), slope)
    return dict(zip(chosen, beta)), beta[-1]


def marks(said, hashed):
    if not said:
        return set()
    s = shingle_stream(np.array([hashed(t)[0] for t in said], np.uint64), min(5, len(said)))
    return {(k, int(mix(s, 80 + k).min())>> 1) for k in range(quality.MARKS)}


def plain_scores(docs, labels):
    """doc_id to score, for documents of which each doc_id is there once."""
    hashed = Hashed()
    annotation, toxic = {}, {}
    for i, good, tox in labels:
        annotation[i] = max(annotation.get(i, 0), 2 if tox == 1 or good == 0 else 1)
        toxic[i] = max(toxic.get(i, 0), int(tox == 1))
    sample, seen = [], set()
    for i, text in sorted(docs.items()):
        if text is not None:
            own = marks(terms(text), hashed)
            if not own & seen:
                sample.append(i)
            seen |= own
    judged = [i for i in sample if i in toxic]
    loaded = odds([{hashed.word(t) for t in terms(docs[i])} for i in judged], [float(toxic[i]) for i in judged])
    strong = sorted((-c, x) for x, (p, _, o, c) in loaded.items() if o > quality.LOADED_ODDS and c > quality.LOADED_CLEAR and p >= quality.LOADED_DOCS)
    lexicon = {x for _, x in strong[: quality.LEXICON]}
    votes = {i: plain_votes(t, lexicon, hashed) for i, t in docs.items()}
    pattern = {i: (*(v + 1 for v in votes[i]), annotation.get(i, 0)) for i in docs}
    posterior = plain_posterior(list(pattern.values()))
    said = lambda i: {k * 7919 + 104729 for k, v in enumerate(votes[i]) if v == 1}
    features = {i: {hashed.word(t) for t in terms(docs[i])} | {hashed.beginning(t) for t in terms(docs[i])} | {x % quality.BUCKETS for x in said(i)} for i in docs}
    weights, bias = plain_scorer([features[i] for i in sample], [posterior[pattern[i]] for i in sample])
    return {i: 1 / (1 + math.exp(-(sum(weights.get(x, 0.0) for x in features[i]) + bias))) for i in docs}


def test_scores(spark):
    """The query's scores and verdicts, lexicon, EM and scorer included, are those of the plain version."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = {r["doc_id"]: r["text"] for r in rows}
    assert len(docs) == len(rows) <= quality.SAMPLE / 2
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = plain_scores(docs, labels)
    got = {r["doc_id"]: r for r in queries.op10_quality_classifier(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert {i: got[i]["bad_score"] for i in got} == pytest.approx(want, abs=2e-4)
    sure = {i for i in want if abs(want[i] - quality.REJECT) > 1e-3}
    assert {i: got[i]["kept"] for i in sure} == {i: want[i] < quality.REJECT for i in sure}
