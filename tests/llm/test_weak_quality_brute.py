"""The weak-label model and its scorer against plain ones, a document, a vote and a feature at a time."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from agreeline.llm import registry, weak_quality

DATA = "/root/testdata/sf0.001"
N = len(weak_quality.LABELLERS)


def plain_votes(text):
    words = (text or "").split()
    return [f(words, text) if words else (0 if f is weak_quality.length else 2) for f in weak_quality.LABELLERS]


def plain_belief(votes):
    low = [v == 0 for v in votes]
    if not any(low):
        return [weak_quality.TRUST] + [(1 - weak_quality.TRUST) / N] * N
    return [1 - weak_quality.TRUST] + [weak_quality.TRUST * (1 / sum(low) if x else 1e-3) for x in low]


def plain_em(votes):
    """Posteriors of the kinds of each document."""
    kinds = range(N + 1)
    post = [[p / sum(b) for p in b] for b in map(plain_belief, votes)]
    for _ in range(300):
        shares = [(sum(p[k] for p in post) + 1) / (len(votes) + N + 1) for k in kinds]
        table = [[[1.0 + sum(p[k] for p, v in zip(post, votes, strict=True) if v[j] == x) for x in range(3)] for j in range(N)] for k in kinds]
        table = [[[x / sum(row) for x in row] for row in own] for own in table]
        new, seen = [], {}
        for v in votes:
            if (key := tuple(v)) not in seen:
                odds = [shares[k] * math.prod(table[k][j][v[j]] for j in range(N)) * plain_belief(v)[k] ** weak_quality.PRIOR for k in kinds]
                seen[key] = [o / sum(odds) for o in odds]
            new.append(seen[key])
        moved = max(abs(a - b) for p, q in zip(post, new, strict=True) for a, b in zip(p, q, strict=True))
        if moved < 1e-7:
            break
        post = new
    return post, shares, table


def plain_features(text):
    words = (text or "").split()
    found = Counter(f for w in words for f in weak_quality.token_features(w))
    return {f: n / max(1, len(words)) for f, n in found.items()}


def plain_fit(rows):
    """Logistic regression on soft labels: batches in the same order, one feature at a time."""
    w, g, b, gb = {}, {}, 0.0, 1e-8
    rng = np.random.default_rng(1)
    squash = lambda z: 1 / (1 + math.exp(-max(-30, min(30, z))))
    for _ in range(30):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            step, miss = {}, []
            for i in part:
                x, y = rows[i]
                miss.append(squash(sum(w.get(f, 0.0) * v for f, v in x.items()) + b) - y)
                for f, v in x.items():
                    step[f] = step.get(f, 0.0) + v * miss[-1] / len(part)
            for f, s in step.items():
                s += 1e-6 * w.get(f, 0.0)
                g[f] = g.get(f, 1e-8) + s * s
                w[f] = w.get(f, 0.0) - 0.5 * s / math.sqrt(g[f])
            mean = sum(miss) / len(miss)
            gb += mean * mean
            b -= 0.5 * mean / math.sqrt(gb)
    return lambda x: squash(sum(w.get(f, 0.0) * v for f, v in x.items()) + b)


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_label_model_equals_plain_em(spark, docs):
    shares, table, n = weak_quality.label_model(spark.createDataFrame(docs, "doc_id long, text string"))
    votes = [plain_votes(t) for _, t in docs]
    post, plain_shares, plain_table = plain_em(votes)
    assert n == len(docs)
    assert np.allclose(shares, plain_shares, atol=1e-5) and np.allclose(table, plain_table, atol=1e-5)
    patterns = np.array([sum(x * 3**j for j, x in enumerate(v)) for v in votes])
    assert np.allclose(weak_quality.posterior(patterns, shares, table), [p[0] for p in post], atol=1e-5)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_query_equals_plain_model_and_scorer(spark, docs):
    post, _, _ = plain_em([plain_votes(t) for _, t in docs])
    once = {xxhash.xxh3_64_intdigest(t or "") >> 24: (plain_features(t), p[0]) for (_, t), p in zip(docs, post, strict=True)}
    score = plain_fit([once[h] for h in sorted(once)])
    got = {r.doc_id: r.score for r in registry.QUERIES["op9_weak_label_quality"](spark, DATA).collect()}
    want = {d: score(plain_features(t)) for d, t in docs}
    assert set(got) == set(want) and max(abs(got[d] - want[d]) for d in want) < 2e-3
    assert sum((got[d] >= 0.5) != (want[d] >= 0.5) for d in want) <= 1
