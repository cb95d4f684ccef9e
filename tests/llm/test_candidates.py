"""Candidates of the near-duplicate search: chance brings no documents together, and no link is lost."""

import random

import numpy as np
import pytest

from agreeline.llm import jaccard


def shingles(text, n):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def components(rows, n, num, den):
    sets, root = [shingles(t, n) for _, t in rows], list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if root[i] != root[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return {rows[i][0]: rows[root[i]][0] for i in range(len(rows))}


def corpus(words_of=14):
    """Texts of few words, which share many shingles by chance, and some near copies in pairs and in one group."""
    rng, rows = random.Random(8), []
    for i in range(150):
        words = [f"w{rng.randrange(words_of)}" for _ in range(rng.randint(150, 260))]
        for _ in range(12 if i == 0 else 2 if i % 10 == 0 else 1):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "w0"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("n", "num", "words_of"), [(5, 80, 14), (3, 90, 60)])
def test_shingles_shared_by_chance_tie_nothing(spark, monkeypatch, n, num, words_of):
    """As in a corpus so large that the table of counts tells rare shingles from others no more."""
    seen, connected = [], jaccard.connected
    monkeypatch.setattr(jaccard, "frequencies", lambda *_: np.zeros(jaccard.SLOTS, np.uint16))
    monkeypatch.setattr(jaccard, "connected", lambda edges, a, b: seen.append(edges.count()) or connected(edges, a, b))
    rows = corpus(words_of)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()}
    want = components(rows, n, num, 100)
    links = len(rows) - len(set(want.values()))
    assert got == want and links > 20
    assert seen[0] <= 66 + links  # 66 pairs of the group of 12


@pytest.mark.parametrize("share", [1e-9, 20, 1e12])
def test_no_link_is_lost_with_any_number_of_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(jaccard, "PAIRS", share)
    rows = corpus()
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, 100).collect()}
    assert got == components(rows, 5, 80, 100)


def test_sketches_are_no_farther_apart_than_the_sets():
    rng = np.random.default_rng(4)
    for size in (1, 5, 60, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[size // 5 :], rng.integers(0, 1 << 63, rng.integers(1, size + 1)).astype(np.uint64)]))
        other = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        s, t, u = (jaccard.sketch(x) for x in (a, b, other))
        assert len(s) == 64
        apart = jaccard.differences([s, s, t, s], [s, t, s, u]).tolist()
        assert apart[0] == 0 and apart[1] == apart[2] <= len(np.setxor1d(a, b))
        if size == 700:
            assert apart[3] > 2 * size / 9  # unrelated sets don't pass for a similarity of 0.8
