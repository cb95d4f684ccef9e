"""Exact top-k search: groups of like candidates, their ranges, and queries sent to some of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agreeline.llm import topk


def brute(ids, x, asked, k):
    x = x.astype(np.int64)
    return sorted((int(ids[q]), rank, int(j), int(s)) for q in asked for rank, (s, j) in enumerate(sorted(((int(x[q] @ x[i]), ids[i]) for i in range(len(x)) if i != q), key=lambda p: (-p[0], p[1]))[:k], 1))


def made(kind: str, n: int = 900) -> np.ndarray:
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 24))
    if kind == "one hot vector":
        x[::3] = x[0]
    if kind == "clusters":
        x = x[rng.integers(0, 12, n)] + 0.2 * x
    if kind == "one axis":
        x[:, 1:] = 0
    if kind == "large numbers":
        x *= 1e6
    return x


@pytest.mark.parametrize("kind", ["even", "one hot vector", "clusters", "one axis", "large numbers"])
def test_small_groups_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "GROUP", 70)
    x = made(kind)
    df = spark.createDataFrame([(i, v.tolist(), "x", i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, g string, row long")
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(np.arange(len(x)), np.floor(256 * x), range(0, len(x), 50), 5)


def test_wide_vectors_are_not_turned(spark, monkeypatch):
    monkeypatch.setattr(topk, "TURNED", 8)
    x = made("even", 200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0, k=3).collect()))
    assert got == brute(np.arange(200), np.floor(256 * x), range(0, 200, 50), 3)


def test_only_empty_vectors(spark):
    df = spark.createDataFrame([(50, []), (50, []), (7, [])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 50 == 0, k=2).collect()))
    assert got == [(50, 1, 7, 0)] * 2 + [(50, 2, 50, 0)] * 2


@pytest.mark.parametrize("width", [1, 5, 16, 17, 40])
def test_ranges_bound_every_product(width):
    rng = np.random.default_rng(width)
    x, q = rng.normal(size=(300, width)), rng.normal(size=(50, width))
    axes = topk.axes_of(x.T @ x)
    parts = [topk.Held(np.arange(100), np.arange(100), x[at : at + 100], axes, 5.0) for at in (0, 100, 200)]
    bound = topk.reach(topk.turn(q, axes), np.stack([p.ranges() for p in parts]))
    for g, p in enumerate(parts):
        assert (bound[:, g] >= (q @ p.x.T).max(1) - 1e-9).all()


def test_queries_go_to_few_groups_of_clusters():
    """Forty far-apart clusters, a group each: a query's own group gives scores that few others reach."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    of = rng.integers(0, 40, 4000)
    x = np.floor(256 * (centres[of] + 0.1 * rng.normal(size=(4000, 32))))
    axes = topk.axes_of(x.T @ x)
    ranges = np.stack([topk.Held(np.flatnonzero(of == c), np.flatnonzero(of == c), x[of == c], axes, 2000.0).ranges() for c in range(40)])
    q = np.arange(0, 4000, 50)
    tops = [sorted((int(x[i] @ x[j]) for j in np.flatnonzero(of == of[i]) if j != i))[-5:] for i in q]
    batch = pa.RecordBatch.from_pydict({"row": pa.array(q), "v": pa.array([x[i].tolist() for i in q]), "tops": pa.array(tops), "g": pa.array(of[q].astype(np.int32))})
    out = pa.Table.from_batches(topk.route(iter([batch]), axes, 32, 5, 2000.0, np.arange(40), ranges))
    sent = out.column("gs").to_pylist()
    assert sum(map(len, sent)) <= 0.1 * 40 * len(q)
    for i, best, to in zip(q, tops, sent, strict=True):  # none is left out that holds a better one
        assert {int(of[j]) for j in range(4000) if x[i] @ x[j] >= best[0]} <= {*to, int(of[i])}
