"""Decontamination by winnowing against SQL and brute force."""

import hashlib
import random
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from agreeline.llm import decontaminate, registry

DATA = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def brute(docs, items, span=10):
    wanted = {}
    for item, text in items:
        w = words(text)
        k = min(span, len(w))
        for s in range(len(w) - k + 1) if k else ():
            wanted.setdefault(tuple(w[s : s + k]), set()).add(item)
    lengths = {len(g) for g in wanted}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for s in range(len(w) - k + 1):
                if (g := tuple(w[s : s + k])) in wanted:
                    hit.update(range(s, s + k))
                    found |= wanted[g]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def got(spark, docs, items, **how):
    df = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **how)
    rows = df.collect()
    assert all(r.n_items == len(r["items"]) for r in rows)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=repr)


@pytest.mark.parametrize(("span", "vocabulary", "bits"), [(10, 4, 26), (10, 2, 26), (10, 60, 6), (6, 3, 26), (3, 5, 8)])
def test_equals_brute_force(spark, monkeypatch, span, vocabulary, bits):
    monkeypatch.setattr(decontaminate, "BITS", bits)  # of few bits nearly all are set: the join decides
    rng = random.Random(span * vocabulary)
    text = lambda n: " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 5, 6, 9, 10, 11, 14, 30]))) for i in range(40)]
    docs = [(i, text(rng.choice([0, 3, 9, 10, 40, 200]))) for i in range(60)]
    docs += [(100 + i, f"{text(5)} {rng.choice(items)[1].upper()}, {text(5)}") for i in range(40)]
    assert got(spark, docs, items, span=span) == brute(docs, items, span)


def test_every_long_shared_passage_is_found(spark):
    rng = random.Random(1)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(300)]
    items = [(1, " ".join(passage))]
    docs = [(n, f"{n} " + " ".join(passage[n : n + n % 13]) + f" z{n}") for n in range(1, 250)]
    assert [(d, h) for d, _, h, _ in got(spark, docs, items)] == sorted(((n, n % 13 if n % 13 >= 10 else 0) for n in range(1, 250)), key=repr)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, " \n,.!"), (4, item), (4, item), (None, item.replace(" ", "--")), (None, None), (5, "one two three"), (6, "Straße ÄRGER ärger x y"), (7, "ONE. TWO. " * 3)]
    items = [(1, item), (1, item + " twelve"), (2, None), (3, ""), (None, "x y"), (4, "straße ÄRGER"), (5, "one two three four"), (5, "two")]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], items) == []
    clash = spark.createDataFrame([(1, item, "a", 1, 2)], "doc_id long, text string, mark string, row long, item long")
    assert [(r.doc_id, r.n_hit) for r in decontaminate.contamination(clash, spark.createDataFrame(items, ITEMS)).collect()] == [(1, 11)]


def test_very_long_texts(spark):
    items = [(1, " ".join(f"q{i}" for i in range(12)))]
    docs = [(1, "word " * 300_000 + items[0][1] + " word" * 300_000), (2, "x" * 2_000_000), (3, (items[0][1] + " ") * 20_000)]
    assert [(n, hit) for _, n, hit, _ in got(spark, docs, items)] == [(600_012, 12), (1, 0), (240_000, 240_000)]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES["op12_winnowing"](spark, DATA)
    want = con.sql(registry.ORACLES["op12_winnowing"]).df()
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.itertuples(index=False, name=None))
    assert df.filter("contaminated").count() > 0
    assert df.filter(F.col("items_sha256") == hashlib.sha256(b"").hexdigest()).count() == df.filter("n_items = 0").count()
