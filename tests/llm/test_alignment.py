"""Alignment of two tokenizers against the tokenizers libraries and sets of ends."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from agreeline.llm import alignment, bpe, registry

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens_of(coders, text):
    """(id, bytes) of both sides, nothing if the bytes aren't those of the text."""
    a, b = coders
    back = {c: x for x, c in bpe.byte_chars().items()}
    x = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(back[c] for c in t)) for i, t in zip(x.ids, x.tokens, strict=True)]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
    want = b" " + text.encode()
    return (left, right) if b"".join(t for _, t in left) == want == b"".join(t for _, t in right) else ([], [])


def brute(coders, docs):
    links, rows = Counter(), []
    for doc, text in docs:
        left, right = tokens_of(coders, text) if text else ([], [])
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (left, right)]
        both = sorted(set(ends[0]) & set(ends[1]))
        of = [dict(zip(e, [i for i, _ in side], strict=True)) for e, side in zip(ends, (left, right), strict=True)]
        pairs = [(of[0][e], of[1][e]) for e in both]
        links.update(pairs)
        groups, at = [], [0, 0]
        for e in both:
            until = [es.index(e, i) + 1 for es, i in zip(ends, at, strict=True)]
            groups.append("|".join(",".join(str(i) for i, _ in side[i:j]) for side, i, j in zip((left, right), at, until, strict=True)))
            at = until
        rows.append((doc, len(left), len(right), len(both), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    return sorted([(d, a, b, g, len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), s) for d, a, b, g, p, s in rows], key=repr)


def got(df):
    return sorted([(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()], key=repr)


def test_common_ends_are_all_found():
    rng = random.Random(3)
    for _ in range(300):
        sizes, low, high, a, b, base = [], [], [], [], [], 0
        for _ in range(rng.randint(1, 5)):
            n = rng.randint(1, 200)
            sizes.append(n)
            few = rng.choice([0.02, 0.3, 0.9])
            low.append(len(a) - 1)
            a += sorted({base + n, *(base + x for x in range(1, n) if rng.random() < few)})
            b += sorted({base + n, *(base + x for x in range(1, n) if rng.random() < 0.5)})
            high.append(len(a) - 1)
            base += n
        a, b = np.array(a), np.array(b)
        assert alignment.common_ends(a, b, np.array(low), np.array(high)).tolist() == np.flatnonzero(np.isin(a, b)).tolist()


def test_one_interval_without_cuts_ends_quickly():
    a, b = np.append(np.arange(1, 2_000_000, 2), 2_000_000), np.arange(2, 2_000_002, 2)
    assert alignment.common_ends(a, b, np.array([-1]), np.array([len(a) - 1])).tolist() == [len(a) - 1]


@pytest.mark.parametrize("head", [1_000_000, 200, 0])
def test_odd_rows_equal_brute_force(spark, coders, head):
    rng = random.Random(head)
    parts = ["hello", " ", "  ", "\n", "Straße", "日本語", "é", "▁", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "🙂", "123", "\t", "\0", "ﬁ", "…", "a" * 40, "=" * 30, " ", "　", "İ", "I'm", "été", "مرحبا", "\r\n", "​"]
    docs = [(1, None), (2, ""), (3, " "), (None, "one two"), (None, "one two"), (4, "one two"), (4, "one two"), (5, "\n"), (6, "x")]
    docs += [(i + 10, "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    df = spark.createDataFrame([(*d, 1, "x", 2, 3) for d in docs], SCHEMA + ", row long, pairs string, n_a long, best long").repartition(3)
    want = brute(coders, docs)
    assert got(alignment.judged(df, A, B, head=head)) == want
    assert sum(r[1] > 0 for r in want) > 30
    assert got(alignment.judged(spark.createDataFrame([], SCHEMA), A, B)) == []


def test_very_long_texts(spark, coders):
    docs = [(2, "lorem ipsum " * 40_000), (4, "ab cd\n" * 20_000)]
    assert got(alignment.judged(spark.createDataFrame(docs, SCHEMA), A, B)) == brute(coders, docs)
    runs = [(1, "=" * 300_000), (2, " " * 100_000 + "x"), (3, "ab" * 100_000)]  # the library that the vocabulary is for takes hours for these
    vocab = bpe.Vocabulary(A)
    for (_, text), r in zip(runs, got(alignment.judged(spark.createDataFrame(runs, SCHEMA), A, B)), strict=True):
        spaces, rest = bpe.PIECES.findall(" " + text)[:-1], bpe.PIECES.findall(" " + text)[-1]
        ids, own = [t for p in [*spaces, rest] for t in vocab.merge(p.encode())], coders[1].encode(text)
        ends = np.cumsum([len(vocab.bytes[i]) for i in ids]), np.cumsum([len(coders[1].id_to_piece(i).replace("▁", " ").encode()) for i in own])
        assert r[1:4] == (len(ids), len(own), len(np.intersect1d(*ends)))


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_query_equals_brute_force(spark, coders):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got(registry.QUERIES["op11_shared_cut_alignment"](spark, DATA)) == brute(coders, docs)
