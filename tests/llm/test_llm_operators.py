"""The training-data operators against brute force, round trips and held-out labels; odd inputs."""

import datetime
import hashlib
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from agreeline.llm import bpe, jaccard, language, mixing, pii, quality_rules, registry, tokens, topk, toxicity, weak_quality

DATA = "/root/testdata/sf0.001"
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, equal texts, a long text, and columns
    whose names the operators use themselves."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "Hello there, you idiot", "en", None), (4, "Hello there, you idiot", "en", None), (5, "a b c", "de", "b"), (6, "A b C", "de", "b"),
        (None, "no id here", "fr", "b"), (7, long, None, "c"), (8, long + " end", "es", "c"), (9, "l\nl\nl\nx", "en", "c"), (10, "<|endoftext|> \0 x   y", "en", "c"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in ("label", "rep", "node", "t", "k1", "size", "src", "found", "score", "host", "at")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, n, num, den):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset() if not w else frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    sets, root, where = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}, defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        overlap = Counter(j for g in sets[i] for j in where[g])
        for j, o in overlap.items():
            if den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            where[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("side", "grams", "n", "num", "long"), [(2048, 1 << 20, 3, 90, 1024), (3, 1 << 20, 3, 90, 16), (2048, 200, 3, 90, 32), (2048, 1 << 20, 5, 80, 10)])
def test_jaccard_is_exact(spark, monkeypatch, side, grams, n, num, long):
    monkeypatch.setattr(jaccard, "SIDE", side)
    monkeypatch.setattr(jaccard, "SIDE_GRAMS", grams)
    monkeypatch.setattr(jaccard, "LONG", long)
    rng, rows = random.Random(5), []
    for _ in range(120):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 9, 12, 20, 30, 60, 150]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
            rows.append((len(rows), " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()}
    assert got == brute_components(rows, n, num, 100)


def test_jaccard_odd_rows(spark, odd):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd, 3, 90, 100).collect())
    assert got[(1, 0, 1)] == got[(2, 0, 2)] == got[(3, 0, 3)] == 1 and got[(4, 2, 4)] == 2
    assert got[(5, 1, 5)] == got[(6, 1, 5)] == 1 and got[(None, 1, None)] == 1
    assert jaccard.jaccard_components(empty(spark)).count() == 0


@pytest.mark.parametrize(("num", "long", "ways"), [(90, 1024, 4), (90, 20, 4), (80, 20, 4), (80, 5, 1), (90, 5, 2)])
def test_signatures_keep_every_pair_over_the_threshold(monkeypatch, num, long, ways):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "WAYS", ways)
    rng = random.Random(3)
    frequency = np.random.default_rng(3).integers(0, 4, jaccard.SLOTS).astype(np.uint16)
    for _ in range(300):
        n = rng.randint(1, 200)
        a = set(rng.sample(range(10_000), n))
        b = set(a)
        for _ in range(rng.randint(0, max(1, n // (9 if num == 90 else 4)))):
            if rng.random() < 0.5 and b:
                b.discard(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(10_000))
        if not b or 100 * len(a & b) < num * len(a | b):
            continue
        one, two = (jaccard.signatures(np.unique(jaccard.mix(np.array(sorted(x), np.uint64))), frequency, num, 100) for x in (a, b))
        assert set(one.tolist()) & set(two.tolist())


def test_one_key_with_two_texts_keeps_the_links_of_both(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " x"), (8, "c d e"), (None, a)]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect())
    assert got == Counter({(5, 5): 2, (6, 5): 1, (7, 5): 1, (8, 8): 1, (None, None): 1})


def test_unrelated_long_texts_never_meet():
    rng = np.random.default_rng(1)
    frequency, seen = np.zeros(jaccard.SLOTS, np.uint16), set()
    for _ in range(40):  # a third of each set comes from a pool that all of them share
        grams = np.unique(jaccard.mix(np.concatenate([rng.integers(0, 50_000, 1500), rng.integers(0, 1 << 60, 3000)]).astype(np.uint64)))
        sigs = set(jaccard.signatures(grams, frequency, 90, 100).tolist())
        assert not sigs & seen
        seen |= sigs


def test_frequencies_count_every_document(spark):
    rows = [(i, f"same three words {i}") for i in range(300)]
    table = jaccard.frequencies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3, "text")
    common = jaccard.shingles("same three words", 3, jaccard.WordHashes())
    assert table[jaccard.slots(common)[0]] == int(1024 * np.log2(301)) and (table > 0).sum() in range(250, 302)


def test_bpe_equals_the_library(spark, docs, odd):
    library = Tokenizer.from_file(JSON)
    rng = random.Random(1)
    alphabet = "ab Z9é\n\t ''sre.,!$\x1c\x85\xa0ñ漢😀"
    fuzz = spark.createDataFrame([(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(2000)] + [(5000, "z" * 3000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(fuzz)
    texts = [r.text or "" for r in both.collect()]
    want = Counter((tuple(e.ids), library.decode(e.ids, skip_special_tokens=False)) for e in library.encode_batch(texts, add_special_tokens=False))
    got = Counter((tuple(r.ids), r.decoded) for r in bpe.encode_decode(both, JSON, size=3000).collect())
    assert got == want
    assert bpe.encode_decode(empty(spark), JSON).count() == 0


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["a", "ing", "sing", "ring", "rings", "sings", "ü"])}
    lex = bpe.Lexicon.load(np.frombuffer(bpe.Lexicon.build(words).save(), np.uint8))
    rows = lex.rows([*words, b"rin", b"ringss", b"x", b""]).tolist()
    assert [lex.a["ids"][lex.a["offset"][r] : lex.a["offset"][r + 1]].tolist() for r in rows[: len(words)]] == [*words.values()] and rows[len(words) :] == [-1] * 4
    ends = {w: i for i, w in enumerate([p + e for p in "bcd" for e in ("olts", "old")])}
    assert len(bpe.Lexicon.build({w.encode(): [i] for w, i in ends.items()}).a["first"]) - 1 == 6  # root; after b, c or d; o; l; t; the end


def test_lexicon_has_the_most_frequent_words(spark):
    n = {f"w{i}": 2 + i // 3 for i in range(60)}
    df = spark.createDataFrame([(0, " ".join(f"{w} " * k for w, k in n.items()), "", "", 0)], SCHEMA)
    counts = Counter({r.word: r.n for r in bpe.word_counts(df, JSON).filter("n > 1").collect()})
    for size in (1, 2, 3, 7, 30, 59, 60, 61, 1000):
        lexicon = bpe.build_lexicon(df, JSON, size=size)
        held = {w for w in counts if lexicon.rows([w.encode()])[0] >= 0}
        least = min((v for v in set(counts.values()) if sum(x >= v for x in counts.values()) <= size), default=10**9)
        assert held == {w for w, v in counts.items() if v >= least}


def test_length_histogram(spark, odd):
    counted = tokens.with_token_counts(odd, RANKS, ["source"])
    enc = tokens.encoding(RANKS)
    n = [(r.source, len(enc.encode_ordinary(r.text or ""))) for r in odd.collect()]
    hist = tokens.length_histogram(counted, "source")
    for r in hist.collect():
        own = [x for s, x in n if s == r.grp]
        assert (r.docs, r.docs_ge, r.docs_total) == (own.count(r.n_tokens), sum(x >= r.n_tokens for x in own), len(own))
        assert (r.tokens_ge, r.tokens_total) == (sum(x for x in own if x >= r.n_tokens), sum(own))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in own) and r.share_le == pytest.approx(sum(x <= r.n_tokens for x in own) / len(own))
    for r in tokens.limits(hist, [4, 100]).collect():
        own = [x for s, x in n if s == r.grp]
        assert (r.docs_over, r.tokens_kept, r.tokens_cut) == (sum(x > r.context for x in own), sum(min(x, r.context) for x in own), sum(max(0, x - r.context) for x in own))
    assert tokens.length_histogram(tokens.with_token_counts(empty(spark), RANKS, ["source"]), "source").count() == 0


def test_long_runs_are_counted():
    enc, rng = tokens.encoding(RANKS), random.Random(1)
    for _ in range(100):
        p = "".join(rng.choice("ab  \n\n\tée.!1") for _ in range(rng.randint(1, 400)))
        assert sum(tokens.merged(x.encode(), enc._mergeable_ranks) for x in tokens.PIECES.findall(p)) == len(enc.encode_ordinary(p))
    mixed = "  \n " * 1000 + " ab" + "c" * 3000 + " " * 2500
    assert tokens.count_tokens(mixed, enc) == len(enc.encode_ordinary(mixed))
    assert tokens.count_tokens("x <|endoftext|>" + " " * 5000, enc) == len(enc.encode_ordinary("x <|endoftext|>" + " " * 5000))


def test_rules(spark, odd):
    assert quality_rules.repeated_words("a b c d e f a b c d e".split()) == 10 and quality_rules.repeated_words("a a a a a a".split()) == 6 and quality_rules.repeated_words("a b c d e".split()) == 0
    got = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False)
    assert (got[9].n_words, got[9].n_dup_lines, got[9].word_chars) == (4, 2, 4) and got[7].n_repeat_words == 30_000
    assert quality_rules.judge(empty(spark)).count() == 0


def test_windows_of_many_different_words_never_mix():
    words = [str(i) for i in range(3_000_000)]
    assert quality_rules.repeated_words([*words, *words[5:12], "x", *words[100:104]]) == 14


def test_host_rates_shrink(spark):
    rows = [("big", i < 90) for i in range(100)] + [(f"h{j}", i < 2) for j in range(20) for i in range(40)] + [("tiny", True)]
    got = {r.host: r for r in quality_rules.host_rates(spark.createDataFrame(rows, "h string, bad boolean"), "h", "bad").collect()}
    mean = sum(r.failures for r in got.values()) / sum(r.docs for r in got.values())
    assert all(min(mean, r.rate) <= r.shrunk <= max(mean, r.rate) for r in got.values())
    assert got["big"].shrunk > 0.8 and got["tiny"].rate - got["tiny"].shrunk > 10 * (got["big"].rate - got["big"].shrunk) > 0


def test_language(spark, odd):
    de, en = "der die das und nicht ein zug fährt ", "the train that goes and it is not one "
    rows = [(i, (de if i % 2 else en) * 9, "de" if i % 2 else "en") for i in range(40)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and 0 < got[4][1] <= 1
    none = language.identify(odd, empty(spark)).collect()
    assert {r.lang_pred for r in none} == {"und"} and language.identify(empty(spark), odd).count() == 0


@pytest.mark.parametrize("block", [4, 32, 256])
def test_phrases_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = random.Random(2)
    samples = {k: ["".join(rng.choice(a) for _ in range(60)) for _ in range(3)] for k, a in (("x", "abc "), ("y", "bcd "), ("z", "ab"))}
    samples["z"].append("ab" * 40)
    known = language.Languages(samples)
    texts = ["".join(rng.choice("abcde ,") for _ in range(rng.randint(0, 700))) for _ in range(20)] + ["ab" * 200, samples["x"][0] * 3, "a" * 300 + "ab" * 150]
    total, _ = known.phrases(texts)
    for t, row in zip(texts, total, strict=True):
        codes = known.alphabet.read([t])[0].tolist()
        for k, name in enumerate(known.names):
            learnt = ["," + ",".join(map(str, known.alphabet.read([s])[0].tolist())) + "," for s in samples[name]]
            n = i = 0
            while i < len(codes):
                j = i + 1
                while j < len(codes) and any("," + ",".join(map(str, codes[i : j + 1])) + "," in s for s in learnt):
                    j += 1
                n, i = n + 1, j
            assert row[k] == n, (name, t)


def test_automata_of_many_letters_stay_small():
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(4000)]
    samples = {f"l{k}": ["".join(rng.choices(letters, [1 / (i + 1) for i in range(4000)], k=1200)) for _ in range(10)] for k in range(10)}
    known = language.Languages(samples)
    assert known.shift.nbytes + known.owner.nbytes + known.target.nbytes < 30_000_000
    total, _ = known.phrases([samples["l3"][2], samples["l7"][0][:500]])
    assert total.argmin(1).tolist() == [3, 7] and total.min(1).tolist() == [1, 1]


def test_only_long_texts_teach_by_the_shortest(spark):
    rows = [(i, "x" * (5000 + i), "only-long") for i in range(5)] + [(9, "y" * 30, "short"), (10, "z" * 9000, "short"), (11, None, "none"), (12, "", "none"), (13, "q", None)]
    got = language.training_text(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert got == {"only-long": ["x" * 5000], "short": ["y" * 30]}


def turns(key, tag, left, right, sizes):
    """The Feistel network over pairs, in Python."""
    for turn in range(pii.ROUNDS):
        h = int(hashlib.sha256(f"{key}|{tag}|{turn}|{right if turn % 2 == 0 else left}".encode()).hexdigest()[:12], 16)
        left, right = ((left + h) % sizes[0], right) if turn % 2 == 0 else (left, (right + h) % sizes[1])
    return left, right


def plain_pseudonym(key, kind, v):
    """What one value becomes, written apart from the operator."""
    if kind == "date":
        n = (datetime.date.fromisoformat(v) - datetime.date(1800, 1, 1)).days
        a, b = turns(key, "date", n // 773, n % 773, (189, 773))
        return (datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 773 + b)).isoformat()
    if kind == "ipv4":
        p = [*map(int, v.split("."))]
        a, b = turns(key, "ipv4", p[0] * 256 + p[1], p[2] * 256 + p[3], (65536, 65536))
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "social":
        areas = [x for x in range(1, 900) if x != 666]
        p = [*map(int, v.split("-"))]
        a, b = turns(key, "social", areas.index(p[0]), (p[1] - 1) * 9999 + p[2] - 1, (898, 99 * 9999))
        return f"{areas[a]:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    digits = [int(c) for c in v if c.isdigit()][:-1]
    half = len(digits) // 2
    for turn in range(pii.ROUNDS):
        side = digits[half:] if turn % 2 == 0 else digits[:half]
        h = hashlib.sha256(f"{key}|card|{turn}|{','.join(map(str, side))}".encode()).hexdigest()
        digits = [(d + int(h[4 * (i % 16) : 4 * (i % 16) + 4], 16)) % 10 if (i < half) == (turn % 2 == 0) else d for i, d in enumerate(digits)]
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    new = iter([*digits, -total % 10])
    return "".join(str(next(new)) if c.isdigit() else c for c in v)


def test_pseudonyms_equal_a_plain_program(spark):
    rng, rows = random.Random(12), []

    def value(kind):
        if kind == "date":
            return (datetime.date(1800, 1, 1) + datetime.timedelta(days=rng.randrange(189 * 773))).isoformat()
        if kind == "ipv4":
            return ".".join(str(rng.randrange(256)) for _ in range(4))
        if kind == "social":
            return f"{rng.choice([1, 77, 665, 667, 899]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"
        d = [rng.randrange(10) for _ in range(15)]
        d.append(-sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10)
        s = "".join(map(str, d))
        return rng.choice([s, " ".join(s[i : i + 4] for i in (0, 4, 8, 12))])

    filler = ["word", "(see", "x1", "3.14", "12,", "a@b", "99-1,", "end.", "mail@", "2020-13-45,", "1.2.3", "000-12-3456,"]
    for i in range(150):
        text, want, spans = "", "", []
        for _ in range(rng.randint(1, 6)):
            kind = rng.choice(["date", "ipv4", "social", "card"])
            v, before = value(kind), " ".join(rng.choice(filler) for _ in range(rng.randint(1, 4))) + " or "
            spans.append((kind, v, plain_pseudonym("k", kind, v)))
            text, want = text + before + v + ", ", want + before + spans[-1][2] + ", "
        rows.append((i, text, want, spans))
    got = pii.pseudonymise(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), "k", found="spans").collect()
    for r in got:
        assert [tuple(s) for s in r.spans] == rows[r.doc_id][3] and r.text == rows[r.doc_id][2]


def test_mail_addresses_end_with_letters(spark):
    cases = {
        "to x@a.com.": ["x@a.com"], "x@a.com1 y": [], "x@mail.com.1 y": ["x@mail.com"], "x@a..com": [], "x@10.0.0.1": ["10.0.0.1"], "a.b+c@d-e.co.uk!": ["a.b+c@d-e.co.uk"], "@a.com x@": [], "q@x.y.com-": [],
        "x@mail.com.4111111111111111": ["x@mail.com", "4111111111111111"], "x@" + "a." * 100_000 + "com": ["x@" + "a." * 100_000 + "com"], "x@" + "a1." * 100_000: [], "x" * 300_000 + "@": [], "a@" * 100_000: [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    for r in pii.pseudonymise(df, "k", found="spans").orderBy("doc_id").collect():
        assert [s.value for s in r.spans] == [*cases.values()][r.doc_id], r.doc_id


def test_feistel_is_a_permutation(spark):
    ids = spark.range(189 * 773).select(pii.feistel_pair("k", "t", F.floor(F.col("id") / 773), F.col("id") % 773, (189, 773)).alias("x"))
    assert ids.filter("x.l between 0 and 188 and x.r between 0 and 772").distinct().count() == 189 * 773
    codes = spark.range(10_000).select(pii.card("k", F.concat(F.lit("400000000"), F.lpad(F.col("id").cast("string"), 4, "0"))).alias("c"))
    assert codes.distinct().count() == 1000  # the last digit follows from the others


def test_mix(spark, docs, odd):
    plan = mixing.mix(docs).cache()
    rows = plan.collect()
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.src].append(r)
        assert r.copies <= 3 and len(r.shards) == r.copies
    assert sum(v[0].target for v in by.values()) == pytest.approx(total)
    for v in by.values():
        assert abs(sum(r["size"] * r.copies for r in v) - v[0].target) <= max(r["size"] for r in v) / 2 + 1 and v[0].target <= 3 * v[0].source_size
    again = mixing.mix(docs.repartition(3))
    assert sorted(map(tuple, again.select("doc_id", "copies").collect())) == sorted((r.doc_id, r.copies) for r in rows)
    assert mixing.draw(docs, plan).count() == sum(r.copies for r in rows) and mixing.draw(docs, plan).columns == docs.columns
    plan = mixing.mix(odd).cache()
    strange = plan.collect()
    assert len(strange) == odd.count() and all(r["size"] * r.copies <= 3 * r["size"] for r in strange) and mixing.mix(empty(spark)).count() == 0
    want = Counter({})
    for r in strange:
        want[r.doc_id, r.src] += r.copies
    clashing = odd.withColumns({c: F.lit("y") for c in ("row", "turn", "shards", "equals", "copies", "r", "copy")})
    got = mixing.draw(clashing, plan)
    assert got.columns == clashing.columns and Counter((r.doc_id, r.source) for r in got.collect()) == +want
    assert mixing.draw(empty(spark), mixing.mix(empty(spark))).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_mix_of_equal_rows_comes_near_its_target(spark, key):
    words = "a b c d e f g h i j"
    rows = [(key, words, "en", "x", 0)] * 100 + [(i, words + f" {i}" * 5, "en", "y", 0) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    plan = mixing.mix(df).cache()
    got = {r.src: (r.taken, r.target) for r in plan.groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()}
    assert all(abs(taken - target) <= 8 for taken, target in got.values()) and got["x"][1] == pytest.approx(4000 * 5 / 7) or got["x"][1] == 3000
    drawn = Counter(r.source for r in mixing.draw(df.repartition(3), plan).collect())
    assert drawn == Counter({r.src: r["n"] for r in plan.groupBy("src").agg(F.sum("copies").alias("n")).collect()})
    part = mixing.mix(spark.createDataFrame([(key, words, "en", "x", 0)] * 100 + [(i, words, "en", "y", 0) for i in range(20)] + [(i, words, "en", "z", 0) for i in range(60)], SCHEMA)).collect()
    for s in "xyz":
        own = [r for r in part if r.src == s]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= 5
    assert all(0 <= r.copies <= 3 for r in part) and sum({r.src: r.target for r in part}.values()) == pytest.approx(1800)


def brute_targets(sizes, weights, passes):
    """Water-filling by resharing the excess round by round."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-6 and open_:
        share = left / sum(weight[n] for n in open_)
        left = 0.0
        for n in sorted(open_, key=str):
            target[n] += share * weight[n]
            if target[n] >= passes * sizes[n] - 1e-9:
                left += target[n] - passes * sizes[n]
                target[n] = passes * sizes[n]
                open_.discard(n)
    return target


def test_targets_equal_resharing(spark):
    rng = random.Random(3)
    for _ in range(6):
        sizes = {n: rng.choice([0, 1, 5, 50, 1000, 20_000]) for n in [None, *"abcdefgh"[: rng.randint(1, 8)]]}
        df = spark.createDataFrame([(n, 1, v) for n, v in sizes.items()], "src string, docs long, source_size long")
        got = {r.src: r.target for r in mixing.water_fill(df).collect()}
        assert got == pytest.approx(brute_targets(sizes, (5, 2, 1), 3), abs=1e-3)


def test_splitting_tree_is_exact(spark):
    quotas = {"a": 1000, "b": 37, None: 5, "z": 0}
    got = mixing.splitting_tree(spark.createDataFrame([*quotas.items()], "src string, quota int"), 3).collect()
    shards = Counter()
    for r in got:
        shards[r.shard] += r.blocks
    assert {(r.src, r.first) for r in got} == {(s, sum(r.blocks for r in got if r.src == s and r.shard < k)) for s in quotas for k in range(8)}
    assert {s: sum(r.blocks for r in got if r.src == s) for s in quotas} == quotas and max(shards.values()) - min(shards.values()) <= 1


def test_splitting_tree_of_many_sources(spark, monkeypatch):
    """Three tiers of groups of sources; sums and draws stay right through them."""
    monkeypatch.setattr(mixing, "FAN", 4)
    quotas = {**{f"s{i:03d}": i % 4 for i in range(40)}, "s007": 900, None: 2}
    table = spark.createDataFrame([*quotas.items()], "src string, quota int")
    got = mixing.splitting_tree(table.repartition(3), 2).collect()
    shards = Counter()
    for r in got:
        shards[r.shard] += r.blocks
    assert len(got) == 4 * len(quotas) and all(r.blocks >= 0 for r in got)
    assert {s: sum(r.blocks for r in got if r.src == s) for s in quotas} == quotas and max(shards.values()) - min(shards.values()) <= 1
    assert {(r.src, r.first) for r in got} == {(s, sum(r.blocks for r in got if r.src == s and r.shard < k)) for s in quotas for k in range(4)}
    assert sorted(map(tuple, mixing.splitting_tree(table, 2).select("shard", "blocks").collect())) == sorted((r.shard, r.blocks) for r in got)
    # of 3,000 sources of one block, half go left, and of those in any hundred as many as chance allows
    monkeypatch.setattr(mixing, "FAN", 64)
    many = spark.range(3000).select(F.format_string("%04d", "id").alias("src"), F.lit(1).alias("quota"))
    left = {int(r.src) for r in mixing.splitting_tree(many, 1).filter("shard = 0 and blocks = 1").collect()}
    hundreds = [sum(x // 100 == h for x in left) for h in range(30)]
    assert len(left) == 1500 and all(25 <= x <= 75 for x in hundreds)
    assert 12 < sum((x - 50) ** 2 for x in hundreds) / 30 < 50  # the variance is 25 * 2900 / 2999


def test_sources_are_added_up_in_ranges(spark):
    """Running sums over 5,000 sources are those of a plain loop, null last; targets are those of resharing."""
    rng = random.Random(4)
    sizes = {**{f"h{rng.random():.12f}": rng.choice([0, 1, 7, 300]) for _ in range(5000)}, None: 40}
    df = spark.createDataFrame([(n, 1, v) for n, v in sizes.items()], "src string, docs long, source_size long").repartition(7)
    got = {r.src: (r.n, r.sum) for r in mixing.running(df, mixing.in_order(), n=F.lit(1), sum=F.col("source_size")).collect()}
    want, total = {}, 0
    for i, name in enumerate(sorted(sizes, key=lambda x: (x is None, x or ""))):
        want[name] = (i, total)
        total += sizes[name]
    assert got == want
    assert {r.src: r.target for r in mixing.water_fill(df).collect()} == pytest.approx(brute_targets(sizes, (5, 2, 1), 3), abs=1e-3)
    assert mixing.water_fill(df.limit(0)).count() == 0


def test_hypergeometric_probabilities(spark):
    from math import comb

    u = spark.range(4000).select(mixing.hypergeometric(F.lit(20), F.lit(8), F.lit(10), (F.col("id") + 0.5) / 4000).alias("x")).groupBy("x").count().collect()
    assert all(abs(r["count"] / 4000 - comb(8, r.x) * comb(12, 10 - r.x) / comb(20, 10)) < 1e-3 for r in u)
    edge = [(0, 0, 0, 0), (5, 5, 3, 3), (5, 0, 3, 0), (7, 3, 0, 0), (7, 3, 7, 3), (100_000, 40_000, 50_000, 20_000)]
    for total, marked, drawn, want in edge:
        got = spark.range(1).select(mixing.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), F.lit(0.5)).alias("x")).first().x
        assert abs(got - want) <= 1


def test_decoder_restores_words(docs):
    decoder = toxicity.Decoder(toxicity.character_model(toxicity.trigram_counts(docs)))
    cases = {"st@te": "state", "thhhere": "there", "thh3re": "there", "s t @ t e": "state", "plain,": "plain", "...": "", "(th3re)": "there"}
    assert {x: decoder.restore(x) for x in cases} == cases
    assert decoder.restore("d.1." * 20_000)


def readings_of(runs, edge):
    """All readings of the runs with their log probabilities."""
    out = [("", 0.0)]
    for i, (c, n) in enumerate(runs):
        out = [(a + b, p + q) for a, p in out for b, q in toxicity.options(c, n, edge(i))]
    return out


def test_viterbi_equals_all_readings(docs):
    decoder = toxicity.Decoder(toxicity.character_model(toxicity.trigram_counts(docs)))
    rng = random.Random(4)
    lexicon = toxicity.Lexicon({w: (3.0, -rng.random() * 9) for w in ("ai", "sea", "ease", "tea", "seat", "oil", "ss")})

    def likely(text):
        sym = [0, 0, *map(decoder.symbol, text), 0]
        n = toxicity.SYMBOLS
        return sum(decoder.model[(a * n + b) * n + c] for a, b, c in zip(sym, sym[1:], sym[2:], strict=False))

    for _ in range(300):
        token = "".join(rng.choice("aesti1$@.3 o") * rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(1, 5)))
        runs = toxicity.runs_of(token)
        inner = [i for i, (c, _) in enumerate(runs) if c.isalnum()] or [0]
        best = max(p + likely(x) for x, p in readings_of(runs, lambda i: not inner[0] <= i <= inner[-1]))
        assert decoder.best(runs)[0] == pytest.approx(best, abs=1e-4)
        want = {}
        for a in range(len(runs)):
            for b in range(a + 1, len(runs) + 1):
                if (a and runs[a - 1][0].isalnum()) or (b < len(runs) and runs[b][0].isalnum()) or runs[a][0] in toxicity.SET_APART:
                    continue
                for x, p in readings_of(runs[a:b], lambda i: False):
                    for node, end in enumerate(lexicon.end):
                        if node and end and end[0] == x:
                            want[x, a, b] = max(want.get((x, a, b), -1e9), p + end[1])
        got = lexicon.along(runs)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_learnt_words_are_restored(docs):
    decoder = toxicity.Decoder(toxicity.character_model(toxicity.trigram_counts(docs)))
    words = ["ass", "die", "dumb", "stupid", "fuck", "moron", "idiot", "cunt"]
    lexicon = toxicity.Lexicon({w: (3.0, -8.0) for w in words})
    restorer = toxicity.Restorer(np.array(decoder.model), lexicon)
    cases = {
        "an a s s here": "ass", "so d i e.": "die", "(d i e)": "die", "you are a d u m b": "dumb", "i d i e": "die", "s  t\tu\np i d": "stupid", "fu.ck": "fuck", "st.u-pid": "stupid", "st@te moron!": "moron",
        "a$$": "ass", "!diot": "idiot", "(unt,": "cunt", "stuupid": "stupid", "m0r0000n": "moron", "you.idiot": "idiot", "1d1ot?": "idiot", "FUUUCK": "fuck",
    }
    for text, word in cases.items():
        assert word in {w for t in toxicity.tokens_of(text) for w in restorer.words(t)}, text
    for text in ("class assist diet", "a b cat, 1 or x y", "plain, (words) and 3.14", "as 5", ""):
        assert not {w for t in toxicity.tokens_of(text) for w in restorer.words(t)}, text
    assert toxicity.set_apart("a b cat, 1 or x y") == set()
    assert restorer.evidence("a b " * 20_000 + "x" * 100_000 + " " + "d.u" * 50_000) == 0


def hidden(word, rng):
    """A spelling that hides a word: signs for letters, letters apart, or letters repeated."""
    signs = {"o": "0", "i": "1!|", "e": "3", "a": "4@", "s": "5$", "t": "7+"}
    how = rng.randrange(3)
    if how == 0:
        return "".join(rng.choice(signs[c]) if c in signs and rng.random() < 0.7 else c for c in word)
    if how == 1:
        return rng.choice(". -*").join(word)
    at = rng.randrange(len(word))
    return word[:at] + word[at] * rng.randint(3, 6) + word[at + 1 :]


def test_toxicity_goes_through_the_channel_and_survives_odd_rows(spark, odd, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["na", "te", "so", "ri", "mu", "le"]) for _ in range(rng.randint(1, 4)))
    bad, rows = ["idiot", "moron", "stupid", "asshole", "trash"], []
    for i in range(800):
        w = [word() for _ in range(30)]
        if i % 5 == 0:  # plain in the rows that teach, hidden in the others
            x = rng.choice(bad)
            while i >= 500 and (new := hidden(x, rng)) in {x, ""}:
                pass
            w[rng.randrange(30)] = x if i < 500 else new
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()

    def held():
        got = {r.doc_id: r.score for r in toxicity.score(df, df, F.col("doc_id") < 500).collect()}
        return np.mean([got[i] >= 0.3 for i, _, y in rows if i >= 500 and y]), np.mean([got[i] >= 0.3 for i, _, y in rows if i >= 500 and not y])

    caught, wrong = held()
    assert caught >= 0.95 and wrong <= 0.01
    strange = {r.doc_id: r.score for r in toxicity.score(odd.withColumn("toxic", F.lit("x")), df.withColumn("k", F.lit(1)), F.lit(True)).collect()}
    assert strange[1] == strange[2] == strange[None]
    teaching = odd.select("doc_id", "text").union(df.select(F.col("doc_id") + 100, "text"))
    strange = {r.doc_id: r.score for r in toxicity.score(teaching, df.withColumn("doc_id", F.col("doc_id") + 100)).collect()}
    assert strange[1] == strange[2] < 0.3 < strange[4]
    assert len({r.score for r in toxicity.score(odd, df.limit(0)).collect()}) == 1 and toxicity.score(empty(spark), df).count() == 0


def test_without_decoding_hidden_words_are_missed(docs):
    rng = random.Random(7)
    words = {"idiot": (3.0, -8.0), "moron": (3.0, -8.0), "stupid": (3.0, -8.0), "asshole": (3.0, -9.0), "trash": (3.0, -9.0)}
    model = toxicity.character_model(toxicity.trigram_counts(docs))
    texts = [f"well {hidden(rng.choice([*words]), rng)} said" for _ in range(400)]
    with_it = toxicity.Restorer(model, toxicity.Lexicon(words))
    assert np.mean([with_it.evidence(t) > 0 for t in texts]) >= 0.9
    plain = toxicity.Restorer(model, toxicity.Lexicon(words))
    plain.lexicon.along = lambda runs: {}
    assert np.mean([plain.evidence(t) > 0 for t in texts]) <= 0.2


@pytest.mark.parametrize("alarms", [0.02, 0.01])
def test_estimates_come_near_the_labellers_true_accuracies(alarms):
    rng = np.random.default_rng(4)
    m, n = len(weak_quality.LABELLERS), 200_000
    kind = np.where(rng.random(n) < 0.8, 0, rng.integers(1, m + 1, n))
    p_low = np.full((m + 1, m), alarms)
    for j, p in ((0, 0.9), (1, 0.7), (2, 0.6)):  # each defect is seen by several labellers
        p_low[np.arange(1, m + 1), (np.arange(m) + j) % m] = p
    low = rng.random((n, m)) < p_low[kind]
    votes = np.where(low, 0, np.where(rng.random((n, m)) < 0.7, 1, 2))
    patterns, count = np.unique((votes * 3 ** np.arange(m)).sum(1), return_counts=True)
    shares, table = weak_quality.estimate(patterns, count.astype(float))
    assert abs(shares[0] - 0.8) < 0.05 and np.abs(table[0, :, 0] - alarms).max() < 0.015
    v = weak_quality.digits(patterns)
    bayes = lambda share, t: share * np.prod(t[:, np.arange(m), v], -1).T
    truth = bayes(np.array([0.8, *[0.2 / m] * m]), np.stack([p_low, (1 - p_low) * 0.7, (1 - p_low) * 0.3], -1))
    truth = truth[:, 0] / truth.sum(1)
    got = weak_quality.posterior(patterns, shares, table)
    clear = np.abs(truth - 0.5) > 0.25  # a lone low vote may be either
    assert np.average(np.abs(got - truth), weights=count) < 0.05 and np.average(((got > 0.5) == (truth > 0.5))[clear], weights=count[clear]) > 0.99
    plain = bayes(shares, table) * weak_quality.belief(patterns) ** weak_quality.PRIOR
    assert got == pytest.approx(plain[:, 0] / plain.sum(1))


def test_weak_labels_odd_rows(spark, odd):
    rows = spark.createDataFrame([(i, f"This is a plain sentence number {i}. " * 8, "", "", 0) for i in range(40)], SCHEMA)
    both = rows.unionByName(odd.select(*rows.columns)).withColumns({c: F.lit("x") for c in ("draw", "f", "x", "p", "pattern")})
    got = [(r.doc_id, r.score) for r in weak_quality.score(both).collect()]
    assert Counter(i for i, _ in got) == Counter(r.doc_id for r in both.collect())
    assert len({s for i, s in got if i in (101, 102, 103)}) <= 1 and all(0 <= s <= 1 for _, s in got)
    empties = weak_quality.score(odd.filter("doc_id in (1, 2, 3)")).collect()
    assert len({r.score for r in empties}) == 1


def test_weak_labels(spark, odd):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["na", "te", "so", "ri", "mu", "le"]) for _ in range(rng.randint(1, 5)))
    rows = []
    for i in range(300):
        w = [word() for _ in range(60)]
        t = " ".join(x + "%%%" for x in w) if i % 4 == 0 else ". ".join(" ".join(w[j : j + 10]) for j in range(0, 60, 10)) + "."
        rows.append((i, t, i % 4 == 0))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.score for r in weak_quality.score(df).collect()}
    assert all((got[i] < 0.5) == bad for i, _, bad in rows)
    assert weak_quality.score(odd).count() == odd.count() and weak_quality.score(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [8192, 3])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "TILE", 64)
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(400, 10)), 1)
    v[200:] = v[:200]  # ties
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1050, [float("nan")] * 10), (1100, [None, *[1.0] * 9]), (None, [1.0] * 10)]
    got = defaultdict(list)
    for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.floor(256 * v)
    for q in range(0, 400, 50):
        want = sorted(((int(-(x[q] @ x[j])), j) for j in range(400) if j != q))[:5]
        assert got[q] == [(j, -s) for s, j in want]
    assert sorted(got) == list(range(0, 400, 50))
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.fixture(scope="module")
def very_long(spark):
    """Long runs of one kind of sign, each of which some engine walks by recursion or in square time."""
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" * 1_000_000, "x@" + "a." * 200_000 + "com", "4111 " * 100_000, "1.2-" * 100_000, "a'" * 200_000, "$h1t" * 100_000, "d.i e " * 50_000, "l\n" * 200_000, "+1 555 " * 50_000]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(4).cache()


LABELS = [(0, 0), (1, 1), (5, 0), (7, 1)]
EVERY = {
    "tokens": lambda d, s: tokens.length_histogram(tokens.with_token_counts(d, RANKS, ["source"]), "source"),
    "rules": lambda d, s: quality_rules.judge(d),
    "language": lambda d, s: language.identify(d, d.limit(3)),
    "bpe": lambda d, s: bpe.encode_decode(d, JSON).select("doc_id", "n_tokens"),
    "jaccard": lambda d, s: jaccard.jaccard_components(d, 3, 90, 100),
    "mixing": lambda d, s: mixing.draw(d, mixing.mix(d)),
    "pii": lambda d, s: pii.pseudonymise(d, "k"),
    "toxicity": lambda d, s: toxicity.score(d, s.createDataFrame(LABELS, "doc_id long, toxic int")),
    "weak": lambda d, s: weak_quality.score(d),
}


@pytest.mark.parametrize("name", sorted(EVERY))
def test_very_long_texts(spark, very_long, name):
    out = EVERY[name](very_long, spark)
    out.write.format("noop").mode("overwrite").save()


def test_top_k_of_repeated_ids(spark):
    rows = [(50, [1.0, 0.0], "a"), (50, [0.5, 0.5], "b"), (50, [1.0, 0.0], "a"), (1, [2.0], "c"), (2, [], "d"), (None, [9.0, 9.0], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.exact_top_k(df, F.col("vec_id") % 50 == 0, k=2).collect())
    u = 256 * 256
    assert got == sorted([(50, 1, 1, 2 * u), (50, 2, 50, u)] * 2 + [(50, 1, 1, u), (50, 2, 50, u // 2)])


@pytest.mark.parametrize("kind", ["even", "clusters", "few axes"])
def test_most_pairs_are_pruned(kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 64))
    if kind == "clusters":
        x = x[rng.integers(0, 60, 6000)] + 0.3 * x
    if kind == "few axes":
        x = x @ (np.linalg.qr(rng.normal(size=(64, 64)))[0] * 0.8 ** np.arange(64)[:, None])
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    row, ids = np.arange(6000), np.arange(6000)
    asked = row[row % 50 == 0]
    q_row, vec, score, products = topk.best(asked, x[asked], row, ids, x, 5)
    assert products <= {"even": 0.3, "clusters": 0.15, "few axes": 0.05}[kind] * len(asked) * len(x)
    for q in asked[:20]:
        all_scores = sorted((-int(x[q] @ x[j]), int(j)) for j in range(6000) if j != q)[:5]
        assert [(-s, v) for s, v in zip(score[q_row == q].tolist(), vec[q_row == q].tolist(), strict=True)] == all_scores


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(map(str, want[cols].values.tolist())) == sorted(map(str, registry.QUERIES[name](spark, DATA).toPandas()[cols].values.tolist()))


@needs_data
def test_op4_digests(spark, docs):
    library = Tokenizer.from_file(JSON)
    want = set()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in registry.QUERIES["op4_transducer_bpe"](spark, DATA).collect()} == want


@needs_data
def test_pipeline_stages(spark, docs, tmp_path):
    got, before = docs, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, got, DATA)
        out.write.parquet(str(tmp_path / name))
        before, got = got, spark.read.parquet(str(tmp_path / name))
        if name != "encoding":
            assert got.columns == docs.columns
        if name == "near_duplicates":
            comp = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
            assert {r.doc_id for r in got.collect()} == {c for _, c in comp.values()}
        if name == "pii":
            assert got.count() == before.count()
    library = Tokenizer.from_file(JSON)
    assert Counter(tuple(r.ids) for r in got.collect()) == Counter(tuple(library.encode(r.text or "", add_special_tokens=False).ids) for r in before.collect())


@needs_data
@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, odd, stage):
    """Nulls in every column, repeats, clashing names, long texts, and no rows at all."""
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = odd.withColumns({c: F.lit("x") for c in ("row", "bad", "mark", "shard", "turn", "copy", "spans", "gone", "_gone", "_rejected", "_k", "id", "y")})
    rows = Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    out = run(spark, docs, DATA)
    assert run(spark, docs.limit(0), DATA).count() == 0
    if stage == "encoding":
        assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == sum(rows.values())
        return
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    if stage == "toxicity":
        assert all(got[k] in (0, v) for k, v in rows.items()) and not got - rows and got[2, "", "a"] == got[1, None, None] == 1
    if stage == "near_duplicates":  # documents 5 and 6 are copies, as are both rows of 4 and nearly 7 and 8
        assert Counter(k[0] for k in got.elements()) == Counter([1, 2, 3, 4, 5, None, 7, 9, 10])
    if stage == "pii":
        assert got == rows
    if stage == "mixing":
        assert set(got) <= set(rows) and all(n <= 3 * rows[k] for k, n in got.items())


@needs_data
def test_toxic_rows_go_one_by_one(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    toxic = docs.join(labels.filter("toxic = 1"), "doc_id").select(*docs.columns)
    scores = toxicity.score(docs, labels).join(toxic.select("doc_id"), "doc_id").orderBy(F.desc("score"))
    worst = docs.filter(F.col("doc_id") == scores.first().doc_id)
    clean = docs.filter("doc_id = 1").withColumn("text", F.lit("A calm and friendly sentence about the weather."))
    same = worst.withColumn("doc_id", F.lit(1).cast("long")).unionByName(clean).unionByName(worst.withColumn("doc_id", F.lit(None).cast("long")))
    got = corpus_pipeline.toxicity_stage(spark, docs.filter("doc_id <> 1").unionByName(same), DATA)
    assert [r.text for r in got.filter("doc_id = 1").collect()] == ["A calm and friendly sentence about the weather."]
    assert got.filter("doc_id is null").count() == 0


@pytest.mark.parametrize("keys", [(1, None, 2), (2, None, 1), (None, 1, 2), (1, 2, None), (None, None, 1), (None, None, None)])
def test_rows_without_a_key_lose_no_link(spark, keys):
    """Texts A and B are linked by a text N only; all orders of keys, N's or another's null."""
    words = [f"w{i}" for i in range(200)]
    swapped = lambda at: [f"x{i}" if i in at else w for i, w in enumerate(words)]
    texts = [" ".join(w) for w in (words, swapped({100, 20}), swapped({100, 20, 50, 150}))]
    sets = [jaccard.shingles(t, 3, jaccard.WordHashes()) for t in texts]
    near = lambda a, b: len(np.intersect1d(a, b)) * 100 >= 90 * len(np.union1d(a, b))
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    rows = [(k, t) for k, t in zip(keys, texts, strict=True) for _ in range(2)] + [(9, "all others are apart from it")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90, den=100).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(k, k and min(x for x in keys if x)) for k in keys for _ in range(2)] + [(9, 9)], key=str)


@pytest.mark.parametrize(("sign", "n"), [(" ", 6000), ("-", 500)])
def test_many_cards_in_one_run_take_linear_time(spark, sign, n):
    import time

    card = sign.join(("4111", "1111", "1111", "1111"))
    df = spark.createDataFrame([(1, sign.join([card] * n)), (2, "12 " * 4 * n + card), (3, f"x {card}, " * 1000)], "doc_id long, text string")
    pii.pseudonymise(df.limit(0), "k", found="f").collect()
    start = time.time()
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k", found="f").collect()}
    assert time.time() - start < 240
    other = {x.pseudonym for r in out.values() for x in r.f}
    assert [len(out[i].f) for i in (1, 2, 3)] == [n, 1, 1000] and len(other) == 1
    assert out[1].text == sign.join([*other] * n) and out[2].text == "12 " * 4 * n + [*other][0]


def test_words_are_numbered_at_their_first_lookup_and_equal_merges(monkeypatch):
    # known words are looked up once; ids of new ones are put together as arrays, also after words were forgotten
    monkeypatch.setattr(bpe, "KEPT_WORDS", 30)
    vocab = bpe.vocabulary(registry.vocabulary_path("byte_bpe_50k.json"))
    encoder = bpe.Encoder(vocab, bpe.Lexicon.build({p.encode(): vocab.ids(p) for p in (" the", " river", ",")}))
    special = next(iter(vocab.special))
    texts = ["the river, the  river", "", f"a{special}b {special}", "x" * 90 + " " + "y" * 30, *[f"word{i}s and,ü{i} größe 12{i}." for i in range(60)], " the river,"]
    for part in (texts[:3], texts[3:30], texts[30:], texts):
        n, ids = encoder.encode(part)
        want = [[t for w in bpe.words(text, vocab) for p in vocab.pieces(w) for t in vocab.ids(p)] for text in part]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [t for x in want for t in x]
        assert not encoder.known.new and not encoder.known_pieces.new and len(encoder.length) == len(encoder.known)
    n, ids = vocab.merge_all([b" straightforwardness", b"", b"q" * 70, b" the"])
    assert np.split(ids, np.cumsum(n)[:-1])[3].tolist() == vocab.merge(b" the") and n[1] == 0 and ids.tolist() == [t for p in (b" straightforwardness", b"q" * 70, b" the") for t in vocab.merge(p)]
