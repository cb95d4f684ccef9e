"""Operators on hand-made frames: nulls, ties, empty groups, unassigned rows, and mutants."""

import hashlib
import re
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from agreeline.functions import textscore
from agreeline.operators import catalog, decompose, frame, labels, measures, predict, readers, relations, resample, robust
from agreeline.plans import bindings, resampling
from agreeline.sources import shared, tables
from agreeline.streaming import windows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_period_and_group_are_no_complements(spark):
    df = spark.createDataFrame([("19970101", "a film"), ("19990101", ""), ("1998", None), ("x9990101", "b"), (None, "film")], "day string, title string")
    out = df.select(labels.period(F.col("day"), 1997, 1999), labels.keyword_group(F.col("title"), ["film"]))
    assert [tuple(r) for r in out.collect()] == [("pre", "marked"), ("post", "unassigned"), ("unassigned", "unassigned"), ("unassigned", "other"), ("unassigned", "marked")]


def test_six_counts(spark):
    df = spark.createDataFrame([("p", "x", 1.0, True), ("p", "", 1.0, True), ("p", None, 0.0, False), ("p", "y", 2.0, False), ("q", None, None, True)], "g string, r string, d double, m boolean")
    out = {r.g: r for r in measures.six_counts(df, ["g"], "r", "d", F.col("m")).collect()}
    assert (out["p"].n_total, out["p"].n_judgeable, out["p"].n_match, out["p"].n_empty_realized, out["p"].n_dur_le_0, out["p"].n_empty_and_zerodur) == (4, 2, 1, 2, 1, 1)
    assert out["p"].agreement == 0.5 and out["q"].agreement is None and out["q"].agreement_status == "missing"


def test_checked_join_reports_repeats_and_gaps(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(1, "x"), (1, "y")], "b int, v string")
    stats = frame.checked_join(left, right, [("a", "b")])[1]
    assert tuple(stats.first()) == (2, 1, 3)
    with pytest.raises(ValueError):
        frame.require(stats, {"matched": 4})
    with pytest.raises(ValueError):
        frame.require(stats, {"no_such_count": 1})


def test_violations(spark):
    p = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", " "), ("z", "q")], "id string, hyp string")
    u = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(tables.violations(p, u)) == [("blank", "b"), ("repeated", "a"), ("unknown", "z")]


def test_kitagawa_adds_up_and_weighs_by_the_pre_period(spark):
    s = spark.createDataFrame([("film", "pre", 10, 8), ("film", "post", 10, 7), ("other", "pre", 30, 24), ("other", "post", 20, 16)], "g string, p string, n long, k long")
    r = decompose.kitagawa(s, [], "g", "p", "n", "k").first()
    assert r.unadjusted == pytest.approx(100 * (32 / 40 - 23 / 30), abs=1e-5)
    assert r.residual == pytest.approx(100 * (0.8 - (0.25 * 0.7 + 0.75 * 0.8)), abs=1e-5)
    assert r.explained + r.residual == pytest.approx(r.unadjusted, abs=1e-5)
    lacking = decompose.kitagawa(s.filter("not (g = 'film' and p = 'post')"), [], "g", "p", "n", "k").first()
    assert lacking.unadjusted is None


def test_total_order_and_quantiles(spark):
    df = spark.createDataFrame([(i % 3, float((i * 7) % 50)) for i in range(200)], "g int, v double").withColumn("id", F.monotonically_increasing_id())
    got = robust.total_order(df, ["v", "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 201)) and [r.v for r in got] == sorted(r.v for r in got)
    per = robust.total_order(df, ["v", "id"], "rank", ["g"]).groupBy("g").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("d")).collect()
    assert all(r.m == r.d for r in per)
    small = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 5.0), ("b", None)], "g string, v double")
    assert rows(robust.quantiles_np1(small, "g", "v", {"q1": 0.25, "q2": 0.5})) == [("a", 3, 1.0, 2.0), ("b", 1, 5.0, 5.0)]


def test_ranked_median_even_and_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2), ("a", 3.0, 3), ("a", 9.0, 4), ("b", None, 1)], "g string, v double, k int")
    assert rows(robust.ranked_median(df, "g", "v")) == [("a", 3.0, 4)]


def test_seed_and_draws():
    assert resample.seed_of(20250918, "film_pre") == 1446693614
    with pytest.raises(ValueError):
        resample.check_draws(200)


def test_bootstrap_draws_whole_clusters(spark):
    cells = spark.createDataFrame([("s", i, 1, i) for i in range(10)] + [("t", 99, 5, 7)], "s string, c int, n int, k int")
    got = resample.bootstrap_sums(cells, "s", "c", ["n", "k"], 20, 1, least=20).collect()
    assert len(got) == 40 and all(r.n == 10 for r in got if r.s == "s") and all((r.n, r.k) == (5, 7) for r in got if r.s == "t")
    assert len({r.k for r in got if r.s == "s"}) > 5


def brute_draws(cells, draws, seed):
    """Rounds of clusters drawn by hash, a draw at a time."""
    out = []
    for s in {c[0] for c in cells}:
        own = sorted(c[1:] for c in cells if c[0] == s)
        for b in range(draws):
            drawn = []
            for k in range(len(own)):
                h = hashlib.md5(f"{resample.seed_of(seed, s)}:{b}:{k // 4}".encode()).hexdigest()
                drawn.append(own[int(h[8 * (k % 4) : 8 * (k % 4) + 8], 16) % len(own)])
            out.append((b, s, sum(d[1] or 0 for d in drawn), sum(d[2] or 0 for d in drawn), len(own)))
    return sorted(out)


@pytest.mark.parametrize(("held", "turns"), [(1_000_000, 65_536), (7, 2), (1, 1)])
def test_bootstrap_sums_equal_brute_force(spark, monkeypatch, held, turns):
    monkeypatch.setattr(resample, "HELD", held)
    monkeypatch.setattr(resample, "TURNS", turns)
    cells = [("s", i, i * i % 7 if i != 3 else None, i / 2) for i in range(23)] + [("t", i, 2**40 + i, -1.0) for i in range(4)] + [("one", 5, 9, 0.5)]
    df = spark.createDataFrame(cells, "s string, c int, n long, x double")
    got = resample.bootstrap_sums(df, "s", "c", ["n", "x"], 40, 11, "g", least=40)
    assert sorted((r.b, r.s, int(r.n), r.x, r.g) for r in got.collect()) == brute_draws(cells, 40, 11)
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("held", [16_000_000, 2500])
def test_bootstrap_sums_of_many_clusters_equal_brute_force(spark, monkeypatch, held):
    # clusters are packed, hashed together, and sent to a task once, however many rounds there are
    monkeypatch.setattr(resample, "HELD", held)
    monkeypatch.setattr(resample, "PACKED", 1000)
    cells = [("s", i, i * i % 300 - 40, i) for i in range(5003)] + [(None, i, 2**40 + i, -1) for i in range(1200)]
    got = resample.bootstrap_sums(spark.createDataFrame(cells, "s string, c int, n long, x long"), "s", "c", ["n", "x"], 20, 11, "g", least=20)
    own = resample._packed(resample.indexed(spark.createDataFrame(cells, "s string, c int, n long, x long"), "s", "c", 11), "s", ["n", "x"])
    assert own.count() == (8 if held > 5003 else 9)
    want = {}
    for s in ("s", None):
        mine, seed = [c for c in cells if c[0] == s], int(hashlib.sha256(("11:s" if s else "11").encode()).hexdigest()[:8], 16)
        for b in range(20):
            digits = "".join(hashlib.md5(f"{seed}:{b}:{k}".encode()).hexdigest() for k in range(-(-len(mine) // 4)))
            drawn = [mine[int(digits[8 * k : 8 * k + 8], 16) % len(mine)] for k in range(len(mine))]
            want[b, s] = (sum(d[2] for d in drawn), sum(d[3] for d in drawn), len(mine))
    assert {(r.b, r.s): (r.n, r.x, r.g) for r in got.collect()} == want


def test_bootstrap_plans_have_no_row_for_each_cluster_and_round(spark):
    cells = spark.range(2000).select(F.lit("s").alias("s"), F.col("id").alias("c"), F.lit(1).cast("long").alias("n"))
    for scheme in resample.SCHEMES:
        spark.sparkContext.setJobGroup(scheme, scheme)
        out = resample.resampled_sums(cells, "s", "c", ["n"], 1000, 1, scheme).persist()
        assert out.count() == 1000
        assert 1900 < out.agg(F.avg("n")).first()[0] < 2100
        out.unpersist()
        assert "explode(sequence(0, 999" not in out._jdf.queryExecution().toString()


def test_weights_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resample, "HELD_STRATA", 2)
    cells = [(s, f"{s}{i}" if i else None, i, 2 * i) for s in ("a", "b", None, "d", "e") for i in range(5)]
    got = resample.poisson_sums(spark.createDataFrame(cells, "s string, c string, n int, k int"), "s", "c", ["n", "k"], 30, 4, "g", least=30).collect()
    want = {}
    for s, c, n, k in cells:
        seed = int(hashlib.sha256(":".join(["4", *([s] if s else [])]).encode()).hexdigest()[:8], 16)
        for b in range(30):
            u = int(hashlib.md5(":".join([str(seed), str(b), *([c] if c else [])]).encode()).hexdigest()[:13], 16) / 2**52
            w, row = sum(u >= p for p in resample.POISSON), want.setdefault((b, s), [0, 0, 0])
            want[b, s] = [row[0] + w * n, row[1] + w * k, row[2] + 1]
    assert {(r.b, r.s): [r.n, r.k, r.g] for r in got} == want


def test_bootstraps_refuse_few_draws_and_take_the_scheme_that_is_named(spark):
    cells = spark.createDataFrame([("s", i, 1, i) for i in range(10)], "s string, c int, n int, k int")
    for f in (resample.bootstrap_sums, resample.poisson_sums, lambda *x: resample.resampled_sums(*x, "drawn"), lambda *x: resample.resampled_sums(*x, "poisson")):
        with pytest.raises(ValueError, match="draws"):
            f(cells, "s", "c", ["n"], 999, 1)
    with pytest.raises(KeyError):
        resample.resampled_sums(cells, "s", "c", ["n"], 1000, 1, "both")
    many = resample.resampled_sums(cells, "s", "c", ["n"], 1000, 1, "poisson").collect()
    assert len({r.n for r in many}) > 3 and 9.5 < sum(r.n for r in many) / 1000 < 10.5
    assert [r[0] for r in spark.createDataFrame([("film_pre",)], "h string").select(resample.stratum_seed(20250918, F.col("h"))).collect()] == [1446693614]


def test_tail_is_opposite_to_the_observed_value(spark):
    # 3 replicates of 1, 7 of -1: on the other side of an observed 0.5 lie 7, of an observed -0.5 lie 3
    v = spark.createDataFrame([(g, x, o) for g, o in (("a", 0.5), ("b", -0.5), ("c", 0.0)) for x in [1.0] * 3 + [-1.0] * 7], "g string, v double, o double")
    assert {r.g: r.p_opposite for r in resample.interval(v, ["g"], "v", "o").collect()} == {"a": 1.0, "b": 0.6, "c": 1.0}


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_small_strata_are_inconclusive(spark, monkeypatch):
    data, load = "/root/testdata/sf0.001", tables.load
    few = spark.read.parquet(f"{data}/customer.parquet").orderBy("c_custkey").limit(9)
    monkeypatch.setattr(bindings, "load", lambda s, d, t, *a: few if t == "customer" else load(s, d, t, *a))
    assert resampling.i04_i08_gap_interval(spark, data).first().verdict == "inconclusive"
    assert {r.verdict for r in resampling.i12_reader_gap_bootstrap(spark, data).collect()} == {"inconclusive"}
    ten = spark.read.parquet(f"{data}/customer.parquet").orderBy("c_custkey").limit(10)
    monkeypatch.setattr(bindings, "load", lambda s, d, t, *a: ten if t == "customer" else load(s, d, t, *a))
    assert resampling.i04_i08_gap_interval(spark, data).first().verdict != "inconclusive"


def test_benjamini_hochberg(spark):
    p = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)]
    got = dict((r.name, r.p_bh) for r in resample.benjamini_hochberg(spark.createDataFrame(p, "name string, p double"), "name", "p", 4).collect())
    assert got == {"a": 0.04, "b": 0.053333, "c": 0.053333, "d": 0.5}
    with pytest.raises(ValueError, match="declared"):
        resample.benjamini_hochberg(spark.createDataFrame(p, "name string, p double"), "name", "p", 3)


def test_readers(spark):
    df = spark.createDataFrame([("x", "x", "y", "x", "y"), ("x", "x", "x", "x", "x"), ("y", None, "x", "x", "x")], "a string, b string, c string, t string, base string")
    assert [r[0] for r in df.select(readers.differs(["a", "b", "c"])).collect()] == [True, False, None]
    out = {r.reader: (r.n_match, r.gap_pm) for r in readers.agreement_gaps(df, ["a", "c"], "base", "t").collect()}
    assert out == {"a": (2, 0.0), "c": (2, 0.0)}


def test_doubling_moves_a_rarity_cutoff_unless_types_are_prefixed(spark):
    units = spark.createDataFrame([(i, "a") for i in range(5)] + [(9, "b")], "id int, type string")
    share = lambda u: u.groupBy("type").count().filter("count < 8").agg(F.sum("count")).first()[0]
    assert share(relations.double(units, ["id", "type"])) == 2 * share(units)
    assert share(relations.double(units, ["id"])) != 2 * share(units)


def test_relations_catch_a_constant_denominator(spark):
    base = spark.createDataFrame([("n_x", 3.0), ("agree", 0.5), ("odd", 1.0)], "name string, value double")
    other = spark.createDataFrame([("n_x", 3.0), ("agree", 0.5), ("odd", 1.0)], "name string, value double")
    assert {r.name: r.ok for r in relations.compare(base, other, "double").collect()} == {"n_x": False, "agree": True, "odd": False}
    assert not relations.report(relations.compare(base.limit(0), other.limit(0), "double"), "double").first().passed


def test_closure_of_exempt_metrics_ends(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "e"), ("e", "d"), ("a", "c"), ("f", "f"), ("b", "a"), (None, "a"), ("g", None)] + [(f"x{i}", f"x{i - 1}" if i else "a") for i in range(12)]
    needs = spark.createDataFrame(edges, "metric string, needs string")
    closed = lambda start: sorted(r.metric for r in relations.exempt_closure(spark.createDataFrame([(s,) for s in start], "metric string"), needs).collect())
    assert closed(["a", "a", None]) == sorted(["a", "b", "c", *(f"x{i}" for i in range(12))])
    assert closed(["d"]) == ["d", "e"] and closed(["g"]) == ["g"] and closed([]) == []


def test_catalog(spark):
    wide = spark.createDataFrame([(4, 0)], "x int, y int")
    out = catalog.derive(wide, {"r": ({"s"}, lambda: F.col("s") + 1), "s": (set(), lambda: F.try_divide("x", "y"))}).first()
    assert out.s is None and out.r is None
    with pytest.raises(ValueError):
        catalog.derive(wide, {"p": ({"q"}, lambda: F.lit(1)), "q": ({"p"}, lambda: F.lit(1))})
    share = {"share": ({"total"}, lambda: catalog.quotient("share", F.col("x"), "total")), "total": (set(), lambda: F.col("y") * 2)}
    with pytest.raises(Exception, match="metric share divides by total, which is 0"):
        catalog.derive(wide, share).collect()
    assert catalog.derive(wide.withColumn("y", F.lit(1)), share).first().share == 2 and catalog.derive(wide.withColumn("y", F.lit(None)), share).first().share is None
    one = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 2)], "name string, value double, n long")
    two = spark.createDataFrame([("a", 1.0, 3), ("c", 1.0, 2)], "name string, value double, n long")
    assert {r.name: r.ok for r in catalog.routes_agree(one, two).collect()} == {"a": False, "b": False, "c": False}


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def test_text_scores(spark):
    import random

    rng = random.Random(4)
    pairs = [([rng.choice("abc") for _ in range(rng.randint(0, 9))], [rng.choice("abc") for _ in range(rng.randint(0, 9))]) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(textscore.token_edits(F.col("a"), F.col("b"))).collect()] == [edit(a, b) for a, b in pairs]
    one = spark.createDataFrame([("天氣好好", "天氣好"), ("", "x")], "r string, h string")
    assert tuple(textscore.character_error(one.limit(1), "r", "h").first()) == (1, 1, 4, 250.0)
    assert textscore.character_error(one.filter("r = ''"), "r", "h").first().cer_pm is None


FOLDS = {"們": "们", "薴": "苧", "苧": "苎"}


def plain_tokens(text, metric):
    """The rule of tokens, one character at a time."""
    kept = lambda c: unicodedata.category(c)[0] in "LMN"
    part = lambda c: c == "'" or (c.isascii() and c.isdigit()) or (c.isalpha() and unicodedata.name(c, "").startswith("LATIN"))
    norm = []
    for c in unicodedata.normalize("NFKC", text).lower():
        c = "'" if c in "\u2018\u2019\u02bc" else c
        for _ in range(4):
            c = FOLDS.get(c, c)
        norm.append(c)
    if metric == "cer":
        return [c for c in norm if kept(c)]
    out, word = [], ""
    for c in [*norm, " "]:
        if part(c):
            word += c
            continue
        if word.strip("'"):
            out.append(word.strip("'"))
        word = ""
        if kept(c):
            out.append(c)
    return out


def test_tokens_follow_the_rule(spark):
    import random

    rng = random.Random(8)
    alphabet = "aZé'’‘09 中們薴ひ한гд٣ไทยअ́\u0301ﬁＡ①½.,-ßİ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += ["Don't 天氣 abc 12", "don\u2019t café", "我哋去 Shopping 啦，don't worry", "rock''n''roll 'tis' '", "去ＳＨＯＰ，ping！", "Привет мир", "薴", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("n", textscore.normal_form(F.col("t"), FOLDS))
    for r in df.select("i", textscore.tokens(F.col("n")).alias("m"), textscore.characters(F.col("n")).alias("c")).collect():
        assert r.m == plain_tokens(texts[r.i], "mer"), texts[r.i]
        assert list(r.c) == plain_tokens(texts[r.i], "cer"), texts[r.i]
    long = spark.createDataFrame([("a'" * 300_000,), ("a" * 1_000_000,), ("'" * 1_000_000,)], "t string")
    assert [r[0] for r in long.select(F.size(textscore.tokens(textscore.normal_form(F.col("t"))))).collect()] == [1, 1, 0]


def test_scores_need_equal_ids_and_full_references(spark):
    refs = spark.createDataFrame([("a", "我們去 Shop!"), ("b", "x")], "id string, ref string")
    hyps = [("a", "我们去 shop"), ("b", "y z")]
    make = lambda rows: spark.createDataFrame(rows, "id string, hyp string")
    assert tuple(textscore.scored(refs, make(hyps), "mer", FOLDS).first()) == (2, 2, 5, 400.0)
    assert tuple(textscore.scored(refs, make(hyps), "cer", FOLDS).first())[1:3] == (2, 8)
    for bad in (hyps[:1], [*hyps, ("c", "q")], [*hyps, ("b", "q")]):
        with pytest.raises(ValueError, match="don't match"):
            textscore.scored(refs, make(bad), "cer")
    with pytest.raises(ValueError, match="empty references"):
        textscore.scored(refs.union(spark.createDataFrame([("c", "?!")], "id string, ref string")), make([*hyps, ("c", "q")]), "mer")


def test_mixed_error_of_a_table_equals_the_rule(spark):
    pairs = [("The quick fox 中文", "the quick, box 中"), ("a b c", ""), ("it's 12 o'clock", "its 12 oclock")]
    got = textscore.mixed_error(spark.createDataFrame(pairs, "r string, h string"), "r", "h").first()
    want = sum(edit(plain_tokens(a, "mer"), plain_tokens(b, "mer")) for a, b in pairs)
    assert (got.n_pairs, got.edits, got.n_ref) == (3, want, sum(len(plain_tokens(a, "mer")) for a, _ in pairs))


def lines(tmp_path, name, *rows):
    path = tmp_path / name
    path.write_text("\n".join(rows), encoding="utf-8")
    return str(path)


def test_predictions_and_references_are_read_strictly(spark, tmp_path):
    good = lines(tmp_path, "good", '{"id": "a", "hyp": "x", "more": 1}', "", '{"id": "b", "hyp": "ü\\n"}')
    assert rows(tables.read_predictions(spark, good)) == [("a", "x"), ("b", "ü\n")]
    for i, bad in enumerate(['{"id": 7, "hyp": "x"}', '{"id": "a", "hyp": 5}', '{"id": "a"}', '{"id": "a", "hyp": null}', "[1]", "{bad", '"text"']):
        with pytest.raises(ValueError):
            tables.read_predictions(spark, lines(tmp_path, f"bad{i}", '{"id": "a", "hyp": "x"}', bad))
    with pytest.raises(ValueError, match="no rows"):
        tables.read_predictions(spark, lines(tmp_path, "empty", ""))
    assert tables.read_references(spark, lines(tmp_path, "refs", '{"id": "a", "ref": "x"}')).count() == 1
    for i, bad in enumerate(['{"id": "a", "ref": "y"}', '{"id": "b", "ref": " "}', '{"id": "b", "ref": "?!"}']):
        with pytest.raises(ValueError):
            tables.read_references(spark, lines(tmp_path, f"refs{i}", '{"id": "a", "ref": "x"}', bad))
    out = str(tmp_path / "written")
    tables.write_predictions(tables.read_predictions(spark, good), out)
    assert rows(tables.read_predictions(spark, out)) == [("a", "x"), ("b", "ü\n")]


def test_fingerprint_keeps_values_apart(spark):
    digest = lambda *v: tables.fingerprint(spark.createDataFrame([v], "a string, b string"), ["a", "b"], "x").first().digest
    values = [("a|b", "c"), ("a", "b|c"), (None, "null"), ("null", None), ("", None), (None, ""), ("4:null", "x")]
    assert len({digest(*v) for v in values}) == len(values)


def test_provenance(spark):
    card = {"script_commit": "a" * 40, "model": "m", "model_revision": "b" * 40, "decoding": {"beam": 1}, "device": "cpu", "dirty": False}
    assert tables.provenance(card) == card
    for change in ({"script_commit": "a" * 39}, {"model": " "}, {"decoding": {}}, {"dirty": True}, {"device": None}):
        with pytest.raises(ValueError):
            tables.provenance(card | change)
    with pytest.raises(ValueError):
        tables.provenance({k: v for k, v in card.items() if k != "model_revision"})


def test_assembly_fails_on_what_does_not_fit(spark):
    u = spark.createDataFrame([(1, 10, "A"), (2, 10, "A"), (3, 11, "B"), (4, 12, "C")], "id int, us int, ut string")
    s = spark.createDataFrame([(10, 5, "A"), (11, 5, "B"), (12, 6, "C")], "s int, sc int, tier string")
    c = spark.createDataFrame([(5, "x"), (6, "y")], "c int, title string")
    args = ("us", "s", "sc", "c", "tier", ["A", "B"])
    out, ledger = frame.assemble(u, s, c, *args, unit_tier="ut", expected={"units": 5, "published": 3}, within={"units": 1})
    assert out.count() == 3 and [(r.step, r.rows_before, r.rows_after) for r in ledger.orderBy("step").collect()][3:] == [(4, 4, 4), (5, 4, 3), (6, 3, 3)]
    with pytest.raises(ValueError, match="counts differ"):
        frame.assemble(u, s, c, *args, expected={"units": 5})
    with pytest.raises(ValueError, match="unmatched"):
        frame.assemble(u, s.filter("s < 12"), c, *args)
    with pytest.raises(ValueError, match="rows of"):
        frame.assemble(u, s.union(s.limit(1)), c, *args)
    with pytest.raises(ValueError, match="clusters"):
        frame.assemble(u, s, c.filter("c = 6"), *args)
    with pytest.raises(ValueError, match="tier"):
        frame.assemble(u.withColumn("ut", F.lit("A")), s, c, *args, unit_tier="ut")


def test_lookup_and_reader_tables(spark):
    df, side = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "kk int, w string")
    assert rows(frame.lookup(df, "k", side, "kk", ["w"])) == [(1, "a", "x"), (2, "b", "y")]
    for bad in (side.filter("kk <> 2"), side.union(side.filter("kk = 1"))):
        with pytest.raises(ValueError):
            frame.lookup(df, "k", bad, "kk", ["w"])
    with pytest.raises(ValueError, match="already"):
        frame.lookup(df, "k", side.withColumnRenamed("w", "v"), "kk", ["v"])
    read = spark.createDataFrame([(1, "p"), (2, "q"), (9, "r")], "id int, hyp string")
    assert rows(readers.join_readers(df, "k", {"one": read, "two": read.filter("id < 9")})) == [(1, "a", "p", "p"), (2, "b", "q", "q")]
    for bad in (read.filter("id <> 2"), read.union(read.filter("id = 1"))):
        with pytest.raises(ValueError, match="reader two"):
            readers.join_readers(df, "k", {"one": read, "two": bad})
    assert [r[0] for r in spark.createDataFrame([("Straße",), ("abc",), (None,), ("ÄÖ",)], "t string").select(readers.folds_apart(F.col("t"))).collect()] == [True, False, False, False]


def test_keys_with_the_separator_are_refused(spark):
    df = spark.createDataFrame([("a", "b"), ("a\x1fb", "c"), ("a", "b"), (None, "b")], "x string, y string")
    assert tuple(measures.bad_keys(df, ["x", "y"]).first()) == (1, 2)


def test_denominators_by_name(spark):
    m = spark.createDataFrame([("n_a", 4.0), ("n_b", 6.0), ("agree_a", 0.5), ("gap", 1.0)], "name string, value double")
    rules = [("n_.*", ["n_b"]), ("agree_.*", ["n_a"]), ("gap", ["n_a", "n_b"])]
    assert {r.name: r.n for r in catalog.with_denominators(m, rules).collect()} == {"n_a": 6, "n_b": 6, "agree_a": 4, "gap": 10}
    with pytest.raises(ValueError, match="no rule"):
        catalog.with_denominators(m, rules[:2])
    with pytest.raises(ValueError, match="aren't there"):
        catalog.with_denominators(m, [(".*", ["n_c"])])


def test_relations_of_predictions_and_anchor(spark):
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, hyp string")
    assert rows(relations.double_predictions(p)) == [("a", "x"), ("b", "y"), ("dup:a", "x"), ("dup:b", "y")]
    left = spark.createDataFrame([("b",), ("b",), ("z",)], "u string")
    assert rows(relations.exclude_predictions(p, left, "u")) == [("b", "y")]
    assert [relations.anchor(left, n, t).first().ok for n, t in ((3, 0), (4, 0), (4, 1))] == [True, False, True]


def test_checks_catch_broken_metrics(spark):
    m = spark.createDataFrame([("n_pre", 10.0, 40), ("agree_share", 0.5, 10)], "name string, value double, n long")
    wrong = spark.createDataFrame([("n_pre", 41), ("agree_share", 10)], "name string, n long")
    assert {r.name: r.ok for r in catalog.declared_n(m, wrong).collect()} == {"n_pre": False, "agree_share": True}
    moved = m.withColumn("value", F.col("value") + F.when(F.col("name") == "agree_share", 0.01).otherwise(0.0))
    assert not relations.report(relations.compare(m, moved, "permute"), "permute").first().passed
    assert not relations.report(relations.compare(m, moved, "exclude"), "exclude").first().passed
    assert {r.name: r.ok for r in catalog.routes_agree(m, moved).collect()} == {"n_pre": True, "agree_share": False}
    rows_of = lambda df: df.select(F.lit("n").alias("name"), F.spark_partition_id().cast("double").alias("value"), F.lit(1).cast("long").alias("n")).orderBy(F.desc("value")).limit(1)
    assert not catalog.deterministic(rows_of, spark.range(100).coalesce(1)).first().ok


def test_word_labels_fall_back_to_characters(spark):
    def words(text):
        known = {"ab": ["1", "2"], "cde": ["x", "y"], "c": ["3"], "d": None, "e": ["5", "6"], "f": None}
        return [(w, known[w]) for w in re.findall("ab|cde|.", text)]

    labeller = predict.per_character(words)
    assert labeller([list("abcde"), ["f", "ab"], []]) == [["1", "2", "3", "?", "?"], ["?", "1", "2"], []]
    with pytest.raises(ValueError, match="make up"):
        predict.per_character(lambda t: [("z", None)])([["a"]])


def test_windowed_counts_on_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    events = spark.createDataFrame([(at + timedelta(minutes=m), k, float(m)) for m in range(0, 300, 7) for k in "ab"], "ts timestamp, k string, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counted = windows.windowed_counts(stream, "ts", ["k"], "1 hour", "2 hours", F.col("value") > 50)
    q = counted.writeStream.outputMode("complete").format("memory").queryName("windowed").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("windowed")) == rows(windows.windowed_counts(events, "ts", ["k"], "1 hour", "2 hours", F.col("value") > 50))


def test_prediction_lengths(spark):
    u = spark.createDataFrame([("s", 2, "b", "y"), ("s", 1, "a", "x"), ("t", 1, "c", None)], "s string, p int, id string, tok string")
    seq = predict.sequences(u, "s", "p", "id", "tok")
    got = predict.by_unit(predict.predict(seq, "s", lambda b: [[t or "" for t in x] for x in b]))
    assert rows(got) == [("a", "x"), ("b", "y"), ("c", "?")]
    with pytest.raises(Exception, match="missing or too many"):
        predict.predict(seq, "s", lambda b: [x[:1] for x in b]).collect()


def test_run_record(spark, tmp_path):
    out, df = str(tmp_path / "status"), spark.createDataFrame([(1, "a"), (2, None)], "a int, b string")
    run = tables.RunRecord(spark, out)
    run.start()
    with pytest.raises(ValueError, match="complete"):
        run.check({"x": df})
    run.complete({"x": df})
    run.check({"x": df.repartition(3)})
    with pytest.raises(ValueError, match="x"):
        run.check({"x": df.limit(1)})


def test_killed_and_changed_runs_are_refused(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("k"))
    run = tables.RunRecord(spark, str(tmp_path / "run"))
    run.write({"a": df, "b": df.limit(3)}, expected={"a": 9}, within={"a": 1})
    assert run.read("a").count() == 10 and run.read("b").count() == 3
    for declared in ({"a": 8}, {"b": 4}, {"c": 1}):
        with pytest.raises(ValueError):
            run.write({"a": df, "b": df.limit(3)}, expected=declared, within={"a": 1})
        with pytest.raises(ValueError, match="complete"):
            run.read("a")
    run.write({"a": df})
    broken = df.select((F.lit(1) / F.col("k").cast("double")).alias("k"), F.when(F.col("k") == 7, F.raise_error("killed")).alias("x"))
    with pytest.raises(Exception, match="killed"):
        run.write({"b": df, "a": broken})
    with pytest.raises(ValueError, match="complete"):
        run.read("b")
    run.write({"a": df})
    df.limit(9).write.mode("overwrite").parquet(str(tmp_path / "run" / "a.parquet"))
    with pytest.raises(ValueError, match="isn't what"):
        run.read("a")


def test_sketches_merge_and_keep_their_bound(spark):
    n = 30_000
    df = spark.range(n).select((F.col("id") % 3).alias("day"), F.when(F.col("id") % 5 != 0, F.col("id") % 20_000).alias("v"), F.lit(None).cast("long").alias("w"), F.lit(1).alias("one"))
    exact = len({i % 20_000 for i in range(n) if i % 5})
    got = {r.column: r.about for r in measures.merged_distinct(measures.distinct_sketches(df, ["day"], ["v", "w", "one"]), ["v", "w", "one"]).collect()}
    assert abs(got["v"] - exact) <= measures.SKETCH_ERROR * exact and got["w"] == 0 and got["one"] == 1
    assert {r.column: (r.n_nonnull, r.n_distinct, r.constant) for r in measures.column_profile(df, ["v", "w", "one"]).collect()} == {"v": (24_000, exact, False), "w": (0, 0, True), "one": (n, 1, True)}


def test_null_and_empty_parts_of_keys_differ(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a\x1f", "b"), ("\x00", "b")], "x string, y string")
    assert tuple(measures.bad_keys(df, ["x", "y"]).first()) == (2, 2)


def test_cascade_and_ledger(spark):
    p = spark.createDataFrame([(1,)], "k int")
    c = spark.createDataFrame([(1, 10), (2, 20)], "pk int, ck int")
    g = spark.createDataFrame([(10,), (20,), (None,)], "ck2 int")
    out = frame.cascade({"p": p, "c": c, "g": g}, [("c", "pk", "p", "k"), ("g", "ck2", "c", "ck")])
    assert out["g"].count() == 1
    led = frame.ledger(spark.createDataFrame([("a", 1), ("a", None), ("b", 5)], "g string, x int"), [("pos", F.col("x") > 0), ("big", F.col("x") > 2)], "g")
    assert rows(led) == [(1, "pos", "a", 2, 1), (1, "pos", "b", 1, 1), (2, "big", "a", 1, 0), (2, "big", "b", 1, 1)]


def test_checked_joins_run_once(spark):
    """Every join makes its rows in one job: no join stands in what the caller gets, and its inputs are read once."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(x):
        reads.add(1)
        return x

    left = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 4).alias("s"))
    side = spark.range(4).repartition(1).select(F.col("id").alias("kk"), F.col("id").alias("w"))
    probe = left.withColumn("p", seen(F.col("k").cast("int")))
    out = frame.lookup(probe, "s", side, "kk", ["w"])
    assert out.filter("p >= 0").count() == 40 and reads.value == 40
    assert "Join" not in out._jdf.queryExecution().toString()
    tables_of = {n: left.select(F.col("k").alias("id"), F.lit(n).alias("hyp")) for n in ("a", "b", "c")}
    before = reads.value
    joined = readers.join_readers(probe, "k", tables_of)
    assert joined.filter("p >= 0 and a = 'a' and c = 'c'").count() == 40 and reads.value == before + 40
    assert "Join" not in joined._jdf.queryExecution().toString()


def test_edit_distance_in_blocks_equals_the_table():
    import random
    import time

    rng = random.Random(8)
    for n in range(400):
        a, b = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        if n % 3 == 0:
            b = a[: len(a) // 2] + b[:3] + a[len(a) // 2 :]
        for width in (1, 3, 8, 64):
            assert textscore.edit_distance(a, b, width) == edit(a, b)
    words = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    other = list(words)
    for _ in range(500):
        del other[rng.randrange(len(other))]
    start = time.time()
    assert textscore.edit_distance(words, other) == 500
    assert textscore.edit_distance(words, words[::-1]) > 15_000
    assert time.time() - start < 20


def test_ascii_texts_have_one_form_natively_and_equal_the_rule(spark):
    texts = ["Plain ASCII", "It's\n", "\n", "", None, "É FF ﬁ", "Ａ１", "x\u2019s", "ß ẞ", "a\tB\x00c", "İ", "Q" * 5000, "abc\u2028", "ABC\u0085"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for folds in (None, {"a": "b", "b": "c", "é": "e"}, {"q": "kw"}):
        want = [t and plain_form(t, folds or {}) for t in texts]
        assert [r[0] for r in df.select(textscore.normal_form(F.col("t"), folds)).collect()] == want


def plain_form(text, folds):
    out = []
    for c in unicodedata.normalize("NFKC", text).lower():
        c = "'" if c in "\u2018\u2019\u02bc" else c
        for _ in range(4):
            c = folds.get(c, c)
        out.append(c)
    return "".join(out)


@pytest.mark.parametrize(("steps", "few"), [(4096, 100_000), (64, 3)])
def test_order_statistics_equal_sorted_values(spark, monkeypatch, steps, few):
    import math
    import random

    monkeypatch.setattr(robust, "STEPS", steps)
    monkeypatch.setattr(robust, "FEW", few)
    rng = random.Random(steps)
    values = {
        "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(90)], None: [rng.gauss(0, 1) for _ in range(75)], "one": [7.0], "equal": [3.0] * 40,
        "wide": [10.0 ** rng.randint(-300, 300) * rng.choice([1, -1]) for _ in range(60)], "odd": [math.inf, -math.inf, math.nan, 1e308, -1e308, 0.0, -0.0, math.nan, math.inf, 5e-324],
    }
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("ties", None), ("none", None)], "g string, v double")
    n = F.col("n")
    ranks = {"a": F.lit(1), "b": F.floor((n + 1) / 2), "c": n, "d": F.lit(9), "e": n + 1}
    got = {r.g: tuple(r) for r in robust.order_statistics(df, "g", "v", ranks).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        s = sorted(vs, key=lambda x: (math.isnan(x), x))
        want = [s[0], s[(len(s) + 1) // 2 - 1], s[-1], s[8] if len(s) > 8 else None, None]
        assert got[g][1] == len(vs) and all(x == y or (x != x and y != y) for x, y in zip(got[g][2:], want, strict=True)), (g, got[g], want)


def test_trimmed_equals_a_whole_order(spark, monkeypatch):
    import random

    monkeypatch.setattr(robust, "FEW", 5)
    rng = random.Random(2)
    for n, scores in ((1, [1.0]), (5, [None]), (40, [1.0]), (60, [1.0, 2.0, None]), (80, [rng.random() for _ in range(50)])):
        data = [(rng.choice(scores), i % 7, i) for i in range(n)]
        k = 0 if n < 2 else 1 if n < 20 else int(0.05 * n)
        want = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))[k : n - k]
        assert rows(robust.trimmed(spark.createDataFrame(data, "s double, t int, c int"), ["s", "t", "c"])) == sorted(want, key=str)


@pytest.mark.parametrize("most", [500_000, 2])
def test_markers_in_titles(spark, monkeypatch, most):
    import random

    monkeypatch.setattr(labels, "MOST_MARKERS", most)
    rng = random.Random(6)
    titles = [None, "", "abc", *("".join(rng.choice("abé") for _ in range(rng.randint(1, 12))) for _ in range(80))]
    for toks in ([], ["abc", "é", "abc", None], ["aab", "bbé", "zz", "éa", "babab"], ["", "x"]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "k int, t string")
        got = labels.with_marker(df, "t", spark.createDataFrame([(t,) for t in toks], "tok string")).collect()
        want = [(i, t, t is not None and any(m is not None and m in t for m in toks)) for i, t in enumerate(titles)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_many_markers_take_linear_time(spark):
    import time

    toks = spark.range(100_000).select(F.concat(F.lit("m"), F.col("id").cast("string"), F.lit(";")).alias("tok"))
    df = spark.range(20_000).select(F.concat(F.lit("a title of m"), (F.col("id") * 10).cast("string"), F.when(F.col("id") % 2 == 0, ";").otherwise("")).alias("t"))
    start = time.time()
    assert labels.with_marker(df, "t", toks).filter("marked").count() == 5000
    assert time.time() - start < 60


def test_streamed_labels_keep_state_over_batches(spark):
    import itertools

    def step(state, tokens):
        sums = list(itertools.accumulate(map(int, tokens), initial=state or 0))
        return sums[-1], [str(x) if x % 5 else "" for x in sums[1:]]

    data = [(s, p, f"{s}:{p}", str((p * 7) % 4)) for s, n in (("a", 37), ("b", 1), (None, 9), ("", 4)) for p in range(n)]
    want = []
    for _, own in itertools.groupby(data, lambda r: r[0]):
        total = 0
        for _, _, i, t in own:
            total += int(t)
            want.append((i, str(total) if total % 5 else "?"))
    df = spark.createDataFrame(data, "s string, p int, i string, t string").repartition(5)
    for batch in (1, 4, 10_000):
        assert rows(predict.streamed(df, "s", "p", "i", "t", step, batch=batch)) == sorted(want, key=str)
    with pytest.raises(Exception, match="missing or too many"):
        predict.streamed(df, "s", "p", "i", "t", lambda s, t: (s, t[1:])).collect()


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_two_intervals_of_readers_draw_once(spark):
    # the rounds' sums are written once: nothing that is left to run draws
    out = resampling.i12_reader_gap_bootstrap(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in out._jdf.queryExecution().toString() and out.count() == 3


def test_tables_of_many_rows_are_cut_by_size(spark, monkeypatch):
    # a task's rows are bounded by a size, not by the number of partitions of the session
    monkeypatch.setitem(shared.SPREAD, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    cells = spark.range(800_000).groupBy((F.col("id") % 400_000).alias("c")).agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.lit("s"))
    before = {k: spark.conf.get(k, None) for k in shared.SPREAD}
    settings = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert shared.cut(cells).rdd.getNumPartitions() <= 4
        assert shared.cut_spread(cells).rdd.getNumPartitions() > 8
        own = resample.indexed(cells, "s", "c", 1)
        assert own.agg(F.count_distinct("_i"), F.min("_i"), F.max("_i")).first()[:] == (400_000, 0, 399_999)
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert {k: spark.conf.get(k, None) for k in shared.SPREAD} == before
