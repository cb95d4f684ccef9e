"""Queries: frame assembly, reader tables, predictions, run records, denominators by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from agreeline.operators import catalog, frame, measures, predict, relations
from agreeline.operators import readers as rd
from agreeline.sources import tables

from .bindings import READERS_SQL, SEGMENTS_SQL, TIERS, UNITS_SQL, assembled, clusters, raw_units, segments, units

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


INPUTS = ("customer", "lineitem", "orders")


@query(" UNION ALL ".join(f"SELECT 'input' AS kind, '{t}' AS name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT string_agg(column_name, ',') FROM (DESCRIBE {t})) AS detail" for t in INPUTS)
       + f" UNION ALL (WITH {SEGMENTS_SQL} SELECT 'step', '1:all', (SELECT count(*) FROM ps), 'tier from ' || (SELECT count(*) FROM s))")
def a06_run_manifest(spark, d):
    step = segments(spark, d).agg(F.lit(1).alias("step"), F.lit("tier").alias("rule"), F.lit("all").alias("grp"), F.count(F.lit(1)).alias("rows_before"), F.count_if(F.col("tier").isin(TIERS)).alias("rows_after"))
    return tables.manifest({t: tables.load(spark, d, t) for t in INPUTS}, step)


@query(f"""SELECT count(*) FILTER (regexp_matches(lower(trim(text)), '{rd.APART}')) AS n_apart, count(*) AS n, count(*) FILTER (lower(trim(lang)) = lower(trim(upper(lang)))) AS n_equal FROM documents""")
def b11_normal_readings(spark, d):
    """Normalised readings of two spellings match; texts that case folding would change are counted."""
    t = tables.load(spark, d, "documents", ["text", "lang"])
    return t.agg(F.count_if(rd.folds_apart(F.col("text"))).alias("n_apart"), F.count(F.lit(1)).alias("n"), F.count_if(rd.normal(F.col("lang")) == rd.normal(F.upper("lang"))).alias("n_equal"))


@query(f"WITH {READERS_SQL}, j AS (SELECT *, period <> 'unassigned' AS ok FROM rd) SELECT count(*) FILTER (ok AND trim(coalesce(a, '')) = '') AS a, count(*) FILTER (ok AND trim(coalesce(b, '')) = '') AS b, count(*) FILTER (ok AND trim(coalesce(c, '')) = '') AS c FROM j")
def b17_reader_guards(spark, d):
    from .bindings import readers

    return rd.missing_readings(readers(spark, d), ["a", "b", "c"], F.col("period") != "unassigned")


@query(f"WITH {READERS_SQL} SELECT a = base AS same, count(*) AS n, count(*) FILTER (a = target) AS n_match FROM rd GROUP BY 1")
def b14_pair_sides(spark, d):
    """The rows where a reader differs from the baseline, and the side where both are equal."""
    from .bindings import readers

    return readers(spark, d).groupBy((F.col("a") == F.col("base")).alias("same")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("target")).alias("n_match"))


@query("SELECT count(*) FILTER (l_linestatus IS DISTINCT FROM o_orderstatus) AS n_different, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def b20_tiers_differ(spark, d):
    return frame.tiers_differ(assembled(spark, d), "l_linestatus", "tier")


@query("""WITH c AS (SELECT count(*) AS n FROM customer), s AS (SELECT count(*) AS n FROM orders), u AS (SELECT count(*) AS n FROM lineitem), p AS (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O'))
SELECT 1::INT AS step, 'clusters, whole table' AS rule, 'all' AS grp, n AS rows_before, n AS rows_after, 0::BIGINT AS unmatched_left FROM c UNION ALL SELECT 2, 'segments, whole table', 'all', n, n, 0 FROM s UNION ALL SELECT 3, 'units, whole table', 'all', n, n, 0 FROM u
UNION ALL SELECT 4, 'units with their segment', 'all', n, n, 0 FROM u UNION ALL SELECT 5, 'tier in F, O', 'all', u.n, p.n, 0 FROM u, p UNION ALL SELECT 6, 'published rows with their cluster', 'all', n, n, 0 FROM p""")
def c03_frame_assembly(spark, d):
    s = segments(spark, d).withColumnRenamed("seg_cluster", "of_cluster")
    return frame.assemble(raw_units(spark, d), s, clusters(spark, d), "unit_segment", "segment", "of_cluster", "cluster", "tier", TIERS)[1]


@query("""WITH c AS (SELECT (max(c_custkey) - min(c_custkey) + 1)::BIGINT AS n FROM customer), s AS (SELECT (max(o_orderkey) - min(o_orderkey) + 1)::BIGINT AS n FROM orders), u AS (SELECT count(*) FILTER (o_orderkey IS NOT NULL) AS n, count(*) FILTER (o_orderstatus <> 'P') AS p FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
SELECT 'clusters' AS what, c.n AS expected, (SELECT count(*) FROM customer) AS found, 0::BIGINT AS within FROM c UNION ALL SELECT 'segments', s.n, (SELECT count(*) FROM orders), 0 FROM s UNION ALL SELECT 'units', 4 * s.n, u.n, s.n // 50 FROM s, u UNION ALL SELECT 'published', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') ON l_orderkey = o_orderkey), u.p, 0 FROM u""")
def k06_frame_counts(spark, d):
    """Counts that the assembly is held to: as many clusters and segments as keys range over, four units to a
    segment within two per cent, and all units published but those of a left-out tier."""
    o, c, u = segments(spark, d), clusters(spark, d), raw_units(spark, d)
    span = lambda df, k: df.agg((F.max(k) - F.min(k) + 1).cast("long")).first()[0]
    n = span(o, "segment")
    left_out = u.join(o.filter("tier = 'P'"), F.col("unit_segment") == F.col("segment"), "left_semi").count()
    expected = {"clusters": span(c, "cluster"), "segments": n, "units": 4 * n, "published": u.count() - left_out}
    within = {"units": n // 50}
    s = o.withColumnRenamed("seg_cluster", "of_cluster")
    ledger = frame.assemble(u, s, c, "unit_segment", "segment", "of_cluster", "cluster", "tier", TIERS, expected=expected, within=within)[1]
    found = {1: "clusters", 2: "segments", 3: "units", 5: "published"}
    declared = spark.createDataFrame([(i, w, expected[w], within.get(w, 0)) for i, w in found.items()], "i int, what string, expected long, within long")
    return declared.join(F.broadcast(ledger), F.col("i") == F.col("step")).select("what", "expected", F.col("rows_after").alias("found"), "within")  # four rows


@query("""WITH r AS (SELECT o_orderstatus AS target, CASE WHEN o_totalprice > 150000 THEN 'O' ELSE 'F' END AS price, substr(o_orderpriority, 1, 1) AS urgent FROM orders)
SELECT target, count(*) AS n, count(*) FILTER (price = target) AS n_price, count(*) FILTER (urgent = '1') AS n_urgent FROM r GROUP BY target""")
def c10_reader_tables(spark, d):
    o = tables.load(spark, d, "orders")
    price = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 150000, "O").otherwise("F").alias("hyp"))
    urgent = o.select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).alias("hyp"))
    j = rd.join_readers(o.select("o_orderkey", F.col("o_orderstatus").alias("target")), "o_orderkey", {"price": price, "urgent": urgent})
    return j.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("price") == F.col("target")).alias("n_price"), F.count_if(F.col("urgent") == "1").alias("n_urgent"))


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def c11_attribute_lookup(spark, d):
    o = tables.load(spark, d, "orders", ["o_orderkey", "o_custkey"])
    return frame.lookup(o, "o_custkey", tables.load(spark, d, "customer"), "c_custkey", ["c_mktsegment"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


CLASSES = ("tone", "segment", "diff")


@query(f"""WITH {UNITS_SQL} {' UNION ALL '.join(f"SELECT '{c}' AS class, round(1000.0 * (count(*) FILTER (ok AND verdict = '{c}' AND period = 'post')::DOUBLE / nullif(count(*) FILTER (ok AND period = 'post'), 0) - count(*) FILTER (ok AND verdict = '{c}' AND period = 'pre')::DOUBLE / nullif(count(*) FILTER (ok AND period = 'pre'), 0)), 6) AS gap_pm FROM u" for c in CLASSES)}""")
def d08_class_gaps(spark, d):
    return measures.class_gaps(units(spark, d), "period", "verdict", CLASSES, F.col("ok"))


@query(f"""WITH {UNITS_SQL}, common AS (SELECT type AS t FROM r GROUP BY type HAVING count(*) >= 25), x AS (SELECT * FROM u JOIN common ON type = t WHERE grp = 'other')
SELECT 'controlled' AS denominator, count(*) FILTER (ok AND period = 'pre') AS n_pre, count(*) FILTER (ok AND period = 'post') AS n_post,
  round(count(*) FILTER (ok AND match AND period = 'pre')::DOUBLE / nullif(count(*) FILTER (ok AND period = 'pre'), 0), 6) AS agree_pre, round(count(*) FILTER (ok AND match AND period = 'post')::DOUBLE / nullif(count(*) FILTER (ok AND period = 'post'), 0), 6) AS agree_post,
  round(100 * (count(*) FILTER (ok AND match AND period = 'pre')::DOUBLE / nullif(count(*) FILTER (ok AND period = 'pre'), 0) - count(*) FILTER (ok AND match AND period = 'post')::DOUBLE / nullif(count(*) FILTER (ok AND period = 'post'), 0)), 6) AS gap FROM x""")
def d13_controlled_gap(spark, d):
    from agreeline.operators import labels

    from .bindings import RARE_BELOW

    u = labels.with_rarity(units(spark, d), raw_units(spark, d), "type", RARE_BELOW).filter("not rare and grp = 'other'")
    return measures.period_gap(u, [], "period", {"controlled": F.col("ok")}, F.col("match"))


@query(f"""WITH {READERS_SQL}, x AS (SELECT rd.*, l_returnflag AS realised, dur FROM (SELECT cluster, period, type, l_linestatus AS a, tier AS b, CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'N' THEN 'O' WHEN 'A' THEN 'P' END AS c, CASE type % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS target, realised AS l_returnflag, dur FROM a) rd),
y AS (SELECT *, realised IS NOT NULL AND realised <> '' AND dur > 0 AS ok, CASE WHEN a <> b OR b <> c OR a <> c THEN 'main' ELSE 'control' END AS part FROM x)
SELECT part, count(*) AS n_total, count(*) FILTER (ok) AS n_judgeable, count(*) FILTER (coalesce(realised, '') = '') AS n_empty_realized, count(*) FILTER (dur <= 0) AS n_dur_le_0, count(*) FILTER (coalesce(realised, '') = '' AND dur <= 0) AS n_empty_and_zerodur,
  count(*) FILTER (ok AND a = target) AS n_match_a, count(*) FILTER (ok AND b = target) AS n_match_b, count(*) FILTER (ok AND c = target) AS n_match_c FROM y GROUP BY part""")
def d25_reader_six_counts(spark, d):
    from .bindings import reader_columns

    u = assembled(spark, d)
    r = u.select(*reader_columns(), "realised", "dur")
    part = F.when(rd.differs(["a", "b", "c"]), "main").otherwise("control")
    return measures.reader_counts(r.withColumn("part", part), ["part"], "realised", "dur", ["a", "b", "c"], "target")


@query("SELECT 'dup:' || doc_id AS id, toxic::VARCHAR AS hyp FROM labels UNION ALL SELECT doc_id::VARCHAR, toxic::VARCHAR FROM labels")
def g05_doubled_predictions(spark, d):
    p = tables.load(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("string").alias("hyp"))
    return relations.double_predictions(p)


@query("SELECT l.doc_id AS id, toxic::VARCHAR AS hyp FROM labels l WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def g05_excluded_predictions(spark, d):
    p = tables.load(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("string").alias("hyp"))
    return relations.exclude_predictions(p, tables.load(spark, d, "documents", ["doc_id", "lang"]).filter("lang = 'en'"), "doc_id")


@query("SELECT count(*) FILTER (contains(p_brand, '#') OR contains(p_type, '#')) AS n_bad, count(DISTINCT CASE WHEN NOT (contains(p_brand, '#') OR contains(p_type, '#')) THEN p_brand || '#' || p_type END) AS n_keys FROM part")
def h08_composite_keys(spark, d):
    return measures.bad_keys(tables.load(spark, d, "part"), ["p_brand", "p_type"], "#")


@query("SELECT count(*) AS n, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS declared, count(*) = (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS ok FROM orders WHERE o_orderstatus IN ('F', 'O')")
def j05_published_anchor(spark, d):
    """The published segments against a number that is counted the other way round."""
    declared = tables.load(spark, d, "orders").filter("o_orderstatus <> 'P'").count()
    return relations.anchor(frame.published(segments(spark, d), "tier", TIERS), declared)


N_RULES = [("n_.*", ["n_total"]), ("agree_(?:pre|post)", ["n_judgeable"]), ("gap_all", ["n_pre", "n_post"])]


@query(f"""WITH {UNITS_SQL}, w AS (SELECT count(*) AS n_total, count(*) FILTER (ok) AS n_judgeable, count(*) FILTER (period = 'pre') AS n_pre, count(*) FILTER (period = 'post') AS n_post, round(avg(match::INT) FILTER (ok AND period = 'pre'), 6) AS agree_pre,
  round(avg(match::INT) FILTER (ok AND period = 'post'), 6) AS agree_post, round(100 * (avg(match::INT) FILTER (period = 'pre') - avg(match::INT) FILTER (period = 'post')), 6) AS gap_all FROM u)
{' UNION ALL '.join(f"SELECT '{n}' AS name, {n}::DOUBLE AS value, {'n_total' if n[:2] == 'n_' else 'n_judgeable' if n[:5] == 'agree' else 'n_pre + n_post'} AS n FROM w" for n in ('n_total', 'n_judgeable', 'n_pre', 'n_post', 'agree_pre', 'agree_post', 'gap_all'))}""")
def k08_denominators(spark, d):
    u = units(spark, d)
    pre, post = (F.col("period") == p for p in ("pre", "post"))
    share = lambda c: F.avg(F.when(c, F.col("match").cast("int")))
    wide = u.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("ok").alias("n_judgeable"), F.count_if(pre).alias("n_pre"), F.count_if(post).alias("n_post"), F.round(share(F.col("ok") & pre), 6).alias("agree_pre"),
        F.round(share(F.col("ok") & post), 6).alias("agree_post"), F.round(100 * (share(pre) - share(post)), 6).alias("gap_all"),
    )
    return catalog.with_denominators(tables.metric_rows(wide, {c: (F.col(c), F.lit(0), "") for c in wide.columns}), N_RULES)


@query("""SELECT conv_id::VARCHAR || ':' || turn AS id, CASE WHEN i % 2 = 1 THEN upper(substr(role, i::INT, 1)) ELSE lower(substr(role, i::INT, 1)) END AS hyp FROM (SELECT conv_id, turn, role, unnest(range(1, length(role) + 1)) AS i FROM conversations)""")
def m03_word_labels(spark, d):
    """Labels of characters from a labeller of words: here each word's letters, upper case in turn."""
    t = tables.load(spark, d, "conversations", ["conv_id", "turn", "role"])
    letters = t.select("conv_id", "turn", F.posexplode(F.filter(F.split("role", ""), lambda c: c != "")).alias("pos", "c"))
    letters = letters.withColumns({"seg": F.concat_ws(":", "conv_id", "turn"), "id": F.concat_ws(":", "conv_id", "turn")})
    seqs = predict.sequences(letters, "seg", "pos", "id", "c")
    return predict.by_unit(predict.predict(seqs, "seg", predict.per_character(lambda text: [(text, [c.upper() if i % 2 == 0 else c.lower() for i, c in enumerate(text)])])))


CARD = {"script_commit": "0" * 40, "model": "rule", "model_revision": "1" * 40, "decoding": {"beam": 1}, "device": "cpu", "dirty": False}


@query("""SELECT doc_id::VARCHAR AS id, toxic::VARCHAR AS hyp, '{"decoding": {"beam": 1}, "device": "cpu", "dirty": false, "model": "rule", "model_revision": "1111111111111111111111111111111111111111", "script_commit": "0000000000000000000000000000000000000000"}' AS made_by FROM labels""")
def m05_provenance(spark, d):
    p = tables.load(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("string").alias("hyp"))
    return tables.with_provenance(p, CARD)
