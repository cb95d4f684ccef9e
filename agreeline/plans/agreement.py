"""Queries: labels, counts, agreement, gaps, shares, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from agreeline.operators import frame, labels, measures
from agreeline.sources import tables

from .bindings import AGREE, CLASSES, MARKERS, RARE_BELOW, SEGMENTS_SQL, UNITS_SQL, assembled, clusters, published_segments, raw_units, segments, units

QUERIES, ORACLES = {}, {}
OK, MATCH = F.col, F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def a01_scan(spark, d):
    return tables.load(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])


@query(f"""WITH {SEGMENTS_SQL}
SELECT period, grp, count(*) AS n_segments, count(DISTINCT cluster) AS n_clusters FROM s JOIN cg ON seg_cluster = cluster GROUP BY ALL""")
def b05_b08_labels(spark, d):
    s, c = segments(spark, d), clusters(spark, d)
    j = s.join(c, s["seg_cluster"] == c["cluster"])
    return j.groupBy("period", "grp").agg(F.count(F.lit(1)).alias("n_segments"), F.count_distinct("cluster").alias("n_clusters"))


@query(f"""WITH {SEGMENTS_SQL}
SELECT count(*) FILTER (contains(title, 'MACH') AND contains(title, 'BUILD')) AS n_in_both, count(*) FILTER (grp = 'unassigned') AS n_unassigned FROM cg""")
def b07_b19_overlap(spark, d):
    t = F.col("title")
    return clusters(spark, d).agg(
        F.count_if(labels.has_marker(t, MARKERS[:1]) & labels.has_marker(t, MARKERS[1:])).alias("n_in_both"), F.count_if(F.col("grp") == "unassigned").alias("n_unassigned")
    )


@query(f"WITH {UNITS_SQL} SELECT type, count(*) AS n FROM r GROUP BY type HAVING count(*) < {RARE_BELOW}")
def b09_rare_types(spark, d):
    return labels.rare_types(raw_units(spark, d), "type", RARE_BELOW)


@query(f"""WITH {UNITS_SQL}
SELECT period, CASE WHEN verdict IN ('exact_default', 'exact_alt') THEN 'match' WHEN verdict IN ('tone', 'segment', 'diff') THEN verdict WHEN verdict = 'none' THEN 'none' ELSE 'undeclared' END AS class, count(*) AS n
FROM u GROUP BY ALL""")
def b10_error_classes(spark, d):
    u = units(spark, d).withColumn("class", labels.error_class(F.col("verdict"), CLASSES, AGREE))
    return u.groupBy("period", "class").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
SELECT CASE WHEN trim(coalesce(nxt, '')) = '' THEN 'empty' WHEN trim(nxt) IN ('system') THEN 'final' ELSE 'non_final' END AS context, count(*) AS n FROM t WHERE role = 'user' GROUP BY 1""")
def b15_context(spark, d):
    from pyspark.sql import Window

    t = tables.load(spark, d, "conversations", ["conv_id", "turn", "role"])
    t = t.withColumn("nxt", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.withColumn("context", labels.next_token_class(F.col("role"), F.col("nxt"), "user", ["system"])).filter(F.col("context").isNotNull()).groupBy("context").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {UNITS_SQL}
SELECT count(*) FILTER (flag NOT IN (0, 1) OR flag IS NULL) AS bad_flag, count(*) FILTER (measure IS NULL) AS no_measure, count(*) FILTER (ok AND verdict IS NULL) AS no_verdict,
  count(*) FILTER (realised IS NULL) AS no_reading, count(*) FILTER (dur <= 0) AS no_duration FROM u""")
def b16_guards(spark, d):
    return frame.guards(units(spark, d), {
        "bad_flag": ~F.col("flag").isin(0, 1), "no_measure": F.col("measure").isNull(), "no_verdict": F.col("ok") & F.col("verdict").isNull(),
        "no_reading": F.col("realised").isNull(), "no_duration": F.col("dur") <= 0,
    })


@query(f"WITH {SEGMENTS_SQL} SELECT period, count(*) AS n FROM s WHERE tier IN ('F', 'P') AND measure > 100000 GROUP BY period")
def b18_predicate(spark, d):
    s = frame.predicate(frame.predicate(segments(spark, d), "tier", "IN ('F', 'P')"), "measure", "> 100000")
    return s.groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {UNITS_SQL}, n AS (SELECT unit_segment AS k, count(DISTINCT type) AS n_cand FROM r GROUP BY 1)
SELECT period, count(*) AS n, count(*) FILTER (match) AS n_match, round(count(*) FILTER (match)::DOUBLE / count(*), 6) AS agreement FROM u JOIN n ON unit_segment = k WHERE n_cand >= 2 AND ok GROUP BY period""")
def b21_candidates(spark, d):
    n = raw_units(spark, d).groupBy(F.col("unit_segment").alias("k")).agg(F.count_distinct("type").alias("n_cand"))
    u = units(spark, d).join(n, F.col("unit_segment") == F.col("k")).filter("n_cand >= 2 and ok")
    out = u.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_if("match").alias("n_match"))
    return out.withColumn("agreement", measures.rate(F.col("n_match"), F.col("n")))


@query(f"""WITH {UNITS_SQL}
SELECT count(segment) AS matched, count(*) - count(segment) AS unmatched_left, count(*) AS rows_out FROM r LEFT JOIN s ON unit_segment = segment""")
def c02_checked_join(spark, d):
    return frame.checked_join(raw_units(spark, d), segments(spark, d), [("unit_segment", "segment")])[1]


@query(f"WITH {SEGMENTS_SQL}, m(tok) AS (VALUES ('MACH'), ('BUILD')) SELECT cluster, title FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE contains(title, tok))")
def c05_no_marker(spark, d):
    m = spark.createDataFrame([(x,) for x in MARKERS], "tok string")
    return labels.with_marker(clusters(spark, d).select("cluster", "title"), "title", m).filter("not marked").drop("marked")


@query(f"WITH {SEGMENTS_SQL}, m(tok) AS (VALUES ('MACH'), ('BUILD')) SELECT cluster, title FROM c WHERE EXISTS (SELECT 1 FROM m WHERE contains(title, tok))")
def c06_marker(spark, d):
    m = spark.createDataFrame([(x,) for x in MARKERS], "tok string")
    return labels.with_marker(clusters(spark, d).select("cluster", "title"), "title", m).filter("marked").drop("marked")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, substr(b.text, 1, 40))) AS marked FROM documents d")
def c06m_many_markers(spark, d):
    """Documents that contain the beginning of an item, all items at once."""
    m = tables.load(spark, d, "benchmark", ["text"]).select(F.substring("text", 1, 40).alias("tok"))
    return labels.with_marker(tables.load(spark, d, "documents", ["doc_id", "text"]), "text", m).drop("text")


@query(f"WITH {SEGMENTS_SQL} SELECT cluster FROM c WHERE cluster NOT IN (SELECT seg_cluster FROM ps)")
def c08_clusters_without_segments(spark, d):
    return clusters(spark, d).select("cluster").join(published_segments(spark, d).select(F.col("cluster").alias("k")), F.col("cluster") == F.col("k"), "left_anti")


@query("""WITH c AS (SELECT * FROM customer WHERE c_acctbal > 0), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS name, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS removed UNION ALL SELECT 'orders', (SELECT count(*) FROM orders) - (SELECT count(*) FROM o)
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM l)""")
def c12_cascade(spark, d):
    names = ["customer", "orders", "lineitem"]
    before = {n: tables.load(spark, d, n) for n in names}
    after = frame.cascade({**before, "customer": before["customer"].filter("c_acctbal > 0")}, [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    count = lambda t, n, sign: t.agg(F.lit(n).alias("name"), (sign * F.count(F.lit(1))).alias("k"))
    parts = [count(before[n], n, 1).unionByName(count(after[n], n, -1)) for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").agg(F.sum("k").alias("removed"))


@query("""SELECT count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS extra, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS "both"
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON l.doc_id = d.doc_id""")
def c13_coverage(spark, d):
    return frame.coverage(tables.load(spark, d, "labels"), tables.load(spark, d, "documents"), "doc_id", "doc_id")


@query(f"""WITH {UNITS_SQL} SELECT period, grp, count(*) AS n_total, count(*) FILTER (ok) AS n_judgeable, count(*) FILTER (ok AND match) AS n_match, count(*) FILTER (coalesce(realised, '') = '') AS n_empty_realized,
  count(*) FILTER (dur <= 0) AS n_dur_le_0, count(*) FILTER (coalesce(realised, '') = '' AND dur <= 0) AS n_empty_and_zerodur,
  round(count(*) FILTER (ok AND match)::DOUBLE / nullif(count(*) FILTER (ok), 0), 6) AS agreement, CASE WHEN count(*) FILTER (ok) > 0 THEN 'ok' ELSE 'missing' END AS agreement_status
FROM u GROUP BY period, grp""")
def d02_d04_six_counts(spark, d):
    return measures.six_counts(units(spark, d), ["period", "grp"], "realised", "dur", F.col("match"))


def _gap_sql(by: str, dens: dict[str, str]) -> str:
    each = []
    for n, ok in dens.items():
        pre, post = (f"count(*) FILTER ({ok} AND match AND period = '{p}')::DOUBLE / nullif(count(*) FILTER ({ok} AND period = '{p}'), 0)" for p in ("pre", "post"))
        each.append(
            f"SELECT {by + ',' if by else ''} '{n}' AS denominator, count(*) FILTER ({ok} AND period = 'pre') AS n_pre, count(*) FILTER ({ok} AND period = 'post') AS n_post, "
            f"round({pre}, 6) AS agree_pre, round({post}, 6) AS agree_post, round(100 * ({pre} - {post}), 6) AS gap FROM u {'GROUP BY ' + by if by else ''}"
        )
    return f"WITH {UNITS_SQL} " + " UNION ALL ".join(each)


DENOMINATORS = {"judgeable": "ok", "all": "true", "excl_empty": "coalesce(realised, '') <> ''", "excl_zerodur": "dur > 0"}


@query(_gap_sql("", DENOMINATORS))
def d05_period_gap(spark, d):
    """Agreement and gap by period under each denominator, in one pass over the units."""
    return measures.period_gap(units(spark, d), [], "period", {n: F.expr(e) for n, e in DENOMINATORS.items()}, F.col("match"))


@query(_gap_sql("grp", {"judgeable": "ok"}))
def d04_group_gap(spark, d):
    return measures.period_gap(units(spark, d), ["grp"], "period", {"judgeable": F.col("ok")}, F.col("match"))


@query(f"""WITH g AS ({_gap_sql("grp", {"judgeable": "ok"})}) SELECT round(max(gap) FILTER (grp = 'marked') - max(gap) FILTER (grp = 'other'), 5) AS did FROM g""")
def d09_did(spark, d):
    from agreeline.operators.decompose import did

    return did(d04_group_gap(spark, d), "grp", "gap", "marked", "other").select(F.round("did", 5).alias("did"))


def _class_sql(within: str) -> str:
    parts = ", ".join(f"count(*) FILTER ({within} AND verdict = '{c}') AS n_{c}, round(1000.0 * count(*) FILTER ({within} AND verdict = '{c}') / nullif(count(*) FILTER ({within}), 0), 6) AS rate_{c}" for c in CLASSES)
    return f"WITH {UNITS_SQL} SELECT period, count(*) FILTER ({within}) AS n, {parts} FROM u GROUP BY period"


@query(_class_sql("true"))
def d07_class_rates(spark, d):
    return measures.class_rates(units(spark, d), ["period"], "verdict", CLASSES, F.lit(True))


@query(_class_sql("ok"))
def d08_class_shares(spark, d):
    return measures.class_rates(units(spark, d), ["period"], "verdict", CLASSES, F.col("ok"))


@query(f"""WITH {SEGMENTS_SQL} SELECT round(avg(measure) FILTER (period = 'pre'), 3) AS mean_pre, round(avg(measure) FILTER (period = 'post'), 3) AS mean_post,
  round(avg(measure) FILTER (period = 'post') - avg(measure) FILTER (period = 'pre'), 3) AS gap FROM ps""")
def d10_mean_gap(spark, d):
    return measures.mean_gap(published_segments(spark, d), "period", "measure", 1.0)


@query(f"WITH {SEGMENTS_SQL} SELECT period, sum(flag)::BIGINT AS n_flag, count(*) AS n, round(1000.0 * sum(flag) / count(*), 6) AS rate_pm FROM ps GROUP BY period")
def d11_flag_rate(spark, d):
    return published_segments(spark, d).groupBy("period").agg(F.sum("flag").alias("n_flag"), F.count(F.lit(1)).alias("n")).withColumn("rate_pm", measures.rate(F.col("n_flag"), F.col("n"), 1000))


@query(f"""WITH {UNITS_SQL}, rare AS (SELECT type AS t FROM r GROUP BY type HAVING count(*) < {RARE_BELOW})
SELECT period, count(*) AS n, count(t) AS n_rare, round(count(t)::DOUBLE / count(*), 6) AS rare_share FROM u LEFT JOIN rare ON type = t GROUP BY period""")
def d12_rare_share(spark, d):
    u = labels.with_rarity(units(spark, d), raw_units(spark, d), "type", RARE_BELOW)
    return u.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_if("rare").alias("n_rare")).withColumn("rare_share", measures.rate(F.col("n_rare"), F.col("n")))


@query(f"""WITH {UNITS_SQL}, common AS (SELECT type AS t FROM r GROUP BY type HAVING count(*) >= {RARE_BELOW})
SELECT period, count(*) AS n_judgeable, count(*) FILTER (match) AS n_match, round(count(*) FILTER (match)::DOUBLE / count(*), 6) AS agreement FROM u JOIN common ON type = t WHERE ok AND grp = 'other' AND period <> 'unassigned' GROUP BY period""")
def d13_controlled_cell(spark, d):
    u = labels.with_rarity(units(spark, d), raw_units(spark, d), "type", RARE_BELOW).filter("ok and not rare and grp = 'other' and period <> 'unassigned'")
    return u.groupBy("period").agg(F.count(F.lit(1)).alias("n_judgeable"), F.count_if("match").alias("n_match")).withColumn("agreement", measures.rate(F.col("n_match"), F.col("n_judgeable")))


@query(f"""WITH {SEGMENTS_SQL} SELECT substr(day, 1, 4) AS cell, count(DISTINCT cluster) AS n_clusters, count(*) AS n_segments, round(avg(flag), 6) AS flag_rate, count(DISTINCT cluster) < 10 AS small_cell FROM ps GROUP BY 1""")
def d17_year_cells(spark, d):
    return measures.year_cells(published_segments(spark, d), labels.year(F.col("day")), "cluster", {"flag_rate": F.col("flag")})


@query("""SELECT event_type AS "value", count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1""")
def d19_value_shares(spark, d):
    return measures.value_shares(tables.load(spark, d, "events"), "event_type")


@query("SELECT k AS n_candidates, count(*) AS n FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def d20_histogram(spark, d):
    k = tables.load(spark, d, "lineitem", ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_candidates"))
    return k.groupBy("n_candidates").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SEGMENTS_SQL}, k AS (SELECT period, cluster, sum(measure) / count(*) AS x FROM ps GROUP BY 1, 2) SELECT period, count(*) AS n_clusters, round(avg(x), 4) AS mean_of_ratios FROM k GROUP BY 1""")
def d26_mean_of_ratios(spark, d):
    k = published_segments(spark, d).groupBy("period", "cluster").agg(F.try_divide(F.sum("measure"), F.count(F.lit(1))).alias("x"))
    return k.groupBy("period").agg(F.count(F.lit(1)).alias("n_clusters"), F.round(F.avg("x"), 4).alias("mean_of_ratios"))


LEDGER = (("tier", "tier IN ('F', 'O')"), ("assigned", "period <> 'unassigned'"), ("realised", "coalesce(realised, '') <> ''"), ("duration", "dur > 0"))


def _ledger_sql() -> str:
    out = []
    for i, (name, _) in enumerate(LEDGER, 1):
        before = " AND ".join(e for _, e in LEDGER[: i - 1]) or "true"
        out.append(f"SELECT {i}::INT AS step, '{name}' AS rule, grp, count(*) FILTER ({before}) AS rows_before, count(*) FILTER ({before} AND {LEDGER[i - 1][1]}) AS rows_after FROM a GROUP BY grp")
    return f"WITH {UNITS_SQL} " + " UNION ALL ".join(out)


@query(_ledger_sql())
def d27_step_ledger(spark, d):
    return frame.ledger(assembled(spark, d), [(n, F.expr(e)) for n, e in LEDGER], "grp")


@query(f"""WITH {UNITS_SQL} SELECT period, count(*) AS n_total, count(*) FILTER (ok) AS n_judgeable FROM (SELECT *, length(trim(coalesce(realised, ''))) > 0 AND dur > 0 AS ok FROM a) GROUP BY period""")
def d28_before_filter(spark, d):
    a = assembled(spark, d).withColumn("ok", measures.judgeable_trimmed(F.col("realised"), F.col("dur")))
    return a.groupBy("period").agg(F.count(F.lit(1)).alias("n_total"), F.count_if("ok").alias("n_judgeable"))


@query("""SELECT l_partkey AS "value", count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""")
def f01_top_values(spark, d):
    return measures.top_values(tables.load(spark, d, "lineitem"), "l_partkey", 10)
