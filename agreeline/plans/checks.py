"""Queries: sources and sinks, relations, catalog checks, text scores, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from agreeline.functions import textscore
from agreeline.operators import catalog, measures, predict, relations
from agreeline.sources import tables
from agreeline.sources.shared import new_path
from agreeline.streaming import windows

from .bindings import UNITS_SQL, segments, units

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FINGERPRINTED = ["o_orderkey", "o_custkey", "o_orderstatus"]


_HASHED = ", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}, 'null')" for c in FINGERPRINTED)


@query(f"SELECT 'orders' AS name, count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', {_HASHED})), 1, 15))::UBIGINT::HUGEINT)::VARCHAR AS digest FROM orders")
def a09_fingerprint(spark, d):
    return tables.fingerprint(tables.load(spark, d, "orders", FINGERPRINTED), FINGERPRINTED, "orders")


INVENTORY = ["customer", "lineitem", "orders", "part"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns FROM {t}" for t in INVENTORY))
def a10_inventory(spark, d):
    return tables.inventory({t: tables.load(spark, d, t) for t in INVENTORY})


@query("""WITH p AS (SELECT doc_id AS id, lang AS v FROM documents), k AS (SELECT DISTINCT doc_id AS id FROM labels)
SELECT 'repeated' AS kind, id FROM p GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'blank', id FROM p WHERE trim(coalesce(v, '')) = '' UNION ALL SELECT 'unknown', id FROM p WHERE id NOT IN (SELECT id FROM k)""")
def a03_prediction_checks(spark, d):
    """All documents' languages as predictions for the labelled documents."""
    p = tables.load(spark, d, "documents", ["doc_id", "lang"]).select(F.col("doc_id").alias("id"), F.col("lang").alias("hyp"))
    return tables.violations(p, tables.load(spark, d, "labels").select(F.col("doc_id").alias("id")))


def _wide(u):
    return u.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if("ok").alias("n_judgeable"), F.count_if(F.col("ok") & F.col("match")).alias("n_match"), F.count_if(~F.col("ok")).alias("n_not_judgeable"),
        F.count_if(F.col("period") == "pre").alias("n_pre"), F.count_if(F.col("period") == "post").alias("n_post"), F.count_if(F.col("period") == "unassigned").alias("n_unassigned"),
    )


NAMES = ["n_total", "n_judgeable", "n_match", "n_not_judgeable", "n_pre", "n_post", "n_unassigned"]
WIDE_SQL = f"{UNITS_SQL}, w AS (SELECT count(*) AS n_total, count(*) FILTER (ok) AS n_judgeable, count(*) FILTER (ok AND match) AS n_match, count(*) FILTER (NOT ok) AS n_not_judgeable, count(*) FILTER (period = 'pre') AS n_pre, count(*) FILTER (period = 'post') AS n_post, count(*) FILTER (period = 'unassigned') AS n_unassigned FROM u)"


def _metrics(u):
    wide = catalog.derive(_wide(u), {"agree_all": ({"agree_share"}, lambda: 100 * F.col("agree_share")), "agree_share": (set(), lambda: catalog.quotient("agree_share", F.col("n_match"), "n_judgeable"))})
    rows = {n: (F.col(n), F.col("n_total"), "count") for n in NAMES}
    return tables.metric_rows(wide, rows | {n: (F.round(n, 6), F.col("n_judgeable"), "derived") for n in ("agree_share", "agree_all")})


METRIC_SQL = f"WITH {WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {n}::DOUBLE AS value, n_total AS n, 'count' AS route FROM w" for n in NAMES) + " UNION ALL SELECT 'agree_share', round(n_match::DOUBLE / n_judgeable, 6), n_judgeable, 'derived' FROM w UNION ALL SELECT 'agree_all', round(100 * (n_match::DOUBLE / n_judgeable), 6), n_judgeable, 'derived' FROM w"


@query(METRIC_SQL)
def a05_k01_metric_rows(spark, d):
    return _metrics(units(spark, d))


@query(f"WITH m AS ({METRIC_SQL}) SELECT name, CASE WHEN name LIKE 'n\\_%' ESCAPE '\\' THEN 'count' ELSE 'rate' END AS family, value AS base, CASE WHEN name LIKE 'n\\_%' ESCAPE '\\' THEN 2 * value ELSE value END AS other, true AS ok FROM m")
def j02_double(spark, d):
    u = units(spark, d)
    return relations.compare(_metrics(u), _metrics(relations.double(u, ["unit_segment", "segment", "cluster", "seg_cluster", "type"])), "double")


@query(f"WITH m AS ({METRIC_SQL}) SELECT 'permute' AS relation, count(*) AS compared, count(*) AS n_ok, 0::BIGINT AS n_exempt, true AS passed FROM m")
def j03_j07_permute(spark, d):
    u = units(spark, d)
    return relations.report(relations.compare(_metrics(u), _metrics(relations.permute(u, 7)), "permute"), "permute")


@query(f"WITH m AS ({METRIC_SQL}) SELECT 'exclude' AS relation, count(*) AS compared, count(*) AS n_ok, 0::BIGINT AS n_exempt, true AS passed FROM m")
def j04_exclude(spark, d):
    from agreeline.operators.frame import cascade
    from agreeline.plans.bindings import TIERS, clusters, raw_units

    t = cascade({"s": segments(spark, d).filter(F.col("tier").isin(TIERS)), "u": raw_units(spark, d)}, [("u", "unit_segment", "s", "segment")])
    u = t["u"].join(t["s"], F.col("unit_segment") == F.col("segment")).join(clusters(spark, d), F.col("seg_cluster") == F.col("cluster"))
    u = u.withColumns({"ok": measures.judgeable(F.col("realised"), F.col("dur")), "match": F.col("verdict").isin("exact_default", "exact_alt")})
    return relations.report(relations.compare(_metrics(units(spark, d)), _metrics(u), "exclude"), "exclude")


@query("""SELECT 'dup:' || o_orderkey AS o_orderkey, 'dup:' || o_custkey AS o_custkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus FROM orders""")
def g02_doubled(spark, d):
    return relations.double(tables.load(spark, d, "orders", FINGERPRINTED), ["o_orderkey", "o_custkey"])


@query(f"WITH {WIDE_SQL} SELECT 'parts' AS \"identity\", (n_judgeable + n_not_judgeable)::DOUBLE AS lhs, n_total::DOUBLE AS rhs, true AS ok FROM w UNION ALL SELECT 'periods', (n_pre + n_post)::DOUBLE, n_total::DOUBLE, n_unassigned = 0 FROM w UNION ALL SELECT 'three_terms', (n_pre + n_post + n_unassigned)::DOUBLE, n_total::DOUBLE, true FROM w")
def k04_identities(spark, d):
    return catalog.identities(_wide(units(spark, d)), {
        "parts": (F.col("n_judgeable") + F.col("n_not_judgeable"), F.col("n_total")), "periods": (F.col("n_pre") + F.col("n_post"), F.col("n_total")),
        "three_terms": (F.col("n_pre") + F.col("n_post") + F.col("n_unassigned"), F.col("n_total")),
    })


@query(f"WITH m AS ({METRIC_SQL}) SELECT name, n, n AS declared, true AS ok FROM m WHERE name IN ('n_pre', 'agree_share')")
def k03_declared_n(spark, d):
    u = units(spark, d)
    declared = _wide(u).select(F.explode(F.array(F.struct(F.lit("n_pre").alias("name"), F.col("n_total").alias("n")), F.struct(F.lit("agree_share").alias("name"), F.col("n_judgeable").alias("n")))).alias("x")).select("x.*")
    return catalog.declared_n(_metrics(u), declared)


@query(f"WITH m AS ({METRIC_SQL}) SELECT name, value AS value_one, value AS value_two, true AS ok FROM m WHERE route = 'count'")
def k05_k07_two_routes(spark, d):
    """The same counts by a SQL statement and by DataFrame operators."""
    u = units(spark, d)
    u.createOrReplaceTempView("published_units")
    sql = "SELECT count(*) AS n_total, count_if(ok) AS n_judgeable, count_if(ok AND match) AS n_match, count_if(NOT ok) AS n_not_judgeable, count_if(period = 'pre') AS n_pre, count_if(period = 'post') AS n_post, count_if(period = 'unassigned') AS n_unassigned FROM published_units"
    rows = {n: (F.col(n), F.col("n_total"), "count") for n in NAMES}
    return catalog.routes_agree(_metrics(u).filter("route = 'count'"), tables.metric_rows(spark.sql(sql), rows))


@query(f"WITH m AS ({METRIC_SQL}) SELECT name, value AS value_one, value AS value_two, true AS ok FROM m")
def k02_deterministic(spark, d):
    return catalog.deterministic(_metrics, units(spark, d))


PAIRS_SQL = "SELECT p_brand AS grp, p_name AS ref, p_type AS hyp FROM part"


@query(f"""WITH p AS ({PAIRS_SQL}), q AS (SELECT grp, regexp_replace(lower(ref), '[^a-z0-9]', '', 'g') AS r, regexp_replace(lower(hyp), '[^a-z0-9]', '', 'g') AS h FROM p)
SELECT grp, count(*) AS n_pairs, sum(levenshtein(r, h))::BIGINT AS edits, sum(length(r))::BIGINT AS n_ref, round(1000.0 * sum(levenshtein(r, h)) / sum(length(r)), 6) AS cer_pm FROM q GROUP BY grp""")
def l01_pooled_cer(spark, d):
    p = tables.load(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_name").alias("ref"), F.col("p_type").alias("hyp"))
    return textscore.character_error(p, "ref", "hyp", ["grp"])


WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:''+[a-z0-9]+)*')"


@query(f"""WITH RECURSIVE p AS (SELECT row_number() OVER () AS id, grp, {WORDS.format('ref')} AS r, {WORDS.format('hyp')} AS h FROM ({PAIRS_SQL})),
dp AS (
  SELECT id, 0::BIGINT AS i, range(0, len(h) + 1) AS cells FROM p
  UNION ALL
  SELECT id, i + 1, [list_min([CASE WHEN k = 0 THEN i + 1 ELSE least(cells[k + 1] + 1, cells[k] + (r[i + 1] <> h[k])::INT) END + j - k FOR k IN range(0, j + 1)]) FOR j IN range(0, len(h) + 1)]
  FROM dp JOIN p USING (id) WHERE i < len(r)
)
SELECT grp, count(*) AS n_pairs, sum(cells[len(h) + 1])::BIGINT AS edits, sum(len(r))::BIGINT AS n_ref, round(1000.0 * sum(cells[len(h) + 1])::BIGINT / sum(len(r))::BIGINT, 6) AS mer_pm FROM dp JOIN p USING (id) WHERE i = len(r) GROUP BY grp""")
def l02_l03_pooled_mer(spark, d):
    p = tables.load(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_name").alias("ref"), F.col("p_type").alias("hyp"))
    return textscore.mixed_error(p, "ref", "hyp", ["grp"])


def _turns(spark, d):
    t = tables.load(spark, d, "conversations", ["conv_id", "turn", "role"])
    return predict.sequences(t.withColumn("id", F.concat_ws(":", "conv_id", "turn")), "conv_id", "turn", "id", "role")


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS text, count(*) AS n, count(DISTINCT turn) = count(*) AS ordered FROM conversations GROUP BY conv_id")
def f03_m01_segment_texts(spark, d):
    return _turns(spark, d).select("conv_id", F.array_join("tokens", " ").alias("text"), F.size("tokens").cast("long").alias("n"), "ordered")


@query("SELECT concat_ws(':', conv_id::VARCHAR, turn::VARCHAR) AS id, left(role, 1) AS hyp FROM conversations")
def m02_m04_predictions(spark, d):
    # the labeller travels by value: workers needn't have this package
    label = lambda batch: [[(t or "")[:1] for t in tokens] for tokens in batch]
    return predict.by_unit(predict.predict(_turns(spark, d), "conv_id", label))


@query("SELECT event_type, epoch_ms(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start_ms, count(*) AS n, count(*) FILTER (value > 50) AS n_match FROM events GROUP BY ALL")
def s01_windowed_counts(spark, d):
    out = windows.windowed_counts(tables.load(spark, d, "events"), "ts", ["event_type"], "1 day", "1 hour", F.col("value") > 50)
    return out.select("event_type", (F.unix_millis(F.col("window.start").cast("timestamp"))).alias("start_ms"), "n", "n_match")


FLAGGED_SQL = "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'"


@query(f"""WITH RECURSIVE f AS ({FLAGGED_SQL}), e AS (SELECT DISTINCT 'part:' || a.l_partkey AS m, 'supplier:' || a.l_suppkey AS of FROM f a UNION SELECT DISTINCT 'part:' || b.l_partkey, 'part:' || a.l_partkey FROM f a JOIN f b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
r AS (SELECT 'supplier:' || s_suppkey AS metric FROM supplier WHERE s_acctbal < 0 UNION SELECT m FROM r JOIN e ON of = metric)
SELECT metric FROM r""")
def j06_exempt_closure(spark, d):
    """What is derived from suppliers in debt: parts that they returned, and parts next to such ones in an order."""
    f = tables.load(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag"]).filter("l_returnflag = 'R'")
    part = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    supplier = lambda c: F.concat(F.lit("supplier:"), F.col(c).cast("string"))
    before = f.select(part.alias("needs"), F.col("l_orderkey").alias("o"), (F.col("l_linenumber") + 1).alias("next"))
    beside = f.join(before, (F.col("l_orderkey") == F.col("o")) & (F.col("l_linenumber") == F.col("next"))).select(part.alias("metric"), "needs")
    needs = f.select(part.alias("metric"), supplier("l_suppkey").alias("needs")).union(beside)
    outside = tables.load(spark, d, "supplier", ["s_suppkey", "s_acctbal"]).filter("s_acctbal < 0").select(supplier("s_suppkey").alias("metric"))
    return relations.exempt_closure(outside, needs)


@query(f"""SELECT 'orders' AS name, count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws('|', {_HASHED})), 1, 15))::UBIGINT::HUGEINT)::VARCHAR AS digest FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'rest', count(*), sum(('0x' || substr(md5(concat_ws('|', {_HASHED})), 1, 15))::UBIGINT::HUGEINT)::VARCHAR FROM orders WHERE o_orderstatus = 'P'""")
def a07_committed_run(spark, d):
    """Two outputs written, recorded with declared counts, and read back through the record."""
    orders = tables.load(spark, d, "orders", FINGERPRINTED)
    outputs = {"orders": orders.filter("o_orderstatus <> 'P'"), "rest": orders.filter("o_orderstatus = 'P'")}
    n = orders.count()
    run = tables.RunRecord(spark, new_path(spark, "run"))
    run.write(outputs, expected={"orders": n, "rest": 0}, within={"orders": n // 2, "rest": n // 2})
    back = [tables.fingerprint(run.read(name), FINGERPRINTED, name) for name in outputs]
    return back[0].unionByName(back[1])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_nonnull, count(DISTINCT {c}) AS n_distinct, true AS near FROM orders" for c in ("o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey")))
def d23s_sketched_distinct(spark, d):
    """Exact distinct counts beside those of sketches, which are made by status and merged."""
    columns = ["o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey"]
    o = tables.load(spark, d, "orders", columns)
    sketches = measures.distinct_sketches(o.withColumn("by", F.col("o_orderstatus")), ["by"], columns)
    about = measures.merged_distinct(sketches, columns).select(F.col("column").alias("c"), "about")
    exact = measures.column_profile(o, columns)
    near = F.abs(F.col("about") - F.col("n_distinct")) <= F.ceil(measures.SKETCH_ERROR * F.col("n_distinct"))
    return exact.join(F.broadcast(about), F.col("column") == F.col("c")).select("column", "n_nonnull", "n_distinct", near.alias("near"))  # a row a column


@query("SELECT conv_id || ':' || turn AS id, role || row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || ':' || turn) AS hyp FROM conversations")
def f03s_streamed_labels(spark, d):
    """Each turn's label tells how many turns its conversation has had, however long conversations are."""

    def step(seen, roles):
        first = (seen or 0) + 1
        return first + len(roles) - 1, [f"{r}{n}" for n, r in enumerate(roles, first)]

    t = tables.load(spark, d, "conversations", ["conv_id", "turn", "role"]).withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return predict.streamed(t, "conv_id", "turn", "id", "role", step)


@query("SELECT doc_id::VARCHAR AS id, toxic::VARCHAR AS hyp FROM labels")
def a02_a08_predictions(spark, d):
    """Predictions written in order of their ids as JSON lines, and read back strictly."""
    path = new_path(spark, "predictions")
    tables.write_predictions(tables.load(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("string").alias("hyp")), path)
    return tables.read_predictions(spark, path)


@query("SELECT doc_id::VARCHAR AS id, text AS ref FROM documents WHERE regexp_matches(text, '[\\p{L}\\p{M}\\p{N}]')")
def a04_references(spark, d):
    """Texts with something to count, written as a reference set and read back strictly."""
    path = new_path(spark, "references")
    texts = tables.load(spark, d, "documents", ["doc_id", "text"]).filter(F.col("text").rlike(r"[\p{L}\p{M}\p{N}]"))
    texts.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("ref")).write.json(path)
    return tables.read_references(spark, path)
