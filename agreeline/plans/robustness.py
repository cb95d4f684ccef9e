"""Queries: medians, trims, order statistics, decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from agreeline.operators import decompose, measures, robust
from agreeline.sources import tables

from .bindings import SEGMENTS_SQL, UNITS_SQL, clusters, published_segments, units

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _assigned(spark, d):
    return published_segments(spark, d).filter("period <> 'unassigned'")


def _clusters(spark, d):
    return robust.cluster_means(_assigned(spark, d), ["cluster", "title"], "period", F.col("measure"))


MEANS_SQL = SEGMENTS_SQL + ", k AS (SELECT cluster, title, period, round(avg(measure), 6) AS score, count(measure) AS n, sum(measure) AS total FROM ps WHERE period <> 'unassigned' GROUP BY ALL)"


@query(f"WITH {SEGMENTS_SQL}, z AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY measure, segment) AS r, count(*) OVER (PARTITION BY period) AS n FROM ps WHERE measure IS NOT NULL) "
       "SELECT period, round(avg(measure), 6) AS median, max(n) AS n FROM z WHERE r = (n + 1) // 2 OR r = (n + 2) // 2 GROUP BY period")
def e01_ranked_median(spark, d):
    return robust.ranked_median(published_segments(spark, d), "period", "measure")


@query(f"WITH {MEANS_SQL} SELECT period, count(*) AS n_clusters, round(quantile_cont(score, 0.5), 6) AS median FROM k GROUP BY period")
def e02_cluster_medians(spark, d):
    return robust.median_by(_clusters(spark, d), "period")


@query(f"WITH {MEANS_SQL}, m AS (SELECT period, quantile_cont(score, 0.5) AS x FROM k GROUP BY period) SELECT round(max(x) FILTER (period = 'post') - max(x) FILTER (period = 'pre'), 3) AS gap FROM m")
def e02_median_gap(spark, d):
    return robust.gap(robust.median_by(_clusters(spark, d), "period"), "period", "median")


def _trim_sql(score: str) -> str:
    return f"""WITH {SEGMENTS_SQL}, p AS (SELECT * FROM ps WHERE period <> 'unassigned'), k AS (SELECT cluster, title, round({score}, 6) AS score FROM p GROUP BY ALL),
z AS (SELECT *, row_number() OVER (ORDER BY score, title, cluster) AS r, count(*) OVER () AS g FROM k), t AS (SELECT *, CASE WHEN g < 2 THEN 0 WHEN g < 20 THEN 1 ELSE floor(0.05 * g) END AS cut FROM z),
x AS (SELECT p.* FROM p JOIN t USING (cluster) WHERE r > cut AND r <= g - cut)
SELECT count(*) AS n_segments, count(DISTINCT cluster) AS n_clusters, round(avg(measure) FILTER (period = 'post') - avg(measure) FILTER (period = 'pre'), 3) AS gap,
  round(1000 * (avg(flag) FILTER (period = 'post') - avg(flag) FILTER (period = 'pre')), 3) AS flag_gap_pm FROM x"""


def _trim(spark, d, score):
    p = _assigned(spark, d)
    kept = robust.trimmed(p.groupBy("cluster", "title").agg(F.round(score, 6).alias("score")), ["score", "title", "cluster"]).select(F.col("cluster").alias("k"))
    x = p.join(kept, F.col("cluster") == F.col("k"))
    at = lambda c, q: F.avg(F.when(F.col("period") == q, F.col(c)))
    return x.agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_distinct("cluster").alias("n_clusters"), F.round(at("measure", "post") - at("measure", "pre"), 3).alias("gap"),
        F.round(1000 * (at("flag", "post") - at("flag", "pre")), 3).alias("flag_gap_pm"),
    )


@query(_trim_sql("avg(measure)"))
def e03_trim_gap(spark, d):
    return _trim(spark, d, F.avg("measure"))


@query(_trim_sql("1000.0 * sum(flag) / count(*)"))
def e04_trim_by_flag(spark, d):
    return _trim(spark, d, 1000.0 * F.sum("flag") / F.count(F.lit(1)))


def _quantile_sql(p: float, name: str) -> str:
    at = f"greatest(1.0::DOUBLE, least(n::DOUBLE, {p}::DOUBLE * (n + 1)))"
    return f"round(sum(CASE WHEN r = floor({at}) THEN v * (1 - ({at} - floor({at}))) WHEN r = floor({at}) + 1 THEN v * ({at} - floor({at})) END), 6) AS {name}"


@query("WITH z AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, "
       + ", ".join(_quantile_sql(p, n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))) + " FROM z GROUP BY 1")
def e05_order_statistics(spark, d):
    return robust.quantiles_np1(tables.load(spark, d, "events"), "event_type", "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})


@query("WITH z AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL), q AS (SELECT event_type AS e, "
       + ", ".join(_quantile_sql(p, n) for n, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))) + " FROM z GROUP BY 1) SELECT event_type, count(value) AS n_nonnull, count(DISTINCT value) AS n_distinct, round(min(value), 6) AS min, max(p25) AS p25, max(median) AS median, max(p75) AS p75, "
       "round(max(value), 6) AS max, count(DISTINCT value) <= 1 AS constant FROM events LEFT JOIN q ON event_type = e GROUP BY 1")
def e06_profile(spark, d):
    return robust.profile(tables.load(spark, d, "events"), "event_type", "value")


@query(f"""WITH {MEANS_SQL}, m AS (SELECT period, round(quantile_cont(score, 0.5), 6) AS x FROM k GROUP BY period), md AS (SELECT round(max(x) FILTER (period = 'post') - max(x) FILTER (period = 'pre'), 3) AS median FROM m),
rw AS (SELECT round(avg(measure) FILTER (period = 'post') - avg(measure) FILTER (period = 'pre'), 3) AS row FROM ps), tr AS ({_trim_sql("avg(measure)")})
SELECT row, median, tr.gap AS trim, sign(row) <> sign(median) OR sign(row) <> sign(gap) OR sign(median) <> sign(gap) OR abs(row) > 2 * abs(median) OR abs(median) > 2 * abs(row) OR abs(row) > 2 * abs(gap) OR abs(gap) > 2 * abs(row)
  OR abs(median) > 2 * abs(gap) OR abs(gap) > 2 * abs(median) AS inconclusive FROM rw, md, tr""")
def e07_triptych(spark, d):
    one = measures.mean_gap(_assigned(spark, d), "period", "measure", 1.0).select(F.col("gap").alias("row"))
    two = e02_median_gap(spark, d).select(F.col("gap").alias("median"))
    three = e03_trim_gap(spark, d).select(F.col("gap").alias("trim"))
    return robust.triptych(one.crossJoin(two).crossJoin(three))  # three single rows


@query(f"WITH {SEGMENTS_SQL} SELECT segment, row_number() OVER (ORDER BY measure, title, segment) AS rank FROM ps")
def f04_total_order(spark, d):
    return robust.total_order(published_segments(spark, d).select("segment", "measure", "title"), ["measure", "title", "segment"]).select("segment", F.col("rank").cast("long").alias("rank"))


CELLS_SQL = UNITS_SQL + """, cells AS (SELECT cg.cluster, cg.grp, p.period, coalesce(n_judgeable, 0)::BIGINT AS n_judgeable, coalesce(n_match, 0)::BIGINT AS n_match
  FROM cg CROSS JOIN (VALUES ('pre'), ('post')) p(period) LEFT JOIN (SELECT cluster, period, sum(ok::INT) AS n_judgeable, sum((ok AND match)::INT) AS n_match FROM u GROUP BY 1, 2) x ON cg.cluster = x.cluster AND p.period = x.period)"""


def cells(spark, d):
    base = clusters(spark, d).select("cluster", "grp").withColumn("period", F.explode(F.array(F.lit("pre"), F.lit("post"))))
    return decompose.cluster_cells(base, units(spark, d), ["cluster", "period"], {"n_judgeable": F.col("ok"), "n_match": F.col("ok") & F.col("match")})


@query(f"WITH {CELLS_SQL} SELECT * FROM cells")
def d14_cluster_cells(spark, d):
    return cells(spark, d).select("cluster", "grp", "period", "n_judgeable", "n_match")


@query(f"""WITH {SEGMENTS_SQL} SELECT cluster, period, count(*) AS n, sum(flag)::BIGINT AS n_flag, round(sum(measure), 4) AS total FROM ps GROUP BY ALL""")
def d15_cluster_matrix(spark, d):
    return published_segments(spark, d).groupBy("cluster", "period").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("n_flag"), F.round(F.sum("measure"), 4).alias("total"))


@query(f"WITH {CELLS_SQL} SELECT grp, period, count(*) AS n_clusters, count(*) FILTER (n_judgeable > 0) AS n_with_any, sum(n_judgeable)::BIGINT AS n_judgeable, sum(n_match)::BIGINT AS n_match FROM cells GROUP BY ALL")
def d16_stratum_sums(spark, d):
    return decompose.stratum_sums(cells(spark, d), ["grp", "period"], ["n_judgeable", "n_match"], "n_judgeable")


@query(f"""WITH {CELLS_SQL}, g AS (SELECT grp, sum(n_judgeable) FILTER (period = 'pre')::DOUBLE AS n0, sum(n_judgeable) FILTER (period = 'post')::DOUBLE AS n1, sum(n_match) FILTER (period = 'pre')::DOUBLE AS k0, sum(n_match) FILTER (period = 'post')::DOUBLE AS k1 FROM cells GROUP BY grp),
t AS (SELECT sum(k0) / sum(n0) AS pre, sum(k1) / sum(n1) AS post, sum(n0 * k1 / n1) / sum(n0) AS cf FROM g) SELECT round(100 * (pre - post), 6) AS unadjusted, round(100 * (pre - cf), 6) AS residual, round(100 * (cf - post), 6) AS explained FROM t""")
def i01_kitagawa(spark, d):
    return decompose.kitagawa(cells(spark, d), [], "grp", "period", "n_judgeable", "n_match")
