"""Queries: cluster bootstraps, intervals, p values, verdicts, readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from agreeline.operators import decompose, measures, resample
from agreeline.operators import readers as rd
from agreeline.sources import tables
from agreeline.sources.shared import cut, cut_spread

from .bindings import CLASSES, READERS_SQL, UNITS_SQL, clusters, published_segments, readers, units
from .robustness import CELLS_SQL, cells

QUERIES, ORACLES = {}, {}
DRAWS, SEED = 2000, 20250918
#: Clusters are drawn one by one, as the SQL does; ``poisson`` is the way for very many clusters.
SCHEME = "drawn"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _seed_sql(stratum: str) -> str:
    return f"('0x' || substr(sha256('{SEED}:' || {stratum}), 1, 8))::UBIGINT::VARCHAR"


def _draws_sql(cells: str, key: str, stratum: str, sums: list[str]) -> str:
    return f"""ix AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {key}) - 1 AS i, count(*) OVER (PARTITION BY {stratum}) AS g FROM {cells}),
sz AS (SELECT DISTINCT {stratum} AS st, g, {_seed_sql(stratum)} AS sd FROM ix), dr AS (SELECT st, b, (('0x' || substr(md5(concat_ws(':', sd, b::VARCHAR, (k // 4)::VARCHAR)), 1 + 8 * (k % 4)::INT, 8))::UBIGINT % g::UBIGINT)::BIGINT AS j
  FROM (SELECT st, sd, g, b, unnest(range(g)) AS k FROM sz, range({DRAWS}) t(b))),
bs AS (SELECT b, {stratum}, min(g) AS g, {', '.join(f'sum({s})::BIGINT AS {s}' for s in sums)} FROM dr JOIN ix ON st = {stratum} AND j = i GROUP BY b, {stratum})"""


def _interval_sql(value: str, table: str, by: str = "", observed: str = "obs") -> str:
    """Intervals, and the tail of the replicates on the other side of 0 than the observed value."""
    return f"""SELECT {by + ',' if by else ''} count({value}) AS n_rounds, round(quantile_cont({value}, 0.025), 6) AS low, round(quantile_cont({value}, 0.975), 6) AS high,
round(least(1.0, 2 * least(avg(({value} > 0)::INT), avg(({value} < 0)::INT))), 6) AS p, round(max({observed}), 6) AS observed,
round(least(1.0, 2 * CASE WHEN max({observed}) >= 0 THEN avg(({value} <= 0)::INT) ELSE avg(({value} >= 0)::INT) END), 6) AS p_opposite, min(g) AS n_clusters FROM {table} {'GROUP BY ' + by if by else ''}"""


def _with_observed(replicates, point, by: list[str], name: str):
    """Replicates with the observed value of the same statistic, one row for each of ``by``."""
    one = point.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(name).alias("obs"))
    if not by:
        return replicates.crossJoin(F.broadcast(one))  # a single row
    return replicates.join(F.broadcast(one), F.col(by[0]) == F.col(f"_{by[0]}")).drop(f"_{by[0]}")  # as many rows as classes


BOOT_SQL = f"{CELLS_SQL}, {_draws_sql('cells', 'cluster', 'period', ['n_judgeable', 'n_match'])}"
GAP = "100 * (max(k) FILTER (period = 'pre') - max(k) FILTER (period = 'post'))"


def _boot(spark, d):
    return resample.bootstrap_sums(cells(spark, d), "period", "cluster", ["n_judgeable", "n_match"], DRAWS, SEED, "n_clusters")


def _gap_of(sums):
    at = lambda p: F.max(F.when(F.col("period") == p, F.try_divide(F.col("n_match").cast("double"), F.col("n_judgeable").cast("double"))))
    return sums.groupBy("b").agg((100 * (at("pre") - at("post"))).alias("gap"), F.min("n_clusters").alias("n_clusters"))


@query(f"WITH {BOOT_SQL} SELECT b::INT AS b, period, n_judgeable, n_match FROM bs")
def i03_bootstrap_sums(spark, d):
    return _boot(spark, d).select("b", "period", "n_judgeable", "n_match")


POINT_SQL = f"(SELECT {GAP} AS obs FROM (SELECT period, sum(n_match)::DOUBLE / nullif(sum(n_judgeable), 0) AS k FROM cells GROUP BY period))"


@query(f"""WITH {BOOT_SQL}, gp AS (SELECT b, {GAP} AS gap, min(g) AS g FROM (SELECT b, g, period, n_match::DOUBLE / n_judgeable AS k FROM bs) GROUP BY b), iv AS ({_interval_sql("gap", f"(SELECT * FROM gp, {POINT_SQL})")})
SELECT * EXCLUDE n_clusters, CASE WHEN n_clusters < 10 THEN 'inconclusive' WHEN low > 0 THEN 'gap_above_0' WHEN high < 0 THEN 'gap_below_0' ELSE 'consistent_with_0' END AS verdict FROM iv""")
def i04_i08_gap_interval(spark, d):
    c = cut_spread(cells(spark, d))
    gaps = _gap_of(resample.resampled_sums(c, "period", "cluster", ["n_judgeable", "n_match"], DRAWS, SEED, SCHEME, "n_clusters"))
    point = _gap_of(c.groupBy("period").agg(F.lit(0).alias("b"), F.sum("n_judgeable").alias("n_judgeable"), F.sum("n_match").alias("n_match"), F.lit(0).alias("n_clusters")))
    out = resample.interval(_with_observed(gaps, point, [], "gap"), [], "gap", "obs", "n_clusters")
    return out.withColumn("verdict", resample.verdict(F.col("low"), F.col("high"), resample.enough(F.col("n_clusters")))).drop("n_clusters")


POISSON_SQL = " + ".join(f"(h >= {p!r}::DOUBLE)::INT" for p in resample.POISSON)


@query(f"""WITH {CELLS_SQL}, w AS (SELECT b, period, n_judgeable, n_match, ('0x' || substr(md5(concat_ws(':', {_seed_sql('period')}, b::VARCHAR, cluster::VARCHAR)), 1, 13))::UBIGINT / 4503599627370496.0::DOUBLE AS h FROM cells, range({DRAWS}) t(b))
SELECT b::INT AS b, period, sum(n_judgeable * ({POISSON_SQL}))::BIGINT AS n_judgeable, sum(n_match * ({POISSON_SQL}))::BIGINT AS n_match FROM w GROUP BY ALL""")
def i03p_poisson_sums(spark, d):
    return resample.poisson_sums(cells(spark, d), "period", "cluster", ["n_judgeable", "n_match"], DRAWS, SEED).select("b", "period", "n_judgeable", "n_match")


@query(f"""WITH {CELLS_SQL}, st AS (SELECT *, grp || '_' || period AS stratum FROM cells), {_draws_sql('st', 'cluster', 'stratum', ['n_judgeable', 'n_match'])},
x AS (SELECT b, split_part(stratum, '_', 1) AS grp, split_part(stratum, '_', 2) AS period, n_judgeable::DOUBLE AS n, n_match::DOUBLE AS k FROM bs),
g AS (SELECT b, grp, sum(n) FILTER (period = 'pre') AS n0, sum(n) FILTER (period = 'post') AS n1, sum(k) FILTER (period = 'pre') AS k0, sum(k) FILTER (period = 'post') AS k1 FROM x GROUP BY ALL),
t AS (SELECT b, sum(k0) / sum(n0) AS pre, sum(k1) / sum(n1) AS post, sum(n0 * k1 / n1) / sum(n0) AS cf FROM g GROUP BY b),
v AS (SELECT round(100 * (pre - post), 6) AS unadjusted, round(100 * (pre - cf), 6) AS residual, round(100 * (cf - post), 6) AS explained FROM t)
SELECT 'unadjusted' AS part, round(quantile_cont(unadjusted, 0.025), 6) AS low, round(quantile_cont(unadjusted, 0.975), 6) AS high FROM v UNION ALL
SELECT 'residual', round(quantile_cont(residual, 0.025), 6), round(quantile_cont(residual, 0.975), 6) FROM v UNION ALL SELECT 'explained', round(quantile_cont(explained, 0.025), 6), round(quantile_cont(explained, 0.975), 6) FROM v""")
def i09_decomposition_bootstrap(spark, d):
    st = cells(spark, d).withColumn("stratum", F.concat_ws("_", "grp", "period"))
    sums = resample.resampled_sums(st, "stratum", "cluster", ["n_judgeable", "n_match"], DRAWS, SEED, SCHEME)
    sums = sums.withColumns({"grp": F.split("stratum", "_")[0], "period": F.split("stratum", "_")[1]})
    parts = decompose.kitagawa(sums, ["b"], "grp", "period", "n_judgeable", "n_match")
    long = parts.unpivot("b", ["unadjusted", "residual", "explained"], "part", "v")
    return long.groupBy("part").agg(F.round(F.percentile("v", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("v", F.lit(0.975)), 6).alias("high"))


KINDS = [*CLASSES[:2], "exact_alt"]
CLASS_CELLS = ", ".join(f"coalesce(sum((ok AND verdict = '{c}')::INT), 0)::BIGINT AS n_{c}" for c in KINDS)
#: Every cluster in both periods: those without a unit there stay, with sums of 0.
BASE_SQL = "(SELECT cg.cluster, p.period FROM cg CROSS JOIN (VALUES ('pre'), ('post')) p(period))"


def _base(spark, d):
    return clusters(spark, d).select("cluster").withColumn("period", F.explode(F.array(F.lit("pre"), F.lit("post"))))


def _at(period, value):
    return F.max(F.when(F.col("period") == period, F.col(value)))


def _ratio(above, below):
    """A quotient of two columns as doubles, null where the second is 0."""
    above, below = (F.col(c) if isinstance(c, str) else c for c in (above, below))
    return F.try_divide(above.cast("double"), below.cast("double"))


def _each(df, name, rows):
    """``df`` with a row for each of ``rows``, which has its columns by its name."""
    one = [F.struct(F.lit(k).alias(name), *[v.alias(c) for c, v in columns.items()]) for k, columns in rows.items()]
    return df.select("*", F.explode(F.array(*one)).alias("_z")).select("*", "_z.*").drop("_z")


def _post_less_pre(value, unit=1):
    return (unit * (_at("post", value) - _at("pre", value))).alias("gap")


@query(f"""WITH {UNITS_SQL}, k AS (SELECT base.cluster, base.period, coalesce(sum(ok::INT), 0)::BIGINT AS n, {CLASS_CELLS} FROM {BASE_SQL} base LEFT JOIN u ON u.cluster = base.cluster AND u.period = base.period GROUP BY ALL), {_draws_sql('k', 'cluster', 'period', ['n', *(f'n_{c}' for c in KINDS)])},
l AS ({' UNION ALL '.join(f"SELECT b, g, period, '{c}' AS class, n_{c}::DOUBLE / nullif(n, 0) AS x FROM bs" for c in KINDS)}),
gp AS (SELECT b, class, min(g) AS g, 1000 * (max(x) FILTER (period = 'post') - max(x) FILTER (period = 'pre')) AS gap FROM l GROUP BY b, class),
pt AS (SELECT class, 1000 * (max(x) FILTER (period = 'post') - max(x) FILTER (period = 'pre')) AS obs FROM ({' UNION ALL '.join(f"SELECT period, '{c}' AS class, sum(n_{c})::DOUBLE / nullif(sum(n), 0) AS x FROM k GROUP BY period" for c in KINDS)}) GROUP BY class),
iv AS ({_interval_sql("gap", "(SELECT * FROM gp JOIN pt USING (class))", "class")}),
rk AS (SELECT *, row_number() OVER (ORDER BY p_opposite, class) AS r FROM iv), bh AS (SELECT *, p_opposite * 3 / r AS x FROM rk)
SELECT class, n_rounds, low, high, p, observed, p_opposite, round(least(1.0, min(x) OVER (ORDER BY p_opposite DESC, class DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_bh, CASE WHEN n_clusters < 10 THEN 'inconclusive' ELSE 'estimated' END AS conclusion FROM bh""")
def i10_class_gaps_bh(spark, d):
    counts = {"n": F.col("ok"), **{f"n_{c}": F.col("ok") & (F.col("verdict") == c) for c in KINDS}}
    k = cut_spread(decompose.cluster_cells(_base(spark, d), units(spark, d), ["cluster", "period"], counts))
    shares = {c: {"x": _ratio(f"n_{c}", "n")} for c in KINDS}
    sums = resample.resampled_sums(k, "period", "cluster", [*counts], DRAWS, SEED, SCHEME, "n_clusters")
    gap = _post_less_pre("x", 1000)
    gaps = _each(sums, "class", shares).groupBy("b", "class").agg(gap, F.min("n_clusters").alias("n_clusters"))
    observed = k.groupBy("period").agg(*[F.sum(c).alias(c) for c in counts])
    point = _each(observed, "class", shares).groupBy("class").agg(gap)
    out = resample.interval(_with_observed(gaps, point, ["class"], "gap"), ["class"], "gap", "obs", "n_clusters")
    out = resample.benjamini_hochberg(out, "class", "p_opposite", len(KINDS))
    return out.withColumn("conclusion", resample.conclusion(F.col("n_clusters"))).drop("n_clusters")


@query(f"""WITH {UNITS_SQL}, k AS (SELECT base.cluster, base.period, count(ps.segment) AS n, coalesce(sum(flag), 0)::BIGINT AS n_flag, coalesce(sum(round(100 * measure)::BIGINT), 0)::BIGINT AS total FROM {BASE_SQL} base LEFT JOIN ps ON ps.cluster = base.cluster AND ps.period = base.period GROUP BY ALL), {_draws_sql('k', 'cluster', 'period', ['n', 'n_flag', 'total'])},
l AS (SELECT b, g, period, 'flag_pm' AS rate, 1000 * n_flag::DOUBLE / nullif(n, 0) AS x FROM bs UNION ALL SELECT b, g, period, 'measure', total::DOUBLE / 100 / nullif(n, 0) FROM bs),
gp AS (SELECT b, rate, min(g) AS g, max(x) FILTER (period = 'post') - max(x) FILTER (period = 'pre') AS gap FROM l GROUP BY b, rate),
pt AS (SELECT rate, max(x) FILTER (period = 'post') - max(x) FILTER (period = 'pre') AS obs FROM (SELECT period, 'flag_pm' AS rate, 1000 * sum(n_flag)::DOUBLE / nullif(sum(n), 0) AS x FROM k GROUP BY period UNION ALL SELECT period, 'measure', sum(total)::DOUBLE / 100 / nullif(sum(n), 0) FROM k GROUP BY period) GROUP BY rate),
iv AS ({_interval_sql("gap", "(SELECT * FROM gp JOIN pt USING (rate))", "rate")}),
rk AS (SELECT *, row_number() OVER (ORDER BY p_opposite, rate) AS r FROM iv), bh AS (SELECT *, p_opposite * 2 / r AS x FROM rk)
SELECT rate, n_rounds, low, high, p, observed, p_opposite, round(least(1.0, min(x) OVER (ORDER BY p_opposite DESC, rate DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_bh, CASE WHEN n_clusters < 10 THEN 'inconclusive' ELSE 'estimated' END AS conclusion FROM bh""")
def i11_flag_gap_bootstrap(spark, d):
    """A flag's rate and a measure's mean (added up in hundredths, so that sums are exact)."""
    counts = {"n": F.lit(1), "n_flag": F.col("flag"), "total": F.round(100 * F.col("measure"))}
    k = cut_spread(decompose.cluster_cells(_base(spark, d), published_segments(spark, d), ["cluster", "period"], counts))
    rates = {"flag_pm": {"x": 1000 * _ratio("n_flag", "n")}, "measure": {"x": _ratio(F.col("total").cast("double") / 100, "n")}}
    sums = resample.resampled_sums(k, "period", "cluster", [*counts], DRAWS, SEED, SCHEME, "n_clusters")
    gap = _post_less_pre("x")
    gaps = _each(sums, "rate", rates).groupBy("b", "rate").agg(gap, F.min("n_clusters").alias("n_clusters"))
    observed = k.groupBy("period").agg(*[F.sum(c).alias(c) for c in counts])
    point = _each(observed, "rate", rates).groupBy("rate").agg(gap)
    out = resample.interval(_with_observed(gaps, point, ["rate"], "gap"), ["rate"], "gap", "obs", "n_clusters")
    out = resample.benjamini_hochberg(out, "rate", "p_opposite", 2)
    return out.withColumn("conclusion", resample.conclusion(F.col("n_clusters"))).drop("n_clusters")


MAIN = "(a <> b OR b <> c OR a <> c)"


@query()
def i12_reader_gap_bootstrap(spark, d):
    r = readers(spark, d).filter(rd.differs(["a", "b", "c"]))
    names = {"a": "m_a", "b": "m_b", "c": "m_c", "base": "m_base"}
    hits = [F.sum((F.col(x) == F.col("target")).cast("long")).alias(m) for x, m in names.items()]
    k = cut_spread(r.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *hits).withColumn("stratum", F.lit("all")))
    sums = cut(resample.resampled_sums(k, "stratum", "cluster", ["n", *names.values()], DRAWS, SEED, SCHEME, "n_clusters"))  # two intervals read it
    more = lambda x: F.col(f"m_{x}") - F.col("m_base")
    gaps = {x: {"gap": 1000 * _ratio(more(x), "n"), "rel": _ratio(more(x), "m_base")} for x in "abc"}
    point = _each(k.agg(*[F.sum(c).alias(c) for c in ("n", *names.values())]), "reader", gaps)
    replicates = _each(sums, "reader", gaps).select("n_clusters", "reader", "gap", "rel")
    long = _with_observed(replicates, point, ["reader"], "gap")
    out = resample.interval(long, ["reader"], "gap", "obs", "n_clusters")
    rel = resample.interval(long, ["reader"], "rel").select(F.col("reader").alias("r"), F.col("low").alias("rel_low"), F.col("high").alias("rel_high"), F.col("n_rounds").alias("n_comparable"))
    ratio = point.select(F.col("reader").alias("q"), F.col("rel").alias("ratio"))
    out = out.join(rel, F.col("reader") == F.col("r")).join(ratio, F.col("reader") == F.col("q"))
    one, two = resample.away(F.col("low"), F.col("high")), resample.away(F.col("rel_low"), F.col("rel_high"))
    out = out.withColumn("verdict", resample.verdict(F.col("low"), F.col("high"), resample.enough(F.col("n_clusters"))))
    out = out.withColumn("sign_flip", resample.sign_flip(F.col("observed"), F.col("ratio")))
    return out.withColumn("conclusion_flip", F.col("sign_flip") | (one != two)).drop("n_clusters", "r", "q", "ratio")


ORACLES["i12_reader_gap_bootstrap"] = f"""WITH {READERS_SQL}, k AS (SELECT cluster, 'all' AS stratum, count(*) AS n, sum((a = target)::INT)::BIGINT AS m_a, sum((b = target)::INT)::BIGINT AS m_b, sum((c = target)::INT)::BIGINT AS m_c, sum((base = target)::INT)::BIGINT AS m_base FROM rd WHERE {MAIN} GROUP BY cluster),
{_draws_sql('k', 'cluster', 'stratum', ['n', 'm_a', 'm_b', 'm_c', 'm_base'])},
gp AS ({' UNION ALL '.join(f"SELECT '{r}' AS reader, g, 1000 * ((m_{r} - m_base)::DOUBLE / n) AS gap, (m_{r} - m_base)::DOUBLE / nullif(m_base, 0) AS rel FROM bs" for r in 'abc')}),
pt AS ({' UNION ALL '.join(f"SELECT '{r}' AS reader, 1000 * (sum(m_{r} - m_base)::DOUBLE / sum(n)) AS obs, sum(m_{r} - m_base)::DOUBLE / nullif(sum(m_base), 0) AS ratio FROM k" for r in 'abc')}),
iv AS ({_interval_sql("gap", "(SELECT * FROM gp JOIN pt USING (reader))", "reader")}), rl AS (SELECT reader, count(rel) AS n_comparable, round(quantile_cont(rel, 0.025), 6) AS rel_low, round(quantile_cont(rel, 0.975), 6) AS rel_high FROM gp GROUP BY reader),
v AS (SELECT *, ratio IS NULL OR sign(observed) <> sign(ratio) AS sign_flip, coalesce(low > 0 OR high < 0, false) AS one, coalesce(rel_low > 0 OR rel_high < 0, false) AS two FROM iv JOIN rl USING (reader) JOIN pt USING (reader))
SELECT reader, n_rounds, low, high, p, observed, p_opposite, n_comparable, rel_low, rel_high, CASE WHEN n_clusters < 10 THEN 'inconclusive' WHEN low > 0 THEN 'gap_above_0' WHEN high < 0 THEN 'gap_below_0' ELSE 'consistent_with_0' END AS verdict,
  sign_flip, sign_flip OR one <> two AS conclusion_flip FROM v"""


@query(f"WITH {READERS_SQL} SELECT {MAIN} AS main, count(*) AS n FROM rd GROUP BY 1")
def b13_main_and_control(spark, d):
    return readers(spark, d).groupBy(rd.differs(["a", "b", "c"]).alias("main")).agg(F.count(F.lit(1)).alias("n"))


def _reader_sql(where: str) -> str:
    return f"WITH {READERS_SQL} " + " UNION ALL ".join(
        f"SELECT '{r}' AS reader, count(*) AS n, count(*) FILTER ({r} = target) AS n_match, round(1000.0 * count(*) FILTER ({r} = target) / count(*), 6) AS agree_pm, round(1000.0 * (count(*) FILTER ({r} = target) - count(*) FILTER (base = target)) / count(*), 6) AS gap_pm FROM rd WHERE {where}"
        for r in "abc"
    )


@query(_reader_sql(MAIN))
def d24_reader_gaps(spark, d):
    return rd.agreement_gaps(readers(spark, d).filter(rd.differs(["a", "b", "c"])), ["a", "b", "c"], "base", "target")


@query(_reader_sql("a <> base"))
def b14_pair_subset(spark, d):
    return rd.agreement_gaps(readers(spark, d).filter("a <> base"), ["a", "b", "c"], "base", "target")


@query(f"WITH {READERS_SQL} SELECT (a <> b)::INT AS a_b, (a <> c)::INT AS a_c, (b <> c)::INT AS b_c, count(*) AS n FROM rd GROUP BY ALL")
def d21_patterns(spark, d):
    return rd.disagreement_patterns(readers(spark, d), ["a", "b", "c"])


@query(f"WITH {READERS_SQL} SELECT type, count(*) AS n, count(*) FILTER (a <> b) AS a_b, count(*) FILTER (a <> c) AS a_c, count(*) FILTER (b <> c) AS b_c FROM rd GROUP BY type")
def d22_type_disagreement(spark, d):
    return rd.type_disagreement(readers(spark, d), "type", ["a", "b", "c"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_nonnull, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS constant FROM orders" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")))
def d23_distinct(spark, d):
    return measures.column_profile(tables.load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])
