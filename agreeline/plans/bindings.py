"""The given tables in the roles of clusters, segments and units, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agreeline.operators import frame, labels, measures
from agreeline.sources.tables import load

PRE, POST = 1997, 1999
MARKERS = ["MACH", "BUILD"]
TIERS = ["F", "O"]
RARE_BELOW = 25
AGREE = ("exact_default", "exact_alt")
CLASSES = ("tone", "segment", "diff")


def clusters(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_name"])
    c = c.select(F.col("c_custkey").alias("cluster"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("title"))
    return c.withColumn("grp", labels.keyword_group(F.col("title"), MARKERS))


def segments(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    o = o.select(
        F.col("o_orderkey").alias("segment"), F.col("o_custkey").alias("seg_cluster"), F.col("o_orderstatus").alias("tier"), F.col("o_totalprice").alias("measure"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("flag"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"),
    )
    return o.withColumn("period", labels.period(F.col("day"), PRE, POST))


def raw_units(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("unit_segment"), F.col("l_partkey").alias("type"), n.alias("pos"), F.nullif("l_returnflag", F.lit("N")).alias("realised"), (F.col("l_quantity") - 5).alias("dur"),
        F.when(n <= 4, "exact_default").when(n == 5, "exact_alt").when(n == 6, "tone").otherwise("segment").alias("verdict"), "l_linestatus", "l_returnflag",
    )


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """Units with their segment's and cluster's columns, all tiers."""
    u, s, c = raw_units(spark, d), segments(spark, d), clusters(spark, d)
    return u.join(s, u["unit_segment"] == s["segment"]).join(c, F.col("seg_cluster") == c["cluster"])


def units(spark: SparkSession, d: str) -> DataFrame:
    """Published units with ok (judgeable) and match."""
    f = frame.published(assembled(spark, d), "tier", TIERS)
    return f.withColumns({"ok": measures.judgeable(F.col("realised"), F.col("dur")), "match": F.col("verdict").isin(*AGREE)})


def published_segments(spark: SparkSession, d: str) -> DataFrame:
    s, c = frame.published(segments(spark, d), "tier", TIERS), clusters(spark, d)
    return s.join(c, s["seg_cluster"] == c["cluster"])


def reader_columns() -> list:
    """Three readers of each assembled unit, the target and the baseline."""
    c = F.when(F.col("l_returnflag") == "R", "F").when(F.col("l_returnflag") == "N", "O").when(F.col("l_returnflag") == "A", "P")
    target = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("type") % 3 + 1).cast("int"))
    return ["cluster", "period", "type", F.col("l_linestatus").alias("a"), F.col("tier").alias("b"), c.alias("c"), F.lit("O").alias("base"), target.alias("target")]


def readers(spark: SparkSession, d: str) -> DataFrame:
    return assembled(spark, d).select(*reader_columns())


SEGMENTS_SQL = """
s AS (SELECT o_orderkey AS segment, o_custkey AS seg_cluster, o_orderstatus AS tier, o_totalprice AS measure, (o_orderpriority = '1-URGENT')::INT AS flag, strftime(o_orderdate, '%Y%m%d') AS day,
  CASE WHEN year(o_orderdate) <= 1997 THEN 'pre' WHEN year(o_orderdate) >= 1999 THEN 'post' ELSE 'unassigned' END AS period FROM orders),
c AS (SELECT c_custkey AS cluster, concat_ws(' ', c_mktsegment, c_name) AS title FROM customer),
cg AS (SELECT *, CASE WHEN contains(title, 'MACH') OR contains(title, 'BUILD') THEN 'marked' WHEN trim(title) <> '' THEN 'other' ELSE 'unassigned' END AS grp FROM c),
ps AS (SELECT * FROM s JOIN cg ON seg_cluster = cluster WHERE tier IN ('F', 'O'))
"""
UNITS_SQL = SEGMENTS_SQL + """,
r AS (SELECT l_orderkey AS unit_segment, l_partkey AS type, l_linenumber AS pos, nullif(l_returnflag, 'N') AS realised, l_quantity - 5 AS dur, l_linestatus, l_returnflag,
  CASE WHEN l_linenumber <= 4 THEN 'exact_default' WHEN l_linenumber = 5 THEN 'exact_alt' WHEN l_linenumber = 6 THEN 'tone' ELSE 'segment' END AS verdict FROM lineitem),
a AS (SELECT * FROM r JOIN s ON unit_segment = segment JOIN cg ON seg_cluster = cluster),
u AS (SELECT *, realised IS NOT NULL AND realised <> '' AND dur > 0 AS ok, verdict IN ('exact_default', 'exact_alt') AS match FROM a WHERE tier IN ('F', 'O'))
"""
READERS_SQL = UNITS_SQL + """,
rd AS (SELECT cluster, period, type, l_linestatus AS a, tier AS b, CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'N' THEN 'O' WHEN 'A' THEN 'P' END AS c, 'O' AS base,
  CASE type % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS target FROM a)
"""
