"""Metamorphic relations: doubled, permuted and reduced tables, and what must hold of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreeline.sources.shared import cut


def double(df: DataFrame, keys: list[str], prefix: str = "dup:") -> DataFrame:
    """The rows and a copy of them whose keys, references and types carry a prefix; these columns
    become text in both."""
    text = df.withColumns({k: F.col(k).cast("string") for k in keys})
    return text.unionByName(text.withColumns({k: F.concat(F.lit(prefix), F.col(k)) for k in keys}))


def permute(df: DataFrame, parts: int, seed: int = 1) -> DataFrame:
    return df.repartition(parts, F.rand(seed))


def double_predictions(predictions: DataFrame, prefix: str = "dup:") -> DataFrame:
    """Predictions (id, hyp) and a copy of them for the units of a doubled table."""
    return double(predictions, ["id"], prefix)


def exclude_predictions(predictions: DataFrame, units: DataFrame, unit_id: str) -> DataFrame:
    """Predictions without those whose unit is gone."""
    left = units.select(F.col(unit_id).alias("_unit")).distinct()
    return predictions.join(left, F.col("id") == F.col("_unit"), "left_semi")


def anchor(units: DataFrame, declared: int, tolerance: int = 0) -> DataFrame:
    """(n, declared, ok): the rows that are left after exclusion against the published number."""
    return units.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(declared).cast("long").alias("declared"), (F.abs(F.col("n") - declared) <= tolerance).alias("ok"))


def family(name: Column, counts: tuple[str, ...] = ("n_",), rates: tuple[str, ...] = ("agree", "gap", "rate", "share", "mean")) -> Column:
    starts = lambda ps: F.greatest(*[F.startswith(name, F.lit(p)) for p in ps]) if len(ps) > 1 else F.startswith(name, F.lit(ps[0]))
    return F.when(starts(counts), "count").when(starts(rates), "rate").otherwise("unclassified")


def compare(base: DataFrame, other: DataFrame, relation: str, tol: float = 1e-6) -> DataFrame:
    """(name, family, base, other, ok) of (name, value) rows: doubling doubles counts and keeps
    rates, permuting and excluding unpublished rows keep both; a metric of no family isn't ok."""
    j = base.select("name", F.col("value").alias("base")).join(other.select(F.col("name").alias("_n"), F.col("value").alias("other")), F.col("name") == F.col("_n"), "full_outer")
    kind = family(F.coalesce("name", "_n"))
    times = F.when(kind == "count", 2.0 if relation == "double" else 1.0).otherwise(1.0)
    near = F.when(kind == "count", F.col("other") == F.col("base") * times).otherwise(F.abs(F.col("other") - F.col("base")) <= tol)
    same = F.coalesce(near, F.col("base").isNull() & F.col("other").isNull() & F.col("name").isNotNull() & F.col("_n").isNotNull(), F.lit(False))
    return j.select(F.coalesce("name", "_n").alias("name"), kind.alias("family"), "base", "other", (same & (kind != "unclassified")).alias("ok"))


def report(compared: DataFrame, relation: str, exempt: list[str] | None = None) -> DataFrame:
    """(relation, compared, n_ok, n_exempt, passed); a relation that compares nothing fails."""
    out = F.col("name").isin(exempt or [])
    r = compared.agg(F.count_if(~out).alias("compared"), F.count_if(~out & F.col("ok")).alias("n_ok"), F.count_if(out).alias("n_exempt"))
    return r.select(F.lit(relation).alias("relation"), "*", ((F.col("compared") > 0) & (F.col("compared") == F.col("n_ok"))).alias("passed"))


def exempt_closure(outside: DataFrame, needs: DataFrame) -> DataFrame:
    """(metric): the metrics of ``outside`` (metric) and all that are derived from them, over any number of
    steps; ``needs`` has (metric, needs). Each round joins only what the last one found and leaves out what
    is known, so cycles end; rows that repeat and nulls don't matter."""
    edges = cut(needs.select(F.col("metric").alias("m"), F.col("needs").alias("of")).filter("m is not null and of is not null").distinct())
    new = cut(outside.select("metric").filter("metric is not null").distinct())
    known = new
    while not new.isEmpty():
        reached = edges.join(new, F.col("of") == F.col("metric"), "left_semi").select(F.col("m").alias("metric")).distinct()
        new = cut(reached.join(known, "metric", "left_anti"))
        known = known.union(new)
    return known
