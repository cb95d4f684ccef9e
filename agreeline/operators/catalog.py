"""Checks of metric rows: derived values, declared denominators, identities, independent routes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive(wide: DataFrame, derived: dict[str, tuple[set[str], Callable[[], Column]]]) -> DataFrame:
    """Adds derived metrics, each after those it needs; a cycle fails. Quotients are made by ``quotient``."""
    left, out = dict(derived), wide
    while left:
        ready = [n for n, (needs, _) in left.items() if not needs & set(left)]
        if not ready:
            raise ValueError(f"metrics depend on each other: {sorted(left)}")
        out = out.withColumns({n: left.pop(n)[1]() for n in ready})
    return out


def quotient(metric: str, above: Column, divisor: str) -> Column:
    """``above`` by the metric ``divisor``; fails, naming both, where that is 0, and is null where either is."""
    below = F.col(divisor).cast("double")
    why = F.concat(F.lit(f"metric {metric} divides by {divisor}, which is "), below.cast("string"))
    return F.when(below == 0, F.raise_error(why).cast("double")).otherwise(above.cast("double") / below)


def with_denominators(metrics: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """(name, value, n): the denominator of each metric by its name. ``rules`` are patterns, the first
    that matches the whole name counts, each with the names of the counts whose values add up to n. A
    metric that no rule names, or whose counts aren't there, fails."""
    counts = {x for _, names in rules for x in names}
    values = {r.name: r.value for r in metrics.filter(F.col("name").isin(*counts)).collect()}
    if lacking := sorted(counts - set(values)):
        raise ValueError(f"counts that denominators need aren't there: {lacking}")
    n = F.lit(None).cast("long")
    for pattern, names in reversed(rules):
        n = F.when(F.col("name").rlike(f"^(?:{pattern})$"), F.lit(int(sum(values[x] for x in names))).cast("long")).otherwise(n)
    out = metrics.select("name", "value", n.alias("n"))
    if unnamed := [r.name for r in out.filter("n is null").select("name").limit(3).collect()]:
        raise ValueError(f"no rule names the denominator of {unnamed}")
    return out


def declared_n(metrics: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, n, declared, ok) of metrics whose denominator was declared."""
    d = declared.select(F.col("name").alias("_n"), F.col("n").alias("declared"))
    return metrics.join(d, F.col("name") == F.col("_n")).select("name", "n", "declared", F.col("n").eqNullSafe(F.col("declared")).alias("ok"))


def identities(wide: DataFrame, pairs: dict[str, tuple[Column, Column]], tol: float = 1e-6) -> DataFrame:
    """(identity, lhs, rhs, ok) for each named pair of expressions of the one wide row."""
    each = [F.struct(F.lit(n).alias("identity"), a.cast("double").alias("lhs"), b.cast("double").alias("rhs"), F.coalesce(F.abs(a - b) <= tol, F.lit(False)).alias("ok")) for n, (a, b) in pairs.items()]
    return wide.select(F.explode(F.array(*each)).alias("i")).select("i.*")


def routes_agree(one: DataFrame, two: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(name, value_one, value_two, ok): two independently computed sets of (name, value, n)."""
    b = two.select(F.col("name").alias("_n"), F.col("value").alias("value_two"), F.col("n").alias("n_two"))
    j = one.join(b, F.col("name") == F.col("_n"), "full_outer")
    ok = F.coalesce((F.abs(F.col("value") - F.col("value_two")) <= tol) & F.col("n").eqNullSafe(F.col("n_two")), F.lit(False))
    return j.select(F.coalesce("name", "_n").alias("name"), F.col("value").alias("value_one"), "value_two", ok.alias("ok"))


def deterministic(make: Callable[[DataFrame], DataFrame], df: DataFrame, parts: int = 7) -> DataFrame:
    """A metric function twice, over two partitionings: (name, value_one, value_two, ok)."""
    return routes_agree(make(df), make(df.repartition(parts)), 1e-9)
