"""Cluster cells, stratum sums, and the decomposition of a gap into mix and rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measures import DIGITS


def cluster_cells(clusters: DataFrame, units: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """The clusters, each with sums over its units; 0 for clusters without any."""
    cells = units.groupBy(*keys).agg(*[F.sum(c.cast("long")).alias(n) for n, c in sums.items()])
    return clusters.join(cells, keys, "left").fillna(0, list(sums))


def stratum_sums(cells: DataFrame, strata: list[str], sums: list[str], size: str) -> DataFrame:
    return cells.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(F.col(size) > 0).alias("n_with_any"), *[F.sum(s).alias(s) for s in sums])


def kitagawa(sums: DataFrame, by: list[str], group: str, period: str, n: str, k: str) -> DataFrame:
    """Per ``by``: the gap in points, how much of it the groups' mix explains, and the rest.

    Weights are the groups' shares of n in the pre period; the counterfactual post rate weighs the
    post rates by them. residual is pre less counterfactual, explained the rest of the gap. Groups
    without rows in either period make the row null, never a guess.
    """
    at = lambda c, p: F.sum(F.when(F.col(period) == p, F.col(c)))
    cells = sums.groupBy(*by, group).agg(*[at(c, p).cast("double").alias(f"{c}_{p}") for c in (n, k) for p in ("pre", "post")])
    rate = lambda p: F.try_divide(F.col(f"{k}_{p}"), F.col(f"{n}_{p}"))
    cells = cells.withColumns({"r_pre": rate("pre"), "r_post": rate("post")})
    aggs = [F.sum(f"{c}_{p}").alias(f"{c}_{p}") for c in (n, k) for p in ("pre", "post")]
    aggs += [F.sum(F.col(f"{n}_pre") * F.col("r_post")).alias("cf"), F.count_if(F.col("r_post").isNull() | F.col("r_pre").isNull()).alias("lacking")]
    tot = cells.groupBy(*by).agg(*aggs) if by else cells.agg(*aggs)
    pre, post, cf = F.try_divide(F.col(f"{k}_pre"), F.col(f"{n}_pre")), F.try_divide(F.col(f"{k}_post"), F.col(f"{n}_post")), F.try_divide(F.col("cf"), F.col(f"{n}_pre"))
    ok = F.col("lacking") == 0
    pp = lambda c: F.when(ok, F.round(100 * c, DIGITS))
    return tot.select(*by, pp(pre - post).alias("unadjusted"), pp(pre - cf).alias("residual"), pp(cf - post).alias("explained"))


def did(gaps: DataFrame, group: str, gap: str, a: str, b: str) -> DataFrame:
    """Difference in differences: gap of a less gap of b."""
    at = lambda g: F.max(F.when(F.col(group) == g, F.col(gap)))
    return gaps.agg(F.round(at(a) - at(b), DIGITS).alias("did"))
