"""Robust location: cluster medians, symmetric trimming, order statistics, side by side."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agreeline.sources.shared import bounded, cut, written

from .measures import DIGITS

#: Ranges of a histogram of values, and values of a range that are put in order.
STEPS, FEW = 4096, 100_000


def total_order(df: DataFrame, order: list[str], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """``df`` with its rank (from 1) in a total order, of the whole or of each group, without gathering
    a group in one task: rows are range-partitioned by group and order, ranked in each partition,
    and shifted by the group's counts in the partitions before. The partitioned rows are written
    once, so that counts and ranks see the same partitions after the loss of an executor, too."""
    group = by or []
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    parts = cut(df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(run), F.lit(0))).select("_p", "_b", *[F.col(c).alias(f"_g_{c}") for c in group])
    inside = F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    ranked = parts.withColumn("_inside", inside)
    return ranked.join(before.withColumnRenamed("_p", "_q"), _same(group), "inner").withColumn(name, F.col("_inside") + F.col("_b")).drop("_p", "_q", "_inside", "_b", *[f"_g_{c}" for c in group])


def _same(group: list[str]):
    on = F.col("_p") == F.col("_q")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return on


def cluster_means(segments: DataFrame, cluster: list[str], by: str, measure: Column) -> DataFrame:
    return segments.groupBy(*cluster, by).agg(F.round(F.avg(measure.cast("double")), DIGITS).alias("score"), F.count(measure).alias("n"), F.sum(measure.cast("double")).alias("total"))


def order_statistics(df: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, and a column for each of ``ranks``): the value at that rank, from 1, among the values of a group
    that aren't null; ranks are expressions of n, null if there is no such rank. NaN is the largest value.

    Values are counted, not sorted: a histogram of ``STEPS`` ranges for each group, then of the one range in
    which the rank falls, until at most ``FEW`` values are in it or all of them are equal. Only those few
    are ranked. Values are written once, two columns wide, and each round reads them once.
    """
    some = written(df.filter(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")), "values")
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    bounds = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min(finite).alias("first"), F.max(finite).alias("last")]
    groups = cut(some.groupBy("g").agg(*bounds))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("want")) for k, r in ranks.items()]))
    left = groups.select("*", wanted.alias("w")).select("g", "n", "lo", "hi", "first", "last", "w.*").filter("want between 1 and n")
    found, few = [], []
    for turn in count():
        left = cut(left)
        found.append(left.filter("lo <=> hi").select("g", "name", F.col("lo").alias("x")))
        left = left.filter("not lo <=> hi")
        few.append(left.filter(F.col("n") <= FEW))
        left = left.filter(F.col("n") > FEW)
        if left.isEmpty():
            break
        counts = _inside(some, left).groupBy("c", "a", "b", _step(turn).alias("step")).agg(*bounds)
        run = Window.partitionBy("c", "a", "b").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
        at = _same_range() & (F.col("want") > F.col("before")) & (F.col("want") <= F.col("before") + F.col("n"))
        targets = left.select("g", "name", "want", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
        left = counts.join(bounded(targets), at).select("g", "n", "lo", "hi", "first", "last", "name", (F.col("want") - F.col("before")).alias("want"))
    last = few[0]
    for x in few[1:]:
        last = last.union(x)
    ranked = _inside(some, last).withColumn("r", F.row_number().over(Window.partitionBy("c", "a", "b").orderBy("v")))
    targets = last.select("g", "name", "want", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"))
    out = ranked.join(bounded(targets), _same_range() & (F.col("r") == F.col("want"))).select("g", "name", F.col("v").alias("x"))
    for x in found:
        out = out.union(x)
    wide = out.groupBy(F.col("g").alias("k")).agg(*[F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in ranks])
    return groups.select("g", "n").join(wide, F.col("g").eqNullSafe(F.col("k")), "left").select(F.col("g").alias(by), "n", *ranks)


def _step(turn: int) -> Column:
    """The range of a histogram between the first and last finite value in which v lies. Ranges are of equal
    widths and, every other turn, of equal widths of the magnitude, so few turns split any values."""

    def place(x: Column) -> Column:
        if turn % 2 == 0:
            return x / 2  # so that no difference of finite values is infinite
        return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))  # logarithms are above -1075

    v, low, high = (place(F.col(c)) for c in ("v", "first", "last"))
    part = F.floor(STEPS * F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0)))
    return F.when(F.isnan("v"), STEPS + 2).when(F.col("v") == float("inf"), STEPS + 1).when(F.col("v") == float("-inf"), -1).otherwise(part)


def _inside(some: DataFrame, ranges: DataFrame) -> DataFrame:
    """Values in one of the different ranges (c, a, b) of their group; ranges of a group don't overlap."""
    cells = ranges.select(F.col("g").alias("c"), F.col("lo").alias("a"), F.col("hi").alias("b"), "first", "last").distinct()
    return some.join(bounded(cells), F.col("g").eqNullSafe(F.col("c")) & (F.col("v") >= F.col("a")) & (F.col("v") <= F.col("b"))).drop("g")


def _same_range() -> Column:
    return F.col("g").eqNullSafe(F.col("c")) & (F.col("lo0") == F.col("a")) & (F.col("hi0") == F.col("b"))


def median_by(clusters: DataFrame, by: str) -> DataFrame:
    """(by, n_clusters, median) of the clusters' scores."""
    return ranked_median(clusters, by, "score").select(by, F.col("n").alias("n_clusters"), "median")


def ranked_median(rows: DataFrame, by: str, score: str) -> DataFrame:
    """The median by rank: the middle value, or the mean of the two middle ones."""
    two = order_statistics(rows, by, score, {"_low": F.floor((F.col("n") + 1) / 2), "_high": F.floor((F.col("n") + 2) / 2)})
    return two.select(by, F.round((F.col("_low") + F.col("_high")) / 2, DIGITS).alias("median"), "n")


def trimmed(clusters: DataFrame, order: list[str], share: float = 0.05) -> DataFrame:
    """Clusters without the k lowest and k highest by score and tie keys: k is 0 below 2 clusters,
    1 below 20, else share of them rounded down. Only rows with one of the two scores at which it is cut are put in
    order by their keys; a score that is null comes first."""
    clusters = cut(clusters)
    g = clusters.count()
    k = 0 if g < 2 else 1 if g < 20 else int(share * g)
    if not k:
        return clusters
    ranks = order_statistics(clusters.select(F.lit(1).alias("one"), F.coalesce(F.col(order[0]).cast("double"), F.lit(float("-inf"))).alias("v")), "one", "v", {"lo": F.lit(k), "hi": F.lit(g - k + 1)})
    lo, hi = ranks.select("lo", "hi").first()
    v = F.coalesce(F.col(order[0]).cast("double"), F.lit(float("-inf")))
    below, above = v < F.lit(lo), v > F.lit(hi)
    n_below, n_above = clusters.agg(F.count_if(below), F.count_if(above)).first()
    tied = (v == F.lit(lo)) | (v == F.lit(hi))
    ranked = total_order(clusters.filter(tied), order, "_rank")
    n_tied = g - n_below - n_above - clusters.filter((v > F.lit(lo)) & (v < F.lit(hi))).count()
    kept = ranked.filter((F.col("_rank") > k - n_below) & (F.col("_rank") <= n_tied - (k - n_above))).drop("_rank")
    return clusters.filter((v > F.lit(lo)) & (v < F.lit(hi))).unionByName(kept)


def gap(rows: DataFrame, by: str, value: str, unit: float = 1.0, name: str = "gap") -> DataFrame:
    """One row: value of post less value of pre."""
    at = lambda p: F.max(F.when(F.col(by) == p, F.col(value)))
    return rows.agg(F.round(unit * (at("post") - at("pre")), 3).alias(name))


def quantiles_np1(df: DataFrame, by: str, value: str, points: dict[str, float]) -> DataFrame:
    """Order statistics at position p * (n + 1), linear between neighbours and held at the ends."""
    n = F.col("n")
    at = {name: F.greatest(F.lit(1.0), F.least(n.cast("double"), p * (n + 1))) for name, p in points.items()}
    ranks = {f"_{side}_{name}": F.least(n, F.floor(x) + i) for name, x in at.items() for i, side in enumerate(("low", "high"))}
    found = order_statistics(df, by, value, ranks)
    part = {name: x - F.floor(x) for name, x in at.items()}
    return found.select(by, "n", *[F.round(F.col(f"_low_{k}") * (1 - x) + F.when(x > 0, F.col(f"_high_{k}") * x).otherwise(0.0), DIGITS).alias(k) for k, x in part.items()])


def profile(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n_nonnull, n_distinct, min, p25, median, p75, max, constant) of a number in each group."""
    v = F.col(value)
    wide = df.groupBy(by).agg(
        F.count(v).alias("n_nonnull"), F.count_distinct(v).alias("n_distinct"), F.round(F.min(v), DIGITS).alias("min"), F.round(F.max(v), DIGITS).alias("max"), (F.count_distinct(v) <= 1).alias("constant")
    )
    points = quantiles_np1(df, by, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}).drop("n").withColumnRenamed(by, "_by")
    out = wide.join(points, F.col(by).eqNullSafe(F.col("_by")), "left")
    return out.select(by, "n_nonnull", "n_distinct", "min", "p25", "median", "p75", "max", "constant")


def triptych(row: DataFrame, names: tuple[str, str, str] = ("row", "median", "trim")) -> DataFrame:
    """The three gaps with ``inconclusive``: any two differ in sign, one is zero and one isn't, or
    one is more than twice the other."""
    bad = F.lit(False)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = F.col(a), F.col(b)
            bad = bad | (F.signum(x) != F.signum(y)) | (F.abs(x) > 2 * F.abs(y)) | (F.abs(y) > 2 * F.abs(x))
    return row.select(*names, bad.alias("inconclusive"))
