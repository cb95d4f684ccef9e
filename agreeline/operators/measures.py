"""Counts, agreement, gaps and shares, fused into one aggregate per grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def rate(a: Column, b: Column, unit: float = 1.0) -> Column:
    """unit * a / b, null where b is 0."""
    return F.round(unit * F.try_divide(a.cast("double"), b.cast("double")), DIGITS)


def judgeable(realised: Column, dur: Column) -> Column:
    return F.coalesce(realised.isNotNull() & (realised != "") & (dur > 0), F.lit(False))


def judgeable_trimmed(realised: Column, dur: Column) -> Column:
    return F.coalesce((F.length(F.trim(F.coalesce(realised, F.lit("")))) > 0) & (dur > 0), F.lit(False))


def six_counts(frame: DataFrame, by: list[str], realised: str, dur: str, match: Column) -> DataFrame:
    """n_total, n_judgeable, n_match, n_empty_realized, n_dur_le_0, n_empty_and_zerodur, agreement
    and agreement_status of each group, in one aggregate."""
    r, d = F.col(realised), F.col(dur)
    ok, empty, short = judgeable(r, d), F.coalesce(r, F.lit("")) == "", F.coalesce(d <= 0, F.lit(False))
    out = frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_judgeable"), F.count_if(ok & match).alias("n_match"),
        F.count_if(empty).alias("n_empty_realized"), F.count_if(short).alias("n_dur_le_0"), F.count_if(empty & short).alias("n_empty_and_zerodur"),
    )
    return out.withColumn("agreement", rate(F.col("n_match"), F.col("n_judgeable"))).withColumn("agreement_status", F.when(F.col("n_judgeable") > 0, "ok").otherwise("missing"))


def period_gap(frame: DataFrame, by: list[str], period: str, denominators: dict[str, Column], match: Column, unit: float = 100.0) -> DataFrame:
    """(denominator, agree_pre, agree_post, gap) for each named denominator, whose predicate the
    numerator follows; all in one pass. gap is pre less post."""
    aggs = []
    for name, ok in denominators.items():
        for p in ("pre", "post"):
            here = ok & (F.col(period) == p)
            aggs += [F.count_if(here).alias(f"{name}_{p}_n"), F.count_if(here & match).alias(f"{name}_{p}_k")]
    wide = frame.groupBy(*by).agg(*aggs) if by else frame.agg(*aggs)
    exact = lambda n, p: F.try_divide(F.col(f"{n}_{p}_k").cast("double"), F.col(f"{n}_{p}_n").cast("double"))
    each = [
        F.struct(F.lit(n).alias("denominator"), F.col(f"{n}_pre_n").alias("n_pre"), F.col(f"{n}_post_n").alias("n_post"), F.round(exact(n, "pre"), DIGITS).alias("agree_pre"),
                 F.round(exact(n, "post"), DIGITS).alias("agree_post"), F.round(unit * (exact(n, "pre") - exact(n, "post")), DIGITS).alias("gap"))
        for n in denominators
    ]
    return wide.select(*by, F.explode(F.array(*each)).alias("g")).select(*by, "g.*")


def class_rates(frame: DataFrame, by: list[str], kind: str, classes: tuple[str, ...], within: Column, unit: float = 1000.0) -> DataFrame:
    """n and, per class, its count and rate among rows that meet ``within``."""
    aggs = [F.count_if(within).alias("n")] + [F.count_if(within & (F.col(kind) == c)).alias(f"n_{c}") for c in classes]
    out = frame.groupBy(*by).agg(*aggs)
    return out.select(*by, "n", *[x for c in classes for x in (F.col(f"n_{c}"), rate(F.col(f"n_{c}"), F.col("n"), unit).alias(f"rate_{c}"))])


def class_gaps(frame: DataFrame, period: str, kind: str, classes: tuple[str, ...], within: Column, unit: float = 1000.0) -> DataFrame:
    """(class, gap_pm): the rate of each class among rows that meet ``within``, post less pre, in one pass."""
    count = lambda p, c=None: F.count_if(within & (F.col(period) == p) & (F.lit(True) if c is None else F.col(kind) == c)).cast("double")
    wide = frame.agg(*[count(p).alias(f"n_{p}") for p in ("pre", "post")], *[count(p, c).alias(f"{c}_{p}") for c in classes for p in ("pre", "post")])
    share = lambda c, p: F.try_divide(F.col(f"{c}_{p}"), F.col(f"n_{p}"))
    each = [F.struct(F.lit(c).alias("class"), F.round(unit * (share(c, "post") - share(c, "pre")), DIGITS).alias("gap_pm")) for c in classes]
    return wide.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def mean_gap(frame: DataFrame, period: str, measure: str, unit: float = 1000.0) -> DataFrame:
    """mean_pre, mean_post and their gap, post less pre."""
    at = lambda p: F.avg(F.when(F.col(period) == p, F.col(measure)))
    return frame.agg(F.round(unit * at("pre"), 3).alias("mean_pre"), F.round(unit * at("post"), 3).alias("mean_post"), F.round(unit * (at("post") - at("pre")), 3).alias("gap"))


def value_shares(frame: DataFrame, column: str) -> DataFrame:
    """(value, n, share) with nulls kept; the total is one row joined by broadcast."""
    counts = frame.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(frame.agg(F.count(F.lit(1)).alias("_t")))).select("value", "n", rate(F.col("n"), F.col("_t")).alias("share"))


def year_cells(segments: DataFrame, year: Column, cluster: str, rates: dict[str, Column], small: int = 10) -> DataFrame:
    """Per year: clusters, segments, rates, and whether the cell is small; rows without a year are
    one row of their own."""
    named = segments.withColumn("cell", F.coalesce(year.cast("string"), F.lit("unassigned")))
    out = named.groupBy("cell").agg(F.count_distinct(cluster).alias("n_clusters"), F.count(F.lit(1)).alias("n_segments"), *[F.round(F.avg(c.cast("double")), DIGITS).alias(n) for n, c in rates.items()])
    return out.withColumn("small_cell", F.col("n_clusters") < small)


def top_values(frame: DataFrame, column: str, k: int) -> DataFrame:
    return frame.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def column_profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_nonnull, n_distinct, constant) of each column. Each is counted by value on its own: several
    distinct counts in one aggregate would multiply all rows by their number, and a scan of one column reads
    no other."""
    out = None
    for c in columns:
        by_value = frame.select(F.col(c).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        one = by_value.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_nonnull"), F.count(F.lit(1)).alias("n_distinct"))
        one = one.select(F.lit(c).alias("column"), "n_nonnull", "n_distinct", (F.col("n_distinct") <= 1).alias("constant"))
        out = one if out is None else out.unionByName(one)
    return out


#: A sketch has 2^SKETCH_BITS slots; its count is off by less than four standard errors of 1.04 / 2^(SKETCH_BITS / 2).
SKETCH_BITS = 14
SKETCH_ERROR = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)


def distinct_sketches(frame: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One sketch of the different values of each column for each group, of a fixed size, in one pass. Sketches
    of days or parts of a table can be kept and merged; nulls don't count."""
    return frame.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_BITS).alias(c) for c in columns])


def merged_distinct(sketches: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, column, about): how many different values all sketches of a group saw, about."""
    one = sketches.groupBy(*(by or [])).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0)).alias("about")) for c in columns]))
    return one.select(*(by or []), each.alias("e")).select(*(by or []), "e.*")


def flat_key(columns: list[str], separator: str = "\x1f") -> Column:
    """One key of several columns. A part that holds the separator or the sign for null makes the key null,
    so that two keys are never taken for one; ``bad_keys`` counts such rows. Nulls have a sign of their own,
    and so differ from empty text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_SIGN)) for c in columns]
    bad = F.lit(False)
    for c, p in zip(columns, parts, strict=True):
        bad = bad | F.contains(p, F.lit(separator)) | F.coalesce(F.contains(F.col(c).cast("string"), F.lit(NULL_SIGN)), F.lit(False))
    return F.when(~bad, F.concat_ws(separator, *parts))


#: Stands for null in keys of several columns.
NULL_SIGN = "\x00"


def bad_keys(frame: DataFrame, columns: list[str], separator: str = "\x1f") -> DataFrame:
    """One row: rows whose parts hold the separator, and different keys of the others."""
    key = flat_key(columns, separator)
    return frame.agg(F.count_if(key.isNull()).alias("n_bad"), F.count_distinct(key).alias("n_keys"))


def reader_counts(frame: DataFrame, by: list[str], realised: str, dur: str, readers: list[str], target: str) -> DataFrame:
    """The counts of ``six_counts`` with one number of matches for each reader, among judgeable rows."""
    r, d = F.col(realised), F.col(dur)
    ok, empty, short = judgeable(r, d), F.coalesce(r, F.lit("")) == "", F.coalesce(d <= 0, F.lit(False))
    return frame.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(ok).alias("n_judgeable"), F.count_if(empty).alias("n_empty_realized"), F.count_if(short).alias("n_dur_le_0"),
        F.count_if(empty & short).alias("n_empty_and_zerodur"), *[F.count_if(ok & (F.col(x) == F.col(target))).alias(f"n_match_{x}") for x in readers],
    )
