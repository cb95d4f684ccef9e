"""The analysis frame: checked joins, published rows, cascades, step ledgers, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agreeline.sources.shared import written


def published(df: DataFrame, tier: str, values: list[str]) -> DataFrame:
    return df.filter(F.col(tier).isin(values))


def predicate(df: DataFrame, column: str, fragment: str) -> DataFrame:
    """Rows whose column meets the SQL fragment; a null result means not published."""
    return df.filter(F.coalesce(F.expr(f"`{column}` {fragment}"), F.lit(False)))


def checked_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(left join of right, one row of matched, unmatched_left and rows_out): repeated right keys show
    as rows_out above the left rows."""
    mark = right.withColumn("_right", F.lit(1))
    on = [left[a] == mark[b] for a, b in keys]
    joined = left.join(mark, on, "left")
    hit = F.col("_right").isNotNull()
    stats = joined.agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched_left"), F.count(F.lit(1)).alias("rows_out"))
    return joined.drop("_right"), stats


def require(stats: DataFrame, expected: dict[str, int], within: dict[str, int] | None = None) -> None:
    """Fails unless the one row of counts is as declared, each within its tolerance (0 if none is given);
    names that it lacks fail, too."""
    row, within = stats.first().asDict(), within or {}
    wrong = {k: (row.get(k), v) for k, v in expected.items() if row.get(k) is None or abs(row[k] - v) > within.get(k, 0)}
    if wrong:
        raise ValueError(f"counts differ (found, expected): {wrong}")


def cascade(tables: dict[str, DataFrame], refs: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Rows whose parent is gone go, too. refs: (child, child column, parent, parent column), parents
    before their children; references have no cycles, so one pass ends it."""
    out = dict(tables)
    for child, column, parent, key in refs:
        keys = out[parent].select(F.col(key).alias("_k")).distinct()
        out[child] = out[child].join(keys, F.col(column) == F.col("_k"), "left_semi")
    return out


def ledger(df: DataFrame, rules: list[tuple[str, Column]], by: str) -> DataFrame:
    """(step, rule, grp, rows_before, rows_after) for rules applied one after another, in one pass."""
    cols, passed = [F.count(F.lit(1)).alias("c0")], F.lit(True)
    for i, (_, rule) in enumerate(rules, 1):
        passed = passed & F.coalesce(rule, F.lit(False))
        cols.append(F.count_if(passed).alias(f"c{i}"))
    wide = df.groupBy(F.col(by).alias("grp")).agg(*cols)
    each = [F.struct(F.lit(i).cast("int").alias("step"), F.lit(n).alias("rule"), F.col(f"c{i - 1}").alias("rows_before"), F.col(f"c{i}").alias("rows_after")) for i, (n, _) in enumerate(rules, 1)]
    return wide.select("grp", F.explode(F.array(*each)).alias("s")).select("s.step", "s.rule", "grp", "s.rows_before", "s.rows_after")


def guards(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that violate each check, in one pass."""
    return df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])


def coverage(have: DataFrame, want: DataFrame, key_have: str, key_want: str) -> DataFrame:
    """(missing, extra, both): ids wanted but not there, there but not wanted, and both."""
    a = have.select(F.col(key_have).alias("a")).distinct()
    b = want.select(F.col(key_want).alias("b")).distinct()
    j = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return j.agg(F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def tiers_differ(df: DataFrame, unit_tier: str, segment_tier: str) -> DataFrame:
    """One row: units whose tier isn't their segment's, nulls counted like values."""
    return df.agg(F.count_if(~F.col(unit_tier).eqNullSafe(F.col(segment_tier))).alias("n_different"), F.count(F.lit(1)).alias("n"))


def marked_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], mark: str) -> DataFrame:
    """Left join with a column ``mark`` that is null where nothing matched."""
    side = right.withColumn(mark, F.lit(1))
    return left.join(side, [left[a] == side[b] for a, b in keys], "left")


def counted(df: DataFrame, marks: dict[str, Column], name: str) -> tuple[DataFrame, dict[str, int]]:
    """(``df`` without its marks, numbers): how many rows there are, as ``rows``, and how many meet each
    condition. The rows are made once, written to the shared folder; the counts read only the marks from there,
    so a task that runs twice isn't counted twice."""
    made = written(df.withColumns({f"_is_{k}": F.coalesce(c, F.lit(False)) for k, c in marks.items()}), name)
    found = made.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(f"_is_{k}").alias(k) for k in marks]).first().asDict()
    return made.drop(*[f"_is_{k}" for k in marks]), found


def lookup(df: DataFrame, key: str, attributes: DataFrame, attribute_key: str, columns: list[str]) -> DataFrame:
    """``df`` with columns of its key's row in ``attributes``. A column that ``df`` has already, a key that
    repeats there, and a key of ``df`` that isn't there fail. The join runs once."""
    if clash := sorted(set(columns) & set(df.columns)):
        raise ValueError(f"columns are there already: {clash}")
    side = attributes.select(F.col(attribute_key).alias("_key"), *columns)
    joined, found = counted(marked_join(df, side, [(key, "_key")], "_found"), {"lacking": F.col("_found").isNull()}, "lookup")
    if found["lacking"] or found["rows"] != df.count():
        raise ValueError(f"{found['lacking']} rows without attributes, {found['rows']} rows after the join")
    return joined.drop("_key", "_found")


def assemble(
    units: DataFrame, segments: DataFrame, clusters: DataFrame, unit_segment: str, segment: str, segment_cluster: str, cluster: str,
    tier: str, tiers: list[str], unit_tier: str | None = None, expected: dict[str, int] | None = None, within: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(published units with their segment's and cluster's columns, ledger of the steps).

    ``expected`` declares counts of clusters, segments, units and published rows, each met within its
    tolerance or the assembly fails. So do units without a segment, published rows without a cluster,
    repeated keys, and, with ``unit_tier``, units whose tier isn't their segment's. Other units are
    left out by tier. The ledger has (step, rule, grp, rows_before, rows_after, unmatched_left).

    Segments get their clusters, units their segments; either join runs once, and all counts come from
    the rows that it made.
    """
    sizes = {"clusters": clusters.count(), "segments": segments.count(), "units": units.count()}
    with_cluster = marked_join(segments.withColumn("_segment", F.lit(1)), clusters, [(segment_cluster, cluster)], "_cluster")
    whole = units.join(with_cluster, units[unit_segment] == with_cluster[segment], "left")
    of_tier = F.col(tier).isin(tiers)
    marks = {"unmatched": F.col("_segment").isNull(), "published": of_tier, "lacking": of_tier & F.col("_cluster").isNull()}
    if unit_tier:
        marks["differ"] = F.col("_segment").isNotNull() & ~F.col(unit_tier).eqNullSafe(F.col(tier))
    made, found = counted(whole, marks, "frame")
    if found["unmatched"] or found["rows"] != sizes["units"]:
        raise ValueError(f"units and segments: {found['unmatched']} unmatched, {found['rows']} rows of {sizes['units']} after the joins")
    if found.get("differ"):
        raise ValueError(f"{found['differ']} units have another tier than their segment")
    if found["lacking"]:
        raise ValueError(f"published rows and clusters: {found['lacking']} unmatched")
    sizes["published"] = found["published"]
    require(df_of(units, sizes), expected or {}, within)
    n = sizes["units"]
    steps = [(1, "clusters, whole table", sizes["clusters"], sizes["clusters"]), (2, "segments, whole table", sizes["segments"], sizes["segments"]), (3, "units, whole table", n, n),
             (4, "units with their segment", n, found["rows"]), (5, f"{tier} in {', '.join(tiers)}", found["rows"], sizes["published"]), (6, "published rows with their cluster", sizes["published"], sizes["published"])]
    ledger = units.sparkSession.createDataFrame([(*x[:2], "all", *x[2:], 0) for x in steps], "step int, rule string, grp string, rows_before long, rows_after long, unmatched_left long")
    return published(made, tier, tiers).drop("_segment", "_cluster"), ledger


def df_of(like: DataFrame, counts: dict[str, int]) -> DataFrame:
    """One row of counts."""
    return like.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"`{k}` long" for k in counts))
