"""Labels of periods, groups, types and errors. No label is another one's complement."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from agreeline.sources.shared import cut, is_small, ship


def year(day: Column) -> Column:
    """The year of a yyyyMMdd text, null unless its first four characters are digits."""
    y = F.substring(day, 1, 4)
    return F.when(y.rlike("^[0-9]{4}$"), y.cast("int"))


def period(day: Column, pre_last: int, post_first: int) -> Column:
    y = year(day)
    return F.when(y <= pre_last, "pre").when(y >= post_first, "post").otherwise("unassigned")


def has_marker(title: Column, markers: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(title, F.lit(m)) for m in markers]), F.lit(False))


#: Markers that go to all tasks, at most; more are joined.
MOST_MARKERS = 500_000


def with_marker(df: DataFrame, title: str, markers: DataFrame, name: str = "marked") -> DataFrame:
    """``df`` with a boolean: does the title contain one of ``markers`` (tok)? A null title doesn't; an empty marker
    is in every other title; null markers and repeats don't matter.

    Titles run through an automaton of all markers once, so their number doesn't cost time. Where a count
    finds more markers than tasks should hold, every piece of a title of a marker's length is looked up by
    a join instead.
    """
    toks = cut(markers.select("tok").filter("tok is not null").distinct())
    ship(df.sparkSession)
    if is_small(toks, MOST_MARKERS):
        known = df.sparkSession.sparkContext.broadcast([r.tok for r in toks.collect()])

        @pandas_udf("boolean")
        def has(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import ahocorasick

            found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for tok in known.value:
                if tok:
                    found.add_word(tok)
            every = "" in known.value
            if len(found):
                found.make_automaton()
            for batch in batches:
                yield batch.map(lambda t: t is not None and (every or (len(found) > 0 and next(found.iter(t), None) is not None)))

        return df.withColumn(name, has(F.col(title)))
    lengths = [r[0] for r in toks.select(F.length("tok")).distinct().collect()]  # no more than the longest marker has characters
    titles = df.select(F.col(title).alias("_t")).filter("_t is not null").distinct()
    t = F.col("_t")
    of = lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = titles.select("_t", F.explode(F.array_distinct(F.flatten(F.array(*map(of, lengths))))).alias("_piece"))
    hits = pieces.join(toks, F.col("_piece") == F.col("tok"), "left_semi").select("_t").distinct().withColumn("_hit", F.lit(True))
    return df.join(hits, F.col(title) == F.col("_t"), "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_t", "_hit")


def keyword_group(title: Column, markers: list[str], name: str = "marked", other: str = "other") -> Column:
    """Titles with a marker, titles without one, and empty or missing titles unassigned."""
    has = has_marker(title, markers)
    return F.when(has, name).when(~has & (F.coalesce(F.trim(title), F.lit("")) != ""), other).otherwise("unassigned")


def rare_types(units: DataFrame, kind: str, below: int) -> DataFrame:
    """(type, n) of types that occur fewer than ``below`` times in the whole unit table."""
    return units.groupBy(F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < below)


def with_rarity(frame: DataFrame, units: DataFrame, kind: str, below: int) -> DataFrame:
    """``frame`` with a boolean ``rare``: counted types are joined back, not the units themselves."""
    rare = rare_types(units, kind, below).select(F.col("type").alias("_t"), F.lit(True).alias("_r"))
    return frame.join(rare, F.col(kind) == F.col("_t"), "left").withColumn("rare", F.coalesce("_r", F.lit(False))).drop("_r", "_t")


def error_class(verdict: Column, classes: tuple[str, ...], agree: tuple[str, ...]) -> Column:
    return F.when(verdict.isin(*agree), "match").when(verdict.isin(*classes), verdict).when(verdict == "none", "none").otherwise("undeclared")


def next_token_class(value: Column, following: Column, wanted: str, final: list[str]) -> Column:
    """For units of a value: is the next token empty, one that ends a sentence, or another."""
    nxt = F.trim(F.coalesce(following, F.lit("")))
    return F.when(value == wanted, F.when(nxt == "", "empty").when(nxt.isin(final), "final").otherwise("non_final"))
