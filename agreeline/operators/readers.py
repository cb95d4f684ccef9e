"""Several readers of the same units: where they differ, and who agrees with the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import counted, marked_join
from .measures import rate


def normal(c: Column) -> Column:
    return F.lower(F.trim(c))


def _apart() -> str:
    """A class of the characters that full case folding changes and lower case doesn't, as ranges."""
    points = [p for p in range(0x110000) if chr(p).casefold() != chr(p).lower()]
    known = set(points)
    starts, ends = [p for p in points if p - 1 not in known], [p for p in points if p + 1 not in known]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


#: Sharp s, final sigma, ligatures and others of which lower case isn't the folded form.
APART = _apart()


def folds_apart(c: Column) -> Column:
    """Readings that full case folding would change where lower case doesn't: their normal forms must not
    be compared."""
    return F.coalesce(normal(c).rlike(APART), F.lit(False))


def join_readers(units: DataFrame, unit_id: str, tables: dict[str, DataFrame]) -> DataFrame:
    """``units`` with one column for each reader, from tables of (id, hyp). Every unit must have exactly
    one reading of each reader, or it fails; readings of other units are left out. Each reader is joined
    once, however many there are, and all are counted in the rows so made."""
    out = units
    for name, table in tables.items():
        side = table.groupBy(F.col("id").alias(f"_{name}")).agg(F.min("hyp").alias(name), F.count(F.lit(1)).alias(f"_n_{name}"))
        out = marked_join(out, side, [(unit_id, f"_{name}")], f"_in_{name}")
    marks = {f"lacking_{n}": F.col(f"_in_{n}").isNull() for n in tables} | {f"repeated_{n}": F.col(f"_n_{n}") > 1 for n in tables}
    out, found = counted(out, marks, "readers")
    for name in tables:
        if found[f"lacking_{name}"] or found[f"repeated_{name}"]:
            raise ValueError(f"reader {name}: {found[f'lacking_{name}']} units without a reading, {found[f'repeated_{name}']} with several, of {found['rows']}")
    return out.drop(*[f"{p}{n}" for n in tables for p in ("_", "_n_", "_in_")])


def missing_readings(df: DataFrame, readers: list[str], where: Column) -> DataFrame:
    """One row: of the rows that meet ``where``, how many lack each reader's reading."""
    return df.agg(*[F.count_if(where & (F.coalesce(F.trim(r), F.lit("")) == "")).alias(r) for r in readers])


def differs(readers: list[str]) -> Column:
    """Any two readers differ; null if a reading is missing."""
    lacking = F.exists(F.array(*[F.col(r) for r in readers]), lambda x: x.isNull())
    return F.when(~lacking, F.size(F.array_distinct(F.array(*[F.col(r) for r in readers]))) > 1)


def agreement_gaps(df: DataFrame, readers: list[str], baseline: str, target: str, by: list[str] | None = None) -> DataFrame:
    """(reader, n, n_match, agree_pm, gap_pm): each reader against the target and the baseline on the
    same rows, in one aggregate."""
    by = by or []
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col(r) == F.col(target)).alias(r) for r in [baseline, *readers]]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    each = [F.struct(F.lit(r).alias("reader"), F.col("n"), F.col(r).alias("n_match"), rate(F.col(r), F.col("n"), 1000).alias("agree_pm"), rate(F.col(r) - F.col(baseline), F.col("n"), 1000).alias("gap_pm")) for r in readers]
    return wide.select(*by, F.explode(F.array(*each)).alias("x")).select(*by, "x.*")


def pair_flags(readers: list[str]) -> dict[str, Column]:
    return {f"{a}_{b}": F.col(a) != F.col(b) for i, a in enumerate(readers) for b in readers[i + 1 :]}


def disagreement_patterns(df: DataFrame, readers: list[str]) -> DataFrame:
    """Counts by which pairs of readers differ."""
    return df.select(*[c.cast("int").alias(n) for n, c in pair_flags(readers).items()]).groupBy(*pair_flags(readers)).agg(F.count(F.lit(1)).alias("n"))


def type_disagreement(df: DataFrame, kind: str, readers: list[str]) -> DataFrame:
    return df.groupBy(F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in pair_flags(readers).items()])
